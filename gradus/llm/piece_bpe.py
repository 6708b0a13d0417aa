"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they would form (ties: leftmost first), merges the best pair, links its new
neighbours and goes on until the agenda is empty; symbols that are no piece fall
back to byte pieces.  No piece holds a space after another character, so no merge
crosses the start of a word: texts are cut there, and a bounded cache holds the
ids of recent words.

In every Arrow batch the words not seen before are checked against the
sentencepiece library, encoded and decoded, and so is one whole text; any
difference raises.

Defined cases: null text is empty; empty text has no ids and decodes to empty;
U+2581 in a text is a space to the vocabulary and decodes to one; repeated rows
and null ids are kept; other columns are not touched.  Vocabularies without byte
fallback, with user-defined or unused pieces, or with a normaliser raise ValueError.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import heapq
import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, read, WordCache, worker_state

SPACE = "▁"
SHORT = 48  # symbols
SYMBOL_BITS = 20
NONE = 1 << 62
BLOCK_WORDS = 8_192
CACHE_BYTES = 96 << 20
DOCS_PER_STEP = 512
_UTF8 = np.array([0x80, 0x800, 0x10000])  # first code points of two, three and four bytes
_RUNS = re.compile(" *[^ ]+| +$")


class PieceBpe:
    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.scores = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if i not in special}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        if not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte fallback")
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not supported")
        probe = "  Ab ＡÉ ﬁ\tx  "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("vocabularies with a normaliser are not supported")
        self.text_of = [p.replace(SPACE, " ") for p in self.pieces]
        for i in range(n):
            if sp.is_control(i):
                self.text_of[i] = ""
            elif sp.is_unknown(i):
                self.text_of[i] = " ⁇ "
        for b in range(128):
            self.text_of[self.bytes[b]] = chr(b)
        # a control piece has no text but ends a run of bytes: 0xFF is in no valid text
        self.raw_of = [t.encode() or b"\xff" for t in self.text_of]
        for b in range(128, 256):
            self.raw_of[self.bytes[b]] = bytes([b])
        self.byte_ids = np.array(self.bytes, np.uint32)
        self.decimal = list(map(str, range(n)))
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cache = WordCache(CACHE_BYTES)
        self._number_pairs()

    def _number_pairs(self) -> None:
        """Symbols by number: pieces by their ids, further characters of pieces above them,
        then all other characters, which form no pair.

        A pair of symbols, as one integer, has the rank of the piece that they make and its
        number, so a smaller value has the higher score.  Pieces of tied scores cannot be
        ranked so: their pairs have -1, and words that meet one take the agenda of strings.
        """
        symbols = dict(self.ids)
        for c in sorted(set("".join(self.ids)) - self.ids.keys()):
            symbols[c] = len(self.pieces) + len(symbols) - len(self.ids)
        self.other = len(self.pieces) + len(symbols)
        self.symbol_of = np.full(sys.maxunicode + 1, self.other, np.int32)
        for c, number in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = number
        times = collections.Counter(self.scores.values())
        pairs: dict[int, int] = {}
        get = symbols.get
        for rank, piece in enumerate(sorted(self.scores, key=self.scores.__getitem__, reverse=True)):
            for i in range(1, len(piece)):
                if (a := get(piece[:i])) is not None and (b := get(piece[i:])) is not None:
                    pairs[a << SYMBOL_BITS | b] = rank << SYMBOL_BITS | self.ids[piece] if times[self.scores[piece]] == 1 else -1
        self.pair = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.by_number = bool(pairs) and self.other < 1 << SYMBOL_BITS

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << SYMBOL_BITS | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.made[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, whose spaces are U+2581, one after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(size <= SHORT) if self.by_number else np.zeros(0, np.int64)
        short = short[np.argsort(size[short], kind="stable")]  # words of a block are of like length
        blocks = [short[s:s + BLOCK_WORDS] for s in range(0, len(short), BLOCK_WORDS)]
        order, flat, count = [], [], []
        rest = [np.setdiff1d(np.arange(len(words)), short)]
        for block in blocks:
            ids, n, tied = self._merge_block([words[i] for i in block.tolist()], size[block])
            rest.append(block[tied])
            order.append(block[~tied])
            flat.append(ids)
            count.append(n)
        for i in np.concatenate(rest).tolist():
            ids = self.agenda(words[i])
            order.append(np.array([i]))
            flat.append(np.array(ids, np.uint32))
            count.append(np.array([len(ids)]))
        where = np.concatenate(order)
        n = np.empty(len(words), np.int64)
        n[where] = got = np.concatenate(count)
        start = np.empty(len(words), np.int64)
        start[where] = np.cumsum(got) - got
        pick = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.concatenate(flat)[pick], n

    def _merge_block(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every word's agenda at once, a row of scores each: a step merges the best pair
        (the leftmost of equals) of every word that has one left.

        Returns the ids of the words without a tied pair, how many each has, and which have one.
        """
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        width = int(size.max())
        cell = np.repeat(np.arange(len(words)) * width - (np.cumsum(size) - size), size) + np.arange(len(chars))
        sym = np.full(len(words) * width + 1, self.other, np.int32)  # the last cell is beyond every end
        sym[cell] = self.symbol_of[chars]
        end = len(sym) - 1
        right, left = np.full(len(sym), end), np.full(len(sym), end)
        inner = cell[1:] == cell[:-1] + 1
        inner &= cell[1:] % width != 0
        right[cell[:-1][inner]] = cell[1:][inner]
        left[cell[1:][inner]] = cell[:-1][inner]
        score = np.full(len(sym), NONE)
        score[cell] = self._made(sym[cell], sym[right[cell]])
        rows = score[:-1].reshape(len(words), width)
        live = np.zeros(len(sym), bool)
        live[cell] = True
        tied = np.zeros(len(words), bool)
        active = np.arange(len(words))
        while len(active):
            at = rows[active].argmin(axis=1)
            i = active * width + at
            best = score[i]
            tied[active[best < 0]] = True
            go = (best >= 0) & (best < NONE)
            active, i, best = active[go], i[go], best[go]
            gone = right[i]
            sym[i] = best & ((1 << SYMBOL_BITS) - 1)
            live[gone] = False
            score[gone] = NONE
            right[i] = after = right[gone]
            left[after] = i
            score[i] = self._made(sym[i], sym[after])
            before = left[i]
            score[before] = self._made(sym[before], sym[i])
            score[end] = NONE
            left[end] = end
        char = np.zeros(len(sym), np.uint32)
        char[cell] = chars
        row = np.arange(len(sym) - 1) // width
        pos = np.flatnonzero(live[:-1] & ~tied[row])
        own = sym[pos]
        odd = own >= len(self.pieces)  # characters that are no piece
        data = char[pos[odd]].tobytes().decode("utf-32-le")
        raw = np.frombuffer(data.encode(), np.uint8)
        wide = np.ones(len(pos), np.int64)
        wide[odd] = np.searchsorted(_UTF8, char[pos[odd]], "right") + 1
        ids = np.repeat(own, wide).astype(np.uint32)
        ids[np.repeat(odd, wide)] = self.byte_ids[raw]
        n = np.bincount(row[pos], wide, len(words)).astype(np.int64)
        return ids, n[~tied], tied

    def agenda(self, text: str) -> list[int]:
        """Ids of ``text``, whose spaces are U+2581, by the score-ordered agenda."""
        sym = list(text)
        return self._ids(self._merge_long(sym) if len(sym) > SHORT else self._merge_short(sym))

    def _merge_short(self, sym: list[str]) -> list[str]:
        """The agenda as a plain list of the pairs' scores: few pairs are scanned faster
        than a heap is kept."""
        get, none = self.scores.get, -np.inf
        queue = [get(a + b, none) for a, b in itertools.pairwise(sym)]
        while queue and (best := max(queue)) != none:
            i = queue.index(best)  # the leftmost of equals
            sym[i] += sym.pop(i + 1)
            del queue[i]
            if i < len(queue):
                queue[i] = get(sym[i] + sym[i + 1], none)
            if i:
                queue[i - 1] = get(sym[i - 1] + sym[i], none)
        return sym

    def _merge_long(self, sym: list[str]) -> list[str]:
        """The agenda as a heap with lazy deletion."""
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        queue: list[tuple[float, int, int, str]] = []
        scores = self.scores
        for i in range(len(sym) - 1):
            pair = sym[i] + sym[i + 1]
            if pair in scores:
                queue.append((-scores[pair], i, i + 1, pair))
        heapq.heapify(queue)
        while queue:
            _, a, b, pair = heapq.heappop(queue)
            if right[a] != b or not sym[a] or sym[a] + sym[b] != pair:
                continue  # one of the two has been merged meanwhile
            sym[a], sym[b] = pair, ""
            c = right[a] = right[b]
            right[b] = -1
            if c >= 0:
                left[c] = a
                if (new := pair + sym[c]) in scores:
                    heapq.heappush(queue, (-scores[new], a, c, new))
            if (z := left[a]) >= 0 and (new := sym[z] + pair) in scores:
                heapq.heappush(queue, (-scores[new], z, a, new))
        return [s for s in sym if s]

    def _ids(self, sym: list[str]) -> list[int]:
        out: list[int] = []
        for s in sym:
            i = self.ids.get(s)
            if i is None:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(i)
        return out

    def _words(self, text: str) -> list[str]:
        """Pieces of the text, each without the one space that it starts with."""
        if not self.by_word:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _RUNS.findall(" " + text)]
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        self.cache.trim()
        cut = [self._words(t.replace(SPACE, " ")) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in self.cache})
        if new:
            ids, n = self.encode_words([SPACE + w.replace(" ", SPACE) for w in new])
            self.check_words(new, ids, n)
            data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            packed = {w: data[a:b] for w, a, b in zip(new, [0, *ends[:-1]], ends, strict=True)}
            self.cache.put(packed.items())
        long = {w: p for w, p in packed.items() if w not in self.cache} if new else {}
        look = self.cache.__getitem__ if not long else lambda w: self.cache.get(w) or long[w]
        out = [np.frombuffer(b"".join(map(look, words)), "<u4") for words in cut]
        for t, ids in zip(texts, out, strict=True):
            if t:
                self.check(t, ids.tolist())
                break
        return out

    def check_words(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        """The empty word, a space alone, is left out: the library takes it for no text."""
        want = self.library.encode(words, num_threads=1)
        if "" in words:
            want[words.index("")] = [self.ids[SPACE]]
        if list(map(len, want)) != n.tolist() or list(itertools.chain.from_iterable(want)) != (flat := ids.tolist()):
            raise RuntimeError("ids differ from the sentencepiece library's")
        # all ids as one text: every word starts with its space, so no run of bytes crosses two
        if self.library.decode(flat) != self.decode(flat):
            raise RuntimeError("decoded texts differ from the sentencepiece library's")

    def check(self, text: str, ids: list[int]) -> None:
        if self.library.encode(text, num_threads=1) != ids or self.library.decode(ids) != self.decode(ids):
            raise RuntimeError("a text differs from the sentencepiece library's")

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: one leading space goes, runs of byte pieces become characters."""
        if not ids:
            return ""
        try:
            # no piece starts within a character, so what is valid as a whole is so in each run
            text = b"".join(map(self.raw_of.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                parts += [self._chars(run), self.text_of[i]]
                run.clear()
            text = "".join([*parts, self._chars(run)])
        if text[:1] != " ":
            return text
        first = next((self.pieces[i] for i in ids if self.text_of[i]), "")
        return text[1:] if first.startswith(SPACE) else text

    @staticmethod
    def _chars(run: bytearray) -> str:
        """UTF-8 of a run of byte pieces; every byte of no character becomes U+FFFD."""
        out, at = [], 0
        while at < len(run):
            lead = run[at]
            n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4
            try:
                out.append(bytes(run[at:at + n]).decode())
                at += n
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


def vocabulary(path: str) -> PieceBpe:
    """One for each worker process."""
    return worker_state("piece_bpe", path, functools.partial(PieceBpe, path))


def _steps(batches: Iterator[pa.RecordBatch], path: str):
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_PER_STEP):
            b = batch.slice(at, DOCS_PER_STEP)
            yield b, vocabulary(path).encode_batch([t or "" for t in b.column("text").to_pylist()])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for b, ids in _steps(batches, path):
        v = vocabulary(path)
        lists = [x.tolist() for x in ids]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(map(len, lists), pa.int64()),
             pa.array([sha(",".join(map(v.decimal.__getitem__, x)).encode()).hexdigest() for x in lists]),
             pa.array([sha(v.decode(x).encode()).hexdigest() for x in lists])],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b, ids in _steps(batches, path):
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in b.schema.names), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
             pa.array([len(x) for x in ids], pa.int64())], names=[*b.schema.names, "token_ids", "n_tokens"])


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decode = vocabulary(path).decode
    for b in batches:
        texts = [None if x is None else decode(x) for x in b.column("token_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(texts, pa.string())],
                                         names=[*b.schema.names, "decoded"])


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids array<int> and n_tokens; columns of these names are replaced."""
    docs = docs.drop("token_ids", "n_tokens")
    plain = docs if text == "text" else docs.drop("text").withColumnRenamed(text, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = plain.mapInArrow(functools.partial(_ids, path=model_path), schema + ", token_ids array<int>, n_tokens long")
    return out if text == "text" else out.withColumnRenamed("text", text)


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """``df``, which has token_ids, with the column decoded; null ids decode to null."""
    df = df.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(functools.partial(_texts, path=model_path), schema + ", decoded string")


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    return _texts(_ids(batches, path), path)


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass: two passes in a row would take two worker
    processes a task, each with a vocabulary and a cache of its own."""
    docs = docs.drop("token_ids", "n_tokens", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(functools.partial(_coded, path=model_path),
                           schema + ", token_ids array<int>, n_tokens long, decoded string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of all ids and of the text decoded from them."""
    return doc_columns(docs).mapInArrow(functools.partial(_digests, path=model_path),
                                        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
