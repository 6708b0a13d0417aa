"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
The automaton holds every word sequence of the items.  A document's words are
streamed through it, tracking the longest match that ends at each word: where it
reaches the window length, or is a whole item shorter than that, the words of the
window are hit.  Stretches whose adjacent word pairs occur in no item cannot hold
a window and are skipped before streaming.

Items are cut into shards of about ``SHARD_WORDS`` words, which tasks write to and read
from the shared folder; longer items are cut into pieces that overlap by a window less one
word.  A task runs stretches of its documents through one shard's automaton after the
other and holds one at a time, so more items cost passes over a stretch, not memory.
Documents are never shuffled, and items never pass through the driver.

Defined cases: null or empty text has no words and is not contaminated; null or
empty items have no windows; a null item id counts as the empty id; repeated items
count once per id; repeated documents are judged alike; very long texts are scanned
whole; other columns are not looked at by ``judge`` and carried along by ``clean``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, file_system, fresh_path, read, stored, worker_state

WINDOW = 10
SHARD_WORDS = 100_000
DOCS_PER_STEP = 512
HELD_BYTES = 16 << 20
_WORD_BYTES = [c for c in range(256) if c >= 0x80 or chr(c).isalnum()]
TABLE = bytes(ord(chr(c).lower()) if c in _WORD_BYTES and c < 0x80 else c if c in _WORD_BYTES else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        coded = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in words] for _, words in items]
        short: dict[int, list[int]] = {}
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min((min(len(s), window) for s in coded if s), default=0)
        for k, seq in enumerate(coded):
            if 0 < len(seq) < window:
                v = 0
                for c in seq:
                    v = self.next[v][c]
                short.setdefault(v, []).append(k)
        # short items that end in a state's strings, along its suffix links
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.short = short
        self.short_up = [-1] * len(self.link)
        for v in order:
            up = self.link[v]
            self.short_up[v] = up if up in short else self.short_up[up] if up > 0 else -1
        self.items: dict[int, set[int]] = {}
        for k, seq in enumerate(coded):
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.items.setdefault(self._window_state(v), set()).add(k)
        pairs = np.array([a << 32 | b for s in coded for a, b in itertools.pairwise(s)], np.int64)
        self.pairs = np.zeros(1 << 22, bool)
        self.pairs[self._slot(pairs)] = True

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings of ``q`` up to one word more than ``p``'s."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _window_state(self, v: int) -> int:
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges [start, end), in any order, and the numbers of the items."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        codes = np.fromiter(map(self.vocab.get, words, itertools.repeat(0)), np.int64, len(words))
        if self.shortest > 1:
            ok = self.pairs[self._slot(codes[:-1] << 32 | codes[1:])] & (codes[:-1] > 0) & (codes[1:] > 0)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2] + 1
        else:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], codes > 0, [False]]).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.shortest
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, n = self.next, self.link, self.length, self.window
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            v = matched = 0
            for i, c in enumerate(codes[s:e].tolist(), s + 1):
                while v and c not in nxt[v]:
                    v = link[v]
                    matched = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    matched += 1
                if matched >= n:
                    hits.append((i - n, i))
                    found |= self.items[self._window_state(v)]
                u = v if v in self.short and matched == length[v] else self.short_up[v]
                while u > 0:
                    hits.append((i - length[u], i))
                    found.update(self.short[u])
                    u = self.short_up[u]
        return hits, found


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Words of the items, cut into pieces of ``most`` that overlap by a window less one word."""
    for b in batches:
        rows = []
        for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1), most - window + 1) if words else ():
                rows.append((name, b" ".join(words[at:at + most]), len(words[at:at + most])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["name", "words", "n"])


def _shards(items: DataFrame, item_id: str, text: str, window: int) -> tuple[str, int]:
    """Folder of the shards and their number; written by tasks, read by tasks."""
    it = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"),
                      F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null").distinct()
    pieces = stored(it.mapInArrow(functools.partial(_pieces, window=window, most=max(2 * window, SHARD_WORDS // 8)), "name string, words binary, n long"), "items")
    count = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS))
    path = fresh_path(items.sparkSession, "shards")
    shard = F.pmod(F.xxhash64("name", "words"), F.lit(count))
    pieces.select(shard.alias("shard"), "name", "words").repartition(count, "shard").write.partitionBy("shard").parquet(path)
    return path, count


def _items(path: str, shard: int) -> list[tuple[str, list[bytes]]]:
    fs, base = file_system(path)
    folder = pafs.FileSelector(f"{base}/shard={shard}", allow_not_found=True)
    files = sorted(f.path for f in fs.get_file_info(folder) if f.path.endswith(".parquet"))
    rows = [r for f in files for r in pq.ParquetFile(fs.open_input_file(f)).read(["name", "words"]).to_pylist()]
    return sorted((r["name"], r["words"].split()) for r in rows)


def _scanned(batches: Iterator[pa.RecordBatch], column: str, path: str, shards: int, window: int):
    """(batch, raw texts, (words, merged hit word ranges, sorted item ids) of each).

    Up to ``HELD_BYTES`` of a task's texts meet one shard's automaton after the other, so
    an automaton is built once for that many texts, and is the only one in memory.
    """
    def results(held):
        found = [[(0, [], set()) for _ in texts] for _, texts in held]
        for shard in range(shards):
            auto = worker_state("leaks", (path, shard, window), lambda s=shard: Automaton(_items(path, s), window))
            for out, (_, texts) in zip(found, held, strict=True):
                for k, t in enumerate(texts):
                    words = words_of(t)
                    got, items = auto.scan(words)
                    out[k] = len(words), out[k][1] + got, out[k][2].union(auto.names[i] for i in items) if got else out[k][2]
        for out, (b, texts) in zip(found, held, strict=True):
            yield b, texts, [(n, _merged(hits), sorted(items)) for n, hits, items in out]

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_PER_STEP):
            b = batch.slice(at, DOCS_PER_STEP)
            texts = [t.encode() if isinstance(t, str) else t or b"" for t in b.column(column).to_pylist()]
            held.append((b, texts))
            size += sum(map(len, texts))
            if size > HELD_BYTES:
                yield from results(held)
                held, size = [], 0
    if held:
        yield from results(held)


def _merged(hits: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _judge(batches: Iterator[pa.RecordBatch], path: str, shards: int, window: int) -> Iterator[pa.RecordBatch]:
    for b, _, got in _scanned(batches, "text", path, shards, window):
        hit = [sum(e - s for s, e in spans) for _, spans, _ in got]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array([n for n, _, _ in got], pa.int64()), pa.array(hit, pa.int64()),
             pa.array([len(i) for _, _, i in got], pa.int64()),
             pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, _, i in got]),
             pa.array([h > 0 for h in hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _word_offsets(text: bytes) -> np.ndarray:
    """[start, end) of each word in the bytes of a text."""
    inside = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    return np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))).reshape(-1, 2)


def _clean(batches: Iterator[pa.RecordBatch], path: str, shards: int, window: int, text: str,
           max_coverage: float) -> Iterator[pa.RecordBatch]:
    for b, raw, got in _scanned(batches, text, path, shards, window):
        column, keep = b.column(text).to_pylist(), []
        for k, (n, spans, _) in enumerate(got):
            hit = sum(e - s for s, e in spans)
            keep.append(not hit or hit <= max_coverage * n)
            if hit:
                off = _word_offsets(raw[k])
                cut = [0, *itertools.chain.from_iterable((off[s, 0], off[e - 1, 1]) for s, e in spans), len(raw[k])]
                column[k] = b"".join(raw[k][i:j] for i, j in zip(cut[::2], cut[1::2], strict=True)).decode()
        arrays = [pa.array(column, b.schema.field(n).type) if n == text else b.column(n) for n in b.schema.names]
        yield pa.RecordBatch.from_arrays(arrays, schema=b.schema).filter(pa.array(keep))


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    path, shards = _shards(items, item_id, item_text, window)
    return (doc_columns(docs).select("id", F.col("text").cast("binary").alias("text"))
            .mapInArrow(functools.partial(_judge, path=path, shards=shards, window=window),
                        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with every hit span cut from the text, and without documents of
    whose words more than ``max_coverage`` are hit."""
    path, shards = _shards(items, item_id, item_text, window)
    return docs.mapInArrow(functools.partial(_clean, path=path, shards=shards, window=window, text=text,
                                             max_coverage=max_coverage), docs.schema)


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT rid, dw.k, i, item FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS names
        FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
