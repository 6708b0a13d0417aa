"""Token-id files: flat unsigned integers plus 64-bit document offsets.

Format, one group of files for each partition ``k`` of the ascending id range:

* ``part-k.ids``  token ids, little-endian, 16 bits if the vocabulary fits, else 32
* ``part-k.off``  int64 token offsets inside the part, one per document plus the end
* ``part-k.doc``  int64 document ids; null ids sort first, their count is in the index
* ``index/``      Parquet, one row per part: part, base, n_tokens, n_docs, n_nulls,
  width; ``base`` is the prefix sum of the parts before it

so a document is ``ids[off[i]:off[i+1]]`` and starts at ``base + off[i]`` overall.
Files are written under a temporary name and renamed, so a retried task leaves
one whole copy; a part's content depends on its rows alone.

Encoding is by the tokenizers library.  Its vocabulary here drops white space and
never joins across it, so a text is encoded chunk by chunk and bounded caches
hold recent chunks and the words within them.  That shortcut is used only after the library itself has
shown, for each white-space character, that a split there changes no id.

Defined cases: null text is empty (its ids are the end id alone); null ids come
first; rows of equal id are ordered by the hash of their text; an empty table
gives no parts and no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_columns, file_system, fresh_path, read, stored, text_hash, AgedCache, worker_state

DOCS_PER_STEP = 512
CACHE_BYTES = 96 << 20  # of chunks, and again of words, in a worker process
INDEX_SCHEMA = "part int, n_docs long, n_nulls long, n_tokens long, width int"

# letters and printable ASCII for which normalising and splitting is the plain rule below
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = itertools.count(256)
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class ChunkEncoder:
    """Encodes texts to the bytes of their ids; equal to the library on whole texts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.cache, self.words = AgedCache(CACHE_BYTES), AgedCache(CACHE_BYTES)
        spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
        both = self.ids(["Ab"])[0] + self.ids(["c1"])[0]
        whole = self.ids([f"Ab{c}c1" for c in spaces])
        unsafe = [c for c, ids in zip(spaces, whole, strict=True) if ids != both]
        self.unsafe = re.compile("[" + "".join(map(re.escape, unsafe)) + "]") if unsafe else None
        self.chunked = len(unsafe) < len(spaces) // 2
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # the plain rule must give the library's ids on samples of all it covers
        letters = [chr(c) for c in range(33, 256) if _PLAIN.fullmatch(chr(c))]
        probe = [a + b for a in letters for b in ("", "x", "'S", "9!", "É")] + ["I'M", "we'll99a", "x's'", "É''re-ß"]
        self.plain = self.chunked and all(
            self._plain(p) == self._bytes(ids) for p, ids in zip(probe, self.ids(probe), strict=True)
            if not any(s in p for s in self.special))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.words.aged(word)
        if got is None:
            mapped = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            got = self._bytes([t.id for t in self.model.tokenize(mapped)])
            self.words.put([(word, got)])
        return got

    def _plain(self, chunk: str) -> bytes:
        return b"".join(map(self._word, _WORDS.findall(chunk.lower())))

    def _new(self, chunks: Iterable[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for c in chunks:
            if self.plain and _PLAIN.fullmatch(c) and not ("<|" in c and any(s in c for s in self.special)):
                out[c] = self._plain(c)
            else:
                rest.append(c)
        if rest:
            out.update(zip(rest, map(self._bytes, self.ids(rest)), strict=True))
        return out

    def encode(self, text: str) -> bytes:
        if not self.chunked or (self.unsafe and self.unsafe.search(text)):
            return self._bytes(self.ids([text])[0])
        self.cache.trim()
        self.words.trim()
        chunks = text.split()
        got = list(map(self.cache.get, chunks))
        if None in got:
            known = {c: self.cache.aged(c) for c, g in zip(chunks, got, strict=True) if g is None}
            new = self._new([c for c, g in known.items() if g is None])
            known.update(new)
            got = [known[c] if g is None else g for c, g in zip(chunks, got, strict=True)]
            self.cache.put(new.items())
        return b"".join(got)


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    return worker_state("token_files", path, functools.partial(ChunkEncoder, path))


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], enc.dtype).tobytes()
    cuts = np.array(bounds, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_PER_STEP):
            b = batch.slice(at, DOCS_PER_STEP)
            ids = [enc.encode(t or "") + end for t in b.column("text").to_pylist()]
            keys = b.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            tie = b.column("th").to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
            share = ((tie.astype(np.float64) + 2.0**63) / 2.0**64 * (hi - lo + 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((lo + np.minimum(share, hi - lo)).astype(np.int32)), b.column("id"), b.column("th"),
                 pa.array(ids, pa.binary())], names=["part", "id", "th", "ids"])


def _write(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    part, tokens, docs, nulls, attempt = None, 0, 0, 0, uuid.uuid4().hex
    offsets: list[np.ndarray] = [np.zeros(1, np.int64)]
    keys: list[np.ndarray] = []
    out = None
    for b in batches:
        if not b.num_rows:
            continue
        if part is None:
            part = b.column("part")[0].as_py()
            out = fs.open_output_stream(f"{base}/.tmp-{attempt}.ids")
        col = b.column("ids")
        for x in col:
            out.write(x.as_buffer())
        n = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]) // width
        offsets.append(tokens + np.cumsum(n.astype(np.int64)))
        tokens, docs = tokens + int(n.sum()), docs + len(n)
        nulls += b.column("id").null_count
        keys.append(b.column("id").fill_null(0).to_numpy(zero_copy_only=False))
    if part is None:
        return
    out.close()
    for kind, data in (("off", offsets), ("doc", keys)):
        with fs.open_output_stream(f"{base}/.tmp-{attempt}.{kind}") as f:
            f.write(np.concatenate(data).astype("<i8").tobytes())
    for kind in ("ids", "off", "doc"):
        fs.move(f"{base}/.tmp-{attempt}.{kind}", f"{base}/part-{part:06d}.{kind}")
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()),
                                      pa.array([nulls], pa.int64()), pa.array([tokens], pa.int64()),
                                      pa.array([width], pa.int32())],
                                     names=["part", "n_docs", "n_nulls", "n_tokens", "width"])


def _open(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is mounted, read otherwise."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = file_system(folder)
    for b in batches:
        for row in b.to_pylist():
            name = f"{base}/part-{row['part']:06d}"
            ids = _open(fs, f"{name}.ids", "<u2" if row["width"] == 2 else "<u4")
            off, doc = _open(fs, f"{name}.off", "<i8"), _open(fs, f"{name}.doc", "<i8")
            for at in range(0, len(doc), 20_000):
                o = off[at:at + 20_001]
                keys = pa.array(doc[at:at + 20_000], pa.int64(),
                                mask=np.arange(at, at + len(o) - 1) < row["n_nulls"])
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in itertools.pairwise(o.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(o[:-1] + row["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, tokenizer_path: str, end_id: int, parts: int, folder: str | None = None,
          key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and the index."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    d = doc_columns(docs, key, text).withColumn("th", text_hash(F.col("text")))
    cuts = [i / parts for i in range(1, parts)]
    bounds = d.select(F.percentile_approx(F.coalesce("id", F.lit(-(1 << 63))), cuts, 100 * parts).alias("b")).first()["b"] if cuts else []
    width = encoder(tokenizer_path).dtype.itemsize
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    rows = d.mapInArrow(functools.partial(_encode, path=tokenizer_path, end_id=end_id, bounds=list(bounds or [])),
                        "part int, id long, th long, ids binary")
    index = stored(rows.repartitionById(parts, F.col("part")).sortWithinPartitions("id", "th")
                   .mapInArrow(functools.partial(_write, folder=folder, width=width), INDEX_SCHEMA), "tokens-index")
    # one row per part: the prefix sum over them is as small as the number of tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    index.coalesce(1).write.parquet(f"{folder}/index")
    return folder, index


def documents(spark: SparkSession, folder: str, parts: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the files have them."""
    index = spark.read.parquet(f"{folder}/index")
    return index.repartition(parts, "part").mapInArrow(
        functools.partial(_read, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder, _ = write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, parts)
    return documents(spark, folder, parts)
