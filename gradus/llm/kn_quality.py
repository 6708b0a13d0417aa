"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

The units are UTF-8 bytes, the order is ``ORDER``, one model for each language.
Counting is a pass over all trusted training texts (partial counts in the tasks,
summed by a shuffle on language and n-gram).  Continuation counts, contexts and
discounts of the lower orders are aggregations of the order above, and
probabilities are built from order 1 up by equi-joins of count tables, sharded by
n-gram; nothing of them is gathered.  The finished tables lie in the shared folder
in shards of about ``SHARD`` entries, cut by the byte before the predicted one: all
that a position needs is in one shard.  Scoring is one pass over all documents
without a shuffle; a worker holds one shard at a time (the last one stays loaded).

A document's perplexity is exp(-mean log p) over its bytes.  A fifth of the trusted
documents, by a hash of the id, is not trained on; the ``quantile`` of their
perplexities in each language is that language's threshold, and documents above
the threshold are rejected.

Defined cases: null and empty texts have no perplexity and are kept; so are
documents of a language without trusted text (there is nothing to judge by); a null
language is a language of its own; without calibration texts a language has no
threshold and rejects nothing; a null id is never trusted; repeated labels trust an
id if any says so.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, fresh_path, read, stored, text_hash, worker_state

ORDER = 5
SHARD = 4_000_000
QUANTILE = 0.99
BROADCAST_IDS = 1_000_000
STEP_BYTES = 400_000
HELD_BYTES = 64 << 20  # shards of a worker process
FLUSH = 1_500_000


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of all bytes (oldest byte highest; zero bytes before a text), and
    where each text's begin."""
    pad = b"\0" * (order - 1)
    buf = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
    code = np.zeros(len(buf), np.uint64)
    for j in range(order):
        code[j:] |= buf[:len(buf) - j] << np.uint64(8 * j)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + order - 1) - size
    keep = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return code[keep], np.concatenate([[0], np.cumsum(size)])


def _steps(texts: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > STEP_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([p[0] for p in parts])
    names, at = np.unique(code, return_inverse=True)
    return names, np.bincount(at, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    worker_state("kn_quality")
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows(lang: str) -> pa.RecordBatch:
        code, n = _merged(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)],
                                          names=["lang", "g", "c"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
            for s in _steps(own):
                code, n = np.unique(_codes(own[s], order)[0], return_counts=True)
                held.setdefault(lang, []).append((code, n))
                if sum(len(p[0]) for p in held[lang]) > FLUSH:
                    held[lang] = [_merged(held[lang])]
                    if len(held[lang][0][0]) > FLUSH // 2:
                        yield rows(lang)
    for lang in list(held):
        yield rows(lang)


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 from the counts of counts (Chen and Goodman 1998)."""
    n = counts.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [(k, F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0),
                    F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))) for k in (1, 2, 3)]
    # too few counts to estimate from, or an estimate out of range: half of each count's room
    return n.select("lang", *[F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(x, F.lit(k - 0.5)))).alias(f"d{k}")
                              for k, x in d])


def tables(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, kind, m, code, value: kind 0 is log p of a seen m-gram, kind 1 the log of
    a context's weight for the order below."""
    counts = {order: grams}
    for m in range(order - 1, 0, -1):
        counts[m] = stored(counts[m + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("g"))
                           .agg(F.count("*").alias("c")), "continuations")
    out = []
    below = None
    for m in range(1, order + 1):
        c = counts[m].join(discounts(counts[m]), "lang").withColumn("ctx", F.shiftright("g", 8))
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        ctx = c.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum(d) / F.sum("c")).alias("gamma"))
        p = c.select("lang", "g", "ctx", (F.col("c") - d).alias("rest")).join(ctx, ["lang", "ctx"])
        if below is None:
            p = p.withColumn("low", F.lit(1 / 256))
        else:
            p = p.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))).join(
                below.select("lang", F.col("g").alias("s"), F.col("p").alias("low")), ["lang", "s"])
        below = stored(p.select("lang", "g", (F.col("rest") / F.col("total") + F.col("gamma") * F.col("low")).alias("p")), "probabilities")
        out.append(below.select("lang", F.lit(0).alias("kind"), F.lit(m).alias("m"), F.col("g").alias("code"),
                                F.log("p").alias("value")))
        out.append(ctx.select("lang", F.lit(1).alias("kind"), F.lit(m).alias("m"), F.col("ctx").alias("code"),
                              F.log("gamma").alias("value")))
    return functools.reduce(DataFrame.unionByName, out)


def _folder(lang: str) -> str:
    return hashlib.md5(lang.encode()).hexdigest()


def save(model: DataFrame) -> str:
    """Writes the tables in shards; returns the folder."""
    path = fresh_path(model.sparkSession, "kn-model")
    model = stored(model, "kn-tables")
    size = model.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    byte = F.when(F.col("kind") == 0, F.shiftright("code", 8)).otherwise(F.col("code")).bitwiseAND(F.lit(0xFF))
    # order 1 has no byte before the predicted one: every shard has it
    home = F.when(F.col("m") > 1, F.array(F.pmod(byte, F.col("shards")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("shards") - 1))
    (model.join(size, "lang").withColumn("shard", F.explode(home)).withColumn("folder", F.md5("lang"))
     .withColumn("part", F.concat_ws("-", "folder", "shard", "shards"))
     .repartition("part").write.partitionBy("part").parquet(path))
    return path


class Shard:
    """Sorted codes and values of each (kind, order)."""

    def __init__(self, table: pa.Table):
        kind, m = table.column("kind").to_numpy(), table.column("m").to_numpy()
        code, value = table.column("code").to_numpy(), table.column("value").to_numpy()
        self.codes: dict[tuple[int, int], np.ndarray] = {}
        self.values: dict[tuple[int, int], np.ndarray] = {}
        for k in {(int(a), int(b)) for a, b in np.unique(np.stack([kind, m]), axis=1).T}:
            own = np.flatnonzero((kind == k[0]) & (m == k[1]))
            own = own[np.argsort(code[own])]
            self.codes[k], self.values[k] = code[own].astype(np.uint64), value[own]

    def find(self, kind: int, m: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = self.codes.get((kind, m), np.zeros(0, np.uint64))
        if not len(names):
            return np.zeros(len(code), bool), np.zeros(len(code))
        at = np.minimum(np.searchsorted(names, code), len(names) - 1)
        return names[at] == code, self.values[(kind, m)][at]

    def log_p(self, code: np.ndarray, order: int) -> np.ndarray:
        """log p of each n-gram's last byte after the bytes before it."""
        out = np.zeros(len(code))
        rest = np.arange(len(code))
        for m in range(order, 0, -1):
            if not len(rest):
                return out
            g = code[rest] & np.uint64((1 << 8 * m) - 1)
            hit, value = self.find(0, m, g)
            out[rest[hit]] += value[hit]
            rest, g = rest[~hit], g[~hit]
            seen, weight = self.find(1, m, g >> np.uint64(8))
            out[rest] += np.where(seen, weight, 0)
        out[rest] += np.log(1 / 256)
        return out


class Model:
    """The shards of a folder; the latest used stay loaded, up to ``HELD_BYTES``."""

    def __init__(self, path: str):
        self.fs, self.base = file_system(path)
        self.parts: dict[str, list[tuple[int, int, str]]] = {}
        for f in self.fs.get_file_info(pafs.FileSelector(self.base)):
            name = f.path.rsplit("/", 1)[-1]
            if name.startswith("part="):
                lang, shard, shards = name[5:].split("-")
                self.parts.setdefault(lang, []).append((int(shard), int(shards), f.path))
        self.loaded: dict[str, tuple[Shard, int]] = {}

    def _load(self, path: str) -> Shard:
        got = self.loaded.pop(path, None)
        if got is None:
            files = [f.path for f in self.fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
            table = pa.concat_tables([pq.ParquetFile(self.fs.open_input_file(f)).read(["kind", "m", "code", "value"]) for f in sorted(files)])
            while self.loaded and table.nbytes + sum(n for _, n in self.loaded.values()) > HELD_BYTES:
                del self.loaded[next(iter(self.loaded))]
            got = (Shard(table), table.nbytes)
        self.loaded[path] = got
        return got[0]

    def sums(self, lang: str, texts: list[bytes], order: int) -> np.ndarray | None:
        """Sum of log p of each text; None without a model of the language."""
        parts = self.parts.get(_folder(lang))
        if parts is None:
            return None
        out = np.zeros(len(texts))
        for shard, shards, path in sorted(parts):
            table = self._load(path)
            for s in _steps(texts):
                code, ptr = _codes(texts[s], order)
                own = (code >> np.uint64(8) & np.uint64(0xFF)) % np.uint64(shards) == np.uint64(shard)
                lp = np.zeros(len(code))
                lp[own] = table.log_p(code[own], order)
                total = np.concatenate([[0.0], np.cumsum(lp)])
                out[s] += total[ptr[1:]] - total[ptr[:-1]]
        return out


def _perplexities(batches: Iterator[pa.RecordBatch], path: str, order: int) -> Iterator[pa.RecordBatch]:
    model = worker_state("kn_quality", path, functools.partial(Model, path))
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        out: list[float | None] = [None] * len(texts)
        for lang in dict.fromkeys(langs):
            own = [i for i, x in enumerate(langs) if x == lang and texts[i]]
            sums = model.sums(lang, [texts[i] for i in own], order)
            if sums is not None:
                for i, s in zip(own, sums.tolist(), strict=True):
                    out[i] = float(np.exp(min(700.0, -s / len(texts[i]))))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())],
                                         names=[*names, "perplexity"])


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """id, th (hash of the text), lang, perplexity, threshold, kept of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text").cast("string")).alias("th"),
                    F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                    F.col("text").cast("string").cast("binary").alias("text"))
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    trusted = stored(trusted, "trusted")
    near = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted  # 8 MB of ids, or a shuffle join
    aside = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 0
    grams = stored(d.join(near, "id").where(~aside).select("lang", "text").mapInArrow(
        functools.partial(_count, order=order), "lang string, g long, c long")
        .groupBy("lang", "g").agg(F.sum("c").alias("c")), "grams")
    path = save(tables(grams, order))
    scored = stored(d.mapInArrow(functools.partial(_perplexities, path=path, order=order),
                                 "id long, th long, lang string, perplexity double"), "perplexities")
    limits = (scored.join(near, "id").where(aside).groupBy("lang")
              .agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold")))
    return scored.join(limits, "lang", "left").withColumn(
        "kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def op5_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "lang", "perplexity", "threshold", "kept")
