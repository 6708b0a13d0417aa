"""Near-duplicates by fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017).

A document is the set of its distinct word shingles.  Its sketch has ``t``
coordinates, filled in rounds: in round i < t each shingle falls into a hashed bin
with the value (i, hash), in round t + j all fall into bin j; a bin keeps its
smallest value.  Every coordinate is filled after 2t rounds, documents of many
shingles after one or two, and the share of equal coordinates is concentrated
around the Jaccard similarity.  Coordinates are banded; documents that share a band
are candidates and are confirmed on their full shingle sets.

Equal sets are one class from the start.  Pairs of a bucket are compared in bounded blocks
and only a few for each member leave a block:

1. each bucket links its members to two of them (smallest and largest class hash);
   confirmed links give first components;
2. buckets that still hold several components are looked at in blocks of at most
   ``BLOCK`` members, where sketches rule out pairs in numpy: a pair is dropped if its
   equal coordinates are five deviations below the threshold, and looked at in the first
   band that it shares only.  First every member's likeliest candidates of other
   components are confirmed on full sets, which joins most of a group of near copies.
   Then all that are left are compared in their blocks on sets of short hashes; a block
   returns a spanning forest of the links that these prove, and pairs at the threshold
   itself, and both are confirmed on full sets.  A bucket of m members that are left in
   several components still has (m / ``BLOCK``)^2 / 2 pairs of blocks.

Misses: a pair at the threshold s shares no band with probability (1 - s^rows)^bands:
1e-9 at 0.85 and 1e-6 at 0.8 with the default 36 bands of 5.

Defined cases: null and empty texts, or texts without words, have the empty set and
link with nothing; very long texts are sets like any other, a text to a numpy step;
columns other than id and text are not looked at, whatever their names (``one_of_each``
reserves ``__i``, ``__h``, ``__id`` and ``__th``); a null id counts after all others as the smallest of a group;
repeated rows are one class; a document of fewer words than a shingle has its whole
sequence as one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, doc_columns, read, stored, text_hash, worker_state
from .rolling import Spans, mix, runs

BANDS, ROWS = 36, 5
BLOCK = 512
LIKELIEST = (2,)  # candidates of a member in the rounds before the one that takes all
STEP_BYTES = 400_000
STEP_DOCS = 4_000
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def steps(texts: list[bytes]) -> Iterator[slice]:
    """Stretches of bounded size."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > STEP_BYTES or i - start >= STEP_DOCS):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def shingle_sets(texts: list[bytes], k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    raw = b"\n".join(t.lower() for t in texts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[buf]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(first, start, "right") - 1
    word = Spans(buf)(start, end) ^ mix(np.uint64(seed) + np.zeros(1, np.uint64))
    n_words = np.bincount(doc, minlength=len(texts))
    n = max(0, len(word) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h + word[j:j + n] + np.uint64(j + 1))
    whole = doc[:n] == doc[k - 1:k - 1 + n]
    h, d = h[whole], doc[:n][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        begin = np.cumsum(n_words) - n_words
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n_words[short] > j
            extra[has] = mix(extra[has] + word[begin[short][has] + j] + np.uint64(j + 1))
        extra = mix(extra ^ (n_words[short].astype(np.uint64) << np.uint64(40)))
        h, d = np.concatenate([h, extra]), np.concatenate([d, short])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(d[order].astype(np.uint16), kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=len(texts)))]).astype(np.int64)


def sketch(h: np.ndarray, ptr: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` coordinates for each set; rows of empty sets are all ones."""
    n = np.diff(ptr)
    out = np.full((len(n), t), _NONE)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(n)), n)
    open_ = n > 0
    for i in range(2 * t):
        if not open_.any():
            break
        if i and not open_[doc].all():
            live = open_[doc]
            h, doc = h[live], doc[live]
        v = mix(h ^ mix(np.full(1, i + 1, np.uint64)))
        b = ((v >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, doc * t + b, (np.uint64(i) << np.uint64(48)) | (mix(v) >> np.uint64(16)))
        open_ &= (out == _NONE).any(axis=1)
    return out


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sk.reshape(len(sk), bands, rows)
    key = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(sk), axis=0)
    for j in range(rows):
        key = mix(key + s[:, :, j])
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    worker_state("fast_sketch")
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        for s in steps(texts):
            h, ptr = shingle_sets(texts[s], k, seed)
            n = np.diff(ptr)
            sk = sketch(h, ptr, bands * rows)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(7)), dtype=np.uint64)])
            keys = band_keys(sk, bands, rows)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[s.start:s.stop], batch.column("th")[s.start:s.stop], pa.array(n),
                 pa.array((total[ptr[1:]] - total[ptr[:-1]]).view(np.int64)),
                 pa.array((other[ptr[1:]] - other[ptr[:-1]]).view(np.int64)), keys,
                 pa.array([r.tobytes() for r in mix(sk).astype(np.uint8)], pa.binary())],
                names=["id", "th", "n", "h", "h2", "bands", "sig"])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    worker_state("fast_sketch")
    for batch in batches:
        ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
        texts = list({id(t): t for t in [*ta, *tb]}.values())
        number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        texts = list(number)
        sets: list[np.ndarray] = []
        for s in steps(texts):
            h, ptr = shingle_sets(texts[s], k)
            sets += [h[x:y] for x, y in zip(ptr[:-1], ptr[1:], strict=True)]
        keep = np.zeros(len(ta), bool)
        for i, (a, b) in enumerate(zip(ta, tb, strict=True)):
            x, y = sets[number[a]], sets[number[b]]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _agree(x: np.ndarray, y: np.ndarray, percent: int) -> int:
    """0 if sets of 32-bit hashes allow no link, 2 if they prove one, 1 if full sets must
    tell; up to two hashes of a set may coincide."""
    both = len(np.intersect1d(x, y))
    return sum(100 * b >= percent * (len(x) + len(y) - b) for b in (both + 2, both - 2))


def _top(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def _short_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    worker_state("fast_sketch")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for s in steps(texts):
            h, ptr = shingle_sets(texts[s], k)
            short = (h >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h")[s.start:s.stop],
                 pa.array([short[x:y].tobytes() for x, y in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())],
                names=["h", "set"])


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int, t: int, rows: int, best: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one block, or between two, of different components whose sketches allow a
    link, each in the first band that it shares: of each member the ``best`` likeliest, or
    (0) those whose sets agree, without pairs that links of the block join already."""
    worker_state("fast_sketch")
    least = t * (percent / 100) - 5 * (t * percent / 100 * (1 - percent / 100)) ** 0.5
    for table, cuts in runs(batches, ["band", "i", "j"], 4096):
        c = {n: table.column(n).to_numpy() for n in ("h", "root", "n", "side", "i", "j", "at")}
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, t)
        sets = [] if best else [np.frombuffer(x, np.uint32) for x in table.column("set").to_pylist()]
        keys = np.zeros((0, 0)) if best else table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sig), -1)
        found: list[np.ndarray] = []
        for s, e in zip(cuts, [*cuts[1:], table.num_rows], strict=True):
            members, parent = np.arange(s, e), {}
            one_block = c["i"][s] == c["j"][s]
            for x in members:
                other = c["root"][s:e] != c["root"][x]
                if best:
                    other &= True if one_block else c["side"][s:e] != c["side"][x]
                else:
                    other &= members > x if one_block else c["side"][s:e] > c["side"][x]
                y = members[other]
                y = y[100 * np.minimum(c["n"][y], c["n"][x]) >= percent * np.maximum(c["n"][y], c["n"][x])]
                same = sig[y] == sig[x]
                likely = same.sum(axis=1)
                y, same, likely = y[likely >= least], same[likely >= least], likely[likely >= least]
                if len(y) and (before := int(c["at"][x])):
                    # whole bands by the signature's bytes in the rounds that may miss a pair, by the keys in the last
                    earlier = same[:, :before * rows].reshape(len(y), before, rows).all(axis=2) if best else keys[y][:, :before] == keys[x, :before]
                    first = ~earlier.any(axis=1)
                    y, likely = y[first], likely[first]
                if best and len(y) > best:
                    y = y[np.argpartition(-likely, best - 1)[:best]]
                elif not best:
                    kept = []
                    for k in y:
                        a, b = _top(parent, int(c["root"][x])), _top(parent, int(c["root"][k]))
                        if a != b and (told := _agree(sets[x], sets[k], percent)):
                            kept.append(k)
                            if told == 2:
                                parent[max(a, b)] = min(a, b)
                    y = np.array(kept, np.int64)
                if len(y):
                    found.append(np.stack([np.minimum(c["h"][y], c["h"][x]), np.maximum(c["h"][y], c["h"][x])]))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after some more links, which can only join whole components."""
    a, b = (root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    ends = (links.join(a, "a", "left").join(b, "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    ends = stored(ends, "ends")
    upper = components(ends).select(F.col("node").alias("root"), F.col("root").alias("upper"))
    own = ends.select(F.explode(F.array("a", "b")).alias("node"))
    nodes = root.union(own.select("node", F.col("node").alias("root"))).distinct()
    return stored(nodes.join(upper, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "roots")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """id, th (hash of the text), n_shingles, component_id, kept for every row of ``docs``."""
    d = doc_columns(docs).withColumn("th", text_hash(F.col("text")))
    raw = d.select("id", "th", F.col("text").cast("binary").alias("text"))
    seed = 0
    while True:
        sk = stored(raw.mapInArrow(functools.partial(_sketches, k=shingle, bands=bands, rows=rows, seed=seed),
                                   "id long, th long, n long, h long, h2 long, bands array<long>, sig binary"), "sketch")
        classes = sk.where("n > 0").groupBy("h").agg(
            F.min("id").alias("cid"), F.min("h2").alias("x"), F.max("h2").alias("y"), F.max("n").alias("n"),
            F.min(F.struct("id", "th")).alias("rep"))
        classes = stored(classes, "classes")
        if not classes.where("x <> y").take(1):  # two sets of one 64-bit hash: take other hashes
            break
        seed += 1

    member = sk.where("n > 0").select(F.posexplode("bands").alias("at", "band"), "h")
    buckets = member.groupBy("band").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi")
    member = stored(member.join(buckets, "band").distinct(), "buckets")
    stars = (member.select(F.col("h").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).where("x <> y")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    involved = member.select("h").distinct().join(classes, "h").select(
        "h", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"))
    text = stored(raw.join(involved, raw["id"].eqNullSafe(F.col("rid")) & (raw["th"] == F.col("rth")))
                  .select("h", "text"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(text.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a")
                .join(text.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b"))
        return both.mapInArrow(functools.partial(_confirm, k=shingle, percent=percent), "a long, b long")

    stars = stored(stars, "stars")
    links = stored(confirmed(stars), "links")
    root = components(links)

    sig = sk.where("n > 0").join(involved.select("h"), "h", "left_semi").groupBy("h").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    sets = text.mapInArrow(functools.partial(_short_sets, k=shingle), "h long, set binary").groupBy("h").agg(
        F.first("set").alias("set"))
    sig = stored(sig.join(sets, "h", "left"), "signatures")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tried = stars
    for best in (*LIKELIEST, 0):
        rest = (member.select("band", "at", "h").join(root.select(F.col("node").alias("h"), "root"), "h", "left")
                .withColumn("root", F.coalesce("root", "h")))
        open_ = (rest.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"))
                 .where("lo < hi").select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
        rest = (rest.join(open_, "band").join(sig.drop("set", "bands") if best else sig, "h")
                .withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                        (F.col("block") > F.col("other")).cast("int").alias("side"), "at", "h", "root", "n", "sig", *([] if best else ["set", "bands"])))
        more = (rest.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
                .mapInArrow(functools.partial(_block_pairs, percent=percent, t=bands * rows, rows=rows, best=best), "a long, b long")
                .distinct().join(tried, ["a", "b"], "left_anti"))
        more = stored(more, "pairs")
        tried = tried.union(more)
        root = _joined(root, stored(confirmed(more), "late"))

    top = classes.join(root.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    low = top.groupBy("root").agg(F.min("cid").alias("component_id"))
    top = top.join(low, "root").select("h", "component_id", F.col("root").alias("component"))
    return (sk.select("id", "th", F.col("n").alias("n_shingles"), "h").join(top, "h", "left")
            .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).drop("h"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest id, then text hash."""
    found = near_duplicates(docs, shingle, percent)
    alone = found.where("component is null").select("id", "th")
    first = found.where("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("r")).select("r.id", "r.th")
    keep = alone.distinct().union(first).select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    d = docs.withColumns({"__i": F.col("doc_id").cast("long"), "__h": text_hash(F.col("text").cast("string"))})
    same = d.join(keep, d["__i"].eqNullSafe(keep["__id"]) & (d["__h"] == keep["__th"]))
    with_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = same.where(with_words).dropDuplicates(["__i", "__h"])
    return once.unionByName(same.where(~with_words)).drop("__i", "__h", "__id", "__th")


def op3_fast_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS g
      FROM d WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b
         WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN comp USING (rid) LEFT JOIN n USING (rid)
"""
