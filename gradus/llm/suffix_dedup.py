"""Repeated passages by suffix order and longest previous factors.

A passage is a string of ``length`` bytes.  Its anchor is the ``gram``-byte substring
of smallest hash (leftmost of equals), so equal passages have equal anchors at equal
offsets.  Each anchor occurrence stands for the run of passages that choose it, one
row instead of one for each byte.

1. Anchors whose gram occurs once are dropped; they hold no repeated passage.
2. Rows of one anchor and equal context (all bytes of the run's passages) are a
   class; a class that is alone at its anchor is repeated as a whole.
3. Where classes differ, one context of each is sorted: the suffix order of all its
   passages by prefix doubling.  The nearest smaller positions before and after a
   passage in that order give its longest previous factor, up to ``length`` bytes; it
   has an earlier copy if that is ``length``, and the place it was found at has a later.
   Anchors with more than ``MAX_CLASSES`` classes are dealt out by the hash of each
   single passage instead, so that no common line's surroundings meet in one task.

``keep="first"`` removes what occurs earlier (by id, then text hash, then place),
``keep="none"`` every occurrence.  Bytes covered by a removed passage go.

Defined cases: null text is empty; texts shorter than ``length`` keep all; nulls in
the id come first; rows equal in id and text are judged alike: repeats of each other
for ``none``, one document for ``first``; empty tables give empty results.  Very
long texts are worked on in pieces that overlap by a passage.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, read, stored, text_hash, worker_state
from .rolling import Spans, mix, runs

LENGTH, GRAM = 200, 50
STEP_BYTES = 400_000
MAX_CLASSES = 20_000  # contexts of one anchor that one task sorts, about 5 MB
GROUP_ROWS = 4_000
NO_ID = -(1 << 63)
ROW = "gram long, context long, key long, th long, pos long"


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) of bounded size."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length) + 1, STEP_BYTES):
            if len(t) >= length:
                held.append((i, at, t[at:at + STEP_BYTES + length - 1]))
                size += len(held[-1][2])
                if size > STEP_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def anchors(buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int):
    """Of the pieces [start, end) of a buffer: each run of passage starts [lo, hi] with
    one anchor, and the anchor's place."""
    w = length - gram + 1
    spans = Spans(buf)
    at = np.arange(len(buf) - gram + 1)
    low = np.uint64((1 << 24) - 1)
    key = (spans(at, at + gram) & ~low) | at.astype(np.uint64)
    block = np.concatenate([key, np.full(-len(key) % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - w + 1
    anchor = (np.minimum(back[:n], ahead[w - 1:w - 1 + n]) & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end - length + 1, -1)
    place = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    chosen = anchor[place]
    cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(place) != 1) | np.isin(place[1:], start)) + 1
    first = np.concatenate([[0], cut]).astype(np.int64)
    last = np.concatenate([cut, [len(place)]]) - 1
    return spans, chosen[first], place[first], place[last]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    worker_state("suffix_dedup")
    for batch in batches:
        key, th = batch.column("key").to_numpy(), batch.column("th").to_numpy()
        for piece in _pieces([t or b"" for t in batch.column("text").to_pylist()], length):
            sizes = np.array([len(p[2]) for p in piece])
            end = np.cumsum(sizes)
            start = end - sizes
            spans, a, lo, hi = anchors(np.frombuffer(b"".join(p[2] for p in piece), np.uint8), start, end, length, gram)
            own = np.searchsorted(start, lo, "right") - 1
            doc = np.array([p[0] for p in piece])[own]
            shape = ((a - lo) << 8 | (hi - lo)).astype(np.uint64)
            context = mix(spans(lo, hi + length) ^ mix(shape + np.uint64(1)))
            pos = (lo - start[own] + np.array([p[1] for p in piece])[own]) << 16 | shape.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spans(a, a + gram).view(np.int64)), pa.array(context.view(np.int64)), pa.array(key[doc]),
                 pa.array(th[doc]), pa.array(pos)], names=["gram", "context", "key", "th", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each class's first context, out of its document."""
    worker_state("suffix_dedup")
    names = ["gram", "context", "pos"]
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py() or b""
            parts = batch.column("parts")[i].values
            cols = [parts.field(n).to_numpy() for n in names]
            lo, size = cols[2] >> 16, cols[2] & 0xFF
            n = len(lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1]), pa.array(np.full(n, batch.column("key")[i].as_py())),
                 pa.array(np.full(n, batch.column("th")[i].as_py())), pa.array(cols[2]), parts.field("m"),
                 pa.array([text[x:x + s + length] for x, s in zip(lo.tolist(), size.tolist(), strict=True)], pa.binary())],
                names=["gram", "context", "key", "th", "pos", "m", "bytes"])


def passage_ranks(buf: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place in suffix order, by prefix doubling;
    equal strings have equal ranks.  Places less than ``length`` from the end get any."""
    def dense(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1].astype(np.uint64)

    h = 1
    padded = np.concatenate([buf, np.zeros(2 * length, np.uint8)]).astype(np.uint64)
    value = padded[:len(buf) + length]
    while h < 8 and 2 * h <= length:
        value = value << np.uint64(8 * h) | np.concatenate([value[h:], np.zeros(h, np.uint64)])
        h *= 2
    rank = dense(value)
    while h < length:
        step = min(h, length - h)  # the last two halves may overlap
        rank = dense(rank << np.uint64(32) | np.concatenate([rank[step:], np.zeros(step, np.uint64)]))
        h += step
    return rank[:len(buf)]


def smaller_before(value: np.ndarray) -> np.ndarray:
    """For each element the last place before it of a smaller value, or -1: up a tree of
    minima to the first left sibling that holds one, then down to its last."""
    levels = [value]
    while len(levels[-1]) > 1:
        v = levels[-1]
        v = np.append(v, v[-1:]) if len(v) % 2 else v
        levels.append(np.minimum(v[::2], v[1::2]))
    out = np.full(len(value), -1)
    todo, found = np.arange(len(value)), []
    for h, low in enumerate(levels):
        at = todo >> h
        hit = (at & 1 == 1) & (low[at - 1] < value[todo])
        found.append((todo[hit], at[hit] - 1))
        todo = todo[~hit]
    who, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for h in range(len(levels) - 1, -1, -1):
        if len(who):
            at = 2 * at + 1  # the right child, if it is there and holds a smaller value
            last = len(levels[h]) - 1
            at -= (at > last) | (levels[h][np.minimum(at, last)] >= value[who])
        who, at = np.concatenate([who, found[h][0]]), np.concatenate([at, found[h][1]])
    out[who] = at
    return out


def common_prefix(buf: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the bytes from ``a`` and from ``b``, up to ``most``,
    in steps of eight bytes."""
    padded = np.concatenate([buf, np.zeros(most + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.full(len(a), most)
    todo = np.arange(len(a))
    for at in range(0, most, 8):
        differ = words[a[todo] + at] != words[b[todo] + at]
        ends = differ.any(axis=1)
        out[todo[ends]] = np.minimum(at + differ[ends].argmax(axis=1), most)
        todo = todo[~ends]
        if not len(todo):
            break
    return out


def previous_factors(buf: np.ndarray, at: np.ndarray, rank: np.ndarray, place: np.ndarray, group: np.ndarray,
                     length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each passage, up to ``length``, and the passage it was
    found at (-1: none).

    ``at`` is a passage's start in ``buf``, ``rank`` its rank in suffix order, ``place`` its
    position in the corpus; factors are looked for among the passages of its ``group``.
    """
    sa = np.lexsort((place, rank, group))
    line = place[sa]
    factor, source = np.zeros(len(sa), np.int64), np.full(len(sa), -1)
    before = smaller_before(line)
    after = len(sa) - 1 - smaller_before(line[::-1])[::-1]
    for near in (before, after):
        own = np.flatnonzero((near >= 0) & (near < len(sa)))
        i, j = sa[own], sa[near[own]]
        keep = group[i] == group[j]
        i, j = i[keep], j[keep]
        size = np.full(len(i), length)
        differ = rank[i] != rank[j]
        size[differ] = common_prefix(buf, at[i[differ]], at[j[differ]], length)
        more = size > factor[i]
        factor[i[more]], source[i[more]] = size[more], j[more]
    return factor, source


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def _previous_factors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each class: offsets of passages that occur elsewhere, and of those with an
    earlier occurrence."""
    worker_state("suffix_dedup")
    for table, at in runs(batches, ["gram"], GROUP_ROWS):
        c = {n: table.column(n).to_numpy() for n in ("gram", "context", "key", "th", "pos")}
        new = np.ones(table.num_rows, bool)  # a document that stands twice gave its contexts twice
        new[1:] = (c["gram"][1:] != c["gram"][:-1]) | (c["context"][1:] != c["context"][:-1])
        pick = np.flatnonzero(new)
        group = np.searchsorted(at, pick, "right")
        c = {n: v[pick] for n, v in c.items()}
        data = table.column("bytes").take(pa.array(pick)).to_pylist()
        first = np.cumsum([0, *(len(x) for x in data)])[:-1]
        buf = np.frombuffer(b"".join(data), np.uint8)
        rank = passage_ranks(buf, length)
        order = np.empty(len(pick), np.int64)
        order[np.lexsort((c["pos"], c["th"], c["key"]))] = np.arange(len(pick))
        n = (c["pos"] & 0xFF) + 1
        row = np.repeat(np.arange(len(pick)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = first[row] + off
        factor, source = previous_factors(buf, at, rank[at], order[row] * 256 + off, group[row], length)
        earlier = factor >= length
        again = earlier.copy()
        again[source[earlier]] = True
        out = []
        for flag in (again, earlier):
            hit = np.flatnonzero(flag)
            out.append(_lists(row[hit], off[hit], len(pick)))
        yield pa.RecordBatch.from_arrays([pa.array(c["gram"]), pa.array(c["context"]), *out],
                                         names=["gram", "context", "again", "earlier"])


def _passages(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each single passage of a class, under two hashes of its bytes."""
    worker_state("suffix_dedup")
    for batch in batches:
        data = batch.column("bytes").to_pylist()
        for s in range(0, batch.num_rows, 2_000):
            part = data[s:s + 2_000]
            pos = batch.column("pos")[s:s + 2_000].to_numpy()
            buf = np.frombuffer(b"".join(part), np.uint8)
            n = (pos & 0xFF) + 1
            row = np.repeat(np.arange(len(part)), n)
            off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = np.cumsum([0, *(len(x) for x in part)])[:-1][row] + off
            cols = {k: batch.column(k)[s:s + 2_000].to_numpy()[row] for k in ("gram", "context", "key", "th")}
            rel = (pos[row] >> 8 & 0xFF) - off
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v) for v in cols.values()), pa.array((pos[row] >> 16) + off), pa.array(off.astype(np.int32)),
                 pa.array((Spans(buf)(at, at + length) ^ mix(rel.astype(np.uint64))).view(np.int64)),
                 pa.array(Spans(buf[::-1])(len(buf) - at - length, len(buf) - at).view(np.int64))],
                names=["gram", "context", "key", "th", "place", "off", "h1", "h2"])


def _merge(ranges: list[dict], length: int) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _rest(text: bytes, cuts: list[list[int]]) -> bytes:
    at, kept = 0, []
    for a, b in cuts:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _digests(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    worker_state("suffix_dedup")
    for batch in batches:
        rows: list[tuple] = []
        for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
            text = text.as_py() or b""
            cuts = _merge(ranges.as_py() or [], length)
            rows.append((len(text), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(_rest(text, cuts)).hexdigest()))
        n, gone, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut_texts(batches: Iterator[pa.RecordBatch], length: int, text: str) -> Iterator[pa.RecordBatch]:
    worker_state("suffix_dedup")
    for batch in batches:
        column = batch.column(text).to_pylist()
        for i, ranges in enumerate(batch.column("__ranges").to_pylist()):
            if ranges:
                raw = column[i].encode()
                cuts = []
                for a, b in _merge(ranges, length):  # whole characters only
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    cuts.append([a, b])
                column[i] = _rest(raw, cuts).decode()
        names = [n for n in batch.schema.names if n != "__ranges"]
        schema = pa.schema([batch.schema.field(n) for n in names])
        yield pa.RecordBatch.from_arrays([pa.array(column, schema.field(n).type) if n == text else batch.column(n)
                                          for n in names], schema=schema)


def _repeated_grams(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of grams that occur more than once; a gram of more than a quarter of a
    partition's share of rows is split over several.  There are at most 4 * ``parts`` such."""
    twice = stored(rows.groupBy("gram").count().where("count > 1"), "grams")
    share = (twice.agg(F.sum("count")).first()[0] or 0) // (4 * parts) + 1
    shares = F.floor(F.col("count") / share).cast("long")
    common = twice.where(F.col("count") > share).select("gram", (shares + 1).alias("shares"))
    salt = F.coalesce(F.pmod(F.xxhash64("key", "th", "pos"), F.col("shares")), F.lit(0).cast("long"))
    dealt = twice.select("gram", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("count") > share, shares)
                                                      .otherwise(0))).alias("salt"))
    return (rows.join(F.broadcast(common), "gram", "left").withColumn("salt", salt).drop("shares")
            .join(dealt, ["gram", "salt"]).drop("salt"))


def repeats(raw: DataFrame, keep: str = "none", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, th, ranges) of every document that loses something: ranges [a, b] of the
    starts of removed passages.  ``raw`` has key, th and the binary text."""
    if keep not in ("none", "first") or not 0 < length - gram < 256:
        raise ValueError("keep is 'none' or 'first'; a passage is at most 255 bytes longer than its gram")
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = raw.where(F.octet_length("text") >= length).mapInArrow(
        functools.partial(_anchor_rows, length=length, gram=gram), ROW)
    rows = stored(_repeated_grams(rows, parts), "anchors")
    classes = rows.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "pos")).alias("first"))
    classes = stored(classes, "contexts")
    mixed = classes.join(classes.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "gram")
    wanted = (mixed.select("first.key", "first.th", F.struct("gram", "context", "first.pos", "m").alias("part"))
              .groupBy("key", "th").agg(F.collect_list("part").alias("parts")))
    bodies = stored(raw.select("key", "th", "text").join(wanted, ["key", "th"]).mapInArrow(
        functools.partial(_contexts, length=length), ROW + ", m long, bytes binary"), "bodies")
    few = (bodies.where(F.col("m") <= MAX_CLASSES).drop("m").repartition(parts, "gram")
           .sortWithinPartitions("gram", "context").mapInArrow(
               functools.partial(_previous_factors, length=length),
               "gram long, context long, again array<int>, earlier array<int>"))
    # very common anchors: each passage by itself, counted before the shuffle
    single = bodies.where(F.col("m") > MAX_CLASSES).dropDuplicates(["gram", "context"]).mapInArrow(
        functools.partial(_passages, length=length),
        "gram long, context long, key long, th long, place long, off int, h1 long, h2 long")
    single = stored(single, "passages").withColumn("at", F.struct("key", "th", "place"))
    same = single.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("at").alias("lowest")).where("c > 1")
    many = (single.join(same, ["h1", "h2"]).groupBy("gram", "context")
            .agg(F.collect_list("off").alias("again"),
                 F.collect_list(F.when(F.col("at") > F.col("lowest"), F.col("off"))).alias("earlier")))
    flags = stored(few.unionByName(many), "factors")

    known = (classes.join(flags, ["gram", "context"], "left")
             .join(classes.groupBy("gram").agg(F.count("*").alias("m")), "gram"))
    lo, size = F.shiftright("pos", 16), F.col("pos").bitwiseAND(F.lit(0xFF))
    whole = F.array(F.struct(lo.alias("a"), (lo + size).alias("b")))
    some = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<int>")),
                                 lambda o: F.struct((lo + o).alias("a"), (lo + o).alias("b")))
    if keep == "none":
        ranges = F.when(F.col("n") > 1, whole).otherwise(some("again"))
    else:
        ranges = F.when(F.struct("key", "th", "pos") == F.col("first"), some("earlier")).otherwise(whole)
    return (rows.join(known.drop("m"), ["gram", "context"]).select("key", "th", F.explode(ranges).alias("r"))
            .groupBy("key", "th").agg(F.collect_set("r").alias("ranges")))


def _raw(docs: DataFrame) -> DataFrame:
    d = doc_columns(docs)
    return d.select("id", F.coalesce("id", F.lit(NO_ID)).alias("key"), text_hash(F.col("text")).alias("th"),
                    F.col("text").cast("binary").alias("text"))


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    raw = _raw(docs)
    return raw.join(repeats(raw, keep, length, gram), ["key", "th"], "left").mapInArrow(
        functools.partial(_digests, length=length),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "first") -> DataFrame:
    """``docs`` (doc_id, text and any columns) without the removed passages, in whole characters."""
    found = repeats(_raw(docs), keep, length, gram).withColumnsRenamed({"key": "__key", "th": "__th", "ranges": "__ranges"})
    own = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                            "__t": text_hash(F.col("text").cast("string"))})
    joined = own.join(found, (own["__k"] == found["__key"]) & (own["__t"] == found["__th"]), "left")
    return joined.drop("__k", "__t", "__key", "__th").mapInArrow(
        functools.partial(_cut_texts, length=length, text="text"), docs.schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
