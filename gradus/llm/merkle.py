"""Merkle manifest of a dataset: digests, membership proofs and their verification.

Every row is a leaf.  Leaves of a group stand in ``order``; every run of ``arity``
consecutive nodes (the last may be shorter) becomes one node, until one is left, the
group's subroot; subroots, ordered by group, are the leaves of one more such tree.
A digest is the hex SHA-256 of the concatenated hex digests below it.

Each level is one self-join: a node meets its siblings by their computed indices
(``index XOR 1`` for binary trees, else its own slot shifted by 1 .. arity - 1 within
the run), and the nodes of slot zero, which now hold their whole run, emit the parents.
Every level is a table in the shared folder.  Proofs go the other way: a node's proof is
its siblings followed by its parent's proof, joined on the parent's index.  All keys are
(group, index), so a group that holds most rows is spread like any other.  Only the
number of leaves of the largest group and the root digest reach the driver.

Defined cases: a null field reads ``-``, an empty one ``0:``; nulls in ``order`` come
first, ties are put in the order of their digests, and repeated rows are leaves of their
own; a null group comes before the empty one; very long texts are hashed where they are
read and never moved; columns outside ``fields`` are not looked at, whatever their names;
an empty table has no root and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read, stored

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: levels whose proofs are joined before a table is written
JOINED = 4


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def group_key(group: Column) -> Column:
    """Sorts null before the empty string, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``left`` and ``right``: digests of the siblings before and after a node, concatenated."""
    slot, none = F.col("pos") % arity, F.lit("").cast("binary")
    out = nodes
    for shift in range(1, arity):
        other = F.col("pos").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("pos") - slot + (slot - shift + arity) % arity
        out = out.join(nodes.select("g", other.alias("pos"), F.col("d").alias(f"s{shift}")), ["g", "pos"], "left")
    # the sibling joined at ``shift`` has slot (slot + shift) mod arity
    seen = [(slot + s < arity, F.coalesce(f"s{s}", none)) for s in range(1, arity)]
    return out.withColumns({"left": F.concat(*[F.when(~after, d).otherwise(none) for after, d in seen]),
                            "right": F.concat(*[F.when(after, d).otherwise(none) for after, d in seen])}
                           ).drop(*[f"s{s}" for s in range(1, arity)])


def grow(leaves: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """Levels below the roots, with siblings, and the roots (g, level, d).

    ``leaves`` has g, pos, n (leaves of the group), d; further columns stay with level 0.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    roots = leaves.where("n = 1").select("g", F.lit(0).alias("level"), "d")
    while most > 1:
        levels.append(stored(siblings(nodes.where("n > 1"), arity), "merkle-level"))
        most = -(-most // arity)
        nodes = (levels[-1].where(F.col("pos") % arity == 0)
                 .select("g", F.floor(F.col("pos") / arity).alias("pos"), F.ceil(F.col("n") / arity).alias("n"),
                         digest(as_hex(F.col("d")), as_hex(F.col("right"))).alias("d")))
        roots = roots.union(nodes.where("n = 1").select("g", F.lit(len(levels)), "d"))
    return levels, stored(roots, "merkle-roots")


def proofs(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, arity: int = 2) -> DataFrame:
    """``leaves`` with ``path``: its siblings (left, right) of every level, then its root's ``path``."""
    roots = roots.select("g", F.col("level").alias("at"), "path")
    found = None
    for level in reversed(range(len(levels) + 1)):
        own = [c for c in leaves.columns if c not in ("n", "d")] if level == 0 else ["g", "pos"]
        top = roots.where(F.col("at") == level).select("g", F.lit(0).cast("long").alias("pos"), "path")
        if level == 0:
            top = leaves.where("n = 1").join(top.drop("pos"), "g")
        top = top.select(*own, "path")
        if level < len(levels):
            below = levels[level].withColumn("up", F.floor(F.col("pos") / arity))
            path = F.concat(F.array(F.struct("left", "right")), "path")
            found = below.join(found.select("g", F.col("pos").alias("up"), "path"), ["g", "up"]).withColumn("path", path)
            found = found.select(*own, "path").union(top)
        else:
            found = top
        if level and level % JOINED == 0:
            found = stored(found, "merkle-proofs")
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, run: F.sha2(F.concat(as_hex(run["left"]), acc, as_hex(run["right"])), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda run: as_hex(F.concat(run["left"], run["right"]))), ""), 256)


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], keep: dict[str, Column] | None = None,
             arity: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``keep``'s columns, leaf, path, subroot and root (hex)."""
    keep = {name: value.alias(f"k{i}") for i, (name, value) in enumerate((keep or {}).items())}
    rows = stored(docs.select(group_key(F.col(group)).alias("g"), F.col(order).alias("o"),
                              digest(*[field(F.col(f)) for f in fields]).alias("d"), *keep.values()), "merkle-leaves")
    leaves = stored(ranked(rows, "g", ["o", "d"]).withColumn("leaf", F.col("d")).drop("part", "o"), "merkle-leaves")
    levels, roots = grow(leaves, arity)

    tops = stored(ranked(roots.select(F.lit("").alias("g"), F.col("g").alias("key"), "level", "d"), "g", ["key"])
                  .drop("part"), "merkle-tops")
    top_levels, top_root = grow(tops, arity)
    root = top_root.first()
    whole = proofs(tops.withColumn("subroot", F.col("d")), [t.withColumn("subroot", F.col("d")) if not i else t for i, t in enumerate(top_levels)],
                   top_root.withColumn("path", F.array().cast("array<struct<left:binary,right:binary>>")), arity)
    whole = stored(whole.select(F.col("key").alias("g"), "level", "subroot", "path"), "merkle-tops")

    out = proofs(leaves, levels, whole, arity).join(whole.select("g", "subroot"), "g")
    return out.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(keep)], as_hex(F.col("leaf")).alias("leaf"), "path",
                      as_hex(F.col("subroot")).alias("subroot"), F.lit(root["d"].hex() if root else None).cast("string").alias("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = [field(F.col(f) + 1 if f == "n_chars" else F.col(f)) for f in FIELDS]
    held = manifest(docs, "lang", "doc_id", FIELDS,
                    {"doc_id": F.col("doc_id"), "changed": F.when(tampered, F.sha2(F.concat(*changed), 256))})
    held = held.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return held.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text: the bitwise definition."""
    return f"""xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
        flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ascii(c)::UBIGINT],
            list_transform(range(8), lambda k: 256::UBIGINT))))),
        lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))"""


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
                                   for c in ["doc_id", "source", "lang", n_chars, "text"]) + ")"


OP11_SQL = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf,
           CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS changed FROM documents),
leaves AS (SELECT d.*, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  count(*) OVER (PARTITION BY g) AS n FROM d),
tree AS (SELECT g, 0 AS l, i, n, leaf AS h FROM leaves
    UNION ALL SELECT g, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1
              GROUP BY g, l + 1, i // 2, (n + 1) // 2),
tops AS (SELECT g, h, l AS height, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS l, i, n, h FROM tops
    UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1
              GROUP BY l + 1, i // 2, (n + 1) // 2),
steps AS (
    SELECT rid, t.l, leaves.i >> t.l AS slot, s.h AS sib FROM leaves
    JOIN (SELECT DISTINCT g, l FROM tree WHERE n > 1) t USING (g)
    LEFT JOIN tree s ON s.g = leaves.g AND s.l = t.l AND s.i = xor(leaves.i >> t.l, 1)
    UNION ALL
    SELECT rid, height + t.l, tops.i >> t.l, s.h FROM leaves JOIN tops USING (g)
    CROSS JOIN (SELECT DISTINCT l FROM crown WHERE n > 1) t
    LEFT JOIN crown s ON s.l = t.l AND s.i = xor(tops.i >> t.l, 1)),
fold AS (SELECT rid, 0 AS l, coalesce(changed, leaf) AS h FROM leaves
    UNION ALL SELECT rid, fold.l + 1, sha256(CASE WHEN slot % 2 = 1 THEN coalesce(sib, '') || h ELSE h || coalesce(sib, '') END)
              FROM fold JOIN steps USING (rid, l)),
proof AS (SELECT rid, sha256(coalesce(string_agg(sib, '' ORDER BY l), '')) AS p FROM steps GROUP BY rid)
SELECT doc_id, leaf, tops.h AS subroot, r.h AS root, coalesce(p, sha256('')) AS proof_sha256, f.h AS folded_root,
       f.h = r.h AS verified
FROM leaves JOIN tops USING (g) JOIN (SELECT rid, max_by(h, l) AS h FROM fold GROUP BY rid) f USING (rid)
CROSS JOIN (SELECT h FROM crown WHERE n = 1) r LEFT JOIN proof USING (rid)
"""
