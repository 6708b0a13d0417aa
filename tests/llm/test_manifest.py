"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gradus.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests, arity):
    """The root and, for each digest, its (left, right) siblings level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i:i + arity] for i in range(0, len(level), arity)]
        for i, p in enumerate(paths):
            run, slot = runs[at[i] // arity], at[i] % arity
            p.append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at[i] //= arity
        level = [sha(*r) for r in runs]
    return level[0], paths


def plain(rows, arity):
    """rows: (group, order, leaf); gives (leaf, subroot, root, path)."""
    groups = {}
    for g, o, d in rows:
        groups.setdefault(g, []).append((o is not None, o, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = [d for *_, d in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))]
        trees[g] = (own, *climb(own, arity))
    root, tops = climb([trees[g][1] for g in names], arity)
    return [(d, trees[g][1], root, p + top) for g, top in zip(names, tops) for d, p in zip(trees[g][0], trees[g][2])]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_is_the_plain_tree(spark, prose, arity):
    sizes = {None: 1, "": 2, "en": 29, "de": 9, "é": 4, "zz": 1}
    rows = [(None if i % 11 == 0 else i % 17, g, None if i % 5 == 0 else i, prose(i, i % 4)) for g, m in sizes.items() for i in range(m)]
    rows += [rows[5], rows[5], (7, "de", 1, "x" * 100_000), (8, "de", 1, None)]
    docs = spark.createDataFrame([(*r, 0, "q", b"") for r in rows],
                                 "doc_id long, lang string, n_chars long, text string, pos int, g string, d binary")
    got = merkle.manifest(docs, "lang", "doc_id", ["doc_id", "lang", "n_chars", "text"], {"id": F.col("doc_id")}, arity)
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    want = plain([(g, i, leaf((i, g, n, t))) for i, g, n, t in rows], arity)
    assert all(r["folded"] == r["root"] for r in got)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == sorted(
        (d, s, root, sha(*[a + b for a, b in p])) for d, s, root, p in want)
    assert sorted((r["leaf"], [(x["left"].hex(), x["right"].hex()) for x in r["path"]]) for r in got) == sorted((d, p) for d, _, _, p in want)


def test_query_tells_the_changed_rows(spark, tmp_path, edge_docs, edge_rows):
    docs = edge_docs.withColumn("source", F.lit(None).cast("string")).withColumn(
        "n_chars", F.when(F.col("doc_id") != 16, F.length("text").cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    assert len(got) == len(edge_rows)
    for r, text in ((r, t) for r in got for i, t in edge_rows if i == r["doc_id"] and i is not None):
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and text is not None and r["doc_id"] != 16
        assert r["verified"] is (not hit) and (r["folded_root"] == r["root"]) is r["verified"]
    assert any(not r["verified"] for r in got)


def test_empty_table_has_no_rows(spark, no_docs):
    assert merkle.manifest(no_docs, "lang", "doc_id", ["doc_id", "text"]).collect() == []
