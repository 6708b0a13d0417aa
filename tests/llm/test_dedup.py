"""Near-duplicates and repeated passages against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from gradus.llm import fast_sketch, flat_graph, suffix_dedup
from gradus.llm.common import components


def groups(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1, 9), (9, 4), (5, 5), (7, 6), (6, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 9: 1, 4: 1, 6: 6, 7: 6}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_coordinate_fills_and_agrees_with_jaccard():
    for n in (1, 2, 50, 5000):
        both = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = np.unique(both[: max(1, n * 9 // 10)]), np.unique(both[n // 10:])
        sk = fast_sketch.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 180)
        assert (sk != fast_sketch._NONE).all()
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sk[0] == sk[1]).mean() - jaccard) < 0.2
    assert (fast_sketch.sketch(np.zeros(0, np.uint64), np.array([0, 0]), 9) == fast_sketch._NONE).all()


def test_near_duplicates(spark, edge_docs, no_docs, edge_rows, prose):
    base = prose(50, 200).split()
    near = []
    for i in range(12):  # a chain: each copy differs a little from the one before
        base = base.copy()
        base[(i * 17) % 200] = f"new{i}"
        near.append((500 + i, " ".join(base)))
    rows = edge_rows + near
    docs = edge_docs.select("doc_id", "text", "id", "th").union(
        spark.createDataFrame([(i, t, None, None) for i, t in near], "doc_id long, text string, id long, th long"))
    sets = [shingles(t, 3) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = groups(len(rows), links)
    low = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(((i, len(s), low.get(r), i == low.get(r)) for (i, _), s, r in zip(rows, sets, root, strict=True)), key=str)
    found = fast_sketch.near_duplicates(docs, 3, 85)
    assert sorted(map(tuple, found.select("id", "n_shingles", "component_id", "kept").collect()), key=str) == want
    assert fast_sketch.near_duplicates(no_docs, 3, 85).count() == 0
    kept = fast_sketch.one_of_each(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted(
        {r: i for (i, _), r in reversed(list(zip(rows, root, strict=True)))}.values(), key=str)


def removed(rows, keep, length):
    """Brute force: bytes covered by a string that starts elsewhere (earlier) as well."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count, first = Counter(), {}
    for k, (_, b) in enumerate(texts):
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            count[s] += 1
            first.setdefault(s, (k, p))
    out = []
    for k, (_, b) in enumerate(texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if count[s] > 1 if keep == "none" else first[s] != (k, p):
                gone[p:p + length] = b"\1" * length
        out.append(bytes(gone))
    return texts, out


@pytest.mark.parametrize("most", [2_000, 1])
def test_repeated_passages(spark, edge_docs, no_docs, edge_rows, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_CLASSES", most)
    want = []
    for (i, b), gone in zip(*removed(edge_rows, "none", 200), strict=True):
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), sum(1 for x in gone.split(b"\0") if x), hashlib.sha256(rest).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.digests(edge_docs).collect()), key=str) == sorted(want, key=str)
    assert suffix_dedup.digests(no_docs).count() == 0


@pytest.mark.parametrize("most", [2_000, 1])
def test_first_copy_stays(spark, edge_docs, edge_rows, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_CLASSES", most)
    rows = [(i, t) for i, t in edge_rows if i is not None]
    rows = list(dict.fromkeys(rows))
    docs = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut(docs).collect()}
    for (i, b), gone in zip(*removed(rows, "first", 200), strict=True):
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[i] or "").encode() == rest, i
    assert suffix_dedup.cut(docs).columns == docs.columns


def test_longest_previous_factors_by_hand():
    r = np.random.default_rng(4)
    for n, length, letters in ((1, 3, 2), (60, 5, 2), (400, 20, 2), (300, 9, 1), (500, 33, 3)):
        buf = r.integers(97, 97 + letters, n + length).astype(np.uint8)
        buf[n // 2:n // 2 + n // 4] = buf[:n // 4]
        at = r.permutation(n)  # passages in any order, by places of their own, in two groups
        place, group = r.permutation(n), (at % 2 if n > 60 else at * 0)
        factor, source = suffix_dedup.previous_factors(buf, at, suffix_dedup.passage_ranks(buf, length)[at], place, group, length)
        raw = buf.tobytes()

        def common(i, j):
            a, b = raw[at[i]:at[i] + length], raw[at[j]:at[j] + length]
            return next((k for k in range(length) if a[k] != b[k]), length)

        for i in range(n):
            want = max((common(i, j) for j in range(n) if place[j] < place[i] and group[j] == group[i]), default=0)
            assert factor[i] == want
            assert want == 0 or common(i, source[i]) == want and place[source[i]] < place[i]
        before = suffix_dedup.smaller_before(place)
        assert before.tolist() == [max((j for j in range(i) if place[j] < place[i]), default=-1) for i in range(n)]


def test_common_grams_are_split(spark):
    rows = spark.createDataFrame([(g, i, i, 0, 0) for i in range(400) for g in {7, i // 2 if i % 3 else -i}], suffix_dedup.ROW)
    got = sorted(map(tuple, suffix_dedup._repeated_grams(rows, 8).select("gram", "context").collect()))
    n = {}
    for g, *_ in (all_rows := rows.collect()):
        n[g] = n.get(g, 0) + 1
    assert got == sorted((x["gram"], x["context"]) for x in all_rows if n[x["gram"]] > 1)
    assert suffix_dedup._repeated_grams(rows.limit(0), 8).count() == 0


def test_pieces_of_a_long_text(monkeypatch, prose):
    text = (prose(9, 900) + prose(8, 300) + prose(9, 900)).encode()
    whole = [x for p in suffix_dedup._pieces([text], 200) for x in p]
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 700)
    parts = [x for p in suffix_dedup._pieces([text], 200) for x in p]
    assert len(whole) == 1 and len(parts) > 5
    starts = sorted(at + k for _, at, b in parts for k in range(len(b) - 199))
    assert starts == list(range(len(text) - 199))


def vectors(n=400, dim=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[50:120] = x[50] + 0.15 * rng.normal(size=(70, dim))
    x[200:203] = x[200]
    x[210] = 3 * x[211]
    return x


def test_links_are_brute_force_links(spark):
    x = vectors()
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [1.0] * 15, [1.0, 2.0], []]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900 + i, v, 0) for i, v in enumerate(odd)] + [(None, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    got = {r["vec_id"]: tuple(r)[1:] for r in flat_graph.near_duplicates(df, 0.9).collect()}
    u = np.concatenate([x, x[5:6]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    root = groups(len(u), list(zip(*np.nonzero(hit), strict=True)))
    found = sum(got[i][0] for i in range(len(x)))
    assert found >= 0.9 * hit[:len(x)].sum()
    for i in range(len(x)):
        assert got[i] == (hit[i].sum(), root[i], root[i] == i)
    assert got[None][:2] == (1, 5)
    assert all(got[900 + i] == (0, 900 + i, True) for i in range(len(odd)))
    assert flat_graph.near_duplicates(df.limit(0), 0.9).count() == 0


def test_parts_of_a_large_shard(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD_MAX", 60)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum() - len(u)
    got = flat_graph.near_duplicates(df, 0.9).agg({"n_links": "sum"}).first()[0]
    assert 0.95 * want <= got <= want


def linked(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    return hit.sum(axis=1)


@pytest.mark.parametrize("most", [3_000, 60])
def test_links_found_by_one_side_count_for_both(spark, most, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD_MAX", most)
    monkeypatch.setattr(flat_graph, "SHARD_TARGET", 100)
    whole = flat_graph._search

    def half(pdf, **how):  # odd nodes never search
        return whole(pdf[pdf["base"] | (pdf["node"] % 2 == 0)], **how)

    monkeypatch.setattr(flat_graph, "_search", lambda pdf, **how: half(pdf, **how))
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in flat_graph.near_duplicates(df, 0.9).collect()}
    assert [got[i] for i in range(len(x))] == linked(x).tolist()


def test_audit_sees_lost_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[:100] = x[0] + 0.1 * rng.normal(size=(100, 16))
    x[100:120:2] = x[101:121:2] + 0.05 * rng.normal(size=(10, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = flat_graph._search

    def groups_only(pdf, **how):  # loses all groups of less than 5
        out = whole(pdf, **how)
        return out[out.groupby("root")["node"].transform("size") >= 5]

    want = linked(x)
    assert (want[100:120] >= 1).all() and want[100:].sum() < 0.05 * want.sum()
    monkeypatch.setattr(flat_graph, "_search", lambda pdf, **how: groups_only(pdf, **how))
    with pytest.raises(RuntimeError, match="recall"):
        flat_graph.near_duplicates(df, 0.9).count()
