"""Prefix trie of rebuilt conversations against plain prefixes."""

import hashlib
import random
import zlib

import pytest

from gradus.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f1 string, conv long, part int"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, r, x))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    saved, leaves, kids = {k: 0 for k in nodes}, {k: 0 for k in nodes}, {k: 0 for k in nodes}
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -99, len(m), kids[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest())
                  for k, m in nodes.items())


def found(df):
    return sorted((r["conv_id"], r["depth"], -99 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def made(seed=3):
    r = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 1003, 1004, 10**15 + 2]:
        if c not in (20, 35):
            for i in range(r.choice([0, 1, 2, 3, 5, 8, 9, 12])):
                rows.append((c, r.choice([i, i, i, None, 3]), r.choice(["user", "bot", "", None]), r.choice(["a", "é" * 3, "", None, "long " * 50])))
    rows += [(c, i, "user", f"t{i}") for c in range(100, 1300, 5) for i in range(3)]  # equal conversations
    rows += [(71, i, "user", f"t{i % 7}") for i in range(900)]  # one holds most of its kind
    rows += [(None, 0, "user", "x"), rows[3], rows[3], (72, 0, "user", "z" * 200_000)]
    return rows


def test_trie_is_the_plain_one(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 0, "x", 7, 1) for r in rows], SCHEMA).repartition(7)
    assert found(prefix_trie.trie(df)) == plain(rows)
    assert prefix_trie.trie(df.limit(0)).collect() == []


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 200, 5) if zlib.crc32(str(c).encode()) % 9]
    assert found(prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == plain(rows)


def test_equal_fingerprints_of_unequal_prefixes_are_seen(spark, monkeypatch):
    rows = [(5, 0, "u", "a"), (5, 1, "u", "b"), (10, 0, "u", "b"), (10, 1, "u", "a"), (15, 0, "u", "a"), (15, 1, "u", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefix_trie, "BASES", ((1, 1), *prefix_trie.BASES[:1]))  # powers of one: order is not seen
    assert found(prefix_trie.trie(df)) == plain(rows)
    monkeypatch.setattr(prefix_trie, "BASES", ((1, 1),))
    with pytest.raises(RuntimeError):
        prefix_trie.trie(df)


def test_refs_name_the_stored_turn(spark):
    rows = [r for r in made(5) if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stored = {(r["conv"], r["pos"]): r["bytes"] for r in prefix_trie.turns(df).collect()}
    for r in prefix_trie.trie(df).collect():
        assert (r["ref"]["src"] is None) == (r["depth"] == 0)
        assert r["depth"] == 0 or (r["ref"]["src"], r["ref"]["at"]) in stored
