"""WARC archives: written, indexed, read back by ranges, against the pages themselves."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradus.llm import warc
from gradus.llm.common import file_system

SCHEMA = "page_id long, url string, html string, id int, payload string, best int, archive string"


def made():
    r = random.Random(5)
    long = "".join(r.choice("abcdé \r\n\0") for _ in range(3_000))
    rows = [(i, f"http://x.org/{i}", long if i % 3 == 0 else "short" if i % 3 == 1 else f"{i} " * 400) for i in range(60)]
    return rows + [(100, None, None), (101, "http://é.org/a b\r\nWARC-Type: x", ""), (None, "u", long), (None, "v", "q" * 1000), (None, "w", "q" * 1000),
                   (200, "same", "z" * 2000), (200, "same", "z" * 2000), (199, "less", "z" * 2000), (7, "edge", "é" * 500), (8, "edge", "é" * 500),
                   (9, "below", "a" * 999), (10, "below", "a" * 999), (11, "large", "y" * 1_000_000)]


def plain(rows):
    groups = {}
    for i, _, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, _, t in rows:
        raw, ids = (t or "").encode(), groups[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        again = len(raw) >= 1000 and len(ids) > 1 and i != best
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, "y") for r in made()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def written(pages):
    return warc.write(pages)


def test_round_trip(spark, pages, written, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op12_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain(made())


def test_index_names_every_byte_once(written):
    folder, index = written
    fs, base = file_system(folder)
    ends = {}
    for r in sorted(index.collect(), key=lambda r: (r["archive"], r["offset"])):
        assert r["offset"] == ends.get(r["archive"], 0)
        ends[r["archive"]] = r["offset"] + r["length"]
    assert len(ends) > 1
    for name, size in ends.items():
        raw = fs.open_input_file(f"{base}/{name}").read()
        assert len(raw) == size
        text = gzip.decompress(raw)  # members one after another are one gzip file
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_selected_records_only(written):
    folder, index = written
    some = index.where(F.col("url").startswith("http://x.org/1"))
    got = warc.fetch(folder, some).collect()
    assert sorted(r["id"] for r in got) == [i for i in range(60) if str(i).startswith("1")]
    assert warc.fetch(folder, index.limit(0)).collect() == []
    assert all(r["digest"] == hashlib.sha1((t or "").encode()).hexdigest() for r in index.collect() for i, u, t in made() if i == r["id"] and u == r["url"])


def test_neighbours_are_one_read():
    assert list(warc.spans([(0, 10), (10, 5), (40, 5), (100, 50), (150, 1)], gap=25, most=60)) == [(0, 3), (3, 5)]
    assert list(warc.spans([(0, 10), (10, 100), (110, 1)], gap=0, most=50)) == [(0, 1), (1, 2), (2, 3)]
    assert list(warc.spans([])) == []


def test_archives_roll_and_damage_is_seen(spark, pages, monkeypatch):
    whole = warc.member(3, "http://a", b"x" * 50, "urn:uuid:1", None, "1970-01-01T00:00:00Z")
    assert warc.parse(whole)[1] == b"x" * 50
    with pytest.raises(ValueError):
        warc.parse(whole + whole)
    with pytest.raises(ValueError):
        warc.parse(whole[:-9])
    folder, index = warc.write(pages.limit(0))
    assert index.collect() == [] and warc.resolve(warc.fetch(folder, index)).collect() == []


def test_names_of_stores():
    fs, base = file_system("file:/tmp/a")
    assert base == "/tmp/a" and file_system("/tmp/b")[1] == "/tmp/b" and type(fs) is type(file_system("file:///c")[0])
