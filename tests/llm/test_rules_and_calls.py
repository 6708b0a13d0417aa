"""URL rules and tool calls against plain versions."""

import json

from gradus.llm import tool_calls, url_rules


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules(spark):
    rules = [*url_rules.QUERY_RULES, ("a.com", "", "block"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("a.com", "/x/y", "allow"),
             ("a.com", "/é", "block"), ("a.com", "/x/y/z", "block"), ("b.a.com", "/", "allow")]
    urls = [None, "", "org/", "http://ORG/", "http://x.org", "https://example.org/es/1?x", "http://m.example.org/en/12", "http://example.org/en/2",
            "http://borg/", "http://q.com/fr/", "http://q.com/fr", "http://a.com/x/y/z/w", "http://a.com/x/yy", "http://A.com/x#f", "http://a.com/é/1",
            "http://a.com/w", "http://b.a.com/x/y", "http://c.b.a.com/", "x://y://org/", "http:///a", "http://a..org/", "http://.org/", "http://a.com:80/x",
            "http://a.com/x" + "y" * 70_000] * 2
    pages = spark.createDataFrame([(None if i % 7 == 0 else i, u, "mine", 1) for i, u in enumerate(urls)],
                                  "page_id long, url string, rule string, hkey int")
    table = spark.createDataFrame(rules, url_rules.RULES_SCHEMA)
    # the blocking one of two equal rules stands
    clear = [r for r in rules if r != ("a.com", "/x", "allow")]
    for rows in (20_000, 3):
        got = sorted([(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"])
                      for r in url_rules.judge(pages, table, rows_per_sweep=rows).collect()], key=str)
        want = [(None if i % 7 == 0 else i, u, *plain(u, clear)) for i, u in enumerate(urls)]
        assert got == sorted(want, key=str)
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, table.limit(0), default="block").collect()} == {"block"}


def test_tool_calls(spark):
    schemas = {"f": {"x": ("integer", True), "y": ("array", False)}}
    calls = [("a", None, "f", '{"y": [1.5, "é"], "x": 1}'), ("b", "a", "f", '{"x": true}'), ("c", "b", "f", "{"), ("d", "lost", "f", "[1]"),
             ("e", "h", "f", None), ("h", "e", "f", '{"x": 2}'), ("k", "h", "g", "{}"), (None, "a", "f", "{}"), ("a", None, "f", '{"y": [1.5, "é"], "x": 1}'),
             ("n", "c", "f", '{"x": NaN, "z": 1}'), ("s", "s", "f", '{"z": 3}')]
    results = [("a", "ok"), ("b", None), ("b", "two"), ("x", "no call"), (None, "lost")]
    got = {r["call_id"]: r for r in tool_calls.link(
        spark.createDataFrame(calls, "call_id string, parent_id string, name string, arguments string"),
        spark.createDataFrame(results, "call_id string, content string"), schemas).collect()}
    assert set(got) == set("abcdehknsx")
    assert {k: got[k]["level"] for k in got} == {"a": 0, "b": 1, "c": 2, "n": 3, "d": 0, "e": None, "h": None, "k": None, "s": None, "x": None}
    assert got["a"]["n_calls"] == 2 and got["b"]["n_results"] == 2 and got["x"]["status"] == "orphan"
    assert got["a"]["record"] == ('{"arguments":{"x":1,"y":[1.5,"é"]},"errors":[],"id":"a","level":0,"name":"f",'
                                  '"parent":null,"result":"ok","status":"answered"}')
    assert got["b"]["errors"] == ["x is no integer"] and json.loads(got["b"]["record"])["result"] == "two"
    assert got["c"]["errors"] == ["arguments are no JSON"] and got["n"]["errors"] == ["arguments are no JSON"]
    assert got["d"]["errors"] == ["arguments are no object", "parent missing"]
    assert got["k"]["errors"] == ["cycle", "unknown tool"]
    assert got["s"]["errors"] == ["cycle", "missing x", "unexpected z"]


def test_levels_of_a_long_chain(spark):
    calls = spark.createDataFrame([(f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(300)], "call_id string, parent_id string")
    assert sorted(map(tuple, tool_calls.levels(calls).collect())) == [(f"{i:04d}", i) for i in range(300)]


def test_turns_of_odd_conversations(spark):
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (1, 2, "user", None, 0), (None, 0, "user", "x", 0), (1, None, "user", "x", 0),
            (2, 3, "system", "", 0), (2, 4, None, "x", 0), (1, 0, "user", "hi", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id int")
    got = {r["call_id"]: r for r in tool_calls.link(*tool_calls.turns(table), tool_calls.QUERY_SCHEMAS).collect()}
    assert set(got) == {"1:0", "1:2", "2:3"}
    assert got["1:2"]["errors"] == ["missing text"] and got["1:2"]["level"] == 1
    assert got["2:3"]["errors"] == ["parent missing"] and got["1:0"]["n_calls"] == 2
    assert tool_calls.link(*tool_calls.turns(table.limit(0)), tool_calls.QUERY_SCHEMAS).count() == 0
