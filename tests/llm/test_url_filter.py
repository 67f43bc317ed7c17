import re

import pytest
import regex

from pyspark.sql import functions as F

from plumbline.llm import url_filter as U

URLS = [
    None, "", "no scheme/en/", "http://", "https://example.org", "https://example.org/", "https://EXAMPLE.org/es/1", "http://a.b.example.org/es/", "http://example.org/esx/", "http://example.org/en/12?x=/es/",
    "http://badexample.org/es/1", "http://x.com/fr/2", "http://x.com/de/2#a", "ftp://com/de/", "http://www.cheap-pills.example.com/en/1", "http://cheap.example.com/", "http://x.net/free-download/1", "http://x.net/freedownload",
    "http://xxx-site.net/", "http://u:p@Host.COM:80/fr/x", "http://x.com?y=/fr/", "a://b://c/d", "http://ÄÖ.org/ß", "http://casino.net", "http://pills-best.net/a b",
    "http://my site.example.org/es/x", "http://x example.org/es/", "http://spam-farm.example.net/en/1", "http://écasino.net/", "http://a.b/c/login?x", "http://a.b/loginx", "http://m.adult-x.example.net/en/2",
    "http://free-bets.example.com/", "http://line\nbreak.example.org/es/\n", "http://a.org/" + "x/y-z." * 20_000 + "?q", "http://" + "sub." * 5_000 + "example.org/en/1",
]


def want(url, host_rules, pattern_rules):
    host = path = ""
    if url and "://" in url:
        rest = re.match(r"[^?#]*", url[url.index("://") + 3 :])[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + tail
    fit = [r for r in host_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    # whole runs of letters and digits, as the expressions' classes name them
    block = any(regex.search(r.pattern, f"{host}#{path}") for r in pattern_rules)
    return host, path, best and best.name, best.verdict if best else "block" if block else "allow"


@pytest.mark.parametrize("inline", [2000, 0])
def test_brute_force(spark, inline):
    rows = [(i % 7 or None, u, "x", f"y{i}" if i % 3 else None) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id int, url string, host string, `__tokens` string").withColumns({"__id": F.lit("mine"), "a.b": F.lit(1)}).repartition(3)
    got = U.judge(df, max_inline=inline)
    assert got.columns == ["page_id", "url", "__tokens", "__id", "a.b", "host", "path", "rule", "pattern", "verdict"]
    assert {(r["__tokens"], r["__id"], r["a.b"]) for r in got.collect()} == {(t, "mine", 1) for _, _, _, t in rows}
    key = lambda x: tuple(map(str, x))
    assert sorted([(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()], key=key) == sorted([(i, u, *want(u, U.HOST_RULES, U.PATTERN_RULES)) for i, u, _, _ in rows], key=key)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").coalesce(1)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, U.op8_url_filter(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(U.ORACLE["op8_url_filter"]).fetchall())


def test_many_rules(spark):
    rules = [U.HostRule("block" if i % 2 else "allow", f"h{i}.example.com", f"/{'en/' if i % 3 else ''}") for i in range(2500)]
    urls = [f"http://s.h{i}.example.com/{'en' if i % 2 else 'de'}/{i}" for i in range(0, 2600, 37)]
    got = U.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules, []).collect()
    assert sorted((r["url"], r["rule"], r["verdict"]) for r in got if r["rule"]) == sorted((u, w[2], w[3]) for u in urls if (w := want(u, rules, []))[2])


def test_every_rule_of_the_query_has_a_token():
    assert all(r.tokens for r in U.HOST_RULES + U.PATTERN_RULES)


def test_index_takes_the_rarest_token():
    by, loose = U.index([U.HostRule("block", "com", "/de/"), U.PatternRule("p", "x", ())], {"com": 900, "de": 3})
    assert by == {"de": [0]} and loose == [1]


def test_empty_and_no_rules(spark):
    df = spark.createDataFrame([("http://a.org/",)], "url string")
    assert U.judge(df.limit(0)).count() == 0 and U.judge(df, [], []).collect()[0]["verdict"] == "allow"
