"""URL filters against a plain scan of all rules for each url."""

import random

from pyspark.sql import functions as F

from tillroll.llm import urls

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"), ("Example.COM", "/en/news/", "allow"), ("a.b.c", "", "block"), ("b.c", "/x", "allow"), ("c", "/x/y", "block"),
    ("a.b.c", "/x", "allow"), ("org", "/é", "block"), ("x-y.org", "/", "block"), ("y.org", "/", "allow"),
]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    host, path = lower(rest[:cut]), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in rules:
        if h is None or p is None or v is None:
            continue
        h = lower(h)
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), h + p, v))
    return host, path, best and best[2], best[3] if best else default


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_urls(n=600):
    rng = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.com", "m.example.com", "xexample.com", "net", "t.net", "a.b.c", "q.a.b.c", "b.c", "z.b.c",
             "c", "org", "x-y.org", "xy.org", "y.org", "a.y.org", "", "user@h.net:80", "com.", ".com", "café.com"]
    paths = ["", "/", "/en", "/en/", "/en/news/1", "/es/", "/fr/x", "/x", "/x/y/z", "/é", "/\U0010ffff", "/en/\n2", "/EN/"]
    tails = ["", "?q=/en/", "#/en/", "?a#b"]
    out = [rng.choice(["http", "", "x"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(n)]
    return out + [None, "", "example.com/en/", "http:/x", "http://a://b/en/", "http://t.net/es/" + "x" * 40_000] + ["http://m.example.com/en/hot"] * 200


def test_against_every_rule(spark):
    given = list(enumerate(some_urls()))
    pages = spark.createDataFrame(given, "page_id long, url string").repartition(5)
    got = rows_of(urls.filter_urls(pages, urls.rule_table(spark, RULES), columns=["page_id"]))
    assert got == sorted(((i, *plain(u, RULES)) for i, u in given), key=str)


def test_deep_nesting_over_many_ranges(spark):
    """Rules nested in each other, opened many ranges before the urls they fit."""
    rules = [("h", "/" + "a/" * k, ["allow", "block"][k % 2]) for k in range(12)] + [("h", "/a/b%03d" % k, "block") for k in range(200)] + [("g.h", "/a/", "allow")]
    given = list(enumerate(["http://s.g.h/" + "a/" * (k % 14) + ("b%03d/" % (k % 300)) * (k % 3) + str(k) for k in range(900)]))
    pages = spark.createDataFrame(given, "page_id long, url string").repartition(3)
    got = rows_of(urls.filter_urls(pages, urls.rule_table(spark, rules), default="none", columns=["page_id"]))
    assert got == sorted(((i, *plain(u, rules, "none")) for i, u in given), key=str)


def test_repeated_and_partial_rules_and_empty_hosts(spark):
    rules = [("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("b.com", None, "block"), ("b.com", "/", None), ("", "/p", "block"), ("", "", "skip")]
    given = list(enumerate(["http://a.com/", "http://b.com/", "http://c.com/p/q", None, "https:///p", "http://x"]))
    pages = spark.createDataFrame(given, "page_id long, url string")
    got = rows_of(urls.filter_urls(pages, urls.rule_table(spark, rules), columns=["page_id"]))
    assert got == sorted(((i, *plain(u, [r for r in rules if r[:2] != ("a.com", "/")])) for i, u in given), key=str)
    assert [r[3:] for r in got[:1]] == [("a.com/", "block")]


def test_empty_tables_repeated_rows_and_clashing_names(spark):
    names = ["url", "rule", "Host", "row", "path", "grp", "key", "tag", "what", "shard", "depth", "odd.name", "col1"]
    rows = [("http://t.net/es/1", *[str(k) for k in range(1, len(names))])] * 2
    pages = spark.createDataFrame(rows, names)
    out = urls.filter_urls(pages, urls.rule_table(spark, RULES))
    assert out.columns == ["url", "row", "grp", "key", "tag", "what", "shard", "depth", "odd.name", "col1", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == 2 and got[0] == got[1] and tuple(got[0])[1:] == ("3", "5", "6", "7", "8", "9", "10", "11", "12", "t.net", "/es/1", "net/es/", "block")
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark, RULES)).count() == 0
    none = urls.filter_urls(pages, urls.rule_table(spark, RULES).limit(0), default="review")
    assert [(r["rule"], r["verdict"]) for r in none.collect()] == [(None, "review")] * 2


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame([(1, "http://t.net/es/1")], "page_id long, url string").select("page_id", "url", F.lit(1))
    plan = urls.filter_urls(pages, urls.rule_table(spark, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
