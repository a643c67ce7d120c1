import re

from pyspark.sql import functions as F

from docquarry.llm import url_rules


def plain(url):
    """Host, path and listed rule as the contract words them."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, *rule


def test_no_rule_from_few_rows_or_from_one_verdict(spark):
    df = lambda rows: spark.createDataFrame(rows, "tokens array<string>, verdict string")
    few = [(["h:a"], "block")] * 19 + [(["h:b"], "allow")] * 19
    assert url_rules.mine(df(few)).count() == 0 and url_rules.mine(df(few + few[:1])).count() == 1
    assert url_rules.mine(df([(["h:a"], "block")] * 50)).count() == 0
    weak = [(["h:a"], "block")] * 90 + [(["h:a"], "allow")] * 10 + [(["h:b"], "block")] * 90 + [(["h:b"], "allow")] * 20
    assert url_rules.mine(df(weak)).count() == 0  # confidence 0.9 where 0.86 of all are blocked


ODD = [None, "", "no scheme", "http://", "://x.com", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en", "http://example.com/en/", "http://com", "http://com/", "http://xcom/", "a://b.net/es/x://y", "http://É.net/fr/1", "http://h.net?/es/", "http://h.com#/x", "http://a.b.com/\n/q?z", "x\ny://m.com/p", "http://long.net/es/" + "x/" * 50_000, "http://long.org/" + "y" * 100_000]


def test_rows(spark):
    urls = ODD + [f"https://{sub}.{'spam' if sub == 'bad' else 'site'}.{tld}/{lang}/{i}" for i in range(12) for sub in ("bad", "www", "blog") for tld in ("com", "net", "org") for lang in ("en", "es", "fr", "de")]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[20], "", ""), (5, urls[5], "", "")], "page_id long, url string, html string, verdict string")
    got = url_rules.judge(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, rule, said = plain(urls[r.page_id] if r.page_id is not None else urls[20])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == said if said else r.verdict in ("allow", "block")
    # net/es and net/fr are always blocked where listed; the mined rules carry that to nothing that is only allowed
    assert {r.verdict for r in got if r.host.endswith(".org") and r.path.startswith("/de")} == {"allow"}
    assert url_rules.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_rules.judge(df.where("page_id < 5")).collect()} == {"allow"}


def test_matching_equals_brute_force(spark):
    """The inverted index finds the rules whose tokens a URL has, no more and no fewer."""
    urls = [f"https://{s}.{d}.{t}/{lang}/{i}" for i in range(6) for s in ("a", "b") for d in ("x", "y") for t in ("com", "net", "org") for lang in ("es", "fr", "en")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_rules.host_and_path(F.col("url"))
    own = df.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = url_rules.listed_rule(F.col("host"), F.col("path"))
    own = own.withColumns({"verdict": said, "tokens": url_rules.url_tokens(F.col("url"), F.col("host"), F.col("path"))})
    labelled = own.where("verdict is not null")
    rules = [(set(r.antecedent), r.confidence) for r in url_rules.mine(labelled).collect()]
    rows = labelled.collect()
    assert rules
    for tokens, confidence in rules:
        having = [r for r in rows if tokens <= set(r.tokens)]
        blocked = sum(r.verdict == "block" for r in having)
        base = sum(r.verdict == "block" for r in rows) / len(rows)
        assert confidence / max(1e-9, 1 - confidence) >= url_rules.MIN_ODDS * base / (1 - base) - 1e-9 and blocked >= url_rules.MIN_ROWS
        assert confidence >= url_rules.MIN_CONFIDENCE and blocked >= url_rules.MIN_SUPPORT * len(rows) and abs(confidence - blocked / len(having)) < 1e-9
    by = {r.page_id: r.by_rules for r in url_rules.judge(df).collect()}
    for r in own.collect():
        want = 0 if r.verdict else sum(t <= set(r.tokens) for t, _ in rules)
        assert by[r.page_id] == want


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/1"), (2, "http://b.com/x"), (3, "http://c.org/es/3")], "page_id long, url string")
    plan = url_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_rule_counts_where_constant_paths_make_many(spark):
    """Rules that hold another's tokens go, no others: {h:example, p:en}, below many of confidence 1, still judges."""
    deep = [f"https://host{k}.net/es/" + "/".join(f"{c}{k}" for c in "abcdefg") + f"/{i}" for k in range(8) for i in range(40)]
    listed = [f"https://example.com/en/{i}" for i in range(100)] + [f"https://www.example.com/en/{i}" for i in range(10)]
    listed += [f"https://example.com/de/{i}" for i in range(60)] + [f"https://other.com/en/{i}" for i in range(60)]
    open_urls = [f"https://example.org/en/{i}" for i in range(1000, 1020)] + [f"https://example.org/de/{i}" for i in range(1000, 1020)]
    urls = deep + listed + open_urls
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    first = len(deep + listed)
    host, path = url_rules.host_and_path(F.col("url"))
    said = url_rules.listed_rule(host, path)[1]
    labelled = df.where(F.col("page_id") < first).select(url_rules.url_tokens(F.col("url"), host, path).alias("tokens"), said.alias("verdict"))
    rules = {frozenset(r.antecedent): r.confidence for r in url_rules.mine(labelled).collect()}
    assert abs(rules[frozenset({"h:example", "p:en"})] - 100 / 110) < 1e-9
    assert not any(a < b for a in rules for b in rules)
    got = {r.page_id: r for r in url_rules.judge(df).collect() if r.page_id >= first}
    assert {i: r.verdict for i, r in got.items()} == {first + i: "block" if "/en/" in u else "allow" for i, u in enumerate(open_urls)}
