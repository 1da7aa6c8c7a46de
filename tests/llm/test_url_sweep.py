import random
import re

from lociform.llm import url_sweep as U

SCHEMA = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=(0, None, default))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["com", "example", "a", "b", "comx", "co-m", "www", "org"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["en", "de", "7", "x"]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path() if rng.random() < 0.8 else "") for _ in range(150))}.values())
    urls = [None, "", "no scheme", "http://", "http://?x", "HTTP://A.COM/en?x://y", "http://a.b#/en", "x://com:80/en", "http://COM", "://com/en\n/de#", "http://a..com/en", "http://.com/", "http://com./", "http://ü.com/en", "http://" + "a." * 3000 + "com/en"]
    urls += [f"https://{host()}{path()}{rng.choice(['', '?q=/x', '#t'])}" for _ in range(600)]
    urls += urls[:30]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
    for buckets in (1, 5):
        got = {r.page_id: tuple(r)[1:] for r in U.judge(df, spark.createDataFrame(rules, SCHEMA), buckets=buckets).collect()}
        assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string")
    rules = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in U.judge(pages, rules).collect()] == [(1, "a.com", "/x", None, "allow")]
    some = spark.createDataFrame([("com", "/", "block"), ("com", "/", "block"), ("", "/", "block"), (None, None, None)], SCHEMA)
    assert U.judge(pages.where("false"), some).count() == 0
    assert U.judge(pages, some).first().verdict == "block"


def test_rules_for_whole_hosts(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com"), (3, "http://b.org/"), (4, "http://a.com/ok/1"), (5, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("com", "", "block"), ("a.com", "/ok", "allow"), ("org", None, "block")], SCHEMA)
    assert {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, rules).collect()} == {1: ("com", "block"), 2: ("com", "block"), 3: ("org", "block"), 4: ("a.com/ok", "allow"), 5: (None, "allow")}


def test_hot_host(spark, monkeypatch):
    from lociform.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    urls = [f"http://www.example.com/{'en' if k % 3 else 'de'}/{k}" for k in range(300)] + [f"http://h{k}.org/en" for k in range(50)]
    rules = [("com", "/en", "block"), ("example.com", "/de/3", "allow"), ("org", "/", "block"), ("h7.org", "/en", "allow")]
    got = {r.page_id: tuple(r)[1:] for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), spark.createDataFrame(rules, SCHEMA)).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}
