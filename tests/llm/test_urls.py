import random

from lodestone.llm.urls import FEATURES, RULES, host_statistics, judge, sampled


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and tail[:cut].startswith(p)]
    return (host, tail[:cut], *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_trees(spark):
    r = random.Random(1)
    hosts = ["a.example.net", "EXAMPLE.net", "x.b.example.com", "example.com", "c.org", "org", "net", "notexample.net", "fooexample.com", "q.de", "Ünet"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/de/1', '/fr/x', '/en', '/es/9'])}{r.choice(['', '?a=1&b=2', '#t', '?u=http://z/fr/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "http://net/en/\nx", "http://" + "x" * 5000 + ".net/"]
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    got = {x.page_id: x for x in judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = brute(u)
        x = got[i]
        assert (x.host, x.path, x.rule) == (host, path, rule), u
        assert x.verdict == verdict if verdict else x.verdict in ("allow", "block")


def test_one_verdict_and_none(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/x"), (2, "http://b.com/x")], "page_id long, url string")
    assert [x.verdict for x in judge(df).collect()] == ["block"] * 3
    assert judge(df.where("page_id = 2")).first().verdict == "allow"
    assert judge(df.limit(0)).count() == 0


def ranked_above(rows, score):
    """AUC: how often a blocked URL's risk passes an allowed one's."""
    good, bad = [score(x) for x in rows if x[1] == 0], [score(x) for x in rows if x[1] == 1]
    return sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))


def test_trees_rank_hosts_they_never_saw(spark):
    """URLs of blocked hosts carry digits and parameters; hosts without a rule are ranked by that alone."""
    r = random.Random(4)

    def url(host, bad):
        path = "/".join("".join(r.choice("0123456789" if bad and r.random() < 0.7 else "abcdefg") for _ in range(8)) for _ in range(r.randrange(1, 4)))
        return f"http://{host}/{path}" + ("?id=7&ref=9" if bad and r.random() < 0.8 else "")

    rules = (("bad.test", "/", "block"), ("god.test", "/", "allow"))
    rows = [(i, url(f"h{i % 50}.{'god' if i % 2 else 'bad'}.test", i % 2 == 0)) for i in range(800)]
    new = [(1000 + i, url(f"h{i % 50}.new.test", i % 2 == 0), 1 - i % 2) for i in range(200)]
    got = {x.page_id: x for x in judge(spark.createDataFrame(rows + [x[:2] for x in new], "page_id long, url string"), rules).collect()}
    assert all(got[i].rule is None for i, _, _ in new)
    assert ranked_above([(i, bad) for i, _, bad in new], lambda x: got[x[0]].risk) > 0.9


def test_suffix_statistics_are_of_other_folds(spark):
    rows = [(f"h{i}.com", "com", "block" if i % 3 else "allow") for i in range(60)] + [("x.com", "com", None), ("c.org", "org", "allow")]
    got = host_statistics(spark.createDataFrame(rows, "host string, _suffix string, _ruled string")).collect()
    com = {x.host: x.suffix_blocked for x in got if x.host.endswith("com")}
    assert len(got) == 62 and len(set(com.values())) <= 4  # one value a fold: nothing of a host's own label
    assert all(0.5 < v < 0.8 for v in com.values())
    rate = 40 / 61
    assert abs(next(x.suffix_blocked for x in got if x.host == "c.org") - rate) < 1e-9


def test_the_sample_is_bounded_and_of_both_labels(spark):
    rows = [(f"http://net/{i % 300}", 1.0) for i in range(3000)] + [(f"http://org/fr/{i}", 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "_url string, y double").selectExpr("_url", "'r' as rule", "if(y = 1, 'block', 'allow') as _ruled", *[f"y as {f}" for f in FEATURES])
    got = sampled(df, 100).collect()
    assert sum(x.label for x in got) == 50 and len(got) == 53 and len({x._url for x in got}) == 53
    assert abs(sum(x._weight for x in got if x.label) - sum(x._weight for x in got if not x.label)) < 1e-6
