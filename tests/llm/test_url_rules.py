"""Operator 3: policy, mined rules by plain counting, and odd urls."""

from itertools import combinations

from petrichor.llm import queries as Q
from petrichor.llm import url_rules as U

URLS = ["https://A.Example.NET/en/1", "http://example.net/de/2?x=1", "ftp://b.example.com/de/", "https://x.org/fr/9#t", "https://notnet/a", "no scheme", None, "https://net", "https://net/",
        "https://x.org/de/1", "http://u://v.net/en/", "https://example.net?q=/en/"]


def test_policy(spark):
    pages = spark.createDataFrame([(k, u, "h", "clash", 1) for k, u in enumerate(URLS)], "page_id long, url string, html string, host string, items int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judged(pages, labels, Q.POLICY, support=0.01).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/2", "net/", "block")
    assert got[2] == ("b.example.com", "/de/", "example.com/de/", "block")
    assert got[3] == ("x.org", "/fr/9", "org/fr/", "allow")
    assert got[4][:3] == ("notnet", "/a", None)
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[5][3] == "allow"
    assert got[7][:3] == ("net", "", None) and got[8][2:] == ("net/", "block")
    assert got[10][:2] == ("u:", "//v.net/en/")
    assert got[11][:3] == ("example.net", "", None)


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "https://x.org/a"), (1, "https://x.org/a"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in U.judged(some, labels, Q.POLICY).collect()] == ["allow"] * 3
    assert U.judged(some.limit(0), labels, Q.POLICY).count() == 0


def test_deep_segments_and_query_values_tell(spark):
    deep = [(k, f"https://a{k}.org/x/y/{'z/' * (k % 3)}{'spam' if k % 2 else 'good'}/{k}") for k in range(40)]
    value = [(k, f"https://b{k}.org/x?kind={'ads' if k % 2 else 'news'}&n={k}") for k in range(100, 140)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in deep + value if k % 20 < 14], "doc_id long, quality int, toxic int")
    out = U.judged(spark.createDataFrame(deep + value, "page_id long, url string"), labels, (), support=0.02).collect()
    assert {r.page_id: r.verdict for r in out} == {k: "block" if k % 2 else "allow" for k, _ in deep + value}


def plain_rules(rows, support, confidence):
    out, n = {}, len(rows)
    seen = {}
    for items, label in rows:
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                e = seen.setdefault(c, {})
                e[label] = e.get(label, 0) + 1
    for c, e in seen.items():
        for label, k in e.items():
            if k / n >= support - 1e-12 and k / sum(e.values()) >= confidence - 1e-12:
                out[(c, label)] = (k / sum(e.values()), k / n)
    return out


def test_mining_and_matching(spark):
    import random
    rng = random.Random(8)
    rows = [([t for t in "abcdef" if rng.random() < 0.5], rng.choice([U.BLOCK, U.ALLOW])) for _ in range(60)]
    rows = [r for r in rows if r[0]]
    rules = U.mine(spark.createDataFrame(rows + [([], U.BLOCK), (["a"], None)], "items array<string>, label string"), 0.05, 0.6)
    want = plain_rules(rows, 0.05, 0.6)
    got = {(tuple(r.antecedent), r.label): (r.confidence, r.support) for r in rules.collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    sets = [sorted(c) for k in range(1, 7) for c in combinations("abcdefz", k)]
    best = {tuple(r["items"]): r.best for r in U.matched(spark.createDataFrame([(s,) for s in sets], "items array<string>"), rules).collect()}
    for s in sets:
        fits = [(c, len(a), u, lab) for (a, lab), (c, u) in want.items() if set(a) <= set(s)]
        assert (tuple(s) in best) == bool(fits)
        if fits:
            assert abs(best[tuple(s)].confidence - max(fits)[0]) < 1e-9 and best[tuple(s)].label in (U.BLOCK, U.ALLOW)


def test_tokens_that_always_come_together_are_one_item(spark):
    """Sixty segments of one shared path: by plain mining 2**60 combinations."""
    shared = "/".join(f"s{k}" for k in range(60))
    rows = [(k, f"https://a{k}.org/{shared}/{k}" if k % 10 == 0 else f"https://b{k}.org/x/{k % 7}") for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k, _ in rows if k < 300], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows + [(1000, "https://new.org/s7/other"), (1001, "https://new.org/x/y")], "page_id long, url string")
    out = {r.page_id: r.verdict for r in U.judged(pages, labels, ()).collect()}
    assert {k for k, v in out.items() if v == "block"} == {k for k, _ in rows if k % 10 == 0} | {1000}


def test_contraction_names_equal_baskets(spark):
    rows = [(["a", "b", "c"],), (["a", "b"],), (["c", "d"],), (["e"],)] * 5
    got = {r.token: r["item"] for r in U.contracted(spark.createDataFrame(rows, "items array<string>"), 0.2).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
