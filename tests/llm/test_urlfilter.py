import pytest
from pyspark.sql import functions as F

from tracesift.llm import urlfilter
from tracesift.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    "http://WWW.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://a.example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://notexample.org/es/", "ftp://b.net", "http://b.net?q=/x", "http://b.net#/x",
    "no scheme", "", None, "://h/p", "a://b://c/d", "http:///p", "HTTP://ÄB.NET/Ä", "http://good.net/", "http://bad.net/", "http://com/fr/", "http://c.com/fr",
]


def links(*hosts):
    return "".join(f'<a class=x href="https://{h}/z">t</a>' for h in hosts)


@pytest.fixture(scope="module")
def judged(spark):
    html = {6: links("x.com"), 16: links("b.net"), 17: links("y.com"), 3: links("good.net", "GOOD.net", "b.net")}
    rows = [(i, u, html.get(i)) for i, u in enumerate(URLS)] + [(50, "http://y.com/de/9", None), (51, "http://bad.net/again", None), (16, URLS[16], html[16])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1)).repartition(3)
    return urlfilter.judge_urls(df, URL_RULES).collect()


def test_rules(judged):
    assert len(judged) == len(URLS) + 3
    for r in judged:
        host, path = split(r.url)
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        assert not rule or r.verdict == rule.verdict


def test_propagation(judged):
    verdict = {r.url: r.verdict for r in judged}
    trust = {r.url: (r.trust, r.distrust) for r in judged}
    assert verdict["http://bad.net/"] == verdict["http://bad.net/again"] == "block"  # links to a blocked host
    assert verdict["http://good.net/"] == "allow" and trust["http://good.net/"][0] > 0
    assert all(r.verdict == "allow" for r in judged if not r.host)


def test_against_plain_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("b", "a", 1), ("c", "a", 3), ("d", "c", 1)]
    seeds = {"a": 0.75, "d": 0.25}
    want = dict(seeds)
    for _ in range(4):
        new = {h: s * (1 - urlfilter.DAMPING) for h, s in seeds.items()}
        for s, t, n in edges:
            out = sum(m for x, _, m in edges if x == s)
            new[t] = new.get(t, 0) + want.get(s, 0) * n / out * urlfilter.DAMPING
        want = new
    got = urlfilter.propagate(
        spark.createDataFrame([("trust", *e) for e in edges], "kind string, src string, dst string, n long"), spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "kind string, host string, seed double"), rounds=4
    )
    assert {r.host: r.score for r in got.collect()} == pytest.approx({h: s / sum(want.values()) for h, s in want.items()})


def test_settled_scores(spark):
    """A chain of more links than any fixed few rounds reach, a star of small seeds, and a cycle of two hosts."""
    edges = [(f"h{i}", f"h{i + 1}") for i in range(20)] + [("x", "y"), ("y", "x")] + [("x", f"s{i}") for i in range(3)]
    seeds = {"h0": 1e-15, "x": 1 - 1e-15}
    out = {s: sum(a == s for a, _ in edges) for s, _ in edges}
    want = dict(seeds)
    for _ in range(400):
        new = {h: s * (1 - urlfilter.DAMPING) for h, s in seeds.items()}
        for s, t in edges:
            if s in want:
                new[t] = new.get(t, 0) + want[s] / out[s] * urlfilter.DAMPING
        want = new
    got = urlfilter.propagate(
        spark.createDataFrame([("trust", *e, 1) for e in edges], "kind string, src string, dst string, n long"), spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "kind string, host string, seed double")
    )
    assert {r.host: r.score for r in got.collect()} == pytest.approx({h: s / sum(want.values()) for h, s in want.items()}, rel=1e-6, abs=0)


def test_dangling_mass_goes_back(spark):
    """As if hosts without links linked to the seeds."""
    edges, seeds = [("a", "b"), ("a", "c"), ("b", "a")], {"a": 0.5, "d": 0.5}
    want = dict(seeds)
    for _ in range(400):
        new = {h: s * (1 - urlfilter.DAMPING) for h, s in seeds.items()}
        for s, mass in want.items():
            to = [b for a, b in edges if a == s]
            for t, part in ([(t, 1 / len(to)) for t in to] or list(seeds.items())):
                new[t] = new.get(t, 0) + mass * part * urlfilter.DAMPING
        want = new
    got = urlfilter.propagate(
        spark.createDataFrame([("trust", *e, 1) for e in edges], "kind string, src string, dst string, n long"), spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "kind string, host string, seed double")
    )
    assert {r.host: r.score for r in got.collect()} == pytest.approx(want, rel=1e-6)


def test_long_html_and_equal_rules(spark):
    """A page of many links; and of two rules of equal length the first in order."""
    rows = [(1, "http://big.net/", links(*(f"h{i}.net" for i in range(20_000)))), (2, "http://a.net/x/1", None), (3, "http://bad.com/de/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [urlfilter.Rule("net", "/x/", "allow"), urlfilter.Rule("a.net", "/", "block"), urlfilter.Rule("bad.com", "/", "block")]
    got = {r.page_id: r for r in urlfilter.judge_urls(df, rules).collect()}
    assert got[1].verdict == "allow" and got[2].rule == "net/x/" and got[2].verdict == "allow" and got[3].verdict == "block"


def test_far_hosts(spark):
    """Who leads to a blocked host over twelve others is blocked too."""
    rows = [(i, f"http://far{i}.net/", links(f"far{i + 1}.net")) for i in range(12)] + [(12, "http://far12.net/", links("bad.com")), (13, "http://bad.com/de/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.verdict for r in urlfilter.judge_urls(df, URL_RULES).collect()} == {"block"}


def test_empty(spark):
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0
