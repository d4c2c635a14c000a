"""URL filters: allow and block rules, and trust propagated over the link graph, in DataFrame functions only.

Rules judge the urls that they fit. All others follow their host: personalised PageRank spreads trust from
the hosts that allow rules fit along links, and distrust from the hosts that block rules fit against them
(who links to a blocked host is suspect), until no verdict can change any more by what is still on its way, until no host's score changes by more than
TOLERANCE of itself, or for ROUNDS rounds, after which less than TOLERANCE of all trust is still on its way. What ends at hosts without links goes back to the seeds: it would
raise all scores of its kind alike, so each kind is scaled to a sum of 1 in the end instead. Hosts whose share of distrust, in the sum
of both, is LEAST_SHARE or more are blocked. Edges are the links between different hosts, counted once per pair, and each host
counts as linked with its parent domain both ways.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; a null
page has no links; repeated pages count their links again but are judged alike; without seeds all that no
rule fits is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

DAMPING = 0.85
#: Relative change of a score over ROUNDS_EACH rounds, made in one plan, below which it has settled.
TOLERANCE, ROUNDS_EACH = 1e-7, 8
#: DAMPING to this power is TOLERANCE.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
LEAST_SHARE = 0.6
#: Edges (some 100 bytes each) that are broadcast.
EDGES_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a host of their own: a scheme, or // alone.
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    """host and all its subdomains, paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.split_part(url, F.lit("://"), F.lit(1))
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.when(url.contains("://"), F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), _UPPER, _LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.split_part(url, F.lit("://"), F.lit(1))
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column, value: str) -> Column:
    """The name or verdict of the longest rule that fits, or null. Of equally long ones the first in order wins."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        out = F.when(rule.fits(host, path), F.lit(getattr(rule, value))).otherwise(out)
    return out


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts; and one link each way between a host and its parent domain."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    links = found.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select("host").where("host != ''").distinct()
    parent = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("parent")).where("parent != ''")
    both = parent.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*").distinct()
    return links.unionByName(both.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def all_decided(scores: DataFrame, open_: float) -> bool:
    """Whether no host's share of distrust can cross LEAST_SHARE any more, when each score, and each kind's sum, may still change by
    open_, and no host will be reached by a kind that hasn't reached it."""
    total = {r.kind: r.total for r in scores.groupBy("kind").agg(F.sum("score").alias("total")).collect()}  # two rows at most
    if any(t <= 2 * open_ for t in total.values()):
        return False
    least, most = {}, {}
    for kind in ("trust", "distrust"):
        score = F.max(F.when(F.col("kind") == kind, F.col("score")))
        sum_ = total.get(kind, 1.0)
        least[kind], most[kind] = F.coalesce(F.greatest(score - open_, F.lit(0.0)) / (sum_ + open_), F.lit(0.0)), F.coalesce((score + open_) / (sum_ - open_), F.lit(0.0))
    hosts = scores.groupBy("host").agg(*(x[k].alias(f"{n}_{k}") for n, x in (("least", least), ("most", most)) for k in x))
    edge = 2e-6  # shares are rounded
    blocked = F.expr(f"least_distrust > 0 and least_distrust >= {LEAST_SHARE + edge} * (least_distrust + most_trust)")
    allowed = F.expr(f"most_distrust = 0 or most_distrust < {LEAST_SHARE - edge} * (most_distrust + least_trust)")
    return hosts.where(~(blocked | allowed)).isEmpty()


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, verdicts: bool = False) -> DataFrame:
    """kind, host, score: personalised PageRank, settled, or after so many rounds; with verdicts, once these can't change. links: kind, src, dst, n; seeds: kind,
    host, seed (summing to 1 a kind). After k rounds DAMPING^k of a kind's seed is still on its way, so no score changes by more."""
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    edges = stored(links.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("part")), "edges")
    seeds = stored(seeds, "seeds")
    # A small graph is broadcast once, and its rounds run in one task; a large one is joined by shuffles.
    count = edges.count()
    small = count <= EDGES_BROADCAST
    dealt = F.broadcast(edges) if small else edges
    kept = seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score"))

    def after(scores: DataFrame, turns: int) -> DataFrame:
        for _ in range(turns):
            moved = dealt.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("part") * DAMPING).alias("score"))
            both = moved.unionByName(kept)  # of a small graph in one task, which needs no exchange from round to round
            scores = (both.coalesce(1) if small else both).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        return scores

    scores, done = seeds.select("kind", "host", F.col("seed").alias("score")), 0
    while done < rounds:
        turns = min(ROUNDS_EACH, rounds - done)
        both = stored(after(scores, turns).join(scores.withColumnRenamed("score", "last"), ["kind", "host"], "left"), "scores")
        facts = both.agg(F.max(F.when(F.col("score") > 0, F.abs(F.col("score") - F.coalesce("last", F.lit(0.0))) / F.col("score"))).alias("change"), F.count_if(F.col("last").isNull()).alias("new")).first()
        drop_stored(scores if done else None)
        scores, done = _last(both), done + turns
        if facts.change is None or facts.change <= TOLERANCE:  # a host that is new changes by all of its score
            break
        if verdicts and not facts.new and all_decided(scores, DAMPING**done):
            break
    total = scores.groupBy("kind").agg(F.sum("score").alias("total"))  # two rows at most
    return scores.join(F.broadcast(total), "kind").select("kind", "host", (F.col("score") / F.col("total")).alias("score"))


def _last(both: DataFrame) -> DataFrame:
    scores = both.drop("last")
    scores._stored_at = both._stored_at
    return scores


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds host, path, rule, verdict, trust and distrust. keep: the columns that stay, all unless given."""
    made = ["host", "path", "rule", "verdict", "trust", "distrust"]
    kept = [c for c in (pages.columns if keep is None else keep) if c not in made]
    split = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    judged = split.select("*", longest_rule(rules, F.col("host"), F.col("path"), "name").alias("rule"), longest_rule(rules, F.col("host"), F.col("path"), "verdict").alias("by_rule"))
    seeds = judged.where("rule is not null and host != ''").groupBy(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows at most
    seeds = seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))
    links = host_links(split)
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    scores = propagate(both, seeds, verdicts=True)
    hosts = scores.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"), F.coalesce(F.max(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"))
    joined = judged.drop("html").join(hosts, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("by_rule", F.when((distrust > 0) & (F.round(distrust / F.nullif(trust + distrust, F.lit(0.0)), 6) >= LEAST_SHARE), "block").otherwise("allow"))
    return joined.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
