"""Personal data: fixed patterns, and candidates that boosted trees judge by their format and context.

Fixed kinds are email, ip, card and phone, each found leftmost and without overlaps; a match that fails its check is dropped. Such
drops are what the method is for: "+1 (269) 555-3296 4524132264652876" is one phone match of too many digits. Generators of high recall
propose overlapping spans: every sequence of up to MOST_GROUPS digit groups of a chain of digits and separators, as card, phone or ip by
its number of digits, and every token with an at sign, or "at" and "dot" in words, as email. Boosted trees score a candidate by its format
(digits, groups, separators, plus sign, Luhn sum, octets) and context (words before it, letters that touch it); those above a threshold,
calibrated to LEAST_PRECISION on documents held out, are added, the better one where two overlap. Fixed spans stay, and nothing is added
over them.

Labels come from the fixed kinds themselves: a candidate that equals an accepted span is positive (1); one that meets an accepted span
otherwise (-1), equals a match that failed, is touched by letters or has too few digits (0) is negative; all others, like those within a
dropped match, have no label.
Features are small whole numbers, so all candidates of a corpus are counted into classes of equal features, one row each, and the trees
are fitted on these counts: all candidates take part, and what comes to the driver is bounded by the product of the features' ranges.

The main path is made of DataFrame functions alone, without a shuffle but for those counts. Positions are running sums over the pieces that
a pattern splits a text into, taken in chunks, and all patterns are free of backtracking over long runs, so that the work is nearly linear in
a text's length.

Spans count code points, ends are exclusive. Defined cases: null and empty texts have no spans; other columns pass through; repeated rows
are judged alike; texts of any length are scanned whole; without labelled candidates nothing is added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored

KINDS = ("email", "ip", "card", "phone")
#: Digit groups of a candidate at most, and the least precision on held-out documents that a threshold is calibrated to.
MOST_GROUPS, LEAST_PRECISION = 6, 0.99
#: Boosting: trees, depth, learning rate, least weight of a leaf.
TREES, DEPTH, RATE, LEAST_LEAF = 24, 3, 0.3, 2.0
_CHUNK, _CONTEXT = 64, 24

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# A run of characters that can't be the local part from its start can't from within; \G starts anew where the last match ended.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++"
_ONE_EMAIL = rf"[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++"
_CHAIN = r"[0-9]++(?:[ ().-]++[0-9]++)*+"
_QUAD = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
_EDGE = r"""\s@<>"'(),;:\[\]"""
_TOKEN = rf"(?:\G|(?<=[{_EDGE}])|^)[^{_EDGE}]++@[^{_EDGE}]++"
_SPELLED = rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[{_LABEL}]++(?: ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?[{_LABEL}]++)++"
#: Words before a candidate that tell its kind, as patterns of lower-case text.
_WORDS = {1: r"tel|phone|call|fax|mobil|whatsapp|sms", 2: r"card|visa|master|amex|credit|konto|account", 3: r"\bip\b|host|server|addr", 4: r"mail|contact|write"}

FEATURES = ("digits", "groups", "plus", "paren", "separator", "last", "luhn", "octets", "touch", "word")


@contextmanager
def deep_lambdas(spark: SparkSession) -> Iterator[None]:
    """Lambdas within lambdas are resolved a level per pass of the analyzer, and there are more levels here than it makes passes."""
    key = "spark.sql.analyzer.maxIterations"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body, or a lambda in it, reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The running sums of an array of numbers, in chunks: appending to one array would copy it once per element."""
    start = lambda: F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))
    added = lambda a, x: F.array_append(a, last(a) + x)

    def sums(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int")), lambda k: F.aggregate(F.slice(a, k * _CHUNK + 1, F.lit(_CHUNK)), start(), added))
        whole = lambda c, before: F.flatten(F.zip_with(c, F.slice(before, F.lit(1), F.size(c)), lambda own, more: F.transform(own, lambda x: x + more)))
        return let(chunks, lambda c: whole(c, F.aggregate(F.transform(c, last), F.array(F.lit(0).cast("bigint")), added)))

    return let(numbers, lambda a: F.when(F.size(a) > 0, sums(a)).otherwise(start()))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern: start, end, text, the end of what lies before (gap), its length (gap_size), and what follows (after)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(gaps: Column) -> Column:
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.right(g, F.lit(_CONTEXT)).alias("gap"), F.length(g).alias("gap_size"), m.alias("text")))
        pairs = F.zip_with(pairs, F.slice(gaps, F.lit(2), F.size(gaps)), lambda p, g: F.struct(p["gap"].alias("gap"), p["gap_size"].alias("gap_size"), p["text"].alias("text"), F.left(g, F.lit(1)).alias("after")))
        size = lambda p: (p["gap_size"] + F.coalesce(F.length(p["text"]), F.lit(0))).cast("bigint")
        ends = lambda p: running_sums(F.transform(p, size))
        full = lambda p, end: F.struct((end - F.length(p["text"])).alias("start"), end.alias("end"), p["text"].alias("text"), p["gap"].alias("gap"), p["gap_size"].alias("gap_size"), p["after"].alias("after"))
        return let(pairs, lambda p: F.filter(F.zip_with(p, ends(p), full), lambda m: m["text"].isNotNull()))

    return let(F.split(text, pattern, -1), placed)


def luhn(digits: Column) -> Column:
    """Whether digits, as many as a card has, pass the Luhn sum."""
    value = lambda d, i: F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    term = lambda x, i: F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))
    total = lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + term(value(d, i), i))
    return let(digits, lambda d: F.when(F.length(d).between(12, 19), total(d) % 10 == 0).otherwise(False))


def _span(kind: Column | str, start: Column, end: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def _no(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_CAND = f"struct<kind:string,start:bigint,end:bigint,label:int,{','.join(f'{f}:int' for f in FEATURES)}>"


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _numbers(chain: Column) -> Column:
    """The fixed spans and the candidates of one chain of digits and separators, as a struct of two arrays."""
    plus, offset = chain["gap"].endswith("+"), chain["start"]
    n_digits = lambda s: F.length(F.translate(s, " ().-", ""))
    text = chain["text"]
    phone_ok = plus & (F.length(text) >= 3) & n_digits(text).between(9, 15)
    card = lambda r: let(F.translate(r["text"], " -", ""), lambda d: F.length(d).between(13, 19) & luhn(d))
    cards = F.transform(matches(text, r"[0-9](?:[ -]?[0-9])*+"), lambda r: F.struct((r["start"] + offset).alias("start"), (r["end"] + offset).alias("end"), card(r).alias("ok")))
    quads = F.filter(matches(text, _QUAD), lambda r: r["text"].rlike(_OCTETS))
    dotted = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]++(?:\.[0-9]++)*+"), F.lit(0)), lambda r: F.exists(F.regexp_extract_all(r, F.lit(_QUAD), F.lit(0)), lambda q: q.rlike(_OCTETS)))

    def spans(c: Column) -> Column:
        found = F.concat(
            F.transform(quads, lambda r: _span("ip", r["start"] + offset, r["end"] + offset)),
            F.transform(F.filter(c, lambda r: r["ok"]), lambda r: _span("card", r["start"], r["end"])),
            F.when(phone_ok, F.array(_span("phone", offset - 1, chain["end"]))).otherwise(_no(_SPAN)),
        )
        return F.struct(found.cast(f"array<{_SPAN}>").alias("base"), candidates(c).alias("found"))

    def candidates(c: Column) -> Column:
        groups = matches(text, r"[0-9]++")
        breaks = lambda g, test: running_sums(F.transform(g, lambda x: F.when((x["start"] > 0) & ~test(x), F.lit(1).cast("bigint")).otherwise(0)))
        parts = {
            "glue": lambda g: breaks(g, lambda x: x["gap_size"] <= 3),
            "card": lambda g: breaks(g, lambda x: x["gap"].rlike("^[ -]$")),
            "dot": lambda g: breaks(g, lambda x: x["gap"] == "."),
            "sum": lambda g: running_sums(F.transform(g, lambda x: F.length(x["text"]).cast("bigint"))),
        }

        def told(g: Column) -> Column:
            zipped = F.arrays_zip(g.alias("g"), *(make(g).alias(name) for name, make in parts.items()))
            at = lambda z, i: F.get(z, F.lit(i) if isinstance(i, int) else i)
            rows = F.transform(zipped, lambda z: F.struct(*(z["g"][f].alias(f) for f in ("start", "end", "text", "gap")), z["glue"].alias("glue"), z["sum"].alias("sum"), at(c, z["card"].cast("int")).alias("card"), z["dot"].cast("int").alias("dot")))
            return let(dotted, lambda d: F.transform(rows, lambda r: F.struct(*(r[f].alias(f) for f in ("start", "end", "text", "gap", "glue", "sum", "card")), F.coalesce(at(d, r["dot"]), F.lit(False)).alias("ip"))))

        return let(let(groups, told), windows)

    def windows(g: Column) -> Column:
        n = F.size(g)
        first, last = lambda i: F.get(g, i), lambda i, k: F.get(g, i + k - 1)
        digits = lambda i, k: last(i, k)["sum"] - first(i)["sum"] + F.length(first(i)["text"])
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.length(first(i)["text"]) >= 7) | (F.coalesce(first(i + 1)["glue"], F.lit(-1)) == first(i)["glue"]))
        fits = lambda i, k: (i + k <= n) & (last(i, k)["glue"] == first(i)["glue"]) & (digits(i, k).between(7, 19) | ((k == 4) & digits(i, k).between(4, 12)))
        pick = lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(MOST_GROUPS)), lambda k: F.coalesce(fits(i, k), F.lit(False))), lambda k: told(i, k))

        def told(i: Column, k: Column) -> Column:
            rows = F.slice(g, i + 1, k)
            before = F.when(i == 0, chain["gap"]).otherwise(first(i)["gap"])
            inner = F.array_join(F.transform(F.slice(g, i + 2, k - 1), lambda r: r["gap"]), "")
            letter = r"[\p{L}_@]"
            touch = _flag((i == 0) & chain["gap"].rlike(letter + "$")) + 2 * _flag((i + k == n) & chain["after"].rlike(letter))
            word = F.lit(0)
            for number, pattern in _WORDS.items():
                word = F.when(F.lower(before).rlike(pattern), number).otherwise(word)
            facts = F.struct(
                digits(i, k).cast("int").alias("digits"), k.alias("groups"), _flag(before.endswith("+")).alias("plus"), _flag(before.endswith("(") | F.contains(inner, F.lit("("))).alias("paren"),
                F.when(inner == "", 0).when(inner.rlike("^ +$"), 1).when(inner.rlike("^-+$"), 2).when(inner.rlike(r"^\.+$"), 3).otherwise(4).alias("separator"),
                F.least(F.length(last(i, k)["text"]), F.lit(5)).alias("last"), _flag(luhn(F.array_join(F.transform(rows, lambda r: r["text"]), ""))).alias("luhn"),
                _flag((k == 4) & F.array_join(F.transform(rows, lambda r: r["text"]), ".").rlike(_OCTETS)).alias("octets"), touch.alias("touch"), word.alias("word"),
                (offset + first(i)["start"]).alias("start"), (offset + last(i, k)["end"]).alias("end"), F.exists(rows, lambda r: r["card"]["ok"] | r["ip"]).alias("over"), first(i)["card"].alias("run"), (k == n).alias("all"), first(i)["ip"].alias("ip"),
            )
            return let(facts, named)

        def named(f: Column) -> Column:
            # What the kind's own rule says: whether the span equals an accepted match, or one that failed.
            same_run = (f["run"]["start"] == f["start"]) & (f["run"]["end"] == f["end"])
            rules = {
                "card": (f["digits"].between(12, 19), same_run & f["run"]["ok"], same_run & ~f["run"]["ok"], f["start"]),
                "phone": (f["digits"].between(7, 15), phone_ok & f["all"], plus & f["all"] & ~phone_ok, f["start"] - F.when(f["plus"] == 1, 1).otherwise(0)),
                "ip": ((f["groups"] == 4) & (f["separator"] == 3), (f["octets"] == 1) & f["ip"], f["octets"] == 0, f["start"]),
            }
            out = []
            for kind, (fits, equal, failed, start) in rules.items():
                poor = failed | (f["touch"] > 0) | ((f["digits"] < 9) & F.lit(kind != "ip"))
                label = F.when(equal, 1).when(f["over"] | phone_ok, -1).when(poor, 0).cast("int")
                out.append(F.when(fits, F.struct(F.lit(kind).alias("kind"), start.alias("start"), f["end"].alias("end"), label.alias("label"), *(f[x].cast("int").alias(x) for x in FEATURES))))
            return F.array(*out)

        return F.filter(F.flatten(F.flatten(F.transform(starts, pick))), lambda x: x.isNotNull()).cast(f"array<{_CAND}>")

    return let(cards, spans)


def _addresses(text: Column) -> Column:
    """Candidates of kind email. digits counts the domain's dots, last its last label's letters (5 at most), separator tells spelled ones."""

    def told(m: Column, spelled: int) -> Column:
        plain = F.regexp_replace(F.regexp_replace(m["text"], r" ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?", "@"), r" ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?", ".") if spelled else m["text"]
        word = F.lit(0)
        for number, pattern in _WORDS.items():
            word = F.when(F.lower(m["gap"]).rlike(pattern), number).otherwise(word)

        def facts(p: Column) -> Column:
            domain = F.element_at(F.split(p, "@"), -1)
            top = F.regexp_extract(domain, r"\.([A-Za-z]+)$", 1)
            label = F.when(F.lit(spelled == 1), None).when(p.rlike(f"^{_ONE_EMAIL}$"), 1).when(p.rlike(_ONE_EMAIL), -1).when(F.length(top) < 2, 0).cast("int")
            values = {"digits": F.least(F.length(domain) - F.length(F.replace(domain, F.lit("."))), F.lit(5)), "separator": F.lit(spelled), "last": F.least(F.length(top), F.lit(5)), "touch": _flag(p.rlike(r"[^\x00-\x7F]")), "plus": _flag(p.rlike(r"[.\-_/?!*|]$")), "word": word}
            return F.struct(F.lit("email").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), label.alias("label"), *(values.get(x, F.lit(0)).cast("int").alias(x) for x in FEATURES))

        return let(plain, facts)

    at = F.when(F.contains(text, F.lit("@")), F.transform(matches(text, _TOKEN), lambda m: told(m, 0))).otherwise(_no(_CAND))
    spelled = F.when(text.rlike(r"\(dot\)|\[dot\]| dot "), F.transform(matches(text, _SPELLED), lambda m: told(m, 1))).otherwise(_no(_CAND))
    return F.concat(at.cast(f"array<{_CAND}>"), spelled.cast(f"array<{_CAND}>"))


def scanned(df: DataFrame, text_col: str, keep: list[str], base: str, found: str, fold: str) -> DataFrame:
    """keep, the fixed spans (base), the candidates (found), and whether a document is held out (fold)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"_c{i}" for i in range(len(keep))]  # columns of df may have any names, so that none can clash
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), text.alias("_text"))
    long_enough = lambda c: (F.length(F.translate(c["text"], " ().-", "")) >= 7) | c["text"].rlike(_QUAD)
    chains = F.filter(matches(F.col("_text"), _CHAIN), long_enough)
    per_chain = F.when(F.col("_text").rlike("[0-9]"), F.transform(chains, _numbers)).otherwise(_no(f"struct<base:array<{_SPAN}>,found:array<{_CAND}>>"))
    emails = F.when(F.contains("_text", F.lit("@")), F.transform(matches(F.col("_text"), _EMAIL), lambda m: _span("email", m["start"], m["end"]))).otherwise(_no(_SPAN))
    both = let(per_chain, lambda p: F.struct(F.flatten(F.transform(p, lambda x: x["base"])).alias("base"), F.flatten(F.transform(p, lambda x: x["found"])).alias("found")))
    rows = rows.select(*names, both.alias("_both"), emails.alias("_emails"), _addresses(F.col("_text")).alias("_addresses"), (F.pmod(F.xxhash64("_text"), F.lit(5)) == 0).alias("_fold"))
    kept = [F.col(n).alias(c) for c, n in zip(keep, names, strict=True)]
    return rows.select(*kept, F.concat("_emails", "_both.base").alias(base), F.concat("_addresses", "_both.found").alias(found), F.col("_fold").alias(fold))


Tree = tuple  # (feature, bound, tree for values up to the bound, tree for larger ones), or (score,)


def _grown(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Tree:
    """A regression tree on gradients: the best split of each node, until the depth is reached or nothing is won."""
    g, h = grad.sum(), hess.sum()
    leaf = (float(-RATE * g / (h + 1)),)
    if depth == 0:
        return leaf
    best, at = 1e-9, None
    for f in range(x.shape[1]):
        for bound in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= bound
            gl, hl = grad[low].sum(), hess[low].sum()
            if min(hl, h - hl) * 4 < LEAST_LEAF:
                continue
            won = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if won > best * (1 + 1e-9):  # of equal splits the first stays
                best, at = won, (f, int(bound))
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return (*at, _grown(x[low], grad[low], hess[low], depth - 1), _grown(x[~low], grad[~low], hess[~low], depth - 1))


def _predicted(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _predicted(tree[2], x), _predicted(tree[3], x))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Tree]:
    """Newton boosting of the logistic loss on weighted rows."""
    share = (y * weight).sum() / weight.sum()
    trees: list[Tree] = [(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))),)]
    score = _predicted(trees[0], x)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grown(x, (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight, DEPTH)
        trees.append(tree)
        score += _predicted(tree, x)
    return trees


def calibrated(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The least score from which on a share of LEAST_PRECISION is positive; None if there is none, or nothing positive."""
    found = None
    for bound in sorted(set(score.tolist()), reverse=True):
        taken = score >= bound
        right, all_ = (y * weight)[taken].sum(), weight[taken].sum()
        if right and right >= LEAST_PRECISION * all_:
            found = bound
    return found


def fit(counts: list[tuple]) -> dict[str, tuple[list[Tree], float]]:
    """Trees and threshold of each kind. counts: kind, held out, label, the features, and the number of candidates."""
    model = {}
    for kind in KINDS:
        rows = [r for r in counts if r[0] == kind]
        train, held = ([r for r in rows if bool(r[1]) == out] for out in (False, True))
        if not any(r[2] == 1 for r in train):
            continue
        table = lambda part: (np.array([r[3:-1] for r in part], dtype=np.int64), np.array([r[2] == 1 for r in part], dtype=float), np.array([r[-1] for r in part], dtype=float))
        x, y, weight = table(sorted(train))
        trees = fit_trees(x, y, weight)
        # What meets an accepted span is never added, so thresholds are set without it.
        judged = table(sorted(r for r in (held if any(r[2] == 1 for r in held) else train) if r[2] >= 0))
        bound = calibrated(sum(_predicted(t, judged[0]) for t in trees), *judged[1:])
        if bound is not None:
            model[kind] = (trees, bound - 1e-9)
    return model


def _scored(trees: list[Tree], c: Column) -> Column:
    def one(tree: Tree) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        return F.when(c[FEATURES[tree[0]]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    return sum((one(t) for t in trees[1:]), F.lit(trees[0][0]))


def fit_pii(rows: DataFrame, found: str, fold: str) -> dict[str, tuple[list[Tree], float]]:
    """Fits on the labelled candidates of all rows, counted by equal features."""
    each = rows.select(F.col(fold).alias("fold"), F.explode(found).alias("c")).select("fold", "c.*").where("label is not null")
    counts = each.groupBy("kind", "fold", "label", *FEATURES).count()
    return fit([(r.kind, r.fold, r.label, *(r[f] for f in FEATURES), r["count"]) for r in counts.collect()])  # a row per class of equal features


def pii_spans(df: DataFrame, text_col: str = "text", out_col: str = "pii", keep: list[str] | None = None, model: dict | None = None) -> DataFrame:
    """Adds out_col: spans as structs of kind, start, end and fixed, by kind, then start. keep: the columns that stay, all unless given.
    model: that of fit_pii(), fitted on df itself unless given."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out_col]
    base, found, fold = fresh(df, "base"), fresh(df, "found"), fresh(df, "fold")
    with deep_lambdas(df.sparkSession):
        rows = scanned(df, text_col, keep, base, found, fold)
        if model is None:
            rows = stored(rows, "pii")
            model = fit_pii(rows, found, fold)
        return _listed(rows, keep, base, found, out_col, model)


def _listed(rows: DataFrame, keep: list[str], base: str, found: str, out_col: str, model: dict) -> DataFrame:
    spans = F.transform(base, lambda s: F.struct(_order(s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(True).alias("fixed")))
    added = _chosen(F.col(found), F.col(base), model)
    if added is not None:
        spans = F.concat(spans, F.transform(added, lambda s: F.struct(_order(s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(False).alias("fixed"))))
    listed = F.transform(F.array_sort(spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["fixed"].alias("fixed")))
    return rows.select(*(F.col(f"`{c}`") for c in keep), listed.alias(out_col))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _chosen(found: Column, base: Column, model: dict) -> Column | None:
    """Candidates above their kind's threshold that meet no fixed span, nor a better one of their own."""
    if not model:
        return None

    def margin(c: Column) -> Column:
        out = F.lit(None).cast("double")
        for kind, (trees, bound) in model.items():
            out = F.when(c["kind"] == kind, _scored(trees, c) - bound).otherwise(out)
        return out

    unknown = F.filter(found, lambda c: c["label"].isNull())
    scored = F.transform(unknown, lambda c: F.struct(margin(c).alias("margin"), (c["end"] - c["start"]).alias("size"), (-c["start"]).alias("at"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    passed = F.filter(scored, lambda c: c["margin"] >= 0)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda p: F.filter(p, lambda c: ~F.exists(base, lambda b: meets(b, c)))
    best = lambda p: F.filter(p, lambda c: ~F.exists(p, lambda d: meets(d, c) & (F.struct(d["margin"], d["size"], d["at"], d["kind"]) > F.struct(c["margin"], c["size"], c["at"], c["kind"]))))
    return let(passed, lambda p: let(free(p), best))
