"""Queries of the fault-localization engine over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import counts, extractors, ledger, ranking, sequence, threads, vectors, weights
from ..schema import EVENT_CODES
from ..shared import scratch_path, stored
from ..sources import binary_log, container, csv_log, files, log_format, mapping, reports, testdata
from ..streaming import live
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VARIANT = {kind: variant for kind, (variant, _, _) in sql.OBSERVATIONS.items()}
FLOW = ("LINE", "BRANCH", "CONDITION", "LENGTH")


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        known = name or function.__name__
        QUERIES[known] = function
        if oracle:
            ORACLES[known] = oracle
        return function

    return add


def events_of(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The events that suit a kind of feature, and the runs."""
    if VARIANT[kind] == "docs":
        return testdata.document_trace(spark, sf_dir), testdata.document_runs(spark, sf_dir)
    return testdata.trace(spark, sf_dir, VARIANT[kind]), testdata.runs(spark, sf_dir)


def counts_of(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    events, runs = events_of(spark, sf_dir, kinds[0])
    return counts.contingency(extractors.extract(events, *kinds), runs)


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the gravest errors stand in for known faults."""
    rows = testdata.table(spark, sf_dir, "events").where("event_type = 'error'")
    most = rows.agg(F.max("value").alias("most"))
    k = testdata.number_of(F.col("props"))
    return rows.crossJoin(F.broadcast(most)).where("value >= 0.9 * most").select(F.concat(F.lit("f"), (k % 5).cast("string")).alias("file"), (k % 19 + 1).cast("int").alias("line")).distinct()


# Line localization, one query per coefficient.


@query(f"{sql.counted('LINE')} select file, line, ef, ep, {metrics.expression('Ochiai')} as score, rank() over (order by {metrics.expression('Ochiai')} desc) as place from counts")
def line_ochiai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ranked by Ochiai. The rank comes from the running count of equal scores, not from one sorted partition."""
    scored = counts_of(spark, sf_dir, "LINE").select("file", "line", "ef", "ep", metrics.metric("Ochiai").alias("score"))
    ranked = ranking.ranks(scored)
    return ranked.select("file", "line", "ef", "ep", "score", (F.col("effort") - F.col("tied") + 1).alias("place"))


def _metric_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts_of(spark, sf_dir, "LINE").select("file", "line", metrics.metric(name).alias("score"))

    return run


for _name in metrics.FORMULAS:
    query(f"{sql.counted('LINE')} select file, line, {metrics.expression(_name)} as score from counts", f"metric_{_name.lower()}")(_metric_query(_name))


@query(f"with {sql.ORDER_RUNS}, {sql.ORDER_OBS}, {sql.COUNTS} select file, line, ef, ep, nf, np, {metrics.expression('Tarantula')} as tarantula, {metrics.expression('DStar')} as dstar from counts")
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, their items by flags and number as lines."""
    observed = extractors.lines(testdata.order_trace(spark, sf_dir))
    made = counts.contingency(observed, testdata.order_runs(spark, sf_dir))
    return made.select("file", "line", "ef", "ep", "nf", "np", metrics.metric("Tarantula").alias("tarantula"), metrics.metric("DStar").alias("dstar"))


# The seventeen kinds of features.


def _kind_query(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts.scored(counts_of(spark, sf_dir, kind)).select("feature", "file", "line", "ef", "nf", "ep", "np", "fr", "fi", "score")

    return run


for _name in extractors.EXTRACTORS:
    query(f"{sql.counted(_name)} select feature, file, line, ef, nf, ep, np, fr, fi, {sql.DEFAULT_SCORE} as score from counts", f"feature_{_name.lower()}")(_kind_query(_name))


@query(f"{sql.counted('BRANCH', 'CONDITION')} select feature, " + ", ".join(f"{metrics.expression(n)} as {n.lower()}" for n in metrics.PREDICATE_FORMULAS) + " from counts")
def predicate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fail, context and increase of both sides of every branch and condition."""
    made = counts_of(spark, sf_dir, "BRANCH", "CONDITION")
    return made.select("feature", *(metrics.metric(n).alias(n.lower()) for n in metrics.PREDICATE_FORMULAS))


# Sequences.


@query(f"with {sql.trace('scopes')}, {sql.SCOPES} select run_id, seq, depth, scope_id from sc")
def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.with_scopes(testdata.trace(spark, sf_dir, "scopes")).select("run_id", "seq", "depth", "scope_id")


@query(f"with {sql.trace('scopes')}, {sql.DEF_USE} select run_id, seq, var, scope_id, def_seq, def_file, def_line from duu")
def def_use_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.def_use(testdata.trace(spark, sf_dir, "scopes")).select("run_id", "seq", "var", "scope_id", "def_seq", "def_file", "def_line")


@query(f"with recursive {sql.trace('loops')}, {sql.LOOPS} select run_id, file, line, loop_id, seq, iterations from le")
def loop_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.loop_counts(testdata.trace(spark, sf_dir, "loops")).select("run_id", "file", "line", "loop_id", "seq", "iterations")


@query(f"with {sql.trace('scopes')}, {sql.VISIBLE} select run_id, seq, var, other_var, other_value_num from visible")
def visible_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.visible_variables(testdata.trace(spark, sf_dir, "scopes")).select("run_id", "seq", "var", "other_var", "other_value_num")


@query(f"with {sql.trace('scopes')}, {sql.VISIBLE} select i.run_id, i.scope_id, o.scope_id as ancestor_id, i.scope_depth - o.scope_depth as distance from lives i join lives o on o.run_id = i.run_id and o.opened <= i.opened and i.opened < o.closed and (o.scope_depth < i.scope_depth or o.scope_id = i.scope_id)")
def scope_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.scope_ancestors(testdata.trace(spark, sf_dir, "scopes")).select("run_id", "scope_id", "ancestor_id", "distance")


_SEGMENTS = f"""{sql.trace('tests')}, {sql.RUNS}, g1 as (
  select *, starts_with(event_type, 'TEST_') as test, case when starts_with(event_type, 'TEST_') then file || ':' || line end as place from tr
), g2 as (
  select *, last_value(place ignore nulls) over (partition by run_id order by seq rows between unbounded preceding and 1 preceding) as before from g1
), g3 as (
  select *, test and before is not null and (event_type = 'TEST_END' or place <> before) as cut from g2
), seg as (
  select *, cast(sum(cut::integer) over (partition by run_id order by seq rows unbounded preceding) as integer) as segment from g3
), mk as (
  select run_id, max(segment) as last, min(seq) filter (event_type = 'TEST_START') as start_seq, min(segment) filter (event_type = 'TEST_START') as start,
    max(seq) filter (event_type = 'TEST_END') as end_seq, max(segment) filter (event_type = 'TEST_END') as fin, max(segment) filter (event_type = 'TEST_END' and cut) - 1 as closest
  from seg group by run_id having bool_or(test)
), parts as (
  select distinct run_id, segment, last, closest, case when case when fin is null then segment >= coalesce(start, 0) else segment >= case when start_seq < end_seq then start else 0 end and segment < fin end then 1.0 else 0.5 end as base
  from seg join mk using (run_id)
)"""


@query(f"with {_SEGMENTS} select run_id, segment, count(*) as n_events, min(seq) as first_seq from seg group by all")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequence.segments(testdata.trace(spark, sf_dir, "tests"))
    return made.groupBy("run_id", "segment").agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"))


# Coverage, suggestions, statistics, ranks and their evaluation.

_FLOW = sql.counted(*FLOW)
_SCORED = f"{_FLOW}, {sql.PLACES.format(score=sql.DEFAULT_SCORE, by='type,')}"


@query(f"with {sql.observations(*FLOW)} select run_id, count(*) as n_features from (select distinct run_id, type, feature from obs) group by all")
def coverage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = events_of(spark, sf_dir, "LINE")
    return counts.coverage(extractors.extract(events, *FLOW))


@query(f"with {sql.observations(*FLOW)} select distinct type, feature, file, line from obs")
def coverage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = events_of(spark, sf_dir, "LINE")
    return counts.covered_places(extractors.extract(events, *FLOW))


@query(f"with {sql.observations(*FLOW)} select run_id, feature, max(truth) as hit, cast(sum(truth) as bigint) as hits, count(*) as seen, arg_max(truth, seq) as last from obs group by run_id, type, feature, file, line, file2, line2")
def run_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each run evaluated a feature, how often it held, and whether it did the last time."""
    events, _ = events_of(spark, sf_dir, "LINE")
    return counts.run_hits(extractors.extract(events, *FLOW)).select("run_id", "feature", "hit", "hits", "seen", "last")


_SWITCHED = """select distinct feature from obs where (type = 'BRANCH' and truth = 1) or (type = 'LENGTH' and not ends_with(feature, ':0')) or type = 'LINE'"""


@query(f"with {sql.observations('LINE', 'BRANCH', 'LENGTH')} {_SWITCHED} order by 1")
def switched_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the sides of branches that aren't taken, and the class of empty lengths, switched off."""
    events, _ = events_of(spark, sf_dir, "LINE")
    return extractors.extract(events, "LINE", "BRANCH", "LENGTH", else_side=False, classes=("1", "more")).select("feature").distinct()


@query(f"with {sql.observations('VARIABLE', 'RETURN')} select feature, count(*) as n, cast(sum(truth) as bigint) as hits from obs where feature like '%:<:%' or feature like '%:<' or feature like '%:==:%' or feature like '%:==' group by feature")
def switched_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values compared by two of the six comparators."""
    events, _ = events_of(spark, sf_dir, "VARIABLE")
    made = extractors.extract(events, "VARIABLE", "RETURN", comparators=("<", "=="))
    return made.groupBy("feature").agg(F.count("*").alias("n"), F.sum("truth").alias("hits"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.scored(counts_of(spark, sf_dir, *FLOW))


@query(f"{_SCORED} select distinct type, score, file || ':' || line as place from pl")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.suggestions(_scores(spark, sf_dir), "type")


@query(f"""{_FLOW}, sc as (select type, unnest(['Ochiai', 'Tarantula']) as metric, unnest([{metrics.expression('Ochiai')}, {metrics.expression('Tarantula')}]) as score, file || ':' || line as place from counts
), per as (select type, metric, score, string_agg(distinct place, ',' order by place) as places from sc group by all)
select type, metric, string_agg(places, ';' order by score desc) as places, count(*) as n from per group by all""")
def suggestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every kind, read back: for each metric its places, best first."""
    scored = counts.scored_long(counts_of(spark, sf_dir, *FLOW), "Ochiai", "Tarantula")
    made = reports.report(ranking.listed(ranking.suggestions(scored, "type", "metric"), "type", "metric"))
    back = made.select("type", F.explode(F.from_json("report", "map<string, array<struct<locations: array<string>, suspiciousness: double>>>")).alias("metric", "list"))
    return back.select("type", "metric", F.array_join(F.transform("list", lambda s: F.array_join(s["locations"], ",")), ";").alias("places"), F.size("list").cast("long").alias("n"))


@query(f"""{_SCORED}, o as (select type, score, row_number() over (partition by type order by score) as n, count(*) over (partition by type) as k from scores)
select type, count(*) as n, min(score) as least, max(score) as most, round(avg(score), 9) as mean, max(case when n = k // 2 + 1 then score end) as median from o group by type""")
def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_statistics(_scores(spark, sf_dir), "type")


_RANKED = f"{_SCORED}, {sql.PLACE_SCORES.format(by='type,')}, {sql.RANKED.format(by='type,', part='partition by type', keys='type, ')}, {sql.FAULTY}"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranks(ranking.place_scores(_scores(spark, sf_dir), "type"), "type")


@query(f"{_RANKED} select type, file, line, score, rank, effort from ranked")
def rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("type", "file", "line", "score", "rank", "effort")


@query(f"""{_RANKED}, lf(n, v) as (select i, sum(case when i > 0 then ln(i) else 0 end) over (order by i) from range(100000) t(i)
), pool as (select type, count(*) as pool, count(b.file) as found, least(10, count(*)) as drawn from ranked r left join faulty b using (file, line) where effort - tied < 10 group by type
), nf as (select count(*) as n_faulty from faulty
), ch as (
  select type, x, exp((select v from lf where n = found) - (select v from lf where n = x) - (select v from lf where n = found - x) + (select v from lf where n = pool - found) - (select v from lf where n = drawn - x) - (select v from lf where n = pool - found - drawn + x)
    - (select v from lf where n = pool) + (select v from lf where n = drawn) + (select v from lf where n = pool - drawn)) as chance
  from pool, range(11) t(x) where x <= found and x <= drawn and drawn - x <= pool - found
)
select type, pool, found, round(found / pool, 9) as share, round(1 - coalesce((select chance from ch where ch.type = pool.type and x = 0), 0), 9) as best,
  round(coalesce(drawn * found / pool / nullif(n_faulty, 0), 0), 9) as worst, round(coalesce((select sum(chance * least(2.0 * x / n_faulty, 1)) from ch where ch.type = pool.type), 0), 9) as average
from pool, nf""")
def top_n_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_n_expected(_ranked(spark, sf_dir), faulty(spark, sf_dir), 10, "type")


@query(f"""{_RANKED}, sz as (select type, count(*) as n_places from ranked group by type
), j as (
  select sz.type, n_places, coalesce(rank, n_places) / n_places as exam, cast(coalesce(effort, n_places) as double) as effort from sz cross join faulty left join ranked on ranked.type = sz.type and ranked.file = faulty.file and ranked.line = faulty.line
)
select type, n_places, """ + ", ".join(f"round(min({c}), 9) as {c}_best, round(max({c}), 9) as {c}_worst, round(list_sort(list({c}))[greatest(len(list({c})) // 2 - 1, 0) + 1], 9) as {c}_middle, round(avg({c}), 9) as {c}_mean" for c in ("exam", "effort")) + " from j group by type, n_places")
def fault_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fault_ranks(_ranked(spark, sf_dir), faulty(spark, sf_dir), "type")


@query(f"{_SCORED} select type, file, line, round(avg(score), 9) as score from (select type, feature, file, line, score from pl) group by all")
def mean_place_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.place_scores(_scores(spark, sf_dir), "type", how="avg")


def _precision(k: int) -> None:
    @query(f"""{_RANKED}, tk as (select *, max(score) over (partition by type) as best from ranked)
select type, count(*) as taken, count(b.file) as hits, round(count(b.file) / count(*), 9) as "precision", round(coalesce(count(b.file) / nullif((select count(*) from faulty), 0), 0), 9) as recall
from tk left join faulty b using (file, line) where effort - tied < {k} or score = best group by type""", f"precision_at_{k}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranking.precision_at(_ranked(spark, sf_dir), faulty(spark, sf_dir), k, "type")


for _k in (1, 3, 5, 10):
    _precision(_k)


@query(f"""{_FLOW} select type, metric, round(avg(score), 9) as mean, max(score) as most from (
  select type, unnest(['Ochiai', 'Tarantula', 'Jaccard']) as metric, unnest([{', '.join(metrics.expression(n) for n in ('Ochiai', 'Tarantula', 'Jaccard'))}]) as score from counts) group by rollup(type, metric)""")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by kind and metric, with their sums over metrics and kinds."""
    made = counts.scored_long(counts_of(spark, sf_dir, *FLOW), "Ochiai", "Tarantula", "Jaccard")
    return made.rollup("type", "metric").agg(F.round(F.avg("score"), 9).alias("mean"), F.max("score").alias("most"))


# Feature vectors.

_ORDER = "list_position([" + ", ".join(f"'{k}'" for k in extractors.EXTRACTORS) + "], type)"
_VALUES = f"vals as (select run_id, feature, type, arg_min(truth, {{'seq': seq, 'o': {_ORDER}, 't': 1 - truth}}) as value from obs group by all)"
_FILL = "case when type in ('BRANCH', 'CONDITION') then -1 else 0 end"


_PRINTED = """concat_ws(':', type, file, line) as start, substr(feature, length(concat_ws(':', type, file, line)) + 2) as rest"""
_PRINT_RULES = """case when type in ('LINE', 'LOOP') then start when type = 'CONDITION' then start || ':' || regexp_replace(rest, ':(is|not)$', '')
  when type = 'BRANCH' then start || ':' || split_part(rest, ':', 2) || ':' || split_part(rest, ':', 1)
  when type = 'LENGTH' then start || ':' || split_part(rest, ':', 1) || ':evaluate_length_' || split_part(rest, ':', 2) end"""


@query(f"""with {sql.observations(*FLOW)}, n as (select *, {_PRINTED} from obs), m as (select *, {_PRINT_RULES} as name from n)
select run_id, name, arg_min(truth, {{'seq': seq, 'o': {_ORDER}, 'later': case when type = 'CONDITION' then cast(ends_with(feature, ':is') as integer) else 0 end, 't': 1 - truth}}) as value from m group by run_id, name, type""")
def printed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature values by printed names, of which the first written stays."""
    events, _ = events_of(spark, sf_dir, "LINE")
    return vectors.printed_values(extractors.extract(events, *FLOW)).select("run_id", "name", "value")


@query(f"with recursive {sql.observations('LOOP')}, n as (select *, concat_ws(':', type, file, line) as name from obs) select run_id, name, arg_min(truth, {{{{'seq': seq, 'later': cast(not ends_with(feature, ':0') as integer), 't': 1 - truth}}}}) as value from n group by all".replace("{{", "{").replace("}}", "}"))
def printed_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = events_of(spark, sf_dir, "LOOP")
    return vectors.printed_values(extractors.extract(events, "LOOP")).select("run_id", "name", "value")


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events, runs = events_of(spark, sf_dir, "LINE")
    return vectors.feature_values(extractors.extract(events, *FLOW)), runs


@query(f"with {sql.observations(*FLOW)}, {_VALUES} select run_id, feature, value from vals")
def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir)[0].select("run_id", "feature", "value")


@query(f"with {sql.observations('LINE', 'CONDITION')}, {_VALUES}, f as (select distinct feature, type from vals) select r.run_id, f.feature, coalesce(v.value, case when f.type = 'CONDITION' then -1 else 0 end) as value from runs r cross join f left join vals v on v.run_id = r.run_id and v.feature = f.feature")
def complete_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, runs = events_of(spark, sf_dir, "LINE")
    values = vectors.feature_values(extractors.extract(events, "LINE", "CONDITION"))
    return vectors.complete(values, runs).select("run_id", "feature", "value")


_CELLS = f"""{sql.observations(*FLOW)}, {_VALUES}, fs as (select distinct feature, type from vals
), cells as (select r.run_id, cast(r.failing as integer) as failing, 'run ' || r.run_id as test, 'all' as label, fs.feature, coalesce(value, {_FILL.replace('type', 'fs.type')}) as value from runs r cross join fs left join vals v on v.run_id = r.run_id and v.feature = fs.feature)"""


@query(f"with {_CELLS} select run_id, failing, test, label, feature, value from cells")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by all features that any run observed, in tables of so many columns as Spark plans, read back as rows."""
    values, runs = _values(spark, sf_dir)
    values = stored(values, "feature-values")
    named = runs.withColumn("test", F.concat(F.lit("run "), F.col("run_id").cast("string")))
    out = None
    for wide in vectors.matrices(values, named, label="all", most=500):
        rows = wide.unpivot(["run_id", "failing", "test", "label"], None, "feature", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {_CELLS} select run_id, feature, value from cells")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as words of 32 features, unpacked again for every run and feature."""
    values, runs = _values(spark, sf_dir)
    words, dictionary = vectors.packed(values)
    return vectors.unpacked(words, dictionary, runs).select("run_id", "feature", "value")


@query(f"with {sql.observations(*FLOW)}, {_VALUES} select run_id, feature, value from vals where run_id not in (select run_id from runs where failing)")
def vectors_without_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that are left when the failing runs are removed."""
    values, runs = _values(spark, sf_dir)
    return vectors.without_runs(values, runs.where("failing")).select("run_id", "feature", "value")


@query(f"with {sql.observations(*FLOW)}, {_VALUES}, fl as (select failing, feature, any_value(type) as type, max(value) as value from vals join runs using (run_id) group by all), a as (select * from fl where failing), b as (select * from fl where not failing) select feature, greatest(a.value, b.value) as either, case when a.value = -1 then -1 else 1 - a.value end as negated from a join b using (feature)")
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing and passing runs' vectors: one or the other, and the failing one negated."""
    values, runs = _values(spark, sf_dir)
    both = vectors.merged(values.join(runs, "run_id"), "failing")
    side = lambda failing, name: both.where(F.col("failing") == failing).select("feature", F.col("value").alias(name))
    return side(True, "a").join(side(False, "b"), "feature").select("feature", vectors.either(F.col("a"), F.col("b")).alias("either"), vectors.negated(F.col("a")).alias("negated"))


@query(f"""with {sql.observations(*FLOW)}, {_VALUES}, nx as (select run_id as a, lead(run_id) over (order by run_id) as b from runs
), pr as (select * from nx where b is not null), l as (select a, b, feature, type, value from pr join vals on run_id = a), r as (select a, b, feature, type, value from pr join vals on run_id = b)
select a, b, cast(sum(cast(coalesce(l.value, {_FILL}) <> coalesce(r.value, {_FILL}) as integer)) as bigint) as difference from l full join r using (a, b, feature, type) group by a, b""")
def vector_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the one with the next id, by the words of their packed vectors."""
    values, runs = _values(spark, sf_dir)
    words, _ = vectors.packed(values)
    return vectors.packed_differences(words, vectors.next_runs(runs))


# Proximity weights.

_LINE_WEIGHTS = """ld as (
  select *, case when closest is null then last - segment when segment < closest then closest - 1 - segment else segment - closest + 1 end as distance from parts
), sw as (select run_id, segment, distance, base * (1 - distance / (max(distance) over (partition by run_id) + 1)) as weight from ld)"""


def _def_use_weights(uses: bool) -> str:
    """Ways back along definitions and uses, by recursion; the shortest is the distance."""
    return f"""u0 as (
  select run_id, var, var_id, segment, bool_or(event_type = 'TEST_DEF') as defines, bool_or(event_type = 'TEST_USE') as used from seg where event_type in ('TEST_DEF', 'TEST_USE') group by all
), u1 as (
  select *, bool_or(defines) over (partition by run_id, var, var_id order by segment rows unbounded preceding) as known from u0
), u2 as (
  select *, last_value(case when {'known' if uses else 'defines'} then segment end ignore nulls) over (partition by run_id, var, var_id order by segment rows between unbounded preceding and 1 preceding) as source from u1
), back as (select distinct run_id, segment, source from u2 where used and not defines and source is not null), way as (
  select run_id, segment, last - segment as distance from parts union select w.run_id, source, distance + 1 from way w join back using (run_id, segment)
), ld as (
  select run_id, segment, base, min(distance) as distance from parts join way using (run_id, segment) group by all
), sw as (select run_id, segment, distance, base * (1 - distance / (max(distance) over (partition by run_id) + 1)) as weight from ld)"""


def _assert_weights(uses: bool) -> str:
    """The second visit as a recursion over its steps, which carries the distances of a run's segments as a list."""
    first, last = _def_use_weights(uses).split("), sw as (")
    return f"""{first}), al as (
  select distinct run_id, file, line from seg where event_type = 'TEST_ASSERT'
), an as (
  select distinct run_id, segment from seg join al using (run_id, file, line) where starts_with(event_type, 'TEST_')
), op as (
  select run_id, segment, distance as near, -1 as seq, cast(null as integer) as origin, an.segment is not null as asserts from ld left join an using (run_id, segment)
  union all select s.run_id, s.segment, ld.distance, s.seq, case when u.defines then u.segment else u.source end, false
  from seg s join u2 u on u.run_id = s.run_id and u.segment = s.segment and u.var = s.var and u.var_id = s.var_id join ld on ld.run_id = s.run_id and ld.segment = s.segment
  where s.event_type = 'TEST_USE' and (u.defines or u.source is not null)
), os as (
  select *, row_number() over (partition by run_id order by near, segment, seq) as n from op
), vi as (
  select run_id, cast(0 as bigint) as n, list(cast(distance as bigint) order by segment) as d, list(cast(0 as bigint) order by segment) as c from ld group by run_id
  union all
  select vi.run_id, os.n,
    case when origin is null then case when asserts and d[segment + 1] > 0 then d[1:segment] || [d[segment + 1] + 1] || d[segment + 2:] else d end
      else d[1:origin] || [least(d[origin + 1], d[segment + 1] + 1) + c[segment + 1]] || d[origin + 2:] end,
    case when origin is null then case when asserts and d[segment + 1] > 0 then c[1:segment] || [1::bigint] || c[segment + 2:] else c end
      else c[1:origin] || [greatest(c[origin + 1], c[segment + 1])] || c[origin + 2:] end
  from vi join os on os.run_id = vi.run_id and os.n = vi.n + 1
), le as (
  select run_id, arg_max(d, n) as d from vi group by run_id
), la as (
  select ld.run_id, ld.segment, ld.base, le.d[ld.segment + 1] as distance from ld join le using (run_id)
), sw as ({last.replace('from ld', 'from la')}"""


def _proximity_sql(segment_weights: str) -> str:
    return f"""with recursive {_SEGMENTS}, {segment_weights}, obs as ({sql.OBSERVATIONS['LINE'][2]}), {sql.COUNTS},
fw as (select feature, o.run_id, max(weight) as weight from obs o join seg using (run_id, seq) join runs r on r.run_id = o.run_id and failing join sw on sw.run_id = o.run_id and sw.segment = seg.segment group by all
), w as (select feature, avg(weight) as weight from fw group by all)
select c.file, c.line, round(coalesce(weight, 0), 9) as weight, round({metrics.expression('Ochiai')} * coalesce(weight, 0), 9) as score from counts c left join w using (feature)"""


def _proximity(spark: SparkSession, sf_dir: str, segment_weights: Callable[[DataFrame], DataFrame]) -> DataFrame:
    events, runs = testdata.trace(spark, sf_dir, "tests"), testdata.runs(spark, sf_dir)
    observed = extractors.extract(events, "LINE")
    made = weights.feature_weights(weights.segment_features(events, observed), segment_weights(events), runs)
    scored = counts.weighted(counts.contingency(observed, runs), made)
    return scored.select("file", "line", F.round("weight", 9).alias("weight"), F.round(metrics.metric("Ochiai") * F.col("weight"), 9).alias("score"))


@query(f"with {_SEGMENTS}, {_LINE_WEIGHTS} select run_id, segment, distance, round(weight, 9) as weight from sw")
def line_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = weights.line_weights(testdata.trace(spark, sf_dir, "tests"))
    return made.select("run_id", "segment", "distance", F.round("weight", 9).alias("weight"))


@query(_proximity_sql("sw as (select run_id, segment, base as weight from parts)"))
def proximity_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, weights.function_weights)


@query(_proximity_sql(_LINE_WEIGHTS))
def proximity_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, weights.line_weights)


@query(_proximity_sql(_def_use_weights(False)))
def proximity_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, weights.def_use_weights)


@query(_proximity_sql(_def_use_weights(True)))
def proximity_def_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, lambda events: weights.def_use_weights(events, uses=True))


@query(_proximity_sql(_assert_weights(False)))
def proximity_assert_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, lambda events: weights.def_use_weights(events, asserts=True))


@query(_proximity_sql(_assert_weights(True)))
def proximity_assert_def_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, lambda events: weights.def_use_weights(events, uses=True, asserts=True))


@query(f"with recursive {_SEGMENTS}, {_assert_weights(True)} select run_id, segment, distance, round(weight, 9) as weight from sw")
def assert_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's distance and weight after both visits."""
    made = weights.def_use_weights(testdata.trace(spark, sf_dir, "tests"), uses=True, asserts=True)
    return made.select("run_id", "segment", F.col("distance").cast("long").alias("distance"), F.round("weight", 9).alias("weight"))


# Sources and sinks, in round trips.


@query(f"with {sql.trace('flow')} select run_id, seq, event_type, file, line, event_id, case when event_type = 'BRANCH' then then_id end as then_id from tr")
def source_csv_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as text logs, a file per run, and read back."""
    path = scratch_path(spark, "csv-logs")
    csv_log.write_csv_logs(testdata.trace(spark, sf_dir, "flow"), path)
    back = csv_log.read_csv_logs(spark, path, F.regexp_extract(F.col("_metadata.file_path"), r"run_id=(\d+)", 1).cast("long"))
    return back.select("run_id", "seq", "event_type", "file", "line", "event_id", "then_id")


_STATIC = ("event_id", "event_type", "file", "line", "function", "function_id", "var", "loop_id", "condition")
_CODE = "k * 100 + case event_type " + " ".join(f"when '{kind}' then {code}" for code, kind in EVENT_CODES.items()) + " end"


_HAS = "event_type in ('DEF', 'FUNCTION_EXIT')"
_TEXT = "case when k % 3 = 0 then '' else 'v' || k end"
_LOGGED = f"""select run_id, seq, {_CODE} as event_id, event_type, line, case when {_HAS} then case k % 5 when 0 then k / 4 when 1 then cast(k - 50 as double) end end as value_num,
  case when {_HAS} and k % 5 = 2 then {_TEXT} end as value_str, case when {_HAS} and k % 5 = 3 then {_TEXT} end as bytes,
  case when {_HAS} then ['float', 'int', 'str', 'bytes', 'NoneType'][k % 5 + 1] end as value_type, case when event_type in ('DEF', 'USE') then var_id end as var_id from tr"""
_LOG_COLUMNS = ("event_id", "event_type", "line", "value_num", "value_str", "cast(value_bin as string) as bytes", "value_type", "var_id")


@query(f"with {sql.trace('scopes')} {_LOGGED}")
def source_binary_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with values of every kind, encoded as binary logs and decoded by the mapping of the program's places."""
    events = testdata.program_place(testdata.valued(testdata.trace(spark, sf_dir, "scopes")))
    logs = stored(binary_log.encode_logs(events), "binary-logs")
    back = binary_log.decode_logs(logs, events.select(*_STATIC).distinct())
    return back.selectExpr("run_id", f"chunk * {binary_log.STRETCH} + seq as seq", *_LOG_COLUMNS)


@query(f"with {sql.trace('scopes')} select * from ({_LOGGED}) where event_type in ('DEF', 'FUNCTION_EXIT')")
def source_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary logs as files, read by format("event_log") with a filter that its reader takes over."""
    events = testdata.program_place(testdata.valued(testdata.trace(spark, sf_dir, "scopes")))
    path = scratch_path(spark, "event-logs")
    log_format.write_logs(binary_log.encode_logs(events).select(F.concat_ws(".", "run_id", "chunk").alias("name"), "content"), path)
    places = stored(events.select(*_STATIC).distinct(), "places")
    back = log_format.read_logs(spark, path, places).where(F.col("event_type").isin("DEF", "FUNCTION_EXIT"))
    named = back.join(F.broadcast(places.select("event_id", "line")), "event_id")  # a program's places
    part = lambda i: F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), i).cast("long")
    placed = named.withColumns({"run_id": part(-2), "seq": part(-1) * binary_log.STRETCH + F.col("seq")})
    return placed.selectExpr("run_id", "seq", *_LOG_COLUMNS)


@query(f"with {sql.trace('scopes')} select distinct {_CODE} as event_id, event_type, file, line, function, var from tr")
def mapping_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of the program's places, written and read back."""
    path = scratch_path(spark, "mapping")
    known = testdata.program_place(testdata.trace(spark, sf_dir, "scopes")).select(*_STATIC).distinct()
    mapping.write_mapping(known.withColumns({"then_id": F.lit(None).cast("long"), "else_id": F.lit(None).cast("long")}), path)
    return mapping.read_mapping(spark, path, lines=True).select("event_id", "event_type", "file", "line", "function", "var")


@query(f"with {sql.RUNS} select row_number() over (order by failing, 'run_id=' || run_id || '/') - 1 as number, run_id, failing from runs")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of passing and failing runs in two folders, found and numbered."""
    path = scratch_path(spark, "runs")
    events, runs = testdata.trace(spark, sf_dir, "flow"), testdata.runs(spark, sf_dir)
    for failing in (False, True):
        csv_log.write_csv_logs(events.join(runs.where(F.col("failing") == failing), "run_id", "left_semi"), f"{path}/{failing}")
    found = mapping.run_registry(spark, f"{path}/False", f"{path}/True")
    return found.select(F.col("run_id").alias("number"), F.regexp_extract("path", r"run_id=(\d+)\.", 1).cast("long").alias("run_id"), "failing")


_CASES = {"click": "", "view": "<system-out>seen</system-out>", "purchase": "<skipped/>", "signup": "<failure message='no'>trace</failure>", "error": "<error/><system-err>x</system-err>"}


@query("select 'u' || user_id || '::t' || event_id as test, case when event_type in ('signup', 'error') then 'FAILED' else 'PASSED' end as result from events where event_type <> 'purchase'")
def junit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as test cases of JUnit files: some with output, some skipped, some failed."""
    path = scratch_path(spark, "junit")
    inner = F.lit("")
    for kind, body in _CASES.items():
        inner = F.when(F.col("event_type") == kind, body).otherwise(inner)
    case = F.concat(F.lit("<testcase classname='u"), F.col("user_id").cast("string"), F.lit("' name='t"), F.col("event_id").cast("string"), F.lit("'>"), inner, F.lit("</testcase>"))
    cases = testdata.table(spark, sf_dir, "events").select("user_id", "event_id", case.alias("value"))
    ends = cases.select("user_id").distinct().select("user_id", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("event_id"), F.lit("<testsuite>").alias("value")), F.struct(F.lit(2**63 - 1).alias("event_id"), F.lit("</testsuite>").alias("value")))).alias("e")).select("user_id", "e.*")
    name = F.concat(F.lit("user_id="), F.col("user_id").cast("string"), F.lit(".xml"))
    files.write_texts(cases.unionByName(ends).select(name.alias("name"), "event_id", "value"), path, "event_id")  # a file for each user
    return reports.junit_results(spark, path)


_CHANGES = """ch as (
  select user_id, row_number() over (partition by user_id order by event_id) as pos, case event_type when 'view' then '-' when 'purchase' then '+' else ' ' end as sign from events
), nu as (
  select *, sum((sign <> '+')::integer) over (partition by user_id order by pos) as old, sum((sign <> '-')::integer) over (partition by user_id order by pos) as new from ch
)"""


@query(f"""with {_CHANGES}, li as (
  select user_id, coalesce(last_value(case when sign <> '+' then old + 6 end ignore nulls) over (partition by user_id order by pos rows unbounded preceding), first_value(case when sign = '+' then new + 6 end ignore nulls) over (partition by user_id order by pos rows unbounded preceding)) as line from nu
) select distinct user_id as bug, 'src/f' || user_id || '.py' as file, cast(line as integer) as line from li""")
def diff_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the lines of a diff's hunk, which begins at line 7."""
    sign = F.when(F.col("event_type") == "view", "-").when(F.col("event_type") == "purchase", "+").otherwise(" ")
    rows = testdata.table(spark, sf_dir, "events").select("user_id", "event_id", sign.alias("sign"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "sign"))), lambda e: F.concat(e["sign"], F.lit("line"))), "\n")
    count = lambda other: F.count_if(F.col("sign") != other).cast("string")
    made = rows.groupBy("user_id").agg(body.alias("body"), count("+").alias("old"), count("-").alias("new"))
    name = F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.lit(".py"))
    text = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -7,"), F.col("old"), F.lit(" +7,"), F.col("new"), F.lit(" @@\n"), F.col("body"))
    return reports.diff_places(made.select(F.col("user_id").alias("bug"), text.alias("diff")))


_CODE_LINES = {"click": ["a = 1"], "view": ["if a:", "    b = 1"], "purchase": ["if a:", "    b = 1", "else:", "    b = 2"], "signup": ["while a:", "    b = 1"], "error": ["def g():", "    return 1"]}
_RANGES = "values ('view', 'BRANCH', true, 0, 1), ('view', 'BRANCH', false, 0, 0), ('purchase', 'BRANCH', true, 0, 1), ('purchase', 'BRANCH', false, 0, 0), ('purchase', 'BRANCH', false, 3, 3), ('signup', 'LOOP', null, 0, 1), ('error', 'FUNCTION', null, 0, 1), ('error', 'FUNCTION_ERROR', null, 0, 1)"


@query(f"""with l as (
  select user_id, event_type, case event_type {" ".join(f"when '{k}' then {len(v)}" for k, v in _CODE_LINES.items())} end as n, event_id from events
), b as (select *, 1 + sum(n) over (partition by user_id order by event_id) - n as line from l), r(event_type, kind, side, f, t) as ({_RANGES})
select kind, 'f' || user_id || '.py' as file, cast(line as integer) as line, side as "then", cast(line + f as integer) as "first", cast(line + t as integer) as "last" from b join r using (event_type)""")
def source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the statements of a Python source, and the ranges found in it."""
    code = F.lit("")
    for kind, lines in _CODE_LINES.items():
        code = F.when(F.col("event_type") == kind, "\n".join(lines)).otherwise(code)
    rows = testdata.table(spark, sf_dir, "events").select("user_id", F.struct("event_id", code.alias("code")).alias("s"))
    made = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["code"]), "\n").alias("text"))
    return reports.source_ranges(made.select(F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".py")).alias("file"), "text"))


@query(f"with {sql.trace('scopes')} select case when event_id % 3 = 0 then event_id + 1000000 else event_id end as event_id, event_type, case when event_type = 'DEF' then 'other' else file end as file, line from tr")
def mapping_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping with new ids for some events, united with another that overrides definitions; only valid events stay."""
    events = testdata.trace(spark, sf_dir, "scopes")
    known = events.select(*_STATIC)
    other = known.where("event_type = 'DEF'").withColumn("file", F.lit("other"))
    moved = known.where("event_id % 3 = 0").select("event_id", (F.col("event_id") + 1000000).alias("new_id"))
    united = mapping.valid_events(mapping.united(known, other), known)
    return mapping.translated(united, moved).select("event_id", "event_type", "file", "line")


@query(f"{_FLOW} select type, feature, ef, ep, {sql.DEFAULT_SCORE} as score from counts")
def dump_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts dumped as JSON, loaded and scored."""
    path = scratch_path(spark, "dump")
    reports.dump_counts(counts_of(spark, sf_dir, *FLOW), path)
    return counts.scored(reports.load_counts(spark, path)).select("type", "feature", "ef", "ep", "score")


def _channel(green: int, yellow: int, red: int) -> str:
    return f"printf('%02x', cast(round_even(case when s <= 0.5 then 2 * (s * {yellow}.0 + (0.5 - s) * {green}.0) else 2 * ((1 - s) * {yellow}.0 + (s - 0.5) * {red}.0) end, 0) as bigint))"


_COLORS = f"""{_SCORED}, top as (select file, line, cast(least(greatest(max(score), 0), 1) as double) as s from pl group by all
), co as (select file, line, cast(floor(s * 100) as integer) as percent, '#' || {" || ".join(_channel(*c) for c in zip(reports.GREEN, reports.YELLOW, reports.RED, strict=True))} as color from top)"""


@query(f"{_COLORS} select * from co")
def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly each line would be marked in a listing."""
    return reports.colored(ranking.places(_scores(spark, sf_dir)))


@query(f"""{_COLORS}, li as (
  select 'f' || (p_partkey % 5) as file, cast(p_partkey % 22 + 1 as integer) as line,
    replace(replace(replace(replace(replace('if x < "' || p_name || '" & y > 0:', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') as t from part
), nu as (select *, case when line < 10 then '   ' else '  ' end || line || ' ' || t as code from li)
select file, line, case when color is null then '<pre title="Line ' || line || ': not executed">' || code || '</pre>'
  else '<pre style="background-color:' || color || '" title="Line ' || line || ': ' || lpad(percent::varchar, 3, ' ') || '%">' || code || '</pre>' end as html from nu left join co using (file, line)""")
def code_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of code, in HTML."""
    key = F.col("p_partkey")
    lines = testdata.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (key % 5).cast("string")).alias("file"), (key % 22 + 1).cast("int").alias("line"), F.concat(F.lit('if x < "'), "p_name", F.lit('" & y > 0:')).alias("text"))
    return reports.listing(lines, ranking.places(_scores(spark, sf_dir)))


@query(f"""with {sql.RUNS}, n as (select user_id as run_id, count(*) filter (event_type in ('click', 'view')) as passed, count(*) filter (event_type = 'error' and value > {testdata.FAILING_VALUE}) as failed from events group by 1)
select run_id, case when passed > 0 and failed = 0 then 'PASSING' when failed > 0 and passed = 0 then 'FAILING' else 'UNDEFINED' end as outcome from n""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count_if(F.col("event_type").isin("click", "view")).alias("passed"), F.count_if((F.col("event_type") == "error") & (F.col("value") > testdata.FAILING_VALUE)).alias("failed"))
    return rows.select("run_id", reports.test_outcome(F.col("passed"), F.col("failed")).alias("outcome"))


@query(r"""select doc_id, case when length(p) > 255 then md5(text) else p end as name from (
  select doc_id, text, regexp_replace(regexp_replace(text, '[^\x00-\x7f]', '', 'g'), '[^A-Za-z0-9]', '_', 'g') as p from documents)""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names from whole texts; those that stay long become checksums."""
    docs = testdata.table(spark, sf_dir, "documents")
    return docs.select("doc_id", reports.safe_name(F.col("text")).alias("name"))


def _streamed(spark: SparkSession, source: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """What a stream over a table gives once all is read: the last batch, or all batches of a stream that appends."""
    path = scratch_path(spark, "stream")
    source.write.parquet(f"{path}/in")
    out = make(spark.readStream.schema(source.schema).parquet(f"{path}/in"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{path}/out/batch={number}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    kept = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in out.schema.fields)}, batch long").parquet(f"{path}/out")
    return kept.drop("batch") if mode == "append" else kept.join(F.broadcast(kept.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.table(spark, sf_dir, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "run_id": F.col("user_id")})


@query("""select window_start, event_type, count(*) as n from (select time_bucket(interval '10 minutes', ts) as window_start, event_type from events) group by all""")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per kind and ten minutes, by a stream over the table that ends when all is read."""
    made = _streamed(spark, _timed(spark, sf_dir), lambda events: live.event_rates(events).select(F.col("window.start").alias("window_start"), "event_type", "n"))
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"with {sql.trace('flow')} select run_id, file, line, count(*) as hits from tr where event_type = 'LINE' group by all")
def streamed_line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, testdata.trace(spark, sf_dir, "flow"), live.line_hits)


@query("""with g as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval '2 hours' then 1 else 0 end as new from events
), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id as run_id, min(ts) as first, count(*) as n from s group by user_id, session""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a run without a pause of over two hours."""
    made = _streamed(spark, _timed(spark, sf_dir), lambda events: live.sessions(events, "2 hours").select("run_id", F.col("session_window.start").alias("first"), "n"))
    return made.select("run_id", F.col("first").cast("timestamp_ntz").alias("first"), "n")


@query(f"with {sql.trace('scopes')}, {sql.SCOPES} select run_id, seq, depth, scope_id from sc")
def streamed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes as state of a stream."""
    return _streamed(spark, testdata.trace(spark, sf_dir, "scopes"), live.scopes, mode="append")


# What needs no more than a query or two.

_THREADS = sql.SCOPES.replace("partition by run_id", "partition by run_id, event_id % 2")


@query(f"with {sql.trace('scopes')}, {_THREADS} select run_id, event_id % 2 as thread_id, seq, depth, scope_id from sc")
def scopes_by_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread of a run has scopes of its own."""
    return sequence.with_scopes(testdata.trace(spark, sf_dir, "scopes", threads=2)).select("run_id", "thread_id", "seq", "depth", "scope_id")


_SPANS = "spans as (select distinct type as kind, file, line, type = 'BRANCH' and ends_with(feature, ':then') as then, line as first, least(line + 2, 19) as last from counts where type = 'BRANCH')"


@query(f"""{_SCORED}, {_SPANS}, ex as (
  select s.type, s.feature, s.file, unnest(case when p.first is null then [s.line] else range(p.first, p.last + 1) end) as line, s.score from scores s left join spans p on s.type = p.kind and s.file = p.file and s.line = p.line and (s.type = 'BRANCH' and ends_with(s.feature, ':then')) = p.then
) select type, file, cast(line as integer) as line, max(score) as score from ex group by all""")
def expanded_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches point to the lines of their side: here the branch's and two more."""
    scored = _scores(spark, sf_dir)
    sides = scored.where("type = 'BRANCH'").select(F.col("type").alias("kind"), "file", "line", F.col("feature").endswith(":then").alias("then"), F.col("line").alias("first"), F.least(F.col("line") + 2, F.lit(19)).alias("last")).distinct()
    return ranking.expanded_places(scored, sides, "type").groupBy("type", "file", "line").agg(F.max("score").alias("score"))


@query(f"""{_SCORED}, {_SPANS}, ex as (
  select s.type, s.feature, s.file, unnest(case when p.first is null then [s.line] else range(p.first, p.last + 1) end) as line, s.score from scores s left join spans p on s.type = p.kind and s.file = p.file and s.line = p.line and (s.type = 'BRANCH' and not ends_with(s.feature, ':then')) = p.then
) select type, file, cast(line as integer) as line, max(score) as score from ex group by all""")
def flipped_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As expanded_places, of the sides that features don't name."""
    scored = _scores(spark, sf_dir)
    sides = scored.where("type = 'BRANCH'").select(F.col("type").alias("kind"), "file", "line", F.col("feature").endswith(":then").alias("then"), F.col("line").alias("first"), F.least(F.col("line") + 2, F.lit(19)).alias("last")).distinct()
    return ranking.expanded_places(scored, sides, "type", flip=True).groupBy("type", "file", "line").agg(F.max("score").alias("score"))


@query(f"{sql.counted('LINE')} select file, line, {metrics.expression('Ochiai')} as ochiai, {metrics.expression('Zoltar')} as zoltar from counts")
def similarity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients as SQL functions of four counts."""
    metrics.register(spark)
    made = counts_of(spark, sf_dir, "LINE")
    four = [F.col(c) for c in ("ep", "np", "ef", "nf")]
    return made.select("file", "line", metrics.similarity("Ochiai", *four).alias("ochiai"), metrics.similarity("Zoltar", *four).alias("zoltar"))


@query(f"with {sql.observations(*FLOW)}, {_VALUES} select r.failing, feature, max(value) as value from vals join runs r using (run_id) group by r.failing, feature")
def merged_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector for all failing runs, and one for all passing ones."""
    values, runs = _values(spark, sf_dir)
    return vectors.merged(values.join(runs, "run_id"), "failing").select("failing", "feature", "value")


@query("""with o as (select user_id as test, case when bool_or(event_type = 'error' and value > 150) then 'FAILED' else 'PASSED' end as result, case when bool_or(event_type = 'error' and value > 120) then 'FAILED' else 'PASSED' end as first from events group by 1)
select test, result from o where result = first""")
def consistent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests whose result is that of another try, here one with a stricter limit."""
    rows = testdata.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("test"))
    outcome = lambda least: rows.agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > least)).alias("bad")).select("test", F.when(F.col("bad"), "FAILED").otherwise("PASSED").alias("result"))
    return reports.consistent_runs(outcome(testdata.FAILING_VALUE), outcome(120))


@query(f"with {sql.RUNS}, n as (select user_id as run_id, count(*) as n from events group by 1) select failing, count(*) as runs, cast(sum(n) as bigint) as events from runs join n using (run_id) group by failing")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and events by outcome."""
    per = testdata.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"))
    return testdata.runs(spark, sf_dir).join(per, "run_id").groupBy("failing").agg(F.count("*").alias("runs"), F.sum("n").alias("events"))


@query(f"with {sql.trace('scopes')} select run_id, seq, event_type, file, line from tr where seq > 10 and seq <= 20")
def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten events of every run's log."""
    events = testdata.trace(spark, sf_dir, "scopes")
    return events.where((F.col("seq") > 10) & (F.col("seq") <= 20)).select("run_id", "seq", "event_type", "file", "line")


# Threads that start in a scope of the main thread, and runs dealt to stretches.

_FORKED = sql.SCOPES.replace("partition by run_id", "partition by run_id, thr").replace("from tr", "from tt")
_THREAD_SCOPES = f"""{sql.trace('scopes')}, tt as (
  select *, nullif(event_id % 3, 0) as thr from tr where event_type in ('DEF', 'USE', 'FUNCTION_ENTER', 'FUNCTION_EXIT', 'FUNCTION_ERROR')
), {_FORKED}, lv as (
  select run_id, thr, scope_id, min(depth) as d, min(seq) as opened, coalesce(min(case when event_type in ('FUNCTION_EXIT', 'FUNCTION_ERROR') and depth > 0 then seq end), max(last) + 1) as closed
  from (select *, max(seq) over (partition by run_id, thr) as last from sc) where scope_id <> 0 group by all
), fk as (
  select f.*, lv.scope_id, lv.d from (select run_id, thr, min(seq) as fork from tt where thr is not null group by all) f join lv on lv.run_id = f.run_id and lv.thr is null and opened <= fork and fork < closed
  union all select run_id, thr, min(seq), 0, 0 from tt where thr is not null group by all
), inn as (
  select run_id, thr, arg_max(scope_id, d) as fork_scope, max(d) as base from fk group by all
), ts as (
  select sc.*, case when fork_scope is null or depth > 0 then sc.thr end as st, case when fork_scope is null or depth > 0 then scope_id else fork_scope end as sid, cast(depth + coalesce(base, 0) as integer) as dep
  from sc left join inn on inn.run_id = sc.run_id and inn.thr = sc.thr
)"""
_THREAD_VISIBLE = f"""{_THREAD_SCOPES}, df as (
  select run_id, st, sid, dep, var, seq as start, lead(seq) over (partition by run_id, st, sid, var order by seq) as next, value_num, value_type from ts where event_type = 'DEF'
), fin as (
  select run_id, max(seq) + 1 as fin from ts group by run_id
), iv as (
  select df.run_id, st as thr, dep, var, start, coalesce(least(next, closed), fin) as finish, value_num, value_type
  from df join fin using (run_id) left join lv on lv.run_id = df.run_id and lv.thr is not distinct from df.st and lv.scope_id = df.sid
  union all select df.run_id, fk.thr, fk.d, var, greatest(start, fork), coalesce(next, fin), value_num, value_type from fk join df on df.run_id = fk.run_id and df.st is null and df.sid = fk.scope_id join fin on fin.run_id = df.run_id
), vis as (
  select d.run_id, d.thr, d.seq, d.var, i.var as other_var, arg_max(i.value_type, i.dep) as other_type, arg_max(coalesce(i.value_num, 1e300), i.dep) as other_raw
  from ts d join iv i on i.run_id = d.run_id and i.thr is not distinct from d.thr and i.start <= d.seq and d.seq < i.finish where d.event_type = 'DEF' group by all
)"""


def _threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.trace(spark, sf_dir, "scopes", threads=3, main=True)


@query(f"with {_THREAD_SCOPES} select run_id, thr as thread_id, seq, st as scope_thread, sid as scope_id, dep as depth from ts")
def thread_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of the main thread and of two that start in one of its scopes."""
    return threads.with_thread_scopes(_threaded(spark, sf_dir)).select("run_id", "thread_id", "seq", "scope_thread", "scope_id", "depth")


@query(f"with {_THREAD_VISIBLE} select run_id, thr as thread_id, seq, var, other_var, case when other_type = 'float' then other_raw end as other_value_num from vis")
def thread_visible_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that a thread sees, inherited ones among them."""
    return threads.visible_variables(_threaded(spark, sf_dir)).select("run_id", "thread_id", "seq", "var", "other_var", "other_value_num")


@query(f"""with {_THREAD_SCOPES}, du as (
  select *, coalesce(
    last_value(case when event_type = 'DEF' then seq end ignore nulls) over (partition by run_id, st, sid, var, var_id order by seq rows between unbounded preceding and 1 preceding),
    last_value(case when event_type = 'DEF' then seq end ignore nulls) over (partition by run_id, thr, var, var_id order by seq rows between unbounded preceding and 1 preceding)) as own from ts where event_type in ('DEF', 'USE')
), dm as (
  select run_id, sid, var, var_id, seq from ts where event_type = 'DEF' and st is null
), inh as (
  select u.run_id, u.thr, u.seq, arg_max(m.def_seq, fk.d) as def_seq from du u join fk on fk.run_id = u.run_id and fk.thr = u.thr
    join lateral (select max(seq) as def_seq from dm where dm.run_id = u.run_id and dm.sid = fk.scope_id and dm.var = u.var and dm.var_id = u.var_id and dm.seq < u.seq) m on m.def_seq is not null
  where u.event_type = 'USE' and u.own is null group by all
)
select u.run_id, u.thr as thread_id, u.seq, u.var, st as scope_thread, sid as scope_id, coalesce(own, inh.def_seq) as def_seq from du u left join inh on inh.run_id = u.run_id and inh.thr = u.thr and inh.seq = u.seq
where u.event_type = 'USE' and coalesce(own, inh.def_seq) is not null""")
def thread_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses with their definitions, across fork points."""
    return threads.def_use(_threaded(spark, sf_dir)).select("run_id", "thread_id", "seq", "var", "scope_thread", "scope_id", "def_seq")


@query(f"with {sql.observations(*FLOW)} select run_id, nullif(event_id % 3, 0) as thread_id, feature, max(truth) as hit, cast(sum(truth) as bigint) as hits, count(*) as seen, arg_max(truth, seq) as last from obs join (select run_id, seq, event_id from tr) using (run_id, seq) group by run_id, event_id % 3, type, feature, file, line, file2, line2")
def thread_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each thread of a run evaluated a feature, how often it held, and whether it did the last time."""
    events = testdata.trace(spark, sf_dir, "flow", threads=3, main=True)
    return counts.thread_hits(extractors.extract(events, *FLOW), events).select("run_id", "thread_id", "feature", "hit", "hits", "seen", "last")


#: So narrow that every run is dealt to many stretches, as a run of millions of events is by default.
_NARROW = 16


@query(ORACLES["scopes"])
def scopes_by_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes by a prefix scan over stretches of each run; no task holds a whole run."""
    return sequence.with_scopes(testdata.trace(spark, sf_dir, "scopes"), long=_NARROW).select("run_id", "seq", "depth", "scope_id")


@query(ORACLES["def_use_pairs"])
def def_use_by_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.def_use(testdata.trace(spark, sf_dir, "scopes"), long=_NARROW).select("run_id", "seq", "var", "scope_id", "def_seq", "def_file", "def_line")


@query(ORACLES["loop_iterations"])
def loops_by_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.loop_counts(testdata.trace(spark, sf_dir, "loops"), long=_NARROW).select("run_id", "file", "line", "loop_id", "seq", "iterations")


@query(ORACLES["segments"])
def segments_by_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequence.segments(testdata.trace(spark, sf_dir, "tests"), long=_NARROW)
    return made.groupBy("run_id", "segment").agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"))


# Counts kept up to date, folds of scores, containers and typed dumps.


@query(f"{_FLOW} select type, feature, ef, nf, ep, np, fr, fi from counts")
def counts_by_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after three deliveries: runs come in pieces, some of which repeat, and outcomes late, or wrong at first."""
    events, runs = events_of(spark, sf_dir, "LINE")
    observed = stored(extractors.extract(events, *FLOW), "observed")
    kept = ledger.Ledger(spark, scratch_path(spark, "ledger"), buckets=8)
    wrong = F.when(F.col("run_id") % 10 == 0, ~F.col("failing")).otherwise(F.col("failing")).alias("failing")
    kept.deliver(0, observed.where("run_id % 3 = 0 or seq % 2 = 0"), runs.where("run_id % 7 > 0").select("run_id", wrong))
    kept.deliver(1, observed.where("run_id % 3 > 0"), runs.where("run_id % 7 = 0"))
    kept.compact()
    kept.deliver(2, observed.where("seq % 5 = 0"), runs.where("run_id % 10 = 0"))
    return kept.counts().select("type", "feature", "ef", "nf", "ep", "np", "fr", "fi")


@query(f"""{_SCORED}, ds as (select type, file, line, list_sort(list(distinct score), 'DESC') as s, round(avg(score), 9) as mean from pl where score is not null group by all)
select type, file, line, round(list_reduce(s, lambda a, x: x + a / 3, 0.0::double), 9) as fading, round(list_reduce(s, lambda a, x: 1 - (1 - x) * (1 - a), 0.0::double), 9) as either, mean from ds""")
def place_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a place put together by two functions of the user's, and by a mean of which two halves are kept and added."""
    scores = stored(_scores(spark, sf_dir), "scores")
    fading = ranking.place_scores(scores, "type", how=lambda score, so_far: score + so_far / 3, start=0)
    either = ranking.place_scores(scores, "type", how=lambda score, so_far: 1 - (1 - score) * (1 - so_far), start=0)
    half = F.length("feature") % 2 == 0
    mean = ranking.mean_of_sums(ranking.place_sums(scores.where(half), "type").unionByName(ranking.place_sums(scores.where(~half), "type")), "type")
    keys = ["type", "file", "line"]
    both = fading.select(*keys, F.round("score", 9).alias("fading")).join(either.select(*keys, F.round("score", 9).alias("either")), keys)
    return both.join(mean.withColumnRenamed("score", "mean"), keys)


@query(ORACLES["source_csv_logs"])
def container_csv_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text logs of all runs in a few containers, read back by their index."""
    path = scratch_path(spark, "containers")
    container.write_containers(csv_log.text_logs(testdata.trace(spark, sf_dir, "flow")), path, files=8)
    return csv_log.parse_text_logs(container.read_containers(spark, path)).select("run_id", "seq", "event_type", "file", "line", "event_id", "then_id")


@query(ORACLES["source_binary_logs"])
def container_binary_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As source_binary_logs, through containers."""
    events = testdata.program_place(testdata.valued(testdata.trace(spark, sf_dir, "scopes")))
    path = scratch_path(spark, "containers")
    container.write_containers(binary_log.encode_logs(events), path, files=8)
    back = binary_log.decode_logs(container.read_containers(spark, path), events.select(*_STATIC).distinct())
    return back.selectExpr("run_id", f"chunk * {binary_log.STRETCH} + seq as seq", *_LOG_COLUMNS)


@query(f"""{_FLOW} select type, feature, case when line % 5 > 0 then ef end as ef, case when line % 5 > 0 then {sql.DEFAULT_SCORE} end as score,
  case when line % 5 = 0 then case when type in ('BRANCH', 'CONDITION') then 'ef,fr' else 'ef' end end as missing from counts""")
def typed_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts dumped, some of them without mandatory fields: those are reported, the others loaded and scored."""
    path = scratch_path(spark, "typed-dump")
    made = counts_of(spark, sf_dir, *FLOW)
    kept = lambda name: F.when(F.col("line") % 5 > 0, F.col(name))
    reports.dump_typed(made.withColumns({"ef": kept("ef"), "fr": kept("fr")}), path)
    good, bad = reports.load_typed(spark, path)
    scored = counts.scored(good).select("type", "feature", "ef", "score", F.lit(None).cast("string").alias("missing"))
    none = F.lit(None).cast("double")
    return scored.unionByName(bad.select("type", F.get_json_object("body", "$.feature").alias("feature"), none.alias("ef"), none.alias("score"), F.array_join("missing", ",").alias("missing")))
