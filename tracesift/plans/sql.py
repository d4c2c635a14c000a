"""The same computations as plain SQL over the driver's tables, put together from common table expressions."""

from __future__ import annotations

from ..functions.metrics import expression
from ..operators.extractors import COMPARATORS, OTHER_DIGITS
from ..schema import PREDICATES
from ..sources.testdata import FAILING_VALUE, VARIANTS

OPS = ", ".join(f"('{o}')" for o in COMPARATORS)
KEYS = "type, feature, file, line, file2, line2"


def trace(variant: str = "scopes", name: str = "tr") -> str:
    cases = []
    for source, (even, odd) in VARIANTS[variant].items():
        cases.append(f"when event_type = '{source}' and k % 2 = 0 then '{even}' when event_type = '{source}' then '{odd}'")
    return f"""{name} as (
  select run_id, row_number() over (partition by run_id order by ts, event_id) as seq, event_id, case {" ".join(cases)} end as event_type,
    'f' || (k % 5) as file, cast(k % 19 + 1 as integer) as line, 'fn' || (k % 7) as function, k % 7 as function_id, 'v' || (k % 4) as var, k % 4 as var_id,
    case when k % 10 <> 9 then value - 50 end as value_num, value > 60 as value_bool, case when k % 10 <> 9 then 'float' else 'NoneType' end as value_type,
    2 * (k % 10) + case when value > 60 then 1 else 0 end as then_id, case when k % 10 = 9 then -1 else 2 * (k % 10) + case when value > 60 then 0 else 1 end end as else_id,
    k % 3 as loop_id, 'c' || (k % 6) as condition, k % 4 as length, event_type as row_type, value, k
  from (select event_id, ts, user_id as run_id, event_type, value, cast(json_extract_string(props, '$.k') as integer) as k from events)
)"""


RUNS = f"runs as (select user_id as run_id, bool_or(event_type = 'error' and value > {FAILING_VALUE}) as failing from events group by 1)"
ORDER_RUNS = "runs as (select o_orderkey as run_id, o_orderstatus = 'F' as failing from orders)"
ORDER_OBS = "obs as (select 'LINE' as type, 'LINE:' || l_returnflag || l_linestatus || ':' || l_linenumber as feature, l_returnflag || l_linestatus as file, cast(l_linenumber as integer) as line, null as file2, null as line2, l_orderkey as run_id, l_linenumber as seq, 1 as truth from lineitem)"
DOC_RUNS = "runs as (select doc_id as run_id, quality = 0 or toxic = 1 as failing from labels)"
DOC_TRACE = r"""d0 as (
  select doc_id, lang, source, coalesce(regexp_extract(text, '^\s*(\S+)', 1), '') as first, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then cast(n_chars as varchar) end as odd, text from documents
), t0 as (
  select doc_id as run_id, 1 as seq, 'DEF' as event_type, 'docs' as file, 1 as line, 'lang' as var, lang as value_str from d0 union all
  select doc_id, 2, 'DEF', 'docs', 2, 'source', source from d0 union all select doc_id, 3, 'DEF', 'docs', 3, 'first', first from d0 union all select doc_id, 4, 'DEF', 'docs', 4, 'odd', odd from d0 union all
  select doc_id, 5, 'DEF', 'docs', 5, 'text', text from d0 union all select doc_id, 6, 'DEF', 'docs', 6, 'raw', null from d0
), tr as (select *, var = 'raw' and run_id % 2 = 1 as no_bytes from t0)"""

SCOPES = """s1 as (
  select *, sum(case when event_type = 'FUNCTION_ENTER' then 1 when event_type in ('FUNCTION_EXIT', 'FUNCTION_ERROR') then -1 else 0 end) over (partition by run_id order by seq rows unbounded preceding) as cum from tr
), s2 as (
  select *, cum - least(0, min(cum) over (partition by run_id order by seq rows unbounded preceding)) as after from s1
), s3 as (
  select *, cast(case when event_type in ('FUNCTION_EXIT', 'FUNCTION_ERROR') then coalesce(lag(after) over (partition by run_id order by seq), 0) else after end as integer) as depth from s2
), sc as (
  select *, case when depth = 0 then 0 else last_value(case when event_type = 'FUNCTION_ENTER' then seq end ignore nulls) over (partition by run_id, depth order by seq rows unbounded preceding) end as scope_id from s3
)"""

DEF_USE = SCOPES + """, du as (
  select run_id, seq, file as use_file, line as use_line, var, var_id, scope_id, event_type,
    coalesce(last_value(case when event_type = 'DEF' then seq end ignore nulls) over (partition by run_id, var, var_id, scope_id order by seq rows between unbounded preceding and 1 preceding),
      last_value(case when event_type = 'DEF' then seq end ignore nulls) over (partition by run_id, var, var_id order by seq rows between unbounded preceding and 1 preceding)) as def_seq
  from sc where event_type in ('DEF', 'USE')
), duu as (
  select du.*, tr.file as def_file, tr.line as def_line from du join tr on tr.run_id = du.run_id and tr.seq = du.def_seq where du.event_type = 'USE'
)"""

#: Loops by recursion over each loop's own events.
LOOPS = """lp as (
  select *, row_number() over (partition by run_id, file, line, loop_id order by seq) as i from tr where event_type in ('LOOP_BEGIN', 'LOOP_HIT', 'LOOP_END')
), lr as (
  select run_id, file, line, loop_id, cast(0 as bigint) as i, cast([] as bigint[]) as st, cast(null as bigint) as popped, cast(null as bigint) as seq from lp where i = 1
  union all
  select lp.run_id, lp.file, lp.line, lp.loop_id, lp.i,
    case lp.event_type when 'LOOP_BEGIN' then list_append(lr.st, 0) when 'LOOP_HIT' then case when len(lr.st) = 0 then [1] else list_append(lr.st[:-2], lr.st[-1] + 1) end else lr.st[:-2] end,
    case when lp.event_type = 'LOOP_END' then case when len(lr.st) = 0 then 0 else lr.st[-1] end end, lp.seq
  from lr join lp on lp.run_id = lr.run_id and lp.file = lr.file and lp.line = lr.line and lp.loop_id = lr.loop_id and lp.i = lr.i + 1
), le as (select run_id, file, line, loop_id, seq, popped as iterations from lr where popped is not null)"""

VISIBLE = SCOPES + """, lives as (
  select run_id, scope_id, min(depth) as scope_depth, coalesce(min(case when event_type in ('FUNCTION_EXIT', 'FUNCTION_ERROR') and depth > 0 then seq end), max(last) + 1) as closed, min(seq) as opened
  from (select *, max(seq) over (partition by run_id) as last from sc) where scope_id <> 0 group by all
  union all select run_id, 0, 0, max(seq) + 1, min(seq) from sc group by run_id
), dv as (
  select run_id, scope_id, var, seq as start, lead(seq) over (partition by run_id, scope_id, var order by seq) as next, value_num, value_type from sc where event_type = 'DEF'
), iv as (
  select dv.*, scope_depth, coalesce(next, closed) as finish from dv join lives using (run_id, scope_id)
), vis as (
  select d.run_id, d.seq, d.file, d.line, d.var, d.value_num, d.value_type, i.var as other_var, arg_max(i.value_type, i.scope_depth) as other_value_type,
    max_by(coalesce(i.value_num, 1e300), i.scope_depth) as other_raw
  from tr d join iv i on i.run_id = d.run_id and i.start <= d.seq and d.seq < i.finish where d.event_type = 'DEF' group by all
), visible as (select * exclude (other_raw), case when other_value_type = 'float' then other_raw end as other_value_num from vis)"""


def compare(op: str, a: str, b: str) -> str:
    hit = f"case {op} when '<' then {a} < {b} when '<=' then {a} <= {b} when '==' then {a} = {b} when '>=' then {a} >= {b} when '>' then {a} > {b} else {a} <> {b} end"
    return f"cast(case when {a} is null or {b} is null then {op} = '!=' else {hit} end as integer)"


def _obs(kind: str, source: str, key: str, truth: str, ends: str = "null as file2, null as line2") -> str:
    return f"select '{kind}' as type, '{kind}:' || file || ':' || line{key} as feature, file, line, {ends}, run_id, seq, {truth} as truth from {source}"


def _class(count: str) -> str:
    return f"cast(case class when '0' then {count} = 0 when '1' then {count} = 1 else {count} > 1 end as integer)"


_CLASSES = "(values ('0'), ('1'), ('more')) c(class)"
_STRING = "case when value_type = 'str' then value_str end"

#: For each kind: the variant of the trace, further expressions, and the observations.
OBSERVATIONS: dict[str, tuple[str, str, str]] = {
    "LINE": ("flow", "", _obs("LINE", "tr where event_type = 'LINE'", "", "1")),
    "BRANCH": ("flow", "", "select 'BRANCH' as type, 'BRANCH:' || file || ':' || line || ':' || id || case when side then ':then' else ':else' end as feature, file, line, null as file2, null as line2, run_id, seq, truth from ("
               "select *, then_id as id, then_id < else_id as side, 1 as truth from tr where event_type = 'BRANCH' union all select *, else_id, else_id < then_id, 0 from tr where event_type = 'BRANCH' and else_id >= 0)"),
    "FUNCTION": ("scopes", "", _obs("FUNCTION", "tr where event_type = 'FUNCTION_ENTER'", " || ':' || function", "1")),
    "LOOP": ("loops", LOOPS, _obs("LOOP", f"le cross join {_CLASSES}", " || ':' || class", _class("iterations"))),
    "DEF_USE": ("scopes", DEF_USE, "select 'DEF_USE' as type, concat_ws(':', 'DEF_USE', def_file, def_line, use_file, use_line, var) as feature, def_file as file, def_line as line, use_file as file2, use_line as line2, run_id, seq, 1 as truth from duu"),
    "CONDITION": ("flow", "", _obs("CONDITION", "tr cross join (values (false), (true)) n(negate) where event_type = 'CONDITION'", " || ':' || condition || case when negate then ':not' else ':is' end", "cast(value_bool <> negate as integer)")),
    "SCALAR_PAIR": ("scopes", VISIBLE, _obs("SCALAR_PAIR", f"visible cross join (values {OPS}) o(op) where value_type = other_value_type and (value_type = 'float' or op in ('==', '!='))", " || ':' || var || ':' || op || ':' || other_var",
                    f"case when value_type = 'float' then {compare('op', 'value_num', 'other_value_num')} else cast(op = '==' as integer) end")),
    "VARIABLE": ("scopes", "", _obs("VARIABLE", f"tr cross join (values {OPS}) o(op) where event_type = 'DEF' and value_type = 'float'", " || ':' || var || ':' || op", compare("op", "value_num", "0.0"))),
    "RETURN": ("scopes", "", _obs("RETURN", f"(select *, case when value_type = 'float' then '0' else 'None' end as against from tr) cross join (values {OPS}) o(op) where event_type = 'FUNCTION_EXIT' and (against = '0' or op in ('==', '!='))",
               " || ':' || function || ':' || op || ':' || against", f"case when against = '0' then {compare('op', 'value_num', '0.0')} else cast((value_type = 'NoneType') = (op = '==') as integer) end")),
    "NONE": ("scopes", "", _obs("NONE", "tr where event_type = 'DEF'", " || ':' || var", "cast(value_type = 'NoneType' as integer)")),
    "EMPTY_STRING": ("docs", "", _obs("EMPTY_STRING", "tr", " || ':' || var", "cast(coalesce(value_str = '', false) as integer)")),
    "EMPTY_BYTES": ("docs", "", _obs("EMPTY_BYTES", "tr", " || ':' || var", "cast(no_bytes as integer)")),
    "ASCII_STRING": ("docs", "", _obs("ASCII_STRING", "tr", " || ':' || var", "cast(coalesce(octet_length(encode(value_str)) = length(value_str), false) as integer)")),
    "DIGIT_STRING": ("docs", "", _obs("DIGIT_STRING", "tr", " || ':' || var", rf"cast(coalesce(regexp_matches(value_str, '[\p{{Nd}}{OTHER_DIGITS}]'), false) as integer)")),
    "SPECIAL_STRING": ("docs", "", _obs("SPECIAL_STRING", "tr", " || ':' || var", r"cast(coalesce(not regexp_full_match(value_str, '[\p{L}\p{N}]+'), false) as integer)")),
    "LENGTH": ("flow", "", _obs("LENGTH", f"tr cross join {_CLASSES} where event_type = 'LEN'", " || ':' || var || ':' || class", _class("length"))),
    "FUNCTION_ERROR": ("scopes", "en as (select file as ef, function_id as ei, min(line) as el from tr where event_type = 'FUNCTION_ENTER' group by all), fe as (select * replace (coalesce(el, line) as line) from tr left join en on ef = file and ei = function_id where event_type in ('FUNCTION_EXIT', 'FUNCTION_ERROR'))",
                       _obs("FUNCTION_ERROR", "fe", " || ':' || function", "cast(event_type = 'FUNCTION_ERROR' as integer)")),
}


def observations(*kinds: str) -> str:
    """Expressions down to obs, of kinds that share a variant of the trace."""
    variant = OBSERVATIONS[kinds[0]][0]
    base = DOC_TRACE if variant == "docs" else trace(variant)
    runs = DOC_RUNS if variant == "docs" else RUNS
    parts = [base, runs, *(OBSERVATIONS[k][1] for k in kinds if OBSERVATIONS[k][1]), "obs as (" + " union all ".join(OBSERVATIONS[k][2] for k in kinds) + ")"]
    return ", ".join(parts)


COUNTS = f"""tot as (select cast(count(*) filter (failing) as double) as f, cast(count(*) filter (not failing) as double) as p from runs
), hits as (select {KEYS}, run_id, max(truth) as hit from obs group by all
), cnt as (
  select {KEYS}, cast(count(*) filter (failing and hit = 1) as double) as ef, cast(count(*) filter (not failing and hit = 1) as double) as ep,
    cast(count(*) filter (failing and hit = 0) as double) as fr, cast(count(*) filter (not failing and hit = 0) as double) as fi
  from hits join runs using (run_id) group by all
), counts as (select {KEYS}, ef, f - ef as nf, ep, p - ep as np, f, p, ef as tr, ep as ti, fr, fi from cnt cross join tot)"""

DEFAULT_SCORE = f"case when type in ({', '.join(repr(x) for x in PREDICATES)}) then {expression('IncreaseTrue')} else {expression('Ochiai')} end"


def counted(*kinds: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive or 'LOOP' in kinds else ''}{observations(*kinds)}, {COUNTS}"


#: Places with their scores; every place of features that name two.
PLACES = """scores as (select *, {score} as score from counts
), pl as (select distinct {by} feature, score, file, line from (select {by} feature, score, file, line from scores union all select {by} feature, score, file2, line2 from scores where line2 is not null))"""

PLACE_SCORES = "ps as (select {by} file, line, max(score) as score from pl group by all)"

RANKED = """per as (select {by} score, count(*) as tied from ps group by all
), pe as (select *, sum(tied) over ({part} order by score desc rows unbounded preceding) as effort from per
), ranked as (select ps.*, cast(pe.effort as bigint) as effort, pe.tied, case when tied = 1 then cast(effort as double) else tied / 2 + (effort - tied + 1) - 1 end as rank from ps join pe using ({keys}score))"""

FAULTY = "faulty as (select distinct file, line from tr where row_type = 'error' and value >= 0.9 * (select max(value) from tr where row_type = 'error'))"
