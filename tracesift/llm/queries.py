"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, convtrie, decontaminate, jaccard, lexical, linededup, pii, quality, secrets, topk, urlfilter, warc
from .common import shared_dir

URL_RULES = [
    urlfilter.Rule("org", "/", "allow"),
    urlfilter.Rule("example.org", "/es/", "block"),
    urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"),
    urlfilter.Rule("com", "/de/", "block"),
]


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])
    both = bpe.bpe_decode(ids, vocabulary())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hashed(F.col("decoded")).alias("decoded_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.col("leak.edits").cast("long").alias("edits"), F.col("leak.first_word").cast("long").alias("first_word"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    back = chat.read_chats(chat.format_chats(turns.unionByName(extra)))
    turned = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), hashed(turned).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), hashed(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), hashed(named(base)).alias("base_sha256"), named(F.col("secrets")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_voters(docs, table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path, least=0)
    return warc.checked_payloads(warc.read_warc(spark, path)).select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = linededup.line_report(table(spark, sf_dir, "documents"), max_edits=1)
    return report.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["fixed"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["fixed"])
    return found.select("doc_id", *map(count, pii.KINDS), hashed(named(base)).alias("base_sha256"), named(F.col("pii")).alias("spans"))


def conversation_base() -> F.Column:
    return F.col("conv_id") - F.col("conv_id") % 100


def conversation_head() -> F.Column:
    return F.crc32(F.col("conv_id").cast("string")) % 6


def op13_convtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.conversation_trie(table(spark, sf_dir, "conversations"), conversation_base(), conversation_head(), most=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_decontaminate, op3_chat, op4_topk, op5_urls, op6_secrets, op7_quality, op8_warc, op9_jaccard, op10_lines, op11_lexical, op12_pii, op13_convtrie)}


_ESCAPE = r"replace(replace(replace({0}, '\', '\0'), '#', '\1'), '<', '\2')"
_BLANK = r"chr(32), chr(9), chr(10), chr(11), chr(12), chr(13)"

SQL = {
    "op3_chat": rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(4 + length(replace({_ESCAPE.format('role')}, ':', '\3')) + 2 + length({_ESCAPE.format('text')}) + 9) as bigint) as formatted_chars,
  cast(0 as bigint) as n_attachments, cast(0 as bigint) as attachment_tokens
from t group by conv_id""",
    "op4_topk": """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.row, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.row <> q.row
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by row order by score desc, vec_id) as rank from s
) where rank <= 5""",
    "op8_warc": """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, cast(unhex(sha1(html)) as bit) as b,
    min(page_id) over (partition by html) as first_id
  from p
)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(5), lambda j: get_bit(b, cast(5 * i + j as integer)) * (16 >> j))) as integer), 1)), 'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from d""",
}


def _url_sql(rounds: int) -> str:
    """The rules, and as many rounds of propagation, as one statement."""
    rules = [f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES]
    turns = ""
    for n in range(rounds):
        turns += f""", s{n + 1} as materialized (
  select kind, host, sum(score) as score from (
    select e.kind, e.dst as host, s.score * e.part * {urlfilter.DAMPING} as score from e join s{n} s on s.kind = e.kind and s.host = e.src
    union all select kind, host, seed * (1 - {urlfilter.DAMPING}) from seeds
  ) group by kind, host
)"""
    return rf"""
with rules(rh, rp, rv) as (values {", ".join(rules)}),
p0 as (
  select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), p as (
  select page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter._UPPER}', '{urlfilter._LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p0
), fit as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as by_rule
  from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id
), judged as (
  select p.*, rule, by_rule from p left join fit using (page_id)
), n as (
  select case when by_rule = 'allow' then 'trust' else 'distrust' end as kind, host, count(*) as n
  from judged where rule is not null and host <> '' group by all
), seeds as materialized (
  select kind, host, n / sum(n) over (partition by kind) as seed from n
), href as (
  select page_id, host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, '\shref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1, 'i'), lambda h: translate(h, '{urlfilter._UPPER}', '{urlfilter._LOWER}')))) as dst from p
), up as (
  select distinct host, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) as parent from p where host <> ''
), linked as (
  select src, dst, count(*) as n from href where src <> '' and src <> dst group by all
  union all select distinct host, parent, 1 from up where parent <> ''
  union all select distinct parent, host, 1 from up where parent <> ''
), links as (
  select src, dst, sum(n) as n from linked group by all
), two as (
  select 'trust' as kind, src, dst, n from links union all select 'distrust', dst, src, n from links
), e as materialized (
  select kind, src, dst, n / sum(n) over (partition by kind, src) as part from two
), s0 as (select kind, host, seed as score from seeds){turns}, h as (
  select host, coalesce(max(score) filter (kind = 'trust'), 0) as trust, coalesce(max(score) filter (kind = 'distrust'), 0) as distrust
  from (select kind, host, score / sum(score) over (partition by kind) as score from s{rounds}) group by host
)
select page_id, j.host, path, rule,
  coalesce(by_rule, case when distrust > 0 and round(distrust / (trust + distrust), 6) >= {urlfilter.LEAST_SHARE} then 'block' else 'allow' end) as verdict
from judged j left join h on h.host = j.host"""


SQL["op5_urls"] = _url_sql(urlfilter.ROUNDS)

SQL["op9_jaccard"] = rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{urlfilter._UPPER}', '{urlfilter._LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w
), n as (
  select doc_id, len(sh) as n from s
), g as (
  select doc_id, unnest(sh) as g from s
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)
), e as (
  select a, b from l union all select b, a from l
), r as (
  select doc_id as d, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.d
)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(c) as component_id from n join r on r.d = n.doc_id group by all"""

SQL["op10_lines"] = f"""
with x as (
  select doc_id, string_split(text, chr(10)) as ls from documents
), o as (
  select doc_id, unnest(range(len(ls))) as line, unnest(ls) as s from x
), solid as (
  select * from o where length(translate(s, concat({_BLANK}), '')) > 0
), f as (
  select s, min({{'d': doc_id, 'n': line}}) as fst, length(s) as z from solid group by s
), k as (
  select s, fst, z, z as m, 'P' as part, left(s, z // 2) as t from f where z > 1 union all
  select s, fst, z, z, 'S', right(s, z // 2) from f where z > 1 union all
  select s, fst, z, z - 1, 'P', left(s, (z - 1) // 2) from f where z > 2 union all
  select s, fst, z, z - 1, 'S', right(s, (z - 1) // 2) from f where z > 2
), c as (
  select distinct a.s as a, b.s as b, a.z as za, b.z as zb, b.fst < a.fst as later from k a join k b on a.m = b.m and a.part = b.part and a.t = b.t and a.s <> b.s and a.m = least(a.z, b.z) and a.z <= b.z
), one as (
  select a, b, later from c where case when za = zb then len(list_filter(range(1, za + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1
    else list_bool_or(list_transform(range(0, zb), lambda i: left(b, i) || substr(b, i + 2) = a)) end
), near as (
  select case when later then a else b end as s from one group by 1
), gone as (
  select doc_id, list(line order by line) as ns from solid join f using (s) left join near using (s) where near.s is not null or {{'d': doc_id, 'n': line}} <> f.fst group by doc_id
)
select x.doc_id, coalesce(cast(len(ls) as bigint), 0) as n_lines, coalesce(cast(len(ns) as bigint), 0) as n_removed, coalesce(array_to_string(ns, ','), '') as removed from x left join gone using (doc_id)"""


SQL["op11_lexical"] = rf"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), w as (
  select row, translate(unnest(ws), '{urlfilter._UPPER}', '{urlfilter._LOWER}') as t from d
), f as (
  select row, t, count(*) as tf from w group by all
), n as (
  select row, cast(sum(tf) as bigint) as n from f group by row
), s as (
  select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as len from n
), df as (
  select t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from f, s group by t
), i as (
  select distinct item_id, text from benchmark where text is not null
), it as (
  select distinct item_id, text, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), '{urlfilter._UPPER}', '{urlfilter._LOWER}') as t from i
), r as (
  select item_id, text, f.row, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len)))) as bigint) as score
  from it join df using (t) join f using (t) join n using (row), s group by all
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from r join d using (row) where score > 0
) where rank <= 10"""

#: CRC-32, byte by byte and bit by bit: no SQL function has it.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL["op13_convtrie"] = f"""
with t as (
  select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), p as (
  select c, role, text, row_number() over (partition by c order by turn nulls first, sha256(length(role) || ':' || role || text)) as pos from t
), ids as (
  select c, c - c % 100 as base, n, h, least(h, (select count(*) from p where p.c = i.c - i.c % 100)) as taken
  from (select c, n, {_CRC32} % 6 as h from (select c, count(*) as n from p group by c)) i
), turns as (
  select ids.c, p.pos as d, role, text from ids join p on p.c = ids.base and p.pos <= h
  union all select ids.c, taken + p.pos - h, role, text from ids join p on p.c = ids.c and p.pos > h
), paths as (
  select c, d, text, list({{'r': role, 't': text}}) over (partition by c order by d) as k from turns
  union all select c, 0, '', [] from ids
), last as (
  select c, max(d) as n from paths group by c
), nodes as (
  select d, k, min(c) as conv_id, count(*) as n_convs, any_value(text) as text, string_agg(case when n = d then c::varchar end, ',' order by c) as ends from paths join last using (c) group by d, k
), m as (
  select paths.c, paths.d, nodes.conv_id from paths join nodes on nodes.d = paths.d and nodes.k = paths.k
), up as (
  select nodes.*, m.conv_id as parent from nodes left join m on m.c = nodes.conv_id and m.d = nodes.d - 1
), kids as (
  select parent, d - 1 as d, count(*) as n from up where d > 0 group by all
), full_nodes as (
  select up.*, coalesce(kids.n, 0) as n_children from up left join kids on kids.parent = up.conv_id and kids.d = up.d
), below as (
  select m.conv_id, m.d, sum((b.n_children = 0)::bigint) as n_leaves, sum((b.n_convs - 1) * length(b.text)) as saved from full_nodes b join m on m.c = b.conv_id and m.d <= b.d group by all
)
select f.conv_id, cast(f.d as bigint) as depth, parent as parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from full_nodes f join below on below.conv_id = f.conv_id and below.d = f.d"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
