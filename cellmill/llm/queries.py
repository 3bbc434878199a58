"""The queries opN_<name> over whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, table

TOKENIZER = "piece_bpe_32k.model"
#: (host, path, verdict) of the fixed rules, and what the method lists itself.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Sites that the method lists under each domain, and whose pages it lists one by one.
SITES, DOMAINS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"), ("example.com", "example.org", "example.net")

#: No source is repeated more often.
REPETITION = 2.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A user's turn asks for a reply; the assistant's next turn is its result.
REPLY = {"reply": {"properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}


@query
def op1_chat_format(spark, sf_dir):
    from .chat_format import link_tools

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ident = lambda back: F.concat_ws(":", F.col("conv_id"), F.col("turn") - back)
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    messages = turns.withColumns({
        "call_id": F.when(user, ident(0)), "name": F.when(user, F.lit("reply")), "arguments": F.when(user, F.to_json(F.struct("turn", F.col("text").alias("prompt")))),
        "result_of": F.when(answer, ident(1)), "after": F.when(user, ident(2)),
    })
    out = link_tools(messages, REPLY)
    return out.select("conv_id", "turn", "status", "linked", "depth", F.array_join("errors", "; ").alias("errors"), F.length("json").cast("long").alias("json_chars"), F.sha2("json", 256).alias("json_sha256"))


SQL["op1_chat_format"] = r"""
with recursive m as (
  select conv_id, turn, role, coalesce(text, '') as content, text, role = 'user' as is_call, role = 'assistant' as is_result from conversations),
calls as (select conv_id, turn, count(*) as n from m where is_call group by all),
results as (select conv_id, turn - 1 as turn, count(*) as n from m where is_result group by all),
nodes as (
  select 'c' as kind, c.conv_id, c.turn, c.n, r.n is not null as linked,
    case when exists (select 1 from results x where x.conv_id = c.conv_id and x.turn = c.turn - 2) and exists (select 1 from calls x where x.conv_id = c.conv_id and x.turn = c.turn - 2) then 'r'
      when exists (select 1 from calls x where x.conv_id = c.conv_id and x.turn = c.turn - 2) then 'c' end as up_kind, c.turn - 2 as up_turn
  from calls c left join results r using (conv_id, turn)
  union all
  select 'r', r.conv_id, r.turn, r.n, c.n is not null, case when c.n is not null then 'c' end, r.turn
  from results r left join calls c using (conv_id, turn)),
tree as (
  select kind, conv_id, turn, 0 as depth from nodes where up_kind is null
  union all
  select n.kind, n.conv_id, n.turn, t.depth + 1 from nodes n join tree t on n.conv_id = t.conv_id and n.up_kind = t.kind and n.up_turn = t.turn)
select m.conv_id, m.turn,
  case when n.kind is null then 'plain' when n.n > 1 then 'repeated' when n.linked then 'linked' when is_call then 'open' else 'orphan' end as status,
  coalesce(n.linked, false) as linked, case when n.kind is null then 0 else t.depth end::bigint as depth,
  case when not is_call or (text is not null and length(text) between 1 and 300) then '' when text is null then 'prompt: missing' when length(text) = 0 then 'prompt: too short' else 'prompt: too long' end as errors,
  length(j)::bigint as json_chars, sha256(j) as json_sha256
from (
  select *, case when is_call then json_object('content', content, 'role', role, 'tool_calls', json_array(json_object('arguments', json_object('prompt', text, 'turn', turn), 'id', conv_id || ':' || turn, 'name', 'reply')))
    when is_result then json_object('content', content, 'role', role, 'tool_call_id', conv_id || ':' || (turn - 1))
    else json_object('content', content, 'role', role) end::varchar as j from m) m
left join nodes n on n.conv_id = m.conv_id and ((is_call and n.kind = 'c' and n.turn = m.turn) or (is_result and n.kind = 'r' and n.turn = m.turn - 1))
left join tree t on t.kind = n.kind and t.conv_id = n.conv_id and t.turn = n.turn"""


@query
def op2_mix_sources(spark, sf_dir):
    from .mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, repetition=REPETITION).select("doc_id", "source", "tokens", "epoch", "block_order", "doc_order")


def mixing_sql(docs: str) -> str:
    """Rows of the mixing of a relation with doc_id, source and text."""
    h = "('0x' || substr(md5({}), 1, 15))::bigint"
    return rf"""
with d as (select doc_id, source, (octet_length(encode(coalesce(text, ''))) + 3) // 4 as tokens, {h.format("'1:' || doc_id")} as h from {docs}),
s as (select source, sum(tokens)::double as total, sum(tokens)::double / (select sum(tokens) from d) as p from d group by source),
a as (select min(k) / 4096.0::double as a from range(0, 4097) r(k) where pow((select max(p) / min(p) from s), (1 - k / 4096.0)::double) <= {REPETITION}),
t as (select source, total, pow((select max(p) from s) / p, 1 - a.a) as times, greatest(1, ceil(total / 1048576))::bigint as blocks from s, a),
c as (
  select d.*, blocks, floor(times)::bigint as passes, (times - floor(times)) * total as rest,
    coalesce(sum(tokens) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source),
e as (select *, unnest(generate_series(1, passes + (before < rest)::int)) as epoch from c)
select doc_id, source, tokens::bigint as tokens, epoch, {h.format("'1:' || coalesce(source, '') || ':' || (((h >> 30) * blocks) >> 30) || ':' || epoch")} as block_order,
  {h.format("'1:' || doc_id || ':' || epoch")} as doc_order
from e"""


SQL["op2_mix_sources"] = mixing_sql("documents")


@query
def op3_license_scan(spark, sf_dir):
    from .license_scan import license_scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op4_near_dedup(spark, sf_dir):
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


@query
def op5_decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op5_decontaminate"] = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
iw as (
  select distinct item_id, size, array_to_string(w[p:p + size - 1], ' ') as win
  from (select item_id, w, least(13, len(w)) as size, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as p from i where len(w) > 0)),
sizes as (select distinct size from iw),
dw as (
  select doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as p from d, sizes where len(w) >= size)),
m as (select doc_id, dw.size, p, item_id from dw join iw on dw.size = iw.size and dw.win = iw.win),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(generate_series(p, p + size - 1)) as q from m) group by doc_id),
n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from m group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join n using (doc_id)"""


@query
def op6_token_count(spark, sf_dir):
    from .token_count import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op7_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_quality(spark, sf_dir):
    from .quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op9_url_filter(spark, sf_dir):
    from .url_filter import canonical_host, canonical_path, host_of, path_of, url_filter

    entries = spark.createDataFrame([(*r, True, False) for r in RULES] + [(f"{s}.{d}", "", "block", False, False) for s in SITES for d in DOMAINS], "host string, path string, verdict string, named boolean, exact boolean")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # the pages of listed sites, as a crawl's own list of URLs; it grows with the crawl
    seen = pages.select(canonical_host(host_of(F.col("url"))).alias("host"), canonical_path(path_of(F.col("url"))).alias("path")).filter(F.col("host").rlike(rf"(^|[.])({'|'.join(SITES)})[.]"))
    seen = seen.distinct().select("host", "path", F.lit("block").alias("verdict"), F.lit(False).alias("named"), F.lit(True).alias("exact"))
    return url_filter(pages, entries.unionByName(seen)).select("page_id", "host", "path", "rule", "verdict")


def _values(rows) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rows)


_FITS = "(u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)"
_CANONICAL = "regexp_replace(regexp_replace(host, '^[^@]*@', ''), '[.]*(:(80|443)?)?$', '')"
SQL["op9_url_filter"] = rf"""
with rules(host, path, verdict) as (values {_values(RULES)}),
sites(site) as (values {', '.join(f"('{s}.{d}')" for s in SITES for d in DOMAINS)}),
u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
c as (select distinct host, {_CANONICAL} as own from u),
b as (select host from c where exists (select 1 from sites where own = site or ends_with(own, '.' || site)) or regexp_matches(own, '(^|[.])({'|'.join(SITES)})[.]'))
select page_id, host, path,
  (select max_by(r.host || r.path, length(r.host || r.path)) from rules r where {_FITS}) as rule,
  coalesce((select max_by(r.verdict, length(r.host || r.path)) from rules r where {_FITS}), case when host in (select host from b) then 'block' else 'allow' end) as verdict
from u"""


@query
def op10_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op10_exact_dedup"] = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm)::bigint as group_size,
  row_number() over (partition by norm order by doc_id) = 1 as kept, sha256(norm) as text_sha256
from n"""
