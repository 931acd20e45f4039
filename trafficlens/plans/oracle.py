"""The same results in SQL, for checking every registered query against another engine on the same tables."""

from __future__ import annotations

from functools import reduce

from trafficlens.functions import text as T
from trafficlens.functions.vectors import DIM, PLANES, SEED, hyperplanes
from trafficlens.sources import dims
from trafficlens.sources import fixtures as X

AS_OF = "2024-01-31 00:00:00"
DAY_US = 86_400_000_000
K = "cast(json_extract_string(props, '$.k') as int)"


def _s(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_s(v) for v in values) + "]" if values else "cast([] as varchar[])"


def _pick(values, index: str) -> str:
    return f"{_list(values)}[({index} + 1)::int]"


PRICING = "pricing(model, provider, price_in, price_out) as (select * from (values " + ", ".join(
    f"({_s(m)}, {_s(p)}, cast({i} as decimal(12,6)), cast({o} as decimal(12,6)))" for m, p, i, o in dims.PRICING) + "))"
ALIASES = "aliases(alias, primary_model, chain) as (select * from (values " + ", ".join(
    f"({_s(a)}, {_s(p)}, {_list(c)})" for a, p, c in dims.ALIASES) + "))"
KEYS = "keys(key_id, key_value, tenant, allowed, rpm, budget, spend, active) as (select * from (values " + ", ".join(
    f"({i}::bigint, {_s(v)}, {_s(a)}, {_list(m)}, {r}, {b}::decimal(18,6), 0::decimal(18,6), {str(on).lower()})"
    for i, v, a, m, r, b, on in dims.KEYS) + "))"
ERRORS = "errors(error_code, http_status, exception_name) as (select * from (values " + ", ".join(
    f"({_s(c)}, {s}, {_s(e)})" for c, s, e in dims.ERROR_CODES) + "))"
LABELLED = "labelled(n, prompt, expected_tier, trap) as (select * from (values " + ", ".join(
    f"({i}, {_s(p)}, {_s(t)}, {_s(w)})" for i, (p, t, w) in enumerate(X.LABELLED_PROMPTS)) + "))"


def cost(pt: str, ct: str) -> str:
    return (f"cast(({pt}::decimal(10,0) * price_in + {ct}::decimal(10,0) * price_out)"
            " * 0.001::decimal(4,3) as decimal(18,6))")


USAGE = PRICING + f""",
usage_base as (
  select event_id as usage_id, ts as created_at, user_id % 10 as virtual_key_id,
    {_pick(X.NAME_BY_EVENT, 'event_id % 8')} as requested_model,
    {_pick(X.MODEL_BY_EVENT, 'event_id % 4')} as resolved_model,
    case when event_type = 'error' then 'ERROR:ProviderUnavailableException' else 'SUCCESS' end as status,
    event_type = 'view' as cache_hit,
    event_type = 'error' or (event_type = 'signup' and {K} % 2 = 0) as fallback_used,
    case when event_type <> 'error' then 10 + 7 * {K} end as prompt_tokens,
    case when event_type <> 'error' then cast(1 + floor(value) as int) end as completion_tokens,
    cast(floor(value * 10) as bigint) as latency_ms
  from events),
usage as (
  select b.*, case when status <> 'SUCCESS' then null when cache_hit then 'cache' else p.provider end as provider,
    case when cache_hit then 0::decimal(18,6) else {cost('prompt_tokens', 'completion_tokens')} end as cost_usd
  from usage_base b left join pricing p on b.resolved_model = p.model)"""

REQUESTS = LABELLED + f""",
requests as (
  select event_id as request_id, ts, event_type, value, {_pick(X.KEY_BY_USER, 'user_id % 7')} as credential,
    {_pick(X.NAME_BY_EVENT, 'event_id % 8')} as model, prompt, expected_tier, trap,
    case when event_id % 17 = 0 then 2.5::double when event_id % 17 <> 1 then 0.5::double end as temperature,
    case when {K} % 3 <> 0 then 10 * {K} end as max_tokens, event_id % 3 = 0 as stream
  from events join labelled on labelled.n = event_id % 11)"""


def _hits(lower: str, needles) -> str:
    return "(" + " + ".join(f"contains({lower}, {_s(n)})::int" for n in needles) + ")"


def signals(text: str) -> dict[str, str]:
    low = f"lower({text})"
    words = f"greatest(1, len(string_split_regex(regexp_replace({low}, '\\s+$', ''), '\\s+')))"
    return {
        "keyword_signal": f"least(1.0::double, {_hits(low, T.HARD_KEYWORDS)} / 2.0::double)",
        "code_signal": f"case when regexp_matches({text}, {_s(T.CODE_OR_MATH)}) then 1.0::double else 0.0::double end",
        "step_signal": "least(1.0::double, case when length({0}) - length(replace({0}, '?', '')) > 1 then 0.5::double"
                       " else 0.0::double end + ".format(text) + _hits(low, T.STEP_PHRASES) + " * 0.5::double)",
        "lexical_signal": f"least(1.0::double, greatest(0.0::double, (length(replace({low}, ' ', ''))::double"
                          f" / {words} - 4.0::double) / 4.0::double))",
        "length_signal": f"least(1.0::double, {words} / 400.0::double)",
    }


def scored(source: str, text: str = "prompt") -> str:
    """CTEs ``sig`` and ``scored`` over a relation with a text column."""
    columns = ", ".join(f"{v} as {k}" for k, v in signals(text).items())
    total = " + ".join(f"{w}::double * {k}" for w, k in zip(T.WEIGHTS, signals(text)))
    return f"""sig as (select *, {columns} from {source}),
scored as (select *, least(1.0::double, {total}) as score,
  case when least(1.0::double, {total}) >= {T.SMART_AT}::double then 'smart' else 'fast' end as tier,
  case when len(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')) > {T.BASELINE_WORDS}
       then 'smart' else 'fast' end as baseline_tier from sig)"""


ROUTED = ", ".join([KEYS, ALIASES, REQUESTS]) + f""",
{scored('labelled')},
authed as (
  select r.*, k.key_id, k.tenant, k.allowed, k.rpm, k.budget,
    case when k.key_id is null then 'INVALID_VIRTUAL_KEY' end as auth_error,
    case when r.credential = '' then 'no key was sent' when k.key_id is null then 'key is unknown or revoked'
    end as auth_message
  from requests r left join keys k on k.active and k.key_value = r.credential),
allowed_requests as (
  select *, case when not (allowed is null or len(allowed) = 0 or list_contains(allowed, model))
    then 'MODEL_NOT_ALLOWED' end as allow_error from authed),
routed as (
  select a.*, lower(a.model) = 'auto' as auto_routed, coalesce(al.primary_model, p.model) as primary_model,
    coalesce(al.chain, case when p.model is not null then cast([] as varchar[]) end) as chain,
    case when coalesce(al.primary_model, p.model) is null then 'UNKNOWN_MODEL_ALIAS' end as route_error
  from allowed_requests a
  join scored s on s.n = a.request_id % 11
  left join aliases al on al.alias = case when lower(a.model) = 'auto' then s.tier else lower(a.model) end
  left join pricing p on p.model = a.model and lower(a.model) <> 'auto')"""

TURNS = """turns as (
  select conv_id * 100 + turn as id, 'team-' || (conv_id % 4) as tenant, role, text as prompt,
    timestamp '2024-01-01 00:00:00' + to_minutes(conv_id * 100 + turn) as ts from conversations)"""


def embedded(name: str, source: str, text: str = "prompt", dim: int = DIM) -> str:
    """CTE ``name``: every row of ``source`` with vec (whole-number weights times four) and norm."""
    return f"""{name}_tok as (select id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as t from {source}),
{name}_hash as (
  select t, length(t) as n, list_reduce(list_prepend(0, list_transform(string_split(t, ''), lambda c: ascii(c))),
    lambda h, c: (h * 31 + c) % {dim}) as h from (select distinct t from {name}_tok)),
{name}_slot as (
  select id, h as slot, 4 * count(*) as w from {name}_tok join {name}_hash using (t) group by all
  union all
  select id, (h * 31 + n) % {dim}, count(*) from {name}_tok join {name}_hash using (t) group by all),
{name}_sum as (select id, slot, sum(w)::double as w from {name}_slot group by all),
{name}_vec as (
  select s.id, list(coalesce(w, 0.0::double) order by r.slot) as vec
  from (select id from {source}) s cross join (select unnest(range({dim})) as slot) r
  left join {name}_sum w on w.id = s.id and w.slot = r.slot group by s.id),
{name} as (select s.*, v.vec, sqrt(list_inner_product(v.vec, v.vec)) as norm from {source} s join {name}_vec v using (id))"""


VECTORS = """vectors as (
  select vec_id as id, 'label-' || label as tenant, cast(embedding as double[]) as vec,
    sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as norm from embeddings)"""
COSINE = ("case when q.norm = 0 or e.norm = 0 then 0.0::double else list_inner_product(q.vec, e.vec)"
          " / (q.norm * e.norm) end")


def grouped(name: str, source: str) -> str:
    return (f"{name} as (select tenant, vec, any_value(norm) as norm, min(id) as gid, count(*) as copies"
            f" from {source} group by tenant, vec)")


def signature(vec: str, dim: int, planes: int = PLANES, table: int = 0) -> str:
    bits = [f"(case when list_inner_product({vec}, {p}::double[]) >= 0 then {1 << i} else 0 end)"
            for i, p in enumerate(hyperplanes(dim, planes, SEED + table))]
    return "(" + " + ".join(bits) + ")"


def signatures(vec: str, dim: int, planes: int, tables: int) -> str:
    return "[" + ", ".join(signature(vec, dim, planes, t) for t in range(tables)) + "]"


#: two vectors share a bucket of some table, or differ in one bit of it
MEET = "len(list_filter(list_zip(q.sigs, e.sigs), lambda s: bit_count(xor(s[1], s[2])) <= 1)) > 0"


# -- one statement per query -------------------------------------------------------------------------------------------

SQL: dict[str, str] = {}


def _q(name: str, ctes: str | list[str], body: str, recursive: bool = False) -> None:
    ctes = ctes if isinstance(ctes, str) else ", ".join(ctes)
    SQL[name] = (f"with {'recursive ' if recursive else ''}{ctes} " if ctes else "") + body


_q("load_pricing", USAGE, """select p.model, p.provider, price_in, price_out, count(*) as requests
  from pricing p join usage u on u.resolved_model = p.model group by all""")
_q("load_aliases", [ALIASES, REQUESTS], """select alias, primary_model, m as fallback_model, count(*) as requests
  from (select alias, primary_model, unnest(chain) as m from aliases) a join requests r on lower(r.model) = a.alias
  group by all""")
_q("load_keys", [KEYS, REQUESTS], """select key_id, tenant, allowed_model, rpm, budget, count(*) as requests
  from (select key_id, key_value, tenant, unnest(allowed) as allowed_model, rpm, budget from keys) k
  join requests r on r.credential = k.key_value and r.model = k.allowed_model group by all""")

_WIRE = f"""wire as (select *, case when usage_id % 97 = 0 then 'cost' when usage_id % 89 = 1 then 'time'
  when usage_id % 83 = 2 then 'json' end as fault, usage_id % 10 = 3 as no_cost, usage_id % 10 = 7 as no_time from usage)"""
_q("ingest_usage", [USAGE, _WIRE], f"""select usage_id, virtual_key_id, requested_model, resolved_model, provider, status,
  prompt_tokens, completion_tokens,
  case when no_cost then 0::decimal(18,6) else coalesce(cost_usd, 0::decimal(18,6)) end as cost_usd,
  cache_hit, fallback_used, latency_ms,
  case when no_time then timestamp '{AS_OF}' else created_at end as created_at from wire where fault is null""")
_q("ingest_usage_quarantine", [USAGE, _WIRE], "select usage_id, fault from wire where fault is not null")
_q("ingest_usage_stream", USAGE, """select side, virtual_key_id, provider, count(*) as requests,
  coalesce(sum(cost_usd), 0)::decimal(18,6) as cost_usd, max(created_at) as newest
  from usage cross join (values ('local'), ('central')) s(side) group by all""")
_q("seed_missing", "", """with known as (select distinct user_id from events),
existing as (select user_id, user_id % 5 <> 0 as active from known where user_id % 3 <> 0)
select 'vk-' || user_id as key_value, 'tenant-' || (user_id % 10) as tenant, active, (user_id * 0.5)::decimal(18,6) as spend
from existing
union all
select 'vk-' || user_id, 'tenant-' || (user_id % 10), true, 0::decimal(18,6) from known k
where not exists (select 1 from existing e where e.user_id = k.user_id and e.active)""")
_q("store_entries", [TURNS, "src as (select * from turns where role = 'user')", embedded("v", "src")],
   """select id, tenant, 'swift-s' as model, timestamp '2024-01-31 00:00:00' as created_at,
  timestamp '2024-01-31 01:00:00' as expires_at, len(list_filter(vec, lambda x: x <> 0)) as slots,
  list_sum(vec)::double as weight, cast(list_inner_product(vec, vec) as bigint) as norm2 from v""")
_q("import_vectors", "", """select vec_id as id, vec_id % 50 <> 0 as accepted,
  case when vec_id % 50 <> 0 then round(list_sum(cast(embedding as double[])), 6) end as total,
  case when vec_id % 50 <> 0 then round(embedding[1]::double, 6) end as first,
  case when vec_id % 50 <> 0 then round(embedding[64]::double, 6) end as last from embeddings""")
_q("export_vectors", "", """select vec_id as id, len(embedding)::int as dims,
  round(list_sum(cast(embedding as double[])), 6) as total from embeddings""")
_STAMPED = "stamped as (select id, tenant, ts as created_at, ts + to_minutes(1440) as expires_at from turns where role = 'user')"
_q("live_entries", [TURNS, _STAMPED],
   "select id, tenant, created_at, expires_at from stamped where expires_at > timestamp '2024-01-04 00:00:00'")
_q("evict_expired", [TURNS, _STAMPED], """select count(*) filter (expires_at <= timestamp '2024-01-04 00:00:00') as removed,
  count(*) filter (expires_at > timestamp '2024-01-04 00:00:00') as kept, min(id) filter
  (expires_at > timestamp '2024-01-04 00:00:00') as first_kept from stamped""")
_q("evict_folders", [TURNS, _STAMPED], """select cast(expires_at as date) as expires_on, count(*) as entries,
  min(id) as first_id, min(expires_at) as first_expiry from stamped
  where expires_at > timestamp '2024-01-04 12:00:00' group by 1""")
_BODIES = """bodies as (select request_id, case when request_id % 29 = 0 then '  ' else model end as model,
  stream, temperature, max_tokens, request_id % 23 = 0 as empty, request_id % 13 = 0 as no_role,
  request_id % 19 = 0 as no_content, prompt from requests)"""
_q("parse_requests", [REQUESTS, _BODIES], """select request_id, model, case when empty then 0 else 2 end as turns,
  case when not empty then case when no_role then '' else 'user' end end as last_role,
  case when not empty then case when no_content then ' ' || chr(9) else prompt end end as last_content,
  stream, temperature, coalesce(temperature, 0.7::double) as temperature_or_default, max_tokens,
  coalesce(max_tokens, 256) as completion_limit from bodies""")
_q("write_usage", USAGE, """select cast(created_at as date) as created_on, virtual_key_id, count(*) as requests,
  min(created_at) as first_at, max(created_at) as last_at, coalesce(sum(cost_usd), 0)::decimal(18,6) as cost_usd
  from usage group by all""")

_q("validate_requests", [REQUESTS, _BODIES], """select request_id, concat_ws('; ',
  case when model = '  ' then 'model: needs a name' end,
  case when empty then 'messages: needs a message' end,
  case when not empty and no_role then 'messages[1].role: needs a role' end,
  case when not empty and no_content then 'messages[1].content: needs some text' end,
  case when temperature > 2 then 'temperature: above 2' end) as violations from bodies""")
_q("estimate_tokens", "", """select conv_id as request_id, sum(greatest(1, length(text) // 4))::bigint as prompt_tokens
  from conversations group by all""")
_UNPRICED = f"""mixed as (select usage_id, case when usage_id % 5 = 4 then 'm-unknown' else resolved_model end as model,
  prompt_tokens, completion_tokens from usage where status = 'SUCCESS')"""
_q("price_usage", [USAGE, _UNPRICED], f"""select usage_id, m.model, p.provider as model_provider,
  prompt_tokens + completion_tokens as total_tokens, {cost('prompt_tokens', 'completion_tokens')} as cost_usd,
  case when p.model is null then 'UNKNOWN_MODEL_ALIAS' end as price_error from mixed m left join pricing p on p.model = m.model""")
_ESTIMATE = cost("greatest(1, length(prompt) // 4)", "coalesce(max_tokens, 256)")
_q("estimate_cost", [PRICING, ROUTED], f"""select request_id, r.primary_model, {_ESTIMATE} as estimate_usd
  from routed r join pricing p on p.model = r.primary_model""")
_CHARGES = f"""charges as (select u.usage_id, u.virtual_key_id, {cost('(10 + 7 * 40)', '50')} as estimate_usd, cost_usd,
  status <> 'SUCCESS' as failed from usage u join pricing p on p.model = u.resolved_model)"""
_q("true_up", [USAGE, _CHARGES], """select * from (select usage_id, virtual_key_id, estimate_usd,
  (case when failed then -estimate_usd else cost_usd - estimate_usd end)::decimal(18,6) as delta_usd,
  case when failed then false else cost_usd > estimate_usd end as over_estimate from charges) where delta_usd <> 0""")
_q("render_prompt", "", """select conv_id as request_id, string_agg(role || ': ' || text || chr(10), '' order by turn) as prompt
  from conversations group by all""")
_q("user_text", "", """select conv_id as request_id, case when count(*) filter (lower(role) = 'user') > 0
  then string_agg(text || ' ', '' order by turn) filter (lower(role) = 'user') else max_by(text, turn) end as user_text
  from conversations group by all""")
_SIGNALS = "keyword_signal, code_signal, step_signal, round(lexical_signal, 9) as lexical_signal, length_signal"
_q("difficulty_features", scored("pages", "html"), f"select page_id, {_SIGNALS} from scored")
_q("difficulty_score", [scored("docs", "text")], "select doc_id, round(score, 9) as score, tier from scored")
SQL["difficulty_score"] = SQL["difficulty_score"].replace("with sig", "with docs as (select doc_id, text from documents), sig")
_q("length_baseline", scored("conversations", "text"), """select conv_id, turn, baseline_tier from scored""")
_q("parse_status", [USAGE, ERRORS], """select usage_id, case when status like 'ERROR%' then 'ERROR' else status end as outcome,
  case when status like 'ERROR%' then split_part(status, ':', 2) end as error_name, error_code
  from usage left join errors on status like 'ERROR%' and exception_name = split_part(status, ':', 2)""")
_q("served_by", USAGE, """select virtual_key_id, provider, case when cache_hit then 'HIT' else 'MISS' end as cache,
  fallback_used, count(*) as requests, coalesce(sum(cost_usd), 0)::decimal(18,6) as cost_usd from usage group by all""")
_q("export_usage_events", USAGE, """select virtual_key_id, status, coalesce(provider, 'none') as provider, count(*) as events,
  sum(coalesce(cost_usd, 0))::decimal(18,6) as cost_usd, max(created_at) as newest from usage group by all""")

_q("authenticate", [PRICING, ROUTED], "select request_id, credential, key_id, tenant, auth_error, auth_message from authed")
_q("check_allowlist", [PRICING, ROUTED],
   "select request_id, tenant, model, allow_error from allowed_requests where auth_error is null")
_q("resolve_route", [PRICING, ROUTED], """select request_id, model, auto_routed, primary_model,
  array_to_string(chain, ',') as chain, route_error from routed""")
_q("expand_chain", [PRICING, ROUTED], """select request_id, generate_subscripts(full_chain, 1)::int - 1 as position,
  unnest(full_chain) as model from (select request_id, list_prepend(primary_model, chain) as full_chain from routed
  where primary_model is not null)""")
_SERVED = """steps as (select request_id, generate_subscripts(full_chain, 1)::int - 1 as position, unnest(full_chain) as model
  from (select request_id, list_prepend(primary_model, chain) as full_chain from routed where primary_model is not null)),
served as (select request_id, min(position) as position, min_by(s.model, position) as served_model,
  min_by(p.provider, position) as served_provider from steps s join pricing p on p.model = s.model
  where p.provider <> 'DOWN' group by request_id)"""
_q("route_around_outage", [PRICING, ROUTED, _SERVED.replace("DOWN", "north")],
   """select r.request_id, r.primary_model, served_model, served_provider, position > 0 as fallback_used,
  case when r.primary_model is not null and served_model is null then 'ALL_PROVIDERS_EXHAUSTED' end as dispatch_error
  from routed r left join served s using (request_id)""")
_q("provider_of", USAGE, """select usage_id, resolved_model as model, p.provider from usage u
  join pricing p on p.model = u.resolved_model""")

_SINCE = f"created_at >= timestamp '{AS_OF}' - interval 7 day"
_q("key_cost_since", USAGE, f"""select virtual_key_id, coalesce(sum(cost_usd), 0)::decimal(18,6) as total_cost_usd
  from usage where {_SINCE} group by all""")
_q("key_requests_since", USAGE, f"select virtual_key_id, count(*) as total_requests from usage where {_SINCE} group by all")
_q("key_cache_hits_since", USAGE, f"""select virtual_key_id, count(*) filter (cache_hit) as cache_hits
  from usage where {_SINCE} group by all""")
_q("usage_summary", [USAGE, KEYS], f"""select key_id, tenant, 30 as window_days, count(usage_id) as total_requests,
  coalesce(sum(cost_usd), 0)::decimal(18,6) as total_cost_usd, count(*) filter (cache_hit) as cache_hits,
  case when count(usage_id) = 0 then 0.0::double else count(*) filter (cache_hit) / count(usage_id) end as cache_hit_rate,
  budget, spend from keys left join (select * from usage where created_at >= timestamp '{AS_OF}' - interval 30 day) u
  on u.virtual_key_id = key_id group by key_id, tenant, budget, spend""")
_BREAKDOWN = f"""breakdown as (select provider, count(*) as request_count, coalesce(sum(cost_usd), 0)::decimal(18,6)
  as total_cost_usd, avg(latency_ms) as avg_latency_ms from usage where provider is not null and {_SINCE} group by provider)"""
_q("provider_breakdown", [USAGE, _BREAKDOWN], "select * from breakdown")
_q("top_providers", [USAGE, _BREAKDOWN], "select * from breakdown order by request_count desc, provider limit 2")
_q("total_spend_since", USAGE, f"select coalesce(sum(cost_usd), 0)::decimal(18,6) as total_spend_usd from usage where {_SINCE}")
_q("fallback_count_since", USAGE, f"select count(*) filter (fallback_used) as fallback_count from usage where {_SINCE}")
_q("usage_report", [USAGE, _BREAKDOWN], f"""select 7 as window_days, t.*,
  (row_number() over (order by request_count desc, provider))::int - 1 as position, breakdown.* from breakdown,
  (select coalesce(sum(cost_usd), 0)::decimal(18,6) as total_spend_usd, count(*) filter (fallback_used) as fallback_count
   from usage where {_SINCE}) t""")
_q("latency_percentiles", USAGE, """select provider, count(*) as n,
  (list(latency_ms order by latency_ms))[least(count(*) - 1, floor(count(*) * 0.5::double)::bigint) + 1] as p50,
  (list(latency_ms order by latency_ms))[least(count(*) - 1, floor(count(*) * 0.95::double)::bigint) + 1] as p95,
  (list(latency_ms order by latency_ms))[least(count(*) - 1, floor(count(*) * 0.99::double)::bigint) + 1] as p99,
  round(sum(latency_ms) / count(*), 1) as mean from usage group by provider""")
_q("latency_percentiles_overall", USAGE, """select count(*) as n,
  (list(latency_ms order by latency_ms))[least(count(*) - 1, floor(count(*) * 0.5::double)::bigint) + 1] as p50,
  (list(latency_ms order by latency_ms))[least(count(*) - 1, floor(count(*) * 0.95::double)::bigint) + 1] as p95,
  (list(latency_ms order by latency_ms))[least(count(*) - 1, floor(count(*) * 0.99::double)::bigint) + 1] as p99,
  round(sum(latency_ms) / count(*), 1) as mean from usage""")
_q("sorted_latencies", USAGE, "select usage_id, latency_ms from usage order by latency_ms, usage_id")
_q("routing_accuracy", [REQUESTS, scored("requests")], """select trap, count(*) as n,
  avg((tier = expected_tier)::int::double) as accuracy, avg((baseline_tier = expected_tier)::int::double) as baseline_accuracy,
  sum((tier = expected_tier)::int) > sum((baseline_tier = expected_tier)::int) as beats_baseline from scored group by trap""")
_q("recent_requests", USAGE, """select virtual_key_id, usage_id, created_at, resolved_model, status, cost_usd, rank::int as rank,
  total_requests from (select *, row_number() over (partition by virtual_key_id order by created_at desc, usage_id desc) as rank,
  count(*) over (partition by virtual_key_id) as total_requests from usage) where rank between 26 and 50""")

# -- folds ---


def rate_ctes(rows: str, window_us: int) -> str:
    """``rows``: relation (k, id, us, cap). CTE ``rate``: k, id, admitted, retry_after_ms."""
    w = window_us
    return f"""rate_rows as (select *, row_number() over (partition by k order by us, id) as rn from {rows}),
rate as (
  select k, rn, id, us, cap, cap >= 1 as admitted, (cap::bigint * {w} - case when cap >= 1 then {w} else 0 end)::bigint as units,
    null::bigint as retry_after_ms from rate_rows where rn = 1
  union all
  select k, rn, id, us, cap, x >= {w}, (case when x >= {w} then x - {w} else x end)::bigint,
    case when x < {w} then (({w} - x) // (cap * 1000))::bigint end
  from (select r.k, r.rn, r.id, r.us, r.cap, least(r.cap::bigint * {w}, f.units + r.cap::bigint * (r.us - f.us)) as x
        from rate f join rate_rows r on r.k = f.k and r.rn = f.rn + 1))"""


def spend_ctes(rows: str) -> str:
    """``rows``: relation (k, o, id, amount, guarded, budget). CTE ``spend``: k, id, admitted, spend."""
    return f"""spend_rows as (select *, row_number() over (partition by k order by o, id) as rn from {rows}),
spend as (
  select k, rn, id, o, not guarded or amount <= budget as admitted,
    (case when not guarded or amount <= budget then amount else 0 end)::decimal(18,6) as spend from spend_rows where rn = 1
  union all
  select r.k, r.rn, r.id, r.o, not r.guarded or f.spend + r.amount <= r.budget,
    (case when not r.guarded or f.spend + r.amount <= r.budget then f.spend + r.amount else f.spend end)::decimal(18,6)
  from spend f join spend_rows r on r.k = f.k and r.rn = f.rn + 1)"""


_RATE_IN = "rate_in as (select event_type as k, event_id as id, epoch_us(ts) as us, 20 as cap from events)"
_q("rate_limit", [_RATE_IN, rate_ctes("rate_in", DAY_US)],
   "select k as event_type, id as event_id, admitted from rate", True)
_q("retry_after", [_RATE_IN, rate_ctes("rate_in", DAY_US)],
   "select k as event_type, id as event_id, retry_after_ms from rate where not admitted", True)
_q("rate_limit_changing", [_RATE_IN.replace("20 as cap", "12 + (event_id // 500) % 3 * 6 as cap"), rate_ctes("rate_in", DAY_US)],
   "select k as event_type, id as event_id, admitted, retry_after_ms from rate", True)
_SPEND_IN = """spend_in as (select user_id as k, ts as o, event_id as id, value::decimal(12,2)::decimal(18,6) as amount,
  true as guarded, 500::decimal(18,6) as budget from events)"""
_q("budget_admit", [_SPEND_IN, spend_ctes("spend_in")], "select k as user_id, id as event_id, admitted, spend from spend", True)
_q("budget_changing", [_SPEND_IN.replace("500::decimal(18,6)", "(300 + (event_id // 500) % 3 * 150)::decimal(18,6)"), spend_ctes("spend_in")],
   "select k as user_id, id as event_id, admitted, spend from spend", True)
_LEDGER_IN = f"""spend_in as (
  select user_id as k, ts as o, event_id * 2 as id, value::decimal(12,2)::decimal(18,6) as amount, true as guarded,
    500::decimal(18,6) as budget from events
  union all
  select user_id, ts, event_id * 2 + 1, (case when event_type = 'error' then -value::decimal(12,2)
    else ({K} - 50) * 0.05::decimal(3,2) end)::decimal(18,6), false, 500::decimal(18,6) from events
    where event_type in ('error', 'purchase'))"""
_q("spend_ledger", [_LEDGER_IN, spend_ctes("spend_in")],
   "select k as user_id, id as entry_id, admitted, spend from spend", True)
_BREAKER = """br as (select user_id % 2 as k, event_id as id, epoch_us(ts) as us, event_type = 'error' as failed,
  row_number() over (partition by user_id % 2 order by ts, event_id) as rn from events),
step as (
  select k, rn, id, us, true as allowed, (case when failed then 1 else 0 end) as fails, null::bigint as opened from br where rn = 1
  union all
  select k, rn, id, us, not refused, case when refused then fails when failed then fails + 1 else 0 end,
    case when refused then opened when failed and (opened is not null or fails + 1 >= 3) then us end
  from (select r.k, r.rn, r.id, r.us, r.failed, s.fails, s.opened,
          s.opened is not null and r.us - s.opened < 3600000000 as refused
        from step s join br r on r.k = s.k and r.rn = s.rn + 1))"""
_q("breaker_replay", _BREAKER, """select k as provider, id as event_id, allowed,
  case when opened is null then 'CLOSED' else 'OPEN' end as state_after from step""", True)
_q("breaker_dispatch", [PRICING, ROUTED, _BREAKER, """openings as (select case when k = 0 then 'north' else 'harbor' end
  as provider, us as opened_at from step where opened = us),
moves as (select request_id, epoch_us(ts) as us, generate_subscripts(full_chain, 1)::int - 1 as position,
    unnest(full_chain) as model
  from (select request_id, ts, list_prepend(primary_model, chain) as full_chain from routed where primary_model is not null)),
last_opening as (select m.*, p.provider, o.opened_at from moves m join pricing p on p.model = m.model
  asof left join openings o on o.provider = p.provider and o.opened_at <= m.us),
served as (select request_id, min(position) as position, min_by(model, position) as served_model,
  min_by(provider, position) as served_provider from last_opening
  where opened_at is null or us >= opened_at + 3600000000 group by request_id)"""],
   """select r.request_id, r.primary_model, served_model, served_provider, position > 0 as fallback_used,
  case when r.primary_model is not null and served_model is null then 'ALL_PROVIDERS_EXHAUSTED' end as dispatch_error
  from routed r left join served s using (request_id)""", True)
_ATTEMPTS = """att as (select event_id // 6 as request_id, ((event_id % 6) // 3)::int as position, (event_id % 3)::int as attempt,
  event_type <> 'error' and value < 20 as ok, event_id % 7 = 2 as slow, ts, (event_id // 6) % 3 = 0 as stream from events),
tried as (select * from (select *, coalesce(min(attempt) filter (ok or slow) over (partition by request_id, position), 2) as last from att)
  where attempt <= last),
kept as (select * from (select *, min(position) filter (ok) over (partition by request_id) as first_ok from tried)
  where first_ok is null or position <= first_ok)"""
_q("dispatch_outcome", _ATTEMPTS, """select request_id, (min(position * 3 + attempt) filter (ok) // 3)::int as position,
  (min(position * 3 + attempt) filter (ok) % 3)::int as attempt,
  coalesce(min(position * 3 + attempt) filter (ok) // 3 > 0, true) as fallback_used,
  case when count(*) filter (ok) > 0 then 'SUCCESS' else 'ALL_PROVIDERS_EXHAUSTED' end as outcome,
  sum(case when not ok and not slow and attempt < 2 then 200 << attempt else 0 end)::bigint as backoff_ms from kept group by request_id""")
_TOLD = """told as (select request_id, position, attempt, ok, ts from kept
  qualify attempt = max(attempt) over (partition by request_id, position)),
told_of as (select t.*, k.slow, k.stream from told t join kept k using (request_id, position, attempt)
  where k.ok or k.stream or not k.slow)"""
_q("breaker_events", [_ATTEMPTS, _TOLD, _BREAKER.replace("user_id % 2", "position").replace("event_id", "request_id * 2 + position")
                      .replace("event_type = 'error'", "not ok").replace("from events", "from told_of")],
   """select t.request_id, t.position, not t.ok as failed, s.allowed, case when s.opened is null then 'CLOSED' else 'OPEN' end as state_after
  from told_of t join step s on s.id = t.request_id * 2 + t.position""", True)
_q("over_admission_check", [_RATE_IN, rate_ctes("rate_in", DAY_US)], f"""select k as event_type,
  count(*) filter (admitted) as admitted, sum(case when admitted then value::decimal(12,2) else 0 end)::decimal(18,6) as spent,
  count(*) filter (admitted) <= 20 * 31 as within_allowance,
  sum(case when admitted then value::decimal(12,2) else 0 end) <= 1000000 as within_budget
  from rate join events on event_id = id group by k""", True)
_CHUNKED = """chunks as (select id, generate_subscripts(w, 1)::int - 1 as position, unnest(w) as word, len(w) as n,
  pt, ct from (select id, string_split(regexp_replace(prompt, ' +$', ''), ' ') as w, length(prompt) as pt, len(
  string_split(prompt, ' '))::int as ct from turns where role = 'assistant'))"""
_q("chunk_completion", [TURNS, _CHUNKED], """select id as completion_id, position,
  word || case when position < n - 1 then ' ' else '' end as delta, null::varchar as finish_reason,
  null::int as prompt_tokens, null::int as completion_tokens from chunks
  union all select id, max(n)::int, '', 'stop', max(pt)::int, max(ct)::int from chunks group by id""")
_ASSEMBLED = """select id as completion_id, regexp_replace(prompt, ' +$', '') as content, length(prompt)::int as prompt_tokens,
  len(string_split(prompt, ' '))::int as completion_tokens from turns where role = 'assistant'"""
_q("assemble_chunks", TURNS, _ASSEMBLED)
_q("assemble_chunks_stream", TURNS, _ASSEMBLED)
_q("cache_savings", USAGE, f"""select virtual_key_id, resolved_model, count(*) as hits,
  sum({cost('prompt_tokens', 'completion_tokens')})::decimal(18,6) as saved_usd
  from usage u join pricing p on p.model = u.resolved_model where cache_hit group by all""")

# -- vectors ---

_DOCS = "src as (select doc_id as id, lang as tenant, text as prompt from documents)"
_q("embed_corpus", [_DOCS, embedded("v", "src")], """select id, len(list_filter(vec, lambda x: x <> 0))::int as slots,
  list_sum(vec)::double as weight, list_inner_product(vec, list_transform(range(128), lambda i: i::double)) as moment,
  round(case when norm = 0 then 0 else list_max(vec) / norm end, 9) as largest from v""")
_q("embed_other", "", f"""with sizes as (select doc_id as id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'),
    lambda w: least(length(w), 16)) as n from documents),
h as (select id, list_transform(range(1, 17), lambda k: len(list_filter(n, lambda x: x = k))::double) as vec from sizes)
select id, list_sum(vec)::double as weight, list_inner_product(vec, list_transform(range(16), lambda i: i::double)) as moment,
  round(sqrt(list_inner_product(vec, vec)), 9) as norm, timestamp '{AS_OF}' + to_minutes(60) as expires_at from h""")
_q("build_index", VECTORS, f"select tenant, 'swift-s' as model, {signature('vec', 64)}::int as signature, id from vectors")
_q("index_stats", VECTORS, f"""select tenant, 'swift-s' as model, {signature('vec', 64)}::int as signature,
  count(*) as entries from vectors group by all""")
_NAMED = "q.tenant, 'swift-s' as model, q.gid as query_id, e.gid as entry_id, q.copies as query_copies, e.copies as entry_copies"
_SIGNED = f"sg as (select *, {signature('vec', 64)}::int as sig from g)"
_q("bucket_join", [VECTORS, grouped("g", "vectors"), _SIGNED], f"""select {_NAMED}, round({COSINE}, 6) as similarity
  from sg q join sg e on q.tenant = e.tenant and bit_count(xor(q.sig, e.sig)) <= 1""")
_q("scoped_cosine_join", [VECTORS, grouped("g", "vectors")], f"""select {_NAMED}, round({COSINE}, 6) as similarity
  from g q join g e on q.tenant = e.tenant where {COSINE} >= 0.3""")
_q("similar_prompt_pairs", [_DOCS, embedded("v", "src"), grouped("g", "v")],
   f"""select q.tenant, 'swift-s' as model, q.gid as left_id, e.gid as right_id, round({COSINE}, 6) as similarity,
  q.copies * e.copies as row_pairs from g q join g e on q.tenant = e.tenant and q.gid < e.gid where {COSINE} >= 0.99
  union all select tenant, 'swift-s', gid, gid, 1.0::double, copies * (copies - 1) // 2 from g where copies > 1 and norm > 0""")
_q("lsh_recall", [VECTORS, grouped("g", "vectors"), _SIGNED], f"""select q.tenant, 'swift-s' as model, count(*) as true_pairs,
  count(*) filter (bit_count(xor(q.sig, e.sig)) <= 1) as found,
  avg((bit_count(xor(q.sig, e.sig)) <= 1)::int::double) as recall
  from sg q join sg e on q.tenant = e.tenant and q.gid < e.gid where {COSINE} >= 0.3 group by q.tenant""")
_q("index_stats_tables", VECTORS, f"""select tenant, 'swift-s' as model, (t - 1)::int as table, sigs[t]::int as signature,
  count(*) as entries from (select tenant, {signatures('vec', 64, X.LSH_PLANES, X.LSH_TABLES)} as sigs from vectors), generate_series(1, {X.LSH_TABLES}) s(t)
  group by all""")
_q("lsh_recall_tables", [TURNS, "src as (select * from turns where role = 'user')", embedded("v", "src"), grouped("g", "v"),
                         f"sg as (select *, {signatures('vec', DIM, X.LSH_PLANES, X.LSH_TABLES)} as sigs from g)"],
   f"""select q.tenant, 'swift-s' as model, count(*) as true_pairs, count(*) filter ({MEET}) as found,
  avg(({MEET})::int::double) as recall
  from sg q join sg e on q.tenant = e.tenant and q.gid < e.gid where {COSINE} >= 0.7 group by q.tenant""")
_TWO = [TURNS, "src as (select * from turns where role in ('user', 'assistant'))", embedded("v", "src"),
        f"""ranked as (select q.id, q.tenant, e.id as match_id, {COSINE} as similarity, e.prompt as content
  from v q join v e on q.tenant = e.tenant where q.role = 'assistant' and e.role = 'user' and {COSINE} >= 0.5),
best as (select id, match_id, similarity, content, row_number() over (partition by id order by similarity desc, match_id) as rn
  from ranked)"""]
_q("best_match", _TWO, "select id, match_id, round(similarity, 6) as similarity from best where rn = 1")
_NEAR = [TURNS, "src as (select * from turns where role in ('user', 'assistant'))", embedded("v", "src"),
         f"sv as (select *, {signature('vec', DIM)}::int as sig from v)",
         f"""ranked as (select q.id, e.id as match_id, {COSINE} as similarity, bit_count(xor(q.sig, e.sig)) <= 1 as near
  from sv q join sv e on q.tenant = e.tenant where q.role = 'assistant' and e.role = 'user' and {COSINE} >= 0.5)""",
         """best as (select *, row_number() over (partition by id order by near desc, similarity desc, match_id) as rn from ranked)"""]
_q("best_match_lsh", _NEAR, "select id, match_id, round(similarity, 6) as similarity from best where rn = 1 and near")
_q("best_match_tables", [*_NEAR[:3], f"sv as (select *, {signatures('vec', DIM, X.LSH_PLANES, X.LSH_TABLES)} as sigs from v)",
                         _NEAR[4].replace("bit_count(xor(q.sig, e.sig)) <= 1", MEET), _NEAR[5]],
   "select id, match_id, round(similarity, 6) as similarity from best where rn = 1 and near")
_q("best_match_lsh_then_exact", _NEAR, "select id, match_id, round(similarity, 6) as similarity from best where rn = 1")
_q("cache_lookup", _TWO, """select t.id, b.match_id is not null as hit, b.content, length(b.content)::int as prompt_tokens,
  len(string_split(b.content, ' '))::int as completion_tokens, round(coalesce(b.similarity, 0.0::double), 6) as similarity
  from turns t left join best b on b.id = t.id and b.rn = 1 where t.role = 'assistant'""")


def replay_ctes(ttl_minutes: int | None) -> list[str]:
    live = "" if ttl_minutes is None else f" and e.ts + to_minutes({ttl_minutes}) >= q.ts"
    return [TURNS, "src as (select * from turns where role = 'user')", embedded("v", "src"),
            f"""near as (select q.id, e.id as eid, {COSINE} as similarity from v q join v e
  on q.tenant = e.tenant and e.id < q.id{live} where {COSINE} >= 0.6),
near_ids as (select id, list(eid) as eids from near group by id),
line as (select s.id, s.tenant, coalesce(n.eids, cast([] as bigint[])) as eids,
  row_number() over (partition by tenant order by s.id) as rn from src s left join near_ids n using (id)),
play as (
  select tenant, rn, id, false as hit, [id] as stored from line where rn = 1
  union all
  select l.tenant, l.rn, l.id, list_has_any(p.stored, l.eids),
    case when list_has_any(p.stored, l.eids) then p.stored else list_append(p.stored, l.id) end
  from play p join line l on l.tenant = p.tenant and l.rn = p.rn + 1),
missed as (select id from play where not hit),
best as (select n.id, n.eid, n.similarity, row_number() over (partition by n.id order by n.similarity desc, n.eid) as rn
  from near n join missed m on m.id = n.eid)"""]


_REPLAYED = """select p.id, p.hit, case when p.hit then b.eid end as match_id,
  round(case when p.hit then b.similarity else 0.0::double end, 6) as similarity
  from play p left join best b on b.id = p.id and b.rn = 1"""
_q("cache_replay", replay_ctes(None), _REPLAYED, True)
_q("cache_replay_ttl", replay_ctes(1440), _REPLAYED, True)
_q("cache_stream", replay_ctes(1440), _REPLAYED, True)

# -- streams ---

_q("rate_limit_stream", [_RATE_IN, rate_ctes("rate_in", DAY_US)],
   "select k as event_type, id as event_id, admitted, retry_after_ms from rate", True)
SQL["budget_stream"] = SQL["budget_admit"]
_q("write_usage_clustered", USAGE, """select cast(created_at as date) as created_on, virtual_key_id, provider, count(*) as requests,
  min(created_at) as first_at, max(created_at) as last_at, coalesce(sum(cost_usd), 0)::decimal(18,6) as cost_usd
  from usage group by all""")
SQL["usage_sink"] = SQL["write_usage"]
_q("read_usage_window", USAGE, """select provider, count(*) as requests, sum(latency_ms)::bigint as latency_ms,
  min(created_at) as first_at, max(created_at) as last_at from usage
  where created_at >= timestamp '2024-01-10 12:00:00' and created_at < timestamp '2024-01-14 00:00:00' group by provider""")
SQL["breaker_stream"] = SQL["breaker_replay"]
_q("usage_rollup_stream", USAGE, """select date_trunc('day', created_at)::timestamp as window_start, provider,
  count(*) as request_count, coalesce(sum(cost_usd), 0)::decimal(18,6) as total_cost_usd,
  count(*) filter (fallback_used) as fallback_count, avg(latency_ms) as avg_latency_ms from usage
  group by 1, 2""")

# -- composites ---

_FACTS = """facts as (
  select r.*, event_type = 'x' as never, cast(1 + floor(value) as int) as completion_tokens,
    cast(floor(value * 10) as bigint) as latency_ms, greatest(1, length(prompt) // 4) as prompt_tokens,
    case when temperature > 2 then 'VALIDATION_FAILED' end as body_error,
    EST as estimate_usd
  from routed r left join pricing p on p.model = r.primary_model)""".replace("EST", _ESTIMATE)
_TTL_US = 6 * 3_600_000_000
_OUTCOME = [PRICING, ROUTED, _SERVED.replace("DOWN", "harbor"), _FACTS,
            "rate_in as (select key_id as k, request_id as id, epoch_us(ts) as us, rpm as cap from facts where auth_error is null)",
            rate_ctes("rate_in", DAY_US),
            "rendered as (select n::bigint as id, 'user: ' || prompt || chr(10) as prompt from labelled)",
            embedded("pv", "rendered"),
            f"prompt_near as (select q.id as a, e.id as b, {COSINE} as similarity from pv q cross join pv e where {COSINE} >= 0.7)",
            # requests that get as far as the cache; a place in the store is a (model, prompt)
            f"""reaching as (select f.*, s.served_model, s.served_provider, s.position, ra.admitted as in_rate,
    case when s.served_model is null then 0 else {cost('f.prompt_tokens', 'f.completion_tokens')} end::decimal(18,6) as settled,
    list_position({_list(m for m, *_ in dims.PRICING)}, s.served_model) as place_model,
    list_position({_list(m for m, *_ in dims.PRICING)}, f.primary_model) as ask_model
  from facts f join rate ra on ra.id = f.request_id left join served s using (request_id) left join pricing p on p.model = s.served_model
  where ra.admitted and coalesce(f.auth_error, f.body_error, f.allow_error, f.route_error) is null),
near_places as (select a, m, list(struct_pack(place := (m - 1) * 11 + b + 1, similarity := similarity)) as near
  from prompt_near, (select unnest(range(1, {len(dims.PRICING) + 1})) as m) group by a, m),
happenings as (
  select tenant, request_id as id, 0 as step, epoch_us(ts) as us, estimate_usd, budget, settled, null::bigint as place,
    case when not stream then near end as near from reaching left join near_places on a = request_id % 11 and m = ask_model
  union all
  select tenant, request_id, 1, epoch_us(ts) + latency_ms * 1000, estimate_usd, budget, settled,
    (place_model - 1) * 11 + request_id % 11 + 1, null from reaching),
line as (select *, row_number() over (partition by tenant order by us, step, id) as rn from happenings)""",
            # one event at a time: what is spent, which reservations are open, and the latest store of every place
            f"""play as (
  select tenant, 0::bigint as rn, null::bigint as id, 1 as step, null::bigint as match_id, null::boolean as admitted, 0::decimal(18,6) as spend,
    cast([] as bigint[]) as open, list_transform(range({11 * len(dims.PRICING)}), lambda x: struct_pack(us := null::bigint, id := null::bigint)) as live
  from (select distinct tenant from line)
  union all
  select tenant, rn, id, step, best.id, case when step = 0 and best is null then spend + estimate_usd <= budget end,
    (case when step = 0 and best is null and spend + estimate_usd <= budget then spend + estimate_usd
          when step = 1 and list_contains(open, id) then spend + settled - estimate_usd else spend end)::decimal(18,6),
    case when step = 0 and best is null and spend + estimate_usd <= budget then list_append(open, id)
         when step = 1 then list_filter(open, lambda x: x <> id) else open end,
    case when step = 1 and place is not null and list_contains(open, id)
         then list_transform(live, lambda v, i: case when i = place then struct_pack(us := us, id := id) else v end) else live end
  from (select l.*, p.spend, p.open, p.live, list_min(list_transform(
          list_filter(l.near, lambda c: p.live[c.place].us + {_TTL_US} >= l.us),
          lambda c: struct_pack(s := -c.similarity, id := p.live[c.place].id))) as best
        from play p join line l on l.tenant = p.tenant and l.rn = p.rn + 1))""",
            """judged as (select f.*, s.served_model, s.served_provider, s.position, ra.retry_after_ms, y.match_id, coalesce(auth_error,
    case when not ra.admitted then 'RATE_LIMITED' end, body_error, allow_error, route_error, case when not y.admitted then 'BUDGET_EXHAUSTED' end,
    case when y.match_id is null and s.served_model is null then 'ALL_PROVIDERS_EXHAUSTED' end) as error_code
  from facts f left join rate ra on ra.id = f.request_id left join served s using (request_id)
  left join play y on y.id = f.request_id and y.step = 0),
outcomes as (select j.request_id, ts, key_id, tenant, j.model, primary_model, prompt_tokens, completion_tokens, latency_ms, match_id,
    match_id is not null as cache_hit, j.error_code, coalesce(e.http_status, 200) as http_status,
    case when j.error_code = 'RATE_LIMITED' then retry_after_ms end as retry_after_ms,
    case when j.error_code is null and match_id is null then served_model end as served_model,
    case when j.error_code is null and match_id is null then served_provider end as served_provider,
    j.error_code is null and match_id is null and position > 0 as fallback_used
  from judged j left join errors e on e.error_code = j.error_code)""", ERRORS]
# errors must come before its use
_OUTCOME = [_OUTCOME[0], ERRORS, *_OUTCOME[1:-1]]
_q("request_outcome", _OUTCOME, """select request_id, tenant, cache_hit, match_id, error_code, http_status, retry_after_ms,
  served_model, served_provider, fallback_used from outcomes""", True)
_q("status_histogram", _OUTCOME, """select tenant, count(*) as total, count(*) filter (http_status = 200) as ok,
  count(*) filter (http_status = 429) as rate_limited, count(*) filter (http_status = 402) as budget_exhausted,
  count(*) filter (http_status not in (200, 429, 402)) as other from outcomes group by tenant""", True)
_q("rejection_report", _OUTCOME, """select tenant, error_code, http_status, count(*) as rejections,
  avg((retry_after_ms // 1000)::double) as mean_retry_after_s from outcomes where error_code is not null group by all""", True)
_q("meter_requests", _OUTCOME, f"""select o.request_id as usage_id, o.ts as created_at, o.key_id as virtual_key_id,
  o.model as requested_model, coalesce(o.served_model, o.primary_model) as resolved_model,
  case when o.cache_hit then 'cache' else o.served_provider end as provider,
  case when o.error_code is not null then 'ERROR:AllProvidersExhaustedException' else 'SUCCESS' end as status,
  case when o.error_code is null then (case when o.cache_hit then s.prompt_tokens else o.prompt_tokens end)::int end as prompt_tokens,
  case when o.error_code is null then case when o.cache_hit then s.completion_tokens else o.completion_tokens end end as completion_tokens,
  o.cache_hit, o.error_code is not null or o.fallback_used as fallback_used, o.latency_ms,
  case when o.cache_hit then 0::decimal(18,6) when o.error_code is null then
    {cost('o.prompt_tokens', 'o.completion_tokens')} end as cost_usd
  from outcomes o left join facts s on s.request_id = o.match_id
  left join pricing p on p.model = coalesce(o.served_model, o.primary_model)
  where o.error_code is null or o.error_code = 'ALL_PROVIDERS_EXHAUSTED'""", True)
