"""SQL for DuckDB that gives the same rows as the named queries."""

from __future__ import annotations

BASE = r"""
with recursive numbered as materialized (
  select row_number() over (order by event_id) as i, event_id, event_type, props, user_id,
    cast(floor(epoch(ts)) as bigint) as ts,
    'm-' || user_id as model_id,
    case when event_type = 'signup' then 'model_registration' else 'inference' end as type,
    row_number() over (partition by user_id, event_type order by event_id) as n
  from events),
fields as materialized (
  select i, ts, type, model_id,
    case when type = 'model_registration' then '1.0.' || n end as version,
    case when type = 'inference' then 'inf-' || event_id end as inference_id,
    case when type = 'inference' then sha256(props) end as input_hash,
    case when type = 'inference' then sha256(event_type || ':' || event_id) end as output_hash,
    'model-' || user_id as name
  from numbered),
requests as materialized (
  select *, case when type = 'inference' then
      '{"executedAt":"' || strftime(epoch_ms(ts * 1000), '%Y-%m-%dT%H:%M:%S.000Z') || '","inferenceId":"' || inference_id || '","inputHash":"' || input_hash
        || '","modelId":"' || model_id || '","outputHash":"' || output_hash || '","type":"inference"}'
    else '{"modelHash":"' || sha256(model_id || '|' || version) || '","modelId":"' || model_id || '","modelName":"' || name || '","type":"model_registration","version":"' || version || '"}' end as data
  from fields)
"""
CHAIN = (
    BASE
    + r""",
rows as materialized (
  select 0 as i, 1700000000 as ts, '{"metadata":{"description":"Genesis block"},"modelId":"genesis","type":"model_registration"}' as data,
    'model_registration' as type, 'genesis' as model_id, cast(null as varchar) as version, cast(null as varchar) as inference_id, cast(null as varchar) as input_hash, cast(null as varchar) as output_hash
  union all select i, ts, data, type, model_id, version, inference_id, input_hash, output_hash from requests),
texts as materialized (select i, i || '|' || ts || '|' || data || '|' as t from rows),
links as (
  select cast(0 as bigint) as i, '0' as prev, sha256(t || '0') as h from texts where i = 0
  union all select x.i, l.h, sha256(x.t || l.h) from links l join texts x on x.i = l.i + 1),
blocks as materialized (
  select cast(r.i as bigint) as block_index, cast(r.ts as bigint) as ts, r.data, l.prev as previous_hash, l.h as hash, r.type, r.model_id, r.version, r.inference_id, r.input_hash, r.output_hash
  from rows r join links l on r.i = l.i)
"""
)
TAMPERED = (
    CHAIN
    + r""",
changed as materialized (
  select block_index, ts, hash,
    case when block_index > 0 and block_index % 97 = 0 then data || ' ' else data end as data,
    case when block_index > 0 and block_index % 101 = 0 then 'x' else previous_hash end as previous_hash
  from blocks),
checked as materialized (
  select *, lag(hash) over (order by block_index) as before, sha256(block_index || '|' || ts || '|' || data || '|' || previous_hash) <> hash as bad from changed),
flags as materialized (select *, before is not null and previous_hash <> before as broken from checked)
"""
)
VERIFY = "select count(*) as total, count(*) filter (bad) as bad_hash, count(*) filter (broken) as broken_links, count(*) filter (bad or broken) as invalid_blocks, count(*) filter (bad or broken) = 0 as is_valid from {}"
ISO = "strftime(epoch_ms({} * 1000), '%Y-%m-%dT%H:%M:%S.000Z')"
ANCHORS = r""",
anchors as materialized (
  select sha256('root:' || i) as merkle_root, i as last_block_index, '0x' || sha256('tx:' || i) as tx_hash,
    case when (i // 50) % 3 = 0 then null else i * 10 end as block_number, cast(11155111 as bigint) as chain_id, ts as anchored_at,
    case when (i // 50) % 3 = 0 then 'pending' else 'confirmed' end as status
  from requests where i % 50 = 0),
receipts as (
  select tx_hash, case when (last_block_index // 50) % 7 <> 0 then last_block_index * 10 end as block_number from anchors where (last_block_index // 50) % 5 <> 0)
"""
MODELS = ", models as materialized (select model_id, name, version, ts as created_at from requests where type = 'model_registration')"
AGENTS = r"""
agents as (
  select event_id, 'agent-' || (user_id % 30) as agent_id,
    case when event_id % 211 <> 0 then 'm-' || (user_id + case when event_id % 97 = 0 then 1000000 else 0 end) end as model_id,
    props as input, event_type || ':' || (event_id % 3) as output,
    cast(floor(epoch(ts)) as bigint) + case when event_id % 303 = 0 then 1000000000 else 0 end as ts, value as cost
  from events)
"""
EVENTS = r"""
with contract as (
  select cast(c_custkey as bigint) as event_no, '0x' || substr(sha256('org' || (c_custkey % 25)), 1, 40) as technical_address, sha256('root:' || c_custkey) as merkle_root,
    'org-' || (c_custkey % 40) as organization_id, c_name as organization_name, lower(c_mktsegment) as domain, cast(1700000000 + c_custkey as bigint) as ts, c_custkey % 50 <> 0 as ok
  from customer)
select event_no, case when ok then technical_address end as technical_address, case when ok then merkle_root end as merkle_root, case when ok then organization_id end as organization_id,
  case when ok then organization_name end as organization_name, case when ok then domain end as domain, case when ok then ts end as ts from contract
"""


def merkle(promote: bool) -> str:
    """A root over the blocks' hashes by lists, level by level; promote: pairs sorted and an odd last node moved up."""
    if promote:
        pair = "case when j + 1 <= len(level) then sha256(unhex(least(level[j], level[j + 1])) || unhex(greatest(level[j], level[j + 1]))) else level[j] end"
    else:
        pair = "sha256(unhex(level[j]) || unhex(coalesce(level[j + 1], level[j])))"
    return CHAIN + f""",
tree as (
  select list(hash order by block_index) as level from blocks
  union all select list_transform(range(1, len(level) + 1, 2), lambda j: {pair}) from tree where len(level) > 1)
select cast((select count(*) from blocks) as bigint) as n_leaves, level[1] as root from tree where len(level) = 1
"""


PREFIXES = CHAIN + """,
tree as (
  select n.length, list(b.hash order by b.block_index) as level from (values (1), (51), (500)) n(length) join blocks b on b.block_index < n.length group by n.length
  union all select length, list_transform(range(1, len(level) + 1, 2), lambda j: sha256(unhex(level[j]) || unhex(coalesce(level[j + 1], level[j])))) from tree where len(level) > 1)
select cast(length as bigint) as length, level[1] as root from tree where len(level) = 1
"""

#: The root over each anchor's prefix with pairs sorted and an odd last node moved up, beside the anchor.
CHECKED = CHAIN + """,
tree as (
  select a.i, list(b.hash order by b.block_index) as level from requests a join blocks b on b.block_index <= a.i where a.i % 50 = 0 group by a.i
  union all select i, list_transform(range(1, len(level) + 1, 2), lambda j: case when j + 1 <= len(level)
    then sha256(unhex(least(level[j], level[j + 1])) || unhex(greatest(level[j], level[j + 1]))) else level[j] end) from tree where len(level) > 1)
select cast(i as bigint) as last_block_index, '0x' || upper(case when (i // 50) % 20 = 0 then sha256('root:' || i) else level[1] end) as merkle_root, level[1] as root,
  (i // 50) % 20 <> 0 as proven
from tree where len(level) = 1
"""
#: Keccak-256 of 'org-7', a fixed value.
ORG_7 = "0afbff16cff0a8240eebf3730a655a9b7d7debf6d7d8d3d6c21e328c9ab7d9ab"
#: The acknowledgements of requests that are appended to an empty chain after its genesis block.
WRITTEN = r""",
judged as materialized ({judged}),
accepted as materialized (
  select 0 as n, cast(null as bigint) as ord, '0|1700000000|{{"metadata":{{"description":"Genesis block"}},"modelId":"genesis","type":"model_registration"}}|' as t
  union all select row_number() over (order by ord), ord, row_number() over (order by ord) || '|' || ts || '|' || data || '|' from judged where reason is null),
hashed as (
  select n, ord, sha256(t || '0') as h from accepted where n = 0
  union all select a.n, a.ord, sha256(a.t || l.h) from hashed l join accepted a on a.n = l.n + 1)
select j.ord, {columns}, j.reason is null as success, j.reason, cast(h.n as varchar) as block_index, h.h as block_hash from judged j left join hashed h on j.ord = h.ord
"""

ORACLE = {
    "ledger_build": CHAIN + "select block_index, ts, data, previous_hash, hash from blocks",
    "ledger_head": CHAIN + "select block_index, hash from blocks order by block_index desc limit 1",
    "verify_chain": CHAIN + ", c as (select sha256(block_index || '|' || ts || '|' || data || '|' || previous_hash) <> hash as bad, coalesce(previous_hash <> lag(hash) over (order by block_index), false) as broken from blocks) " + VERIFY.format("c"),
    "verify_tampered": TAMPERED + VERIFY.format("flags"),
    "verify_tampered_reader": TAMPERED + ", r as (select broken, bad and not broken and before is not null as bad from flags) " + VERIFY.format("r"),
    "verify_errors": TAMPERED + "select block_index, cast(1 as integer) as kind, 'Block ' || block_index || ': Hash mismatch' as message from flags where bad union all select block_index, 2, 'Block ' || block_index || ': Hashchain broken ! (previousHash: ' || substr(previous_hash, 1, 16) || '..., expected: ' || substr(before, 1, 16) || '...)' from flags where broken",
    "chain_gaps": BASE + ", k as (select i, lag(i) over (order by i) as before from requests where i % 10 <> 3) select i as block_index, before as before_index from k where i <> before + 1",
    "block_by_index": CHAIN + "select block_index, ts, data, previous_hash, hash from blocks where block_index = 42",
    "block_by_hash": CHAIN + "select block_index, ts, data, previous_hash, hash from blocks where hash = (select hash from blocks where block_index = 42)",
    "blocks_page": CHAIN + "select block_index, hash from blocks order by block_index limit 10 offset 20",
    "blocks_page_unlimited": CHAIN + "select block_index, hash from blocks order by block_index offset 20",
    "provenance_history": CHAIN + f"select model_id, block_index, {ISO.format('ts')} as timestamp, ts as timestamp_unix, type, version, input_hash, output_hash, cast(null as varchar) as params, cast(null as varchar) as metadata, hash as block_hash, previous_hash from blocks where model_id = 'm-8'",
    "provenance_summary": CHAIN + "select 'm-8' as model_id, count(*) as total_blocks, true as chain_valid, cast(0 as bigint) as error_count from blocks where model_id = 'm-8'",
    "chain_stats": CHAIN + ANCHORS + f"select (select count(*) from blocks) as total_blocks, (select count(distinct model_id) - 1 from blocks) as total_models, b.block_index as last_block_index, b.hash as last_block_hash, {ISO.format('b.ts')} as last_block_timestamp, b.ts as last_block_timestamp_unix, true as chain_valid, cast(0 as bigint) as error_count, a.last_block_index as anchor_block_index, a.tx_hash as anchor_tx_hash, a.status as anchor_status, 'https://explorer.invalid/tx/' || a.tx_hash as anchor_url from (select * from blocks order by block_index desc limit 1) b left join (select * from anchors order by last_block_index desc limit 1) a on true",
    "chain_height": BASE + "select count(*) as height from requests",
    "model_count": BASE + MODELS + "select count(*) as models from models",
    "models_recent": BASE + MODELS + "select * from models order by created_at desc, model_id, version limit 10",
    "models_page": BASE + MODELS + "select * from models order by model_id, version limit 10 offset 5",
    "model_by_id": BASE + MODELS + "select * from models where model_id = 'm-8' order by version, created_at limit 1",
    "model_by_name": BASE + MODELS + "select * from models where name = 'model-8' and version = '1.0.2'",
    "model_ids": BASE + MODELS + "select model_id from models",
    "events_per_model": BASE + "select cast(floor(cast(count(*) as double) / coalesce(nullif(count(distinct model_id), 0), 1) + 0.5) as bigint) as events_per_model, case when count(*) > 0 then 'Active' else 'Starting' end as state from requests",
    "blocks_per_model": CHAIN + "select model_id, count(*) as blocks, count(*) filter (type = 'inference') as inferences, max(block_index) as last_block_index from blocks group by 1",
    "latest_block": CHAIN + "select block_index, ts, hash from blocks order by block_index desc limit 1",
    "type_labels": BASE + "select case when type = 'model_registration' then 'Registration' else 'Inference' end as label, count(*) as blocks from requests group by 1",
    "merkle_root_sha256": merkle(False),
    "merkle_root_sorted_pairs": merkle(True),
    "prefix_roots": PREFIXES,
    "anchors_checked": CHECKED,
    "frontier_root": merkle(True),
    "anchor_due": "select '0x' || root as merkle_root, n_leaves - 1 as last_block_index, '0xnew' as tx_hash, cast(11155111 as bigint) as chain_id, cast(1700000000 as bigint) as anchored_at, 'pending' as status from (" + merkle(True) + ")",
    "anchor_decision": BASE + ANCHORS + ", x as (select (select max(i) from requests) as l, (select coalesce(max(last_block_index), -1) from anchors) as a) select l as last_block_index, a as last_anchored, l - a as new_blocks, l - a >= 20 as due, case when l - a < 20 then 'Not enough new blocks (' || (l - a) || '), wait for 20.' end as reason from x",
    "anchors_page": BASE + ANCHORS + "select * replace (cast(block_number as varchar) as block_number) from anchors order by last_block_index limit 10 offset 10",
    "anchors_pending": BASE + ANCHORS + "select * replace (cast(block_number as varchar) as block_number) from anchors where status = 'pending'",
    "anchors_confirm": BASE + ANCHORS + "select a.merkle_root, a.last_block_index, a.tx_hash, cast(case when a.status = 'pending' and r.block_number is not null then r.block_number else a.block_number end as varchar) as block_number, a.chain_id, a.anchored_at, case when a.status = 'pending' and r.block_number is not null then 'confirmed' else a.status end as status from anchors a left join receipts r using (tx_hash)",
    "contract_events": "select * replace (cast(ts as varchar) as ts) from (" + EVENTS + ")",
    "events_by_address": "select * from (" + EVENTS + ") where lower(technical_address) = '0x' || substr(sha256('org7'), 1, 40)",
    "inference_accept": BASE + MODELS + "select inference_id, model_id from requests where type = 'inference' and model_id in (select model_id from models where version = '1.0.14')",
    "inference_reject": BASE + MODELS + "select inference_id, model_id from requests where type = 'inference' and model_id not in (select model_id from models where version = '1.0.14')",
    "registration_unique": BASE + ", r as (select i, model_id, name, '1.' || (i % 4) as version from requests where type = 'model_registration'), w as (select *, row_number() over (partition by name, version order by i) as n from r) select i as block_index, model_id, name, version, case when n > 1 then 'name and version exist' end as reason from w",
    "models_update": BASE + MODELS + "select model_id, case when version = '1.0.1' then name || '-first' else name end as name, version, created_at from models",
    "models_delete": BASE + MODELS + "select * from models where model_id not in (select model_id from models where version = '1.0.9')",
    "model_provenance_join": CHAIN + MODELS + "select m.model_id, m.version, count(b.block_index) as blocks from models m left join blocks b on m.model_id = b.model_id group by 1, 2",
    "drift_detect": BASE + "select model_id, input_hash, count(distinct output_hash) as outputs, count(*) as inferences from requests where type = 'inference' group by 1, 2 having count(distinct output_hash) > 1",
    "suspicious_agents": "with " + AGENTS + ", p as (select agent_id, input, count(distinct output) as o, count(*) as n, sum(cast(cost as decimal(18,2))) as c from agents group by 1, 2), g as (select agent_id, count(*) filter (o > 1) as repeated_inputs, cast(sum(n) as bigint) as actions, cast(sum(c) as double) as total_cost from p group by 1) select * from g where repeated_inputs >= 3 and total_cost > 100",
    "weird_cases": BASE + MODELS + "," + AGENTS + ", w as (select event_id, model_id is null as missing, ts > 2000000000 as future, model_id is not null and model_id not in (select model_id from models) as unknown from agents) select * from w where missing or future or unknown",
    "unknown_models": BASE + MODELS + "," + AGENTS + "select model_id, count(*) as events from agents where model_id is not null and model_id not in (select model_id from models) group by 1",
    "action_links": BASE + ", a as (select i as action_id, unnest(['inf-' || i, 'inf-' || (i + 1), 'inf-x']) as inference_id from requests where i % 100 = 0) select a.inference_id, a.action_id, r.model_id from a left join requests r on a.inference_id = r.inference_id",
    "action_links_all": BASE + ", a as (select i as action_id, unnest(['inf-' || i, 'inf-' || (i + 1), 'inf-x']) as inference_id from requests) select a.inference_id, a.action_id, r.model_id from a left join requests r on a.inference_id = r.inference_id",
    "data_structure_keys": CHAIN + "select block_index, case when block_index = 0 then 'metadata,modelId,type' when type = 'inference' then 'executedAt,inferenceId,inputHash,modelId,outputHash,type' else 'modelHash,modelId,modelName,type,version' end as keys, false as has_null, case when block_index = 0 then '{\"metadata\":{},\"modelId\":\"genesis\",\"type\":\"model_registration\"}' else data end as text from blocks",
    "conversation_hashes": "select conv_id, turn, sha256(text) as text_hash from conversations",
    "per_model_heads": BASE + ", k as materialized (select model_id, i, row_number() over (partition by model_id order by i) as n, i || '|' || ts || '|' || data || '|' as t from requests), h as (select model_id, n, i, sha256(t || '0') as hash from k where n = 1 union all select k.model_id, k.n, k.i, sha256(k.t || h.hash) from h join k on k.model_id = h.model_id and k.n = h.n + 1) select model_id, max(n) as blocks, arg_max(hash, n) as head from h group by 1",
    "models_recent_all": BASE + MODELS + "select * from models",
    "verify_recleaned": TAMPERED + ", r as (select broken, sha256(block_index || '|' || ts || '|' || rtrim(data) || '|' || previous_hash) <> hash and not broken and before is not null as bad from flags) " + VERIFY.format("r"),
    "genesis_exists": CHAIN + "select count(*) filter (block_index = 0) > 0 as has_genesis from blocks",
    "anchors_append": BASE + ANCHORS + ", x as (select (select max(i) from requests) as l, (select coalesce(max(last_block_index), -1) from anchors) as a) select l as last_block_index, '0xnew' as tx_hash, cast(11155111 as bigint) as chain_id, cast(1700000000 as bigint) as anchored_at, 'pending' as status, cast(66 as integer) as root_chars from x where l - a >= 1",
    "anchored_events": BASE + ANCHORS + f"select '0xabc' as technical_address, merkle_root, '0x{ORG_7}' as organization_id, 'Org' as organization_name, 'health' as domain, anchored_at as ts from anchors",
    "events_by_org": f"select * replace (cast(ts as bigint) as ts), '{ORG_7}' as organization_hash from (" + EVENTS + ") where organization_id = 'org-7'",
    "provenance_report": TAMPERED + ", e as (select count(*) filter (bad) + count(*) filter (broken) as n, arg_min(case when bad then 'Block ' || block_index || ': Hash mismatch' else 'Block ' || block_index || ': Hashchain broken ! (previousHash: ' || substr(previous_hash, 1, 16) || '..., expected: ' || substr(before, 1, 16) || '...)' end, block_index) filter (bad or broken) as first_error from flags) select b.model_id, count(*) as total_blocks, e.n = 0 as chain_valid, e.n as errors, e.first_error, string_agg(b.hash, ',' order by b.block_index) as hashes from blocks b, e group by b.model_id, e.n, e.first_error",
    "stats_badges": TAMPERED + "select case when count(*) filter (bad or broken) = 0 then 'Passing' else 'Failing' end as badge from flags",
    "events_from_args": "select * replace (cast(ts as varchar) as ts) from (" + EVENTS + ")",
    "requests_ingested": BASE + "select model_id, inference_id, input_hash, output_hash from requests where type = 'inference'",
    "payloads_filtered": "select event_id, cast(regexp_extract(props, '-?[0-9]+') as bigint) as k, event_type as type, cast(user_id as bigint) as user_id from events where cast(regexp_extract(props, '-?[0-9]+') as bigint) between 10 and 19",
    "payload_paths": "with p(path, kind) as (values ('$.event', 'OBJECT'), ('$.event.id', 'BIGINT'), ('$.event.type', 'STRING'), ('$.params', 'OBJECT'), ('$.params.k', 'BIGINT'), ('$.tags', 'ARRAY'), ('$.tags[]', 'STRING'), ('$.tags[]', 'OBJECT'), ('$.tags[].user', 'BIGINT'), ('$.note', 'VOID')) select path, kind, count(*) as values from p, events where kind <> 'VOID' or event_id % 3 = 0 group by path, kind",
    "canonical_paths": "select event_id, '{' || case when event_id % 4 = 1 then '\"A\":[true,{\"c\":\"é\"}],' else '' end || '\"props\":{\"k\":' || regexp_extract(props, '-?[0-9]+') || '},\"v\":' || event_id || '}' as canonical, event_id % 4 <> 0 as native from events",
    "canonical_events": "select event_id, '{\"k\":' || regexp_extract(props, '-?[0-9]+') || '}' as canonical, '{\"b\":{\"k\":' || regexp_extract(props, '-?[0-9]+') || '},\"c\":[{},\"\"]}' as cleaned from events",
    "register_models": BASE + WRITTEN.format(
        judged="select i as ord, ts, model_id, name, version, case when version = '1.0.1' then 'name and version exist' end as reason, '{\"modelId\":\"' || model_id || '\",\"modelName\":\"' || name || '\",\"note\":\"a \\\"quoted\\\" <word>\",\"type\":\"model_registration\",\"version\":\"' || version || '\",\"x\":[\"\",{},1]}' as data from requests where type = 'model_registration'",
        columns="model_id, name, version",
    ),
    "log_inferences": BASE + MODELS + WRITTEN.format(
        judged="select i as ord, ts, model_id, inference_id, case when model_id not in (select model_id from models where version = '1.0.14') then 'Model ID ' || model_id || ' does not exist' end as reason, data from requests where type = 'inference'",
        columns="model_id, inference_id",
    ),
}
ORACLE |= {
    "block_by_hash_indexed": ORACLE["block_by_hash"],
    "verify_continued": ORACLE["verify_tampered"],
    "contract_events_source": ORACLE["contract_events"],
    "inferences_acknowledged": "select w.ord, w.inference_id, w.success, f.input_hash, f.output_hash, w.block_hash from (" + ORACLE["log_inferences"] + ") w join (" + BASE + "select inference_id, input_hash, output_hash from requests) f using (inference_id)",
    "verify_excluded": "select count(block_hash) + 1 as total, count(*) filter (block_index::bigint % 7 = 0) as bad_hash, count(*) filter (block_index::bigint % 7 = 0) as broken_links, count(*) filter (block_index::bigint % 7 = 0) as invalid_blocks, count(*) filter (block_index::bigint % 7 = 0) = 0 as is_valid, arg_max(block_hash, block_index::bigint) as head, count(block_hash) as kept from (" + ORACLE["log_inferences"] + ")",
    "models_registered": BASE + MODELS + "select m.model_id, m.name, m.version, m.created_at, '{\"layers\":[1,{\"w\":' || r.i || '}],\"note\":\"a \\\"quoted\\\" word\"}' as parameters, '{\"f1\":0.5,\"n\":' || r.i || '}' as metrics, cast(null as varchar) as metadata, 'h' || r.i as model_hash from models m join requests r on r.model_id = m.model_id and r.version = m.version where m.version <> '1.0.1'",
    "stats_maintained": ORACLE["chain_stats"],
    "blocks_per_model_maintained": ORACLE["blocks_per_model"],
    "models_update_stored": ORACLE["models_update"],
    "models_delete_stored": ORACLE["models_delete"],
    "anchors_confirm_stored": ORACLE["anchors_confirm"],
    "events_by_hour": "with " + AGENTS + "select ts // 3600 * 3600 as start, action_type, count(*) as events from (select a.*, e.event_type as action_type from agents a join events e using (event_id)) where ts <= 2000000000 group by 1, 2",
    "keyed_heads_streamed": ORACLE["per_model_heads"],
    "anchors_confirm_within": ORACLE["anchors_confirm"].replace("left join receipts r using (tx_hash)", "left join receipts r on a.tx_hash = r.tx_hash and (a.last_block_index // 50) % 4 < 3"),
}
