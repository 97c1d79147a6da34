"""Queries of the integrity rules: a run's ledgers with planted faults, and what DuckDB SQL finds wrong in the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import vocab as V
from ..operators import validate
from .fixtures import table

#: Ledgers with faults, in SQL that Spark and DuckDB both read: name, source table, columns.
LEDGERS = {
    "sources": ("supplier", """concat('s-', CAST(s_suppkey - CASE WHEN s_suppkey % 31 = 0 THEN 1 ELSE 0 END AS STRING)) AS source_id, 'web' AS source_type, CASE s_suppkey % 9 WHEN 0 THEN 'odd' ELSE 'unknown' END AS strength_grade,
        CASE s_suppkey % 7 WHEN 0 THEN 'odd' ELSE 'public' END AS access_class, 'l' AS locator, 't' AS retrieved_at, CASE s_suppkey % 11 WHEN 0 THEN CAST(NULL AS STRING) ELSE 'ready' END AS state"""),
    "frontier": ("customer", """concat('e-', CAST(c_custkey AS STRING)) AS frontier_event_id, concat('f-', CAST(c_custkey % 40 AS STRING)) AS frontier_id, 'r' AS run_id, 'g' AS goal_id, 'c' AS source_class,
        CASE c_custkey % 29 WHEN 0 THEN 'guess' ELSE 'feed' END AS discovery_method, CASE WHEN c_custkey % 40 = 3 THEN concat('i-', CAST(c_custkey % 80 AS STRING)) WHEN c_custkey % 37 = 0 THEN ' ' ELSE 'i' END AS entrypoint,
        '{}' AS dimensions, 'q' AS query, 'a' AS alias, 'm' AS market, CASE c_custkey % 13 WHEN 0 THEN 'f-99' WHEN 1 THEN concat('f-', CAST(c_custkey % 40 AS STRING)) ELSE CAST(NULL AS STRING) END AS parent_frontier_id,
        CASE c_custkey % 5 WHEN 0 THEN 'exhausted' WHEN 1 THEN 'blocked' WHEN 2 THEN 'active' WHEN 3 THEN 'pending' ELSE 'gone' END AS state, CAST(NULL AS STRING) AS cursor, concat('2026-01-01T', CAST(c_custkey + 100000 AS STRING)) AS event_at,
        c_custkey % 3 - CASE WHEN c_custkey % 17 = 0 THEN 5 ELSE 0 END AS new_target_count, 0 AS duplicate_target_count, 0 AS invalid_target_count, CASE WHEN c_custkey % 2 = 0 THEN 'end' ELSE '' END AS end_reason,
        CASE WHEN c_custkey % 3 = 0 THEN 'why' ELSE CAST(NULL AS STRING) END AS blocker_reason, c_custkey AS line"""),
    "targets": ("part", """concat('T-', CAST(p_partkey - CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS STRING)) AS target_id, 'r' AS run_id, 'g' AS goal_id, 't' AS template_id, 'x' AS target_type, 'p' AS page_type, 'c' AS source_class,
        concat('route-', CAST(p_partkey % 4 AS STRING)) AS route_id, 'l' AS locator, '{}' AS dimensions, split(concat('fa,f', CAST(p_partkey % 3 AS STRING)), ',') AS coverage_fields, 0 AS priority,
        p_partkey % 5 - CASE WHEN p_partkey % 53 = 0 THEN 9 ELSE 0 END AS shard_id, 'k' AS partition_key, 'b' AS batch_id, 't' AS planned_at, 'v' AS planner_version, split('route-0,route-1,route-2', ',') AS route_candidates,
        split(concat('f-', CAST(p_partkey % 45 AS STRING)), ',') AS frontier_ids"""),
    "attempts": ("orders", """concat('a-', CAST(o_orderkey AS STRING)) AS attempt_id, 'r' AS run_id, 'b' AS batch_id, concat('T-', CAST(o_custkey AS STRING)) AS target_id, CASE o_orderkey % 19 WHEN 0 THEN 'guess' ELSE 'fetch' END AS stage,
        'ad' AS adapter, 'v' AS route_version, o_orderkey % 23 AS attempt_no, CASE o_orderkey % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'lost' WHEN 2 THEN 'blocked' ELSE 'success' END AS status, 't' AS started_at, 't' AS finished_at,
        CASE WHEN o_orderkey % 3 = 0 THEN 'net' ELSE ' ' END AS error_category, CASE o_orderkey % 31 WHEN 0 THEN -1 ELSE 4 END AS elapsed_ms, CASE o_orderkey % 41 WHEN 0 THEN -0.5 ELSE 1.0 END AS cost,
        CASE o_orderkey % 43 WHEN 0 THEN concat('a-', CAST(o_orderkey AS STRING)) WHEN 1 THEN 'a-0' ELSE CAST(NULL AS STRING) END AS retry_of_attempt_id"""),
    "coverage": ("orders", """concat('c-', CAST(o_orderkey AS STRING)) AS attempt_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('CELL-', substr(sha2(concat('{{"field":"fa","target_id":"T-', CAST(o_custkey AS STRING), '"}}'), 256), 1, 24)) ELSE 'CELL-0' END AS cell_id,
        'r' AS run_id, 'c' AS source_class, '{{}}' AS object_scope, CASE o_orderkey % 5 WHEN 0 THEN 'fz' ELSE 'fa' END AS field_scope, 'm' AS market, CASE o_orderkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'maybe' ELSE 'unchecked' END AS state,
        't' AS retrieved_at, concat('T-', CAST(o_custkey AS STRING)) AS target_id, CASE WHEN o_orderkey % 3 = 0 THEN 'why' ELSE '' END AS blocker_reason, split(concat('s-', CAST(o_orderkey % 120 AS STRING)), ',') AS source_ids"""),
    "raw_artifacts": ("orders", """concat('w-', CAST(o_orderkey AS STRING)) AS raw_artifact_id, 'r' AS run_id, concat('T-', CAST(o_custkey AS STRING)) AS target_id, concat('a-', CAST(o_orderkey + o_orderkey % 2 AS STRING)) AS attempt_id,
        CASE o_orderkey % 9 WHEN 0 THEN 'nohash' ELSE sha2(CAST(o_orderkey AS STRING), 256) END AS sha256, CASE o_orderkey % 11 WHEN 0 THEN -1 ELSE 10 END AS bytes, 'text/html' AS media_type, 'l' AS locator, 't' AS retrieved_at, 'v' AS route_version,
        CASE o_orderkey % 13 WHEN 0 THEN 'odd' ELSE 'public' END AS access_class, CASE o_orderkey % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'lost' ELSE 'stored' END AS storage_state,
        CASE o_orderkey % 8 WHEN 2 THEN '../x' WHEN 3 THEN '' ELSE 'raw/x' END AS relative_path, CASE WHEN o_orderkey % 3 = 0 THEN 'why' ELSE CAST(NULL AS STRING) END AS retention_reason, concat('s-', CAST(o_orderkey % 110 AS STRING)) AS source_id"""),
    "observations": ("orders", """concat('o-', CAST(o_orderkey - CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS STRING)) AS observation_id, 'r' AS run_id, concat('k-', CAST(o_orderkey % 50 AS STRING)) AS observation_key, 'x' AS object_type, 'x' AS object_id,
        CASE o_orderkey % 6 WHEN 0 THEN 'fz' ELSE 'fa' END AS field, CASE o_orderkey % 7 WHEN 0 THEN 'odd' ELSE 'static' END AS field_kind, '1' AS value_json, concat('s-', CAST(o_orderkey % 130 AS STRING)) AS source_id, 'x' AS evidence_type,
        CASE o_orderkey % 9 WHEN 0 THEN CAST(NULL AS STRING) ELSE 'unknown' END AS source_strength, CASE o_orderkey % 17 WHEN 0 THEN 'soon' ELSE '2026-01-01' END AS observed_at, '2026-01-02T00:00:00Z' AS retrieved_at, 'v' AS route_version,
        'v' AS parser_version, CASE o_orderkey % 5 WHEN 0 THEN sha2(CAST(o_orderkey AS STRING), 256) WHEN 1 THEN 'gone' ELSE CAST(NULL AS STRING) END AS raw_hash, concat('T-', CAST(o_custkey AS STRING)) AS target_id"""),
    "tasks": ("customer", """concat('t-', CAST(c_custkey AS STRING)) AS task_id, CASE c_custkey % 15 WHEN 0 THEN 'g2' ELSE 'g' END AS goal_id, 's' AS input_snapshot, concat('p-', CAST(c_custkey % 400 AS STRING)) AS partition_key, 'o' AS owner,
        CASE c_custkey % 10 WHEN 0 THEN 'leased' WHEN 1 THEN 'odd' ELSE 'completed' END AS status, 1 AS attempt, CASE c_custkey % 6 WHEN 0 THEN 'child_agent' WHEN 1 THEN 'external_cli' WHEN 2 THEN 'robot' ELSE 'lead' END AS runner_class,
        CASE c_custkey % 21 WHEN 0 THEN ' ' ELSE 'e' END AS executor_id, 'd' AS dispatch_reason, 'x' AS expected_output_schema, 'm' AS acceptance_metric, 'c' AS escalation_condition, 'none' AS allowed_side_effects,
        split(concat('l-', CAST(c_custkey % 300 AS STRING)), ',') AS resource_lease_keys, CASE c_custkey % 12 WHEN 0 THEN '' ELSE '1' END AS prompt_version, CASE c_custkey % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'maybe' ELSE 'passed' END AS acceptance_result,
        CASE c_custkey % 16 WHEN 0 THEN 'other' WHEN 3 THEN 'bad luck' ELSE CAST(NULL AS STRING) END AS failure_class, CASE WHEN c_custkey % 9 = 0 THEN concat('t-', CAST(c_custkey + c_custkey % 4 - 1 AS STRING)) ELSE CAST(NULL AS STRING) END AS escalated_from_task_id,
        CASE WHEN c_custkey % 9 = 0 THEN 1 WHEN c_custkey % 55 = 0 THEN 3 WHEN c_custkey % 77 = 0 THEN -1 ELSE 0 END AS escalation_step, 2 AS max_escalations, CASE c_custkey % 18 WHEN 0 THEN 'huge' ELSE 'balanced' END AS model_tier,
        'low' AS reasoning_tier, CASE WHEN c_custkey % 4 = 1 THEN 'broken' ELSE 'ready' END AS readiness_state"""),
    "claims": ("supplier", """concat('q-', CAST(s_suppkey AS STRING)) AS claim_id, 'x' AS text, 'open' AS status, '1' AS confidence, split(concat('s-', CAST(s_suppkey % 30 AS STRING), ',s-', CAST(s_suppkey + 20 AS STRING)), ',') AS source_ids,
        split(concat('s-', CAST(s_suppkey * 2 AS STRING)), ',') AS counterevidence_source_ids, split('', ',') AS gap_ids, CASE s_suppkey % 6 WHEN 0 THEN '{{"claim_id":1,"text":null,"status":1,"gap_ids":[]}}'
        ELSE '{{"claim_id":1,"text":1,"status":1,"confidence":1,"source_ids":1,"counterevidence_source_ids":1,"gap_ids":1}}' END AS raw_line"""),
    "current_view": ("customer", """concat('k-', CAST(c_custkey % 1400 AS STRING)) AS observation_key, concat('o-', CAST(c_custkey AS STRING)) AS selected_from_observation_id"""),
    "conflicts": ("customer", """concat('k-', CAST(c_custkey AS STRING)) AS observation_key, 'competing_values' AS conflict_type, CASE c_custkey % 3 WHEN 0 THEN CAST(NULL AS STRING) ELSE concat('o-', CAST(c_custkey AS STRING)) END AS selected_observation_id,
        split(concat('o-', CAST(c_custkey + 1 AS STRING), ',o-', CAST(c_custkey + 2 AS STRING)), ',') AS alternative_observation_ids"""),
}
_SPARK = {name: f"SELECT {columns if '{{' in columns else columns.replace('{', '{{').replace('}', '}}')} FROM {{t}}" for name, (_, columns) in LEDGERS.items()}
DUCK = {name: f"{name}_ AS (SELECT {columns.replace('{{', '{').replace('}}', '}').replace('sha2(', 'sha_2(')} FROM {source})" for name, (source, columns) in LEDGERS.items()}


def ledgers(spark, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.sql(_SPARK[name], t=table(spark, sf_dir, source)) for name, (source, _) in LEDGERS.items()}


# Each check as SQL: rows (table_name, row_key, message).
def _where(name: str, bad: str, message: str) -> str:
    return f"SELECT '{name}' AS table_name, {validate.KEYS[name]} AS row_key, '{message}' AS message FROM {name}_ WHERE {bad}"


def _enum(name: str, column: str, values: tuple[str, ...]) -> str:
    return _where(name, f"{column} IS NULL OR {column} NOT IN ({', '.join(map(repr, values))})", f"invalid {column}")


def _unique(name: str) -> str:
    key = validate.KEYS[name]
    return f"SELECT '{name}', {key}, 'duplicate {key}' FROM {name}_ GROUP BY {key} HAVING count(*) > 1"


def _foreign(name: str, column: str, parent: str, parent_column: str, array: bool = False) -> str:
    fk = f"unnest({column})" if array else column
    return (f"SELECT '{name}', k, 'unknown {column} ' || fk FROM (SELECT {validate.KEYS[name]} AS k, {fk} AS fk FROM {name}_) WHERE fk IS NOT NULL AND fk NOT IN (SELECT {parent_column} FROM {parent}_ WHERE {parent_column} IS NOT NULL)")


def _blank(column: str) -> str:
    return f"trim(coalesce({column}, '')) = ''"


def _unplanned(name: str, column: str) -> str:
    return (f"SELECT '{name}', {validate.KEYS[name]}, 'field is not planned: ' || {column} FROM {name}_ x WHERE EXISTS (SELECT 1 FROM targets_ t WHERE t.target_id = x.target_id) "
            f"AND NOT EXISTS (SELECT 1 FROM targets_ t WHERE t.target_id = x.target_id AND list_contains(t.coverage_fields, x.{column}))")


_ESCALATED = """SELECT 'tasks', task_id, problem FROM (SELECT c.task_id, CASE WHEN p.task_id IS NULL THEN 'unknown parent' WHEN c.task_id = p.task_id THEN 'escalates itself'
    WHEN c.goal_id <> p.goal_id OR c.input_snapshot <> p.input_snapshot OR c.partition_key <> p.partition_key THEN 'goal, snapshot or partition differs from the parent'
    WHEN c.escalation_step <> p.escalation_step + 1 THEN 'step does not follow the parent''s' WHEN p.acceptance_result NOT IN ('partial', 'failed') THEN 'parent did not fail'
    WHEN c.runner_class = p.runner_class AND c.executor_id = p.executor_id AND c.model_tier = p.model_tier AND c.reasoning_tier = p.reasoning_tier AND c.prompt_version = p.prompt_version THEN 'capability is unchanged' END AS problem
    FROM tasks_ c LEFT JOIN tasks_ p ON c.escalated_from_task_id = p.task_id WHERE c.escalated_from_task_id IS NOT NULL) WHERE problem IS NOT NULL"""
_TELEMETRY = "valid_record_count, new_record_count, elapsed_ms, input_tokens, output_tokens, bytes_received, cost must be 0 or more"
CHECKS: dict[str, list[str]] = {
    "V18": [_unique("sources"), _enum("sources", "strength_grade", V.STRENGTHS), _enum("sources", "state", V.SOURCE_STATES), _enum("sources", "access_class", V.ACCESS_CLASSES)],
    "V19": [_enum("frontier", "state", V.FRONTIER_STATES), _enum("frontier", "discovery_method", V.DISCOVERY_METHODS), _where("frontier", _blank("entrypoint"), "frontier_id, source_class, entrypoint, event_at must not be empty"),
            _where("frontier", f"state = 'exhausted' AND {_blank('end_reason')}", "exhausted without end_reason"), _where("frontier", f"state = 'blocked' AND {_blank('blocker_reason')}", "blocked without blocker_reason"),
            _where("frontier", "new_target_count < 0", "new_target_count, duplicate_target_count, invalid_target_count must be 0 or more")],
    "V20": ["SELECT 'frontier', frontier_id, 'identity changed between events' FROM frontier_ GROUP BY frontier_id HAVING count(DISTINCT discovery_method || entrypoint) > 1"],
    "V21": [_foreign("frontier", "parent_frontier_id", "frontier", "frontier_id"), _where("frontier", "parent_frontier_id = frontier_id", "parent_frontier_id refers to itself")],
    "V22": ["SELECT 'frontier', frontier_id, 'frontier is still open' FROM frontier_ GROUP BY frontier_id HAVING arg_max(state, (event_at, line)) NOT IN ('exhausted', 'blocked')"],
    "V23": [_unique("targets"), _where("targets", "shard_id < 0", "shard_id must be 0 or more")],
    "V24": [_where("targets", "NOT list_contains(route_candidates, route_id)", "route_id is not among route_candidates"), _foreign("targets", "frontier_ids", "frontier", "frontier_id", True)],
    "V26": [_foreign("attempts", "target_id", "targets", "target_id"), _enum("attempts", "stage", V.STAGES), _enum("attempts", "status", V.STATUSES),
            _where("attempts", f"status IN ('timeout', 'blocked') AND {_blank('error_category')}", "failure without error_category"), _where("attempts", "attempt_no < 1", "attempt_no must be 1 or more"),
            _where("attempts", "elapsed_ms < 0 OR cost < 0", _TELEMETRY)],
    "V27": [_foreign("attempts", "retry_of_attempt_id", "attempts", "attempt_id"), _where("attempts", "retry_of_attempt_id = attempt_id", "retry_of_attempt_id refers to itself")],
    "V34": [_enum("coverage", "state", V.COVERAGE_STATES), _where("coverage", f"state = 'blocked' AND {_blank('blocker_reason')}", "blocked without blocker_reason"), _foreign("coverage", "target_id", "targets", "target_id"),
            _foreign("coverage", "source_ids", "sources", "source_id", True),
            _where("coverage", "cell_id <> 'CELL-' || substr(sha256('{\"field\":\"' || field_scope || '\",\"target_id\":\"' || target_id || '\"}'), 1, 24)", "cell_id does not match its target and field"), _unplanned("coverage", "field_scope")],
    "V35": [_foreign("raw_artifacts", "target_id", "targets", "target_id"), _foreign("raw_artifacts", "attempt_id", "attempts", "attempt_id"), _foreign("raw_artifacts", "source_id", "sources", "source_id"),
            _where("raw_artifacts", "length(sha256) <> 64", "sha256 is no hash"), _where("raw_artifacts", "bytes < 0", "bytes must be 0 or more"), _enum("raw_artifacts", "access_class", V.ACCESS_CLASSES),
            _enum("raw_artifacts", "storage_state", V.STORAGE_STATES)],
    "V36": [_where("raw_artifacts", "storage_state = 'stored' AND relative_path IN ('', '../x')", "stored without a path inside the package"), _where("raw_artifacts", "storage_state <> 'stored' AND retention_reason IS NULL", "not stored without retention_reason")],
    "V37": [_unique("observations"), _foreign("observations", "source_id", "sources", "source_id"), _foreign("observations", "target_id", "targets", "target_id"), _foreign("observations", "raw_hash", "raw_artifacts", "sha256"),
            _enum("observations", "field_kind", V.FIELD_KINDS), _enum("observations", "source_strength", V.STRENGTHS), _unplanned("observations", "field")],
    "V38": [_enum("tasks", "status", V.TASK_STATES)],
    "V39": [_enum("tasks", "runner_class", V.RUNNER_CLASSES), _where("tasks", _blank("executor_id"), "executor_id, dispatch_reason, expected_output_schema, acceptance_metric, escalation_condition must not be empty"),
            _where("tasks", f"runner_class = 'child_agent' AND (model_tier = 'huge' OR {_blank('prompt_version')})", "child agent without tier or prompt_version"),
            _where("tasks", "runner_class = 'external_cli' AND status = 'leased' AND readiness_state = 'broken'", "active executor that isn''t ready")],
    "V40": [_enum("tasks", "acceptance_result", V.ACCEPTANCE_RESULTS), _where("tasks", "failure_class = 'bad luck'", "invalid failure_class"), _where("tasks", "acceptance_result = 'failed' AND failure_class IS NULL", "partial or failed without failure_class"),
            _where("tasks", "escalation_step < 0", "escalation_step, max_escalations must be 0 or more"), _where("tasks", "escalation_step > 2", "too many escalations"),
            _where("tasks", "(escalation_step = 0) <> (escalated_from_task_id IS NULL)", "step 0 and no parent must go together")],
    "V41": ["SELECT 'tasks', partition_key, 'several active tasks of one partition' FROM tasks_ WHERE status IN ('pending', 'leased') GROUP BY partition_key HAVING count(*) > 1",
            "SELECT 'tasks', l, 'several active tasks hold one lease' FROM (SELECT unnest(resource_lease_keys) AS l FROM tasks_ WHERE status IN ('pending', 'leased')) GROUP BY l HAVING count(*) > 1"],
    "V42": [_ESCALATED],
    "V44": ["SELECT 'claims', claim_id, 'missing keys: confidence,source_ids,counterevidence_source_ids' FROM claims_ WHERE raw_line LIKE '%text\":null%'",
            _foreign("claims", "source_ids", "sources", "source_id", True), _foreign("claims", "counterevidence_source_ids", "sources", "source_id", True)],
    "V45": [_unique("current_view"), _foreign("current_view", "selected_from_observation_id", "observations", "observation_id")],
    "V46": [_foreign("conflicts", "selected_observation_id", "observations", "observation_id"), _foreign("conflicts", "alternative_observation_ids", "observations", "observation_id", True)],
    "V51": [_where("observations", "observed_at = 'soon'", "time can''t be read")],
}


def _query(rule: str):
    def run(spark, sf_dir: str) -> DataFrame:
        return validate.check_package(ledgers(spark, sf_dir), only={rule}).select("table_name", "row_key", "message")
    return run


def _sql(rule: str) -> str:
    parts = " UNION ALL ".join(CHECKS[rule])
    used = [name for name in LEDGERS if f"{name}_" in parts]
    return f"WITH {', '.join(DUCK[n] for n in used)} SELECT * FROM ({parts}) AS found(table_name, row_key, message)".replace("sha_2(", "sha256(").replace(", 256)", ")")


RULE_QUERIES = {f"rule_{rule}": _query(rule) for rule in CHECKS}
RULE_SQL = {f"rule_{rule}": _sql(rule) for rule in CHECKS}
