"""Integrity rules over ledgers: each is a DataFrame of (rule_id, severity, table_name, row_key, message).

Rules are built from a few kinds of check and listed in RULES; check_package() unites those whose tables are given.
Presence of a key is read from raw_line where the ledger has it (JSON null counts as present), else from not-null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import contained_path, json_object, json_text, stable_id, version_of
from .latest import FRONTIER, latest

Tables = dict[str, DataFrame]
Rule = Callable[[Tables], DataFrame]
ISSUE_SCHEMA = "rule_id string, severity string, table_name string, row_key string, message string"
KEYS = {"sources": "source_id", "frontier": "frontier_event_id", "targets": "target_id", "attempts": "attempt_id", "decisions": "decision_id", "coverage": "attempt_id",
        "raw_artifacts": "raw_artifact_id", "observations": "observation_id", "tasks": "task_id", "claims": "claim_id", "current_view": "observation_key", "conflicts": "observation_key"}

# Required keys of each ledger.
REQUIRED = {
    "sources": "source_id source_type strength_grade access_class locator retrieved_at state",
    "frontier": "frontier_event_id frontier_id run_id goal_id source_class discovery_method entrypoint dimensions query alias market parent_frontier_id state cursor event_at "
                "new_target_count duplicate_target_count invalid_target_count end_reason blocker_reason",
    "targets": "target_id run_id goal_id template_id target_type page_type source_class route_id locator dimensions coverage_fields priority shard_id partition_key batch_id "
               "planned_at planner_version route_candidates frontier_ids",
    "attempts": "attempt_id run_id batch_id target_id stage adapter route_version attempt_no status started_at finished_at",
    "decisions": "decision_id run_id goal_id input_snapshot decided_at selector_version policy ledger_snapshot selected candidate_count selected_count "
                 "unresolved_required_cells actionable_required_cells open_frontier_ids discovery_complete exclusion_counts stop_decision",
    "coverage": "attempt_id cell_id run_id source_class object_scope field_scope market state retrieved_at target_id",
    "raw_artifacts": "raw_artifact_id run_id target_id attempt_id sha256 bytes media_type locator retrieved_at route_version access_class storage_state",
    "observations": "observation_id run_id observation_key object_type object_id field field_kind value source_id evidence_type source_strength observed_at retrieved_at "
                    "route_version parser_version raw_hash target_id",
    "tasks": "task_id goal_id input_snapshot partition_key owner status attempt runner_class executor_id dispatch_reason expected_output_schema acceptance_metric "
             "escalation_condition allowed_side_effects resource_lease_keys prompt_version acceptance_result failure_class escalated_from_task_id escalation_step max_escalations",
    "claims": "claim_id text status confidence source_ids counterevidence_source_ids gap_ids",
    "current_view": "observation_key selected_from_observation_id",
    "conflicts": "observation_key conflict_type selected_observation_id alternative_observation_ids",
}


# Required keys of an item of a decision's selected.
SELECTED_KEYS = "target_id partition_key source_class selected_route_id required_fields coverage_debt required_source_class static_priority route_metrics selection_reason"


def _issues(df: DataFrame, rule: str, table: str, message: Column | str, severity: str = "error", key: str | None = None) -> DataFrame:
    key = key or KEYS[table]
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"),
                     (F.lit(message) if isinstance(message, str) else message).alias("message"))


def where(rule: str, table: str, bad: Callable[[DataFrame], Column], message: str, severity: str = "error") -> tuple[str, set[str], Rule]:
    return rule, {table}, lambda t: _issues(t[table].where(F.coalesce(bad(t[table]), F.lit(False))), rule, table, message, severity)


def enum(rule: str, table: str, column: str, values: tuple[str, ...]) -> tuple[str, set[str], Rule]:
    return where(rule, table, lambda df: F.lit(False) if column not in df.columns else ~F.coalesce(F.col(column).isin(*values), F.lit(False)), f"invalid {column}")


def required(rule: str, table: str) -> tuple[str, set[str], Rule]:
    names = REQUIRED[table].split()

    def run(t: Tables) -> DataFrame:
        df = t[table]
        if "raw_line" in df.columns:
            missing = F.array_except(F.array(*[F.lit(n) for n in names]), F.json_object_keys("raw_line"))
        else:
            have = [n for n in names if n in df.columns or (n == "value" and "value_json" in df.columns)]
            missing = F.array(*[F.lit(n) for n in names if n not in have]).cast("array<string>")
        return _issues(df.withColumn("_m", missing).where(F.size("_m") > 0), rule, table, F.concat(F.lit("missing keys: "), F.array_join("_m", ",")))
    return rule, {table}, run


def unique(rule: str, table: str, column: str | None = None) -> tuple[str, set[str], Rule]:
    column = column or KEYS[table]

    def run(t: Tables) -> DataFrame:
        twice = t[table].where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
        return _issues(twice, rule, table, f"duplicate {column}", key=column)
    return rule, {table}, run


def _kind(value: Column) -> Column:
    """Type of a JSON value; null where the value is missing or JSON null."""
    return F.nullif(F.schema_of_variant(value), F.lit("VOID"))


def _is_text_set(value: Column) -> Column:
    texts = F.try_variant_get(value, "$", "array<string>")
    return _kind(value).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(texts, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))) & (F.size(F.array_distinct(texts)) == F.size(texts))


#: What a JSON value has to be, and whether it is.
JSON_KINDS: dict[str, Callable[[Column], Column]] = {
    "an object": lambda v: _kind(v).startswith("OBJECT"), "an integer": lambda v: _kind(v).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "a boolean": lambda v: _kind(v) == "BOOLEAN",
    "a list": lambda v: _kind(v).startswith("ARRAY"), "a list of different texts": _is_text_set,
}


def typed(rule: str, table: str, **kinds: str) -> tuple[str, set[str], Rule]:
    """Columns whose JSON value is of a kind other than that of JSON_KINDS. Read from raw_line; ledgers without it have typed
    columns, so nothing is checked. Missing and null values are left to the other rules."""
    def run(t: Tables) -> DataFrame:
        df = t[table]
        if "raw_line" not in df.columns:
            return _issues(df.where("false"), rule, table, "")
        whole = F.try_parse_json("raw_line")
        bad = []
        for name, kind in kinds.items():
            value = F.try_variant_get(whole, f"$.{name}", "variant")
            bad.append(F.when(_kind(value).isNotNull() & ~F.coalesce(JSON_KINDS[kind](value), F.lit(False)), F.lit(f"{name} must be {kind}")))
        return _issues(df.withColumn("_m", F.explode(F.array_compact(F.array(*bad)))), rule, table, F.col("_m"))
    return rule, {table}, run


def foreign(rule: str, table: str, column: str, parent: str, parent_column: str, array: bool = False) -> tuple[str, set[str], Rule]:
    """Values of column (or its elements) that parent lacks; null refers to nothing."""
    def run(t: Tables) -> DataFrame:
        child = t[table].select(F.col(KEYS[table]), (F.explode(column) if array else F.col(column)).alias("_fk")).where("_fk is not null")
        known = t[parent].select(F.col(parent_column).alias("_fk")).distinct()
        return _issues(child.join(known, "_fk", "left_anti"), rule, table, F.concat(F.lit(f"unknown {column} "), F.col("_fk")))
    return rule, {table, parent}, run


def not_self(rule: str, table: str, column: str, own: str) -> tuple[str, set[str], Rule]:
    return where(rule, table, lambda df: F.col(column) == F.col(own), f"{column} refers to itself")


def negative(rule: str, table: str, columns: tuple[str, ...], least: int = 0) -> tuple[str, set[str], Rule]:
    return where(rule, table, lambda df: reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < least, F.lit(False)) for c in columns if c in df.columns], F.lit(False)),
                 f"{', '.join(columns)} must be {least} or more")


def empty(rule: str, table: str, columns: tuple[str, ...]) -> tuple[str, set[str], Rule]:
    return where(rule, table, lambda df: reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in columns if c in df.columns], F.lit(False)),
                 f"{', '.join(columns)} must not be empty")


def lacks(reason: str) -> Column:
    return F.coalesce(F.trim(F.col(reason)), F.lit("")) == ""


def _identity_drift(t: Tables) -> DataFrame:
    from .frontier import identity_drift
    return _issues(identity_drift(t["frontier"], tuple(c for c in ("goal_id", "source_class", "discovery_method", "entrypoint", "query", "alias", "market") if c in t["frontier"].columns)),
                   "V20", "frontier", "identity changed between events", key="frontier_id")


def _cell_ids(t: Tables) -> DataFrame:
    want = stable_id("CELL", json_object(field=json_text(F.col("field_scope")), target_id=json_text(F.col("target_id"))))
    return _issues(t["coverage"].where(F.col("cell_id") != want), "V34", "coverage", "cell_id does not match its target and field")


def _planned_fields(rule: str, table: str, column: str) -> tuple[str, set[str], Rule]:
    def run(t: Tables) -> DataFrame:
        plan = t["targets"].select("target_id", F.explode("coverage_fields").alias(column)).distinct()
        known = t[table].join(t["targets"].select("target_id").distinct(), "target_id", "left_semi")
        return _issues(known.join(plan, ["target_id", column], "left_anti"), rule, table, F.concat(F.lit("field is not planned: "), F.col(column)))
    return rule, {table, "targets"}, run


def _selected(t: Tables) -> DataFrame:
    items = t["decisions"].select("decision_id", "selected_count", F.col("selected.target_id").alias("ids"))
    return _issues(items.where((F.size("ids") != F.col("selected_count")) | (F.size(F.array_distinct("ids")) != F.size("ids"))), "V29", "decisions", "selected targets repeat or their count differs")


def _selected_items(t: Tables) -> DataFrame:
    """Items of selected, read from raw_line: all keys, a route, a debt of 1 or more, fields that are different texts."""
    df = t["decisions"]
    if "raw_line" not in df.columns:
        return _issues(df.where("false"), "V29", "decisions", "")
    items = F.try_variant_get(F.try_parse_json("raw_line"), "$.selected", "array<variant>")
    get = lambda item, name: F.try_variant_get(item, f"$.{name}", "variant")

    def message(item: Column) -> Column:
        lacking = F.array_compact(F.array(*[F.when(get(item, k).isNull(), F.lit(k)) for k in SELECTED_KEYS.split()]))
        route, debt = F.try_variant_get(item, "$.selected_route_id", "string"), F.try_variant_get(item, "$.coverage_debt", "bigint")
        fault = lambda good, text: F.when(~F.coalesce(good, F.lit(False)), F.lit(text))
        found = F.array_compact(F.array(
            F.when(F.size(lacking) > 0, F.concat(F.lit("missing keys: "), F.array_join(lacking, ","))),
            fault((_kind(get(item, "selected_route_id")) == "STRING") & (route != ""), "selected_route_id must be a text"),
            fault(JSON_KINDS["an integer"](get(item, "coverage_debt")) & (debt >= 1), "coverage_debt must be 1 or more"),
            fault(_is_text_set(get(item, "required_fields")), "required_fields must be a list of different texts")))
        return F.when(F.coalesce(_kind(item).startswith("OBJECT"), F.lit(False)), F.array_join(found, "; ")).otherwise(F.lit("no object"))
    found = df.select("decision_id", F.posexplode(F.transform(items, message)).alias("at", "text")).where("text <> ''")
    return _issues(found, "V29", "decisions", F.concat(F.lit("selected["), F.col("at"), F.lit("]: "), F.col("text")))


def _selected_known(t: Tables) -> DataFrame:
    items = t["decisions"].select("decision_id", F.explode("selected.target_id").alias("target_id"))
    return _issues(items.join(t["targets"], "target_id", "left_anti"), "V29", "decisions", F.concat(F.lit("unknown target_id "), F.col("target_id")))


def _active_twice(t: Tables) -> DataFrame:
    active = t["tasks"].where(F.col("status").isin(*V.ACTIVE_TASKS))
    parts = active.where("partition_key <> ''").groupBy("partition_key").agg(F.count("*").alias("n")).where("n > 1")
    out = _issues(parts, "V41", "tasks", "several active tasks of one partition", key="partition_key")
    if "resource_lease_keys" in active.columns:
        leases = active.select(F.explode("resource_lease_keys").alias("lease")).groupBy("lease").agg(F.count("*").alias("n")).where("n > 1")
        out = out.union(_issues(leases, "V41", "tasks", "several active tasks hold one lease", key="lease"))
    return out


def _escalations(t: Tables) -> DataFrame:
    child = t["tasks"].where("escalated_from_task_id is not null").alias("c")
    parent = t["tasks"].alias("p")
    both = child.join(parent, F.col("c.escalated_from_task_id") == F.col("p.task_id"), "left")
    same = lambda c: F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}"))
    capability = [c for c in ("runner_class", "executor_id", "model_tier", "reasoning_tier", "prompt_version") if c in t["tasks"].columns]
    unchanged = reduce(lambda a, b: a & b, [same(c) for c in capability])
    problem = (F.when(F.col("p.task_id").isNull(), "unknown parent").when(F.col("c.task_id") == F.col("p.task_id"), "escalates itself")
               .when(~same("goal_id") | ~same("input_snapshot") | ~same("partition_key"), "goal, snapshot or partition differs from the parent")
               .when(F.col("c.escalation_step") != F.col("p.escalation_step") + 1, "step does not follow the parent's")
               .when(~F.coalesce(F.col("p.acceptance_result").isin("partial", "failed"), F.lit(False)), "parent did not fail").when(unchanged, "capability is unchanged"))
    found = both.select(F.col("c.task_id").alias("task_id"), problem.alias("problem")).where("problem is not null")
    return _issues(found, "V42", "tasks", F.col("problem"))


def _stored_sizes(t: Tables) -> DataFrame:
    """Stored payloads against blobs (relative_path, length and, where hashes are to be checked, sha256)."""
    stored = t["raw_artifacts"].where("storage_state = 'stored'")
    blobs = t["blobs"].withColumnsRenamed({"sha256": "_blob_sha", "length": "_length"})
    both = stored.join(blobs.withColumn("_there", F.lit(True)), "relative_path", "left")
    problem = F.when(F.col("_there").isNull(), "blob is missing").when(F.col("_length") != F.col("bytes"), "size differs")
    if "_blob_sha" in blobs.columns:
        problem = problem.when(F.col("_blob_sha") != F.col("sha256"), "hash differs")
    return _issues(both.withColumn("_p", problem).where("_p is not null"), "V36", "raw_artifacts", F.col("_p"))


def _open_end(t: Tables) -> DataFrame:
    now = latest(t["frontier"], ["frontier_id"], tuple(c for c in FRONTIER if c in t["frontier"].columns))
    return _issues(now.where(~F.col("state").isin(*V.TERMINAL_FRONTIER)), "V22", "frontier", "frontier is still open", "warning", key="frontier_id")


_TELEMETRY = ("valid_record_count", "new_record_count", "elapsed_ms", "input_tokens", "output_tokens", "bytes_received", "cost")
_NESTED_DECISIONS: list[tuple[str, set[str], Rule]] = [
    typed("V28", "decisions", policy="an object", ledger_snapshot="an object"), ("V29", {"decisions"}, _selected_items),
    typed("V29", "decisions", selected="a list", candidate_count="an integer", selected_count="an integer", unresolved_required_cells="an integer", actionable_required_cells="an integer"),
    typed("V30", "decisions", open_frontier_ids="a list of different texts", discovery_complete="a boolean", exclusion_counts="an object"),
]
#: The rules of nested values of decisions alone.
NESTED_DECISIONS = [run for _, _, run in _NESTED_DECISIONS]
RULES: list[tuple[str, set[str], Rule]] = [
    *[required(r, t) for r, t in (("V18", "sources"), ("V19", "frontier"), ("V23", "targets"), ("V26", "attempts"), ("V28", "decisions"), ("V34", "coverage"), ("V35", "raw_artifacts"),
                                  ("V37", "observations"), ("V38", "tasks"), ("V44", "claims"), ("V45", "current_view"), ("V46", "conflicts"))],
    *[unique(r, t) for r, t in (("V18", "sources"), ("V19", "frontier"), ("V23", "targets"), ("V26", "attempts"), ("V28", "decisions"), ("V34", "coverage"), ("V35", "raw_artifacts"),
                                ("V37", "observations"), ("V38", "tasks"), ("V44", "claims"), ("V45", "current_view"))],
    enum("V18", "sources", "strength_grade", V.STRENGTHS), enum("V18", "sources", "state", V.SOURCE_STATES), enum("V18", "sources", "access_class", V.ACCESS_CLASSES),
    enum("V19", "frontier", "state", V.FRONTIER_STATES), enum("V19", "frontier", "discovery_method", V.DISCOVERY_METHODS),
    empty("V19", "frontier", ("frontier_id", "source_class", "entrypoint", "event_at")),
    where("V19", "frontier", lambda d: (F.col("state") == "exhausted") & lacks("end_reason"), "exhausted without end_reason"),
    where("V19", "frontier", lambda d: (F.col("state") == "blocked") & lacks("blocker_reason"), "blocked without blocker_reason"),
    negative("V19", "frontier", ("new_target_count", "duplicate_target_count", "invalid_target_count")),
    typed("V19", "frontier", dimensions="an object", new_target_count="an integer", duplicate_target_count="an integer", invalid_target_count="an integer"),
    ("V20", {"frontier"}, _identity_drift), foreign("V21", "frontier", "parent_frontier_id", "frontier", "frontier_id"),
    not_self("V21", "frontier", "parent_frontier_id", "frontier_id"), ("V22", {"frontier"}, _open_end),
    typed("V23", "targets", dimensions="an object", coverage_fields="a list of different texts", priority="an integer", shard_id="an integer"),
    typed("V24", "targets", route_candidates="a list of different texts", frontier_ids="a list of different texts"),
    negative("V23", "targets", ("shard_id",)), where("V24", "targets", lambda d: ~F.array_contains("route_candidates", F.col("route_id")), "route_id is not among route_candidates"),
    foreign("V24", "targets", "frontier_ids", "frontier", "frontier_id", array=True),
    foreign("V26", "attempts", "target_id", "targets", "target_id"), enum("V26", "attempts", "stage", V.STAGES), enum("V26", "attempts", "status", V.STATUSES),
    where("V26", "attempts", lambda d: F.col("status").isin(*V.STATUSES) & ~F.col("status").isin(*V.NON_FAILURE) & lacks("error_category"), "failure without error_category"),
    negative("V26", "attempts", ("attempt_no",), 1), negative("V26", "attempts", _TELEMETRY),
    foreign("V27", "attempts", "retry_of_attempt_id", "attempts", "attempt_id"), not_self("V27", "attempts", "retry_of_attempt_id", "attempt_id"),
    *_NESTED_DECISIONS,
    enum("V30", "decisions", "stop_decision", V.STOP_DECISIONS), ("V29", {"decisions"}, _selected), ("V29", {"decisions", "targets"}, _selected_known),
    where("V30", "decisions", lambda d: (F.col("stop_decision") == "continue") != (F.col("selected_count") > 0), "continue and a selection must go together"),
    foreign("V30", "decisions", "open_frontier_ids", "frontier", "frontier_id", array=True),
    negative("V29", "decisions", ("candidate_count", "selected_count", "unresolved_required_cells", "actionable_required_cells")),
    enum("V34", "coverage", "state", V.COVERAGE_STATES), where("V34", "coverage", lambda d: (F.col("state") == "blocked") & lacks("blocker_reason"), "blocked without blocker_reason"),
    foreign("V34", "coverage", "target_id", "targets", "target_id"), foreign("V34", "coverage", "source_ids", "sources", "source_id", array=True),
    ("V34", {"coverage"}, _cell_ids), _planned_fields("V34", "coverage", "field_scope"),
    foreign("V35", "raw_artifacts", "target_id", "targets", "target_id"), foreign("V35", "raw_artifacts", "attempt_id", "attempts", "attempt_id"),
    foreign("V35", "raw_artifacts", "source_id", "sources", "source_id"), where("V35", "raw_artifacts", lambda d: ~F.regexp_like("sha256", F.lit("^[0-9a-fA-F]{64}$")), "sha256 is no hash"),
    negative("V35", "raw_artifacts", ("bytes",)), enum("V35", "raw_artifacts", "access_class", V.ACCESS_CLASSES), enum("V35", "raw_artifacts", "storage_state", V.STORAGE_STATES),
    where("V36", "raw_artifacts", lambda d: (F.col("storage_state") == "stored") & (lacks("relative_path") | ~contained_path(F.coalesce("relative_path", F.lit("")))), "stored without a path inside the package"),
    where("V36", "raw_artifacts", lambda d: (F.col("storage_state") != "stored") & lacks("retention_reason"), "not stored without retention_reason"), ("V36", {"raw_artifacts", "blobs"}, _stored_sizes),
    foreign("V37", "observations", "source_id", "sources", "source_id"), foreign("V37", "observations", "target_id", "targets", "target_id"),
    foreign("V37", "observations", "raw_hash", "raw_artifacts", "sha256"), enum("V37", "observations", "field_kind", V.FIELD_KINDS),
    enum("V37", "observations", "source_strength", V.STRENGTHS), _planned_fields("V37", "observations", "field"),
    typed("V39", "tasks", allowed_side_effects="a list of different texts", resource_lease_keys="a list of different texts"),
    enum("V38", "tasks", "status", V.TASK_STATES), enum("V39", "tasks", "runner_class", V.RUNNER_CLASSES),
    empty("V39", "tasks", ("executor_id", "dispatch_reason", "expected_output_schema", "acceptance_metric", "escalation_condition")),
    where("V39", "tasks", lambda d: (F.col("runner_class") == "child_agent") & (~F.coalesce(F.col("model_tier").isin(*V.MODEL_TIERS), F.lit(False))
          | ~F.coalesce(F.col("reasoning_tier").isin(*V.REASONING_TIERS), F.lit(False)) | lacks("prompt_version")), "child agent without tier or prompt_version"),
    where("V39", "tasks", lambda d: (F.col("runner_class") == "external_cli") & F.col("status").isin(*V.ACTIVE_TASKS)
          & ~F.coalesce(F.col("readiness_state").isin("ready", "degraded"), F.lit(False)), "active executor that isn't ready"),
    enum("V40", "tasks", "acceptance_result", V.ACCEPTANCE_RESULTS),
    where("V40", "tasks", lambda d: F.col("failure_class").isNotNull() & ~F.col("failure_class").isin(*V.FAILURE_CLASSES), "invalid failure_class"),
    where("V40", "tasks", lambda d: F.col("acceptance_result").isin("partial", "failed") & F.col("failure_class").isNull(), "partial or failed without failure_class"),
    negative("V40", "tasks", ("escalation_step", "max_escalations")), where("V40", "tasks", lambda d: F.col("escalation_step") > F.col("max_escalations"), "too many escalations"),
    where("V40", "tasks", lambda d: (F.col("escalation_step") == 0) != F.col("escalated_from_task_id").isNull(), "step 0 and no parent must go together"),
    ("V41", {"tasks"}, _active_twice), ("V42", {"tasks"}, _escalations),
    foreign("V44", "claims", "source_ids", "sources", "source_id", array=True), foreign("V44", "claims", "counterevidence_source_ids", "sources", "source_id", array=True),
    foreign("V45", "current_view", "selected_from_observation_id", "observations", "observation_id"),
    foreign("V46", "conflicts", "selected_observation_id", "observations", "observation_id"),
    foreign("V46", "conflicts", "alternative_observation_ids", "observations", "observation_id", array=True),
    where("V51", "observations", lambda d: F.col("observed_at").cast("string").try_cast("timestamp").isNull() | F.col("retrieved_at").cast("string").try_cast("timestamp").isNull(), "time can't be read"),
]


def check_package(tables: Tables, only: set[str] | None = None, strict: bool = False) -> DataFrame:
    """All issues of the tables given (names as in KEYS, and blobs); strict turns warnings into errors."""
    parts = [run(tables) for rule, needs, run in RULES if needs <= set(tables) and (only is None or rule in only)]
    if not parts:
        raise ValueError("no rule applies to these tables")
    out = reduce(DataFrame.union, parts)
    return out.withColumn("severity", F.lit("error")) if strict else out


def blob_issues(raw_artifacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """Issues of stored payloads whose file is missing or differs; blobs has relative_path, length and, to check it, sha256."""
    return _stored_sizes({"raw_artifacts": raw_artifacts, "blobs": blobs})


def check_contracts(goal: dict, manifest: dict, dictionary: dict | None = None, fields: dict | None = None, plan: dict | None = None) -> list[tuple[str, str, str]]:
    """(rule, severity, message) of the one-row contracts."""
    out: list[tuple[str, str, str]] = []
    add = lambda rule, bad, text, severity="error": out.append((rule, severity, text)) if bad else None
    for c in ("schema_version", "goal_id", "mode", "depth", "as_of"):
        add("V05", c in goal and c in manifest and goal[c] != manifest[c], f"goal and manifest differ in {c}")
    add("V06", "depth" in goal and goal["depth"] not in V.DEPTHS, "invalid depth")
    snapshot = hashlib.sha256(json.dumps(goal, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    add("V07", manifest.get("input_snapshot") != snapshot, "input_snapshot does not match the goal")
    version = version_of(manifest.get("schema_version"))
    whole = lambda x, least: isinstance(x, int) and not isinstance(x, bool) and x >= least
    filled = lambda x: isinstance(x, str) and x.strip() != ""
    co = manifest.get("coordination")
    add("V08", version >= V.GATES["routing"] and not isinstance(co, dict), "coordination must be an object")
    if isinstance(co, dict):
        lanes, decision, assessed = co.get("independent_lane_count"), co.get("child_agent_decision"), co.get("assessed")
        add("V08", not isinstance(assessed, bool), "coordination.assessed must be a boolean")
        add("V08", not whole(lanes, 0), "independent_lane_count must be an integer of 0 or more")
        add("V08", decision not in V.CHILD_DECISIONS, "invalid child_agent_decision")
        if assessed and whole(lanes, 2) and decision != "delegated":
            add("V09", decision == "single_lane", "several lanes can't be single_lane")
            add("V09", not filled(co.get("child_agent_reason")), "several lanes without delegation need child_agent_reason")
        add("V11", assessed is False, "coordination is unassessed", "warning")
        for d in co.get("external_executor_decisions") or []:
            if not isinstance(d, dict):
                add("V10", True, "an executor decision must be an object")
                continue
            add("V10", any(not isinstance(d.get(k), str) or not d[k] for k in ("executor_id", "capability_gap", "reason")), "executor decision lacks executor_id, capability_gap or reason")
            add("V10", d.get("decision") not in V.EXTERNAL_DECISIONS, "invalid executor decision")
            add("V10", d.get("decision") in ("selected", "failed_pilot") and not (isinstance(d.get("pilot_attempt_id"), str) and d["pilot_attempt_id"]), "executor decision needs pilot_attempt_id")
    cc = manifest.get("collection_control")
    add("V12", version >= V.GATES["adaptive"] and not isinstance(cc, dict), "collection_control must be an object")
    if isinstance(cc, dict):
        add("V12", not isinstance(cc.get("discovery_assessed"), bool), "discovery_assessed must be a boolean")
        add("V12", cc.get("discovery_mode") not in V.DISCOVERY_MODES, "invalid discovery_mode")
        add("V12", cc.get("discovery_mode") in ("bounded_plan", "not_applicable") and not filled(cc.get("discovery_reason")), "discovery_mode needs discovery_reason")
        add("V12", not filled(cc.get("selector_policy")), "selector_policy must not be empty")
        for k, least in (("max_attempts_per_target_route", 1), ("max_task_escalations", 0), ("exploration_slots", 0)):
            add("V12", not whole(cc.get(k), least), f"{k} must be an integer of {least} or more")
        add("V11", cc.get("discovery_assessed") is False, "discovery is unassessed", "warning")
    for name, c in (("data_dictionary", dictionary), ("coverage_plan", plan), ("field_contract", fields)):
        if c is not None:
            add("V13" if name != "field_contract" else "V14", c.get("schema_version") != goal.get("schema_version") or c.get("goal_id") != goal.get("goal_id"), f"{name} differs from the goal in version or id")
    if fields is not None:
        need, may, no = (set(fields.get(k) or []) for k in ("required_fields", "optional_fields", "excluded_fields"))
        add("V15", need & may or need & no or may & no, "field sets overlap")
        add("V15", any(set(goal.get(k) or []) != set(fields.get(k) or []) for k in ("required_fields", "optional_fields", "excluded_fields")), "goal and field contract differ")
        add("V15", plan is not None and set(plan.get("required_fields") or []) != need, "coverage plan and field contract differ")
        if dictionary is not None:
            names = set(dictionary.get("fields") or {})
            add("V16", not need | may <= names or bool(names & no), "data dictionary does not fit the field sets")
        for k in ("extractor_output_fields", "acceptance_fields"):
            got = set(fields.get(k) or [])
            add("V17", not need <= got or not got <= need | may, f"{k} does not fit the field sets")
    return out
