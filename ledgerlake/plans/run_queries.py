"""Queries of ledger files, of streams, and of the rules that hold ledgers against a run's contracts, each with DuckDB SQL.

Files and streams need something to read: the tables are first written as ledgers into a folder of their own under
spark.checkpoint.dir, whole, and the query reads those.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocab as V
from ..operators import run_rules, validate
from ..sources import ledger as L
from ..streaming import logs
from .fixtures import derived, ledger, table
from .rule_queries import CHECKS, DUCK, ledgers

RUN_QUERIES: dict = {}
RUN_SQL: dict[str, str] = {}
#: Files into which a table is dealt where a query reads several.
FILES = 16


def query(name: str, sql: str):
    def add(f):
        RUN_QUERIES[name], RUN_SQL[name] = f, sql
        return f
    return add


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one where Spark is one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
    return f"{base.rstrip('/')}/ledgerlake/query-{uuid.uuid4().hex}"


# --- files

def _order_lines(spark: SparkSession, d: str) -> str:
    """orders as JSON Lines, one file per o_orderkey % FILES, with blank lines and broken ones in between."""
    key = F.col("o_orderkey").cast("string")
    text = (F.when(F.col("o_orderkey") % 17 == 0, "  ").when(F.col("o_orderkey") % 17 == 1, F.concat(F.lit("["), key, F.lit("]"))).when(F.col("o_orderkey") % 17 == 2, F.concat(F.lit('{"order_id":'), key))
            .otherwise(F.concat(F.lit('{"order_id":"'), key, F.lit('","status":"'), "o_orderstatus", F.lit('"}'))))
    at = folder(spark)
    rows = table(spark, d, "orders").select(text.alias("value"), (F.col("o_orderkey") % FILES).alias("part"), "o_orderkey")
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("value", "part").write.partitionBy("part").text(at)
    return at


_LINES = f"""lines AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderkey % {FILES} AS part, row_number() OVER (PARTITION BY o_orderkey % {FILES} ORDER BY o_orderkey) AS line FROM orders)"""
_ORDER = StructType().add("order_id", "string").add("status", "string")


def _part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.regexp_extract("_input_path", r"part=(\d+)", 1).cast("long"))


@query("ledger_lines", f"WITH {_LINES} SELECT part, line, CAST(k AS VARCHAR) AS order_id, status FROM lines WHERE k % 17 > 2")
def ledger_lines(spark, d):
    rows, _ = L.read_ledger(spark, _order_lines(spark, d), _ORDER)
    return _part(rows).select("part", "line", "order_id", "status")


@query("ledger_issues", f"""WITH {_LINES} SELECT part, line, CASE k % 17 WHEN 1 THEN '[' || k || ']' ELSE '{{"order_id":' || k END AS raw_line FROM lines WHERE k % 17 IN (1, 2)""")
def ledger_issues(spark, d):
    _, issues = L.read_ledger(spark, _order_lines(spark, d), _ORDER)
    return _part(issues).select("part", "line", "raw_line")


@query("optional_ledgers", "SELECT 'orders' AS name, count_if(o_orderkey % 17 > 2) AS n FROM orders UNION ALL SELECT 'missing', 0")
def optional_ledgers(spark, d):
    there = _order_lines(spark, d)
    have = L.optional_ledger(spark, there, _ORDER)
    none = L.optional_ledger(spark, f"{there}-missing", _ORDER)
    return have.agg(F.lit("orders").alias("name"), F.count("*").alias("n")).union(none.agg(F.lit("missing"), F.count("*")))


@query("ledger_versions", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def ledger_versions(spark, d):
    """A ledger replaced twice; what is read is the last version, whole."""
    at, rows = folder(spark), table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    L.replace_atomically(rows, at)
    L.replace_atomically(rows.where("o_orderkey % 3 <> 0"), at)
    return L.read_current(spark, at, rows.schema).groupBy("status").agg(F.count("*").alias("n"))


@query("ledger_appended", "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def ledger_appended(spark, d):
    """Two appends that overlap: every event is there once."""
    at, rows = folder(spark), table(spark, d, "events").select("event_id", "user_id", "event_type")
    L.append_idempotent(rows.where("event_id % 3 <> 0"), at, "event_id", ["user_id", "event_type"])
    L.append_idempotent(rows.where("event_id % 3 <> 1"), at, "event_id", ["user_id", "event_type"])
    return spark.read.schema(rows.schema).parquet(at).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("append_conflicts", "SELECT event_id FROM events WHERE event_id % 5 = 0 AND event_id % 7 = 0")
def append_conflicts(spark, d):
    """Ids of rows to append that the ledger holds with another payload."""
    rows = table(spark, d, "events").select("event_id", "event_type")
    new = rows.where("event_id % 5 = 0").withColumn("event_type", F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")))
    return L.split_append(new, rows, "event_id", ["event_type"])[1].select("event_id")


@query("payload_places", """SELECT p_type AS name, sha256(p_type) AS sha256, octet_length(encode(p_type)) AS bytes, 'raw/sha256/' || substr(sha256(p_type), 1, 2) || '/' || sha256(p_type) || '.txt' AS relative_path, true AS stored_new
    FROM part GROUP BY p_type""")
def payload_places(spark, d):
    """Payloads, many of them equal, put into the content-addressed store."""
    files = table(spark, d, "part").select(F.col("p_type").alias("name"), F.concat("p_type", F.lit(".TXT")).alias("path"), F.col("p_type").cast("binary").alias("content"))
    return L.store_payloads(files, folder(spark)).select("name", "sha256", "bytes", "relative_path", "stored_new").distinct()


@query("stored_blobs", """WITH x AS (SELECT o_orderkey AS k FROM orders) SELECT CAST(k AS VARCHAR) AS row_key, CASE WHEN k % 5 = 0 THEN 'blob is missing' WHEN k % 7 = 0 THEN 'size differs' ELSE 'hash differs' END AS message
    FROM x WHERE k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0""")
def stored_blobs(spark, d):
    """Stored payloads against the files that are there: presence, size, hash."""
    key = F.col("o_orderkey").cast("string")
    sha = F.sha2(key.cast("binary"), 256)
    rows = table(spark, d, "orders").select(key.alias("raw_artifact_id"), sha.alias("sha256"), F.octet_length(key.cast("binary")).cast("long").alias("bytes"), F.concat(F.lit("raw/"), key).alias("relative_path"),
                                            F.lit("stored").alias("storage_state"), "o_orderkey")
    blobs = rows.where("o_orderkey % 5 <> 0").select("relative_path", (F.col("bytes") + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("length"),
                                                     F.when(F.col("o_orderkey") % 11 == 0, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha256")).alias("sha256"))
    rows = rows.withColumns({"access_class": F.lit("public"), "retention_reason": F.lit("")})
    return validate.blob_issues(rows, blobs).select("row_key", "message")


_FILES = ("goal_contract.json run_manifest.json data_dictionary.json coverage_plan.json sources.jsonl coverage.jsonl observations.jsonl tasks.jsonl claims.jsonl current_view.jsonl conflicts.jsonl").split()
_GATED = "field_contract.json collection_attempts.jsonl target_queue.jsonl raw_artifacts.jsonl discovery_frontier.jsonl batch_decisions.jsonl".split()


@query("package_files", "SELECT * FROM (VALUES " + ", ".join([f"('absent', 'V01', '{f}')" for f in _FILES] + [f"('absent', 'V03', '{f}')" for f in _GATED] + [f"('old', 'V01', '{f}')" for f in _FILES]
                        + ["('changed', 'goal', 'b')", "('again', 'refused', 'FileExistsError')"]) + ") AS t(package, rule_id, file)")
def package_files(spark, d):
    """Files that run packages lack: one that isn't there, by two schema versions, and one just set up; its goal is then replaced."""
    at = folder(spark)
    found = [("absent", *x) for x in L.missing_files(spark, at, "1.5.0")] + [("old", *x) for x in L.missing_files(spark, at)]
    contracts = {name: {"schema_version": "1.5.0"} for name in ("data_dictionary", "coverage_plan", "field_contract")}
    L.init_package(spark, at, {"goal": "a"}, {"run_id": "r"}, contracts)
    found += [("new", *x) for x in L.missing_files(spark, at, "1.5.0")]
    L.replace_contract(spark, f"{at}/goal_contract.json", {"goal": "b"})
    found.append(("changed", "goal", L.read_contract(spark, f"{at}/goal_contract.json")["goal"]))
    found += [("changed", "problem", p) for p in L.load_contract(spark, f"{at}/goal_contract.json")[1]]
    try:
        L.init_package(spark, at, {"goal": "a"}, {"run_id": "r"}, contracts)
    except FileExistsError as e:
        found.append(("again", "refused", type(e).__name__))
    return spark.createDataFrame(found, "package string, rule_id string, file string")


# --- streams

def _arrivals(spark: SparkSession, rows: DataFrame, by: str | list[str], fmt: str) -> str:
    """A ledger as log files that arrive in several micro-batches, in no order of time."""
    at = folder(spark)
    with L.shuffles_deleted(spark):
        rows.repartition(6, F.hash(*([by] if isinstance(by, str) else by))).write.format(fmt).option("compression", "zstd" if fmt == "parquet" else "none").save(at)
    return at


@query("stream_latest", "SELECT user_id, max(event_id) FILTER (rn = 1) AS event_id, max(event_type) FILTER (rn = 1) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1")
def stream_latest(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    log, view = _arrivals(spark, rows, "event_id", "parquet"), folder(spark)
    state = logs.latest_stream(logs.read_log(spark, log, rows.schema, "parquet", files_per_batch=2), ["user_id"], ("ts", "event_id"))
    logs.replace_view(state, view, f"{view}-checkpoint").awaitTermination()
    return L.read_current(spark, view, state.schema, "parquet").select("user_id", "event_id", "event_type")


@query("stream_appended", "SELECT event_id, user_id, event_type FROM events")
def stream_appended(spark, d):
    """A log in which a third of the events arrive twice, appended by two streams of the same files: every event is there once."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    log, out = _arrivals(spark, rows.union(rows.where("event_id % 3 = 0")), "user_id", "json"), folder(spark)
    for run in ("first", "again"):
        logs.append_stream(logs.read_log(spark, log, rows.schema, files_per_batch=3), out, "event_id", ["user_id", "event_type"], f"{out}-{run}").awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def stream_merged(spark, d):
    """The current view that micro-batches of observations leave; batches cut through keys.

    The log holds lineitem's columns, of which the stream makes observations: their texts would take several times the disk.
    """
    of_id = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select(*of_id, "l_returnflag", "l_linestatus", "l_shipdate")
    log, store = _arrivals(spark, rows, of_id, "parquet"), folder(spark)
    observations = derived(spark, logs.read_log(spark, log, rows.schema, "parquet", files_per_batch=3, delete_read=True), "observations")
    logs.merge_stream(observations, store, f"{store}-view", f"{store}-checkpoint", "run-2").awaitTermination()
    from ..operators.merge import current_view
    schema = current_view(derived(spark, rows.limit(0), "observations"), "run-2").schema
    v = L.read_current(spark, f"{store}-view", schema, "parquet")
    return v.select("observation_key", F.col("value_json").alias("value"), F.col("selected_from_observation_id").alias("selected_from"), F.size("alternative_observation_ids").cast("long").alias("n_alternatives"),
                    F.array_join("alternative_observation_ids", ",").alias("alternatives"))


# --- ledgers against contracts

_CELLS = [f"CELL-{hashlib.sha256(json.dumps({'field': 'fa', 'target_id': f'T-{i}'}, separators=(',', ':')).encode()).hexdigest()[:24]}" for i in range(1, 51)]
_EXECUTORS = [{"executor_id": e, "capability_gap": "x", "reason": "x", "decision": "selected", "pilot_attempt_id": a} for e, a in (("e", "a-1"), ("x", "a-none"))]
RUN = run_rules.Contracts(
    goal={"depth": "exhaustive"},
    manifest={"schema_version": "1.5.0", "run_id": "r", "goal_id": "g", "input_snapshot": "s", "status": "complete", "coordination": {"child_agent_decision": "single_lane", "external_executor_decisions": _EXECUTORS},
              "collection_control": {"selector_policy": "p", "discovery_mode": "frontier_ledger", "max_task_escalations": 1}},
    fields={"required_fields": ["fa", "f0"], "optional_fields": ["f1"]},
    plan={"required_cells": _CELLS, "required_frontier_ids": [f"f-{i}" for i in range(46)], "required_source_classes": ["c", "d"]})


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of decisions with planted faults, from supplier."""
    k = F.col("s_suppkey")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    one = F.struct(text("T-", k % 300).alias("target_id"), F.lit("route-0").alias("selected_route_id"))
    picks = F.when(k % 6 == 0, F.array().cast("array<struct<target_id:string,selected_route_id:string>>")).when(k % 11 == 0, F.array(one, one)).otherwise(F.array(one))
    return table(spark, d, "supplier").select(
        text("BDEC-", k - (k % 23 == 0).cast("int")).alias("decision_id"), F.lit("r").alias("run_id"), F.when(k % 19 == 0, "g2").otherwise("g").alias("goal_id"), F.lit("s").alias("input_snapshot"),
        F.lit("t").alias("decided_at"), F.lit("v").alias("selector_version"),
        F.struct(F.when(k % 7 == 0, "other").otherwise("p").alias("name"), F.lit(1).alias("limit"), F.lit(1).alias("exploration_slots"), F.lit(1).alias("max_attempts_per_target_route")).alias("policy"),
        F.create_map(F.lit("attempts"), F.when(k % 5 == 0, "short").otherwise(F.sha2(k.cast("string").cast("binary"), 256))).alias("ledger_snapshot"), picks.alias("selected"),
        F.when(k % 17 == 0, -1).otherwise(3).alias("candidate_count"), F.when(k % 13 == 0, 5).otherwise(F.size(picks)).alias("selected_count"), F.lit(0).alias("unresolved_required_cells"),
        F.lit(0).alias("actionable_required_cells"), F.array(text("f-", k % 45)).alias("open_frontier_ids"), F.lit(True).alias("discovery_complete"), F.lit("{}").alias("exclusion_counts"),
        F.when(k % 8 == 0, "halt").when(k % 9 == 0, "blocked_only").otherwise("continue").alias("stop_decision"))


_DECISIONS = """decisions_ AS (SELECT s_suppkey AS k, 'BDEC-' || (s_suppkey - CASE WHEN s_suppkey % 23 = 0 THEN 1 ELSE 0 END) AS decision_id,
    CASE WHEN s_suppkey % 13 = 0 THEN 5 WHEN s_suppkey % 6 = 0 THEN 0 WHEN s_suppkey % 11 = 0 THEN 2 ELSE 1 END AS selected_count, CASE WHEN s_suppkey % 6 = 0 THEN 0 WHEN s_suppkey % 11 = 0 THEN 2 ELSE 1 END AS picks,
    CASE WHEN s_suppkey % 8 = 0 THEN 'halt' WHEN s_suppkey % 9 = 0 THEN 'blocked_only' ELSE 'continue' END AS stop FROM supplier)"""


# --- nested values of a ledger's raw lines

@query("nested_values", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS row_key FROM orders)
    SELECT 'V28' AS rule_id, row_key, 'policy must be an object' AS message FROM o WHERE k % 5 = 0
    UNION ALL SELECT 'V30', row_key, 'discovery_complete must be a boolean' FROM o WHERE k % 7 = 0
    UNION ALL SELECT 'V30', row_key, 'open_frontier_ids must be a list of different texts' FROM o WHERE k % 11 IN (0, 1, 2)
    UNION ALL SELECT 'V29', row_key, 'candidate_count must be an integer' FROM o WHERE k % 13 IN (0, 1)
    UNION ALL SELECT 'V29', row_key, 'selected[1]: ' || concat_ws('; ', CASE WHEN k % 17 = 0 THEN 'missing keys: route_metrics' END, CASE WHEN k % 3 = 0 THEN 'coverage_debt must be 1 or more' END) FROM o WHERE k % 17 = 0 OR k % 3 = 0""")
def nested_values(spark, d):
    """Kinds of nested values, and selected items, of decisions given as JSON text; from orders, with planted faults."""
    k = F.col("o_orderkey")
    pick = lambda n, faults, other: reduce(lambda c, x: c.when(k % n == x[0], x[1]), faults[1:], F.when(k % n == faults[0][0], faults[0][1])).otherwise(other)
    keys = [x for x in validate.SELECTED_KEYS.split() if x not in ("coverage_debt", "required_fields", "route_metrics")]
    item = lambda debt, metrics: F.concat(F.lit("{" + "".join(f'"{x}":"x",' for x in keys) + '"required_fields":["f"]'), metrics, F.lit(',"coverage_debt":'), debt, F.lit("}"))
    metrics = ',"route_metrics":{"n":1}'
    raw = F.concat(
        F.lit('{"policy":'), pick(5, [(0, '"p"')], '{"name":"p"}'), F.lit(',"discovery_complete":'), pick(7, [(0, "1")], "true"),
        F.lit(',"open_frontier_ids":'), pick(11, [(0, '["f","f"]'), (1, '["f",1]'), (2, '"f"')], '["f"]'), F.lit(',"candidate_count":'), pick(13, [(0, "1.5"), (1, "true")], k.cast("string")),
        F.lit(',"selected":['), item(F.lit("1"), F.lit(metrics)), F.lit(","), item((k % 3).cast("string"), pick(17, [(0, "")], metrics)), F.lit("]}"))
    rows = table(spark, d, "orders").select(k.cast("string").alias("decision_id"), raw.alias("raw_line"))
    return reduce(DataFrame.union, [run({"decisions": rows}) for run in validate.NESTED_DECISIONS]).select("rule_id", "row_key", "message")


def _found(name: str, where: str, message: str, severity: str = "error", key: str | None = None, source: str | None = None) -> str:
    key = key or f"CAST({validate.KEYS[name]} AS VARCHAR)"
    return f"SELECT '{severity}', '{name}', {key}, '{message}' FROM {source or name + '_'} WHERE {where}"


def _plain(rule: str) -> list[str]:
    return [f"SELECT 'error', * FROM ({x})" for x in CHECKS[rule]]


def _values(items: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in items) + ") AS need(id)"


_NEED = _values(RUN.plan["required_frontier_ids"])
_STATE = "SELECT frontier_id, arg_max(state, (event_at, line)) AS state FROM frontier_ GROUP BY 1"
_CELL = "'CELL-' || substr(sha256('{\"field\":\"' || field || '\",\"target_id\":\"' || target_id || '\"}'), 1, 24)"
_PLANNED = "(SELECT target_id, unnest(coverage_fields) AS field FROM targets_)"
_ALONE = "(SELECT 1)"
#: Rule, the ledgers it is asked of, and SQL that finds (severity, table_name, row_key, message) in the same rows.
RULES: dict[str, tuple[tuple[str, ...], list[str]]] = {
    "V22": (("frontier",), [f"SELECT 'error', 'coverage_plan', id, 'unknown required frontier' FROM {_NEED} WHERE id NOT IN (SELECT frontier_id FROM frontier_)",
                            f"SELECT 'error', 'coverage_plan', id, 'no required frontier of this source class' FROM (VALUES ('c'), ('d')) AS c(id) WHERE id NOT IN (SELECT source_class FROM frontier_ WHERE frontier_id IN (SELECT id FROM {_NEED}))",
                            f"SELECT 'warning', 'frontier', id, 'completed run, open frontier' FROM {_NEED} WHERE id NOT IN (SELECT frontier_id FROM ({_STATE}) WHERE state IN ('exhausted', 'blocked'))"]),
    "V23": (("targets",), [*_plain("V23"), f"SELECT 'error', 'targets', target_id, 'field is not in the contract: ' || field FROM {_PLANNED} WHERE field NOT IN ('fa', 'f0', 'f1')"]),
    "V25": (("targets",), [f"SELECT 'error', 'targets', target_id, 'cell is not among required_cells: ' || {_CELL} FROM {_PLANNED} WHERE {_CELL} NOT IN (SELECT id FROM {_values(_CELLS)})"]),
    "V28": (("decisions",), [_found("decisions", "k % 5 = 0", "ledger_snapshot must map ledgers to digests"), _found("decisions", "k % 7 = 0", "policy differs from collection_control"),
                             _found("decisions", "k % 19 = 0", "goal_id differs from the manifest''s"), "SELECT 'error', 'decisions', decision_id, 'duplicate decision_id' FROM decisions_ GROUP BY 2, 3 HAVING count(*) > 1"]),
    "V29": (("decisions", "targets"), [_found("decisions", "picks <> selected_count OR picks = 2", "selected targets repeat or their count differs"),
                                       _found("decisions", "k % 17 = 0", "candidate_count, selected_count, unresolved_required_cells, actionable_required_cells must be 0 or more"),
                                       "SELECT 'error', 'decisions', decision_id, 'unknown target_id T-' || k % 300 FROM decisions_, generate_series(1, picks) WHERE 'T-' || k % 300 NOT IN (SELECT target_id FROM targets_)"]),
    "V30": (("decisions", "frontier"), [_found("decisions", "stop = 'halt'", "invalid stop_decision"), _found("decisions", "(stop = 'continue') <> (selected_count > 0)", "continue and a selection must go together"),
                                        "SELECT 'error', 'decisions', decision_id, 'unknown open_frontier_ids f-' || k % 45 FROM decisions_ WHERE 'f-' || k % 45 NOT IN (SELECT frontier_id FROM frontier_)"]),
    "V32": (("attempts",), [f"SELECT 'error', 'run_manifest', id, 'unknown pilot_attempt_id' FROM {_values(['a-1', 'a-none'])} WHERE id NOT IN (SELECT attempt_id FROM attempts_)"]),
    "V33": (("attempts",), [_found("contracts", "EXISTS (SELECT 1 FROM attempts_ WHERE cost IS NOT NULL)", "costs without a cost_unit", "warning", "NULL", _ALONE)]),
    "V38": (("tasks",), [*_plain("V38"), _found("tasks", "goal_id <> 'g'", "goal_id differs from the manifest''s")]),
    "V40": (("tasks",), [*_plain("V40"), _found("tasks", "max_escalations > 1", "max_escalations is above the run''s")]),
    "V43": (("tasks",), [_found("contracts", "EXISTS (SELECT 1 FROM tasks_ WHERE runner_class = 'child_agent')", "delegation and child_agent tasks must go together", "error", "NULL", _ALONE),
                         f"SELECT 'error', 'run_manifest', id, 'selected executor has no task' FROM {_values(['e', 'x'])} WHERE id NOT IN (SELECT executor_id FROM tasks_ WHERE runner_class = 'external_cli')"]),
    "V47": (("observations", "claims"), [_found("contracts", "EXISTS (SELECT 1 FROM observations_)", text, "warning", "NULL", _ALONE) for text in ("observations without coverage", "observations without attempts")]
            + [_found("contracts", "EXISTS (SELECT 1 FROM observations_) AND EXISTS (SELECT 1 FROM claims_)", "claims without a current view", "warning", "NULL", _ALONE)]
            + [_found("contracts", "true", text, "warning", "NULL", _ALONE) for text in ("data dictionary without unit_of_analysis", "exhaustive run without stop_conditions")]),
}


def _run_query(rule: str, names: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        have = ledgers(spark, d)
        tables = {n: decisions(spark, d) if n == "decisions" else have[n] for n in names}
        return run_rules.check_run(spark, tables, RUN).where(F.col("rule_id") == rule).select("severity", "table_name", "row_key", "message")
    return run


for _rule, (_names, _parts) in RULES.items():
    RUN_QUERIES[f"run_{_rule}"] = _run_query(_rule, _names)
    _all = " UNION ALL ".join(_parts)
    _with = [_DECISIONS if n == "decisions" else DUCK[n] for n in [*DUCK, "decisions"] if f"{n}_" in _all]
    RUN_SQL[f"run_{_rule}"] = f"WITH {', '.join(_with)} SELECT * FROM ({_all}) AS found(severity, table_name, row_key, message)".replace("sha_2(", "sha256(").replace(", 256)", ")")


@query("run_V48", f"WITH {DUCK['frontier']} SELECT 'error' AS severity, frontier_id AS row_key FROM ({_STATE}) WHERE state NOT IN ('exhausted', 'blocked')")
def run_v48(spark, d):
    """A strict check turns warnings into errors."""
    return validate.check_package({"frontier": ledgers(spark, d)["frontier"]}, {"V22"}, strict=True).select("severity", "row_key")


# --- contracts alone: each case changes one thing of a run without issues

_GOAL = dict.fromkeys(run_rules.CONTRACT_KEYS["goal_contract"].split(), "x") | {"schema_version": "1.5.0", "goal_id": "g", "depth": "quick", "required_fields": ["f"], "optional_fields": [], "excluded_fields": ["n"]}
_BOTH = {"schema_version": "1.5.0", "goal_id": "g"}
_SOUND = {
    "goal": _GOAL,
    "manifest": dict.fromkeys(run_rules.CONTRACT_KEYS["run_manifest"].split(), "x") | _BOTH | {"depth": "quick", "coordination": {
        "assessed": True, "independent_lane_count": 2, "child_agent_decision": "unavailable", "child_agent_reason": "x", "external_executor_decisions": _EXECUTORS}, "collection_control": {
        "discovery_assessed": True, "discovery_mode": "bounded_plan", "discovery_reason": "x", "selector_policy": "p", "max_attempts_per_target_route": 2, "max_task_escalations": 0, "exploration_slots": 0}},
    "dictionary": _BOTH | {"unit_of_analysis": "u", "key_fields": [], "fields": {"f": {}}},
    "fields": _BOTH | {"required_fields": ["f"], "optional_fields": [], "excluded_fields": ["n"], "extractor_output_fields": ["f"], "acceptance_fields": ["f"]},
    "plan": _BOTH | {"required_fields": ["f"]},
}
#: Path of the value changed, new value (... deletes it), and the rules and severities that this breaks.
_CASES: list[tuple[str, object, str]] = [
    ("goal.goal", "x", ""), ("goal.deliverables", ..., "V04:error"), ("dictionary.key_fields", ..., "V13:error"), ("goal.mode", "y", "V05:error"), ("goal.as_of", "y", "V05:error"), ("goal.depth", "deep", "V05:error V06:error"),
    ("manifest.input_snapshot", "0", "V07:error"), ("manifest.coordination", 1, "V08:error"), ("manifest.coordination.assessed", "yes", "V08:error"), ("manifest.coordination.independent_lane_count", True, "V08:error"),
    ("manifest.coordination.independent_lane_count", -1, "V08:error"), ("manifest.coordination.child_agent_decision", "maybe", "V08:error"), ("manifest.coordination.child_agent_decision", "single_lane", "V09:error"),
    ("manifest.coordination.child_agent_reason", " ", "V09:error"), ("manifest.coordination.external_executor_decisions", [1], "V10:error"), ("manifest.coordination.assessed", False, "V11:warning"),
    ("manifest.coordination.external_executor_decisions", [_EXECUTORS[0] | {"reason": ""}], "V10:error"), ("manifest.coordination.external_executor_decisions", [_EXECUTORS[0] | {"decision": "later"}], "V10:error"),
    ("manifest.coordination.external_executor_decisions", [_EXECUTORS[0] | {"pilot_attempt_id": None}], "V10:error"), ("manifest.collection_control", [], "V12:error"),
    ("manifest.collection_control.discovery_mode", "guess", "V12:error"), ("manifest.collection_control.discovery_reason", "", "V12:error"), ("manifest.collection_control.max_attempts_per_target_route", 0, "V12:error"),
    ("manifest.collection_control.exploration_slots", 1.5, "V12:error"), ("manifest.collection_control.discovery_assessed", False, "V11:warning"), ("manifest.collection_control.selector_policy", "", "V12:error"),
    ("dictionary.goal_id", "h", "V13:error"), ("plan.schema_version", "1.4.0", "V13:error"), ("fields.goal_id", "h", "V14:error"), ("plan.required_fields", ["g"], "V15:error"), ("goal.excluded_fields", [], "V15:error"),
    ("fields.excluded_fields", ["f"], "V15:error V15:error V16:error"), ("dictionary.fields", {}, "V16:error"), ("dictionary.fields", {"f": {}, "n": {}}, "V16:error"), ("fields.extractor_output_fields", [], "V17:error"),
    ("fields.acceptance_fields", ["f", "o"], "V17:error"),
]


def _changed(path: str, value: object) -> run_rules.Contracts:
    c = json.loads(json.dumps(_SOUND))
    *way, last = path.split(".")
    at = reduce(lambda x, k: x[k], way, c)
    if value is ...:
        del at[last]
    else:
        at[last] = value
    if path != "manifest.input_snapshot":
        c["manifest"]["input_snapshot"] = hashlib.sha256(json.dumps(c["goal"], sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return run_rules.Contracts(**c)


@query("contract_rules", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{path}', '{broken}')" for i, (path, _, broken) in enumerate(_CASES)) + ") AS t(case_no, changed, broken)")
def contract_rules(spark, d):
    rows = [(i, path, " ".join(f"{rule}:{severity}" for rule, severity, _ in sorted(run_rules.contract_issues(_changed(path, value))))) for i, (path, value, _) in enumerate(_CASES)]
    return spark.createDataFrame(rows, "case_no int, changed string, broken string")
