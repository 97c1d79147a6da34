"""The run report: one JSON object over a run's ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attempts as A
from . import coverage as C
from . import frontier as FR
from .validate import Tables, check_package


def tasks_by_runner(tasks: DataFrame) -> DataFrame:
    runner = F.coalesce(F.when(F.col("runner_class") != "", F.col("runner_class")), F.lit("unspecified"))
    return tasks.groupBy(runner.alias("runner_class")).agg(F.count("*").alias("tasks"))


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The last decision by time, then place in the log; no row if there is none."""
    order = F.struct(F.coalesce("decided_at", F.lit("")), *(["line"] if "line" in decisions.columns else ["decision_id"]))
    one = decisions.agg(F.max_by(F.struct("decision_id", "stop_decision", "selected_count"), order).alias("d"))
    return one.where("d is not null").select("d.*")


def raw_payloads(artifacts: DataFrame) -> DataFrame:
    """One row: artifact rows, and the distinct payloads they stand for."""
    return artifacts.agg(F.count("*").alias("artifacts"), F.count_distinct(F.when(F.col("sha256") != "", F.col("sha256"))).alias("payloads"))


def observation_counts(observations: DataFrame) -> DataFrame:
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return observations.agg(F.count("*").alias("rows"), F.count_distinct(filled("observation_id")).alias("ids"), F.count_distinct(filled("observation_key")).alias("keys"))


def table_counts(tables: Tables) -> DataFrame:
    """(table_name, rows) of every table given."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule_id", "severity", "table_name").agg(F.count("*").alias("issues"))


def attempt_errors(attempts: DataFrame) -> DataFrame:
    """Issues of the rules that attempts must pass before they are summed up."""
    return check_package({"attempts": attempts}, only={"V26", "V27"}).where("severity = 'error'")


def run_report(spark: SparkSession, tables: Tables, manifest: dict, fields: dict | None = None) -> dict:
    """The report of a run: pipeline, recovery, failures, observations, field coverage, efficiency, coordination, control loop
    and yield by batch. Attempts with errors are refused. Every part is an aggregate over ledgers with at most a row per
    field, adapter, route, executor or batch, and that is what reaches the driver. Tables not given are left out.
    """
    att = tables["attempts"]
    bad = attempt_errors(att).limit(5).collect()
    if bad:
        raise ValueError(f"attempts with errors: {[(r['rule_id'], r['row_key'], r['message']) for r in bad]}")
    fields = fields or {}
    one = lambda df: df.first().asDict(recursive=True) if df.columns else {}
    by = lambda df, key: {r[key]: {k: v for k, v in r.asDict(recursive=True).items() if k != key} for r in df.orderBy(key).collect()}
    count = lambda df, key, n: {r[key]: r[n] for r in df.orderBy(key).collect()}
    out = {
        "run_id": manifest.get("run_id"), "cost_unit": manifest.get("cost_unit"), "coordination": manifest.get("coordination"), "collection_control": manifest.get("collection_control"),
        "pipeline": one(A.pipeline_funnel(att)), "stages": by(A.stage_summary(att), "stage"), "recovery": one(A.retry_recovery(att)),
        "failures": {"attempts_by_status": count(A.failure_histogram(att), "status", "attempts"), "final_targets_by_status": count(A.final_status(att), "status", "targets")},
        "efficiency": one(A.efficiency(att)), "adapters": by(A.adapter_summary(att), "adapter"),
        "routes": by(A.efficiency(att.withColumn("route", A.route_of_report()), "route"), "route"),
        "executors": by(A.efficiency(att.withColumn("executor", A.executor_of_report()), "executor"), "executor"),
        "batches": [r.asDict() for r in A.batch_yield(att).orderBy("first_start", "batch_id").collect()],
        "rows": count(table_counts(tables), "table_name", "rows")}
    if "observations" in tables:
        out["observations"] = one(observation_counts(tables["observations"]))
    if "coverage" in tables:
        out["coverage"] = one(C.totals(tables["coverage"]))
        if "observations" in tables:
            out["fields"] = by(C.field_summary(tables["coverage"], tables["observations"], fields.get("required_fields") or [], fields.get("optional_fields") or []), "field")
    if "raw_artifacts" in tables:
        out["raw"] = one(raw_payloads(tables["raw_artifacts"]))
    if "tasks" in tables:
        out["tasks_by_runner_class"] = count(tasks_by_runner(tables["tasks"]), "runner_class", "tasks")
    if "frontier" in tables:
        states = FR.frontier_summary(tables["frontier"])
        out["frontier_states"] = count(states, "state", "frontiers")
    if "decisions" in tables:
        found = latest_decision(tables["decisions"]).collect()
        out["latest_decision"] = found[0].asDict() if found else None
    return out


def validation_report(tables: Tables, issues: DataFrame | None = None) -> dict:
    """Rows of every table, and issues by rule; passed if there is no error."""
    found = issues if issues is not None else check_package(tables)
    kinds = [r.asDict() for r in issue_counts(found).orderBy("rule_id", "severity", "table_name").collect()]
    total = lambda s: sum(r["issues"] for r in kinds if r["severity"] == s)
    return {"rows": {r["table_name"]: r["rows"] for r in table_counts(tables).collect()}, "issues": kinds, "errors": total("error"), "warnings": total("warning"), "passed": total("error") == 0}
