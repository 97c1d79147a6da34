"""Integrity rules that hold a run package's ledgers against its one-row contracts.

Contracts are dicts; ledgers are DataFrames. A ledger whose table is not given counts as empty where a rule asks
whether it has rows. Rules that a schema version introduced apply from that version of the run manifest on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import json_object, json_text, stable_id, version_of
from .latest import FRONTIER, latest
from .selector import decision_id
from .validate import ISSUE_SCHEMA, Tables, _issues, check_contracts, check_package

# Required keys of the contracts.
CONTRACT_KEYS = {
    "goal_contract": "schema_version goal_id goal decision_use mode depth in_scope out_of_scope deliverables must_preserve success_conditions stop_conditions assumptions as_of change_log",
    "run_manifest": "schema_version run_id goal_id mode depth created_at as_of input_snapshot status",
    "data_dictionary": "schema_version goal_id unit_of_analysis key_fields fields",
}
FIELD_SETS = "required_fields optional_fields excluded_fields"
#: Columns of each ledger that repeat a value of the manifest, and the rule that says so.
REPEATED = {
    "frontier": ("V19", ("run_id", "goal_id")), "targets": ("V23", ("run_id", "goal_id")), "attempts": ("V26", ("run_id",)),
    "decisions": ("V28", ("run_id", "goal_id", "input_snapshot")), "raw_artifacts": ("V35", ("run_id",)), "tasks": ("V38", ("goal_id", "input_snapshot")),
}


@dataclass(frozen=True)
class Contracts:
    goal: dict
    manifest: dict
    dictionary: dict = field(default_factory=dict)
    fields: dict = field(default_factory=dict)
    plan: dict = field(default_factory=dict)

    def since(self, gate: str) -> bool:
        return version_of(self.manifest.get("schema_version")) >= V.GATES[gate]

    def part(self, name: str) -> dict:
        value = self.manifest.get(name)
        return value if isinstance(value, dict) else {}


def contract_issues(c: Contracts) -> list[tuple[str, str, str]]:
    """(rule, severity, message) of rules that need no ledger: required keys, then those of check_contracts()."""
    out = []
    keys = {**CONTRACT_KEYS, "goal_contract": CONTRACT_KEYS["goal_contract"] + (f" {FIELD_SETS}" if c.since("field_contract") else "")}
    for name, value in (("goal_contract", c.goal), ("run_manifest", c.manifest), ("data_dictionary", c.dictionary)):
        missing = [k for k in keys[name].split() if k not in value]
        if missing:
            out.append(("V13" if name == "data_dictionary" else "V04", "error", f"{name} lacks {','.join(missing)}"))
    return out + check_contracts(c.goal, c.manifest, c.dictionary, c.fields if c.since("field_contract") else None, c.plan)


def _repeated(c: Contracts, t: Tables) -> list[DataFrame]:
    out = []
    for table, (rule, columns) in REPEATED.items():
        for name in columns if table in t else ():
            if name in t[table].columns:
                out.append(_issues(t[table].where(~F.col(name).eqNullSafe(F.lit(c.manifest.get(name)).cast("string"))), rule, table, f"{name} differs from the manifest's"))
    return out


def _decisions(c: Contracts, decisions: DataFrame) -> list[DataFrame]:
    digests = F.map_values("ledger_snapshot")
    bad = F.col("ledger_snapshot").isNull() | (F.size("ledger_snapshot") == 0) | F.exists(digests, lambda d: F.coalesce(F.length(d) != 64, F.lit(True)))
    out = [_issues(decisions.where(bad), "V28", "decisions", "ledger_snapshot must map ledgers to digests"),
           _issues(decisions.where(F.col("decision_id") != decision_id()), "V31", "decisions", "decision_id does not match what was decided")]
    if c.since("adaptive"):
        name = F.lit(c.part("collection_control").get("selector_policy")).cast("string")
        out.append(_issues(decisions.where(~F.col("policy.name").eqNullSafe(name)), "V28", "decisions", "policy differs from collection_control"))
    return out


def _planned(c: Contracts, targets: DataFrame) -> list[DataFrame]:
    spark = targets.sparkSession
    cells = targets.select("target_id", F.explode("coverage_fields").alias("field"))
    allowed = [(x,) for k in ("required_fields", "optional_fields") for x in c.fields.get(k) or []]
    outside = cells.join(F.broadcast(spark.createDataFrame(allowed, "field string")), "field", "left_anti")  # a contract's list
    cell = stable_id("CELL", json_object(field=json_text(F.col("field")), target_id=json_text(F.col("target_id"))))
    # as long as the plan, so this list is joined, not broadcast by hint
    known = spark.createDataFrame([(x,) for x in c.plan.get("required_cells") or []], "cell_id string")
    missing = cells.withColumn("cell_id", cell).join(known, "cell_id", "left_anti")
    return [_issues(outside, "V23", "targets", F.concat(F.lit("field is not in the contract: "), F.col("field"))),
            _issues(missing, "V25", "targets", F.concat(F.lit("cell is not among required_cells: "), F.col("cell_id")))]


def _frontiers(c: Contracts, frontier: DataFrame) -> list[DataFrame]:
    """Rules of required frontiers; with a discovery mode of frontier_ledger also of source classes and open ends."""
    spark, run = frontier.sparkSession, []
    need = spark.createDataFrame([(x,) for x in c.plan.get("required_frontier_ids") or []], "frontier_id string")
    run.append(_issues(need.join(frontier, "frontier_id", "left_anti"), "V22", "coverage_plan", "unknown required frontier", key="frontier_id"))
    if c.part("collection_control").get("discovery_mode") == "frontier_ledger":
        now = latest(frontier, ["frontier_id"], tuple(x for x in FRONTIER if x in frontier.columns)).join(need, "frontier_id", "left_semi")
        classes = spark.createDataFrame([(x,) for x in c.plan.get("required_source_classes") or []], "source_class string")
        run.append(_issues(classes.join(now, "source_class", "left_anti"), "V22", "coverage_plan", "no required frontier of this source class", key="source_class"))
        if c.manifest.get("status") == "complete":
            ended = now.where(F.col("state").isin(*V.TERMINAL_FRONTIER))
            run.append(_issues(need.join(ended, "frontier_id", "left_anti"), "V22", "frontier", "completed run, open frontier", "warning", key="frontier_id"))
    return run


def _executors(c: Contracts, spark: SparkSession, t: Tables) -> list[DataFrame]:
    entries = [d for d in c.part("coordination").get("external_executor_decisions") or [] if isinstance(d, dict)]
    out = []
    if "attempts" in t:
        pilots = [(d["pilot_attempt_id"],) for d in entries if d.get("decision") in ("selected", "failed_pilot") and isinstance(d.get("pilot_attempt_id"), str)]
        out.append(_issues(spark.createDataFrame(pilots, "attempt_id string").join(t["attempts"], "attempt_id", "left_anti"), "V32", "run_manifest", "unknown pilot_attempt_id", key="attempt_id"))
    if "tasks" in t:
        chosen = sorted({d["executor_id"] for d in entries if d.get("decision") == "selected" and isinstance(d.get("executor_id"), str)})
        owners = t["tasks"].where("runner_class = 'external_cli'")
        out.append(_issues(spark.createDataFrame([(x,) for x in chosen], "executor_id string").join(owners, "executor_id", "left_anti"), "V43", "run_manifest", "selected executor has no task", key="executor_id"))
        cap = c.part("collection_control").get("max_task_escalations")
        if c.since("adaptive") and isinstance(cap, int):
            out.append(_issues(t["tasks"].where(F.col("max_escalations") > cap), "V40", "tasks", "max_escalations is above the run's"))
    return out


def _whole_run(c: Contracts, t: Tables) -> list[tuple[str, str, str]]:
    """Rules that ask whether ledgers have rows; each probe stops at the first row."""
    has = {name: name in t and not t[name].isEmpty() for name in ("observations", "coverage", "attempts", "claims", "current_view")}
    deep, exhaustive = c.goal.get("depth") in ("standard", "exhaustive"), c.goal.get("depth") == "exhaustive"
    out = [
        ("V47", "warning", "observations without coverage", has["observations"] and not has["coverage"]),
        ("V47", "warning", "observations without attempts", has["observations"] and not has["attempts"]),
        ("V47", "warning", "data dictionary without unit_of_analysis", deep and not c.dictionary.get("unit_of_analysis")),
        ("V47", "warning", "coverage plan without required_source_classes", deep and not c.plan.get("required_source_classes")),
        ("V47", "error", "exhaustive run without required cells", exhaustive and not c.plan.get("required_cells")),
        ("V47", "warning", "exhaustive run without stop_conditions", exhaustive and not c.goal.get("stop_conditions")),
        ("V47", "warning", "claims without a current view", has["claims"] and has["observations"] and not has["current_view"]),
    ]
    unit = c.manifest.get("cost_unit")
    costs = has["attempts"] and "cost" in t["attempts"].columns and not (isinstance(unit, str) and unit)
    out.append(("V33", "warning", "costs without a cost_unit", costs and not t["attempts"].where("cost is not null").isEmpty()))
    if c.since("routing") and "tasks" in t:
        delegated = c.part("coordination").get("child_agent_decision") == "delegated"
        child = not t["tasks"].where("runner_class = 'child_agent'").isEmpty()
        out.append(("V43", "error", "delegation and child_agent tasks must go together", delegated != child))
    if c.since("adaptive"):
        ledger_mode = c.part("collection_control").get("discovery_mode") == "frontier_ledger"
        out.append(("V22", "error", "frontier_ledger needs required_frontier_ids", ledger_mode and not c.plan.get("required_frontier_ids")))
    return [(rule, severity, text) for rule, severity, text, bad in out if bad]


def check_run(spark: SparkSession, tables: Tables, contracts: Contracts, strict: bool = False) -> DataFrame:
    """All issues of a run package: (rule_id, severity, table_name, row_key, message).

    tables are named as in check_package(), whose rules are included, but for its plain rule of open frontiers: here
    only required frontiers of a completed run have to be closed. row_key is null for issues of a contract.
    """
    c = contracts
    one_row = contract_issues(c) + _whole_run(c, tables)
    parts = [spark.createDataFrame([(rule, severity, "contracts", None, text) for rule, severity, text in one_row], ISSUE_SCHEMA)]
    if tables:
        parts.append(check_package(tables).where("not (rule_id = 'V22' and severity = 'warning')"))
    parts += _repeated(c, tables)
    if "decisions" in tables:
        parts += _decisions(c, tables["decisions"])
    if "targets" in tables and c.since("targets"):
        parts += _planned(c, tables["targets"])
    if "frontier" in tables and c.since("adaptive"):
        parts += _frontiers(c, tables["frontier"])
    if c.since("routing"):
        parts += _executors(c, spark, tables)
    out = reduce(DataFrame.union, parts)
    return out.withColumn("severity", F.lit("error")) if strict else out
