"""Rules that hold ledgers against contracts: a valid run has no issue, each mutation its rule."""

import copy
import hashlib
import json

import pytest

from ledgerlake.functions.expr import version_of
from ledgerlake.operators import run_rules as R
from ledgerlake.operators import selector as S

GOAL = {"schema_version": "1.5.0", "goal_id": "g", "goal": "x", "decision_use": "x", "mode": "m", "depth": "quick", "in_scope": [], "out_of_scope": [], "deliverables": [], "must_preserve": [],
        "success_conditions": [], "stop_conditions": [], "assumptions": [], "as_of": "2026-01-01", "change_log": [], "required_fields": ["f"], "optional_fields": [], "excluded_fields": []}
MANIFEST = {"schema_version": "1.5.0", "run_id": "r", "goal_id": "g", "mode": "m", "depth": "quick", "created_at": "x", "as_of": "2026-01-01", "status": "complete", "cost_unit": "credits",
            "coordination": {"assessed": True, "independent_lane_count": 1, "child_agent_decision": "single_lane", "child_agent_reason": "", "external_executor_decisions": [
                {"executor_id": "e", "capability_gap": "x", "decision": "failed_pilot", "reason": "x", "pilot_attempt_id": "A-1"}]},
            "collection_control": {"discovery_assessed": True, "discovery_mode": "bounded_plan", "discovery_reason": "x", "selector_policy": S.POLICY_NAME, "max_attempts_per_target_route": 2,
                                   "max_task_escalations": 1, "exploration_slots": 1}}
BOTH = {"schema_version": "1.5.0", "goal_id": "g"}
FIELDS = BOTH | {"required_fields": ["f"], "optional_fields": [], "excluded_fields": [], "extractor_output_fields": ["f"], "acceptance_fields": ["f"]}
CELL = "CELL-" + hashlib.sha256(b'{"field":"f","target_id":"T-1"}').hexdigest()[:24]
PLAN = BOTH | {"required_fields": ["f"], "required_cells": [CELL], "required_frontier_ids": [], "required_source_classes": []}


def contracts(**change):
    goal, manifest, plan, fields = (copy.deepcopy(x) for x in (GOAL, MANIFEST, PLAN, FIELDS))
    manifest["input_snapshot"] = hashlib.sha256(json.dumps(goal, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    for path, value in change.items():
        at = {"goal": goal, "manifest": manifest, "plan": plan, "fields": fields}
        *way, last = path.split("__")
        for step in way:
            at = at[step]
        at[last] = value
    return R.Contracts(goal, manifest, BOTH | {"unit_of_analysis": "u", "key_fields": [], "fields": {"f": {}}}, fields, plan)


@pytest.fixture(scope="module")
def tables(spark):
    line = lambda needs: json.dumps(dict.fromkeys(needs.split()))
    from ledgerlake.operators.validate import REQUIRED
    targets = spark.createDataFrame([("T-1", "r", "g", ["f"], "r1", ["r1"], [], 0, line(REQUIRED["targets"]))],
                                    "target_id string, run_id string, goal_id string, coverage_fields array<string>, route_id string, route_candidates array<string>, frontier_ids array<string>, shard_id long, raw_line string")
    attempts = spark.createDataFrame([("A-1", "T-1", "r", "fetch", "success", 1, 0.5, None, None, line(REQUIRED["attempts"]))],
                                     "attempt_id string, target_id string, run_id string, stage string, status string, attempt_no long, cost double, error_category string, retry_of_attempt_id string, raw_line string")
    return {"targets": targets, "attempts": attempts}


def rules(spark, tables, **change):
    return {r["rule_id"] for r in R.check_run(spark, tables, contracts(**change)).collect()}


def test_valid_run_has_no_issue(spark, tables):
    assert R.check_run(spark, tables, contracts()).collect() == []
    assert "V04" in {r["rule_id"] for r in R.check_run(spark, {}, R.Contracts({}, {})).collect()}


@pytest.mark.parametrize("want, change", [
    ("V06", {"goal__depth": "deep"}), ("V08", {"manifest__coordination__assessed": "yes"}), ("V08", {"manifest__coordination": None}), ("V09", {"manifest__coordination__independent_lane_count": 2}),
    ("V10", {"manifest__coordination__external_executor_decisions": [{}]}), ("V11", {"manifest__collection_control__discovery_assessed": False}),
    ("V12", {"manifest__collection_control__exploration_slots": True}), ("V23", {"fields__required_fields": ["other"]}), ("V25", {"plan__required_cells": []}),
    ("V26", {"manifest__run_id": "other"}), ("V32", {"manifest__coordination__external_executor_decisions": [
        {"executor_id": "e", "capability_gap": "x", "decision": "selected", "reason": "x", "pilot_attempt_id": "A-9"}]}),
    ("V33", {"manifest__cost_unit": None}), ("V22", {"manifest__collection_control__discovery_mode": "frontier_ledger"}), ("V47", {"goal__depth": "exhaustive"})])
def test_each_mutation_breaks_its_rule(spark, tables, want, change):
    only = {"V23": ["targets"], "V25": ["targets"], "V26": ["attempts"], "V32": ["attempts"], "V33": ["attempts"]}.get(want, [])
    assert want in rules(spark, {k: tables[k] for k in only}, **change)


def test_frontiers_of_a_completed_run(spark):
    frontier = spark.createDataFrame([("E-1", "F-1", "c1", "active", "2026-01-01"), ("E-2", "F-1", "c1", "exhausted", "2026-01-02"), ("E-3", "F-2", "c1", "active", "2026-01-01")],
                                     "frontier_event_id string, frontier_id string, source_class string, state string, event_at string")
    change = {"manifest__collection_control__discovery_mode": "frontier_ledger", "plan__required_source_classes": ["c1", "c2"], "plan__required_frontier_ids": ["F-1", "F-2", "F-3"]}
    found = [i for part in R._frontiers(contracts(**change), frontier) for i in part.collect()]
    assert sorted((i["severity"], i["row_key"]) for i in found) == [("error", "F-3"), ("error", "c2"), ("warning", "F-2"), ("warning", "F-3")]


def test_decision_row_has_the_id_of_its_basis(spark, tables):
    decision = {"selected": [{"target_id": 'T-"1"', "selected_route_id": "r1", "debt": 1, "utility": 0.5, "selection_reason": "x"}], "selected_count": 1, "candidate_count": 1, "unresolved_required_cells": 1,
                "actionable_required_cells": 1, "exclusion_counts": {}, "discovery_complete": True, "open_frontier_ids": [], "stop_decision": "continue"}
    row = S.decision_row(decision, S.Policy(limit=5), contracts().manifest, tables, "2026-01-01T00:00:00Z")
    r = row.first()
    basis = {k: r[k] for k in ("run_id", "input_snapshot", "selector_version", "stop_decision", "ledger_snapshot")}
    basis |= {"policy": r["policy"].asDict(), "selected": [{"target_id": 'T-"1"', "selected_route_id": "r1"}]}
    assert r["decision_id"] == "BDEC-" + hashlib.sha256(json.dumps(basis, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]
    found = lambda df: {i["rule_id"] for part in R._decisions(contracts(), df) for i in part.collect()}
    assert found(row) == set() and found(row.drop("stop_decision").selectExpr("*", "'blocked_only' as stop_decision")) == {"V31"}
    assert S.ledger_digest(tables["attempts"]) == S.ledger_digest(tables["attempts"].repartition(3)) != S.ledger_digest(tables["attempts"].union(tables["attempts"]))


def test_kinds_of_nested_values(spark):
    """Rows of raw JSON, read by a plain restatement too; values missing or null are not these rules' matter."""
    from ledgerlake.operators import validate
    values = ["{}", '{"a": 1}', "[]", '["a"]', '["a", "a"]', '["a", " "]', '["a", 1]', "[null]", "1", "12345678901234567890123", "1.5", "true", '"x"', '""', "null"]
    unique = lambda v: isinstance(v, list) and all(isinstance(x, str) and x.strip() for x in v) and len(set(v)) == len(v)
    checks = {"policy": ("V28", lambda v: isinstance(v, dict)), "open_frontier_ids": ("V30", unique), "discovery_complete": ("V30", lambda v: isinstance(v, bool)),
              "candidate_count": ("V29", lambda v: isinstance(v, int) and not isinstance(v, bool)), "selected": ("V29", lambda v: isinstance(v, list))}
    rows, want = [], set()
    for name, (rule, good) in checks.items():
        for i, text in enumerate(values):
            rows.append((f"{name}-{i}", f'{{"{name}": {text}}}'))
            if json.loads(text) is not None and not good(json.loads(text)):
                want.add((rule, f"{name}-{i}"))
    item = dict.fromkeys(validate.SELECTED_KEYS.split(), "x") | {"coverage_debt": 1, "required_fields": ["f"]}
    items = {"good": item, "route": item | {"selected_route_id": ""}, "number": item | {"selected_route_id": 3}, "debt": item | {"coverage_debt": 0}, "half": item | {"coverage_debt": 1.5},
             "fields": item | {"required_fields": ["f", "f"]}, "key": {k: v for k, v in item.items() if k != "route_metrics"}, "none": None, "list": []}
    rows += [(f"item-{k}", json.dumps({"selected": [item, v]})) for k, v in items.items()] + [("broken", "{"), ("null", None)]
    want |= {("V29", f"item-{k}") for k in items if k != "good"}
    df = spark.createDataFrame(rows, "decision_id string, raw_line string")
    ours = validate.NESTED_DECISIONS
    found = [tuple(r) for run in ours for r in run({"decisions": df}).select("rule_id", "row_key", "message").collect()]
    assert {(a, b) for a, b, m in found if not (b.startswith("selected-") and m.startswith("selected["))} == want
    assert ("V29", "item-key", "selected[1]: missing keys: route_metrics") in found
    assert all(run({"decisions": df.drop("raw_line")}).count() == 0 for run in ours)


def test_versions_on_the_driver():
    assert version_of("1.10.0") > version_of("1.5.0") > version_of("x") == version_of(None) == ()
