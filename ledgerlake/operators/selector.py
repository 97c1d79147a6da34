"""Choosing the next batch: coverage debt, routes, leases, and a constrained top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import json_map, json_object, json_text, stable_id
from ..functions.vocab import ACTIVE_TASKS, HARD_FAILURE, TERMINAL_SELECTOR
from .attempts import route_metrics, route_of_selector
from .frontier import discovery_complete, open_frontiers
from .latest import ATTEMPT, COVERAGE_SELECT, latest

SELECTOR_VERSION, POLICY_NAME = "1.0.0", "coverage_first_yield_adaptive"
PRIOR = {"success_probability": 0.5, "expected_new_records": 0.5, "utility": 0.25}


@dataclass(frozen=True)
class Policy:
    limit: int
    exploration_slots: int = 1
    max_attempts: int = 2
    required_fields: tuple[str, ...] = ()
    required_classes: tuple[str, ...] = ()


def target_routes(targets: DataFrame, last: DataFrame) -> DataFrame:
    """(target, route): the candidates of each target, its requested next route first if it is none of them."""
    joined = targets.join(last.select("target_id", "next_route_id"), "target_id", "left")
    own = F.coalesce(F.col("route_candidates"), F.array("route_id"))
    extra = F.when(F.col("next_route_id").isNotNull() & (F.col("next_route_id") != ""), F.array("next_route_id")).otherwise(F.array().cast("array<string>"))
    return joined.select("target_id", "next_route_id", F.explode(F.array_distinct(F.concat(extra, own))).alias("route"))


def best_routes(targets: DataFrame, attempts: DataFrame, policy: Policy) -> DataFrame:
    """The runnable route of highest utility of each target, ties by name; targets without one are absent."""
    att = attempts.withColumn("route", route_of_selector())
    order = tuple(c for c in ATTEMPT if c in att.columns)
    last = latest(att.select("target_id", "next_route_id", *order), ["target_id"], order)
    used = att.groupBy("target_id", "route").agg(F.max("attempt_no").alias("tries"), F.max_by("status", F.struct(*order)).alias("last_status"))
    routes = target_routes(targets, last).join(used, ["target_id", "route"], "left")
    hard = F.coalesce(F.col("last_status").isin(*HARD_FAILURE), F.lit(False)) & ~F.coalesce(F.col("route") == F.col("next_route_id"), F.lit(False))
    open_ = routes.where((F.coalesce("tries", F.lit(0)) < policy.max_attempts) & ~hard).join(route_metrics(attempts), "route", "left")
    open_ = open_.withColumns({"executions": F.coalesce("executions", F.lit(0).cast("long")), **{k: F.coalesce(F.col(k), F.lit(v)) for k, v in PRIOR.items()}})
    pick = F.min_by(F.struct("route", "executions", "utility", "success_probability", "expected_new_records"), F.struct(-F.col("utility"), F.col("route")))
    return open_.groupBy("target_id").agg(pick.alias("r")).select("target_id", F.col("r.route").alias("selected_route_id"), "r.executions", "r.utility", "r.success_probability", "r.expected_new_records")


def gaps(targets: DataFrame, coverage: DataFrame, policy: Policy) -> DataFrame:
    """Per target: required cells that aren't terminal, and those of them that may be worked on."""
    order = tuple(c for c in COVERAGE_SELECT if c in coverage.columns)
    now = latest(coverage.select("target_id", "field_scope", "state", *[c for c in order if c != "state"]), ["target_id", "field_scope"], order)
    plan = targets.select("target_id", "next_route_known", F.explode("coverage_fields").alias("field_scope"))
    if policy.required_fields:
        plan = plan.where(F.col("field_scope").isin(*policy.required_fields))
    c = plan.join(now.select("target_id", "field_scope", "state"), ["target_id", "field_scope"], "left").withColumn("state", F.coalesce("state", F.lit("unchecked")))
    due = ~F.col("state").isin(*TERMINAL_SELECTOR)
    stuck = (F.col("state") == "blocked") & ~F.col("next_route_known")
    return c.groupBy("target_id").agg(F.count_if(due).alias("unresolved"), F.count_if(due & ~stuck).alias("debt"), F.count_if(stuck).alias("stuck"))


def candidates(targets: DataFrame, coverage: DataFrame, attempts: DataFrame, tasks: DataFrame, policy: Policy) -> DataFrame:
    """Every target with its debt, best route and the reason that excludes it, if any."""
    order = tuple(c for c in ATTEMPT if c in attempts.columns)
    last = latest(attempts.select("target_id", "next_route_id", *order), ["target_id"], order).select("target_id", (F.coalesce("next_route_id", F.lit("")) != "").alias("next_route_known"))
    t = targets.join(last, "target_id", "left").withColumn("next_route_known", F.coalesce("next_route_known", F.lit(False)))
    leased = tasks.where(F.col("status").isin(*ACTIVE_TASKS) & (F.col("partition_key") != "")).select("partition_key").distinct().withColumn("leased", F.lit(True))
    out = t.join(gaps(t, coverage, policy), "target_id", "left").join(leased, "partition_key", "left").join(best_routes(targets, attempts, policy), "target_id", "left")
    no_debt = F.coalesce("debt", F.lit(0)) == 0
    reason = (F.when(no_debt & (F.coalesce("stuck", F.lit(0)) > 0), "blocked_coverage_terminal").when(no_debt, "required_coverage_terminal")
              .when(F.coalesce("leased", F.lit(False)), "active_partition_lease").when(F.col("selected_route_id").isNull(), "retry_or_route_exhausted"))
    return out.withColumn("exclusion", reason).withColumn("required_class", F.col("source_class").isin(*policy.required_classes) if policy.required_classes else F.lit(False))


def ranking() -> list[Column]:
    return [F.col("debt").desc(), F.col("required_class").desc(), F.col("utility").desc(), F.col("priority").desc(), F.col("target_id").asc()]


def select_batch(cand: DataFrame, policy: Policy) -> DataFrame:
    """At most `limit` candidates: first routes never tried, then one of each class not yet there, then by rank.

    As sets: phase 1 is the top of the untried ones; phase 2 the first of every class that phase 1 lacks; phase 3 the
    rest. Only `limit` rows of any phase can be chosen, so each phase keeps that many by a top-k per task.
    """
    spark = cand.sparkSession
    ok = cand.where("exclusion is null")
    slots = min(policy.exploration_slots, policy.limit)
    explore = ok.where("executions = 0").orderBy(*ranking()).limit(slots).select("target_id", "source_class") if slots else spark.createDataFrame([], "target_id string, source_class string")
    firsts = ok.join(F.broadcast(explore.select("source_class").distinct()), "source_class", "left_anti")  # at most `slots` rows
    classed = firsts.withColumn("_rn", F.row_number().over(Window.partitionBy("source_class").orderBy(*ranking()))).where("_rn = 1").select("target_id", F.lit(2).alias("_p"))
    phase1 = explore.select("target_id", F.lit(1).alias("_p"))
    marks = phase1.union(classed)
    rows = ok.join(marks, "target_id", "left").withColumn("phase", F.coalesce("_p", F.lit(3)))
    reason = F.element_at(F.create_map(F.lit(1), F.lit("explore_untried_route"), F.lit(2), F.lit("source_class_fairness"), F.lit(3), F.lit("coverage_debt_utility")), F.col("phase"))
    return rows.withColumn("selection_reason", reason).orderBy("phase", *ranking()).limit(policy.limit)


def decide(cand: DataFrame, frontier: DataFrame, policy: Policy, mode: str = "bounded_plan", assessed: bool = True, required_frontiers: list[str] = ()) -> dict:
    """The decision: picks (at most `limit`), counts, open frontiers and why to stop, if so."""
    picks = select_batch(cand, policy).select("target_id", "selected_route_id", "debt", "utility", "selection_reason").collect()
    sums = cand.agg(F.sum("unresolved"), F.sum("debt"), F.count_if(F.col("exclusion").isNull()), F.count_if(F.col("exclusion") == "retry_or_route_exhausted")).first()
    excluded = {r["exclusion"]: r["count"] for r in cand.where("exclusion is not null").groupBy("exclusion").count().collect()}
    complete = discovery_complete(frontier, mode, assessed, required_frontiers)
    open_ = sorted(r[0] for r in open_frontiers(frontier).collect())  # the decision row lists them all
    actionable = sums[1] or 0
    if picks:
        stop = "continue"
    elif actionable == 0 and complete:
        stop = "coverage_complete"
    elif open_ or not complete:
        stop = "discovery_incomplete"
    elif sums[3]:
        stop = "blocked_only"
    else:
        stop = "no_eligible_targets"
    return {"selected": [r.asDict() for r in picks], "selected_count": len(picks), "candidate_count": sums[2], "unresolved_required_cells": sums[0] or 0,
            "actionable_required_cells": actionable, "exclusion_counts": excluded, "discovery_complete": complete, "open_frontier_ids": open_, "stop_decision": stop}


def decision_id() -> Column:
    """The id of a decision row from what was decided: run, snapshots, policy, picks in order, and the stop decision."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    policy = json_object(name=json_text(F.col("policy.name")), **{k: number(f"policy.{k}") for k in ("limit", "exploration_slots", "max_attempts_per_target_route")})
    picks = F.transform("selected", lambda s: json_object(selected_route_id=json_text(s["selected_route_id"]), target_id=json_text(s["target_id"])))
    basis = {c: json_text(F.col(c)) for c in ("run_id", "input_snapshot", "selector_version", "stop_decision")}
    return stable_id("BDEC", json_object(policy=policy, ledger_snapshot=json_map(F.col("ledger_snapshot")), selected=F.concat(F.lit("["), F.array_join(picks, ","), F.lit("]")), **basis))


def ledger_digest(df: DataFrame) -> str:
    """A SHA-256 hex digest of a ledger's rows, whatever their order and layout; repeated rows count."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string") for seed in (1, 2, 3)]
    return df.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256)).first()[0]


def record_decision(decision: DataFrame, existing: DataFrame) -> tuple[DataFrame, bool]:
    """(the decision that holds, whether it is to be appended): an earlier row of the same id takes its place."""
    prior = existing.join(F.broadcast(decision.select("decision_id")), "decision_id", "left_semi")  # one row
    return (decision, True) if prior.isEmpty() else (prior, False)


DECISION_SCHEMA = ("run_id string, goal_id string, input_snapshot string, decided_at string, selector_version string, "
                   "policy struct<name:string,limit:bigint,exploration_slots:bigint,max_attempts_per_target_route:bigint>, ledger_snapshot map<string,string>, "
                   "selected array<struct<target_id:string,selected_route_id:string,debt:bigint,utility:double,selection_reason:string>>, selected_count bigint, candidate_count bigint, "
                   "unresolved_required_cells bigint, actionable_required_cells bigint, exclusion_counts map<string,bigint>, discovery_complete boolean, open_frontier_ids array<string>, stop_decision string")


def decision_row(decision: dict, policy: Policy, manifest: dict, ledgers: dict[str, DataFrame], decided_at: str) -> DataFrame:
    """The row that records a decision, for an idempotent append; ledgers are those that it was based on."""
    spark = next(iter(ledgers.values())).sparkSession
    given = (POLICY_NAME, policy.limit, min(policy.exploration_slots, policy.limit), policy.max_attempts)
    row = decision | {k: manifest.get(k) for k in ("run_id", "goal_id", "input_snapshot")} | {
        "decided_at": decided_at, "selector_version": SELECTOR_VERSION, "policy": given, "ledger_snapshot": {n: ledger_digest(df) for n, df in sorted(ledgers.items())}}
    return spark.createDataFrame([row], DECISION_SCHEMA).select(decision_id().alias("decision_id"), "*")
