"""Collection planning: axes to targets and coverage cells."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import canonical_json, canonical_url, hash_shard, json_object, json_raw_map, json_text, quote_plus, shard_name, stable_id, version_of
from ..functions.vocab import GATES

PLANNER_VERSION = "1.1.0"


def check_spec(spec: dict) -> list[str]:
    """Problems of a plan specification."""
    out = []
    axes, templates = spec.get("axes"), spec.get("templates")
    if not isinstance(axes, dict) or not all(isinstance(v, list) and v and len(set(map(json.dumps, v))) == len(v) for v in axes.values()):
        out.append("axes must be lists of distinct values, none empty")
        axes = {}
    if any(isinstance(x, (dict, list)) for v in axes.values() for x in v):
        out.append("axis values must be scalar")
    if not isinstance(spec.get("shard_count", 1), int) or isinstance(spec.get("shard_count", 1), bool) or spec.get("shard_count", 1) < 1:
        out.append("shard_count must be a positive integer")
    if not isinstance(templates, list) or not templates:
        return out + ["templates must be a list that isn't empty"]
    ids = [t.get("template_id") for t in templates]
    if len(set(ids)) < len(ids) or not all(isinstance(i, str) and i for i in ids):
        out.append("template_id must be distinct strings")
    for t in templates:
        vary, fixed = t.get("vary_by") or [], t.get("fixed_dimensions") or {}
        for name in vary:
            if name not in axes:
                out.append(f"{t.get('template_id')}: unknown axis {name}")
        for name in (t.get("identity_axes") or []) + (t.get("url_encode_axes") or []):
            if name not in vary and name not in fixed:
                out.append(f"{t.get('template_id')}: {name} is no dimension")
        for name in re.findall(r"{([^{}]*)}", t.get("locator_template") or ""):
            if name not in vary and name not in fixed:
                out.append(f"{t.get('template_id')}: locator names unknown dimension {name}")
        if not t.get("coverage_fields") or len(set(t["coverage_fields"])) < len(t["coverage_fields"]):
            out.append(f"{t.get('template_id')}: coverage_fields must be distinct and not empty")
        if not isinstance(t.get("priority", 0), int) or isinstance(t.get("priority", 0), bool):
            out.append(f"{t.get('template_id')}: priority must be an integer")
        for name in ("target_type", "page_type", "source_class", "route_id"):
            if name in t and not (isinstance(t[name], str) and t[name].strip()):
                out.append(f"{t.get('template_id')}: {name} must be a text that isn't empty")
    return out


def combinations(spark: SparkSession, axes: dict[str, list], vary_by: list[str], fixed: dict) -> DataFrame:
    """Every combination of axis values: maps `dimensions` (values as text) and `dimensions_json` (as JSON text).

    Varying dimensions override fixed ones; values may be texts, numbers, booleans or null, and repeated ones count
    once. This Cartesian product is the operator itself; its size is that of the plan.
    """
    out = spark.range(0, 1, 1, 1).select()
    for i, name in enumerate(vary_by):
        values = sorted({canonical_json(v): str(v) for v in axes[name]}.items())
        axis = spark.createDataFrame([((text, js),) for js, text in values], f"`{name}` struct<text:string,json:string>")
        out = out.crossJoin(axis.coalesce(1) if i else axis)  # the first axis deals the product over tasks
    dims = {k: F.struct(F.lit(str(v)).alias("text"), F.lit(canonical_json(v)).alias("json")) for k, v in fixed.items()} | {n: F.col(f"`{n}`") for n in vary_by}
    names = F.array(*[F.lit(k) for k in dims]).cast("array<string>")
    maps = [F.map_from_arrays(names, F.array(*[c[part] for c in dims.values()]).cast("array<string>")).alias(name) for part, name in (("text", "dimensions"), ("json", "dimensions_json"))]
    return out.select(*maps)


def exclude(combos: DataFrame, rules: list[dict], template_id: str) -> DataFrame:
    """Combinations that no rule matches in all its entries; the empty rule matches every combination."""
    for rule in rules:
        hit = F.lit(True)
        for k, v in rule.items():
            have = F.lit(canonical_json(template_id)) if k == "template_id" else F.coalesce(F.try_element_at("dimensions_json", F.lit(k)), F.lit("null"))
            hit = hit & (have == F.lit(canonical_json(v)))
        combos = combos.where(~hit)
    return combos


def plan(spark: SparkSession, spec: dict, run_id: str = "", goal_id: str = "", schema_version: str = "1.5.0") -> tuple[DataFrame, DataFrame]:
    """(targets, cells) of a plan specification. Ids depend on the schema version: since the adaptive gate a target is
    told apart by page type and source class, before that by its route."""
    problems = check_spec(spec)
    if problems:
        raise ValueError("; ".join(problems))
    parts = []
    for t in sorted(spec["templates"], key=lambda t: t["template_id"]):
        fixed, vary = t.get("fixed_dimensions") or {}, t.get("vary_by") or []
        combos = exclude(combinations(spark, spec["axes"], vary, fixed), spec.get("exclude") or [], t["template_id"])
        dim = lambda n: F.element_at("dimensions", F.lit(n))  # noqa: B023, E731
        encode = set(t.get("url_encode_axes") or [])
        pieces = [F.lit(x) if i % 2 == 0 else (quote_plus(dim(x)) if x in encode else dim(x)) for i, x in enumerate(re.split(r"{([^{}]*)}", t["locator_template"]))]
        wanted = t.get("identity_axes", vary)
        original, route = F.concat(*pieces), t.get("route_id", "unassigned").strip()
        routes = [route, *sorted({r for r in t.get("route_candidates") or [] if r != route})]
        parts.append(combos.select(
            F.lit(run_id).alias("run_id"), F.lit(goal_id).alias("goal_id"), F.lit(t["template_id"]).alias("template_id"), F.lit(t.get("target_type", "source_target")).alias("target_type"),
            F.lit(t.get("page_type", "unknown")).alias("page_type"), F.lit(t.get("source_class", "unknown")).alias("source_class"), F.lit(route).alias("route_id"),
            F.array(*[F.lit(x) for x in routes]).alias("route_candidates"),
            F.array(*[F.lit(x) for x in t.get("frontier_ids") or []]).cast("array<string>").alias("frontier_ids"),
            canonical_url(original).alias("locator"), original.alias("original_locator"), "dimensions", "dimensions_json",
            F.array_sort(F.array(*[F.lit(x) for x in t["coverage_fields"]])).alias("coverage_fields"), F.lit(int(t.get("priority", 0))).cast("long").alias("priority"),
            F.lit(spec.get("planned_at")).alias("planned_at"), F.lit(PLANNER_VERSION).alias("planner_version"),
            F.map_filter("dimensions_json", lambda k, _: k.isin(*wanted) if wanted else F.lit(False)).alias("_identity")))  # noqa: B023
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    targets = rows.withColumn("target_id", target_id(schema_version)).drop("_identity")
    shard = hash_shard(F.col("target_id"), int(spec.get("shard_count", 1)))
    targets = targets.withColumn("shard_id", shard).withColumn("partition_key", shard_name(F.col("template_id"), F.col("shard_id")))
    targets = targets.withColumn("batch_id", F.format_string("batch-%s-shard-%03d", "template_id", "shard_id"))
    return targets, cells(targets)


def target_id(schema_version: str) -> Column:
    """The id of a planned target from target_type, locator, the identity dimensions (`_identity`, JSON texts by name), and
    page_type and source_class, or route_id before the adaptive gate."""
    names = ("page_type", "source_class") if version_of(schema_version) >= GATES["adaptive"] else ("route_id",)
    return stable_id("T", json_object(dimensions=json_raw_map(F.col("_identity")), **{n: json_text(F.col(n)) for n in ("locator", "target_type", *names)}))


def cells(targets: DataFrame) -> DataFrame:
    """A row per target and field, unchecked, with the id of its planning attempt; columns that targets lacks are left out."""
    have = [c for c in ("run_id", "target_id", "source_class", "route_id") if c in targets.columns]
    extra = [F.col("dimensions").alias("object_scope"), F.try_element_at("dimensions", F.lit("market")).alias("market")] if "dimensions" in targets.columns else []
    one = targets.select(*have, *extra, F.explode(F.array_sort("coverage_fields")).alias("field_scope"), F.col("planned_at").alias("retrieved_at"))
    cell = stable_id("CELL", json_object(field=json_text(F.col("field_scope")), target_id=json_text(F.col("target_id"))))
    one = one.withColumn("cell_id", cell).withColumn("attempt_id", stable_id("PLAN", json_object(cell_id=json_text(F.col("cell_id")))))
    return one.withColumn("state", F.lit("unchecked")).withColumn("source_ids", F.array().cast("array<string>"))


def against_existing(targets: DataFrame, cells: DataFrame, old_targets: DataFrame, old_cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new targets, new cells) in order of their ids; a planned target that differs from the existing row of its id is an error."""
    payload = [c for c in targets.columns if c != "target_id" and c in old_targets.columns]
    body = lambda: F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    both = targets.select("target_id", body().alias("_new")).join(old_targets.select("target_id", body().alias("_old")), "target_id")
    clash = [r[0] for r in both.where("_new <> _old").select("target_id").limit(5).collect()]
    if clash:
        raise ValueError(f"existing targets conflict with the plan: {clash}")
    return (targets.join(old_targets.select("target_id"), "target_id", "left_anti").orderBy("target_id"),
            cells.join(old_cells.select("cell_id"), "cell_id", "left_anti").orderBy("cell_id"))


def updated_contract(contract: dict, spec: dict, cells: DataFrame) -> dict:
    """The coverage plan with what a plan adds: required cells and dimensions by union, the plan's hash and shards. The
    contract is one JSON object that lists every cell, so they are gathered here."""
    ids = {r[0] for r in cells.select("cell_id").distinct().collect()}
    return contract | {
        "required_cells": sorted({*map(str, contract.get("required_cells") or []), *ids}),
        "dimensions": sorted({*map(str, contract.get("dimensions") or []), *spec["axes"], "target", "field"}),
        "planner_version": PLANNER_VERSION, "last_plan_hash": hashlib.sha256(canonical_json(spec).encode()).hexdigest(), "shard_count": int(spec.get("shard_count", 1))}


def target_collisions(targets: DataFrame) -> DataFrame:
    """Target ids that stand for several rows."""
    return targets.groupBy("target_id").agg(F.count_distinct(F.struct("template_id", "locator", F.to_json("dimensions"))).alias("rows")).where("rows > 1")


def shard_histogram(targets: DataFrame, shards: int) -> DataFrame:
    """Targets by shard, empty shards included."""
    all_ = targets.sparkSession.range(shards).select(F.col("id").alias("shard_id"))
    return all_.join(targets.groupBy("shard_id").agg(F.count("*").alias("targets")), "shard_id", "left").na.fill(0)
