"""Merging observation ledgers into a current view and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import strength_rank
from ..functions.vocab import FIELD_KINDS, STRENGTHS

NEEDED = ["observation_id", "run_id", "observation_key", "field_kind", "value_json", "source_strength", "observed_at", "retrieved_at"]


def id_conflicts(obs: DataFrame) -> DataFrame:
    """Observation ids that stand for several payloads."""
    body = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(payload_columns(obs)) if c != "observation_id"]), {"ignoreNullFields": "false"}), 256)
    return obs.groupBy("observation_id").agg(F.count("*").alias("rows"), F.count_distinct(body).alias("payloads")).where("payloads > 1")


def payload_columns(obs: DataFrame) -> list[str]:
    """Columns of an observation itself, without what reading it has added: its line's text and place."""
    return [c for c in obs.columns if not c.startswith("_") and c not in ("raw_line", "line")]


def problems(obs: DataFrame) -> DataFrame:
    """(observation_id, problem): observations that may not be merged."""
    time = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("timestamp")
    none = F.lit(False)
    problem = (F.when(F.col("observation_id").isNull() | F.col("observation_key").isNull(), "without id or key").when(~F.coalesce(F.col("field_kind").isin(*FIELD_KINDS), none), "invalid field_kind")
               .when(~F.coalesce(F.col("source_strength").isin(*STRENGTHS), none), "invalid source_strength")
               .when(time("observed_at").isNull() | time("retrieved_at").isNull(), "time can't be read"))
    return obs.select("observation_id", problem.alias("problem")).where("problem is not null")


def materializable(obs: DataFrame) -> DataFrame:
    """One row per id, without null values and rows whose value_state, where given, isn't present.

    An explicit null counts as given where raw_line tells it from a missing key.
    """
    return _usable(obs.dropDuplicates(["observation_id"]))


def _usable(obs: DataFrame) -> DataFrame:
    out = obs.where(F.col("value_json").isNotNull() & (F.col("value_json") != "null"))
    if "value_state" in obs.columns:
        given = F.coalesce(F.array_contains(F.json_object_keys("raw_line"), "value_state"), F.lit(False)) if "raw_line" in obs.columns else F.lit(False)
        out = out.where(F.coalesce(F.col("value_state"), F.when(given, "null").otherwise("present")) == "present")
    return out


def kind_conflicts(obs: DataFrame) -> DataFrame:
    """Keys whose materialisable observations disagree on their kind."""
    return materializable(obs).groupBy("observation_key").agg(F.count_distinct("field_kind").alias("kinds")).where("kinds > 1")


def _ranking(current_run: str | None) -> tuple[Column, Column]:
    """(whether the current-run rule leaves an observation, what the observations of a key are ranked by)."""
    dynamic = F.col("field_kind") == "dynamic"
    current = F.col("run_id") == F.lit(current_run)
    inside = ~dynamic | current if current_run is not None else F.lit(True)
    rank = strength_rank(F.col("source_strength")).cast("long")
    when, got = F.col("observed_at").try_cast("timestamp").cast("double"), F.col("retrieved_at").try_cast("timestamp").cast("double")
    none = F.lit(0.0)
    return inside, F.struct(F.when(dynamic, when).otherwise(none), rank, F.when(dynamic, none).otherwise(when), got, F.col("observation_id"))


def _keyed(obs: DataFrame, current_run: str | None) -> DataFrame:
    """An aggregate row per key: counts, the winner, ids and values of the candidates left after the current-run rule."""
    inside, order = _ranking(current_run)
    use = lambda c: F.when(inside, c)
    return materializable(obs).groupBy("observation_key").agg(
        F.max("field_kind").alias("field_kind"), F.count_if(inside).alias("candidates"),
        F.max_by(use(F.struct(*[c for c in obs.columns if c != "observation_key"])), use(order)).alias("winner"),
        F.array_sort(F.collect_list(use(F.col("observation_id")))).alias("ids"), F.array_sort(F.collect_set(use(F.col("value_json")))).alias("vals"),
        F.array_sort(F.collect_list("observation_id")).alias("all_ids"), F.array_sort(F.collect_set("value_json")).alias("all_vals"))


def current_view(obs: DataFrame, current_run: str | None = None) -> DataFrame:
    """The winning observation of each key, with the ids it beat.

    Dynamic fields rank by observation time, then strength, then retrieval time; others by strength, then times; the
    id breaks ties. With a current run, dynamic fields only use that run's rows, and keys without any have no row.
    """
    k = _keyed(obs, current_run).where("candidates > 0")
    rest = [F.col(f"winner.{c}").alias(c) for c in payload_columns(obs) if c != "observation_key"]
    return k.select("observation_key", *rest, F.col("winner.observation_id").alias("selected_from_observation_id"),
                    F.array_except("ids", F.array("winner.observation_id")).alias("alternative_observation_ids"))


def extended_view(view: DataFrame, obs: DataFrame, current_run: str | None = None) -> DataFrame:
    """The current view of what view, of the same current run, was made from and of obs; obs may repeat observations, but
    ids must not stand for several payloads. The ranking is total, so a beaten observation never wins later and its id is enough."""
    inside, order = _ranking(current_run)
    own = [c for c in payload_columns(obs) if c != "observation_key"]
    new = _usable(obs).where(inside).select("observation_key", *own, F.array().cast("array<string>").alias("_beaten"))
    old = view.select("observation_key", *own, F.col("alternative_observation_ids").alias("_beaten"))
    k = new.unionByName(old).groupBy("observation_key").agg(
        F.max_by(F.struct(*own), order).alias("winner"), F.array_sort(F.collect_set("observation_id")).alias("ids"), F.flatten(F.collect_list("_beaten")).alias("beaten"))
    return k.select("observation_key", *[F.col(f"winner.{c}").alias(c) for c in own], F.col("winner.observation_id").alias("selected_from_observation_id"),
                    F.array_sort(F.array_except(F.array_union("ids", "beaten"), F.array("winner.observation_id"))).alias("alternative_observation_ids"))


def conflicts(obs: DataFrame, current_run: str | None = None) -> DataFrame:
    """Keys with several values, and dynamic keys that the current run lacks."""
    k = _keyed(obs, current_run)
    stale = F.col("candidates") == 0
    return k.where(stale | (F.size("vals") > 1)).select(
        "observation_key", F.when(stale, "stale_only").otherwise("competing_values").alias("conflict_type"),
        F.when(~stale, F.col("winner.observation_id")).alias("selected_observation_id"),
        F.when(stale, F.col("all_ids")).otherwise(F.array_except("ids", F.array("winner.observation_id"))).alias("alternative_observation_ids"),
        F.when(stale, F.col("all_vals")).otherwise(F.col("vals")).alias("values"))


def merge(obs: DataFrame, current_run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(current view, conflicts), each to be written in order of its key; observations that may not be merged, ids with several
    payloads and keys of several kinds are errors."""
    for bad, what in ((problems(obs), "observations that may not be merged"), (id_conflicts(obs), "ids with several payloads"), (kind_conflicts(obs), "keys of several kinds")):
        found = bad.limit(5).collect()
        if found:
            raise ValueError(f"{what}: {[tuple(r)[:2] for r in found]}")
    return current_view(obs, current_run).orderBy("observation_key"), conflicts(obs, current_run).orderBy("observation_key")


def receipt(obs: DataFrame, current_run: str | None = None) -> DataFrame:
    """One row: rows read, distinct ids, keys of the current view, and conflicts by kind; one pass over the keys."""
    k = _keyed(obs, current_run).agg(F.count_if(F.col("candidates") > 0).alias("current_keys"), F.count_if(F.col("candidates") == 0).alias("stale_only"),
                                     F.count_if((F.col("candidates") > 0) & (F.size("vals") > 1)).alias("competing"))
    return obs.agg(F.count("*").alias("input_rows"), F.count_distinct("observation_id").alias("unique_observations")).crossJoin(k)  # one row each
