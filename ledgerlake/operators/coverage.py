"""Coverage cells: posture, field summary, pilot metrics, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.vocab import COVERAGE_STATES, TERMINAL_REPORT
from .latest import COVERAGE_REPORT, latest


def latest_cells(coverage: DataFrame) -> DataFrame:
    """The last state of each (target, field)."""
    return latest(coverage, ["target_id", "field_scope"], tuple(c for c in COVERAGE_REPORT if c in coverage.columns))


def posture(coverage: DataFrame) -> DataFrame:
    return latest_cells(coverage).groupBy(F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("cells"))


def totals(coverage: DataFrame) -> DataFrame:
    done = F.count_if(F.col("state").isin(*TERMINAL_REPORT))
    return latest_cells(coverage).agg(F.count("*").alias("cells"), done.alias("terminal_cells")).withColumn("terminal_rate", ratio(F.col("terminal_cells"), F.col("cells")))


def field_summary(coverage: DataFrame, observations: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Per field of the contract, the coverage or the observations: whether required or optional, observations, targets,
    keys, cells, terminal share, and the cells of each state as a map."""
    spark = coverage.sparkSession
    states = (*COVERAGE_STATES, "unknown")
    cells = latest_cells(coverage).groupBy(F.col("field_scope").alias("field")).agg(F.count("*").alias("planned"), F.count_if(F.col("state").isin(*TERMINAL_REPORT)).alias("terminal"),
        *[F.count_if(F.coalesce(F.col("state"), F.lit("unknown")) == x).alias(f"_{x}") for x in states])
    seen = observations.groupBy("field").agg(F.count("*").alias("observations"), F.count_distinct("target_id").alias("targets"), F.count_distinct("observation_key").alias("keys"))
    fields = spark.createDataFrame([(f,) for f in dict.fromkeys([*required, *optional])], "field string").union(cells.select("field")).union(seen.select("field")).distinct()
    counts = ["observations", "targets", "keys", "planned", "terminal"]
    out = fields.join(cells, "field", "left").join(seen, "field", "left").na.fill(0, counts)
    histogram = F.map_filter(F.create_map(*[x for s in states for x in (F.lit(s), F.coalesce(f"_{s}", F.lit(0)))]), lambda _, n: n > 0)
    among = lambda names: F.col("field").isin(*names) if names else F.lit(False)
    return out.select("field", among(required).alias("required"), among(optional).alias("optional"), *counts, ratio(F.col("terminal"), F.col("planned")).alias("terminal_rate"), histogram.alias("states"))


def select_targets(targets: DataFrame, target_ids: list[str] = (), batch_ids: list[str] = (), shard_ids: list[int] = ()) -> DataFrame:
    """Targets that pass every list given; an empty list is no restriction. No target left is an error."""
    for column, values in (("target_id", target_ids), ("batch_id", batch_ids), ("shard_id", shard_ids)):
        if values:
            targets = targets.where(F.col(column).isin(*values))
    if targets.isEmpty():
        raise LookupError("no target selected")
    return targets


def pilot_cells(targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every planned (target, field) with its last state, unchecked if it has none."""
    plan = targets.select("target_id", F.explode_outer("coverage_fields").alias("field_scope"))
    states = latest_cells(coverage.join(targets.select("target_id"), "target_id", "left_semi")).select("target_id", "field_scope", "state")
    return plan.join(states, ["target_id", "field_scope"], "left").withColumn("state", F.when(F.col("field_scope").isNotNull(), F.coalesce("state", F.lit("unchecked"))))


def pilot_metrics(targets: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: cells, terminal cells, hits, targets, terminal targets (one without fields is) and their rates."""
    done = F.col("state").isin(*TERMINAL_REPORT)
    per = pilot_cells(targets, coverage).groupBy("target_id").agg(F.count("field_scope").alias("cells"), F.count_if(done).alias("terminal"), F.count_if(F.col("state") == "checked_hit").alias("hits"))
    out = per.agg(F.sum("cells").alias("cells"), F.sum("terminal").alias("terminal_cells"), F.sum("hits").alias("hits"), F.count("*").alias("targets"), F.count_if(F.col("cells") == F.col("terminal")).alias("terminal_targets"))
    return out.withColumns({"terminal_cell_rate": ratio(F.col("terminal_cells"), F.col("cells")), "terminalization_rate": ratio(F.col("terminal_targets"), F.col("targets"))})


def pilot_consistency(targets: DataFrame, coverage: DataFrame, observations: DataFrame) -> DataFrame:
    """Cells that claim a hit without an observation, and observations without a hit."""
    hits = pilot_cells(targets, coverage).where("state = 'checked_hit'").select("target_id", F.col("field_scope").alias("field"), F.lit(True).alias("hit"))
    seen = observations.join(targets.select("target_id"), "target_id", "left_semi").select("target_id", "field").distinct().withColumn("seen", F.lit(True))
    both = hits.join(seen, ["target_id", "field"], "full_outer").where("hit is null or seen is null")
    return both.select("target_id", "field", F.when(F.col("seen").isNull(), "hit_without_observation").otherwise("observation_without_hit").alias("issue"))


def pilot_field_issues(targets: DataFrame, observations: DataFrame, contract_fields: list[str], extractor_fields: list[str]) -> DataFrame:
    """(target_id, field, issue): observations of the pilot's targets whose field the contract or the extractor lacks."""
    seen = observations.join(targets.select("target_id"), "target_id", "left_semi").select("target_id", "field")
    parts = [seen.where(~F.coalesce(F.col("field").isin(*names) if names else F.lit(False), F.lit(False))).withColumn("issue", F.lit(issue))
             for names, issue in ((contract_fields, "outside the field contract"), (extractor_fields, "not declared by the extractor"))]
    return parts[0].union(parts[1])


def completion_axes(coverage: DataFrame, attempts: DataFrame, frontier_latest: DataFrame) -> DataFrame:
    """The three completion axes: discovery (frontiers closed), collection (targets resolved), coverage (cells closed)."""
    from .attempts import pipeline_funnel

    cells = totals(coverage).select(F.lit("coverage").alias("axis"), F.col("terminal_cells").alias("done"), F.col("cells").alias("total"))
    funnel = pipeline_funnel(attempts).select(F.lit("collection"), F.col("discovered") - F.col("unresolved"), F.col("discovered"))
    fronts = frontier_latest.agg(F.count_if(F.col("state").isin("exhausted", "blocked")), F.count("*")).select(F.lit("discovery"), "*")
    return cells.union(funnel).union(fronts).withColumn("rate", ratio(F.col("done"), F.col("total")))
