"""Collection attempts: funnel, efficiency, retries, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import non_empty, ratio
from ..functions.vocab import HARD_FAILURE, NON_FAILURE, STAGES, SUCCESS
from .latest import ATTEMPT_REPORT, latest


def succeeded() -> Column:
    return F.col("status").isin(*SUCCESS)


def route_of_selector() -> Column:
    return F.coalesce(non_empty(F.col("route_id")), non_empty(F.col("adapter")), F.lit("unassigned"))


def route_of_report() -> Column:
    return F.coalesce(non_empty(F.col("route_id")), non_empty(F.col("route_version")), F.lit("unknown"))


def executor_of_report() -> Column:
    return F.coalesce(non_empty(F.col("executor_class")), F.lit("unspecified"))


def efficiency(attempts: DataFrame, *keys: str) -> DataFrame:
    """Measures of attempts by keys, or of all; sums are null where no row has a number."""
    good = succeeded()
    out = attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_distinct("target_id").alias("targets"), F.count_if(good).alias("successes"),
        F.coalesce(F.sum(F.when(good, F.col("new_record_count"))), F.lit(0)).alias("new_records"),
        F.coalesce(F.sum(F.when(good, F.col("valid_record_count"))), F.lit(0)).alias("valid_records"),
        F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("bytes_received").alias("bytes_received"), F.sum("cost").alias("cost"))
    new = F.nullif(F.col("new_records"), F.lit(0))
    tokens = F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return out.withColumns({"new_per_100": ratio(F.col("new_records") * 100, F.col("attempts")), "cost_per_new": ratio(F.col("cost"), new),
                            "elapsed_per_new": ratio(F.col("elapsed_ms"), new), "tokens_per_new": ratio(tokens, new)})


def efficiency_by(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """efficiency() for each of several single keys and for all rows in one scan: (grouping, key, measures)."""
    tags = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit(None).cast("string").alias("key")),
                             *[F.struct(F.lit(k).alias("grouping"), F.col(k).cast("string").alias("key")) for k in keys]))
    tagged = attempts.withColumn("_tag", tags).withColumns({"grouping": F.col("_tag.grouping"), "key": F.col("_tag.key")}).drop("_tag")
    return efficiency(tagged, "grouping", "key")


def stage_summary(attempts: DataFrame) -> DataFrame:
    """Every stage with its attempts, targets, successes and failures; stages without rows count 0."""
    spark = attempts.sparkSession
    found = attempts.groupBy("stage").agg(
        F.count("*").alias("attempts"), F.count_distinct("target_id").alias("targets"), F.count_if(succeeded()).alias("successes"),
        F.count_distinct(F.when(succeeded(), F.col("target_id"))).alias("successful_targets"), F.count_if(~F.col("status").isin(*NON_FAILURE)).alias("failures"))
    stages = spark.createDataFrame([(s,) for s in STAGES], "stage string")
    return stages.join(found, "stage", "left").na.fill(0)


def adapter_summary(attempts: DataFrame) -> DataFrame:
    """Per adapter: targets with a full success, targets with a usable result, their rates, and the measures of efficiency()."""
    found = attempts.groupBy("adapter").agg(F.count_distinct(F.when(F.col("status") == "success", F.col("target_id"))).alias("fully_successful_targets"),
                                            F.count_distinct(F.when(succeeded(), F.col("target_id"))).alias("usable_targets"))
    out = efficiency(attempts, "adapter").join(found, "adapter")
    return out.withColumns({"target_success_rate": ratio(F.col("fully_successful_targets"), F.col("targets")), "target_usable_rate": ratio(F.col("usable_targets"), F.col("targets"))})


def target_flags(attempts: DataFrame) -> DataFrame:
    """Per target: which steps of the funnel it reached."""
    good, stage = succeeded(), F.col("stage")
    late = stage.isin("fetch", "render", "parse", "extract")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return attempts.groupBy("target_id").agg(
        any_((stage == "discover") & good | late).alias("discovered"), any_(stage.isin("fetch", "render")).alias("fetch_attempted"),
        any_(stage.isin("fetch", "render") & good).alias("fetched"), any_(stage.isin("parse", "extract") & good).alias("parsed"),
        any_((stage == "extract") & good).alias("extracted"), any_((stage == "extract") & good & (F.col("valid_record_count") > 0)).alias("valid"),
        any_(F.col("status") == "skipped_duplicate").alias("duplicate"))


def pipeline_funnel(attempts: DataFrame) -> DataFrame:
    """One row: targets at each step, duplicates, unresolved ones (their last status failed) and four rates."""
    n = lambda c: F.count_if(c)
    c = F.col
    flags = target_flags(attempts)
    last = latest(attempts.select("target_id", *[x for x in ATTEMPT_REPORT], "status"), ["target_id"], ATTEMPT_REPORT).select("target_id", "status")
    both = flags.join(last, "target_id")
    return both.agg(
        n(c("discovered")).alias("discovered"), n(c("fetch_attempted")).alias("fetch_attempted"), n(c("fetched")).alias("fetched"), n(c("parsed")).alias("parsed"),
        n(c("extracted")).alias("extracted"), n(c("valid")).alias("valid"), n(c("duplicate")).alias("duplicate"),
        n(~c("status").isin(*NON_FAILURE)).alias("unresolved"), n(c("parsed") & c("fetched")).alias("_both")).select(
        "discovered", "fetch_attempted", "fetched", "parsed", "extracted", "valid", "duplicate", "unresolved",
        ratio(c("fetched"), c("fetch_attempted")).alias("fetch_rate"), ratio(c("_both"), c("fetched")).alias("parse_rate"),
        ratio(c("valid"), c("extracted")).alias("valid_rate"), ratio(c("valid"), c("discovered")).alias("end_to_end_rate"))


def final_status(attempts: DataFrame) -> DataFrame:
    last = latest(attempts.select("target_id", *ATTEMPT_REPORT, "status"), ["target_id"], ATTEMPT_REPORT)
    return last.groupBy("status").agg(F.count("*").alias("targets"))


def failure_histogram(attempts: DataFrame) -> DataFrame:
    return attempts.where(~F.col("status").isin(*NON_FAILURE)).groupBy("status").agg(F.count("*").alias("attempts"))


def retry_recovery(attempts: DataFrame) -> DataFrame:
    """One row: (target, stage) groups, those tried again, and those that failed first and succeeded later."""
    order = F.struct(*ATTEMPT_REPORT)
    g = attempts.groupBy("target_id", "stage").agg(F.count("*").alias("n"), F.min_by(succeeded(), order).alias("first_ok"), F.bool_or(succeeded()).alias("any_ok"))
    out = g.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("retried"), F.count_if((F.col("n") > 1) & ~F.col("first_ok") & F.col("any_ok")).alias("recovered"))
    return out.withColumn("recovery_rate", ratio(F.col("recovered"), F.col("retried")))


def batch_yield(attempts: DataFrame) -> DataFrame:
    """New records by batch in order of first start, with their running sum. Batches are few; ties go by batch_id."""
    b = attempts.groupBy("batch_id").agg(F.min("started_at").alias("first_start"), F.count("*").alias("attempts"),
                                         F.coalesce(F.sum(F.when(succeeded(), F.col("new_record_count"))), F.lit(0)).alias("new_records"))
    w = Window.orderBy("first_start", "batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.withColumn("cumulative_new", F.sum("new_records").over(w))


def executions(attempts: DataFrame) -> DataFrame:
    """(target, route, attempt_no) runs: the last status decides on success and blocking; records, time and cost add up."""
    order = F.struct("finished_at", "attempt_no", "attempt_id", *(["line"] if "line" in attempts.columns else []))
    return attempts.withColumn("route", route_of_selector()).groupBy("target_id", "route", "attempt_no").agg(
        F.max_by(succeeded(), order).alias("success"), F.sum(F.coalesce("new_record_count", F.lit(0))).alias("new_records"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0))).alias("elapsed_ms"), F.sum("cost").alias("cost"), F.count("cost").alias("costs"),
        F.max_by(F.col("status").isin(*HARD_FAILURE), order).alias("blocked"))


def route_metrics(attempts: DataFrame, rounded: bool = True) -> DataFrame:
    """Smoothed success and yield, penalties for time and cost, and the utility of each route."""
    short = F.bround if rounded else lambda c, _: c
    r = executions(attempts).groupBy("route").agg(
        F.count("*").alias("executions"), F.count_if("success").alias("_ok"), F.sum("new_records").alias("_new"), F.sum("elapsed_ms").alias("_ms"),
        F.sum("cost").alias("_cost"), F.sum("costs").alias("_costs"), F.count_if("blocked").alias("_blocked"))
    n = F.col("executions").cast("double")
    p, y, ms = (F.col("_ok") + 1) / (n + 2), (F.col("_new") + 0.5) / (n + 1), F.col("_ms") / n
    mean_cost = ratio(F.col("_cost"), F.col("_costs"))
    utility = p * y / ((1 + ms / 60000) * F.when(mean_cost.isNull(), 1.0).otherwise(1 + mean_cost))
    return r.select("route", "executions", short(p, 6).alias("success_probability"), short(y, 6).alias("expected_new_records"), short(ms, 3).alias("average_elapsed_ms"),
                    short(mean_cost, 6).alias("average_cost"), short(F.col("_blocked") / n, 6).alias("blocked_share"), short(utility, 9).alias("utility"))


def retry_link_issues(attempts: DataFrame) -> DataFrame:
    """Attempts that retry an unknown attempt or themselves."""
    link = attempts.where("retry_of_attempt_id is not null").select("attempt_id", "retry_of_attempt_id")
    known = attempts.select(F.col("attempt_id").alias("retry_of_attempt_id")).distinct()
    return link.join(known, "retry_of_attempt_id", "left_anti").select("attempt_id", F.lit("unknown").alias("issue")).union(
        link.where("attempt_id = retry_of_attempt_id").select("attempt_id", F.lit("self").alias("issue")))
