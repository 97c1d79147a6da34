"""Event logs as streams: nothing late is dropped, so there is no watermark."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import ledger as L
from ..sources.ledger import append_idempotent, replace_atomically


def read_log(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_batch: int | None = None, delete_read: bool = False) -> DataFrame:
    """delete_read: files go when the micro-batch that read them is done."""
    log = spark.readStream.schema(schema).format(fmt)
    log = log.option("cleanSource", "delete") if delete_read else log
    return (log.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else log).load(path)


def latest_stream(events: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key, whatever the order of arrival; for output mode update or complete."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def replace_view(state: DataFrame, view: str, checkpoint: str):
    """Keep a streaming aggregate as a Parquet view: each micro-batch's whole result replaces the last one in one step."""
    return (state.writeStream.outputMode("complete").foreachBatch(lambda df, _: replace_atomically(df, view, "parquet"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_stream(events: DataFrame, path: str, key: str, payload: list[str], checkpoint: str):
    """Append each micro-batch to a Parquet ledger, ids once; a repeated batch appends nothing."""
    return events.writeStream.foreachBatch(lambda df, _: append_idempotent(df, path, key, payload)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Observations that merge_stream takes at a time, about.
SLICE_ROWS = 2_000_000


def merge_stream(observations: DataFrame, store: str, view: str, checkpoint: str, current_run: str | None = None):
    """Keep a ledger of observations, and after each micro-batch the current view of it; order-invariant.

    A micro-batch is dealt by key into slices, and these are done one after the other, so that shuffles of one are on disk at a
    time. The new rows extend the view of the rows before; only where that is of another current run, or missing though there
    is a ledger, are the keys of the batch merged again from the ledger. A batch that fails leaves ledger and view as they were.
    """
    from ..operators.merge import current_view, extended_view

    def apply(df: DataFrame, _: int) -> None:
        spark, schema = df.sparkSession, df.schema
        payload = [c for c in df.columns if c != "observation_id"]
        view_schema = current_view(spark.createDataFrame([], schema), current_run).schema
        of = 1 << max(0, -(-df.count() // SLICE_ROWS) - 1).bit_length()
        before, version, mark = L.current_version(spark, view), L.new_version(), "_any-run" if current_run is None else f"_run-{hashlib.sha256(current_run.encode()).hexdigest()}"
        done, own, staged, fresh = False, f"{view}/{version}", f"{store}/_batch-{version}", f"{store}/_fresh-{version}"
        extend = L.exists(spark, f"{view}/{before}/{mark}") if before else not L.exists(spark, store)
        try:
            if of > 1:
                dealt = df.withColumn("_slice", F.pmod(F.xxhash64("observation_key"), F.lit(of)))
                dealt.write.options(compression="zstd", maxConcurrentOutputFileWriters="64").partitionBy("_slice").parquet(staged)
                _refuse_ids_of_several_keys(spark.read.schema(schema).parquet(*[f"{staged}/_slice={n}" for n in range(of) if L.exists(spark, f"{staged}/_slice={n}")]), store, max(1, of // 4))
            for n in range(of):
                at = f"{staged}/_slice={n}"
                rows = df if of == 1 else spark.read.schema(schema).parquet(at) if L.exists(spark, at) else spark.createDataFrame([], schema)
                ledger = L.read_slice(spark, store, schema, "observation_key", n, of) if of > 1 else spark.read.schema(schema).parquet(store) if L.exists(spark, store) else spark.createDataFrame([], schema)
                old = L.read_slice(spark, f"{view}/{before}", view_schema, "observation_key", n, of) if before else spark.createDataFrame([], view_schema)
                L.write_fresh(rows, ledger, fresh, "observation_id", payload, n, of)
                if extend:
                    now = extended_view(old, rows.where("observation_key is not null"), current_run)
                else:
                    touched = rows.select("observation_key").distinct()
                    now = current_view(ledger.unionByName(rows).join(touched, "observation_key", "left_semi"), current_run)
                    now = old.join(touched, "observation_key", "left_anti").unionByName(now)
                L.write_slice(now, own, n, of)
                if of > 1:
                    L.delete(spark, at)
            if extend:  # else keys that the batch lacks are still of another run
                L.touch(spark, f"{own}/{mark}")
            done = True
            L.move_files(spark, fresh, store)
            L.point_to(spark, view, version)
        finally:
            for path in [staged, fresh] + [own] * (not done):
                L.delete(spark, path)
    return observations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _refuse_ids_of_several_keys(rows: DataFrame, store: str, passes: int) -> None:
    """Slices by key don't see these; found by hashes, a part of the ids in each pass, then compared."""
    spark = rows.sparkSession
    both = rows.select("observation_id", "observation_key")
    if L.exists(spark, store):
        both = both.unionByName(spark.read.schema(rows.schema).parquet(store).select(*both.columns))
    both = both.where("observation_id is not null").withColumn("_id", F.xxhash64("observation_id"))
    with L.shuffles_deleted(spark):
        for n in range(passes):
            some = both.where(F.pmod("_id", F.lit(passes)) == n)
            several = some.select("_id", F.xxhash64("observation_key").alias("_key")).repartition("_id").groupBy("_id").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("a <> b").select("_id")
            if several.limit(1).collect():
                keys = some.join(several, "_id", "left_semi").groupBy("observation_id").agg(F.count_distinct(F.struct("observation_key")).alias("n"))
                bad = keys.where("n > 1").limit(5).collect()
                if bad:
                    raise ValueError(f"ids with another payload: {[r[0] for r in bad]}")
