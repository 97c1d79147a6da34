"""Shared helpers: shared-folder materialisation, id hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import mix

#: White space of the contracts: space and the five ASCII controls 0x09-0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
_OWN_FOLDERS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


#: Spark deletes the shuffle files of a query at its end; what we write is read from Parquet, never from the query again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and Spark runs in one process (tests), a
    temporary folder; on a cluster an unset spark.checkpoint.dir is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
    return _OWN_FOLDERS[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for frames that nothing will read again."""
    for df in frames:
        delete(df.sparkSession, _PATHS.pop(df))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bits of a key filter at most: 8 MB, whatever the number of keys. A fuller filter lets more rows pass, never fewer.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter (uint8) of a DataFrame of one long column, for dropping rows early on the other side of a join."""
    bits = min(FILTER_BITS, 1 << max(16, (keys.count() * 16).bit_length()))

    def fill(batches):
        own = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for at in _bits(batch.column(0), bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])
    parts = keys.coalesce(8).mapInArrow(fill, "bits binary").collect()  # 8 arrays of 8 MB at most
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts:
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def _bits(column: pa.Array, bits: int) -> list[np.ndarray]:
    h = mix(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (h, h >> np.uint64(32))]


def may_hold(table: np.ndarray, column: pa.Array) -> np.ndarray:
    a, b = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in _bits(column, len(table) * 8))
    return (a & b).astype(bool)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), component the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each one aggregation of minima and one
    equi-join, so no neighbour list is ever gathered. Ids without an edge are absent. Self edges are ignored.
    """
    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    cur = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = fingerprint(cur)
    if not seen[0]:
        return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        nxt = materialise(small.distinct(), "edges")
        now = fingerprint(nxt)
        discard(cur)
        cur, done, seen = nxt, now == seen, now
        if done:
            roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    raise RuntimeError("components did not settle")
