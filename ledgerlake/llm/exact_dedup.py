"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, delete, documents, materialise, shared_dir

#: Buckets of a new index; fixed for its life. Take about one per 200 MB of digests expected.
BUCKETS = 256
_MARK = "_buckets-"


class DigestIndex:
    """Digests seen so far with the id that was kept: Parquet files under `path`, bucketed and sorted by digest.

    The files persist; any later session opens them again by path. Appends go through Spark's commit protocol,
    so a lost executor repeats its task and a failed append leaves no rows.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Open the index at path, or begin one with so many buckets (BUCKETS if None); another number than the one that
        an index has is an error, as its digests would be looked for in the wrong files."""
        self.spark, self.path, self.buckets = spark, path, self._agree(spark, path, buckets)
        buckets = self.buckets
        self.table = f"ledgerlake_digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    @staticmethod
    def _agree(spark: SparkSession, path: str, buckets: int | None) -> int:
        """The number of buckets, which the folder keeps as the name of an empty file."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        found = next((int(x.removeprefix(_MARK)) for x in names if x.startswith(_MARK)), None)
        if found is None:
            if names:
                raise ValueError(f"{path} holds files, but not the number of buckets of an index")
            found = BUCKETS if buckets is None else buckets
            fs.create(spark._jvm.org.apache.hadoop.fs.Path(at, f"{_MARK}{found}"), False).close()
        if buckets not in (None, found):
            raise ValueError(f"the index at {path} has {found} buckets, not {buckets}")
        return found

    def close(self, drop: bool = False) -> None:
        """Forget the index in this session's catalog; with drop, delete its files too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if drop:
            delete(self.spark, self.path)

    def bucketed(self) -> DataFrame:
        """The index as a bucketed relation: joins on digest need no exchange on its side."""
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """The same rows without their bucketing, for joins whose other side may be skewed and has to be split."""
        return self.spark.read.schema("digest binary, keep_id long").parquet(self.path)

    def append_new(self, groups: DataFrame) -> None:
        """Add the digests of groups (digest, keep_id; one row each) that the index lacks, by a sort-merge anti-join."""
        new = groups.hint("merge").join(self.bucketed().hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def dedup_batch(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicate docs (doc_id, text; other columns are ignored) within itself and against the index; append to it.

    One row per input row: doc_id, keep_id, group_size (equal texts in this batch), kept, digest, known (the text was
    in the index before). Texts are equal if identical after replacing each run of ASCII white space by one space;
    null is the empty text. The row with the smallest doc_id stays; if the index holds the text, its row stays and
    none of the batch is kept. A null doc_id stays only in a group without other ids. Rows that repeat both doc_id
    and text are one document, each marked as kept if it stays.
    """
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE_CLASS + "+", " ")
    keyed = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "digests")
    groups = materialise(keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "groups")
    before = materialise(groups.hint("merge").join(index.bucketed().hint("merge"), "digest").select("digest", "keep_id"), "before")
    index.append_new(groups.select("digest", F.col("first_id").alias("keep_id")))
    decided = (
        groups.join(before.withColumn("known", F.lit(True)), "digest", "left")
        .select("digest", "group_size", F.coalesce("known", F.lit(False)).alias("known"),
                F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("first_id")).alias("keep_id")))
    return keyed.join(decided, "digest").select(
        "doc_id", "keep_id", "group_size", (~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest", "known")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"{shared_dir(spark)}/ledgerlake/digest-index-{uuid.uuid4().hex}")
    out = dedup_batch(documents(spark, sf_dir), index)  # from here on it reads written tables, not the index
    index.close(drop=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
