"""Reading and writing ledgers: JSON Lines in, Parquet or JSON Lines out; idempotent appends; payload store."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.expr import contained_path, json_object, json_text, safe_suffix, stable_id, version_of
from ..functions.vocab import GATES

RAW, CORRUPT = "raw_line", "_corrupt"


def read_contract(spark: SparkSession, path: str) -> dict:
    """One JSON object; a byte-order mark is tolerated, anything but an object is an error."""
    value = json.loads(spark.read.text(path, wholetext=True).first()[0].lstrip("﻿"))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: expected a JSON object")
    return value


def read_ledger(spark: SparkSession, paths: str | list[str], schema: StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of JSON Lines files. Rows carry raw_line, _input_path and line, the number of the line in its file.

    Blank lines are skipped. A line that is no JSON object becomes an issue, or with strict an error when read.
    """
    paths = [paths] if isinstance(paths, str) else paths
    lines = numbered_lines(spark, paths).withColumn(RAW, F.regexp_replace(RAW, "^﻿", "")).where(F.trim(RAW) != "")
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    is_object = F.json_object_keys(RAW).isNotNull()
    parsed = lines.withColumn("_row", F.from_json(RAW, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = ~is_object | F.col(f"_row.{CORRUPT}").isNotNull()
    if strict:
        parsed = parsed.withColumn("_row", F.when(bad, F.raise_error(F.concat(F.lit("invalid ledger line: "), F.col(RAW)))).otherwise(F.col("_row")))
        bad = F.lit(False)
    rows = parsed.where(~bad).select(*[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields], RAW, "_input_path", "line")
    return rows, parsed.where(bad).select("_input_path", "line", RAW)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(raw_line, _input_path, line): lines of text files with their numbers from 1.

    Lines are counted by block of a file, and the counts added up; there is one row per block, and no line moves.
    """
    text = spark.read.text(paths).select(F.col("value").alias(RAW), F.col("_metadata.file_path").alias("_input_path"), F.col("_metadata.file_block_start").alias("_start"),
                                         F.monotonically_increasing_id().alias("_at"))
    blocks = text.groupBy("_input_path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_input_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return text.join(blocks, ["_input_path", "_start"]).select(RAW, "_input_path", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line"))


def load_contract(spark: SparkSession, path: str) -> tuple[dict, list[str]]:
    """(the JSON object, problems): like read_contract(), but what is wrong is returned, with an empty object."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return {}, [f"{path}: missing"]
        return read_contract(spark, path), []
    except ValueError as e:
        return {}, [f"{path}: {e}"]


def replace_contract(spark: SparkSession, path: str, value: dict) -> None:
    """Write a JSON object (sorted keys, indented) in place of the one at path, by one rename over it."""
    _replace_file(spark, path, (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n").encode())


def _replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark._jvm
    target, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = own.getFileSystem(spark._jsc.hadoopConfiguration()).create(own)
    out.write(bytearray(content))
    out.close()
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(own, target, option)


def write_report(spark: SparkSession, path: str, report: dict) -> str:
    """The report as JSON text (sorted keys, indented), also written to path."""
    replace_contract(spark, path, report)
    return json.dumps(report, sort_keys=True, ensure_ascii=False, indent=2)


#: Files of a run package, and those that a schema version introduced.
REQUIRED_FILES = ("goal_contract.json", "run_manifest.json", "data_dictionary.json", "coverage_plan.json", "sources.jsonl", "coverage.jsonl", "observations.jsonl", "tasks.jsonl",
                  "claims.jsonl", "current_view.jsonl", "conflicts.jsonl")
GATED_FILES = {"field_contract": ("field_contract.json",), "attempts": ("collection_attempts.jsonl",), "targets": ("target_queue.jsonl", "raw_artifacts.jsonl"),
               "adaptive": ("discovery_frontier.jsonl", "batch_decisions.jsonl")}


def missing_files(spark: SparkSession, root: str, schema_version: str | None = None) -> list[tuple[str, str]]:
    """(rule, file): required files that a run package lacks (V01); with a schema version, those it introduced too (V03)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    have = {x.getPath().getName() for x in fs.listStatus(at)} if fs.exists(at) else set()
    gated = [f for gate, files in GATED_FILES.items() if version_of(schema_version) >= GATES[gate] for f in files]
    return [("V01", f) for f in REQUIRED_FILES if f not in have] + [("V03", f) for f in gated if f not in have]


def optional_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The ledger's rows, or none if there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return read_ledger(spark, path, schema)[0]
    return spark.createDataFrame([], StructType([*schema.fields, StructField(RAW, StringType())]))


def replace_atomically(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write df as a new version under path, then point to it by one rename, so that readers see the old rows or the new ones.

    Versions but the last two are deleted, so that a reader of the one before can end. Read it with read_current().
    """
    spark = df.sparkSession
    version = new_version()
    df.write.format(fmt).save(f"{path}/{version}")
    point_to(spark, path, version)


def new_version() -> str:
    return f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Make a version that is written in full the current one, by one rename; versions but it and the one before are deleted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    before = current_version(spark, path)
    _replace_file(spark, f"{path}/_current-version", version.encode())
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(x.getPath(), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path, "_current-version")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """The rows that replace_atomically() last put at path."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.schema(schema).format(fmt).load(f"{path}/{version}")


def split_append(new: DataFrame, existing: DataFrame, key: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts) of an idempotent append: ids that exist are skipped, unless their payload differs."""
    digest = lambda: F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    fresh = new.dropDuplicates([key, *payload])
    have = existing.select(key, digest().alias("_have"))
    conflicts = fresh.withColumn("_new", digest()).join(have, key).where("_new <> _have").drop("_new", "_have")
    inside = fresh.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    conflicts = conflicts.unionByName(fresh.join(inside, key, "left_semi").select(*conflicts.columns))
    return fresh.join(existing.select(key).distinct(), key, "left_anti"), conflicts


def append_idempotent(new: DataFrame, path: str, key: str, payload: list[str]) -> int:
    """Append to a Parquet ledger the rows whose id it lacks; an id with another payload is an error."""
    spark = new.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    existing = spark.read.schema(new.schema).parquet(path) if exists else spark.createDataFrame([], new.schema)
    rows, conflicts = split_append(new, existing, key, payload)
    bad = conflicts.select(key).limit(5).collect()
    if bad:
        raise ValueError(f"ids with another payload: {[r[0] for r in bad]}")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


#: Spark deletes the shuffle files of a query at its end. Only for frames that are written once and read from there.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SLICE = re.compile(r"slice-(\d+)-of-(\d+)-")


@contextmanager
def shuffles_deleted(spark: SparkSession):
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def touch(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at).close()


def in_slice(key: str, n: int, of: int) -> Column:
    """Whether a row belongs to a slice of a table, by the hash of its key; of is a power of two."""
    return F.pmod(F.xxhash64(key), F.lit(of)) == n


def write_slice(df: DataFrame, path: str, n: int, of: int) -> None:
    """Add a slice to the Parquet files in path, under names that say which slice it is."""
    own = f"{path}/_slice-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.options(**{"compression": "zstd", "parquet.writer.version": "v2"}).parquet(own)  # texts in order take less as differences
    move_files(df.sparkSession, own, path, f"slice-{n}-of-{of}-")


def move_files(spark: SparkSession, source: str, path: str, prefix: str = "") -> None:
    """Rename the data files in source into path, and delete source."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path))
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name[0] not in "_." and not fs.rename(x.getPath(), jvm.org.apache.hadoop.fs.Path(path, prefix + name)):
            raise OSError(f"{x.getPath()} can't be moved to {path}")
    fs.delete(at, True)


def read_slice(spark: SparkSession, path: str, schema: StructType, key: str, n: int, of: int) -> DataFrame:
    """The rows of a slice in path; files that are named after other slices aren't read. Both numbers of slices are powers of two."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = []
    for x in fs.listStatus(at) if fs.exists(at) else ():
        name, slice_ = x.getPath().getName(), _SLICE.match(x.getPath().getName())
        if name[0] not in "_." and (not slice_ or (int(slice_[1]) - n) % min(int(slice_[2]), of) == 0):
            files.append(x.getPath().toString())
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(in_slice(key, n, of))


def write_fresh(new: DataFrame, existing: DataFrame, path: str, key: str, payload: list[str], n: int, of: int) -> None:
    """Add to path, as a slice, the rows whose id existing lacks, each once; an id with another payload is an error.

    Payloads are compared only where an id occurs several times.
    """
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    no_id = F.when(F.col(key).isNull(), F.struct(*payload)).alias("_no_id")  # rows without id stay apart
    rows = new.repartition(key).groupBy(key, no_id).agg(*[F.first(c).alias(c) for c in payload], F.count("*").alias("_n")).join(known, key, "left")
    seen = Observation()
    rows = rows.observe(seen, F.count_if((F.col("_n") > 1) | F.col("_known")).alias("again")).where("_known is null").select(*new.columns)
    write_slice(rows, path, n, of)
    if seen.get["again"]:
        with shuffles_deleted(new.sparkSession):
            bad = split_append(new, existing.join(new.select(key).distinct(), key, "left_semi"), key, payload)[1].select(key).limit(5).collect()
        if bad:
            raise ValueError(f"ids with another payload: {[r[0] for r in bad]}")


def payload_store(files: DataFrame) -> DataFrame:
    """Content-addressed places of payloads: files has path and content (the binaryFile source).

    Adds sha256, bytes and relative_path raw/sha256/<2 hex>/<hash><suffix>; equal payloads share one place.
    """
    sha = F.sha2("content", 256)
    out = files.withColumn("sha256", sha).withColumn("bytes", F.octet_length("content").cast("long"))
    return out.withColumn("relative_path", F.concat(F.lit("raw/sha256/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"), safe_suffix(F.col("path"))))


def raw_artifact_rows(files: DataFrame) -> DataFrame:
    """Provenance rows of payloads: files has run_id, target_id, attempt_id, sha256, bytes and relative_path."""
    identity = json_object(**{c: json_text(F.col(c)) for c in ("run_id", "target_id", "attempt_id", "sha256")})
    inside = F.when(contained_path(F.col("relative_path")), F.col("relative_path")).otherwise(F.raise_error(F.concat(F.lit("path leaves the package: "), F.col("relative_path"))))
    return files.withColumn("raw_artifact_id", stable_id("RAW", identity)).withColumn("relative_path", inside)


def store_payloads(files: DataFrame, root: str) -> DataFrame:
    """Copy payloads (path, content) to their content-addressed places under root; returns payload_store() without content,
    with stored_new. A file that is there already must have the hash of its name, else that is an error.

    Each distinct payload is written once, under a name of its own that is then renamed, so a repeated task does no harm.
    """
    placed = payload_store(files).withColumn("_name", F.concat(F.lit(root.rstrip("/") + "/"), F.col("relative_path")))

    def copy(rows):
        for batch in rows:
            done = []
            for name, sha, content in zip(*(batch.column(c).to_pylist() for c in ("_name", "sha256", "content"))):
                done.append(_store_one(name, sha, content))
            yield pa.RecordBatch.from_arrays([batch.column("relative_path"), pa.array(done, pa.bool_())], names=["relative_path", "stored_new"])
    once = placed.dropDuplicates(["relative_path"]).select("relative_path", "_name", "sha256", "content").mapInArrow(copy, "relative_path string, stored_new boolean")
    return placed.drop("content", "_name").join(once, "relative_path")


def _store_one(name: str, sha: str, content: bytes) -> bool:
    fs, at = pa.fs.FileSystem.from_uri(name)
    if fs.get_file_info(at).type == pa.fs.FileType.File:
        with fs.open_input_stream(at) as f:
            if hashlib.sha256(f.read()).hexdigest() != sha:
                raise ValueError(f"{name} has another hash than its name")
        return False
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(content)
    fs.move(own, at)
    return True


LEDGERS = ("sources", "discovery_frontier", "target_queue", "collection_attempts", "batch_decisions", "coverage", "observations",
           "raw_artifacts", "tasks", "claims", "current_view", "conflicts")


def init_package(spark: SparkSession, path: str, goal: dict, manifest: dict, contracts: dict[str, dict]) -> str:
    """Lay down a new run package: five contracts and empty ledgers. Returns the goal's hash; a path in use is an error."""
    import hashlib

    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(root) and (not fs.getFileStatus(root).isDirectory() or len(fs.listStatus(root))):
        raise FileExistsError(path)
    fields = [set(goal.get(k) or []) for k in ("required_fields", "optional_fields", "excluded_fields")]
    if fields[0] & fields[1] or fields[0] & fields[2] or fields[1] & fields[2]:
        raise ValueError("required, optional and excluded fields overlap")
    snapshot = hashlib.sha256(json.dumps(goal, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    for name, value in {"goal_contract": goal, "run_manifest": manifest | {"input_snapshot": snapshot}, **contracts}.items():
        replace_contract(spark, f"{path}/{name}.json", value)
    for name in LEDGERS:
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.jsonl")).close()
    return snapshot
