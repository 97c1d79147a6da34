"""Ledgers derived from the star-schema tables, in Spark SQL and as DuckDB views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "observations": ("lineitem", """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS observation_id, concat('run-', l_suppkey % 3) AS run_id,
          concat_ws('-', l_orderkey, l_linenumber) AS observation_key, element_at(array('static', 'slowly_changing', 'dynamic'), CAST(l_orderkey % 3 AS INT) + 1) AS field_kind,
          CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS value_json,
          element_at(array('unknown', 'weak_signal', 'independent_secondary', 'official_secondary', 'direct_primary'), (ascii(l_returnflag) + ascii(l_linestatus)) % 5 + 1) AS source_strength,
          l_shipdate AS observed_at, l_shipdate + make_dt_interval(CAST(l_partkey % 10 AS INT)) AS retrieved_at, concat('f', l_linenumber) AS field, CAST(l_orderkey AS STRING) AS target_id
        FROM {t}"""),
    "attempts": ("events", """
        SELECT concat('A-', event_id) AS attempt_id, CAST(user_id AS STRING) AS target_id, element_at(array('discover', 'fetch', 'render', 'parse', 'extract'), CAST(event_id % 5 AS INT) + 1) AS stage,
          CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'partial' WHEN 'view' THEN 'skipped_duplicate' WHEN 'signup' THEN 'timeout' ELSE 'blocked' END AS status,
          concat('route-', event_id % 4) AS route_id, concat('adapter-', event_id % 2) AS adapter, 'v1' AS route_version, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'tool' END AS executor_class,
          row_number() OVER (PARTITION BY user_id, event_id % 5, event_id % 4 ORDER BY ts, event_id) AS attempt_no, CAST(round(value * 1000) AS BIGINT) AS elapsed_ms,
          CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS cost, k % 3 AS new_record_count, k % 4 AS valid_record_count, k AS input_tokens, CASE WHEN k % 2 = 1 THEN k END AS output_tokens,
          CAST(NULL AS BIGINT) AS bytes_received, date_format(ts, 'yyyy-MM-dd') AS batch_id, ts AS started_at, ts AS finished_at,
          CASE WHEN event_id % 97 = 0 THEN concat('A-', event_id) WHEN event_id % 11 = 0 THEN concat('A-', event_id - 20) END AS retry_of_attempt_id,
          CASE WHEN event_id % 7 = 0 THEN concat('route-', (event_id + 1) % 5) END AS next_route_id
        FROM (SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {t})"""),
    "coverage": ("orders", """
        SELECT CAST(o_orderkey AS STRING) AS attempt_id, CAST(o_custkey AS STRING) AS target_id, concat('field-', substring(o_orderpriority, 1, 1)) AS field_scope,
          CASE o_orderstatus WHEN 'F' THEN 'checked_hit' WHEN 'O' THEN 'unchecked' ELSE 'blocked' END AS state, o_orderdate AS retrieved_at, o_orderkey AS line
        FROM {t}"""),
    "tasks": ("orders", """
        SELECT CAST(o_orderkey AS STRING) AS task_id, CAST(o_custkey AS STRING) AS partition_key, CASE o_orderstatus WHEN 'O' THEN 'leased' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
          array(o_orderpriority) AS resource_lease_keys
        FROM {t}"""),
    "frontier": ("events", """
        SELECT concat('E-', event_id) AS frontier_event_id, concat('F-', user_id % 50) AS frontier_id, CASE event_type WHEN 'purchase' THEN 'exhausted' WHEN 'click' THEN 'active' WHEN 'view' THEN 'pending'
          WHEN 'signup' THEN 'paused' ELSE 'blocked' END AS state, ts AS event_at, event_id AS line, event_id % 3 AS new_target_count, event_id % 2 AS duplicate_target_count,
          concat('class-', user_id % 5) AS source_class, CASE WHEN user_id % 50 = 7 THEN event_type ELSE 'index' END AS entrypoint
        FROM {t}"""),
    "customers": ("customer", """
        SELECT CAST(c_custkey AS STRING) AS target_id, concat('class-', c_nationkey % 5) AS source_class, CAST(c_custkey % 7 AS BIGINT) AS priority, concat('p-', c_custkey % 400) AS partition_key,
          array('field-1', 'field-2', 'field-3') AS coverage_fields, array(concat('route-', c_custkey % 4), concat('route-', (c_custkey + 1) % 6)) AS route_candidates, concat('route-', c_custkey % 4) AS route_id
        FROM {t}"""),
}

#: DuckDB common table expressions of the same ledgers.
SQL = {
    "observations": """obs AS (
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_suppkey % 3 AS run, l_orderkey || '-' || l_linenumber AS k, l_orderkey % 3 AS kind,
          CAST(round(l_extendedprice * 100) AS BIGINT) AS v, (ascii(l_returnflag) + ascii(l_linestatus)) % 5 AS strength, epoch(l_shipdate) AS o, epoch(l_shipdate) + 86400 * (l_partkey % 10) AS r,
          'f' || l_linenumber AS field, CAST(l_orderkey AS VARCHAR) AS target_id
        FROM lineitem)""",
    "attempts": """att AS (
        SELECT 'A-' || event_id AS attempt_id, CAST(user_id AS VARCHAR) AS target_id, (['discover', 'fetch', 'render', 'parse', 'extract'])[event_id % 5 + 1] AS stage,
          CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'partial' WHEN 'view' THEN 'skipped_duplicate' WHEN 'signup' THEN 'timeout' ELSE 'blocked' END AS status,
          event_type IN ('purchase', 'click') AS ok, 'route-' || event_id % 4 AS route_id, 'adapter-' || event_id % 2 AS adapter, CASE event_id % 3 WHEN 2 THEN 'tool' ELSE 'unspecified' END AS executor,
          row_number() OVER (PARTITION BY user_id, event_id % 5, event_id % 4 ORDER BY ts, event_id) AS attempt_no, CAST(round(value * 1000) AS BIGINT) AS elapsed_ms,
          CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS cost, k % 3 AS new_n, k % 4 AS valid_n, k AS tok_in, CASE WHEN k % 2 = 1 THEN k END AS tok_out, strftime(ts, '%Y-%m-%d') AS batch_id, ts,
          CASE WHEN event_id % 97 = 0 THEN 'A-' || event_id WHEN event_id % 11 = 0 THEN 'A-' || (event_id - 20) END AS retry_of,
          CASE WHEN event_id % 7 = 0 THEN 'route-' || (event_id + 1) % 5 END AS next_route
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
    "coverage": """cov AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS attempt_id, CAST(o_custkey AS VARCHAR) AS target_id, 'field-' || substr(o_orderpriority, 1, 1) AS field,
          CASE o_orderstatus WHEN 'F' THEN 'checked_hit' WHEN 'O' THEN 'unchecked' ELSE 'blocked' END AS state, o_orderdate AS ts, o_orderkey AS line FROM orders)""",
    "frontier": """fro AS (
        SELECT 'F-' || user_id % 50 AS frontier_id, CASE event_type WHEN 'purchase' THEN 'exhausted' WHEN 'click' THEN 'active' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'paused' ELSE 'blocked' END AS state,
          ts, event_id AS line, event_id % 3 AS new_n, event_id % 2 AS dup_n, 'class-' || user_id % 5 AS source_class, CASE WHEN user_id % 50 = 7 THEN event_type ELSE 'index' END AS entrypoint FROM events)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derived(spark, table(spark, sf_dir, _SPARK[name][0]), name)


def derived(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A ledger from the rows of its table, which may be a stream."""
    return spark.sql(_SPARK[name][1], t=rows)
