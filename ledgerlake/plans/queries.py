"""Registered queries of the ledger operators with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import attempts as A
from ..operators import coverage as C
from ..operators import frontier as FR
from ..operators import merge as M
from ..operators import planner as P
from ..operators import report as R
from ..operators import selector as S
from ..operators import validate as V
from ..operators.latest import latest
from .fixtures import SQL, ledger, table
from .rule_queries import RULE_QUERIES, RULE_SQL
from .run_queries import RUN_QUERIES, RUN_SQL, stream_merged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            with_ = ", ".join(SQL[n] for n in needs)
            ORACLE_SQL[name] = (f"WITH {with_}" + (", " if sql.lstrip().startswith("+") else " ") if needs else "") + sql.lstrip().removeprefix("+").strip()
        return f
    return add


_RANKED = """+ c AS (SELECT *, count_if(run = 2) OVER (PARTITION BY k) AS cur FROM obs), u AS (SELECT * FROM c WHERE kind <> 2 OR run = 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN kind = 2 THEN o ELSE 0 END DESC, strength DESC, CASE WHEN kind = 2 THEN 0 ELSE o END DESC, r DESC, id DESC) AS rn FROM u) """
CURRENT_RUN = "run-2"


@query("merge_current_view", _RANKED + """SELECT k AS observation_key, max(CAST(v AS VARCHAR)) FILTER (rn = 1) AS value, max(id) FILTER (rn = 1) AS selected_from,
    count(*) - 1 AS n_alternatives, coalesce(string_agg(id, ',' ORDER BY id) FILTER (rn > 1), '') AS alternatives FROM w GROUP BY k""", ("observations",))
def merge_current_view(spark, d):
    v = M.current_view(ledger(spark, d, "observations"), CURRENT_RUN)
    return v.select("observation_key", F.col("value_json").alias("value"), F.col("selected_from_observation_id").alias("selected_from"),
                    F.size("alternative_observation_ids").cast("long").alias("n_alternatives"), F.array_join("alternative_observation_ids", ",").alias("alternatives"))


@query("merge_conflicts", _RANKED + """SELECT k AS observation_key, 'competing_values' AS conflict_type, max(id) FILTER (rn = 1) AS selected,
      coalesce(string_agg(id, ',' ORDER BY id) FILTER (rn > 1), '') AS alternatives, array_to_string(list_sort(list(DISTINCT CAST(v AS VARCHAR))), ',') AS values_text
    FROM w GROUP BY k HAVING count(DISTINCT v) > 1
    UNION ALL SELECT k, 'stale_only', NULL, string_agg(id, ',' ORDER BY id), array_to_string(list_sort(list(DISTINCT CAST(v AS VARCHAR))), ',') FROM c WHERE kind = 2 AND cur = 0 GROUP BY k""", ("observations",))
def merge_conflicts(spark, d):
    c = M.conflicts(ledger(spark, d, "observations"), CURRENT_RUN)
    return c.select("observation_key", "conflict_type", F.col("selected_observation_id").alias("selected"), F.array_join("alternative_observation_ids", ",").alias("alternatives"),
                    F.array_join("values", ",").alias("values_text"))


@query("merge_stale_only", "SELECT k AS observation_key, count(*) AS n FROM obs WHERE kind = 2 GROUP BY k HAVING count_if(run = 2) = 0", ("observations",))
def merge_stale_only(spark, d):
    c = M.conflicts(ledger(spark, d, "observations"), CURRENT_RUN).where("conflict_type = 'stale_only'")
    return c.select("observation_key", F.size("alternative_observation_ids").cast("long").alias("n"))


@query("merge_receipt", "+ v AS (SELECT k, count(DISTINCT v) FILTER (kind <> 2 OR run = 2) AS vs, count_if(kind <> 2 OR run = 2) AS n FROM obs GROUP BY k) SELECT (SELECT count(*) FROM obs) AS input_rows, (SELECT count(DISTINCT id) FROM obs) AS unique_observations, count_if(n > 0) AS current_keys, count_if(n = 0) AS stale_only, count_if(vs > 1) AS competing FROM v", ("observations",))
def merge_receipt(spark, d):
    return M.receipt(ledger(spark, d, "observations"), CURRENT_RUN)


@query("obs_dedup_conflicts", "SELECT l_orderkey || '-' || l_linenumber AS observation_id, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS payloads FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_partkey, l_suppkey, l_quantity)) > 1")
def obs_dedup_conflicts(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("observation_id"), "l_partkey", "l_suppkey", "l_quantity")
    return M.id_conflicts(rows).select("observation_id", F.col("rows").alias("n_rows"), "payloads")


@query("latest_coverage_cell", "SELECT target_id, field AS field_scope, arg_max(state, (ts, attempt_id)) AS state, arg_max(attempt_id, (ts, attempt_id)) AS attempt_id FROM cov GROUP BY 1, 2", ("coverage",))
def latest_coverage_cell(spark, d):
    return C.latest_cells(ledger(spark, d, "coverage")).select("target_id", "field_scope", "state", "attempt_id")


@query("latest_frontier_state", "SELECT frontier_id, arg_max(state, (ts, line)) AS state, max(line) FILTER (true) > 0 AS seen FROM fro GROUP BY 1", ("frontier",))
def latest_frontier_state(spark, d):
    return FR.latest_frontiers(ledger(spark, d, "frontier")).select("frontier_id", "state", F.lit(True).alias("seen"))


@query("frontier_summary", "+ l AS (SELECT frontier_id, arg_max(state, (ts, line)) AS state FROM fro GROUP BY 1) SELECT state, count(*) AS frontiers, (SELECT CAST(sum(new_n) AS BIGINT) FROM fro) AS new_targets, (SELECT CAST(sum(dup_n) AS BIGINT) FROM fro) AS duplicate_targets FROM l GROUP BY 1", ("frontier",))
def frontier_summary(spark, d):
    return FR.frontier_summary(ledger(spark, d, "frontier"))


@query("identity_drift", "SELECT frontier_id, count(DISTINCT (source_class, entrypoint)) AS identities FROM fro GROUP BY 1 HAVING count(DISTINCT (source_class, entrypoint)) > 1", ("frontier",))
def identity_drift(spark, d):
    return FR.identity_drift(ledger(spark, d, "frontier"), ("source_class", "entrypoint"))


@query("open_frontiers", "SELECT frontier_id FROM fro GROUP BY 1 HAVING arg_max(state, (ts, line)) NOT IN ('exhausted', 'blocked')", ("frontier",))
def open_frontiers(spark, d):
    return FR.open_frontiers(ledger(spark, d, "frontier"))


@query("last_attempt_per_target", "SELECT target_id, arg_max(attempt_id, (ts, attempt_no, attempt_id)) AS attempt_id, arg_max(status, (ts, attempt_no, attempt_id)) AS status FROM att GROUP BY 1", ("attempts",))
def last_attempt_per_target(spark, d):
    return latest(ledger(spark, d, "attempts"), ["target_id"], ("finished_at", "attempt_no", "attempt_id")).select("target_id", "attempt_id", "status")


_EFF = """count(*) AS attempts, count(DISTINCT target_id) AS targets, count_if(ok) AS successes, CAST(coalesce(sum(new_n) FILTER (ok), 0) AS BIGINT) AS new_records,
    CAST(coalesce(sum(valid_n) FILTER (ok), 0) AS BIGINT) AS valid_records, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, CAST(sum(tok_in) AS BIGINT) AS input_tokens,
    CAST(sum(tok_out) AS BIGINT) AS output_tokens, CAST(NULL AS BIGINT) AS bytes_received, sum(cost) AS cost"""
_EFF_OUT = """*, CAST(new_records * 100 AS DOUBLE) / attempts AS new_per_100, cost / nullif(new_records, 0) AS cost_per_new, CAST(elapsed_ms AS DOUBLE) / nullif(new_records, 0) AS elapsed_per_new,
    CAST(input_tokens + coalesce(output_tokens, 0) AS DOUBLE) / nullif(new_records, 0) AS tokens_per_new"""


@query("efficiency_global", f"+ e AS (SELECT {_EFF} FROM att) SELECT {_EFF_OUT} FROM e", ("attempts",))
def efficiency_global(spark, d):
    return A.efficiency(ledger(spark, d, "attempts"))


def _by(name: str, key: str, column) -> None:
    @query(f"efficiency_{name}", f"+ e AS (SELECT {key} AS {name}, {_EFF} FROM att GROUP BY 1) SELECT {_EFF_OUT} FROM e", ("attempts",))
    def run(spark, d):
        return A.efficiency(ledger(spark, d, "attempts").withColumn(name, column()), name)


_by("route", "route_id", A.route_of_report)
_by("executor", "executor", A.executor_of_report)
_by("adapter", "adapter", lambda: F.col("adapter"))
_by("batch", "batch_id", lambda: F.col("batch_id"))


@query("efficiency_groupings", f"+ e AS (SELECT CASE WHEN grouping(adapter) = 0 THEN 'adapter' WHEN grouping(route_id) = 0 THEN 'route_id' ELSE 'all' END AS grouping, coalesce(adapter, route_id) AS key, {_EFF} FROM att GROUP BY GROUPING SETS ((adapter), (route_id), ())) SELECT {_EFF_OUT} FROM e", ("attempts",))
def efficiency_groupings(spark, d):
    return A.efficiency_by(ledger(spark, d, "attempts"), ["adapter", "route_id"])


@query("stage_summary", "SELECT stage, count(*) AS attempts, count(DISTINCT target_id) AS targets, count_if(ok) AS successes, count(DISTINCT target_id) FILTER (ok) AS successful_targets, count_if(status IN ('timeout', 'blocked')) AS failures FROM att GROUP BY 1", ("attempts",))
def stage_summary(spark, d):
    return A.stage_summary(ledger(spark, d, "attempts"))


@query("pipeline_funnel", """+ f AS (SELECT target_id, bool_or((stage = 'discover' AND ok) OR stage <> 'discover') AS dis, bool_or(stage IN ('fetch', 'render')) AS tri, bool_or(stage IN ('fetch', 'render') AND ok) AS fet,
      bool_or(stage IN ('parse', 'extract') AND ok) AS par, bool_or(stage = 'extract' AND ok) AS ext, bool_or(stage = 'extract' AND ok AND valid_n > 0) AS val, bool_or(status = 'skipped_duplicate') AS dup, arg_max(status, (ts, attempt_no, attempt_id)) AS s FROM att GROUP BY 1)
    SELECT count_if(dis) AS discovered, count_if(tri) AS fetch_attempted, count_if(fet) AS fetched, count_if(par) AS parsed, count_if(ext) AS extracted, count_if(val) AS valid,
      count_if(dup) AS duplicate, count_if(s IN ('timeout', 'blocked')) AS unresolved, CAST(count_if(fet) AS DOUBLE) / nullif(count_if(tri), 0) AS fetch_rate,
      CAST(count_if(par AND fet) AS DOUBLE) / nullif(count_if(fet), 0) AS parse_rate, CAST(count_if(val) AS DOUBLE) / nullif(count_if(ext), 0) AS valid_rate, CAST(count_if(val) AS DOUBLE) / nullif(count_if(dis), 0) AS end_to_end_rate FROM f""", ("attempts",))
def pipeline_funnel(spark, d):
    return A.pipeline_funnel(ledger(spark, d, "attempts"))


@query("final_status_hist", "+ l AS (SELECT target_id, arg_max(status, (ts, attempt_no, attempt_id)) AS status FROM att GROUP BY 1) SELECT status, count(*) AS targets FROM l GROUP BY 1", ("attempts",))
def final_status_hist(spark, d):
    return A.final_status(ledger(spark, d, "attempts"))


@query("retry_recovery", "+ g AS (SELECT count(*) AS n, arg_min(ok, (ts, attempt_no, attempt_id)) AS f, bool_or(ok) AS a FROM att GROUP BY target_id, stage) SELECT count(*) AS \"groups\", count_if(n > 1) AS retried, count_if(n > 1 AND NOT f AND a) AS recovered, CAST(count_if(n > 1 AND NOT f AND a) AS DOUBLE) / nullif(count_if(n > 1), 0) AS recovery_rate FROM g", ("attempts",))
def retry_recovery(spark, d):
    return A.retry_recovery(ledger(spark, d, "attempts"))


@query("failure_hist", "SELECT status, count(*) AS attempts FROM att WHERE status IN ('timeout', 'blocked') GROUP BY 1", ("attempts",))
def failure_hist(spark, d):
    return A.failure_histogram(ledger(spark, d, "attempts"))


@query("batch_marginal_yield", "+ b AS (SELECT batch_id, min(ts) AS t, count(*) AS attempts, CAST(coalesce(sum(new_n) FILTER (ok), 0) AS BIGINT) AS new_records FROM att GROUP BY 1) SELECT batch_id, attempts, new_records, CAST(sum(new_records) OVER (ORDER BY t, batch_id) AS BIGINT) AS cumulative_new FROM b", ("attempts",))
def batch_marginal_yield(spark, d):
    return A.batch_yield(ledger(spark, d, "attempts")).select("batch_id", "attempts", "new_records", "cumulative_new")


_ROUTES = """x AS (SELECT target_id, route_id, attempt_no, arg_max(ok, (ts, attempt_no, attempt_id)) AS ok, sum(new_n) AS new_n, sum(elapsed_ms) AS ms, sum(cost) AS cost, count(cost) AS costs, arg_max(status IN ('blocked', 'access_denied', 'challenge_blocked', 'invalid_target'), (ts, attempt_no, attempt_id)) AS bl
      FROM att GROUP BY 1, 2, 3),
    rm AS (SELECT route_id AS route, count(*) AS executions, (count_if(ok) + 1) / (count(*) + 2.0::DOUBLE) AS p, (sum(new_n) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE) AS y, sum(ms)::DOUBLE / count(*) AS ms, sum(cost) / nullif(sum(costs), 0) AS cost,
      count_if(bl)::DOUBLE / count(*) AS bl FROM x GROUP BY 1),
    ru AS (SELECT *, p * y / ((1 + ms / 60000) * coalesce(1 + cost, 1)) AS utility FROM rm)"""


@query("route_metrics", f"+ {_ROUTES} SELECT route, executions, p AS success_probability, y AS expected_new_records, ms AS average_elapsed_ms, cost AS average_cost, bl AS blocked_share, utility FROM ru", ("attempts",))
def route_metrics(spark, d):
    return A.route_metrics(ledger(spark, d, "attempts"), rounded=False)


@query("retry_link_check", "SELECT attempt_id, 'unknown' AS issue FROM att a WHERE retry_of IS NOT NULL AND NOT EXISTS (SELECT 1 FROM att b WHERE b.attempt_id = a.retry_of) UNION ALL SELECT attempt_id, 'self' FROM att WHERE retry_of = attempt_id", ("attempts",))
def retry_link_check(spark, d):
    return A.retry_link_issues(ledger(spark, d, "attempts"))


@query("coverage_posture", "+ l AS (SELECT arg_max(state, (ts, attempt_id)) AS state FROM cov GROUP BY target_id, field) SELECT state, count(*) AS cells FROM l GROUP BY 1", ("coverage",))
def coverage_posture(spark, d):
    return C.posture(ledger(spark, d, "coverage"))


@query("coverage_totals", "+ l AS (SELECT arg_max(state, (ts, attempt_id)) AS state FROM cov GROUP BY target_id, field) SELECT count(*) AS cells, count_if(state <> 'unchecked') AS terminal_cells, CAST(count_if(state <> 'unchecked') AS DOUBLE) / count(*) AS terminal_rate FROM l", ("coverage",))
def coverage_totals(spark, d):
    return C.totals(ledger(spark, d, "coverage"))


@query("field_summary", """+ l AS (SELECT field, arg_max(state, (ts, attempt_id)) AS state FROM cov GROUP BY target_id, field), c AS (SELECT field, count(*) AS planned, count_if(state <> 'unchecked') AS terminal, concat_ws(',', 'blocked=' || nullif(count_if(state = 'blocked'), 0), 'checked_hit=' || nullif(count_if(state = 'checked_hit'), 0), 'unchecked=' || nullif(count_if(state = 'unchecked'), 0)) AS states FROM l GROUP BY 1),
    s AS (SELECT field, count(*) AS observations, count(DISTINCT target_id) AS targets, count(DISTINCT k) AS keys FROM obs GROUP BY 1), u AS (SELECT field FROM c UNION SELECT field FROM s UNION SELECT 'extra')
    SELECT field, coalesce(observations, 0) AS observations, coalesce(targets, 0) AS targets, coalesce(keys, 0) AS keys, coalesce(planned, 0) AS planned, coalesce(terminal, 0) AS terminal, CAST(terminal AS DOUBLE) / nullif(planned, 0) AS terminal_rate, field = 'extra' AS required, field = 'field-1' AS optional, coalesce(states, '') AS states
    FROM u LEFT JOIN c USING (field) LEFT JOIN s USING (field)""", ("coverage", "observations"))
def field_summary(spark, d):
    out = C.field_summary(ledger(spark, d, "coverage"), ledger(spark, d, "observations"), ["extra"], ["field-1"])
    return out.withColumn("states", F.array_join(F.transform(F.array_sort(F.map_entries("states")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("pilot_metrics", """+ t AS (SELECT CAST(c_custkey AS VARCHAR) AS target_id, unnest(['field-1', 'field-2', 'field-3']) AS field FROM customer), l AS (SELECT target_id, field, arg_max(state, (ts, attempt_id)) AS state FROM cov GROUP BY 1, 2),
    p AS (SELECT t.target_id, count(*) AS cells, count_if(coalesce(state, 'unchecked') <> 'unchecked') AS done, count_if(state = 'checked_hit') AS hits FROM t LEFT JOIN l USING (target_id, field) GROUP BY 1)
    SELECT CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(done) AS BIGINT) AS terminal_cells, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS targets, count_if(cells = done) AS terminal_targets, sum(done)::DOUBLE / sum(cells)::DOUBLE AS terminal_cell_rate,
      count_if(cells = done)::DOUBLE / count(*) AS terminalization_rate FROM p""", ("coverage",))
def pilot_metrics(spark, d):
    return C.pilot_metrics(ledger(spark, d, "customers"), ledger(spark, d, "coverage"))


@query("pilot_consistency", """+ l AS (SELECT target_id, field, arg_max(state, (ts, attempt_id)) AS state FROM cov GROUP BY 1, 2), h AS (SELECT target_id, field FROM l JOIN customer ON target_id = CAST(c_custkey AS VARCHAR) WHERE state = 'checked_hit' AND field IN ('field-1', 'field-2', 'field-3')),
    s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS target_id, 'field-' || l_linenumber AS field FROM lineitem JOIN customer ON l_suppkey = c_custkey)
    SELECT coalesce(h.target_id, s.target_id) AS target_id, coalesce(h.field, s.field) AS field, CASE WHEN s.field IS NULL THEN 'hit_without_observation' ELSE 'observation_without_hit' END AS issue
    FROM h FULL JOIN s ON h.target_id = s.target_id AND h.field = s.field WHERE h.field IS NULL OR s.field IS NULL""", ("coverage",))
def pilot_consistency(spark, d):
    obs = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("target_id"), F.concat(F.lit("field-"), "l_linenumber").alias("field"))
    return C.pilot_consistency(ledger(spark, d, "customers"), ledger(spark, d, "coverage"), obs)


_URL = r"""u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p,
      list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT regexp_matches(lower(x), '^(fbclid|gclid|mc_cid|mc_eid)(=|$)'))) AS q FROM pages),
    loc AS (SELECT page_id, h, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS locator FROM u),
    ti AS (SELECT page_id, locator, 'T-' || substr(sha256('{"dimensions":{"part":' || page_id % 3 || '},"locator":"' || locator || '","page_type":"page","source_class":"' || h || '","target_type":"source_target"}'), 1, 24) AS target_id FROM loc),
    ts AS (SELECT page_id, locator, target_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 65), lambda i: CAST(instr('0123456789abcdef', substr(sha256(target_id), i, 1)) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 7) AS BIGINT) AS shard_id FROM ti)"""


def page_targets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("locator"))
    host = F.regexp_extract("locator", "://([^/?#]*)", 1)
    t = t.withColumns({"target_type": F.lit("source_target"), "page_type": F.lit("page"), "source_class": host, "_identity": F.create_map(F.lit("part"), (F.col("page_id") % 3).cast("string"))})
    t = t.withColumn("target_id", P.target_id("1.5.0")).drop("_identity")
    return t.withColumn("shard_id", X.hash_shard(F.col("target_id"), 7))


@query("canonical_locators", f"WITH {_URL} SELECT page_id, locator FROM loc")
def canonical_locators(spark, d):
    return page_targets(spark, d).select("page_id", "locator")


@query("target_ids", f"WITH {_URL} SELECT page_id, target_id, shard_id, 'pages:shard-' || lpad(CAST(shard_id AS VARCHAR), 3, '0') AS partition_key FROM ts")
def target_ids(spark, d):
    return page_targets(spark, d).select("page_id", "target_id", "shard_id", X.shard_name(F.lit("pages"), F.col("shard_id")).alias("partition_key"))


@query("shard_histogram", f"WITH {_URL} SELECT CAST(g AS BIGINT) AS shard_id, count(page_id) AS targets FROM range(7) r(g) LEFT JOIN ts ON shard_id = g GROUP BY 1")
def shard_histogram(spark, d):
    return P.shard_histogram(page_targets(spark, d), 7)


@query("new_targets_anti", f"WITH {_URL}, n AS (SELECT DISTINCT target_id, locator FROM ti) SELECT target_id, locator FROM n WHERE target_id NOT IN (SELECT target_id FROM ti WHERE page_id % 3 = 0)")
def new_targets_anti(spark, d):
    from ..sources.ledger import split_append
    t = page_targets(spark, d)
    return split_append(t.select("target_id", "locator"), t.where("page_id % 3 = 0").select("target_id", "locator").distinct(), "target_id", ["locator"])[0]


@query("planner_cross_exclude", "SELECT DISTINCT r_name AS region, n_name AS nation, p_brand AS brand FROM region, nation, part WHERE NOT (r_name = 'ASIA' AND p_brand = (SELECT min(p_brand) FROM part)) AND NOT (n_name = (SELECT min(n_name) FROM nation))")
def planner_cross_exclude(spark, d):
    names = lambda t, c: sorted(r[0] for r in table(spark, d, t).select(c).distinct().collect())  # noqa: E731  axes of a plan are small lists
    axes = {"region": names("region", "r_name"), "nation": names("nation", "n_name"), "brand": names("part", "p_brand")}
    rules = [{"region": "ASIA", "brand": axes["brand"][0]}, {"nation": axes["nation"][0]}]
    combos = P.exclude(P.combinations(spark, axes, ["region", "nation", "brand"], {}), rules, "t")
    return combos.select(*[F.col("dimensions")[n].alias(n) for n in ("region", "nation", "brand")])


@query("cells_explode", "SELECT CAST(c_custkey AS VARCHAR) AS target_id, f AS field_scope, 'CELL-' || substr(sha256('{\"field\":\"' || f || '\",\"target_id\":\"' || c_custkey || '\"}'), 1, 24) AS cell_id FROM customer, (SELECT unnest(['field-1', 'field-2', 'field-3']) AS f)")
def cells_explode(spark, d):
    t = ledger(spark, d, "customers").withColumns({"run_id": F.lit("r"), "planned_at": F.lit("")})
    return P.cells(t).select("target_id", "field_scope", "cell_id")


@query("raw_dedup", "SELECT sha256(text) AS sha256, count(*) AS artifacts, CAST(max(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def raw_dedup(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return files.groupBy("sha256").agg(F.count("*").alias("artifacts"), F.max("bytes").alias("bytes"), F.min("doc_id").alias("first_doc"))


@query("lease_duplicates", "SELECT CAST(o_custkey AS VARCHAR) AS row_key, 'several active tasks of one partition' AS message FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT o_orderpriority, 'several active tasks hold one lease' FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority HAVING count(*) > 1")
def lease_duplicates(spark, d):
    return V.check_package({"tasks": ledger(spark, d, "tasks")}, only={"V41"}).select("row_key", "message")


@query("fk_orphans", "SELECT 'claims' AS table_name, CAST(doc_id AS VARCHAR) AS row_key FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.doc_id % 3 <> 0)")
def fk_orphans(spark, d):
    claims = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("claim_id"), F.array(F.col("doc_id").cast("string")).alias("source_ids"))
    sources = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("source_id"))
    run = next(r for rule, needs, r in V.RULES if rule == "V44" and needs == {"claims", "sources"})
    return run({"claims": claims, "sources": sources}).select("table_name", "row_key")


@query("contract_set_ops", """+ a AS (SELECT DISTINCT field FROM cov), b AS (SELECT unnest(['field-1', 'field-2', 'other']) AS field)
    SELECT 'missing' AS kind, field FROM (SELECT field FROM b EXCEPT SELECT field FROM a) UNION ALL SELECT 'outside', field FROM (SELECT field FROM a EXCEPT SELECT field FROM b) UNION ALL SELECT 'both', field FROM (SELECT field FROM a INTERSECT SELECT field FROM b)""", ("coverage",))
def contract_set_ops(spark, d):
    a = ledger(spark, d, "coverage").select(F.col("field_scope").alias("field")).distinct()
    b = spark.createDataFrame([("field-1",), ("field-2",), ("other",)], "field string")
    part = lambda kind, df: df.select(F.lit(kind).alias("kind"), "field")
    return part("missing", b.subtract(a)).union(part("outside", a.subtract(b))).union(part("both", a.intersect(b)))


@query("version_gate", "SELECT p_partkey, (p_size // 10, p_size % 10) >= (3, 5) AS open FROM part")
def version_gate(spark, d):
    t = table(spark, d, "part")
    v = F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit(".0"))
    return t.select("p_partkey", X.version_at_least(v, (3, 5, 0)).alias("open"))


_POLICY = S.Policy(limit=40, exploration_slots=3, max_attempts=4, required_fields=("field-1", "field-2"), required_classes=("class-1",))


def _candidates(spark, d):
    tasks = table(spark, d, "customer").where("c_custkey % 400 < 60").select(F.concat(F.lit("p-"), F.col("c_custkey") % 400).alias("partition_key"), F.lit("leased").alias("status"))
    return S.candidates(ledger(spark, d, "customers"), ledger(spark, d, "coverage"), ledger(spark, d, "attempts"), tasks, _POLICY)


_CAND = _ROUTES + """, t AS (SELECT CAST(c_custkey AS VARCHAR) AS target_id, 'class-' || c_nationkey % 5 AS source_class, c_custkey % 7 AS priority, c_custkey % 400 < 60 AS leased, ['route-' || c_custkey % 4, 'route-' || (c_custkey + 1) % 6] AS rc FROM customer),
    la AS (SELECT target_id, arg_max(attempt_id, (ts, attempt_no, attempt_id)) AS aid FROM att GROUP BY 1), nr AS (SELECT la.target_id, att.next_route AS nxt FROM la JOIN att ON la.aid = att.attempt_id),
    us AS (SELECT target_id, route_id AS route, max(attempt_no) AS tries, arg_max(status, (ts, attempt_no, attempt_id)) AS st FROM att GROUP BY 1, 2),
    tr AS (SELECT DISTINCT t.target_id, nxt, unnest(CASE WHEN nxt IS NULL THEN rc ELSE list_append(rc, nxt) END) AS route FROM t LEFT JOIN nr USING (target_id)),
    br AS (SELECT tr.target_id, tr.route, coalesce(ru.executions, 0) AS executions, coalesce(round(ru.utility, 9), 0.25) AS utility, row_number() OVER (PARTITION BY tr.target_id ORDER BY coalesce(round(ru.utility, 9), 0.25) DESC, tr.route) AS rn
      FROM tr LEFT JOIN us USING (target_id, route) LEFT JOIN ru ON ru.route = tr.route WHERE coalesce(tries, 0) < 4 AND NOT (coalesce(st, '') = 'blocked' AND NOT coalesce(tr.route = nxt, false))),
    lc AS (SELECT target_id, field, arg_max(state, (ts, line)) AS state FROM cov GROUP BY 1, 2),
    gp AS (SELECT t.target_id, count_if(coalesce(state, 'unchecked') <> 'checked_hit') AS unresolved, count_if(coalesce(state, 'unchecked') = 'unchecked' OR (state = 'blocked' AND nxt IS NOT NULL)) AS debt,
        count_if(state = 'blocked' AND nxt IS NULL) AS stuck FROM t CROSS JOIN (SELECT unnest(['field-1', 'field-2']) AS field) f LEFT JOIN lc ON lc.target_id = t.target_id AND lc.field = f.field LEFT JOIN nr ON nr.target_id = t.target_id GROUP BY 1),
    cd AS (SELECT t.*, gp.unresolved, gp.debt, br.route, br.executions, br.utility, CASE WHEN debt = 0 AND stuck > 0 THEN 'blocked_coverage_terminal' WHEN debt = 0 THEN 'required_coverage_terminal' WHEN leased THEN 'active_partition_lease'
        WHEN br.route IS NULL THEN 'retry_or_route_exhausted' END AS exclusion, CASE WHEN source_class = 'class-1' THEN 1 ELSE 0 END AS rq FROM t JOIN gp USING (target_id) LEFT JOIN br ON br.target_id = t.target_id AND br.rn = 1),
    ok AS (SELECT *, row_number() OVER (ORDER BY debt DESC, rq DESC, utility DESC, priority DESC, target_id) AS r FROM cd WHERE exclusion IS NULL)"""


@query("best_route_per_target", f"+ {_CAND} SELECT target_id, route AS selected_route_id, executions FROM br WHERE rn = 1", ("attempts", "coverage"))
def best_route_per_target(spark, d):
    return S.best_routes(ledger(spark, d, "customers"), ledger(spark, d, "attempts"), _POLICY).select("target_id", "selected_route_id", "executions")


@query("selection_exclusions", f"+ {_CAND} SELECT coalesce(exclusion, 'eligible') AS exclusion, count(*) AS targets, CAST(sum(unresolved) AS BIGINT) AS unresolved, CAST(sum(debt) AS BIGINT) AS debt FROM cd GROUP BY 1", ("attempts", "coverage"))
def selection_exclusions(spark, d):
    return _candidates(spark, d).groupBy(F.coalesce("exclusion", F.lit("eligible")).alias("exclusion")).agg(F.count("*").alias("targets"), F.sum("unresolved").alias("unresolved"), F.sum("debt").alias("debt"))


@query("select_batch", f"""+ {_CAND}, e AS (SELECT * FROM ok WHERE executions = 0 ORDER BY r LIMIT 3), k AS (SELECT source_class, min(r) AS r FROM ok WHERE source_class NOT IN (SELECT source_class FROM e) GROUP BY 1),
    ph AS (SELECT ok.*, CASE WHEN r IN (SELECT r FROM e) THEN 1 WHEN r IN (SELECT r FROM k) THEN 2 ELSE 3 END AS phase FROM ok)
    SELECT target_id, route AS selected_route_id, debt, CAST(phase AS INTEGER) AS phase FROM ph ORDER BY phase, r LIMIT 40""", ("attempts", "coverage"))
def select_batch(spark, d):
    return S.select_batch(_candidates(spark, d), _POLICY).select("target_id", "selected_route_id", "debt", "phase")


@query("decision_ids", """SELECT o_custkey, 'BDEC-' || substr(sha256('{"input_snapshot":"s","ledger_snapshot":{"orders":"' || sha256(CAST(o_custkey AS VARCHAR)) || '"},"policy":{"exploration_slots":1,"limit":20,"max_attempts_per_target_route":2,"name":"p"},"run_id":"run-'
    || o_custkey % 3 || '","selected":[' || string_agg('{"selected_route_id":"' || o_orderpriority || '","target_id":"' || o_orderkey || '"}', ',' ORDER BY o_orderkey) || '],"selector_version":"1.0.0","stop_decision":"continue"}'), 1, 24) AS decision_id FROM orders GROUP BY o_custkey""")
def decision_ids(spark, d):
    pick = F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("target_id"), F.col("o_orderpriority").alias("selected_route_id"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(pick)).alias("selected"))  # a decision is one row, its picks a list
    policy = F.struct(F.lit("p").alias("name"), F.lit(20).alias("limit"), F.lit(1).alias("exploration_slots"), F.lit(2).alias("max_attempts_per_target_route"))
    rows = rows.withColumns({"run_id": F.concat(F.lit("run-"), F.col("o_custkey") % 3), "input_snapshot": F.lit("s"), "selector_version": F.lit("1.0.0"), "stop_decision": F.lit("continue"),
                             "policy": policy, "ledger_snapshot": F.create_map(F.lit("orders"), F.sha2(F.col("o_custkey").cast("string"), 256))})
    return rows.select("o_custkey", S.decision_id().alias("decision_id"))


# --- planning, ids and recording

_SPEC = {"planned_at": "2026-01-01T00:00:00Z", "shard_count": 5, "exclude": [{"level": 2, "flag": True}],
         "templates": [{"template_id": "t", "vary_by": ["nation", "level", "flag"], "identity_axes": ["nation", "level"], "fixed_dimensions": {"market": "m"}, "page_type": "list", "source_class": "registry",
                        "route_id": "r2", "route_candidates": ["r3", "r1"], "url_encode_axes": ["nation"], "locator_template": "HTTP://Ex.org:080/n?b={nation}&a={level}&utm_x=1&c={flag}", "coverage_fields": ["g", "f"], "priority": 2}]}
_PLAN = """+ n AS (SELECT n_name AS n, l, f FROM nation, (SELECT unnest([1, 2]) AS l), (SELECT unnest([true, false]) AS f) WHERE NOT (l = 2 AND f)),
    p AS (SELECT *, 'http://ex.org/n?a=' || l || '&b=' || replace(n, ' ', '+') || '&c=' || CASE WHEN f THEN 'True' ELSE 'False' END AS locator FROM n),
    t AS (SELECT *, 'T-' || substr(sha256('{"dimensions":{"level":' || l || ',"nation":"' || n || '"},"locator":"' || locator || '",' || {identity} || '"target_type":"source_target"}'), 1, 24) AS target_id FROM p),
    s AS (SELECT *, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 65), lambda i: CAST(instr('0123456789abcdef', substr(sha256(target_id), i, 1)) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 5) AS BIGINT) AS shard_id FROM t)"""


def _spec(spark, d) -> dict:
    nations = [r[0] for r in table(spark, d, "nation").select("n_name").distinct().collect()]  # axes of a plan are small lists
    return _SPEC | {"axes": {"nation": nations, "level": [1, 2], "flag": [True, False]}}


def _plan(name: str, version: str, identity: str) -> None:
    @query(name, _PLAN.replace("{identity}", identity).replace("+ n AS", "WITH n AS") + " SELECT target_id, locator, shard_id, 't:shard-00' || shard_id AS partition_key, 'batch-t-shard-00' || shard_id AS batch_id, 'r2,r1,r3' AS route_candidates FROM s")
    def run(spark, d):
        t = P.plan(spark, _spec(spark, d), "r", "g", version)[0]
        return t.select("target_id", "locator", "shard_id", "partition_key", "batch_id", F.array_join("route_candidates", ",").alias("route_candidates"))


_plan("plan_targets", "1.5.0", """'"page_type":"list","source_class":"registry",'""")
_plan("plan_targets_by_route", "1.4.0", """'"route_id":"r2",'""")


@query("plan_cells", _PLAN.replace("{identity}", """'"page_type":"list","source_class":"registry",'""").replace("+ n AS", "WITH n AS") + """, c AS (SELECT target_id, fs AS field_scope, 'CELL-' || substr(sha256('{"field":"' || fs || '","target_id":"' || target_id || '"}'), 1, 24) AS cell_id FROM s, (SELECT unnest(['f', 'g']) AS fs))
    SELECT *, 'PLAN-' || substr(sha256('{"cell_id":"' || cell_id || '"}'), 1, 24) AS attempt_id, 'm' AS market, 'r2' AS route_id, 'unchecked' AS state FROM c""")
def plan_cells(spark, d):
    return P.plan(spark, _spec(spark, d), "r", "g")[1].select("target_id", "field_scope", "cell_id", "attempt_id", "market", "route_id", "state")


@query("plan_new_rows", _PLAN.replace("{identity}", """'"page_type":"list","source_class":"registry",'""").replace("+ n AS", "WITH n AS") + " SELECT target_id, count(*) * 2 AS cells FROM s WHERE n >= 'J' GROUP BY 1")
def plan_new_rows(spark, d):
    t, c = P.plan(spark, _spec(spark, d), "r", "g")
    old = t.where(F.col("dimensions")["nation"] < "J")
    new, cells = P.against_existing(t, c, old, c.join(old.select("target_id"), "target_id", "left_semi"))
    return new.select("target_id").join(cells, "target_id").groupBy("target_id").agg(F.count("*").alias("cells"))


_EVENT_SQL = """e AS (SELECT event_id, '"alias":null,' AS a, '"dimensions":{"u":"' || user_id % 3 || '"},"discovery_method":"feed",' AS dm, '"entrypoint":"in",' AS en, '"market":null,' AS mk, '"query":"' || event_type || '",' AS qu, event_type, user_id FROM events),
    f AS (SELECT *, 'FRONTIER-' || substr(sha256('{' || a || dm || en || mk || qu || '"source_class":"c"}'), 1, 24) AS frontier_id FROM e)"""


def _events(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.lit(None).cast("string").alias("frontier_id"), F.lit("r").alias("run_id"), F.lit("g").alias("goal_id"), F.lit(" c ").alias("source_class"), F.lit("feed").alias("discovery_method"), F.lit("in").alias("entrypoint"),
        F.col("event_type").alias("query"), F.create_map(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("dimensions"), F.lit("active").alias("state"), F.concat(F.lit("t"), "event_id").alias("event_at"),
        (F.col("event_id") % 4).cast("long").alias("new_target_count"))


@query("frontier_event_ids", f"""WITH {_EVENT_SQL} SELECT event_id, frontier_id, 'FREV-' || substr(sha256('{{' || a || '"blocker_reason":null,"cursor":null,' || dm || '"duplicate_target_count":0,"end_reason":null,' || en || '"event_at":"t' || event_id || '","frontier_id":"' || frontier_id
    || '","goal_id":"g","invalid_target_count":0,' || mk || '"new_target_count":' || event_id % 4 || ',"parent_frontier_id":null,' || qu || '"run_id":"r","source_class":"c","state":"active"}}'), 1, 24) AS frontier_event_id FROM f""")
def frontier_event_ids(spark, d):
    return FR.with_ids(_events(spark, d)).select("event_id", "frontier_id", "frontier_event_id")


@query("frontier_new_events", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def frontier_new_events(spark, d):
    old = FR.with_ids(_events(spark, d).where("event_id % 3 = 0"))
    return FR.record_events(_events(spark, d), old).select("event_id")


@query("unfinished_frontiers", "SELECT frontier_id, arg_max(state, (ts, line)) AS state FROM fro GROUP BY 1 HAVING arg_max(state, (ts, line)) NOT IN ('exhausted', 'blocked')", ("frontier",))
def unfinished_frontiers(spark, d):
    return FR.unfinished(ledger(spark, d, "frontier"), ["frontier_id"], ("event_at", "line"), ("exhausted", "blocked")).select("frontier_id", "state")


@query("raw_artifact_ids", """SELECT doc_id, 'RAW-' || substr(sha256('{"attempt_id":"a-' || doc_id || '","run_id":"r","sha256":"' || sha256(text) || '","target_id":"t-' || doc_id % 9 || '"}'), 1, 24) AS raw_artifact_id,
    'raw/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || CASE doc_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.tar7' ELSE '.bin' END AS relative_path FROM documents""")
def raw_artifact_ids(spark, d):
    from ..sources import ledger as L
    end = F.element_at(F.array(*map(F.lit, (".HTML", ".Tar7", "", ".a-b"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.concat(F.lit("/in/p"), end).alias("path"))
    rows = L.payload_store(files).withColumns({"run_id": F.lit("r"), "target_id": F.concat(F.lit("t-"), F.col("doc_id") % 9), "attempt_id": F.concat(F.lit("a-"), "doc_id")})
    return L.raw_artifact_rows(rows).select("doc_id", "raw_artifact_id", "relative_path")


# --- run report

@query("adapter_summary", f"+ e AS (SELECT adapter, {_EFF}, count(DISTINCT target_id) FILTER (status = 'success') AS fully_successful_targets, count(DISTINCT target_id) FILTER (ok) AS usable_targets FROM att GROUP BY 1) SELECT {_EFF_OUT}, fully_successful_targets::DOUBLE / targets AS target_success_rate, usable_targets::DOUBLE / targets AS target_usable_rate FROM e", ("attempts",))
def adapter_summary(spark, d):
    return A.adapter_summary(ledger(spark, d, "attempts"))


@query("tasks_by_runner_class", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'unspecified' ELSE o_orderpriority END AS runner_class, count(*) AS tasks FROM orders GROUP BY 1")
def tasks_by_runner_class(spark, d):
    return R.tasks_by_runner(table(spark, d, "orders").select(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).otherwise("").alias("runner_class")))


@query("latest_decision", "SELECT CAST(o_orderkey AS VARCHAR) AS decision_id, o_orderstatus AS stop_decision, o_custkey AS selected_count FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_decision(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("decision_id"), F.col("o_orderstatus").alias("stop_decision"), F.col("o_custkey").alias("selected_count"),
                                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided_at"), F.col("o_orderkey").alias("line"))
    return R.latest_decision(t)


@query("raw_payloads", "SELECT count(*) AS artifacts, count(DISTINCT sha256(text)) AS payloads FROM documents")
def raw_payloads(spark, d):
    return R.raw_payloads(table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256")))


@query("observation_counts", 'SELECT count(*) AS "rows", count(DISTINCT id) AS ids, count(DISTINCT k) AS keys FROM obs', ("observations",))
def observation_counts(spark, d):
    return R.observation_counts(ledger(spark, d, "observations"))


@query("table_counts", """SELECT 'attempts' AS table_name, count(*) AS "rows" FROM events UNION ALL SELECT 'coverage', count(*) FROM orders UNION ALL SELECT 'tasks', count(*) FROM orders""")
def table_counts(spark, d):
    return R.table_counts({n: ledger(spark, d, n) for n in ("tasks", "coverage", "attempts")})


@query("completion_axes", """+ l AS (SELECT arg_max(state, (ts, attempt_id)) AS state FROM cov GROUP BY target_id, field), f AS (SELECT arg_max(status, (ts, attempt_no, attempt_id)) AS s, bool_or((stage = 'discover' AND ok) OR stage <> 'discover') AS dis FROM att GROUP BY target_id),
    r AS (SELECT arg_max(state, (ts, line)) AS state FROM fro GROUP BY frontier_id), x AS (SELECT 'coverage' AS axis, count_if(state <> 'unchecked') AS done, count(*) AS total FROM l
      UNION ALL SELECT 'collection', count_if(dis) - count_if(s IN ('timeout', 'blocked')), count_if(dis) FROM f UNION ALL SELECT 'discovery', count_if(state IN ('exhausted', 'blocked')), count(*) FROM r)
    SELECT *, done::DOUBLE / total AS rate FROM x""", ("coverage", "attempts", "frontier"))
def completion_axes(spark, d):
    return C.completion_axes(ledger(spark, d, "coverage"), ledger(spark, d, "attempts"), FR.latest_frontiers(ledger(spark, d, "frontier")))


@query("pilot_field_issues", """SELECT CAST(l_suppkey AS VARCHAR) AS target_id, 'field-' || l_linenumber AS field, i AS issue, count(*) AS n FROM lineitem JOIN customer ON l_suppkey = c_custkey, (SELECT unnest(['outside the field contract', 'not declared by the extractor']) AS i)
    WHERE l_linenumber > CASE i WHEN 'outside the field contract' THEN 4 ELSE 2 END GROUP BY ALL""")
def pilot_field_issues(spark, d):
    obs = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("target_id"), F.concat(F.lit("field-"), "l_linenumber").alias("field"))
    return C.pilot_field_issues(ledger(spark, d, "customers"), obs, [f"field-{i}" for i in range(1, 5)], ["field-1", "field-2"]).groupBy("target_id", "field", "issue").agg(F.count("*").alias("n"))


@query("select_targets", "SELECT CAST(c_custkey AS VARCHAR) AS target_id FROM customer WHERE c_custkey % 7 IN (1, 3) AND 'class-' || c_nationkey % 5 = 'class-2'")
def select_targets(spark, d):
    t = ledger(spark, d, "customers").withColumns({"shard_id": F.col("priority"), "batch_id": F.col("source_class")})
    return C.select_targets(t, batch_ids=["class-2"], shard_ids=[1, 3]).select("target_id")


@query("kind_conflicts", "SELECT CAST(l_orderkey AS VARCHAR) AS observation_key, count(DISTINCT l_linenumber % 3) AS kinds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 3) > 1")
def kind_conflicts(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("static", "slowly_changing", "dynamic"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    obs = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"), F.col("l_orderkey").cast("string").alias("observation_key"), kind.alias("field_kind"), F.lit("1").alias("value_json"))
    return M.kind_conflicts(obs)


@query("merge_problems", """SELECT CAST(o_orderkey AS VARCHAR) AS observation_id, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid field_kind' WHEN o_orderkey % 3 = 0 THEN 'invalid source_strength' ELSE 'time can''t be read' END AS problem FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0""")
def merge_problems(spark, d):
    when = lambda n, bad, good: F.when(F.col("o_orderkey") % n == 0, bad).otherwise(good)
    return M.problems(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("observation_id"), F.lit("k").alias("observation_key"), when(5, "odd", "static").alias("field_kind"),
                                                       when(3, "none", "unknown").alias("source_strength"), when(7, "never", "2026-01-01T00:00:00+02:00").alias("observed_at"), F.lit("2026-01-01").alias("retrieved_at")))


@query("materializable_states", "SELECT CAST(o_orderkey AS VARCHAR) AS observation_id FROM orders WHERE o_orderkey % 4 NOT IN (1, 2) AND o_orderkey % 5 <> 0")
def materializable_states(spark, d):
    """value_state: missing key, explicit null, absent and present; every fifth value is null."""
    key = F.col("o_orderkey")
    state = F.when(key % 4 == 2, "absent").when(key % 4 == 3, "present")
    line = F.when(key % 4 == 0, "{}").when(key % 4 == 1, '{"value_state":null}').otherwise('{"value_state":"x"}')
    return M.materializable(table(spark, d, "orders").select(key.cast("string").alias("observation_id"), F.when(key % 5 != 0, "1").otherwise("null").alias("value_json"), state.alias("value_state"), line.alias("raw_line"))).select("observation_id")


# --- scalars

@query("file_names", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.json' ELSE '.bin' END AS suffix, CASE p_partkey % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' ELSE 'application/octet-stream' END AS media, p_partkey % 5 <> 3 AS inside FROM part")
def file_names(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("a/p.HTML", "x.json", "a/.bin2", "../b", "c.toolongsuffix1"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.safe_suffix(name).alias("suffix"), X.media_type(name).alias("media"), X.contained_path(name).alias("inside"))


@query("json_numbers", "SELECT p_partkey, p_partkey % 6 IN (0, 1, 2) AS number FROM part")
def json_numbers(spark, d):
    text = F.element_at(F.array(*map(F.lit, ("1", "-2.5", "1e9", "true", "01", '"1"'))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.is_number(text).alias("number"))


@query("query_encoding", "SELECT p_partkey, replace(replace(p_name, '%', '%25'), ' ', '+') AS encoded FROM part")
def query_encoding(spark, d):
    return table(spark, d, "part").select("p_partkey", X.quote_plus(F.col("p_name")).alias("encoded"))


@query("instants", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch(o_orderdate) - CASE WHEN o_orderkey % 3 = 1 THEN 7200 ELSE 0 END END AS at FROM orders")
def instants(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, "soon").when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T00:00:00+02:00"))).otherwise(day)
    return table(spark, d, "orders").select("o_orderkey", X.instant(text).cast("double").alias("at"))


QUERIES |= RULE_QUERIES
ORACLE_SQL |= RULE_SQL
QUERIES |= RUN_QUERIES | {"stream_merged": stream_merged}
ORACLE_SQL |= RUN_SQL | {"stream_merged": ORACLE_SQL["merge_current_view"]}
