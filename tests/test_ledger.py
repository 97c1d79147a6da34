"""Golden cases, metamorphic checks and one mutation per kind of integrity rule."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import expr as X
from ledgerlake.operators import attempts as A
from ledgerlake.operators import merge as M
from ledgerlake.operators import planner as P
from ledgerlake.operators import validate as V
from ledgerlake.sources import ledger as L

OBS = "observation_id string, run_id string, observation_key string, field_kind string, value_json string, source_strength string, observed_at string, retrieved_at string"
ROWS = [
    ("o-1", "run-1", "price", "dynamic", "70", "direct_primary", "2025-02-01", "2025-02-02"),
    ("o-2", "run-2", "price", "dynamic", "81", "weak_signal", "2025-03-09T10:00:00Z", "2025-03-09T11:00:00Z"),
    ("o-3", "run-2", "price", "dynamic", "82", "official_secondary", "2025-03-09T10:00:00Z", "2025-03-09T10:30:00Z"),
    ("o-4", "run-1", "founded", "static", "1901", "direct_primary", "2024-01-01", "2024-01-01"),
    ("o-5", "run-2", "founded", "static", "1910", "unknown", "2025-03-01", "2025-03-01"),
    ("o-6", "run-1", "staff", "dynamic", "12", "unknown", "2025-01-05", "2025-01-05"),
]


def test_merge_golden_and_order_invariant(spark):
    for rows in (ROWS, ROWS[::-1], ROWS + ROWS):
        view, conflicts = M.merge(spark.createDataFrame(rows, OBS), "run-2")
        got = {r["observation_key"]: (r["value_json"], r["selected_from_observation_id"]) for r in view.collect()}
        assert got == {"price": ("82", "o-3"), "founded": ("1901", "o-4")}
        kinds = sorted(r["conflict_type"] for r in conflicts.collect())
        assert kinds == ["competing_values", "competing_values", "stale_only"]


def test_merge_rejects_conflicting_ids_and_kinds(spark):
    twice = ROWS + [ROWS[0][:4] + ("71",) + ROWS[0][5:]]
    with pytest.raises(ValueError, match="several payloads"):
        M.merge(spark.createDataFrame(twice, OBS))
    kinds = ROWS + [("X",) + ROWS[3][1:3] + ("dynamic",) + ROWS[3][4:]]
    with pytest.raises(ValueError, match="several kinds"):
        M.merge(spark.createDataFrame(kinds, OBS))


def test_merge_of_nothing_and_nulls(spark):
    view, conflicts = M.merge(spark.createDataFrame([], OBS), "r")
    assert view.count() == conflicts.count() == 0
    assert M.current_view(spark.createDataFrame([ROWS[0][:4] + (None,) + ROWS[0][5:]], OBS)).count() == 0


def attempt_rows():
    """13 attempts on 4 targets: one recovers and gets two records, one stays without result, one stops after extraction, one is a duplicate."""
    spec = {"site-a": ["discover ok", "fetch timeout", "fetch ok", "parse ok", "extract ok"], "site-b": ["discover ok", "fetch rate_limited"],
            "site-c": ["discover ok", "fetch ok", "parse ok", "extract ok"], "site-d": ["discover ok", "fetch skipped_duplicate"]}
    at, before = 0, None
    for target, steps in spec.items():
        for text in steps:
            stage, status = text.split()
            at, no = at + 1, 2 if before == (target, stage) else 1
            n = 2 if (target, stage) == ("site-a", "extract") else 0
            yield (f"try-{at}", target, stage, "success" if status == "ok" else status, no, "2025-05-05", f"2025-05-05T10:{at:02d}:00Z", n, n, 100, 10, 5, 100, 0.01, "first", "crawler", "v2", None, None,
                   f"try-{at - 1}" if no == 2 else None)
            before = (target, stage)


ATT = ("attempt_id string, target_id string, stage string, status string, attempt_no long, started_at string, finished_at string, valid_record_count long, new_record_count long, elapsed_ms long, "
       "input_tokens long, output_tokens long, bytes_received long, cost double, batch_id string, adapter string, route_version string, route_id string, executor_class string, retry_of_attempt_id string")


def test_funnel_golden(spark):
    att = spark.createDataFrame(list(attempt_rows()), ATT)
    f = A.pipeline_funnel(att).first()
    assert (f["fetch_rate"], f["valid_rate"], f["end_to_end_rate"], f["duplicate"], f["unresolved"]) == (0.5, 0.5, 0.25, 1, 1)
    e = A.efficiency(att).first()
    assert (e["attempts"], e["targets"], round(e["cost"], 6), round(e["cost_per_new"], 6)) == (13, 4, 0.13, 0.065)
    assert A.retry_recovery(att).first()["recovery_rate"] == 1.0
    assert A.batch_yield(att).count() == 1 and A.stage_summary(att).count() == 5
    assert A.retry_link_issues(att).count() == 0
    r = A.route_metrics(att).first()
    assert r["route"] == "crawler" and r["executions"] == 5
    empty = att.limit(0)
    assert A.pipeline_funnel(empty).first()["fetch_rate"] is None and A.efficiency(empty).first()["attempts"] == 0


SPEC = {"planned_at": "2026-01-01T00:00:00Z", "shard_count": 3, "axes": {"a": ["x", "y"], "b": ["1", "2"], "c": ["p", "q"]}, "exclude": [{"a": "x", "b": "1", "c": "p"}],
        "templates": [{"template_id": "t", "vary_by": ["a", "b", "c"], "target_type": "page", "page_type": "p", "source_class": "s", "route_id": "r1", "route_candidates": ["r1", "r2"],
                       "locator_template": "HTTPS://Example.com:443/{a}?b={b}&utm_source=z&c={c}", "coverage_fields": ["f2", "f1"], "priority": 1}]}


def test_plan_golden(spark):
    targets, cells = P.plan(spark, SPEC)
    assert targets.count() == 7 and cells.count() == 14 and targets.select("target_id").distinct().count() == 7
    assert {r[0] for r in targets.select("locator").collect()} >= {"https://example.com/x?b=1&c=q"}
    again, conflicts = L.split_append(targets, targets, "target_id", ["locator", "template_id"])
    assert again.count() == 0 and conflicts.count() == 0
    assert P.shard_histogram(targets, 3).agg(F.sum("targets")).first()[0] == 7
    with pytest.raises(ValueError, match="unknown axis"):
        P.plan(spark, SPEC | {"templates": [SPEC["templates"][0] | {"vary_by": ["z"]}]})


@pytest.mark.parametrize("url, want", [
    ("  HTTP://Example.COM:80/a?b=2&a=1&UTM_x=3#f ", "http://example.com/a?a=1&b=2"), ("https://h.org", "https://h.org/"), ("not a url", "not a url"), ("http://h:080/x", "http://h/x"),
    ("https://h:8443/x?q=a+b&e=&gclid=1", "https://h:8443/x?e=&q=a+b"), ("https://h/x?q=%zz", "https://h/x?q=%25zz"), (None, None)])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(X.canonical_url(F.col("u"))).first()[0] == want


def test_credentials_are_refused(spark):
    with pytest.raises(Exception, match="embedded credentials"):
        spark.createDataFrame([("https://u:p@h/x",)], "u string").select(X.canonical_url(F.col("u"))).collect()


def digest(prefix, value):
    import hashlib
    return prefix + "-" + hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]


def test_ids_match_plain_python(spark):
    """Target, cell, frontier, event and artifact ids against dictionaries hashed in plain Python."""
    import itertools
    import hashlib
    spec = {"planned_at": "2025-01-01T00:00:00Z", "shard_count": 4, "axes": {"k": ["é x", "b"], "n": [1, 2.5, True, None]}, "exclude": [{"n": None}],
            "templates": [{"template_id": "t", "vary_by": ["k", "n"], "identity_axes": ["n"], "fixed_dimensions": {"market": "eu"}, "locator_template": "https://h.org/{k}/{n}", "coverage_fields": ["f"], "url_encode_axes": ["k"]}]}
    for version in ("1.5.0", "1.3.0"):
        targets, cells = P.plan(spark, spec, "run", "goal", version)
        want = {}
        for k, n in itertools.product(["%C3%A9+x", "b"], [1, 2.5, True]):
            extra = {"page_type": "unknown", "source_class": "unknown"} if version == "1.5.0" else {"route_id": "unassigned"}
            t = digest("T", {"target_type": "source_target", "locator": f"https://h.org/{k}/{n}", "dimensions": {"n": n}, **extra})
            want[t] = int(hashlib.sha256(t.encode()).hexdigest(), 16) % 4
        assert {r["target_id"]: r["shard_id"] for r in targets.collect()} == want
        assert all(r["batch_id"] == f"batch-t-shard-{want[r['target_id']]:03d}" for r in targets.collect())
        for c in cells.collect():
            assert c["cell_id"] == digest("CELL", {"target_id": c["target_id"], "field": "f"}) and c["attempt_id"] == digest("PLAN", {"cell_id": c["cell_id"]}) and c["market"] == "eu"
    event = {"run_id": "r", "goal_id": "g", "source_class": "c", "discovery_method": "feed", "entrypoint": "in", "dimensions": {"b": "2", "a": "1"}, "query": 'q"ö', "alias": None, "market": "m", "parent_frontier_id": None,
             "state": "exhausted", "cursor": None, "event_at": "t", "new_target_count": 3, "duplicate_target_count": 0, "invalid_target_count": 0, "end_reason": "done", "blocker_reason": None}
    schema = ", ".join(f"{k} {'map<string,string>' if k == 'dimensions' else 'long' if k.endswith('count') else 'string'}" for k in ["frontier_id", *event])
    row = spark.createDataFrame([{"frontier_id": None, **event}], schema)
    from ledgerlake.operators import frontier as FR
    got = FR.with_ids(row).first()
    f = digest("FRONTIER", {k: event[k] for k in ("source_class", "discovery_method", "entrypoint", "dimensions", "query", "alias", "market")})
    assert got["frontier_id"] == f and got["frontier_event_id"] == digest("FREV", event | {"frontier_id": f})
    log = FR.with_ids(row)
    assert FR.record_events(row, log).count() == 0 and FR.record_events(row.withColumn("event_at", F.lit("u")), log).count() == 1
    with pytest.raises(ValueError, match="another identity"):
        FR.record_events(row.withColumn("market", F.lit("z")).withColumn("frontier_id", F.lit(f)), log)
    with pytest.raises(ValueError, match="end_reason"):
        FR.record_events(row.withColumn("end_reason", F.lit("")), log)
    assert FR.parse_dimensions([" b = x=y", "a=1"]) == {"a": "1", "b": "x=y"}
    for bad in (["a"], ["=1"], ["a="], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            FR.parse_dimensions(bad)
    raw = spark.createDataFrame([("r", "t", "a", "0" * 64, "raw/x")], "run_id string, target_id string, attempt_id string, sha256 string, relative_path string")
    assert L.raw_artifact_rows(raw).first()["raw_artifact_id"] == digest("RAW", {"run_id": "r", "target_id": "t", "attempt_id": "a", "sha256": "0" * 64})
    with pytest.raises(Exception, match="leaves the package"):
        L.raw_artifact_rows(raw.withColumn("relative_path", F.lit("../x"))).collect()


def test_plan_against_existing_rows_and_contract(spark):
    targets, cells = P.plan(spark, SPEC)
    old = targets.limit(3)
    new, more = P.against_existing(targets, cells, old, cells.limit(2))
    assert new.count() == 4 and more.count() == 12 and [r[0] for r in new.select("target_id").collect()] == sorted(r[0] for r in new.select("target_id").collect())
    with pytest.raises(ValueError, match="conflict with the plan"):
        P.against_existing(targets, cells, old.withColumn("priority", F.lit(9).cast("long")), cells)
    contract = P.updated_contract({"required_cells": ["x"], "dimensions": ["z"]}, SPEC, cells)
    assert len(contract["required_cells"]) == 15 and contract["dimensions"] == ["a", "b", "c", "field", "target", "z"] and P.updated_contract(contract, SPEC, cells) == contract


def test_blocked_and_duplicate_rules(spark):
    """A duplicate counts whatever came later; a run is blocked by its last row alone."""
    base = next(attempt_rows())
    row = lambda i, status, at: (f"x{i}", "t", "fetch", status, 1, "s", at, *base[7:])
    att = spark.createDataFrame([row(1, "skipped_duplicate", "1"), row(2, "blocked", "2"), row(3, "success", "3")], ATT)
    assert A.pipeline_funnel(att).first()["duplicate"] == 1 and A.route_metrics(att).first()["blocked_share"] == 0
    assert A.route_metrics(spark.createDataFrame([row(1, "success", "1"), row(2, "invalid_target", "2")], ATT)).first()["blocked_share"] == 1


def test_ledger_files_to_merge_and_latest(spark, tmp_path):
    """JSON Lines read with their line numbers, merged and projected, as one would use them."""
    names = OBS.replace(" string", "").split(", ")
    lines = [json.dumps(dict(zip(names, r))) for r in ROWS]
    again = json.dumps(dict(reversed(list(zip(names, ROWS[0])))))
    null_state = json.dumps(dict(zip(names, ("o-7", *ROWS[0][1:2], "other", *ROWS[0][3:]))) | {"value_state": None})
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:4]) + "\n\n" + again + "\n")
    (tmp_path / "b.jsonl").write_text("\ufeff" + "\n".join([null_state, *lines[4:]]) + "\n")
    schema = spark.createDataFrame([], OBS + ", value_state string").schema
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        rows, issues = L.read_ledger(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], schema)
        places = sorted((r["_input_path"][-7:], r["line"]) for r in rows.collect())
        assert places == [("a.jsonl", i) for i in (1, 2, 3, 4, 6)] + [("b.jsonl", i) for i in (1, 2, 3)] and issues.count() == 0
        view, conflicts = M.merge(rows, "run-2")
        assert {r["observation_key"]: r["selected_from_observation_id"] for r in view.collect()} == {"price": "o-3", "founded": "o-4"}
        assert conflicts.count() == 3 and not {"raw_line", "line"} & set(view.columns)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "f.jsonl").write_text("".join(json.dumps({"frontier_id": "f", "state": s, "event_at": "1"}) + "\n" for s in ("active", "exhausted", "paused")))
    from ledgerlake.operators.frontier import latest_frontiers
    events, _ = L.read_ledger(spark, str(tmp_path / "f.jsonl"), spark.createDataFrame([], "frontier_id string, state string, event_at string").schema)
    assert latest_frontiers(events).first()["state"] == "paused"
    one = [(*ROWS[3][:4], None, *ROWS[3][5:], "x"), (*ROWS[3][:4], "1", *ROWS[3][5:], None)]
    assert M.id_conflicts(spark.createDataFrame(one, OBS + ", note string")).count() == 1
    for change in ({3: "odd"}, {5: "odd"}, {6: "soon"}):
        with pytest.raises(ValueError, match="may not be merged"):
            M.merge(spark.createDataFrame([tuple(change.get(i, x) for i, x in enumerate(ROWS[0]))], OBS))


def test_merge_stream_equals_batch(spark, tmp_path):
    from ledgerlake.streaming.logs import merge_stream, read_log
    schema = spark.createDataFrame([], OBS).schema
    for i, part in enumerate((ROWS[::2], ROWS[1::2])):
        spark.createDataFrame(part, OBS).write.mode("append").json(str(tmp_path / "in"))
        merge_stream(read_log(spark, str(tmp_path / "in"), schema), str(tmp_path / "store"), str(tmp_path / "view"), str(tmp_path / "cp"), "run-2").awaitTermination()
    want = M.current_view(spark.createDataFrame(ROWS, OBS), "run-2")
    got = L.read_current(spark, str(tmp_path / "view"), want.schema, "parquet")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_merge_stream_in_slices(spark, tmp_path, monkeypatch):
    """As above in many slices, whose shuffles don't stay; repeats, a changed current run, and ids with another payload or key."""
    from ledgerlake.streaming import logs
    monkeypatch.setattr(logs, "SLICE_ROWS", 120)
    rows = [(f"o-{i}", f"run-{i % 3}", f"k-{i * 7 % 40}", ("static", "dynamic")[i * 7 % 2], str(i % 11), ("unknown", "weak_signal")[i % 2], f"2025-01-{i % 28 + 1:02}", "2025-03-01") for i in range(240)]
    at = lambda x: str(tmp_path / x)
    schema = spark.createDataFrame([], OBS).schema

    def arrive(part, run="run-2"):
        spark.createDataFrame(part, OBS).coalesce(1).write.mode("append").json(at("in"))
        logs.merge_stream(logs.read_log(spark, at("in"), schema), at("store"), at("view"), at("cp"), run).awaitTermination()

    def same(seen, run="run-2"):
        want = M.current_view(spark.createDataFrame(seen, OBS), run)
        assert sorted(map(str, L.read_current(spark, at("view"), want.schema, "parquet").collect())) == sorted(map(str, want.collect()))
        assert sorted(r[0] for r in spark.read.parquet(at("store")).select("observation_id").collect()) == sorted({r[0] for r in seen})
    arrive(rows[:90])
    same(rows[:90])
    arrive(rows[60:200] + rows[100:130])
    same(rows[:200])
    view = L.current_version(spark, at("view"))
    assert any(n.startswith("slice-") and "-of-1-" not in n for n in map(lambda p: p.name, (tmp_path / "store").iterdir()))
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_")]
    for bad in (("o-1", "run-1", "k-7", "dynamic", "other", *rows[1][5:]), ("o-1", "run-1", "k-39", *rows[1][3:])):
        with pytest.raises(Exception, match="another payload"):
            arrive(rows[200:] + [bad])
        for f in (tmp_path / "in").glob("part-*"):
            if f.stat().st_mtime == max(x.stat().st_mtime for x in (tmp_path / "in").glob("part-*")):
                f.unlink()
                break
        import shutil
        shutil.rmtree(at("cp"))
        assert L.current_version(spark, at("view")) == view and spark.read.parquet(at("store")).count() == 200
        assert len(list((tmp_path / "view").glob("v-*"))) == 2
    arrive(rows, "run-1")
    same(rows, "run-1")


def test_run_report_and_package_files(spark, tmp_path):
    from ledgerlake.operators import report as R
    att = spark.createDataFrame(list(attempt_rows()), ATT).withColumn("run_id", F.lit("r")).withColumn("error_category", F.lit("e"))
    cov = spark.createDataFrame([("c1", "site-a", "f", "checked_hit", "1"), ("c2", "site-b", "f", "unchecked", "1")], "attempt_id string, target_id string, field_scope string, state string, retrieved_at string")
    obs = spark.createDataFrame(ROWS, OBS).withColumns({"field": F.lit("f"), "target_id": F.lit("site-a")})
    decisions = spark.createDataFrame([("d1", "2025-01-01", "continue", 3), ("d2", "2025-01-02", "blocked_only", 0)], "decision_id string, decided_at string, stop_decision string, selected_count long")
    report = R.run_report(spark, {"attempts": att, "coverage": cov, "observations": obs, "decisions": decisions}, {"run_id": "r"}, {"required_fields": ["f"]})
    assert report["pipeline"]["duplicate"] == 1 and report["adapters"]["crawler"]["fully_successful_targets"] == 4 and report["latest_decision"]["decision_id"] == "d2"
    assert report["fields"]["f"]["states"] == {"checked_hit": 1, "unchecked": 1} and report["fields"]["f"]["required"] and report["rows"]["attempts"] == 13
    text = L.write_report(spark, str(tmp_path / "report.json"), report)
    assert json.loads((tmp_path / "report.json").read_text()) == json.loads(text)
    with pytest.raises(ValueError, match="attempts with errors"):
        R.run_report(spark, {"attempts": att.withColumn("stage", F.lit("odd"))}, {})
    assert R.validation_report({"attempts": att})["passed"] and R.validation_report({"attempts": att.withColumn("stage", F.lit("odd"))})["errors"] == 13
    assert L.missing_files(spark, str(tmp_path)) == [("V01", f) for f in L.REQUIRED_FILES] and ("V03", "discovery_frontier.jsonl") in L.missing_files(spark, str(tmp_path), "1.5.0")
    assert ("V03", "discovery_frontier.jsonl") not in L.missing_files(spark, str(tmp_path), "1.4.0")
    (tmp_path / "bad.json").write_text("[1]")
    assert L.load_contract(spark, str(tmp_path / "bad.json"))[1] and L.load_contract(spark, str(tmp_path / "none.json"))[1] and L.load_contract(spark, str(tmp_path / "report.json"))[1] == []


def test_payloads_are_stored_once_and_checked(spark, tmp_path):
    files = spark.createDataFrame([("/in/a.HTML", bytearray(b"x")), ("/in/b.html", bytearray(b"x")), ("/in/c", bytearray(b"y"))], "path string, content binary")
    got = L.store_payloads(files, f"file://{tmp_path}/run").collect()
    assert all(r["stored_new"] for r in got) and len({r["relative_path"] for r in got}) == 2 and (tmp_path / "run" / got[0]["relative_path"]).read_bytes() in (b"x", b"y")
    assert not any(r["stored_new"] for r in L.store_payloads(files, f"file://{tmp_path}/run").collect())
    (tmp_path / "run" / got[0]["relative_path"]).write_bytes(b"z")
    with pytest.raises(Exception, match="another hash"):
        L.store_payloads(files, f"file://{tmp_path}/run").collect()


def test_decisions_are_recorded_once(spark):
    from ledgerlake.operators.selector import record_decision
    row = spark.createDataFrame([("d1", 1)], "decision_id string, n long")
    assert record_decision(row, row.limit(0))[1] is True
    kept, append = record_decision(row.withColumn("n", F.lit(2).cast("long")), row)
    assert append is False and kept.first()["n"] == 1


def test_hash_shard_and_ids_match_python(spark):
    import hashlib
    keys = [f"T-{i}é" for i in range(200)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", X.hash_shard(F.col("k"), 7).alias("s"), X.stable_id("T", X.json_object(b=X.json_text(F.col("k")), a=F.lit("1"))).alias("i")).collect()
    for r in rows:
        assert r["s"] == int(hashlib.sha256(r["k"].encode()).hexdigest(), 16) % 7
        text = json.dumps({"a": 1, "b": r["k"]}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r["i"] == "T-" + hashlib.sha256(text.encode()).hexdigest()[:24]


def test_version_gate(spark):
    rows = spark.createDataFrame([("1.5.0",), ("1.10.0",), ("1.4.9",), ("x",), (None,)], "v string").select(X.version_at_least(F.col("v"), (1, 5, 0))).collect()
    assert [r[0] for r in rows] == [True, True, False, False, False]


def test_read_and_append(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n[1]\nnonsense\n{"id": "b", "n": 2}\n')
    schema = spark.createDataFrame([], "id string, n long").schema
    rows, issues = L.read_ledger(spark, str(p), schema)
    assert sorted(r["id"] for r in rows.collect()) == ["a", "b"] and issues.count() == 2
    with pytest.raises(Exception, match="invalid ledger line"):
        L.read_ledger(spark, str(p), schema, strict=True)[0].collect()
    assert L.optional_ledger(spark, str(tmp_path / "none"), schema).count() == 0
    out = str(tmp_path / "store")
    good = rows.select("id", "n")
    assert L.append_idempotent(good, out, "id", ["n"]) == 2 and L.append_idempotent(good, out, "id", ["n"]) == 0
    with pytest.raises(ValueError, match="another payload"):
        L.append_idempotent(good.withColumn("n", F.lit(9).cast("long")), out, "id", ["n"])
    for n in (2, 1, 2, 1):
        L.replace_atomically(good.limit(n), str(tmp_path / "r"))
    assert L.read_current(spark, str(tmp_path / "r"), good.schema).count() == 1 and len(list((tmp_path / "r").glob("v-*"))) == 2


def test_init_package(spark, tmp_path):
    goal = {"goal_id": "g", "required_fields": ["a"], "optional_fields": [], "excluded_fields": ["b"], "schema_version": "1.5.0"}
    root = str(tmp_path / "run")
    snap = L.init_package(spark, root, goal, {"run_id": "r", "goal_id": "g"}, {})
    assert L.read_contract(spark, f"{root}/run_manifest.json")["input_snapshot"] == snap
    assert V.check_contracts(L.read_contract(spark, f"{root}/goal_contract.json"), L.read_contract(spark, f"{root}/run_manifest.json")) == []
    drift = V.check_contracts(goal | {"goal": "other"}, L.read_contract(spark, f"{root}/run_manifest.json"))
    assert drift == [("V07", "error", "input_snapshot does not match the goal")]
    with pytest.raises(FileExistsError):
        L.init_package(spark, root, goal, {}, {})


TASK = ("task_id string, goal_id string, input_snapshot string, partition_key string, owner string, status string, attempt long, runner_class string, executor_id string, dispatch_reason string, "
        "expected_output_schema string, acceptance_metric string, escalation_condition string, allowed_side_effects string, resource_lease_keys array<string>, prompt_version string, "
        "acceptance_result string, failure_class string, escalated_from_task_id string, escalation_step long, max_escalations long, model_tier string, reasoning_tier string, readiness_state string")


def task(**change):
    row = dict(task_id="t1", goal_id="g", input_snapshot="s", partition_key="p1", owner="o", status="completed", attempt=1, runner_class="child_agent", executor_id="e", dispatch_reason="d",
               expected_output_schema="x", acceptance_metric="m", escalation_condition="c", allowed_side_effects="none", resource_lease_keys=["l1"], prompt_version="1", acceptance_result="failed",
               failure_class="other", escalated_from_task_id=None, escalation_step=0, max_escalations=2, model_tier="balanced", reasoning_tier="low", readiness_state="ready")
    return tuple((row | change).values())


@pytest.mark.parametrize("rows, want", [
    ([task()], set()), ([task(status="odd")], {"V38"}), ([task(model_tier=None)], {"V39"}), ([task(failure_class=None)], {"V40"}),
    ([task(status="leased"), task(task_id="t2", status="pending", resource_lease_keys=["l2"])], {"V41"}), ([task(status="leased"), task(task_id="t2", partition_key="p2", status="leased")], {"V41"}),
    ([task(), task(task_id="t2", escalated_from_task_id="t1", escalation_step=1)], {"V42"}), ([task(), task(task_id="t2", escalated_from_task_id="t1", escalation_step=1, model_tier="strong_reasoning")], set()),
    ([task(), task(task_id="t1", partition_key="p9")], {"V38"})])
def test_task_rules(spark, rows, want):
    found = V.check_package({"tasks": spark.createDataFrame(rows, TASK)})
    assert {r["rule_id"] for r in found.collect()} == want


def test_foreign_keys_and_presence(spark):
    att = spark.createDataFrame(list(attempt_rows()), ATT).withColumn("run_id", F.lit("r")).withColumn("error_category", F.lit("e"))
    targets = spark.createDataFrame([("site-a",), ("site-b",), ("site-c",)], "target_id string")
    rules = [run for rule, needs, run in V.RULES if rule == "V26" and needs == {"attempts", "targets"}]
    assert sorted(r["row_key"] for r in rules[0]({"attempts": att, "targets": targets}).collect()) == ["try-12", "try-13"]
    assert V.check_package({"attempts": att}, only={"V26", "V27"}).count() == 0
    raw = att.limit(1).withColumn("raw_line", F.lit('{"attempt_id": null}'))
    assert "missing keys" in V.check_package({"attempts": raw}, only={"V26"}).first()["message"]


def test_streaming_latest_equals_batch(spark, tmp_path):
    from ledgerlake.operators.latest import latest
    from ledgerlake.streaming.logs import append_stream, latest_stream, read_log
    rows = [(f"k{i % 3}", i, f"v{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "key string, at long, v string")
    df.where("at % 2 = 1").write.json(str(tmp_path / "in"))
    df.where("at % 2 = 0").write.mode("append").json(str(tmp_path / "in"))
    q = latest_stream(read_log(spark, str(tmp_path / "in"), df.schema), ["key"], ("at",)).writeStream.outputMode("complete").format("memory").queryName("latest_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from latest_test").collect())) == sorted(map(tuple, latest(df, ["key"], ("at",)).collect()))
    for _ in range(2):
        append_stream(read_log(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), "v", ["at"], str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_queries_match_oracle(spark, sf):
    import duckdb

    from ledgerlake.plans.queries import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    norm = lambda v: None if v is None else float(f"{v:.10g}") if isinstance(v, float) else v
    for name in ("merge_current_view", "merge_conflicts", "pipeline_funnel", "route_metrics", "select_batch", "target_ids", "pilot_consistency", "lease_duplicates", "plan_targets", "frontier_event_ids",
                 "adapter_summary", "field_summary", "rule_V24", "rule_V34", "rule_V37", "rule_V42", "ledger_lines", "ledger_issues", "stream_latest", "stream_merged", "payload_places", "package_files",
                 "run_V22", "run_V25", "run_V28", "run_V29", "run_V47", "contract_rules"):
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        mine = sorted((tuple(map(norm, r)) for r in df.select(cols).collect()), key=str)
        cur = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
        assert sorted(names) == cols and mine == theirs, name
