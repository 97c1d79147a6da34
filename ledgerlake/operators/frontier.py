"""Discovery frontiers: event ids, latest states, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import json_map, json_object, json_text, stable_id
from ..functions.vocab import TERMINAL_FRONTIER
from .latest import FRONTIER, latest

IDENTITY = ("source_class", "discovery_method", "entrypoint", "query", "alias", "market")
_COUNTS = ("new_target_count", "duplicate_target_count", "invalid_target_count")
#: Texts of an event besides its identity; with the counts, the dimensions and these it is hashed whole.
_EVENT = ("frontier_id", "run_id", "goal_id", "parent_frontier_id", "state", "cursor", "event_at", "end_reason", "blocker_reason")


def parse_dimensions(values: list[str]) -> dict[str, str]:
    """name=value texts as a map in order of names; parts are trimmed, and only the first = counts."""
    out: dict[str, str] = {}
    for text in values:
        name, mark, value = (x.strip() for x in text.partition("="))
        if not (name and mark and value):
            raise ValueError(f"dimension {text!r} is no name=value")
        if name in out:
            raise ValueError(f"dimension {name!r} is given twice")
        out[name] = value
    return dict(sorted(out.items()))


def with_ids(events: DataFrame) -> DataFrame:
    """frontier_id, where missing, from identity and dimensions; frontier_event_id from the whole event.

    source_class and entrypoint are trimmed. Texts that events lacks as columns are null, counts 0.
    """
    names = (*IDENTITY, *_EVENT)
    out = events.withColumns({c: F.lit(None).cast("string") for c in names if c not in events.columns} | {c: F.lit(0).cast("long") for c in _COUNTS if c not in events.columns})
    if "dimensions" not in events.columns:
        out = out.withColumn("dimensions", F.create_map().cast("map<string,string>"))
    out = out.withColumns({"source_class": F.trim("source_class"), "entrypoint": F.trim("entrypoint")})
    text = lambda c: json_text(F.col(c).cast("string"))
    identity = {"dimensions": json_map(F.col("dimensions")), **{c: text(c) for c in IDENTITY}}
    out = out.withColumn("frontier_id", F.coalesce("frontier_id", stable_id("FRONTIER", json_object(**identity))))
    return out.withColumn("frontier_event_id", stable_id("FREV", json_object(**identity, **{c: text(c) for c in _EVENT}, **{c: F.col(c).cast("string") for c in _COUNTS})))


def event_problems(events: DataFrame) -> DataFrame:
    """(entrypoint, problem): events that may not be recorded."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    few = F.coalesce(F.least(*_COUNTS) < 0, F.lit(False))
    problem = (F.when(blank("source_class") | blank("entrypoint"), "source_class and entrypoint must not be empty").when(few, "counts must be 0 or more")
               .when((F.col("state") == "exhausted") & blank("end_reason"), "exhausted without end_reason").when((F.col("state") == "blocked") & blank("blocker_reason"), "blocked without blocker_reason"))
    return events.select("entrypoint", problem.alias("problem")).where("problem is not null")


def record_events(events: DataFrame, existing: DataFrame) -> DataFrame:
    """The events to append to an existing log, each id once; what may not be recorded, and a frontier whose identity differs
    from that of its earlier events, is an error."""
    new = with_ids(events)
    bad = [(r[0], r[1]) for r in event_problems(new).limit(5).collect()]
    if bad:
        raise ValueError(f"events that may not be recorded: {bad}")
    key = lambda: F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("\x00")) for c in IDENTITY], json_map(F.col("dimensions")))
    old = existing.select("frontier_id", key().alias("_old")).distinct()
    drift = [r[0] for r in new.select("frontier_id", key().alias("_new")).distinct().join(old, "frontier_id").where("_old <> _new").select("frontier_id").limit(5).collect()]
    if drift:
        raise ValueError(f"frontiers of another identity: {drift}")
    return new.dropDuplicates(["frontier_event_id"]).join(existing.select("frontier_event_id"), "frontier_event_id", "left_anti")


def unfinished(log: DataFrame, keys: list[str], order: tuple[str, ...], terminal: tuple[str, ...], state: str = "state") -> DataFrame:
    """What a resumed run has still to do: keys whose latest state is no terminal one."""
    return latest(log, keys, order).where(~F.coalesce(F.col(state).isin(*terminal), F.lit(False)))


def latest_frontiers(events: DataFrame) -> DataFrame:
    return latest(events, ["frontier_id"], FRONTIER)


def frontier_summary(events: DataFrame) -> DataFrame:
    """States over the latest events; counters over all events."""
    states = latest_frontiers(events).groupBy("state").agg(F.count("*").alias("frontiers"))
    return states.crossJoin(events.agg(F.sum("new_target_count").alias("new_targets"), F.sum("duplicate_target_count").alias("duplicate_targets")))  # one row


def identity_drift(events: DataFrame, columns: tuple[str, ...] = ("goal_id", *IDENTITY)) -> DataFrame:
    """Frontiers whose identity columns changed between events."""
    return events.groupBy("frontier_id").agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])).alias("identities")).where("identities > 1")


def open_frontiers(events: DataFrame) -> DataFrame:
    return latest_frontiers(events).where(~F.col("state").isin(*TERMINAL_FRONTIER)).select("frontier_id")


def discovery_complete(events: DataFrame, mode: str, assessed: bool = True, required: list[str] = ()) -> bool:
    """Ledger mode: every required frontier (or every known one) has ended, and there is one; other modes by flag."""
    if mode != "frontier_ledger":
        return assessed and mode in ("bounded_plan", "not_applicable")
    now = latest_frontiers(events)
    closed = now.where(F.col("state").isin(*TERMINAL_FRONTIER))
    if required:
        return closed.where(F.col("frontier_id").isin(*required)).count() == len(set(required))
    total, done = now.count(), closed.count()
    return total > 0 and total == done
