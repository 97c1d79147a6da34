"""Benchmark decontamination: one Aho-Corasick automaton over normalised item windows, each text scanned once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, documents, materialise
from ._words import slices, tidy

#: Characters of window text in one automaton; the broadcast is a tenth of it. A larger benchmark takes several passes.
BLOCK_CHARS = 8_000_000
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: A-Z to lower case; every other ASCII character outside words to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FOLD = {c: c + 32 for c in range(65, 91)}
_HELD: dict[str, ahocorasick.Automaton] = {}
#: Automata that this process has built.
BUILT: list[str] = []


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: lower-cased runs of letters a-z, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _key(words: list[bytes]) -> str:
    """One character per byte, a space before and after each word, so that only whole words match."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[str, int]]:
    if 0 < len(words) < window:
        yield _key(words), len(words)
    for i in range(len(words) - window + 1):
        yield _key(words[i:i + window]), window


def _blocks(items: DataFrame, window: int, block_chars: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items as (id, words), in blocks of about block_chars characters of window text."""
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null").toLocalIterator():
        words = b" ".join(normal_words(row["text"]))
        if words:
            block.append((row["item"], words))
            size += len(words) * window
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _automaton(name: str, block: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton:
    if name not in _HELD:
        _HELD.clear()
        a = ahocorasick.Automaton()
        owners: dict[str, tuple[int, set[str]]] = {}
        for item, words in block:
            for key, n in windows_of(words.split(), window):
                owners.setdefault(key, (n, set()))[1].add(item)
        for key, value in owners.items():
            a.add_word(key, value)
        a.make_automaton()
        _HELD[name] = a
        BUILT.append(name)
    return _HELD[name]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(name: str | None, shared, window: int, keep: list[str], carried: bool, last: bool):
    """Search texts for one block's windows. carried: earlier blocks' findings come along; last: findings become offsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            a = _automaton(name, shared.value, window) if name else None
            texts = batch.column("text").to_pylist()
            keys = [_key(normal_words(t)) for t in texts]
            hits = [[(x["lo"], x["hi"]) for x in r] for r in batch.column("dc_hits").to_pylist()] if carried else [[] for _ in texts]
            items = [set(r) for r in batch.column("dc_items").to_pylist()] if carried else [set() for _ in texts]
            for i, key in enumerate(keys if a else []):
                at = spaces = 0
                for end, (n, owners) in a.iter(key):
                    spaces += key.count(" ", at, end)
                    at = end
                    hits[i].append((spaces - n, spaces))
                    items[i] |= owners
            merged_all = [_merged(found) for found in hits]
            kept = [batch.column(c) for c in keep]
            owners_of = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            if not last:
                found = pa.array([[{"lo": lo, "hi": hi} for lo, hi in m] for m in merged_all], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
                own = [] if "text" in keep else [batch.column("text")]
                yield pa.RecordBatch.from_arrays([*kept, *own, found, owners_of], names=[*keep, *["text"] * len(own), "dc_hits", "dc_items"])
                continue
            n_hit, spans = [], []
            for text, merged in zip(texts, merged_all):
                n_hit.append(sum(hi - lo for lo, hi in merged))
                places = [m.span() for m in WORD.finditer(text.translate(_FOLD))] if merged else []
                spans.append([{"start": places[lo][0], "end": places[hi - 1][1]} for lo, hi in merged])
            n_words = [key.count(" ") - 1 if len(key) > 2 else 0 for key in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), owners_of, pa.array(spans, _SPANS)],
                                             names=[*keep, "dc_n_words", "dc_n_hit", "dc_items", "dc_spans"])
    return run


def _merged(found: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for lo, hi in sorted(found):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    return merged


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Occurrences of benchmark windows in whole texts, in one pass without a shuffle.

    docs has text and the columns named in keep (doc_id if None); items has item_id and text. Returns keep,
    dc_n_words, dc_n_hit (words inside any occurrence), dc_items (item ids as sorted strings) and dc_spans (merged
    occurrences as code-point offsets of the original text). A window is `window` consecutive words of an item; an
    item of fewer words, but not none, is one window. Null texts have no words; items with a null id or text are
    ignored; repeated items count once; every repeated document is reported. The prefix dc_ keeps names apart.

    A benchmark of more than block_chars characters of window text takes one pass for each block of it, with the
    findings so far carried along in a written table, so that a worker builds each automaton once and holds one.
    """
    spark: SparkSession = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, F.col("text").cast("string").alias("text")) if "text" not in keep else docs.select(*keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    found = "dc_n_words long, dc_n_hit long, dc_items array<string>, dc_spans array<struct<start:long,end:long>>"
    state = ["text string"] * ("text" not in keep) + ["dc_hits array<struct<lo:long,hi:long>>", "dc_items array<string>"]
    blocks = _blocks(items, window, block_chars)
    block, before = next(blocks, None), None
    while True:
        after = next(blocks, None)
        shared = None if block is None else spark.sparkContext.broadcast(block)
        scan = tidy(_scan(None if block is None else uuid.uuid4().hex, shared, window, keep, before is not None, after is None))
        if after is None:
            return rows.mapInArrow(scan, ", ".join([*fields, found]))
        rows = materialise(rows.mapInArrow(scan, ", ".join([*fields, *state])), "leaks")
        if before is not None:
            discard(before)
        block, before = after, rows


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", F.col("dc_n_words").alias("n_words"), F.col("dc_n_hit").alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"), (F.col("dc_n_hit") > 0).alias("contaminated"))


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = r"regexp_extract_all(" + _LOWER_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = rf"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (
  SELECT item, CAST(least(len(w), 10) AS BIGINT) AS k, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda p: array_to_string(w[p:p + 9], ' '))) AS g
  FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, k, unnest(range(1, greatest(len(w) - k, -1) + 2)) AS p,
    unnest(list_transform(range(1, greatest(len(w) - k, -1) + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g
  FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT DISTINCT dg.doc_id, dg.p, dg.k, win.item FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
