"""Line deduplication by shortest runs of lines.

A line here is a text line, or a sentence of one where it holds several, so that a passage set inside longer lines
is found as well. From every line, the shortest run of lines that is long enough to be removed is hashed, and so is the
shortest one up to every line; both depend on nothing around them. A passage of whole lines occurs again
just where its shortest runs do, and these cover all its lines, so whatever it is set in, the whole of it is found.
Runs that occur before are compared byte by byte and removed if equal.

Blocks of about BLOCK runs send their distinct hashes, as compressed sorted differences, each with its first place, to
the range of the hash space that owns them, and get back which of them occur elsewhere and which hold the first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blobs import pack, unpack
from ._common import discard, documents, materialise
from ._words import NOT_SPACE, range_hashes, slices, tidy, utf8

#: Lines (other than blank ones) and words that a run must have to be removed.
MIN_LINES, MIN_WORDS = 2, 10
#: Words with which a single line will do.
LONE_WORDS = 50
#: Runs of a block, and of a range of the hash space, in expectation.
BLOCK = 1_000_000
_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True
#: What a block is told about a hash: it occurs elsewhere; so it does, and the block has the first place.
AGAIN, FIRST = 1, 2

_BLOCK_SCHEMA = "ids array<long>, ths array<long>, lengths array<long>, start binary, size binary, h binary, runs long"


def line_runs(arr: pa.Array, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Shortest runs of all texts of an Arrow column in order: (text number, start, end, hash), offsets in bytes of the text.

    start:end leaves out what separates the run from the next line, which is one byte unless the text ends.
    """
    raw, off = utf8(arr)
    if not len(raw):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    newline = raw == 10
    stop = np.zeros(len(raw), dtype=bool)  # the separator after a line
    stop[1:] = _SENTENCE_END[raw[:-1]] & (raw[1:] == 32)
    stop |= newline
    cut = np.union1d(np.flatnonzero(stop) + 1, off)
    start, after = cut[:-1], cut[1:]
    end = np.where(stop[after - 1], after - 1, after)
    doc = np.searchsorted(off, start, "right") - 1
    edges = np.searchsorted(start, off)

    inside = NOT_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[start] = inside[start]
    words = np.concatenate([[0], np.cumsum(first)])[cut]  # before each line
    full = np.diff(words) > 0
    lines = np.concatenate([[0], np.cumsum(full)])
    a = np.flatnonzero(full)
    to = np.maximum(np.searchsorted(lines, lines[a] + min_lines), np.searchsorted(words, words[a] + min_words))
    to = np.minimum(to, np.searchsorted(words, words[a] + LONE_WORDS))
    ok = to <= edges[doc[a] + 1]
    b = a + 1
    at = np.minimum(np.searchsorted(lines, lines[b] - min_lines, "right"), np.searchsorted(words, words[b] - min_words, "right"))
    at = np.maximum(at, np.searchsorted(words, words[b] - LONE_WORDS, "right")) - 1
    ok_b = (at >= 0) & (at >= edges[doc[b - 1]])
    a, to, at, b = a[ok], to[ok], at[ok_b], b[ok_b]
    new = ~np.isin(at * (len(start) + 1) + b, a * (len(start) + 1) + to)
    a, to = np.append(a, at[new]), np.append(to, b[new])
    order = np.lexsort((to, a))  # the ends are in order then as well
    a, to = a[order], to[order]
    base = off[doc[a]]
    return doc[a], start[a] - base, end[to - 1] - base, range_hashes(raw, start[a], end[to - 1])


def _find(min_lines: int, min_words: int, block: int):
    def flush(parts: list) -> pa.RecordBatch:
        ids, ths, lengths, start, size, h = (np.concatenate(x) for x in zip(*parts))
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, ths, lengths)]
        packed = [pa.array([pack(x)], pa.binary()) for x in (start.astype(np.uint32), size.astype(np.uint32), h)]
        return pa.RecordBatch.from_arrays([*lists, *packed, pa.array([len(h)], pa.int64())], names=["ids", "ths", "lengths", "start", "size", "h", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            doc, start, end, h = line_runs(batch.column("text"), min_lines, min_words)
            if not len(h):
                continue
            own, lengths = np.unique(doc, return_counts=True)
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False)[own] for c in ("id", "th"))
            parts.append((ids, ths, lengths, start, end - start, h))
            n += len(h)
            if n >= block:
                yield flush(parts)
                parts, n = [], 0
        if parts:
            yield flush(parts)
    return run


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows hold megabytes; one at a time is turned into Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


class _Block:
    """One block's runs, and its distinct hashes in order, each with its first place."""

    def __init__(self, row: dict):
        self.ids, self.ths = (np.asarray(row[c], dtype=np.int64) for c in ("ids", "ths"))
        self.doc = np.repeat(np.arange(len(self.ids)), np.asarray(row["lengths"], dtype=np.int64))
        self.start = unpack(row["start"], np.uint32).astype(np.int64)
        self.end = self.start + unpack(row["size"], np.uint32)
        self.h = unpack(row["h"])
        order = np.lexsort((self.ths, self.ids))
        new = np.ones(len(order), dtype=bool)  # rows of one document have one rank
        new[1:] = (np.diff(self.ids[order]) != 0) | (np.diff(self.ths[order]) != 0)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        place = rank[self.doc] << 32 | self.start
        order = np.lexsort((place, self.h))
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.h[order[1:]] != self.h[order[:-1]]
        kind = np.cumsum(new) - 1
        self.first = order[new]
        self.keys = self.h[self.first]
        self.inv = np.empty(len(order), dtype=np.int64)
        self.inv[order] = kind
        self.is_first = place == place[self.first][self.inv]
        self.several = np.bincount(self.inv, weights=~self.is_first, minlength=len(self.keys)) > 0


def _requests(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
        for row in _one_by_one(batches):
            b = _Block(row)
            at = [0, *np.searchsorted(b.keys, cuts).tolist(), len(b.keys)]
            own = [i for i in range(ranges) if at[i] < at[i + 1]]
            part = lambda x, **kw: pa.array([pack(x[at[i]:at[i + 1]], **kw) for i in own], pa.binary())
            doc = b.doc[b.first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([row["block"]] * len(own), pa.int64()), part(b.keys, delta=True), part(b.ids[doc]), part(b.ths[doc]),
                 part(b.start[b.first].astype(np.uint32)), part(b.several.astype(np.uint8))],
                names=["range", "block", "keys", "ids", "ths", "start", "several"])
    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = [unpack(x, delta=True) for x in pdf["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    read = lambda c, kind: np.concatenate([unpack(x, kind) for x in pdf[c]])
    keys, ids, ths = np.concatenate(keys), read("ids", np.int64), read("ths", np.int64)
    start, several = read("start", np.uint32), read("several", np.uint8)
    order = np.lexsort((start, ths, ids, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    kind = np.cumsum(new) - 1
    lo = order[new][kind]
    same = (ids[order] == ids[lo]) & (ths[order] == ths[lo]) & (start[order] == start[lo])
    again = np.bincount(kind, weights=~same | (several[order] > 0)) > 0
    reply = np.empty(len(order), dtype=np.uint8)
    reply[order] = np.where(again[kind], np.where(same, FIRST, AGAIN), 0)
    out = pdf[["range", "block"]].copy()
    out["reply"] = [pack(x) for x in np.split(reply, ends[:-1])]
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, th, start, end, h, gone), by text: runs that go, and first places of those that occur again."""
    for row in _one_by_one(batches):
        b = _Block(row)
        # sorted by range, so aligned with the block's sorted keys
        reply = np.concatenate([unpack(x["reply"], np.uint8) for x in row["replies"]])[b.inv]
        stays = (reply == FIRST) & b.is_first
        use = (reply > 0) & ~stays
        # every other run that the ones before and behind it cover is left out
        g = np.flatnonzero(use)
        mid = np.arange(1, len(g) - 1, 2)
        mid = mid[(b.doc[g[mid - 1]] == b.doc[g[mid + 1]]) & (b.end[g[mid - 1]] + 1 >= b.start[g[mid + 1]])]
        gone = use.copy()
        use[g[mid]] = False
        at = np.flatnonzero(use | stays)
        if not len(at):
            continue
        own, heads = np.unique(b.doc[at], return_index=True)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), pa.array(x, kind))
        out = pa.RecordBatch.from_arrays(
            [pa.array(b.ids[own]), pa.array(b.ths[own]), lists(b.start[at].astype(np.int32), pa.int32()), lists(b.end[at].astype(np.int32), pa.int32()),
             lists(b.h[at].view(np.int64), pa.int64()), lists(gone[at], pa.bool_())], names=["id", "th", "start", "end", "h", "gone"])
        for i in range(0, out.num_rows, 2000):
            yield out.slice(i, 2000)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("raw")
        for i in range(batch.num_rows):
            text = raw[i].as_py()
            start, end = (batch.column(c)[i].as_py() for c in ("start", "end"))
            yield pa.RecordBatch.from_arrays([batch.column("h")[i].values, pa.array([text[a:b] for a, b in zip(start, end)], pa.binary())], names=["h", "piece"])


def _cuts(unequal: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, cuts = [], [], []
            for i in range(batch.num_rows):
                start, end, h, gone = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("start", "end", "h", "gone"))
                if unequal:
                    gone = gone & ~np.isin(h, unequal)
                start, after = start[gone].astype(np.int64), end[gone].astype(np.int64) + 1
                if len(start):
                    new = np.append(True, start[1:] > after[:-1])  # runs that touch are one
                    ids.append(batch.column("id")[i].as_py())
                    ths.append(batch.column("th")[i].as_py())
                    cuts.append([{"start": a, "end": b} for a, b in zip(start[new].tolist(), after[np.append(new[1:], True)].tolist())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["id", "th", "cuts"])
    return run


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """docs without the lines of repeated runs in text; all columns stay, and ld_chunks (stretches removed) is added.

    A line goes if it is in a run of lines of one text that occurs before, byte by byte, and has min_lines lines and
    min_words words, or LONE_WORDS words; of equal lines the first stays. Before is by (doc_id, text hash, place),
    wherever the texts are. White space that is left
    at the end after a removal goes. Null and empty texts are returned as they are, with 0 chunks; null doc_id comes
    before all others; rows that repeat both doc_id and text are one document and keep or lose the same lines.
    n_chars, where docs has it, is set anew for changed texts.
    """
    text = F.col("text").cast("string")
    identity = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th")]
    blocks = docs.select(*identity, text.alias("text")).mapInArrow(tidy(_find(min_lines, min_words, block)), _BLOCK_SCHEMA)
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    ranges = max(1, -(-(blocks.agg(F.sum("runs")).first()[0] or 0) // block))
    asked = blocks.mapInArrow(tidy(_requests(ranges)), "range long, block long, keys binary, ids binary, ths binary, start binary, several binary")
    replies = materialise(asked.groupBy("range").applyInPandas(_answer, "range long, block long, reply binary"), "replies")
    by_block = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "reply"))).alias("replies"))
    runs = blocks.join(by_block, "block").mapInArrow(tidy(_marks), "id long, th long, start array<int>, end array<int>, h array<long>, gone array<boolean>")
    runs = materialise(runs.dropDuplicates(["id", "th"]), "runs")  # rows of one document have the same ones
    discard(blocks, replies)

    texts = docs.select(*identity, F.encode(text, "UTF-8").alias("raw"))
    pieces = texts.join(runs, ["id", "th"]).select("raw", "start", "end", "h").mapInArrow(_pieces, "h long, piece binary")
    # hashes of different texts, of which none are to be expected
    different = pieces.groupBy("h").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a <> b").select("h")
    different = materialise(different, "unequal")  # so that the exchanged texts are off the disk before the last join
    unequal = [r["h"] for r in different.collect()]
    discard(different)
    gone = materialise(runs.mapInArrow(_cuts(unequal), "id long, th long, cuts array<struct<start: long, end: long>>"), "gone")
    discard(runs)

    raw = F.encode(F.col("text").cast("string"), "UTF-8")
    part = lambda a, b: F.substring(F.col("ld_raw"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    size = F.octet_length("ld_raw").cast("long")  # the last cut may end one byte beyond it
    at = F.concat(F.array(F.lit(0).cast("long")), F.col("ld_cuts.end"))
    to = F.concat(F.col("ld_cuts.start"), F.array(size))
    pieces = F.transform(F.arrays_zip(at.alias("a"), to.alias("b")), lambda x: F.decode(part(x["a"], x["b"]), "UTF-8"))
    changed = F.regexp_replace(F.array_join(pieces, ""), r"[ \n]+\z", "")
    left = docs.withColumn("ld_id", identity[0]).withColumn("ld_th", identity[1])
    out = left.join(gone.withColumnsRenamed({"id": "ld_id", "th": "ld_th", "cuts": "ld_cuts"}), ["ld_id", "ld_th"], "left").withColumn("ld_raw", F.when(F.col("ld_cuts").isNotNull(), raw))
    out = out.withColumn("text", F.when(F.col("ld_cuts").isNotNull(), changed).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("ld_cuts").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, F.coalesce(F.size("ld_cuts"), F.lit(0)).cast("long").alias("ld_chunks"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("ld_chunks").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), "text")
