"""Deleted-interpolation n-gram language model.

Maximum-likelihood estimates of orders 1 to `order` and a uniform one are mixed by weights that depend on the
frequency of the longest context seen. The weights are learned by expectation-maximisation on deleted counts: every
training token is held out once, its own occurrence taken off all counts it took part in.

Counting covers the whole corpus. Texts are turned into blocks of about BLOCK tokens; each block sends the distinct
n-grams it holds, with their training counts, to the range of the hash space that owns them, and gets the corpus
counts back in the same order. Only distinct n-grams of a block travel, as compressed sorted differences, so a word
that a third of all rows hold costs one entry per block. Each order asks after the one before has its counts, so that
the exchange of one order is on disk at a time. No table of counts is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import pack, unpack
from ._common import crc_mod, discard, documents, materialise
from ._words import combine, hash_words, return_arrays, slices, tidy

#: Tokens of a block, and n-grams of a range of the hash space, in expectation.
BLOCK = 1_000_000
END, START = np.uint64(1), np.uint64(2)
#: Steps per octave of a probability in the statistics of expectation-maximisation; ZERO stands for probability 0.
STEPS, ZERO = 2, 255
#: Octaves of context frequency.
OCTAVES = 48

_BLOCK_SCHEMA = "docs array<long>, held array<boolean>, lengths array<long>, vocab binary, stream binary, tokens long"


def _blocks(block: int):
    def flush(docs: list, held: list, parts: list) -> pa.RecordBatch:
        lengths = [len(p) for p in parts]
        vocab, inv = np.unique(np.concatenate(parts), return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([docs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64())),
             pa.array([pack(vocab, delta=True)], pa.binary()), pa.array([pack(inv.astype(np.uint32))], pa.binary()), pa.array([sum(lengths)], pa.int64())],
            names=["docs", "held", "lengths", "vocab", "stream", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_arrays()
        docs, held, parts, size = [], [], [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            words, off = hash_words(batch.column("text"))
            ids, out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for i in range(batch.num_rows):
                docs.append(ids[i])
                held.append(out[i])
                parts.append(np.append(words[off[i]:off[i + 1]], END))
                size += len(parts[-1])
                if size >= block:
                    yield flush(docs, held, parts)
                    docs, held, parts, size = [], [], [], 0
        if docs:
            yield flush(docs, held, parts)
    return run


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows hold megabytes; one at a time is turned into Python objects."""
    return_arrays()
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


class _Block:
    """One block's tokens and its distinct n-grams, sorted by hash, of each order, or of order `only` + 1 alone."""

    def __init__(self, row: dict, order: int, only: int | None = None):
        self.lengths = np.asarray(row["lengths"], dtype=np.int64)
        self.held = np.asarray(row["held"], dtype=bool)
        vocab = unpack(row["vocab"], delta=True)
        stream = unpack(row["stream"], np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.train = np.repeat(~self.held, self.lengths)
        self.keys, self.inv = [vocab], [stream]
        self.end = int(np.searchsorted(vocab, END))
        words = vocab[stream]
        context = np.full(len(words), START, dtype=np.uint64)
        for k in range(1, order):
            # the k tokens before each place, START before the first
            before = np.roll(words, k)
            for j in range(k):
                at = self.starts[self.lengths > j] + j
                before[at] = START
            context = before if k == 1 else combine(before, context)
            uniq, inv = np.unique(combine(context, words), return_inverse=True) if only in (None, k) else (vocab[:0], stream[:0])
            self.keys.append(uniq)
            self.inv.append(inv.astype(np.uint32))

    def train_counts(self, k: int) -> np.ndarray:
        return np.bincount(self.inv[k], weights=self.train, minlength=len(self.keys[k])).astype(np.uint64)

    def lookup(self, counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Corpus counts of the n-gram that ends at each place, by order, and those of its context (from order 2)."""
        grams = [counts[k][self.inv[k]].astype(np.float64) for k in range(len(counts))]
        n_docs = float(counts[0][self.end])
        contexts = []
        for k in range(1, len(counts)):
            ctx = np.roll(grams[k - 1], 1)
            ctx[self.starts] = n_docs
            contexts.append(ctx)
        self.keys, self.inv = [], []  # not needed any more, and as large as the counts
        return grams, contexts


def _requests(k: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
        for batch in batches:
            for row in _one_by_one(batch):
                b = _Block(row, k + 1, only=k)
                keys, cnt = b.keys[k], b.train_counts(k)
                at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                own = [i for i in range(ranges) if at[i] < at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k * ranges + i for i in own], pa.int64()), pa.array([row["block"]] * len(own), pa.int64()),
                     pa.array([pack(keys[at[i]:at[i + 1]], delta=True) for i in own], pa.binary()),
                     pa.array([pack(cnt[at[i]:at[i + 1]]) for i in own], pa.binary())],
                    names=["range", "block", "keys", "counts"])
    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    return_arrays()
    keys = [unpack(x, delta=True) for x in pdf["keys"]]
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate([unpack(x) for x in pdf["counts"]])
    total = np.zeros(len(uniq), dtype=np.uint64)
    np.add.at(total, inv, own)
    ends = np.cumsum([len(k) for k in keys])
    out = pdf[["range", "block"]].copy()
    out["reply"] = [pack(total[inv[e - len(k):e]]) for k, e in zip(keys, ends)]
    out["kinds"] = [int((total > 0).sum())] + [0] * (len(pdf) - 1)
    out["mass"] = [int(total.sum())] + [0] * (len(pdf) - 1)
    return out


def _counts(row: dict, order: int, ranges: int) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(order)]
    for x in row["replies"]:  # sorted by range, so aligned with the block's sorted keys
        parts[x["range"] // ranges].append(unpack(x["reply"]))
    return [np.concatenate(p) for p in parts]


def _bucket(contexts: list[np.ndarray]) -> np.ndarray:
    """The highest order whose context was seen, and the octave of that context's frequency."""
    if not contexts:
        return np.zeros(0, np.int64)
    out = np.zeros(len(contexts[0]), dtype=np.int16)
    for k, ctx in enumerate(contexts, 1):
        out = np.where(ctx > 0, k * OCTAVES + np.log2(np.maximum(ctx, 1)).astype(np.int16), out)
    return out


def _estimates(grams: list[np.ndarray], contexts: list[np.ndarray], n: float) -> Iterator[np.ndarray]:
    for g, c in zip(grams, [np.float64(n), *contexts]):
        yield np.divide(g, c, out=np.zeros(len(g)), where=c > 0)


def _statistics(order: int, ranges: int, n: float):
    """Training places by context bucket and probabilities of each order, all with the place itself deleted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                b = _Block(row, order)
                grams, contexts = b.lookup(_counts(row, order, ranges))
                grams = [g[b.train] - 1 for g in grams]
                contexts = [c[b.train] - 1 for c in contexts]
                cell = _bucket(contexts).astype(np.int64) if contexts else np.zeros(len(grams[0]), np.int64)
                for p in _estimates(grams, contexts, n - 1):
                    with np.errstate(divide="ignore"):
                        q = np.minimum(np.round(-np.log2(p) * STEPS), ZERO - 1)
                    cell = cell << 8 | np.where(p > 0, q, ZERO).astype(np.int64)
                cells, many = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(many, pa.int64())], names=["cell", "places"])
    return run


def fit_weights(cells: np.ndarray, places: np.ndarray, order: int, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket, order + 1), the uniform estimate's first, by expectation-maximisation."""
    size = order * OCTAVES
    weights = np.full((size, order + 1), np.nan)
    q = np.stack([(cells >> (8 * (order - 1 - k))) & 255 for k in range(order)], axis=1) if len(cells) else np.zeros((0, order), np.int64)
    probs = np.concatenate([np.full((len(q), 1), uniform), np.where(q == ZERO, 0.0, 2.0 ** (-q / STEPS))], axis=1)
    bucket = cells >> (8 * order)
    for b in range(size):
        allowed = np.arange(order + 1) <= 1 + b // OCTAVES
        mine = bucket == b
        if not mine.any():
            continue
        p, n = probs[mine], places[mine].astype(np.float64)
        w = allowed / allowed.sum()
        for _ in range(rounds):
            part = p * w
            part /= part.sum(axis=1, keepdims=True)
            w = n @ part / n.sum()
        # a share for the uniform estimate remains, so no text has probability 0
        w[0] = max(w[0], 1e-6)
        weights[b] = w / w.sum()
    for b in range(size):  # a bucket without training places takes the weights of the nearest one of its order
        if np.isnan(weights[b, 0]):
            near = [c for c in range(b // OCTAVES * OCTAVES, (b // OCTAVES + 1) * OCTAVES) if not np.isnan(weights[c, 0]) and c < size]
            allowed = np.arange(order + 1) <= 1 + b // OCTAVES
            weights[b] = weights[min(near, key=lambda c: abs(c - b))] if near else allowed / allowed.sum()
    return weights


def _score(order: int, ranges: int, n: int, kinds: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                b = _Block(row, order)
                grams, contexts = b.lookup(_counts(row, order, ranges))
                base = np.log10((grams[0] + 0.1) / (n + 0.1 * (kinds + 1)))
                bucket = _bucket(contexts) if contexts else np.zeros(len(grams[0]), np.int64)
                prob = weights[bucket, 0] / (kinds + 1)
                for k, p in enumerate(_estimates(grams, contexts, n), 1):
                    p *= weights[bucket, k]
                    prob += p
                add = lambda x: np.add.reduceat(x, b.starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths, pa.int64()),
                     pa.array(add((grams[0] > 0).astype(np.int64)), pa.int64()), pa.array([n] * len(b.lengths), pa.int64()),
                     pa.array(add(base), pa.float64()), pa.array(add(np.log10(prob)), pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def deleted_interpolation(docs: DataFrame, held_out, order: int = 3, block: int = BLOCK) -> DataFrame:
    """Score every text by a model of the texts for which held_out (a boolean column of docs) is false.

    docs has doc_id and text; other columns are ignored. One row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-0.1 unigram log10 probability), score (the model's log10 probability). Tokens are
    words other than ASCII white space, A-Z lower-cased, then one end. Null, empty and blank texts are one end token;
    a null held_out is false; repeated rows count as often as they occur. Words are compared by 64-bit hashes.
    If no text is for training, only the uniform estimate is left, which is 1 then, and scores are 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    blocks = rows.mapInArrow(tidy(_blocks(block)), _BLOCK_SCHEMA).withColumn("block", F.monotonically_increasing_id())
    blocks = materialise(blocks, "blocks")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(1, -(-total // block))

    def ask(k: int) -> DataFrame:
        asked = blocks.mapInArrow(tidy(_requests(k, ranges)), "range long, block long, keys binary, counts binary")
        return materialise(asked.groupBy("range").applyInPandas(_answer, "range long, block long, reply binary, kinds long, mass long"), "replies")
    replies = []
    for k in range(order):
        replies.append(ask(k))
    found = replies[0].agg(F.sum("kinds"), F.sum("mass")).first()
    kinds, n = found[0] or 0, found[1] or 0
    by_block = reduce(DataFrame.union, replies).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "reply"))).alias("replies"))
    joined = materialise(blocks.join(by_block, "block"), "joined")
    discard(blocks, *replies)

    # At most a cell for each bucket and tuple of half-octave steps, however large the corpus.
    cells = joined.mapInArrow(tidy(_statistics(order, ranges, float(n))), "cell long, places long").groupBy("cell").agg(F.sum("places").alias("places")).toPandas()
    weights = fit_weights(cells["cell"].to_numpy(np.int64), cells["places"].to_numpy(np.int64), order, 1.0 / (kinds + 1))
    if not n:
        weights[:] = np.eye(order + 1)[0]
    return joined.mapInArrow(tidy(_score(order, ranges, n, kinds, weights)),
                             "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return deleted_interpolation(documents(spark, sf_dir), crc_mod(F.col("doc_id"), 10) == 0, order=3)
