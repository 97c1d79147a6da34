"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word has a sparse random index vector, derived from its hash. The vector of a word is the sum of the index
vectors of its neighbours, gathered over all documents; words share a fixed number of rows by their hash, so the
matrix that is summed up and broadcast has a fixed size (ROWS x DIM) whatever the corpus. Partial sums are added up
in two steps, so that no task reads those of all partitions. The network is fitted with
numpy on a bounded sample of labelled rows (SAMPLE at most, chosen by a hash of doc_id), and its logits are divided
by a temperature that is fitted on rows kept out of training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blobs import pack, unpack
from ._common import crc_mod, documents, materialise
from ._words import hash_words, mix, slices, tidy

#: Word rows and dimensions; float32, so 4 MB. Slices in which the matrix is summed up.
ROWS, DIM, SLICES = 1 << 14, 64, 64
#: Neighbours on either side; nonzero places of an index vector.
WINDOW, NONZERO = 2, 4
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE = 32, 40, 3e-3
_TOKENS = 100_000

#: Classes of bytes: letters, digits and bytes of non-ASCII characters make words, other visible characters marks.
CLASSES = np.full(256, 2, dtype=np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _rows(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of the words' index vectors, each (NONZERO, words); equal places add up."""
    code = mix(h + np.uint64(77))
    place = np.stack([(code >> np.uint64(8 * j)).astype(np.uint8) % np.uint8(DIM) for j in range(NONZERO)])
    sign = np.stack([1 - 2 * ((code >> np.uint64(60 + j)) & np.uint64(1)).astype(np.int8) for j in range(NONZERO)])
    return place, sign


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over a partition."""
    sums = np.zeros(ROWS * DIM, dtype=np.float64)
    for batch in (part for whole in batches for part in slices(whole)):
        words, off = hash_words(batch.column("text"), CLASSES, lower=False)
        row = _rows(words) * DIM
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        places, signs = index_vectors(words)
        for step in range(1, WINDOW + 1):
            near = doc[step:] == doc[:-step]
            a, b = row[:-step][near], row[step:][near]
            for place, sign in zip(places, signs):
                sums += np.bincount(a + place[step:][near], weights=sign[step:][near], minlength=ROWS * DIM)
                sums += np.bincount(b + place[:-step][near], weights=sign[:-step][near], minlength=ROWS * DIM)
    whole = np.rint(sums).astype(np.int64).reshape(SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pack(x) for x in whole], pa.binary())], names=["slice", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the partial sums of the slices of this partition; holds one array per slice, SLICES at most."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, blob in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist()):
            v = unpack(blob, np.int64)
            total[s] = total[s] + v if s in total else v.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x) for x in total.values()], pa.binary())], names=["slice", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors (ROWS, DIM) of all texts of docs; rows without words are 0."""
    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(_gather), "slice int, sums binary")
    # partial sums of some input partitions first, one task for each shuffle partition; then all of a slice
    some = partial.withColumn("part", F.spark_partition_id()).repartition("part").drop("part").mapInArrow(_add_up, "slice int, sums binary")
    sums = some.repartition(SLICES, "slice").mapInArrow(_add_up, "slice int, sums binary").collect()  # ROWS x DIM in all
    m = np.zeros((SLICES, ROWS * DIM // SLICES))
    for r in sums:
        m[r["slice"]] = unpack(r["sums"], np.int64)
    m = m.reshape(ROWS, DIM)
    m = np.sign(m) * np.log1p(np.abs(m))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(norm > 0, norm, 1)).astype(np.float32)


FEATURES = DIM + 4


def pooled(arr: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of every text: mean word vector, mean similarity to the next, second and third next word, log length."""
    words, off = hash_words(arr, CLASSES, lower=False)
    row = _rows(words)
    out = np.zeros((len(off) - 1, FEATURES), dtype=np.float64)
    n = np.diff(off)
    out[:, -1] = np.log1p(n)
    # pieces of about _TOKENS words; a long text spans several
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(off, off[i] + _TOKENS, "right")) - 1)
        for lo in range(int(off[i]), int(off[j]), _TOKENS):
            hi = min(lo + _TOKENS, int(off[j]))
            x = vectors[row[lo:min(hi + 3, int(off[j]))]]
            doc = np.repeat(np.arange(i, j), np.diff(np.clip(off[i:j + 1], lo, min(hi + 3, int(off[j])))))
            own = hi - lo
            heads = np.flatnonzero(np.concatenate([[True], doc[1:own] != doc[:own - 1]]))
            out[doc[heads], :DIM] += np.add.reduceat(x[:own], heads, axis=0)
            for step in (1, 2, 3):
                m = min(own, len(x) - step)
                if m > 0:
                    near = doc[step:step + m] == doc[:m]
                    sim = np.einsum("ij,ij->i", x[:m], x[step:step + m]) * near
                    out[:, DIM + step - 1] += np.bincount(doc[:m], weights=sim, minlength=len(n))
        i = j
    out[:, :-1] /= np.maximum(n, 1)[:, None]
    return out


class Network:
    """Two layers, tanh and logistic, fitted by Adam on standardised features; fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, tune: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(7)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        fit = np.flatnonzero(~tune)
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        epochs = max(EPOCHS, min(400, 40_000 // max(len(fit), 1)))
        for _ in range(epochs):
            rng.shuffle(fit)
            for at in range(0, len(fit), 256):
                b = fit[at:at + 256]
                hid = np.tanh(z[b] @ p[0] + p[1])
                err = (1 / (1 + np.exp(-(hid @ p[2] + p[3]))) - t[b]) / len(b)
                back = err[:, None] * p[2] * (1 - hid**2)
                grads = [z[b].T @ back + 1e-4 * p[0], back.sum(axis=0), hid.T @ err, np.array([err.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        self.temperature = 1.0
        held = np.flatnonzero(tune) if tune.any() else fit
        logit, target = self.logits(x[held]), t[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        loss = [np.mean(np.logaddexp(0, np.where(target > 0, -logit, logit) / g)) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            x = pooled(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("tune"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "tune", "x"])
    return run


def _apply(shared, model, prior: float, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            p = model.probabilities(pooled(batch.column("text"), shared.value)) if model else np.full(batch.num_rows, prior)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(p, pa.float64())], names=[*keep, "q_score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """keep (default doc_id) of every row of docs and q_score, the calibrated probability of label 1.

    docs has doc_id and text, labels doc_id and quality (0 or 1). Labels are learned from rows for which learn, a
    boolean expression over doc_id, is true. Only text enters a score. Null text is scored as the empty text; labels
    with a null id or quality are left out; of several labels of one id the smallest counts; repeated documents are
    each scored. If the sample lacks a class, every score is the share of label 1 in it, or 0.5 without any label.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)  # ROWS x DIM floats
    chosen = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
        .withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
        .select("doc_id", "y", (F.pmod(F.col("order"), F.lit(5)) == 0).alias("tune")))
    chosen = materialise(chosen, "sample")  # at most `sample` rows of 13 bytes, so it may be broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").select("y", "tune", F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(tidy(_features(shared)), "y int, tune boolean, x binary").toPandas()
    x = np.stack([np.frombuffer(b) for b in got["x"]]) if len(got) else np.zeros((0, FEATURES))
    y, tune = got["y"].to_numpy(np.int64), got["tune"].to_numpy(bool)
    # the same result whatever the order of arrival
    order = np.lexsort([*x.T[:3], y]) if len(x) else np.zeros(0, np.int64)
    x, y, tune = x[order], y[order], tune[order]
    model = Network(x, y, tune) if len(set(y[~tune].tolist())) == 2 else None
    prior = float(y.mean()) if len(y) else 0.5
    cols = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["q_score double"])
    return docs.select(*cols).mapInArrow(tidy(_apply(shared, model, prior, keep)), schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    scored = score_quality(documents(spark, sf_dir).select("doc_id", "text"), labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("q_score").alias("score"), (F.col("q_score") >= 0.5).cast("int").alias("predicted"))
