"""N-gram Jaccard self-join by a token-group matrix.

Similar documents are put into groups of bounded size; for every group the union of its members' tokens is kept.
A pair of groups is opened only if their unions meet where a link would have to show and their sizes admit one, and
inside an opened pair a document is compared with the members of a group only if its overlap with the group's token
union reaches the least overlap that a link needs. Nothing is capped: a bound that holds only says that no link is
possible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, discard, documents, key_filter, materialise, may_hold
from ._words import hash_words, ngram_hashes, slices, tidy

#: Members of a group at most, in expectation (hot keys are dealt into so many groups by a hash).
GROUP_SIZE = 256
#: Classes by share of tokens of their own into which a large cluster is dealt, so that bounds of groups are near those of members.
TIERS = 8
#: Rows of one set from which its component reaches them by broadcast, not by a join on the set.
HOT_ROWS = 200


def sample_of(percent: int) -> int:
    """One token in so many is counted over the whole corpus; the others still take part in every exact comparison.

    The share counted has to be well above the share in which linked sets may differ, or unrelated sets pass.
    """
    return 4 if percent >= 90 else 3 if percent >= 80 else 2 if percent >= 65 else 1


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    words, off = hash_words(batch.column("text"))
    for i in range(batch.num_rows):
        w = words[off[i]:off[i + 1]]
        yield i, np.unique(ngram_hashes(w, k)) if len(w) else w


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _sketch(k: int, percent: int):
    sample = np.uint64(sample_of(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            n, sig, tok = [], [], []
            for _, s in _sets(batch, k):
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tok.append(s[s % sample == 0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), _lists(tok)], names=["doc_id", "n", "sig", "tok"])
    return run


def _full(k: int, wanted):
    """Whole sets of the texts whose doc_id passes a key filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole.filter(pa.array(may_hold(wanted.value, whole.column("doc_id"))))):
                sets = [s for _, s in _sets(batch, k)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), _lists(sets)],
                    names=["doc_id", "sig", "toks"])
    return run


class _Links:
    """Links among sets of shareable tokens, found set by set against a group's inverted tokens; components by union-find."""

    def __init__(self, pdf: pd.DataFrame, percent: int):
        self.percent = percent
        self.reps, self.n = pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        self.toks = [np.asarray(t, dtype=np.int64).view(np.uint64) for t in pdf["toks"]]
        self.parent = list(range(len(pdf)))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def between(self, left: np.ndarray, right: np.ndarray) -> None:
        """Open a group for the sets of another one (or its own): a set is compared with the members only if its overlap
        with the union of the group's tokens is what a link needs at least."""
        if not len(left) or not len(right):
            return
        flat = np.concatenate([self.toks[i] for i in right])
        owner = np.repeat(np.arange(len(right)), [len(self.toks[i]) for i in right])
        order = np.argsort(flat, kind="stable")
        union, first, per = np.unique(flat[order], return_index=True, return_counts=True)
        owner, sizes = owner[order], self.n[right]
        for i in left:
            t, n = self.toks[i], self.n[i]
            pos = np.minimum(np.searchsorted(union, t), max(len(union) - 1, 0))
            hit = pos[union[pos] == t] if len(union) else pos[:0]
            if 100 * len(hit) < self.percent * n:
                continue
            width = per[hit]
            at = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            both = np.bincount(owner[at], minlength=len(right))
            for j in right[np.flatnonzero(100 * both >= self.percent * (n + sizes - both))]:
                a, b = self.find(int(i)), self.find(int(j))
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    self.edges.append((self.reps[i], self.reps[j]))


def _star(percent: int):
    """Links of a large cluster's first group (ga) with another group of it (gb), and inside both.

    Rows (a, b, false): links, as a spanning forest; rows (sid, label, true): members of gb that have a link. Members
    with one label are connected; the sid of a set of the first group is the label where there is one.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ga, gb = key
        pdf = pdf.assign(second=pdf["gid"] != ga).sort_values(["second", "sid"], kind="stable")
        own = pdf["gid"].to_numpy() == gb
        links, sid = _Links(pdf, percent), pdf["sid"].to_numpy()
        head, body = np.flatnonzero(pdf["gid"].to_numpy() == ga), np.flatnonzero(own)
        links.between(head, head)
        if ga != gb:
            links.between(body, head)
            links.between(body, body)
        root = np.array([links.find(i) for i in range(len(pdf))])  # the first in order, so one of ga if there is any
        several = np.bincount(root, minlength=len(pdf))[root] > 1
        mine = np.flatnonzero(own & several)
        out = [(a, b, False) for a, b in links.edges] + [(sid[i], sid[root[i]], True) for i in mine]
        return pd.DataFrame(out, columns=["a", "b", "label"]).astype({"a": "int64", "b": "int64", "label": "bool"})
    return run


def _open(percent: int):
    """Links between the members of groups ga and gb (inside ga, if equal), as a spanning forest of them."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ga, gb = key
        pdf = pdf.sort_values("sid", kind="stable")
        links, gid = _Links(pdf, percent), pdf["gid"].to_numpy()
        seen: dict[int, int] = {}
        for i, x in enumerate(pdf["label"]):
            if x is not None and x == x:  # sets with one label are connected already
                links.parent[i] = seen.setdefault(int(x), i)
        links.between(np.flatnonzero(gid == ga), np.flatnonzero(gid == gb))
        return pd.DataFrame(links.edges, columns=["a", "b"], dtype="int64")
    return run


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, group_size: int = GROUP_SIZE) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard similarity of percent/100 or more.

    docs has doc_id (integer) and text; other columns are ignored. One row per input row: doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, its own included). Words are runs of characters other
    than ASCII white space, A-Z lower-cased. Null, empty and blank texts have no shingles and stay alone. A text of
    fewer than k words is one shingle. doc_id should be a key; where it repeats, each row is judged by its own text and equal
    ids share their links. A null doc_id gets a null component_id and links nothing. Shingles are compared by 64-bit hashes.

    Exactness: let slack = n - ceil(percent * n / 100). A token that occurs in one set only can't be shared, so a set
    with more than slack of them (alone) is in no link; and two linked sets share a token within the first
    slack + 1 - alone others of either in any fixed order, which is by number of sets, then hash. The overlap of two
    sets is at most n - alone of either. Sampled tokens are counted over the corpus to drop sets by the first rule;
    all tokens of the sets that are left are counted again, and prefixes and bounds come from those counts.

    Near copies that share their rarest tokens fall into one cluster. A large one is opened as a star first: its
    groups each against the one with the fewest tokens of its own, so work grows with its size. What is then known to
    be connected becomes groups of its own, which are never opened against each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = docs.mapInArrow(tidy(_sketch(k, percent)), "doc_id long, n long, sig binary, tok array<long>")
    sketch = materialise(sketch.withColumn("rid", F.monotonically_increasing_id()), "sketch")

    slack = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
    seen = sketch.where("doc_id is not null").select("rid", F.explode("tok").alias("tok"))
    counts = seen.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1").select("tok")
    shared = seen.join(counts, "tok", "left_semi").groupBy("rid").agg(F.count("*").alias("shared"))
    left = sketch.where("n > 0 and doc_id is not null").select("rid", "doc_id", "n", "sig", F.size("tok").alias("s")).join(shared, "rid", "left")
    left = left.where(F.col("s") - F.coalesce("shared", F.lit(0)) <= slack)
    # Equal sets are one from here on.
    left = left.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    left = materialise(left.withColumn("sid", F.monotonically_increasing_id()), "left")
    rows = materialise(sketch.select("doc_id", F.col("n").alias("n_shingles"), "sig"), "rows")
    discard(sketch)

    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(left.select("rep")))  # 8 MB at most
    full = docs.mapInArrow(tidy(_full(k, wanted)), "doc_id long, sig binary, toks array<long>").withColumnRenamed("doc_id", "rep")
    sets = materialise(full.join(left, ["rep", "sig"]).dropDuplicates(["rep", "sig"]).select("sid", "rep", "n", "toks"), "sets")
    discard(left)
    seen = sets.select("sid", F.explode("toks").alias("tok"))
    counts = seen.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    shared = seen.join(counts, "tok").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("m"))
    alone = F.col("n") - F.size("m")
    members = (
        shared.join(sets.select("sid", "rep", "n"), "sid").where(alone <= slack)
        .select("sid", "rep", "n", alone.alias("alone"), F.floor(TIERS * alone / (slack + 1)).alias("tier"), F.array_min("m.tok").alias("mh"),
                F.slice(F.col("m.tok"), F.lit(1), (slack + 1 - alone).cast("int")).alias("prefix"), F.array_sort("m.tok").alias("toks")))
    members = materialise(members, "members")
    discard(sets)

    tiers = members.groupBy("mh", "tier").agg(F.count("*").alias("c"))
    large = tiers.groupBy("mh").agg(F.sum("c").alias("all")).where(F.col("all") > group_size).select("mh")
    parts = tiers.join(large, "mh").select("mh", "tier", F.ceil(F.col("c") / group_size).alias("parts"))
    part = F.pmod(F.xxhash64("sid"), F.col("parts"))
    grouped = members.join(parts, ["mh", "tier"], "left").withColumn("large", F.col("parts").isNotNull())
    grouped = grouped.withColumn("gid", F.when(F.col("large"), F.xxhash64("mh", "tier", part)).otherwise(F.xxhash64("mh")))
    grouped = materialise(grouped.drop("parts"), "grouped")
    discard(members)

    groups = grouped.where("large").groupBy("mh", "gid").agg(F.first("tier").alias("tier"))
    heads = groups.groupBy("mh").agg(F.min_by("gid", F.struct("tier", "gid")).alias("ga"))
    stars = groups.join(heads, "mh").select("ga", F.col("gid").alias("gb"))
    sides = stars.select("ga", "gb", F.explode(F.array_distinct(F.array("ga", "gb"))).alias("gid"))
    first = sides.join(grouped.where("large").select("gid", "sid", "rep", "n", "toks"), "gid").groupBy("ga", "gb").applyInPandas(_star(percent), "a long, b long, label boolean")
    first = materialise(first, "first")

    labels = first.where("label").select(F.col("a").alias("sid"), F.col("b").alias("label"))
    grouped = grouped.join(labels, "sid", "left").withColumn("gid", F.when(F.col("label").isNotNull(), F.xxhash64("gid", "label")).otherwise(F.col("gid")))
    grouped = materialise(grouped.select("gid", "sid", "rep", "n", (F.col("n") - F.col("alone")).alias("s"), "label", "large", "prefix", "toks"), "grouped")

    matrix = grouped.select("gid", "n", "s", "label", F.explode("prefix").alias("tok")).groupBy("tok", "gid").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("s").alias("s"),
        F.when((F.min("label") == F.max("label")) & (F.count("label") == F.count("*")), F.min("label")).alias("label"))
    a, b = matrix.alias("a"), matrix.alias("b")
    apart = ~F.coalesce(F.col("a.label") == F.col("b.label"), F.lit(False))
    met = a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.gid") < F.col("b.gid")) & apart
                 & _may_link(percent, F.col("a.hi"), F.col("a.s"), F.col("a.lo"), F.col("b.lo"), F.col("b.hi"), F.col("b.s")))
    pairs = met.groupBy(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb")).agg(
        *[f(F.col(f"{x}.{c}")).alias(f"{x}_{c}") for x in "ab" for f, c in ((F.min, "lo"), (F.max, "hi"), (F.max, "s"))])
    wide = (F.lit(0).cast("long"), F.lit(1 << 40), F.lit(1 << 40))
    own = grouped.where("not large").groupBy("gid").agg(F.count("*").alias("c")).where("c > 1")
    sides = (
        pairs.select("ga", "gb", F.col("ga").alias("gid"), "b_lo", "b_hi", "b_s").union(pairs.select("ga", "gb", "gb", "a_lo", "a_hi", "a_s"))
        .union(own.select("gid", "gid", "gid", *wide)).toDF("ga", "gb", "gid", "o_lo", "o_hi", "o_s"))
    sides = materialise(sides, "sides").alias("o")
    # only members that the bounds of the other group admit
    admitted = (F.col("o.gid") == F.col("g.gid")) & _may_link(percent, F.col("g.n"), F.col("g.s"), F.col("g.n"), F.col("o_lo"), F.col("o_hi"), F.col("o_s"))
    opened = sides.join(grouped.alias("g"), admitted).select("ga", "gb", "g.gid", "sid", "rep", "n", "label", "toks")
    edges = opened.groupBy("ga", "gb").applyInPandas(_open(percent), "a long, b long")
    comp = components(edges.union(first.where("not label").select("a", "b")))
    discard(first, grouped)

    reps = rows.where("n_shingles > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    reps = materialise(reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("sig", "c", F.coalesce("component", "rep").alias("component_id")), "reps")
    # A set that more than a thousandth of the rows have could fill one task of the join; there are fewer than 1,000 such sets.
    hot = reps.where(F.col("c") > max(HOT_ROWS, rows.count() // 1000)).select("sig", "component_id")
    linkable = rows.where("n_shingles > 0 and doc_id is not null")
    out = linkable.join(F.broadcast(hot), "sig").select("doc_id", "n_shingles", "component_id")
    rest = linkable.join(F.broadcast(hot.select("sig")), "sig", "left_anti").join(reps.join(F.broadcast(hot.select("sig")), "sig", "left_anti"), "sig")
    lone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(rest.select("doc_id", "n_shingles", "component_id")).union(lone)


def _may_link(percent: int, a_hi: Column, a_s: Column, a_lo: Column, b_lo: Column, b_hi: Column, b_s: Column) -> Column:
    """Whether sets of lo to hi tokens, of which s at most can be shared, may link: by size, and by the overlap needed."""
    return (100 * a_hi >= percent * b_lo) & (100 * b_hi >= percent * a_lo) & ((100 + percent) * F.least(a_s, b_s) >= percent * (a_lo + b_lo))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=3, percent=90)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' '))) END AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN sha256(array_to_string(list_sort(g), chr(10))) END AS key, g FROM s),
r AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM k WHERE key IS NOT NULL GROUP BY key),
t AS (SELECT rep, n, unnest(g) AS x FROM r),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT rep AS id, rep AS c FROM r UNION SELECT e.b, reach.c FROM reach JOIN e ON reach.id = e.a),
m AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.c, k.doc_id) AS component_id FROM k LEFT JOIN r ON k.key = r.key LEFT JOIN m ON m.id = r.rep
"""
