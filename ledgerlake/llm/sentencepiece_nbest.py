"""SentencePiece encoding and decoding with N-best segmentation.

Forward Viterbi scores over the piece lattice are exact heuristics for a backward A-star search. Between two characters
that stand side by side in no piece, no piece crosses, so the lattice of a text is a chain of independent ones
(segments). For each distinct segment the best path and its gap to the second best are computed
once. Of a text's N best paths none need differ from the best one outside the N - 1 segments with the smallest gaps;
A-star lists the N best paths of those, and the sums of the lists give the N best of the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents
from ._words import give_back, slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Segments that a worker remembers (about 300 bytes each); when it has more at the start of a slice, those seen in one slice only go.
MEMORY = 300_000
#: Characters of a segment up to which its best path is found together with those of others.
TOGETHER = 64
#: Segments whose best paths are found together.
BUNCH = 8_000
#: Bytes of text whose segments are looked up together.
SLICE = 1 << 21
#: Below the lowest piece score by so much scores a character that no piece covers; it becomes its UTF-8 bytes.
UNKNOWN = 10.0
#: Bits of the table of neighbours; pairs of characters that share an entry leave segments longer, never wrong.
PAIR_BITS = 20


def load_pieces(model_file: str = MODEL_FILE) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of every id; kind is piece, byte or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of neighbouring code points (uint32) in the table of neighbours."""
    return ((a << np.uint32(10)) + b) & np.uint32((1 << PAIR_BITS) - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def _picks(sizes: tuple[int, ...], n_best: int) -> list[tuple[int, ...]]:
    """Ranks in lists of these sizes that can be among the n_best sums."""
    return [pick for pick in itertools.product(*[range(min(n, n_best)) for n in sizes]) if sum(pick) < n_best]


def _by(places: np.ndarray) -> list[np.ndarray]:
    """Numbers of the edges by place, in order of places."""
    order = np.argsort(places, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(places[order])) + 1) if len(order) else []


class Lattice:
    """Pieces of a model and the segments worked out so far. A space stands for the model's space mark."""

    def __init__(self, pieces: list[tuple[str, float, str]], n_best: int = N_BEST):
        self.n_best = n_best
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif kind == "piece":
                text = piece.replace("▁", " ")
                self.raw.append(text.encode("utf-8"))
                self.ids[text] = (i, float(score))
            else:
                self.raw.append(b"")
        self.unknown = min((s for _, s in self.ids.values()), default=0.0) - UNKNOWN
        self.trie: dict[str, tuple[dict, float, int]] = {}
        for text in sorted(self.ids):  # a prefix comes before what it starts
            node = self.trie
            for c in text[:-1]:
                node = node.setdefault(c, ({}, 0.0, -1))[0]
            node[text[-1]] = (node.get(text[-1], ({},))[0], self.ids[text][1], self.ids[text][0])
        self._table()
        self._forget()

    def _table(self) -> None:
        """The trie as sorted keys (node, letter) with the node, piece id and score they lead to."""
        letters = sorted({c for text in self.ids for c in text})
        code, keys, to, piece, score = {c: i for i, c in enumerate(letters)}, [], [], [], []
        self.code = np.full(0x110000, -1, dtype=np.int32)  # numbers of letters by code point
        self.code[[ord(c) for c in letters]] = np.arange(len(letters))
        self.side_by_side = np.zeros(1 << PAIR_BITS, dtype=bool)
        if self.ids:
            whole = _codes("".join(self.ids))
            inner = np.ones(len(whole), dtype=bool)
            inner[np.cumsum([len(text) for text in self.ids]) - 1] = False
            self.side_by_side[_pair(whole[:-1], whole[1:])[inner[:-1]]] = True
        todo, nodes = [(self.trie, 0)], 1
        while todo:
            node, own = todo.pop()
            for c, (below, s, i) in node.items():
                keys.append(own * len(letters) + code[c])
                to.append(nodes)
                piece.append(i)
                score.append(s)
                todo.append((below, nodes))
                nodes += 1
        self.letters = len(letters)
        self.to, self.piece, self.piece_score = (np.array(x) for x in (to or [0], piece or [-1], score or [0.0]))
        # keys by hash: a key is at its own place or behind it, with no free place between
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.held = np.full((1 << (64 - int(self.shift))) + len(keys) + 1, -1, dtype=np.int64)
        self.entry = np.zeros(len(self.held), dtype=np.int64)
        left = np.arange(len(keys))
        key = np.array(keys, dtype=np.int64)
        at = self._place(key)
        while len(left):
            free = np.flatnonzero(self.held[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.held[at[first]], self.entry[at[first]] = key[left[first]], left[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, at = left[rest], at[rest] + 1

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the trie's keys, -1 for what is none."""
        at = self._place(key)
        held = self.held[at]
        out = np.where(held == key, self.entry[at], -1)
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] += 1
            held = self.held[at[on]]
            hit = held == key[on]
            out[on[hit]] = self.entry[at[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def _forget(self) -> None:
        """Start without segments. By number: score and gap to the second best path (infinite if there is none) of the
        best path, whether its pieces spell the segment, in how many slices it was, and where its ids end in `flat`."""
        self.known: dict[str, int] = {}
        self.score, self.gap, self.exact, self.uses, self.flat, self.ends = array("d"), array("d"), array("b"), array("i"), array("i"), array("q", [0])
        self.lists: dict[str, list[tuple[float, np.ndarray]]] = {}

    def _thin(self) -> None:
        """Forget the segments that were in one slice only; of the others half of MEMORY at most stay, the most used."""
        uses, ends, flat = np.array(self.uses), np.array(self.ends), np.array(self.flat)
        stay = uses > 1
        if stay.sum() > MEMORY // 2:
            stay[:] = False
            stay[np.argsort(-uses, kind="stable")[:MEMORY // 2]] = True
        self.known = dict(zip(itertools.compress(self.known, stay.tolist()), itertools.count()))
        for name in ("score", "gap", "exact"):
            old = getattr(self, name)
            setattr(self, name, array(old.typecode, np.array(old)[stay].tobytes()))
        self.uses = array("i", (uses[stay] // 2).tobytes())
        long = np.diff(ends)
        self.flat = array("i", flat[np.repeat(stay, long)].tobytes())
        self.ends = array("q", np.concatenate([[0], np.cumsum(long[stay])]).astype(np.int64).tobytes())

    def _edges(self, seg: str) -> tuple[list[tuple[int, int, float, int]], list[float], list[int]]:
        """Edges (start, end, score, id) by start, the best score before each place, and the edge that reaches it.

        Id -1 is a character spelled in bytes.
        """
        n, root, unknown = len(seg), self.trie, self.unknown
        score, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        edges: list[tuple[int, int, float, int]] = []
        for i in range(n):
            node, base = root, score[i]
            for j in range(i, n):
                hit = node.get(seg[j])
                if hit is None:
                    break
                node, s, piece = hit
                if piece >= 0:
                    if base + s > score[j + 1]:
                        score[j + 1], back[j + 1] = base + s, len(edges)
                    edges.append((i, j + 1, s, piece))
            if not edges or edges[-1][0] != i or seg[i] not in self.ids:
                if base + unknown > score[i + 1]:
                    score[i + 1], back[i + 1] = base + unknown, len(edges)
                edges.append((i, i + 1, unknown, -1))
        return edges, score, back

    def _spell(self, seg: str, path: list[tuple[int, int, float, int]]) -> list[int]:
        if all(e[3] >= 0 for e in path):
            return [e[3] for e in path]
        out: list[int] = []
        for i, j, _, piece in path:
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in seg[i:j].encode("utf-8", "surrogatepass")]
        return out

    def _learn(self, seg: str, score: float, gap: float, ids: list[int]) -> None:
        self.known[seg] = len(self.known)
        self.score.append(score)
        self.gap.append(gap)
        self.exact.append(b"".join([self.raw[i] for i in ids]) == seg.encode("utf-8", "surrogatepass"))
        self.uses.append(0)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def one_best(self, seg: str) -> None:
        """Work out a segment's best path and the gap to its second best one."""
        edges, score, back = self._edges(seg)
        n = j = len(seg)
        path = []
        while j:
            path.append(back[j])
            j = edges[back[j]][0]
        second = -np.inf
        if len(edges) > len(path):
            on_path = set(path)
            rest = [-np.inf] * n + [0.0]
            for k in range(len(edges) - 1, -1, -1):
                i, j, s, _ = edges[k]
                s += rest[j]
                if s > rest[i]:
                    rest[i] = s
                if score[i] + s > second and k not in on_path:
                    second = score[i] + s
        self._learn(seg, score[n], score[n] - second, self._spell(seg, [edges[k] for k in reversed(path)]))

    def all_best(self, segs: list[str]) -> None:
        """one_best of many segments at once, place by place; of long ones, one by one."""
        for seg in segs:
            if len(seg) > TOGETHER:
                self.one_best(seg)
        segs = [seg for seg in segs if len(seg) <= TOGETHER]
        if not segs:
            return
        size = np.fromiter(map(len, segs), np.int64, len(segs))
        head = np.concatenate([[0], np.cumsum(size + 1)])  # each segment is followed by one place more, its end
        owner = np.repeat(np.arange(len(segs), dtype=np.int16 if len(segs) < 1 << 15 else np.int64), size + 1)  # int16 is sorted by radix
        depth = (np.arange(head[-1]) - np.repeat(head[:-1], size + 1)).astype(np.int16)
        letter = self.code[_codes("\n".join([*segs, ""]))]
        inside = np.ones(len(letter), dtype=bool)
        inside[head[1:] - 1] = False
        letter[~inside] = -1

        place, node, found = np.flatnonzero(inside & (letter >= 0)), 0, []
        single = np.zeros(len(letter), dtype=bool)  # places whose character is a piece
        step = 0
        while len(place):
            at = self._find(node * self.letters + letter[place + step])
            place, at = place[on := at >= 0], at[on]
            node, whole = self.to[at], self.piece[at] >= 0
            step += 1
            found.append((place[whole], np.full(int(whole.sum()), step), self.piece_score[at[whole]], self.piece[at[whole]]))
            if step == 1:
                single[place[whole]] = True
            place, node = place[on := letter[place + step] >= 0], node[on]
        rest = np.flatnonzero(inside & ~single)
        found.append((rest, np.ones(len(rest), dtype=np.int64), np.full(len(rest), self.unknown), np.full(len(rest), -1)))
        start, long, s, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(depth[start], kind="stable")
        order = order[np.argsort(owner[start[order]], kind="stable")]
        start, s, piece = start[order], s[order], piece[order]
        end = start + long[order]
        own, begin, stop = owner[start], depth[start], depth[end]

        # edges from one place of each segment end at different places, so plain assignment will do
        score, back = np.full(len(letter), -np.inf), np.zeros(len(letter), dtype=np.int64)
        score[head[:-1]] = 0.0
        for e in _by(begin):
            new = score[start[e]] + s[e]
            e, new = e[better := new > score[end[e]]], new[better]
            score[end[e]], back[end[e]] = new, e
        rest = np.full(len(letter), -np.inf)
        rest[head[1:] - 1] = 0.0
        for e in reversed(_by(stop)):
            rest[start[e]] = np.maximum(rest[start[e]], s[e] + rest[end[e]])
        path, now = np.zeros(len(start), dtype=bool), head[1:] - 1
        while len(now := now[depth[now] > 0]):
            path[back[now]] = True
            now = start[back[now]]
        through = np.where(path, -np.inf, score[start] + s + rest[end])
        second = np.maximum.reduceat(through, np.searchsorted(own, np.arange(len(segs))))
        best = score[head[1:] - 1]
        gap = np.where(np.isfinite(second), best - second, np.inf)
        spelled = np.zeros(len(segs), dtype=bool)  # with a character in bytes; these are few
        spelled[own[path & (piece < 0)]] = True
        for i in np.flatnonzero(spelled).tolist():
            k = np.arange(np.searchsorted(own, i), np.searchsorted(own, i, "right"))
            k = k[path[k]]
            self._learn(segs[i], float(best[i]), float(gap[i]), self._spell(segs[i], list(zip(begin[k].tolist(), stop[k].tolist(), s[k].tolist(), piece[k].tolist()))))
        path &= ~spelled[own]
        segs, ids, several = [seg for seg, odd in zip(segs, spelled.tolist()) if not odd], piece[path], np.bincount(own[path], minlength=len(spelled))[~spelled]
        if not segs:
            return
        raw = [seg.encode("utf-8", "surrogatepass") for seg in segs]
        pieces = [self.raw[i] for i in ids.tolist()]
        exact = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.concatenate([[0], np.cumsum(several)[:-1]])) == np.fromiter(map(len, raw), np.int64, len(raw))
        exact &= b"".join(pieces) == b"".join(raw)
        self.known.update(zip(segs, itertools.count(len(self.known))))
        self.score.frombytes(best[~spelled].tobytes())
        self.gap.frombytes(gap[~spelled].tobytes())
        self.exact.frombytes(exact.astype(np.int8).tobytes())
        self.uses.frombytes(bytes(4 * len(segs)))
        self.ends.frombytes((np.cumsum(several) + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def n_best_paths(self, seg: str) -> list[tuple[float, np.ndarray]]:
        """The n_best paths of a segment by score: A-star from its end, guided by the forward scores.

        Of equal totals the hypothesis nearest the start is taken first, so ties do not multiply the agenda.
        """
        found = self.lists.get(seg)
        if found is None:
            edges, score, _ = self._edges(seg)
            ends: list[list[tuple[int, int, float, int]]] = [[] for _ in range(len(seg) + 1)]
            for e in edges:
                ends[e[1]].append(e)
            tick = itertools.count()
            agenda = [(-score[len(seg)], len(seg), next(tick), 0.0, None)]
            found = []
            while agenda and len(found) < self.n_best:
                _, j, _, tail, path = heapq.heappop(agenda)
                if j == 0:
                    steps = []
                    while path:
                        steps.append(path[0])
                        path = path[1]
                    found.append((tail, np.array(self._spell(seg, steps), dtype=np.int32)))
                    continue
                for e in ends[j]:
                    heapq.heappush(agenda, (-(score[e[0]] + e[2] + tail), e[0], next(tick), tail + e[2], (e, path)))
            self.lists[seg] = found
        return found

    def _split(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The segments of all texts in order, as numbers of distinct ones; the distinct ones; and how many each text has."""
        whole = [" " + t if t else "" for t in texts]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        text = "".join(whole)
        if not text:
            return np.zeros(0, np.int64), [], sizes
        code, raw = _codes(text), text.encode("utf-8", "surrogatepass")
        first = np.ones(len(code), dtype=bool)
        first[1:] = ~self.side_by_side[_pair(code[:-1], code[1:])]
        heads = np.concatenate([[0], np.cumsum(sizes)])
        first[heads[:-1][sizes > 0]] = True
        at = np.flatnonzero(first)
        many = np.diff(np.searchsorted(at, heads))
        if len(raw) > len(code):
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[at]
        off = np.append(at, len(raw)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(raw)]).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), [x.decode("utf-8", "surrogatepass") for x in coded.dictionary.to_pylist()], many

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bool, list[tuple[float, list[tuple[int, int, np.ndarray]]]]]]:
        """For each text: the best ids, whether they spell the text, and its n_best segmentations, best first, as score and
        changes (from, to, ids) of the best ids. The texts' segments are looked up together."""
        if len(self.known) > MEMORY:
            self._thin()
        if len(self.lists) > MEMORY // 10:
            self.lists = {}
        which, distinct, sizes = self._split(texts)
        at = np.concatenate([[0], np.cumsum(sizes)])
        new = [seg for seg in distinct if seg not in self.known]
        for lo in range(0, len(new), BUNCH):
            self.all_best(new[lo:lo + BUNCH])
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        if distinct:
            np.frombuffer(self.uses, np.int32)[own] += 1
        ends, score, gap, exact = (np.frombuffer(x or b"", x.typecode)[own] for x in (self.ends, self.score, self.gap, self.exact))
        long = np.frombuffer(self.ends, np.int64)[own + 1] - ends
        first = np.concatenate([[0], np.cumsum(long)])
        flat = np.frombuffer(self.flat or b"", np.int32)[np.repeat(ends - first[:-1], long) + np.arange(first[-1])]
        score, gap, exact, long, first = score[which], gap[which], exact[which], long[which], first[which]
        to = np.concatenate([[0], np.cumsum(long)])  # in the ids of all texts
        ids = flat[np.repeat(first - to[:-1], long) + np.arange(to[-1])]
        full = np.flatnonzero(sizes)
        total, same = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if len(full):
            total[full] = np.add.reduceat(score, at[full])
            same[full] = np.add.reduceat(exact.astype(np.int64), at[full]) == sizes[full]
        few = self.n_best - 1
        for t in range(len(texts)):
            # only the n_best - 1 segments with the smallest gaps can differ from the best path
            lo, hi = int(at[t]), int(at[t + 1])
            own = gap[lo:hi]
            near = np.flatnonzero(own <= np.partition(own, few - 1)[few - 1]) if 0 < few < hi - lo else np.arange(min(few, hi - lo))
            loose = [lo + i for i in near[np.argsort(own[near], kind="stable")[:few]].tolist() if own[i] < np.inf]
            lists = [self.n_best_paths(distinct[which[i]]) for i in loose]
            sums = [[-score for score, _ in l] for l in lists]
            ranks = sorted((sum([l[r] for l, r in zip(sums, pick)]), pick) for pick in _picks(tuple(map(len, lists)), self.n_best))
            base = total[t] - sum(score[i] for i in loose)
            zero = to[lo]
            ways = [(float(base - minus), [(int(to[i] - zero), int(to[i + 1] - zero), l[r][1]) for i, l, r in sorted(zip(loose, lists, pick), key=lambda x: x[0]) if r])
                    for minus, pick in ranks[:self.n_best]]
            yield ids[zero:to[hi]], bool(same[t]), ways

    def encode(self, text: str) -> list[tuple[float, np.ndarray]]:
        """The n_best segmentations of a text as (score, ids), best first; one empty one for the empty text."""
        (ids, _, ways), = self.encode_all([text])
        return [(score, changed(ids, changes)) for score, changes in ways]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; exact for the ids of encode(). Bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        try:
            text = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def changed(ids: np.ndarray, changes: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """ids with the stretches from:to replaced."""
    parts, at = [], 0
    for lo, hi, other in changes:
        parts += [ids[at:lo], other]
        at = hi
    return np.concatenate([*parts, ids[at:]]) if parts else ids


_HELD: dict[str, Lattice] = {}


def _lattice(name: str, shared, n_best: int = N_BEST) -> Lattice:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Lattice(shared.value, n_best)
    return _HELD[name]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _encode(name: str, shared, n_best: int, keep: list[str], with_ids: bool, with_ways: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(name, shared, n_best)
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            best, same, ways = map(list, zip(*lattice.encode_all(batch.column("text").to_pylist())))
            arrays = [pa.array([len(x) for x in best], pa.int64()), pa.array([w[0][0] for w in ways], pa.float64()), pa.array([[s for s, _ in w] for w in ways], pa.list_(pa.float64())),
                      pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in best], pa.string()), pa.array(same, pa.bool_())]
            names = ["sp_n_pieces", "sp_score", "sp_scores", "sp_ids_sha256", "sp_round_trip"]
            if with_ids:
                arrays.append(_lists(best))
                names.append("sp_ids")
            if with_ways:
                off = np.concatenate([[0], np.cumsum([len(w) for w in ways])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(off), _lists([changed(x, c) for x, w in zip(best, ways) for _, c in w])))
                names.append("sp_nbest_ids")
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + arrays, names=[*keep, *names])
        give_back()
    return run


def _decode(name: str, shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(name, shared)
        for batch in batches:
            texts = [None if x is None else lattice.decode(np.array(x, dtype=np.int64)) for x in batch.column("sp_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "sp_text"])
    return run


def _fields(df: DataFrame, columns: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def encode_texts(docs: DataFrame, keep: list[str] | None = None, n_best: int = N_BEST, model_file: str = MODEL_FILE, with_ids: bool = True, with_nbest_ids: bool = False) -> DataFrame:
    """keep (default doc_id) of every row with sp_n_pieces, sp_score, sp_scores (of the n_best segmentations, best
    first; fewer if there are fewer), sp_ids_sha256 (of the best one's ids as little-endian int32), sp_round_trip
    (decoding gives the text back), with_ids sp_ids, and with_nbest_ids sp_nbest_ids (ids of all n_best, best first).

    Whole texts are encoded; null is the empty text, which has one empty segmentation. A space mark in a text is
    spelled in bytes, so that decoding is exact. Ties go to the path found first, always the same. Repeated rows are
    each encoded. No shuffle; the model file is read by the driver, and its pieces, a bounded list, are broadcast.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))
    fields = _fields(docs, keep) + ["sp_n_pieces long", "sp_score double", "sp_scores array<double>", "sp_ids_sha256 string", "sp_round_trip boolean"]
    fields += ["sp_ids array<int>"] * with_ids + ["sp_nbest_ids array<array<int>>"] * with_nbest_ids
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(_encode(f"{model_file}:{n_best}", shared, n_best, keep, with_ids, with_nbest_ids), ", ".join(fields))


def decode_texts(encoded: DataFrame, keep: list[str] | None = None, model_file: str = MODEL_FILE) -> DataFrame:
    """keep (default doc_id) of every row with sp_text, the text of its ids in sp_ids; null ids have null text.

    Exact for ids of encode_texts. Control and unknown pieces are empty, bytes that are no UTF-8 become U+FFFD, and an
    id that the model lacks is an error.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_file))
    rows = encoded.select(*dict.fromkeys([*keep, "sp_ids"]))
    return rows.mapInArrow(_decode(f"{model_file}:{N_BEST}", shared, keep), ", ".join(_fields(encoded, keep) + ["sp_text string"]))


def op3_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(documents(spark, sf_dir), with_ids=False)
    return out.select("doc_id", F.col("sp_n_pieces").alias("n_pieces"), F.col("sp_score").alias("score"),
                      F.array_join(F.col("sp_scores").cast("array<string>"), ",").alias("nbest_scores"),
                      F.col("sp_ids_sha256").alias("ids_sha256"), F.col("sp_round_trip").alias("round_trip"))
