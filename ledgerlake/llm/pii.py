"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments by span features (shape, digit count, checksum, separators, neighbouring
words) and chooses boundaries and types jointly by dynamic programming over segments of at most MAX_TOKENS tokens.
It is trained here, by gradient ascent on the conditional likelihood of sequences that a seeded generator makes. It
runs on the tokens around digits, `@` and spelled-out marks; elsewhere no segment can be an entity. Spans of the
patterns are never changed; the field adds spans that touch none of them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most, and tokens of context behind and before a trigger.
MAX_TOKENS, CONTEXT, BEFORE = 20, 3, 6
#: Probability by which a segment must be an entity to be added.
SURE = 0.5
#: Characters of an entity at most, and of context before a trigger.
MAX_CHARS, MAX_BEFORE = 80, 160

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9]|@|\b(?:at|dot)\b", re.I)
#: Marks of a mail address, spelled out or not, with blanks or brackets around them.
_AT = re.compile(r"@|(?:\s|[(\[{<])\s?at\s?(?:\s|[)\]}>])", re.I)
_DOT = re.compile(r"\.|(?:\s|[(\[{<])\s?dot\s?(?:\s|[)\]}>])", re.I)


_FOUR = re.compile(r"[0-9]+(?: ?\. ?[0-9]+){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, in time linear in the text: each match holds an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _ADDRESS.match(text, start - 1):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact patterns as (kind, start, end), by start, then kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# --- the field -------------------------------------------------------------------------------------------------

def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i..j-1 as a whole."""
    s, e = tokens[i][0], tokens[j - 1][1]
    span = text[s:e]
    digits = _digits(span)
    shape = re.sub("A+", "A", re.sub("[A-Za-z]+", "A", re.sub("[0-9]+", "9", span)))[:40]
    parts = re.findall("[0-9]+", span)
    left = text[tokens[i - 1][0]:tokens[i - 1][1]].lower() if i else ""
    right = text[tokens[j][0]:tokens[j][1]].lower() if j < len(tokens) else ""
    glued = (i > 0 and tokens[i - 1][1] == s, j < len(tokens) and tokens[j][0] == e)
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9\s]", "", span))))[:6]
    out = ["bias", f"shape={shape}", f"digits={min(len(digits), 20)}", f"marks={marks}", f"first={span[0] if not span[0].isalnum() else 'w'}",
           f"left={left}", f"glued={glued}", f"groups={','.join(str(len(p)) for p in parts[:6])}", f"at={len(_AT.findall(span))},dot={min(len(_DOT.findall(span)), 3)}",
           f"before={left if left.isalpha() and digits else ''},{min(len(digits), 16)}", f"words={min(len(re.findall('[A-Za-z]+', span)), 9)},{bool(digits)},{bool(_AT.search(span))}"]
    if _AT.search(span):
        ends = re.split(r"[\s.]+", span.lower())
        out += [f"top={ends[-1] if len(ends[-1]) <= 4 else 'long'}", f"start={ends[0] if len(ends[0]) <= 3 else 'w'}", f"inner={re.search('[.!?;,] ', span) is not None}", f"user={len(re.findall('[ ]', _AT.split(span)[0]))}"]
    if len(digits) >= 12:
        out.append(f"luhn={luhn(digits)},{14 <= len(digits) <= 19}")
    if len(parts) == 4:
        out.append(f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)},{marks}")
    if right in ("%", "eur", "usd", "km", "kg"):
        out.append("unit")
    return out


def _may_be_entity(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> bool:
    """Bounds of the search: a segment without a line break or a gap of two spaces, with digits or a mail mark."""
    s, e = tokens[i][0], tokens[j - 1][1]
    span = text[s:e]
    if "\n" in span or "  " in span or len(span) > MAX_CHARS or not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        return False
    return len(_digits(span)) >= 7 or _FOUR.fullmatch(span) is not None or bool(span[0].isalnum() and _AT.search(span) and _DOT.search(span))


def _segments(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    return {(i, j): _features(text, tokens, i, j) for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1)
            if _may_be_entity(text, tokens, i, j)}


class SemiCrf:
    """Weights of span features by kind; outside tokens score 0."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def _scores(self, segs: dict[tuple[int, int], list[str]]) -> dict[tuple[int, int], list[float]]:
        zero = [0.0] * len(KINDS)
        return {k: [sum(col) for col in zip(*[self.weights.get(f, zero) for f in fs])] for k, fs in segs.items()}

    @staticmethod
    def _sums(n: int, scores: dict[tuple[int, int], list[float]]) -> tuple[list[float], list[float]]:
        """Log sums over all segmentations of tokens before and from each place."""
        into: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
        for (i, j), s in scores.items():
            into[j].append((i, s))
        fore = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [fore[j - 1]] + [fore[i] + x for i, s in into[j] for x in s]
            top = max(terms)
            fore[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        outof: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
        for (i, j), s in scores.items():
            outof[i].append((j, s))
        rear = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            terms = [rear[i + 1]] + [rear[j] + x for j, s in outof[i] for x in s]
            top = max(terms)
            rear[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        return fore, rear

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 8, rate: float = 0.5) -> SemiCrf:
        """Stochastic gradient ascent on the conditional log-likelihood, with a small pull to 0."""
        prepared = []
        pieces = [(text[s:e], [(k, a - s, b - s) for k, a, b in gold if s <= a and b <= e]) for text, gold in examples for s, e in windows(text, [])]
        for text, gold in pieces:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            want = {(s, e): KINDS.index(k) for k, s, e in gold}
            segs = _segments(text, tokens)
            prepared.append((len(tokens), segs, {ij: want[(tokens[ij[0]][0], tokens[ij[1] - 1][1])] for ij in segs if (tokens[ij[0]][0], tokens[ij[1] - 1][1]) in want}))
        rng = random.Random(5)
        for r in range(rounds):
            rng.shuffle(prepared)
            step = rate / (1 + r)
            for n, segs, gold in prepared:
                if not segs:
                    continue
                scores = self._scores(segs)
                fore, rear = self._sums(n, scores)
                for (i, j), fs in segs.items():
                    for k, x in enumerate(scores[(i, j)]):
                        g = (gold.get((i, j)) == k) - math.exp(min(0.0, fore[i] + x + rear[j] - fore[n]))
                        if abs(g) > 1e-3:
                            for f in fs:
                                w = self.weights.setdefault(f, [0.0] * len(KINDS))
                                w[k] += step * (g - 0.0005 * w[k])
        return self

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """Entities of the best segmentation whose marginal probability is SURE or more."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segs = _segments(text, tokens)
        if not segs:
            return []
        scores, n = self._scores(segs), len(tokens)
        into: list[list[tuple[int, list[float]]]] = [[] for _ in range(n + 1)]
        for (i, j), s in scores.items():
            into[j].append((i, s))
        best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], (j - 1, -1)
            for i, s in into[j]:
                for k, x in enumerate(s):
                    if best[i] + x > best[j]:
                        best[j], back[j] = best[i] + x, (i, k)
        found, j = [], n
        while j:
            i, k = back[j]
            if k >= 0:
                found.append((i, j, k))
            j = i
        if not found:
            return []
        fore, rear = self._sums(n, scores)
        return [(KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k in found[::-1] if math.exp(fore[i] + scores[(i, j)][k] + rear[j] - fore[n]) >= SURE]


def training_examples(count: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with entities in usual and disguised forms, and with numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "on", "the", "st", "in", "re", "lo", "ma", "qui", "en", "de"]) for _ in range(rng.randint(1, 3)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(ok: bool) -> str:
        body = rng.choice("3456") + num(14)
        last = next(c for c in "0123456789" if luhn(body + c) == ok)
        d = body + last
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str | None, str]:
        user, host, top = word() + rng.choice(["", num(2), "." + word()]), word() + rng.choice(["", num(1)]), rng.choice(["com", "org", "net", "de"])
        at_, dot_ = rng.choice([" at ", " AT ", "(at)", "[at]", " (at) ", " [at] ", " [AT] ", "{at}"]), rng.choice([" dot ", " DOT ", "(dot)", "[dot]", " (dot) ", " [dot] "])
        gap = rng.choice([" ", "-", " ", "/"])
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([
            ("email", f"{user}@{host}.{top}"), ("email", f"{user}{at_}{host}{dot_}{top}"), ("email", f"{user}{at_}{host}{dot_}{top}"), ("email", f"{user}{at_}{host}.{top}"), ("email", f"{user} @ {host}.{top}"),
            ("phone", f"0{num(rng.randint(2, 4))}{gap}{num(3)}{gap}{num(2)}{gap}{num(2)}"), ("phone", f"0{num(rng.randint(2, 4))}{rng.choice(' /-')}{num(rng.randint(6, 8))}"), ("phone", f"(0{num(rng.randint(1, 3))}) {num(rng.randint(3, 4))}{gap}{num(4)}"),
            ("phone", f"00{rng.randint(11, 99)} {num(3)} {num(rng.randint(6, 7))}"), (None, f"{word()} {rng.choice(['at', 'AT'])} {word()} {word()}. {word().capitalize()}"), (None, f"{word()}. {word()} at {word()} {num(2)}.{num(2)}"),
            (None, f"{word()} at the dot on the {word()}"), (None, f"{num(1)}.{num(1)}.{num(1)} at {word()} {num(8)}"), ("email", f"{user}{at_}{host}{dot_}{top}"), ("ip", " . ".join(str(rng.randint(0, 99)) for _ in range(4))),
            (None, f"{num(1)} {num(3)} {num(3)}"), (None, f"{num(4)}-{num(4)}"), (None, f"{rng.choice(['isbn', 'no.', 'id'])} {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}"), (None, f"{num(3)} {num(3)} {num(3)} {num(3)}"),
            ("ip", ".".join(octets)), ("ip", " . ".join(octets)), ("card", card(True)), ("card", card(True)),
            ("phone", f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}"), ("phone", f"({num(3)}) {num(3)}-{num(4)}"), ("phone", f"{num(3)}-{num(3)}-{num(4)}"),
            (None, card(False)), (None, card(False)), (None, num(rng.randint(7, 20))), (None, f"{rng.randint(1990, 2030)}-{num(2)}-{num(2)}"),
            (None, "".join(rng.choice("0123456789abcdef") for _ in range(40))), (None, f"{num(1)}.{num(1)}.{num(2)}"),
            (None, f"{word()} at {word()}. {word()}"), (None, f"{num(3)},{num(3)},{num(3)}"), (None, f"{num(2)}:{num(2)}:{num(2)} {num(4)}"), (None, f"{num(4)} {num(4)}"),
            (None, ".".join(str(rng.randint(256, 999)) for _ in range(4)))])

    out = []
    for _ in range(count):
        text, gold = "", []
        for _ in range(rng.randint(1, 2)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            kind, s = entity()
            if kind:
                gold.append((kind, len(text), len(text) + len(s)))
            text += s + rng.choice(["", ".", ","]) + " " + rng.choice(["", "", "is mine ", "or "])
        out.append((text + " ".join(word() for _ in range(rng.randint(1, 3))), gold))
    return out


_TRAINED: list[SemiCrf] = []


def trained() -> SemiCrf:
    if not _TRAINED:
        _TRAINED.append(SemiCrf().fit(training_examples()))
    return _TRAINED[0]


def windows(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of one line around triggers outside base spans; a stretch never touches a base span."""
    busy = [(s, e) for _, s, e in sorted(base, key=lambda x: x[1])]
    done = b = 0
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if at < done:
            continue
        while b < len(busy) and busy[b][1] <= at:
            b += 1
        if b < len(busy) and busy[b][0] <= at:
            done = busy[b][1]
            continue
        floor = max(done, busy[b - 1][1] if b else 0, text.rfind("\n", 0, at) + 1, at - MAX_BEFORE)
        ceiling = text.find("\n", at)
        ceiling = min(len(text) if ceiling < 0 else ceiling, busy[b][0] if b < len(busy) else len(text))
        before = [x.start() for x in _TOKEN.finditer(text, floor, at)][-BEFORE:]
        start, end, last = (before[0] if before else at), at, 0
        for x in _TOKEN.finditer(text, at, ceiling):
            end = x.end()
            last = 0 if _TRIGGER.search(x.group()) else last + 1
            if last > CONTEXT:
                break
        yield start, end
        done = max(end, at + 1)


def find_spans(text: str, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    more = []
    for s, e in windows(text, base):
        piece = text[s:e]
        # no entity without seven digits, four groups of them with dots between, or the marks of a mail address
        if len(_digits(piece)) >= 7 or _FOUR.search(piece) or _AT.search(piece) and _DOT.search(piece):
            more += [(k, s + a, s + b) for k, a, b in model.decode(piece)]
    taken = [x for x in more if not any(x[1] < e and s < x[2] for _, s, e in base)]
    return base, sorted(base + taken, key=lambda x: (x[1], KINDS.index(x[0])))


def _show(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(shared.value)
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                b, a = find_spans(text, model) if text else ([], [])
                base.append(b)
                spans.append(a)
            counts = [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in KINDS]
            as_rows = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + counts + [pa.array([hashlib.sha256(_show(b).encode()).hexdigest() for b in base]), pa.array([_show(x) for x in spans]), pa.array(as_rows, kind)],
                names=[*keep, *[f"pii_n_{k}" for k in KINDS], "pii_base_sha256", "pii_spans_text", "pii_spans"])
    return run


def find_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Personal data in whole texts, in one pass without a shuffle.

    keep (default doc_id) of every row with pii_n_email, pii_n_ip, pii_n_card and pii_n_phone (spans of the exact
    patterns), pii_base_sha256, pii_spans (all spans as structs; code points, end exclusive) and pii_spans_text.
    Null and empty texts have none. Repeated rows are each searched.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(trained().weights)  # features of a fixed training set
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    fields += [f"pii_n_{k} long" for k in KINDS] + ["pii_base_sha256 string", "pii_spans_text string", "pii_spans array<struct<kind:string,start:long,end:long>>"]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scan(shared, keep), ", ".join(fields))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(documents(spark, sf_dir))
    return out.select("doc_id", *[F.col(f"pii_n_{k}").alias(f"n_{k}") for k in KINDS], F.col("pii_base_sha256").alias("base_sha256"), F.col("pii_spans_text").alias("spans"))
