"""Main text of web pages: nearest-URL page differencing, with markup zones as a prior.

Each page is cut into lines, its blocks of text. Lines inside menus, headers, footers, sidebars, notices, adverts,
forms and reader comments are marked as such by their markup and go. The other lines of every page are aligned with
those of the page with the nearest URL path on the same host by a longest common subsequence, and the shared ones, the
site's own, are deleted. Two pages may share an article, so a shared line inside an article or main element goes only
if it recurs on half of the host's pages, and a page that its neighbour repeats whole is left as it is.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise

# HTML element names.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe svg".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
             "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_DROP = set("nav header footer aside form head button select dialog menu object".split())
#: Words of class, id and role values that mark what isn't the article.
_DROP_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu nav "
                  "navbar navigation newsletter notice notices popup promo promoted promotion related share sharing sidebar sidebars signup social sponsor sponsored "
                  "subscribe toolbar widget alert modal complementary contentinfo search".split())
_MAIN_WORDS = {"article", "main", "post", "entry"}
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|/[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile("[\x20\x09-\x0d]+")
#: Zones of a block; GONE_BY_NAME came from a class, id or role alone, and the first article inside undoes it.
PLAIN, MAIN, GONE, GONE_BY_NAME = 0, 1, 2, 3
#: A shared line of an article is the site's own if it is on this share of the host's pages, and on this many.
SITE_SHARE, SITE_PAGES = 0.5, 4
#: Lines of one page times lines of the other up to which an alignment keeps a row of bits for each line.
LCS_CELLS = 1 << 26


def _zone(tag: str, attrs: str, above: int, depth: int, seen_main: bool) -> int:
    if above == GONE or tag in _DROP:
        return GONE
    if above == GONE_BY_NAME and (seen_main or tag not in ("article", "main")):
        return GONE_BY_NAME
    if tag in ("article", "main"):
        zone = MAIN
    else:
        zone = above
    if attrs and depth > 2:
        for name, value in _ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id", "role"):
                words = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
                if _DROP_WORDS.intersection(words) and tag not in ("article", "main", "body"):
                    return GONE_BY_NAME
                if name == "role" and words == ["main"] or name != "role" and value.strip("\"'").lower() in _MAIN_WORDS:
                    zone = MAIN
            elif name == "aria-hidden" and "true" in value.lower() or name == "style" and re.search(r"display\s*:\s*none", value):
                return GONE
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs):
        return GONE
    return zone


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of every block that isn't dropped by its markup, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, buf, at, seen_main = PLAIN, [], 0, False

    def flush() -> None:
        nonlocal seen_main
        if buf:
            seen_main |= zone == MAIN
            text = _SPACE.sub(" ", html.unescape("".join(buf))).strip("\x20\t\n\x0b\x0c\r")
            if text:
                out.append((zone, text))
            buf.clear()

    n = len(page)
    while True:
        m = _TAG.search(page, at)
        if zone < GONE:
            buf.append(page[at:m.start() if m else n])
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(4) != ">":  # cut off inside a tag
            break
        if m.group(1):
            if tag in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if zone != (up := stack[k - 1][1] if k else PLAIN):
                        flush()
                    del stack[k:]
                    zone = up
                    break
            continue
        if tag in _RAW:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 or n if end else n
            continue
        if tag == "br":
            if zone < GONE:
                buf.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            shut = "p" if tag != "li" else "li"
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph or list item ends here
                if stack[k][0] == shut:
                    del stack[k:]
                    zone = stack[-1][1] if stack else PLAIN
                    break
                if stack[k][0] in _BLOCK and stack[k][0] != "p":
                    break
        if tag in _VOID or m.group(3).endswith("/") and tag not in _BLOCK:
            continue
        below = _zone(tag, m.group(3), zone, len(stack) + 1, seen_main)
        if below != zone:
            flush()
        stack.append((tag, below))
        zone = below
    flush()
    return out


def _places(b: list) -> dict:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    return where


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of a with b[:j] for every j."""
    where, full = _places(b), (1 << len(b)) - 1
    v = full
    for x in a:
        hit = v & where.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list, b: list, cells: int = LCS_CELLS) -> set[int]:
    """Places of a that a longest common subsequence with b matches; bit-parallel, one row of len(b) bits per line.

    Where that would be more than `cells` bits, a is halved and b is cut where the halves match most (Hirschberg 1975).
    """
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            found.add(a1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > cells and a1 - a0 > 1:
            mid = (a0 + a1) // 2
            cut = b0 + int(np.argmax(_lengths(a[a0:mid], b[b0:b1]) + _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]))
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        where, full = _places(b[b0:b1]), (1 << (b1 - b0)) - 1
        rows, v = [], full
        for x in a[a0:a1]:
            hit = v & where.get(x, 0)
            v = ((v + hit) | (v - hit)) & full
            rows.append(v)
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if i == 0 or rows[i - 1] >> (j - 1) & 1:
                    found.add(a0 + i)
                    j -= 1
    return found


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), (parts.path.rstrip("/") or "/")
    except ValueError:
        return "", url or ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500)
            found = [blocks(page) if page else [] for page in batch.column("html").to_pylist()]
            hosts, paths = zip(*map(_address, batch.column("url").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array([[z == MAIN for z, _ in f] for f in found], pa.list_(pa.bool_())), pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))],
                names=["page_id", "url", "host", "path", "main", "lines"])


_LINKS = "rid long, host string, path string, part int, first boolean, last boolean, before_rid long, before_path string, after_rid long, after_path string, mate long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by host and path; each gets the rows before and after it in its partition."""
    schema = pa.schema([("rid", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()),
                        ("before_rid", pa.int64()), ("before_path", pa.string()), ("after_rid", pa.int64()), ("after_path", pa.string()), ("mate", pa.int64())])
    before = now = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now:
                out.append(_linked(now, before, r))
            before, now = now, r
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if now:
        yield pa.RecordBatch.from_pylist([_linked(now, before, None)], schema=schema)


def _linked(now: dict, before: dict | None, after: dict | None) -> dict:
    same = lambda x: x if x and x["host"] == now["host"] else {"rid": None, "path": None}
    b, a = same(before), same(after)
    out = now | {"first": before is None, "last": after is None, "before_rid": b["rid"], "before_path": b["path"], "after_rid": a["rid"], "after_path": a["path"]}
    return out | {"mate": _mate(out)}


def _mate(r: dict) -> int | None:
    if r["before_rid"] is None or r["after_rid"] is None:
        return r["after_rid"] if r["before_rid"] is None else r["before_rid"]
    shared = lambda other: len(os.path.commonprefix([r["path"], other]))
    return r["after_rid"] if shared(r["after_path"]) > shared(r["before_path"]) else r["before_rid"]


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(rid, mate): for every row of pages (rid, host, path) the row of the same host whose path is next to it in
    order and shares the longer prefix with it; the one before on ties; none if the host has one page.

    Sorted by range, so a host that holds a third of all rows is dealt over many tasks. The outermost rows of each
    range, two per partition, are linked with each other on the driver.
    """
    spark = pages.sparkSession
    order = ["host", "path", "rid"]
    ranged = pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    links = materialise(ranged.select("rid", "host", "path", "part").mapInArrow(_neighbours, _LINKS), "links")
    edge = sorted((r.asDict() for r in links.where("first or last").collect()), key=lambda r: r["part"])
    ends: dict[int, dict] = {}
    for r in edge:
        ends.setdefault(r["part"], {}).update({k: r for k in ("first", "last") if r[k]})
    parts = sorted(ends)
    for left, right in zip(parts, parts[1:]):
        a, b = ends[left]["last"], ends[right]["first"]
        if a["host"] == b["host"]:
            a["after_rid"], a["after_path"], b["before_rid"], b["before_path"] = b["rid"], b["path"], a["rid"], a["path"]
    mended = spark.createDataFrame([(r["rid"], _mate(r)) for r in edge], "rid long, mate long")
    return links.where("not first and not last").select("rid", "mate").union(mended)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, at): places of the lines that a page shares with its mate, of pages that share some but aren't copies."""
    for batch in batches:
        rids, found = [], []
        for rid, main, lines, other in zip(*(batch.column(c).to_pylist() for c in ("rid", "main", "hashes", "mate_hashes"))):
            gone = shared_lines(lines, other)
            if gone and (any(main) or len(gone) < len(lines)):
                rids.append(rid)
                found.append(sorted(gone))
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["rid", "at"])


def extract_text(pages: DataFrame, site_share: float = SITE_SHARE, site_pages: int = SITE_PAGES) -> DataFrame:
    """page_id, url and the main text of every row of pages (page_id, url, html; other columns are ignored).

    Character references are decoded, ASCII white space inside a block becomes one space, blocks are trimmed and
    joined by a newline; a br is white space. Null or empty html, and a page without text, give the empty text. A
    null or malformed url makes a page of the host ''. Repeated rows are pages of their own. Of a page with an article
    or main element, lines outside of it go. Lines that the nearest page shares go: outside of articles always, but for
    a page that is shared whole; inside only those on site_share of the host's pages and on site_pages of them at
    least. Lines are compared by 64-bit hashes.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = rows.mapInArrow(_parse, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, path string, main array<boolean>, lines array<string>")
    parsed = materialise(parsed.withColumn("rid", F.monotonically_increasing_id()), "parsed")
    mates = nearest_pages(parsed.select("rid", "host", "path")).where("mate is not null")
    hashed = parsed.select("rid", "host", "main", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"))
    other = hashed.select(F.col("rid").alias("mate"), F.col("hashes").alias("mate_hashes"))
    shared = hashed.join(mates, "rid").join(other, "mate").select("rid", "main", "hashes", "mate_hashes").mapInArrow(_align, "rid long, at array<int>")
    shared = materialise(shared, "shared")

    # The lines on so large a share of a host's pages are at most a few times as many as a page has.
    line = F.explode(F.array_distinct(F.filter("hashes", lambda x, i: F.get("main", i)))).alias("line")
    counts = hashed.select("host", line).groupBy("host", "line").agg(F.count("*").alias("on")).where(F.col("on") >= site_pages)
    site = counts.join(hashed.groupBy("host").agg(F.count("*").alias("all")), "host").where(F.col("on") >= site_share * F.col("all")).select("host", "line")
    at = shared.join(hashed, "rid").select("rid", "host", "main", "hashes", F.explode("at").alias("at"))
    at = at.select("rid", "host", "at", F.get("main", F.col("at")).alias("inside"), F.get("hashes", F.col("at")).alias("line"))
    inside = at.where("inside").join(site, ["host", "line"], "left_semi").select("rid", "at")
    gone = at.where("not inside").select("rid", "at").union(inside).groupBy("rid").agg(F.collect_list("at").alias("gone"))
    gone = materialise(gone, "gone")
    discard(shared)

    decided = parsed.join(gone, "rid", "left")
    has_main = F.exists("main", lambda x: x)
    stays = lambda x, i: (F.get("main", i) | ~has_main) & ~F.coalesce(F.array_contains("gone", i), F.lit(False))
    return decided.select("page_id", "url", F.array_join(F.filter("lines", stays), "\n").alias("text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
