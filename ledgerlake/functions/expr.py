"""Scalar functions as Spark expressions; no Python at run time."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import STRENGTHS, TRACKING_KEYS, TRACKING_PREFIX


def non_empty(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def json_text(c: Column) -> Column:
    """A string as JSON text, non-ASCII characters kept."""
    wrapped = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))
    return F.when(c.isNull(), "null").otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def json_object(**parts: Column) -> Column:
    """Canonical JSON of a flat object of JSON texts: sorted keys, no blanks."""
    items = [F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def json_map(m: Column) -> Column:
    """Canonical JSON of a map of strings."""
    entries = F.array_sort(F.map_entries(m))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(e["value"]))), ","), F.lit("}"))


def json_raw_map(m: Column) -> Column:
    """Canonical JSON of a map whose values are JSON texts."""
    entries = F.array_sort(F.map_entries(m))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def canonical_json(value: object) -> str:
    """Canonical JSON of a value on the driver: sorted keys, no blanks, non-ASCII characters kept."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def utc_now() -> Column:
    """The time of the query in UTC to the second, as text; pass a time of your own where results must repeat."""
    return F.date_format(F.to_utc_timestamp(F.date_trunc("second", F.current_timestamp()), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def row_uuid(given: Column) -> Column:
    """The id given, or a random one where there is none."""
    return F.coalesce(non_empty(given), F.uuid())


def is_number(text: Column) -> Column:
    """Whether a JSON text is a number; true and false aren't."""
    return F.coalesce(F.regexp_like(text, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")), F.lit(False))


def stable_id(prefix: str, canonical: Column) -> Column:
    """PREFIX- and the first 24 hex digits of the SHA-256 of a canonical text."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(canonical, 256), 1, 24))


def hash_shard(key: Column, shards: int) -> Column:
    """The SHA-256 of key as a 256-bit integer, modulo shards (below 2^31)."""
    digest = F.sha2(key, 256)
    word = lambda i: F.conv(F.substring(digest, i, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(57), F.lit(8)), F.lit(0).cast("long"), lambda a, i: F.pmod(a * F.lit(4294967296) + word(i), F.lit(shards).cast("long")))


def shard_name(template: Column, shard: Column) -> Column:
    return F.format_string("%s:shard-%03d", template, shard)


def quote_plus(c: Column) -> Column:
    """Query encoding: blanks as +, and letters, digits, _ . - ~ as they are."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _unquote_plus(c: Column) -> Column:
    """url_decode, but a % that starts no escape stays."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(url: Column) -> Column:
    """A locator in canonical form.

    Trimmed; lower-case scheme and host; default port, fragment and tracking parameters dropped; the query decoded,
    sorted by name and value and encoded again, blank values kept; an empty path is /. What is no absolute http or
    other scheme://host URL stays as it is, trimmed. A URL with credentials is an error. IPv6 hosts keep brackets.
    """
    u = F.trim(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    g = lambda i: F.regexp_extract(u, pattern, i)
    scheme, authority, path, query = F.lower(g(1)), g(2), g(3), g(4)
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    port = F.regexp_extract(authority, r":0*([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(_unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
                                                  F.when(F.instr(p, "=") > 0, _unquote_plus(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX))))
    encoded = F.array_join(F.transform(pairs, lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
                   F.when(path == "", "/").otherwise(path), F.when(encoded == "", "").otherwise(F.concat(F.lit("?"), encoded)))
    absolute = F.regexp_like(u, F.lit(pattern)) & (authority != "")
    return F.when(~absolute, u).when(F.instr(authority, "@") > 0, F.raise_error(F.lit("locator with embedded credentials")).cast("string")).otherwise(out)


def version_of(text: object) -> tuple[int, ...]:
    """major.minor.patch of a contract on the driver; empty, so below any version, if malformed."""
    return tuple(map(int, text.split("."))) if isinstance(text, str) and re.fullmatch(r"[0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9}", text) else ()


def version_at_least(version: Column, least: tuple[int, int, int]) -> Column:
    """major.minor.patch compared as integers; a malformed version is false."""
    ok = F.regexp_like(F.coalesce(version, F.lit("")), F.lit(r"^[0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9}$"))
    part = lambda i: F.try_element_at(F.split(version, r"\."), F.lit(i)).try_cast("int")
    return F.when(ok, F.struct(part(1), part(2), part(3)) >= F.struct(*[F.lit(x) for x in least])).otherwise(False)


def instant(text: Column) -> Column:
    """ISO-8601 text as a UTC instant; without an offset it is UTC; null if it can't be read."""
    return text.try_cast("timestamp")


def strength_rank(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STRENGTHS) for x in (s, i)]), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Ties to even."""
    return F.bround(c, digits)


def safe_suffix(name: Column) -> Column:
    """Lower-case file suffix of letters and digits, 12 characters at most with its dot; else .bin."""
    return F.coalesce(non_empty(F.lower(F.regexp_extract(name, r"[^/.](\.[A-Za-z0-9]{1,11})$", 1))), F.lit(".bin"))


def contained_path(path: Column) -> Column:
    return ~F.startswith(path, F.lit("/")) & ~F.regexp_like(path, F.lit(r"(^|/)\.\.(/|$)"))


MEDIA_TYPES = {".html": "text/html", ".htm": "text/html", ".json": "application/json", ".txt": "text/plain", ".csv": "text/csv", ".xml": "text/xml",
               ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".zip": "application/zip"}


def media_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))
