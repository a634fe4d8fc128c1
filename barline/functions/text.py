"""Identifiers, times, lists, paths and JSON keys of messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normalised names that no transported key or query parameter may have.
FORBIDDEN_KEYS = (
    "api_key", "access_token", "secret_key", "private_key", "seed_phrase",
    "personal_data", "large_log", "raw_venue_payload",
)
#: Patterns of secrets in free text.
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
SECRET_NAMES = ("api[_-]?key", "access[_-]?token", "secret[_-]?key", "private[_-]?key", "seed[_-]?phrase")
URI_SCHEMES = ("file", "https", "git")


def secret_pattern(names: tuple[str, ...] = SECRET_NAMES) -> str:
    """Pattern of `name = value` for the given names."""
    return rf"(?im)\b(?:{'|'.join(names)})\s*[:=]\s*[^<\s][^\s]*"


def has_secret(text: Column, names: tuple[str, ...] = SECRET_NAMES) -> Column:
    return text.rlike(PRIVATE_KEY) | text.rlike(secret_pattern(names))


def is_canonical_uuid(text: Column, nullable: bool = False) -> Column:
    ok = F.coalesce(text.rlike(r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lit(False))
    return ok | text.isNull() if nullable else ok


def is_utc_z(text: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS[.ffffff]Z and a real date (the pattern is a fixed value)."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z\z")
    return F.coalesce(shape & F.when(shape, text.try_cast("timestamp")).isNotNull(), F.lit(False))


def length_between(text: Column, least: int, most: int) -> Column:
    return F.coalesce(F.char_length(text).between(least, most), F.lit(False))


def list_ok(items: Column, most: int = 200, longest: int = 4096) -> Column:
    """At most `most` strings, each of 1 to `longest` characters."""
    return F.coalesce((F.size(items) <= most) & F.forall(items, lambda x: length_between(x, 1, longest)), F.lit(False))


def normalize_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_path(path: Column) -> Column:
    """Trimmed, with forward slashes and none at the end; null for empty, absolute or dotted paths."""
    clean = F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+$", "")
    bad = (clean == "") | F.translate(F.trim(path), "\\", "/").startswith("/") | clean.rlike("^[A-Za-z]:") | F.exists(F.split(clean, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(~bad, clean)


def normalize_paths(paths: Column) -> Column:
    """Distinct normalised paths in order; null where one is refused."""
    return F.array_sort(F.array_distinct(F.transform(paths, normalize_path)))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for invalid text and repeated keys. Numbers that are
    equal (1 and 1.0) have one form."""
    return F.to_json(F.try_parse_json(text))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based (SHA-1) UUID, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda start, n: F.substr(digest, F.lit(start), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def result_id(task_id: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL, prefix: str = "task-result:") -> Column:
    """The id of a task's result: the same for every answer to one task."""
    return uuid5(namespace, F.concat(F.lit(prefix), task_id))


def query_keys(uri: Column) -> Column:
    """Normalised names of the query parameters."""
    query = F.coalesce(F.try_parse_url(uri, F.lit("QUERY")), F.lit(""))
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: normalize_key(F.split(p, "=")[0]))


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def uri_fault(uri: Column, schemes: tuple[str, ...] = URI_SCHEMES) -> Column:
    """'uri_scheme', 'uri_parameter' or null."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(~F.coalesce(scheme.isin(*schemes), F.lit(False)), "uri_scheme").when(F.exists(query_keys(uri), lambda k: k.isin(*FORBIDDEN_KEYS)), "uri_parameter")


def lease_until(now: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) + seconds.cast("long") * 1_000_000)


def lease_expired(lease: Column, now: Column) -> Column:
    return lease.isNull() | (lease <= now)
