"""Text, URL, date and number functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ROOM_ID = r"^[a-z]{3}-[a-z]{4}-[a-z]{3}$"
LABEL = 10


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def lower_strip(s: Column) -> Column:
    return strip(F.lower(s))


def has_upper(s: Column) -> Column:
    return s != F.lower(s)


def slugify(s: Column) -> Column:
    """ASCII letters, digits and underscores in small letters, hyphens between; accents are taken off first."""
    return _slugify(s)


@F.pandas_udf(StringType())
def _slugify(s: pd.Series) -> pd.Series:
    plain = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())
    kept = plain.str.lower().str.replace(r"[^\w\s-]", "", regex=True)
    return kept.str.replace(r"[-\s]+", "-", regex=True).str.strip("-_")


@cache
def _accented() -> tuple[str, str]:
    """All letters that decompose into a small ASCII letter and accents, and those letters."""
    parts = {chr(k): unicodedata.normalize("NFD", chr(k)) for k in range(0x80, 0x2200)}
    kept = {x: p[0] for x, p in parts.items() if "a" <= p[0] <= "z" and all("\u0300" <= m <= "\u036f" for m in p[1:])}
    return "".join(kept), "".join(kept.values())


def slugify_simple(s: Column) -> Column:
    """As a browser does it: small letters, accents off, trimmed, other characters dropped, spaces to hyphens, runs as one."""
    plain = F.regexp_replace(F.translate(F.lower(s), *_accented()), "[\u0300-\u036f]", "")
    kept = F.regexp_replace(strip(plain), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")


def is_uuid(s: Column) -> Column:
    return F.rlike(F.lower(s), F.lit(UUID))


def capitalize_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def zero_pad(s: Column, n: int) -> Column:
    """Zeros in front up to n characters; longer strings stay whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def replace_all(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def redact_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_suffix(url: Column) -> Column:
    """The suffix of a URL's path in small letters, with its dot; '' without one."""
    return F.lower(F.regexp_extract(url_path(url), r"[^./](\.[^./]+)$", 1))


def unquote(s: Column) -> Column:
    """Percent codes decoded, plus signs kept."""
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def quote(s: Column) -> Column:
    """Percent codes for all but letters, digits, _.-~ and slashes."""
    coded = F.url_encode(s)
    for code, char in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return coded


def known_language(language: Column, known: list[str], default: str) -> Column:
    """The language, or what stands before its hyphen, if known; else the default."""
    base = base_language(language)
    return F.when(F.lower(language).isin(*known), F.lower(language)).when(base.isin(*known), base).otherwise(default)


def base_language(language: Column) -> Column:
    return F.lower(F.split_part(language, F.lit("-"), F.lit(1)))


def local_time(at: Column, zone: str, form: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), form)


def from_nanoseconds(ns: Column) -> Column:
    """A timestamp; 0 and null have none."""
    return F.when(ns != 0, F.timestamp_micros(F.floor(ns / 1000).cast("long")))


def remaining_seconds(until: Column, now: Column) -> Column:
    """Whole seconds, cut towards zero, of two epoch milliseconds."""
    return ((until - now) / 1000).cast("long")


def round_half_even(x: Column, digits: int = 2) -> Column:
    return F.bround(x, digits)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex of HMAC-SHA256, from two digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(k ^ b for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def typed(s: Column) -> Column:
    """What a string holds: int, float or string."""
    return F.when(F.rlike(s, F.lit(r"^\s*[+-]?\d+\s*$")), "int").when(s.try_cast("double").isNotNull() & ~F.rlike(s, F.lit("[dDfF]\\s*$")), "float").otherwise("string")


def email_domain(s: Column) -> Column:
    return F.substring_index(s, "@", -1)


def short_label(s: Column, n: int = LABEL) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("."))).otherwise(s)


def strip_mime(s: Column) -> Column:
    return F.regexp_replace(s, "^(audio|video)/", "")


def join_trimmed(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, strip), lambda t: t != ""), " ")


def hyphenate_room(s: Column) -> Column:
    return F.concat_ws("-", F.substring(s, 1, 3), F.substring(s, 4, 4), F.substring(s, 8, 3))


def room_slug(seed: Column) -> Column:
    """Letters xxx-xxxx-xxx that follow from a seed."""
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.char(F.pmod(F.xxhash64(seed, k), F.lit(26)) + 97)), "")
    return hyphenate_room(letters)


def group_pin(s: Column) -> Column:
    """The first run of ten digits as ddd ddd dddd, and a # behind; '' stays."""
    return F.when(s == "", s).otherwise(F.concat(F.regexp_replace(s, r"^(.*?)(\d{3})(\d{3})(\d{4})", "$1$2 $3 $4"), F.lit("#")))


def date_or_invalid(s: Column, form: str) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(s), form), F.lit("Invalid Date"))


def is_room_id(s: Column, origin: str) -> Column:
    """A room id, or one below the own origin."""
    return F.rlike(s, F.lit(ROOM_ID)) | (F.startswith(s, F.lit(origin + "/")) & F.rlike(F.substring(s, F.lit(len(origin) + 2), F.length(s)), F.lit(ROOM_ID)))


def phone(s: Column, country: str = "33") -> Column:
    """A national number of ten digits in international form; null if it isn't one."""
    digits = F.regexp_replace(s, r"[^0-9+]", "")
    return F.when(F.rlike(digits, F.lit(r"^0[1-9]\d{8}$")), F.concat(F.lit(f"+{country}"), F.substring(digits, 2, 9))).when(F.rlike(digits, F.lit(r"^\+[1-9]\d{7,14}$")), digits)
