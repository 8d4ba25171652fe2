"""Derived fields and predicates of meeting entities as column expressions."""

from __future__ import annotations

import hashlib
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERIC_TYPES = ("application/octet-stream", "binary/octet-stream", "")


def storage_key(folder: str, id_: Column, mode: Column) -> Column:
    return F.concat(F.lit(f"{folder}/"), id_.cast("string"), F.lit("."), F.when(mode == "transcript", "ogg").otherwise("mp4"))


def extension(filename: Column) -> Column:
    """What follows the last dot of the file's name; null without one. A dot in front is no extension."""
    return F.nullif(F.regexp_extract(filename, r"[^./]\.([^./]+)$", 1), F.lit(""))


def file_root(filename: Column) -> Column:
    base = F.substring_index(filename, "/", -1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]+$", "")


def expires(created: Column, days: int | None) -> Column:
    """`created` (epoch days) and so many days; null if they are not set."""
    return created + F.lit(days)


def default_title(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), file_root(filename))


def mime_type(content: Column, by_extension: Column) -> Column:
    """The content's type unless generic, then the extension's, else octet-stream."""
    return F.when(content.isNotNull() & ~content.isin(*GENERIC_TYPES), content).otherwise(F.coalesce(by_extension, F.lit("application/octet-stream")))


def color_table(spark) -> DataFrame:
    """(seed, color) of all 65,536 seeds: hue 0 to 360, saturation 50 to 75, lightness 25 to 60 from a seeded generator."""

    def color(seed: int) -> str:
        rng = random.Random(seed)
        return f"hsl({rng.randint(0, 360)}, {rng.randint(50, 75)}%, {rng.randint(25, 60)}%)"

    return spark.createDataFrame([(k, color(k)) for k in range(1 << 16)], "seed int, color string")


def color_seed(id_: Column) -> Column:
    """The last 16 bits of an id's SHA-1."""
    return F.conv(F.right(F.sha1(id_.cast("binary")), F.lit(4)), 16, 10).cast("int")


def color_seed_of(id_: str) -> int:
    return int(hashlib.sha1(id_.encode()).hexdigest(), 16) & 0xFFFF


def changed(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Sorted names of the fields whose values differ; null equals null."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, a, b in pairs])))


def name_matches(name: Column, pattern: str | None) -> Column:
    """The pattern occurs in the name; an invalid or missing pattern lets all pass."""
    try:
        re.compile(pattern or "")
    except re.error:
        return F.lit(True)
    return F.rlike(name, F.lit(pattern)) if pattern else F.lit(True)


def iexact(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def icontains(a: Column, b: str) -> Column:
    return F.contains(F.lower(a), F.lit(b.lower()))


def search(tokens: list[str], exact: Column, *columns: Column) -> Column:
    """Every token is the exact column's value or occurs in one of the others."""
    out = F.lit(True)
    for t in tokens:
        one = exact.cast("string") == t
        for c in columns:
            one = one | F.coalesce(icontains(c, t), F.lit(False))
        out = out & one
    return out


def is_key(key: Column, id_: Column, slug: Column) -> Column:
    """A key of digits is an id, any other a slug."""
    return F.when(F.rlike(key, F.lit(r"^\d+$")), id_.cast("string") == key).otherwise(slug == F.lower(key))


def printable(s: Column, most: int = 255) -> Column:
    return F.rlike(s, F.lit("^[ -~]*$")) & (F.length(s) <= most)


def any_set(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (c.isNotNull() & (c.cast("string") != ""))
    return out


def set_fields(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in pairs]))


def first_failing(*gates: tuple[str, Column]) -> Column:
    """The name of the first gate that is shut; 'ok' if all are open."""
    out = F.lit("ok")
    for name, open_ in reversed(gates):
        out = F.when(~F.coalesce(open_, F.lit(False)), name).otherwise(out)
    return out


def denied_exception(kind: Column, values: Column, message: Column, patterns: list[str]) -> Column:
    """An exception of which a value or the message matches a pattern. Other events, and nulls, are not denied."""
    all_ = F.concat(F.coalesce(values, F.array().cast("array<string>")), F.array(message))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.exists(F.filter(all_, lambda x: x.isNotNull()), lambda x: F.rlike(x, F.lit(p)))  # noqa: B023
    return (kind == "exception") & hit


def role_change(actor: Column, target: Column, same: Column, new: Column) -> Column:
    """Why a change of role is refused; null if it is not."""
    return F.when(same, "self").when(~F.coalesce(actor.isin("owner", "administrator"), F.lit(False)), "not allowed").when(new == "owner", "owner is not granted").when(target == "owner", "owner is not demoted")


def _grams(text: str) -> list[str]:
    """Trigrams in order: two blanks before and one behind each run of letters and digits."""
    return [f"  {w} "[k : k + 3] for w in re.findall(r"[^\W_]+", text.lower()) for k in range(len(w) + 1)]


def _word_similarity(text: str, asked: set[str]) -> float:
    grams, best = _grams(text), 0.0
    hits = [k for k, g in enumerate(grams) if g in asked]
    for n, i in enumerate(hits):
        for j in hits[n:]:
            extent = set(grams[i : j + 1])
            both = len(extent & asked)
            best = max(best, both / (len(asked) + len(extent) - both))
    return best


def similar(rows: DataFrame, column: str, query: str, threshold: float = 0.6) -> DataFrame:
    """Rows whose column has a stretch of trigrams that is at least `threshold` like the query's, with `similarity`.

    How many of the query's trigrams occur at all bounds the similarity from above, and is counted in the JVM first.
    """
    asked = set(_grams(query))
    if not asked:
        return rows.withColumn("similarity", F.lit(0.0)).limit(0)
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    held = sum((F.contains(padded, F.lit(g)).cast("int") for g in sorted(asked)), F.lit(0))

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda t: 0.0 if t is None else _word_similarity(t, asked)).astype(float)

    near = rows.where(held >= threshold * len(asked))
    return near.withColumn("similarity", score(F.col(column))).where(F.col("similarity") >= threshold)
