"""Maps, arrays and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(a: Column, b: Column) -> Column:
    """Entries of both; b's win. No session setting is needed: keys of b are taken out of a first."""
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def without_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*keys))


def only_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def union_arrays(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def remove_all(a: Column, b: Column) -> Column:
    """What of a is not in b, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def split_scopes(s: Column, prefix: str = "") -> Column:
    """Words in small letters without repeats, in order, the prefix taken off."""
    words = F.filter(F.split(F.lower(s), " "), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.when(F.startswith(w, F.lit(prefix)), F.substring(w, F.lit(len(prefix) + 1), F.length(w))).otherwise(w)) if prefix else F.array_distinct(words)


def json_get(doc: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(doc, path), F.lit(default))


def unknown_keys(doc: Column, allowed: list[str]) -> Column:
    """Top-level keys that a closed schema doesn't have; null if `doc` is no object."""
    return F.array_except(F.json_object_keys(doc), F.array(*map(F.lit, allowed)))


def subset(a: Column, b: Column) -> Column:
    """An empty a is in everything, a null b has nothing in it."""
    empty = F.size(F.coalesce(a, F.array().cast("array<string>"))) == 0
    return empty | F.coalesce(F.size(F.array_except(a, b)) == 0, F.lit(False))


def list_or_default(doc: Column, path: str, default: list[str]) -> Column:
    """The list of strings at `path`, or the default if there is no array."""
    return F.coalesce(F.from_json(F.get_json_object(doc, path), "array<string>"), F.array(*map(F.lit, default)))


def names_by_id(people: Column) -> Column:
    """array<struct<participantId, name>> -> map of id to name, or to the id where there is no name. The last of an id wins."""
    last = F.filter(people, lambda p, k: ~F.exists(F.slice(people, k + 2, F.size(people)), lambda q: q["participantId"] == p["participantId"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["participantId"], F.coalesce(F.nullif(p["name"], F.lit("")), p["participantId"]))))


def relabel(segments: Column, names: Column) -> Column:
    """Speakers of segments and of the words in them renamed by a map; unknown ones and all other fields stay."""
    named = lambda s: F.coalesce(F.try_element_at(names, s["speaker"]), s["speaker"])
    return F.transform(segments, lambda s: s.withField("speaker", named(s)).withField("words", F.transform(s["words"], lambda w: w.withField("speaker", named(w)))))


def decode_callback(message: Column) -> Column:
    """What a tagged message asks for, by type and then status; '' where the receiver does nothing."""
    kind, status = F.get_json_object(message, "$.type"), F.get_json_object(message, "$.status")
    return F.when((kind == "transcript") & (status == "success"), "external_process_successful").when((kind == "transcript") & (status == "failure"), "external_process_failed").otherwise("")
