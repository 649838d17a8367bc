"""JSON objects as maps of strings: merges, allow-lists, references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OBJECT = "map<string,string>"


def decoded(blob: Column) -> Column:
    """A flat JSON object as a map; null and malformed ones are empty."""
    return F.coalesce(F.from_json(blob, OBJECT), F.create_map().cast(OBJECT))


def patched(old: Column, new: Column) -> Column:
    """RFC 7386 for flat maps: keys of ``new`` win, a null in it deletes the key; a null map changes nothing."""
    empty = F.create_map().cast(OBJECT)
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull()))


def allowed(found: Column, keys: list[str]) -> Column:
    return F.map_filter(found, lambda k, _: k.isin(keys)) if keys else F.map_filter(found, lambda k, _: F.lit(False))


def referenced(old: Column, by: Column, post: Column) -> Column:
    """An array of {by, post} with one more reference, unless it is there."""
    there = F.exists(old, lambda r: (r["by"] == by) & (r["post"] == post))
    return F.when(there, old).otherwise(F.array_append(old, F.struct(by.alias("by"), post.alias("post"))))


def without(mapped: Column, keys: list[str]) -> Column:
    """A map without some keys."""
    return F.map_filter(mapped, lambda k, _: ~k.isin(keys))


def revision(mapped: Column, volatile: list[str]) -> Column:
    """A fingerprint of a record whatever the order of its keys, without those that change by themselves."""
    kept = F.map_from_entries(F.array_sort(F.map_entries(without(mapped, volatile))))
    return F.sha2(F.to_json(kept), 256)
