"""Nested JSON as texts: one form for all orders of keys, digests, entries, merges; all depths alike.

A variant keeps an object's keys sorted, so its text is the same whatever order they were written
in. Texts that are not JSON, repeat a key in one object or exceed a variant's 16 MB stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTRIES = "map<string,variant>"


def canonical(json: Column) -> Column:
    """The text without spaces and with sorted keys at every depth; null stays null."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def digest(json: Column) -> Column:
    """sha256 of the canonical text."""
    return F.sha2(canonical(json), 256)


def _held(value: Column) -> Column:
    """A variant's entries; null if it is no object."""
    return F.try_variant_get(value, "$", _ENTRIES)


def _or_none(held: Column) -> Column:
    return F.coalesce(held, F.create_map().cast(_ENTRIES))


def is_object(json: Column) -> Column:
    """False for null, for texts that are no JSON and for other kinds of values."""
    return _held(F.try_parse_json(json)).isNotNull()


def entries(json: Column) -> Column:
    """The entries of an object; none of what is no object."""
    return _or_none(_held(F.try_parse_json(json)))


def _once(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a struct of values, each of which is computed once a row however often body names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def has_key(json: Column, key: str) -> Column:
    """Whether an object has the key, null values included."""
    return F.map_contains_key(entries(json), F.lit(key))


def _over(old: Column, new: Column) -> Column:
    """Entries of both maps, the new one's where both have the key."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _text(held: Column) -> Column:
    return canonical(F.to_json(held))


def with_entry(json: Column, key: str, value: Column) -> Column:
    """The object with an entry set to a JSON text's value; null or no JSON sets null."""
    one = F.create_map(F.lit(key), F.coalesce(F.try_parse_json(value), F.parse_json(F.lit("null"))))
    return _text(_once(lambda p: _over(p["old"], p["new"]), old=entries(json), new=one))


def merged_objects(old: Column, new: Column, nested: list[str] = ()) -> Column:
    """Entries of both objects, the new value where both have a key.

    Under a key of `nested`, if both values are objects, their entries are merged in the same way;
    if only one is an object, it stays. What is no object counts as an empty one. Both texts are
    parsed once, and one text is made, however many keys are nested.
    """

    def inner(p: Column, key: str) -> Column:
        own = {side: _held(F.try_element_at(p[side], F.lit(key))) for side in ("old", "new")}
        return _once(
            lambda q: F.when(q["old"].isNotNull() | q["new"].isNotNull(), F.create_map(F.lit(key), F.try_parse_json(F.to_json(_over(_or_none(q["old"]), _or_none(q["new"])))))), **own
        )

    def merged(p: Column) -> Column:
        out = _over(p["old"], p["new"])
        for key in dict.fromkeys(nested):
            out = _once(lambda q: F.when(q["inner"].isNull(), q["out"]).otherwise(_over(q["out"], q["inner"])), out=out, inner=inner(p, key))
        return out

    return _text(_once(merged, old=entries(old), new=entries(new)))
