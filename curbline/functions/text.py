"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: white space of any script, and the separators U+001C to U+001F.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse_space(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), _SPACE, " "))


def fingerprint(c) -> Column:
    """md5 hex of the query text with white space collapsed."""
    return F.md5(collapse_space(c))


def preview_text(c, n: int = 100) -> Column:
    return F.substring(_col(c), 1, n)


def strip_fences(c) -> Column:
    """Generated SQL without code fences and outer white space."""
    bare = F.regexp_replace(_col(c), "```(sql)?", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def tokens(c) -> Column:
    """Lower-case words split at white space; empty pieces dropped."""
    return F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda t: t != "")


def one_object(c) -> Column:
    """A JSON object as a map; null when it is broken or text follows its end.

    Read as a list of one: text after the object breaks the list.
    """
    listed = F.from_json(F.concat(F.lit("["), _col(c), F.lit("]")), "array<map<string,string>>")
    return F.when(_col(c).startswith("{") & (F.size(listed) == 1), F.get(listed, F.lit(0)))


def entity_map(c) -> Column:
    """Entities from model output: an object, or the first element of a list.

    Anything else, bad JSON included, gives an empty map; null values are dropped.
    """
    raw = F.trim(_col(c))
    as_map = "map<string,string>"
    # A list, too, is read as the one element of another, so that nothing may follow it.
    lists = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<array<string>>")
    first = F.when(F.size(lists) == 1, F.get(F.get(lists, F.lit(0)), F.lit(0)))
    pick = F.when(raw.startswith("{"), one_object(raw)).when(raw.startswith("["), one_object(F.trim(first)))
    empty = F.from_json(F.lit("{}"), as_map)
    return F.coalesce(F.map_filter(pick, lambda _, v: v.isNotNull()), empty)


def sorted_json(m) -> Column:
    """JSON text of a map with its keys in order."""
    entries = F.array_sort(F.map_entries(_col(m)))
    return F.to_json(F.map_from_entries(entries))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
