"""Column helpers: literal lookups and name functions."""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from portcullis.functions import tables as T


def _quoted(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


@lru_cache(maxsize=256)
def _list_sql(values: tuple) -> str:
    return "array(" + ", ".join(_quoted(v) for v in values) + ")"


@lru_cache(maxsize=64)
def _map_sql(pairs: tuple) -> str:
    return "map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in pairs) + ")"


def lookup(key: Column, table: dict) -> Column:
    """Value of ``key`` in a fixed table, NULL when it is not listed.

    The table is one parsed literal: building it from single columns costs a call to the JVM for
    every entry."""
    return F.try_element_at(F.expr(_map_sql(tuple(table.items()))), key)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def string_list(values: list[str]) -> Column:
    return F.expr(_list_sql(tuple(values))) if values else F.expr("cast(array() as array<string>)")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext(path: Column) -> Column:
    """Lower-case last extension of a path, '' when the base name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


MEDIA = {e: name for name, extensions in T.MEDIA_EXTENSIONS.items() for e in extensions}


def category(extension: Column) -> Column:
    """video / audio / subtitle for a media extension, NULL for anything else (a sidecar)."""
    return lookup(extension, MEDIA)


def second_ext(name: Column) -> Column:
    """Second-to-last extension of a base name with at least two dots."""
    parts = F.split(F.lower(name), r"\.")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -2))


def container_of(fmt: Column) -> Column:
    """Container class of a format string."""
    first = F.split(fmt, ",")[0]
    return F.coalesce(lookup(fmt, T.CONTAINERS_EXACT), lookup(first, T.CONTAINERS_FIRST), first)


def tag_ci(tags: Column, key: str) -> Column:
    """Case-insensitive lookup in a map; '' when absent. The alphabetically first spelling wins."""
    hits = F.map_filter(tags, lambda k, v: F.lower(k) == key)
    best = F.array_min(F.map_keys(hits))
    return F.coalesce(F.when(best.isNotNull(), F.try_element_at(hits, best)), F.lit(""))


# --- languages ----------------------------------------------------------------------------
LANGUAGE_ALIASES = {spelling: group[0] for group in T.LANGUAGE_GROUPS for spelling in group}
_SPACE = "\t\n\u000b\f\r \u0085\u00a0"


@lru_cache(maxsize=1)
def _aliases_by_letter() -> str:
    """The aliases as one literal: place c + 1 of an array has those whose first character is c."""
    by: dict[int, dict] = {}
    for alias, canon in LANGUAGE_ALIASES.items():
        by.setdefault(ord(alias[0]), {})[alias] = canon
    none = "cast(map() as map<string,string>)"
    return "array(" + ", ".join(_map_sql(tuple(by[c].items())) if c in by else none for c in range(max(by) + 1)) + ")"


def _alias(code: Column) -> Column:
    """A lookup compares with every key of a map, so only the few aliases of the code's first letter are asked."""
    return F.try_element_at(F.get(F.expr(_aliases_by_letter()), F.ascii(code)), code)


def canonical_lang(code: Column) -> Column:
    """ISO 639-2/B form; unknown codes pass through lower-cased, '' and NULL are 'und'. Most codes are spelled as in the
    table; only the others are trimmed and cut at the first separator."""
    clean = F.lower(F.btrim(code, F.lit(_SPACE)))
    short = F.coalesce(F.nullif(F.substring_index(F.translate(clean, "_", "-"), "-", 1), F.lit("")), clean)
    rest = F.when(clean == "", F.lit("und")).otherwise(F.coalesce(_alias(short), short))
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("und")).otherwise(F.coalesce(_alias(code), rest))


def canonical_lang_py(code: str) -> str:
    """The same rule for settings that are known on the driver."""
    clean = code.strip().lower()
    if not clean:
        return "und"
    for i, ch in enumerate(clean):
        if ch in "-_":
            clean = clean[:i] if i > 0 else clean
            break
    return LANGUAGE_ALIASES.get(clean, clean)


def is_und(code: Column) -> Column:
    return canonical_lang(code).isin("und", "unknown")
