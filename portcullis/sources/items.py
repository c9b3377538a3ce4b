"""Sources: trees of files, and existing tables read as the gate's relations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.sources.tree import WHOLE, WINDOW, listing, listing_stream, with_bodies

TEMP_PREFIX, TEMP_SUFFIX = ".portcullis-", ".tmp"
IGNORED_NAMES = [".DS_Store"]


def plain_path(path: Column) -> Column:
    """A file URL as a path."""
    return F.regexp_replace(path, "^file:/+", "/")


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.substring_index("path", "/", -1))


def _listed(files: DataFrame, exclude: list[str]) -> DataFrame:
    path = plain_path(F.col("path"))
    name = F.substring_index(path, "/", -1)
    own = name.startswith(TEMP_PREFIX) & name.endswith(TEMP_SUFFIX)
    keep = ~name.isin(IGNORED_NAMES) & ~own
    for folder in exclude:
        keep = keep & ~path.startswith(folder.rstrip("/") + "/")
    return files.filter(keep).withColumn("path", path).withColumn("name", name)


def list_items(spark: SparkSession, path: str, exclude: list[str] | None = None, bodies: bool = True, whole: int = WHOLE,
               window: int = WINDOW) -> DataFrame:
    """Every file below ``path``, empty and hidden ones as well: path, modificationTime, length and name, and with
    ``bodies`` content (of files above ``whole`` bytes their first and last ``window`` bytes), whole and error."""
    files = _listed(listing(spark, path), exclude or [])
    return _named(with_bodies(files, whole, window)) if bodies else files


def stream_items(spark: SparkSession, path: str, exclude: list[str] | None = None, whole: int = WHOLE, window: int = WINDOW) -> DataFrame:
    """The same with bodies, as files arrive or change."""
    return _named(with_bodies(_listed(listing_stream(spark, path), exclude or []), whole, window))


def union_roots(frames: list[DataFrame]) -> DataFrame:
    """Several roots as one run."""
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- existing tables ------------------------------------------------------------------------------
def _mapped(df: DataFrame, wanted: dict[str, tuple[str, object]], mapping: dict) -> DataFrame:
    unknown = set(mapping) - set(wanted)
    if unknown:
        raise ValueError("unknown columns: " + ", ".join(sorted(unknown)))
    out = []
    for name, (kind, default) in wanted.items():
        value = mapping.get(name, F.lit(default))
        value = F.col(value) if isinstance(value, str) else value
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


ITEM = {"item_id": ("string", None), "name": ("string", ""), "body": ("string", None),
        "declared": ("long", None), "grp": ("string", "")}
PART = {"item_id": ("string", None), "idx": ("long", 0), "type": ("string", ""), "codec": ("string", ""),
        "codec_tag": ("string", ""), "lang": ("string", ""), "ietf": ("string", ""), "title": ("string", ""),
        "is_default": ("boolean", False), "forced": ("boolean", False), "commentary": ("boolean", False),
        "hearing_imp": ("boolean", False), "visual_imp": ("boolean", False), "original": ("boolean", False),
        "attached_pic": ("boolean", False), "text_sub": ("boolean", False), "text": ("string", ""),
        "tags": ("map<string,string>", None)}
ATTACHMENT = {"item_id": ("string", None), "att_id": ("long", 0), "file_name": ("string", ""),
              "mime": ("string", ""), "size": ("long", 0), "payload": ("binary", None)}
OBSERVATION = {"path": ("string", None), "version": ("string", ""), "ts": ("timestamp_ntz", None)}


def as_items(df: DataFrame, **mapping) -> DataFrame:
    return _mapped(df, ITEM, mapping)


def as_parts(df: DataFrame, **mapping) -> DataFrame:
    return _mapped(df, PART, mapping)


def as_attachments(df: DataFrame, **mapping) -> DataFrame:
    return _mapped(df, ATTACHMENT, mapping)


def as_observations(df: DataFrame, **mapping) -> DataFrame:
    return _mapped(df, OBSERVATION, mapping)


def as_attrs(df: DataFrame, item_id: str, tags: Column, scope: str = "item") -> DataFrame:
    """(item_id, scope, key, value) rows of a metadata map."""
    return df.select(F.col(item_id).cast("string").alias("item_id"), F.lit(scope).alias("scope"),
                     F.explode(tags).alias("key", "value"))


def tags_from_json(text: Column) -> Column:
    """A flat JSON object as a metadata map; a bad document is an empty map, not an error."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
