"""Cleaning: what is stripped from items that need no rebuild."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions.columns import ext
from portcullis.operators.metadata import provenance_keys
from portcullis.operators.profiles import Settings
from portcullis.operators.spread import ordered_entries, paged_lists
from portcullis.schema import FAIL, PASS, WARN, finding, gather, text, to_rows



def removals(items: DataFrame, parts: DataFrame, p: Settings, keys: list[str] | None = None) -> DataFrame:
    """(item_id, rank, what): everything a header edit removes, in order.

    ``items``: title, global_tags, track_tags, muxing_app, writing_app; ``parts``: idx, title,
    editable."""
    keys = keys or ["item_id"]
    tags = F.coalesce(F.col("global_tags"), F.lit(0)) + F.coalesce(F.col("track_tags"), F.lit(0))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    what = F.array_compact(F.array(
        F.when(p["metadata.strip_tags"] & (tags > 0), text(tags, " tag entries")),
        F.when(p["metadata.strip_title"] & given("title"), "title"),
        F.when(p["metadata.strip_provenance"] & (given("muxing_app") | given("writing_app")), "muxing/writing app, date")))
    rows = items.select(*keys, F.posexplode(what).alias("pos", "what")).select(
        *keys, F.col("pos").cast("long").alias("rank"), "what")
    if p.may("metadata.strip_track_titles"):
        named = parts.filter(p["metadata.strip_track_titles"] & given("title") & F.col("editable"))
        rows = rows.unionByName(named.select(*keys, (F.col("idx").cast("long") + 8).alias("rank"),
                                             text("track #", F.col("idx"), " name").alias("what")))
    return rows


def removal_entries(what: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ordinal, what): the removals of each item numbered in order, one row a removal."""
    return ordered_entries(what, keys or ["item_id"], "rank", F.col("what"), "what")


def clean_findings(items: DataFrame, what: DataFrame, dry_run: bool = False, keys: list[str] | None = None,
                   page: int = 4096) -> DataFrame:
    """METADATA (or DRY_RUN) with the removals, NOTHING_TO_CLEAN for an item without any."""
    keys = keys or ["item_id"]
    lists = paged_lists(what, keys, "rank", F.col("what"), "what", page)
    joined = items.select(*keys).join(lists, keys, "left")
    some = F.col("what").isNotNull()
    code = F.when(~some, "NOTHING_TO_CLEAN").otherwise("DRY_RUN" if dry_run else "METADATA")
    said = text("would remove " if dry_run else "removed ", F.array_join("what", ", "))
    return to_rows(joined, gather(finding(F.lit(True), "clean", code, PASS,
                                          F.when(some, said).otherwise("already clean"),
                                          seq=F.coalesce("page", F.lit(0)))), *keys)


def strip_items(items: DataFrame, p: Settings) -> DataFrame:
    """Items after the edit: title, tags, applications and date by profile."""
    cut = lambda flag, c, empty: F.when(p[flag], empty).otherwise(F.col(c))
    none = F.create_map().cast("map<string,string>")
    return items.withColumns({
        "title": cut("metadata.strip_title", "title", F.lit("")),
        "tags": cut("metadata.strip_tags", "tags", none),
        "global_tags": cut("metadata.strip_tags", "global_tags", F.lit(0)),
        "track_tags": cut("metadata.strip_tags", "track_tags", F.lit(0)),
        "muxing_app": cut("metadata.strip_provenance", "muxing_app", F.lit("")),
        "writing_app": cut("metadata.strip_provenance", "writing_app", F.lit(""))})


def strip_parts(parts: DataFrame, p: Settings) -> DataFrame:
    return parts.withColumn("title", F.when(p["metadata.strip_track_titles"], "").otherwise(F.col("title")))


# --- tags a rewrite always writes back ------------------------------------------------------------
def inert_filter(tags: Column, scope: Column) -> Column:
    """Tags that count as metadata: without those every rewrite re-creates, so that cleaning twice
    changes nothing the second time. ``scope`` is item or part."""
    def inert_part(k, v):
        out = F.lower(k) == "language"
        for key, values in T.INERT_PART_TAGS.items():
            out = out | ((F.lower(k) == key) & v.isin(values))
        return out

    return F.map_filter(tags, lambda k, v: ~F.when(scope == "item", F.lower(k).isin(T.INERT_ITEM_TAGS))
                        .otherwise(inert_part(k, v)))


def rewrite_reasons(attrs: Column, has_xmp: Column, tags: Column) -> Column:
    """What a rewrite of one item would drop: provenance keys, XMP, listed items, format tags."""
    keys = provenance_keys(attrs)
    counted = F.size(F.map_keys(inert_filter(tags, F.lit("item"))))
    return F.array_compact(F.array(
        F.when(F.size(keys) > 0, text(F.size(keys), " provenance atom(s): ", F.array_join(keys, ", "))),
        F.when(has_xmp, "XMP box"),
        F.when(F.size(F.map_keys(attrs)) > 0, text(F.size(F.map_keys(attrs)), " ilst item(s)")),
        F.when(counted > 0, text(counted, " format tag(s)"))))


def in_namespace(key: Column, prefixes: list[str]) -> Column:
    """Exact, case-sensitive prefix with something after it."""
    out = F.lit(False)
    for prefix in prefixes:
        if prefix:
            out = out | (key.startswith(prefix) & (F.length(key) > len(prefix)))
    return out


def strip_namespace(attrs: Column, prefixes: list[str], dry_run: bool = False) -> tuple[Column, Column]:
    """(remaining attributes, finding) of removing a namespace; a dry run keeps everything."""
    gone = F.array_sort(F.filter(F.map_keys(attrs), lambda k: in_namespace(k, prefixes)))
    left = attrs if dry_run else F.map_filter(attrs, lambda k, v: ~in_namespace(k, prefixes))
    said = finding(F.size(gone) > 0, "clean", "XATTR", PASS,
                   text("would remove" if dry_run else "removed", " xattr ", F.array_join(gone, ", ")), seq=1000)
    return left, said


def verify_clean(compared: DataFrame, counts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Findings of a rewrite that must be thrown away: layout, hashes or provenance keys.

    ``compared`` from ``compare_parts``, ``counts`` from ``verify_counts``, ``outputs``: item_id,
    attrs, has_xmp of the rewritten items. Items without a finding are good."""
    layout = counts.filter(F.col("want") != F.col("got")).select("item_id").distinct()
    differs = compared.filter((F.col("status").isin("mismatch", "decoded")) & F.col("idx").isNotNull()).groupBy(
        "item_id").agg(F.min("idx").alias("idx"))
    keys = provenance_keys(F.col("attrs"))
    left = outputs.filter((F.size(keys) > 0) | F.col("has_xmp"))
    return (to_rows(layout, gather(finding(F.lit(True), "verify", "CLEAN_FAIL", FAIL,
                                           "rewritten file does not match source stream layout")), "item_id")
            .unionByName(to_rows(differs, gather(finding(
                F.lit(True), "verify", "HASH_MISMATCH", FAIL,
                text("stream #", F.col("idx"), " differs after rewrite; original untouched"), seq=1)), "item_id"))
            .unionByName(to_rows(left, gather(finding(
                F.lit(True), "verify", "PURCHASE_ATOM", FAIL,
                text("provenance survived rewrite: ", F.array_join(keys, ", ")), seq=2)), "item_id")))


def keep_verified(outputs: DataFrame, failures: DataFrame) -> DataFrame:
    """Outputs whose verification found nothing; the others are discarded."""
    return outputs.join(failures.select("item_id").distinct(), "item_id", "left_anti")


def clean_sidecar(path: Column, p: Settings, remove_blocked: bool, dry_run: bool = False,
                  xattr: Column | None = None) -> Column:
    """Finding about a sidecar: removed when blocked and asked for, stripped, or left alone."""
    e = ext(path)
    blocked = F.array_contains(p["sidecars.block"], e)
    if remove_blocked:
        code, sev = ("DRY_RUN" if dry_run else "SIDECAR_REMOVED"), PASS
        said = text("would remove blocked sidecar .", e) if dry_run else F.lit("blocked sidecar removed")
    else:
        code, sev = "SKIPPED", WARN
        said = text("blocked sidecar .", e, " stays; its removal was not asked for")
    rest = finding(F.lit(True), "clean", "NOTHING_TO_CLEAN", PASS, "sidecar; nothing to clean")
    if xattr is not None:
        rest = F.coalesce(xattr, rest)
    return F.coalesce(finding(blocked, "clean", code, sev, said), rest)


def clean_dispatch(container: Column, strip_audio: bool = False, command: str = "clean") -> Column:
    """struct(cleaner, code, severity, message): which cleaner an item's container takes."""
    def out(cleaner, code="", severity=PASS, message=""):
        m = message if isinstance(message, Column) else F.lit(message)
        return F.struct(F.lit(cleaner).alias("cleaner"), F.lit(code).alias("code"),
                        F.lit(severity).alias("severity"), m.alias("message"))

    advice = ("audio tags stay in an ingest run" if command == "ingest"
              else "audio tags stay unless their removal is asked for")
    audio = out("rewrite") if strip_audio else out("none", "SKIPPED", PASS, advice)
    return (F.when(container.isin("matroska", "webm"), out("header"))
             .when(container.isin("mp4", "avi", "flv"), out("rewrite"))
             .when(container.isin("mpegts", "mpegps"),
                   out("none", "NOTHING_TO_CLEAN", PASS, text(container, " holds no metadata that can be rewritten; rebuild it instead")))
             .when(container.isin("mp3", "flac", "ogg", "wav"), audio)
             .otherwise(out("none", "SKIPPED", WARN, text("no cleaner for container ", container))))
