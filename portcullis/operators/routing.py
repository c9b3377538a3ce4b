"""Routing: refuse, rebuild, clean or skip each item, and plan where outputs go."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions.columns import base_name, category, ext
from portcullis.operators.policy import ACTION_SPAN
from portcullis.operators.profiles import Settings
from portcullis.operators.spread import ordered_entries, paged_lists, with_flag_from, with_stats
from portcullis.schema import BLOCK, FAIL, PASS, WARN, finding, gather, text, to_rows


def refuse(path: Column, verdict: Column, parsed: Column, force: Column) -> Column:
    """struct(severity, message, reason) where an item goes no further; NULL where it may."""
    def out(severity, message, reason):
        return F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(reason).alias("reason"))

    media = category(ext(path)).isNotNull()
    return (F.when(media & (verdict >= BLOCK), out(BLOCK, "blocked by the scan", "scan verdict BLOCK"))
             .when(media & (verdict >= FAIL) & ~force,
                   out(FAIL, "failed by the scan; only a forced run goes on", "scan verdict FAIL"))
             .when(media & ~parsed, out(FAIL, "the scan found no parts in it", "no probe result")))


#: What routing reads of decided parts.
DECIDED = ["item_id", "idx", "type", "codec", "lang", "is_default", "forced", "keep", "reason", "out_default", "out_forced",
           "set_language", "has_video"]


def rebuild_reasons(decided: DataFrame, attachments: DataFrame | None, chapters: DataFrame | None,
                    p: Settings, keys: list[str] | None = None) -> DataFrame:
    """(item_id, rank, reason): every way an item differs from its decision, in order.

    ``chapters`` has one row (item_id, chapter_n) per item."""
    keys = keys or ["item_id"]
    t, idx = F.col("type"), F.col("idx")
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("und"))
    av = t.isin("audio", "subtitle")

    def flip(name, was, now):
        return F.when(F.col("keep") & av & (was != now), text("#", idx, f" {name} flag ", was, " -> ", now))

    reasons = F.array_compact(F.array(
        F.when(~F.col("keep"), text("drop #", idx, " ", t, " ", F.col("codec"), " ", lang, ": ", F.col("reason"))),
        flip("default", F.col("is_default"), F.col("out_default")),
        flip("forced", F.col("forced"), F.col("out_forced")),
        F.when(F.col("keep") & (F.col("set_language") != ""), text("#", idx, " language und -> ", F.col("set_language")))))
    rows = (decided.filter(t.isin("video", "audio", "subtitle"))
            .select(*keys, idx.cast("long").alias("idx"), F.posexplode(reasons).alias("pos", "reason"))
            .select(*keys, (F.col("idx") * 8 + F.col("pos")).alias("rank"), "reason"))
    if attachments is not None:
        rows = rows.unionByName(attachments.filter(~F.col("keep")).select(
            *keys, (F.lit(8 * ACTION_SPAN) + F.col("att_id")).alias("rank"),
            text("drop attachment #", F.col("att_id"), " ", F.col("file_name"), ": ", F.col("reason")).alias("reason")))
    if chapters is not None:
        rows = rows.unionByName(chapters.filter(~p["chapters.keep"] & (F.col("chapter_n") > 0)).select(
            *keys, F.lit(16 * ACTION_SPAN).alias("rank"), F.lit("chapters dropped").alias("reason")))
    return rows


def reason_entries(reasons: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ordinal, reason): the reasons of each item numbered in order, one row a reason."""
    return ordered_entries(reasons, keys or ["item_id"], "rank", F.col("reason"), "reason")


def reason_lists(reasons: DataFrame, keys: list[str] | None = None, page: int = 4096) -> DataFrame:
    return paged_lists(reasons, keys or ["item_id"], "rank", F.col("reason"), "reasons", page)


def route(path: Column, verdict: Column, container: Column, parsed: Column, copies: Column, tool_warning: Column,
          no_video: Column, differs: Column, mode: Column, force: Column) -> Column:
    """struct(route, reason): the first of the ordered rules that applies.

    The reason of a rebuild that follows from ``differs`` is empty: its reasons are a list."""
    def out(name, reason):
        r = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(name).alias("route"), r.alias("reason"))

    cat = category(ext(path))
    side = cat.isin("audio", "subtitle")
    refused = refuse(path, verdict, parsed, force)
    failed, linked = verdict >= FAIL, copies > 1
    name = F.coalesce(F.nullif(container, F.lit("")), F.lit("unknown"))
    return (F.when(cat.isNull(), out("skip", "sidecar"))
             .when(refused.isNotNull(), out("skip", refused["reason"]))
             .when(~force & ~side & no_video, out("skip", "decision failed"))
             .when(failed & force & ~side, out("remux", "scan verdict FAIL; rebuilt because --force was given"))
             .when(linked & side, out("skip", "hard-linked audio or subtitle file"))
             .when(linked & mode.isin("break", "copy"),
                   out("remux", text("hard-linked; rebuilt rather than edited in place (safety.hardlinks = ", mode, ")")))
             .when(linked, out("skip", "hard-linked"))
             .when(side & failed & force, out("clean", "scan verdict FAIL; cleaned because --force was given"))
             .when(side, out("clean", "audio or subtitle container; metadata only"))
             .when((ext(path) != "mkv") | ~container.isin("matroska", "webm"),
                   out("remux", text("container ", name, " is rebuilt as Matroska")))
             .when(tool_warning, out("remux", "mkvmerge reported warnings; rebuilding"))
             .when(differs, out("remux", ""))
             .otherwise(out("clean", "tracks, flags, attachments and chapters already match the profile")))


def route_items(items: DataFrame, reasons: DataFrame, p: Settings, force: bool = False,
                mode: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Append route and reason to items (path, verdict, container, parsed, copies, tool_warning,
    no_video). Items have one row each, so the join on the item has no hot key; reasons are reduced
    to one row per item before it."""
    keys = keys or ["item_id"]
    differing = reasons.groupBy(*keys).agg(F.count("*").alias("n_reasons"))
    joined = items.join(differing, keys, "left")
    r = route(F.col("path"), F.col("verdict"), F.col("container"), F.col("parsed"), F.col("copies"),
              F.col("tool_warning"), F.col("no_video"), F.coalesce("n_reasons", F.lit(0)) > 0,
              p["safety.hardlinks"] if mode is None else mode, F.lit(force))
    return (joined.withColumn("__r", r).withColumn("route", F.col("__r.route"))
            .withColumn("reason", F.col("__r.reason")).drop("__r", "n_reasons"))


def route_findings(routed: DataFrame, reasons: DataFrame, force: bool = False, page: int = 4096,
                   keys: list[str] | None = None) -> DataFrame:
    """REFUSED, HARDLINKED and ROUTE findings. ROUTE names the reasons; an item with more than a page
    of them has one ROUTE row per page."""
    keys = keys or ["item_id"]
    listed = reason_lists(reasons, keys, page).select(*keys, F.col("page").alias("__page"), "reasons")
    joined = routed.join(listed, keys, "left")
    refused = refuse(F.col("path"), F.col("verdict"), F.col("parsed"), F.lit(force))
    side = category(ext(F.col("path"))).isin("audio", "subtitle")
    linked = F.col("reason").isin("hard-linked", "hard-linked audio or subtitle file")
    why = F.when(F.col("reason") == "", F.array_join("reasons", "; ")).otherwise(F.col("reason"))
    first = F.coalesce("__page", F.lit(0)) == 0
    shown = first | (F.col("reason") == "")
    checks = gather(
        finding(first & refused.isNotNull(), "route", "REFUSED", refused["severity"], refused["message"]),
        finding(first & linked, "route", "HARDLINKED", WARN, F.when(side, text(
            F.col("copies"), " names share this file, and an edit in place would show under all of them")).otherwise(text(F.col("copies"), " names share this file; left alone (safety.hardlinks = skip)")), seq=1),
        finding(shown, "route", "ROUTE", PASS, text(F.col("route"), ": ", why),
                seq=2 + F.coalesce("__page", F.lit(0))))
    return to_rows(joined, checks, *keys)


def output_key(path: Column, root: str, out_root: str | None = None, extension: str = "mkv") -> Column:
    """Destination of a rebuilt item: the same relative key with the new extension."""
    root = root.rstrip("/")
    dest = (out_root or f"{root}__remuxed").rstrip("/")
    rel = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 2147483647)).otherwise(base_name(path))
    return F.concat(F.lit(dest + "/"), F.regexp_replace(rel, r"\.[^./]*$", ""), F.lit("." + extension))


def plan_destinations(items: DataFrame, root: str, out_root: str | None = None, existing: DataFrame | None = None,
                      fold_case: bool = False, extension: str = "mkv", dry_run: bool = False) -> DataFrame:
    """Append dest, placed and the finding columns code, severity, message.

    Of the ``eligible`` items that share a target the first in path order wins; an existing target
    beats them all. Winners are found by a minimum per target, never by ranking a target's items."""
    planned = items.withColumn("dest", output_key(F.col("path"), root, out_root, extension))
    slot = F.lower("dest") if fold_case else F.col("dest")
    planned = planned.withColumn("__slot", slot)
    if existing is not None:
        there = existing.select((F.lower("key") if fold_case else F.col("key")).alias("__slot"))
        planned = with_flag_from(planned, there, ["__slot"], "__taken")
    else:
        planned = planned.withColumn("__taken", F.lit(False))
    planned = with_stats(planned, ["__slot"], {
        "__winner": ("min", F.when(F.col("eligible") & ~F.col("__taken"), F.col("path")))})
    placed = F.col("eligible") & ~F.col("__taken") & (F.col("path") == F.col("__winner"))
    done = (F.lit("DRY_RUN"), text("would write ", F.col("dest"))) if dry_run else (
        F.lit("PLACED"), F.lit("written and verified"))
    out = (planned.withColumn("placed", F.coalesce(placed, F.lit(False)))
           .withColumn("code", F.when(F.col("placed"), done[0]).when(F.col("eligible"), "OUTPUT_EXISTS"))
           .withColumn("severity", F.when(F.col("placed"), PASS).when(F.col("eligible"), FAIL))
           .withColumn("message", F.when(F.col("placed"), done[1])
                       .when(F.col("eligible"), text(F.col("dest"), " already exists"))))
    return out.drop("__slot", "__taken", "__winner")


def dry_run(items: DataFrame, root: str, **options) -> DataFrame:
    """The destination plan alone: what would be written where. No sink follows."""
    return plan_destinations(items, root, dry_run=True, **options)


def quarantine_key(path: Column, root: str) -> Column:
    """Mirrored relative key, or the base name for a path that escapes the root."""
    root = root.rstrip("/")
    rel = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 2147483647))
    escapes = rel.isNull() | rel.isin("", ".", "..") | rel.startswith("../") | rel.startswith("/")
    return F.when(escapes, base_name(path)).otherwise(rel)


def check_quarantine_root(root: str, quarantine: str) -> None:
    """The scanned root may not be, or lie inside, the quarantine folder."""
    r, q = root.rstrip("/"), quarantine.rstrip("/")
    if r == q:
        raise ValueError(f"{root} is the quarantine directory; the quarantine directory must lie outside the tree it serves")
    if r.startswith(q + "/"):
        raise ValueError(f"{root} lies inside the quarantine directory {quarantine}; the quarantine directory must "
                         "lie outside the tree it serves")


def plan_quarantine(items: DataFrame, root: str, quarantine: str, stored: DataFrame | None = None) -> DataFrame:
    """Where BLOCK items go: dest, moved, severity and message. A key that is taken, in store or by an
    earlier item of the run, is a WARN and nothing is overwritten."""
    check_quarantine_root(root, quarantine)
    blocked = (items.filter(F.col("verdict") == BLOCK)
               .withColumn("key", quarantine_key(F.col("path"), root)))
    if stored is not None:
        blocked = with_flag_from(blocked, stored.select("key"), ["key"], "__taken")
    else:
        blocked = blocked.withColumn("__taken", F.lit(False))
    blocked = with_stats(blocked, ["key"], {"__winner": ("min", F.col("path"))})
    usable = F.col("key") != ""
    moved = usable & ~F.col("__taken") & (F.col("path") == F.col("__winner"))
    dest = F.concat(F.lit(quarantine.rstrip("/") + "/"), F.col("key"))
    return (blocked.withColumn("dest", dest).withColumn("moved", moved)
            .withColumn("severity", F.when(moved, BLOCK).otherwise(WARN))
            .withColumn("message", F.when(moved, text("moved to ", dest))
                        .when(~usable, text("quarantine failed: ", F.col("path"), " has no usable file name"))
                        .otherwise(F.lit("quarantine failed: destination exists")))
            .drop("__taken", "__winner"))
