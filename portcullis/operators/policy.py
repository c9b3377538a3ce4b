"""The decision engine: what to keep, relabel or strip in each part of each item.

All rules are decomposable statistics of an item (first, any, best), so they are computed with a
partial aggregation per block of parts instead of windows over whole items; see ``spread``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions.columns import canonical_lang, ext, is_und, let
from portcullis.operators.metadata import attachment_payload
from portcullis.operators.profiles import Settings
from portcullis.operators.spread import bounded_numbers, ordered_entries, paged_lists, with_flag_from, with_stats
from portcullis.schema import BLOCK, FAIL, LAST_SEQ, PASS, WARN, finding, gather, text, to_rows
from portcullis.session import fine_shuffles

COMMENTARY = "(?i)(?<![A-Za-z0-9_])commentar(?:y|ie[s\u017f])(?![A-Za-z0-9_])"


RANK_SPAN = 1 << 60  # part numbers stay below this


def language_codes(lang: Column, ietf: Column) -> tuple[Column, Column]:
    """Canonical codes of a part; '' where it carries no tag of the second kind."""
    tag = F.coalesce(ietf, F.lit(""))
    return canonical_lang(lang), F.when(tag == "", "").otherwise(canonical_lang(tag))


def language_matches(lang: Column, ietf: Column, p: Settings) -> Column:
    return _matches(*language_codes(lang, ietf), p)


def _matches(code: Column, tag: Column, p: Settings) -> Column:
    codes = p["languages.keep_codes"]
    return p["languages.keep_all"] | F.array_contains(codes, code) | ((tag != "") & F.array_contains(codes, tag))


def want_part(lang: Column, ietf: Column, p: Settings) -> Column:
    """struct(keep, reason, set_language) from the language rules alone."""
    code, tag = language_codes(lang, ietf)
    return let(F.struct(code.alias("code"), tag.alias("tag")), lambda c: want_codes(c["code"], c["tag"], p))


def want_codes(code: Column, tag: Column, p: Settings) -> Column:
    """The same from canonical codes, which a plan computes once per part."""
    def out(keep, reason, language=""):
        k = keep if isinstance(keep, Column) else F.lit(keep)
        s = language if isinstance(language, Column) else F.lit(language)
        r = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(k.alias("keep"), r.alias("reason"), s.alias("set_language"))

    und = code.isin("und", "unknown") & tag.isin("", "und", "unknown")
    rule, assumed = p["languages.und"], p["languages.assume"]
    kept_guess = p["languages.keep_all"] | F.array_contains(p["languages.keep_codes"], assumed)
    return (F.when(und & (rule == "drop"), out(False, "untagged language (und = drop)"))
             .when(und & rule.startswith("assume:") & kept_guess,
                   out(True, text("untagged language assumed ", assumed), assumed))
             .when(und & rule.startswith("assume:"), out(False, text("untagged language assumed ", assumed, ", not kept")))
             .when(und, out(True, "untagged language kept"))
             .when(_matches(code, tag, p), out(True, text("language ", code)))
             .otherwise(out(False, text("language ", code, " not in keep list"))))


def is_commentary(flag: Column, title: Column) -> Column:
    return flag | F.coalesce(title, F.lit("")).rlike(COMMENTARY)


def dealt(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Parts with what no profile changes (``__lang``, ``__tag``, ``__named``). Where part numbers bound an item, its
    parts are brought together once, which ``__near`` marks; a sweep over profiles then adds its rows behind that shuffle."""
    fine_shuffles(parts.sparkSession)
    code, tag = language_codes(F.col("lang"), F.col("ietf"))
    rows = parts.withColumns({"__lang": code, "__tag": tag, "__named": is_commentary(F.col("commentary"), F.col("title"))})
    if not bounded_numbers(parts, "idx"):
        return rows
    return rows.repartition(*[F.col(k) for k in keys or ["item_id"]]).withColumn("__near", F.lit(True))


def decide(parts: DataFrame, p: Settings, keys: list[str] | None = None,
           original: Column | None = None) -> DataFrame:
    """Append keep, reason, out_default, out_forced, set_language, clear_title to every part, and
    the item facts has_video, audio_fallback, first_part, has_text_sub.

    ``parts``: item_id, idx, type, lang, ietf, title, is_default, forced, commentary, hearing_imp,
    attached_pic, text_sub, as they are or from ``dealt``. ``original`` is the original language of the item, where
    known. Where ``dealt`` brought an item's parts together, all statistics are windows on one shuffle and one sort."""
    keys = keys or ["item_id"]
    parts = parts if "__lang" in parts.columns else dealt(parts, keys)
    near = "__near" in parts.columns
    t = F.col("type")
    av = t.isin("audio", "subtitle")
    hint = F.coalesce(original if original is not None else F.lit(""), F.lit(""))
    rows = (parts.withColumn("__want", F.when(av, want_codes(F.col("__lang"), F.col("__tag"), p)))
            .withColumn("__talk", F.col("__named") & p["audio.drop_commentary"])
            .withColumn("__rescue", (t == "subtitle") & ~F.col("__want.keep") & p["subtitles.keep_forced"] & F.col("forced"))
            .withColumn("__pass", F.col("__want.keep") | F.col("__rescue"))
            .withColumn("__keep", F.coalesce(F.col("__pass") & ~F.col("__talk"), F.lit(False)))
            .withColumn("__orig", F.when(p["languages.prefer_original"] & (hint != ""), canonical_lang(hint)))
            .withColumn("__spoken", F.coalesce(F.nullif(F.col("__want.set_language"), F.lit("")), F.col("__lang")))
            # Preference and place in one number: a minimum of numbers is a hash aggregate, one of structs a sort.
            .withColumn("__rank", F.when(F.coalesce(F.col("__spoken") == F.col("__orig"), F.lit(False)), F.lit(0))
                        .when(F.col("is_default"), F.lit(RANK_SPAN)).otherwise(F.lit(2 * RANK_SPAN)) + F.col("idx")))
    audio, kept_audio = t == "audio", (t == "audio") & F.col("__keep")
    sdh = F.lit(False)
    if p.may("subtitles.drop_sdh_duplicates"):  # before the item's: the sort by item and language serves both
        rows = with_stats(rows, [*keys, "__lang"], {
            "__plain": ("max", (t == "subtitle") & F.col("__keep") & ~F.col("hearing_imp"))}, near)
        sdh = (p["subtitles.drop_sdh_duplicates"] & (t == "subtitle") & F.col("__keep")
               & F.col("hearing_imp") & F.col("__plain"))
    rows = with_stats(rows, keys, {
        "__first_video": ("min", F.when((t == "video") & ~F.col("attached_pic"), F.col("idx"))),
        "__audio": ("max", audio), "__kept": ("max", kept_audio),
        "__first_audio": ("min", F.when(audio, F.col("idx"))),
        "__first_kept": ("min", F.when(kept_audio, F.col("idx"))),
        "__pick_all": ("min", F.when(audio, F.col("__rank"))),
        "__pick_kept": ("min", F.when(kept_audio, F.col("__rank"))),
        "first_part": ("min", F.col("idx")),
        "has_text_sub": ("max", (t == "subtitle") & F.col("text_sub"))}, near)
    rows = rows.withColumn("audio_fallback", F.col("__audio") & ~F.col("__kept"))
    only_first = F.coalesce("__first_kept", "__first_audio")
    rows = (rows
            .withColumn("__later", audio & p["audio.keep_first"] & (F.col("__keep") | F.col("audio_fallback"))
                        & (F.col("idx") != only_first))
            .withColumn("__default_at", F.when(p["audio.keep_first"], only_first)
                        .otherwise(F.coalesce("__pick_kept", "__pick_all") % F.lit(RANK_SPAN))))
    rows = rows.withColumn("__sdh", sdh)
    primary = F.coalesce(F.col("idx") == F.col("__first_video"), F.lit(False))
    keep = (F.when(t == "video", primary)
             .when(t == "audio", (F.col("__keep") | F.col("audio_fallback")) & ~F.col("__later"))
             .when(t == "subtitle", F.col("__keep") & ~F.col("__sdh")).otherwise(F.lit(False)))
    reason = (F.when((t == "video") & F.col("attached_pic"), "cover art stream")
               .when((t == "video") & primary, "primary video").when(t == "video", "secondary video stream")
               .when(F.col("__later"), "keep_first")
               .when((t == "audio") & F.col("audio_fallback"), "kept: policy would have removed every audio track")
               .when(F.col("__sdh"), "SDH duplicate")
               .when(av & F.col("__pass") & F.col("__talk"), "commentary")
               .when(F.col("__rescue"), "forced subtitle").when(av, F.col("__want.reason"))
               .when(t == "attachment", "attachment stream handled by attachment policy").otherwise("data stream"))
    out = (rows.withColumn("keep", keep).withColumn("reason", reason)
           .withColumn("out_default", F.when(t == "video", primary)
                       .when(t == "audio", F.col("keep") & (F.col("idx") == F.col("__default_at")))
                       .when(t == "subtitle", F.col("is_default")).otherwise(F.lit(False)))
           .withColumn("out_forced", F.when(av, F.col("forced")).otherwise(F.lit(False)))
           .withColumn("set_language", F.coalesce("__want.set_language", F.lit("")))
           .withColumn("clear_title", p["metadata.strip_track_titles"])
           .withColumn("has_video", F.col("__first_video").isNotNull()))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def decision_findings(decided: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long findings of a decision: extra video, no video, audio fallback, untagged parts."""
    t, idx, first = F.col("type"), F.col("idx"), F.col("idx") == F.col("first_part")
    big = LAST_SEQ
    checks = gather(
        finding(F.col("reason") == "secondary video stream", "policy", "VIDEO_EXTRA", WARN,
                text("stream #", idx, ": extra video stream dropped"), seq=idx),
        finding(first & ~F.col("has_video"), "policy", "NO_VIDEO", FAIL, "no video stream", seq=big - 2),
        finding(first & F.col("audio_fallback"), "policy", "AUDIO_FALLBACK", WARN,
                "no audio track matched the language policy; all audio kept", seq=big - 1),
        finding(F.col("keep") & t.isin("audio", "subtitle") & is_und(F.col("lang")) & (F.col("set_language") == ""),
                "policy", "UND_TRACK", PASS,
                text("stream #", idx, " (", t, ") has no language tag; kept as und (languages.und = keep)"), seq=big))
    return to_rows(decided, checks, *(keys or ["item_id"]), "idx")


# --- attachments ------------------------------------------------------------------------------------
def attachment_kind(mime: Column, file_name: Column) -> Column:
    m, e = F.lower(F.coalesce(mime, F.lit(""))), ext(file_name)
    return (F.when(m.isin(T.FONT_MIMES) | e.isin(T.FONT_EXTENSIONS), "font")
             .when(m.startswith("image/") | e.isin(T.IMAGE_EXTENSIONS), "image").otherwise("other"))


def attachment_action(kind: Column, has_text_sub: Column, p: Settings) -> Column:
    """struct(keep, block, reason)."""
    def out(keep, block, reason):
        return F.struct(F.lit(keep).alias("keep"), F.lit(block).alias("block"), F.lit(reason).alias("reason"))

    fonts = p["attachments.fonts"]
    font, image = kind == "font", kind == "image"
    return (F.when(font & (fonts == "keep"), out(True, False, "font kept"))
             .when(font & (fonts == "keep_if_text_subs") & has_text_sub, out(True, False, "font kept for text subtitles"))
             .when(font & (fonts == "keep_if_text_subs"), out(False, False, "font dropped: no text subtitles"))
             .when(font, out(False, False, "font dropped by policy"))
             .when(image & (p["attachments.cover_art"] == "keep"), out(True, False, "cover art kept"))
             .when(image, out(False, False, "cover art dropped by policy"))
             .when(p["attachments.other"] == "block", out(False, True, "non-font, non-image attachment"))
             .otherwise(out(False, False, "attachment dropped by policy")))


def decide_attachments(attachments: DataFrame, parts: DataFrame, p: Settings,
                       keys: list[str] | None = None) -> DataFrame:
    """Append kind, keep, block, reason to every attachment (item_id, att_id, file_name, mime, size)."""
    keys = keys or ["item_id"]
    text_parts = parts.filter((F.col("type") == "subtitle") & F.col("text_sub"))
    flagged = with_flag_from(attachments, text_parts, keys, "has_text_sub")
    acted = (flagged.withColumn("kind", attachment_kind(F.col("mime"), F.col("file_name")))
             .withColumn("__a", attachment_action(F.col("kind"), F.col("has_text_sub"), p)))
    return acted.withColumns({c: F.col(f"__a.{c}") for c in ("keep", "block", "reason")}).drop("__a")


def attachment_findings(decided: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Exactly one finding per attachment; a dangerous payload wins over every policy."""
    bad = attachment_payload(F.col("payload"))
    label = text("attachment #", F.col("att_id"), ' "', F.col("file_name"), '" (', F.col("mime"), ", ",
                 F.col("size"), " bytes)")
    code = (F.when(bad.isNotNull(), "ATTACH_EXEC").when(F.col("block"), "ATTACH_BLOCKED")
             .when(F.col("keep"), "ATTACH_OK").otherwise("ATTACH_DROP"))
    severity = F.when(bad.isNotNull() | F.col("block"), BLOCK).otherwise(PASS)
    message = F.when(bad.isNotNull(), text(label, " contains ", bad)).otherwise(text(label, ": ", F.col("reason")))
    return to_rows(decided, gather(finding(F.lit(True), "attachments", code, severity, message,
                                           seq=F.col("att_id"))), *(keys or ["item_id"]), "att_id")


# --- item level ----------------------------------------------------------------------------------------
def item_strips(items: DataFrame, p: Settings) -> DataFrame:
    return items.withColumns({"keep_chapters": p["chapters.keep"], "strip_title": p["metadata.strip_title"],
                              "strip_tags": p["metadata.strip_tags"],
                              "strip_provenance": p["metadata.strip_provenance"],
                              "clear_titles": p["metadata.strip_track_titles"]})


ACTION_SPAN = 1 << 40


def action_lines(decided: DataFrame, attachments: DataFrame | None, p: Settings,
                 keys: list[str] | None = None) -> DataFrame:
    """(item_id, rank, line): what will be done to every part and attachment, then chapters."""
    keys = keys or ["item_id"]
    verb = F.when(F.col("keep"), "keep").otherwise("drop")
    flags = text(F.when(F.col("keep") & F.col("out_default") & (F.col("type") != "video"), " default"),
                 F.when(F.col("keep") & F.col("out_forced"), " forced"),
                 F.when(F.col("set_language") != "", F.concat(F.lit(" lang="), F.col("set_language"))))
    lang = F.coalesce(F.nullif(F.lower(F.btrim("lang")), F.lit("")), F.lit("und"))
    lines = decided.filter(~F.col("type").isin("attachment", "data")).select(
        *keys, F.col("idx").cast("long").alias("rank"),
        text(verb, " #", F.col("idx"), " ", F.col("type"), " ", F.col("codec"), " ", lang, flags, ": ",
             F.col("reason")).alias("line"))
    chapters = decided.filter(F.col("idx") == F.col("first_part")).select(
        *keys, F.lit(2 * ACTION_SPAN).alias("rank"),
        F.when(p["chapters.keep"], "keep chapters").otherwise("drop chapters").alias("line"))
    lines = lines.unionByName(chapters)
    if attachments is not None:
        lines = lines.unionByName(attachments.select(
            *keys, (F.lit(ACTION_SPAN) + F.col("att_id")).alias("rank"),
            text(verb, " attachment #", F.col("att_id"), " ", F.col("file_name"), ": ", F.col("reason")).alias("line")))
    return lines


def action_entries(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ordinal, line): the actions of each item numbered in order, one row an action."""
    return ordered_entries(lines, keys or ["item_id"], "rank", F.col("line"), "line")


def action_list(lines: DataFrame, keys: list[str] | None = None, page: int = 4096) -> DataFrame:
    """Ordered action lists per item, in bounded pages."""
    return paged_lists(lines, keys or ["item_id"], "rank", F.col("line"), "actions", page)
