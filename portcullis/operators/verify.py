"""Verification: the output is compared with its source; nothing is trusted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import typed as N
from portcullis.functions.columns import let
from portcullis.functions.content import canonical_bytes
from portcullis.operators import metadata as M
from portcullis.operators.profiles import Settings
from portcullis.operators.spread import with_ordinal
from portcullis.schema import FAIL, PASS, finding, gather, text, to_rows

STREAM_TYPES = ["video", "audio", "subtitle"]


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def canonical_hash(body: Column) -> Column:
    """Digest of the decoded form, equal for copies that differ in framing only."""
    return F.sha2(canonical_bytes(body), 256)


def pair_parts(kept: DataFrame, output: DataFrame) -> DataFrame:
    """Kept source parts against output parts by (item, type, ordinal within type).

    Both sides: item_id, type, idx, raw_hash, canon_hash. The ordinal is part of the join key, so a
    hot item spreads over all tasks."""
    a = with_ordinal(kept.filter(F.col("type").isin(STREAM_TYPES)), ["item_id", "type"], "idx", "ordinal")
    b = with_ordinal(output.filter(F.col("type").isin(STREAM_TYPES)), ["item_id", "type"], "idx", "ordinal")
    b = b.select("item_id", "type", "ordinal", F.col("idx").alias("out_idx"),
                 F.col("raw_hash").alias("out_raw"), F.col("canon_hash").alias("out_canon"))
    return a.join(b, ["item_id", "type", "ordinal"], "full")


def compare_parts(pairs: DataFrame) -> DataFrame:
    """Append status: packet, decoded, mismatch, missing (no output part) or extra (no source part).

    ``same_family`` marks items whose framing may not change: there equal raw bytes are required."""
    both = F.col("idx").isNotNull() & F.col("out_idx").isNotNull()
    status = (F.when(both & (F.col("raw_hash") == F.col("out_raw")), "packet")
               .when(both & F.col("same_family"), "mismatch")
               .when(both & (F.col("canon_hash") == F.col("out_canon")), "decoded")
               .when(both, "mismatch").when(F.col("idx").isNotNull(), "missing").otherwise("extra"))
    return pairs.withColumn("status", status)


def verify_parts(compared: DataFrame, p: Settings) -> DataFrame:
    """HASH_OK with the number of parts where every kept part is paired and equal; VERIFY_FAIL where parts are
    missing or extra, which is settled before any hash; else HASH_MISMATCH for the first that differs."""
    on = p["verify.stream_hash"] & (p["verify.tier"] != "none")
    status = F.col("status")
    sums = compared.filter(on).groupBy("item_id").agg(
        F.sum(F.when(status.isin("packet", "decoded"), 1).otherwise(0)).alias("n"),
        F.sum(F.when(status == "missing", 1).otherwise(0)).alias("missing"),
        F.sum(F.when(status == "extra", 1).otherwise(0)).alias("extra"),
        F.min(F.when(status == "mismatch", F.struct("idx", "type"))).alias("bad"))
    unpaired = (F.col("missing") > 0) | (F.col("extra") > 0)
    return to_rows(sums, gather(
        finding(unpaired, "verify", "VERIFY_FAIL", FAIL,
                text(F.col("missing"), " kept stream(s) missing from output, ", F.col("extra"), " not in source")),
        finding(~unpaired & F.col("bad").isNotNull(), "verify", "HASH_MISMATCH", FAIL,
                text("stream #", F.col("bad.idx"), " (", F.col("bad.type"), ") differs from source")),
        finding(~unpaired & F.col("bad").isNull(), "verify", "HASH_OK", PASS,
                text(F.col("n"), " stream(s) verified identical to source"))), "item_id")


def verify_counts(kept: DataFrame, output: DataFrame) -> DataFrame:
    """(item_id, type, want, got): kept parts against output parts. One union and one aggregation
    replace a join of two aggregates."""
    tagged = kept.select("item_id", "type", F.lit(1).alias("w"), F.lit(0).alias("g")).unionByName(
        output.select("item_id", "type", F.lit(0).alias("w"), F.lit(1).alias("g")))
    return (tagged.filter(F.col("type").isin(STREAM_TYPES)).groupBy("item_id", "type")
            .agg(F.sum("w").alias("want"), F.sum("g").alias("got")))


def verify_structure(counts: DataFrame) -> DataFrame:
    """VERIFY_FAIL for the first part type whose number differs."""
    rank = F.array_position(F.array(*[F.lit(t) for t in STREAM_TYPES]), F.col("type"))
    worst = counts.filter(F.col("want") != F.col("got")).groupBy("item_id").agg(
        F.min(F.struct(rank.alias("r"), "type", "want", "got")).alias("b"))
    return to_rows(worst, gather(finding(
        F.lit(True), "verify", "VERIFY_FAIL", FAIL,
        text("expected ", F.col("b.want"), " ", F.col("b.type"), " stream(s), output has ", F.col("b.got")))), "item_id")


def verify_item(pair: DataFrame) -> DataFrame:
    """VERIFY_FAIL findings of item level: attachments, chapters, tags, title, applications.

    ``pair`` has one row per item: keep_chapters, strip_*, src_chapters and the out_* facts; the
    first rule that fails is reported."""
    c = F.col
    rules = [
        ((c("out_attachments") > 0) & (c("out_attachments") != c("kept_attachments")),
         text("expected ", c("kept_attachments"), " attachment(s), output has ", c("out_attachments"))),
        (~c("keep_chapters") & (c("out_chapters") > 0), F.lit("chapters present in output")),
        (c("keep_chapters") & (c("src_chapters") > 0) & (c("out_chapters") == 0), F.lit("chapters lost in output")),
        (c("strip_tags") & ((c("out_global_tags") > 0) | (c("out_track_tags") > 0)),
         text("tags present in output (", c("out_global_tags"), " global, ", c("out_track_tags"), " track)")),
        (c("strip_title") & (c("out_title") != ""), F.lit("title present in output")),
        (c("strip_provenance") & ((c("out_muxing_app") != "") | (c("out_writing_app") != "")),
         F.lit("muxing/writing application still set"))]
    message = F.when(rules[0][0], rules[0][1])
    for condition, said in rules[1:]:
        message = message.when(condition, said)
    return to_rows(pair, gather(finding(message.isNotNull(), "verify", "VERIFY_FAIL", FAIL, message, seq=1)), "item_id")


# --- struct diff --------------------------------------------------------------------------------
_NUMBERS, _WHOLE = M.COORDINATES + M.LUMINANCE, M.LIGHT + M.CONFIG
_EXTRA = ["chromaticity_coordinates", "luminance", "white_coordinates"]


def struct_diff(src: Column, out: Column) -> Column:
    """Every field lost, gained or changed between two signal structs, in plain words.

    A group present on one side only is one entry; its members are not listed again."""
    def present(s, members):
        c = s[members[0]].isNotNull()
        for m in members[1:]:
            c = c | s[m].isNotNull()
        return c

    lost_or_gained, skip = [], {}
    for name, (members, prefixes) in M.GROUP_NAMES.items():
        a, b = present(src, members), present(out, members)
        lost_or_gained.append(F.when(a & ~b, f"{name} lost").when(~a & b, f"{name} gained"))
        for n in M.NAMES + _NUMBERS + _WHOLE + _EXTRA:
            if n.startswith(prefixes):
                skip[n] = a != b

    def flawed(s, n):
        return F.array_contains(s["malformed"], n)

    def entry(n):
        """One field on both sides: its number or its text, whether it was rejected, whether it counts."""
        def side(s, x):
            number = s[n] if n in _NUMBERS else F.lit(None).cast("double")
            words = (F.nullif(s[n], F.lit("")) if n in M.NAMES else
                     s[n].cast("string") if n in _WHOLE else F.lit(None).cast("string"))
            return [number.alias(f"{x}num"), words.alias(f"{x}text"), flawed(s, n).alias(f"{x}bad")]
        return F.struct(F.lit(n).alias("name"), skip.get(n, F.lit(False)).alias("skip"), *side(src, "a"), *side(out, "b"))

    def spoken(e, x):
        return F.coalesce(e[f"{x}text"], N.shown(e[f"{x}num"]))

    def here(e, x):
        return e[f"{x}num"].isNotNull() | e[f"{x}text"].isNotNull()

    def changed(e):
        def write(p):
            twin = (p["a"] == p["b"]) & e["anum"].isNotNull()
            both = F.coalesce(~N.close_enough(e["anum"], e["bnum"]), p["a"] != p["b"])
            return F.when(both, text(e["name"], " changed from ", p["a"], F.when(twin, text(" (", N.exact(e["anum"]), ")")),
                                     " to ", p["b"], F.when(twin, text(" (", N.exact(e["bnum"]), ")"))))
        return let(F.struct(spoken(e, "a").alias("a"), spoken(e, "b").alias("b")), write)

    def lost(e):
        a, b = here(e, "a"), here(e, "b")
        return (F.when(e["skip"] | ~a, F.lit(None).cast("string"))
                 .when(e["bbad"], text(e["name"], " changed from ", spoken(e, "a"), " to malformed"))
                 .when(~b, text(e["name"], " lost (was ", spoken(e, "a"), ")")).otherwise(changed(e)))

    def lost_flaw(e):
        b = here(e, "b")
        return F.when(~e["skip"] & e["abad"] & ~e["bbad"], F.when(
            b, text(e["name"], " changed from malformed to ", spoken(e, "b"))).otherwise(text(e["name"], " lost (was malformed)")))

    def gained(e):
        return F.when(~e["skip"] & here(e, "b") & ~here(e, "a") & ~e["abad"], text(e["name"], " gained (now ", spoken(e, "b"), ")"))

    def gained_flaw(e):
        return F.when(~e["skip"] & e["bbad"] & ~e["abad"] & ~here(e, "a"), text(e["name"], " gained (now malformed)"))

    def differs(e):
        return ~e["skip"] & ((e["abad"] != e["bbad"]) | ~e["atext"].eqNullSafe(e["btext"])
                             | (e["anum"].isNull() != e["bnum"].isNull())
                             | F.coalesce(~N.close_enough(e["anum"], e["bnum"]), F.lit(False)))

    fields = F.array(*[entry(n) for n in M.NAMES + _NUMBERS + _WHOLE + _EXTRA])
    ordered = lambda es: F.array_sort(es, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    flaws = lambda es: ordered(F.filter(es, lambda e: e["abad"] | e["bbad"]))
    # Most fields agree: they are dropped before any sentence is put together.
    diff = let(F.filter(fields, differs), lambda es: F.array_compact(F.concat(
        F.array(*lost_or_gained), F.transform(es, lost), F.transform(flaws(es), lost_flaw),
        F.transform(es, gained), F.transform(flaws(es), gained_flaw))))
    return F.when(src == out, F.array().cast("array<string>")).otherwise(diff)


def label_diff(src: Column, out: Column) -> Column:
    """Sentence about signal families that differ, NULL when they agree."""
    a, b = F.array_join(src, "+"), F.array_join(out, "+")
    show = lambda x: F.when(x == "", "none").otherwise(x)
    return F.when(a != b, text("source video is ", show(a), ", output is ", show(b)))


def verify_labels(pairs: DataFrame) -> DataFrame:
    """HDR_LOST where the signal families of a kept video part (``src_labels``) are not those of its output
    (``out_labels``)."""
    said = label_diff(F.col("src_labels"), F.col("out_labels"))
    return to_rows(pairs, gather(finding(said.isNotNull(), "verify", "HDR_LOST", FAIL, said, seq=F.col("idx"))), "item_id", "idx")


def first_failure(steps: DataFrame) -> DataFrame:
    """The battery of an item ends at its first failure: ``steps`` holds the findings of all checks with ``step``,
    the place of the check; later steps of an item are dropped."""
    ends = steps.groupBy("item_id").agg(F.min(F.when(F.col("severity") >= FAIL, F.col("step"))).alias("__end"))
    return (steps.join(ends, "item_id").where(F.col("__end").isNull() | (F.col("step") <= F.col("__end"))).drop("__end"))


def stale_findings(checked: DataFrame) -> DataFrame:
    """CLEAN_FAIL or REMUX_FAIL for items that are no longer what was scanned; ``checked`` is still_current's
    result with ``route``."""
    code = F.when(F.col("route") == "clean", "CLEAN_FAIL").otherwise("REMUX_FAIL")
    return to_rows(checked.where(F.col("route").isin("clean", "remux")), gather(
        finding(~F.col("fresh"), "place", code, FAIL, text("not touched: ", F.col("why")))), "item_id")


def still_current(decided: DataFrame, current: DataFrame) -> DataFrame:
    """Append ``fresh`` and ``why``: a verdict holds only for the version it was made on.

    Both sides have one row per item: item_id, length, modified, digest."""
    now = current.select("item_id", F.lit(True).alias("__there"), F.col("length").alias("__l"),
                         F.col("modified").alias("__m"), F.col("digest").alias("__d"))
    j = decided.join(now, "item_id", "left")
    same = (F.col("length").eqNullSafe(F.col("__l")) & F.col("modified").eqNullSafe(F.col("__m"))
            & F.col("digest").eqNullSafe(F.col("__d")))
    return (j.withColumn("why", F.when(F.col("__there").isNull(), "vanished").when(~same, "changed since the scan")
                         .otherwise("")).withColumn("fresh", F.col("why") == "")
            .drop("__there", "__l", "__m", "__d"))
