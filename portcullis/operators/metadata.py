"""Metadata: provenance, merged descriptions, typed signal groups, part checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions import typed as N
from portcullis.functions.columns import is_und, let, lookup, string_list
from portcullis.functions.content import sniff
from portcullis.operators.checks import graded
from portcullis.operators.profiles import Settings
from portcullis.operators.spread import with_ordinal, with_stats
from portcullis.schema import BLOCK, FAIL, LAST_SEQ, PASS, finding, gather, text, to_rows

_NO_STRINGS = "array<string>"


# --- provenance ------------------------------------------------------------------------------
def provenance_keys(attrs: Column) -> Column:
    """Sorted identifying keys of a metadata map."""
    known = string_list(list(T.PROVENANCE_KEYS))
    return F.array_sort(F.filter(F.map_keys(attrs), lambda k: F.array_contains(known, k)
                                 | k.startswith(T.FREEFORM_PREFIX)))


def _entry(attrs: Column, k: Column) -> Column:
    about = F.coalesce(lookup(k, T.PROVENANCE_KEYS), F.lit("freeform metadata"))
    value = F.try_element_at(attrs, k)
    quoted = (value != "") & (F.octet_length(value) < 80)
    return text(F.btrim(k), " (", about, ")", F.when(quoted, F.concat(F.lit(" = "), value)))


def provenance(attrs: Column, has_xmp: Column, p: Settings) -> Column:
    """Findings about identifying metadata; encoder keys are only a fingerprint."""
    keys = provenance_keys(attrs)
    tool = string_list(T.TOOL_KEYS)
    ident = F.transform(F.filter(keys, lambda k: ~F.array_contains(tool, k)), lambda k: _entry(attrs, k))
    tools = F.transform(F.filter(keys, lambda k: F.array_contains(tool, k)), lambda k: _entry(attrs, k))
    grade = graded(p["metadata.provenance"])
    return gather(
        finding(F.size(ident) > 0, "provenance", "PURCHASE_ATOM", grade,
                text(F.size(ident), " identifying metadata atom(s): ", F.array_join(ident, "; ")),
                F.array_join(ident, "\n")),
        finding(has_xmp, "provenance", "PURCHASE_ATOM", grade, "XMP metadata box present", seq=1),
        finding(F.size(tools) > 0, "provenance", "PROVENANCE_INFO", PASS,
                text("encoder fingerprint: ", F.array_join(tools, "; ")), seq=2))


def provenance_info(tags: Column, title: Column, writing_app: Column, muxing_app: Column,
                    global_tags: Column, track_tags: Column) -> Column:
    """PASS summary of what the metadata says about the item's origin."""
    none = F.array().cast(_NO_STRINGS)

    def given(label, value):
        return F.when(F.coalesce(value, F.lit("")) != "", F.array(text(label, value))).otherwise(none)

    def counted(n, label):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.array(text(n, label))).otherwise(none)

    named = F.transform(F.filter(F.map_keys(tags), lambda k: F.lower(k).isin(T.INFO_TAGS)),
                        lambda k: text(k, "=", F.try_element_at(tags, k)))
    pieces = F.array_sort(F.concat(given("writing app ", writing_app), given("muxing app ", muxing_app), named,
                                   counted(global_tags, " global tag(s)"), counted(track_tags, " track tag(s)"),
                                   given("title ", title)))
    return finding(F.size(pieces) > 0, "info", "PROVENANCE_INFO", PASS, F.array_join(pieces, "; "))


# --- two descriptions of one item -----------------------------------------------------------------
FILLED = ["title"]                 # the second source fills what the first leaves empty
JOINED = ["commentary", "hearing_imp", "visual_imp", "original"]
OVERRIDDEN = ["is_default", "forced"]


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pair the parts of two descriptions by (item, type, ordinal within type) and merge them.

    ``first`` carries ``container``; parts the second source does not know stay as they are."""
    a = with_ordinal(first, ["item_id", "type"], "idx", "ordinal")
    b = with_ordinal(second, ["item_id", "type"], "idx", "ordinal")
    b = b.select("item_id", "type", "ordinal", F.col("idx").alias("second_idx"),
                 *[F.col(c).alias(f"b_{c}") for c in ["lang", "ietf", *FILLED, *JOINED, *OVERRIDDEN, "text_sub"]])
    j = a.filter(F.col("type") != "attachment").join(b, ["item_id", "type", "ordinal"], "left")
    hit = F.col("second_idx").isNotNull()
    lang_b = F.coalesce(F.nullif(F.lower(F.btrim("b_lang")), F.lit("")), F.lit("und"))
    lang_a = F.coalesce(F.nullif(F.lower(F.btrim("lang")), F.lit("")), F.lit("und"))
    header = F.col("container").isin("matroska", "webm")
    cols = {"lang": F.when(hit & (lang_a == "und") & (F.coalesce("b_lang", F.lit("")) != ""), lang_b).otherwise(lang_a),
            "ietf": F.when(hit & (F.coalesce("b_ietf", F.lit("")) != ""), F.col("b_ietf")).otherwise(F.col("ietf")),
            "text_sub": F.col("text_sub") | F.coalesce((F.col("type") == "subtitle") & F.col("b_text_sub"), F.lit(False))}
    for c in FILLED:
        cols[c] = F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"b_{c}"), F.lit(""))
    for c in JOINED:
        cols[c] = F.col(c) | F.coalesce(F.col(f"b_{c}"), F.lit(False))
    for c in OVERRIDDEN:
        cols[c] = F.when(hit & header, F.col(f"b_{c}")).otherwise(F.col(c))
    merged = j.withColumns(cols).withColumn("second_idx", F.coalesce("second_idx", F.lit(-1)))
    return merged.drop(*[c for c in merged.columns if c.startswith("b_")])


# --- typed signal groups ------------------------------------------------------------------------
NAMES = ["primaries", "transfer", "matrix", "range"]
COORDINATES = ["red_x", "red_y", "green_x", "green_y", "blue_x", "blue_y", "white_x", "white_y"]
LUMINANCE = ["min_luminance", "max_luminance"]
LIGHT = ["max_cll", "max_fall"]
CONFIG = ["dv_profile", "dv_level", "dv_rpu", "dv_el", "dv_bl", "dv_bl_signal_compatibility_id"]
SIGNAL_TYPE = ("struct<" + ",".join([*(f"{n}:string" for n in NAMES), *(f"{n}:double" for n in COORDINATES + LUMINANCE),
                                     *(f"{n}:int" for n in LIGHT + CONFIG), "malformed:array<string>"]) + ">")
GROUP_NAMES = {"mastering display metadata": (COORDINATES + LUMINANCE, ("red_", "green_", "blue_", "white_",
                                                                        "min_luminance", "max_luminance")),
               "content light level": (LIGHT, ("max_cll", "max_fall")),
               "dolby vision configuration": (CONFIG, ("dv_",))}
VETO = {**{n: [n] for n in NAMES},
        **{n: COORDINATES + ["chromaticity_coordinates", "white_coordinates"] for n in COORDINATES},
        **{n: ["luminance", *LUMINANCE] for n in LUMINANCE},
        **{n: LIGHT for n in LIGHT}, **{n: CONFIG for n in CONFIG}}


def _signal(values: dict, malformed: Column) -> Column:
    fields = [values[n].alias(n) for n in NAMES + COORDINATES + LUMINANCE + LIGHT + CONFIG]
    return F.struct(*fields, malformed.alias("malformed")).cast(SIGNAL_TYPE)


def json_entries(raw: Column) -> Column:
    """Objects of a JSON list; anything else in it is skipped, a list of another shape is empty."""
    listed = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    return F.filter(F.coalesce(listed, F.array().cast("array<variant>")),
                    lambda e: F.schema_of_variant(e).startswith("OBJECT"))


def _first_of(entries: Column, word: str) -> Column:
    hit = F.filter(entries, lambda e: F.lower(F.coalesce(F.try_variant_get(e, "$.side_data_type", "string"),
                                                         F.lit(""))).contains(word))
    return F.get(hit, F.lit(0))


def _parsed(**fields: Column):
    """Named values computed once, for rules that name each of them many times."""
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def extract_groups(names: dict[str, Column], side_data: Column) -> Column:
    """Signal struct of one part: plain names plus the groups of its side-data list.

    The first entry of a kind wins. A group is all or nothing: a partial or invalid one holds no
    value and the rejected names are listed."""
    keys = {**{n: n.replace("white_", "white_point_") for n in COORDINATES}, **{n: n for n in LUMINANCE},
            "max_cll": "max_content", "max_fall": "max_average",
            "dv_profile": "dv_profile", "dv_level": "dv_level", "dv_rpu": "rpu_present_flag",
            "dv_el": "el_present_flag", "dv_bl": "bl_present_flag",
            "dv_bl_signal_compatibility_id": "dv_bl_signal_compatibility_id"}
    top = {"max_cll": T.MAX_CONTENT_LIGHT, "max_fall": T.MAX_CONTENT_LIGHT, "dv_profile": T.MAX_DV_PROFILE,
           "dv_level": T.MAX_DV_LEVEL, "dv_rpu": 1, "dv_el": 1, "dv_bl": 1,
           "dv_bl_signal_compatibility_id": T.MAX_DV_COMPAT}
    owner = {**{n: "m" for n in COORDINATES + LUMINANCE}, **{n: "c" for n in LIGHT}, **{n: "d" for n in CONFIG}}

    def groups(entries):
        return _parsed(m=_first_of(entries, "mastering display"), c=_first_of(entries, "content light"),
                       d=_first_of(entries, "dovi configuration"))

    def fields(g):
        out = {n: N.parse_enum(names[n]) for n in NAMES}
        for n, k in keys.items():
            e = g[owner[n]]
            raw = F.try_variant_get(e, f"$.{k}", "string")
            out[n] = (N.parse_int(raw, top[n]) if n in top
                      else N.parse_bounded(raw, 0.0, 1.0 if n in COORDINATES else T.MAX_LUMINANCE))
            out[f"has_{n}"] = F.coalesce(F.try_variant_get(e, f"$.{k}", "variant").isNotNull(), F.lit(False))
        return _parsed(**out, has_dv=g["d"].isNotNull())

    def judge(r):
        def every(ns, test):
            c = test(ns[0])
            for n in ns[1:]:
                c = c & test(n)
            return c

        valued, given = (lambda n: r[n].isNotNull()), (lambda n: r[f"has_{n}"])
        some = lambda ns: ~every(ns, lambda n: ~given(n))
        values = {n: F.coalesce(r[n], F.lit("")) for n in NAMES}
        for group in (COORDINATES, LUMINANCE, LIGHT, CONFIG):
            whole = every(group, valued)
            values.update({n: F.when(whole, r[n]) for n in group})
        bad = {n: r[n].isNull() for n in NAMES}
        bad.update({n: given(n) & r[n].isNull() for n in COORDINATES + LUMINANCE})
        bad["chromaticity_coordinates"] = some(COORDINATES) & ~every(COORDINATES, given)
        bad["luminance"] = some(LUMINANCE) & ~every(LUMINANCE, valued)
        bad.update({n: some(LIGHT) & r[n].isNull() for n in LIGHT})
        bad.update({n: r["has_dv"] & r[n].isNull() for n in CONFIG})
        return _signal(values, N.malformed(**bad))

    return let(let(let(json_entries(side_data), groups), fields), judge)


def header_groups(props: Column) -> Column:
    """Signal struct of a track header's property map (JSON text values): coded names, coordinate
    lists, alternate key spellings with the first one given winning. The map is built once a row, not for every key."""
    return let(props, _header_groups)


def _header_groups(props: Column) -> Column:
    def get(*keys):
        return F.coalesce(*[F.try_element_at(props, F.lit(k)) for k in keys])

    stems = {"primaries": "_primaries", "transfer": "_transfer_characteristics", "matrix": "_matrix_coefficients",
             "range": "_range"}
    raw_xy, raw_white = get("chromaticity_coordinates"), get("white_colour_coordinates", "white_color_coordinates")
    light = {"max_cll": "max_content_light", "max_fall": "max_frame_light"}
    fields = {n: N.coded(get("colour" + s, "color" + s), n) for n, s in stems.items()}
    fields.update(xy=N.coordinate_list(raw_xy, 6), white=N.coordinate_list(raw_white, 2), has_xy=raw_xy.isNotNull(),
                  has_white=raw_white.isNotNull())
    fields.update({n: N.parse_bounded(get(n), 0.0, T.MAX_LUMINANCE) for n in LUMINANCE})
    fields.update({n: N.parse_int(get(k), T.MAX_CONTENT_LIGHT) for n, k in light.items()})
    fields["has_lum"] = get("min_luminance").isNotNull() | get("max_luminance").isNotNull()
    fields["has_light"] = get("max_content_light").isNotNull() | get("max_frame_light").isNotNull()

    def judge(r):
        values = {n: F.coalesce(r[n], F.lit("")) for n in NAMES}
        bad = {n: r[n].isNull() for n in NAMES}
        xy, white = r["xy"], r["white"]
        whole = xy.isNotNull() & white.isNotNull()
        for i, n in enumerate(COORDINATES):
            values[n] = F.when(whole, xy[i] if i < 6 else white[i - 6])
        bad["chromaticity_coordinates"] = F.when(r["has_xy"], xy.isNull()).otherwise(r["has_white"])
        bad["white_coordinates"] = xy.isNotNull() & white.isNull()
        both = r["min_luminance"].isNotNull() & r["max_luminance"].isNotNull()
        values.update({n: F.when(both, r[n]) for n in LUMINANCE})
        bad["luminance"] = r["has_lum"] & ~both
        lit = r["max_cll"].isNotNull() & r["max_fall"].isNotNull()
        values.update({n: F.when(lit, r[n]) for n in LIGHT})
        bad.update({n: r["has_light"] & r[n].isNull() for n in LIGHT})
        values.update({n: F.lit(None) for n in CONFIG})
        return _signal(values, N.malformed(**bad))

    return let(_parsed(**fields), judge)


def fill_missing(a: Column, b: Column) -> Column:
    """The first signal, filled group by group from the second; a name malformed on either side
    holds no value."""
    names = F.array_sort(F.array_union(a["malformed"], b["malformed"]))
    values = {}
    for n in NAMES:
        values[n] = F.when(F.array_contains(names, n), "").when(a[n] == "", b[n]).otherwise(a[n])
    for group in (COORDINATES, LUMINANCE, LIGHT, CONFIG):
        veto = F.arrays_overlap(names, string_list(VETO[group[0]]))
        for n in group:
            other = b[n] if group is not CONFIG else F.lit(None)
            values[n] = F.when(veto, F.lit(None)).when(a[group[0]].isNotNull(), a[n]).otherwise(other)
    return _signal(values, names)


def signal_text(s: Column) -> Column:
    """Every value of a signal as name=value pairs in fixed order."""
    pairs = [F.when(s[n] != "", text(n, "=", s[n])) for n in NAMES]
    pairs += [F.when(s[n].isNotNull(), text(n, "=", N.shown(s[n]))) for n in COORDINATES + LUMINANCE]
    pairs += [F.when(s[n].isNotNull(), text(n, "=", s[n])) for n in LIGHT + CONFIG]
    return F.concat_ws(" ", *pairs, F.transform(s["malformed"], lambda m: text(m, "=malformed")))


# --- part checks ------------------------------------------------------------------------------------
def check_parts(parts: DataFrame, p: Settings, keys: list[str] | None = None) -> DataFrame:
    """Long findings about the parts of items; ``parts`` carries ``category`` and ``container`` of
    its item, ``labels`` (signal families), ``codec`` and ``codec_tag``."""
    keys = keys or ["item_id"]
    stats = with_stats(parts, keys, {
        "__video": ("max", (F.col("type") == "video") & ~F.col("attached_pic")),
        "__audio": ("max", F.col("type") == "audio"),
        "__first": ("min", F.col("idx"))})
    t, idx = F.col("type"), F.col("idx")
    und = is_und(F.col("lang")) & is_und(F.col("ietf"))
    first = idx == F.col("__first")
    checks = gather(
        finding((t == "video") & ~F.col("attached_pic") & (F.size("labels") > 0), "parts", "HDR", PASS,
                text("stream #", idx, ": ", F.array_join("labels", "+")), seq=idx),
        finding(t.isin("audio", "subtitle") & und, "parts", "UND_TRACK", PASS,
                text("stream #", idx, " ", t, " has no language tag"), seq=idx),
        finding((t == "data") & ~F.array_contains(p["streams.allow_data_tags"], F.lower(F.col("codec_tag"))),
                "parts", "DATA_STREAM", BLOCK,
                text("stream #", idx, " is a data stream (codec=", F.col("codec"), ' tag="', F.col("codec_tag"),
                     '"); allow with streams.allow_data_tags'), seq=idx),
        finding((t == "attachment") & ~F.col("container").isin("matroska", "webm"), "parts", "ATTACH_BLOCKED",
                BLOCK, text("stream #", idx, " is an attachment in a non-Matroska container"), seq=idx),
        finding(first & (F.col("category") == "video") & ~F.col("__video"), "parts", "NO_VIDEO", FAIL,
                "no video stream in a video container", seq=LAST_SEQ),
        finding(first & (F.col("category") == "audio") & ~F.col("__audio"), "parts", "NO_AUDIO", FAIL,
                "no audio stream in an audio container", seq=LAST_SEQ))
    return to_rows(stats, checks, *keys)


def attachment_payload(payload: Column) -> Column:
    """'kind detail' of a dangerous attachment payload, NULL otherwise. The head is sniffed whatever the
    declared size."""
    s = sniff(payload)
    return F.when(s["kind"].isin(T.DANGEROUS_KINDS),
                  text(s["kind"], " ", s["detail"]))
