"""Queries of provenance, merging and typed parsing."""
from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions import typed as N
from portcullis.functions.columns import LANGUAGE_ALIASES, canonical_lang, container_of, is_und, tag_ci
from portcullis.operators import checks as K
from portcullis.operators import metadata as M
from portcullis.operators.profiles import Profile, Settings
from portcullis.queries.base import (EVENT_ATTRS_SQL, ITEMS_SQL, ORDER_PARTS_SQL, by_rest, documents_items, event_attrs,
                                     order_parts, query, rows, sql_by_rest, sql_list, sql_str, table)

P = Settings.of(Profile.load("homelab"))
STRICT = Settings.of(Profile.load("strict"))

ALIAS_SQL = "alias(code, canon) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_ALIASES.items()) + ")"


def lang_sql(c: str) -> str:
    short = f"regexp_extract(lower(trim({c})), '^(.[^_-]*)', 1)"
    return (f"CASE WHEN trim({c}) = '' THEN 'und' ELSE coalesce((SELECT canon FROM alias al WHERE al.code = {short}), {short}) END")


_KNOWN = "known(key, about) AS (VALUES " + ", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in T.PROVENANCE_KEYS.items()) + ")"
_ENTRIES = f"""entries AS (SELECT item_id, a.key, trim(a.key) || ' (' || coalesce(about, 'freeform metadata') || ')' ||
    CASE WHEN value <> '' AND strlen(value) < 80 THEN ' = ' || value ELSE '' END AS e, a.key IN {sql_list(T.TOOL_KEYS)} AS tool
  FROM attrs a LEFT JOIN known k ON a.key = k.key WHERE k.key IS NOT NULL OR a.key LIKE '----:%')"""


@query("m01_provenance", f"""WITH {EVENT_ATTRS_SQL}, {_KNOWN}, {_ENTRIES}
 SELECT item_id, 'PURCHASE_ATOM' AS code, 3 AS severity, count(*) || ' identifying metadata atom(s): ' || string_agg(e, '; ' ORDER BY key) AS message FROM entries WHERE NOT tool GROUP BY item_id
 UNION ALL SELECT item_id, 'PURCHASE_ATOM', 3, 'XMP metadata box present' FROM ev WHERE has_xmp
 UNION ALL SELECT item_id, 'PROVENANCE_INFO', 0, 'encoder fingerprint: ' || string_agg(e, '; ' ORDER BY key) FROM entries WHERE tool GROUP BY item_id""")
def _(spark, sf):
    a = event_attrs(spark, sf)
    return K.to_rows(a, M.provenance(F.col("tags"), F.col("has_xmp"), STRICT), "item_id").select("item_id", "code", "severity", "message")


@query("m02_provenance_info", f"""WITH {EVENT_ATTRS_SQL}, p AS (
  SELECT item_id, 'writing app ' || writing_app AS s FROM ev WHERE writing_app <> '' UNION ALL SELECT item_id, 'muxing app ' || muxing_app FROM ev WHERE muxing_app <> ''
  UNION ALL SELECT item_id, key || '=' || value FROM attrs WHERE lower(key) IN {sql_list(T.INFO_TAGS)}
  UNION ALL SELECT item_id, global_tags || ' global tag(s)' FROM ev WHERE global_tags > 0 UNION ALL SELECT item_id, track_tags || ' track tag(s)' FROM ev WHERE track_tags > 0
  UNION ALL SELECT item_id, 'title ' || title FROM ev WHERE title <> '')
 SELECT item_id, 'PROVENANCE_INFO' AS code, 0 AS severity, string_agg(s, '; ' ORDER BY s) AS message FROM p GROUP BY item_id""")
def _(spark, sf):
    c = F.col
    return rows(event_attrs(spark, sf), M.provenance_info(c("tags"), c("title"), c("writing_app"), c("muxing_app"),
                                                           c("global_tags"), c("track_tags")))


@query("m03_tag_ci", f"""WITH {EVENT_ATTRS_SQL} SELECT ev.item_id, coalesce((SELECT value FROM attrs a WHERE a.item_id = ev.item_id AND lower(key) = 'description'), '') AS description,
  coalesce((SELECT value FROM attrs a WHERE a.item_id = ev.item_id AND lower(key) = 'encoder'), '') AS encoder FROM ev""")
def _(spark, sf):
    return event_attrs(spark, sf).select("item_id", tag_ci(F.col("tags"), "description").alias("description"),
                                         tag_ci(F.col("tags"), "encoder").alias("encoder"))


_CODES = ["-US", "", "_x", " ", "eutsch"]


@query("m04_canonical_lang", f"""WITH {ALIAS_SQL}, c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN 'unknown'
    WHEN doc_id % 7 = 2 THEN upper(lang) || {sql_by_rest('doc_id', 5, _CODES, '')} WHEN doc_id % 7 = 3 THEN '-' || lang ELSE lang || {sql_by_rest('doc_id', 5, _CODES, '')} END AS code FROM documents)
 SELECT doc_id, {lang_sql('c.code')} AS lang, {lang_sql('c.code')} IN ('und', 'unknown') AS und FROM c""")
def _(spark, sf):
    d, tail = F.col("doc_id"), by_rest(F.col("doc_id"), 5, _CODES, "")
    code = (F.when(d % 7 == 0, "").when(d % 7 == 1, "unknown").when(d % 7 == 2, F.concat(F.upper("lang"), tail))
             .when(d % 7 == 3, F.concat(F.lit("-"), "lang")).otherwise(F.concat("lang", tail)))
    return table(spark, sf, "documents").withColumn("code", code).select(
        "doc_id", canonical_lang(F.col("code")).alias("lang"), is_und(F.col("code")).alias("und"))


_FORMATS = ["matroska,webm", "mov,mp4,m4a,3gp,3g2,mj2", "mpegts", "mpeg", "avi", "srt", "webvtt", "x,y", "mp3", ""]


@query("m05_container_of", f"""WITH f AS (SELECT l_partkey, {sql_by_rest('l_partkey', 10, _FORMATS, '')} AS fmt FROM lineitem)
 SELECT fmt, CASE fmt WHEN 'matroska,webm' THEN 'matroska' WHEN 'mov,mp4,m4a,3gp,3g2,mj2' THEN 'mp4' WHEN 'mpeg' THEN 'mpegps' WHEN 'srt' THEN 'subtitle'
   WHEN 'webvtt' THEN 'subtitle' ELSE string_split(fmt, ',')[1] END AS container, count(*) AS n FROM f GROUP BY ALL""")
def _(spark, sf):
    f = table(spark, sf, "lineitem").select(by_rest(F.col("l_partkey"), 10, _FORMATS, "").alias("fmt"))
    return f.groupBy("fmt", container_of(F.col("fmt")).alias("container")).agg(F.count("*").alias("n"))


@query("m06_merge_sources", f"""WITH {ORDER_PARTS_SQL},
 a AS (SELECT *, CASE WHEN CAST(item_id AS BIGINT) % 2 = 0 THEN 'matroska' ELSE 'mp4' END AS container, row_number() OVER (PARTITION BY item_id, type ORDER BY idx) AS o FROM parts),
 b AS (SELECT item_id, type, idx * 10 AS idx, CASE WHEN lang = '' THEN 'FR' ELSE lang END AS lang, ietf, 'T' || idx AS title, NOT is_default AS is_default, NOT forced AS forced,
     hearing_imp, idx % 2 = 0 AS commentary, row_number() OVER (PARTITION BY item_id, type ORDER BY idx) AS o FROM parts WHERE idx % 3 <> 0)
 SELECT a.item_id, a.idx, CASE WHEN a.lang <> '' THEN lower(a.lang) ELSE coalesce(lower(b.lang), 'und') END AS lang,
   CASE WHEN coalesce(b.ietf, '') <> '' THEN b.ietf ELSE a.ietf END AS ietf,
   CASE WHEN a.title <> '' THEN a.title ELSE coalesce(b.title, '') END AS title, CASE WHEN container = 'matroska' AND b.idx IS NOT NULL THEN b.is_default ELSE a.is_default END AS is_default,
   CASE WHEN container = 'matroska' AND b.idx IS NOT NULL THEN b.forced ELSE a.forced END AS forced, a.commentary OR coalesce(b.commentary, false) AS commentary, coalesce(b.idx, -1) AS second_idx
 FROM a LEFT JOIN b USING (item_id, type, o)""")
def _(spark, sf):
    parts = order_parts(spark, sf)
    first = parts.withColumn("container", F.when(F.col("item_id").cast("long") % 2 == 0, "matroska").otherwise("mp4"))
    i = F.col("idx")
    second = parts.filter(i % 3 != 0).withColumns({
        "lang": F.when(F.col("lang") == "", "FR").otherwise(F.col("lang")), "title": F.concat(F.lit("T"), i.cast("string")),
        "is_default": ~F.col("is_default"), "forced": ~F.col("forced"), "commentary": i % 2 == 0, "idx": i * 10})
    return M.merge_sources(first, second).select("item_id", "idx", "lang", "ietf", "title", "is_default", "forced",
                                                 "commentary", "second_idx")


_RAW = ["{k}", "{k}/4", "{k}/0", "NaN", "1e400", " {k}.5 ", "0x1F", "1_000", "-{k}", ".5", "{k}e1", "{k}/3/2", "", "inf", "1e-3"]


def _raw(e, k):
    out = F.lit("")
    for i, form in enumerate(_RAW):
        before, _, after = form.partition("{k}")
        value = F.concat(F.lit(before), k.cast("string"), F.lit(after)) if "{k}" in form else F.lit(form)
        out = F.when(e % len(_RAW) == i, value).otherwise(out)
    return out


_RAW_SQL = "CASE event_id % 15 " + " ".join(
    f"WHEN {i} THEN '" + f.replace("{k}", "' || k || '") + "'" for i, f in enumerate(_RAW)) + " END"
_NUM = "CASE WHEN regexp_full_match(trim({c}), '[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?') THEN CASE WHEN isinf(try_cast(trim({c}) AS DOUBLE)) THEN NULL ELSE try_cast(trim({c}) AS DOUBLE) END END"


def bounded_sql(c: str, lo, hi) -> str:
    num, den = f"regexp_extract({c}, '^([^/]*)/', 1)", f"regexp_extract({c}, '^[^/]*/(.*)$', 1)"
    v = (f"CASE WHEN contains({c}, '/') THEN {_NUM.format(c=num)} / nullif({_NUM.format(c=den)}, 0) ELSE {_NUM.format(c=c)} END")
    return f"(SELECT CASE WHEN v BETWEEN {lo} AND {hi} THEN v END FROM (SELECT {v} AS v))"


@query("m07_parse_bounded", f"""WITH {EVENT_ATTRS_SQL}, r AS (SELECT event_id, {_RAW_SQL} AS raw FROM ev)
 SELECT event_id, raw, {bounded_sql('raw', 0, 200)} AS num, CAST(CASE WHEN {bounded_sql('raw', 0, 100)} = floor({bounded_sql('raw', 0, 100)}) THEN {bounded_sql('raw', 0, 100)} END AS INTEGER) AS whole,
   CASE WHEN raw = '' THEN '' WHEN regexp_full_match(raw, '[A-Za-z0-9._+-]+') THEN lower(raw) END AS name,
   array_to_string(list_filter([CASE WHEN regexp_full_match(raw, '[A-Za-z0-9._+-]*') THEN '' ELSE 'name' END, CASE WHEN {bounded_sql('raw', 0, 200)} IS NULL THEN 'num' ELSE '' END], lambda x: x <> ''), ',') AS malformed FROM r""")
def _(spark, sf):
    r = event_attrs(spark, sf).select(F.col("item_id").alias("event_id"), _raw(F.col("item_id"), F.col("k")).alias("raw"))
    raw = F.col("raw")
    return r.select("event_id", "raw", N.parse_bounded(raw, 0, 200).alias("num"), N.parse_int(raw, 100).alias("whole"),
                    N.parse_enum(raw).alias("name"), F.array_join(N.malformed(
                        num=N.parse_bounded(raw, 0, 200).isNull(), name=N.parse_enum(raw).isNull()), ",").alias("malformed"))


_TRANSFER = ["smpte2084", "arib-std-b67", "bt709", ""]
_SIDES = ["DOVI configuration record", "HDR Dynamic Metadata HDR10+ (SMPTE2094-40)", "Content light level metadata", "Dolby Vision RPU"]


@query("m09_family_labels", f"""WITH s AS (SELECT event_id, {sql_by_rest('event_id', 4, _TRANSFER, '')} AS t, {sql_by_rest('event_id', 5, _SIDES, 'x')} AS a, {sql_by_rest('event_id', 7, _SIDES, 'y')} AS b FROM events),
 l AS (SELECT event_id, [CASE t WHEN 'smpte2084' THEN 'hdr10' WHEN 'arib-std-b67' THEN 'hlg' ELSE '' END,
    CASE WHEN a ILIKE '%dovi%' OR a ILIKE '%dolby vision%' THEN 'dovi' ELSE '' END, CASE WHEN a ILIKE '%hdr10+%' THEN 'hdr10plus' ELSE '' END,
    CASE WHEN b ILIKE '%dovi%' OR b ILIKE '%dolby vision%' THEN 'dovi' ELSE '' END, CASE WHEN b ILIKE '%hdr10+%' THEN 'hdr10plus' ELSE '' END] AS x FROM s)
 SELECT event_id, array_to_string(list_filter(x, lambda v, i: v <> '' AND list_position(x, v) = i), '+') AS labels FROM l""")
def _(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.array_join(N.family_labels(
        by_rest(e, 4, _TRANSFER, ""), F.array(by_rest(e, 5, _SIDES, "x"), by_rest(e, 7, _SIDES, "y"))), "+").alias("labels"))


# --- part checks -----------------------------------------------------------------------------------
_CHECKED_SQL = f"""{ORDER_PARTS_SQL}, checked AS (SELECT * REPLACE (CASE WHEN idx % 7 = 0 THEN 'data' WHEN idx % 5 = 0 THEN 'attachment' ELSE type END AS type),
   CASE WHEN idx % 2 = 0 THEN 'tmcd' ELSE 'gpmd' END AS codec_tag, CASE CAST(item_id AS BIGINT) % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END AS category,
   CASE WHEN CAST(item_id AS BIGINT) % 2 = 0 THEN 'matroska' ELSE 'mp4' END AS container, CASE WHEN idx % 4 = 1 THEN 'hdr10+dovi' ELSE '' END AS labels FROM parts)"""


def _checked(spark, sf):
    i, item = F.col("idx"), F.col("item_id").cast("long")
    return order_parts(spark, sf).withColumns({
        "type": F.when(i % 7 == 0, "data").when(i % 5 == 0, "attachment").otherwise(F.col("type")),
        "codec_tag": F.when(i % 2 == 0, "tmcd").otherwise("gpmd"), "category": by_rest(item, 3, ["video", "audio"], "subtitle"),
        "container": F.when(item % 2 == 0, "matroska").otherwise("mp4"),
        "labels": F.when(i % 4 == 1, F.array(F.lit("hdr10"), F.lit("dovi"))).otherwise(F.array().cast("array<string>"))})


@query("m10_check_parts", f"""WITH {_CHECKED_SQL}
 SELECT item_id, 'HDR' AS code, 0 AS severity, 'stream #' || idx || ': ' || labels AS message FROM checked WHERE type = 'video' AND NOT attached_pic AND labels <> ''
 UNION ALL SELECT item_id, 'UND_TRACK', 0, 'stream #' || idx || ' ' || type || ' has no language tag' FROM checked WHERE type IN ('audio', 'subtitle') AND lang = '' AND ietf = ''
 UNION ALL SELECT item_id, 'DATA_STREAM', 4, 'stream #' || idx || ' is a data stream (codec=' || codec || ' tag="' || codec_tag || '"); allow with streams.allow_data_tags' FROM checked WHERE type = 'data' AND codec_tag <> 'tmcd'
 UNION ALL SELECT item_id, 'ATTACH_BLOCKED', 4, 'stream #' || idx || ' is an attachment in a non-Matroska container' FROM checked WHERE type = 'attachment' AND container <> 'matroska'
 UNION ALL SELECT item_id, 'NO_VIDEO', 3, 'no video stream in a video container' FROM checked WHERE category = 'video' GROUP BY item_id HAVING count(*) FILTER (type = 'video' AND NOT attached_pic) = 0
 UNION ALL SELECT item_id, 'NO_AUDIO', 3, 'no audio stream in an audio container' FROM checked WHERE category = 'audio' GROUP BY item_id HAVING count(*) FILTER (type = 'audio') = 0""")
def _(spark, sf):
    return M.check_parts(_checked(spark, sf), P).select("item_id", "code", "severity", "message")


@query("m11_tool_messages", """SELECT event_id AS item_id, 'MKV_ERROR' AS code, 3 AS severity, 'tool: ' || event_type || ' ' || event_id AS message FROM events WHERE event_type = 'error'
 UNION ALL SELECT event_id, 'MKV_WARNING', 1, 'tool: ' || w FROM events, (VALUES ('slow'), ('odd')) t(w) WHERE event_id % 50 = 0""")
def _(spark, sf):
    e = F.col("event_id")
    none = F.array().cast("array<string>")
    ev = table(spark, sf, "events").select(
        e.alias("item_id"), F.when(F.col("event_type") == "error", F.array(F.concat("event_type", F.lit(" "), e.cast("string")))).otherwise(none).alias("errors"),
        F.when(e % 50 == 0, F.array(F.lit("slow"), F.lit("odd"))).otherwise(none).alias("warnings"))
    return K.to_rows(ev, K.check_tool_messages(F.col("errors"), F.col("warnings")), "item_id").select("item_id", "code", "severity", "message")


@query("m12_truncated", f"""WITH {ITEMS_SQL} SELECT item_id, 'TRUNCATED' AS code, 3 AS severity, 'no mandatory section: item is truncated or not finalised' AS message FROM items WHERE NOT contains(body, '.')
 UNION ALL SELECT item_id, 'TRUNCATED', 3, 'item declares ' || declared || ' but has ' || length(body) FROM items WHERE declared > length(body)""")
def _(spark, sf):
    i = documents_items(spark, sf)
    return K.to_rows(i, K.check_truncated(F.col("declared"), F.length("body"), F.contains("body", F.lit("."))), "item_id").select(
        "item_id", "code", "severity", "message")


@query("m13_no_duration", f"""WITH {ITEMS_SQL} SELECT i.item_id, 'NO_DURATION' AS code, 1 AS severity, 'container reports no duration' AS message FROM items i
  LEFT JOIN labels l ON i.item_id = l.doc_id WHERE i.name LIKE '%.mkv' AND coalesce(l.quality, 0) <= 0""")
def _(spark, sf):
    i = documents_items(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality"), "item_id", "left")
    return rows(i, K.check_no_duration(F.col("name"), F.col("quality")))


# --- coded names ---------------------------------------------------------------------------------------
def _code_rows(name):
    return ", ".join(f"({k}, '{v}')" for k, v in T.CODE_TABLES[name].items())


@query("m14_coded_lookup", f"""WITH {EVENT_ATTRS_SQL}, pc(c, n) AS (VALUES {_code_rows('primaries')}), tc(c, n) AS (VALUES {_code_rows('transfer')}),
 r AS (SELECT event_id, k, CASE WHEN event_id % 5 = 0 THEN 'x' || k ELSE CAST(k % 25 AS VARCHAR) END AS raw FROM ev)
 SELECT event_id, coalesce(pc.n, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '' END) AS primaries, coalesce(tc.n, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '' END) AS transfer FROM r
 LEFT JOIN pc ON pc.c = try_cast(raw AS INTEGER) LEFT JOIN tc ON tc.c = try_cast(raw AS INTEGER)""")
def _(spark, sf):
    e = event_attrs(spark, sf)
    raw = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("x"), F.col("k").cast("string"))).otherwise((F.col("k") % 25).cast("string"))
    return e.select(F.col("item_id").alias("event_id"), N.coded(raw, "primaries").alias("primaries"), N.coded(raw, "transfer").alias("transfer"))


# --- groups ----------------------------------------------------------------------------------------------
def _groups(spark, sf):
    """Side data of each event: an odd list with a light entry and, for some, a luminance entry."""
    e, k = F.col("item_id"), F.col("k").cast("string")
    light = F.concat(F.lit('{"side_data_type":"Content light level metadata","max_content":'), F.when(e % 4 == 0, '"bad"').otherwise(k),
                     F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(',"max_average":"'), k, F.lit('"'))), F.lit("}"))
    second = F.concat(F.lit('{"side_data_type":"CONTENT LIGHT level","max_content":1,"max_average":1}'))
    lum = F.concat(F.lit('{"side_data_type":"Mastering display metadata","min_luminance":"1/'), F.when(e % 6 == 0, "0").otherwise("10000"),
                   F.lit('","max_luminance":'), k, F.lit("}"))
    side = F.concat(F.lit('[5,"x",null,'), light, F.lit(","), second, F.when(e % 3 == 0, F.concat(F.lit(","), lum)).otherwise(""), F.lit("]"))
    names = {"primaries": F.when(e % 5 == 0, "bad name").otherwise("BT2020"), "transfer": F.when(e % 3 == 1, "unknown").otherwise("smpte2084"),
             "matrix": F.lit("bt2020nc"), "range": F.lit("tv")}
    return event_attrs(spark, sf).withColumn("side", F.when(e % 11 == 0, "not json").otherwise(side)).withColumn(
        "g", M.extract_groups(names, F.col("side")))


_GROUP_SQL = f"""{EVENT_ATTRS_SQL}, g AS (SELECT event_id, k, event_id % 11 <> 0 AS js, event_id % 11 <> 0 AND event_id % 4 <> 0 AS cll, event_id % 11 <> 0 AND event_id % 7 <> 0 AS fall,
   event_id % 11 <> 0 AND event_id % 3 = 0 AS lum, event_id % 6 <> 0 AS lumok, event_id % 5 <> 0 AS pri FROM ev)"""
_GROUP_MAL = """array_to_string(list_filter([CASE WHEN lum AND NOT lumok THEN 'luminance' ELSE '' END, CASE WHEN js AND NOT cll THEN 'max_cll' ELSE '' END, CASE WHEN js AND NOT fall THEN 'max_fall' ELSE '' END,
   CASE WHEN lum AND NOT lumok THEN 'min_luminance' ELSE '' END, CASE WHEN NOT pri THEN 'primaries' ELSE '' END], lambda x: x <> ''), ',')"""


@query("m15_extract_groups", f"""WITH {_GROUP_SQL} SELECT event_id, CASE WHEN pri THEN 'bt2020' ELSE '' END AS primaries, CASE WHEN event_id % 3 = 1 THEN '' ELSE 'smpte2084' END AS transfer,
   CAST(CASE WHEN cll AND fall THEN k END AS INTEGER) AS max_cll, CAST(CASE WHEN cll AND fall THEN k END AS INTEGER) AS max_fall, CASE WHEN lum AND lumok THEN CAST(0.0001 AS DOUBLE) END AS min_luminance, CASE WHEN lum AND lumok THEN CAST(k AS DOUBLE) END AS max_luminance,
   {_GROUP_MAL} AS malformed FROM g""")
def _(spark, sf):
    return _groups(spark, sf).select(F.col("item_id").alias("event_id"), "g.primaries", "g.transfer", "g.max_cll", "g.max_fall",
                                     "g.min_luminance", "g.max_luminance", F.array_join("g.malformed", ",").alias("malformed"))


@query("m15_header_groups", f"""WITH {EVENT_ATTRS_SQL} SELECT event_id, CASE WHEN k % 25 = 9 THEN 'bt2020' WHEN k % 25 = 1 THEN 'bt709' ELSE '' END AS primaries,
   CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN k / 1000.0 END AS red_x, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN CAST(0.329 AS DOUBLE) END AS white_y,
   CASE WHEN event_id % 3 = 0 THEN 'chromaticity_coordinates' WHEN event_id % 2 = 1 THEN 'white_coordinates' ELSE '' END AS malformed FROM ev""")
def _(spark, sf):
    return _headers(event_attrs(spark, sf)).select(F.col("item_id").alias("event_id"), "h.primaries", "h.red_x", "h.white_y",
                                                   F.array_join("h.malformed", ",").alias("malformed"))


def _headers(e):
    k, item = F.col("k"), F.col("item_id")
    x = F.format_string("%.3f", k / F.lit(1000.0))
    props = F.create_map(
        F.lit("color_primaries"), F.when((k % 25).isin(9, 1), (k % 25).cast("string")).otherwise("2"),
        F.lit("chromaticity_coordinates"), F.concat(x, F.lit(",0.292,0.17,0.797,0.131"), F.when(item % 3 == 0, "").otherwise(",0.046")),
        F.lit("white_colour_coordinates"), F.when(item % 2 == 0, "0.3127,0.329"),
        F.lit("color_transfer_characteristics"), F.lit("18"))
    return e.withColumn("h", M.header_groups(props))


@query("m08_fill_missing", f"""WITH {_GROUP_SQL} SELECT event_id, CASE WHEN NOT pri THEN '' ELSE 'bt2020' END AS primaries, CASE WHEN event_id % 3 = 1 THEN 'arib-std-b67' ELSE 'smpte2084' END AS transfer,
   CAST(CASE WHEN cll AND fall THEN k END AS INTEGER) AS max_cll, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN k / 1000.0 END AS red_x, CASE WHEN lum AND lumok THEN CAST(k AS DOUBLE) END AS max_luminance,
   array_to_string(list_sort(list_filter(string_split({_GROUP_MAL}, ',') || [CASE WHEN event_id % 3 = 0 THEN 'chromaticity_coordinates' WHEN event_id % 2 = 1 THEN 'white_coordinates' ELSE '' END], lambda x: x <> '')), ',') AS malformed FROM g""")
def _(spark, sf):
    both = _headers(_groups(spark, sf)).withColumn("m", M.fill_missing(F.col("g"), F.col("h")))
    return both.select(F.col("item_id").alias("event_id"), "m.primaries", "m.transfer", "m.max_cll", "m.red_x", "m.max_luminance",
                       F.array_join("m.malformed", ",").alias("malformed"))
