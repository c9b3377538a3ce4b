"""Queries of verification, verdicts, reports, signatures and identity."""
from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions import typed as N
from portcullis.operators import checks as K
from portcullis.operators import metadata as M
from portcullis.operators import signatures as G
from portcullis.operators import verdict as A
from portcullis.operators import verify as V
from portcullis.operators.profiles import Settings
from portcullis.queries.base import ITEMS_SQL, by_rest, documents_items, query, rows, table
from portcullis.queries.content import UTF8_HEX
from portcullis.queries.policy import PROFILES
from portcullis.schema import union_all
from portcullis.sources import decode as D

P = Settings.of(PROFILES["homelab"])
_CANON = "rtrim(regexp_replace({c}, '[ \\t]+(\\n|$)', '\\1', 'g'), chr(10))"


# --- hashes ------------------------------------------------------------------------------------------
@query("v01_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.content_hash(F.encode("text", "UTF-8")).alias("digest"))


@query("v02_canonical_hash", f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), ' ' || chr(10)) || '  ' || chr(10) || chr(10) ELSE text END AS s FROM documents)
 SELECT doc_id, sha256({_CANON.format(c='s')}) AS digest FROM c""")
def _(spark, sf):
    framed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.replace("text", F.lit("\n"), F.lit(" \r\n")), F.lit("  \n\n"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", V.canonical_hash(framed).alias("digest"))


_ACCENTS = "replace(replace(text, 'a', 'á'), 'o', 'ö')"


@query("v02_unicode_forms", f"""WITH c AS (SELECT doc_id, nfc_normalize({_ACCENTS}) AS s FROM documents)
 SELECT doc_id, sha256({_CANON.format(c='s')}) AS digest FROM c""")
def _(spark, sf):
    """Every second document has its accents decomposed; its digest is that of the composed form."""
    accents = F.replace(F.replace("text", F.lit("a"), F.lit("\u00e1")), F.lit("o"), F.lit("\u00f6"))
    apart = F.replace(F.replace(accents, F.lit("\u00e1"), F.lit("a\u0301")), F.lit("\u00f6"), F.lit("o\u0308"))
    return table(spark, sf, "documents").select("doc_id", V.canonical_hash(F.when(F.col("doc_id") % 2 == 0, apart).otherwise(accents)).alias("digest"))


# --- parts against their copies ---------------------------------------------------------------------------
def _turns(spark, sf):
    """Conversation turns as parts, and a copy with lost, changed and reframed turns."""
    c, t = F.col("conv_id"), F.col("turn")
    z = c * 7 + t
    src = table(spark, sf, "conversations").select(
        c.alias("item_id"), t.alias("idx"), by_rest(F.length("role"), 10, ["", "", "", "", "audio", "", "video"], "subtitle").alias("type"),
        "text", z.alias("z"), (c % 2 == 0).alias("same_family"))
    w = F.col("z")
    out = src.filter(w % 17 != 0).withColumn("text", F.when(w % 19 == 0, F.upper("text")).when(w % 5 == 0, F.concat("text", F.lit("  "))).otherwise(F.col("text")))

    def hashed(df):
        return df.withColumn("raw_hash", V.content_hash(F.encode("text", "UTF-8"))).withColumn("canon_hash", V.canonical_hash(F.col("text")))
    return hashed(src), hashed(out)


_TURNS_SQL = f"""src AS (SELECT conv_id AS item_id, turn AS idx, CASE role WHEN 'user' THEN 'audio' WHEN 'system' THEN 'video' ELSE 'subtitle' END AS type, text, conv_id * 7 + turn AS z FROM conversations),
 outp AS (SELECT item_id, idx, type, CASE WHEN z % 19 = 0 THEN upper(text) WHEN z % 5 = 0 THEN text || '  ' ELSE text END AS text FROM src WHERE z % 17 <> 0),
 a AS (SELECT *, row_number() OVER (PARTITION BY item_id, type ORDER BY idx) AS o FROM src), b AS (SELECT *, row_number() OVER (PARTITION BY item_id, type ORDER BY idx) AS o FROM outp),
 cmp AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.type, b.type) AS type, o, a.idx, CASE WHEN a.text = b.text THEN 'packet' WHEN a.idx IS NOT NULL AND b.idx IS NOT NULL AND a.item_id % 2 = 0 THEN 'mismatch'
    WHEN {_CANON.format(c='a.text')} = {_CANON.format(c='b.text')} THEN 'decoded' WHEN a.idx IS NOT NULL AND b.idx IS NOT NULL THEN 'mismatch' WHEN a.idx IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
   FROM a FULL OUTER JOIN b USING (item_id, type, o))"""


@query("v03_compare_parts", f"WITH {_TURNS_SQL} SELECT item_id, type, o AS ordinal, status FROM cmp")
def _(spark, sf):
    return V.compare_parts(V.pair_parts(*_turns(spark, sf))).select("item_id", "type", "ordinal", "status")


@query("v03_verify_parts", f"""WITH {_TURNS_SQL}, s AS (SELECT item_id, count(*) FILTER (status IN ('packet', 'decoded')) AS n, min(idx) FILTER (status = 'mismatch') AS bad, arg_min(type, idx) FILTER (status = 'mismatch') AS bt,
   count(*) FILTER (status = 'missing') AS lost, count(*) FILTER (status = 'extra') AS extra FROM cmp GROUP BY item_id)
 SELECT item_id, CASE WHEN lost + extra > 0 THEN 'VERIFY_FAIL' WHEN bad IS NULL THEN 'HASH_OK' ELSE 'HASH_MISMATCH' END AS code, CASE WHEN lost + extra = 0 AND bad IS NULL THEN 0 ELSE 3 END AS severity,
   CASE WHEN lost + extra > 0 THEN lost || ' kept stream(s) missing from output, ' || extra || ' not in source' WHEN bad IS NULL THEN n || ' stream(s) verified identical to source' ELSE 'stream #' || bad || ' (' || bt || ') differs from source' END AS message FROM s""")
def _(spark, sf):
    return V.verify_parts(V.compare_parts(V.pair_parts(*_turns(spark, sf))), P).select("item_id", "code", "severity", "message")


@query("v04_verify_structure", f"""WITH {_TURNS_SQL}, w AS (SELECT item_id, type, count(*) AS n FROM src GROUP BY ALL), g AS (SELECT item_id, type, count(*) AS n FROM outp GROUP BY ALL),
 d AS (SELECT item_id, type, coalesce(w.n, 0) AS want, coalesce(g.n, 0) AS got FROM w FULL OUTER JOIN g USING (item_id, type) WHERE coalesce(w.n, 0) <> coalesce(g.n, 0)),
 f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE type WHEN 'video' THEN 1 WHEN 'audio' THEN 2 ELSE 3 END) AS r FROM d)
 SELECT item_id, 'VERIFY_FAIL' AS code, 3 AS severity, 'expected ' || want || ' ' || type || ' stream(s), output has ' || got AS message FROM f WHERE r = 1""")
def _(spark, sf):
    return V.verify_structure(V.verify_counts(*_turns(spark, sf))).select("item_id", "code", "severity", "message")


@query("v04_verify_item", """WITH o AS (SELECT o_orderkey AS item_id, o_orderkey % 3 AS at_out, o_orderkey % 2 AS at_kept, o_orderkey % 5 AS ch_out, o_orderkey % 7 AS tags, CASE WHEN o_orderkey % 11 = 0 THEN 'T' ELSE '' END AS title,
   CASE WHEN o_orderkey % 13 = 0 THEN 'mux' ELSE '' END AS app FROM orders)
 SELECT item_id, 'VERIFY_FAIL' AS code, 3 AS severity, m AS message FROM (SELECT item_id, CASE WHEN at_out > 0 AND at_out <> at_kept THEN 'expected ' || at_kept || ' attachment(s), output has ' || at_out
   WHEN ch_out = 0 THEN 'chapters lost in output' WHEN tags > 4 THEN 'tags present in output (' || tags || ' global, 0 track)' WHEN title <> '' THEN 'title present in output' WHEN app <> '' THEN 'muxing/writing application still set' END AS m FROM o) WHERE m IS NOT NULL""")
def _(spark, sf):
    o = F.col("o_orderkey")
    pair = table(spark, sf, "orders").select(
        o.alias("item_id"), (o % 3).alias("out_attachments"), (o % 2).alias("kept_attachments"), (o % 5).alias("out_chapters"),
        F.lit(2).alias("src_chapters"), F.when(o % 7 > 4, o % 7).otherwise(0).alias("out_global_tags"), F.lit(0).alias("out_track_tags"),
        F.when(o % 11 == 0, "T").otherwise("").alias("out_title"), F.when(o % 13 == 0, "mux").otherwise("").alias("out_muxing_app"),
        F.lit("").alias("out_writing_app"), *[F.lit(True).alias(c) for c in ("keep_chapters", "strip_tags", "strip_title", "strip_provenance")])
    return V.verify_item(pair).select("item_id", "code", "severity", "message")


def _signals(spark, sf):
    """Two signal structs per event: the source and an output with single fields altered."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    none = F.array().cast("array<string>")

    def signal(**given):
        fields = [given.get(n, F.lit("") if n in M.NAMES else F.lit(None)).alias(n) for n in M.NAMES + M.COORDINATES + M.LUMINANCE + M.LIGHT + M.CONFIG]
        return F.struct(*fields, given.get("malformed", none).alias("malformed")).cast(M.SIGNAL_TYPE)

    peak = k.cast("double") * 10 + 1
    src = signal(primaries=F.lit("bt2020"), transfer=F.when(e % 11 == 0, "").otherwise("smpte2084"), min_luminance=F.lit(0.0001), max_luminance=peak,
                 max_cll=k, max_fall=k, malformed=F.when(e % 11 == 0, F.array(F.lit("transfer"))).otherwise(none))
    out = signal(primaries=F.when(e % 3 == 0, "bt709").otherwise("bt2020"), transfer=F.when(e % 4 == 0, "").otherwise("smpte2084"), matrix=F.when(e % 13 == 0, "bt2020nc").otherwise(""),
                 min_luminance=F.when(e % 10 != 0, 0.0001), max_luminance=F.when(e % 10 != 0, F.when(e % 5 == 0, peak * 2).when(e % 6 == 0, peak * (1 + 1e-8)).otherwise(peak)),
                 max_cll=F.when(e % 7 != 0, k), max_fall=F.when(e % 7 != 0, k + F.when(e % 9 == 0, 1).otherwise(0)))
    return table(spark, sf, "events").select("event_id", src.alias("src"), out.alias("out"))


@query("v05_struct_diff", """WITH s AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(props->>'$.k' AS INTEGER) * 10 + 1 AS peak FROM events),
 d AS (SELECT event_id, [CASE WHEN event_id % 10 = 0 THEN 'mastering display metadata lost' END, CASE WHEN event_id % 7 = 0 THEN 'content light level lost' END,
   CASE WHEN event_id % 3 = 0 THEN 'primaries changed from bt2020 to bt709' END,
   CASE WHEN event_id % 11 <> 0 AND event_id % 4 = 0 THEN 'transfer lost (was smpte2084)' END,
   CASE WHEN event_id % 10 <> 0 AND event_id % 5 = 0 THEN 'max_luminance changed from ' || peak || ' to ' || (peak * 2) END,
   CASE WHEN event_id % 7 <> 0 AND event_id % 9 = 0 THEN 'max_fall changed from ' || k || ' to ' || (k + 1) END,
   CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'transfer lost (was malformed)' ELSE 'transfer changed from malformed to smpte2084' END END,
   CASE WHEN event_id % 13 = 0 THEN 'matrix gained (now bt2020nc)' END] AS x FROM s)
 SELECT event_id, array_to_string(list_filter(x, lambda v: v IS NOT NULL), '; ') AS diff FROM d""")
def _(spark, sf):
    return _signals(spark, sf).select("event_id", F.array_join(V.struct_diff(F.col("src"), F.col("out")), "; ").alias("diff"))


@query("v06_close_enough", """WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 + (l_partkey % 5) * 5e-7) AS b FROM lineitem)
 SELECT l_linenumber, abs(a - b) <= 1e-9 OR abs(a - b) <= 1e-6 * greatest(abs(a), abs(b)) AS same, count(*) AS n FROM l GROUP BY ALL""")
def _(spark, sf):
    a = F.col("l_extendedprice")
    b = a * (1 + (F.col("l_partkey") % 5) * F.lit(5e-7))
    return table(spark, sf, "lineitem").groupBy("l_linenumber", N.close_enough(a, b).alias("same")).agg(F.count("*").alias("n"))


@query("v07_decode_check", f"""WITH {ITEMS_SQL} SELECT item_id, 'DECODE_FAIL' AS code, 3 AS severity, 'content does not decode (full)' AS message FROM items
 WHERE NOT regexp_full_match(h, '(?:{UTF8_HEX})*')""")
def _(spark, sf):
    return rows(documents_items(spark, sf).filter(F.col("content").isNotNull()), K.check_decode(F.col("content"), "full", F.lit(True)))


_JSON_BODY = """CASE doc_id % 7 WHEN 0 THEN left(j, length(j) - 1) WHEN 1 THEN j || ' x' WHEN 2 THEN replace(j, '":', '" ') WHEN 3 THEN '[' || j || ', null, -1.5e3, "\\u00e9"]' ELSE j END"""


@query("v07_decode_ranges", f"""WITH d AS (SELECT doc_id, CAST(json_object('doc_id', doc_id, 'text', text) AS VARCHAR) AS j FROM documents),
 b AS (SELECT doc_id, {_JSON_BODY} AS s FROM d)
 SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'DECODE_FAIL' ELSE 'UNPARSEABLE' END AS code, 3 AS severity, doc_id % 11 <> 3 AS terminal,
   CASE WHEN doc_id % 11 = 3 THEN 'content does not decode (full)' ELSE 'content is not one JSON value' END AS message
 FROM b WHERE doc_id % 11 = 3 OR NOT json_valid(s)""")
def _(spark, sf):
    """The documents as JSON bodies: some cut, with something behind the value or without colons; in some a byte that begins no character leads."""
    d = F.col("doc_id")
    j = F.to_json(F.struct("doc_id", "text"))
    s = (F.when(d % 7 == 0, F.left(j, F.length(j) - 1)).when(d % 7 == 1, F.concat(j, F.lit(" x"))).when(d % 7 == 2, F.replace(j, F.lit('":'), F.lit('" ')))
          .when(d % 7 == 3, F.concat(F.lit("["), j, F.lit(', null, -1.5e3, "\\u00e9"]'))).otherwise(j))
    body = F.concat(F.when(d % 11 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.encode(s, "UTF-8"))
    faults = D.body_faults(table(spark, sf, "documents"), ["doc_id"], body, F.lit(True))
    return D.fault_findings(faults, "doc_id").select("doc_id", "code", "severity", "terminal", "message")


@query("v05_hdr_lost", """WITH e AS (SELECT event_id AS item_id, CASE event_id % 3 WHEN 0 THEN 'hdr10' WHEN 1 THEN 'hdr10+dv' ELSE '' END AS a, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'hdr10' WHEN event_id % 3 = 1 THEN 'hdr10+dv' ELSE '' END AS b FROM events)
 SELECT item_id, 'HDR_LOST' AS code, 3 AS severity, 'source video is ' || CASE a WHEN '' THEN 'none' ELSE a END || ', output is ' || CASE b WHEN '' THEN 'none' ELSE b END AS message FROM e WHERE a <> b""")
def _(spark, sf):
    e = F.col("event_id")
    none = F.array().cast("array<string>")
    labels = F.when(e % 3 == 0, F.array(F.lit("hdr10"))).when(e % 3 == 1, F.array(F.lit("hdr10"), F.lit("dv"))).otherwise(none)
    pairs = table(spark, sf, "events").select(e.alias("item_id"), F.lit(0).alias("idx"), labels.alias("src_labels"),
                                              F.when(e % 5 == 0, none).otherwise(labels).alias("out_labels"))
    return V.verify_labels(pairs).select("item_id", "code", "severity", "message")


@query("v08_stale", """SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'CLEAN_FAIL' ELSE 'REMUX_FAIL' END AS code, 3 AS severity,
   'not touched: ' || CASE WHEN doc_id % 17 = 0 THEN 'vanished' ELSE 'changed since the scan' END AS message
 FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0""")
def _(spark, sf):
    d = F.col("item_id")
    checked = V.still_current(*_versions(spark, sf)).withColumn("route", F.when(d % 2 == 0, "clean").otherwise("remux"))
    return V.stale_findings(checked).select("item_id", "code", "severity", "message")


@query("v08_still_current", """WITH d AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 17 = 0 THEN 'vanished' WHEN doc_id % 19 = 0 OR doc_id % 23 = 0 THEN 'changed since the scan' ELSE '' END AS why FROM documents)
 SELECT item_id, why, why = '' AS fresh FROM d""")
def _(spark, sf):
    return V.still_current(*_versions(spark, sf)).select("item_id", "why", "fresh")


def _versions(spark, sf):
    """The documents as they were scanned, and as they are now."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    before = docs.select(d.alias("item_id"), F.length("text").alias("length"), at.alias("modified"), F.sha2("text", 256).alias("digest"))
    now = docs.filter(d % 17 != 0).select(
        d.alias("item_id"), (F.length("text") + F.when(d % 19 == 0, 1).otherwise(0)).alias("length"),
        F.when(d % 23 == 0, at + F.expr("INTERVAL 1 SECOND")).otherwise(at).alias("modified"), F.sha2("text", 256).alias("digest"))
    return before, now


# --- verdicts ----------------------------------------------------------------------------------------------
def _found(spark, sf):
    """Items of the documents and their findings from three checks of different stages."""
    i = documents_items(spark, sf)
    long = union_all([K.to_rows(i, K.gather(K.check_name_chars(F.col("name")), K.check_empty(F.length("content"))), "item_id"),
                      K.to_rows(i, K.check_truncated(F.col("declared"), F.length("body"), F.lit(True)), "item_id"),
                      K.to_rows(i, K.gather(K.check_double_ext(F.col("name"), P["sidecars.block"])), "item_id")])
    return i.select("item_id", "grp", "path"), long


_FOUND_SQL = f"""{ITEMS_SQL}, found AS (SELECT item_id, 1 AS stage, 0 AS seq, 'BIDI_NAME' AS code, 4 AS severity FROM items WHERE regexp_matches(name, '\\p{{Cf}}')
  UNION ALL SELECT item_id, 2, 0, 'EMPTY_FILE', 4 FROM items WHERE h = '' UNION ALL SELECT item_id, 17, 1, 'TRUNCATED', 3 FROM items WHERE declared > length(body)
  UNION ALL SELECT item_id, 5, 0, 'DOUBLE_EXT', 1 FROM items WHERE name LIKE '%.exe.%'),
 judged AS (SELECT i.item_id, i.grp, '/in/' || i.grp || '/' || i.name AS path, coalesce(max(f.severity), 0) AS verdict FROM items i LEFT JOIN found f USING (item_id) GROUP BY ALL)"""
_NAME = "CASE verdict WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 3 THEN 'FAIL' ELSE 'BLOCK' END"


@query("a01_verdicts", f"WITH {_FOUND_SQL} SELECT item_id, verdict FROM judged")
def _(spark, sf):
    return A.verdicts(*_found(spark, sf)).select("item_id", "verdict")


@query("a02_verdict_counts", f"WITH {_FOUND_SQL} SELECT grp, {_NAME} AS verdict, count(*) AS files FROM judged GROUP BY ALL")
def _(spark, sf):
    return A.verdict_counts(A.verdicts(*_found(spark, sf)), "grp")


@query("a03_run_verdict", f"WITH {_FOUND_SQL} SELECT grp, CASE WHEN length(grp) % 2 = 0 THEN greatest(max(verdict), 3) ELSE max(verdict) END AS verdict, count(*) AS files FROM judged GROUP BY grp")
def _(spark, sf):
    """Each source is a run; every other one ended with an error of its own."""
    return A.run_verdict(A.verdicts(*_found(spark, sf)), (F.length("grp") + 1) % 2, "grp")


@query("a04_exit_code", f"WITH {_FOUND_SQL} SELECT item_id, CASE WHEN item_id % 2 = 0 AND verdict = 0 THEN 130 ELSE verdict END AS exit_code FROM judged")
def _(spark, sf):
    return A.verdicts(*_found(spark, sf)).select("item_id", A.exit_code(F.col("verdict"), F.col("item_id") % 2 == 0).alias("exit_code"))


@query("a05_ordered_findings", f"WITH {_FOUND_SQL} SELECT item_id, count(*) AS total, string_agg(code, ',' ORDER BY stage, seq) AS codes FROM found GROUP BY item_id")
def _(spark, sf):
    return A.ordered_findings(_found(spark, sf)[1]).select("item_id", F.col("total").cast("long").alias("total"), F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@query("a05_finding_entries", f"WITH {_FOUND_SQL} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY stage, seq) AS ordinal, code FROM found")
def _(spark, sf):
    return A.finding_entries(_found(spark, sf)[1]).select("item_id", "ordinal", "code")


@query("a05_merged_results", f"WITH {_FOUND_SQL} SELECT code, count(*) AS n FROM (SELECT code FROM found UNION ALL SELECT 'ROUTE' FROM items) GROUP BY code")
def _(spark, sf):
    items, found = _found(spark, sf)
    from portcullis.schema import PASS, finding, gather, to_rows
    routed = to_rows(items, gather(finding(F.lit(True), "route", "ROUTE", PASS, "skip: sidecar")), "item_id")
    return A.merge_results(found, routed).groupBy("code").agg(F.count("*").alias("n"))


@query("a06_has_code", f"WITH {_FOUND_SQL} SELECT item_id, grp FROM items WHERE item_id IN (SELECT item_id FROM found WHERE code = 'TRUNCATED')")
def _(spark, sf):
    items, found = _found(spark, sf)
    return A.has_code(items.select("item_id", "grp"), found, "TRUNCATED")


@query("a07_report_lines", f"""WITH {_FOUND_SQL}, agg AS (SELECT item_id, count(*) AS n, string_agg(code, ',' ORDER BY stage, seq) AS codes FROM found GROUP BY item_id)
 SELECT item_id, path, {_NAME} AS verdict, coalesce(n, 0) AS n, coalesce(codes, '') AS codes, '{{}}' AS info FROM judged LEFT JOIN agg USING (item_id)""")
def _(spark, sf):
    items, found = _found(spark, sf)
    lines = A.report_lines(A.verdicts(items, found), found)
    get = lambda p: F.get_json_object("line", p)
    codes = F.from_json("line", "findings array<struct<code:string>>")["findings"]
    return lines.select("item_id", get("$.path").alias("path"), get("$.verdict").alias("verdict"), F.size(codes).cast("long").alias("n"),
                        F.array_join(F.transform(codes, lambda c: c["code"]), ",").alias("codes"), get("$.info").alias("info"))



_HEAD_SQL = """'{"schema":"portcullis.report/1","tool":"portcullis","version":"0.1.0","command":"scan","profile":"homelab","started":"2026-01-02T03:04:05Z","finished":"2026-01-02T03:04:06Z","verdict":"' || arg_max(v, m) || '","counts":{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}'"""


@query("a07_document", f"""WITH {_FOUND_SQL}, c AS (SELECT {_NAME} AS v, count(*) AS n, max(verdict) AS m FROM judged GROUP BY ALL),
 f AS (SELECT *, row_number() OVER (ORDER BY path, item_id) AS place FROM judged),
 e AS (SELECT item_id, code, {_NAME.replace("verdict", "severity")} AS severity, row_number() OVER (PARTITION BY item_id ORDER BY stage, seq) AS ordinal FROM found)
 SELECT 0 AS place, 0 AS section, 0 AS ordinal, {_HEAD_SQL} || ',"files":[' AS piece FROM c
 UNION ALL SELECT place, 0, 0, CASE WHEN place > 1 THEN ',' ELSE '' END || '{{"path":' || to_json(path) || ',"verdict":"' || {_NAME} || '","findings":[' FROM f
 UNION ALL SELECT place, 1, ordinal, CASE WHEN ordinal > 1 THEN ',' ELSE '' END || '{{"code":"' || code || '","severity":"' || severity || '","message":"' || code || '"}}' FROM e JOIN f USING (item_id)
 UNION ALL SELECT place, 2, 0, CASE WHEN verdict < 3 THEN '],"output":' || to_json('/out/' || item_id) ELSE ']' END FROM f
 UNION ALL SELECT place, 3, a, CASE WHEN a = 1 THEN ',"actions":[' ELSE ',' END || to_json('keep "' || a || '"') FROM f, (SELECT unnest([1, 2]) AS a) WHERE item_id % 2 = 1
 UNION ALL SELECT place, 4, 0, CASE WHEN item_id % 2 = 1 THEN ']' ELSE '' END || ',"info":{{"grp":' || to_json(grp) || '}},"duration_ms":' || item_id % 100 || '}}' FROM f
 UNION ALL SELECT 9223372036854775807, 4, 0, '],"errors":[]}}'""")
def _(spark, sf):
    """The pieces of the whole document; a finding's message is its code here, every other item was acted upon."""
    items, found = _found(spark, sf)
    told = found.withColumn("message", F.col("code")).withColumn("detail", F.lit(None).cast("string"))
    judged = A.verdicts(items, told).withColumns({
        "output": F.when(F.col("verdict") < 3, F.concat(F.lit("/out/"), F.col("item_id").cast("string"))),
        "info": F.create_map(F.lit("grp"), F.col("grp")), "duration_ms": F.col("item_id") % 100})
    lines = items.filter("item_id % 2 = 1").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal")).withColumn(
        "line", F.concat(F.lit('keep "'), F.col("ordinal").cast("string"), F.lit('"')))
    at = F.lit("2026-01-02 03:04:05.9").cast("timestamp")
    return A.document_pieces(judged, told, lines, tool="portcullis", version="0.1.0", command="scan", profile="homelab",
                             started=at, finished=at + F.expr("INTERVAL 1 SECOND"))


@query("a07_count_line", f"WITH {_FOUND_SQL}, c AS (SELECT {_NAME} AS v, count(*) AS n, max(verdict) AS m FROM judged GROUP BY ALL) SELECT arg_max(v, m) || ': ' || sum(n) || ' file(s) ' || string_agg(v || '=' || n, ' ' ORDER BY v) AS line FROM c")
def _(spark, sf):
    return A.count_line(A.verdicts(*_found(spark, sf)))


@query("a07_run_header", f"""WITH {_FOUND_SQL}, c AS (SELECT {_NAME} AS v, count(*) AS n, max(verdict) AS m FROM judged GROUP BY ALL)
 SELECT '{{"schema":"portcullis.report/1","tool":"portcullis","version":"0.1.0","command":"scan","profile":"homelab","started":"2026-01-02T03:04:05Z","finished":"2026-01-02T03:04:06Z","verdict":"' || arg_max(v, m) || '","counts":{{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}},"errors":[]}}' AS header FROM c""")
def _(spark, sf):
    at = F.lit("2026-01-02 03:04:05.9").cast("timestamp")
    return A.run_header(A.verdicts(*_found(spark, sf)), tool="portcullis", version="0.1.0", command="scan", profile="homelab",
                        started=at, finished=at + F.expr("INTERVAL 1 SECOND"))


# --- signatures ------------------------------------------------------------------------------------------------
_OUT = ["clean", "infected", "timed out"]


@query("k01_signature_policy", """WITH g AS (SELECT o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'optional' ELSE 'required' END AS mode, o_orderkey % 5 = 0 AS forced, o_orderkey % 7 <> 0 AS present,
   CASE WHEN o_orderkey % 11 = 0 THEN 3000000000 ELSE 10 END AS size, CASE o_orderkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'infected' WHEN 2 THEN 'timed out' ELSE 'clean' END AS outcome FROM orders),
 m AS (SELECT *, CASE WHEN forced AND mode = 'off' THEN 'optional' ELSE mode END AS md FROM g),
 c AS (SELECT *, CASE WHEN md = 'off' THEN NULL WHEN NOT present THEN CASE WHEN md = 'required' THEN 'SIGNATURE_MISSING' END WHEN size > 2146435072 THEN 'SIGNATURE_ERROR' WHEN outcome = 'infected' THEN 'SIGNATURE_INFECTED' WHEN outcome <> 'clean' THEN 'SIGNATURE_ERROR' END AS code FROM m)
 SELECT item_id, code, CASE code WHEN 'SIGNATURE_MISSING' THEN 3 WHEN 'SIGNATURE_INFECTED' THEN 4 ELSE CASE WHEN md = 'required' THEN 3 ELSE 1 END END AS severity, code = 'SIGNATURE_INFECTED' OR md = 'required' AS terminal FROM c WHERE code IS NOT NULL""")
def _(spark, sf):
    o = F.col("o_orderkey")
    g = table(spark, sf, "orders").withColumn("f", G.signature_policy(
        by_rest(o, 3, ["off", "optional"], "required"), o % 5 == 0, o % 7 != 0, F.when(o % 11 == 0, 3000000000).otherwise(10),
        by_rest(o, 4, _OUT, "clean")))
    return g.filter(F.col("f").isNotNull()).select(o.alias("item_id"), "f.code", "f.severity", "f.terminal")


def _signatures(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("sig_id"), "text", F.sha2("text", 256).alias("digest"))
    d = table(spark, sf, "documents").filter(F.col("doc_id") % 97 == 0).select((F.col("doc_id") + 100000).alias("sig_id"), "text", F.sha2("text", 256).alias("digest"))
    return b.unionByName(d)


_MATCH_SQL = """sigs AS (SELECT item_id AS sig_id, text FROM benchmark UNION ALL SELECT doc_id + 100000, text FROM documents WHERE doc_id % 97 = 0),
 matched AS (SELECT d.doc_id AS item_id, s.sig_id, CASE WHEN d.text = s.text THEN 'digest' ELSE 'text' END AS how FROM documents d JOIN sigs s ON contains(d.text, s.text))"""


@query("k02_signature_match", f"WITH {_MATCH_SQL} SELECT * FROM matched")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"))
    return G.signature_match(docs, _signatures(spark, sf))


@query("k02_signature_findings", f"WITH {_MATCH_SQL} SELECT item_id, 'SIGNATURE_INFECTED' AS code, 4 AS severity, count(*) || ' signature(s) matched, first #' || min(sig_id) AS message FROM matched GROUP BY item_id")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"))
    return G.signature_findings(docs, G.signature_match(docs, _signatures(spark, sf))).select("item_id", "code", "severity", "message")


@query("d01_multi_named", """SELECT doc_id AS item_id, 'HARDLINKED' AS code, 0 AS severity, 'file has ' || n || ' hard links' AS message FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("digest"))
    return rows(G.multi_named(docs), K.check_copies(F.col("copies")))


