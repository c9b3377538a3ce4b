"""Queries of the item checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions import content as C
from portcullis.functions import tables as T
from portcullis.functions.columns import category, ext
from portcullis.operators import checks as K
from portcullis.operators.profiles import Profile, Settings
from portcullis.plans.scan import finding_rows, scan_items
from portcullis.queries.base import ITEMS_SQL, documents_items, query, rows, sql_list, table
from portcullis.schema import severity_name

HOME = Profile.load("homelab")
P = Settings.of(HOME)
MEDIA_SQL = " ".join(f"WHEN ext IN {sql_list(v)} THEN '{k}'" for k, v in T.MEDIA_EXTENSIONS.items())
EXT_SQL = "lower(regexp_extract(name, '\\.([^.]*)$', 1))"
UTF8_HEX = ("[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]|"
         "E[1-9A-CEF](?:[89AB][0-9A-F]){2}|ED[89][0-9A-F][89AB][0-9A-F]|F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}|"
         "F[1-3](?:[89AB][0-9A-F]){3}|F48[0-9A-F](?:[89AB][0-9A-F]){2}")
_DANGER = sql_list(T.DANGEROUS_KINDS)


def _text_sql(h: str) -> str:
    """looks_text over hex: strip a BOM, wide text passes, then UTF-8 without controls."""
    b = f"CASE WHEN {h} LIKE 'EFBBBF%' THEN substr({h}, 7) ELSE {h} END"
    cuts = [f"substr(b, 1, greatest(length(b) - {2 * k}, 0))" for k in range(5)]
    arms = " ".join(f"WHEN regexp_full_match({c}, '(?:{UTF8_HEX})*') "
                    f"THEN NOT regexp_matches({c}, '^(?:..)*(?:0[0-8BEF]|1[0-9A-F])')" for c in cuts)
    return f"(SELECT CASE WHEN b LIKE 'FFFE%' OR b LIKE 'FEFF%' THEN true {arms} ELSE false END FROM (SELECT {b} AS b))"


def _at(offset: int, hexes: str) -> str:
    return f"substr(w, {2 * offset + 1}, {len(hexes)}) = '{hexes}'"


def _a(offset: int, s: str) -> str:
    return _at(offset, s.encode("latin-1").hex().upper())


_HTML = "^(?:..)*(?:3C(?:6|4)8(?:7|5)4(?:6|4)D(?:6|4)C|3C21(?:6|4)4(?:6|4)F(?:6|4)3(?:7|5)4(?:7|5)9(?:7|5)0(?:6|4)520(?:6|4)8(?:7|5)4(?:6|4)D(?:6|4)C|3C(?:7|5)3(?:6|4)3(?:7|5)2(?:6|4)9(?:7|5)0(?:7|5)4)"
_KIND = f"""CASE WHEN w IS NULL THEN NULL WHEN w = '' THEN 'empty'
 WHEN {_at(0, '1A45DFA3')} AND regexp_matches(substr(w, 1, 512), '^(?:..)*7765626D') THEN 'webm'
 WHEN {_at(0, '1A45DFA3')} THEN 'matroska'
 WHEN {_a(4, 'ftyp')} OR {_a(4, 'moov')} OR {_a(4, 'mdat')} OR {_a(4, 'wide')} OR {_a(4, 'free')} OR {_a(4, 'skip')} THEN 'mp4'
 WHEN {_a(0, 'RIFF')} AND {_a(8, 'AVI ')} THEN 'avi' WHEN {_a(0, 'RIFF')} AND {_a(8, 'WAVE')} THEN 'wav'
 WHEN {_at(0, '000001BA')} THEN 'mpegps' WHEN {_at(0, '464C5601')} THEN 'flv' WHEN {_at(0, '3026B2758E66CF11')} THEN 'asf'
 WHEN {_a(0, 'OggS')} THEN 'ogg' WHEN {_a(0, 'fLaC')} THEN 'flac'
 WHEN {_a(0, 'ID3')} OR regexp_matches(w, '^FF[EF][2-7A-F]') THEN 'mp3'
 WHEN {_a(0, 'MZ')} OR {_at(0, '7F454C46')} OR substr(w, 1, 8) IN ('FEEDFACE', 'FEEDFACF', 'CEFAEDFE', 'CFFAEDFE', 'CAFEBABE') THEN 'executable'
 WHEN substr(w, 1, 8) IN ('504B0304', '504B0506') OR {_at(0, '526172211A07')} OR {_at(0, '377ABCAF271C')} OR {_at(0, '1F8B')} THEN 'archive'
 WHEN {_a(0, '%PDF-')} THEN 'pdf'
 WHEN {_at(0, '89504E47')} OR {_at(0, 'FFD8FF')} OR {_a(0, 'GIF8')} OR {_a(0, 'BM')} OR ({_a(0, 'RIFF')} AND {_a(8, 'WEBP')}) THEN 'image'
 WHEN {_a(0, '#!')} THEN 'script'
 WHEN length(w) >= 1128 AND {_at(0, '47')} AND {_at(188, '47')} AND {_at(376, '47')} THEN 'mpegts'
 WHEN length(w) >= 1160 AND {_at(4, '47')} AND {_at(196, '47')} AND {_at(388, '47')} THEN 'mpegts'
 WHEN {_text_sql('w')} THEN CASE WHEN regexp_matches(w, '{_HTML}') THEN 'html' ELSE 'text' END
 ELSE 'unknown' END"""
_DETAIL = f"""CASE kind WHEN 'empty' THEN '' WHEN 'webm' THEN 'EBML doctype webm' WHEN 'matroska' THEN 'EBML header'
 WHEN 'mp4' THEN 'ISO BMFF brand ' || CASE WHEN {_a(4, 'ftyp')} AND length(w) >= 24 THEN trim(decode(unhex(substr(w, 17, 8)))) ELSE '' END
 WHEN 'avi' THEN 'RIFF AVI' WHEN 'wav' THEN 'RIFF WAVE' WHEN 'mpegps' THEN 'MPEG program stream pack header'
 WHEN 'asf' THEN 'ASF/WMV' WHEN 'mp3' THEN 'MPEG audio frame or ID3'
 WHEN 'executable' THEN CASE WHEN {_a(0, 'MZ')} THEN 'PE/DOS executable' WHEN {_at(0, '7F454C46')} THEN 'ELF' ELSE 'Mach-O' END
 WHEN 'archive' THEN CASE WHEN {_at(0, '50')} THEN 'zip' WHEN {_at(0, '52')} THEN 'rar' WHEN {_at(0, '37')} THEN '7z' ELSE 'gzip' END
 WHEN 'script' THEN 'shebang' WHEN 'mpegts' THEN CASE WHEN {_at(0, '47')} AND {_at(188, '47')} AND {_at(376, '47')}
   THEN '188-byte packets' ELSE '192-byte packets (m2ts)' END ELSE '' END"""
_ALLOWED_ROWS = ", ".join(f"('{e}', '{k}')" for e, ks in T.EXTENSION_KINDS.items() for k in ks)
SNIFFED_SQL = f"""{ITEMS_SQL},
 head AS (SELECT *, {EXT_SQL} AS ext, substr(h, 1, 16384) AS w FROM items),
 kinds AS (SELECT *, coalesce({_KIND}, 'unknown') AS kind, CASE {MEDIA_SQL} END AS cat FROM head),
 allowed(e, k) AS (VALUES {_ALLOWED_ROWS}),
 sniffed AS (SELECT *, CASE WHEN w IS NULL THEN '' ELSE {_DETAIL} END AS detail,
   kind = 'unknown' OR ext NOT IN (SELECT e FROM allowed) OR (ext, kind) IN (SELECT (e, k) FROM allowed) AS fits FROM kinds)"""


def sniffed(spark, sf):
    return documents_items(spark, sf).withColumn("s", C.sniff(F.col("content"))).withColumn(
        "kind", F.coalesce("s.kind", F.lit("unknown"))).withColumn("sniff_detail", F.coalesce("s.detail", F.lit("")))


@query("f01_ext", f"WITH {ITEMS_SQL} SELECT item_id, {EXT_SQL} AS ext FROM items")
def _(spark, sf):
    return documents_items(spark, sf).select("item_id", ext(F.col("name")).alias("ext"))


@query("f02_category", f"""WITH {ITEMS_SQL}, e AS (SELECT *, {EXT_SQL} AS ext FROM items)
 SELECT coalesce(CASE {MEDIA_SQL} END, 'sidecar') AS category, ext, count(*) AS n FROM e GROUP BY ALL""")
def _(spark, sf):
    e = documents_items(spark, sf).select(ext(F.col("name")).alias("ext"))
    return e.select("ext", F.coalesce(category(F.col("ext")), F.lit("sidecar")).alias("category")).groupBy(
        "category", "ext").agg(F.count("*").alias("n"))


@query("f03_empty", f"""WITH {ITEMS_SQL} SELECT item_id, 'EMPTY_FILE' AS code, 4 AS severity, 'empty file' AS message
 FROM items WHERE h = ''""")
def _(spark, sf):
    return rows(documents_items(spark, sf), K.check_empty(F.length("content")))


@query("f04_name_chars", f"""WITH {ITEMS_SQL}, c AS (SELECT item_id, regexp_extract(name, '(\\p{{Cf}})', 1) AS ch FROM items)
 SELECT item_id, 'BIDI_NAME' AS code, 4 AS severity, 'filename contains ' || CASE WHEN
   unicode(ch) IN (1564, 8206, 8207) OR unicode(ch) BETWEEN 8234 AND 8238 OR unicode(ch) BETWEEN 8294 AND 8297
   THEN 'bidi control U+' ELSE 'zero-width character U+' END || printf('%04X', unicode(ch)) || ' (extension spoofing)' AS message
 FROM c WHERE ch <> ''""")
def _(spark, sf):
    return rows(documents_items(spark, sf), K.check_name_chars(F.col("name")))


@query("f05_double_ext", f"""WITH {ITEMS_SQL}, p AS (SELECT item_id, string_split(lower(name), '.') AS s FROM items)
 SELECT item_id, 'DOUBLE_EXT' AS code, 1 AS severity, 'double extension .' || s[-2] || '.' || s[-1] AS message
 FROM p WHERE len(s) >= 3 AND s[-2] IN {sql_list(HOME['sidecars.block'])}""")
def _(spark, sf):
    return rows(documents_items(spark, sf), K.check_double_ext(F.col("name"), P["sidecars.block"]))


@query("f06_flag", """SELECT d.doc_id AS item_id, 'EXEC_PERM' AS code, CASE WHEN m.mode = 'fail' THEN 3 ELSE 1 END AS severity,
   'executable permission bit set' AS message, m.mode FROM labels d, (VALUES ('warn'), ('fail'), ('ignore')) m(mode)
 WHERE d.toxic = 1 AND m.mode <> 'ignore'""")
def _(spark, sf):
    marked = table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("flag"),
        F.explode(F.array(F.lit("ignore"), F.lit("warn"), F.lit("fail"))).alias("mode"))
    return K.to_rows(marked, K.gather(K.check_flag(F.col("flag"), F.col("mode"))), "item_id", "mode").select(
        "item_id", "code", "severity", "message", "mode")


@query("f07_sniff", f"WITH {SNIFFED_SQL} SELECT item_id, kind, detail FROM sniffed")
def _(spark, sf):
    return sniffed(spark, sf).select("item_id", "kind", F.col("sniff_detail").alias("detail"))


@query("f08_looks_text", f"WITH {SNIFFED_SQL} SELECT item_id, {_text_sql('w')} AS is_text FROM sniffed WHERE w IS NOT NULL")
def _(spark, sf):
    return documents_items(spark, sf).filter(F.col("content").isNotNull()).select(
        "item_id", C.looks_text(F.substring("content", 1, T.SNIFF_WINDOW)).alias("is_text"))


@query("f09_kind_class", f"""WITH {SNIFFED_SQL} SELECT CASE WHEN kind IN {sql_list(T.VIDEO_KINDS)} THEN 'video'
   WHEN kind IN {sql_list(T.AUDIO_KINDS)} THEN 'audio' WHEN kind IN {_DANGER} THEN 'dangerous' ELSE 'other' END AS class,
   kind, count(*) AS n FROM sniffed GROUP BY ALL""")
def _(spark, sf):
    return sniffed(spark, sf).groupBy(C.kind_class(F.col("kind")).alias("class"), "kind").agg(F.count("*").alias("n"))


@query("f10_dangerous", f"""WITH {SNIFFED_SQL} SELECT item_id, 'DANGEROUS_CONTENT' AS code, 4 AS severity,
   detail || ' ' || kind || ' content under a .' || ext || ' name' AS message FROM sniffed WHERE cat IS NOT NULL AND kind IN {_DANGER}""")
def _(spark, sf):
    return rows(sniffed(spark, sf), K.check_dangerous(F.col("name"), F.col("kind"), F.col("sniff_detail")))


@query("f11_unreadable", f"""WITH {ITEMS_SQL} SELECT item_id, 'UNREADABLE' AS code, 3 AS severity,
   'content could not be read' AS message FROM items WHERE h IS NULL""")
def _(spark, sf):
    return rows(documents_items(spark, sf), K.check_unreadable(F.col("content")))


@query("f12_ext_mismatch", f"""WITH {SNIFFED_SQL} SELECT item_id, 'EXT_MISMATCH' AS code, 3 AS severity,
   'content is ' || kind || ' but extension is .' || ext AS message FROM sniffed WHERE cat IS NOT NULL AND NOT fits""")
def _(spark, sf):
    return rows(sniffed(spark, sf), K.check_ext_mismatch(F.col("name"), F.col("kind")))


_POLY = "CASE WHEN contains(substr(h, 1, 2097152), '{stub}') THEN 'PE executable stub string inside file' {arms} END".format(
    stub=T.STUB_TEXT.encode().hex().upper(), arms=" ".join(
        f"WHEN regexp_matches(right(h, 2097152), '^(?:..)*{sig}') THEN 'archive/executable signature \"{shown}\" near end of file (appended payload)'"
        for sig, shown in T.PAYLOAD_SIGNATURES))


@query("f13_polyglot", f"""WITH {SNIFFED_SQL}, p AS (SELECT item_id, {_POLY} AS m FROM sniffed WHERE cat IS NOT NULL)
 SELECT item_id, 'POLYGLOT' AS code, 4 AS severity, m AS message FROM p WHERE m IS NOT NULL""")
def _(spark, sf):
    return rows(documents_items(spark, sf), K.check_polyglot(F.col("name"), F.col("content")))


def _sidecar_sql(p: Profile, extra: str = "") -> str:
    b, a = sql_list(p["sidecars.block"]), sql_list(p["sidecars.allow"])
    return f"""SELECT item_id, CASE WHEN ext IN {b} THEN 'SIDECAR_BLOCKED' WHEN kind IN {_DANGER} THEN 'DANGEROUS_CONTENT'
   WHEN ext IN {a} AND NOT fits THEN 'EXT_MISMATCH' WHEN ext IN {a} THEN 'SIDECAR_OK' ELSE 'SIDECAR_UNKNOWN' END AS code,
  CASE WHEN ext IN {b} OR kind IN {_DANGER} THEN 4 WHEN ext IN {a} AND NOT fits THEN 3 WHEN ext IN {a} THEN 0 ELSE 1 END AS severity,
  CASE WHEN ext IN {b} THEN 'blocked sidecar type .' || ext WHEN kind IN {_DANGER} THEN kind || ' content under a .' || ext || ' name'
   WHEN ext IN {a} AND NOT fits THEN 'content is ' || kind || ' but extension is .' || ext
   WHEN ext IN {a} THEN 'allowed sidecar .' || ext ELSE 'unrecognised sidecar type .' || ext || ' (' || kind || ')' END AS message{extra}
  FROM sniffed WHERE cat IS NULL"""


@query("f14_sidecar", f"WITH {SNIFFED_SQL} {_sidecar_sql(HOME)}")
def _(spark, sf):
    return rows(sniffed(spark, sf), K.check_sidecar(F.col("name"), F.col("kind"), P))


# The run over one item in order; the first terminal stage ends it (no notes: their text is L7's).
_B, _A = sql_list(HOME["sidecars.block"]), sql_list(HOME["sidecars.allow"])
_RUN_SQL = f"""{SNIFFED_SQL}, poly AS (SELECT *, {_POLY} AS pm, string_split(lower(name), '.') AS s FROM sniffed),
 found AS (
  SELECT item_id, 1 AS stage, true AS terminal, 'BIDI_NAME' AS code, 4 AS severity FROM poly WHERE regexp_matches(name, '\\p{{Cf}}')
  UNION ALL SELECT item_id, 2, true, 'EMPTY_FILE', 4 FROM poly WHERE h = ''
  UNION ALL SELECT item_id, 5, false, 'DOUBLE_EXT', 1 FROM poly WHERE len(s) >= 3 AND s[-2] IN {_B}
  UNION ALL SELECT item_id, 6, true, 'UNREADABLE', 3 FROM poly WHERE h IS NULL
  UNION ALL SELECT item_id, 7, false, CASE WHEN ext IN {_B} THEN 'SIDECAR_BLOCKED' WHEN kind IN {_DANGER} THEN 'DANGEROUS_CONTENT'
    WHEN ext IN {_A} AND NOT fits THEN 'EXT_MISMATCH' WHEN ext IN {_A} THEN 'SIDECAR_OK' ELSE 'SIDECAR_UNKNOWN' END,
    CASE WHEN ext IN {_B} OR kind IN {_DANGER} THEN 4 WHEN ext IN {_A} AND NOT fits THEN 3 WHEN ext IN {_A} THEN 0 ELSE 1 END
    FROM poly WHERE cat IS NULL
  UNION ALL SELECT item_id, 8, true, 'DANGEROUS_CONTENT', 4 FROM poly WHERE cat IS NOT NULL AND kind IN {_DANGER}
  UNION ALL SELECT item_id, 9, false, 'EXT_MISMATCH', 3 FROM poly WHERE cat IS NOT NULL AND NOT fits
  UNION ALL SELECT item_id, 10, true, 'POLYGLOT', 4 FROM poly WHERE cat IS NOT NULL AND pm IS NOT NULL),
 stops AS (SELECT item_id, min(stage) AS last FROM found WHERE terminal GROUP BY item_id),
 kept AS (SELECT f.* FROM found f LEFT JOIN stops USING (item_id) WHERE stage <= coalesce(last, 999))"""
def _not_notes():
    return ~F.col("code").isin("NOTE_KNOWN", "NOTE_TEXT", "LINK_IN_SIDECAR", "DECODE_FAIL")



@query("f15_stop_at_terminal", f"WITH {_RUN_SQL} SELECT item_id, code, severity FROM kept")
def _(spark, sf):
    found = finding_rows(scan_items(documents_items(spark, sf).drop("declared"), HOME))
    return found.filter(_not_notes()).select("item_id", "code", "severity")


@query("f15_stop_at_terminal_long", f"WITH {_RUN_SQL} SELECT code, count(*) AS n FROM kept GROUP BY code")
def _(spark, sf):
    """The same rule where findings come from several tables: no array per item."""
    s = sniffed(spark, sf)
    n, k = F.col("name"), F.col("kind")
    every = [K.check_name_chars(n), K.check_empty(F.length("content")), K.check_double_ext(n, P["sidecars.block"]),
             K.check_unreadable(F.col("content")), K.check_sidecar(n, k, P), K.check_dangerous(n, k, F.col("sniff_detail")),
             K.check_ext_mismatch(n, k), K.check_polyglot(n, F.col("content"))]
    long = K.to_rows(s, K.gather(*every), "item_id")
    return K.stop_at_terminal_rows(long).groupBy("code").agg(F.count("*").alias("n"))


@query("f15_item_verdicts", f"""WITH {_RUN_SQL}, worst AS (SELECT item_id, max(severity) AS v FROM kept GROUP BY item_id),
 judged AS (SELECT i.grp, coalesce(w.v, 0) AS v FROM items i LEFT JOIN worst w USING (item_id))
 SELECT grp, CASE v WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 3 THEN 'FAIL' ELSE 'BLOCK' END AS verdict, count(*) AS files
 FROM judged GROUP BY ALL""")
def item_verdicts(spark, sf):
    """Verdict counts per source of the item checks, without notes and decode checks."""
    scanned = scan_items(documents_items(spark, sf).drop("declared"), HOME, tier="none")
    quiet = scanned.withColumn("verdict", F.coalesce(F.array_max(F.transform(
        F.filter("findings", lambda f: f["code"] != "LINK_IN_SIDECAR"), lambda f: f["severity"])), F.lit(0)))
    return quiet.groupBy("grp", "verdict").agg(F.count("*").alias("files")).select(
        "grp", severity_name(F.col("verdict")).alias("verdict"), "files")
