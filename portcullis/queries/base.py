"""Relations of the gate read from the given tables, each with the same relation as DuckDB SQL.

Files that arrive damaged, disguised or spoofed are not in the tables, so they are derived from
them: every rule below depends on a row's own key, and the work grows with the table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.schema import gather, text, to_rows
from portcullis.sources import items as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def by_rest(column: Column, modulus: int, values: list, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for i, v in enumerate(values):
        out = out.when(column % modulus == i, F.lit(v))
    return out.otherwise(F.lit(default))


def sql_by_rest(column: str, modulus: int, values: list[str], default: str) -> str:
    arms = " ".join(f"WHEN {column} % {modulus} = {i} THEN {sql_str(v)}" for i, v in enumerate(values))
    return f"CASE {arms} ELSE {sql_str(default)} END"


# --- items ------------------------------------------------------------------------------------
EXTENSIONS = ["txt", "nfo", "srt", "html", "exe", "mkv", "md5", "zzz"]
# hex put in front of / behind a body, by doc_id % 53
PREFIXES = ["4D5A9000", "1A45DFA3", "255044462D", "FFFE", "00000018667479706D703432",
            "23212F62696E2F73680A", "FF", "", "", "524946460000000041564920", "3C68746D6C3E",
            "", "", "1A45DFA3010000007765626D", "0001", "7F454C46", "EFBBBF", "424D"]
SUFFIXES = {11: "504B0304", 12: "This program cannot be run in DOS mode".encode().hex().upper()}


def documents_items(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, grp, name, path, body, content (bytes as they arrived), declared."""
    d = F.col("doc_id")
    infix = (F.when(d % 31 == 0, "‮").when(d % 37 == 0, "​").when(d % 41 == 0, ".exe").otherwise(""))
    name = F.concat(F.lit("doc-"), d.cast("string"), infix, F.lit("."), by_rest(d, 8, EXTENSIONS, ""))
    body = F.concat(F.unhex(by_rest(d, 53, PREFIXES, "")), F.encode("text", "UTF-8"),
                    F.when(d % 53 == 11, F.unhex(F.lit(SUFFIXES[11]))).when(d % 53 == 12, F.unhex(F.lit(SUFFIXES[12])))
                    .otherwise(F.unhex(F.lit(""))))
    content = F.when(d % 53 == 7, F.unhex(F.lit(""))).when(d % 53 == 8, F.lit(None)).otherwise(body)
    return table(spark, sf, "documents").select(
        d.alias("item_id"), F.col("source").alias("grp"), name.alias("name"),
        F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), name).alias("path"),
        F.col("text").alias("body"), content.alias("content"),
        F.when(d % 43 == 0, F.col("n_chars") + 7).otherwise(F.col("n_chars")).alias("declared"))


ITEMS_SQL = f"""items AS (
  SELECT doc_id AS item_id, source AS grp, text AS body,
    CASE WHEN doc_id % 43 = 0 THEN n_chars + 7 ELSE n_chars END AS declared,
    'doc-' || doc_id || CASE WHEN doc_id % 31 = 0 THEN chr(8238) WHEN doc_id % 37 = 0 THEN chr(8203)
      WHEN doc_id % 41 = 0 THEN '.exe' ELSE '' END || '.' || {sql_by_rest('doc_id', 8, EXTENSIONS, '')} AS name,
    CASE WHEN doc_id % 53 = 7 THEN '' WHEN doc_id % 53 = 8 THEN NULL ELSE
      {sql_by_rest('doc_id', 53, PREFIXES, '')} || hex(encode(text)) ||
      CASE WHEN doc_id % 53 = 11 THEN '{SUFFIXES[11]}' WHEN doc_id % 53 = 12 THEN '{SUFFIXES[12]}' ELSE '' END
    END AS h FROM documents)"""


# --- parts ------------------------------------------------------------------------------------
def document_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the parts of their source: few items with very many parts each."""
    d = F.col("doc_id")
    return S.as_parts(
        table(spark, sf, "documents"), item_id="source", idx="doc_id", text="text",
        type=by_rest(d, 3, ["video", "audio", "subtitle"], ""), codec=F.concat(F.lit("c"), (d % 4).cast("string")),
        lang=F.when(d % 7 == 0, "").otherwise(F.col("lang")),
        ietf=F.when(d % 10 == 0, F.concat("lang", F.lit("-XX"))).otherwise(""),
        title=F.when(d % 13 == 0, "Commentary").when(d % 6 == 0, text("see www.site", d, ".com now")).otherwise(""),
        is_default=d % 5 == 0, forced=d % 11 == 0, commentary=d % 17 == 0, hearing_imp=d % 4 == 0,
        attached_pic=d % 9 == 0, text_sub=d % 2 == 0)


DOCUMENT_PARTS_SQL = """parts AS (
  SELECT source AS item_id, doc_id AS idx,
    CASE doc_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END AS type, 'c' || (doc_id % 4) AS codec,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS lang,
    CASE WHEN doc_id % 10 = 0 THEN lang || '-XX' ELSE '' END AS ietf,
    CASE WHEN doc_id % 13 = 0 THEN 'Commentary' WHEN doc_id % 6 = 0 THEN 'see www.site' || doc_id || '.com now' ELSE '' END AS title,
    doc_id % 5 = 0 AS is_default, doc_id % 11 = 0 AS forced, doc_id % 17 = 0 AS commentary,
    doc_id % 4 = 0 AS hearing_imp, doc_id % 9 = 0 AS attached_pic, doc_id % 2 = 0 AS text_sub, text
  FROM documents)"""


def order_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as the parts of their order: very many items with a few parts each. Lines that
    share a number are one part."""
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.ascii("l_returnflag")).alias("flag"), F.min(F.ascii("l_linestatus")).alias("status"), F.min("l_quantity").alias("qty"),
        F.min("l_discount").alias("disc"), F.min("l_tax").alias("tax"), F.min("l_partkey").alias("pk"))
    q = F.col("qty")
    return S.as_parts(
        line, item_id="l_orderkey", idx="l_linenumber",
        type=F.when(F.col("flag") == ord("A"), "audio").when(F.col("flag") == ord("R"), "subtitle").otherwise("video"),
        codec=F.concat(F.lit("c"), (F.col("pk") % 5).cast("string")),
        lang=F.when(F.col("status") == ord("F"), "").when(q < 15, "de").when(q < 30, "eng").otherwise("en-US"),
        ietf=F.when(F.col("pk") % 11 == 0, "pt-BR").otherwise(""),
        title=F.when(F.col("pk") % 13 == 0, "Director's commentary").otherwise(""),
        is_default=F.col("disc") < 0.05, forced=F.col("tax") < 0.02, hearing_imp=q > 25, commentary=q > 46,
        attached_pic=F.col("pk") % 9 == 0, text_sub=F.col("pk") % 2 == 0)


ORDER_PARTS_SQL = """parts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS item_id, l_linenumber AS idx,
    CASE flag WHEN 'A' THEN 'audio' WHEN 'R' THEN 'subtitle' ELSE 'video' END AS type, 'c' || (pk % 5) AS codec,
    CASE WHEN status = 'F' THEN '' WHEN qty < 15 THEN 'de' WHEN qty < 30 THEN 'eng' ELSE 'en-US' END AS lang,
    CASE WHEN pk % 11 = 0 THEN 'pt-BR' ELSE '' END AS ietf,
    CASE WHEN pk % 13 = 0 THEN 'Director''s commentary' ELSE '' END AS title,
    disc < 0.05 AS is_default, tax < 0.02 AS forced, qty > 25 AS hearing_imp, qty > 46 AS commentary,
    pk % 9 = 0 AS attached_pic, pk % 2 = 0 AS text_sub
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_quantity) AS qty,
          min(l_discount) AS disc, min(l_tax) AS tax, min(l_partkey) AS pk
        FROM lineitem GROUP BY l_orderkey, l_linenumber))"""


def document_attachments(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    ending = by_rest(d, 4, ["ttf", "jpg", "bin", "otf"], "")
    mime = by_rest(d, 3, ["application/octet-stream", "font/ttf", "image/png"], "")
    payload = F.concat(F.unhex(by_rest(d, 19, ["4D5A", "504B0304", "7F454C46"], "")), F.encode("text", "UTF-8"))
    return S.as_attachments(table(spark, sf, "documents"), item_id="source", att_id="doc_id",
                            file_name=F.concat(F.lit("a"), d.cast("string"), F.lit("."), ending), mime=mime,
                            size="n_chars", payload=payload)


ATTACHMENTS_SQL = """attachments AS (
  SELECT source AS item_id, doc_id AS att_id, 'a' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'ttf' WHEN 1 THEN 'jpg'
      WHEN 2 THEN 'bin' ELSE 'otf' END AS file_name,
    CASE doc_id % 3 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'font/ttf' ELSE 'image/png' END AS mime,
    n_chars AS size, CASE doc_id % 19 WHEN 0 THEN 'executable PE/DOS executable' WHEN 1 THEN 'archive zip'
      WHEN 2 THEN 'executable ELF' END AS bad FROM documents)"""


def event_attrs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as items with a metadata map: item_id, tags, title, writing_app, muxing_app, counts."""
    e, k = F.col("event_id"), F.col("n")
    props = S.tags_from_json(F.col("props"))
    df = table(spark, sf, "events").withColumn("props_map", props).withColumn(
        "n", F.try_element_at("props_map", F.lit("k")).cast("long"))
    key = by_rest(e, 11, PROVENANCE_SAMPLE, "----:x.y:Z")
    extra = F.when(e % 2 == 0, F.create_map(key, text("v", k))).otherwise(F.create_map().cast("map<string,string>"))
    info = F.when(e % 3 == 0, F.create_map(by_rest(e, 9, INFO_SAMPLE, "Encoder"), text(F.col("event_type"), k))).otherwise(
        F.create_map().cast("map<string,string>"))
    link = F.when(e % 5 == 0, F.create_map(F.lit("note"), text("get it at http://t", k, ".example.com/x and www.g", k, ".to."))
                  ).otherwise(F.create_map().cast("map<string,string>"))
    return df.select(e.alias("item_id"), F.map_concat("props_map", extra, info, link).alias("tags"), "event_type", "value",
                     F.col("ts"), k.alias("k"),
                     F.when(e % 7 == 0, text("see t", k, ".net")).otherwise("").alias("title"),
                     F.when(e % 4 == 0, text("app ", k)).otherwise("").alias("writing_app"),
                     F.when(e % 6 == 0, text("mux ", k)).otherwise("").alias("muxing_app"),
                     (e % 3).alias("global_tags"), (e % 2).alias("track_tags"), (e % 13 == 0).alias("has_xmp"))


PROVENANCE_SAMPLE = ["ownr", "apID", "©too", "xid ", "----:com.apple.iTunes:iTunNORM", "desc", "----:a.b:Free", "©cmt",
                     "flvr", "©enc"]
INFO_SAMPLE = ["encoder", "ENCODED_BY", "comment", "Description", "creation_time", "handler_name", "other", "x"]

_KEY_SQL = sql_by_rest("event_id", 11, PROVENANCE_SAMPLE, "----:x.y:Z")
_INFO_SQL = sql_by_rest("event_id", 9, INFO_SAMPLE, "Encoder")
# long form of the same maps
EVENT_ATTRS_SQL = f"""ev AS (SELECT event_id AS item_id, event_id, event_type, value, ts, CAST(props->>'$.k' AS BIGINT) AS k,
    CASE WHEN event_id % 7 = 0 THEN 'see t' || CAST(props->>'$.k' AS BIGINT) || '.net' ELSE '' END AS title,
    CASE WHEN event_id % 4 = 0 THEN 'app ' || CAST(props->>'$.k' AS BIGINT) ELSE '' END AS writing_app,
    CASE WHEN event_id % 6 = 0 THEN 'mux ' || CAST(props->>'$.k' AS BIGINT) ELSE '' END AS muxing_app,
    event_id % 3 AS global_tags, event_id % 2 AS track_tags, event_id % 13 = 0 AS has_xmp FROM events),
  attrs AS (
    SELECT item_id, 'k' AS key, CAST(k AS VARCHAR) AS value FROM ev
    UNION ALL SELECT item_id, {_KEY_SQL}, 'v' || k FROM ev WHERE event_id % 2 = 0
    UNION ALL SELECT item_id, {_INFO_SQL}, event_type || k FROM ev WHERE event_id % 3 = 0
    UNION ALL SELECT item_id, 'note', 'get it at http://t' || k || '.example.com/x and www.g' || k || '.to.' FROM ev WHERE event_id % 5 = 0)"""


def rows(df: DataFrame, check: Column, key: str = "item_id", detail: bool = False) -> DataFrame:
    """Findings of one check in the columns the oracles state."""
    out = to_rows(df, gather(check), key)
    return out.select(key, "code", "severity", "message", *(["detail"] if detail else []))
