"""Whole plans over orders as items and their lines as parts: the scan with every finding, and an ingest run."""
from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.operators.verdict import verdict_counts
from portcullis.plans.ingest import ingest, scan_run
from portcullis.queries.base import ORDER_PARTS_SQL, order_parts, query, sql_list
from portcullis.queries.metadata import ALIAS_SQL
from portcullis.queries.policy import PROFILES
from portcullis.queries.routing import _MEDIA, ORDER_ITEMS_SQL, _route_sql, order_items

HOME = PROFILES["homelab"]
# every tenth item is a program under a media or note name; the seventh line of an order is a data stream
MATROSKA, MP4, PROGRAM = "1A45DFA3", "00000018667479706D703432", "4D5A9000"


def gate_items(spark, sf):
    n, e = F.col("n"), F.lower(F.substring_index("path", ".", -1))
    none = F.create_map().cast("map<string,string>")
    body = (F.when(n % 10 == 9, F.unhex(F.lit(PROGRAM))).when(e == "nfo", F.encode(F.lit("plain words"), "UTF-8"))
            .when(e == "mp4", F.unhex(F.lit(MP4))).otherwise(F.unhex(F.lit(MATROSKA))))
    items = order_items(spark, sf).drop("verdict", "parsed")
    return items.withColumn("name", F.substring_index("path", "/", -1)).withColumn("content", body).withColumn(
        "tags", F.when(n % 20 == 0, F.create_map(F.lit("ownr"), F.lit("x"))).when(n % 20 == 1, F.create_map(F.lit("note"), F.lit("see www.t.net"))).otherwise(none))


def gate_parts(spark, sf):
    return order_parts(spark, sf).withColumn("type", F.when(F.col("idx") == 7, "data").otherwise(F.col("type")))


_VIDEO, _AUDIO = sql_list(T.MEDIA_EXTENSIONS["video"]), sql_list(T.MEDIA_EXTENSIONS["audio"])
_PARTS = ORDER_PARTS_SQL.replace("parts AS (", "raw_parts AS (", 1) + """,
 parts AS (SELECT * REPLACE (CASE WHEN idx = 7 THEN 'data' ELSE type END AS type) FROM raw_parts)"""
_ITEMS = ORDER_ITEMS_SQL.replace("ox AS (SELECT *, lower(", "ox0 AS (SELECT * EXCLUDE (verdict, parsed), lower(", 1)
_UND = "lower(trim({c})) IN ('', 'und', 'unknown')"
_SCAN_SQL = f"""{ALIAS_SQL}, {_PARTS}, {_ITEMS},
 live AS (SELECT *, ext IN {_VIDEO} AS video, ext IN {_AUDIO} AS audio FROM ox0 WHERE {_MEDIA} AND n % 10 <> 9),
 lp AS (SELECT p.*, l.video, l.audio FROM parts p JOIN live l USING (item_id)),
 has AS (SELECT item_id, bool_or(type = 'video' AND NOT attached_pic) AS v, bool_or(type = 'audio') AS a, any_value(video) AS video, any_value(audio) AS audio FROM lp GROUP BY item_id),
 found AS (
  SELECT item_id, 'HARDLINKED' AS code, 0 AS severity FROM ox0 WHERE copies > 1
  UNION ALL SELECT item_id, 'DANGEROUS_CONTENT', 4 FROM ox0 WHERE n % 10 = 9
  UNION ALL SELECT item_id, unnest(['SIDECAR_OK', 'NOTE_TEXT']), 0 FROM ox0 WHERE NOT {_MEDIA} AND n % 10 <> 9
  UNION ALL SELECT item_id, 'UND_TRACK', 0 FROM lp WHERE type IN ('audio', 'subtitle') AND {_UND.format(c='lang')} AND {_UND.format(c='ietf')}
  UNION ALL SELECT item_id, 'DATA_STREAM', 4 FROM lp WHERE type = 'data'
  UNION ALL SELECT item_id, 'NO_VIDEO', 3 FROM has WHERE video AND NOT v
  UNION ALL SELECT item_id, 'NO_AUDIO', 3 FROM has WHERE audio AND NOT a
  UNION ALL SELECT item_id, 'LINK_IN_TAG', 1 FROM live WHERE n % 20 = 1
  UNION ALL SELECT item_id, 'PURCHASE_ATOM', 1 FROM live WHERE n % 20 = 0 AND container = 'mp4'),
 scanned AS (SELECT ox0.item_id, coalesce(max(severity), 0) AS verdict FROM ox0 LEFT JOIN found USING (item_id) GROUP BY ALL)"""


@query("plan_scan", f"WITH {_SCAN_SQL} SELECT item_id, code, severity, count(*) AS n FROM found GROUP BY ALL")
def _(spark, sf):
    _, found = scan_run(gate_items(spark, sf), gate_parts(spark, sf), HOME)
    return found.groupBy("item_id", "code", "severity").agg(F.count("*").alias("n"))


@query("plan_ingest", f"""WITH {_SCAN_SQL}, ox AS (SELECT ox0.*, s.verdict, p.item_id IS NOT NULL AS parsed FROM ox0 JOIN scanned s USING (item_id) LEFT JOIN (SELECT DISTINCT item_id FROM parts) p USING (item_id)),
 {_route_sql(HOME, False)},
 gate AS (SELECT * FROM routed WHERE media AND verdict < 3 AND parsed),
 late AS (SELECT item_id, verdict AS severity FROM routed
  UNION ALL SELECT item_id, 4 FROM routed WHERE media AND verdict >= 4
  UNION ALL SELECT item_id, 3 FROM routed WHERE media AND (verdict >= 3 OR NOT parsed)
  UNION ALL SELECT item_id, 1 FROM routed WHERE reason LIKE 'hard-linked%'
  UNION ALL SELECT item_id, 3 FROM gate WHERE no_video AND NOT side
  UNION ALL SELECT g.item_id, 1 FROM gate g JOIN decided d USING (item_id) WHERE d.audio_fallback OR d.reason = 'secondary video stream'),
 final AS (SELECT item_id, max(severity) AS verdict FROM late GROUP BY item_id)
 SELECT r.item_id, f.verdict, r.route, CASE WHEN r.reason = r.why THEN '' ELSE r.reason END AS reason FROM routed r JOIN final f USING (item_id)""")
def _(spark, sf):
    run = ingest(gate_items(spark, sf), gate_parts(spark, sf), HOME)
    return run.items.select("item_id", "verdict", "route", "reason")


@query("flagship_scan_verdicts", f"""WITH {_SCAN_SQL} SELECT container, CASE s.verdict WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 3 THEN 'FAIL' ELSE 'BLOCK' END AS verdict, count(*) AS files
 FROM ox0 JOIN scanned s USING (item_id) GROUP BY ALL""")
def flagship(spark, sf):
    """Verdict counts per container of a whole scan, nothing left out."""
    judged, _ = scan_run(gate_items(spark, sf), gate_parts(spark, sf), HOME)
    return verdict_counts(judged, "container")
