"""Queries of routing, destinations, quarantine and cleaning."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.operators import cleaning as C
from portcullis.operators import policy as D
from portcullis.operators import routing as R
from portcullis.operators import verify as V
from portcullis.operators.profiles import Profile, Settings
from portcullis.queries.base import (EVENT_ATTRS_SQL, ORDER_PARTS_SQL, by_rest, event_attrs, order_parts, query, rows,
                                     sql_by_rest, sql_list, table)
from portcullis.queries.metadata import ALIAS_SQL
from portcullis.queries.policy import PROFILES, RULES, decide_sql
from portcullis.session import checkpoint_dir, kept
from portcullis.sources.sinks import stored_items, write_clean, write_quarantine

HOME, ARCHIVE = PROFILES["homelab"], PROFILES["archive"]
P, PA, PR = Settings.of(HOME), Settings.of(ARCHIVE), Settings.of(RULES)
_EXT = ["mkv", "mkv", "mp4", "mka", "webm", "nfo", "MKV"]
_BOX = ["matroska", "mp4", "webm", "matroska"]
_ALL_MEDIA = sql_list([e for v in T.MEDIA_EXTENSIONS.values() for e in v])


def order_items(spark, sf):
    """Orders as items: path, verdict, container, parsed, copies, tool_warning, chapter_n and tags."""
    o, pr = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").select(
        o.cast("string").alias("item_id"),
        F.concat(F.lit("/in/"), (o % 50).cast("string"), F.lit("/m"), F.floor(o / 3).cast("string"), F.lit("."), by_rest(o, 7, _EXT, "")).alias("path"),
        F.when(pr == "1", 4).when(pr == "2", 3).when(pr == "3", 1).otherwise(0).alias("verdict"),
        by_rest(o, 4, _BOX, "").alias("container"), (o % 13 != 0).alias("parsed"),
        F.when(o % 9 == 0, 2).otherwise(1).alias("copies"), (o % 8 == 5).alias("tool_warning"), (o % 3).cast("int").alias("chapter_n"),
        F.when(o % 5 == 0, F.concat(F.lit("T"), o.cast("string"))).otherwise("").alias("title"),
        (o % 4).cast("int").alias("global_tags"), (o % 2).cast("int").alias("track_tags"),
        F.when(o % 6 == 0, "mux").otherwise("").alias("muxing_app"), F.lit("").alias("writing_app"),
        F.create_map(F.lit("a"), F.lit("b")).alias("tags"), o.alias("n"))


ORDER_ITEMS_SQL = f"""oitems AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderkey AS n,
  '/in/' || (o_orderkey % 50) || '/m' || (o_orderkey // 3) || '.' || {sql_by_rest('o_orderkey', 7, _EXT, '')} AS path,
  CASE o_orderpriority[1] WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 1 ELSE 0 END AS verdict, {sql_by_rest('o_orderkey', 4, _BOX, '')} AS container,
  o_orderkey % 13 <> 0 AS parsed, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 1 END AS copies, o_orderkey % 8 = 5 AS tool_warning, o_orderkey % 3 AS chapter_n,
  CASE WHEN o_orderkey % 5 = 0 THEN 'T' || o_orderkey ELSE '' END AS title, o_orderkey % 4 AS global_tags, o_orderkey % 2 AS track_tags,
  CASE WHEN o_orderkey % 6 = 0 THEN 'mux' ELSE '' END AS muxing_app FROM orders),
 ox AS (SELECT *, lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS ext FROM oitems)"""
_MEDIA = f"ext IN {_ALL_MEDIA}"


@query("r01_refuse", f"""WITH {ORDER_ITEMS_SQL} SELECT item_id, CASE WHEN verdict >= 4 THEN 4 ELSE 3 END AS severity,
  CASE WHEN verdict >= 4 THEN 'scan verdict BLOCK' WHEN verdict >= 3 THEN 'scan verdict FAIL' ELSE 'no probe result' END AS reason FROM ox WHERE {_MEDIA} AND (verdict >= 3 OR NOT parsed)""")
def _(spark, sf):
    r = order_items(spark, sf).withColumn("r", R.refuse(F.col("path"), F.col("verdict"), F.col("parsed"), F.lit(False)))
    return r.filter(F.col("r").isNotNull()).select("item_id", "r.severity", "r.reason")


def _ready(spark, sf, p, stored=True):
    """Items, decided parts and reasons; ``stored`` where more than the reasons is read."""
    decided = D.decide(order_parts(spark, sf), p)
    if stored:
        decided = kept(decided.select(*R.DECIDED))
    facts = decided.groupBy("item_id").agg((~F.max("has_video")).alias("no_video"))
    items = order_items(spark, sf).join(facts, "item_id", "left").withColumn("no_video", F.coalesce("no_video", F.lit(True)))
    reasons = R.rebuild_reasons(decided, None, items.select("item_id", "chapter_n"), p)
    return items, decided, reasons


def _reasons_sql(p: Profile) -> str:
    chapters = "" if p["chapters.keep"] else " UNION ALL SELECT item_id, 1000000, 9, 'chapters dropped' FROM ox WHERE chapter_n > 0"
    return f"""reasons AS (
   SELECT item_id, idx, 0 AS pos, 'drop #' || idx || ' ' || type || ' ' || codec || ' ' || CASE WHEN lang = '' THEN 'und' ELSE lang END || ': ' || reason AS reason FROM decided WHERE NOT keep
   UNION ALL SELECT item_id, idx, 1, '#' || idx || ' default flag ' || is_default || ' -> ' || out_default FROM decided WHERE keep AND type <> 'video' AND is_default <> out_default
   UNION ALL SELECT item_id, idx, 2, '#' || idx || ' forced flag ' || forced || ' -> ' || out_forced FROM decided WHERE keep AND type <> 'video' AND forced <> out_forced
   UNION ALL SELECT item_id, idx, 3, '#' || idx || ' language und -> ' || set_language FROM decided WHERE keep AND set_language <> ''{chapters})"""


def _route_sql(p: Profile, force: bool) -> str:
    f = "true" if force else "false"
    mode = p["safety.hardlinks"]
    rebuilt = f"'hard-linked; rebuilt rather than edited in place (safety.hardlinks = {mode})'"
    linked_route = "'remux'" if mode in ("break", "copy") else "'skip'"
    linked_reason = rebuilt if mode in ("break", "copy") else "'hard-linked'"
    return f"""{decide_sql(p)}, {_reasons_sql(p)}, facts AS (SELECT item_id, NOT bool_or(has_video) AS nv FROM decided GROUP BY item_id),
 rc AS (SELECT item_id, string_agg(reason, '; ' ORDER BY idx, pos) AS why FROM reasons GROUP BY item_id),
 joined AS (SELECT ox.*, coalesce(nv, true) AS no_video, coalesce(why, '') AS why, {_MEDIA} AS media, ext IN {sql_list(T.MEDIA_EXTENSIONS['audio'] + ['mks'])} AS side FROM ox LEFT JOIN facts USING (item_id) LEFT JOIN rc USING (item_id)),
 routed AS (SELECT *, CASE WHEN NOT media THEN 'skip' WHEN verdict >= 4 OR (verdict >= 3 AND NOT {f}) OR NOT parsed THEN 'skip' WHEN NOT {f} AND NOT side AND no_video THEN 'skip'
   WHEN verdict >= 3 AND {f} AND NOT side THEN 'remux' WHEN copies > 1 AND side THEN 'skip' WHEN copies > 1 THEN {linked_route} WHEN side THEN 'clean'
   WHEN ext <> 'mkv' OR container NOT IN ('matroska', 'webm') THEN 'remux' WHEN tool_warning THEN 'remux' WHEN why <> '' THEN 'remux' ELSE 'clean' END AS route,
  CASE WHEN NOT media THEN 'sidecar' WHEN verdict >= 4 THEN 'scan verdict BLOCK' WHEN verdict >= 3 AND NOT {f} THEN 'scan verdict FAIL' WHEN NOT parsed THEN 'no probe result' WHEN NOT {f} AND NOT side AND no_video THEN 'decision failed'
   WHEN verdict >= 3 AND {f} AND NOT side THEN 'scan verdict FAIL; rebuilt because --force was given' WHEN copies > 1 AND side THEN 'hard-linked audio or subtitle file'
   WHEN copies > 1 THEN {linked_reason} WHEN side AND verdict >= 3 THEN 'scan verdict FAIL; cleaned because --force was given' WHEN side THEN 'audio or subtitle container; metadata only'
   WHEN ext <> 'mkv' OR container NOT IN ('matroska', 'webm') THEN 'container ' || container || ' is rebuilt as Matroska' WHEN tool_warning THEN 'mkvmerge reported warnings; rebuilding' WHEN why <> '' THEN why
   ELSE 'tracks, flags, attachments and chapters already match the profile' END AS reason FROM joined)"""


BREAK = Profile.build("break", {"safety.hardlinks": "break"})
for _name, _profile, _force in (("r02_route", ARCHIVE, False), ("r02_route_forced", BREAK, True)):
    @query(_name, f"WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, {ORDER_ITEMS_SQL}, {_route_sql(_profile, _force)} SELECT item_id, route, CASE WHEN reason = why THEN '' ELSE reason END AS reason FROM routed")
    def _(spark, sf, profile=_profile, force=_force):
        p = Settings.of(profile)
        items, _, reasons = _ready(spark, sf, p)
        return R.route_items(items, reasons, p, force).select("item_id", "route", "reason")


@query("r03_needs_rebuild", f"WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, {ORDER_ITEMS_SQL}, {decide_sql(RULES)}, {_reasons_sql(RULES)} SELECT item_id, count(*) AS n, string_agg(reason, '; ' ORDER BY idx, pos) AS reasons FROM reasons GROUP BY item_id")
def _(spark, sf):
    _, _, reasons = _ready(spark, sf, PR, stored=False)
    return R.reason_lists(reasons).select("item_id", F.col("total").alias("n"), F.array_join("reasons", "; ").alias("reasons"))


@query("r03_reason_entries", f"WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, {ORDER_ITEMS_SQL}, {decide_sql(RULES)}, {_reasons_sql(RULES)} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY idx, pos) AS ordinal, reason FROM reasons")
def _(spark, sf):
    return R.reason_entries(_ready(spark, sf, PR, stored=False)[2])


@query("r04_route_findings", f"""WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, {ORDER_ITEMS_SQL}, {_route_sql(ARCHIVE, False)}
 SELECT item_id, 'REFUSED' AS code, CASE WHEN verdict >= 4 THEN 4 ELSE 3 END AS severity, CASE WHEN verdict >= 4 THEN 'blocked by the scan' WHEN verdict >= 3 THEN 'failed by the scan; only a forced run goes on' ELSE 'the scan found no parts in it' END AS message
   FROM routed WHERE media AND (verdict >= 3 OR NOT parsed)
 UNION ALL SELECT item_id, 'HARDLINKED', 1, CASE WHEN side THEN copies || ' names share this file, and an edit in place would show under all of them' ELSE copies || ' names share this file; left alone (safety.hardlinks = skip)' END FROM routed WHERE reason LIKE 'hard-linked%'
 UNION ALL SELECT item_id, 'ROUTE', 0, route || ': ' || reason FROM routed""")
def _(spark, sf):
    items, _, reasons = _ready(spark, sf, PA)
    return R.route_findings(R.route_items(items, reasons, PA), reasons).select("item_id", "code", "severity", "message")


# --- destinations -------------------------------------------------------------------------------------
def _dest_sql(fold: bool, dry: bool) -> str:
    slot = "lower(dest)" if fold else "dest"
    done = "'DRY_RUN'" if dry else "'PLACED'"
    said = "'would write ' || dest" if dry else "'written and verified'"
    return f"""{ORDER_ITEMS_SQL}, d AS (SELECT *, verdict < 3 AS eligible, '/in__remuxed/' || regexp_replace(substr(path, 5), '\\.[^./]*$', '') || '.mkv' AS dest FROM ox),
 e AS (SELECT *, {slot} AS slot FROM d), ex AS (SELECT DISTINCT slot FROM e WHERE n % 40 = 0),
 r AS (SELECT e.*, ex.slot IS NOT NULL AS taken FROM e LEFT JOIN ex USING (slot)),
 w AS (SELECT *, row_number() OVER (PARTITION BY slot, eligible ORDER BY path) AS rn FROM r)
 SELECT item_id, dest, CASE WHEN NOT eligible THEN NULL WHEN taken OR rn > 1 THEN 'OUTPUT_EXISTS' ELSE {done} END AS code, CASE WHEN NOT eligible THEN NULL WHEN taken OR rn > 1 THEN 3 ELSE 0 END AS severity,
   CASE WHEN NOT eligible THEN NULL WHEN taken OR rn > 1 THEN dest || ' already exists' ELSE {said} END AS message FROM w"""


def _planned(spark, sf, fold, dry):
    items = order_items(spark, sf).withColumn("eligible", F.col("verdict") < 3)
    existing = items.filter(F.col("n") % 40 == 0).select(R.output_key(F.col("path"), "/in").alias("key"))
    return R.plan_destinations(items, "/in", existing=existing, fold_case=fold, dry_run=dry).select(
        "item_id", "dest", "code", "severity", "message")


for _name, _fold, _dry in (("r05_plan_destinations", False, False), ("r05_plan_destinations_folded", True, False), ("r06_dry_run", False, True)):
    @query(_name, "WITH " + _dest_sql(_fold, _dry))
    def _(spark, sf, fold=_fold, dry=_dry):
        return _planned(spark, sf, fold, dry)


@query("s06_write_clean_plan", "WITH " + _dest_sql(False, False).replace("SELECT item_id, dest, CASE", "SELECT dest, item_id, CASE").replace("FROM w", "FROM w WHERE eligible AND NOT taken AND rn = 1"))
def _(spark, sf):
    return _planned(spark, sf, False, False).filter("code = 'PLACED'")


@query("s05_quarantine_plan", f"""WITH {ORDER_ITEMS_SQL}, b AS (SELECT *, CASE WHEN n % 10 = 0 THEN '/else/' || n || '.mkv' ELSE path END AS loc FROM ox WHERE verdict = 4),
 k AS (SELECT *, CASE WHEN loc LIKE '/in/%' THEN substr(loc, 5) ELSE regexp_extract(loc, '([^/]*)$', 1) END AS key FROM b), st AS (SELECT DISTINCT key FROM k WHERE n % 25 = 0),
 r AS (SELECT k.*, st.key IS NOT NULL AS taken, min(loc) OVER (PARTITION BY k.key) AS win FROM k LEFT JOIN st ON st.key = k.key)
 SELECT item_id, key, NOT taken AND loc = win AS moved, CASE WHEN NOT taken AND loc = win THEN 4 ELSE 1 END AS severity,
   CASE WHEN NOT taken AND loc = win THEN 'moved to /q/' || key ELSE 'quarantine failed: destination exists' END AS message FROM r""")
def _(spark, sf):
    n = F.col("n")
    items = order_items(spark, sf).withColumn("path", F.when(n % 10 == 0, F.concat(F.lit("/else/"), n.cast("string"), F.lit(".mkv"))).otherwise(F.col("path")))
    stored = items.filter((F.col("verdict") == 4) & (n % 25 == 0)).select(R.quarantine_key(F.col("path"), "/in").alias("key"))
    return R.plan_quarantine(items, "/in", "/q", stored).select("item_id", "key", "moved", "severity", "message")


# order items named by their number, so that paths are unique; three share one target
def _named(spark, sf):
    n = F.col("n").cast("string")
    return order_items(spark, sf).withColumn("path", F.concat(F.lit("/in/"), F.floor(F.col("n") / 3).cast("string"), F.lit("."), n)).withColumn(
        "content", F.encode(F.concat(F.lit("body "), n), "UTF-8"))


_NAMED_SQL = f"{ORDER_ITEMS_SQL}, nm AS (SELECT item_id, verdict, n, '/in/' || (n // 3) || '.' || n AS path FROM ox)"


@query("s06_write_clean", f"""WITH {_NAMED_SQL}, d AS (SELECT *, n // 3 || '.mkv' AS rel FROM nm WHERE verdict < 3)
 SELECT rel, min(path) AS path, 'body ' || arg_min(n, path) AS content FROM d GROUP BY rel""")
def _(spark, sf):
    """Outputs written and read back: the first of the items that share a target."""
    store = f"{checkpoint_dir(spark).rstrip('/')}/clean-{uuid.uuid4().hex}"
    for _ in range(2):  # a repeat of the same run changes nothing
        write_clean(_named(spark, sf).withColumn("eligible", F.col("verdict") < 3), "/in", store, run="first")
    return stored_items(spark, store).select(F.substring_index("key", "/", -1).alias("rel"), "path", F.decode("content", "UTF-8").alias("content"))


@query("s05_write_quarantine", f"WITH {_NAMED_SQL} SELECT substr(path, 5) AS key, path, 'body ' || n AS content FROM nm WHERE verdict = 4")
def _(spark, sf):
    """Blocked items moved to the store, mirrored below it, and read back."""
    store = f"{checkpoint_dir(spark).rstrip('/')}/quarantine-{uuid.uuid4().hex}"
    for run in ("first", "first", "second"):  # neither a repeat nor another run moves a key again
        write_quarantine(_named(spark, sf), "/in", store, run=run)
    return stored_items(spark, store).select("key", "path", F.decode("content", "UTF-8").alias("content"))


# --- cleaning ------------------------------------------------------------------------------------------
_WHAT_SQL = f"""{ORDER_ITEMS_SQL}, {ORDER_PARTS_SQL}, what AS (SELECT item_id, 0 AS r, (global_tags + track_tags) || ' tag entries' AS w FROM ox WHERE global_tags + track_tags > 0
   UNION ALL SELECT item_id, 1, 'title' FROM ox WHERE title <> '' UNION ALL SELECT item_id, 2, 'muxing/writing app, date' FROM ox WHERE muxing_app <> ''
   UNION ALL SELECT item_id, idx + 8, 'track #' || idx || ' name' FROM parts WHERE title <> '' AND type <> 'subtitle' AND item_id IN (SELECT item_id FROM ox)), agg AS (SELECT item_id, string_agg(w, ', ' ORDER BY r) AS s FROM what GROUP BY item_id)"""


@query("c01_strip_metadata", f"""WITH {_WHAT_SQL} SELECT item_id, CASE WHEN s IS NULL THEN 'NOTHING_TO_CLEAN' ELSE 'METADATA' END AS code, 0 AS severity, coalesce('removed ' || s, 'already clean') AS message FROM ox LEFT JOIN agg USING (item_id)""")
def _(spark, sf):
    items = order_items(spark, sf)
    parts = order_parts(spark, sf).withColumn("editable", F.col("type") != "subtitle")
    return C.clean_findings(items, C.removals(items, parts, PA)).select("item_id", "code", "severity", "message")


@query("c01_removal_entries", f"WITH {_WHAT_SQL} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY r) AS ordinal, w AS what FROM what")
def _(spark, sf):
    parts = order_parts(spark, sf).withColumn("editable", F.col("type") != "subtitle")
    return C.removal_entries(C.removals(order_items(spark, sf), parts, PA))


@query("c01_clean_twice", f"WITH {ORDER_ITEMS_SQL} SELECT item_id, 'NOTHING_TO_CLEAN' AS code FROM ox")
def _(spark, sf):
    """What was cleaned has nothing left to clean."""
    items = C.strip_items(order_items(spark, sf), PA)
    parts = C.strip_parts(order_parts(spark, sf), PA).withColumn("editable", F.lit(True))
    return C.clean_findings(items, C.removals(items, parts, PA)).select("item_id", "code")


_INERT = ["major_brand", "Minor_Version", "handler_name", "vendor_id", "language", "encoder"]
_VALUES = ["VideoHandler", "FFMP", "custom", "en"]


@query("c02_inert_filter", f"""WITH {EVENT_ATTRS_SQL}, t AS (SELECT item_id, key, value FROM attrs UNION ALL SELECT item_id, {sql_by_rest('event_id', 6, _INERT, '')} || '', {sql_by_rest('event_id', 4, _VALUES, '')} FROM ev WHERE event_id % 3 <> 0),
 s AS (SELECT t.*, CASE WHEN item_id % 2 = 0 THEN 'item' ELSE 'part' END AS scope FROM t)
 SELECT item_id, count(*) FILTER (NOT CASE WHEN scope = 'item' THEN lower(key) IN ('major_brand', 'minor_version', 'compatible_brands') ELSE lower(key) = 'language' OR (lower(key) = 'handler_name' AND value IN {sql_list(T.INERT_PART_TAGS['handler_name'])}) OR (lower(key) = 'vendor_id' AND value IN {sql_list(T.INERT_PART_TAGS['vendor_id'])}) END) AS counted FROM s GROUP BY item_id""")
def _(spark, sf):
    e = F.col("item_id")
    extra = F.when(e % 3 != 0, F.create_map(by_rest(e, 6, _INERT, ""), by_rest(e, 4, _VALUES, ""))).otherwise(F.create_map().cast("map<string,string>"))
    tagged = event_attrs(spark, sf).withColumn("all", F.map_concat("tags", extra))
    return tagged.select("item_id", F.size(F.map_keys(C.inert_filter(F.col("all"), F.when(e % 2 == 0, "item").otherwise("part")))).cast("long").alias("counted"))


_NS = "CASE WHEN key = 'k' THEN 'user.' || value WHEN key = 'note' THEN 'USER.x' ELSE 'trusted.user.' || key END"


@query("c03_strip_namespace", f"""WITH {EVENT_ATTRS_SQL}, n AS (SELECT item_id, {_NS} AS key FROM attrs UNION ALL SELECT item_id, 'user.' FROM ev)
 SELECT item_id, count(*) FILTER (NOT (key LIKE 'user._%')) AS left_over, 'removed xattr ' || string_agg(key, ', ' ORDER BY key) FILTER (key LIKE 'user._%') AS message FROM n GROUP BY item_id""")
def _(spark, sf):
    def rename(k, v):
        return F.when(k == "k", F.concat(F.lit("user."), v)).when(k == "note", F.lit("USER.x")).otherwise(F.concat(F.lit("trusted.user."), k))
    a = event_attrs(spark, sf).withColumn("x", F.map_concat(F.transform_keys("tags", rename), F.create_map(F.lit("user."), F.lit("")) ))
    left, said = C.strip_namespace(F.col("x"), ["user."])
    return a.select("item_id", F.size(F.map_keys(left)).cast("long").alias("left_over"), said["message"].alias("message"))


_COPY_SQL = f"""src AS (SELECT *, sha256(codec || lang || title) AS raw FROM parts), outp AS (SELECT item_id, type, idx, CASE WHEN CAST(item_id AS BIGINT) % 19 = 0 AND idx = 3 THEN sha256('x' || raw) ELSE raw END AS raw FROM src WHERE NOT (CAST(item_id AS BIGINT) % 17 = 0 AND idx = 2))"""


def rewritten(spark, sf):
    """Order parts and an altered copy: one part lost or changed in some items."""
    n, i = F.col("item_id").cast("long"), F.col("idx")
    src = order_parts(spark, sf).withColumn("raw_hash", F.sha2(F.concat("codec", "lang", "title"), 256)).withColumn("canon_hash", F.col("raw_hash"))
    out = src.filter(~((n % 17 == 0) & (i == 2))).withColumn("raw_hash", F.when((n % 19 == 0) & (i == 3), F.sha2(F.concat(F.lit("x"), "raw_hash"), 256)).otherwise(F.col("raw_hash")))
    return src.withColumn("same_family", F.lit(True)), out.withColumn("canon_hash", F.col("raw_hash"))


@query("c04_verify_clean", f"""WITH {ORDER_PARTS_SQL}, {ORDER_ITEMS_SQL}, {_COPY_SQL},
 cnt AS (SELECT s.item_id FROM (SELECT item_id, type, count(*) c FROM src GROUP BY ALL) s LEFT JOIN (SELECT item_id, type, count(*) c FROM outp GROUP BY ALL) o USING (item_id, type) WHERE s.c <> coalesce(o.c, 0)),
 a AS (SELECT *, row_number() OVER (PARTITION BY item_id, type ORDER BY idx) AS o FROM src), b AS (SELECT *, row_number() OVER (PARTITION BY item_id, type ORDER BY idx) AS o FROM outp),
 mis AS (SELECT a.item_id, min(a.idx) AS idx FROM a JOIN b USING (item_id, type, o) WHERE a.raw <> b.raw GROUP BY a.item_id)
 SELECT DISTINCT item_id, 'CLEAN_FAIL' AS code, 'rewritten file does not match source stream layout' AS message FROM cnt
 UNION ALL SELECT item_id, 'HASH_MISMATCH', 'stream #' || idx || ' differs after rewrite; original untouched' FROM mis
 UNION ALL SELECT item_id, 'PURCHASE_ATOM', 'provenance survived rewrite: desc, ownr' FROM ox WHERE n % 100 = 0""")
def _(spark, sf):
    src, out = rewritten(spark, sf)
    none = F.create_map().cast("map<string,string>")
    left = order_items(spark, sf).select("item_id", F.when(F.col("n") % 100 == 0, F.create_map(F.lit("ownr"), F.lit("x"), F.lit("desc"), F.lit("y"))).otherwise(none).alias("attrs"), F.lit(False).alias("has_xmp"))
    return C.verify_clean(V.compare_parts(V.pair_parts(src, out)), V.verify_counts(src, out), left).select("item_id", "code", "message")


_SIDE = f"CASE WHEN ext IN {sql_list(HOME['sidecars.block'])}"


@query("c05_clean_sidecars", f"""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'exe' WHEN 1 THEN 'nfo' ELSE 'txt' END AS ext FROM part)
 SELECT p_partkey, {_SIDE} THEN 'SKIPPED' ELSE 'NOTHING_TO_CLEAN' END AS code, {_SIDE} THEN 1 ELSE 0 END AS severity, {_SIDE} THEN 'blocked sidecar .' || ext || ' stays; its removal was not asked for' ELSE 'sidecar; nothing to clean' END AS message FROM s""")
def _(spark, sf):
    k = F.col("p_partkey")
    s = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("p"), k.cast("string"), F.lit("."), by_rest(k, 3, ["exe", "nfo"], "txt")).alias("path"))
    return rows(s, C.clean_sidecar(F.col("path"), P, remove_blocked=False), "p_partkey")


_BOXES = ["matroska", "mp4", "avi", "mpegts", "mp3", "flac", "asf", "webm", "subtitle"]


@query("c06_clean_dispatch", f"""WITH b AS (SELECT l_partkey, {sql_by_rest('l_partkey', 9, _BOXES, '')} AS c FROM lineitem)
 SELECT c AS container, CASE WHEN c IN ('matroska', 'webm') THEN 'header' WHEN c IN ('mp4', 'avi', 'flv') THEN 'rewrite' ELSE 'none' END AS cleaner,
  CASE WHEN c IN ('matroska', 'webm', 'mp4', 'avi', 'flv') THEN '' WHEN c IN ('mpegts', 'mpegps') THEN 'NOTHING_TO_CLEAN' ELSE 'SKIPPED' END AS code, CASE WHEN c IN ('asf', 'subtitle') THEN 1 ELSE 0 END AS severity,
  CASE WHEN c IN ('matroska', 'webm', 'mp4', 'avi', 'flv') THEN '' WHEN c = 'mpegts' THEN 'mpegts holds no metadata that can be rewritten; rebuild it instead' WHEN c IN ('mp3', 'flac') THEN 'audio tags stay unless their removal is asked for' ELSE 'no cleaner for container ' || c END AS message, count(*) AS n FROM b GROUP BY ALL""")
def _(spark, sf):
    b = table(spark, sf, "lineitem").select(by_rest(F.col("l_partkey"), 9, _BOXES, "").alias("container"))
    d = b.withColumn("d", C.clean_dispatch(F.col("container")))
    return d.groupBy("container", "d.cleaner", "d.code", "d.severity", "d.message").agg(F.count("*").alias("n"))


