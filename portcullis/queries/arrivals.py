"""Queries of sources, intake and the settle window."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.operators import intake as H
from portcullis.operators.profiles import Profile
from portcullis.queries.base import EVENT_ATTRS_SQL, by_rest, event_attrs, query, sql_by_rest, table
from portcullis.session import checkpoint_dir
from portcullis.sources import items as S
from portcullis.sources.sinks import write_report
from portcullis.streaming import gate as J
from portcullis.streaming import settle as W


# --- sources ----------------------------------------------------------------------------------------
_FOLDER_BYTES = """SELECT coalesce(source, '') AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents GROUP BY ALL
 UNION ALL SELECT '', 0"""


def _as_files(spark, sf):
    """The documents as files, one folder for each source; the writer adds an empty _SUCCESS at the root."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/listed-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.col("source").alias("folder"))
    rows.repartition("folder").write.partitionBy("folder").text(root)
    return root


def _folder_bytes(files):
    """Bytes of every file, empty and hidden ones too, but for the writer's checksums."""
    return (files.filter(~F.col("name").endswith(".crc")).groupBy(F.regexp_extract("path", "/folder=([^/]*)/", 1).alias("folder"))
            .agg(F.sum("length").alias("bytes")))


@query("s01_list_items", _FOLDER_BYTES)
def _(spark, sf):
    """A whole tree listed, hidden and empty files as well; no body is read."""
    return _folder_bytes(S.list_items(spark, _as_files(spark, sf), bodies=False))


@query("j07_gate_stream", _FOLDER_BYTES)
def _(spark, sf):
    """The tree as a stream, scanned as its files arrive: two passes over one checkpoint scan every file once."""
    root, at = _as_files(spark, sf), f"{checkpoint_dir(spark).rstrip('/')}/gated-{uuid.uuid4().hex}"
    scanned = J.gate_stream(spark, root, Profile.load("homelab")).select("path", "name", "length", "verdict")

    def start():
        return (scanned.writeStream.format("parquet").option("path", f"{at}/scanned").option("checkpointLocation", f"{at}/state")
                .trigger(availableNow=True).start())

    J.run_once(start)
    return _folder_bytes(spark.read.schema(scanned.schema).parquet(f"{at}/scanned"))


@query("s04_write_report", """SELECT '{"doc_id":' || doc_id || ',"source":"' || source || '"}' AS line FROM documents""")
def _(spark, sf):
    """A report written and read back; a second write to the same place is refused."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    write_report(table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "source")).alias("line")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s02_union_roots", "SELECT doc_id % 2 AS root, source, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    d = table(spark, sf, "documents")
    roots = [d.filter(F.col("doc_id") % 2 == r).select(F.lit(r).cast("long").alias("root"), "doc_id", "source") for r in (0, 1)]
    return S.union_roots(roots).groupBy("root", "source").agg(F.count("*").alias("n"))


@query("s03_as_items", "SELECT CAST(page_id AS VARCHAR) AS item_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name, length(html) AS n, '' AS grp FROM pages")
def _(spark, sf):
    items = S.as_items(table(spark, sf, "pages"), item_id="page_id", name=F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), body="html")
    return items.select("item_id", "name", F.length("body").alias("n"), "grp")


@query("s03_as_parts", "SELECT CAST(conv_id AS VARCHAR) AS item_id, turn AS idx, role AS type, false AS forced, length(text) AS n FROM conversations")
def _(spark, sf):
    parts = S.as_parts(table(spark, sf, "conversations"), item_id="conv_id", idx="turn", type="role", text="text")
    return parts.select("item_id", "idx", "type", "forced", F.length("text").alias("n"))


@query("s03_as_attrs", f"WITH {EVENT_ATTRS_SQL} SELECT CAST(item_id AS VARCHAR) AS item_id, 'item' AS scope, key, value FROM attrs")
def _(spark, sf):
    return S.as_attrs(event_attrs(spark, sf), "item_id", F.col("tags"))


@query("s03_as_observations", "SELECT CAST(user_id AS VARCHAR) AS path, event_type AS version, ts FROM events")
def _(spark, sf):
    return S.as_observations(table(spark, sf, "events"), path="user_id", version="event_type", ts="ts")


# --- intake -------------------------------------------------------------------------------------------
def jobs_intake(spark, sf):
    """Orders as announced jobs in the four dialects."""
    o = F.col("o_orderkey")
    k, st, cat = o.cast("string"), F.col("o_orderstatus"), F.lower(F.substring_index("o_orderpriority", "-", -1))
    c = F.concat
    code = F.when(st == "O", "0").when(st == "F", "1").otherwise("")
    sab = F.when(o % 3 == 0, F.create_map(F.lit("SAB_COMPLETE_DIR"), c(F.lit("/dl/"), k), F.lit("SAB_PP_STATUS"), code, F.lit("SAB_FINAL_NAME"), c(F.lit("Job "), k),
                                          F.lit("SAB_CAT"), cat, F.lit("SAB_FAIL_MSG"), F.when(o % 5 == 0, "unpack failed").otherwise("")))
    nzb = F.create_map(F.lit("NZBPP_TOTALSTATUS"), F.when(st == "O", "SUCCESS").when(st == "F", "FAILURE").otherwise(""), F.lit("NZBPP_DIRECTORY"), c(F.lit("/d/"), k),
                       F.lit("NZBPP_FINALDIR"), F.when(o % 5 == 0, c(F.lit("/f/"), k)).otherwise(""), F.lit("NZBPP_CATEGORY"), cat, F.lit("NZBPP_STATUS"), F.when(o % 3 == 0, "X/Y").otherwise(""))
    son = F.create_map(F.lit("sonarr_eventtype"), F.when(st == "O", "Download").when(st == "F", "Test").otherwise("Grab"), F.lit("sonarr_episodefile_paths"), c(F.lit("/a"), k, F.lit("||/b"), k, F.lit("|")),
                       F.lit("sonarr_series_originallanguage"), F.lit("en"), F.lit("sonarr_series_title"), c(F.lit("S"), k), F.lit("sonarr_release_title"), F.when(o % 3 == 0, "R").otherwise(""))
    rad = F.create_map(F.lit("radarr_eventtype"), F.lit("Download"), F.lit("radarr_moviefile_path"), F.when(o % 5 == 0, "").otherwise(c(F.lit("/m/"), k)),
                       F.lit("radarr_movie_title"), F.when(o % 3 == 0, "").otherwise("M"), F.lit("radarr_release_title"), F.lit("Rel"))
    adapter = by_rest(o, 4, T.ADAPTERS, "")
    args = F.when((o % 4 == 0) & (o % 3 == 1), F.array(c(F.lit("/argv/"), k), F.lit("n.nzb"), F.when(o % 5 == 0, "").otherwise(c(F.lit("Arg "), k)), F.lit("1"), cat, F.lit("g"), code, F.lit("")))
    env = F.when(adapter == "sabnzbd", sab).when(adapter == "nzbget", nzb).when(adapter == "sonarr", son).otherwise(rad)
    return table(spark, sf, "orders").select(o.alias("job_id"), adapter.alias("adapter"),
                                             F.coalesce(env, F.create_map().cast("map<string,string>")).alias("env"),
                                             F.coalesce(args, F.array().cast("array<string>")).alias("args"))


JOBS_SQL = f"""j AS (SELECT o_orderkey AS job_id, o_orderkey AS o, {sql_by_rest('o_orderkey', 4, T.ADAPTERS, '')} AS adapter, o_orderstatus AS st, lower(string_split(o_orderpriority, '-')[-1]) AS cat,
   CASE o_orderstatus WHEN 'O' THEN '0' WHEN 'F' THEN '1' ELSE '' END AS code, o_orderkey % 5 = 0 AS five, o_orderkey % 3 AS m FROM orders),
 e AS (SELECT *, CASE adapter WHEN 'sabnzbd' THEN CASE WHEN m = 0 AND code = '' THEN 'SAB_COMPLETE_DIR came without SAB_PP_STATUS' WHEN m = 1 AND code = '' THEN 'parameter seven (the status) has no value'
      WHEN m = 2 THEN 'neither SAB_COMPLETE_DIR nor parameters were given' ELSE '' END
    WHEN 'nzbget' THEN CASE WHEN st = 'P' THEN 'NZBPP_TOTALSTATUS is missing' ELSE '' END
    WHEN 'radarr' THEN CASE WHEN five THEN 'event Download without radarr_moviefile_path' ELSE '' END ELSE '' END AS error FROM j),
 jobs AS (SELECT job_id, adapter, error, adapter = 'sonarr' AND st = 'F' AS test, CASE WHEN error <> '' THEN '' WHEN adapter = 'sabnzbd' THEN CASE WHEN m = 0 THEN '/dl/' || o ELSE '/argv/' || o END
      WHEN adapter = 'nzbget' THEN CASE WHEN five THEN '/f/' || o ELSE '/d/' || o END WHEN adapter = 'sonarr' THEN CASE WHEN st = 'O' THEN '/a' || o || '|/b' || o ELSE '' END ELSE '/m/' || o END AS paths,
   CASE WHEN error = '' AND adapter = 'sonarr' AND st = 'O' THEN 'en' ELSE '' END AS original,
   CASE WHEN error <> '' THEN '' WHEN adapter = 'sabnzbd' THEN CASE WHEN m = 0 THEN 'Job ' || o WHEN five THEN 'n.nzb' ELSE 'Arg ' || o END WHEN adapter = 'nzbget' THEN ''
     WHEN adapter = 'sonarr' THEN CASE WHEN st <> 'O' THEN '' WHEN m = 0 THEN 'S' || o || ': R' ELSE 'S' || o END ELSE CASE WHEN m = 0 THEN 'Rel' ELSE 'M: Rel' END END AS label,
   CASE WHEN error = '' AND adapter IN ('sabnzbd', 'nzbget') THEN cat ELSE '' END AS category,
   CASE WHEN error <> '' THEN '' WHEN adapter = 'sabnzbd' THEN 'pp status ' || code WHEN adapter = 'nzbget' THEN 'status ' || CASE st WHEN 'O' THEN 'SUCCESS' ELSE 'FAILURE' END || CASE WHEN m = 0 THEN '/X/Y' ELSE '' END
     WHEN adapter = 'sonarr' THEN CASE st WHEN 'O' THEN 'Download' WHEN 'F' THEN 'Test' ELSE 'Grab' END ELSE 'Download' END AS event,
   CASE WHEN error <> '' THEN '' WHEN adapter = 'sabnzbd' AND code <> '0' THEN 'post-processing status ' || code || '; the files are not usable' || CASE WHEN m = 0 AND five THEN ': unpack failed' ELSE '' END
     WHEN adapter = 'nzbget' AND st <> 'O' THEN 'download status FAILURE' || CASE WHEN m = 0 THEN '/X/Y' ELSE '' END || '; the files are not usable' WHEN adapter = 'sonarr' AND st = 'P' THEN 'event Grab; nothing to ingest' ELSE '' END AS skip FROM e)"""


@query("h01_parse_jobs", f"WITH {JOBS_SQL} SELECT job_id, adapter, error, test, paths, original, label, category, event FROM jobs")
def _(spark, sf):
    return H.parse_jobs(jobs_intake(spark, sf)).select("job_id", "adapter", "error", "test", F.array_join("paths", "|").alias("paths"),
                                                       "original", "label", "category", "event")


@query("h02_check_positional", """WITH a AS (SELECT p_partkey, p_partkey % 11 AS n, p_partkey % 2 = 0 AS mapped, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '0' END AS st FROM part)
 SELECT p_partkey, CASE WHEN n = 0 THEN '' WHEN n = 7 AND mapped THEN 'with SAB_COMPLETE_DIR set eight parameters are due, not 7 (first: "/x' || p_partkey || '")'
   WHEN n NOT IN (7, 8) THEN 'parameters must number none, seven or eight, not ' || n || ' (first: "/x' || p_partkey || '")' WHEN st = '' THEN 'parameter seven (the status) has no value' ELSE '' END AS error,
   CASE WHEN n = 1 THEN '/x' || p_partkey WHEN n = 9 AND st = '0' THEN 'http://h/9' ELSE '' END AS stray FROM a""")
def _(spark, sf):
    k = F.col("p_partkey")
    values = [F.concat(F.lit("/x"), k.cast("string")), F.lit("n"), F.lit("j"), F.lit("1"), F.lit("c"), F.lit("g"),
              F.when(k % 7 == 0, "").otherwise("0"), F.lit(""), F.lit("http://h/9"), F.lit("z")]
    a = table(spark, sf, "part").select("p_partkey", F.slice(F.array(*values), F.lit(1), (k % 11).cast("int")).alias("args"),
                                        F.when(k % 2 == 0, F.create_map(F.lit("SAB_COMPLETE_DIR"), F.lit("/d"))).otherwise(
                                            F.create_map().cast("map<string,string>")).alias("env"))
    return a.select("p_partkey", F.coalesce(H.check_positional(), F.lit("")).alias("error"), H.stray_argument().alias("stray"))


@query("h03_explode_paths", f"WITH {JOBS_SQL} SELECT job_id, unnest(string_split(paths, '|')) AS path FROM jobs WHERE error = '' AND skip = '' AND NOT test")
def _(spark, sf):
    return H.explode_paths(H.parse_jobs(jobs_intake(spark, sf))).select("job_id", "path")


@query("h04_match_category", f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN error = '' AND category <> '' AND NOT regexp_full_match(category, '[^/]*i[^/]') THEN 'category ' || category || ' does not match --category *I?' ELSE skip END AS skip FROM jobs")
def _(spark, sf):
    return H.match_category(H.parse_jobs(jobs_intake(spark, sf)), "*I?").select("job_id", "skip")


@query("h05_skip_rules", f"WITH {JOBS_SQL} SELECT adapter, skip, count(*) AS n FROM jobs GROUP BY ALL")
def _(spark, sf):
    return H.parse_jobs(jobs_intake(spark, sf)).groupBy("adapter", "skip").agg(F.count("*").alias("n"))


@query("h06_caller_code", f"""WITH {JOBS_SQL}, v AS (SELECT *, job_id % 5 AS verdict, CASE job_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS fail_on, CASE WHEN error <> '' THEN 'usage' WHEN skip <> '' THEN 'skipped' WHEN job_id % 50 = 0 THEN 'interrupted' ELSE 'ran' END AS outcome FROM jobs)
 SELECT job_id, CASE outcome WHEN 'ran' THEN CASE WHEN verdict = 4 OR verdict >= fail_on THEN CASE WHEN adapter = 'nzbget' THEN 94 ELSE 1 END ELSE CASE WHEN adapter = 'nzbget' THEN 93 ELSE 0 END END
    WHEN 'skipped' THEN CASE WHEN adapter = 'nzbget' THEN 95 ELSE 0 END WHEN 'usage' THEN CASE WHEN adapter = 'nzbget' THEN 94 ELSE 2 END ELSE CASE WHEN adapter = 'nzbget' THEN 94 ELSE 130 END END AS exit_code,
   CASE WHEN adapter = 'nzbget' AND verdict = 4 THEN '[NZB] MARK=BAD' ELSE '' END AS control FROM v""")
def _(spark, sf):
    j = F.col("job_id")
    jobs = H.parse_jobs(jobs_intake(spark, sf))
    verdict = (j % 5).cast("int")
    outcome = F.when(F.col("error") != "", "usage").when(F.col("skip") != "", "skipped").when(j % 50 == 0, "interrupted").otherwise("ran")
    return jobs.select("job_id", H.caller_code(F.col("adapter"), verdict, F.when(j % 3 == 0, 1).when(j % 3 == 1, 3).otherwise(4), outcome).alias("exit_code"),
                       H.control_line(F.col("adapter"), verdict).alias("control"))


# --- settle window -------------------------------------------------------------------------------------
def _observed(df):
    return df.select(F.col("user_id").cast("string").alias("path"), F.date_format("ts", "yyyy-MM-dd").alias("version"), "ts")


def _settle_sql(obs: str, hours: int, extra: str = "") -> str:
    return f"""WITH o AS ({obs}), l AS (SELECT *, lag(version) OVER w AS pv{', lag(pass) OVER w AS pp' if extra else ''} FROM o WINDOW w AS (PARTITION BY path ORDER BY ts, version)),
 c AS (SELECT *, sum(CASE WHEN pv IS DISTINCT FROM version{extra} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, version) AS isl FROM l),
 s AS (SELECT *, min(ts) OVER (PARTITION BY path, isl) AS since FROM c)
 SELECT path, version, since, min(ts) AS settled_at FROM s WHERE ts - since >= INTERVAL {hours} HOUR GROUP BY path, version, isl, since"""


_OBS = "SELECT CAST(user_id AS VARCHAR) AS path, strftime(ts, '%Y-%m-%d') AS version, ts FROM events"


@query("j01_settle_stream", _settle_sql(_OBS, 3))
def _(spark, sf):
    """The stream run over the events as observations; same answer as the batch form."""
    return W.settle_files(spark, f"{sf}/events.parquet", _observed, 3 * 3600)


@query("j02_settle_batch", _settle_sql(_OBS, 3))
def _(spark, sf):
    return W.settle_batch(_observed(table(spark, sf, "events")), 3 * 3600)


_PASSES = "SELECT CAST(user_id AS VARCHAR) AS path, 'v' || (user_id % 3) AS version, ts, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS pass FROM events"


@query("j02_settle_passes", _settle_sql(_PASSES, 48, " OR pass - pp > 1"))
def _(spark, sf):
    """One pass a day: a path that a pass does not list is forgotten."""
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("path"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"), "ts",
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("pass_no"))
    return W.settle_batch(e, 48 * 3600, pass_no="pass_no")


@query("j03_prune_absent", """WITH last AS (SELECT max(CAST(ts AS DATE)) AS d FROM events) SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events, last WHERE CAST(ts AS DATE) = d""")
def _(spark, sf):
    e = table(spark, sf, "events")
    known = e.select(F.col("user_id").cast("string").alias("path")).distinct()
    day = F.to_date("ts")
    newest = e.agg(F.max(day).alias("d"))
    last = e.withColumn("d", day).join(newest, "d", "left_semi").select(F.col("user_id").cast("string").alias("path"))
    return W.prune_absent(known, last)


_MSG = "CASE WHEN event_type = 'error' THEN 'E' || (event_id % 2) WHEN event_type = 'click' THEN '' ELSE 'E1' END"


@query("j04_once_per_change", f"""WITH m AS (SELECT user_id, ts, {_MSG} AS msg FROM events), l AS (SELECT *, lag(msg) OVER (PARTITION BY user_id ORDER BY ts, msg) AS pm FROM m)
 SELECT user_id, ts, msg FROM l WHERE msg <> '' AND msg <> coalesce(pm, '')""")
def _(spark, sf):
    msg = (F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("event_id") % 2).cast("string")))
            .when(F.col("event_type") == "click", "").otherwise("E1"))
    return W.once_per_change(table(spark, sf, "events").select("user_id", "ts", msg.alias("msg")), ["user_id"])


@query("j05_pass_reports", """WITH v AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS pass_start, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS v FROM events)
 SELECT pass_start, CASE max(v) WHEN 3 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) AS files, count(*) FILTER (v = 0) AS n_pass, count(*) FILTER (v = 1) AS n_warn, count(*) FILTER (v = 3) AS n_fail, count(*) FILTER (v = 4) AS n_block FROM v GROUP BY pass_start""")
def _(spark, sf):
    e = table(spark, sf, "events").select("ts", F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 1).otherwise(0).alias("verdict"))
    return J.pass_reports(e, "6 hours")
