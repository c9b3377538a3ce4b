"""Intake: jobs announced by four callers in their own dialects, and their exit codes."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions.columns import lookup
from portcullis.schema import BLOCK, text

JOB_FIELDS = ["paths", "original", "label", "category", "event", "skip", "test", "error"]


def first_wins(entries: Column) -> Column:
    """Map of "K=V" entries; the first value of a repeated key counts."""
    pairs = F.transform(F.filter(entries, lambda e: F.instr(e, "=") > 1), lambda e: F.struct(
        F.substring_index(e, "=", 1).alias("k"), F.regexp_extract(e, "(?s)^[^=]*=(.*)$", 1).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def _var(key: str, env: str = "env") -> Column:
    """Value of a variable, '' when it is unset or empty."""
    return F.coalesce(F.try_element_at(F.col(env), F.lit(key)), F.lit(""))


def _arg(i: int) -> Column:
    return F.coalesce(F.get(F.col("args"), F.lit(i)), F.lit(""))


def _is_status(s: Column) -> Column:
    return s.rlike(r"^[+-]?[0-9]+\z")


def _is_failure_url(s: Column) -> Column:
    return (s == "") | s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]")


def stray_argument() -> Column:
    """The argument a wrapper added, where the values alone tell which one it is."""
    n = F.size("args")
    front = _is_failure_url(_arg(8)) & _is_status(_arg(7)) & ~_is_status(_arg(6))
    back = _is_failure_url(_arg(7)) & _is_status(_arg(6))
    return (F.when(n == 1, _arg(0)).when((n == 9) & front, _arg(0)).when((n == 9) & back, _arg(8))
             .otherwise(F.lit("")))


def check_positional() -> Column:
    """Error of the positional arguments of the one caller that passes any; NULL when they fit.

    Accepted are none, seven or eight; seven only without the map form; the status may not be
    empty."""
    n, mapped = F.size("args"), _var("SAB_COMPLETE_DIR") != ""
    return (F.when(n == 0, F.lit(None).cast("string"))
             .when((n == 7) & mapped, text(
                 "with SAB_COMPLETE_DIR set eight parameters are due, not ", n, ' (first: "', _arg(0),
                 '")'))
             .when(~n.isin(7, 8), text("parameters must number none, seven or eight, not ", n, ' (first: "', _arg(0), '")'))
             .when(_arg(6) == "", "parameter seven (the status) has no value"))


def explode_list(value: Column) -> Column:
    """'|'-separated paths without the empty ones."""
    return F.filter(F.split(value, r"\|"), lambda p: p != "")


def parse_jobs(intake: DataFrame) -> DataFrame:
    """Append the job fields to intake(job_id, adapter, env MAP, args ARRAY)."""
    none, no_paths = F.lit(""), F.array().cast("array<string>")
    null = F.lit(None).cast("string")

    def job(paths=None, original=none, label=none, category=none, event=none, skip=none, test=None, error=None):
        return F.struct(
            F.when(error.isNotNull(), no_paths).otherwise(paths if paths is not None else no_paths).alias("paths")
            if error is not None else (paths if paths is not None else no_paths).alias("paths"),
            original.alias("original"), label.alias("label"), category.alias("category"), event.alias("event"),
            skip.alias("skip"), (test if test is not None else F.lit(False)).alias("test"),
            F.coalesce(error, none).alias("error") if error is not None else none.alias("error"))

    # first dialect: variables, or positional parameters where the variables are missing
    mapped, listed = _var("SAB_COMPLETE_DIR") != "", F.size("args") > 0
    status = F.when(mapped, _var("SAB_PP_STATUS")).otherwise(_arg(6))
    bad = F.coalesce(check_positional(), F.when(
        mapped & (_var("SAB_PP_STATUS") == ""), "SAB_COMPLETE_DIR came without SAB_PP_STATUS").when(
        ~mapped & ~listed, "neither SAB_COMPLETE_DIR nor parameters were given"))
    why = text("post-processing status ", status, "; the files are not usable",
               F.when(_var("SAB_FAIL_MSG") != "", F.concat(F.lit(": "), _var("SAB_FAIL_MSG"))))
    sab = job(F.array(F.when(mapped, _var("SAB_COMPLETE_DIR")).otherwise(_arg(0))), none,
              F.when(mapped, _var("SAB_FINAL_NAME")).when(_arg(2) != "", _arg(2)).otherwise(_arg(1)),
              F.when(mapped, _var("SAB_CAT")).otherwise(_arg(4)), text("pp status ", status),
              F.when(status != "0", why).otherwise(none), None, bad)

    # second dialect: variables only
    total, detail = _var("NZBPP_TOTALSTATUS"), _var("NZBPP_STATUS")
    final = F.when(_var("NZBPP_FINALDIR") != "", _var("NZBPP_FINALDIR")).otherwise(_var("NZBPP_DIRECTORY"))
    both = text(total, F.when(detail != "", F.concat(F.lit("/"), detail)))
    nzb = job(F.array(final), none, _var("NZBPP_NZBNAME"), _var("NZBPP_CATEGORY"), text("status ", both),
              F.when(total != "SUCCESS", text("download status ", both, "; the files are not usable")).otherwise(none),
              None, F.when(total == "", "NZBPP_TOTALSTATUS is missing")
              .when(final == "", "NZBPP_FINALDIR and NZBPP_DIRECTORY are both missing"))

    # third and fourth dialect: an event with its variables
    def events(name, program, path_key, list_key, lang_key, title_key):
        event = _var(f"{name}_eventtype")
        paths = F.when(_var(path_key) != "", F.array(_var(path_key)))
        paths = paths.otherwise(explode_list(_var(list_key))) if list_key else paths.otherwise(no_paths)
        run = event == "Download"
        title, release = _var(title_key), _var(f"{name}_release_title")
        label = (F.when((title != "") & (release != ""), text(title, ": ", release)).when(title != "", title)
                  .otherwise(release))
        lacking = f"event Download without {path_key}" + (f" or {list_key}" if list_key else "")
        return job(F.when(run, paths).otherwise(no_paths), F.when(run, _var(lang_key)).otherwise(none),
                   F.when(run, label).otherwise(none), none, event,
                   F.when((event != "Test") & ~run, text("event ", event, "; nothing to ingest")).otherwise(none),
                   event == "Test",
                   F.when(event == "", f"{name}_eventtype is missing")
                   .when(run & (F.size(paths) == 0), lacking))

    series = events("sonarr", "Sonarr", "sonarr_episodefile_path", "sonarr_episodefile_paths",
                    "sonarr_series_originallanguage", "sonarr_series_title")
    films = events("radarr", "Radarr", "radarr_moviefile_path", "", "radarr_movie_originallanguage", "radarr_movie_title")
    unknown = job(error=F.coalesce(text('unknown adapter "', F.col("adapter"), '"'), null))
    a = F.col("adapter")
    parsed = intake.withColumn("__j", F.when(a == "sabnzbd", sab).when(a == "nzbget", nzb).when(a == "sonarr", series)
                               .when(a == "radarr", films).otherwise(unknown))
    out = parsed.withColumns({f: F.col(f"__j.{f}") for f in JOB_FIELDS}).drop("__j")
    failed = F.col("error") != ""
    return out.withColumns({f: F.when(failed, "").otherwise(F.col(f)) for f in
                            ("original", "label", "category", "event", "skip")})


def explode_paths(jobs: DataFrame) -> DataFrame:
    """One row per path of the jobs that run."""
    run = (F.col("error") == "") & (F.col("skip") == "") & ~F.col("test")
    # The condition sits in the list: as a filter it would be pushed below with a copy of the parser.
    listed = F.when(run, F.col("paths"))
    return jobs.select("job_id", "adapter", F.posexplode_outer(listed).alias("pos", "path")).filter(F.col("path").isNotNull())


# --- category filter -------------------------------------------------------------------------------
def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a shell pattern; ``*`` and ``?`` do not cross '/'."""
    out, i, g = [], 0, glob.lower()
    while i < len(g):
        c = g[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i >= len(g):
                raise ValueError(f"{glob!r}: syntax error in pattern")
            out.append(re.escape(g[i]))
            i += 1
        elif c == "[":
            end = i + (1 if g[i:i + 1] == "^" else 0)
            members = []
            while end < len(g) and (g[end] != "]" or not members):
                if g[end] == "\\":
                    end += 1
                if end >= len(g) or (g[end] in "-]" and g[end - 1] != "\\"):
                    raise ValueError(f"{glob!r}: syntax error in pattern")
                lo = hi = g[end]
                end += 1
                if g[end:end + 1] == "-":
                    end += 1
                    if g[end:end + 1] == "\\":
                        end += 1
                    if end >= len(g) or g[end] == "]":
                        raise ValueError(f"{glob!r}: syntax error in pattern")
                    hi = g[end]
                    end += 1
                members.append(f"{re.escape(lo)}-{re.escape(hi)}")
            if end >= len(g) or not members:
                raise ValueError(f"{glob!r}: syntax error in pattern")
            out.append("[" + ("^" if g[i] == "^" else "") + "".join(members) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def match_category(jobs: DataFrame, glob: str) -> DataFrame:
    """Jobs whose category does not match are skipped; jobs without a category are not filtered."""
    if glob == "":
        return jobs
    misses = (F.col("category") != "") & ~F.lower("category").rlike(glob_pattern(glob))
    return jobs.withColumn("skip", F.when(misses & (F.col("error") == ""), text(
        "category ", F.col("category"), f" does not match --category {glob}")).otherwise(F.col("skip")))


def caller_code(adapter: Column, verdict: Column, fail_on: Column, outcome: Column) -> Column:
    """Exit code in the caller's own convention; BLOCK fails under every threshold."""
    failed = (verdict == BLOCK) | (verdict >= fail_on)
    names = ["ok", "bad", "skipped", "usage", "interrupted"]
    table = {f"{a}/{n}": codes[i] for a, codes in T.EXIT_CODES.items() for i, n in enumerate(names)}
    known = F.when(adapter.isin(T.ADAPTERS), adapter).otherwise("sabnzbd")
    result = (F.when((outcome == "ran") & failed, "bad").when(outcome == "ran", "ok")
               .when(outcome.isin("skipped", "usage"), outcome).otherwise("interrupted"))
    return lookup(F.concat(known, F.lit("/"), result), table)


def control_line(adapter: Column, verdict: Column) -> Column:
    return F.when((adapter == "nzbget") & (verdict == BLOCK), T.CONTROL_LINE).otherwise("")
