"""Verdict algebra and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions.columns import let
from portcullis.functions.tables import SEVERITY_NAMES
from portcullis.operators.prefix import with_position
from portcullis.operators.spread import ordered_entries, paged_lists
from portcullis.schema import FAIL, PASS, severity_name, text, union_all
from portcullis.session import kept

SCHEMA_ID = "portcullis.report/1"


def verdicts(items: DataFrame, findings: DataFrame, key: str = "item_id") -> DataFrame:
    """Append the worst severity of an item's findings; an item without any is PASS.

    Findings are reduced per item first (map-side), so a hot item costs one row per task."""
    worst = findings.groupBy(key).agg(F.max("severity").alias("__worst"))
    return (items.join(worst, key, "left")
            .withColumn("verdict", F.coalesce("__worst", F.lit(PASS))).drop("__worst"))


def verdict_counts(judged: DataFrame, *keys: str) -> DataFrame:
    return (judged.groupBy(*keys, "verdict").count()
            .select(*keys, severity_name(F.col("verdict")).alias("verdict"), F.col("count").alias("files")))


def run_verdict(judged: DataFrame, run_errors: int | Column = 0, *runs: str) -> DataFrame:
    """The worst verdict of each run (one row without ``runs``); a run-level error raises it to FAIL at least."""
    errors = run_errors if isinstance(run_errors, Column) else F.lit(run_errors)
    worst = F.coalesce(F.max("verdict"), F.lit(PASS))
    raised = F.when(F.coalesce(F.max(errors), F.lit(0)) > 0, F.lit(FAIL)).otherwise(F.lit(PASS))
    return judged.groupBy(*runs).agg(F.greatest(worst, raised).alias("verdict"), F.count("*").alias("files"))


def exit_code(verdict: Column, interrupted: Column) -> Column:
    return F.when(interrupted & (verdict == PASS), F.lit(130)).otherwise(verdict)


def has_code(items: DataFrame, findings: DataFrame, code: str, key: str = "item_id") -> DataFrame:
    return items.join(findings.filter(F.col("code") == code).select(key).distinct(), key, "left_semi")


def merge_results(*results: DataFrame) -> DataFrame:
    """Findings of several steps over the same items; the later stages keep their place by stage."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _entry() -> Column:
    return F.struct("code", severity_name(F.col("severity")).alias("severity"), "message",
                    F.coalesce("detail", F.lit("")).alias("detail"))


def finding_entries(findings: DataFrame, key: str = "item_id") -> DataFrame:
    """(item, ordinal, code, severity, message, detail): one row a finding, numbered in the order they were made."""
    return ordered_entries(findings, [key], ["stage", "seq"], _entry(), "entry").select(key, "ordinal", "entry.*")


def ordered_findings(findings: DataFrame, key: str = "item_id", page: int = 4096) -> DataFrame:
    """(item, page, pages, total, findings): the same as lists in pages of bounded length, so that no item is
    collected whole when it has very many."""
    return paged_lists(findings, [key], ["stage", "seq"], _entry(), "findings", page)


def report_lines(judged: DataFrame, findings: DataFrame, key: str = "item_id", page: int = 4096) -> DataFrame:
    """One JSON line per item (per page of findings for a very large item): the scalable report.

    ``judged``: key, path, verdict and optionally output, info (map). Arrays and maps are present and
    empty, never null."""
    lists = ordered_findings(findings, key, page)
    none = F.array().cast("array<struct<code:string,severity:string,message:string,detail:string>>")
    columns = judged.columns
    info = F.coalesce(F.col("info"), F.create_map().cast("map<string,string>")) if "info" in columns else (
        F.create_map().cast("map<string,string>"))
    output = F.coalesce(F.col("output"), F.lit("")) if "output" in columns else F.lit("")
    joined = judged.join(lists, key, "left")
    line = F.to_json(F.struct(
        F.col("path").alias("path"), severity_name(F.col("verdict")).alias("verdict"),
        F.coalesce("findings", none).alias("findings"), output.alias("output"), info.alias("info"),
        F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("pages", F.lit(1)).alias("pages")),
        {"ignoreNullFields": "false"})
    return joined.select(key, line.alias("line"))


def _counts() -> Column:
    """Files per verdict as a map aggregate, only those that occur, keys sorted."""
    pairs = [F.struct(F.lit(name).alias("k"), F.count(F.when(F.col("verdict") == value, 1)).alias("n"))
             for value, name in sorted(SEVERITY_NAMES.items(), key=lambda e: e[1])]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["n"] > 0))


def count_line(judged: DataFrame) -> DataFrame:
    """One row "VERDICT: N file(s) K=V ..." with the keys sorted."""
    head = judged.agg(F.coalesce(F.max("verdict"), F.lit(PASS)).alias("v"), F.count("*").alias("n"), _counts().alias("c"))
    pairs = F.transform(F.map_entries("c"), lambda e: text(e["key"], "=", e["value"]))
    return head.select(text(severity_name(F.col("v")), ": ", F.col("n"), " file(s) ", F.array_join(pairs, " ")).alias("line"))


def _head_fields(*, tool: str, version: str, command: str, profile: str, started: Column, finished: Column,
                 errors: list[str] | None = None, hook: Column | None = None):
    errors = errors or []
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    worst = F.greatest(F.coalesce(F.max("verdict"), F.lit(PASS)), F.lit(FAIL if errors else PASS))
    fields = [F.lit(SCHEMA_ID).alias("schema"), F.lit(tool).alias("tool"), F.lit(version).alias("version"),
              F.lit(command).alias("command"), F.lit(profile).alias("profile")]
    if hook is not None:
        fields.append(hook.alias("hook"))
    before = [*fields, stamp(started).alias("started"), stamp(finished).alias("finished"),
              severity_name(worst).alias("verdict"), _counts().alias("counts")]
    return before, F.array(*[F.lit(e) for e in errors]).cast("array<string>").alias("errors")


def run_header(judged: DataFrame, **head) -> DataFrame:
    """One-row JSON head of a run: everything of the report document except its files, which are the
    report lines. Times are UTC whole seconds."""
    fields, errors = _head_fields(**head)
    return judged.agg(F.to_json(F.struct(*fields, errors), {"ignoreNullFields": "false"}).alias("header"))


#: Sections of a file in the document, in order; the head has place 0, the tail the last place.
OPEN, FINDINGS, OUTPUT, ACTIONS, CLOSE = range(5)
LAST_PLACE = (1 << 63) - 1


def _quoted(value: Column) -> Column:
    """A text as a JSON string; NULL as the empty one."""
    return let(F.to_json(F.array(F.coalesce(value, F.lit("")))), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def document_pieces(judged: DataFrame, findings: DataFrame, actions: DataFrame | None = None, key: str = "item_id",
                    **head) -> DataFrame:
    """(place, section, ordinal, piece): the single JSON document of a run, cut between tokens. All pieces in order of
    the first three columns are the document; ``sinks.write_document`` writes them so.

    ``judged``: key, path, verdict and optionally output, info (map), duration_ms; ``actions``: key, ordinal, line;
    the rest as for ``run_header``. Files come in order of their paths. A piece holds a finding, an action or the
    fields of one file, so neither a file with very many findings nor a run with very many files is ever one row.
    Findings and actions of no judged item, or of none at all, are left out; ``findings`` and ``errors`` are there and
    empty where there are none, empty outputs, actions, infos and details are not written."""
    have = set(judged.columns)
    none = F.create_map().cast("map<string,string>")
    info = F.coalesce(F.col("info"), none) if "info" in have else none
    narrow = kept(judged.select(
        key, "path", "verdict", (F.col("output") if "output" in have else F.lit(None).cast("string")).alias("output"), info.alias("info"),
        F.coalesce(F.col("duration_ms") if "duration_ms" in have else F.lit(None), F.lit(0)).cast("long").alias("duration_ms")))
    files = with_position(narrow, [F.col("path").asc_nulls_first(), F.col(key)], "place")
    acted = F.lit(False)
    if actions is not None:
        firsts = actions.filter("ordinal = 1").select(key, F.lit(True).alias("acted"))
        files, acted = files.join(firsts, key, "left"), F.coalesce("acted", F.lit(False))

    def pieces(df, section, ordinal, *texts):
        return df.select(F.col("place"), F.lit(section).alias("section"), ordinal.cast("long").alias("ordinal"),
                         F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in texts]).alias("piece"))

    def some(condition, *texts):
        return F.when(condition, F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in texts])).otherwise("")

    zero, places = F.lit(0), files.select(key, "place")
    entries = finding_entries(findings, key).join(places, key)
    entry = F.struct("code", "severity", F.coalesce("message", F.lit("")).alias("message"), F.nullif("detail", F.lit("")).alias("detail"))
    sorted_info = F.map_from_entries(F.array_sort(F.map_entries("info")))
    out = [pieces(files, OPEN, zero, some(F.col("place") > 1, ","), '{"path":', _quoted(F.col("path")), ',"verdict":"',
                  severity_name(F.col("verdict")), '","findings":['),
           pieces(entries, FINDINGS, F.col("ordinal"), some(F.col("ordinal") > 1, ","), F.to_json(entry)),
           pieces(files, OUTPUT, zero, "]", some(F.coalesce("output", F.lit("")) != "", ',"output":', _quoted(F.col("output")))),
           pieces(files, CLOSE, zero, some(acted, "]"), some(F.size("info") > 0, ',"info":', F.to_json(sorted_info)),
                  ',"duration_ms":', F.col("duration_ms").cast("string"), "}")]
    if actions is not None:
        out.append(pieces(actions.join(places, key), ACTIONS, F.col("ordinal"),
                          F.when(F.col("ordinal") == 1, ',"actions":[').otherwise(","), _quoted(F.col("line"))))
    fields, errors = _head_fields(**head)
    top = narrow.agg(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("top"))
    top = top.withColumn("place", F.lit(0).cast("long"))
    out.append(pieces(top, OPEN, zero, F.substring("top", F.lit(1), F.length("top") - 1), ',"files":['))
    tail = narrow.agg(F.to_json(errors).alias("errors")).withColumn("place", F.lit(LAST_PLACE))
    out.append(pieces(tail, CLOSE, zero, '],"errors":', F.col("errors"), "}"))
    return union_all(out)
