"""Item checks: each is a Column holding a finding or NULL, so a whole scan is one projection.

Expected item columns: ``name``, ``content`` (BINARY), ``length`` and, where a check needs them,
the columns it is given. No check shuffles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import content as C
from portcullis.functions import tables as T
from portcullis.functions.columns import base_name, category, ext, let, second_ext
from portcullis.functions.text import classify_note, decode_text, first_invisible
from portcullis.operators.profiles import Settings
from portcullis.schema import BLOCK, FAIL, PASS, WARN, finding, gather, text, to_rows


def graded(mode: Column) -> Column:
    """WARN unless the setting says fail."""
    return F.when(mode == "fail", FAIL).otherwise(WARN)


def check_name_chars(name: Column) -> Column:
    bad = first_invisible(base_name(name))
    return finding(bad.isNotNull(), "name", "BIDI_NAME", BLOCK,
                   text("filename contains ", bad, " (extension spoofing)"), terminal=True)


def check_empty(length: Column) -> Column:
    return finding(length == 0, "empty", "EMPTY_FILE", BLOCK, "empty file", terminal=True)


def check_flag(flag: Column, mode: Column, what: str = "executable permission bit set") -> Column:
    return finding(flag & mode.isin("warn", "fail"), "flag", "EXEC_PERM", graded(mode), what)


def check_copies(copies: Column) -> Column:
    return finding(copies > 1, "copies", "HARDLINKED", PASS, text("file has ", copies, " hard links"))


def check_double_ext(name: Column, blocked: Column) -> Column:
    inner = second_ext(base_name(name))
    return finding(F.array_contains(blocked, inner), "double_ext", "DOUBLE_EXT", WARN,
                   text("double extension .", inner, ".", ext(name)))


def check_unreadable(content: Column) -> Column:
    return finding(content.isNull(), "readable", "UNREADABLE", FAIL, "content could not be read",
                   terminal=True)


def check_dangerous(name: Column, kind: Column, detail: Column) -> Column:
    """Media names only; sidecars take the ladder of ``check_sidecar``."""
    return finding(category(ext(name)).isNotNull() & kind.isin(T.DANGEROUS_KINDS), "danger",
                   "DANGEROUS_CONTENT", BLOCK,
                   text(detail, " ", kind, " content under a .", ext(name), " name"), terminal=True)


def check_ext_mismatch(name: Column, kind: Column) -> Column:
    return finding(category(ext(name)).isNotNull() & ~C.ext_allows(ext(name), kind), "ext",
                   "EXT_MISMATCH", FAIL,
                   text("content is ", kind, " but extension is .", ext(name)))


def check_polyglot(name: Column, content: Column) -> Column:
    found = C.appended_payload(content)
    return finding(category(ext(name)).isNotNull() & found.isNotNull(), "polyglot", "POLYGLOT", BLOCK,
                   found, terminal=True)


def check_sidecar(name: Column, kind: Column, p: Settings) -> Column:
    """Ladder for an item that is not media; exactly one finding."""
    e = ext(name)
    side = category(e).isNull()
    blocked, allowed = F.array_contains(p["sidecars.block"], e), F.array_contains(p["sidecars.allow"], e)
    danger, fits = kind.isin(T.DANGEROUS_KINDS), C.ext_allows(e, kind)
    code = (F.when(blocked, "SIDECAR_BLOCKED").when(danger, "DANGEROUS_CONTENT")
             .when(allowed & ~fits, "EXT_MISMATCH").when(allowed, "SIDECAR_OK").otherwise("SIDECAR_UNKNOWN"))
    severity = (F.when(blocked | danger, BLOCK).when(allowed & ~fits, FAIL).when(allowed, PASS).otherwise(WARN))
    message = (F.when(blocked, text("blocked sidecar type .", e))
                .when(danger, text(kind, " content under a .", e, " name"))
                .when(allowed & ~fits, text("content is ", kind, " but extension is .", e))
                .when(allowed, text("allowed sidecar .", e))
                .otherwise(text("unrecognised sidecar type .", e, " (", kind, ")")))
    return finding(side, "sidecar", code, severity, message)


def note_of(name: Column, content: Column, kind: Column, p: Settings) -> Column:
    """Classification of an accepted note, NULL for every other item."""
    e = ext(name)
    reached = ((e == "nfo") & ~F.array_contains(p["sidecars.block"], e) & ~kind.isin(T.DANGEROUS_KINDS)
               & F.array_contains(p["sidecars.allow"], e) & C.ext_allows(e, kind))
    return F.when(reached, classify_note(decode_text(content)))


def note_findings(note: Column, p: Settings) -> list[Column]:
    """What a note is, and the links it carries outside the expected places."""
    k, host = note["kind"], note["host"]
    known = k.isin("xml", "url", "mixed") | (host != "")
    message = (F.when(k == "xml", text(note["root"], " note"))
                .when(k == "url", text("URL note (", host, ")"))
                .when(k == "mixed", text(note["root"], " note with a trusted URL (", host, ")"))
                .when(host != "", text("text note with a trusted URL (", host, ")"))
                .otherwise(F.lit("plain text note")))
    n = F.size(note["links"])
    return [finding(note.isNotNull(), "note", F.when(known, "NOTE_KNOWN").otherwise("NOTE_TEXT"), PASS, message),
            finding(note.isNotNull() & (n > 0), "note", "LINK_IN_SIDECAR", graded(p["metadata.links"]),
                    text(n, " link(s) in note outside the expected fields: ", F.array_join(note["links"], "; ")),
                    F.array_join(note["links"], "\n"), seq=1)]


def check_tool_messages(errors: Column, warnings: Column) -> Column:
    """One finding per entry of the two message lists (an array of findings)."""
    def rows(messages, code, severity, first):
        return F.transform(F.coalesce(messages, F.array().cast("array<string>")), lambda m, i: finding(
            F.lit(True), "tools", code, severity, text("tool: ", m), seq=i + first))
    return F.concat(rows(errors, "MKV_ERROR", FAIL, 0), rows(warnings, "MKV_WARNING", WARN, 100000))


def check_truncated(declared: Column, actual: Column, has_body: Column) -> Column:
    missing = finding(~has_body, "structure", "TRUNCATED", FAIL,
                      "no mandatory section: item is truncated or not finalised")
    short = finding(declared > actual, "structure", "TRUNCATED", FAIL,
                    text("item declares ", declared, " but has ", actual), seq=1)
    return gather(missing, short)


def check_no_duration(name: Column, measure: Column) -> Column:
    cat = category(ext(name))
    return finding(cat.isNotNull() & (cat != "subtitle") & (F.coalesce(measure, F.lit(0)) <= 0), "duration",
                   "NO_DURATION", WARN, "container reports no duration")


def check_decode(content: Column, tier: str, has_media: Column) -> Column:
    if tier == "none":
        return finding(F.lit(False), "decode", "DECODE_FAIL", FAIL, "")
    return finding(has_media & ~C.head_tail_valid(content, tier), "decode", "DECODE_FAIL", FAIL,
                   f"content does not decode ({tier})", terminal=False)


# --- terminal rule ------------------------------------------------------------------------------
def stop_at_terminal(findings: Column) -> Column:
    """Findings up to and including the first terminal stage; no decode check after a FAIL."""
    def cut(found):
        last = F.coalesce(F.array_min(F.transform(F.filter(found, lambda f: f["terminal"]), lambda f: f["stage"])),
                          F.lit(999))
        return let(F.filter(found, lambda f: f["stage"] <= last), without_decode)

    def without_decode(kept):
        bad = F.exists(kept, lambda f: (f["severity"] >= FAIL) & (f["code"] != "DECODE_FAIL"))
        return F.when(bad, F.filter(kept, lambda f: f["code"] != "DECODE_FAIL")).otherwise(kept)

    return let(findings, cut)


def stop_at_terminal_rows(rows: DataFrame, item: str = "item_id") -> DataFrame:
    """The same rule over long findings of any volume per item."""
    from portcullis.operators.spread import with_stats
    stopped = with_stats(rows, [item],
                         {"__last": ("min", F.when(F.col("terminal"), F.col("stage")))})
    kept = stopped.filter(F.col("stage") <= F.coalesce("__last", F.lit(999))).drop("__last")
    failed = with_stats(kept, [item],
                        {"__bad": ("max", (F.col("severity") >= FAIL) & (F.col("code") != "DECODE_FAIL"))})
    return failed.filter(~(F.col("__bad") & (F.col("code") == "DECODE_FAIL"))).drop("__bad")
