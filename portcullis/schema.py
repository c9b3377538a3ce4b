"""The finding structure and severity algebra shared by every check."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions.tables import BLOCK, FAIL, PASS, SEVERITY_NAMES, USAGE, WARN  # noqa: F401

FINDING_TYPE = ("struct<stage:int,seq:long,terminal:boolean,code:string,severity:int,"
                "message:string,detail:string>")
#: Places behind every numbered part.
LAST_SEQ = 1 << 62
FINDING_COLUMNS = ["stage", "seq", "terminal", "code", "severity", "message", "detail"]

# Position of each check in the run over one item; F15 and the report order rest on it.
STAGE = {"name": 1, "empty": 2, "flag": 3, "copies": 4, "double_ext": 5, "readable": 6,
         "sidecar": 7, "danger": 8, "ext": 9, "polyglot": 10, "signature": 11, "parse": 12,
         "duration": 13, "parts": 14, "tools": 15, "attachments": 16, "structure": 17,
         "provenance": 18, "links": 19, "text_links": 20, "info": 21, "decode": 22,
         "note": 23, "policy": 24, "route": 25, "verify": 26, "clean": 27, "place": 28,
         "quarantine": 29}


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text(*pieces) -> Column:
    """Concatenate literals and columns; a missing piece reads as the empty string."""
    return F.concat(*[F.coalesce(as_col(p).cast("string"), F.lit("")) for p in pieces])


def finding(condition, stage: str, code: str, severity, message, detail=None, *, seq=0,
            terminal=False) -> Column:
    """A finding struct where ``condition`` holds, NULL elsewhere."""
    body = F.struct(
        F.lit(STAGE[stage]).alias("stage"),
        as_col(seq).cast("long").alias("seq"),
        as_col(terminal).cast("boolean").alias("terminal"),
        as_col(code).alias("code"),
        as_col(severity).cast("int").alias("severity"),
        as_col(message).cast("string").alias("message"),
        (F.lit(None) if detail is None else as_col(detail)).cast("string").alias("detail"))
    return F.when(as_col(condition), body)


def gather(*findings: Column) -> Column:
    """Findings of one row, in order, without the NULL ones."""
    return F.filter(F.array(*findings), lambda f: f.isNotNull())


def to_rows(df: DataFrame, findings: Column, *keys: str) -> DataFrame:
    """Long form: one row per finding. Rows without a finding are not emitted.

    An outer explode keeps Catalyst from inferring a size filter and pushing a second copy of every
    check below the projection; the NULL rows are dropped after it."""
    return (df.select(*keys, F.explode_outer(findings).alias("f")).filter(F.col("f").isNotNull())
              .select(*keys, *[F.col(f"f.{c}").alias(c) for c in FINDING_COLUMNS]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def severity_name(severity: Column) -> Column:
    out = F.when(severity == 0, F.lit("PASS"))
    for value, name in SEVERITY_NAMES.items():
        if value:
            out = out.when(severity == value, F.lit(name))
    return out.otherwise(text("SEVERITY(", severity, ")"))


def worst(findings: Column) -> Column:
    """Worst severity of an array of findings; an empty array is PASS."""
    return F.coalesce(F.array_max(F.transform(findings, lambda f: f["severity"])), F.lit(PASS))
