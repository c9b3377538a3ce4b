"""Scan plan: every item check in run order as one projection, then the verdict.

The checks of an item need nothing but its own row, so the scan shuffles nothing; findings about
parts, which live in other tables, join by item only where a whole run is put together.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.functions.columns import category, ext
from portcullis.functions.content import sniff
from portcullis.operators import checks as K
from portcullis.operators.profiles import Profile, Settings
from portcullis.operators.signatures import signature_policy
from portcullis.schema import FINDING_TYPE, gather, to_rows, worst


def scan_items(items: DataFrame, profile: Profile, tier: str | None = None) -> DataFrame:
    """Append kind, category, findings and verdict.

    ``items``: item_id, name, content and optionally flag, copies, outcome (of a signature scan),
    measure (duration or the like), declared. A column that is not there switches its check off."""
    p, have = Settings.of(profile), set(items.columns)
    name, content = F.col("name"), F.col("content")
    sniffed = items.withColumn("__s", sniff(content)).withColumn("kind", F.coalesce("__s.kind", F.lit("unknown")))
    sniffed = sniffed.withColumn("__note", K.note_of(name, content, F.col("kind"), p))
    kind, detail = F.col("kind"), F.coalesce("__s.detail", F.lit(""))
    media = category(ext(name)).isNotNull()
    length = F.coalesce(F.length(content), F.lit(-1))
    single = [K.check_name_chars(name), K.check_empty(length)]
    if "flag" in have:
        single.append(K.check_flag(F.col("flag"), p["safety.exec_permissions"]))
    if "copies" in have:
        single.append(K.check_copies(F.col("copies")))
    single += [K.check_double_ext(name, p["sidecars.block"]), K.check_unreadable(content),
               K.check_sidecar(name, kind, p), *K.note_findings(F.col("__note"), p),
               K.check_dangerous(name, kind, detail), K.check_ext_mismatch(name, kind), K.check_polyglot(name, content)]
    if "outcome" in have:
        single.append(F.when(media, signature_policy(p["safety.clamav"], F.lit(False), F.lit(True), length, F.col("outcome"))))
    if "measure" in have:
        single.append(K.check_no_duration(name, F.col("measure")))
    if "declared" in have:
        single += [F.when(media, f) for f in _structure(content)]
    single.append(F.when(media, K.check_decode(content, tier or profile["verify.tier"], kind == "text")))
    found = K.stop_at_terminal(F.array_sort(gather(*single)).cast(f"array<{FINDING_TYPE}>"))
    return (sniffed.withColumn("category", F.coalesce(category(ext(name)), F.lit("sidecar")))
            .withColumn("findings", found).withColumn("verdict", worst(F.col("findings"))).drop("__s", "__note"))


def _structure(content):
    from portcullis.schema import FAIL, finding, text
    return [finding(F.col("declared") > F.length(content), "structure", "TRUNCATED", FAIL,
                    text("item declares ", F.col("declared"), " but has ", F.length(content)))]


def finding_rows(scanned: DataFrame, key: str = "item_id") -> DataFrame:
    return to_rows(scanned, F.col("findings"), key)


