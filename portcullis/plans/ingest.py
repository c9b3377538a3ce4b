"""Ingest plan: scan an item with its parts, route it on the scan's verdict, decide, clean and place."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.functions.columns import category, ext
from portcullis.operators import checks as K
from portcullis.operators import cleaning, links, metadata, policy, routing
from portcullis.operators.profiles import Profile, Settings
from portcullis.operators.verdict import verdicts
from portcullis.plans.scan import finding_rows, scan_items
from portcullis.schema import FAIL, to_rows, union_all
from portcullis.session import kept as stored


@dataclass
class Run:
    """Frames of one run; nothing is computed until a sink asks for it."""
    items: DataFrame        # one row per item: verdict, route, reason
    findings: DataFrame     # long findings of all steps
    parts: DataFrame        # decisions per part
    attachments: DataFrame | None
    reasons: DataFrame


_LONG = ["item_id", "stage", "seq", "terminal", "code", "severity", "message", "detail"]


def scan_run(items: DataFrame, parts: DataFrame, profile: Profile, attachments: DataFrame | None = None,
             tier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items without their bodies (category, parsed, verdict) and the long findings of the whole scan.

    An item whose own checks end with a terminal finding, and every sidecar, has no findings about its
    parts; a decode check counts only where nothing else failed. Optional columns of ``items`` switch
    checks on: title and tags (links, provenance), errors and warnings (tool messages)."""
    p, have = Settings.of(profile), set(items.columns)
    # the body has done its work; from here on rows are narrow, and they are read many times
    narrow = stored(scan_items(items, profile, tier).drop("content", "__note").withColumn(
        "__live", (F.col("category") != "sidecar") & ~F.exists("findings", lambda f: f["terminal"])))
    own = finding_rows(narrow).select(*_LONG)
    live = narrow.filter("__live").select("item_id", "category", "container")
    with_parts = parts.drop("category", "container").join(live, "item_id")
    if "labels" not in parts.columns:
        with_parts = with_parts.withColumn("labels", F.array().cast("array<string>"))
    if "codec_tag" not in parts.columns:
        with_parts = with_parts.withColumn("codec_tag", F.lit(""))
    found = [own, metadata.check_parts(with_parts, p).select(*_LONG)]
    alive = narrow.filter("__live")
    if attachments is not None:
        acted = policy.decide_attachments(attachments.join(live.select("item_id"), "item_id", "left_semi"), parts, p)
        found.append(policy.attachment_findings(acted).select(*_LONG))
    if {"errors", "warnings"} <= have:
        found.append(to_rows(alive, K.check_tool_messages(F.col("errors"), F.col("warnings")), "item_id").select(*_LONG))
    if {"title", "tags"} <= have:
        hits = links.link_hits(alive, with_parts if {"title", "tags"} <= set(with_parts.columns) else None)
        found.append(links.links_in_attrs(hits, p).select(*_LONG))
        mp4 = alive.filter(F.col("container") == "mp4")
        xmp = F.col("has_xmp") if "has_xmp" in have else F.lit(False)
        found.append(to_rows(mp4, metadata.provenance(F.col("tags"), xmp, p), "item_id").select(*_LONG))
    if "text" in parts.columns:
        found.append(links.links_in_text_parts(with_parts, p).select(*_LONG))
    every = stored(union_all(found))
    failed = (every.filter((F.col("severity") >= FAIL) & (F.col("code") != "DECODE_FAIL")).groupBy("item_id")
              .agg(F.lit(True).alias("__failed")))
    kept = (every.join(failed, "item_id", "left")
            .filter(~((F.col("code") == "DECODE_FAIL") & F.coalesce("__failed", F.lit(False)))).drop("__failed"))
    bare = narrow.drop("findings", "verdict", "__live")
    return stored(verdicts(bare, kept)), kept


def ingest(items: DataFrame, parts: DataFrame, profile: Profile, attachments: DataFrame | None = None,
           force: bool = False, tier: str | None = None, root: str | None = None) -> Run:
    """``items``: item_id, name, path, content, container, copies, tool_warning, chapter_n, title,
    global_tags, track_tags, muxing_app, writing_app; ``parts`` and ``attachments`` as in S3.

    Items are refused and routed on the verdict of the scan alone; what the policy finds joins the
    report afterwards, for items that were not refused and without NO_VIDEO for audio and subtitle
    containers. With ``root`` the outputs of rebuilt items are planned as well (a dry run)."""
    p = Settings.of(profile)
    judged, found = scan_run(items, parts, profile, attachments, tier)
    decided = stored(policy.decide(parts, p))
    kept_atts = None if attachments is None else policy.decide_attachments(attachments, parts, p)
    chapters = items.select("item_id", "chapter_n")
    reasons = routing.rebuild_reasons(decided, kept_atts, chapters, p)
    facts = decided.groupBy("item_id").agg((~F.max("has_video")).alias("no_video"), F.lit(True).alias("parsed"))
    ready = judged.join(facts, "item_id", "left").withColumns({
        "parsed": F.coalesce("parsed", F.lit(False)), "no_video": F.coalesce("no_video", F.lit(True))})
    routed = stored(routing.route_items(ready, reasons, p, force))
    refused = routing.refuse(F.col("path"), F.col("verdict"), F.col("parsed"), F.lit(force))
    gated = routed.filter(category(ext(F.col("path"))).isNotNull() & refused.isNull()).select(
        "item_id", category(ext(F.col("path"))).isin("audio", "subtitle").alias("__side"))
    policies = (policy.decision_findings(decided).select(*_LONG).join(gated, "item_id")
                .filter(~(F.col("__side") & (F.col("code") == "NO_VIDEO"))).drop("__side"))
    found = union_all([found, policies.select(*_LONG), routing.route_findings(routed, reasons, force).select(*_LONG)])
    to_clean = routed.filter(F.col("route") == "clean")
    what = cleaning.removals(to_clean, decided.join(to_clean.select("item_id"), "item_id", "left_semi")
                             .withColumn("editable", F.lit(True)), p)
    found = found.unionByName(cleaning.clean_findings(to_clean, what).select(*_LONG))
    if root is not None:
        placed = routing.plan_destinations(routed.withColumn("eligible", F.col("route") == "remux"), root, dry_run=True)
        found = found.unionByName(placed.filter(F.col("code").isNotNull()).select(
            "item_id", F.lit(28).alias("stage"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("terminal"), "code",
            "severity", "message", F.lit(None).cast("string").alias("detail")))
    return Run(verdicts(routed.drop("verdict"), found), found, decided, kept_atts, reasons)
