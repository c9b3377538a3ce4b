"""Link reports over metadata and text parts, and bounded evidence of a tool's output."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions.columns import let
from portcullis.functions.text import clip_bytes, find_links
from portcullis.operators.checks import graded
from portcullis.operators.profiles import Settings
from portcullis.operators.spread import ordered_entries, paged_lists
from portcullis.schema import finding, gather, text, to_rows, union_all


def labelled(where, value: Column) -> Column:
    """"where: link" for every link of a text."""
    return F.transform(find_links(F.coalesce(value, F.lit(""))), lambda l: text(where, ": ", l))


def links_in_tags(tags: Column, prefix="tag ", skip: tuple[str, ...] = ()) -> Column:
    """Labelled links of a metadata map, keys in order."""
    tags = F.coalesce(tags, F.create_map().cast("map<string,string>"))
    keys = F.filter(F.array_sort(F.map_keys(tags)), lambda k: ~F.lower(k).isin(list(skip)) if skip else F.lit(True))
    return F.flatten(F.transform(keys, lambda k: labelled(text(prefix, k), F.try_element_at(tags, k))))


HIT_SPAN = 1 << 20    # links of one source row that keep a place of their own
SOURCE_SPAN = 1 << 60  # part numbers below this many spans


def link_hits(items: DataFrame, parts: DataFrame | None = None, chapters: DataFrame | None = None,
              attachments: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, hit): every labelled link; ``rank`` is the report order within an item.

    Title and tags come first, then parts, chapters and attachment names. Each source row yields
    its own links; nothing is collected here."""
    def ranked(df, hits, source, idx):
        base = F.lit(source * SOURCE_SPAN) + idx.cast("long") * HIT_SPAN
        return (df.select("item_id", base.alias("base"), F.posexplode(hits).alias("pos", "hit"))
                  .select("item_id", (F.col("base") + F.col("pos")).alias("rank"), "hit"))

    frames = [ranked(items, F.concat(labelled("title", F.col("title")), links_in_tags(F.col("tags"))),
                     0, F.lit(0))]
    if parts is not None:
        label = text("stream #", F.col("idx"))
        frames.append(ranked(parts, F.concat(
            labelled(text(label, " title"), F.col("title")),
            links_in_tags(F.col("tags"), text(label, " tag "), ("title", "language"))), 1, F.col("idx")))
    if chapters is not None:
        frames.append(ranked(chapters, labelled(text("chapter ", F.col("idx")), F.col("title")), 2, F.col("idx")))
    if attachments is not None:
        frames.append(ranked(attachments, labelled("attachment name", F.col("file_name")), 3, F.col("att_id")))
    return union_all(frames)


def link_entries(hits: DataFrame) -> DataFrame:
    """(item_id, ordinal, hit): the labelled links of each item numbered in report order, one row a link."""
    return ordered_entries(hits, ["item_id"], "rank", F.col("hit"), "hit")


def links_in_attrs(hits: DataFrame, p: Settings, page: int = 4096, larger: bool = True) -> DataFrame:
    """LINK_IN_TAG findings: one per item, or one per page of ``page`` links of a larger item. Without ``larger`` only
    items whose links fit on one page have theirs; ``link_entries`` has the links of all."""
    lists = paged_lists(hits, ["item_id"], "rank", F.col("hit"), "hits", page)
    if not larger:
        lists = lists.filter("pages = 1")
    return to_rows(lists, gather(finding(
        F.lit(True), "links", "LINK_IN_TAG", graded(p["metadata.links"]),
        text(F.col("total"), " link(s) in metadata: ", F.array_join("hits", "; ")),
        F.array_join("hits", "\n"), seq=F.col("page"))), "item_id")


def links_in_text_parts(parts: DataFrame, p: Settings) -> DataFrame:
    """LINK_IN_SUBS findings of text parts; whole texts are searched."""
    chosen = parts.filter((F.col("type") == "subtitle") & F.col("text_sub") & p["subtitles.scan_links"])
    found = chosen.withColumn("__links", find_links(F.col("text")))
    severity = graded(p["subtitles.links"])
    links = finding(F.size("__links") > 0, "text_links", "LINK_IN_SUBS", severity,
                    text("stream #", F.col("idx"), " subtitle text contains ", F.size("__links"), " link(s): ",
                         F.array_join("__links", ", ")),
                    F.array_join("__links", "\n"), seq=F.col("idx"))
    return to_rows(found, gather(links), "item_id", "idx")


def bounded_evidence(output: Column, prefix: Column) -> Column:
    """Lines of a tool's output about this item: at most 8 lines, 512 bytes each, 4096 bytes in all.

    The rule is greedy: a line that would cross the bound is left out and a later, shorter one may
    still fit, which is why the lines are folded in order."""
    lines = F.filter(F.split(output, "\n"), lambda l: l.startswith(prefix))
    clipped = F.transform(lines, lambda l: clip_bytes(l, T.EVIDENCE_LINE_BYTES))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("kept"), F.lit(0).alias("size"), F.lit(0).alias("more"))

    def step(acc, line):
        fits = (F.size(acc["kept"]) < T.EVIDENCE_LINES) & (acc["size"] + F.octet_length(line) <= T.EVIDENCE_BYTES)
        return F.when(fits, F.struct(F.array_append(acc["kept"], line).alias("kept"),
                                     (acc["size"] + F.octet_length(line)).alias("size"), acc["more"].alias("more"))
                      ).otherwise(F.struct(acc["kept"].alias("kept"), acc["size"].alias("size"),
                                           (acc["more"] + 1).alias("more")))

    def done(acc):
        shown = F.when(F.size(acc["kept"]) > 0, acc["kept"]).otherwise(
            F.array(F.lit("no line of the scanner output refers to this file")))
        return F.array_join(F.when(acc["more"] > 0, F.array_append(
            shown, text(acc["more"], " more line(s) about this file not shown"))).otherwise(shown), "\n")

    return let(clipped, lambda ls: F.aggregate(ls, start, step, done))
