"""Content functions: what a body is, judged from its bytes."""
from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from portcullis.functions import tables as T
from portcullis.functions.columns import lookup


def _at(head: Column, offset: int, hexes: str) -> Column:
    """The bytes ``hexes`` stand at ``offset`` (hex text of the head is compared)."""
    return F.substring(head, 2 * offset + 1, len(hexes)) == hexes


def _hex(s: str) -> str:
    return s.encode("latin-1").hex().upper()


def looks_text(window: Column) -> Column:
    """Valid UTF-8 (a character cut at the end is forgiven) without control characters."""
    bom = F.hex(F.substring(window, 1, 3)) == "EFBBBF"
    body = F.when(bom, F.substring(window, 4, T.SNIFF_WINDOW)).otherwise(window)
    wide = F.hex(F.substring(body, 1, 2)).isin("FFFE", "FEFF")
    n = F.length(body)
    cuts = [F.substring(body, F.lit(1), F.greatest(n - k, F.lit(0))).cast("string") for k in range(5)]
    good = F.when(F.is_valid_utf8(cuts[0]), cuts[0])
    for c in cuts[1:]:
        good = good.when(F.is_valid_utf8(c), c)
    clean = ~good.rlike(r"[\x00-\x08\x0B\x0E-\x1F]")
    return F.when(wide, F.lit(True)).otherwise(F.coalesce(clean, F.lit(False)))


def sniff(content: Column) -> Column:
    """struct(kind, detail) of a body from its first 8 KiB; the first rule that fits decides."""
    window = F.substring(content, 1, T.SNIFF_WINDOW)
    head = F.hex(F.substring(content, 1, 400))  # every fixed position tested lies below 400
    n = F.length(window)

    def out(kind, detail=""):
        d = detail if isinstance(detail, Column) else F.lit(detail)
        return F.struct(F.lit(kind).alias("kind"), d.alias("detail"))

    def any_at(offset, *hexes):
        c = _at(head, offset, hexes[0])
        for h in hexes[1:]:
            c = c | _at(head, offset, h)
        return c

    brand = F.when(_at(head, 4, _hex("ftyp")) & (n >= 12),
                   F.btrim(F.substring(content, 9, 4).cast("string"), F.lit("\t\n\u000b\f\r "))).otherwise(F.lit(""))
    frame = head.rlike(r"^FF[EF](?:[2-7]|[A-F])")
    packets = lambda start, step: (_at(head, start, "47") & _at(head, start + step, "47")
                                   & _at(head, start + 2 * step, "47"))
    lower = F.lower(window.cast("string"))
    page = lower.contains("<html") | lower.contains("<!doctype html") | lower.contains("<script")
    webm = F.substring(content, 1, 256).contains(F.lit(b"webm"))
    text_kind = F.when(page, out("html")).otherwise(out("text"))
    return (F.when(n == 0, out("empty"))
            .when(_at(head, 0, "1A45DFA3") & webm, out("webm", "EBML doctype webm"))
            .when(_at(head, 0, "1A45DFA3"), out("matroska", "EBML header"))
            .when(any_at(4, *[_hex(x) for x in ("ftyp", "moov", "mdat", "wide", "free", "skip")]),
                  out("mp4", F.concat(F.lit("ISO BMFF brand "), brand)))
            .when(_at(head, 0, _hex("RIFF")) & _at(head, 8, _hex("AVI ")), out("avi", "RIFF AVI"))
            .when(_at(head, 0, _hex("RIFF")) & _at(head, 8, _hex("WAVE")), out("wav", "RIFF WAVE"))
            .when(_at(head, 0, "000001BA"), out("mpegps", "MPEG program stream pack header"))
            .when(_at(head, 0, _hex("FLV\x01")), out("flv"))
            .when(_at(head, 0, "3026B2758E66CF11"), out("asf", "ASF/WMV"))
            .when(_at(head, 0, _hex("OggS")), out("ogg"))
            .when(_at(head, 0, _hex("fLaC")), out("flac"))
            .when(_at(head, 0, _hex("ID3")) | frame, out("mp3", "MPEG audio frame or ID3"))
            .when(_at(head, 0, _hex("MZ")), out("executable", "PE/DOS executable"))
            .when(_at(head, 0, "7F454C46"), out("executable", "ELF"))
            .when(any_at(0, "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"),
                  out("executable", "Mach-O"))
            .when(any_at(0, "504B0304", "504B0506"), out("archive", "zip"))
            .when(_at(head, 0, "526172211A07"), out("archive", "rar"))
            .when(_at(head, 0, "377ABCAF271C"), out("archive", "7z"))
            .when(_at(head, 0, "1F8B"), out("archive", "gzip"))
            .when(_at(head, 0, _hex("%PDF-")), out("pdf"))
            .when(any_at(0, "89504E47", "FFD8FF", _hex("GIF8"), _hex("BM"))
                  | (_at(head, 0, _hex("RIFF")) & _at(head, 8, _hex("WEBP"))), out("image"))
            .when(_at(head, 0, _hex("#!")), out("script", "shebang"))
            .when((n >= 188 * 3) & packets(0, 188), out("mpegts", "188-byte packets"))
            .when((n >= 192 * 3 + 4) & packets(4, 192), out("mpegts", "192-byte packets (m2ts)"))
            .when(looks_text(window), text_kind)
            .otherwise(out("unknown")))


def kind_class(kind: Column) -> Column:
    """video, audio, dangerous or other."""
    return (F.when(kind.isin(T.VIDEO_KINDS), "video").when(kind.isin(T.AUDIO_KINDS), "audio")
             .when(kind.isin(T.DANGEROUS_KINDS), "dangerous").otherwise("other"))


# Extension -> its kinds between separators, so one lookup answers the question.
_FITTING = {e: "|" + "|".join(kinds) + "|" for e, kinds in T.EXTENSION_KINDS.items()}


def ext_allows(extension: Column, kind: Column) -> Column:
    """The extension may hold this kind; unknown extensions and unknown content always may."""
    fitting = lookup(extension, _FITTING)
    return (kind == "unknown") | F.coalesce(F.contains(fitting, F.concat(F.lit("|"), kind, F.lit("|"))), F.lit(True))


def appended_payload(content: Column) -> Column:
    """Sentence about a stub in the first MiB or an archive in the last MiB, else NULL."""
    head = F.substring(content, 1, T.PAYLOAD_WINDOW)
    tail = F.when(F.length(content) > T.PAYLOAD_WINDOW,
                  F.substring(content, -T.PAYLOAD_WINDOW, T.PAYLOAD_WINDOW)).otherwise(content)
    out = F.when(head.contains(F.lit(T.STUB_TEXT.encode())),
                 F.lit("PE executable stub string inside file"))
    for sig, shown in T.PAYLOAD_SIGNATURES:
        out = out.when(tail.contains(F.lit(bytes.fromhex(sig))), F.lit(
            f'archive/executable signature "{shown}" near end of file (appended payload)'))
    return out


def head_tail_valid(content: Column, tier: str, window: int = T.SNIFF_WINDOW) -> Column:
    """Decode check: quick looks at both ends, full at everything. A character cut by a window edge
    is forgiven."""
    whole = F.is_valid_utf8(content.cast("string"))
    if tier == "full":
        return whole

    def lenient(chunk, at_start):
        n = F.length(chunk)
        ok = F.lit(False)
        for k in range(4):
            piece = (F.substring(chunk, F.lit(k + 1), F.greatest(n - k, F.lit(0))) if at_start
                     else F.substring(chunk, F.lit(1), F.greatest(n - k, F.lit(0))))
            ok = ok | F.is_valid_utf8(piece.cast("string"))
        return ok

    big = F.length(content) > 2 * window
    return F.when(big, lenient(F.substring(content, 1, window), False)
                  & lenient(F.substring(content, -window, window), True)).otherwise(whole)


@F.arrow_udf(StringType())
def _composed(s: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normalize("NFC", t) for t in s.to_pylist()], pa.string())


def composed(s: Column) -> Column:
    """Unicode normal form C. Characters below U+0300 are never changed by it, so only texts with others go to Python."""
    return F.coalesce(_composed(F.when(s.rlike(r"[^\x00-\x{2FF}]"), s)), s)


def canonical_bytes(s: Column) -> Column:
    """Text in the form two honest copies share: newlines, trailing blanks, outer blank space and the way accents
    are composed are removed from the comparison."""
    t = F.regexp_replace(composed(s), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(t, r"\n+\z", "")
