"""Typed parsing of untrusted values: a bad value is NULL and its field is named, never an error."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions.columns import let, lookup

_DECIMAL = r"^[+\-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?$"
_BLANK = "\t\n\u000b\f\r \u0085\u00a0"


def plain_number(s: Column) -> Column:
    """A finite decimal number, NULL for every other spelling."""
    def read(t):
        return F.when(t.rlike(_DECIMAL), t.try_cast("double"))
    return let(let(F.btrim(s, F.lit(_BLANK)), read), lambda v: F.when(F.abs(v) < float("inf"), v))


def parse_bounded(raw: Column, lo: float, hi: float) -> Column:
    """A number or num/den within [lo, hi]."""
    def read(t):
        cut = F.instr(t, "/")
        ratio = F.try_divide(plain_number(F.substring_index(t, "/", 1)), plain_number(t.substr(cut + 1, F.length(t))))
        return F.when(F.octet_length(t) <= 64, F.when(cut > 0, ratio).otherwise(plain_number(t)))
    return let(let(F.btrim(raw, F.lit(_BLANK)), read), lambda v: F.when((v >= lo) & (v <= hi) & ~F.isnan(v), v))


def parse_int(raw: Column, hi: int) -> Column:
    """A whole number in [0, hi]."""
    return let(parse_bounded(raw, 0.0, float(hi)), lambda v: F.when(v == F.floor(v), v)).cast("int")


def parse_enum(raw: Column) -> Column:
    """A short name, lower-cased; '' where the tool says it is not signalled; NULL when unfit."""
    s = F.coalesce(raw, F.lit(""))
    fit = s.rlike(r"^[A-Za-z0-9._+\-]+\z") & (F.octet_length(s) <= T.MAX_ENUM_LENGTH)
    return F.when(s.isin(T.UNSIGNALLED_NAMES), "").when(fit, F.lower(s))


def coded(raw: Column, table: str) -> Column:
    """Name of a code point; '' for an unlisted or absent code; NULL for a malformed one."""
    named = let(parse_int(raw, 255), lambda n: F.when(
        n.isNotNull(), F.coalesce(lookup(n, T.CODE_TABLES[table]), F.lit(""))))
    return F.when(raw.isNull(), "").otherwise(named)


def coordinate_list(raw: Column, n: int) -> Column:
    """Exactly n comma separated values in [0, 1], else NULL."""
    parts = F.transform(F.split(raw, ","), lambda p: plain_number(p))
    return let(parts, lambda p: F.when((F.octet_length(raw) <= 256) & (F.size(p) == n) & F.forall(
        p, lambda v: v.isNotNull() & (v >= 0) & (v <= 1)), p))


def malformed(**bad: Column) -> Column:
    """Sorted names of the fields whose value was rejected."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()])))


def close_enough(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return (d <= 1e-9) | (d <= 1e-6 * F.greatest(F.abs(a), F.abs(b)))


def family_labels(transfer: Column, types: Column) -> Column:
    """Signal family labels: the transfer's label first, then those of the side-data types."""
    low = F.transform(types, lambda t: F.lower(F.coalesce(t, F.lit(""))))

    def seen(*words):
        return F.exists(low, lambda t: F.greatest(*[t.contains(w) for w in words])
                        if len(words) > 1 else t.contains(words[0]))

    first = F.transform(low, lambda t: F.array_compact(F.array(
        F.when(t.contains("dovi") | t.contains("dolby vision"), F.lit("dovi")),
        F.when(t.contains("hdr10+") | t.contains("dynamic hdr"), F.lit("hdr10plus")))))
    return F.array_distinct(F.concat(
        F.array_compact(F.array(lookup(transfer, T.TRANSFER_LABELS))), F.flatten(first)))


def _general(parts: Column) -> Column:
    """Significant digits and decimal exponent, struct(sign, digits, exp), in the shorter of plain
    and e-notation."""
    def write(p):
        digits, exp = p["digits"], p["exp"]
        n, size = F.length(digits), F.abs(exp).cast("string")
        rest = F.substring(digits, 2, 40)
        science = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
                           F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")),
                           F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
        whole = F.concat(digits, F.repeat(F.lit("0"), exp + 1 - n))
        mixed = F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, n))
        return F.concat(p["sign"], F.when((exp < -4) | (exp >= 6), science).when(exp < 0, below)
                        .when(n <= exp + 1, whole).otherwise(mixed))
    return let(parts, write)


def _parts(sign: Column, digits: Column, exp: Column) -> Column:
    return F.struct(sign.alias("sign"), F.rtrim(digits, F.lit("0")).alias("digits"), exp.alias("exp"))


def shown(v: Column) -> Column:
    """A measured value with six significant digits."""
    def read(s):
        digits = F.concat(F.regexp_extract(s, r"([0-9])[.,]", 1), F.regexp_extract(s, r"[.,]([0-9]+)", 1))
        return _general(_parts(F.regexp_extract(s, "^(-?)", 1), digits,
                               F.regexp_extract(s, r"e([+\-][0-9]+)$", 1).try_cast("int")))
    return F.when(v == 0, "0").when(v.isNotNull(), let(F.format_string("%.5e", v), read))


def exact(v: Column) -> Column:
    """Shortest spelling that reads back as the same value."""
    def read(s):
        whole, joined = F.regexp_extract(s, r"^-?([0-9]+)", 1), F.regexp_replace(s, r"^-|\.|E.*$", "")
        power = F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        digits = F.ltrim(joined, F.lit("0"))
        return _general(_parts(F.regexp_extract(s, "^(-?)", 1), digits,
                               power + F.length(whole) - 1 - (F.length(joined) - F.length(digits))))
    return F.when(v == 0, "0").when(v.isNotNull(), let(v.cast("string"), read))
