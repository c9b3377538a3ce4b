"""Personal data: format-preserving Feistel pseudonyms.

A finding is validated (octets, Luhn and mod-97 checks, calendar, numbering rules), its value is read
as one integer of the set of all values of its format, permuted in that set by a keyed Feistel network
with cycle walking, and written back in the same places: separators, letter case and length stay, check
digits are made anew. Equal values of a kind get equal pseudonyms in every document, whatever their
separators; different values of a format never collide; who holds the key can invert the map.

One projection of the whole text of each row; nothing is shuffled.

Defined results: null texts stay null, texts without findings stay as they are; other columns,
clashing names included, are kept; repeated rows are rewritten alike. A value whose format has few
members (an e-mail name of one letter) may by chance be its own pseudonym.
"""
from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from portcullis.llm.common import small_batches, tidy

#: Key of the registered query; users pass their own.
#: For the registered query, the pipeline's runs on test tables and tests alone: who has it can invert every pseudonym.
SAMPLE_KEY = b"portcullis sample key"
ROUNDS = 8
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_WORD = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
KINDS = [
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})",
    rf"(?P<access_key>{_WORD}(?:AKIA|ASIA)[0-9A-Z]{{16}}{_END})",
    r"(?P<assigned>(?i:password|passwd|secret|token|api_?key)(?:\s{0,3}[=:]\s{0,3})[\"']?(?P<value>[A-Za-z0-9+/_-]{8,}))",
    rf"(?P<prefixed>{_WORD}(?:ghp_|gho_|sk-|xoxb-|xoxp-)(?P<rest>[A-Za-z0-9-]{{16,}}){_END})",
    rf"(?P<iban>{_WORD}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}{_END})",
    rf"(?P<iso_date>{_WORD}(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}{_END})",
    rf"(?P<day_date>{_WORD}[0-9]{{2}}[/.][0-9]{{2}}[/.](?:19|20)[0-9]{{2}}{_END})",
    r"(?P<ip>(?<![0-9A-Za-z_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_])(?!\.[0-9]))",
    rf"(?P<ssn>{_WORD}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-?[0-9A-Za-z_]))",
    rf"(?P<card>{_WORD}[0-9](?:[ -]?[0-9]){{12,18}}{_END})",
    r"(?P<phone>(?<![A-Za-z0-9_+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z_]))",
]
PATTERN = re.compile("|".join(KINDS))
#: The same kinds one by one, for what else may begin where a value is not valid.
EACH = {re.match(r"\(\?P<(\w+)>", p)[1]: re.compile(p) for p in KINDS}
#: Characters (without separators) of the shortest value of a kind whose match may run into the next word.
SHORTEST = {"card": 13, "iban": 15}
#: Kinds whose written form is decisive: an impossible date or number of that form is nothing else.
DECISIVE = {"ssn", "iso_date", "day_date"}
_WORD_CHARACTER = re.compile(r"[A-Za-z0-9_]")
_ACCESS = re.compile("AKIA|ASIA")
_RUN = re.compile(r"[A-Za-z0-9]+|.", re.S)
_NEEDED = bytes(c for c in range(256) if c not in b"0123456789@")


def permute(key: bytes, kind: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size): Feistel rounds on the next even number of bits, walked until
    the value falls into the range again."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def round_(i: int, x: int) -> int:
        d = hashlib.blake2b(b"%d|%d|" % (i, size) + x.to_bytes(width, "big"), key=key[:64], person=kind.encode()[:16], digest_size=min(64, width))
        return int.from_bytes(d.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ round_(i, left), left) if back else (right, left ^ round_(i, right))
        value = left << half | right
        if value < size:
            return value


_SLOTS = {c: ("0", 10) for c in "0123456789"} | {chr(c): ("A", 26) for c in range(65, 91)} | {chr(c): ("a", 26) for c in range(97, 123)}


def permute_characters(key: bytes, kind: str, text: str, back: bool = False, hexadecimal: bool = False) -> str:
    """ASCII letters and digits permuted together, each within its class; other characters stay."""
    size, value, places = 1, 0, []
    for i, c in enumerate(text):
        first, n = ("h", 16) if hexadecimal else _SLOTS.get(c, ("", 0))
        if n:
            size, value = size * n, value * n + (int(c, 16) if hexadecimal else ord(c) - ord(first))
            places.append((i, first, n))
    value, out = permute(key, kind, value, size, back), list(text)
    for i, first, n in reversed(places):
        value, d = divmod(value, n)
        out[i] = "0123456789abcdef"[d] if hexadecimal else chr(ord(first) + d)
    return "".join(out)


def with_digits(text: str, digits: str) -> str:
    """The digits of ``text`` replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """Luhn check digit that belongs behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _email(key, m, back):
    name, _, domain = m.partition("@")
    inner, dot, top = domain.rpartition(".")
    return permute_characters(key, "email", f"{name}@{inner}", back) + dot + top


def _card(key, m, back):
    d = "".join(c for c in m if c.isdigit())
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    body = f"{permute(key, 'card', int(d[:-1]), 10 ** n, back):0{n}d}"
    return with_digits(m, body + str(luhn(body)))


def _ip(key, m, back):
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low = [(0, 10, 100)[len(p) - 1] for p in parts]
    size, value = 1, 0
    counts = [(10, 90, 156)[len(p) - 1] for p in parts]
    for p, lo, n in zip(parts, low, counts, strict=True):
        size, value = size * n, value * n + int(p) - lo
    value = permute(key, "ip", value, size, back)
    out = []
    for lo, n in zip(reversed(low), reversed(counts), strict=True):
        value, d = divmod(value, n)
        out.append(str(lo + d))
    return ".".join(reversed(out))


def _date(key, year, month, day, back):
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return datetime.date.fromordinal(FIRST_DAY + permute(key, "date", at, LAST_DAY - FIRST_DAY + 1, back))


def _iso_date(key, m, back):
    d = _date(key, m[:4], m[5:7], m[8:], back)
    return d and d.isoformat()


def _day_date(key, m, back):
    d = _date(key, m[6:], m[3:5], m[:2], back)
    return d and f"{d.day:02d}{m[2]}{d.month:02d}{m[5]}{d.year:04d}"


def _ssn_valid(v: int) -> bool:
    area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(key, m, back):
    v = int(m.replace("-", ""))
    if not _ssn_valid(v):
        return None
    while True:  # walks on until the number is a valid one again
        v = permute(key, "ssn", v, 900_000_000, back)
        if _ssn_valid(v):
            return with_digits(m, f"{v:09d}")


def _iban_rest(country: str, bban: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def _iban(key, m, back):
    s = m.replace(" ", "")
    country, check, bban = s[:2], s[2:4], s[4:]
    if len(bban) < 11 or not check.isdigit() or 98 - _iban_rest(country, bban) != int(check):
        return None
    new = permute_characters(key, "iban" + country, bban, back)
    it = iter(f"{country}{98 - _iban_rest(country, new):02d}{new}")
    return "".join(c if c == " " else next(it) for c in m)


def _phone(key, m, back):
    d = "".join(c for c in m if c.isdigit())
    code = re.match(r"\+([0-9]{1,3})(?=[ .-]|\()", m)
    prefix = code[1] if code else ""
    rest = d[len(prefix):]
    plain = m.isdigit()
    if not 7 <= len(rest) <= 14 or len(d) > 15 or (not m.startswith("+") and (plain or len(d) < 9)):
        return None
    if re.fullmatch(r"[0-9]{1,4}(?:\.[0-9]+)+", m):  # versions and decimal numbers
        return None
    new = f"{permute(key, 'phone', int(rest), 10 ** len(rest), back):0{len(rest)}d}"
    return with_digits(m, prefix + new)


def _secret(key, kind, text, back):
    low_hex = re.fullmatch(r"[0-9a-f]+", text) is not None
    return permute_characters(key, kind + ("x" if low_hex else ""), text, back, hexadecimal=low_hex)


_NUMBERS = {"email": _email, "card": _card, "ip": _ip, "iso_date": _iso_date, "day_date": _day_date, "ssn": _ssn, "iban": _iban,
            "phone": _phone}


def replacement(m: re.Match, key: bytes, back: bool, kind: str) -> tuple[str, str] | None:
    """(kind, new text) of a match of that kind, or None where the value is not valid."""
    found = m.group()
    if kind == "access_key":
        return "secret", found[:4] + permute_characters(key, "access", found[4:], back)
    if kind in ("assigned", "prefixed"):
        inner = "value" if kind == "assigned" else "rest"
        a = m.start(inner) - m.start()
        if not any(c.isdigit() for c in m.group(inner)):
            return None
        return "secret", found[:a] + _secret(key, "secret", m.group(inner), back)
    new = _NUMBERS[kind](key, found, back)
    return None if new is None else (kind, new)


def _first_valid(m: re.Match, key: bytes, back: bool) -> tuple[int, tuple[str, str]] | None:
    """End and replacement of the valid value that begins where ``m`` does: the longest of the first kind that
    has one. A card or IBAN may have run into the number or word behind it, so its shorter ends count too."""
    text, start = m.string, m.start()
    first = next(k for k in EACH if m.group(k) is not None)
    kinds = list(EACH)
    for kind in [first] if first in DECISIVE else kinds[kinds.index(first):]:
        k = m if kind == first else EACH[kind].match(text, start)
        while k is not None:
            got = replacement(k, key, back, kind)
            if got is not None:
                return k.end(), got
            if kind not in SHORTEST:
                break
            end = k.end() - 1
            k = None
            while end > start and k is None:
                if sum(c.isalnum() for c in text[start:end]) < SHORTEST[kind]:
                    break
                # a value ends where no letter or digit follows
                if text[end - 1].isalnum() and not _WORD_CHARACTER.match(text, end):
                    k = EACH[kind].fullmatch(text, start, end)
                end -= 1
    return None


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """New text and (start, end, kind) of each finding. ``back`` inverts the map on such a text."""
    spans, out, at, start = [], [], 0, 0
    while (m := PATTERN.search(text, start)) is not None:
        found = _first_valid(m, key, back)
        if found is None:
            # not valid: look again behind its first run of digits or letters
            start = max(_RUN.match(text, m.start()).end(), m.start() + 1)
            if m.group("prefixed") is not None:  # without digits: only an access key can begin inside, the rest is not read again
                inside = _ACCESS.search(text, start, m.end())
                start = inside.start() if inside else m.end()
            continue
        end, got = found
        out += [text[at:m.start()], got[1]]
        spans.append((m.start(), end, got[0]))
        at = start = end
    return ("".join(out) + text[at:], spans) if spans else (text, spans)


def may_hold(text: bytes) -> bool:
    """False where no pattern can match: every finding has a digit or an at sign, or is an access key."""
    return bool(text.translate(None, _NEEDED)) or b"AKIA" in text or b"ASIA" in text


def rewrite(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text rewritten, and, behind them, _pii_count and _pii_kinds (sorted, distinct).
    Columns may have any names, those as well."""
    return _rewritten(docs, key, column).toDF(*docs.columns, "_pii_count", "_pii_kinds")


def hidden(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """``docs`` with the text rewritten; columns may have any names."""
    return _rewritten(docs, key, column).drop("n", "k").toDF(*docs.columns)


def _rewritten(docs: DataFrame, key: bytes, column: str) -> DataFrame:
    """The columns of ``docs`` by place, n and k."""
    at = docs.columns.index(column)
    # A projection renames, so that names may clash or repeat below Arrow.
    inner = small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn(f"c{at}", F.col(f"c{at}").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, kinds = [], [], []
            for t in b.column(at).to_pylist():
                spans: list = []
                if t is not None and may_hold(t):
                    new, spans = pseudonymise(t.decode("utf-8", "surrogateescape"), key)
                    t = new.encode("utf-8", "surrogateescape") if spans else t
                texts.append(t)
                counts.append(len(spans))
                kinds.append(",".join(sorted({s[2] for s in spans})))
            columns = [*b.columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())]
            columns[at] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "n", "k"])

    kind = StructType([*inner.schema.fields, StructField("n", LongType()), StructField("k", StringType())])
    out = inner.mapInArrow(tidy(run), kind)
    return out.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

