"""Text functions: decoding, invisible characters, escaping, links and trusted hosts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portcullis.functions import tables as T
from portcullis.functions.columns import let, string_list

INVISIBLE = r"[\p{Cf}&&[^\u00ad\u0600-\u200a]]"
SPACES = r"[\t\n\x0B\f\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
UNSAFE = r"[\x00-\x08\x0A-\x1F\x7F-\x9F\u2028\u2029\p{Cf}]"


def _code_hex(char: Column) -> Column:
    """Code point of a one-character string as eight upper-case hex digits."""
    return F.hex(F.encode(char, "UTF-32"))


# --- decoding -------------------------------------------------------------------------------
def valid_utf8(raw: Column) -> Column:
    """UTF-8 text of raw bytes; each run of invalid bytes becomes one '?'.

    A genuine U+FFFD is kept: it is set aside before the invalid bytes are replaced by that same
    character."""
    s = raw.cast("string")
    aside = F.replace(F.replace(s, F.lit("\ue000"), F.lit("\ue000a")), F.lit("\ufffd"), F.lit("\ue000b"))
    fixed = F.regexp_replace(F.make_valid_utf8(aside), "\ufffd+", "?")
    back = F.replace(F.replace(fixed, F.lit("\ue000b"), F.lit("\ufffd")), F.lit("\ue000a"), F.lit("\ue000"))
    return F.when(F.is_valid_utf8(s), s).otherwise(back)


def _utf16(raw: Column, little: bool) -> Column:
    """UTF-16 units to text without failing: an unpaired surrogate becomes U+FFFD."""
    units = F.regexp_extract_all(F.hex(raw), F.lit("(....)"), 1)
    if little:
        units = F.transform(units, lambda u: F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2)))
    high, low = "^D[89AB]", "^D[C-F]"

    def repaired(all_units):
        def one(u, i):
            after = F.coalesce(F.get(all_units, i + 1), F.lit("")).rlike(low)
            before = F.coalesce(F.get(all_units, i - 1), F.lit("")).rlike(high)
            return (F.when(u.rlike(high) & ~after, F.lit("FFFD"))
                     .when(u.rlike(low) & ~before, F.lit("FFFD")).otherwise(u))
        return F.transform(all_units, one)

    return F.decode(F.unhex(F.concat_ws("", let(units, repaired))), "UTF-16BE")


def decode_text(raw: Column) -> Column:
    """Bytes of a note as text: byte order marks honoured, bad bytes '?', NUL a space."""
    head = F.hex(F.substring(raw, 1, 3))
    rest = F.substring(raw, 3, 2147483647)
    plain = valid_utf8(F.when(head.startswith("EFBBBF"), F.substring(raw, 4, 2147483647)).otherwise(raw))
    wide = (F.when(head.startswith("FFFE"), _utf16(rest, True))
             .when(head.startswith("FEFF"), _utf16(rest, False)))
    # An empty wide text falls back to the plain reading.
    return F.translate(F.when(F.coalesce(wide, F.lit("")) != "", wide).otherwise(plain),
                       "\x00", " ")


def strip_invisible(s: Column) -> Column:
    """Remove format characters from U+200B on, so that a link they split is found."""
    return F.regexp_replace(s, INVISIBLE, "")


def first_invisible(name: Column) -> Column:
    """Description of the first format character of a name, NULL when there is none."""
    char = F.regexp_extract(name, r"(\p{Cf})", 1)
    point = F.regexp_replace(_code_hex(char), r"^0+(?=.{4})", "")
    what = F.when(char.rlike(r"[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"),
                  F.lit("bidi control U+")).otherwise(F.lit("zero-width character U+"))
    return F.when(char != "", F.concat(what, point))


def sanitize(s: Column) -> Column:
    """Make controls, format characters and line separators visible as escapes.

    Only the distinct offending characters are replaced, so the cost does not grow with their
    number; bytes that are not UTF-8 stay as they are."""
    def escape(c):
        h = F.lower(_code_hex(c))
        return (F.when(h.startswith("000000"), F.concat(F.lit("\\x"), F.substring(h, 7, 2)))
                 .when(h.startswith("0000"), F.concat(F.lit("\\u"), F.substring(h, 5, 4)))
                 .otherwise(F.concat(F.lit("\\U"), h)))

    offenders = F.array_distinct(F.regexp_extract_all(s, F.lit(f"({UNSAFE})"), 1))
    return F.when(s.rlike(UNSAFE), F.aggregate(offenders, s, lambda acc, c: F.replace(acc, c, escape(c)))
                  ).otherwise(s)


def printable(raw: Column) -> Column:
    """Metadata value fit for a report: valid text without controls, at most 512 bytes."""
    clean = F.regexp_replace(valid_utf8(raw), r"[\x00-\x08\x0B-\x1F]", "")
    data = F.encode(clean, "UTF-8")
    return F.when(F.octet_length(clean) > 512,
                  F.concat(F.substring(data, 1, 512), F.encode(F.lit("\u2026"), "UTF-8")).cast("string")
                  ).otherwise(clean)


def clip_bytes(s: Column, limit: int) -> Column:
    """Trim, cut to ``limit`` bytes on a character boundary with '...', escape."""
    t = F.btrim(s, F.lit("\t\n\u000b\f\r \u0085\u00a0"))
    head = F.substring(F.encode(t, "UTF-8"), 1, limit)
    # A character cut in half leaves at most three bytes, which are dropped.
    options = [F.substring(head, 1, limit - k).cast("string") for k in range(4)]
    cut = F.when(F.is_valid_utf8(options[0]), options[0])
    for o in options[1:]:
        cut = cut.when(F.is_valid_utf8(o), o)
    whole = F.octet_length(t) <= limit
    return let(F.when(whole, t).otherwise(F.concat(cut, F.lit("..."))), sanitize)


# --- links -----------------------------------------------------------------------------------
def _fold(word: str) -> str:
    """Case folding of s and k reaches U+017F and U+212A in the reference's pattern dialect."""
    return word.replace("s", "[s\u017f]").replace("k", "[k\u212a]")


_ALNUM = "a-z0-9\u017f\u212a"
_LABEL = f"[{_ALNUM}](?:[{_ALNUM}-]{{0,61}}[{_ALNUM}])?"
_TLD = "(?:" + "|".join(_fold(t) for t in T.LINK_TLDS) + ")"
# ASCII word boundary, spelled out because Java's own is Unicode-aware.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_SCHEME = f"(?:http{_fold('s')}?://|ftp://|www\\.)"
# A link with a scheme, or a whole run of dotted labels and the word character behind it. Runs are taken
# possessively, so a megabyte of labels needs neither stack nor backtracking; the part of a run up to
# its last top-level domain is cut out by a second, linear pattern.
LINK = (f"(?i)({_SCHEME}[^\\t\\n\\f\\r \"'<>]++|"
        f"{_EDGE}{_LABEL}(?:\\.(?!https?://|ftp://){_LABEL})*+[A-Za-z0-9_]?)")
_IN_RUN = f"(?i)^([{_ALNUM}.-]*\\.{_TLD}){_EDGE}"
_IN_RUN_WWW = "(?i)(?:^|\\.)(www\\..+)$"
# Cheap test for the few texts that can hold a link at all.
MAYBE_LINK = f"(?i){_SCHEME}|\\.{_TLD}"


def find_links(s: Column) -> Column:
    """Link-like tokens: first spelling of each, in order, trailing punctuation cut."""
    def whole(m: Column) -> Column:
        name = F.regexp_extract(m, _IN_RUN, 1)
        return F.when(m.rlike(f"^(?i){_SCHEME}"), m).when(name != "", name).otherwise(F.regexp_extract(m, _IN_RUN_WWW, 1))

    found = F.filter(F.transform(F.regexp_extract_all(s, F.lit(LINK), 1), lambda m: F.rtrim(whole(m), F.lit(T.LINK_TRAILING))), lambda m: m != "")
    # Sorted by spelling, the first of equal ones stands before the others: no link is compared with all others.
    placed = lambda ms: F.array_sort(F.transform(ms, lambda m, i: F.struct(F.lower(m).alias("low"), i.alias("i"), m.alias("m"))))
    heads = lambda by: F.filter(by, lambda e, i: (i == 0) | (e["low"] != F.get(by, i - 1)["low"]))
    in_order = lambda es: F.transform(F.array_sort(F.transform(es, lambda e: F.struct(e["i"].alias("i"), e["m"].alias("m")))), lambda e: e["m"])
    firsts = let(F.when(s.rlike(MAYBE_LINK), found), lambda ms: let(placed(ms), lambda by: in_order(heads(by))))
    return F.coalesce(firsts, F.array().cast("array<string>"))


_AUTHORITY = (r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[A-Za-z0-9\-._~!$&'()*+,;=:%@]*@)?"
              "([A-Za-z0-9\\-._~!$&'()*+,;=\u0080-\U0010ffff]+)(?::[0-9]*)?([/?#][^\\x00-\\x1F\\x7F]*)?$")


def trusted_host(token: Column) -> Column:
    """The trusted site a link token belongs to, NULL for every other token.

    The host is taken from the authority part alone: user information, ports, paths, queries and
    look-alike names never count, and a site with a path rule counts only below that path."""
    url = F.when(token.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), token).otherwise(F.concat(F.lit("http://"), token))

    def judge(u):
        host = F.regexp_replace(F.lower(F.regexp_extract(u, _AUTHORITY, 1)), r"\.$", "")
        raw = F.regexp_extract(F.regexp_extract(u, _AUTHORITY, 2), r"^(/[^?#]*)", 1)
        path = F.when(raw.contains("%"), F.coalesce(F.try_url_decode(raw), F.lit(""))).otherwise(raw)
        return let(F.struct(host.alias("host"), path.alias("path")), site)

    def site(at):
        out = F.when(at["host"] == "", F.lit(None).cast("string"))
        for name in T.TRUSTED_SITES:
            member = (at["host"] == name) | at["host"].endswith("." + name)
            prefix = T.TRUSTED_PATHS.get(name)
            if prefix:
                out = out.when(member & ~at["path"].startswith(prefix), F.lit(None).cast("string"))
            out = out.when(member, F.lit(name))
        return out

    return let(url, judge)


# --- notes -----------------------------------------------------------------------------------
NOTE_TYPE = "struct<kind:string,root:string,host:string,links:array<string>>"


def _note(kind, root, host, links) -> Column:
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.struct(c(kind).cast("string").alias("kind"), c(root).cast("string").alias("root"),
                    c(host).cast("string").alias("host"), links.alias("links"))


def _outside_links(s: Column, label: Column) -> Column:
    """Links of a text that do not lead to a trusted site, labelled with where they are."""
    return F.transform(F.filter(find_links(strip_invisible(s)), lambda l: trusted_host(l).isNull()),
                       lambda l: F.concat(label, F.lit(": "), l))


def classify_text_note(s: Column) -> Column:
    """A note that is not markup: only trusted addresses, or free text with its links."""
    site = lambda w: F.when(w.rlike(r"^tt[0-9]{5,}\z"), F.lit(T.BARE_ID_SITE)).otherwise(trusted_host(w))
    empty = F.array().cast("array<string>")

    def judge(words):
        only = (F.size(words) > 0) & F.forall(words, lambda w: site(w).isNotNull())
        return F.when(only, _note("url", "", site(F.get(words, F.lit(0))), empty))

    def judge_links(found):
        sites = F.filter(F.transform(found, trusted_host), lambda h: h.isNotNull())
        foreign = F.transform(F.filter(found, lambda l: trusted_host(l).isNull()),
                              lambda l: F.concat(F.lit("text: "), l))
        return _note("text", "", F.coalesce(F.get(sites, F.lit(0)), F.lit("")), foreign)

    words = F.filter(F.split(strip_invisible(s), SPACES), lambda w: w != "")
    return F.coalesce(let(words, judge), let(find_links(strip_invisible(s)), judge_links))


_PROLOGUE = (r"^(?s)(?:[\t\n\x0B\f\r \u0085\u00a0]|<\?.*?\?>|<!--.*?-->|"
             r"<![A-Za-z][^\[>]*(?:\[[^\]]*\])?[^>]*>)*+")
_ROOT = _PROLOGUE + r"<(?:[\w.\-]+:)?(" + "|".join(T.NOTE_ROOTS) + r")(?=[\s/>])"
_TOKEN = (r"(?s)(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z][^\[>]*(?:\[[^\]]*\])?[^>]*>|"
          r"<[^>]*>|[^<]+|<)")
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _unescape(s: Column) -> Column:
    """Numeric and predefined character references as characters."""
    def char(ref):
        digits = F.regexp_extract(ref, r"^&#(?:x([0-9A-Fa-f]+)|([0-9]+));$", 1)
        code = F.when(digits != "", F.conv(digits, 16, 16)).otherwise(
            F.conv(F.regexp_extract(ref, r"^&#([0-9]+);$", 1), 10, 16))
        padded = F.lpad(code, 8, "0")
        legal = padded.rlike("^000(?:0(?!D[89A-F])|[1-9A-F](?=.{4}$))|^0010....$")
        return F.when(legal, F.decode(F.unhex(padded), "UTF-32")).otherwise(ref)

    refs = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});)"), 1))
    out = F.aggregate(refs, s, lambda acc, r: F.replace(acc, r, char(r)))
    for name, value in _NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.when(s.contains("&"), out).otherwise(s)


def _element_path(path: Column) -> Column:
    p = F.array_join(path, "/")
    return F.when(F.length(p) > 120, F.concat(F.lit("..."), F.right(p, F.lit(120)))).otherwise(p)


_BROKEN = -1  # of a note that closes what it never opened


def classify_markup_note(s: Column) -> Column:
    """A note that is a document with a known root: links in allow-listed elements are expected,
    all others are reported with their element; NULL when the root is unknown, never closes, or a tag
    closes what is not open."""
    root = F.regexp_extract(s, _ROOT, 1)
    tokens = F.regexp_extract_all(s, F.lit(_TOKEN), 1)
    empty = F.array().cast("array<string>")
    allowed = string_list(T.NOTE_ALLOWED_ELEMENTS)
    start = F.struct(empty.alias("path"), F.lit(0).alias("quiet"), F.lit(False).alias("closed"),
                     empty.alias("links"), F.lit("").alias("rest"))

    def state(path, quiet, closed, links, rest):
        return F.struct(path.alias("path"), quiet.alias("quiet"), closed.alias("closed"),
                        links.alias("links"), rest.alias("rest"))

    def report(acc, path, quiet, value):
        found = _outside_links(value, _element_path(path))
        return F.when(quiet > 0, acc["links"]).otherwise(F.concat(acc["links"], found))

    def step(acc, t):
        name = F.regexp_extract(t, r"^</?(?:[\w.\-]+:)?([\w.\-]+)", 1)
        opens, ends = t.rlike(r"^<[^!?/]") & (name != ""), t.startswith("</")
        selfclosed = t.rlike(r"/>$")
        inside = F.size(acc["path"]) > 0
        deeper = F.array_append(acc["path"], name)
        hush = acc["quiet"] + F.when(F.array_contains(allowed, name), 1).otherwise(0)
        # a closing tag closes everything inside the innermost element of its name
        above = F.size(acc["path"]) - F.array_position(F.reverse(acc["path"]), name).cast("int")
        up = F.slice(acc["path"], F.lit(1), above)
        less = F.size(F.filter(up, lambda n: F.array_contains(allowed, n)))
        known = F.array_contains(acc["path"], name)
        attributes = _unescape(F.concat_ws(" ", F.transform(
            F.regexp_extract_all(t, F.lit(r"=\s*(?:\"([^\"]*)\"|'[^']*')"), 0),
            lambda a: F.regexp_replace(a, r"^=\s*[\"']|[\"']$", ""))))
        cdata = t.startswith("<![CDATA[")
        words = F.when(cdata, F.regexp_extract(t, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)).otherwise(_unescape(t))
        is_text = cdata | ~t.startswith("<")
        return (F.when(acc["quiet"] == _BROKEN, acc)
                 .when(acc["closed"], state(acc["path"], acc["quiet"], acc["closed"], acc["links"],
                                            F.concat(acc["rest"], t)))
                 .when(opens & selfclosed,
                       state(acc["path"], acc["quiet"], ~inside, report(acc, deeper, hush, attributes), acc["rest"]))
                 .when(opens, state(deeper, hush, acc["closed"], report(acc, deeper, hush, attributes), acc["rest"]))
                 .when(ends & inside & known, state(up, less, above == 0, acc["links"], acc["rest"]))
                 .when(ends & inside, state(acc["path"], F.lit(_BROKEN), acc["closed"], acc["links"], acc["rest"]))
                 .when(is_text & inside,
                       state(acc["path"], acc["quiet"], acc["closed"], report(acc, acc["path"], acc["quiet"], words),
                             acc["rest"]))
                 .otherwise(acc))

    def finish(acc):
        words = F.filter(F.split(strip_invisible(acc["rest"]), SPACES), lambda w: w != "")
        one = F.when(F.size(words) == 1, trusted_host(F.get(words, F.lit(0))))
        trailing = F.concat(acc["links"], _outside_links(acc["rest"], F.lit("trailing text")))
        return F.when(~acc["closed"], F.lit(None).cast(NOTE_TYPE)).otherwise(
            F.when(one.isNotNull(), _note("mixed", root, one, acc["links"]))
             .otherwise(_note("xml", root, "", trailing)))

    return F.when(root != "", F.aggregate(tokens, start, step, finish))


def classify_note(s: Column) -> Column:
    """kind (xml, mixed, url, text), root element, trusted host and foreign links of a note."""
    return let(s, lambda t: F.coalesce(classify_markup_note(t), classify_text_note(t)))
