"""Vectors of the column functions."""
from pyspark.sql import functions as F

from portcullis.functions import columns as C
from portcullis.functions import content as K
from portcullis.functions import tables as T
from portcullis.functions import text as X
from portcullis.functions import typed as N


def test_sniff(values):
    """Signatures at their places, each in a body of our own."""
    packet = b"\x47" + bytes(187)
    cases = {
        bytes.fromhex("1A45DFA3") + b"\x93\x42\x82\x88matroska tail": "matroska", bytes.fromhex("1A45DFA3") + b"\x42\x82\x84webm": "webm",
        b"\0\0\0\x20ftypisom" + bytes(20): "mp4", b"RIFF\x10\0\0\0AVI " + bytes(9): "avi", b"RIFF\x10\0\0\0WEBP" + bytes(9): "image",
        b"MZ" + bytes(30): "executable", b"\x7fELF" + bytes(12): "executable", b"PK\x03\x04 zipped": "archive", b"\x1f\x8b\x08\0": "archive",
        b"%PDF-2.0\n": "pdf", b"#!/usr/bin/env awk\n": "script", b"\n #!/usr/bin/env awk\n": "text", b"": "empty", packet * 5: "mpegts",
        (b"\1\2\3\4" + packet) * 5: "mpegts", b"<!doctype HTML>\n<p>": "html", b"a line\n<script>go()</script>": "html", b"<i>one word</i> in a line": "text",
        b"\xef\xbb\xbf<HTML lang=x>": "html", "grüße aus köln\n".encode(): "text", b"zero\0inside": "unknown", b"\x9c\x9d\x9e\x9f" * 4: "unknown",
        b"\xff\xfeA\0": "mp3", b"BM" + bytes(40): "image", b"P": "text", b"%PD": "text"}
    got = values([bytearray(b) for b in cases], "binary", lambda v: K.sniff(v)["kind"])
    assert dict(zip(cases, got)) == cases


def test_sniff_window_may_cut_a_character(values):
    for k in range(1, 5):
        body = b"z" * (8192 - k) + "\U0001f30d".encode() * 3
        assert values([bytearray(body)], "binary", lambda v: K.sniff(v)["kind"]) == ["text"]


def test_payload_windows(values):
    big = b"x" * (3 << 20)
    given = [b"PK\x03\x04" + big, big + b"PK\x03\x04", b"..Rar!\x1a\x07", b"This program cannot be run in DOS mode" + big, big + b"This program cannot be run in DOS mode"]
    got = values([bytearray(b) for b in given], "binary", lambda v: K.appended_payload(v).isNotNull())
    assert got == [False, True, True, True, False]


def test_links(values):
    given = ["See HTTP://Alpha.example/p?q=2, or www.beta.to. Also Gamma.ORG and gamma.org; v2.10 and 3.14 are numbers.",
             "no address here: one.two three.4five", "naïveab.net", "x.org X.ORG y.org", " ".join(f"n{i}.info" for i in range(57)),
             "left.com.right", "a.com_b", "a.com-b.c", "q.http://r.net/s", "(https://t.example/u)", "end.com"]
    got = values(given, "string", X.find_links)
    assert got[0] == ["HTTP://Alpha.example/p?q=2", "www.beta.to", "Gamma.ORG"]
    assert got[1] == [] and got[2] == ["veab.net"] and got[3] == ["x.org", "y.org"] and len(got[4]) == 57
    assert got[5:] == [["left.com"], [], ["a.com"], ["http://r.net/s"], ["https://t.example/u"], ["end.com"]]


def test_links_in_hostile_names(values):
    many = ".".join(["ab"] * 350_000)
    got = values([many, many + ".com", many + " z.net", "a-" * 400_000, "." * 500_000 + "q.org"], "string", lambda v: F.transform(X.find_links(v), F.length))
    assert got == [[], [len(many) + 4], [5], [], [5]]


def test_trusted_host(values):
    """Every trusted site in each honest form, and forms that only look like one."""
    for site in T.TRUSTED_SITES:
        path = T.TRUSTED_PATHS.get(site, "/any/")
        yes = [f"{scheme}{sub}{site}{port}{path}7" for scheme in ("", "http://", "HTTPS://", "https://me:pw@") for sub in ("", "www.", "a.b.")
               for port in ("", ":8443")] + [f"https://{site.upper()}.{path}7"]
        yes = [u for u in yes if "@" not in u or "://" in u]
        assert values(yes, "string", X.trusted_host) == [site] * len(yes)
        no = [f"https://{site}.bad.example{path}", f"https://bad.example/{site}{path}", f"https://bad.example/?u={site}", f"https://bad.example#{site}",
              f"https://{site}@bad.example/", f"https://x{site}{path}", f"https://{site}x{path}", f"https://bad.example\\@{site}/", f"http://[::2]/{site}",
              "https://" + site.replace("m", "\u043c", 1).replace("v", "\u03bd", 1) + path, "https://" + site[:3] + "\u200b" + site[3:] + path]
        assert values(no, "string", X.trusted_host) == [None] * len(no)
    assert values(["", "http://", "tt123", "https://imdb.com/", "https://imdb.com/chart/"], "string", X.trusted_host) == [None] * 5


SITE = T.TRUSTED_SITES[0]
NOTES = [
    (f"https://{SITE}/9\n", "url", "", SITE, []), ("tt7654321", "url", "", T.BARE_ID_SITE, []), ("", "text", "", "", []),
    (f"we took it from {SITE}/9 last week", "text", "", SITE, []), ("greetings from www.some-shop.to", "text", "", "", ["text: www.some-shop.to"]),
    ("<movie><note>http://a.example.com/1</note></movie>", "xml", "movie", "", ["movie/note: http://a.example.com/1"]),
    ("<?xml version='1.0'?><!-- http://a.example.com --><album><year>1999</year></album>", "xml", "album", "", []),
    ("<movie><title>never closed", "text", "", "", []), ("<page>http://a.example.com/2</page>", "text", "", "", ["text: http://a.example.com/2"]),
    (f"<artist><name>N</name></artist>\nhttps://{SITE}/person/3", "mixed", "artist", SITE, []),
    ("<artist><name>N</name></artist> and www.some-shop.to", "xml", "artist", "", ["trailing text: www.some-shop.to"]),
    ("<movie><note by='http://a.example.com/3'>x</note></movie>", "xml", "movie", "", ["movie/note: http://a.example.com/3"]),
    ("<movie><thumb big='http://a.example.com/b'>http://a.example.com/s</thumb></movie>", "xml", "movie", "", []),
    ("<movie><fanart><size>http://a.example.com/f</size></fanart></movie>", "xml", "movie", "", []),
    ("<movie><a><b>http://a.example.com/deep</b></a></movie>", "xml", "movie", "", ["movie/a/b: http://a.example.com/deep"]),
    ("<movie><note><![CDATA[<b> http://a.example.com/4]]></note></movie>", "xml", "movie", "", ["movie/note: http://a.example.com/4"]),
    ("<movie><note>htt&#112;&#x3a;//a.example.com/5</note></movie>", "xml", "movie", "", ["movie/note: http://a.example.com/5"]),
    ("<movie><note>http://a.exa\u200bmple.com/6</note></movie>", "xml", "movie", "", ["movie/note: http://a.example.com/6"]),
    ("<movie><thumb>http://a.example.com/t</movie>", "xml", "movie", "", []), ("<movie><a><b>x</a><c>http://a.example.com/7</c></movie>", "xml", "movie", "", ["movie/c: http://a.example.com/7"]),
    ("<movie></year></movie>", "text", "", "", []),
    ("<m:movie xmlns:m='urn:x'><m:note>fine</m:note></m:movie>", "xml", "movie", "", []),
    ("<movie>" + "".join(f"<n>http://h{i}.example.com</n>" for i in range(45)) + "</movie>", "xml", "movie", "", [f"movie/n: http://h{i}.example.com" for i in range(45)]),
]


def test_notes(values):
    got = values([n[0] for n in NOTES], "string", X.classify_note)
    for note, row in zip(NOTES, got):
        assert (row.kind, row.root, row.host, row.links) == note[1:], note[0]


def test_text(values):
    word = "Ünïcode \U0001f680"
    raw = [b"\xef\xbb\xbf" + word.encode(), b"\xff\xfe" + word.encode("utf-16le"), b"\xfe\xff" + word.encode("utf-16be"), b"x\xc3\xa4y"]
    assert values([bytearray(b) for b in raw], "binary", X.decode_text) == [word, word, word, "xäy"]
    marks = {"\u202a": "bidi control U+202A", "\u2069": "bidi control U+2069", "\u200d": "zero-width character U+200D"}
    assert values([f"na{m}me.txt" for m in marks], "string", X.first_invisible) == list(marks.values())
    assert values(["name.txt"], "string", X.first_invisible) == [None]
    assert values(["tab\tnew\nbell\x07", "ok"], "string", X.sanitize) == ["tab\tnew\\x0abell\\x07", "ok"]
    shown = values([bytearray(b"y" * 700), bytearray(b"p\x08q\n\xfe")], "binary", X.printable)
    assert shown == ["y" * 512 + "…", "pq\n?"]


def test_languages(values):
    """Every spelling of the table, with a region or script behind it, in any case, with blanks around."""
    given = {code: group[0] for group in T.LANGUAGE_GROUPS for code in group}
    spelled = {f" {c.upper()}-Abc": canon for c, canon in given.items()} | {f"{c}_12": canon for c, canon in given.items()}
    assert values(list(spelled), "string", C.canonical_lang) == list(spelled.values())
    assert [C.canonical_lang_py(c) for c in spelled] == list(spelled.values())
    odd = {"": "und", "qq": "qq", "-de": "-de", "_": "_", "deutsch": "deutsch"}
    assert values(list(odd), "string", C.canonical_lang) == list(odd.values()) == [C.canonical_lang_py(c) for c in odd]
    assert values(["", "und", "unknown", "de"], "string", C.is_und) == [True, True, True, False]


def test_names(values):
    assert values(["a.b.C", "x", "/p.q/name", ".hid"], "string", C.ext) == ["c", "", "", "hid"]
    assert values(["movie.mkv.exe", "a.b", "A.EXE.mkv"], "string", C.second_ext) == ["mkv", None, "exe"]


def test_typed(values):
    given = {"3/4": 0.75, "9/0": None, "nan": None, "1e999": None, "  12 ": 12.0, "0b1": None, "2_0": None, "6.": 6.0, ".25": 0.25, "8/4/2": None, "-3": None,
             "": None, "infinity": None, "9" * 70: None, "1001": None}
    assert values(list(given), "string", lambda v: N.parse_bounded(v, 0, 1000)) == list(given.values())
    assert values(["PQ12", "unknown", "p q", "e" * 33, None], "string", N.parse_enum) == ["pq12", "", None, None, ""]
    close = [(x, x * (1 + e), abs(e) < 1e-6) for x in (0.25, 1.0, 640.0) for e in (0.0, 1e-9, 1e-2, -1e-2)]
    assert values([(a, b) for a, b, _ in close], "struct<a:double,b:double>", lambda v: N.close_enough(v["a"], v["b"])) == [c for _, _, c in close]
    numbers = [0.5, 250.0, 0.00025, 2.5e8, 3e-9, 0.0, -7.25]
    assert values(numbers, "double", N.shown) == ["%g" % v for v in numbers]
    assert [float(v) for v in values(numbers, "double", N.exact)] == numbers
