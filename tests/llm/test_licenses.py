import random
import re

from portcullis.llm import licenses as L


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def as_regex(template):
    """The same template as a regular expression over words that each end with a blank."""
    out, at = "", 0
    for m in L._MARKUP.finditer(template):
        out += "".join(re.escape(w) + " " for w in words(template[at:m.start()]))
        out += {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or f"(?:[^ ]+ ){{0,{m[2]}}}"
        at = m.end()
    return re.compile(out + "".join(re.escape(w) + " " for w in words(template[at:])))


def some_text(rng, template):
    """A text of the template, optional regions taken or not, replaceable ones filled."""
    t = re.sub(r"<<var;most=(\d+)>>", lambda m: " ".join(["x"] * rng.randint(0, int(m[1]))), template)
    while "<<begin" in t:
        t = re.sub(r"<<beginOptional>>((?:(?!<<begin).)*?)<<endOptional>>", lambda m: m[1] if rng.random() < 0.5 else " ", t, count=1, flags=re.S)
    return t


def test_templates_accept_exactly_their_wording():
    rng, s = random.Random(3), L.Scanner()
    for label, worth, template in L.TEMPLATES:
        for _ in range(10):
            ws = [w.encode() for w in words("pre amble " + some_text(rng, template) + " and more")]
            assert (label, worth) in {m[:2] for m in s.matches(ws, set(ws))}, template
        a, form = L.compile_template(label, worth, template), as_regex(template)
        for _ in range(60):
            ws = words(some_text(rng, template))
            i = rng.randrange(len(ws))
            ws[i:i + 1] = rng.choice([[], ["zzz"], [ws[i], ws[i]], [ws[i]]])
            m = form.match("".join(w + " " for w in ws))
            assert a.longest([w.encode() for w in ws], 0) == (m.group().count(" ") if m else -1)


def test_phrases_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["under the MIT License", "Apache License, Version 2", "CC-BY-NC", "under", "the", "mit", "cc", "by", "nc", "é", "é中", "1", "\n", "--", "\x7f", "version 2"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "cc by nc " * 20000, "Licensed under CC BY-NC 4.0."] * 2
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int").toDF("doc_id", "text", "doc_id")
    for r in L.scan(docs).toDF("i", "t", "n", "n_words", "found", "score").collect():
        ws = words(r.t)
        want = sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split())
        assert r.n_words == len(ws)
        assert sorted((f.start, f.label) for f in r.found if f.kind == "phrase") == want
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.found)


def test_an_opening_is_worth_less_than_a_licence():
    s = L.Scanner()

    def worths(t):
        ws = [w.encode() for w in words(t)]
        return {m[:2] for m in s.matches(ws, set(ws))}
    fill = lambda t: re.sub("<<begin.*?<<endOptional>>", "", t.replace("\n", " ").replace("<<var;most=12>>", "the authors").replace("<<var;most=8>>", "the author"))
    whole = {label: fill(t) for label, worth, t in L.TEMPLATES if worth == 1.0}
    for label, opening in (("mit", "mit"), ("isc", "isc"), ("bsd-2", "bsd"), ("bsd-3", "bsd"), ("unlicense", "unlicense")):
        text = whole[label]
        assert (label, 1.0) in worths(text) and (opening, 0.6) in worths(text)
        for lost in (text[:text.upper().index("IN NO EVENT")], re.sub("(?i)be liable", "be held liable", text), re.sub("(?i)as is", "as it is", text)):
            assert worths(lost) == {(opening, 0.6)}, (label, lost)
    assert worths(whole["0bsd"]) == {("0bsd", 1.0)}


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
