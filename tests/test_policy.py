"""Vectors of the decision engine, routes and struct differences."""
import pytest
from pyspark.sql import functions as F

from portcullis.operators import intake, policy, routing
from portcullis.operators import metadata as M
from portcullis.operators import verify as V
from portcullis.operators.profiles import Profile, Settings
from portcullis.sources.items import as_attachments, as_parts

# idx, type, lang, title, is_default, forced, hearing_imp: a film in Portuguese with four dubs
SAMPLE = [
    (10, "video", "", "", False, False, False), (11, "audio", "por", "", False, False, False), (12, "audio", "dan", "", True, False, False),
    (13, "audio", "", "", False, False, False), (14, "audio", "dan", "Producers' commentary", False, False, False), (15, "audio", "eng", "", False, False, False),
    (20, "subtitle", "dan", "", False, False, False), (21, "subtitle", "dan", "", False, False, True), (22, "subtitle", "eng", "signs", False, True, False),
    (23, "subtitle", "fin", "", False, False, False), (30, "video", "", "", False, False, False)]


def parts_of(spark, rows=SAMPLE, item="a"):
    df = spark.createDataFrame(rows, "idx long, type string, lang string, title string, is_default boolean, forced boolean, hearing_imp boolean")
    return as_parts(df, item_id=F.lit(item), text_sub=F.col("type") == "subtitle", **{c: c for c in df.columns})


def kept(rows, kind):
    return sorted(r.idx for r in rows if r.type == kind and r.keep)


def decide(spark, profile, rows=SAMPLE, original=""):
    return policy.decide(parts_of(spark, rows), Settings.of(profile), original=F.lit(original)).collect()


def test_built_in_profiles(spark):
    home = decide(spark, Profile.load("homelab"))
    assert kept(home, "audio") == [11, 12, 13, 14, 15] and kept(home, "subtitle") == [20, 21, 22, 23] and kept(home, "video") == [10]
    assert [r.idx for r in home if r.type == "audio" and r.out_default] == [12]
    archive = decide(spark, Profile.load("archive"))
    assert kept(archive, "audio") == [15] and kept(archive, "subtitle") == [22] and all(r.clear_title for r in archive)
    for hint, at in (("pt", 11), ("Portuguese", 12), ("en_GB", 15), ("fin", 12)):
        rows = decide(spark, Profile.load("homelab"), original=hint)
        assert [r.idx for r in rows if r.type == "audio" and r.out_default] == [at], hint


def test_fallback_and_overrides(spark):
    only = [r for r in SAMPLE if r[0] in (10, 11, 12)]
    rows = policy.decide(parts_of(spark, only), Settings.of(Profile.load("archive")))
    assert kept(rows.collect(), "audio") == [11, 12]
    assert "AUDIO_FALLBACK" in {r.code for r in policy.decision_findings(rows).collect()}
    assumed = [r for r in decide(spark, Profile.build("x", {"languages.keep": ["fin"], "languages.und": "assume:fi"})) if r.idx == 13][0]
    assert assumed.keep and assumed.set_language == "fin"
    assert kept(decide(spark, Profile.build("y", {"subtitles.drop_sdh_duplicates": True})), "subtitle") == [20, 22, 23]


def test_part_numbers_above_int(spark):
    big = 3_000_000_000
    rows = [(r[0] + big, *r[1:]) for r in SAMPLE]
    found = policy.decision_findings(policy.decide(parts_of(spark, rows), Settings.of(Profile.load("homelab")))).collect()
    assert {(r.code, r.idx) for r in found} == {("VIDEO_EXTRA", big + 30), ("UND_TRACK", big + 13)} and all(r.seq >= big for r in found)


def test_default_is_unique_in_a_sweep(spark):
    from portcullis.operators.profiles import sweep
    profiles = [Profile.load(n) for n in ("homelab", "anime", "archive", "strict")]
    for flags in (lambda i: True, lambda i: False, lambda i: i == 14):
        rows = [(r[0], r[1], r[2], r[3], flags(r[0]), r[5], r[6]) for r in SAMPLE]
        out = policy.decide(sweep(parts_of(spark, rows), profiles), Settings.of_profiles(profiles), ["profile", "item_id"])
        counts = {r.profile: r.n for r in out.filter("type = 'audio' and keep").groupBy("profile").agg(
            F.sum(F.col("out_default").cast("int")).alias("n")).collect()}
        assert counts == {p.name: 1 for p in profiles}


def test_bad_profiles():
    for bad in ({"bogus.x": 1}, {"languages.keep": 1}, {"languages.keep": []}, {"verify.tier": "sometimes"}, {"languages.und": "maybe"}):
        with pytest.raises(ValueError):
            Profile.build("bad", bad)


def test_routes_follow_their_order(spark):
    """Each rule decides only where none before it does: all combinations against the rules written as a ladder."""
    import itertools

    def ladder(path, verdict, container, parsed, copies, warned, no_video, differs, mode, force):
        kind = {"mkv": "video", "mp4": "video", "ogg": "audio", "mks": "subtitle"}.get(path[2:])
        side = kind in ("audio", "subtitle")
        if kind is None or verdict >= 4 or (verdict >= 3 and not force) or not parsed or (not force and not side and no_video):
            return "skip"
        if verdict >= 3 and not side:
            return "remux"
        if copies > 1:
            return "skip" if side or mode not in ("break", "copy") else "remux"
        if side:
            return "clean"
        return "remux" if path[2:] != "mkv" or container not in ("matroska", "webm") or warned or differs else "clean"

    flags = (False, True)
    cases = list(itertools.product(("q.mkv", "q.mp4", "q.ogg", "q.mks", "q.md"), (0, 1, 3, 4), ("matroska", "avi"), flags, (1, 4), flags, flags, flags, ("skip", "copy", "else"), flags))
    names = "path string, verdict int, container string, parsed boolean, copies int, tool_warning boolean, no_video boolean, differs boolean, mode string, force boolean"
    df = spark.createDataFrame(cases, names)
    wrong = [r for r in df.withColumn("r", routing.route(*[F.col(c) for c in df.columns])).collect() if r.r.route != ladder(*r[:10])]
    assert wrong == []


def test_long_paths_keep_their_end(spark):
    deep = "/in/" + "d/" * 40_000
    df = spark.createDataFrame([(deep + "a.mp4", True), (deep + "b.mp4", True)], "path string, eligible boolean")
    out = routing.plan_destinations(df, "/in").collect()
    assert {r.code for r in out} == {"PLACED"} and {len(r.dest) for r in out} == {len("/in__remuxed/" + deep[4:] + "a.mkv")}


def test_attachment_of_any_size_is_sniffed(spark):
    df = spark.createDataFrame([(1, "x.ttf", "font/ttf", 70 << 20, bytearray(b"\x7fELF rest"))], "att_id long, file_name string, mime string, size long, payload binary")
    atts = as_attachments(df, item_id=F.lit("a"), **{c: c for c in df.columns})
    found = policy.attachment_findings(policy.decide_attachments(atts, parts_of(spark), Settings.of(Profile.load("homelab")))).collect()
    assert [(r.code, r.severity) for r in found] == [("ATTACH_EXEC", 4)]


def test_struct_diff(spark):
    def signal(**v):
        fields = M.NAMES + M.COORDINATES + M.LUMINANCE + M.LIGHT + M.CONFIG
        return tuple(v.get(n, "" if n in M.NAMES else None) for n in fields) + (v.get("malformed", []),)

    a = dict(primaries="p3", transfer="pq", matrix="ncl", range="tv", red_x=0.61, red_y=0.31, green_x=0.21, green_y=0.71, blue_x=0.11, blue_y=0.04, white_x=0.3,
             white_y=0.32, min_luminance=0.002, max_luminance=600.0, max_cll=610, max_fall=130)
    without = lambda *ns: {k: v for k, v in a.items() if k not in ns}
    cases = [(a, a, []), ({}, {}, []), (a, {**a, "blue_y": 0.04 * (1 + 1e-9)}, [])]
    cases += [(a, {**a, n: ""}, [f"{n} lost (was {a[n]})"]) for n in ("primaries", "transfer", "matrix", "range")]
    cases += [(a, {**a, n: "zz"}, [f"{n} changed from {a[n]} to zz"]) for n in ("primaries", "range")]
    cases += [(a, without(*M.COORDINATES, *M.LUMINANCE), ["mastering display metadata lost"]), (a, without("max_cll", "max_fall"), ["content light level lost"]),
              (a, {**a, "max_luminance": 700.0}, ["max_luminance changed from 600 to 700"]),
              (a, without("min_luminance", "max_luminance"), ["min_luminance lost (was 0.002)", "max_luminance lost (was 600)"]),
              (dict(malformed=["max_luminance"]), {}, ["max_luminance lost (was malformed)"]), (dict(malformed=["max_luminance"]), dict(malformed=["max_luminance"]), [])]
    df = spark.createDataFrame([(i, signal(**a), signal(**b)) for i, (a, b, _) in enumerate(cases)], f"i int, a {M.SIGNAL_TYPE}, b {M.SIGNAL_TYPE}")
    got = df.select("i", V.struct_diff(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [c[2] for c in cases]


def test_side_data(spark):
    light = '{"side_data_type":"Content light level metadata","max_content":%s,"max_average":%s}'
    raw = ["[" + light % (250, '"90"') + "]", '[7,{"side_data_type":[]}]', "null", "{", None, "[" + light % (99999, "null") + "]",
           '[{"side_data_type":"Mastering display metadata","blue_y":"0.1","max_luminance":"nan"}]']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, s string")
    names = {n: F.lit("") for n in M.NAMES}
    g = df.select("i", M.extract_groups(names, F.col("s")).alias("g")).orderBy("i").collect()
    assert (g[0].g.max_cll, g[0].g.max_fall, g[0].g.malformed) == (250, 90, [])
    assert all(g[i].g.malformed == [] and g[i].g.max_cll is None for i in (1, 2, 3, 4))
    assert g[5].g.malformed == ["max_cll", "max_fall"] and g[5].g.max_cll is None
    assert "max_luminance" in g[6].g.malformed and g[6].g.max_luminance is None


def test_caller_codes(spark):
    from portcullis.functions import tables as T
    rows, want = [], []
    for a, (ok, bad, skipped, usage, stopped) in T.EXIT_CODES.items():
        for fail_on, v in ((1, 0), (1, 1), (3, 1), (3, 3), (4, 3), (4, 4), (5, 4)):
            for outcome, code in (("ran", bad if v == 4 or v >= fail_on else ok), ("skipped", skipped), ("usage", usage), ("interrupted", stopped)):
                rows.append((len(rows), a, v, fail_on, outcome))
                want.append(code)
    df = spark.createDataFrame(rows, "i int, a string, v int, f int, o string")
    got = df.select("i", intake.caller_code(F.col("a"), F.col("v"), F.col("f"), F.col("o")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == want


def test_first_entry_wins(spark):
    df = spark.createDataFrame([(["A=1", "A=2", "B=x=y", "=z", "C="],)], "e array<string>")
    assert df.select(intake.first_wins(F.col("e")).alias("m")).first().m == {"A": "1", "B": "x=y", "C": ""}


def test_globs():
    import re
    for glob, name, hit in (("tv*", "TV-HD", True), ("tv*", "tv/hd", False), ("m?vies", "movies", True), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), ("a\\*", "a*", True)):
        assert bool(re.match(intake.glob_pattern(glob).replace("\\z", "\\Z"), name.lower())) is hit
    for bad in ("[", "[]", "a\\", "[a-"):
        with pytest.raises(ValueError):
            intake.glob_pattern(bad)


def test_windows_and_aggregates_decide_alike(spark):
    """Items whose numbers are bounded are decided on one shuffle and one read; others as before."""
    from pyspark.sql import functions as F
    from portcullis.operators import policy as D
    from portcullis.operators.profiles import Profile, Settings
    from portcullis.sources.items import as_parts
    i = F.col("id")
    raw = spark.range(600).select((i % 60).alias("item"), F.floor(i / 60).alias("n"), "id")
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    parts = as_parts(raw, item_id="item", idx="n", type=pick(["video", "audio", "audio", "subtitle", "subtitle"], i * 7 % 11), codec=F.lit("c"),
                     lang=pick(["de", "", "eng", "en-US", "PT_br", "xx"], i * 5 % 13), ietf=pick(["", "pt-BR", ""], i), title=F.lit(""),
                     is_default=i % 3 == 0, forced=i % 4 == 0, hearing_imp=i % 2 == 0, commentary=i % 9 == 0)
    p = Settings.of(Profile.build("first", {"languages.keep": ["ger", "por"], "languages.und": "drop", "audio.keep_first": True,
                                            "audio.drop_commentary": True, "subtitles.drop_sdh_duplicates": True}))
    columns = ["item_id", "idx", "keep", "reason", "out_default", "out_forced", "set_language", "has_video", "audio_fallback", "first_part"]
    near = D.decide(parts, p).select(*columns)
    far = D.decide(parts.withColumn("idx", F.col("idx") + 100000), p).withColumn("idx", F.col("idx") - 100000).withColumn(
        "first_part", F.col("first_part") - 100000).select(*columns)
    assert sorted(near.collect()) == sorted(far.collect())
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 600") == 1 and "Join" not in plan


def test_language_codes_of_every_spelling(values):
    from portcullis.functions.columns import LANGUAGE_ALIASES, canonical_lang, canonical_lang_py
    given = [*LANGUAGE_ALIASES, *[f" {a.upper()}-x" for a in LANGUAGE_ALIASES], "", " ", "-", "_en", "-en", "xx", "x_y-z", "en_", "\u00e4b", "\ten\n", "En", "zz9"]
    assert values(given, "string", canonical_lang) == [canonical_lang_py(g) for g in given]
    assert values([None], "string", canonical_lang) == ["und"]
