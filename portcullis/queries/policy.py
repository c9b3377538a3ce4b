"""Queries of profiles and the decision engine."""
from __future__ import annotations

import json

from pyspark.sql import functions as F


from portcullis.functions.columns import canonical_lang_py
from portcullis.functions.profiles import ENUM_VALUES, HOMELAB
from portcullis.operators import policy as D
from portcullis.operators import profiles as PR
from portcullis.operators.profiles import Profile, Settings
from portcullis.queries.base import (ATTACHMENTS_SQL, DOCUMENT_PARTS_SQL, ORDER_PARTS_SQL, document_attachments,
                                     document_parts, order_parts, query, sql_list, sql_str, table)
from portcullis.queries.metadata import ALIAS_SQL

# One profile per rule under test, next to the built-in ones.
PROFILES = {n: Profile.load(n) for n in ("homelab", "anime", "archive", "strict")}
RULES = Profile.build("rules", {
    "languages.keep": ["en"], "languages.und": "assume:de", "languages.prefer_original": True,
    "audio.drop_commentary": True, "subtitles.keep_forced": True, "subtitles.drop_sdh_duplicates": True})
FIRST = Profile.build("first", {"languages.keep": ["ger", "por"], "languages.und": "drop", "audio.keep_first": True,
                                "audio.drop_commentary": True, "subtitles.drop_sdh_duplicates": True})


def canon_sql(c: str) -> str:
    short = f"regexp_extract(lower(trim({c})), '^(.[^_-]*)', 1)"
    return f"CASE WHEN trim({c}) = '' THEN 'und' ELSE coalesce((SELECT canon FROM alias al WHERE al.code = {short}), {short}) END"


def decide_sql(p: Profile, original: str = "", parts: str = "parts", key: str = "item_id") -> str:
    """CTEs ending in ``decided``: the same rules, written as windows over each item."""
    b = lambda k: "true" if p[k] else "false"
    d = p.derived()
    codes, keep_all = sql_list(d["languages.keep_codes"]), "true" if d["languages.keep_all"] else "false"
    und, assumed = p["languages.und"], d["languages.assume"]
    matches = f"({keep_all} OR lc IN {codes} OR (ietf <> '' AND ic IN {codes}))"
    guess = "true" if d["languages.keep_all"] or assumed in d["languages.keep_codes"] else "false"
    if und == "drop":
        w = ("false", "'untagged language (und = drop)'", "''")
    elif und.startswith("assume:"):
        w = (guess, f"'untagged language assumed {assumed}'" if guess == "true" else f"'untagged language assumed {assumed}, not kept'",
             f"'{assumed}'" if guess == "true" else "''")
    else:
        w = ("true", "'untagged language kept'", "''")
    orig = canonical_lang_py(original) if original and p["languages.prefer_original"] else ""
    return f"""lang AS (SELECT *, {canon_sql('lang')} AS lc, {canon_sql('ietf')} AS ic FROM {parts}),
 want AS (SELECT *, lc IN ('und', 'unknown') AND ic IN ('und', 'unknown') AS und FROM lang),
 w2 AS (SELECT *, CASE WHEN und THEN {w[0]} ELSE {matches} END AS wk, CASE WHEN und THEN {w[1]} WHEN {matches} THEN 'language ' || lc ELSE 'language ' || lc || ' not in keep list' END AS wr,
   CASE WHEN und AND type IN ('audio', 'subtitle') THEN {w[2]} ELSE '' END AS set_language, {b('audio.drop_commentary')} AND (commentary OR regexp_matches(title, '(?i)\\bcommentar(?:y|ies)\\b')) AS talk FROM want),
 w3 AS (SELECT *, type = 'subtitle' AND NOT wk AND {b('subtitles.keep_forced')} AND forced AS rescue FROM w2),
 w4 AS (SELECT *, (wk OR rescue) AND NOT talk AS k0, {canon_sql("CASE WHEN set_language <> '' THEN set_language ELSE lang END")} AS spoken FROM w3),
 vid AS (SELECT *, min(idx) FILTER (type = 'video' AND NOT attached_pic) OVER (PARTITION BY {key}) AS fv, bool_or(type = 'audio') OVER (PARTITION BY {key}) AND NOT coalesce(bool_or(k0) FILTER (type = 'audio') OVER (PARTITION BY {key}), false) AS audio_fallback FROM w4),
 fb AS (SELECT *, CASE WHEN type = 'audio' THEN k0 OR audio_fallback WHEN type = 'subtitle' THEN k0 ELSE coalesce(idx = fv, false) END AS k1 FROM vid),
 kf AS (SELECT *, type = 'audio' AND k1 AND {b('audio.keep_first')} AND row_number() OVER (PARTITION BY {key}, type = 'audio' AND k1 ORDER BY idx) > 1 AS later FROM fb),
 k2 AS (SELECT *, k1 AND NOT later AS kk FROM kf),
 df AS (SELECT *, row_number() OVER (PARTITION BY {key}, type = 'audio' AND kk ORDER BY CASE WHEN '{orig}' <> '' AND spoken = '{orig}' THEN 0 WHEN is_default THEN 1 ELSE 2 END, idx) AS dr FROM k2),
 sd AS (SELECT *, {b('subtitles.drop_sdh_duplicates')} AND type = 'subtitle' AND kk AND hearing_imp AND coalesce(bool_or(kk AND NOT hearing_imp) FILTER (type = 'subtitle') OVER (PARTITION BY {key}, lc), false) AS sdh FROM df),
 decided AS (SELECT *, kk AND NOT sdh AS keep,
   CASE WHEN type = 'video' AND attached_pic THEN 'cover art stream' WHEN type = 'video' AND idx = fv THEN 'primary video' WHEN type = 'video' THEN 'secondary video stream' WHEN later THEN 'keep_first'
     WHEN type = 'audio' AND audio_fallback THEN 'kept: policy would have removed every audio track' WHEN sdh THEN 'SDH duplicate' WHEN (wk OR rescue) AND talk THEN 'commentary' WHEN rescue THEN 'forced subtitle' ELSE wr END AS reason,
   CASE WHEN type = 'video' THEN coalesce(idx = fv, false) WHEN type = 'audio' THEN kk AND dr = 1 ELSE is_default END AS out_default, CASE WHEN type = 'video' THEN false ELSE forced END AS out_forced,
   fv IS NOT NULL AS has_video, min(idx) OVER (PARTITION BY {key}) AS first_part FROM sd)"""


_OUT = ["item_id", "idx", "keep", "reason", "out_default", "out_forced", "set_language"]


def _decided(parts, profile, original=""):
    return D.decide(parts, Settings.of(profile), original=F.lit(original))


# --- profiles ---------------------------------------------------------------------------------------
# Tenants are the customers; each states a few settings, some of them unknown or illegal.
_STATED = [("languages.und", '"drop"'), ("verify.tier", '"sometimes"'), ("languages.keep", "[]"), ("bogus.key", "1"), ("audio.keep_first", "true")]
_TENANTS_SQL = "overlay(profile, key, value) AS (" + " UNION ALL ".join(
    f"SELECT 'tenant-' || c_custkey, {sql_str(k)}, {sql_str(v)} FROM customer WHERE c_custkey % {len(_STATED)} = {i}" for i, (k, v) in enumerate(_STATED)) + ")"
_BASE_SQL = "base(key, value) AS (VALUES " + ", ".join(f"({sql_str(k)}, {sql_str(json.dumps(v))})" for k, v in HOMELAB.items()) + ")"
_RESOLVED = """resolved AS (SELECT p.profile, b.key, coalesce(o.value, b.value) AS value, o.value IS NOT NULL AS stated
  FROM (SELECT DISTINCT profile FROM overlay) p CROSS JOIN base b LEFT JOIN overlay o ON o.profile = p.profile AND o.key = b.key)"""


def _tenants(spark, sf):
    c = F.col("c_custkey")
    key, value = F.lit(""), F.lit("")
    for i, (k, v) in enumerate(_STATED):
        key, value = F.when(c % len(_STATED) == i, k).otherwise(key), F.when(c % len(_STATED) == i, v).otherwise(value)
    return table(spark, sf, "customer").select(F.concat(F.lit("tenant-"), c.cast("string")).alias("profile"), key.alias("key"), value.alias("value"))


@query("p01_resolve_profiles", f"WITH {_TENANTS_SQL}, {_BASE_SQL}, {_RESOLVED} SELECT * FROM resolved")
def _(spark, sf):
    return PR.resolve_profiles(PR.builtin_rows(spark), _tenants(spark, sf))


@query("p01_unknown_keys", f"WITH {_TENANTS_SQL}, {_BASE_SQL} SELECT profile, key FROM overlay WHERE key NOT IN (SELECT key FROM base)")
def _(spark, sf):
    return PR.unknown_keys(PR.builtin_rows(spark), _tenants(spark, sf))


_ENUM_SQL = " OR ".join(f"(key = '{k}' AND trim(value, '\"') NOT IN {sql_list(v)})" for k, v in ENUM_VALUES.items())


@query("p02_validate_profiles", f"""WITH {_TENANTS_SQL}, {_BASE_SQL}, {_RESOLVED} SELECT profile, key, value FROM resolved
 WHERE {_ENUM_SQL} OR (key = 'languages.keep' AND value = '[]') OR (key = 'languages.und' AND trim(value, '"') NOT IN ('keep', 'drop') AND value NOT LIKE '"assume:%')""")
def _(spark, sf):
    return PR.validate_profiles(PR.resolve_profiles(PR.builtin_rows(spark), _tenants(spark, sf)))


# --- rules -------------------------------------------------------------------------------------------
def _rule(name, columns, sql_columns, profile, where="", parts_sql=ORDER_PARTS_SQL, parts=order_parts, original=""):
    @query(name, f"WITH {ALIAS_SQL}, {parts_sql}, {decide_sql(profile, original)} SELECT item_id, idx, {sql_columns} FROM decided {('WHERE ' + where) if where else ''}")
    def _(spark, sf):
        out = _decided(parts(spark, sf), profile, original)
        return (out.filter(where) if where else out).select("item_id", "idx", *columns)


@query("p03_language_matches", f"""WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, l AS (SELECT *, {canon_sql('lang')} AS lc, {canon_sql('ietf')} AS ic FROM parts)
 SELECT item_id, idx, lc IN ('ger', 'por') OR (ietf <> '' AND ic IN ('ger', 'por')) AS matches FROM l""")
def _(spark, sf):
    return order_parts(spark, sf).select("item_id", "idx", D.language_matches(F.col("lang"), F.col("ietf"), Settings.of(FIRST)).alias("matches"))


@query("p04_want_part", f"""WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, {decide_sql(RULES)}
 SELECT item_id, idx, wk AS keep, wr AS reason, set_language FROM w2 WHERE type IN ('audio', 'subtitle')""")
def _(spark, sf):
    parts = order_parts(spark, sf).filter(F.col("type").isin("audio", "subtitle"))
    return parts.select("item_id", "idx", D.want_part(F.col("lang"), F.col("ietf"), Settings.of(RULES)).alias("w")).select("item_id", "idx", "w.*")


_rule("p05_primary_part", ["keep", "reason", "out_default"], "keep, reason, out_default", PROFILES["homelab"], "type = 'video'")
_rule("p06_drop_commentary", ["keep", "reason"], "keep, reason", PROFILES["archive"], "reason = 'commentary'")
_rule("p07_rescue_forced", ["keep", "out_forced"], "keep, out_forced", RULES, "reason = 'forced subtitle'")
_rule("p08_fallback_keep_all", ["keep", "out_default"], "keep, out_default", PROFILES["archive"], "type = 'audio' AND audio_fallback")
_rule("p09_keep_first", ["keep", "reason", "out_default"], "keep, reason, out_default", FIRST, "type = 'audio'")
_rule("p10_assign_default", ["out_default"], "out_default", RULES, "type = 'audio' AND keep", original="pt-BR")
_rule("p11_drop_sdh_duplicates", ["keep", "reason"], "keep, reason", RULES, "type = 'subtitle'")
_rule("p11_decide_large_items", ["keep", "reason", "out_default", "set_language"], "keep, reason, out_default, set_language", FIRST,
      parts_sql=DOCUMENT_PARTS_SQL, parts=document_parts, original="fr")


@query("p12_attachment_action", f"""WITH {DOCUMENT_PARTS_SQL}, {ATTACHMENTS_SQL}, subs AS (SELECT DISTINCT item_id FROM parts WHERE type = 'subtitle' AND text_sub AND idx % 10 = 2),
 k AS (SELECT a.*, s.item_id IS NOT NULL AS ts, CASE WHEN mime = 'font/ttf' OR file_name LIKE '%.ttf' OR file_name LIKE '%.otf' THEN 'font' WHEN mime = 'image/png' OR file_name LIKE '%.jpg' THEN 'image' ELSE 'other' END AS kind
   FROM attachments a LEFT JOIN subs s USING (item_id))
 SELECT item_id, att_id, kind, kind = 'image' OR (kind = 'font' AND ts) AS keep, kind = 'other' AS block,
   CASE kind WHEN 'font' THEN CASE WHEN ts THEN 'font kept for text subtitles' ELSE 'font dropped: no text subtitles' END WHEN 'image' THEN 'cover art kept' ELSE 'non-font, non-image attachment' END AS reason FROM k""")
def _(spark, sf):
    few = document_parts(spark, sf).withColumn("text_sub", F.col("text_sub") & (F.col("idx") % 10 == 2))
    return D.decide_attachments(document_attachments(spark, sf), few, Settings.of(PROFILES["homelab"])).select(
        "item_id", "att_id", "kind", "keep", "block", "reason")


@query("p13_check_attachments", f"""WITH {ATTACHMENTS_SQL},
 k AS (SELECT *, CASE WHEN mime = 'font/ttf' OR file_name LIKE '%.ttf' OR file_name LIKE '%.otf' THEN 'font' WHEN mime = 'image/png' OR file_name LIKE '%.jpg' THEN 'image' ELSE 'other' END AS kind FROM attachments),
 r AS (SELECT *, 'attachment #' || att_id || ' "' || file_name || '" (' || mime || ', ' || size || ' bytes)' AS label, CASE kind WHEN 'font' THEN 'font dropped by policy' WHEN 'image' THEN 'cover art dropped by policy' ELSE 'non-font, non-image attachment' END AS reason FROM k)
 SELECT item_id, att_id, CASE WHEN bad IS NOT NULL THEN 'ATTACH_EXEC' WHEN kind = 'other' THEN 'ATTACH_BLOCKED' ELSE 'ATTACH_DROP' END AS code, CASE WHEN bad IS NOT NULL OR kind = 'other' THEN 4 ELSE 0 END AS severity,
   CASE WHEN bad IS NOT NULL THEN label || ' contains ' || bad ELSE label || ': ' || reason END AS message FROM r""")
def _(spark, sf):
    decided = D.decide_attachments(document_attachments(spark, sf), document_parts(spark, sf), Settings.of(PROFILES["archive"]))
    return D.attachment_findings(decided).select("item_id", "att_id", "code", "severity", "message")


def _findings_sql(p, original=""):
    return f"""{decide_sql(p, original)}, policy_findings AS (
  SELECT item_id, 'VIDEO_EXTRA' AS code, 1 AS severity, 'stream #' || idx || ': extra video stream dropped' AS message FROM decided WHERE reason = 'secondary video stream'
  UNION ALL SELECT DISTINCT item_id, 'NO_VIDEO', 3, 'no video stream' FROM decided WHERE NOT has_video
  UNION ALL SELECT DISTINCT item_id, 'AUDIO_FALLBACK', 1, 'no audio track matched the language policy; all audio kept' FROM decided WHERE audio_fallback
  UNION ALL SELECT item_id, 'UND_TRACK', 0, 'stream #' || idx || ' (' || type || ') has no language tag; kept as und (languages.und = keep)' FROM decided
    WHERE keep AND type IN ('audio', 'subtitle') AND lc IN ('und', 'unknown') AND set_language = '')"""


@query("p14_decision_findings", f"WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, {_findings_sql(PROFILES['archive'])} SELECT * FROM policy_findings")
def _(spark, sf):
    return D.decision_findings(_decided(order_parts(spark, sf), PROFILES["archive"])).select("item_id", "code", "severity", "message")


@query("p14_und_findings", f"WITH {ALIAS_SQL}, {DOCUMENT_PARTS_SQL}, {_findings_sql(PROFILES['homelab'])} SELECT * FROM policy_findings WHERE code = 'UND_TRACK'")
def _(spark, sf):
    return D.decision_findings(_decided(document_parts(spark, sf), PROFILES["homelab"])).filter("code = 'UND_TRACK'").select(
        "item_id", "code", "severity", "message")


@query("p15_item_strips", """SELECT o_orderkey AS item_id, p.profile, p.kc AS keep_chapters, p.st AS strip_title, p.tg AS strip_tags, p.pv AS strip_provenance, p.ct AS clear_titles FROM orders,
  (VALUES """ + ", ".join(f"('{n}', {str(p['chapters.keep']).lower()}, {str(p['metadata.strip_title']).lower()}, {str(p['metadata.strip_tags']).lower()}, {str(p['metadata.strip_provenance']).lower()}, {str(p['metadata.strip_track_titles']).lower()})"
                          for n, p in PROFILES.items()) + ") p(profile, kc, st, tg, pv, ct)")
def _(spark, sf):
    swept = PR.sweep(table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")), list(PROFILES.values()))
    return D.item_strips(swept, Settings.of_profiles(list(PROFILES.values())))


_ACTIONS_SQL = f"""WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, {decide_sql(RULES)},
 l AS (SELECT item_id, idx, CASE WHEN keep THEN 'keep' ELSE 'drop' END || ' #' || idx || ' ' || type || ' ' || codec || ' ' || CASE WHEN lang = '' THEN 'und' ELSE lower(lang) END || CASE WHEN keep AND out_default AND type <> 'video' THEN ' default' ELSE '' END ||
    CASE WHEN keep AND out_forced THEN ' forced' ELSE '' END || CASE WHEN set_language <> '' THEN ' lang=' || set_language ELSE '' END || ': ' || reason AS line FROM decided
   UNION ALL SELECT DISTINCT item_id, 1000000, 'keep chapters' FROM decided)"""


@query("p16_action_list", f"""{_ACTIONS_SQL}
 SELECT item_id, string_agg(line, chr(10) ORDER BY idx) AS actions FROM l GROUP BY item_id""")
def _(spark, sf):
    p = Settings.of(RULES)
    lines = D.action_lines(D.decide(order_parts(spark, sf), p), None, p)
    return D.action_list(lines).select("item_id", F.array_join("actions", "\n").alias("actions"))


@query("p16_action_entries", f"""{_ACTIONS_SQL} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY idx) AS ordinal, line FROM l""")
def _(spark, sf):
    p = Settings.of(RULES)
    return D.action_entries(D.action_lines(D.decide(order_parts(spark, sf), p), None, p))


_SWEEP = [PROFILES["homelab"], PROFILES["archive"], RULES, FIRST]


@query("p17_decide_all", f"WITH {ALIAS_SQL}, {ORDER_PARTS_SQL}, " + ", ".join(
    f"d_{p.name} AS (WITH {decide_sql(p)} SELECT '{p.name}' AS profile, reason, keep, out_default FROM decided)" for p in _SWEEP)
    + " SELECT profile, reason, keep, out_default, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM d_{p.name}" for p in _SWEEP) + ") GROUP BY ALL")
def _(spark, sf):
    """The same parts under several profiles in one plan; the profiles multiply rows behind the shuffle of the parts."""
    swept = PR.sweep(D.dealt(order_parts(spark, sf)), _SWEEP)
    return D.decide(swept, Settings.of_profiles(_SWEEP), ["item_id", "profile"]).groupBy("profile", "reason", "keep", "out_default").agg(
        F.count("*").alias("n"))


