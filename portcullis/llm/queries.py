"""Registered queries of this package; each applies its operator to the whole of its table."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm import backoff_lm, bit_sliced, bpe, importance, knn_quality, licenses, mixing, multi_index, ngram_join, pii, prefix_trie, toxicity, warc
from portcullis.llm.common import crc_rest, table
from portcullis.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


#: Documents whose score reaches it count as good.
QUALITY_THRESHOLD = 0.3


@query
def op10_knn_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = knn_quality.fit(docs, table(spark, sf, "labels"))
    return knn_quality.score(docs, model).select(
        "doc_id", (crc_rest("doc_id", 5) == 0).alias("held_out"), F.col("_quality_score").alias("score"),
        (F.col("_quality_score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


#: The secret of the pseudonyms; the sample key only where none is given, as on test tables.
PII_KEY = os.environ["PORTCULLIS_PII_KEY"].encode() if os.environ.get("PORTCULLIS_PII_KEY") else pii.SAMPLE_KEY


@query
def op4_pii_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = pii.rewrite(table(spark, sf, "documents").select("doc_id", "text"), PII_KEY)
    return docs.select("doc_id", "text", F.col("_pii_count").alias("n_pii"), F.col("_pii_kinds").alias("kinds"))


@query
def op8_bpe_backtracking(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf, "documents"))


@query
def op1_entropy_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


#: Queries of the exact search: ids divisible by it.
EVERY_50 = 50


@query
def op5_bit_sliced_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf, "embeddings"), lambda i: i % EVERY_50 == 0, k=5)


sql("op5_bit_sliced_top_k", """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
 s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")


@query
def op3_backoff_automaton(spark: SparkSession, sf: str) -> DataFrame:
    out = backoff_lm.score(table(spark, sf, "documents"), crc_rest("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_license_templates(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))
    phrases = F.filter("_found", lambda f: f["kind"] == "phrase")
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda f: f["label"]))), ",")
    starts = F.transform(phrases, lambda f: f["start"])
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.size(phrases).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(phrases).alias("base_labels"), labels(F.col("_found")).alias("labels"), F.col("_score").alias("score"))


@query
def op7_warc_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return warc.round_trip(table(spark, sf, "pages"), folder)


sql("op7_warc_normaliser", """WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
 d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
 f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
   CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
   CASE WHEN first <> page_id THEN first END AS refers_to
 FROM d LEFT JOIN f USING (h)""")


#: Queries of the approximate search: ids divisible by it.
EVERY_100 = 100


@query
def op6_multi_index_hashing(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.neighbours(table(spark, sf, "embeddings"), lambda i: i % EVERY_100 == 0, k=10)


@query
def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    out = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a list of bytes, by its bitwise table of 256 entries.
_SQL_CRC = """byte_table AS (SELECT list(c ORDER BY i) AS crc FROM (
   SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
   FROM (SELECT unnest(range(256)) AS i)))"""

sql("op12_importance_resampling", f"""WITH {_SQL_CRC},
 texts AS (SELECT doc_id, false AS target, row_number() OVER () AS r, text FROM documents
           UNION ALL SELECT NULL, true, row_number() OVER (), text FROM benchmark),
 split AS (SELECT doc_id, target, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
 used AS (SELECT target, r, w, count(*) AS n FROM (SELECT target, r, unnest(ws) AS w FROM split) GROUP BY ALL),
 hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM used)),
 bucketed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2),
      lambda i: CAST((instr('0123456789ABCDEF', x[i:i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1:i + 1]) - 1 AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, byte_table),
 f AS (SELECT target, r, bucket, n FROM used JOIN bucketed USING (w)),
 counted AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT target), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (target), 0) AS DOUBLE) AS t FROM f GROUP BY bucket),
 gained AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS BIGINT) AS gain FROM counted),
 summed AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN gained USING (bucket) WHERE NOT target GROUP BY r),
 scored AS (SELECT doc_id, r, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
   FROM split LEFT JOIN summed USING (r) WHERE NOT target),
 placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place,
   count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored)
 SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed""")


@query
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf, "conversations"))


sql("op13_prefix_trie", f"""WITH {_SQL_CRC},
 given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 ids AS (SELECT conv_id, turn, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS id,
   len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM given),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS p FROM ids),
 decimals AS (SELECT conv_id AS c, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM given GROUP BY conv_id),
 c AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2),
      lambda i: CAST((instr('0123456789ABCDEF', x[i:i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1:i + 1]) - 1 AS BIGINT))),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM decimals, byte_table),
 r AS (SELECT c, 0 AS part, p, id, words FROM c JOIN t ON t.conv_id = c.base AND p <= h
       UNION ALL SELECT c, 1, p, id, words FROM c JOIN t ON t.conv_id = c.c AND p > h),
 placed AS (SELECT c, id, words, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM r),
 paths AS (SELECT c.c, list(id ORDER BY d) FILTER (d IS NOT NULL) AS path, count(d) AS n FROM c LEFT JOIN placed USING (c) GROUP BY c.c),
 pre AS (SELECT c, n, d, CASE WHEN d = 0 THEN '' ELSE array_to_string(path[1:d], ',') END AS node FROM (SELECT c, path, n, unnest(range(n + 1)) AS d FROM paths)),
 nodes AS (SELECT node, any_value(pre.d) AS d, min(pre.c) AS conv_id, count(*) AS n_convs, max(coalesce(words, 0)) AS words, max(n) AS longest,
     coalesce(string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c) FILTER (n = pre.d), '') AS ending
   FROM pre LEFT JOIN placed ON placed.c = pre.c AND placed.d = pre.d GROUP BY node),
 up AS (SELECT DISTINCT a.node AS top, b.node FROM pre a JOIN pre b ON a.c = b.c AND a.d <= b.d),
 under AS (SELECT top, sum(CASE WHEN longest = d THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
   FROM up JOIN nodes USING (node) GROUP BY top),
 parents AS (SELECT DISTINCT b.node, a.node AS parent FROM pre a JOIN pre b ON a.c = b.c AND a.d + 1 = b.d),
 kids AS (SELECT parent, count(*) AS n_children FROM parents GROUP BY parent)
 SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
   CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ending) AS ends_sha256
 FROM nodes n JOIN under u ON u.top = n.node LEFT JOIN kids k ON k.parent = n.node
   LEFT JOIN parents p ON p.node = n.node LEFT JOIN nodes q ON q.node = p.parent""")


#: Documents whose score reaches it count as toxic.
TOXIC_THRESHOLD = 0.5


@query
def op11_toxicity_bigru(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (crc_rest("id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))
