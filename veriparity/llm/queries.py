"""Registered queries of the corpus operators, and check SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriparity.llm.alignment import align_tokenizers
from veriparity.llm.common import table
from veriparity.llm.lines import line_dedup
from veriparity.llm.merkle import compare_with_next
from veriparity.llm.minhash import near_duplicates
from veriparity.llm.negatives import hard_negatives
from veriparity.llm.packing import pack_documents
from veriparity.llm.pii import find_pii
from veriparity.llm.quality import classify
from veriparity.llm.sampled_pieces import round_trips
from veriparity.llm.secret_scan import find_secrets
from veriparity.llm.substrings import without_repeats
from veriparity.llm.toxicity import toxicity_scores
from veriparity.llm.vector_links import vector_links

Query = Callable[[SparkSession, str], DataFrame]

TOXIC_FROM = 0.7


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return placed.withColumn("length", F.col("length").cast("long"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), seed=3)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("found", "n_layers")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved)).drop("positive_rank")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents")).drop("pairs")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRINGS_SQL = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 48))) AS i FROM d)
), firsts AS (
    SELECT k, min(doc_id) AS f FROM win GROUP BY k
), gone AS (
    SELECT DISTINCT doc_id, i + j AS p
    FROM (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE doc_id > f), (SELECT unnest(range(0, 50)) AS j)
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), removed AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

VECTORS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
    SELECT * FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), groups AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN groups USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

MINHASH_SQL = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 2], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), groups AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM groups LEFT JOIN sizes USING (doc_id)
"""

NEGATIVES_SQL = """
WITH sound AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
), v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS e
    FROM sound WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
    SELECT * FROM (
        SELECT anchor_id, id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place
        FROM scored WHERE same
    ) WHERE place <= 5
), placed AS (
    SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS place
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM placed WHERE place <= 3
"""

LINES_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(w) AS line, unnest(range(len(w))) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents)
), k AS (
    SELECT *, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
), common AS (
    SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, p, line, coalesce(k.doc_id <> last, false) AS gone FROM k LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing, op2_substring_dedup, op3_sentencepiece, op4_embedding_dedup, op5_quality, op6_fingerprints,
        op7_secrets, op8_minhash, op9_toxicity, op10_pii, op11_negatives, op12_alignment, op13_line_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": SUBSTRINGS_SQL,
    "op4_embedding_dedup": VECTORS_SQL,
    "op8_minhash": MINHASH_SQL,
    "op11_negatives": NEGATIVES_SQL,
    "op13_line_dedup": LINES_SQL,
}
