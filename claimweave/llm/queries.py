"""Queries opN_<name>: each operator over its whole table, with the columns of its contract, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import aligned
from .decontamination import contaminated
from .embedding_graph import embedding_components
from .hard_negatives import hard_negatives
from .language_id import language_id
from .licenses import license_scan
from .licenses import sql as license_sql
from .lm_scoring import lm_scores
from .parity_join import jaccard_components
from .quality import quality
from .source_mix import source_mix
from .substring_dedup import substring_dedup
from .token_counts import token_counts, with_bytes
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, by the package that has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts(docs, tokenizer_file("piece_bpe_32k.model")).drop("text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, relabelled = table(spark, sf_dir, "embeddings"), (F.col("label").cast("long") + 1) % 10
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, relabelled).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_license_scan": op5_license_scan,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_source_mix": op8_source_mix,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

WORDS_SQL = r"""WITH words AS (SELECT doc_id, row_number() OVER () AS r, [x FOR x IN string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents)"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": WORDS_SQL.format(text="text")
    + """, starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
keyed AS (SELECT s.r, s.i, sha256(array_to_string(w[s.i : s.i + 34], ' ')) AS h FROM starts s JOIN words USING (r)),
twice AS (SELECT r, i FROM keyed JOIN (SELECT h FROM keyed GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM twice),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
kept AS (SELECT doc_id, len(w) AS n_words, len(coalesce(ps, [])) AS n_removed, CASE WHEN ps IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ps, k)] END AS k FROM words LEFT JOIN lists USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
    "op4_ngram_jaccard": "WITH RECURSIVE"
    + WORDS_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").removeprefix("WITH")
    + """, shingles AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes m ON m.r = x JOIN sizes n ON n.r = y WHERE 100 * c >= 75 * (m.n + n.n - c)),
reach AS (SELECT r AS x, r AS y FROM words UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.component_id FROM words w LEFT JOIN sizes USING (r)
JOIN (SELECT x, min(doc_id) AS component_id FROM reach JOIN words ON y = r GROUP BY x) m ON m.x = w.r""",
    "op5_license_scan": license_sql(),
    "op8_source_mix": r"""WITH sized AS (SELECT doc_id, text, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
  CAST(len([x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']) AS BIGINT) AS size FROM documents),
caps AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS weight, CAST(sum(size) * 3 AS DOUBLE) AS cap FROM sized GROUP BY key),
rated AS (SELECT *, cap / weight AS ratio FROM caps),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(cap) OVER b, 0)) / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER b AS BIGINT), 0)) AS level FROM rated
  WINDOW b AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT key, source_size, least(cap, weight * (SELECT arg_min(level, {'a': ratio, 'b': key}) FROM levels WHERE level <= ratio)) AS target FROM levels),
ranked AS (SELECT doc_id, key, size, row_number() OVER (PARTITION BY key ORDER BY lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 3), substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 3), size, doc_id) AS rank FROM sized),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, CAST('0x' || substr(md5('17:' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM ranked JOIN goals USING (key))
SELECT doc_id, size, source_size, target, CAST(floor(rank * rate + start) - floor((rank - 1) * rate + start) AS BIGINT) * size AS taken FROM rates""",
    "op11_hard_negatives": """WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER r AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW r AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER r <= 10""",
    "op12_embedding_near_dedup": """WITH RECURSIVE fine AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN n ON n.x = vec_id""",
}
