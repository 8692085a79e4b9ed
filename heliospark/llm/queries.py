"""One query for each operator on the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.llm import alignment, bpe, exact_dedup, lemp, line_dedup, packing, pitman_yor, simhash, site_style_tree, token_counts, topk, toxicity, warc
from heliospark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Letters of the contracts' lower-casing, for the SQL.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def remainder(key: str, of: int):
    """crc32 of the key as text, modulo ``of``; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


@query(
    "op1_top_k",
    """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM ints),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM cells q JOIN cells c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op2_packing", packing.pack_sql("documents"))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: End-of-document id of the tokenizer file that the queries use.
SEPARATOR = 50_256


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder("doc_id", 3) != 1)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, learned_labels(spark, sf_dir))
    return toxicity.scored(documents, model).select(
        "row.doc_id",
        F.coalesce(remainder("row.doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        "evidence",
    )


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, owners = token_counts.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), SEPARATOR)
    counted = token_counts.count_documents(blocks, SEPARATOR)
    return counted.join(owners, ["file", "ordinal"]).select(F.col("key").alias("doc_id"), "file", "ordinal", "start", "n_tokens")


@query(
    "op7_exact_dedup",
    f"""
WITH d AS (SELECT doc_id, sha256({_SQL_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op8_line_dedup",
    f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {_SQL_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op9_site_style_tree")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_style_tree.extract(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op10_pitman_yor")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    coded = pitman_yor.code(documents.withColumn("held_out", held_out), learned=~F.col("held_out"))
    model, learned = pitman_yor.learn(coded)
    scored = pitman_yor.score_coded(coded, model, learned)
    return scored.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op11_warc",
    """
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM w
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_key").cast("long").alias("refers_to"),
    )


@query(
    "op12_ranked_search",
    rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{lemp.TERM}')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
whole AS (SELECT count(*) AS rows_all, sum(n)::BIGINT AS terms_all FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(rows_all) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term
), measures AS (SELECT doc_id, 100 - 50 + (50 * n * rows_all) // terms_all AS m FROM lengths, whole),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{lemp.TERM}')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN measures USING (doc_id) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemp.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("alignment", 256))
    return alignment.with_counts(aligned.withColumn("alignment", digest).withColumnRenamed("alignment", "groups_sha256"))
