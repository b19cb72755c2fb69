"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged
from tickersift.llm import quality
from tickersift.llm.adaptive_search import approximate_top_k
from tickersift.llm.language import fit_languages, held_out, predict_languages
from tickersift.llm.lexical_search import ranked_documents
from tickersift.llm.line_templates import drop_recurring_lines
from tickersift.llm.mixing import mix_sources
from tickersift.llm.packing import pack_documents
from tickersift.llm.pivot_search import exact_top_k
from tickersift.llm.pseudonyms import pseudonymised
from tickersift.llm.repeats import repeated_bytes
from tickersift.llm.sharding import shuffled_shards, text_bytes
from tickersift.llm.simhash import near_duplicates
from tickersift.llm.spelling import spelling_variants, vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = predict_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "prediction.*")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law: ``rows``, since positions in one random order are dealt to the shards in turn."""
    sharded = shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    text = F.col("record.text")
    return sharded.select(
        "record.doc_id",
        (text_bytes(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), words=0.7)
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", "text")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# A key of a test; a real one comes from a secret store.
TEST_KEY = b"not a secret"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)
    return found.select("doc_id", "text", F.size("pii").alias("n_pii"), "pii")


def op7_adaptive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(table(spark, sf_dir, "documents"), min_letters=6, min_count=5, every=199)
    return spelling_variants(staged(words, "vocabulary"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_shards": op3_shards,
    "op4_line_templates": op4_line_templates,
    "op5_repeats": op5_repeats,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_adaptive_search": op7_adaptive_search,
    "op8_pivot_search": op8_pivot_search,
    "op9_mix_sources": op9_mix_sources,
    "op10_pack": op10_pack,
    "op11_lexical_search": op11_lexical_search,
    "op12_spelling": op12_spelling,
    "op13_quality": op13_quality,
}

MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes
), filled AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / CAST(weight AS DOUBLE) AS ratio,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER upto, 0) AS DOUBLE)
           / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW upto AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, ratio) FROM filled WHERE level <= ratio)) AS target
  FROM filled
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS base FROM targets
), running AS (
  SELECT r.*, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
), taken AS (
  SELECT *, base + CASE WHEN budget > 0 AND 2 * before + size <= 2 * budget THEN 1 ELSE 0 END AS copies FROM running
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies FROM taken
"""

LINES_SQL = r"""
WITH documents_once AS (
  SELECT DISTINCT doc_id, text FROM documents
), exploded AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS line
  FROM documents_once WHERE text IS NOT NULL
), split AS (
  SELECT doc_id, text, no, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS plain FROM exploded
), masked AS (
  SELECT *, list_transform(plain, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS fields FROM split
), tokenised AS (
  SELECT doc_id, text, no, CASE WHEN len(list_filter(fields, lambda t: t <> '<*>')) >= 0.7e0 * len(plain) THEN fields ELSE plain END AS tokens
  FROM masked
), lines AS (
  SELECT doc_id, text, no, len(tokens) AS n, tokens, list_slice(tokens, 1, 3) AS lead, array_to_string(tokens, ' ') AS template
  FROM tokenised WHERE len(tokens) > 0
), kinds AS (
  SELECT n, lead, template, any_value(tokens) AS tokens, count(*) AS lines FROM lines WHERE n > 3 GROUP BY ALL
), leaves AS (
  SELECT n, lead, sum(lines) AS every FROM kinds GROUP BY ALL HAVING count(*) > 1 AND sum(lines) >= 10
), places AS (
  SELECT k.n, k.lead, k.template, k.lines, l.every, generate_subscripts(k.tokens, 1) AS spot, unnest(k.tokens) AS token
  FROM kinds k JOIN leaves l USING (n, lead)
), fixed AS (
  SELECT n, lead, spot, token FROM places WHERE token <> '<*>' GROUP BY n, lead, spot, token, every HAVING 2 * sum(lines) > every
), general AS (
  SELECT n, lead, count(*) AS constants FROM fixed GROUP BY ALL HAVING count(*) >= 0.7 * n
), covered AS (
  SELECT p.n, p.lead, p.template
  FROM places p JOIN fixed USING (n, lead, spot, token) JOIN general g USING (n, lead)
  GROUP BY p.n, p.lead, p.template, g.constants HAVING count(*) = g.constants
), placed AS (
  SELECT l.doc_id, l.text, l.no, l.n,
         CASE WHEN c.template IS NULL THEN 'line ' || l.template ELSE 'leaf ' || l.n || ' ' || array_to_string(l.lead, ' ') END AS place
  FROM lines l LEFT JOIN covered c ON l.n = c.n AND l.lead = c.lead AND l.template = c.template
), firsts AS (
  SELECT place, n, doc_id, text FROM placed
  QUALIFY row_number() OVER (PARTITION BY place, n ORDER BY doc_id NULLS FIRST) = 1
), recurring AS (
  SELECT place, n FROM (SELECT DISTINCT place, n, doc_id, text FROM placed)
  GROUP BY place, n HAVING count(*) >= CASE WHEN n >= 20 THEN 3 ELSE 10 END
), drops AS (
  SELECT p.doc_id, p.text, list(DISTINCT p.no) AS drop_no
  FROM placed p JOIN recurring r USING (place, n) JOIN firsts f USING (place, n)
  WHERE p.doc_id IS DISTINCT FROM f.doc_id OR p.text <> f.text
  GROUP BY p.doc_id, p.text
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(x.drop_no), 0) AS INTEGER) AS n_dropped,
       CASE WHEN x.drop_no IS NULL THEN d.text
            ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda t, i: NOT list_contains(x.drop_no, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN drops x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text
"""

TOP_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

RANKED_SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS row_no, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), terms AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM numbered
), lengths AS (
  SELECT row_no, doc_id, count(*) AS n FROM terms GROUP BY ALL
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), items AS (
  SELECT item_id, translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id
), asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items) GROUP BY ALL
), occurrences AS (
  SELECT row_no, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM occurrences GROUP BY term), totals
), impacts AS (
  SELECT o.row_no, l.doc_id, o.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
  FROM occurrences o JOIN weights USING (term) JOIN lengths l USING (row_no), totals
), scored AS (
  SELECT item_id, row_no, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score
  FROM asked JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

SQL = {
    "op11_lexical_search": RANKED_SQL,
    "op8_pivot_search": TOP_SQL,
    "op4_line_templates": LINES_SQL,
    "op9_mix_sources": MIX_SQL,
}
