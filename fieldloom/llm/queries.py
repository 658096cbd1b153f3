"""Queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import html_crf, pii_crf, quality_forest, toxicity_ftrl
from fieldloom.llm.conversations import repaired
from fieldloom.llm.decontaminate import contamination
from fieldloom.llm.lexical import search
from fieldloom.llm.mixing import mix
from fieldloom.llm.packing import pack_documents
from fieldloom.llm.simhash_gph import near_duplicates
from fieldloom.llm.substring_dedup import remove_repeated_passages
from fieldloom.llm.token_counts import count_tokens
from fieldloom.llm.token_store import documents_of, read_store, shared_folder, write_store


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_crf.extract_text(pages, html_crf.train(pages))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(_table(spark, sf_dir, "documents"), width=20, with_text=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = quality_forest.train(docs, _table(spark, sf_dir, "labels"))
    return quality_forest.judge(docs, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii_crf.find_personal_data(docs, pii_crf.train(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_ftrl.score_toxicity(docs, toxicity_ftrl.train(docs, _table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), limit=2048)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, radius=2).drop("fp")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-store")
    docs = _table(spark, sf_dir, "documents")
    write_store(docs, path, _vocabulary("byte_bpe_50k.json"), end_id=2)
    # Every key through the index; documents without one can only be read from their shards.
    return documents_of(docs, path).unionByName(read_store(spark, path, nulls_only=True))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_substring_dedup, op3_quality, op4_personal_data, op5_toxicity, op6_decontamination, op7_token_counts, op8_simhash, op9_packing, op10_token_store, op11_lexical_search, op12_mixing, op13_conversations)} | {"pipeline": pipeline}


#: Words, windows by their text, all but the first of equal windows, the words they cover, and what is left.
_OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM f)),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT u.doc_id, count(c.j) AS n_removed, string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY u.j) AS rest FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.j = c.j GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


#: Terms, counts, weights and scores as the contract has them.
_OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM g),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
s AS (SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score FROM b JOIN p USING (term) JOIN w USING (term) JOIN g ON p.doc_id = g.doc_id, a GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

#: Sizes, sources in the order in which they fill, targets, and where each document lies in its source's random order.
_OP12 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
r AS (SELECT *, CASE k % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END::DOUBLE AS weight, source_size * 2::DOUBLE AS most FROM n),
f AS (SELECT *, coalesce(sum(most) OVER b, 0) AS most_before, coalesce(sum(weight) OVER b, 0) AS weight_before FROM r WINDOW b AS (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT 1.5::DOUBLE * sum(source_size) AS total, sum(weight) AS weights FROM r),
u AS (SELECT f.*, weight * (total - most_before) > most * (weights - weight_before) AS whole, total, weights FROM f, a),
o AS (SELECT max(total) - coalesce(sum(most) FILTER (WHERE whole), 0) AS rest, max(weights) - coalesce(sum(weight) FILTER (WHERE whole), 0) AS free FROM u),
g AS (SELECT source, source_size, CASE WHEN whole THEN most ELSE least(most, weight * rest / CASE WHEN free = 0 THEN 1 ELSE free END) END AS target FROM u, o),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('12|' || coalesce(CAST(doc_id AS VARCHAR), ' ')), 1, 15))::BIGINT, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM p)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)) AS taken FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2, "op11_lexical_search": _OP11, "op12_mixing": _OP12}
