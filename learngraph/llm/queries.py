"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.llm import embedding_duplicates, fill_in_middle, html_text, language_id, near_duplicates, nearest, packing, quality, secret_scan, sentencepiece_codec, sharding, shared, token_store, vector_codes

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1, size=2048)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(_table(spark, sf_dir, "documents"), words=4, percent=80).drop("digest", "root")


def _remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, by ``divisor``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def language_model(docs: DataFrame, *, calibrated: bool = False) -> language_id.Model:
    """Fitted on about 1,500 rows of each language, none of them held out."""
    return language_id.fit(docs.where(_remainder(5) != 0), key=F.col("doc_id"), rows_per_language=1500, calibrated=calibrated)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_model(docs))
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-shards")
    token_store.write_shards(_table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=0)
    return token_store.read_documents(spark, path)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates.link(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on about 8,000 labelled rows at most, none of them held out."""
    return quality.fit(docs, labels.where(_remainder(3) != 1), max_rows=8000)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), PIECE_BPE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality_model(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), shards=8)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(_table(spark, sf_dir, "documents"), seed=7)
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, its documents of one language a repository."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.col("lang"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_owned", "n_copied")


# Forms and cuts are plain string work on the seed's sha-256; the text restored is the text itself.
_FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS lines FROM t),
k AS (SELECT *, len(lines)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM l),
b AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, array_to_string(lines[1:lo], '') AS p, array_to_string(lines[lo + 1:hi], '') AS m, array_to_string(lines[hi + 1:], '') AS s FROM b)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM c
"""


def _codes_sql() -> str:
    """Every distance to every entry in whole numbers; a distance and its entry's index make one number, so its least value names both."""
    nearest = lambda k: f"near{k} AS (SELECT vec_id, p, min(list_sum(list_transform(range(1, len(s.x) + 1), lambda i: (s.x[i] - b.x[i]) * (s.x[i] - b.x[i])))::BIGINT * 64 + b.k) AS m FROM sub s JOIN book{k} b USING (p) GROUP BY vec_id, p)"
    moved = lambda k: f"""sums{k} AS (SELECT p, m % 64 AS k, i, sum(x[i])::BIGINT AS t, count(*) AS n FROM near{k} JOIN sub USING (vec_id, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY 1, 2, 3),
book{k + 1} AS (SELECT b.p, b.k, coalesce(c.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT p, k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS x FROM sums{k} GROUP BY 1, 2) c USING (p, k))"""  # noqa: E731
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sub AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)),
book0 AS (SELECT p, k, x FROM sub JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{nearest(0)}, {moved(0)}, {nearest(1)}, {moved(1)}, {nearest(2)},
codes AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near2 GROUP BY 1),
name AS (SELECT sha256(string_agg(x[i]::VARCHAR, ',' ORDER BY p, k, i)) AS s FROM book2, unnest(range(1, len(x) + 1)) AS u(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM codes JOIN kept USING (vec_id), name"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_minhash_dedup, op3_language_id, op4_token_shards, op5_html_extraction, op6_embedding_dedup, op7_nearest_neighbours, op8_sentencepiece, op9_quality, op10_sharding, op11_fill_in_middle, op12_vector_codes, op13_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": _FIM_SQL, "op12_vector_codes": _codes_sql()}
