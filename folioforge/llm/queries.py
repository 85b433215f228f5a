"""Queries of the training-data operators, by the names the driver knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import exact, jaccard, langid, licences, mixing, packing, privacy, repeats, tokenfiles, topk
from folioforge.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id != c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).drop("base_spans")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes_of(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    n_bytes, kept = F.length("body").cast("long"), F.length("kept").cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


EXACT_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from d
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_documents(tokenfiles.write_sequences(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.labelled_samples(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": TOP_K_SQL, "op4_mixing": mixing.mix_sql(), "op7_exact_dedup": EXACT_SQL, "op9_licences": licences.scan_sql()}
