"""Exact filtered vector search, keyword ranks, and their reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import CHUNK_SQL, DOCUMENT_SQL, LIVE_SQL, chunk, document, visible
from ..session import table
from .lexemes import postings, postings_sql, ranked, ranked_sql, stored

#: Constant of the rank fusion, candidates of each retriever, weight of the keyword side.
RRF_K, DEPTH, KEYWORD_WEIGHT = 60, 30, 0.3
_LABELS = "label IN (1, 3, 5)"


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """vec_id, score of the k vectors of allowed labels nearest by cosine to vector 0; filters come before ranking."""
    vectors = table(spark, sf_dir, "embeddings")
    probe = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = vectors.where(_LABELS).join(F.broadcast(probe)).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


_COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], q), 6)"
_VECTOR_SQL = f"SELECT vec_id, {_COSINE} AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) WHERE {_LABELS} ORDER BY score DESC, vec_id"


@query("vector_topk", f"{_VECTOR_SQL} LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_top(spark, sf_dir, 10)


#: Fixed value: the most hits a search returns.
MOST = 50


def clamped(k: int) -> int:
    return max(1, min(k, MOST))


QUESTION, TENANT, LABELS = "Licenses and the?", 1, ["public", "finance"]
_GOVERNED_SQL = f"{DOCUMENT_SQL}, {LIVE_SQL}, governed AS (SELECT * FROM live WHERE tenant_id = {TENANT} AND list_has_any(labels, {LABELS})), {postings_sql('governed')}"
_KEYWORD_SQL = f"{ranked_sql(QUESTION)} ORDER BY rank DESC, doc_id"


def searched(spark: SparkSession, sf_dir: str, tenant: int = TENANT, labels: list[str] = LABELS, *more: str) -> DataFrame:
    """doc_id, tenant_id (and more columns) of the live documents of one tenant that share a label with the caller: every filter comes before ranking."""
    return visible(document(spark, sf_dir).select("doc_id", "tenant_id", "source_path", "labels", *more), tenant, labels).select("doc_id", "tenant_id", *more)


def keyword_top(spark: SparkSession, sf_dir: str, words: str, k: int, tenant: int = TENANT, labels: list[str] = LABELS) -> DataFrame:
    """doc_id, rank of the k documents that the caller may see and that answer best.

    Where the application has stored the folder's index, its postings of the words are read and no texts. One question alone
    doesn't have the whole index built: postings are made of the texts that the caller may see, after all filters, as the SQL has it.
    """
    entries = stored(spark, sf_dir)
    if entries is None:
        return ranked(postings(searched(spark, sf_dir, tenant, labels, "text")), words, k)
    return ranked(entries, words, k, searched(spark, sf_dir, tenant, labels).select("doc_id"))


@query("keyword_topk", f"WITH {_GOVERNED_SQL} {_KEYWORD_SQL} LIMIT {DEPTH}")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the question's words, of documents that the caller may see; texts are not read where the index is there."""
    return keyword_top(spark, sf_dir, QUESTION, DEPTH)


_NEAREST_SQL = f"SELECT c.chunk_id, c.doc_id, round(list_cosine_similarity(c.embedding::DOUBLE[], q), 6) AS score FROM chunk c JOIN governed d ON d.doc_id = c.doc_id AND d.tenant_id = c.tenant_id, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) WHERE c.tenant_id = {TENANT} ORDER BY score DESC, chunk_id"


def nearest_chunks(chunks: DataFrame, docs: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """chunk_id, doc_id, score of the k chunks of docs nearest to probe (one row, q) by cosine; both sides are of one tenant."""
    q, e = F.col("q"), F.col("embedding")
    mine = chunks.join(docs.select("doc_id", "tenant_id"), ["doc_id", "tenant_id"]).join(F.broadcast(probe))
    scored = mine.select("chunk_id", "doc_id", F.round(dot(e, q) / F.sqrt(dot(e, e) * dot(q, q)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("search", f"WITH {_GOVERNED_SQL}, {CHUNK_SQL} SELECT chunk_id, doc_id, round(score, 4) AS score FROM ({_NEAREST_SQL} LIMIT {MOST})")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed vector search: chunk joined with document, a k beyond the bound is lowered, scores are rounded at the boundary."""
    found = nearest_chunks(chunk(spark, sf_dir), searched(spark, sf_dir), _probe(spark, sf_dir), clamped(1000))
    return found.select("chunk_id", "doc_id", F.round("score", 4).alias("score"))


def fused(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """id and score of two ranked lists (id, r) of at most DEPTH rows each: weights over RRF_K and rank, summed."""
    score = F.coalesce(1.0 / (RRF_K + F.col("vr")), F.lit(0.0)) + F.coalesce(KEYWORD_WEIGHT / (RRF_K + F.col("kr")), F.lit(0.0))
    return vector.select("id", F.col("r").alias("vr")).join(keyword.select("id", F.col("r").alias("kr")), "id", "full").select("id", F.round(score, 9).alias("score"))


def numbered(rows: DataFrame, id_: str, by: str) -> DataFrame:
    # rows are limited before, so one task numbers DEPTH of them
    return rows.select(F.col(id_).alias("id"), F.row_number().over(Window.orderBy(F.desc(by), id_)).alias("r"))


_FUSED_SQL = f"SELECT coalesce(v.id, k.id) AS id, round(coalesce(1.0 / ({RRF_K} + v.r), 0) + coalesce({KEYWORD_WEIGHT} / ({RRF_K} + k.r), 0), 9) AS score FROM v FULL JOIN k ON v.id = k.id"
_RANKED_K_SQL = f"k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY rank DESC, doc_id) AS r FROM ({_KEYWORD_SQL} LIMIT {DEPTH}))"


@query("rrf_fuse", f"WITH {_GOVERNED_SQL}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({_VECTOR_SQL} LIMIT {DEPTH})), {_RANKED_K_SQL} {_FUSED_SQL}")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = vector_top(spark, sf_dir, DEPTH).select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("r"))
    return fused(vector, numbered(keyword_topk(spark, sf_dir), "doc_id", "rank"))


def hybrid(spark: SparkSession, sf_dir: str, words: str, tenant: int, labels: list[str], k: int) -> DataFrame:
    """doc_id, score by both retrievers over the same governed rows; a blank query or no labels give none, and k is clamped.

    A document's place among the vectors is that of its best chunk.
    """
    if not words.strip() or not labels:
        return spark.createDataFrame([], "doc_id long, score double")
    docs = searched(spark, sf_dir, tenant, labels)
    nearest = nearest_chunks(chunk(spark, sf_dir), docs, _probe(spark, sf_dir), DEPTH).groupBy("doc_id").agg(F.max("score").alias("score"))
    both = fused(numbered(nearest, "doc_id", "score"), numbered(keyword_top(spark, sf_dir, words, DEPTH, tenant, labels), "doc_id", "rank"))
    return both.orderBy(F.desc("score"), F.col("id").cast("string")).limit(clamped(k)).select(F.col("id").alias("doc_id"), "score")


@query("hybrid_search", f"WITH {_GOVERNED_SQL}, {CHUNK_SQL}, v AS (SELECT doc_id AS id, row_number() OVER (ORDER BY max(score) DESC, doc_id) AS r FROM ({_NEAREST_SQL} LIMIT {DEPTH}) GROUP BY doc_id), {_RANKED_K_SQL} SELECT id AS doc_id, score FROM ({_FUSED_SQL}) ORDER BY score DESC, CAST(id AS VARCHAR) LIMIT 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, QUESTION, TENANT, LABELS, 5)
