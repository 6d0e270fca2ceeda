"""Evaluation of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import table
from .retrieval import dot

_RANKED_SQL = """q AS (SELECT vec_id AS query_id, label AS wanted, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 34),
 s AS (SELECT query_id, wanted, label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(v.embedding::DOUBLE[], q.e), 6) DESC, vec_id) AS r FROM embeddings v, q WHERE vec_id >= 34),
 f AS (SELECT query_id, min(r) FILTER (WHERE label = wanted) AS rank FROM s WHERE r <= 5 GROUP BY query_id)"""


def first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank of the first relevant one of the 5 nearest (null if none): 34 questions, vectors of the same label are relevant."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id < 34").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), F.col("embedding").alias("e"))
    # the question set is stated and small, and is broadcast against all vectors
    scored = vectors.where("vec_id >= 34").join(F.broadcast(asked)).select("query_id", "vec_id", (F.col("label") == F.col("wanted")).alias("good"), F.round(dot(F.col("embedding"), F.col("e")), 6).alias("score"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("r <= 5")
    return ranked.groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("r"))).alias("rank"))


@query("recall_mrr", f"WITH {_RANKED_SQL} SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM f")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    within = {f"recall_{k}": F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6) for k in (1, 3, 5)}
    return first_ranks(spark, sf_dir).agg(F.count(F.lit(1)).alias("questions"), *[c.alias(n) for n, c in within.items()], F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


_SCORES_SQL = "round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr"
_WORDS_SQL = "unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w"
_BENCHMARK_SQL = f"""q AS (SELECT item_id, {_WORDS_SQL} FROM benchmark), d AS (SELECT doc_id, {_WORDS_SQL} FROM documents),
 s AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS r FROM q JOIN d USING (w) GROUP BY item_id, doc_id),
 f AS (SELECT b.item_id, min(r) FILTER (WHERE contains(d.text, b.text)) AS rank FROM benchmark b LEFT JOIN s ON s.item_id = b.item_id AND r <= 5 LEFT JOIN documents d ON d.doc_id = s.doc_id GROUP BY b.item_id)"""


@query("benchmark_recall", f"WITH {_BENCHMARK_SQL} SELECT count(*) AS questions, {_SCORES_SQL} FROM f")
def benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of `benchmark` is a question, ranked by shared words; documents that hold its passage are relevant. One without a passage is a miss.

    A document that holds a passage lacks two of its words at most, the first and the last, which may run on in it. So it
    has one of any three of them, and so has every document before it. Only documents with one of an item's three rarest
    words are counted, and the ranks of relevant ones are those among all documents.
    """
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    asked = items.select("item_id", F.explode(words).alias("w"))
    places = docs.select("doc_id", F.explode(words).alias("w"))
    often = places.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "w"))
    rare = asked.join(often, "w", "left").withColumn("r", order).where("r <= 3").select("item_id", "w")
    pairs = places.join(rare, "w").select("item_id", "doc_id").distinct()
    both = pairs.join(items.select("item_id", words.alias("iw"), F.col("text").alias("passage")), "item_id").join(docs.select("doc_id", words.alias("dw"), "text"), "doc_id")
    shared = both.select("item_id", "doc_id", F.size(F.array_intersect("iw", "dw")).alias("n"), F.contains("text", "passage").alias("hit"))
    found = shared.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "doc_id"))).where("r <= 5 AND hit")
    first = found.groupBy("item_id").agg(F.min("r").alias("rank"))
    within = {f"recall_{k}": F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6) for k in (1, 3, 5)}
    return items.select("item_id").join(first, "item_id", "left").agg(F.count(F.lit(1)).alias("questions"), *[c.alias(n) for n, c in within.items()], F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


_ANSWER_SQL = "SELECT conv_id % 3 AS kind, text, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN ' ' || replace(text, ' ', '  ') || chr(10) WHEN 2 THEN 'no answer' END AS given, CASE WHEN conv_id % 3 = 2 THEN 'no answer' ELSE text END AS expected FROM conversations"


def normal(answer: Column) -> Column:
    """An answer for comparing: lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(answer), r"[ \t\r\n]+", " "))


@query("accuracy", rf"WITH a AS ({_ANSWER_SQL}), n AS (SELECT kind, trim(regexp_replace(lower(given), '[ \t\r\n]+', ' ', 'g')) AS g, trim(regexp_replace(lower(expected), '[ \t\r\n]+', ' ', 'g')) AS e FROM a) SELECT kind, count(*) AS n, round(avg(CASE WHEN g = e THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (WHERE e = 'no answer') AS to_refuse, count(*) FILTER (WHERE e = 'no answer' AND g = e) AS refused FROM n GROUP BY kind")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given answers against expected ones by kind of question, and how many of those to be refused were; a missing answer is wrong.

    Answers are made from messages by turn: as expected, in other spacing, a refusal, or none.
    """
    turn = F.col("turn") % 4
    given = F.when(turn == 0, F.col("text")).when(turn == 1, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"))).when(turn == 2, "no answer")
    kind = F.col("conv_id") % 3
    answers = table(spark, sf_dir, "conversations").select(kind.alias("kind"), normal(given).alias("g"), normal(F.when(kind == 2, "no answer").otherwise(F.col("text"))).alias("e"))
    right = F.coalesce(F.col("g") == F.col("e"), F.lit(False))
    refuse = F.col("e") == "no answer"
    return answers.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count_if(refuse).alias("to_refuse"), F.count_if(refuse & right).alias("refused"))
