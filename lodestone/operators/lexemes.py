"""The dual lexeme index: postings of every word as it stands and by its stem, stored by shards, and ranks read from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import STOP, stem, stem_sql, stems_of, words_of, words_sql
from ..plans.registry import query
from ..session import shared_dir, table

#: Shards of an index (more for a larger one: a query reads those of its words), the fewest parts that documents are dealt over, so that a word that stands everywhere isn't one task's, and characters a part.
SHARDS, SPREAD, PART = 16, 8, 1 << 24
#: Fixed values of the rank: weight of a word, the sum of 1 / n ** 2 over all n, and the most places of a word that count.
WEIGHT, ZETA, PLACES = 0.1, 1.64493406685, 256


def shard(lexeme: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(shards)).cast("int")


def postings(docs: DataFrame) -> DataFrame:
    """lexeme, doc_id, literal, stemmed, words: how often a word stands in a document, as it is and by its stem, and the document's length.

    Null texts and texts without words have none; the stemmed form leaves stop words out. A row's words are counted in the
    row, as runs of its sorted words, so only the different ones are stemmed, and rows dealt by doc_id are not shuffled again.
    """
    sorted_ = docs.select("doc_id", F.sort_array(words_of(F.col("text"))).alias("all"))
    first = lambda at: (at == 0) | (F.get("all", at) != F.get("all", at - 1))
    begins = F.filter(F.when(F.size("all") > 0, F.sequence(F.lit(0), F.size("all") - 1)), first)
    own = sorted_.select("doc_id", F.size("all").cast("long").alias("words"), "all", begins.alias("begins"))
    different = own.select("doc_id", "words", "begins", F.transform("begins", lambda at: F.get("all", at)).alias("own"))
    counted = different.select("doc_id", "words", "own", stems_of(F.col("own")).alias("stems"), F.transform("begins", lambda at, k: F.coalesce(F.get("begins", k + 1).cast("long"), F.col("words")) - at).alias("n"))
    each = counted.select("doc_id", "words", F.explode(F.arrays_zip(F.col("own").alias("word"), F.col("stems").alias("stem"), "n")).alias("w")).select("doc_id", "words", "w.*")
    # a word that is its own stem is one row from the start
    none, stop, same = F.lit(0).cast("long"), F.col("word").isin(*STOP), F.col("stem") == F.col("word")
    form = lambda lexeme, literal, stemmed: F.struct(F.col(lexeme).alias("lexeme"), literal.alias("literal"), stemmed.alias("stemmed"))
    literal = form("word", F.col("n"), F.when(same & ~stop, F.col("n")).otherwise(none))
    forms = F.when(stop | same, F.array(literal)).otherwise(F.array(literal, form("stem", none, F.col("n"))))
    both = each.select("doc_id", "words", F.explode(forms).alias("f")).select("doc_id", "words", "f.*")
    return both.groupBy("lexeme", "doc_id", "words").agg(F.sum("literal").alias("literal"), F.sum("stemmed").alias("stemmed"))


def build(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Write the postings by shard, in order of lexemes, so that a reader opens the shards of its words and skips other row groups.

    Texts are shuffled, once and in parts of bounded size, as they are far smaller than their postings, which each task sorts in memory.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = postings(docs.repartition(max(SPREAD, -(-chars // PART)), "doc_id")).withColumn("shard", shard(F.col("lexeme"), shards))
    rows.sortWithinPartitions("shard", "lexeme", "doc_id").write.partitionBy("shard").parquet(folder, compression="zstd")


_BUILT: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the documents of a folder, built once an application in the shared folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        folder = f"{shared_dir(spark)}/lexemes-{uuid.uuid4()}"
        build(table(spark, sf_dir, "documents"), folder)
        _BUILT[key] = folder
    schema = "lexeme string, doc_id long, words long, literal long, stemmed long, shard int"
    return spark.read.schema(schema).parquet(_BUILT[key])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The index of a folder if this application has built it."""
    return index(spark, sf_dir) if (spark.sparkContext.applicationId, sf_dir) in _BUILT else None


def asked(spark: SparkSession, words: str) -> tuple[list[str], list[str]]:
    """The different words of a query and the stems of those that are no stop words; any text will do."""
    row = spark.range(1).select(F.array_distinct(words_of(F.lit(words))).alias("w")).select("w", F.array_distinct(F.transform(F.filter("w", lambda x: ~x.isin(*STOP)), stem)).alias("s")).first()
    return sorted(row["w"]), sorted(row["s"])


def ranked(entries: DataFrame, words: str, k: int, allowed: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """doc_id, rank of the k documents (of those `allowed`, doc_id) that answer a query best, any of its words being enough.

    A word adds the sum of 1 / n ** 2 over its places, literal and stemmed ones alike; a form's rank is the mean over the
    query's words, and the better of both forms counts. Only postings of the words are read. A query of no words, or of
    stop words only, gives none.
    """
    spark = entries.sparkSession
    literal, stems = asked(spark, words)
    if not stems:
        return entries.select("doc_id", F.lit(0.0).alias("rank")).where("false")
    wanted = sorted({*literal, *stems})
    rows = entries.where(F.col("lexeme").isin(*wanted))
    if "shard" in entries.columns:
        shards = sorted({r[0] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(shard(F.col("w"), shards)).collect()})
        rows = rows.where(F.col("shard").isin(*shards))
    if allowed is not None:
        rows = rows.join(allowed, "doc_id", "left_semi")
    places = F.least(F.col("literal") + F.col("stemmed"), F.lit(PLACES).cast("long"))
    worth = F.aggregate(F.sequence(F.lit(1).cast("long"), places), F.lit(0.0), lambda s, n: s + 1.0 / (n * n))
    form = lambda of: F.sum(F.when(F.col("lexeme").isin(*of), worth).otherwise(0.0)) * (WEIGHT / ZETA / len(of))
    scored = rows.groupBy("doc_id").agg(F.round(F.greatest(form(literal), form(stems)), 8).alias("rank"))
    return scored.where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(k)


def postings_sql(source: str) -> str:
    """token, counted, stems and posting of a relation (doc_id, text), for the oracles."""
    return f"""token AS (SELECT doc_id, len(ws) AS words, unnest(ws) AS word FROM (SELECT doc_id, {words_sql("text")} AS ws FROM {source})),
 counted AS (SELECT doc_id, words, word, count(*) AS n FROM token GROUP BY ALL),
 stems AS (SELECT word, {stem_sql("word")} AS stem FROM (SELECT DISTINCT word FROM counted)),
 posting AS (SELECT lexeme, doc_id, words, CAST(sum(literal) AS BIGINT) AS literal, CAST(sum(stemmed) AS BIGINT) AS stemmed FROM (
  SELECT word AS lexeme, doc_id, words, n AS literal, 0 AS stemmed FROM counted UNION ALL
  SELECT stem, doc_id, words, 0, n FROM counted JOIN stems USING (word) WHERE word NOT IN {STOP}) GROUP BY ALL)"""


def ranked_sql(words: str) -> str:
    """doc_id, rank by `posting`, unordered."""
    literal = f"SELECT DISTINCT unnest({words_sql(repr(words))}) AS lexeme"
    stems = f"SELECT DISTINCT {stem_sql('lexeme')} AS lexeme FROM ({literal}) WHERE lexeme NOT IN {STOP}"
    worth = f"list_sum(list_transform(range(1, least(literal + stemmed, {PLACES}) + 1), lambda n: 1.0::DOUBLE / (n * n)))"
    form = lambda of: f"SELECT doc_id, sum({worth}) * ({WEIGHT / ZETA!r}::DOUBLE / (SELECT count(*) FROM ({of}))) AS r FROM posting WHERE lexeme IN ({of}) GROUP BY doc_id"
    return f"SELECT doc_id, round(max(r), 8) AS rank FROM ({form(literal)} UNION ALL {form(stems)}) GROUP BY doc_id"


@query("lexeme_index", f"WITH {postings_sql('documents')} SELECT * FROM posting")
def lexeme_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting of the stored index."""
    return index(spark, sf_dir).drop("shard")
