"""What is read out of model answers, and what is put into prompts: citations, refusals, SQL, JSON, routes, costs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import table

#: The refusal that answers are searched for, the marker of an unanswerable question, words of a question with several steps.
REFUSAL = "I don't have enough information to answer that."
UNANSWERABLE = "UNANSWERABLE"
MULTI_STEP = r"\b(and also|as well as|compare|versus|vs\.?|then|both|how many .* and|why was|why did|what caused)\b"
#: Price in USD of a million tokens, of the prompt and of the completion.
PRICES = {"gpt-4.1-mini": (0.40, 1.60), "gpt-4.1": (2.00, 8.00), "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00)}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cited(text: Column, hits: int) -> tuple[Column, Column, Column]:
    """The text without citations [n] of sources that were not among the `hits`; the sources cited, and those invented."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    inside = lambda n: n.between(1, hits)
    kept, invented = F.array_sort(F.array_distinct(F.filter(found, inside))), F.array_sort(F.array_distinct(F.filter(found, lambda n: ~inside(n))))
    clean = F.aggregate(invented, text, lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]"))))
    return stripped(F.regexp_replace(F.regexp_replace(clean, " {2,}", " "), r"\s+([.,;:])", "$1")), kept, invented


_MARKED_SQL = "text || ' [1][' || (conv_id % 9) || '] as in [' || (conv_id % 5 + 1) || '] .'"


@query("citations", rf"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '\[(0|[6-9])\]', '', 'g'), ' {{2,}}', ' ', 'g'), '\s+([.,;:])', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5, array_to_string(list_sort(list_distinct(list_filter([1, conv_id % 9, conv_id % 5 + 1], lambda n: n BETWEEN 1 AND 5))), ',') AS kept, CASE WHEN conv_id % 9 BETWEEN 1 AND 5 THEN '' ELSE CAST(conv_id % 9 AS VARCHAR) END AS invented FROM (SELECT conv_id, turn, {_MARKED_SQL} AS m FROM conversations WHERE role = 'assistant')")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with derived markers, of which five sources exist."""
    marked = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(_MARKED_SQL).alias("m"))
    clean, kept, invented = cited(F.col("m"), 5)
    return marked.select("conv_id", "turn", F.md5(clean).alias("clean_md5"), F.array_join(kept, ",").alias("kept"), F.array_join(invented, ",").alias("invented"))


_ANSWER_SQL = "CASE WHEN conv_id % 10 = 0 THEN text || ' Sorry, i DON''T have enough information to answer that.' ELSE text END"


@query("refusal_flag", f"SELECT conv_id, turn, contains(lower({_ANSWER_SQL}), 'i don''t have enough information to answer that.') AS refused FROM conversations")
def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.contains(F.lower(F.expr(_ANSWER_SQL.replace("''", "\\'"))), F.lit(REFUSAL.lower())).alias("refused"))


def sql_of(answer: Column) -> Column:
    """The statement of an answer: what is fenced, else all, from the first SELECT or WITH; null if there is none, or the answer says it can't be answered."""
    fenced = F.regexp_extract(answer, r"(?is)```(?:sql)?\s*(.+?)\s*```", 1)
    whole = stripped(F.when(fenced != "", fenced).otherwise(answer))
    from_word = F.regexp_replace(whole, r"(?is)^.*?(?=select|with)", "")
    statement = F.regexp_replace(F.regexp_replace(from_word, r"\s+$", ""), ";+$", "")
    return F.when(~F.contains(F.upper(answer), F.lit(UNANSWERABLE)) & (statement != ""), statement)


_REPLY_SQL = "CASE conv_id % 4 WHEN 0 THEN 'Here: ```sql' || chr(10) || 'SELECT ' || turn || ';' || chr(10) || '``` done' WHEN 1 THEN 'Sure. Select ' || turn || ' AS a ; ' WHEN 2 THEN 'SELECT ''unanswerable''' ELSE ' just words;; ' END"


@query("sql_extract", "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'SELECT ' || turn WHEN 1 THEN 'Select ' || turn || ' AS a ' WHEN 3 THEN 'just words' END AS statement FROM conversations")
def sql_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sql_of(F.expr(_REPLY_SQL.replace("''", "\\'"))).alias("statement"))


@query("route_agent", rf"SELECT conv_id, turn, regexp_matches(q, '(?i){MULTI_STEP}') OR length(q) - length(replace(q, '?', '')) > 1 AS agent FROM (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Compare ' || turn WHEN 1 THEN 'what? and why?' WHEN 2 THEN 'How MANY rows and sums' WHEN 3 THEN 'strengthen this?' ELSE 'who did it' END AS q FROM conversations)")
def route_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question needs the agent: several steps by its words, or more than one question mark."""
    q = F.expr("CASE conv_id % 5 WHEN 0 THEN concat('Compare ', turn) WHEN 1 THEN 'what? and why?' WHEN 2 THEN 'How MANY rows and sums' WHEN 3 THEN 'strengthen this?' ELSE 'who did it' END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.rlike(q, F.lit(f"(?i){MULTI_STEP}")) | (F.length(q) - F.length(F.replace(q, F.lit("?"))) > 1)).alias("agent"))


def first_object(answer: str | None) -> str | None:
    """The JSON object that starts at the first brace, written compactly; null if that is none."""
    fence = (answer or "").split("```")
    text = fence[1].removeprefix("json") if len(fence) > 2 and fence[1].strip() else answer or ""
    at = text.find("{")
    try:
        found = json.JSONDecoder().raw_decode(text, at)[0] if at >= 0 else None
    except ValueError:
        found = None
    return json.dumps(found, separators=(",", ":"), ensure_ascii=False) if isinstance(found, dict) else None


def json_object(answer: Column) -> Column:
    """`first_object` of each answer; braces inside strings need a parser, so this is a pandas UDF."""
    return F.pandas_udf("string")(lambda answers: answers.map(first_object))(answer)


@query("extract_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS object FROM events")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_object(F.concat(F.lit("Sure, here: "), "props", F.lit(" and more }"))).alias("object"))


_MODELS = [*PRICES, "unknown"]
_USAGE_SQL = f"SELECT conv_id, turn, CASE conv_id % 5 {' '.join(f'WHEN {k} THEN {m!r}' for k, m in enumerate(_MODELS))} END AS model, coalesce(length(text), 0) AS prompt_tokens, turn * 100 AS completion_tokens FROM conversations"


@query("llm_cost", f"SELECT model, count(*) AS calls, round(sum(CASE model {' '.join(f'WHEN {m!r} THEN prompt_tokens * {p}::DOUBLE + completion_tokens * {c}::DOUBLE' for m, (p, c) in PRICES.items())} ELSE 0 END / 1000000), 6) AS usd FROM ({_USAGE_SQL}) GROUP BY model")
def llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by model from a fixed price table; a model without a price costs nothing."""
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("conv_id") % 5 + 1).cast("int"))
    usage = table(spark, sf_dir, "conversations").select(model.alias("model"), F.coalesce(F.length("text"), F.lit(0)).alias("prompt"), (F.col("turn") * 100).alias("completion"))
    price = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for m, p in PRICES.items() for v in (m, p[k])]), F.col("model")), F.lit(0.0))
    return usage.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt").alias("p"), F.sum("completion").alias("c")).select("model", "calls", F.round((F.col("p") * price(0) + F.col("c") * price(1)) / 1000000, 6).alias("usd"))


@query("context_pack", "WITH r AS (SELECT source, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, sha256(string_agg('[' || r || '] ' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY r)) AS context_hash, count(*) AS sources FROM r WHERE r <= 3 GROUP BY source")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sources with their titles, in order of rank: the prompt's context. Ranks are taken on ids, so that only three texts a group move."""
    docs = table(spark, sf_dir, "documents")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = docs.select("source", "doc_id", "n_chars").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "doc_id", "r")
    # three rows a group, and groups are few beside documents; adaptive execution picks the join
    found = docs.select("doc_id", "source", "text").join(top, ["doc_id", "source"])
    packed = found.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("r", "doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("["), p["r"].cast("string"), F.lit("] "), p["doc_id"].cast("string"), F.lit("\n"), p["text"])), "\n\n")
    return packed.select("source", F.sha2(joined, 256).alias("context_hash"), F.size("parts").cast("long").alias("sources"))


_CASE_SQL = "SELECT CASE conv_id % 4 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'database' WHEN 2 THEN 'both' ELSE 'refusal' END AS kind, turn, conv_id FROM conversations"


@query("tool_accuracy", f"SELECT kind, count(*) AS n, round(avg(CASE WHEN CASE kind WHEN 'refusal' THEN turn % 7 <> 0 WHEN 'both' THEN turn % 3 = 2 WHEN 'database' THEN turn % 3 = 1 ELSE turn % 3 = 0 END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_CASE_SQL}) GROUP BY kind")
def tool_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool selection by kind of question: the set of tools called must be the set expected; refusals must be refused."""
    called = F.when(F.col("turn") % 3 == 0, F.array(F.lit("search"))).when(F.col("turn") % 3 == 1, F.array(F.lit("sql"), F.lit("sql"))).otherwise(F.array(F.lit("sql"), F.lit("search")))
    wanted = F.when(F.col("kind") == "knowledge", F.array(F.lit("search"))).when(F.col("kind") == "database", F.array(F.lit("sql"))).otherwise(F.array(F.lit("search"), F.lit("sql")))
    kind = F.element_at(F.array(*map(F.lit, ("knowledge", "database", "both", "refusal"))), (F.col("conv_id") % 4 + 1).cast("int"))
    cases = table(spark, sf_dir, "conversations").select(kind.alias("kind"), "turn")
    right = F.when(F.col("kind") == "refusal", F.col("turn") % 7 != 0).otherwise(F.array_sort(F.array_distinct(called)) == wanted)
    return cases.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


@query("string_join", "SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " | ").alias("names"))


_DIGITS_SQL = "list_transform(range(1, 17), lambda i: CAST(substring(n, CAST(17 - i AS BIGINT), 1) AS BIGINT))"


@query("luhn", f"SELECT event_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN d[i] WHEN d[i] > 4 THEN 2 * d[i] - 9 ELSE 2 * d[i] END)) % 10 = 0 AS valid FROM (SELECT event_id, {_DIGITS_SQL} AS d FROM (SELECT event_id, '4' || lpad(CAST(event_id * 7919 % 1000000007 AS VARCHAR), 15, '0') AS n FROM events))")
def luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers (derived from ids, written with separators) that pass the checksum and have 13 digits or more."""
    number = F.concat(F.lit("4"), F.lpad((F.col("event_id") * 7919 % 1000000007).cast("string"), 15, "0"))
    spaced = table(spark, sf_dir, "events").select("event_id", F.regexp_replace(number, "(.{4})", "$1 ").alias("card"))
    digits = F.regexp_replace("card", "[^0-9]", "")
    return spaced.select("event_id", ((F.length(digits) >= 13) & F.call_function("luhn_check", digits)).alias("valid"))


@query("backoff_jitter", "SELECT l_orderkey, l_linenumber, least(0.5 * power(2, l_linenumber - 1), 8.0) * ((l_orderkey * 31 + l_linenumber) % 1000 / 1000.0) AS seconds FROM lineitem")
def backoff_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits spread over [0, bound) by the call's own numbers, so that a rerun waits the same."""
    bound = F.least(0.5 * F.pow(F.lit(2), F.col("l_linenumber") - 1), F.lit(8.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (bound * ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 1000 / 1000.0)).alias("seconds"))
