"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown, centroids, jaccard, licences, mixing, neighbours, quality, repeats, runs, sharding, toxicity, webp
from .common import read


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of all documents by the law `rows`; nulls have size 8 and ties of a curve's cell are told apart by the id."""
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 24)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; a null source is one, a text without words takes none."""
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and what they decode to; a null text has none."""
    return bpe.token_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text that a string of 100 bytes covers which also starts earlier; rows that share an id are texts in an order of their own."""
    return repeats.repeat_report(read(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every whole text; null and empty texts have no words."""
    return licences.scan(read(spark, sf_dir, "documents"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether its language's threshold keeps it; texts too short for the model are kept."""
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three words are 90 % alike; texts without words are linked with nothing."""
    return jaccard.similar_groups(read(spark, sf_dir, "documents"), 3, 90)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each query; vectors that are null, zero or not finite take no part, ties go to the smaller id."""
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op9_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as lossless images and read back; a null text is an empty one, equal texts give equal values."""
    return webp.media_report(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, learnt from two thirds of the labelled ones; empty texts are scored too."""
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text by classes of words, learnt from six sevenths; a null text is its end token alone."""
    return brown.score(read(spark, sf_dir, "documents"))


def op12_centroid_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector that takes part, after five rounds and a last assignment."""
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, every tenth document being made periodic first; without words or text none."""
    return runs.run_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_mix_sources": op2_mix_sources,
    "op3_bpe": op3_bpe,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_licence_scan": op5_licence_scan,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_webp_media": op9_webp_media,
    "op10_toxicity": op10_toxicity,
    "op11_brown_score": op11_brown_score,
    "op12_centroid_filtering": op12_centroid_filtering,
    "op13_periodic_runs": op13_periodic_runs,
}
_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _lloyd_sql(k: int, rounds: int) -> str:
    """Every vector against every centroid, in every round."""
    far = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = f"SELECT r, vec_id, v, min(n) % {k} AS c, CAST(min(n) // {k} AS BIGINT) AS d FROM (SELECT k.r, k.vec_id, k.v, CAST({far} AS BIGINT) * {k} + c.c AS n FROM kept k, {{}} c) GROUP BY r, vec_id, v"
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({near.format(f'c{i}')})",
            f"m{i} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY place) AS v FROM (SELECT c, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY c, place) GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)",
        ]
    told = "CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256"
    return f"WITH {', '.join(parts)}, z AS ({near.format(f'c{rounds}')}) SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, d AS distance, {told} FROM z JOIN c{rounds} c ON c.c = z.c"


#: By brute force: every string of 100 bytes, and every pair of documents with a shingle in common. Ids are unique in the tables.
ORACLES: dict[str, str] = {
    "op4_suffix_repeats": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
 c AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
 i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM c),
 g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
 s AS (SELECT doc_id, run, min(p) AS first, max(p) + 100 AS stop FROM g GROUP BY doc_id, run),
 b AS (SELECT doc_id, run, first, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS before FROM s),
 k AS (SELECT d.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) || substring(any_value(h), 2 * max(stop) + 1) AS kept, count(*) AS n_spans, sum(stop - first) AS n_removed FROM b JOIN d ON d.doc_id = b.doc_id GROUP BY d.doc_id)
 SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op7_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UP}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
 e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
 r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id""",
    "op12_centroid_filtering": _lloyd_sql(40, 5),
    # every pair of equal stretches of eight words in a document
    "op13_periodic_runs": r"""WITH k AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own,
  xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
   lambda r, x: CASE WHEN xor(r, x) & 1 = 1 THEN xor(xor(r, x) >> 1, 3988292384::UBIGINT) ELSE xor(r, x) >> 1 END), 4294967295::UBIGINT) AS h FROM documents),
 p AS (SELECT *, CAST(h // 10 % greatest(len(own), 1) AS BIGINT) AS a, CAST(3 + h // 10 % 8 AS BIGINT) AS parts FROM k),
 d AS (SELECT doc_id, len(own) AS n, CASE WHEN h % 10 = 0 AND len(own) > 0 THEN list_transform(range(0, len(own)), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(own) - a) // parts) END]) ELSE own END AS ws FROM p),
 g AS (SELECT doc_id, n, i, md5_number(array_to_string(ws[i + 1:i + 8], ' ')) AS gram FROM (SELECT *, unnest(range(0, n - 7)) AS i FROM d)),
 e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON b.doc_id = a.doc_id AND b.gram = a.gram AND b.i > a.i WHERE 3 * (b.i - a.i) <= a.n),
 s AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
 r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
 t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
  first({'start': start, 'length': length, 'period': period} ORDER BY CAST(length AS DECIMAL(18, 0)) / period DESC, start, period) AS best FROM r GROUP BY doc_id),
 x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
 y AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
 z AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(0, n)) AS i FROM d) w ANTI JOIN x ON x.doc_id = w.doc_id AND x.i = w.i GROUP BY w.doc_id)
 SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id""",
}
