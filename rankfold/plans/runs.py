"""Queries of synchronisation, staged runs, look-ups and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.functions import answers as A
from rankfold.operators import pool as O
from rankfold.operators import runs as R
from rankfold.operators import sync as S
from rankfold.operators import vector as V
from rankfold.operators.ranking import r6
from rankfold.operators.scored import SCORED_SQL, raw, scored
from rankfold.plans.retrieval import _LISTS, _lists, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


#: requests of 20 documents each, replies of nine shapes, and what the replies should do
_SYNC = """, pend AS (SELECT * REPLACE (CASE WHEN query_idx % 5 <> 0 AND (query_idx * 31 + doc_id::BIGINT) % 50 < 25 THEN NULL ELSE llm_score END AS llm_score) FROM results),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY doc_id) - 1 AS n FROM pend),
rs AS (SELECT *, 'q' || query_idx || '_b' || lpad((n // 20 + 1)::VARCHAR, 8, '0') AS custom_id, (query_idx * 7 + n // 20 + 1) % 9 AS shape, (n % 20 * 3 + query_idx) % 11 AS v FROM rn),
sy AS (SELECT *, count(*) OVER w = count(llm_score) OVER w AS done, max(v) OVER w AS top FROM rs WINDOW w AS (PARTITION BY custom_id)),
af AS (SELECT query_idx, doc_id, custom_id, shape, done, CASE WHEN done OR shape IN (4, 5) THEN llm_score WHEN shape IN (3, 8) THEN 0.0 ELSE v / 10.0::DOUBLE END AS llm_score,
CASE WHEN shape IN (4, 5) THEN 'missing' WHEN done THEN 'succeeded' WHEN shape IN (3, 8) OR top = 0 THEN 'missing' ELSE 'succeeded' END AS status FROM sy)"""


def _replies(requests: DataFrame) -> DataFrame:
    """(seq, value): a reply to each request, of a shape by its number: three shapes of bodies, a block, none, no JSON, two replies, an object of scores, no scores."""
    scores = F.transform(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: (i * 3 + F.col("query_idx")) % 11)
    text = F.concat(F.lit("["), F.array_join(scores.cast("array<string>"), ", "), F.lit("]"))
    body = lambda t: F.to_json(F.struct(F.struct(F.struct(t.alias("text")).alias("body")).alias("response"), F.col("custom_id")))
    choices = F.array(F.struct(F.struct(text.alias("content")).alias("message")))
    part = F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content")))
    stop = F.array(F.struct(F.lit("SAFETY").alias("finish_reason")))
    under = lambda name, v, key: F.to_json(F.struct(F.struct(v.alias(name)).alias("response"), F.col("custom_id").alias(key)))
    shapes = [
        [body(text)], [under("choices", choices, "id")], [under("candidates", part, "key")], [under("candidates", stop, "key")], [], [F.concat(F.lit('{"response": '), F.col("custom_id"))],
        [body(text), body(F.lit("[10, 10, 10]"))], [body(F.concat(F.lit('{"scores": '), text, F.lit("}")))], [body(F.lit("no verdict"))],
    ]
    shape, given = (F.col("query_idx") * 7 + F.col("batch")) % 9, F.array().cast("array<string>")
    for i, s in enumerate(shapes):
        if s:
            given = F.when(shape == i, F.array(*s)).otherwise(given)
    return requests.select((F.col("query_idx") * 1_000_000 + F.col("batch") * 10).alias("first"), F.posexplode(given).alias("i", "value")).select((F.col("first") + F.col("i")).alias("seq"), "value")


def _synced(spark: SparkSession, sf_dir: str) -> S.Synced:
    open_ = (F.col("query_idx") % 5 != 0) & ((F.col("query_idx") * 31 + F.col("doc_id").cast("long")) % 50 < 25)
    results = scored(spark, sf_dir).withColumn("llm_score", F.when(~open_, F.col("llm_score")))
    rows = O.batches(results, 20).groupBy("query_idx", "batch").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))  # 20 at most
    requests = rows.withColumn("custom_id", F.format_string("q%d_b%08d", "query_idx", "batch")).withColumn("status", F.lit(S.SUBMITTED))
    return S.sync(results, requests.drop("batch"), _replies(requests))


@query(SCORED_SQL + _SYNC + " SELECT query_idx, count(*) AS n, count(llm_score) AS scored, round(sum(llm_score), 6) AS total FROM af GROUP BY 1")
def batch_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of nine shapes put into the results."""
    return _synced(spark, sf_dir).results.groupBy("query_idx").agg(F.count("*").alias("n"), F.count("llm_score").alias("scored"), r6(F.sum("llm_score")).alias("total"))


@query(SCORED_SQL + _SYNC + " SELECT DISTINCT custom_id, query_idx, status FROM af")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).requests.select("custom_id", "query_idx", "status")


@query(SCORED_SQL + _SYNC + """, u AS (SELECT custom_id, shape, done, count(*) AS n FROM af GROUP BY ALL)
SELECT sum(CASE shape WHEN 4 THEN 0 WHEN 6 THEN 2 ELSE 1 END)::BIGINT AS lines, count(*) FILTER (shape = 5) AS bad_lines,
sum(CASE WHEN shape IN (4, 5) THEN 0 WHEN done AND shape = 6 THEN 2 WHEN done OR shape = 6 THEN 1 ELSE 0 END)::BIGINT AS skipped, sum(CASE WHEN shape IN (4, 5) OR done THEN 0 ELSE n END)::BIGINT AS updated FROM u""")  # fmt: skip
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).counts


@query(SCORED_SQL + _LISTS + """, seen AS (SELECT query_idx, doc_id FROM raw WHERE llm_score = 0), st AS (SELECT 1 AS stage UNION ALL SELECT 2),
nd AS (SELECT (pool_pos - 1) // 250 + 1 AS stage, doc_id FROM gp UNION SELECT 1, gt_doc FROM truth),
sp AS (SELECT stage, query_idx, doc_id FROM nd JOIN st USING (stage), truth WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.query_idx = truth.query_idx AND s.doc_id = nd.doc_id))
SELECT stage::INT AS stage, query_idx, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM sp GROUP BY 1, 2""")
def stage_scoring_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query scores in the first two stages: the stage's part of the pool, all truths in the first, without pairs that are blocked already."""
    truths = scored(spark, sf_dir).filter("is_gt = 1").select("query_idx", "doc_id")
    pool, seen = O.global_pool(_lists(spark, sf_dir)), raw(spark, sf_dir).filter("llm_score = 0")
    parts = [R.stage_pairs(truths, pool, seen, n, 5).withColumn("stage", F.lit(n)) for n in (1, 2)]
    return parts[0].unionByName(parts[1]).groupBy("stage", "query_idx").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""SELECT a.vec_id AS q, b.vec_id AS d, round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity,
(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) DESC, b.vec_id))::INT AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label % 2 = 1 QUALIFY rank <= 5""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest among rows of odd labels for every row whose id is divisible by 50; the filter stands before the search."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d"), "embedding", "label")
    queries = rows.filter("d % 50 = 0").select(F.col("d").alias("q"), "embedding")
    return V.top_k_in_blocks(rows.filter("label % 2 = 1"), queries, 5, 50)


@query("""SELECT doc_id AS q, CASE WHEN doc_id % 3 = 2 THEN doc_id - 1 ELSE doc_id END AS d, CASE WHEN doc_id % 3 = 2 THEN 'PMID' ELSE 'own id' END AS matched FROM documents
WHERE doc_id % 3 <> 2 OR doc_id - 1 IN (SELECT doc_id FROM documents)""")
def id_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents looked up by id, every third by a key in its metadata."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    meta = F.create_map(F.lit("PMID"), F.concat(F.lit("P"), F.col("doc_id").cast("string")))
    asked = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit(" p"), (F.col("doc_id") - 1).cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return A.found_by_id(docs.select(F.col("doc_id").alias("q"), asked.alias("id")), docs.select(F.col("doc_id").alias("d"), meta.alias("meta")))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"


@query(f"""WITH r AS (SELECT a.conv_id AS q, b.turn AS place, b.text AS answer, len(list_intersect({_WORDS.format("a.text")}, {_WORDS.format("b.text")}))::DOUBLE / greatest(len({_WORDS.format("a.text")}), 1) AS score
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.role = 'assistant')
SELECT q, place, md5(answer) AS answer, round(score, 6) AS score, n FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY score DESC, place) AS r FROM r) WHERE r = 1""")
def best_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turn that shares most words with a conversation's first turn."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("turn = 0").select(F.col("conv_id").alias("q"), F.col("text").alias("question"))
    given = c.filter("role = 'assistant'").select(F.col("conv_id").alias("q"), F.col("turn").alias("place"), F.col("text").alias("answer"))
    return A.best_answer(asked.join(given, "q")).select("q", "place", F.md5("answer").alias("answer"), r6(F.col("score")).alias("score"), "n")


@query(SCORED_SQL + """ SELECT CASE WHEN rag_failed = 1 THEN 'bad' ELSE 'good' END AS queries, count(*) AS n, round(avg(llm_score), 6) AS mean, round(median(llm_score), 6) AS median,
round(stddev_pop(llm_score), 6) AS std, min(llm_score) AS min, max(llm_score) AS max FROM results WHERE is_gt = 1 GROUP BY 1""")
def entropy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the truths, of queries whose first document is the truth and of the others."""
    v = F.col("llm_score")
    stats = (F.count("*").alias("n"), r6(F.avg(v)).alias("mean"), r6(F.median(v)).alias("median"), r6(F.stddev_pop(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return scored(spark, sf_dir).filter("is_gt = 1").groupBy(F.when(F.col("rag_failed") == 1, "bad").otherwise("good").alias("queries")).agg(*stats)


@query("""WITH s AS (SELECT value AS v, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events WHERE event_type <> 'error')
SELECT least(9, floor((v - lo) / ((hi - lo) / 10)))::INT AS bin, count(*) AS n, round(avg(v), 6) AS avg, min(v) AS min, max(v) AS max FROM s GROUP BY 1""")
def logged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins over logged scores; records whose score is no number don't count."""
    logged = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("score"))
    rows = logged.select(F.col("score").try_cast("double").alias("v")).filter("v is not null")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))))  # one row
    bin_ = F.coalesce(F.least(F.lit(9), F.floor(F.try_divide(F.col("v") - F.col("lo"), (F.col("hi") - F.col("lo")) / 10))), F.lit(0)).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("v")).alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"))


@query("""WITH s AS (SELECT user_id % 20 AS combination, 100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*) AS success, count(*) / (epoch(max(ts)) - epoch(min(ts))) AS rate FROM events GROUP BY 1)
SELECT combination, round(success, 6) AS success, round(rate, 9) AS rate, (row_number() OVER (ORDER BY success DESC, rate DESC, combination))::INT AS place FROM s""")
def benchmark_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a benchmark by their share of calls that succeed, then by calls a second; a few settings by design."""
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    calls = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("combination"))
    rows = calls.agg((100.0 * F.count_if(F.col("event_type") != "error") / F.count("*")).alias("s"), (F.count("*") / (F.max(sec) - F.min(sec))).alias("t"))
    place = F.row_number().over(Window.orderBy(F.desc("s"), F.desc("t"), "combination"))
    return rows.select("combination", r6(F.col("s")).alias("success"), F.round("t", 9).alias("rate"), place.alias("place"))


@query(SCORED_SQL + """, k AS (SELECT query_idx, (query_idx - 1) // 25 + 1 AS chunk FROM truth)
SELECT chunk::BIGINT AS chunk, count(*) AS n, min(query_idx) AS first, max(query_idx) AS last FROM k GROUP BY 1""")
def query_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in chunks of 25 for submission."""
    rows = scored(spark, sf_dir).filter("is_gt = 1").select("query_idx")
    chunk = (F.floor((F.col("query_idx") - 1) / 25) + 1).cast("long")
    return rows.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.min("query_idx").alias("first"), F.max("query_idx").alias("last"))
