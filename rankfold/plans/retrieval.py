"""Queries of retrieval, pools, parsing, synchronisation and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.functions import parsing as P
from rankfold.operators import pool as O
from rankfold.operators import vector as V
from rankfold.operators.ranking import r6
from rankfold.operators.scored import N_QUERIES, SCORED_SQL, corpus, query_set, raw, scored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT q, d, s AS similarity, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS d,
round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE r <= 10""")
def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all rows, itself too, for every row whose id is divisible by 50; queries in blocks of MOST_QUERIES ids."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q"), "embedding")
    return V.top_k_in_blocks(rows.select(F.col("vec_id").alias("d"), "embedding"), queries, 10, 50)


@query(SCORED_SQL + " SELECT q, d, s, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM sim WHERE s >= 0.2) WHERE r <= 5")
def threshold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = V.top_k(corpus(spark, sf_dir), query_set(spark, sf_dir), 5)
    return near.select("q", "d", F.col("similarity").alias("s"), F.col("rank").alias("r")).filter("s >= 0.2")


@query(SCORED_SQL + """ SELECT q, d, round(list_cosine_similarity(qv.e, dv.e), 6) + 0.0 AS cosine, round(list_inner_product(qv.e, dv.e), 6) + 0.0 AS dot, round(list_distance(qv.e, dv.e), 6) AS l2,
round(1 / (1 + list_distance(qv.e, dv.e)), 6) AS euclidean, round(1 - list_cosine_similarity(qv.e, dv.e), 6) AS cosine_distance, round(-list_inner_product(qv.e, dv.e), 6) + 0.0 AS ip FROM qv, dv""")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every query of the stated set and every corpus row; tasks hold the queries, the corpus is not shuffled."""
    a = query_set(spark, sf_dir).select("q", F.col("embedding").alias("a"))
    b = corpus(spark, sf_dir).select("d", F.col("embedding").alias("b"))
    m = {n: r6(V.metric(k)(F.col("a"), F.col("b"))) for n, k in (("dot", "dot"), ("l2", "l2"), ("euclidean", "euclidean"), ("cosine_distance", "cosine"), ("ip", "ip"))}
    return b.crossJoin(F.broadcast(a)).select("q", "d", r6(V.cosine(F.col("a"), F.col("b"))).alias("cosine"), *(c.alias(n) for n, c in m.items()))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(V.norm(e)).alias("norm"), r6(V.norm(V.unit(e))).alias("unit_norm"))


#: noise levels and runs of the noise experiment
EPSILONS, RUNS = (0.0, 0.001, 0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 1.0), 5
#: two numbers from 0 to 1 of a query, place and run, for a normal one
_U, _W = "((q * 1009 + i * 9176 + run * 31337 + 17) % 7919 + 0.5::DOUBLE) / 7919", "((q * 2003 + i * 7529 + run * 15485 + 5) % 6007 + 0.5::DOUBLE) / 6007"


def _noise(keys: list, width: int, run: int) -> np.ndarray:
    """Standard normal numbers from hashed ones, the same at each run of the query."""
    q, i = np.array(keys, np.int64)[:, None], np.arange(width)
    u, w = ((q * 1009 + i * 9176 + run * 31337 + 17) % 7919 + 0.5) / 7919, ((q * 2003 + i * 7529 + run * 15485 + 5) % 6007 + 0.5) / 6007
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * w)


_NOISE = SCORED_SQL + f""", ep AS (SELECT unnest([{", ".join(f"{e}::DOUBLE" for e in EPSILONS)}]) AS eps), rn AS (SELECT unnest(range(0, {RUNS})) AS run),
nz AS (SELECT q, eps, run, list_transform(range(0, len(e)), lambda i: e[i + 1] / sqrt(list_inner_product(e, e)) + eps * sqrt(-2 * ln({_U})) * cos(2 * pi() * {_W})) AS e FROM qv, ep, rn),
t0 AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM sim QUALIFY r <= 10),
t1 AS (SELECT q, eps, run, d, row_number() OVER (PARTITION BY q, eps, run ORDER BY round(list_cosine_similarity(nz.e, dv.e), 6) DESC, d) AS r FROM nz, dv QUALIFY r <= 10),
nc AS (SELECT t1.q, eps, run, count(*) FILTER (t0.d <> t1.d) AS n FROM t1 JOIN t0 ON t0.q = t1.q AND t0.r = t1.r GROUP BY 1, 2, 3)
"""


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, epsilon, run, n): how many of the ten nearest change their place as noise is added to the unit query."""
    docs, qs = corpus(spark, sf_dir), query_set(spark, sf_dir)
    keys, m = V.query_matrix(qs, "q", "embedding")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sets = [(eps, run) for eps in EPSILONS for run in range(RUNS)]
    noisy = np.concatenate([unit + eps * _noise(keys, m.shape[1], run) for eps, run in sets])
    ids = [s * N_QUERIES + k for s in range(len(sets)) for k in keys]
    near = V.block_cosine(docs, ids, noisy, top=10).withColumn("similarity", F.round("s1", 6))
    near = O.first_ranked(near, "q", [F.desc("similarity"), "d"], 10)
    near = near.withColumn("set", F.floor(F.col("q") / N_QUERIES)).withColumn("q", F.col("q") % N_QUERIES)
    base = V.top_k(docs, qs, 10).select("q", F.col("d").alias("d0"), F.col("rank").alias("r"))
    eps = F.get(F.array(*map(F.lit, EPSILONS)), F.floor(F.col("set") / RUNS).cast("int"))
    changed = near.join(base, ["q", "r"]).groupBy("q", "set").agg(F.count_if(F.col("d") != F.col("d0")).alias("n"))
    return changed.select("q", eps.alias("epsilon"), (F.col("set") % RUNS).alias("run"), "n")


@query(_NOISE + "SELECT eps AS epsilon, round(avg(n), 6) AS mean_changed, round(avg(n / 10.0::DOUBLE), 6) AS mean_percent FROM nc GROUP BY eps")
def noise_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).groupBy("epsilon").agg(r6(F.avg("n")).alias("mean_changed"), r6(F.avg(F.col("n") / 10)).alias("mean_percent"))


@query(_NOISE + "SELECT q, eps AS epsilon, round(avg(n), 6) AS mean_changed, round(avg(n / 10.0::DOUBLE), 6) AS mean_percent FROM nc GROUP BY q, eps")
def noise_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).groupBy("q", "epsilon").agg(r6(F.avg("n")).alias("mean_changed"), r6(F.avg(F.col("n") / 10)).alias("mean_percent"))


@query(SCORED_SQL + """, n5 AS (SELECT q, d, s FROM sim QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) <= 5),
w AS (SELECT n5.*, exp(s - max(s) OVER (PARTITION BY q)) AS w FROM n5),
x AS (SELECT q, w, unnest(e) AS x, unnest(range(0, len(e))) AS pos FROM w JOIN dv USING (d))
SELECT q, pos::INT AS pos, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM x GROUP BY q, pos""")
def softmax_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    near = V.top_k(docs, query_set(spark, sf_dir), 5).select("q", "d", F.col("similarity").alias("score"))
    return V.weighted_centroid(near.join(docs, "d")).select("q", "pos", r6(F.col("x")).alias("x"))


@query("SELECT vec_id FROM embeddings ORDER BY (vec_id * 48271 + 11) % 2147483647, vec_id LIMIT 100")
def document_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id").orderBy((F.col("vec_id") * 48271 + 11) % 2147483647, "vec_id").limit(100)


@query()
def farthest_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.anchors(corpus(spark, sf_dir), 4)


@query()
def trilateration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative retrieval for each query of the stated set, scored by similarity."""
    docs, qs = corpus(spark, sf_dir), query_set(spark, sf_dir).select("q", F.col("embedding").alias("qe"))
    start = [r["d"] for r in V.anchors(docs, 4).collect()]
    score = (1 + V.cosine(F.col("embedding"), F.col("qe"))) / 2
    ids = [r["q"] for r in qs.select("q").orderBy("q").limit(V.MOST_QUERIES + 1).collect()]
    return V.trilateration_searches(docs, ids, start, lambda rows: rows.join(F.broadcast(qs), "q").select("q", "d", score.alias("score")))


_LISTS = """, ng AS (SELECT query_idx, doc_id, row_number() OVER (PARTITION BY query_idx ORDER BY dist_to_gt, doc_id::BIGINT) AS r FROM results WHERE is_gt = 0 QUALIFY r <= 20),
nq AS (SELECT q + 1 AS query_idx, d::VARCHAR AS doc_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM sim QUALIFY r <= 20),
fo AS (SELECT query_idx, doc_id, min(o) AS o FROM (SELECT query_idx, doc_id, 2 * (r - 1) AS o FROM ng UNION ALL SELECT query_idx, doc_id, 2 * (r - 1) + 1 FROM nq) GROUP BY 1, 2),
il AS (SELECT query_idx, doc_id, row_number() OVER (PARTITION BY query_idx ORDER BY o) AS pos FROM fo),
gp AS (SELECT doc_id, row_number() OVER (ORDER BY f.pos, f.query_idx) AS pool_pos FROM (SELECT doc_id, min({'pos': pos, 'query_idx': query_idx}) AS f FROM il GROUP BY doc_id))
"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_truth = O.first_ranked(scored(spark, sf_dir).filter("is_gt = 0"), "query_idx", ["dist_to_gt", F.col("doc_id").cast("long")], 20)
    near = V.top_k(corpus(spark, sf_dir), query_set(spark, sf_dir), 20)
    return O.interleaved(by_truth, near.select((F.col("q") + 1).alias("query_idx"), F.col("d").cast("string").alias("doc_id"), F.col("rank").alias("r")))


@query(SCORED_SQL + _LISTS + "SELECT query_idx, doc_id, pos::INT AS pos FROM il")
def interleaved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir)


@query(SCORED_SQL + _LISTS + "SELECT doc_id, pool_pos, ((pool_pos - 1) // (5 * 50) + 1)::BIGINT AS stage FROM gp")
def staged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.global_pool(_lists(spark, sf_dir)).withColumn("stage", O.stage(F.col("pool_pos"), 5, N_QUERIES))


@query(SCORED_SQL + _LISTS + """SELECT query_idx, batch, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT p.query_idx, p.doc_id,
(row_number() OVER (PARTITION BY p.query_idx ORDER BY p.doc_id) - 1) // 20 + 1 AS batch FROM (SELECT query_idx, gp.doc_id FROM truth, gp) p
WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.query_idx = p.query_idx AND r.doc_id = p.doc_id AND r.llm_score <> 0)) GROUP BY 1, 2""")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the pairs of every query and the pool that have no score yet; the queries are a stated set."""
    queries = F.broadcast(scored(spark, sf_dir).filter("is_gt = 1").select("query_idx").distinct())
    pairs = O.global_pool(_lists(spark, sf_dir)).select("doc_id").crossJoin(queries)
    todo = O.batches(O.unscored(pairs, raw(spark, sf_dir), zeros=True), 20)
    return todo.groupBy("query_idx", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(SCORED_SQL + " SELECT query_idx, doc_id FROM results QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY doc_id) <= 40")
def pilot_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_ranked(scored(spark, sf_dir).select("query_idx", "doc_id"), "query_idx", ["doc_id"], 40).drop("r")


_REQUESTS = """, rq AS (SELECT 'q' || query_idx || '_b' || lpad(b::VARCHAR, 8, '0') AS custom_id, query_idx, b, doc_id, llm_score FROM (SELECT *,
(row_number() OVER (PARTITION BY query_idx ORDER BY doc_id) - 1) // 20 + 1 AS b FROM raw))"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.batches(raw(spark, sf_dir), 20).withColumn("custom_id", F.format_string("q%d_b%08d", "query_idx", "batch"))
    return rows.groupBy("custom_id", "query_idx").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")).withColumn("status", F.lit("succeeded"))


@query(SCORED_SQL + _REQUESTS + " SELECT custom_id, query_idx, count(*)::INT AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM rq GROUP BY 1, 2")
def request_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("custom_id", "query_idx", F.size("doc_ids").alias("n"), F.array_join("doc_ids", ",").alias("doc_ids"))


@query(SCORED_SQL + _REQUESTS + " SELECT custom_id FROM rq GROUP BY 1 HAVING bool_or(coalesce(llm_score, 0) = 0)")
def retry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.retry_set(_requests(spark, sf_dir), raw(spark, sf_dir))


@query(SCORED_SQL + """ SELECT query_idx, count(*) AS n, count(llm_score) AS scored, round(sum(llm_score), 6) AS total FROM (SELECT query_idx, CASE WHEN coalesce(llm_score, 0) = 0 AND query_idx % 2 = 0
THEN (doc_id::BIGINT % 10 + 1) / 10.0::DOUBLE ELSE llm_score END AS llm_score FROM raw) GROUP BY 1""")
def synced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to open pairs of even queries, each sent twice; the last stands."""
    r = raw(spark, sf_dir)
    todo = r.filter((F.coalesce("llm_score", F.lit(0.0)) == 0) & (F.col("query_idx") % 2 == 0))
    reply = P.single_score(F.concat(F.lit("Score: "), (F.col("doc_id").cast("long") % 10 + 1).cast("string")))
    new = todo.select("query_idx", "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), reply.alias("s")).withColumn("new_score", F.when(F.col("seq") == 2, F.col("s")).otherwise(0.3))
    out = O.update_scores(r, new)
    return out.groupBy("query_idx").agg(F.count("*").alias("n"), F.count("llm_score").alias("scored"), r6(F.sum("llm_score")).alias("total"))


@query(SCORED_SQL + """ SELECT query_idx, '[' || (query_idx % 14) || ', ' || (query_idx % 7) || ']' AS reply, least(10, query_idx % 14) || ' ' || (query_idx % 7) || ' 0' AS scores,
(CASE WHEN query_idx % 14 BETWEEN 1 AND 10 THEN query_idx % 14 WHEN query_idx % 7 BETWEEN 1 AND 10 THEN query_idx % 7 ELSE 0 END) / 10.0::DOUBLE AS first_score FROM truth""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query_idx")
    rows = scored(spark, sf_dir).filter("is_gt = 1").select("query_idx", F.concat(F.lit("["), (q % 14).cast("string"), F.lit(", "), (q % 7).cast("string"), F.lit("]")).alias("reply"))
    return rows.select("query_idx", "reply", F.array_join(P.parse_scores(F.col("reply"), 3).cast("array<string>"), " ").alias("scores"), P.single_score(F.col("reply")).alias("first_score"))


_PUNCT = P.PUNCTUATION.replace("'", "''")


@query(f"SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), '{_PUNCT}', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS normal FROM documents")
def normalised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of every language."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.norm_text(F.col("text"))).alias("normal"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...[truncated]' ELSE text END) AS cut, length(text) > 500 AS was_cut FROM documents")
def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.truncated(F.col("text"))).alias("cut"), (F.length("text") > 500).alias("was_cut"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS ws FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.ws, b.ws))::DOUBLE / greatest(len(a.ws), 1), 6) AS overlap FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    b = c.select(F.col("conv_id").alias("cid"), F.col("turn").alias("t"), F.col("text").alias("answer"))
    return c.join(b, (F.col("conv_id") == F.col("cid")) & (F.col("t") == F.col("turn") + 1)).select("conv_id", "turn", r6(P.word_overlap(F.col("text"), F.col("answer"))).alias("overlap"))


@query(r"""SELECT CASE WHEN regexp_matches(url, '^\w+:\w+$') THEN 'huggingface_dataset_with_config' WHEN regexp_matches(url, '^\w+$') THEN 'huggingface_dataset'
WHEN regexp_matches(url, '^https?://[^/]+/.*') THEN 'url' ELSE 'invalid' END AS kind, count(*) AS n FROM pages GROUP BY 1""")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(P.source_type(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS operation, count(*) AS count, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 4) AS total FROM events GROUP BY 1")
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("count"), r6(F.avg(v)).alias("avg"), r6(F.min(v)).alias("min"), r6(F.max(v)).alias("max"), F.round(F.sum(v), 4).alias("total"))


def _verdict_sql(m: str) -> str:
    return f"""CASE WHEN abs(b.{m} - a.{m}) < 0.001 OR (abs(b.{m} - a.{m}) < 0.01 AND abs(b.{m} - a.{m}) / greatest(abs(a.{m}), abs(b.{m}), 1e-6) < 0.05) THEN 'Tie'
WHEN b.{m} > a.{m} THEN 'Optimized' ELSE 'Original' END"""


@query(SCORED_SQL + f""", m AS (SELECT q, d, list_cosine_similarity(qv.e, dv.e) AS c, list_inner_product(qv.e, dv.e) AS i, 1 / (1 + list_distance(qv.e, dv.e)) AS u FROM qv JOIN dv ON dv.d IN (50 + qv.q, 51 + qv.q)),
v AS (SELECT a.q + 1 AS query_idx, {_verdict_sql("c")} AS cosine, {_verdict_sql("i")} AS dot, {_verdict_sql("u")} AS euclidean FROM m a JOIN m b ON a.q = b.q AND b.d = a.d + 1 WHERE a.d = 50 + a.q),
n AS (SELECT *, (cosine = 'Original')::INT + (dot = 'Original')::INT + (euclidean = 'Original')::INT AS r, (cosine = 'Optimized')::INT + (dot = 'Optimized')::INT + (euclidean = 'Optimized')::INT AS o,
(cosine = 'Tie')::INT + (dot = 'Tie')::INT + (euclidean = 'Tie')::INT AS t FROM v)
SELECT query_idx, cosine, dot, euclidean, CASE WHEN r >= o AND r >= t THEN 'Original' WHEN o >= t THEN 'Optimized' ELSE 'Tie' END AS agreed, round(greatest(r, o, t) / 3.0::DOUBLE, 6) AS confidence FROM n""")
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidate answers for each query, compared by three similarities and voted on."""
    docs = corpus(spark, sf_dir).select("d", "embedding")
    a, b = docs.select("d", F.col("embedding").alias("a")), docs.select((F.col("d") - 1).alias("d"), F.col("embedding").alias("b"))
    qs = query_set(spark, sf_dir).select("q", F.col("embedding").alias("e"))
    rows = qs.join(a, F.col("d") == F.col("q") + 50).join(b, "d")
    votes = {n: P.verdict(f(F.col("e"), F.col("a")), f(F.col("e"), F.col("b"))) for n, f in (("cosine", V.cosine), ("dot", V.dot), ("euclidean", V.metric("euclidean")))}
    rows = rows.select((F.col("q") + 1).alias("query_idx"), *(v.alias(n) for n, v in votes.items()))
    agreed, confidence = P.consensus([F.col(n) for n in votes])
    return rows.select("query_idx", *votes, agreed.alias("agreed"), r6(confidence).alias("confidence"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming window (an extension: the analytics themselves have no event time)."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
