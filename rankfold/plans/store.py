"""Queries of the vector store, contexts, scorers, manifests and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import storing
from rankfold.functions import answers as A
from rankfold.functions.vectorise import hashed_words, with_vectors
from rankfold.operators import contexts as C
from rankfold.operators import manifest as M
from rankfold.operators import pool as O
from rankfold.operators import runs as R
from rankfold.operators import scoring, sync
from rankfold.operators import vector as V
from rankfold.operators.ranking import r6
from rankfold.operators.scored import N_QUERIES, SCORED_SQL, corpus, query_set, raw, scored
from rankfold.operators.store import VectorStore
from rankfold.plans.retrieval import _LISTS, _lists, _requests, table, trilateration
from rankfold.plans.runs import _SYNC, _replies
from rankfold.streaming import facts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one; it goes when the driver ends."""
    path = f"{storing.shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    storing.atexit.register(storing.remove_at_exit, spark, path)
    return path


@query()
def ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows, by the trained index, for every row whose id is divisible by 50; all rows are stored and indexed."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d"), F.lit("").alias("text"), "embedding")
    store = VectorStore(spark, new_folder(spark, "ann"))
    store.add(rows, "all", size=1_000_000)
    store.build_index()
    return store.search_index(rows.filter(F.col("d") % 50 == 0).select(F.col("d").alias("q"), "embedding"), 10)


_W = r"regexp_extract_all(lower({0}), '[^ \t\n\x0B\f\r]+')"
#: hashed words as lists of 64, of documents (dv) and of conversations' first turns (qv)
_VECTORS = rf"""WITH w AS (SELECT 'd' AS k, doc_id AS id, unnest({_W.format("text")}) AS w FROM documents UNION ALL SELECT 'q', conv_id, unnest({_W.format("text")}) FROM conversations WHERE turn = 0),
c AS (SELECT k, id, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS dim, sum(CASE WHEN ('0x' || substr(md5(w), 5, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL),
ids AS (SELECT 'd' AS k, doc_id AS id FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'q', conv_id FROM conversations WHERE turn = 0 AND text IS NOT NULL),
f AS (SELECT ids.k, ids.id, x.dim, coalesce(c.v, 0) AS v FROM ids CROSS JOIN (SELECT unnest(range(0, 64)) AS dim) x LEFT JOIN c ON c.k = ids.k AND c.id = ids.id AND c.dim = x.dim),
l AS (SELECT k, id, list(v ORDER BY dim) AS vs, sqrt(sum(v * v)) AS norm FROM f GROUP BY ALL),
vec AS (SELECT k, id, list_transform(vs, lambda x: (x / CASE WHEN norm = 0 THEN 1 ELSE norm END)::FLOAT)::DOUBLE[] AS e, norm > 0 AS solid FROM l),
near AS (SELECT q.id AS q, d.id AS d, CASE WHEN q.solid AND d.solid THEN round(greatest(-1, least(1, list_cosine_similarity(q.e, d.e))), 6) ELSE 0 END AS s
FROM vec q, vec d WHERE q.k = 'q' AND d.k = 'd' QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY s DESC, d.id) <= 5)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("q"), F.col("text").alias("question"))


def _store(spark: SparkSession, sf_dir: str) -> VectorStore:
    store = VectorStore(spark, new_folder(spark, "documents"))
    store.add(_documents(spark, sf_dir), "all", lambda rows: with_vectors(rows, hashed_words()), size=100_000)
    return store


@query(_VECTORS + "SELECT id AS doc_id, round(list_sum(list_transform(e, lambda x, i: x * i)), 4) + 0.0 AS weighted, len(list_filter(e, lambda x: x <> 0))::INT AS n_filled, solid FROM vec WHERE k = 'd'")
def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a vector store, loaded in batches that resume, with the vectors of the default model."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    weighted = F.aggregate(F.transform(e, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    filled = F.size(F.filter(e, lambda x: x != 0))
    return _store(spark, sf_dir).rows().select(F.col("d").alias("doc_id"), (F.round(weighted, 4) + 0.0).alias("weighted"), filled.alias("n_filled"), (filled > 0).alias("solid"))


@query(_VECTORS + r""", ok AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM near WHERE s >= 0.5)
SELECT conv_id AS q, count(ok.d)::INT AS n, md5(coalesce(string_agg(documents.text, chr(10) || chr(10) ORDER BY r), '')) AS context FROM conversations LEFT JOIN ok ON ok.q = conv_id LEFT JOIN documents ON doc_id = ok.d
WHERE turn = 0 GROUP BY conv_id""")
def context_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context for each conversation's first turn: its five nearest documents, compared anew, those of 0.5 or more."""
    found = C.contexts(_store(spark, sf_dir).rows(), _questions(spark, sf_dir), hashed_words())
    return found.select("q", "n", F.md5("context").alias("context"))


def _near(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """(query_idx, doc_id, question, text, r): each first turn with its five nearest documents, of which ``text`` is taken."""
    docs, asked = _documents(spark, sf_dir), _questions(spark, sf_dir).filter("question is not null")
    vectors = storing.stored(with_vectors(asked, hashed_words(), text="question").select("q", "embedding"), "asked")
    near = storing.stored(V.top_k(with_vectors(docs, hashed_words()).select("d", "embedding"), vectors, 5), "near").join(asked, "q").join(docs.withColumn("text", F.expr(text)), "d")
    return near.select(F.col("q").alias("query_idx"), F.col("d").cast("string").alias("doc_id"), "question", "text", F.col("rank").alias("r"))


_SETS = {n: f"list_distinct({_W.format(c)})" for n, c in (("asked", "c.text"), ("held", "documents.text"))}


@query(_VECTORS + f"""SELECT q AS query_idx, d::VARCHAR AS doc_id, (1 + 9 * len(list_intersect({_SETS["asked"]}, {_SETS["held"]})) // greatest(1, len({_SETS["asked"]})))::DOUBLE / 10 AS llm_score
FROM near JOIN conversations c ON c.conv_id = q AND c.turn = 0 JOIN documents ON doc_id = d""")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first turn and its five nearest documents through the scorer protocol, by the default scorer."""
    return scoring.score_pairs(_near(spark, sf_dir)).select("query_idx", "doc_id", "llm_score")


_PROMPT = """'Say how relevant each item is to the query, from 1 (not at all) over 2 (words in common), 4 (same field), 6 (same topic)' || chr(10) || 'and 8 (much of it) to 10 (it holds the answer). Reply with '
|| count(*) || ' whole numbers in the order of the items, as a JSON list and nothing else.' || chr(10) || chr(10) || 'QUERY:' || chr(10) || any_value(c.text) || chr(10) || chr(10)
|| string_agg('--- ITEM ' || r || ' ---' || chr(10) || left(documents.text, 4000), chr(10) || chr(10) ORDER BY r) || chr(10)"""


@query(_VECTORS + f""", o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM near)
SELECT q AS query_idx, md5({_PROMPT}) AS prompt, length({_PROMPT}) AS n_chars FROM o JOIN conversations c ON c.conv_id = q AND c.turn = 0 JOIN documents ON doc_id = d GROUP BY q""")
def relevance_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request that asks for the relevance of each first turn's five nearest documents."""
    shown = f"left(text, {A.MOST_IN_PROMPT})"  # no more of a text is shuffled
    rows = _near(spark, sf_dir, shown).groupBy("query_idx", "question").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("t"))  # five at most
    prompt = A.relevance_prompt(F.col("question"), F.col("t.text"))
    return rows.select("query_idx", F.md5(prompt).alias("prompt"), F.length(prompt).cast("long").alias("n_chars"))


@query(SCORED_SQL + _SYNC + " SELECT query_idx, count(*) AS n, count(llm_score) AS scored, round(sum(llm_score), 6) AS total FROM af GROUP BY 1")
def streamed_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of nine shapes that arrive in two parts, put into versions of the results by a stream."""
    open_ = (F.col("query_idx") % 5 != 0) & ((F.col("query_idx") * 31 + F.col("doc_id").cast("long")) % 50 < 25)
    results = scored(spark, sf_dir).withColumn("llm_score", F.when(~open_, F.col("llm_score")))
    rows = O.batches(results, 20).groupBy("query_idx", "batch").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))  # 20 at most
    requests = rows.withColumn("custom_id", F.format_string("q%d_b%08d", "query_idx", "batch")).withColumn("status", F.lit(sync.SUBMITTED))
    requests = storing.stored(requests, "requests")
    folder = new_folder(spark, "sync")
    versions = facts.fact_versions(spark, f"{folder}/facts", 8)
    versions.create(results=results, requests=requests.drop("batch"))
    lines = storing.stored(_replies(requests), "replies")
    for k in (0, 1):  # a request's replies arrive together and in order, requests in many files
        request = F.floor(F.col("seq") / 10)
        part = lines.filter(request % 2 == k).withColumn("request", request).repartitionByRange("request").sortWithinPartitions("seq")
        part.select("value").write.mode("append").text(f"{folder}/in")
        facts.sync_replies(spark, f"{folder}/in", versions, f"{folder}/checkpoint").awaitTermination()
    return versions.read("results").groupBy("query_idx").agg(F.count("*").alias("n"), F.count("llm_score").alias("scored"), r6(F.sum("llm_score")).alias("total"))


def _manifest(spark: SparkSession, sf_dir: str, run: str) -> M.Manifest:
    def make() -> tuple[DataFrame, DataFrame]:
        truths = scored(spark, sf_dir).filter("is_gt = 1").select("query_idx", "doc_id", F.lit(None).cast("string").alias("question"))
        return truths, O.global_pool(_lists(spark, sf_dir))

    return M.load_or_make(spark, run, M.Spec(N_QUERIES, 5, 20, 20), make)


@query(SCORED_SQL + _LISTS + f"SELECT left(sha256('{N_QUERIES}|5|20|20|{M.POOLING}'), 16) AS fingerprint, (SELECT count(*) FROM truth) AS n_truths, count(*) AS pool_size, ((count(*) + {5 * N_QUERIES - 1}) // {5 * N_QUERIES})::BIGINT AS stages FROM gp")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a staged run's manifest says of it, after it was written, loaded and checked."""
    m = _manifest(spark, sf_dir, new_folder(spark, "run"))
    tables = m.pool(spark).agg(F.count("*").alias("pool_size"), F.max("stage").alias("stages"))
    return tables.select(F.lit(m.spec.fingerprint()).alias("fingerprint"), F.lit(m.n_truths).cast("long").alias("n_truths"), "pool_size", "stages")


@query(SCORED_SQL + _LISTS + """, nd AS (SELECT doc_id, min(stage) AS stage FROM (SELECT (pool_pos - 1) // 250 + 1 AS stage, doc_id FROM gp UNION ALL SELECT 1, gt_doc FROM truth) GROUP BY doc_id)
SELECT stage::INT AS stage, query_idx, count(*) AS n, round(sum(((query_idx * 7 + nd.doc_id::BIGINT * 3) % 10 + 1) / 10.0::DOUBLE), 6) AS total FROM nd, truth GROUP BY ALL""")
def streamed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged run as a stream over all its stages, from its manifest; scores are made from the ids."""
    folder = new_folder(spark, "staged")
    manifest = _manifest(spark, sf_dir, folder)
    score = lambda pairs: pairs.withColumn("llm_score", ((F.col("query_idx") * 7 + F.col("doc_id").cast("long") * 3) % 10 + 1) / 10.0)
    facts.lay_out_stages(spark, manifest, f"{folder}/stages")
    facts.stream_stages(spark, manifest, f"{folder}/stages", f"{folder}/scores", score, f"{folder}/checkpoint").awaitTermination()
    return R.scored_stages(spark, f"{folder}/scores").groupBy("stage", "query_idx").agg(F.count("*").alias("n"), r6(F.sum("llm_score")).alias("total"))


@query(SCORED_SQL + """, c AS (SELECT (query_idx - 1) // 10 + 1 AS chunk, count(*) AS n_queries, bool_and(query_idx % 7 <> 0 OR query_idx % 21 = 0) AS recorded FROM truth GROUP BY 1)
SELECT chunk::BIGINT AS chunk, n_queries, recorded, chunk % 2 = 1 AS has_job, recorded AND chunk % 2 = 1 AS submitted FROM c""")
def chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten queries: every seventh query has no request, every 21st was skipped, every other chunk has a job."""
    q = scored(spark, sf_dir).filter("is_gt = 1").select("query_idx")
    requests = _requests(spark, sf_dir).filter("query_idx % 7 <> 0")
    jobs = q.select((F.floor((F.col("query_idx") - 1) / 10) + 1).alias("c")).distinct().filter("c % 2 = 1")
    meta = jobs.select(F.format_string("chunk_%04d_job_id", "c").alias("key"), F.lit("j").alias("value"))
    return R.chunk_states(q, requests, q.filter("query_idx % 21 = 0"), meta, 10)


@query(SCORED_SQL + """, r AS (SELECT *, doc_id::BIGINT % 3 + 1 AS stage FROM raw), n AS (SELECT count(*) AS q FROM truth), p AS (SELECT count(DISTINCT doc_id) AS docs FROM raw)
SELECT max(stage)::BIGINT AS stages_done, 3::BIGINT AS stages, any_value((p.docs + n.q) * n.q)::BIGINT AS expected_pairs, count(*) AS stored, count(llm_score) AS scored, count(*) FILTER (llm_score = 0) AS blocked,
round(count(llm_score) * 100.0::DOUBLE / any_value((p.docs + n.q) * n.q), 6) AS pct_scored FROM r, n, p""")
def staged_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a run is whose documents were scored in three stages by their ids."""
    facts_ = raw(spark, sf_dir)
    counts = facts_.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("query_idx").alias("q")).first()
    return R.staged_progress(facts_.withColumn("stage", F.col("doc_id").cast("long") % 3 + 1), counts["docs"], counts["q"], 3)


@query()
def retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often plain search and trilateration find the truth of a query of the stated set first."""
    truths = scored(spark, sf_dir).filter("is_gt = 1").select((F.col("query_idx") - 1).alias("q"), F.col("doc_id").cast("long").alias("d"))
    return V.retrieval_accuracy(truths, V.top_k(corpus(spark, sf_dir), query_set(spark, sf_dir), 1), trilateration(spark, sf_dir))
