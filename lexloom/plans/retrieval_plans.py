"""Queries on retrieval: term ranking, vectors, fusion, shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import retrieval as R
from lexloom.plans.text_plans import tokens_sql
from lexloom.session import materialize
from lexloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _queries(spark, d):
    r = table(spark, d, "ref_row").where("law_name is not null and indicator_id is not null")
    return r.select("indicator_id", F.explode(T.tokens(F.col("law_name"))).alias("term")).groupBy("indicator_id", "term").agg(F.count("*").alias("qtf"))


def _hits(spark, d, queries):
    """Terms of titles and whole texts that some query has."""
    doc = table(spark, d, "documents").select("doc_id", "title", "text")
    return R.term_hits(doc, "doc_id", T.tokens(F.concat_ws(" ", "title", "text")), queries)


def _bm25(spark, d):
    q = _queries(spark, d)
    return R.bm25(_hits(spark, d, q), "doc_id", q)


BM25 = f"""q AS (SELECT indicator_id, term, count(*) AS qtf FROM (SELECT indicator_id, unnest({tokens_sql("law_name")}) AS term FROM ref_row WHERE law_name IS NOT NULL AND indicator_id IS NOT NULL) GROUP BY 1, 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql("concat_ws(' ', title, text)")}) AS term FROM documents) GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
bm AS (SELECT indicator_id, doc_id, sum(qtf * ln(1 + (n_docs - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2)"""


@query(f"WITH {BM25} SELECT indicator_id, doc_id, rank, round(bm25, 4) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 20")
def bm25_topk(spark, d):
    t = R.top_k(_bm25(spark, d), ["indicator_id"], [F.desc(F.round("bm25", 6)), "doc_id"], 20)
    return t.select("indicator_id", "doc_id", "rank", F.round("bm25", 4).alias("bm25"))


@query(f"WITH {BM25} SELECT indicator_id, doc_id, round(bm25 / max(bm25) OVER (PARTITION BY indicator_id), 5) AS norm FROM bm")
def bm25_maxnorm(spark, d):
    return R.max_norm(_bm25(spark, d), ["indicator_id"], ["bm25"]).select("indicator_id", "doc_id", F.round("bm25_norm", 5).alias("norm"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    f"""WITH s AS (SELECT a.vec_id AS qid, b.vec_id, ({COS} + 1) / 2 AS dense FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id)
    SELECT qid, vec_id, rank, round(dense, 5) AS dense FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dense, 7) DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def dense_cosine_topk(spark, d):
    """Ten nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.nearest(e, e.where("vec_id % 20 = 0"), 10).select("qid", "vec_id", "rank", F.round("dense", 5).alias("dense"))


def _dedup_ranks(spark, d):
    r = table(spark, d, "doc_rank").where("doc_id is not null")
    return r.groupBy("run_id", "indicator_id", "doc_id").agg(F.max("law_name").alias("law_name"), *(F.max(s).alias(s) for s in ("keyword", "semantic", "cross", "scope")))


DR = 'dr AS (SELECT run_id, indicator_id, doc_id, max(law_name) AS law_name, max(keyword) AS keyword, max(semantic) AS semantic, max("cross") AS cross_, max(scope) AS scope FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3)'
BY = ["run_id", "indicator_id"]


def _fused(spark, d):
    r = R.max_norm(_dedup_ranks(spark, d), BY, ["keyword", "semantic"])
    kw, sem = (F.coalesce(F.col(f"{s}_norm"), F.lit(0.0)) for s in ("keyword", "semantic"))
    return r.withColumn("fused", F.round(0.65 * kw + 0.35 * sem, 9)).drop("keyword_norm", "semantic_norm")


FUSED = f"{DR}, fu AS (SELECT *, round(0.65 * coalesce(keyword / CASE WHEN max(keyword) OVER w > 0 THEN max(keyword) OVER w ELSE 1 END, 0) + 0.35 * coalesce(semantic / CASE WHEN max(semantic) OVER w > 0 THEN max(semantic) OVER w ELSE 1 END, 0), 9) AS fused FROM dr WINDOW w AS (PARTITION BY run_id, indicator_id))"


@query(f"WITH {FUSED} SELECT run_id, indicator_id, doc_id, round(fused, 6) AS fused FROM fu")
def hybrid_fusion(spark, d):
    """0.65 of the keyword score and 0.35 of the semantic score, each by its ranking's largest."""
    return _fused(spark, d).select(*BY, "doc_id", F.round("fused", 6).alias("fused"))


PHRASES = ["personal records", "audit trail", "without undue delay", "catatan pribadi", "личные записи", "登记簿副本"]
PHRASES_SQL = ", ".join(f"'{p}'" for p in PHRASES)


@query(f"SELECT doc_id, least(0.30, 0.10 * len(list_filter([{PHRASES_SQL}], lambda p: contains(lower(text), p)))) AS bonus FROM documents WHERE text IS NOT NULL")
def phrase_bonus(spark, d):
    """A tenth for each phrase contained, at most 0.3."""
    n = F.size(F.filter(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(F.lower("text"), p)))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.least(F.lit(0.30), n * 0.10).alias("bonus"))


@query(
    f"""WITH {BM25}, h AS (SELECT q.indicator_id, doc_id, count(*) AS hits FROM q JOIN tf USING (term) GROUP BY 1, 2)
    SELECT a.indicator_id, a.doc_id, round(max(CASE WHEN b.hits > a.hits THEN least(0.20, 0.07 * (b.hits - a.hits)) ELSE 0 END), 4) AS penalty FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.indicator_id <> b.indicator_id AND split_part(a.indicator_id, '-', 1) = split_part(b.indicator_id, '-', 1) GROUP BY 1, 2"""
)
def sibling_penalty(spark, d):
    """What a document loses where a sibling of the indicator's pillar hits it with more terms. Per document there are at most as many rows as indicators."""
    q = _queries(spark, d)
    h = _hits(spark, d, q).join(q, "term").groupBy("indicator_id", "doc_id").agg(F.count("*").alias("hits")).withColumn("pillar", F.substring_index("indicator_id", "-", 1))
    a, b = h.alias("a"), h.alias("b")
    j = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.pillar") == F.col("b.pillar")) & (F.col("a.indicator_id") != F.col("b.indicator_id")))
    more = F.col("b.hits") - F.col("a.hits")
    return j.groupBy("a.indicator_id", "a.doc_id").agg(F.round(F.max(F.when(more > 0, F.least(F.lit(0.20), more * 0.07)).otherwise(0.0)), 4).alias("penalty"))


@query(
    f"""WITH {FUSED}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY fused DESC, doc_id) AS place FROM fu)
    SELECT run_id, indicator_id, doc_id, round(CASE WHEN place <= 15 THEN 0.5 * fused + 0.5 / (1 + exp(-coalesce(least(cross_, 50), 0))) ELSE 0.5 * fused END, 6) AS score FROM p"""
)
def rerank_pool_blend(spark, d):
    """The first 15 of each ranking blended with the sigmoid of the reranker's score; the others are halved."""
    f = materialize(_fused(spark, d), "fused")
    pool = R.top_k(f.where("doc_id is not null"), BY, [F.desc("fused"), "doc_id"], 15).select(*BY, "doc_id", F.lit(True).alias("pooled"))
    ce = 1 / (1 + F.exp(-F.coalesce(F.least(F.col("cross"), F.lit(50.0)), F.lit(0.0))))
    both = f.join(pool, [*BY, "doc_id"], "left")
    return both.select(*BY, "doc_id", F.round(F.when(F.col("pooled"), 0.5 * F.col("fused") + 0.5 * ce).otherwise(0.5 * F.col("fused")), 6).alias("score"))


@query(
    f"""WITH {DR}, a AS (SELECT run_id, indicator_id, doc_id, 1 / (60 + row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY keyword DESC, doc_id)) AS part FROM dr WHERE keyword IS NOT NULL
    UNION ALL SELECT run_id, indicator_id, doc_id, 1 / (60 + row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY semantic DESC, doc_id)) FROM dr WHERE semantic IS NOT NULL
    UNION ALL SELECT run_id, indicator_id, doc_id, 1 / (60 + row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY cross_ DESC, doc_id)) FROM dr WHERE cross_ IS NOT NULL)
    SELECT run_id, indicator_id, doc_id, round(sum(part), 7) AS rrf FROM a GROUP BY 1, 2, 3"""
)
def rrf_law_ranking(spark, d):
    return R.rrf(_dedup_ranks(spark, d), BY, "doc_id", ["keyword", "semantic", "cross"]).select(*BY, "doc_id", F.round("rrf", 7).alias("rrf"))


@query(
    f"""WITH {FUSED}, g AS (SELECT indicator_id, law_name, doc_id, max(fused) AS fused FROM fu WHERE law_name IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT *, row_number() OVER (PARTITION BY indicator_id, law_name ORDER BY fused DESC, doc_id) AS k FROM g),
    b AS (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY CASE WHEN k <= 2 THEN k ELSE 3 END, fused DESC, doc_id) AS rank FROM a) SELECT indicator_id, doc_id, rank FROM b WHERE rank <= 25"""
)
def diverse_shortlist(spark, d):
    g = _fused(spark, d).where("law_name is not null").groupBy("indicator_id", "law_name", "doc_id").agg(F.max("fused").alias("fused"))
    return R.diverse(g, "indicator_id", "law_name", "doc_id", "fused", 25, 2).select("indicator_id", "doc_id", "rank")


@query(
    f"""WITH {FUSED}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY fused DESC, doc_id) AS p FROM fu), kept AS (SELECT run_id, indicator_id, doc_id, 'fused' AS lane FROM k WHERE p <= 10),
    e AS (SELECT k.*, row_number() OVER (PARTITION BY k.run_id, k.indicator_id ORDER BY semantic DESC, doc_id) AS s FROM k WHERE p > 10 AND semantic IS NOT NULL)
    SELECT * FROM kept UNION ALL SELECT run_id, indicator_id, doc_id, 'dense' FROM e WHERE s <= 3"""
)
def dense_recall_guarantee(spark, d):
    """The ten best of each ranking, and the three best by vectors that are not among them."""
    f = materialize(_fused(spark, d), "fused")
    kept = R.top_k(f, BY, [F.desc("fused"), "doc_id"], 10)
    extra = R.top_k(f.where("semantic is not null").join(kept.select(*BY, "doc_id"), [*BY, "doc_id"], "left_anti"), BY, [F.desc("semantic"), "doc_id"], 3)
    return kept.select(*BY, "doc_id", F.lit("fused").alias("lane")).unionByName(extra.select(*BY, "doc_id", F.lit("dense").alias("lane")))


@query(
    """WITH s AS (SELECT DISTINCT economy, doc_id, TRY_CAST(regexp_extract(article_section, '([0-9]+)', 1) AS INT) AS n FROM provisions WHERE doc_id IS NOT NULL AND regexp_matches(article_section, '[0-9]')),
    c AS (SELECT DISTINCT economy, TRY_CAST(regexp_extract(x, '([0-9]+)', 1) AS INT) AS n FROM (SELECT economy, unnest(sections) AS x FROM ref_row) y), h AS (SELECT s.doc_id, s.n FROM s JOIN c USING (economy, n))
    SELECT DISTINCT s.doc_id, s.n FROM h JOIN s ON h.doc_id = s.doc_id AND abs(h.n - s.n) BETWEEN 1 AND 2"""
)
def depth_neighbours(spark, d):
    """Sections next to one whose number the economy's reference rows cite, two on either side, by an equi-join on the exploded neighbours."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")
    p = table(spark, d, "provisions").where(F.col("doc_id").isNotNull() & F.col("article_section").rlike("[0-9]"))
    s = p.select("economy", "doc_id", number("article_section").alias("n")).distinct()
    cited = table(spark, d, "ref_row").select("economy", F.explode("sections").alias("x")).select("economy", number("x").alias("n")).distinct()
    near = s.join(cited, ["economy", "n"], "left_semi").select("doc_id", F.explode(F.array(*(F.col("n") + i for i in (-2, -1, 1, 2)))).alias("n")).distinct()
    return s.select("doc_id", "n").distinct().join(near, ["doc_id", "n"], "left_semi")


@query(
    f"""WITH {FUSED}, t AS (SELECT doc_id, indicator_id, row_number() OVER (PARTITION BY indicator_id ORDER BY fused DESC, doc_id, run_id) AS turn FROM fu)
    SELECT doc_id, turn, indicator_id FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY turn, indicator_id) = 1"""
)
def round_robin_interleave(spark, d):
    return R.round_robin(_fused(spark, d), "indicator_id", [F.desc("fused"), "doc_id", "run_id"], "doc_id")


@query("SELECT run_id, indicator_id, count(DISTINCT doc_id) AS n, least(count(DISTINCT doc_id), 450, greatest(8, 40, CAST(ceil(0.05 * count(DISTINCT doc_id)) AS BIGINT))) AS size FROM doc_rank GROUP BY 1, 2")
def shortlist_size(spark, d):
    g = table(spark, d, "doc_rank").groupBy(*BY).agg(F.countDistinct("doc_id").alias("n"))
    return g.withColumn("size", F.least(F.col("n"), F.lit(450), F.greatest(F.lit(40), F.ceil(F.col("n") * 0.05))).cast("long"))


@query(f"WITH {FUSED} SELECT run_id, indicator_id, arg_max(doc_id, struct_pack(a := fused, b := doc_id)) AS best, round(max(fused), 6) AS fused FROM fu GROUP BY 1, 2")
def arg_max_per_group(spark, d):
    """The best document of each ranking; of equal ones the larger id."""
    return _fused(spark, d).groupBy(*BY).agg(F.max_by("doc_id", F.struct("fused", "doc_id")).alias("best"), F.round(F.max("fused"), 6).alias("fused"))


@query(
    f"""WITH {FUSED}, p AS (SELECT indicator_id, law_name, fused, row_number() OVER (PARTITION BY indicator_id, law_name ORDER BY fused DESC, doc_id, run_id) AS k FROM fu WHERE law_name IS NOT NULL)
    SELECT indicator_id, law_name, round(max(fused), 6) AS best, round(avg(fused) FILTER (WHERE k <= 3), 6) AS mean_top3, round(sum(fused) FILTER (WHERE k <= 5), 6) AS sum_top5 FROM p GROUP BY 1, 2"""
)
def law_scores(spark, d):
    # best and sums need no more than each law's five first, which are cut before the shuffle
    p = R.top_k(_fused(spark, d).where("law_name is not null"), ["indicator_id", "law_name"], [F.desc("fused"), "doc_id", "run_id"], 5).withColumnRenamed("rank", "k")
    return p.groupBy("indicator_id", "law_name").agg(F.round(F.max("fused"), 6).alias("best"), F.round(F.avg(F.when(F.col("k") <= 3, F.col("fused"))), 6).alias("mean_top3"), F.round(F.sum(F.when(F.col("k") <= 5, F.col("fused"))), 6).alias("sum_top5"))


@query(
    f"""WITH {DR}, n AS (SELECT *, keyword / nullif(max(keyword) OVER w, 0) AS k, semantic / nullif(max(semantic) OVER w, 0) AS s FROM dr WINDOW w AS (PARTITION BY run_id, indicator_id)), c AS (SELECT unnest([0.0, 0.25, 0.5, 0.65, 1.0]) AS alpha),
    f AS (SELECT alpha, run_id, indicator_id, doc_id, row_number() OVER (PARTITION BY alpha, run_id, indicator_id ORDER BY round(alpha * coalesce(k, 0) + (1 - alpha) * coalesce(s, 0), 9) DESC, doc_id) AS r, scope FROM n, c)
    SELECT alpha, round(avg(CASE WHEN scope >= 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM f WHERE r <= 5 GROUP BY 1"""
)
def fusion_sweep(spark, d):
    """One pass over the stored components for every setting of the blend: share of national laws among the first five."""
    r = _dedup_ranks(spark, d)
    top = r.groupBy(*BY).agg(F.max("keyword").alias("mk"), F.max("semantic").alias("ms"))
    n = r.join(top, BY).withColumn("k", F.col("keyword") / F.nullif(F.col("mk"), F.lit(0.0))).withColumn("s", F.col("semantic") / F.nullif(F.col("ms"), F.lit(0.0))).drop("mk", "ms")
    c = n.withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.65, 1.0)))))
    score = F.round(F.col("alpha") * F.coalesce("k", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("s", F.lit(0.0)), 9)
    top = R.top_k(c.withColumn("score", score), ["alpha", *BY], [F.desc("score"), "doc_id"], 5)
    return top.groupBy("alpha").agg(F.round(F.avg(F.when(F.col("scope") >= 1, 1.0).otherwise(0.0)), 6).alias("share"))
