"""Queries over the search engine, on the documents and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import search as S
from tessera.operators.index import build_index, stored_index
from tessera.plans.catalog import register
from tessera.plans.oracles import INDEX, bm25, has, phrase, terms_sql


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _index(spark, sf_dir):
    """The documents' index: built by the first query that asks for it, read by all others."""
    return stored_index(_docs(spark, sf_dir), {"text": F.col("text")})


def _top_sql(ctes: str, limit: int = 10, more: str = "") -> str:
    return f"WITH {INDEX}, {ctes} SELECT doc_id, score FROM scored {more} ORDER BY score DESC, doc_id LIMIT {limit}"


ANY = f"({has('anea')} OR {has('eriner')} OR {has('thinth')})"


@register("bm25_topk", _top_sql(bm25("anea", "eriner", "thinth", where=ANY)))
def bm25_topk(spark, sf_dir):
    return S.top(S.matches(_index(spark, sf_dir), "anea eriner thinth"))


@register("bm25_required", _top_sql(bm25("anea", "thinth", where=has("thinth"))))
def bm25_required(spark, sf_dir):
    return S.top(S.matches(_index(spark, sf_dir), "anea +thinth"))


@register("bm25_prohibited", _top_sql(bm25("anea", where=f"{has('anea')} AND NOT {has('thinth')}")))
def bm25_prohibited(spark, sf_dir):
    return S.top(S.matches(_index(spark, sf_dir), "anea -thinth"))


@register("or_groups", _top_sql(bm25("anea", "eriner", "que", where=f"({has('anea')} AND {has('eriner')}) OR ({has('que')} AND d.lang = 'es')")))
def or_groups(spark, sf_dir):
    return S.top(S.matches(_index(spark, sf_dir), "+anea +eriner OR +que +lang:es")).select("doc_id", "score")


@register("phrase_match", _top_sql(bm25("attion", "thanedble", where=phrase("attion", "thanedble"))))
def phrase_match(spark, sf_dir):
    return S.top(S.matches(_index(spark, sf_dir), '"attion to the thanedble"'))


@register("keyword_filter", _top_sql(bm25("anea", where=f"{has('anea')} AND d.source = 'src3'")))
def keyword_filter(spark, sf_dir):
    return S.top(S.matches(_index(spark, sf_dir), "+anea +source:src3")).select("doc_id", "score")


@register("page_two", f"WITH {INDEX}, {bm25('anea', 'eriner', 'thinth', where=ANY)} SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 5 OFFSET 5")
def page_two(spark, sf_dir):
    found = S.matches(_index(spark, sf_dir), "anea eriner thinth")
    first = S.top(found, 5).collect()  # five rows: the last is the token of the page before
    return S.top(found, 5, (first[-1]["score"], first[-1]["doc_id"])) if len(first) == 5 else found.limit(0)


@register(
    "tombstones",
    _top_sql(bm25("anea", "thinth", where=f"({has('anea')} OR {has('thinth')}) AND d.doc_id % 3 <> 0")),
)
def tombstones(spark, sf_dir):
    """Deleted documents are not found but still count in the statistics."""
    index = _index(spark, sf_dir)
    return S.top(S.matches(index.delete(index.stored.where("doc_id % 3 = 0")), "anea thinth"))


@register("facet_lang", f"WITH {INDEX}, {bm25('anea', 'que', where=f'{has('anea')} OR {has('que')}')} SELECT lang AS value, count(*) AS n FROM scored GROUP BY lang ORDER BY n DESC, value LIMIT 5")
def facet_lang(spark, sf_dir):
    index = _index(spark, sf_dir)
    return S.facet(S.with_stored(S.matches(index, "anea que"), index, "lang"), "lang")


BUCKETS = ((0, 500), (500, 2000), (2000, 10000))


@register(
    "facet_buckets",
    f"""WITH {INDEX}, {bm25("anea", where=has("anea"))}, b(label, lo, hi) AS (VALUES {", ".join(f"('{a}-{z}', {a}, {z})" for a, z in BUCKETS)}, ('outside', NULL, NULL))
SELECT label, coalesce(c, 0) AS n FROM b LEFT JOIN (SELECT CASE {" ".join(f"WHEN n_chars >= {a} AND n_chars < {z} THEN '{a}-{z}'" for a, z in BUCKETS)} ELSE 'outside' END AS label,
count(*) AS c FROM scored GROUP BY 1) USING (label)""",
)
def facet_buckets(spark, sf_dir):
    """Counts by half-open ranges; empty ranges stay."""
    index = _index(spark, sf_dir)
    found = S.with_stored(S.matches(index, "anea"), index, "n_chars")
    label = F.lit("outside")
    for a, z in BUCKETS:
        label = F.when((F.col("n_chars") >= a) & (F.col("n_chars") < z), f"{a}-{z}").otherwise(label)
    labels = spark.createDataFrame([(f"{a}-{z}",) for a, z in BUCKETS] + [("outside",)], "label string")
    counts = found.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("c"))
    return labels.join(counts, "label", "left").select("label", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@register(
    "collapse_source",
    f"""WITH {INDEX}, {bm25("anea", "thinth", where=f"{has('anea')} OR {has('thinth')}")} SELECT doc_id, score, folded FROM (SELECT doc_id, score,
row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) - 1 AS folded FROM scored) WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 10""",
)
def collapse_source(spark, sf_dir):
    index = _index(spark, sf_dir)
    return S.collapse(S.with_stored(S.matches(index, "anea thinth"), index, "source"), "source")


@register("sorted_by_field", f"WITH {INDEX}, {bm25('thinth', where=has('thinth'))} SELECT doc_id, score, n_chars FROM scored ORDER BY n_chars DESC NULLS LAST, score DESC, doc_id LIMIT 10")
def sorted_by_field(spark, sf_dir):
    index = _index(spark, sf_dir)
    return S.with_stored(S.matches(index, "thinth"), index, "n_chars").orderBy(F.desc_nulls_last("n_chars"), F.desc("score"), "doc_id").limit(10)


@register("range_docs", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 800")
def range_docs(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("n_chars").between(500, 800)).select("doc_id", "n_chars")


@register("prefix_docs", f"WITH {INDEX} SELECT term, count(*) AS df FROM post WHERE starts_with(term, 'thinth') GROUP BY term ORDER BY term LIMIT 32")
def prefix_docs(spark, sf_dir):
    """The terms of a prefix, 32 at most, with their document counts."""
    return _index(spark, sf_dir).term_stats().where(F.col("term").startswith("thinth")).select("term", "df").orderBy("term").limit(32)


@register("min_should_match", f"WITH {INDEX} SELECT doc_id, count(*) AS n FROM post WHERE term IN ('anea', 'eriner', 'thinth', 'ou', 'attion') GROUP BY doc_id HAVING count(*) >= 3")
def min_should_match(spark, sf_dir):
    found = _index(spark, sf_dir).postings.where(F.col("term").isin("anea", "eriner", "thinth", "ou", "attion"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


_PAIR = f"""WITH {INDEX}, pos AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM docs) SELECT a.doc_id, min(abs(b.pos - a.pos)) AS gap
FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.term = 'anea' AND b.term = 'ou'"""


def _spans(spark, sf_dir):
    """Closest pairs of two terms by their position arrays, in each document alone."""
    rows = _index(spark, sf_dir).postings.where(F.col("term").isin("anea", "ou"))
    held = rows.groupBy("doc_id").agg(*(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(t) for t in ("anea", "ou")))
    return held.where("anea is not null and ou is not null")


@register("span_near", f"{_PAIR} WHERE abs(b.pos - a.pos) <= 4 GROUP BY a.doc_id")
def span_near(spark, sf_dir):
    gap = F.array_min(F.transform("anea", lambda a: F.array_min(F.transform("ou", lambda o: F.abs(o - a)))))
    return _spans(spark, sf_dir).select("doc_id", gap.cast("long").alias("gap")).where("gap <= 4")


@register("span_before", f"{_PAIR} WHERE b.pos - a.pos BETWEEN 1 AND 4 GROUP BY a.doc_id")
def span_before(spark, sf_dir):
    gap = F.array_min(F.flatten(F.transform("anea", lambda a: F.filter(F.transform("ou", lambda o: o - a), lambda d: d > 0))))
    return _spans(spark, sf_dir).select("doc_id", gap.cast("long").alias("gap")).where("gap <= 4")


@register("term_stats", f"WITH {INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM post GROUP BY term")
def term_stats(spark, sf_dir):
    return _index(spark, sf_dir).term_stats().select("term", "df", F.col("total_tf").cast("long").alias("total_tf"))


@register("field_stats", f"WITH {INDEX} SELECT 'text' AS field, n AS n_docs, round_even(avgdl, 4) AS average_length FROM stats")
def field_stats(spark, sf_dir):
    return _index(spark, sf_dir).field_stats().select("field", "n_docs", F.bround("average_length", 4).alias("average_length"))


@register("term_vector", f"WITH {INDEX} SELECT p.term, p.tf, t.df FROM post p JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) t USING (term) WHERE p.doc_id = 7")
def term_vector(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.postings.where("doc_id = 7").join(index.term_stats(), ["field", "term"]).select("term", F.col("tf").cast("long").alias("tf"), "df")


@register(
    "more_like_this",
    f"""WITH {INDEX}, t AS (SELECT term, count(*) AS df FROM post GROUP BY term), seed AS (SELECT term, df FROM post JOIN t USING (term) WHERE doc_id = 7 AND df >= 2 ORDER BY df, term LIMIT 5),
s AS (SELECT p.doc_id, round_even(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avgdl))), 4) AS score
FROM post p JOIN seed USING (term) JOIN docs USING (doc_id) CROSS JOIN stats WHERE p.doc_id <> 7 GROUP BY p.doc_id) SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 5""",
)
def more_like_this(spark, sf_dir):
    """Documents like a seed: its five rarest shared terms as a query."""
    index = _index(spark, sf_dir)
    seed = index.postings.where("doc_id = 7").select("field", "term").join(index.term_stats(), ["field", "term"]).where("df >= 2")
    terms = [(r["field"], r["term"]) for r in seed.orderBy("df", "term").limit(5).collect()]  # five terms
    scored = S.scored_postings(index, terms).where("doc_id <> 7").groupBy("doc_id").agg(F.bround(F.sum("weight"), 4).alias("score"))
    return S.top(scored, 5)


@register(
    "cosine",
    f"""WITH {INDEX}, n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY doc_id)
SELECT b.doc_id, round_even(sum(a.tf * b.tf) / any_value(na.norm * nb.norm), 4) AS cosine FROM post a JOIN post b ON a.term = b.term AND a.doc_id = 7 AND b.doc_id <> 7
JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY b.doc_id ORDER BY cosine DESC, doc_id LIMIT 10""",
)
def cosine(spark, sf_dir):
    """Cosine of term counts of all documents to one."""
    post = _index(spark, sf_dir).postings.select("doc_id", "term", "tf")
    seed = post.where("doc_id = 7").select("term", F.col("tf").alias("seed_tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")))
    rows = post.join(F.broadcast(seed), "term", "left")
    sums = rows.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("seed_tf")).alias("dot"), norm.alias("norm"))
    own = seed.agg(F.sqrt(F.sum(F.col("seed_tf") * F.col("seed_tf"))).alias("own"), F.lit(1).alias("_one"))
    scored = sums.where("dot is not null and doc_id <> 7").withColumn("_one", F.lit(1)).join(F.broadcast(own), "_one")
    return scored.select("doc_id", F.bround(F.col("dot") / (F.col("norm") * F.col("own")), 4).alias("cosine")).orderBy(F.desc("cosine"), "doc_id").limit(10)


@register(
    "rank_fusion",
    f"""WITH {INDEX}, {bm25("anea", where=has("anea"), name="one")}, two AS (SELECT doc_id, n_chars AS score FROM documents),
v AS (SELECT doc_id, 1 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS vote FROM (SELECT * FROM one ORDER BY score DESC, doc_id LIMIT 100)
UNION ALL SELECT doc_id, 1 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM (SELECT * FROM two ORDER BY score DESC, doc_id LIMIT 100))
SELECT doc_id, round_even(sum(vote), 6) AS score, count(*) AS lists FROM v GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
)
def rank_fusion(spark, sf_dir):
    long = _docs(spark, sf_dir).select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return S.top(S.reciprocal_rank_fusion({"bm25": S.matches(_index(spark, sf_dir), "anea"), "long": long}), 20)


def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_partkey", "doc_id")


_PART = f"""docs AS (SELECT p_partkey AS doc_id, {terms_sql("p_name")} AS name, {terms_sql("p_type")} AS type FROM part),
post AS (SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, 'name' AS field, unnest(name) AS term FROM docs UNION ALL SELECT doc_id, 'type', unnest(type) FROM docs) GROUP BY ALL),
len AS (SELECT doc_id, 'name' AS field, len(name) AS l FROM docs UNION ALL SELECT doc_id, 'type', len(type) FROM docs),
stats AS (SELECT field, count(*) AS n, avg(l) AS avgdl FROM len GROUP BY field),
w AS (SELECT doc_id, field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl)) AS weight FROM post JOIN len USING (doc_id, field) JOIN stats USING (field)
JOIN (SELECT field, term, count(*) AS df FROM post GROUP BY ALL) USING (field, term))"""


def _part_weights(spark, sf_dir):
    docs = _parts(spark, sf_dir)
    index = build_index(docs, {"name": F.col("p_name"), "type": F.col("p_type")})
    return S.scored_postings(index, [(f, t) for f in ("name", "type") for t in ("small", "red", "widget", "economy", "large")])


@register("boosted_fields", f"WITH {_PART} SELECT doc_id, round_even(sum(CASE field WHEN 'name' THEN 3 ELSE 1 END * weight), 4) AS score FROM w WHERE term IN ('small', 'red', 'widget', 'economy', 'large') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def boosted_fields(spark, sf_dir):
    boost = F.when(F.col("field") == "name", 3.0).otherwise(1.0)
    return S.top(_part_weights(spark, sf_dir).groupBy("doc_id").agg(F.bround(F.sum(F.col("weight") * boost), 4).alias("score")))


@register(
    "dismax",
    f"""WITH {_PART} SELECT doc_id, round_even(sum(best + 0.1 * (whole - best)), 4) AS score FROM (SELECT doc_id, term, max(weight) AS best, sum(weight) AS whole FROM w
WHERE term IN ('small', 'red', 'widget', 'economy', 'large') GROUP BY ALL) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""",
)
def dismax(spark, sf_dir):
    """The best field counts for each term, the others a tenth."""
    by_term = _part_weights(spark, sf_dir).groupBy("doc_id", "term").agg(F.max("weight").alias("best"), F.sum("weight").alias("whole"))
    return S.top(by_term.groupBy("doc_id").agg(F.bround(F.sum(F.col("best") + 0.1 * (F.col("whole") - F.col("best"))), 4).alias("score")))


@register(
    "batch_queries",
    f"""WITH {INDEX}, t AS (SELECT term, count(*) AS df FROM post GROUP BY term), i AS (SELECT DISTINCT item_id, unnest({terms_sql()}) AS term FROM benchmark),
q AS (SELECT item_id, term, df FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS r FROM i JOIN t USING (term)) WHERE r <= 5),
s AS (SELECT item_id, p.doc_id, round_even(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avgdl))), 4) AS score FROM q JOIN post p USING (term) JOIN docs USING (doc_id) CROSS JOIN stats GROUP BY ALL)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 3""",
)
def batch_queries(spark, sf_dir):
    """All benchmark items as queries in one plan: their five rarest terms, the three best documents of each.

    Items are spread over their terms, joined to postings by term, and ranked.
    """
    index = _index(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    terms = build_index(items.withColumnRenamed("item_id", "doc_id"), {"text": F.col("text")}).postings.select(F.col("doc_id").alias("item_id"), "term")
    df = index.term_stats().select("term", "df")
    rare = terms.join(df, "term").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "term"))).where("r <= 5")
    rows = index.postings.join(rare.select("item_id", "term", "df"), "term").join(F.broadcast(index.field_stats()), "field")
    weight = S.idf(F.col("df"), F.col("n_docs")) * S.saturation(F.col("tf"), F.col("length"), F.col("average_length"))
    scored = rows.groupBy("item_id", "doc_id").agg(F.bround(F.sum(weight), 4).alias("score"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where("r <= 3").select("item_id", "doc_id", "score")


SUBSCRIPTIONS = {"both": "+anea +eriner", "either": "anea que OR +thinth", "without": "que -anea", "french": "+ou +lang:fr"}


@register(
    "percolate",
    f"""WITH {INDEX}, f AS (SELECT d.*, {has("anea")} AS a, {has("eriner")} AS e, {has("que")} AS q, {has("thinth")} AS t, {has("ou")} AS o FROM docs d)
SELECT unnest(['both', 'either', 'without', 'french']) AS name, unnest([count(*) FILTER (a AND e), count(*) FILTER (a OR q OR t), count(*) FILTER (q AND NOT a), count(*) FILTER (o AND lang = 'fr')]) AS n FROM f""",
)
def percolate(spark, sf_dir):
    """Stored queries against documents: clauses are rows, and a document fires a query by counts of the clauses it meets."""
    fired = S.percolated(_index(spark, sf_dir), SUBSCRIPTIONS)
    names = spark.createDataFrame([(n,) for n in SUBSCRIPTIONS], "name string")
    return names.join(fired.groupBy("name").agg(F.count(F.lit(1)).alias("c")), "name", "left").select("name", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@register("access_control", f"WITH {INDEX}, {bm25('anea', where=f'{has('anea')} AND d.source IN (' + chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src2' + chr(39) + ')')} SELECT doc_id, score FROM scored")
def access_control(spark, sf_dir):
    """Only rows that are granted to one of the caller's principals; here a row is granted to its source."""
    index = _index(spark, sf_dir)
    seen = S.with_stored(S.matches(index, "anea"), index, "source").withColumn("granted_to", F.array("source"))
    return seen.where(F.arrays_overlap("granted_to", F.array(F.lit("src1"), F.lit("src2")))).select("doc_id", "score")


@register("recency_tilt", f"WITH {INDEX}, {bm25('thinth', where=has('thinth'))} SELECT doc_id, round_even(score + 0.3 * power(0.5, doc_id / 100.0), 4) AS score FROM scored ORDER BY score DESC, doc_id LIMIT 10")
def recency_tilt(spark, sf_dir):
    """A capped additive factor that halves with age; the id stands for the age here."""
    found = S.matches(_index(spark, sf_dir), "thinth")
    return S.top(found.select("doc_id", F.bround(F.col("score") + 0.3 * F.pow(F.lit(0.5), F.col("doc_id") / 100.0), 4).alias("score")))
