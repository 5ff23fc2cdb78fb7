"""Queries over what a search page needs besides ranking: marks, snippets, corrections, synonyms, nearness, curation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import search as S
from tessera.operators.index import stored_index
from tessera.operators.suggest import did_you_mean
from tessera.plans.catalog import register
from tessera.plans.oracles import INDEX, STEM_SQL, STOP_LIST, bm25, has, phrase, terms_sql


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _index(spark, sf_dir):
    return stored_index(_docs(spark, sf_dir), {"text": F.col("text")})


TERMS = ("anea", "eriner", "thinth")
_LISTED = ", ".join(f"'{t}'" for t in TERMS)
_HIT = f"(lower(w) NOT IN ({STOP_LIST}) AND {STEM_SQL.format('lower(w)')} IN ({_LISTED}))"
#: tok(doc_id, text, i, w, start, stop, hit): the tokens with their places, counted from 0
_TOKENS = f"""raw AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') AS gaps FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, text, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS gap FROM raw),
tok AS (SELECT doc_id, text, i, w, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS start, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, gap, {_HIT} AS hit FROM cut)"""


@register(
    "highlight",
    f"""WITH {_TOKENS} SELECT r.doc_id, coalesce(n, 0)::BIGINT AS n_spans, md5(coalesce(head, '') || coalesce(gaps[len(gaps)], '')) AS digest FROM raw r
LEFT JOIN (SELECT doc_id, count(*) FILTER (hit) AS n, string_agg(gap || CASE WHEN hit THEN '[' || w || ']' ELSE w END, '' ORDER BY i) AS head FROM tok GROUP BY doc_id) USING (doc_id)""",
)
def highlight(spark, sf_dir):
    """All texts with the query's words in brackets: how many, and a digest of the marked text."""
    pieces = _docs(spark, sf_dir).where("text is not null").select("doc_id", T.pieces_at(F.col("text"), TERMS).alias("p"))
    return pieces.select("doc_id", ((F.size("p") - 1) / 2).cast("long").alias("n_spans"), F.md5(T.marked_text(F.col("p"))).alias("digest"))


_WINDOWS = f"""{_TOKENS}, sp AS (SELECT doc_id, text, start, stop FROM tok WHERE hit), held AS (SELECT a.doc_id, a.start, count(*) AS n FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND b.start >= a.start AND b.stop <= a.start + 60 GROUP BY ALL),
best AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start) AS r FROM held) WHERE r = 1),
win AS (SELECT doc_id, text, greatest(0, least(start, length(text) - 60)) AS a FROM best JOIN raw USING (doc_id)),
wide AS (SELECT doc_id, text, (a - length(regexp_extract(text[1:a], '[\\p{{L}}\\p{{N}}]*$')))::INT AS a, (least(length(text), a + 60) + length(regexp_extract(text[least(length(text), a + 60) + 1:], '^[\\p{{L}}\\p{{N}}]*')))::INT AS b FROM win)"""


@register("snippets", f"WITH {_WINDOWS} SELECT doc_id, a AS start, b AS stop, text[a + 1:b] AS snippet FROM wide")
def snippets(spark, sf_dir):
    """The stretch of each matching text that holds most of the query's words, widened to whole words."""
    return _snippets(spark, sf_dir).select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "snippet")


def _snippets(spark, sf_dir):
    ids = _index(spark, sf_dir).postings.where(F.col("term").isin(*TERMS)).select("doc_id").distinct()
    docs = _docs(spark, sf_dir).join(ids, "doc_id", "left_semi").select("doc_id", "text", T.pieces_at(F.col("text"), TERMS).alias("p"))
    found = docs.select("doc_id", "text", T.spans_of(F.col("p")).alias("s")).select("doc_id", "text", T.best_window(F.col("text"), F.col("s")).alias("w"))
    return found.withColumn("snippet", F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")))


@register(
    "snippet_grades",
    f"""WITH {_WINDOWS}, t AS (SELECT doc_id, {terms_sql('text[a + 1:b]')} AS ts FROM wide), p AS (SELECT doc_id, len(list_distinct(list_filter(ts, lambda x: x IN ({_LISTED})))) / 3 AS coverage,
list_filter(list_transform(ts, lambda x, i: CASE WHEN x IN ({_LISTED}) THEN i END), lambda x: x IS NOT NULL) AS places FROM t)
SELECT count(*) AS snippets, count(*) FILTER (round_even(coverage, 4) < 0.5 OR CASE WHEN len(places) = 0 THEN 0 WHEN len(places) = 1 THEN 1 ELSE least(1, 12 / greatest(places[len(places)] - places[1], 1)) END < 0.5) AS below_par FROM p""",
)
def snippet_grades(spark, sf_dir):
    """Snippets that show less than half of the query's words, or them too far apart."""
    graded = _snippets(spark, sf_dir).select(*T.snippet_grade(F.col("snippet"), TERMS))
    return graded.agg(F.count(F.lit(1)).alias("snippets"), F.count_if((F.col("coverage") < 0.5) | (F.col("density") < 0.5)).alias("below_par"))


TYPED = "thinthqq"


@register(
    "spelled_search",
    f"""WITH {INDEX}, offer AS (SELECT term FROM (SELECT term, count(*) AS df FROM post GROUP BY term) WHERE levenshtein(term, '{TYPED}') <= 2 AND list_has_any(list_transform(generate_series(1, length(term)), lambda i: (chr(2) || term || chr(3))[i:i+2]), list_transform(generate_series(1, {len(TYPED)}), lambda i: (chr(2) || '{TYPED}' || chr(3))[i:i+2])) ORDER BY levenshtein(term, '{TYPED}'), df DESC, term LIMIT 1),
served AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM post WHERE term = '{TYPED}') THEN '{TYPED}' ELSE (SELECT term FROM offer) END AS term), q AS (SELECT p.doc_id, p.term, p.tf, (SELECT count(*) FROM post x WHERE x.term = p.term) AS df FROM post p JOIN served USING (term))
SELECT q.doc_id, round_even(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avgdl)), 4) AS score, term AS searched FROM q JOIN docs USING (doc_id) CROSS JOIN stats ORDER BY score DESC, doc_id LIMIT 10""",
)
def spelled_search(spark, sf_dir):
    """A misspelled query: nothing is found, so the vocabulary's best offer is searched instead."""
    index = _index(spark, sf_dir)
    found, searched = spellchecked(index, TYPED)
    return S.top(found).select("doc_id", "score", F.lit(searched).alias("searched"))


def spellchecked(index, text: str, floor: int = 1):
    """The matches and the query that gave them: the query as typed if it finds ``floor`` documents, else with offers for the words that the vocabulary lacks, if that finds any."""
    literal = S.matches(index, text)
    if literal.limit(floor).count() >= floor:
        return literal, text
    spark = index.postings.sparkSession
    words = text.split()
    plain = [w for w in words if not w.startswith(('"', "+", "-")) and ":" not in w and len(S.analyze(w)) == 1]
    if not plain:
        return literal, text
    asked = spark.createDataFrame([(S.analyze(w)[0],) for w in plain], "word string")
    vocabulary = index.term_stats().groupBy("term").agg(F.sum("df").alias("popularity"))
    offers = {r["word"]: r["offer"] for r in did_you_mean(asked, vocabulary).collect()}  # a row a typed word at most
    corrected = " ".join(offers.get(S.analyze(w)[0], w) if w in plain else w for w in words)
    better = S.matches(index, corrected)
    return (better, corrected) if offers and better.limit(1).count() else (literal, text)


@register(
    "synonym_search",
    f"""WITH {INDEX}, d AS (SELECT term, count(*) AS df FROM post WHERE term IN ('anea', 'eriner', 'que', 'ou') GROUP BY term), s AS (SELECT p.doc_id, round_even(sum(CASE term WHEN 'anea' THEN 1 WHEN 'que' THEN 1 ELSE 0.6 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avgdl))), 4) AS score
FROM post p JOIN d USING (term) JOIN docs USING (doc_id) CROSS JOIN stats GROUP BY p.doc_id) SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 10""",
)
def synonym_search(spark, sf_dir):
    """Typed words count in full, their rings' other words at three fifths."""
    return S.top(S.matches(_index(spark, sf_dir), "anea que", synonyms=S.rings(("anea", "eriner"), ("que", "ou"))))


@register(
    "synonym_required",
    f"WITH {INDEX}, f AS (SELECT d.doc_id FROM docs d WHERE ({has('anea')} OR {has('eriner')}) AND {has('ou')}) SELECT count(*) AS found FROM f",
)
def synonym_required(spark, sf_dir):
    """A required word is there if a word of its ring is."""
    return S.matches(_index(spark, sf_dir), "+anea +ou", synonyms=S.rings(("anea", "eriner"))).agg(F.count(F.lit(1)).alias("found"))


_PLACES = f"{INDEX}, pos AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS p FROM docs)"


@register(
    "proximity",
    f"""WITH {_PLACES}, w AS (SELECT a.doc_id, s.p AS first, greatest(min(a.p), min(b.p), min(c.p)) AS last FROM (SELECT doc_id, p FROM pos WHERE term IN ('anea', 'eriner', 'thinth')) s
JOIN pos a ON a.doc_id = s.doc_id AND a.term = 'anea' AND a.p >= s.p JOIN pos b ON b.doc_id = s.doc_id AND b.term = 'eriner' AND b.p >= s.p JOIN pos c ON c.doc_id = s.doc_id AND c.term = 'thinth' AND c.p >= s.p GROUP BY a.doc_id, s.p),
t AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY doc_id ORDER BY last - first, first) AS r FROM w)
SELECT doc_id, first::INT AS first, last::INT AS last, round_even(CASE WHEN last - first - 2 >= 8 THEN 0 ELSE 1 - (last - first - 2) / 8 END, 6) AS bonus FROM t WHERE r = 1""",
)
def proximity(spark, sf_dir):
    """The tightest stretch of each text that holds three words, and the bonus for it: from one, where they are neighbours, to none, where eight words too many lie between."""
    words = TERMS
    rows = _index(spark, sf_dir).postings.where(F.col("term").isin(*words))
    held = rows.groupBy("doc_id").agg(*(F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))).alias(w) for w in words))
    held = held.where(" and ".join(f"size({w}) > 0" for w in words)).select("doc_id", S.tightest_window([F.col(w) for w in words]).alias("w"))
    slack = F.col("w.width") - (len(words) - 1)
    return held.select("doc_id", "w.first", "w.last", F.bround(F.when(slack >= 8, 0.0).otherwise(1 - slack / 8), 6).alias("bonus"))


@register(
    "cascade_search",
    f"""WITH {INDEX}, exact AS (SELECT d.doc_id FROM docs d WHERE {phrase("attion", "thanedble")} AND {has("anea")} AND {has("eriner")}), loose AS (SELECT d.doc_id FROM docs d WHERE {has("anea")} AND {has("eriner")}), fuzzy AS (SELECT d.doc_id FROM docs d WHERE {has("anea")} OR {has("eriner")})
SELECT CASE WHEN (SELECT count(*) FROM exact) >= 25 THEN 'exact' WHEN (SELECT count(*) FROM loose) >= 25 THEN 'loosened' ELSE 'fuzzy' END AS tier,
CASE WHEN (SELECT count(*) FROM exact) >= 25 THEN (SELECT count(*) FROM exact) WHEN (SELECT count(*) FROM loose) >= 25 THEN (SELECT count(*) FROM loose) ELSE (SELECT count(*) FROM fuzzy) END AS found""",
)
def cascade_search(spark, sf_dir):
    """The strictest of three queries that finds 25 documents."""
    index = _index(spark, sf_dir)
    tiers = {"exact": '+anea +eriner "attion thanedble"', "loosened": "+anea +eriner", "fuzzy": "anea eriner"}
    tier, found, _ = S.cascade({k: S.matches(index, q) for k, q in tiers.items()}, 25)
    return found.agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("found"))


@register(
    "curated_search",
    f"""WITH {INDEX}, {bm25("anea", where=has("anea"))}, pins(doc_id, place) AS (VALUES (11, 0), (3, 1)), o AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) + 1 AS place FROM scored WHERE doc_id NOT IN (11, 3, 7, 20))
SELECT doc_id::BIGINT AS doc_id, (SELECT max(score) FROM scored) AS score, TRUE AS curated, place::INT AS place FROM pins UNION ALL SELECT doc_id, score, FALSE, place::INT FROM o WHERE place < 10""",
)
def curated_search(spark, sf_dir):
    """A page on which two documents are pinned and two are blocked."""
    return S.curated(S.matches(_index(spark, sf_dir), "anea"), pinned=(11, 3), blocked=(7, 20))


_TURNS = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)"


@register(
    "query_forms",
    f"""WITH p AS (SELECT text, list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '' AND NOT contains(w, ':')), lambda w: list_extract({terms_sql('w', 'v')}, 1)), lambda t: t IS NOT NULL) AS t,
list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: contains(w, ':')), lambda w: lower(split_part(w, ':', 1)) || ':' || list_extract({terms_sql("w[strpos(w, ':') + 1:]", "v")}, 1)), lambda t: t IS NOT NULL) AS f FROM {_TURNS})
SELECT array_to_string(list_sort(list_concat(t, f)), ' ') AS form, count(DISTINCT text) AS spellings FROM p WHERE len(t) + len(f) > 0 GROUP BY 1""",
)
def query_forms(spark, sf_dir):
    """Users' turns as queries, folded to one form each: the first term of every word, sorted; and how many spellings share it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' and text is not null").select("text").distinct()
    return turns.groupBy(T.query_form(F.col("text")).alias("form")).agg(F.count(F.lit(1)).alias("spellings")).where("form <> ''")


@register(
    "query_intent",
    f"""WITH {INDEX}, t AS (SELECT term, count(*) AS df FROM post GROUP BY term), q AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM {_TURNS}),
r AS (SELECT conv_id, turn, min(coalesce(df, 0)) AS rarest FROM (SELECT conv_id, turn, unnest({terms_sql()}) AS term FROM q) LEFT JOIN t USING (term) GROUP BY ALL),
v AS (SELECT *, CASE WHEN contains(text, '"') OR regexp_matches(text, '(^|\\s)[A-Za-z_]+:\\S') THEN 2 ELSE 0 END + CASE WHEN len(words) BETWEEN 1 AND 2 THEN 1 ELSE 0 END + CASE WHEN rarest BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS nav,
CASE WHEN lower(words[1]) IN ('who', 'what', 'when', 'where', 'why', 'how', 'which', 'whose') THEN 2 ELSE 0 END AS look, CASE WHEN len(words) >= 5 THEN 1 ELSE 0 END + CASE WHEN rarest > 50 THEN 1 ELSE 0 END AS expl FROM q LEFT JOIN r USING (conv_id, turn) WHERE len(words) > 0)
SELECT CASE WHEN greatest(nav, look, expl) = 0 THEN 'lookup' WHEN nav >= look AND nav >= expl THEN 'navigational' WHEN look >= expl THEN 'lookup' ELSE 'exploratory' END AS intent, count(*) AS queries FROM v GROUP BY 1""",
)
def query_intent(spark, sf_dir):
    """Users' turns as queries by what they seem to want: signs of a known item, a question, or a look around."""
    df = _index(spark, sf_dir).term_stats().select("term", "df")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user' and text is not null").select("conv_id", "turn", "text")
    terms = turns.select("conv_id", "turn", F.explode(T.analyzed_terms(F.col("text"))).alias("term"))
    rarest = terms.join(df, "term", "left").groupBy("conv_id", "turn").agg(F.min(F.coalesce("df", F.lit(0))).alias("rarest"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    asked = turns.join(rarest, ["conv_id", "turn"], "left").withColumn("words", words).where(F.size("words") > 0)
    vote = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    n = F.size("words")
    named = F.contains("text", F.lit('"')) | F.col("text").rlike(r"(^|\s)[A-Za-z_]+:\S")
    votes = asked.select(
        (vote(named, 2) + vote(n <= 2, 1) + vote(F.col("rarest").between(1, 3), 1)).alias("nav"),
        vote(F.lower(F.get("words", F.lit(0))).isin(*T.QUESTION_WORDS), 2).alias("look"),
        (vote(n >= 5, 1) + vote(F.col("rarest") > 50, 1)).alias("expl"),
    )
    intent = F.when(F.greatest("nav", "look", "expl") == 0, "lookup").when((F.col("nav") >= F.col("look")) & (F.col("nav") >= F.col("expl")), "navigational")
    return votes.groupBy(intent.when(F.col("look") >= F.col("expl"), "lookup").otherwise("exploratory").alias("intent")).agg(F.count(F.lit(1)).alias("queries"))


@register(
    "term_trace",
    f"""WITH {INDEX}, q(typed) AS (VALUES ('The'), ('Anea'), ('thinthing'), ('que'), ('zzz')), a AS (SELECT typed, list_extract({terms_sql("typed")}, 1) AS term FROM q)
SELECT typed, a.term AS term, coalesce(tf, 0)::BIGINT AS frequency, (SELECT count(*) FROM post x WHERE x.term = a.term) AS df FROM a LEFT JOIN post p ON p.term = a.term AND p.doc_id = 7""",
)
def term_trace(spark, sf_dir):
    """Why a document does or doesn't match: what each typed word became, and how often it and the corpus hold it."""
    typed = spark.createDataFrame([(w,) for w in ("The", "Anea", "thinthing", "que", "zzz")], "typed string").withColumn("term", F.get(T.analyzed_terms(F.col("typed")), F.lit(0)))
    index = _index(spark, sf_dir)
    wanted = [r["term"] for r in typed.where("term is not null").collect()]  # a row a typed word
    own = index.postings.where(F.col("term").isin(*wanted) & (F.col("doc_id") == 7)).select("term", F.col("tf").cast("long").alias("tf"))
    df = index.term_stats().where(F.col("term").isin(*wanted)).select("term", "df")
    found = typed.join(F.broadcast(own), "term", "left").join(F.broadcast(df), "term", "left")
    return found.select("typed", "term", F.coalesce("tf", F.lit(0)).alias("frequency"), F.coalesce("df", F.lit(0)).alias("df"))


@register("coverage_grades", f"WITH {INDEX}, c AS (SELECT d.doc_id, count(term) AS n FROM docs d LEFT JOIN post p USING (doc_id) GROUP BY d.doc_id) SELECT CASE WHEN n = 0 THEN 'orphan' WHEN n <= 2 THEN 'thin' ELSE 'rich' END AS grade, count(*) AS docs FROM c GROUP BY 1")
def coverage_grades(spark, sf_dir):
    """Documents by whether any search can reach them: by no term, by one or two, by more."""
    index = _index(spark, sf_dir)
    held = index.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    every = index.lengths.select("doc_id").distinct().join(held, "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    grade = F.when(F.col("n") == 0, "orphan").when(F.col("n") <= 2, "thin").otherwise("rich")
    return every.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("docs"))


@register(
    "index_digests",
    f"""WITH {INDEX} SELECT (doc_id % 8)::INT AS segment, count(*) AS postings, count(DISTINCT doc_id) AS docs, (sum(('0x' || sha256('text|' || term || '|' || doc_id || ':' || tf)[1:12])::BIGINT) % 1000000007)::BIGINT AS digest FROM post GROUP BY 1""",
)
def index_digests(spark, sf_dir):
    """A manifest of an index's segments (here by id): counts and a digest that doesn't depend on the order of postings, so parts add up."""
    index = _index(spark, sf_dir)
    posts = index.postings
    line = F.concat_ws("|", F.lit("text"), "term", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("tf").cast("string")))
    number = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = posts.groupBy((F.col("doc_id") % 8).cast("int").alias("segment")).agg(F.count(F.lit(1)).alias("postings"), F.sum(number).alias("s"))
    docs = index.lengths.where("length > 0").select("doc_id").distinct().groupBy((F.col("doc_id") % 8).cast("int").alias("segment")).agg(F.count(F.lit(1)).alias("docs"))
    return sums.join(docs, "segment").select("segment", "postings", "docs", (F.col("s") % 1000000007).cast("long").alias("digest"))


@register(
    "ranking_quality",
    """WITH j AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, sum(quality) OVER (PARTITION BY source) AS good, row_number() OVER (PARTITION BY source ORDER BY quality DESC) AS ideal FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT source, round_even(sum(quality) FILTER (r <= 5) / 5, 4) AS precision_at_5, round_even(coalesce(sum(quality) FILTER (r <= 5), 0) / nullif(any_value(good), 0), 4) AS recall_at_5,
round_even(sum(quality / log2(r + 1)) FILTER (r <= 5) / nullif(sum(quality / log2(ideal + 1)) FILTER (ideal <= 5), 0), 4) AS ndcg_at_5 FROM j GROUP BY source""",
)
def ranking_quality(spark, sf_dir):
    """Precision, recall and discounted gain of each source's five longest labelled documents, by their labels."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = read("documents").join(read("labels").where("quality is not null"), "doc_id").select("source", "quality", "n_chars", "doc_id")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 5")
    gains = top.groupBy("source").agg(F.sum("quality").alias("hits"), F.sum(F.col("quality") / F.log2(F.col("r") + 1)).alias("gain"))
    # The best order has the good ones first, so the ideal gain needs their number alone.
    good = rows.groupBy("source").agg(F.sum("quality").alias("good"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("good"), F.lit(5)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / F.log2(k.cast("double") + 1))
    both = gains.join(good, "source")
    ndcg = F.when(F.col("good") > 0, F.bround(F.col("gain") / ideal, 4))
    return both.select("source", F.bround(F.col("hits") / 5, 4).alias("precision_at_5"), F.bround(F.try_divide("hits", "good"), 4).alias("recall_at_5"), ndcg.alias("ndcg_at_5"))
