"""Queries over corpus shape, sketches, samples and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators.index import stored_index
from tessera.operators.ranking import running_sum
from tessera.operators.sketches import bloom_bits, bloom_members, bloom_size, hash64
from tessera.plans.catalog import register
from tessera.plans.oracles import INDEX, terms_sql


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark, sf_dir):
    return stored_index(_table(spark, sf_dir, "documents"), {"text": F.col("text")})


def _terms(spark, sf_dir):
    """doc_id, term and tf, from the documents' stored index."""
    return _index(spark, sf_dir).postings.select("doc_id", "term", "tf")


def _counts(spark, sf_dir):
    """term, df and tf over all documents."""
    return _index(spark, sf_dir).term_stats().select("term", "df", F.col("total_tf").alias("tf"))


_HASH = "('0x' || sha256({0})[1:16])::UBIGINT"


@register("corpus_shape", f"""WITH {INDEX}, t AS (SELECT term, sum(tf) AS tf FROM post GROUP BY term) SELECT sum(tf)::BIGINT AS occurrences, count(*) AS vocabulary,
round_even((SELECT sum(tf) FROM (SELECT tf FROM t ORDER BY tf DESC LIMIT 10)) / sum(tf), 4) AS top_share, round_even(count(*) FILTER (tf = 1) / count(*), 4) AS hapax_share FROM t""")
def corpus_shape(spark, sf_dir):
    totals = _counts(spark, sf_dir)
    top = totals.orderBy(F.desc("tf")).limit(10).agg(F.sum("tf").alias("top"), F.lit(1).alias("_one"))
    whole = totals.agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("vocabulary"), F.sum((F.col("tf") == 1).cast("long")).alias("once"), F.lit(1).alias("_one"))
    both = whole.join(F.broadcast(top), "_one")
    return both.select("occurrences", "vocabulary", F.bround(F.col("top") / F.col("occurrences"), 4).alias("top_share"), F.bround(F.col("once") / F.col("vocabulary"), 4).alias("hapax_share"))


@register("df_histogram", f"WITH {INDEX} SELECT CASE WHEN df = 1 THEN '1' WHEN df <= 10 THEN '2-10' WHEN df <= 100 THEN '11-100' ELSE '100+' END AS bucket, count(*) AS terms FROM (SELECT term, count(*) AS df FROM post GROUP BY term) GROUP BY 1")
def df_histogram(spark, sf_dir):
    df = _counts(spark, sf_dir)
    bucket = F.when(F.col("df") == 1, "1").when(F.col("df") <= 10, "2-10").when(F.col("df") <= 100, "11-100").otherwise("100+")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("terms"))


@register("vocabulary_growth", f"WITH {INDEX} SELECT step, sum(n) OVER (ORDER BY step)::BIGINT AS vocabulary FROM (SELECT first // 100 AS step, count(*) AS n FROM (SELECT term, min(doc_id) AS first FROM post GROUP BY term) GROUP BY 1)")
def vocabulary_growth(spark, sf_dir):
    """Distinct terms by every hundred documents: each term counts where it is first seen."""
    firsts = _terms(spark, sf_dir).groupBy("term").agg(F.min("doc_id").alias("first"))
    steps = firsts.groupBy(F.floor(F.col("first") / 100).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(steps, "step", "n", "vocabulary").select("step", "vocabulary")


@register("stopword_nominate", f"""WITH {INDEX}, q AS (SELECT DISTINCT unnest({terms_sql()}) AS term FROM conversations WHERE role = 'user')
SELECT term, round_even(df / n, 4) AS share, term IN (SELECT term FROM q) AS vetoed FROM (SELECT term, count(*) AS df FROM post GROUP BY term) CROSS JOIN stats WHERE df / n >= 0.6 OR (df / n >= 0.2 AND term IN (SELECT term FROM q))""")
def stopword_nominate(spark, sf_dir):
    """Terms in three fifths of the documents, and whether users' own words veto them; terms of a fifth are shown where they do."""
    index = _index(spark, sf_dir)
    users = _table(spark, sf_dir, "conversations").where("role = 'user'").select(F.explode(T.analyzed_terms(F.col("text"))).alias("term")).distinct()
    share = F.col("df") / F.col("n_docs")
    often = index.term_stats().join(F.broadcast(index.field_stats()), "field").where(share >= 0.2).select("term", share.alias("s"))
    asked = often.join(users.withColumn("vetoed", F.lit(True)), "term", "left").withColumn("vetoed", F.coalesce("vetoed", F.lit(False)))
    return asked.where("s >= 0.6 or vetoed").select("term", F.bround("s", 4).alias("share"), "vetoed")


def _register_of(member: Column) -> tuple[Column, Column]:
    """The register of 64 that a member falls in, and the place of the first one bit in the other 58 bits of its hash."""
    bits = F.lpad(F.conv(F.substring(F.sha2(member, 256), 1, 16), 16, 2), 64, "0")
    place = F.instr(F.substring(bits, 1, 58), "1")
    return F.conv(F.substring(bits, 59, 6), 2, 10).cast("int"), F.when(place == 0, 59).otherwise(place)


_RHO = f"SELECT event_type, user_id, (h & 63)::INT AS register, CASE WHEN h >> 6 = 0 THEN 59 ELSE 59 - length(bin(h >> 6)) END::INT AS rho FROM (SELECT event_type, user_id, {_HASH.format('user_id::VARCHAR')} AS h FROM events)"


@register("hll_registers", f"SELECT register, max(rho) AS rho FROM ({_RHO}) GROUP BY register")
def hll_registers(spark, sf_dir):
    """The registers of a distinct counter: for each of 64 the first one bit that came latest; they merge by maximum."""
    register, rho = _register_of(F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select(register.alias("register"), rho.alias("rho")).groupBy("register").agg(F.max("rho").alias("rho"))


@register("hll_estimate", f"""WITH r AS (SELECT event_type, register, max(rho) AS rho FROM ({_RHO}) GROUP BY ALL), e AS (SELECT event_type, 0.709 * 64 * 64 / (sum(power(2.0, -rho)) + 64 - count(*)) AS raw FROM r GROUP BY event_type)
SELECT event_type, n <= 192 AS exact, CASE WHEN n <= 192 THEN n ELSE round_even(raw, 0)::BIGINT END AS users FROM e JOIN (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1) USING (event_type)""")
def hll_estimate(spark, sf_dir):
    """Distinct users by event type: counted exactly up to 192, estimated from the registers beyond."""
    events = _table(spark, sf_dir, "events")
    register, rho = _register_of(F.col("user_id").cast("string"))
    registers = events.select("event_type", register.alias("register"), rho.alias("rho")).groupBy("event_type", "register").agg(F.max("rho").alias("rho"))
    raw = registers.groupBy("event_type").agg((0.709 * 64 * 64 / (F.sum(F.pow(F.lit(2.0), -F.col("rho"))) + 64 - F.count(F.lit(1)))).alias("raw"))
    few = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    both = raw.join(few, "event_type")
    return both.select("event_type", (F.col("n") <= 192).alias("exact"), F.when(F.col("n") <= 192, F.col("n")).otherwise(F.bround("raw", 0).cast("long")).alias("users"))


@register("distinct_users", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


# Upper edges of the histogram's buckets.
EDGES = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)


def _edge_sql(value: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {e} THEN {e}" for e in EDGES) + " ELSE 5001 END"


@register("quantile_buckets", f"""WITH b AS (SELECT event_type, {_edge_sql('value')} AS edge, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY edge) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b)
SELECT event_type, min(edge) FILTER (upto >= 0.5 * total) AS p50, min(edge) FILTER (upto >= 0.95 * total) AS p95 FROM c GROUP BY event_type""")
def quantile_buckets(spark, sf_dir):
    """Quantiles of a fixed-edge histogram, which merges by sums: the upper edge where the share is reached."""
    edge = F.lit(5001)
    for e in reversed(EDGES):
        edge = F.when(F.col("value") <= e, e).otherwise(edge)
    counts = _table(spark, sf_dir, "events").groupBy("event_type", edge.alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type")  # a row an edge
    rows = counts.withColumns({"upto": F.sum("n").over(w.orderBy("edge")), "total": F.sum("n").over(w)})
    reached = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("edge")))
    return rows.groupBy("event_type").agg(reached(0.5).alias("p50"), reached(0.95).alias("p95"))


@register("reservoir", f"SELECT doc_id FROM documents ORDER BY {_HASH.format(chr(39) + 'audit|' + chr(39) + ' || doc_id')} DESC, doc_id LIMIT 20")
def reservoir(spark, sf_dir):
    """A sample that doesn't depend on the order of rows: the highest hashed priorities."""
    return _table(spark, sf_dir, "documents").orderBy(F.desc(hash64(F.concat(F.lit("audit|"), F.col("doc_id").cast("string")))), "doc_id").limit(20).select("doc_id")


@register("noisy_counts", f"""WITH {INDEX}, t AS (SELECT term, count(*) AS n FROM post GROUP BY term HAVING count(*) >= 10) SELECT term, greatest(10, (round_even((n + ('0x' || sha256(term || '|week')[1:2])::INT % 10 - 5) / 10.0, 0) * 10)::BIGINT) AS published FROM t""")
def noisy_counts(spark, sf_dir):
    """Counts of ten or more with a hashed jitter, rounded to tens (halves to even)."""
    counts = _terms(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    jitter = F.conv(F.substring(F.sha2(F.concat("term", F.lit("|week")), 256), 1, 2), 16, 10).cast("long") % 10 - 5
    return counts.select("term", F.greatest(F.lit(10), F.bround((F.col("n") + jitter) / 10.0, 0) * 10).cast("long").alias("published"))


_BLOOM = f"""s AS (SELECT greatest(1, count(*)) AS n, greatest(8, ceil(-greatest(1, count(*)) * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS bits FROM documents), z AS (SELECT n, bits, greatest(1, round_even(bits / n * ln(2), 0))::BIGINT AS hashes FROM s),
k AS (SELECT doc_id, unnest(generate_series(0, hashes - 1)) AS k, bits FROM documents CROSS JOIN z), b AS (SELECT DISTINCT {_HASH.format("k::VARCHAR || '|' || doc_id::VARCHAR")} % bits::UBIGINT AS bit FROM k)"""


@register("bloom_filter", f"""WITH {_BLOOM}, p AS (SELECT i, unnest(generate_series(0, hashes - 1)) AS k, bits FROM generate_series(0, 499) t(i) CROSS JOIN z),
q AS (SELECT i, bool_and({_HASH.format("k::VARCHAR || '|never-added-' || i::VARCHAR")} % bits::UBIGINT IN (SELECT bit FROM b)) AS hit FROM p GROUP BY i)
SELECT bits, hashes, (SELECT count(*) FROM b) AS bits_set, (SELECT count(*) FILTER (hit) FROM q) AS false_hits FROM z""")
def bloom_filter(spark, sf_dir):
    """A filter sized for the documents at one false hit in a hundred: its bits and hashes, the bits set, and the hits of 500 keys that were never added."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"))
    n = docs.count()
    bits, hashes = bloom_size(n, 0.01)
    held = bloom_bits(docs, "key", bits, hashes)
    probes = spark.range(500).select(F.concat(F.lit("never-added-"), F.col("id").cast("string")).alias("key"))
    hits = bloom_members(probes, "key", held, bits, hashes)
    return held.agg(F.lit(bits).cast("long").alias("bits"), F.lit(hashes).cast("long").alias("hashes"), F.count(F.lit(1)).alias("bits_set")).join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("false_hits"))))


@register("bloom_members", "SELECT count(*) AS found FROM documents WHERE doc_id IS NOT NULL")
def bloom_members_query(spark, sf_dir):
    """Every key that was added is found."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key")).where("key is not null")
    bits, hashes = bloom_size(docs.count(), 0.01)
    return bloom_members(docs, "key", bloom_bits(docs, "key", bits, hashes), bits, hashes).agg(F.count(F.lit(1)).alias("found"))


@register("cohens_kappa", """SELECT round_even((o - e) / (1 - e), 4) AS kappa, n FROM (SELECT avg((a = b)::INT) AS o, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS e, count(*) AS n
FROM (SELECT quality AS a, (n_chars >= 400)::INT AS b FROM labels JOIN documents USING (doc_id)))""")
def cohens_kappa(spark, sf_dir):
    """Agreement beyond chance of two judges: the labels, and a length rule."""
    j = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").alias("a"), (F.col("n_chars") >= 400).cast("int").alias("b"))
    s = j.agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("o"), F.avg("a").alias("x"), F.avg("b").alias("y"), F.count(F.lit(1)).alias("n"))
    e = F.col("x") * F.col("y") + (1 - F.col("x")) * (1 - F.col("y"))
    return s.select(F.bround(F.try_divide(F.col("o") - e, 1 - e), 4).alias("kappa"), "n")


@register("precision_recall", """SELECT round_even(count(*) FILTER (p AND q) / count(*) FILTER (p), 4) AS precision, round_even(count(*) FILTER (p AND q) / count(*) FILTER (q), 4) AS recall
FROM (SELECT n_chars >= 400 AS p, quality = 1 AS q FROM labels JOIN documents USING (doc_id))""")
def precision_recall(spark, sf_dir):
    j = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id").select((F.col("n_chars") >= 400).alias("p"), (F.col("quality") == 1).alias("q"))
    both = F.count(F.when(F.col("p") & F.col("q"), 1))
    share = lambda c: F.bround(F.try_divide(both, F.count(F.when(F.col(c), 1))), 4)
    return j.agg(share("p").alias("precision"), share("q").alias("recall"))


@register("mean_reciprocal_rank", """SELECT round_even(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM (SELECT source, min(r) FILTER (quality = 1) AS first
FROM (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)) WHERE r <= 10 GROUP BY source)""")
def mean_reciprocal_rank(spark, sf_dir):
    """Of each source's ten longest labelled documents the rank of the first good one."""
    j = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    ranked = j.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 10")
    firsts = ranked.groupBy("source").agg(F.min(F.when(F.col("quality") == 1, F.col("r"))).alias("first"))
    return firsts.agg(F.bround(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


@register("growth_fit", """SELECT round_even(regr_slope(n, p), 4) AS slope, round_even(regr_intercept(n, p), 4) AS intercept FROM (SELECT (year(o_orderdate) - 1992)::DOUBLE AS p, count(*)::DOUBLE AS n FROM orders GROUP BY 1)""")
def growth_fit(spark, sf_dir):
    years = _table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") - 1992).cast("double").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return years.agg(F.bround(F.regr_slope("n", "p"), 4).alias("slope"), F.bround(F.regr_intercept("n", "p"), 4).alias("intercept"))


@register("seasonal", """SELECT month, year, n, round_even(expected, 4) AS expected, coalesce(n > 2 * expected, FALSE) AS spike FROM (SELECT month, year, n, avg(n) OVER (PARTITION BY month ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected
FROM (SELECT month(o_orderdate)::INT AS month, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY ALL))""")
def seasonal(spark, sf_dir):
    """Each month against the mean of the same month in earlier years; a spike is over twice as much."""
    months = _table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("month").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # a row a year
    expected = months.withColumn("e", F.avg("n").over(before))
    return expected.select("month", "year", "n", F.bround("e", 4).alias("expected"), F.coalesce(F.col("n") > 2 * F.col("e"), F.lit(False)).alias("spike"))


@register("taxonomy_rollup", """SELECT r_name, n_name, count(*) AS customers, round_even(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def taxonomy_rollup(spark, sf_dir):
    joined = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.bround(F.sum("c_acctbal"), 2).alias("balance"))


@register("storage_estimate", f"WITH {INDEX} SELECT (8 * count(*) + 4 * sum(tf) + (SELECT sum(length(text)) FROM documents) + 16)::BIGINT AS bytes FROM post")
def storage_estimate(spark, sf_dir):
    posts = _terms(spark, sf_dir).agg((8 * F.count(F.lit(1)) + 4 * F.sum("tf")).alias("a"), F.lit(1).alias("_one"))
    chars = _table(spark, sf_dir, "documents").agg(F.sum(F.length("text")).alias("b"), F.lit(1).alias("_one"))
    return posts.join(F.broadcast(chars), "_one").select((F.col("a") + F.col("b") + 16).alias("bytes"))


@register("field_coverage", "SELECT lang, count(*) AS docs, count(text) AS with_text, count(*) FILTER (n_chars = 0 OR text = '') AS empty FROM documents GROUP BY lang")
def field_coverage(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count("text").alias("with_text"), F.count(F.when((F.col("n_chars") == 0) | (F.col("text") == ""), 1)).alias("empty"))


@register("clean_feed", "SELECT reason, count(*) AS pages FROM (SELECT CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN length(html) < 700 THEN 'short' WHEN contains(url, '?') THEN 'parameters' ELSE 'ok' END AS reason FROM pages) GROUP BY reason")
def clean_feed(spark, sf_dir):
    """Rows of a feed by the first reason to refuse them; a bad row is a value, not an error."""
    reason = F.when(F.col("html").isNull() | (F.col("html") == ""), "empty").when(F.length("html") < 700, "short").when(F.col("url").contains("?"), "parameters").otherwise("ok")
    return _table(spark, sf_dir, "pages").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("pages"))


@register("snapshot_diff", """WITH a AS (SELECT p_partkey, md5(p_name || '|' || p_size) AS d FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, md5(p_name || '|' || CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END) AS d FROM part WHERE p_partkey % 5 <> 0)
SELECT CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b USING (p_partkey) GROUP BY 1""")
def snapshot_diff(spark, sf_dir):
    """Added, removed and changed rows of two snapshots, by digests; the snapshots are made from one table by rule."""
    part = _table(spark, sf_dir, "part")
    digest = lambda size: F.md5(F.concat_ws("|", "p_name", size.cast("string")))
    a = part.where("p_partkey % 7 <> 0").select("p_partkey", digest(F.col("p_size")).alias("a"))
    b = part.where("p_partkey % 5 <> 0").select("p_partkey", digest(F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "p_partkey", "full").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@register("shard_route", f"SELECT ({_HASH.format('doc_id::VARCHAR')} % 8)::INT AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_route(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy((hash64(F.col("doc_id").cast("string")) % 8).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@register("ab_split", "SELECT arm, count(*) AS users FROM (SELECT DISTINCT user_id, CASE WHEN ('0x' || sha256('ranking\\x00'::BLOB || user_id::VARCHAR::BLOB)[1:16])::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.3 THEN 'treatment' ELSE 'control' END AS arm FROM events) GROUP BY arm")
def ab_split(spark, sf_dir):
    """Users dealt to arms by a hash of experiment and user."""
    share = hash64(F.concat(F.lit("ranking\x00"), F.col("user_id").cast("string"))).cast("double") / 18446744073709551616.0
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    return users.groupBy(F.when(share < 0.3, "treatment").otherwise("control").alias("arm")).agg(F.count(F.lit(1)).alias("users"))


@register("geo_nearest", """WITH c AS (SELECT c_custkey, (c_custkey * 7 % 120 - 60)::DOUBLE AS lat, (c_custkey * 13 % 340 - 170)::DOUBLE AS lon FROM customer)
SELECT c_custkey, round_even(12742 * asin(sqrt(power(sin(radians(lat - 48) / 2), 2) + cos(radians(48)) * cos(radians(lat)) * power(sin(radians(lon - 2) / 2), 2))), 3) AS km FROM c WHERE lat BETWEEN 38 AND 58 AND lon BETWEEN -13 AND 17 ORDER BY km, c_custkey LIMIT 10""")
def geo_nearest(spark, sf_dir):
    """The nearest points to one place: a box first, then great circles. Coordinates come from keys."""
    points = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 120 - 60).cast("double").alias("lat"), (F.col("c_custkey") * 13 % 340 - 170).cast("double").alias("lon"))
    near = points.where("lat between 38 and 58 and lon between -13 and 17")
    h = F.pow(F.sin(F.radians(F.col("lat") - 48) / 2), 2) + F.cos(F.radians(F.lit(48.0))) * F.cos(F.radians("lat")) * F.pow(F.sin(F.radians(F.col("lon") - 2) / 2), 2)
    return near.select("c_custkey", F.bround(12742 * F.asin(F.sqrt(h)), 3).alias("km")).orderBy("km", "c_custkey").limit(10)
