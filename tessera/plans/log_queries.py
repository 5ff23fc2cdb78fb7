"""Queries over event logs: sessions, trends, experiments and click statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.index import stored_index
from tessera.operators.ranking import values_at
from tessera.plans.catalog import register
from tessera.plans.oracles import INDEX
from tessera.streaming import logs


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_MARKED = """m AS (SELECT *, CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)"""


def _sessions(spark, sf_dir):
    """Events with the number of their user's session: a pause longer than 30 minutes opens one, an equal one does not."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = _events(spark, sf_dir).withColumn("prev", F.lag("ts").over(by_user))
    fresh = F.when(F.col("prev").isNull() | (F.col("ts") > F.col("prev") + F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0)
    return marked.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(by_user))


@register("sessions", f"WITH {_MARKED} SELECT user_id, session::BIGINT AS session, count(*) AS n_events, (max(epoch_us(ts)) - min(epoch_us(ts))) AS length_us FROM s GROUP BY ALL")
def sessions(spark, sf_dir):
    """Sessions numbered by user; events merge into sessions first, so the numbering sees a row a session."""
    found = logs.sessions(_events(spark, sf_dir))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    number = F.row_number().over(Window.partitionBy("user").orderBy("start")).cast("long")
    return found.select(F.col("user").alias("user_id"), number.alias("session"), "n_events", (micros("end") - micros("start") - 30 * 60 * 1_000_000).alias("length_us"))


@register("session_windows", f"WITH {_MARKED} SELECT n_events, count(*) AS sessions FROM (SELECT user_id, session, count(*) AS n_events FROM s GROUP BY ALL) GROUP BY n_events")
def session_windows(spark, sf_dir):
    """Sessions by the streaming operator: sizes and how often each occurs."""
    return logs.sessions(_events(spark, sf_dir)).groupBy("n_events").agg(F.count(F.lit(1)).alias("sessions"))


@register("session_success", f"WITH {_MARKED} SELECT round_even(avg((last = 'purchase')::INT), 4) AS success, count(*) AS sessions FROM (SELECT user_id, session, arg_max(event_type, (ts, event_id)) AS last FROM s GROUP BY ALL)")
def session_success(spark, sf_dir):
    """The share of sessions whose last event is a purchase."""
    last = logs.sessions(_events(spark, sf_dir), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return last.agg(F.bround(F.avg((F.col("last.event_type") == "purchase").cast("int")), 4).alias("success"), F.count(F.lit(1)).alias("sessions"))


@register("reformulations", f"WITH {_MARKED} SELECT event_type, next_type, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS next_type FROM s) WHERE event_type = 'error' AND next_type <> 'error' GROUP BY ALL HAVING count(*) >= 3")
def reformulations(spark, sf_dir):
    """What follows a failure within a session."""
    step = F.lead("event_type").over(Window.partitionBy("user_id", "session").orderBy("ts", "event_id"))
    moved = _sessions(spark, sf_dir).withColumn("next_type", step).where("event_type = 'error' and next_type <> 'error'")
    return moved.groupBy("event_type", "next_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@register("trending", """WITH c AS (SELECT user_id AS key, count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-12') AS now FROM events GROUP BY user_id)
SELECT *, CASE WHEN before = 0 AND now >= 5 THEN 'newborn' WHEN before > 0 AND now >= 5 AND now >= 2 * before THEN 'rising' WHEN before >= 5 AND (now = 0 OR before >= 2 * now) THEN 'falling' END AS trend FROM c WHERE trend IS NOT NULL""")
def trending(spark, sf_dir):
    from datetime import datetime

    counts = logs.trending(_events(spark, sf_dir), "user_id")
    return logs.rising(counts, datetime(2024, 1, 10), datetime(2024, 1, 11))


@register("retention", """WITH f AS (SELECT user_id, min(ts)::DATE AS first FROM events GROUP BY user_id) SELECT date_diff('week', DATE '2024-01-01', first) AS cohort, (ts::DATE - first) // 7 AS week, count(DISTINCT user_id) AS users FROM events JOIN f USING (user_id) GROUP BY ALL""")
def retention(spark, sf_dir):
    """Users of each weekly cohort who are back in later weeks."""
    firsts = _events(spark, sf_dir).groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first"))
    seen = _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct().join(firsts, "user_id")
    week = F.floor(F.datediff("day", "first") / 7)
    return seen.groupBy(F.floor(F.datediff("first", F.lit("2024-01-01")) / 7).alias("cohort"), week.alias("week")).agg(F.count_distinct("user_id").alias("users"))


@register("decay_top", "SELECT user_id, round_even(sum(power(0.5, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0 / 7)), 4) AS weight FROM events GROUP BY user_id ORDER BY weight DESC, user_id LIMIT 10")
def decay_top(spark, sf_dir):
    """Weights that halve each week."""
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000.0 / 7
    weights = _events(spark, sf_dir).groupBy("user_id").agg(F.bround(F.sum(F.pow(F.lit(0.5), age)), 4).alias("weight"))
    return weights.orderBy(F.desc("weight"), "user_id").limit(10)


@register("click_rates", """SELECT event_id % 10 AS position, round_even(count(*) FILTER (event_type = 'click') / (count(*) * (1.0 / (1 + event_id % 10))), 4) AS corrected FROM events GROUP BY 1""")
def click_rates(spark, sf_dir):
    """Clicks over looks, where a place's looks fall with its rank; the place comes from the id here."""
    place = F.col("event_id") % 10
    clicks = F.count(F.when(F.col("event_type") == "click", 1))
    return _events(spark, sf_dir).groupBy(place.alias("position")).agg((clicks / F.count(F.lit(1))).alias("rate")).select("position", F.bround(F.col("rate") * (1 + F.col("position")), 4).alias("corrected"))


@register(
    "slow_percentiles",
    "SELECT event_type, v[floor(0.5 * (len(v) - 1) + 0.5)::INT + 1] AS p50, v[floor(0.95 * (len(v) - 1) + 0.5)::INT + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)",
)
def slow_percentiles(spark, sf_dir):
    """Exact values at the nearest places to a half and to 95 in a hundred of each type's events, halves up."""
    return values_at(_events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@register("week_over_week", """SELECT week, n, change, CASE WHEN before IS NULL OR abs(change) <= 0.05 * before THEN 'steady' WHEN change > 0 THEN 'better' ELSE 'worse' END AS direction
FROM (SELECT *, coalesce(n - before, 0) AS change FROM (SELECT *, lag(n) OVER (ORDER BY week) AS before FROM (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) // 7 AS week, count(*) AS n FROM events GROUP BY 1)))""")
def week_over_week(spark, sf_dir):
    """Events by week against the week before; moves of up to a twentieth are steady."""
    weeks = _events(spark, sf_dir).groupBy(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    before = weeks.withColumn("before", F.lag("n").over(Window.orderBy("week")))  # a row a week
    change = F.coalesce(F.col("n") - F.col("before"), F.lit(0))
    direction = F.when(F.col("before").isNull() | (F.abs(change) <= 0.05 * F.col("before")), "steady").when(change > 0, "better").otherwise("worse")
    return before.select("week", "n", change.alias("change"), direction.alias("direction"))


@register("user_quota", """SELECT day::VARCHAR AS day, count(*) AS refused FROM (SELECT ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS r FROM events) WHERE r > 3 GROUP BY day""")
def user_quota(spark, sf_dir):
    """Requests beyond a daily quota of three a user; how many they are needs counts alone."""
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.where("n > 3").groupBy("day").agg(F.sum(F.col("n") - 3).alias("refused"))


@register("ranking_moves", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 20), b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) - doc_id DESC, doc_id) AS r FROM documents QUALIFY r <= 20)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.r IS NULL THEN 'enters' WHEN b.r IS NULL THEN 'leaves' ELSE 'moves' END AS kind, abs(coalesce(a.r, 21) - coalesce(b.r, 21))::INT AS distance FROM a FULL JOIN b USING (doc_id)""")
def ranking_moves(spark, sf_dir):
    """Footrule distances of two rankings, cut at twenty, with what enters and leaves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def top(score, name):
        cut = docs.select("doc_id", score.alias("s")).orderBy(F.desc("s"), "doc_id").limit(20)
        return cut.select("doc_id", F.row_number().over(Window.orderBy(F.desc("s"), "doc_id")).alias(name))  # twenty rows

    both = top(F.col("n_chars"), "a").join(top(F.length("text") - F.col("doc_id"), "b"), "doc_id", "full")
    kind = F.when(F.col("a").isNull(), "enters").when(F.col("b").isNull(), "leaves").otherwise("moves")
    return both.select("doc_id", kind.alias("kind"), F.abs(F.coalesce("a", F.lit(21)) - F.coalesce("b", F.lit(21))).alias("distance"))


@register("error_budget", "SELECT day, n, errors, round_even(errors / n / 0.2, 4) AS burn FROM (SELECT ts::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) WHERE n >= 20")
def error_budget(spark, sf_dir):
    """How fast each day's failures use up a budget of a fifth, once there are twenty samples."""
    days = _events(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    return days.where("n >= 20").select("day", "n", "errors", F.bround(F.col("errors") / F.col("n") / 0.2, 4).alias("burn"))


@register("missed_beats", "SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) // 43200000000 AS missed FROM events GROUP BY user_id HAVING (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) // 43200000000 >= 1")
def missed_beats(spark, sf_dir):
    """Users silent for half a day or more before a point in time."""
    silent = F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.max(F.col("ts").cast("timestamp")))
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.floor(silent / 43200000000).alias("missed"))
    return last.where("missed >= 1")


@register("train_test_split", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' ELSE 'test' END AS side, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def train_test_split(spark, sf_dir):
    """Events by a day: what comes before it, and what does not."""
    side = F.when(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"), "train").otherwise("test")
    return _events(spark, sf_dir).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


_PROFILE = """(SELECT doc_id % 2 AS half, sum(tf) / count(DISTINCT doc_id) AS avg_length, 1000 * count(DISTINCT term) / sum(tf) AS vocab_per_thousand FROM post GROUP BY 1) JOIN (SELECT half, max(c) / sum(c) AS top_term_share FROM (SELECT doc_id % 2 AS half, term, sum(tf) AS c FROM post GROUP BY ALL) GROUP BY half) USING (half)"""


@register(
    "corpus_drift",
    f"""WITH {INDEX}, r AS (SELECT * FROM {_PROFILE}), m AS (SELECT unnest(['avg_length', 'vocab_per_thousand', 'top_term_share']) AS metric, unnest([a.avg_length, a.vocab_per_thousand, a.top_term_share]) AS base, unnest([b.avg_length, b.vocab_per_thousand, b.top_term_share]) AS seen, unnest([0.2, 0.3, 0.5]) AS tolerance
FROM r a JOIN r b ON a.half = 0 AND b.half = 1) SELECT metric, round_even((seen - base) / base, 4) AS moved, abs((seen - base) / base) > tolerance AS breach FROM m""",
)
def corpus_drift(spark, sf_dir):
    """Mean length, vocabulary and the commonest term's share of one half of the corpus against the other's, and which break their tolerances."""
    posts = stored_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), {"text": F.col("text")}).postings.withColumn("half", F.col("doc_id") % 2)
    by_term = posts.groupBy("half", "term").agg(F.sum("tf").alias("c")).groupBy("half").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("terms"), F.max("c").alias("most"))
    docs = posts.select("half", "doc_id").distinct().groupBy("half").agg(F.count(F.lit(1)).alias("docs"))
    shape = by_term.join(docs, "half").select("half", (F.col("total") / F.col("docs")).alias("avg_length"), (1000 * F.col("terms") / F.col("total")).alias("vocab_per_thousand"), (F.col("most") / F.col("total")).alias("top_term_share"))
    tolerances = {"avg_length": 0.2, "vocab_per_thousand": 0.3, "top_term_share": 0.5}
    side = lambda k, m: F.max(F.when(F.col("half") == k, F.col(m)))
    both = shape.agg(F.array(*(F.struct(F.lit(m).alias("metric"), side(0, m).alias("base"), side(1, m).alias("seen"), F.lit(t).alias("tolerance")) for m, t in tolerances.items())).alias("rows"))
    moved = (F.col("r.seen") - F.col("r.base")) / F.col("r.base")
    return both.select(F.explode("rows").alias("r")).select("r.metric", F.bround(moved, 4).alias("moved"), (F.abs(moved) > F.col("r.tolerance")).alias("breach"))


@register("funnel", "SELECT count(*) FILTER (v) AS viewed, count(*) FILTER (v AND c) AS clicked, count(*) FILTER (v AND c AND p) AS bought FROM (SELECT user_id, ts::DATE AS day, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events GROUP BY ALL)")
def funnel(spark, sf_dir):
    """User days that saw, clicked and bought."""
    did = lambda kind: F.bool_or(F.col("event_type") == kind)
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(did("view").alias("v"), did("click").alias("c"), did("purchase").alias("p"))
    return days.agg(F.count_if("v").alias("viewed"), F.count_if(F.col("v") & F.col("c")).alias("clicked"), F.count_if(F.col("v") & F.col("c") & F.col("p")).alias("bought"))
