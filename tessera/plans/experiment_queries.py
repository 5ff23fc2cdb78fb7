"""Queries over experiments, clicks, words and time: arms, samples, drafts, click models, compounds, as-of joins, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import words as W
from tessera.operators.graph import _cut
from tessera.operators.index import distinct_postings, stored_index, vocabulary
from tessera.operators.suggest import within_edits
from tessera.plans.catalog import register
from tessera.plans.oracles import INDEX, STEM_SQL, STOP_LIST
from tessera.streaming import logs


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _terms(spark, sf_dir):
    return stored_index(_table(spark, sf_dir, "documents"), {"text": F.col("text")}).term_stats().select("term", "df")


def hash_share(value: Column) -> Column:
    """A number from 0 up to 1 by the first four bytes of SHA-256."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


_SHARE = "('0x' || sha256({0})[1:8])::UBIGINT::DOUBLE / 4294967296.0"


@register(
    "canary_arms",
    f"""WITH s AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY ALL), a AS (SELECT CASE WHEN {_SHARE.format("user_id::VARCHAR")} < 0.1 THEN 'canary' ELSE 'incumbent' END AS arm, clicks FROM s)
SELECT arm, count(*) AS searches, round_even(count(*) FILTER (clicks = 0) / count(*), 4) AS abandonment, round_even(sum(clicks) / count(*), 4) AS clicks_per_search FROM a GROUP BY arm""",
)
def canary_arms(spark, sf_dir):
    """User days dealt to a tenth and the rest by a hash of the user: how many end without a click, and clicks for each."""
    days = _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"))
    arm = F.when(hash_share(F.col("user_id").cast("string")) < 0.1, "canary").otherwise("incumbent")
    n = F.count(F.lit(1))
    return days.groupBy(arm.alias("arm")).agg(n.alias("searches"), F.bround(F.count_if(F.col("clicks") == 0) / n, 4).alias("abandonment"), F.bround(F.sum("clicks") / n, 4).alias("clicks_per_search"))


@register("sampled_queries", f"SELECT {_SHARE.format('text')} < 0.25 AS sampled, count(*) AS queries FROM (SELECT DISTINCT text FROM conversations WHERE role = 'user' AND text IS NOT NULL) GROUP BY 1")
def sampled_queries(spark, sf_dir):
    """Queries in and out of a sample that a hash of the query decides, so each is always in or always out."""
    asked = _table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select("text").distinct()
    return asked.groupBy((hash_share(F.col("text")) < 0.25).alias("sampled")).agg(F.count(F.lit(1)).alias("queries"))


def team_draft(left: Column, right: Column, coin: tuple[bool, ...], length: int = 10) -> Column:
    """A struct of shown and teams: two ranked lists take turns, each with its best item not yet shown; the coin says who goes first in a round."""
    empty = F.struct(F.array().cast("array<bigint>").alias("shown"), F.array().cast("array<string>").alias("teams"))

    def pick(state: Column, ranked: Column, team: str) -> Column:
        free = F.get(F.filter(ranked, lambda x: ~F.array_contains(state["shown"], x)), F.lit(0))
        grown = F.struct(F.concat(state["shown"], F.array(free)).alias("shown"), F.concat(state["teams"], F.array(F.lit(team))).alias("teams"))
        return F.when(free.isNotNull() & (F.size(state["shown"]) < length), grown).otherwise(state)

    turns = [t for k in range(length) for t in (("left", "right") if coin[k % len(coin)] else ("right", "left"))]
    sides = {"left": left, "right": right}
    return F.aggregate(F.array(*map(F.lit, turns)), empty, lambda s, t: F.when(t == "left", pick(s, sides["left"], "left")).otherwise(pick(s, sides["right"], "right")))


@register("interleave")
def interleave(spark, sf_dir):
    """Two rankings of each source's documents drafted into one list; a draft is a loop, so tests hold it against a plain one."""
    docs = _table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id", "n_chars")

    def best(name: str, *order) -> DataFrame:
        top = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where("r <= 10")
        return top.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"]).alias(name))

    both = best("left", F.desc("n_chars"), "doc_id").join(best("right", F.col("n_chars") % 100, "doc_id"), "source")
    drafted = both.select("source", team_draft(F.col("left"), F.col("right"), (True, False, False, True)).alias("d"))
    return drafted.select("source", F.array_join(F.transform("d.shown", lambda x: x.cast("string")), " ").alias("shown"), F.array_join("d.teams", " ").alias("teams"))


@register(
    "click_model",
    """WITH s AS (SELECT dayofweek(ts)::INT AS query, event_id % 40 AS doc, event_type = 'click' AS hit, row_number() OVER w AS pos, user_id, ts::DATE AS day FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)),
d AS (SELECT *, max(CASE WHEN hit THEN pos ELSE 0 END) OVER (PARTITION BY user_id, day) AS deepest, CASE WHEN pos <= 5 THEN [1.0, 0.7, 0.5, 0.35, 0.25][pos] ELSE 0.25 / (pos - 4) END AS rate FROM s)
SELECT query, doc, round_even(least(1, count(*) FILTER (hit) / sum(rate)), 4) AS attraction, sum(rate) >= 3 AS confident FROM d WHERE hit OR pos < deepest GROUP BY ALL""",
)
def click_model(spark, sf_dir):
    """How attractive items are: clicks over the looks that their places give, counting only places up to the deepest click of an impression (here a user's day)."""
    shown = Window.partitionBy("user_id", F.to_date("ts"))
    rows = _table(spark, sf_dir, "events").select(
        F.dayofweek("ts").alias("q"),
        (F.col("event_id") % 40).alias("doc"),
        (F.col("event_type") == "click").alias("hit"),
        F.row_number().over(shown.orderBy("ts", "event_id")).alias("pos"),
        "user_id",
        "ts",
    )
    rates = F.element_at(F.array(*map(F.lit, (1.0, 0.7, 0.5, 0.35, 0.25))), F.least("pos", F.lit(5)))
    seen = rows.withColumn("deepest", F.max(F.when(F.col("hit"), F.col("pos")).otherwise(0)).over(shown)).withColumn("rate", F.when(F.col("pos") <= 5, rates).otherwise(0.25 / (F.col("pos") - 4)))
    counts = seen.where(F.col("hit") | (F.col("pos") < F.col("deepest"))).groupBy((F.col("q") - 1).alias("query"), "doc").agg(F.count_if("hit").alias("c"), F.sum("rate").alias("w"))
    return counts.select("query", "doc", F.bround(F.least(F.lit(1.0), F.col("c") / F.col("w")), 4).alias("attraction"), (F.col("w") >= 3).alias("confident"))


_TOPS = """l AS (SELECT source, list(doc_id ORDER BY n_chars DESC, doc_id)[1:5] AS e FROM documents GROUP BY source), o AS (SELECT source, list(doc_id ORDER BY {0} DESC, doc_id)[1:5] AS s FROM documents GROUP BY source)"""


@register("golden_compare", f"WITH {_TOPS.format('n_chars // 50')} SELECT source, CASE WHEN e = s THEN 'same' WHEN list_sort(e) = list_sort(s) THEN 'reordered' ELSE 'changed' END AS verdict FROM l JOIN o USING (source)")
def golden_compare(spark, sf_dir):
    """Each source's blessed first five against a coarser ranking's: the same, in another order, or others."""
    docs = _table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id", "n_chars")

    def five(score: Column, name: str) -> DataFrame:
        top = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(score.desc(), "doc_id"))).where("r <= 5")
        return top.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id"))).alias(name))

    both = five(F.col("n_chars"), "e").join(five(F.floor(F.col("n_chars") / 50), "s"), "source")
    e, s = F.col("e.doc_id"), F.col("s.doc_id")
    return both.select("source", F.when(e == s, "same").when(F.array_sort(e) == F.array_sort(s), "reordered").otherwise("changed").alias("verdict"))


@register(
    "regression_states",
    """WITH j AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
g AS (SELECT source, sum(quality) FILTER (a <= 5) >= 4 AS before, sum(quality) FILTER (b <= 5) >= 4 AS after FROM j GROUP BY source)
SELECT CASE WHEN before AND NOT after THEN 'regressed' WHEN after AND NOT before THEN 'healed' WHEN before THEN 'held' ELSE 'debt' END AS state, count(*) AS evals FROM g GROUP BY 1""",
)
def regression_states(spark, sf_dir):
    """Evaluations (here: four good ones among a source's first five) before and after a change of ranking."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").where("quality is not null"), "doc_id").select("source", "quality", "n_chars", "doc_id")

    def holds(name: str, *order) -> DataFrame:
        top = rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where("r <= 5")
        return top.groupBy("source").agg((F.sum("quality") >= 4).alias(name))

    both = holds("before", F.desc("n_chars"), "doc_id").join(holds("after", "n_chars", "doc_id"), "source")
    state = F.when(F.col("before") & ~F.col("after"), "regressed").when(F.col("after") & ~F.col("before"), "healed").when(F.col("before"), "held").otherwise("debt")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("evals"))


@register(
    "compound_words",
    f"""WITH RECURSIVE {INDEX}, t AS (SELECT term, count(*) AS df FROM post GROUP BY term), v AS (SELECT term FROM t WHERE df >= 10 AND length(term) >= 3), q AS (SELECT term AS word FROM t WHERE df < 10),
s(word, rest, parts) AS (SELECT word, word, []::VARCHAR[] FROM q UNION ALL SELECT word, rest[length(v.term) + 1:], list_append(parts, v.term) FROM s JOIN v ON starts_with(rest, v.term) WHERE rest <> '' AND length(rest) - length(v.term) NOT IN (1, 2)),
d AS (SELECT word, parts, row_number() OVER (PARTITION BY word ORDER BY len(parts), list_transform(parts, lambda p: -length(p))) AS r FROM s WHERE rest = '')
SELECT word, array_to_string(parts, '+') AS parts FROM d WHERE r = 1""",
)
def compound_words(spark, sf_dir):
    """Rare words of any length as parts that many documents hold."""
    # Read twice, so the counts are written once.
    terms = _cut(vocabulary(distinct_postings(_table(spark, sf_dir, "documents"), F.col("text"))))
    words = terms.where("df < 10").select(F.col("term").alias("word"))
    return W.compounds(words, terms.where("df >= 10").select("term")).select("word", F.array_join("parts", "+").alias("parts"))


_LETTERS = "regexp_replace(lower(term), '[^\\p{L}]', '', 'g')"


@register(
    "mashed_words",
    f"""WITH {INDEX}, t AS (SELECT term, count(*) AS df, {_LETTERS} AS l FROM post GROUP BY term), p AS (SELECT term, df, length(l) AS n, unnest(list_transform(generate_series(1, length(l) - 1), lambda i: l[i:i+1])) AS pair FROM t WHERE length(l) > 1),
c AS (SELECT pair, count(*) AS c FROM p WHERE df BETWEEN 3 AND 50 GROUP BY pair), s AS (SELECT term, any_value(df) AS df, any_value(n) AS n, round_even(avg(ln(greatest(coalesce(c, 0) / (SELECT sum(c) FROM c), 1e-4))), 4) AS score FROM p LEFT JOIN c USING (pair) GROUP BY term)
SELECT count(*) AS judged, count(*) FILTER (score < (SELECT min(score) - 0.5 FROM s WHERE df > 50)) AS mashed, (SELECT round_even(min(score) - 0.5, 4) FROM s WHERE df > 50) AS threshold FROM s WHERE n >= 4""",
)
def mashed_words(spark, sf_dir):
    """Words whose letters follow each other as they seldom do: below the worst of the commonest words by a margin."""
    terms = _terms(spark, sf_dir).withColumnRenamed("term", "word")
    scores = W.letter_scores(terms, terms.where("df between 3 and 50")).join(terms, "word")
    threshold = scores.where("df > 50").agg(F.bround(F.min("score") - 0.5, 4).alias("threshold"))
    judged = scores.where(F.length(W.letters(F.col("word"))) >= 4).join(F.broadcast(threshold))
    return judged.agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("score") < F.col("threshold")).alias("mashed"), F.max("threshold").alias("threshold"))


@register("typing_slips")
def typing_slips(spark, sf_dir):
    """Names that a cheap slip of the fingers turns into another one; the costs are a recurrence, so tests hold them against a plain table."""
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).where("a is not null").distinct()
    near = within_edits(names, names.select(F.col("a").alias("b")), 2).where("a <> b")
    return near.select(F.col("a").alias("typed"), F.col("b").alias("meant"), W.typing_costs("a", "b").alias("cost")).where("cost <= 2.0")


_INITIALS = "array_to_string(list_transform(list_filter(string_split(lower(p_type), ' '), lambda w: w <> ''), lambda w: w[1:1]), '')"


@register("abbreviations", f"SELECT abbrev, claims, CASE WHEN claims = 1 THEN spelled END AS expansion FROM (SELECT {_INITIALS} AS abbrev, count(DISTINCT lower(trim(p_type))) AS claims, min(lower(trim(p_type))) AS spelled FROM part WHERE p_type IS NOT NULL GROUP BY 1) WHERE abbrev <> ''")
def abbreviations(spark, sf_dir):
    """Initials and what they stand for; initials that several spellings claim expand to none."""
    spelled = _table(spark, sf_dir, "part").select(F.lower(F.trim("p_type")).alias("spelled")).where("spelled is not null").distinct()
    initials = F.array_join(F.transform(F.filter(F.split("spelled", " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    claims = spelled.groupBy(initials.alias("abbrev")).agg(F.count(F.lit(1)).alias("claims"), F.min("spelled").alias("least"))
    return claims.where("abbrev <> ''").select("abbrev", "claims", F.when(F.col("claims") == 1, F.col("least")).alias("expansion"))


# Stopwords of languages whose words are not stemmed.
PLAIN_LANGUAGES = {
    "de": tuple("der die das und oder ein eine mit von zu im am".split()),
    "fr": tuple("le la les des un une et ou avec de du au aux".split()),
}


def language_terms(text: Column, lang: Column) -> Column:
    """The terms by the document's language; null for a language that has no analysis, rather than another's."""
    words = F.transform(T.raw_tokens(text), F.lower)
    found = F.when(lang.isin("en", "en-gb", "en-us"), F.filter(F.transform(words, T.stem), lambda w: ~w.isin(*T.STOPWORDS)))
    kept = lambda stops: F.filter(words, lambda w: ~w.isin(*stops))
    return found.when(lang.isin("de", "de-at"), kept(PLAIN_LANGUAGES["de"])).when(lang == "fr", kept(PLAIN_LANGUAGES["fr"]))


def _plain(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in PLAIN_LANGUAGES[lang])
    return f"list_filter(ws, lambda w: w NOT IN ({listed}))"


@register(
    "language_packs",
    f"""WITH r AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(CASE lang WHEN 'en' THEN list_filter(list_transform(ws, lambda w: {STEM_SQL.format("w")}), lambda w: w NOT IN ({STOP_LIST})) WHEN 'de' THEN {_plain("de")} WHEN 'fr' THEN {_plain("fr")} END, ' ')) AS digest FROM r""",
)
def language_packs(spark, sf_dir):
    """Each document's terms by its own language's rules."""
    found = language_terms(F.col("text"), F.col("lang"))
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(F.array_join(found, " ")).alias("digest"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, value: str, name: str) -> DataFrame:
    """left with ``name``: the ``value`` of the last row of right with the same key that comes before by (at, tie).

    Rows meet within a key's day; where a day has none before, the last of the
    key's earlier days stands in. So a key with many rows is a window a day.
    """
    day = F.to_date(at)
    mark = lambda df, side, v: df.select(key, at, tie, day.alias("_day"), F.lit(side).alias("_side"), v.alias("_v"), *(F.col(c) if side == 0 else F.lit(None).alias(c) for c in rest))
    rest = [c for c in left.columns if c not in (key, at, tie)]
    both = mark(left, 0, F.lit(None)).unionByName(mark(right, 1, F.col(value)))
    before = Window.partitionBy(key, "_day").orderBy(at, tie, F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_same", F.last("_v", ignorenulls=True).over(before)).where("_side = 0")
    lasts = right.groupBy(key, day.alias("_d")).agg(F.max_by(F.col(value), F.struct(at, tie)).alias("_last"))
    days = found.select(key, F.col("_day").alias("_d")).distinct().withColumn("_ask", F.lit(True))
    by_day = days.join(lasts, [key, "_d"], "full")
    earlier = by_day.withColumn("_prior", F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)))  # a row a day
    earlier = earlier.where("_ask").select(F.col(key).alias("_k"), "_d", "_prior")
    joined = found.join(earlier, (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")), "left")
    return joined.select(*left.columns, F.coalesce("_same", "_prior").alias(name))


@register(
    "last_view",
    "SELECT event_id, view FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view FROM events) WHERE event_type = 'purchase'",
)
def last_view(spark, sf_dir):
    """For each purchase the user's last view before it."""
    events = _table(spark, sf_dir, "events")
    found = as_of(events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), events.where("event_type = 'view'").withColumn("v", F.col("event_id")), "user_id", "ts", "event_id", "v", "view")
    return found.select("event_id", "view")


@register(
    "sliding_counts",
    "SELECT make_timestamp((epoch_us(ts) // 21600000000 - k) * 21600000000)::VARCHAR AS start, event_type AS key, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL",
)
def sliding_counts(spark, sf_dir):
    """Events by type in windows of a day that start every six hours."""
    return logs.sliding(_table(spark, sf_dir, "events"), "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "key", "n")


@register(
    "moving_week",
    "SELECT event_type, day::VARCHAR AS day, (sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))::BIGINT AS week FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)",
)
def moving_week(spark, sf_dir):
    """Events by type over the seven days up to each day, by a range of days; days without events don't count as rows."""
    days = _table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    week = Window.partitionBy("event_type").orderBy(F.unix_date("d")).rangeBetween(-6, 0)  # a row a day
    return days.select("event_type", F.col("d").cast("string").alias("day"), F.sum("n").over(week).alias("week"))


@register("event_props", "SELECT unnest(json_keys(props)) AS key, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events WHERE props IS NOT NULL GROUP BY 1")
def event_props(spark, sf_dir):
    """The properties of events as maps: each key's count and sum."""
    maps = _table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))
    return maps.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
