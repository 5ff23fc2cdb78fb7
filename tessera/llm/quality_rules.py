"""Host-level quality rules.

Each text is measured by plain rules. Failures are aggregated by host, and each
host's failure rate is shrunk towards the corpus by a beta prior that is fitted
to all hosts by moments. The posterior of a host's rate gives its verdict: how
credible it is that the host fails more often than the corpus does. The verdict
is joined back and moves the limits that the host's documents must keep: on a
host that is no worse than the corpus only the loose limits bind, and the more
credible it is that a host is worse, the nearer they come to the strict ones.

All of it is DataFrame code; no row goes through Python.

Defined results for odd input: a null text counts as empty (no words, which
fails the base rule); a null host is a host of its own; repeated rows are
measured and returned once each; very long texts are measured whole; a share
equal to its limit passes; columns beyond the named ones are ignored, so
clashing names in them do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, materialize, words_of


@dataclass(frozen=True)
class QualityParams:
    """Limits of the rules; rates are shares of a document's words or lines. Each limit is (loose, strict)."""

    symbols: tuple[float, float] = (0.10, 0.05)  # symbols a word
    dup_lines: tuple[float, float] = (0.50, 0.30)  # repeated lines of all lines with a word
    repeat: tuple[float, float] = (0.50, 0.30)  # words in repeated windows of all words
    least_mean_word: tuple[float, float] = (1.0, 3.0)  # characters a word
    most_mean_word: tuple[float, float] = (20.0, 10.0)
    credible: float = 0.95  # a host is rejected if it is as credible as this that it is worse than the corpus


def measures(docs: DataFrame, id_col: str, text_col: str, host: Column) -> DataFrame:
    """doc_id, host and the counts of each whole text, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), text.alias("_t"), words_of(F.col(text_col)).alias("_w"))
    n = F.size("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        grams.alias("_g"),
    )
    # Windows that occur once need no sorting; most texts have only such windows.
    placed = F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    base = base.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    same = lambda v, k: F.coalesce(v["h"] == F.get("_s", k)["h"], F.lit(False))
    twice = F.filter("_s", lambda v, k: same(v, k + 1) | ((k > 0) & same(v, k - 1)))
    base = base.withColumn("_d", F.sort_array(F.transform(twice, lambda v: v["i"]))).drop("_s")
    # Positions covered by windows of three that start at the sorted places _d.
    steps = F.zip_with(F.slice("_d", 1, F.size("_d") - 1), F.slice("_d", 2, F.size("_d") - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.when(F.size("_d") == 0, 0).when(F.size("_d") == 1, 3).otherwise(3 + F.aggregate(steps, F.lit(0), lambda a, x: a + x))
    return base.withColumn("n_repeat_words", covered.cast("long")).drop("_d")


def _breaks(params: QualityParams, strictness) -> Column:
    """Whether a document breaks a limit; ``strictness`` goes from 0 (loose) to 1 (strict)."""
    words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines"))
    limit = lambda pair: F.lit(pair[0]) + F.lit(pair[1] - pair[0]) * strictness
    mean = F.col("word_chars") / words
    return (
        (F.col("n_symbols") > limit(params.symbols) * words)
        | (F.col("n_dup_lines") > limit(params.dup_lines) * lines)
        | (F.col("n_repeat_words") > limit(params.repeat) * words)
        | (mean < limit(params.least_mean_word))
        | (mean > limit(params.most_mean_word))
    )


def judge(measured: DataFrame, params: QualityParams) -> DataFrame:
    """Adds base_failed and strict_failed to ``measures`` rows."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({"base_failed": base, "strict_failed": _breaks(params, F.lit(1.0))})


def host_verdicts(judged: DataFrame, params: QualityParams) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, worse and host_rejected.

    A document fails if it breaks the base rule or a strict limit. The prior's
    mean is the corpus rate and its weight is fitted by moments to the spread of
    the hosts' rates beyond what chance gives, so a host of few documents stays
    near the corpus and a large one near its own rate. ``worse`` is the
    posterior's share above the corpus rate, by the logistic form of the normal
    curve.
    """
    failed = (F.col("base_failed") | F.col("strict_failed")).cast("long")
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.var_pop(rate).alias("v"),
        F.avg(1 / F.col("n_docs")).alias("inv"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    beyond = F.greatest(F.col("v") - spread * F.col("inv"), F.lit(1e-6))
    # One row: the join key is a constant and the broadcast side is that row.
    prior = prior.select(F.lit(1).alias("_one"), "m", F.least(F.greatest(spread / beyond - 1, F.lit(1.0)), F.lit(1e4)).alias("weight"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    error = F.sqrt(F.greatest(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (F.col("n_docs") + F.col("weight") + 1), F.lit(1e-12)))
    return (
        hosts.withColumn("_one", F.lit(1))
        .join(F.broadcast(prior), "_one")
        .withColumn("shrunk_rate", shrunk)
        .withColumn("worse", 1 / (1 + F.exp(-1.702 * (F.col("shrunk_rate") - F.col("m")) / error)))
        .select("host", "n_docs", "n_failed", "shrunk_rate", "worse", (F.col("worse") >= params.credible).alias("host_rejected"))
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, params: QualityParams = QualityParams()
) -> DataFrame:
    """One row per input row: its counts, base_failed, kept and its host's figures.

    kept is false where base_failed or where the document breaks a limit as its
    host's verdict sets it: loose up to even odds that the host is worse than the
    corpus, strict at certainty, in proportion between.
    """
    host = F.col("source") if host is None else host
    judged = judge(materialize(measures(docs, id_col, text_col, host), "quality"), params)
    hosts = host_verdicts(judged, params).withColumnRenamed("host", "_host")
    joined = judged.join(hosts, judged["host"].eqNullSafe(F.col("_host")), "left").drop("_host")
    strictness = F.greatest(F.lit(0.0), 2 * F.coalesce("worse", F.lit(0.5)) - 1)
    return joined.withColumn("kept", ~F.col("base_failed") & ~_breaks(params, strictness))


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rejected"
    )


_LIMITS = QualityParams()


def _limit_sql(pair: tuple[float, float], strictness: str) -> str:
    return f"({pair[0]}::DOUBLE + ({pair[1]}::DOUBLE - {pair[0]}::DOUBLE) * {strictness})"


def _breaks_sql(strictness: str) -> str:
    words, lines, p = "greatest(n_words, 1)", "greatest(n_lines, 1)", _LIMITS
    return f"""(n_symbols > {_limit_sql(p.symbols, strictness)} * {words} OR n_dup_lines > {_limit_sql(p.dup_lines, strictness)} * {lines}
 OR n_repeat_words > {_limit_sql(p.repeat, strictness)} * {words} OR word_chars / {words} < {_limit_sql(p.least_mean_word, strictness)} OR word_chars / {words} > {_limit_sql(p.most_mean_word, strictness)})"""


#: DuckDB SQL for the rows of ``op1_query``: windows as text, not by hashes.
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM w WHERE len(words) >= 3),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
 len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_breaks_sql("1.0")} AS strict_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR strict_failed) AS f FROM j GROUP BY host),
p AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1 / n) AS inv FROM h),
q AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6) - 1, 1), 1e4) AS k FROM p),
s AS (SELECT host, n, m, k, (f + m * k) / (n + k) AS rate FROM h CROSS JOIN q),
v AS (SELECT host, 1 / (1 + exp(-1.702 * (rate - m) / sqrt(greatest(rate * (1 - rate) / (n + k + 1), 1e-12)))) AS worse FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
 base_failed, NOT base_failed AND NOT {_breaks_sql("greatest(0.0, 2 * worse - 1)")} AS kept, j.host, worse >= {_LIMITS.credible} AS host_rejected FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host"""
