"""Judgements about single words by what a vocabulary holds: compounds, mashed keys, slips of the finger."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators.graph import _cut

LEAST_PART = 3


def best_split(n: int, held: list[tuple[int, int, str]]) -> list[str] | None:
    """The parts of a word of n letters, from its pieces (start, end, piece): the fewest there are, longer ones first."""
    best = {n: (0, n, "")}  # start to the least number of parts from there, the first one's end negated, and that part
    for at, end, piece in sorted(held, reverse=True):
        if end in best:
            best[at] = min(best.get(at, (n + 1, 0, "")), (best[end][0] + 1, -end, piece))
    parts, at = [], 0
    while at < n:
        if at not in best:
            return None
        _, end, piece = best[at]
        parts, at = [*parts, piece], -end
    return parts


def compounds(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, parts): words (word) outside the vocabulary (term) as parts that it holds, the fewest there are, longer ones first.

    A word's pieces (spans as long as some term is, that leave no rest shorter
    than LEAST_PART) meet the vocabulary once. Those that it holds come back to
    the word, whose best split is found from its end to its start: each start
    keeps the best of its splits, so the work of a word doesn't grow with the
    number of its splits. A piece carries its word's number: a long word isn't
    copied for each of its pieces.
    """
    known = _cut(vocabulary.where(F.length("term") >= LEAST_PART).select(F.col("term").alias("piece")).distinct())
    sizes = sorted(r["n"] for r in known.select(F.length("piece").alias("n")).distinct().collect())
    n, least = F.length("word"), F.lit(LEAST_PART)
    open_words = words.select("word").distinct().where(n >= 2 * least).join(known, F.col("word") == F.col("piece"), "left_anti")
    open_words = _cut(open_words.select(F.monotonically_increasing_id().alias("id"), "word"))
    starts = F.concat(F.array(F.lit(0)), F.sequence(least, n - least))
    lengths = F.array(*map(F.lit, sizes)).cast("array<int>")
    ends = lambda at: F.filter(F.transform(lengths, lambda size: at + size), lambda end: (end <= n - least) | (end == n))
    spans = F.flatten(F.transform(starts, lambda at: F.transform(ends(at), lambda end: F.struct(at.alias("at"), end.alias("end")))))
    cut = open_words.select("id", "word", F.explode(spans).alias("p"))
    cut = cut.select("id", n.alias("n"), "p.at", "p.end", F.expr("substring(word, p.at + 1, p.end - p.at)").alias("piece"))
    held = cut.join(known, "piece").groupBy("id", "n").agg(F.collect_list(F.struct("at", "end", "piece")).alias("held"))
    held = held.where(F.exists("held", lambda h: h["at"] == 0) & F.exists("held", lambda h: h["end"] == F.col("n")))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.slice(k, 1024).to_pylist()
                found = (best_split(r["n"], [(h["at"], h["end"], h["piece"]) for h in r["held"]]) for r in rows)
                parts = [p for p in found if p]
                yield pa.RecordBatch.from_arrays([pa.array(["".join(p) for p in parts], pa.string()), pa.array(parts, pa.list_(pa.string()))], names=["word", "parts"])

    return held.select("n", "held").mapInArrow(run, "word string, parts array<string>")


def letters(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}]", "")


def letter_scores(words: DataFrame, training: DataFrame, least: float = 1e-4) -> DataFrame:
    """word and score: the mean log share, among the training words' pairs of neighbouring letters, of each of a word's pairs."""
    def pairs(df: DataFrame) -> DataFrame:
        spelled = df.select("word", letters(F.col("word")).alias("l")).where("length(l) > 1")
        return spelled.select("word", F.explode(F.expr("transform(sequence(1, length(l) - 1), i -> substring(l, i, 2))")).alias("pair"))

    counts = pairs(training).groupBy("pair").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    shares = counts.join(F.broadcast(total)).select("pair", F.greatest(F.col("c") / F.col("total"), F.lit(least)).alias("share"))
    met = pairs(words).join(shares, "pair", "left")
    return met.groupBy("word").agg(F.bround(F.avg(F.log(F.coalesce("share", F.lit(least)))), 4).alias("score"))


# The rows of a keyboard, and the prices of a slip and of any other edit.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
SLIP, EDIT = 0.4, 1.0
_AT = {c: (row, column) for row, keys in enumerate(KEYS) for column, c in enumerate(keys)}


def slip_price(a: str, b: str) -> float:
    """Neighbouring keys are a slip."""
    if a in _AT and b in _AT and max(abs(x - y) for x, y in zip(_AT[a], _AT[b])) == 1:
        return SLIP
    return EDIT


def typing_cost(typed: str, meant: str) -> float:
    """The cheapest way from what was typed to what was meant: wrong key, key too many (a doubled one is a slip), key missing, two keys swapped."""
    typed, meant = typed.lower(), meant.lower()
    before, last = [], [float(j) for j in range(len(meant) + 1)]
    for i, t in enumerate(typed, 1):
        extra = SLIP if i > 1 and typed[i - 2] == t else EDIT
        now = [i * EDIT]
        for j, m in enumerate(meant, 1):
            ways = [last[j - 1] + (0.0 if t == m else slip_price(t, m)), last[j] + extra, now[j - 1] + EDIT]
            if i > 1 and j > 1 and t == meant[j - 2] and typed[i - 2] == m:
                ways.append(before[j - 2] + slip_price(m, t))
            now.append(min(ways))
        before, last = last, now
    return round(last[-1], 4)


@F.pandas_udf(DoubleType())
def typing_costs(typed: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([typing_cost(t, m) for t, m in zip(typed, meant)], dtype="float64")
