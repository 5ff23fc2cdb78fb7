"""Words a few edits away, and what to offer for a word that the vocabulary lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import ngrams


def deletions(word: Column, most: int) -> Column:
    """All strings that deleting up to ``most`` characters leaves, distinct."""
    left = F.array(word)
    every = left
    for _ in range(most):
        shorter = lambda w: F.when(
            F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        ).otherwise(F.array(w))
        left = F.array_distinct(F.flatten(F.transform(left, shorter)))
        every = F.array_union(every, left)
    return every


def within_edits(left: DataFrame, right: DataFrame, most: int, few: bool = False) -> DataFrame:
    """(a, b, distance, and the right side's other columns) of words a of ``left`` (a) and b of ``right`` (b, ..) at most ``most`` edits apart.

    Two such words share a string that deleting ``most`` characters of each can
    leave, so they meet in a join on those strings' hashes; the pairs that meet are
    measured. A key that many words share is one of a few characters, and words so
    short are few. Spark takes the deletions to be as small as the words that they
    come from, so the join is told not to broadcast them. Where the left side is
    ``few`` words, these are broadcast and measured against each word of the right
    side, and nothing is spelled out.
    """
    if few:
        near = F.abs(F.length("a") - F.length("b")) <= most
        met = right.join(F.broadcast(left.select("a").distinct()), near)
    else:
        reach = lambda df, c: df.select(c, F.explode(deletions(F.col(c), most)).alias("_s")).select(c, F.xxhash64("_s").alias("_key"))
        pairs = reach(left, "a").hint("merge").join(reach(right, "b"), "_key").select("a", "b").distinct()
        pairs = pairs.where(F.levenshtein("a", "b", most) >= 0)
        met = pairs if right.columns == ["b"] else pairs.hint("merge").join(right, "b")
    return met.select("a", "b", F.levenshtein("a", "b", most).alias("distance"), *(c for c in right.columns if c != "b")).where("distance >= 0")


def suggestions(words: DataFrame, vocabulary: DataFrame, most: int = 2, limit: int = 3, few: bool = False) -> DataFrame:
    """word, term, distance, popularity and rank: for each word (word) the terms (term, popularity) that share a trigram with it and are few edits away."""
    near = within_edits(words.select(F.col("word").alias("a")).distinct(), vocabulary.select(F.col("term").alias("b"), "popularity"), most, few)
    near = near.where(F.arrays_overlap(ngrams(F.col("a"), 3), ngrams(F.col("b"), 3)))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", F.desc("popularity"), "b"))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("a").alias("word"), F.col("b").alias("term"), "distance", "popularity", "rank")


def did_you_mean(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """word and offer: the best suggestion for each of a few words (a query's) that the vocabulary lacks."""
    asked = words.select("word").distinct()
    known = vocabulary.select(F.col("term").alias("word")).join(F.broadcast(asked), "word", "left_semi")
    return suggestions(asked.join(known, "word", "left_anti"), vocabulary, most, 1, few=True).select("word", F.col("term").alias("offer"))
