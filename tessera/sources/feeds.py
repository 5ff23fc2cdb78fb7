"""Feeds into tables: mapping of raw rows, cleaning of texts, admission by keys, and export by pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import placed


@dataclass(frozen=True)
class Rule:
    """A target field: what its sources hold, joined by spaces, or a constant."""

    target: str
    sources: tuple[str, ...] = ()
    constant: str | None = None
    required: bool = False

    def __post_init__(self):
        if (self.constant is None) != bool(self.sources):
            raise ValueError(f"{self.target}: either sources or a constant")


def adapt(rows: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, the targets, complaint (null for rows that map) and dropped, the number of columns that no rule reads. A bad row is a value, not an error."""
    if not rules or len({r.target for r in rules}) != len(rules):
        raise ValueError("rules must have targets of their own")

    def value(rule: Rule) -> Column:
        if rule.constant is not None:
            return F.lit(rule.constant)
        present = F.filter(F.array(*(F.col(s).cast("string") for s in rule.sources if s in rows.columns)), lambda x: x.isNotNull() & (x != ""))
        return F.when(F.size(present) > 0, F.array_join(present, " "))

    read = {s for r in rules for s in r.sources}
    shaped = rows.select(*keep, *(value(r).alias(r.target) for r in rules))
    missing = F.coalesce(*(F.when(F.col(r.target).isNull(), F.lit(f"required field {r.target} has no source")) for r in rules if r.required), F.lit(None).cast("string"))
    return shaped.withColumns({"complaint": missing, "dropped": F.lit(len([c for c in rows.columns if c not in read]))})


# What cleaning takes out of a text, in order, and what it leaves.
STAGES = (
    ("markup", r"<[^>]{1,200}>", " "),
    ("control", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    ("invisibles", r"[\u00AD\u200B\u200C\u200D\uFEFF]", ""),
    ("whitespace", r"[\s\x1C-\x1F\x85\p{Z}]+", " "),
)


def cleaned(text: Column) -> tuple[Column, dict[str, Column]]:
    """The clean text, and whether each stage changed it."""
    touched = {}
    for name, pattern, put in STAGES:
        after = F.regexp_replace(text, pattern, put)
        after = F.trim(after) if name == "whitespace" else after
        touched[name] = after != text
        text = after
    return text, touched


def admitted(rows: DataFrame, key: str, position: str, problem: Column) -> DataFrame:
    """The rows with status (admitted, duplicate, refused) and first_position.

    A row without a key or with a problem (a text, else null) is refused and
    claims nothing; of the others the first of each key is admitted. The firsts
    are summed by key before they meet the rows, and only keys that recur do.
    """
    empty = F.col(key).isNull() | (F.trim(key) == "")
    judged = rows.withColumn("problem", F.when(empty, "no key").otherwise(problem))
    firsts = judged.where("problem is null").groupBy(F.col(key).alias("_key")).agg(F.min(position).alias("first_position"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = judged.join(firsts, F.col("problem").isNull() & (F.col(key) == F.col("_key")), "left").drop("_key")
    status = F.when(F.col("problem").isNotNull(), "refused").when(F.col("first_position") < F.col(position), "duplicate").otherwise("admitted")
    return met.withColumn("status", status)


def pages(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """The rows with page: 0, 1, .. of ``size`` rows each, by rising id. A page's last id is the cursor for the next."""
    return placed(rows, id_col).withColumn("page", F.floor(F.col("place") / size)).drop("place")
