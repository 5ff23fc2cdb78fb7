"""Ranks and running sums over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import _cut


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds place: 0, 1, .. over the whole table by ``order``, which must tell rows apart.

    Rows are dealt out by ranges and sorted within them; the ranges' sizes, a
    row a task, give each range's first place.
    """
    held = _cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    firsts = F.broadcast(sizes.select("_part", before.alias("_first")))
    joined = held.withColumn("_part", part).join(firsts, "_part")
    return joined.withColumn("place", F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_first")


def running_sum(rows: DataFrame, step: str, value: str, name: str, block: int = 1000) -> DataFrame:
    """Adds the sum of ``value`` over all steps up to a row's; steps are numbers, a row each.

    Blocks of steps are summed first, so the window without a key sees a row a block.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(step) / block))
    whole = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = whole.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy("_block").orderBy(step))
    return blocked.withColumn("_inner", inner).join(before, "_block").withColumn(name, F.col("_before") + F.col("_inner")).drop("_block", "_inner", "_before")


def values_at(rows: DataFrame, key: str, value: str, fractions: dict[str, float], bins: int = 1024) -> DataFrame:
    """For each key the values whose place among its sorted values is fraction * (n - 1), halves up; exact.

    Values are counted by bins of their key's range; only the bins that hold a
    wanted place are looked into, so no task sorts all values of a key.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    ends = counted.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("c").alias("n"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    binned = counted.join(F.broadcast(ends), key).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width)))
    sums = binned.groupBy(key, "bin").agg(F.sum("c").alias("m"), F.first("n").alias("n"))  # at most ``bins`` rows a key
    upto = F.sum("m").over(Window.partitionBy(key).orderBy("bin"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.floor(F.lit(f) * (F.col("n") - 1) + 0.5).alias("place")) for name, f in fractions.items())))
    sums = sums.withColumns({"upto": upto}).withColumn("w", wanted)
    hit = sums.where((F.col("w.place") < F.col("upto")) & (F.col("w.place") >= F.col("upto") - F.col("m")))
    hit = hit.select(key, "bin", F.col("w.name").alias("name"), (F.col("w.place") - (F.col("upto") - F.col("m"))).alias("inner"))
    needed = binned.join(hit.select(key, "bin").distinct(), [key, "bin"])
    ranked = needed.withColumn("end", F.sum("c").over(Window.partitionBy(key, "bin").orderBy(value)))
    found = ranked.join(hit, [key, "bin"]).where((F.col("inner") < F.col("end")) & (F.col("inner") >= F.col("end") - F.col("c")))
    return found.groupBy(key).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in fractions))
