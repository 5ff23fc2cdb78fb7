"""Sharding by a k-d tree over document metadata.

The tree starts with one node of all documents and splits, along its widest
dimension and at a weighted median, every node that holds more than the target
bytes. Medians are found without sorting or collecting rows: each document has,
for each dimension, an ordinate of 62 bits (the scaled value, then the text's
checksum, then a hash of the row, so equal values still have an order and equal
texts stay side by side), and a few rounds of counting bytes by ever finer digits
of the ordinate close in on the median of every node of a level at once. A cut
that would part a group of equal texts moves to the group's nearer end, unless
the group is too large a share of a shard.

Rows get gapless slots in two steps, by buckets of each shard and within them,
so no task sorts a whole shard.

Defined results for odd input: a null text has no bytes, and each document
counts one byte more for its end; a very long text is placed whole, so it can
make its shard larger; null metadata lies below all values; repeated
rows are placed once each, though where they are alike in all that the ordinate
holds they stay together; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize

VALUE_BITS, TIE_BITS = 20, 42
DIGIT_BITS, ROUNDS = 12, 5  # 60 of the 62 bits are told apart
ROW_BITS = TIE_BITS - 24  # below the checksum: a hash of the row
BUCKET_ROWS = 50_000


def _ordinate(value, lo, hi):
    """The value scaled to its range over all documents, with the tie bits below."""
    span = F.greatest(F.lit(float(hi) - float(lo)), F.lit(1e-9))
    scaled = F.when(value.isNull(), 0).otherwise(1 + F.floor((value.cast("double") - float(lo)) / span * ((1 << VALUE_BITS) - 2)))
    return F.shiftleft(scaled.cast("long"), TIE_BITS).bitwiseOR(F.col("_tie"))


def metadata(docs: DataFrame, id_col: str, text_col: str, dimensions: dict) -> DataFrame:
    """doc_id, size, text_crc32 and one ordinate (d0, d1, ..) for each dimension; slim, and written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *(c.cast("double").alias(f"v{k}") for k, c in enumerate(dimensions.values())),
    )
    row = F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)
    base = materialize(base.withColumn("_tie", F.shiftleft(F.shiftright("text_crc32", 8), ROW_BITS).bitwiseOR(row)), "shard-meta")
    names = [f"v{k}" for k in range(len(dimensions))]
    ends = base.agg(*(f(n).alias(f"{g}_{n}") for n in names for f, g in ((F.min, "lo"), (F.max, "hi")))).first()
    ordinates = [_ordinate(F.col(n), ends[f"lo_{n}"] or 0.0, ends[f"hi_{n}"] or 0.0).alias(f"d{k}") for k, n in enumerate(names)]
    return base.select("doc_id", "size", "text_crc32", *ordinates)


def _medians(rows: DataFrame, open_: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each open node (its dimension, the share of bytes for its left part) the least ordinate of the right part.

    Each round brings back one row a node: the digit in which the wanted byte falls, and the bytes before it.
    """
    found = {n: (0, None) for n in open_}  # the ordinate's known upper part, and the bytes still wanted
    shift = VALUE_BITS + TIE_BITS
    for _ in range(ROUNDS):
        shift -= DIGIT_BITS
        pick = F.coalesce(*(F.when(F.col("node") == n, F.col(f"d{d}")) for n, (d, _) in open_.items()))
        known = F.coalesce(*(F.when(F.col("node") == n, F.lit(upper)) for n, (upper, _) in found.items()))
        live = rows.where(F.col("node").isin(*open_)).withColumn("_o", pick)
        live = live.where(F.shiftright("_o", shift + DIGIT_BITS) == known)
        digit = F.shiftright("_o", shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")
        bins = live.groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"))  # at most 2 ** DIGIT_BITS rows a node
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit"))
        whole = F.sum("bytes").over(Window.partitionBy("node"))
        wanted = F.coalesce(
            *(F.when(F.col("node") == n, (F.col("whole") * open_[n][1]).cast("double") if w is None else F.lit(float(w))) for n, (_, w) in found.items())
        )
        bins = bins.withColumns({"upto": upto, "whole": whole}).withColumn("wanted", wanted)
        at = bins.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("bytes") < F.col("wanted")))
        for r in at.groupBy("node").agg(F.min(F.struct("digit", "upto", "bytes", "wanted")).alias("x")).collect():
            upper = found[r["node"]][0]
            found[r["node"]] = (upper << DIGIT_BITS | r["x"]["digit"], r["x"]["wanted"] - (r["x"]["upto"] - r["x"]["bytes"]))
    return {n: (upper + 1) << shift for n, (upper, _) in found.items()}


def _whole_groups(rows: DataFrame, cuts: dict[int, int], open_: dict[int, tuple[int, float]], shards_in: dict[int, int], share: float) -> dict[int, int]:
    """The cuts, moved to the nearer end of the group of equal texts that they would part, if its bytes are ``share`` of a shard's at most."""
    pick = F.coalesce(*(F.when(F.col("node") == n, F.col(f"d{open_[n][0]}")) for n in cuts))
    cut = F.coalesce(*(F.when(F.col("node") == n, F.lit(c)) for n, c in cuts.items()))
    own = F.shiftright("_o", ROW_BITS) == F.shiftright("_c", ROW_BITS)
    part = lambda side: F.coalesce(F.sum(F.when(own & side, F.col("size"))), F.lit(0))
    met = rows.where(F.col("node").isin(*cuts)).withColumns({"_o": pick, "_c": cut})
    moved = dict(cuts)
    for r in met.groupBy("node").agg(F.sum("size").alias("whole"), part(F.col("_o") < F.col("_c")).alias("left"), part(F.col("_o") >= F.col("_c")).alias("right")).collect():  # a row a node
        group = cuts[r["node"]] >> ROW_BITS
        if r["left"] and r["right"] and r["left"] + r["right"] <= share * r["whole"] / shards_in[r["node"]]:
            moved[r["node"]] = (group + (r["left"] > r["right"])) << ROW_BITS
    return moved


def split_tree(rows: DataFrame, shards: int, dimensions: int, share: float = 0.02) -> DataFrame:
    """Adds shard: leaves of a tree whose nodes split until each holds the bytes of one shard.

    Groups of equal texts with at most ``share`` of a shard's bytes stay whole.
    """
    nodes = {0: shards}  # node to the number of shards in it
    rows = rows.withColumn("node", F.lit(0))
    level = 0
    while any(n > 1 for n in nodes.values()):
        wide = [n for n, count in nodes.items() if count > 1]
        spans = rows.where(F.col("node").isin(*wide)).groupBy("node").agg(
            *((F.max(F.shiftright(f"d{d}", TIE_BITS)) - F.min(F.shiftright(f"d{d}", TIE_BITS))).alias(f"s{d}") for d in range(dimensions))
        )
        widest = {r["node"]: max(range(dimensions), key=lambda d: (r[f"s{d}"], -d)) for r in spans.collect()}  # a row a node
        open_ = {n: (widest[n], (nodes[n] // 2) / nodes[n]) for n in wide if n in widest}
        cuts = _whole_groups(rows, _medians(rows, open_), open_, nodes, share) if open_ else {}
        parts, moved = {}, F.col("node")
        for n, count in nodes.items():
            if count == 1:
                parts[n * 2] = 1
            else:
                parts[n * 2], parts[n * 2 + 1] = count // 2, count - count // 2
        step = F.lit(0)
        for n, (d, _) in open_.items():
            step = F.when(F.col("node") == n, (F.col(f"d{d}") >= cuts[n]).cast("int")).otherwise(step)
        moved = (F.col("node") * 2 + step).cast("int")
        rows, nodes, level = rows.withColumn("node", moved), parts, level + 1
        if level % 2 == 0:
            rows = materialize(rows, "shard-tree")
    order = sorted(nodes)
    numbers = F.create_map(*(F.lit(x) for k, n in enumerate(order) for x in (n, k)))
    return rows.withColumn("shard", numbers[F.col("node")].cast("int"))


def with_slots(rows: DataFrame, group: str, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds slot: 0, 1, .. within each group, gapless; buckets by hash, then places within a bucket."""
    most = rows.groupBy(group).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    buckets = max(16, -(-int(most) // bucket_rows))
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")), "slots")
    counts = rows.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col(group).alias("_g"), F.col("bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order)) - 1
    joined = rows.withColumn("place", place).join(bases, (F.col(group) == F.col("_g")) & (F.col("bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("base") + F.col("place")).cast("long")).drop("_g", "_b", "base", "place", "bucket")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, dimensions: dict | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, one row per input row; the shards' bytes are near equal.

    ``dimensions`` names the metadata: Columns of numbers. By default the size,
    the language (by checksum) and the bytes a character: equal texts are alike
    in these and stay in one shard unless a cut falls inside their group.
    """
    if dimensions is None:
        size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
        width = size / F.greatest(F.length(F.col(text_col)), F.lit(1))
        dimensions = {"size": F.log2(size + 1), "lang": F.crc32(F.col("lang")), "width": width}
    rows = split_tree(metadata(docs, id_col, text_col, dimensions), shards, len(dimensions))
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "d0")
    return with_slots(rows, "shard", ["d0", "doc_id", "text_crc32"]).drop("d0")


def op6_query(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
