"""SimHash near-duplicates by tiled exact comparison.

Each text gets a fingerprint of one or more 64-bit lanes. Equal fingerprints
collapse to one row. Distinct fingerprints are put in tiles by the population
counts of their parts; two tiles are compared only where those counts allow a
distance within the radius, and then every pair of the two is compared by
numpy exclusive-or and bit counts. A tile pair returns a spanning forest of its
links, which joins the same fingerprints as all its links do, so a group of
thousands of near copies yields as many rows as it has members.

Defined results for odd input: null and empty texts have no words and the
fingerprint zero; a bit set in just half of the shingles is not set; very long
texts are read whole; repeated rows are returned once each; null ids never name a
component unless all of its ids are null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.components import connected_components

LANE_BITS = 64
TILE_ROWS = 2048
BLOCK = 1 << 16  # shingles whose bits are counted at a time


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(LANE_BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3, lanes: int = 1, seed: int = 42) -> tuple[list[int], int]:
    """The lanes as unsigned ints, and the number of shingles, of one whole text."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return [0] * lanes, 0
    shingles = list(map(b" ".join, zip(*(found[k:] for k in range(words))))) if len(found) >= words else [b" ".join(found)]
    n = len(shingles)
    return [majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed + lane)), dtype=np.uint64, count=n)) for lane in range(lanes)], n


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int) -> DataFrame:
    """doc_id, lane0.. (signed longs) and n_shingles, one row per input row."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(x.as_py(), words, lanes) for x in batch.column(1)]
            columns = [batch.column(0)]
            columns += [pa.array(np.array([f[0][k] for f in found], np.uint64).view(np.int64), pa.int64()) for k in range(lanes)]
            columns.append(pa.array([f[1] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"lane{k}" for k in range(lanes)), "n_shingles"])

    schema = "doc_id long, " + "".join(f"lane{k} long, " for k in range(lanes)) + "n_shingles long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among n rows as stars: each row with the least row it reaches."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            rows = np.nonzero(label != np.arange(n))[0]
            return rows, label[rows]
        label = new


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between tiles a and b (rows x lanes), or inside a; rows of b count on from a's."""
    own = b is None
    other = a if own else b
    found_i, found_j, step = [], [], max(1, (1 << 19) // max(1, len(other)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        apart = np.bitwise_count(part[:, None, 0] ^ other[None, :, 0])
        for lane in range(1, a.shape[1]):
            apart = apart + np.bitwise_count(part[:, None, lane] ^ other[None, :, lane])
        i, j = np.nonzero(apart <= radius)
        if own:
            i, j = i[i + at < j], j[i + at < j]
        found_i.append(i + at)
        found_j.append(j if own else j + len(a))
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    return _forest(i, j, len(a) + (0 if own else len(b))) if len(i) > len(a) else (i, j)


def nearest_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a its nearest row of b within the radius, and the other way round; inside a for each row its nearest earlier and its nearest later one. Rows (i, j) and distances; i is the row whose neighbour j is, and rows of b count on from a's."""
    own = b is None
    other = a if own else b
    best, near = np.full(len(other), 255, np.uint8), np.zeros(len(other), np.int64)
    step, found = max(1, (1 << 19) // max(1, len(other))), []
    for at in range(0, len(a), step):
        part = a[at : at + step]
        apart = np.bitwise_count(part[:, None, 0] ^ other[None, :, 0])
        for lane in range(1, a.shape[1]):
            apart += np.bitwise_count(part[:, None, lane] ^ other[None, :, lane])
        if own:
            apart[np.arange(at, at + len(part))[:, None] >= np.arange(len(other))[None, :]] = 255
        least = apart.min(axis=0)
        closer = np.nonzero((least <= radius) & (least < best))[0]
        best[closer], near[closer] = least[closer], apart[:, closer].argmin(axis=0) + at
        least = apart.min(axis=1)
        rows = np.nonzero(least <= radius)[0]
        found.append((rows + at, apart[rows].argmin(axis=1) + (0 if own else len(a)), least[rows]))
    j = np.nonzero(best <= radius)[0]
    found.append((j + (0 if own else len(a)), near[j], best[j]))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    return i, j, d.astype(np.int64)


def fingerprint_links(prints: DataFrame, lanes: int, radius: int, parts: int, step: int, band: str | None, tile_rows: int = TILE_ROWS, nearest: bool = False) -> DataFrame:
    """Links (u, v) between rows of ``prints`` (fp, lane0.., and the band column): a forest of each tile pair.

    With ``nearest`` the links are (u, v, d): of each tile pair, for each row u of
    either tile its nearest row v of the other one, and their distance.

    The tile key holds, for each of ``parts`` equal parts of the bits, the
    population count in bins of ``step``. Distances within the radius need the
    counts of all parts to differ by the radius at most in sum.
    """
    width = lanes * LANE_BITS // parts
    bins = width // step + 1
    if width > LANE_BITS:  # a part of several whole lanes
        pops = [sum(F.bit_count(f"lane{k}") for k in range(p * lanes // parts, (p + 1) * lanes // parts)) for p in range(parts)]
    else:
        each, mask = LANE_BITS // width, -1 if width == LANE_BITS else (1 << width) - 1
        pops = [F.bit_count(F.shiftrightunsigned(f"lane{p // each}", width * (p % each)).bitwiseAND(mask)) for p in range(parts)]
    keyed = prints.select(
        "fp",
        F.array(*(f"lane{k}" for k in range(lanes))).alias("lanes"),
        (F.col(band) if band else F.lit(0)).cast("int").alias("band"),
        *((p / step).cast("int").alias(f"p{k}") for k, p in enumerate(pops)),
    )
    key = ["band", *(f"p{k}" for k in range(parts))]
    # At most bins ** parts rows a band: the population counts bound the table, not the input, so it is broadcast.
    sizes = F.broadcast(keyed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("subs")))
    tiles = (
        keyed.join(sizes, key)
        .withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
        .groupBy(*key, "sub")
        .agg(F.collect_list(F.struct("fp", "lanes")).alias("rows"))
        .select(*key, "sub", F.col("rows.fp").alias("fps"), F.flatten("rows.lanes").alias("bits"))
    )
    tiles = materialize(tiles, "tiles")
    reach = math.ceil(radius / step)
    near = [d for d in itertools.product(range(-reach, reach + 1), repeat=parts) if sum(max(0, (abs(x) - 1) * step + 1) for x in d) <= radius]
    offsets = [d for d in itertools.product(range(-1, 2) if band else [0], near) if (d[0], *d[1]) >= (0,) * (parts + 1)]
    away = F.from_json(F.lit(str([[d[0], *d[1]] for d in offsets]).replace(" ", "")), "array<array<int>>")
    left = tiles.withColumn("d", F.explode(away)).select(
        *((F.col(c) + F.col("d")[k]).alias(c) for k, c in enumerate(key)),
        F.forall("d", lambda x: x == 0).alias("own_key"),
        F.col("sub").alias("sub_a"),
        F.col("fps").alias("fps_a"),
        F.col("bits").alias("bits_a"),
    )
    # Pairs of tiles are dealt out by the second one, so those of one key spread over tasks.
    left = left.join(sizes, key).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    pairs = left.where(~F.col("own_key") | (F.col("sub_a") <= F.col("sub"))).join(tiles, [*key, "sub"])
    pairs = pairs.select("fps_a", "bits_a", "fps", "bits", (F.col("own_key") & (F.col("sub_a") == F.col("sub"))).alias("same"))

    def run(batches):
        for batch in batches:
            us, vs, ds = [], [], []
            for r in range(batch.num_rows):
                fa, ba, fb, bb = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(4))
                a, b = ba.view(np.uint64).reshape(-1, lanes), bb.view(np.uint64).reshape(-1, lanes)
                same = batch.column(4)[r].as_py()
                if nearest:
                    i, j, d = nearest_links(a, None if same else b, radius)
                    ds.append(d)
                else:
                    i, j = tile_links(a, None if same else b, radius)
                if len(i):
                    names = fa if same else np.concatenate([fa, fb])
                    us.append(names[i])
                    vs.append(names[j])
            if us:
                columns = {"u": np.concatenate(us), "v": np.concatenate(vs)} | ({"d": np.concatenate(ds)} if nearest else {})
                yield pa.RecordBatch.from_pydict({k: pa.array(c) for k, c in columns.items()})

    return pairs.mapInArrow(run, "u long, v long, d long" if nearest else "u long, v long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    lanes: int = 1,
    radius: int = 2,
    similarity: float | None = None,
) -> DataFrame:
    """doc_id, fingerprint (hex), n_shingles and component_id, one row per input row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    least doc_id that links reach. With ``similarity``, texts whose numbers of
    shingles already rule it out aren't compared.
    """
    names = [f"lane{k}" for k in range(lanes)]
    prints = materialize(fingerprints(docs, id_col, text_col, words, lanes), "fingerprints")
    band = (F.log(F.greatest(F.col("n_shingles"), F.lit(1)).cast("double")) / math.log(1 / similarity)).cast("int") if similarity else F.lit(0)
    prints = prints.withColumn("band", band)
    same = [*names, "band"]
    # The name of a distinct fingerprint: itself, or a number (which writing it fixes) where it has more than one long.
    name = F.col("lane0") if same == ["lane0", "band"] and not similarity else F.monotonically_increasing_id()
    distinct = materialize(prints.groupBy(*same).agg(F.min("doc_id").alias("least")).withColumn("fp", name), "distinct")
    coarse = radius > 4
    links = fingerprint_links(distinct, lanes, radius, 1 if coarse else 4 * lanes, radius + 1 if coarse else 1, "band" if similarity else None)
    roots = connected_components(links)
    linked = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = linked.join(distinct.select("fp", "least"), "fp")
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"))
    linked = linked.join(firsts, "root").select("fp", "first")
    ids = distinct.join(linked, "fp", "left").select(*same, F.coalesce("first", "least").alias("component_id"))
    out = prints.join(ids, same)
    text = F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in names))
    return out.select("doc_id", text.alias("fingerprint"), "n_shingles", "component_id")


def op2_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
