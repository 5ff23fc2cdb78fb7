"""Near duplicates by SimHash, with exact counts to decide.

1. Texts with equal sets of word shingles are one class, with the least id.
2. Each class has a SimHash fingerprint of several lanes over its set. Tiled
   exclusive-or comparison (``simhash``) within bands of set sizes gives for each
   class its nearest ones within the radius, which lies two deviations beyond the
   distance that sets just as similar as the threshold have.
3. The nearest three of lesser and of greater name are compared by their whole
   sets, in turns that bound the disk taken: only pairs with a Jaccard similarity
   of ``num`` / ``den`` or more are links. Components run over the links.
4. What fingerprints leave open is found exactly. Ordered by rarity, two sets of
   that similarity share many of the first n - ceil(n * num / den) + k shingles of
   either, k an eighth of the set; how many follows from both sizes. Components
   that may hold two such sets meet there, each as one row a shingle and a band of
   sizes. Two single sets are compared by their whole sets; the sets of two
   components by what they differ in from one set of the greater one. Components
   run over all links.

So no pair links that isn't that similar, and the components are those of all
pairs that are. A large group of near copies costs a few rows for each of its
members, and a set outside of it meets the group as one.

Defined results for odd input: null and empty texts have no shingles and are
equal; a text of fewer words than a shingle is one shingle; null ids never name
a component unless all of its ids are null; of rows that share an id the one of
least text hash goes first; very long texts are read whole; repeated rows give
their rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, materialize
from tessera.llm.components import connected_components
from tessera.llm.simhash import LANE_BITS, fingerprint_links, majority

RARITY_BITS, BLOCK_BITS = 20, 12  # shingles are counted by 2^20 buckets, which are summed in blocks of 2^12
PART = 1 << 24  # shingles that a turn of comparisons moves at least
NEAREST = 3
ASKED = 8  # a head has one shingle more for each so many of its set than a common one needs
BAND = 1.05  # sizes of a band of the last step
SPREAD = 256  # sets of a component that are measured by one copy of its middle


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles of the whole text, ascending."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return np.zeros(0, np.int64)
    shingles = list(map(b" ".join, zip(*(found[k:] for k in range(words))))) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles)).view(np.int64))


def lane_prints(found: np.ndarray, lanes: int) -> list[int]:
    """SimHash lanes of a set of hashes; each lane mixes the hashes anew."""
    hashes, out = found.view(np.uint64), []
    for lane in range(lanes):
        mixed = (hashes + np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(mixed ^ (mixed >> np.uint64(29))))
    return out


def wide_radius(similarity: float, lanes: int) -> int:
    """The mean distance of fingerprints of equal-sized sets of that similarity, and two deviations."""
    bits, cosine = lanes * LANE_BITS, 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    return int(bits * share + 2 * math.sqrt(bits * share * (1 - share)))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(name.., s) of texts (name.., text): the text column gives way to its set of shingles."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-1]
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_set(x.as_py(), words) for x in part.column(len(names))]
                ends = np.cumsum([0] + [len(f) for f in found])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], held], names=[*names, "s"])

    return texts.mapInArrow(run, "".join(f"{c} long, " for c in texts.columns[:-1]) + "s array<bigint>")


def _bucket_of(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def set_prints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """(doc_id, same, digest, n, lane0..) of docs (doc_id, same, text): a set's name, size and fingerprint. A task's last rows hold its ``block`` s of ``counts`` of shingles by bucket."""

    def run(batches):
        from xxhash import xxh3_128_digest

        counts = np.zeros(1 << RARITY_BITS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_set(x.as_py(), words) for x in part.column(2)]
                np.add.at(counts, _bucket_of(np.concatenate(found)), np.uint32(1))
                prints = np.array([lane_prints(f, lanes) for f in found], np.uint64).reshape(-1, lanes).view(np.int64)
                columns = [part.column(0), part.column(1), pa.array([xxh3_128_digest(f.tobytes()) for f in found], pa.binary()), pa.array([len(f) for f in found], pa.int64())]
                columns += [*(pa.array(prints[:, k]) for k in range(lanes)), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "digest", "n", *names, "block", "counts"])
        blocks = [(k, x.tobytes()) for k, x in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)) if x.any()]
        if blocks:
            blank = [pa.nulls(len(blocks), pa.binary() if c == "digest" else pa.int64()) for c in ("doc_id", "same", "digest", "n", *names)]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([k for k, _ in blocks], pa.int64()), pa.array([x for _, x in blocks], pa.binary())], names=["doc_id", "same", "digest", "n", *names, "block", "counts"])

    names = [f"lane{k}" for k in range(lanes)]
    return docs.mapInArrow(run, "doc_id long, same long, digest binary, n long, " + ", ".join(f"{n} long" for n in names) + ", block long, counts binary")


def rarity(counted: DataFrame) -> np.ndarray:
    """A level for each bucket of shingles, zero up to the mean count and one more for each doubling; from rows (block, counts).

    The table has a byte a bucket whatever the input. It only sets the order of
    shingles: any order gives the same links.
    """

    def total(key, table):
        summed = np.sum([np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("counts")], axis=0)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([summed.tobytes()], pa.binary())})

    out = np.zeros((1 << (RARITY_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for row in counted.groupBy("block").applyInArrow(total, "block long, counts binary").collect():
        out[row["block"]] = np.frombuffer(row["counts"], "<i8")
    out = out.reshape(-1)
    return np.log2(np.maximum(1.0, out / max(1.0, out.mean()))).astype(np.uint8)


def asked(n: int) -> int:
    """How many shingles the heads of two similar sets share, the lesser of n shingles.

    Of the common shingles the k-th by rarity has at most n - ceil(n * num / den)
    that are not common before it, so it lies in the first
    n - ceil(n * num / den) + k of either set.
    """
    return 1 + n // ASKED


def set_heads(docs: DataFrame, words: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """(digest, head) of docs (text): the rarest n - ceil(n * num / den) + asked(n) shingles of each set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                digests, heads = [], []
                for x in batch.slice(at, 512).column(0):
                    found = shingle_set(x.as_py(), words)
                    if len(found):
                        reach = len(found) + (-len(found) * num) // den + asked(len(found))
                        digests.append(xxh3_128_digest(found.tobytes()))
                        heads.append(found[np.argsort(shared.value[_bucket_of(found)], kind="stable")[:reach]])
                if digests:
                    ends = np.cumsum([0] + [len(h) for h in heads])
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(heads)))], names=["digest", "head"])

    return docs.mapInArrow(run, "digest binary, head array<bigint>")


def _ceil_share(total, num: int, den: int):
    """How many shingles two sets of together ``total`` share at least to be as similar as num / den."""
    return F.ceil(total * num / (num + den) - 1e-9)


def _asked_at_least(low, high, num: int, den: int):
    """Of a set (n, h), the least number of shingles that its head and that of a similar set of ``low`` to ``high`` shingles share.

    Sets as similar share t of ceil((n + k) * num / (num + den)) shingles; n - h of
    them may lie behind the one head and k less its own length behind the other.
    What that leaves is bounded from below by straight lines in k.
    """
    share = lambda k: (F.col("n") + k) * num / (num + den)
    behind = lambda k: share(k) - k * num / den + k / ASKED - 1
    return F.greatest(F.lit(1), F.ceil(F.least(F.col("h") - F.col("n") + share(low), share(low), behind(low), behind(high)) - 1e-6)).cast("int")


def _band(n):
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def open_pairs(heads: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): the pairs of components, by the names of their roots, that may hold two sets (fp, n, head) as similar as num / den.

    What the heads of two such sets share follows from the sizes of both, and all
    of it is among what sets of several components hold. So a set goes that holds
    less of this than partners of any size ask; for partners of each band of sizes
    two sets must meet in all but the last of what is asked, ordered by counts. A
    component is one row of a shingle and a band however many of its sets meet there.
    """
    placed = heads.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("r"), "head")
    placed = materialize(placed, "heads")
    by = Window.partitionBy("g")
    rows = placed.select("fp", "n", "r", F.size("head").alias("h"), F.explode("head").alias("g"))
    rows = rows.select("fp", "n", "r", "h", "g", F.count(F.lit(1)).over(by).alias("c"), F.min("r").over(by).alias("lo"), F.max("r").over(by).alias("hi"))
    met = rows.where("lo <> hi").groupBy("fp", "n", "r", "h").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("m"))
    low, high = F.ceil(F.col("n") * num / den - 1e-9), F.floor(F.col("n") * den / num + 1e-9)
    met = met.where(F.size("m") >= _asked_at_least(low, high, num, den))
    met = materialize(met.select("fp", "n", "r", "h", F.transform("m", lambda k: k["g"]).alias("m")), "met")
    discard(placed)

    keyed = met.withColumns({"own": _band(F.col("n")), "other": F.explode(F.sequence(_band(low), _band(high)))})
    band_low = F.greatest(low, F.floor(F.pow(F.lit(BAND), F.col("other"))) - 1)
    band_high = F.least(high, F.ceil(F.pow(F.lit(BAND), F.col("other") + 1)) + 1)
    keyed = keyed.withColumn("keys", F.size("m") - _asked_at_least(band_low, band_high, num, den) + 1).where("keys > 0")
    keyed = keyed.select("r", "own", "other", F.explode(F.slice("m", F.lit(1), F.col("keys"))).alias("g")).distinct()
    x, y = keyed.where("own <= other").alias("x"), keyed.where("own >= other").alias("y")
    apart = (F.col("x.r") < F.col("y.r")) | ((F.col("x.r") > F.col("y.r")) & (F.col("x.own") < F.col("x.other")))
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own")) & apart)
    pairs = pairs.select(F.least("x.r", "y.r").alias("u"), F.greatest("x.r", "y.r").alias("v")).distinct()
    several = roots.select(F.col("root").alias("k")).distinct()
    for side in ("u", "v"):
        pairs = pairs.join(several.withColumn("found", F.lit(True)), F.col(side) == F.col("k"), "left").withColumn(f"{side}_alone", F.col("found").isNull()).drop("k", "found")
    pairs = materialize(pairs, "met-pairs")
    # Where both are single sets, what their heads share is counted.
    side = lambda fp, n, h, m: met.select(F.col("fp").alias(fp), F.col("n").alias(n), F.col("h").alias(h), F.col("m").alias(m))
    both = pairs.where("u_alone and v_alone").join(side("u", "nu", "hu", "mu"), "u").join(side("v", "nv", "hv", "mv"), "v")
    least = F.least(F.col("hu") - F.col("nu"), F.col("hv") - F.col("nv")) + _ceil_share(F.col("nu") + F.col("nv"), num, den)
    both = both.where(F.size(F.array_intersect("mu", "mv")) >= least)
    out = materialize(both.select("u", "v").union(pairs.where("not (u_alone and v_alone)").select("u", "v")), "open-pairs")
    discard(met, pairs)
    return out


def links_across(pairs: DataFrame, roots: DataFrame, known: DataFrame, sets_of, num: int, den: int) -> DataFrame:
    """(u, v): for each of the pairs of components (u, v), the greater one of several sets, links between the two, if there are any.

    Sets of both are measured by how they differ from one set c of the greater
    component. With d of c's shingles missing from a set and ``diff`` all in which
    it differs, sets x and y share |c| - dx - dy + |diff x and diff y|. So the least
    q = num * n + (num + den) * d of the greater component tells whether x links
    whatever it shares; where not, two sets must have enough differences in
    common, which those near c haven't, and meet in the rarest of them.
    """
    sizes = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("z"))
    for side in ("u", "v"):
        pairs = pairs.join(sizes.select(F.col("root").alias("k"), F.col("z").alias(f"z{side}")), F.col(side) == F.col("k"), "left").drop("k").fillna(1, [f"z{side}"])
    ahead = F.col("zu") >= F.col("zv")
    turned = materialize(pairs.select(F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("ctx"), F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("other"), F.greatest("zu", "zv").alias("z")), "turned")
    every = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    inside = turned.select("ctx", "z").distinct().join(every, F.col("ctx") == F.col("root")).select("ctx", "z", F.lit(0).alias("side"), F.col("node").alias("fp"))
    outside = turned.join(every, F.col("other") == F.col("root"), "left").select("ctx", "z", F.lit(1).alias("side"), F.coalesce("node", "other").alias("fp"))
    rows = materialize(inside.union(outside), "contexts")
    sets = materialize(sets_of(rows.select("fp").distinct()), "context-sets")
    # The set with most links is likely near the others; any gives the same links.
    degrees = known.select("u").union(known.select("v")).groupBy(F.col("u").alias("fp")).agg(F.count(F.lit(1)).alias("links"))
    hubs = rows.where("side = 0").join(degrees, "fp", "left").groupBy("ctx", "z").agg(F.max_by("fp", F.struct(F.coalesce("links", F.lit(0)), F.col("fp"))).alias("fp"))
    hubs = hubs.join(sets.select("fp", F.col("s").alias("c")), "fp").select("ctx", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"z div {SPREAD}"))).alias("deal"))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("fp"), F.expr(f"z div {SPREAD} + 1"))).join(sets, "fp").join(hubs, ["ctx", "deal"])
    told = dealt.select("ctx", "side", "fp", F.size("s").cast("long").alias("n"), F.size("c").cast("long").alias("nc"), F.array_except("c", "s").alias("lost"), F.array_except("s", "c").alias("more"))
    whole = num + den
    told = told.select("ctx", "side", "fp", "nc", (F.col("n") * num + F.size("lost") * whole).alias("q"), F.concat("lost", "more").alias("diff"))
    told = materialize(told, "differences")
    discard(turned, rows, sets)

    members, others = told.where("side = 0"), told.where("side = 1")
    best = members.groupBy("ctx").agg(F.min("q").alias("w"), F.min_by("fp", "q").alias("v"))
    others = others.join(best, "ctx")
    sure = F.col("q") + F.col("w") <= F.col("nc") * whole
    out = others.where(sure).select(F.col("fp").alias("u"), "v")
    others = others.where(~sure).select("ctx", "side", "fp", "nc", "q", "w", "diff")
    members = members.join(others.groupBy("ctx").agg(F.min("q").alias("w")), "ctx").select(*others.columns)
    by = Window.partitionBy("ctx", "g")
    names = ["ctx", "side", "fp", "nc", "q", "w"]
    seen = others.union(members).select(*names, F.explode("diff").alias("g"))
    seen = seen.select(*names, "g", F.count(F.lit(1)).over(by).alias("c"), F.min("side").over(by).alias("lo"), F.max("side").over(by).alias("hi")).where("lo <> hi")
    seen = seen.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "g"))), lambda k: k["g"]).alias("m"))
    asks = lambda q, w, nc: F.ceil((q + w) / whole - 1e-9) - nc
    seen = seen.withColumn("keys", (F.size("m") - asks(F.col("q"), F.col("w"), F.col("nc")) + 1).cast("int")).where("keys > 0")
    seen = materialize(seen, "shared-differences")
    keyed = seen.select("ctx", "side", "fp", "nc", "q", F.size("m").alias("size"), F.posexplode(F.slice("m", F.lit(1), F.col("keys"))).alias("at", "g"))
    x, y = keyed.where("side = 1").alias("x"), keyed.where("side = 0").alias("y")
    least = asks(F.col("x.q"), F.col("y.q"), F.col("x.nc"))
    meet = (F.col("x.ctx") == F.col("y.ctx")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.at") + least <= F.col("x.size")) & (F.col("y.at") + least <= F.col("y.size"))
    near = x.join(y, meet).select(F.col("x.ctx").alias("ctx"), F.col("x.fp").alias("u"), F.col("y.fp").alias("v"), least.alias("least")).distinct()
    side = lambda k, fp, m: seen.where(F.col("side") == k).select("ctx", F.col("fp").alias(fp), F.col("m").alias(m))
    near = near.join(side(1, "u", "mu"), ["ctx", "u"]).join(side(0, "v", "mv"), ["ctx", "v"])
    out = materialize(out.union(near.where(F.size(F.array_intersect("mu", "mv")) >= F.col("least")).select("u", "v")), "links-across")
    discard(told, seen)
    return out


def whole_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(fp, s): the whole sets of the wanted classes (fp)."""
    rows = classes.join(wanted, "fp").select("fp", F.col("first.doc_id").alias("c_id"), F.col("first.same").alias("c_same"))
    texts = docs.join(rows, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("same") == F.col("c_same"))).select("fp", "text").dropDuplicates(["fp"])
    return _sets(texts, words)


def verified(pairs: DataFrame, sets: DataFrame, part: int, num: int, den: int) -> DataFrame:
    """The pairs (u, nu, v) whose whole sets are as similar as num / den, in turns that move about ``part`` shingles each."""
    moved = pairs.agg(F.coalesce(F.sum("nu"), F.lit(0))).first()[0]
    turns, out = max(1, -(-moved // part)), []
    for turn in range(turns):
        some = pairs.where(F.pmod(F.xxhash64("u", "v"), F.lit(turns)) == turn).select("u", "v")
        met = some.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("fp").alias("v"), F.col("s").alias("sv")), "v")
        sizes = met.select("u", "v", F.size(F.array_intersect("su", "sv")).cast("long").alias("both"), (F.size("su") + F.size("sv")).cast("long").alias("sum"))
        out.append(materialize(sizes.where(F.col("both") * den >= (F.col("sum") - F.col("both")) * num).select("u", "v"), "links"))
    return functools.reduce(DataFrame.union, out)


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5, lanes: int = 4) -> DataFrame:
    """doc_id, same, component_id and first, one row per input row.

    component_id is the least doc_id that links reach; ``first`` marks the rows
    that stand for their component: its least doc_id and, of texts with that id,
    the one of least hash (``same``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    told = materialize(set_prints(docs, words, lanes), "prints")
    rows = told.where("block is null").drop("block", "counts")
    levels = rarity(told.where("block is not null").select("block", "counts"))
    # Nulls last, so a class goes by a row with an id if it has one.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("same")))
    names = [f"lane{k}" for k in range(lanes)]
    classes = rows.groupBy("digest").agg(first.alias("first"), *(F.first(c).alias(c) for c in ("n", *names)))
    # The band is by size: sets that link lie in one band or in neighbouring ones.
    band = (F.log(F.greatest("n", F.lit(1)).cast("double")) / math.log(den / num) + 1e-9).cast("int")
    classes = materialize(classes.withColumns({"fp": F.monotonically_increasing_id(), "band": band}), "classes")

    radius = wide_radius(num / den, lanes)
    near = fingerprint_links(classes.where("n > 0").select("fp", "band", *names), lanes, radius, 1, radius + 1, "band", nearest=True)
    # On either side, so that a copy finds its original and a group holds together wherever they stand.
    nearest = F.slice(F.sort_array(F.collect_list(F.struct("d", "v"))), 1, NEAREST)
    near = near.groupBy("u", (F.col("u") > F.col("v")).alias("side")).agg(nearest.alias("near")).select(F.col("u").alias("x"), F.explode("near.v").alias("y"))
    near = near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    size = lambda fp, n: classes.select(F.col("fp").alias(fp), F.col("n").alias(n))
    pairs = near.join(size("u", "nu"), "u").join(size("v", "nv"), "v")
    pairs = materialize(pairs.where((F.least("nu", "nv") * den) >= (F.greatest("nu", "nv") * num)).select("u", "nu", "v"), "pairs")
    held = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def links_of(found: DataFrame) -> DataFrame:
        sets = materialize(whole_sets(found.select(F.col("u").alias("fp")).union(found.select("v")).distinct(), classes, docs, words), "shingle-sets")
        links = verified(found, sets, max(PART, held // 4), num, den)
        discard(sets)
        return links

    links = links_of(pairs)
    roots = connected_components(links)
    heads = set_heads(docs.select("text"), words, num, den, levels).dropDuplicates(["digest"])
    rest = open_pairs(heads.join(classes.select("digest", "fp", "n"), "digest").select("fp", "n", "head"), roots, num, den)
    several = roots.select(F.col("root").alias("k")).distinct()
    alone = rest.join(several, F.col("u") == F.col("k"), "left_anti").join(several, F.col("v") == F.col("k"), "left_anti")
    left = materialize(alone.join(pairs.select("u", "v"), ["u", "v"], "left_anti").join(size("u", "nu"), "u").select("u", "nu", "v"), "left-pairs")
    across = rest.join(alone, ["u", "v"], "left_anti")
    more = []
    if not left.isEmpty():
        more.append(links_of(left))
    if not across.isEmpty():
        more.append(links_across(across, roots, links, lambda wanted: whole_sets(wanted, classes, docs, words), num, den))
    if more:
        roots = connected_components(functools.reduce(DataFrame.union, more, links))
    discard(pairs, rest, left)

    linked = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = linked.join(classes.select("fp", F.col("first").alias("least")), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    ids = classes.join(named, "fp", "left").select("digest", F.coalesce("component", "first").alias("component"))
    out = rows.select("doc_id", "same", "digest").join(ids, "digest")
    stands = F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("same") == F.col("component.same"))
    return out.select("doc_id", "same", F.col("component.doc_id").alias("component_id"), stands.alias("first"))
