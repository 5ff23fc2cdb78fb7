"""Matching and BM25 ranking over an index: one pass over the postings of the query's terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.index import Index
from tessera.operators.query import Clause, analyze, parse

K1, B = 1.2, 0.75


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def scored_postings(index: Index, terms: list[tuple[str, str]], k1: float = K1, b: float = B) -> DataFrame:
    """field, term, doc_id, tf, positions, df and weight (BM25) of the terms' postings; none without terms.

    The terms are a filter that reaches the scan of the postings. Statistics have
    a row for each query term or field, so their joins broadcast.
    """
    wanted = reduce(lambda x, y: x | y, ((F.col("field") == f) & (F.col("term") == t) for f, t in terms), F.lit(False))
    df = index.term_stats().where(wanted).select("field", "term", "df")
    rows = index.postings.where(wanted).join(F.broadcast(df), ["field", "term"]).join(F.broadcast(index.field_stats()), "field")
    weight = idf(F.col("df"), F.col("n_docs")) * saturation(F.col("tf"), F.col("length"), F.col("average_length"), k1, b)
    return rows.select("field", "term", "doc_id", "tf", "positions", "df", weight.alias("weight"))


def phrase_hit(positions: list[Column]) -> Column:
    """Whether some place holds the terms one after the other; positions are arrays, null where the term is absent."""
    def back(held: Column, by: int) -> Column:  # a second parameter of the lambda itself would be the index
        return F.transform(held, lambda x: x - by)

    shifted = [back(p, k) for k, p in enumerate(positions)]
    return F.coalesce(F.size(reduce(F.array_intersect, shifted)) > 0, F.lit(False))


def matches(
    index: Index,
    text: str,
    text_fields: tuple[str, ...] = ("text",),
    weights: dict[str, float] | None = None,
    default_field: str = "text",
    synonyms: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """doc_id and score of every live document that the query matches, and the stored columns its exact clauses name.

    A document's terms are flags, and only the terms of phrases bring their
    positions. ``synonyms`` gives for a term the terms that stand for it, with
    the share of their weight that counts.
    """
    groups = parse(text, default_field)
    fields, rings = set(text_fields), synonyms or {}
    exact = sorted({c.field for g in groups for c in g if c.field not in fields})
    clauses = [c for g in groups for c in g if c.field in fields]
    typed = sorted({(c.field, t) for c in clauses for t in c.terms})
    ranked = {(c.field, t) for c in clauses if not c.prohibited for t in c.terms}
    shares = {k: 1.0 for k in ranked}
    for f, t in sorted(ranked):
        for other, share in rings.get(t, {}).items():
            shares.setdefault((f, other), share)
    terms = sorted({*typed, *shares, *((f, o) for f, t in typed for o in rings.get(t, {}))})
    place = {t: k for k, t in enumerate(terms)}
    rows = scored_postings(index, terms)
    is_term = lambda t: (F.col("field") == t[0]) & (F.col("term") == t[1])
    boost = F.lit(1.0)
    for name, value in (weights or {}).items():
        boost = F.when(F.col("field") == name, value).otherwise(boost)
    share = reduce(lambda x, kv: F.when(is_term(kv[0]), kv[1]).otherwise(x), shares.items(), F.lit(0.0))
    phrases = sorted({(c.field, t) for c in clauses if c.phrase for t in c.terms})
    by_doc = rows.groupBy("doc_id").agg(
        F.sum(F.col("weight") * boost * share).alias("score"),
        *(F.max(is_term(t)).alias(f"_t{k}") for t, k in place.items()),
        *(F.flatten(F.collect_list(F.when(is_term(t), F.col("positions")))).alias(f"_p{place[t]}") for t in phrases),
    )
    live = by_doc
    if exact:
        live = index.stored.select("doc_id", *exact).join(by_doc, "doc_id", "left")
        live = live.fillna(False, [f"_t{k}" for k in place.values()]).fillna(0.0, ["score"])

    def hit(clause: Clause) -> Column:
        if clause.field not in fields:
            if clause.field not in index.stored.columns:
                raise ValueError(f"no field {clause.field}")
            return F.coalesce(F.col(clause.field).cast("string") == clause.text, F.lit(False))
        if not clause.terms:
            return F.lit(False)
        if clause.phrase:
            return phrase_hit([F.when(F.size(f"_p{k}") > 0, F.col(f"_p{k}")) for k in (place[clause.field, t] for t in clause.terms)])
        standing = [(clause.field, o) for t in clause.terms for o in (t, *rings.get(t, {}))]
        return reduce(lambda x, y: x | y, (F.col(f"_t{place[t]}") for t in standing))

    def group_hit(group: tuple[Clause, ...]) -> Column:
        must = [hit(c) for c in group if c.required or (c.phrase and not c.prohibited)]
        bare = [hit(c) for c in group if not (c.required or c.prohibited or c.phrase)]
        found = reduce(lambda x, y: x & y, must) if must else reduce(lambda x, y: x | y, bare)
        return reduce(lambda x, c: x & ~hit(c), (c for c in group if c.prohibited), found)

    live = live.where(reduce(lambda x, y: x | y, map(group_hit, groups)))
    if index.tombstones is not None:
        live = live.join(index.tombstones, "doc_id", "left_anti")
    return live.select("doc_id", F.bround("score", 4).alias("score"), *exact)


def top(matched: DataFrame, limit: int = 10, after: tuple[float, int] | None = None) -> DataFrame:
    """A page of matches by falling score and rising id; ``after`` is the last row of the page before."""
    if after is not None:
        matched = matched.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("doc_id") > after[1])))
    return matched.orderBy(F.desc("score"), "doc_id").limit(limit)


def with_stored(matched: DataFrame, index: Index, *columns: str) -> DataFrame:
    return matched.join(index.stored.select("doc_id", *columns), "doc_id")


def facet(matched: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """The most frequent values among all matches, ties by the value's text."""
    counts = matched.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit)


def collapse(matched: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The best match of each key value with the number it stands for; rows without the key stand alone.

    The best is an aggregate, not a window, so a value that a third of all rows share is summed before it moves.
    """
    group = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00"), F.col("doc_id").cast("string")))
    best = matched.groupBy(group.alias("_group")).agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.select(F.col("b.doc_id").alias("doc_id"), (-F.col("b.s")).alias("score"), (F.col("n") - 1).alias("folded")).orderBy(F.desc("score"), "doc_id").limit(limit)


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], k: int = 60, depth: int = 100) -> DataFrame:
    """doc_id and fused score of rankings (doc_id, score), each cut at ``depth``."""
    votes = [
        top(r, depth).select("doc_id", (1 / (k + F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))).alias("vote")) for r in rankings.values()
    ]  # a window over ``depth`` rows
    fused = reduce(DataFrame.unionByName, votes).groupBy("doc_id").agg(F.sum("vote").alias("score"), F.count(F.lit(1)).alias("lists"))
    return fused.select("doc_id", F.bround("score", 6).alias("score"), "lists")


def rings(*words: tuple[str, ...], share: float = 0.6) -> dict[str, dict[str, float]]:
    """Synonyms for ``matches``: the words of a ring stand for each other at ``share`` of their weight. A word is in one ring at most."""
    out: dict[str, dict[str, float]] = {}
    for ring in words:
        terms = [t for w in ring for t in analyze(w)]
        if len(terms) != len(ring) or len(set(terms)) < max(2, len(ring)) or any(t in out for t in terms):
            raise ValueError(f"a ring needs two or more words of one term each, in no other ring: {ring}")
        out |= {t: {o: share for o in terms if o != t} for t in terms}
    return out


def tightest_window(positions: list[Column]) -> Column:
    """The first of the smallest ranges of positions that touch every term's: a struct of first, last and width. Null where a term is absent."""
    def reaching(start: Column) -> Column:
        ends = [F.array_min(F.filter(p, lambda x: x >= start)) for p in positions]
        last = F.greatest(*ends) if len(ends) > 1 else ends[0]
        whole = reduce(lambda x, y: x & y, (e.isNotNull() for e in ends))
        return F.when(whole, F.struct((last - start).alias("width"), start.alias("first"), last.alias("last")))

    every = F.sort_array(F.array_distinct(F.flatten(F.array(*positions))))
    return F.array_min(F.filter(F.transform(every, reaching), lambda w: w.isNotNull()))


def curated(matched: DataFrame, pinned: tuple[int, ...], blocked: tuple[int, ...], limit: int = 10) -> DataFrame:
    """doc_id, score, curated and place: the pinned documents first, in their order and with the best score, then the others without the blocked ones."""
    if set(pinned) & set(blocked):
        raise ValueError("a document can't be both pinned and blocked")
    spark = matched.sparkSession
    best = matched.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("score"))
    first = spark.createDataFrame([(d, k) for k, d in enumerate(pinned)], "doc_id long, place int").join(F.broadcast(best))
    rest = top(matched.where(~F.col("doc_id").isin(*pinned, *blocked)), limit)
    placed = rest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) + len(pinned) - 1)  # ``limit`` rows
    shown = lambda df, by: df.select("doc_id", "score", F.lit(by).alias("curated"), "place")
    return shown(first, True).unionByName(shown(placed, False)).where(F.col("place") < limit)


def cascade(tiers: dict[str, DataFrame], floor: int) -> tuple[str, DataFrame, list[str]]:
    """The first tier with ``floor`` documents at least, else the last, and the tiers that starved before it. At most ``floor`` rows of a tier are counted."""
    starved: list[str] = []
    for name, found in tiers.items():
        if found.select("doc_id").distinct().limit(floor).count() >= floor or len(starved) == len(tiers) - 1:
            return name, found, starved
        starved.append(name)
    raise ValueError("a cascade needs a tier")


def percolated(index: Index, subscriptions: dict[str, str], default_field: str = "text") -> DataFrame:
    """name and doc_id: the stored queries (without phrases) that each live document fires.

    Each clause is a row; postings and stored fields meet clauses by their term
    or value, and a group fires by what its counts say. A query must have a
    positive clause, by which documents find it.
    """
    rows, needs = [], []
    for name, text in sorted(subscriptions.items()):
        for g, group in enumerate(parse(text, default_field)):
            must = [c for c in group if c.required]
            for n, c in enumerate(group):
                if c.phrase:
                    raise ValueError("phrases can't be percolated")
                keyword = c.field in index.stored.columns and c.field != default_field
                for key in [c.text] if keyword else c.terms:
                    rows.append((c.field, key, keyword, name, g, n, "no" if c.prohibited else "must" if c.required else "may"))
            needs.append((name, g, len(must)))
    spark = index.postings.sparkSession
    clauses = spark.createDataFrame(rows, "field string, term string, keyword boolean, name string, grp int, clause int, kind string")
    met = index.postings.select("field", "term", "doc_id").join(F.broadcast(clauses.where("not keyword")), ["field", "term"])
    for name in sorted({r[0] for r in rows if r[2]}):
        held = index.stored.select(F.lit(name).alias("field"), F.col(name).cast("string").alias("term"), "doc_id")
        met = met.unionByName(held.join(F.broadcast(clauses.where("keyword")), ["field", "term"]))
    counts = met.groupBy("name", "grp", "doc_id").agg(
        F.count_distinct(F.when(F.col("kind") == "must", F.col("clause"))).alias("must"),
        F.count(F.when(F.col("kind") == "may", 1)).alias("may"),
        F.count(F.when(F.col("kind") == "no", 1)).alias("no"),
    )
    needed = F.broadcast(spark.createDataFrame(needs, "name string, grp int, wanted int"))
    fits = (F.col("no") == 0) & (F.col("must") == F.col("wanted")) & ((F.col("wanted") > 0) | (F.col("may") > 0))
    fired = counts.join(needed, ["name", "grp"]).where(fits).select("name", "doc_id").distinct()
    return fired if index.tombstones is None else fired.join(index.tombstones, "doc_id", "left_anti").select("name", "doc_id")
