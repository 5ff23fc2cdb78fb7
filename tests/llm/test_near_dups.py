"""The pipeline's near-duplicate stage against brute force around its similarity, and its recall by planted edits."""

import random

import corpus_pipeline as P
from tessera.llm import near_dups as N

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _stays(rows):
    """The ids of least documents of components by every pair's exact similarity."""
    sets, root = {i: _grams(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def _stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    return {r["doc_id"] for r in P.near_dup_stage(spark, docs, "").collect()}


def test_near_dup_stage_links_what_brute_force_links(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]  # in many texts that don't link
    rows = [(0, ""), (1, None), (2, "two words"), (3, "Two  words"), (4, "x " * 40), (5, "x " * 90)]
    for k in range(150):
        base = [word() for _ in range(rng.randint(60, 160))] + (passage if k % 2 else [])
        rows.append((100 + 10 * k, " ".join(base)))
        for c in range(rng.randint(1, 4)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 30))):
                copy[at] = word()
            rows.append((101 + 10 * k + c, " ".join(copy)))
    rows.append((9, rows[6][1] + " " + " ".join(rows[6][1].split()[:200] * 3)))  # a passage repeated
    rng.shuffle(rows)
    got, want = _stage(spark, rows), _stays(rows)
    assert want <= got  # nothing goes that brute force keeps
    gone = len(rows) - len(want)
    assert len(got - want) <= 0.03 * gone


def test_no_pair_at_the_threshold_is_missed(spark):
    """Pairs at 86 of 106 shingles, and a text whose nearest by fingerprint are all just too far: none that brute force links stays."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(400):
        base = [word() for _ in range(100)]
        copy = list(base)
        for at in (rng.randint(10, 40), rng.randint(55, 85)):
            copy[at] = word()
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(copy))]
    assert _stage(spark, rows) == _stays_of_pairs(rows)


def _stays_of_pairs(rows):
    """Brute force where only the two texts of a ten of ids share words."""
    return {i for k in range(0, len(rows), 2) for i in _stays(rows[k : k + 2])}


def test_rows_that_share_an_id_stay_apart(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, c), (2, a), (None, b), (None, c), (None, text()), (1, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in P.near_dup_stage(spark, docs, "").collect())
    assert got == sorted([(1, a), (1, b), (1, c), (0, rows[6][1])])


def test_stages_on_odd_tables(spark, tmp_path):
    """Shared ids, repeated rows, nulls, a very long text, clashing columns and an empty table."""
    rng = random.Random(8)
    text = lambda n=90: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item = text(20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, dirty, long = text(), text() + " " + item, text(60_000)
    rows = [(1, kept), (1, dirty), (1, text()), (2, long), (None, text()), (3, None), (4, "")]
    shape = COLUMNS + ", first boolean, same long, component_id long, kept string, __pipeline long"
    docs = spark.createDataFrame([(i, t, None, None, None, True, 1, 2, "k", 3) for i, t in rows + rows[:1]], shape)
    for name, stage in P.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            assert out.schema.names == docs.columns, name
            found = [(r["doc_id"], r["text"]) for r in out.collect()]
            if table is not docs:
                assert not found
            elif name == "benchmark_decontamination":
                assert (1, dirty) not in found and found.count((1, kept)) == 2 and len(found) == 7
            elif name == "simhash_near_dedup":
                assert len(found) == 6 and found.count((1, kept)) == 1  # null and empty texts are equal
            elif name == "quality_rules":
                assert sorted(map(str, found)) == sorted(map(str, rows[:5] + rows[:1]))
    assert P.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_common_passage_makes_no_pairs(spark):
    """Texts that share a fifth of their words, but no more, aren't compared by their whole sets; those that share enough still are."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(25)]
    texts = [" ".join([word() for _ in range(100)] + passage) for _ in range(80)]
    copy = texts[0].split()
    copy[10] = copy[50] = word()
    docs = spark.createDataFrame([(t,) for t in [*texts, " ".join(copy)]], "text string")
    heads = N.set_heads(docs, 5, 4, 5, np.zeros(1 << N.RARITY_BITS, np.uint8))
    sizes = N._sets(docs.select(F.monotonically_increasing_id().alias("fp"), "text"), 5).select(F.size("s").cast("long").alias("n")).distinct()
    named = heads.select(F.monotonically_increasing_id().alias("fp"), "head").join(sizes.agg(F.max("n").alias("n")))
    none = spark.createDataFrame([], "node long, root long")
    assert N.open_pairs(named, none, 4, 5).count() == 1


def _near_copies(rng, members, outsiders, words=120):
    """An original, copies with one or two of its words changed and copies with four to six changed."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    original = [word() for _ in range(words)]
    texts = [original]
    for k in range(members + outsiders):
        copy = list(original)
        for at in rng.sample(range(5, words - 5), rng.randint(1, 2) if k < members else rng.randint(4, 6)):
            copy[at] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_a_group_of_near_copies_is_met_once(spark):
    """Outsiders of a group meet it as one component, not each of its sets, and those that link to one of them are found."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(41)
    texts = _near_copies(rng, 120, 40)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "fp long, text string")
    sets = N._sets(docs, 5).select("fp", "s").localCheckpoint()
    heads = sets.select("fp", F.size("s").cast("long").alias("n"), "s").withColumn("head", F.expr("slice(s, 1, cast(n - (4 * n + 4) div 5 + 1 + n div 8 as int))")).drop("s")
    grams = [_grams(t) for t in texts]
    known = [(k, 0) for k in range(1, 121) if 5 * len(grams[k] & grams[0]) >= 4 * len(grams[k] | grams[0])]
    assert len(known) == 120
    roots = spark.createDataFrame(known, "node long, root long")
    rest = N.open_pairs(heads, roots, 4, 5)
    assert rest.where("u < 121").count() == rest.where("u = 0").count() <= 40  # thousands, were each of its sets met
    across = rest.where("u = 0").localCheckpoint()
    links = N.links_across(across, roots, roots.toDF("u", "v"), lambda wanted: sets.join(wanted, "fp"), 4, 5).collect()
    alike = lambda i, j: 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])
    assert all(alike(r["u"], r["v"]) for r in links)
    assert {max(r["u"], r["v"]) for r in links} == {x for x in range(121, 161) if any(alike(x, y) for y in range(121))}


def test_groups_of_near_copies_are_those_of_brute_force(spark):
    """Groups with and without their original, whose outsiders link to a few members or none."""
    rng = random.Random(43)
    texts = [t for k in range(4) for t in _near_copies(rng, 30, 20, rng.randint(70, 110))[k % 2 :]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert _stage(spark, rows) == _stays(rows)
