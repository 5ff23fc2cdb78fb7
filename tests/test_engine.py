"""The engine against plain Python on small tables, and against DuckDB on the smallest test tables."""

import hashlib
import itertools
import math
import os
import random
import re
import unicodedata
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values
from tessera.operators import graph, query, ranking, search, sketches, suggest, words
from tessera.operators.index import build_index, distinct_postings, open_index, stored_index, vocabulary
from tessera.plans import catalog, experiment_queries
from tessera.streaming import logs

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "the cat sat on the mat", "a"),
    (2, "a black cat and a black dog", "b"),
    (3, "dogs chasing cats quickly", None),
    (4, "", "a"),
    (5, None, "b"),
    (6, "the of and", "a"),
    (7, "cat mat cat mat", None),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return build_index(docs, {"text": F.col("text")})


def found(df):
    return [r["doc_id"] for r in df.collect()]


def bm25(terms):
    docs = {i: list(query.analyze(t or "")) for i, t, _ in TEXTS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, words in docs.items():
        tf = Counter(words)
        for t in terms:
            df = sum(t in w for w in docs.values())
            if tf[t]:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / avg))
    return out


def test_scores_match_plain_python(index):
    want = bm25(["cat", "dog"])
    got = {r["doc_id"]: r["score"] for r in search.matches(index, "cat dogs").collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_matching_rules(index):
    assert found(search.top(search.matches(index, "+cat -mat"))) == [2, 3]
    assert set(found(search.matches(index, '"cat mat"'))) == {7}
    assert set(found(search.matches(index, '"cat sat mat"'))) == {1}
    assert set(found(search.matches(index, "+lang:a +cat OR dog"))) == {1, 2, 3}
    assert found(search.matches(index, "+the")) == []


def test_pages_are_the_whole(index):
    every = search.matches(index, "cat dog mat")
    whole = search.top(every, 10).collect()
    first = search.top(every, 2).collect()
    rest = search.top(every, 10, (first[-1]["score"], first[-1]["doc_id"])).collect()
    assert first + rest == whole


def test_deleted_rows_still_count_in_statistics(spark, index):
    gone = index.delete(spark.createDataFrame([(7,)], "doc_id long"))
    before = {r["doc_id"]: r["score"] for r in search.matches(index, "cat").collect()}
    after = {r["doc_id"]: r["score"] for r in search.matches(gone, "cat").collect()}
    assert after == {k: v for k, v in before.items() if k != 7}
    assert gone.compacted().stored.count() == len(TEXTS) - 1


def test_index_round_trip(spark, index, tmp_path):
    index.write(str(tmp_path))
    assert sorted(found(search.matches(open_index(spark, str(tmp_path)), "cat"))) == [1, 2, 3, 7]


@pytest.mark.parametrize("text", ["", '"open', "OR cat", "cat OR", "-cat", "+", "cat -", '""', ":x", "lang:"])
def test_unreadable_queries(text):
    with pytest.raises(query.QueryError):
        query.parse(text)


def test_collapse_and_facet(spark, index):
    hits = search.with_stored(search.matches(index, "cat"), index, "lang")
    rows = {r["doc_id"]: r["folded"] for r in search.collapse(hits, "lang").collect()}
    assert rows == {1: 0, 2: 0, 3: 0, 7: 0}
    assert [tuple(r) for r in search.facet(hits, "lang").collect()] == [("a", 1), ("b", 1)]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.stem(F.lit("running")).alias("stem"),
        T.phonetic_code(F.lit("Ashcraft")).alias("sound"),
        F.array_join(T.split_identifier(F.lit("parseHTTPResponse2_old")), " ").alias("parts"),
        T.fold(F.lit("Straße œuvre été")).alias("fold"),
        T.sniff_language(F.lit("the end of the day is in the book")).alias("lang"),
        T.scrub(F.lit("mail a.b@c.org or +1 (555) 555-0100")).alias("scrub"),
        F.size(T.ngrams(F.lit("ab"), 3)).alias("grams"),
    ).first()
    assert row["stem"] == "runn" and row["sound"] == "A226"
    assert row["parts"] == "parse http response 2 old" and row["fold"] == "Strasse oeuvre ete"
    assert row["lang"] == "en" and row["scrub"] == "mail [email] or +1 (555) 555-0100" and row["grams"] == 2


def test_scrub_matches_plain_patterns(spark):
    card = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")
    email = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")
    phone = re.compile(r"(?<!\d)(?:\+?\d[\s-]?){7,14}\d(?!\d)")
    rng = random.Random(3)
    texts = ["card 4111 1111 1111 1111 call 555 010 9999", "jösé+x@exämple.co.uk, +1 555-010-9999", "1" * 25, None, ""]
    texts += ["".join(rng.choice("0123456789 -+a@.é") for _ in range(rng.randint(5, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.scrub(F.col("t")).alias("s")).collect()
    for r in rows:
        text = texts[r["k"]]
        assert r["s"] == (text if text is None else phone.sub("[phone]", email.sub("[email]", card.sub("[card]", text))))


def test_sounds_and_folds(spark):
    words = ["bébé", "Ashcraft", "Kovač", "Tymczak", "éé", "straße", "O'Neil", "ő", "ź", "ĩñ", "ǿ", "x\u0301y"]
    def sound(name):
        letters, out = [c for c in name.lower() if c.isalpha()], []
        kinds = [next((d for d, of in T.SOUNDS.items() if c in of), "") for c in letters]
        for before, d in zip(kinds, kinds[1:]):
            if d and d != before:
                out.append(d)
        return (letters[0].upper() + "".join(out))[:4].ljust(4, "0")

    def plain(text):
        spelled = "".join(T.LIGATURES.get(c, c) for c in text)
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", spelled) if not unicodedata.combining(c)))

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.phonetic_code(F.col("w")).alias("s"), T.fold(F.col("w")).alias("f")).collect()
    assert [(r["w"], r["s"], r["f"]) for r in rows] == [(w, sound(w), plain(w)) for w in words]


def test_components_and_authority(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 8), (3, 4)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    edges, n = [(0, 1), (1, 2), (2, 0), (3, 0)], 5
    rank = {k: 1 / n for k in range(n)}
    for _ in range(20):
        loose = sum(rank[k] for k in range(n) if not any(a == k for a, _ in edges))
        rank = {k: 0.15 / n + 0.85 * (loose / n + sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == k)) for k in range(n)}
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = {r["node"]: r["rank"] for r in graph.authority(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == pytest.approx(rank)


def test_similar_pairs_match_all_pairs(spark):
    base = "one two three four five six seven eight nine ten".split()
    texts = [(k, " ".join(base[: 10 - k] + [f"w{k}{j}" for j in range(k)])) for k in range(5)] + [(10, " ".join(base)), (11, ""), (12, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in texts if t for w in [query.analyze(t)] if i != 10}
    want = {(a, b) for a in sets for b in sets if a < b and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4) >= 0.6}
    got = {(r["a"], r["b"]) for r in graph.similar_pairs(docs, T.analyzed_terms(F.col("text"))).collect()}
    assert got == want


def test_clusters_are_components_of_pairs(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(40)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.03 else f"x{rng.randint(0, 99)}" for w in b) for b in base for _ in range(rng.randint(1, 9))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = graph.similar_pairs(docs, T.analyzed_terms(F.col("text")))
    want = {(r["node"], r["root"]) for r in graph.components(pairs.select("a", "b")).collect()}
    assert want and {(r["node"], r["root"]) for r in graph.similar_clusters(docs, T.analyzed_terms(F.col("text"))).collect()} == want


def test_empty_tables(spark, tmp_path):
    """Queries over the documents give a result where there are none."""
    for name, file in (("documents", "documents"), ("labels", "labels"), ("customer", "customer"), ("benchmark", "benchmark"), ("conversations", "conversations"), ("events", "events"), ("part", "part")):
        spark.read.parquet(f"{SF}/{file}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("bm25_topk", "page_two", "more_like_this", "precision_recall", "link_authority", "term_trace", "bloom_filter", "compound_words", "export_pages", "slow_percentiles", "hll_estimate", "spelled_search", "last_view"):
        catalog.queries()[name](spark, str(tmp_path)).collect()


def test_a_stored_index_is_read_not_rebuilt(spark, tmp_path):
    rows = spark.createDataFrame([(1, "cat mat"), (2, "dog")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    one = stored_index(docs, {"text": F.col("text")})
    assert one.postings.inputFiles() == stored_index(docs, {"text": F.col("text")}).postings.inputFiles()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search.scored_postings(one, [("text", "cat"), ("text", "dog")])._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*(Or\(.*EqualTo\(term,cat\).*EqualTo\(term,dog\)|In\(term, \[cat,dog)", plan)
    rows.union(rows.selectExpr("doc_id + 5", "text")).write.mode("overwrite").parquet(str(tmp_path / "t"))
    again = stored_index(spark.read.parquet(str(tmp_path / "t")), {"text": F.col("text")})
    assert sorted(found(search.matches(again, "cat"))) == [1, 6] and found(search.matches(one, "cat")) == [1]
    both = build_index(rows, {"text": F.col("text")}).added(build_index(rows.selectExpr("doc_id + 9 AS doc_id", "text"), {"text": F.col("text")}))
    assert sorted(found(search.matches(both, "cat dog"))) == [1, 2, 10, 11]


def test_index_rows_are_built_in_place(spark, tmp_path):
    """No text's array is copied for each of its terms, nothing is shuffled to count terms, and rows that share an id are one document."""
    texts = [(1, "cat mat cat"), (2, "dog"), (1, "mat dogs"), (None, "cat"), (None, "cat sat"), (3, None), (4, "the of")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    shape = lambda df: sorted(((str(r["doc_id"]), r["term"], r["tf"], r["length"], len(r["positions"])) for r in df.collect()))
    want = [("1", "cat", 2, 3, 2), ("1", "dog", 1, 2, 1), ("1", "mat", 2, 3, 2), ("2", "dog", 1, 1, 1), ("None", "cat", 2, 2, 2), ("None", "sat", 1, 2, 1)]
    assert shape(build_index(docs, {"text": F.col("text")}).postings) == want == shape(stored_index(docs, {"text": F.col("text")}).postings)
    once = build_index(docs.where("doc_id > 1"), {"text": F.col("text")}).postings
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and re.search(r"Generate explode\(p#\d+\), \[doc_id#\d+L, length#\d+\]", plan)


def test_synonyms_pins_and_windows(spark, index):
    rings = search.rings(("cat", "mat"))
    plain = {r["doc_id"]: r["score"] for r in search.matches(index, "mat").collect()}
    grown = {r["doc_id"]: r["score"] for r in search.matches(index, "mat", synonyms=rings).collect()}
    extra = bm25(["cat"])
    assert grown == pytest.approx({k: plain.get(k, 0) + 0.6 * extra.get(k, 0) for k in {*plain, *extra}}, abs=2e-4)
    with pytest.raises(ValueError):
        search.rings(("cat", "mat"), ("mat", "dog"))
    page = [(r["doc_id"], r["curated"]) for r in search.curated(search.matches(index, "cat"), (5, 3), (7,)).orderBy("place").collect()]
    assert page[:2] == [(5, True), (3, True)] and {d for d, _ in page[2:]} == {1, 2}
    lists = ([1, 9, 20], [4, 10], [12, 2])
    row = spark.range(1).select(search.tightest_window([F.array(*map(F.lit, x)) for x in lists]).alias("w")).first()["w"]
    best = min((max(c) - min(c), min(c), max(c)) for c in itertools.product(*lists))
    assert tuple(row) == best


def test_places_and_sums_over_whole_tables(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), round(rng.choice([rng.random(), 0.5, 3.0]), 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(7)
    assert [(r["id"], r["place"]) for r in ranking.placed(df, "id").orderBy("id").collect()] == [(k, k) for k in range(500)]
    sums = {r["id"]: r["s"] for r in ranking.running_sum(df, "id", "id", "s", block=30).collect()}
    assert sums == {k: k * (k + 1) // 2 for k in range(500)}
    got = {r["k"]: (r["p"], r["q"]) for r in ranking.values_at(df, "k", "v", {"p": 0.5, "q": 0.95}, bins=8).collect()}
    for key in "ab":
        held = sorted(v for _, k, v in rows if k == key)
        assert got[key] == tuple(held[int(f * (len(held) - 1) + 0.5)] for f in (0.5, 0.95))
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    assert ranking.values_at(two, "k", "v", {"p": 0.5}).first()["p"] == 2.0


def test_words_within_edits(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)})

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    left = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r["a"], r["b"], r["distance"]) for r in suggest.within_edits(left, left.withColumnRenamed("a", "b"), 2).collect()}
    assert got == {(a, b, distance(a, b)) for a in words for b in words if distance(a, b) <= 2}


def test_deletions_are_not_broadcast(spark):
    """A vocabulary's deletions outgrow what Spark takes them for, and a query's few words need none."""
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 8))) for _ in range(150)})
    right = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "b string, popularity long")
    left = right.select(F.col("b").alias("a")).limit(20)
    many, few = suggest.within_edits(left, right, 2), suggest.within_edits(left, right, 2, few=True)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    plan = suggest.within_edits(left, right, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    offers = suggest.did_you_mean(left.select(F.col("a").alias("word")).union(spark.sql("SELECT 'abcdz'")), right.withColumnRenamed("b", "term"))
    assert "Generate" not in offers._jdf.queryExecution().executedPlan().toString()
    assert [r["word"] for r in offers.collect()] in ([], ["abcdz"])


def test_typing_costs():
    assert words.typing_cost("tesy", "test") == 0.4 and words.typing_cost("tesst", "test") == 0.4 and words.typing_cost("tset", "test") == 0.4
    assert words.typing_cost("test", "test") == 0.0 and words.typing_cost("tes", "test") == 1.0 and words.typing_cost("pest", "test") == 1.0

    def least(a, b):
        """Every way, by recursion."""
        if not a or not b:
            return float(len(a) + len(b)) - 0.6 * sum(x == y for x, y in zip(a, a[1:]))
        ways = [least(a[:-1], b) + (0.4 if len(a) > 1 and a[-2] == a[-1] else 1.0), least(a, b[:-1]) + 1.0, least(a[:-1], b[:-1]) + (0.0 if a[-1] == b[-1] else words.slip_price(a[-1], b[-1]))]
        if len(a) > 1 and len(b) > 1 and a[-1] == b[-2] and a[-2] == b[-1]:
            ways.append(least(a[:-2], b[:-2]) + words.slip_price(a[-2], a[-1]))
        return min(ways)

    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("qwas") for _ in range(rng.randint(1, 5))) for _ in range(2))
        if all(x != y for x, y in zip(a, a[1:])):
            assert words.typing_cost(a, b) == pytest.approx(least(a, b))


def test_drafts(spark):
    rng = random.Random(5)
    for _ in range(6):
        left, right = rng.sample(range(12), 8), rng.sample(range(12), 8)
        coin = tuple(rng.random() < 0.5 for _ in range(3))
        shown, teams, k = [], [], 0
        while len(shown) < 10:
            before = len(shown)
            for team in ("left", "right") if coin[k % 3] else ("right", "left"):
                free = [x for x in (left if team == "left" else right) if x not in shown]
                if free and len(shown) < 10:
                    shown.append(free[0])
                    teams.append(team)
            k += 1
            if len(shown) == before:
                break
        lit = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
        got = spark.range(1).select(experiment_queries.team_draft(lit(left), lit(right), coin).alias("d")).first()["d"]
        assert (got["shown"], got["teams"]) == (shown, teams)


def test_values(spark):
    cases = {"2024-03-04": ("iso", 19786), "20240304": ("compact", 19786), "2024/3/4": ("slashed", 19786), "25/12/2023": ("slashed", 19716), "12/25/2023": ("slashed", 19716), "4/3/2024": ("ambiguous", None), "3/3/2024": ("slashed", 19785), "2024-02-31": ("iso", None), "soon": ("unknown", None)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", values.parse_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: (r["d"]["shape"], r["d"]["days"]) for r in rows} == cases
    said = {"10k": 10_000, "1.5 m": 1_500_000, "0.5": None, "k": None, "3 dozen": None, "7": 7, "1.2.3k": None}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", values.parse_quantity(F.col("t"), values.COUNTS).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == said
    row = spark.range(1).select(values.stamp(F.lit(7992739871)).alias("s"), values.verify(F.lit("79927398713")).alias("ok"), values.verify(F.lit("79927398731")).alias("bad")).first()
    assert tuple(row) == ("79927398713", 7992739871, None)


def test_silence_as_a_stateful_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    day = timedelta(days=1)
    for k, rows in enumerate([[(1, start), (2, start)], [(1, start + timedelta(hours=6)), (2, start + timedelta(hours=1))], [(1, start + day)], [(3, start + 3 * day)], [(3, start + 3 * day)]]):
        spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    running = logs.silent_users(stream).writeStream.format("memory").queryName("silent").outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    got = sorted((r["user"], r["beats"]) for r in spark.table("silent").collect())
    assert (2, 2) in got and all(u in (1, 2) for u, _ in got)


def test_late_rows_are_dropped(spark, tmp_path):
    """Beyond the watermark a row comes too late for its window."""
    start = datetime(2024, 1, 1)
    for k, rows in enumerate([[("a", start)], [("a", start + timedelta(days=5))], [("a", start + timedelta(days=9))], [("a", start + timedelta(hours=1))], [("a", start + timedelta(days=20))]]):
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    running = logs.trending(stream, "k", watermark="1 day").writeStream.format("memory").queryName("late").outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    assert {r["n"] for r in spark.table("late").collect()} == {1}


def test_sessions_as_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, start), (1, start + timedelta(minutes=30)), (1, start + timedelta(minutes=90)), (2, start)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    out = logs.sessions(stream, watermark="1 minute").writeStream.format("memory").queryName("sessions").outputMode("complete")
    running = out.start()
    running.processAllAvailable()
    running.stop()
    batch = logs.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp"))
    assert sorted((r["user"], r["n_events"]) for r in batch.collect()) == [(1, 1), (1, 2), (2, 1)]  # an equal pause goes on
    assert sorted(spark.table("sessions").collect()) == sorted(batch.collect())


def test_every_query_has_columns_and_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", ["bm25_topk", "phrase_match", "facet_buckets", "sessions", "noisy_counts", "hll_registers", "snapshot_diff", "term_stats", "highlight", "snippets", "proximity", "synonym_search", "feed_clean", "bulk_admission", "index_diff", "check_digits", "click_model", "sliding_counts", "ab_split", "percolate"])
def test_oracles(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    want = db.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(str, df.astype(object).values.tolist()))
    assert [[float(v) if isinstance(v, (int, float)) else str(v) for v in r] for r in sorted(got.astype(object).values.tolist(), key=str)] == [
        [float(v) if isinstance(v, (int, float)) else str(v) for v in r] for r in sorted(want.astype(object).values.tolist(), key=str)
    ] or key(got) == key(want)


def _shuffled_keys(df):
    """What the exchanges of a plan deal rows out by."""
    return re.findall(r"hashpartitioning\(([^,]*)", df._jdf.queryExecution().executedPlan().toString())


def test_similar_pairs_analyse_texts_once(spark):
    """The texts are scanned once to find the shingles that they share, also by clusters."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "b c d e f g h")], "doc_id long, text string")
    plans = []
    cut, graph._cut = graph._cut, lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df)
    try:
        assert graph.similar_pairs(docs, T.analyzed_terms(F.col("text")), threshold=0.4).count() == 1
    finally:
        graph._cut = cut
    assert plans[0].count("LogicalRDD") == 1


def test_similar_pairs_leave_no_sets_behind(spark, monkeypatch):
    """Shingles are counted in rounds, and what only one step reads is gone after it."""
    cut, frames = graph._cut, []
    monkeypatch.setattr(graph, "_cut", lambda df: frames.append(cut(df)) or frames[-1])
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdef") + "x" for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = graph._prefixes(docs, T.analyzed_terms(F.col("text")), "doc_id", 0.5, 2)
    assert len(frames) == graph.ROUNDS + 2 and keyed.count() > 0
    assert [os.path.exists(graph._cut_path(f).removeprefix("file:")) for f in frames] == [False] * (graph.ROUNDS + 1) + [True]


def test_least_hashes_stay_in_the_rows_task(spark, monkeypatch):
    """Only one row a group is shuffled, and what a task remembers doesn't change the hashes."""
    rng = random.Random(5)
    rows = [(k // 2, [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 30))]) for k in range(300)] + [(None, ["ä", "b"]), (None, ["c"]), (900, None)]
    members = spark.createDataFrame(rows, "g long, m array<string>")
    want = {}
    for g, m in rows:
        for t in m or []:
            hashes = [int(hashlib.sha256(f"{s}|{t}".encode()).hexdigest()[:16], 16) - (1 << 63) for s in range(4)]
            want[g] = list(map(min, want.get(g, hashes), hashes))
    for room in (sketches.KEPT_MEMBERS, 50):
        monkeypatch.setattr(sketches, "KEPT_MEMBERS", room)
        signs = sketches.least_hashes(members, "g", "m", width=4)
        assert _shuffled_keys(signs) == ["g#" + _shuffled_keys(signs)[0].split("#")[1]]
        assert {r["g"]: list(r)[1:] for r in signs.collect()} == want


def test_compounds_of_words_with_many_splits(spark):
    """A word of 60 letters with some hundred million splits into parts that the vocabulary holds; ties go to the longer first part."""
    vocabulary = ["aaa", "aaaa", "aaaaa", "abc", "abcdef", "def", "ghi", "defghi"]
    rows = ["a" * 59 + "b", "a" * 60, "abcdefghi", "abcxx", "ghidefx", "ab", "aaa"]
    known, asked = spark.createDataFrame([(v,) for v in vocabulary], "term string"), spark.createDataFrame([(w,) for w in rows], "word string")
    got = {r["word"]: r["parts"] for r in words.compounds(asked, known).collect()}
    assert got == {"a" * 60: ["aaaaa"] * 12, "abcdefghi": ["abcdef", "ghi"]}


def test_compound_words_of_any_length(spark, tmp_path):
    """Rare words are split however short or long they are, as the SQL does; a word of 20,000 letters is no burden."""
    often = " ".join(["sun", "light", "flower", "garden"])
    texts = [often] * 10 + ["sunsun sunflower sunflowergarden sunlightflowergarden sunx", "sun" + "q" * 20_000, "flowersunlightgardensunlightgarden"]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.queries()["compound_words"](spark, str(tmp_path)).collect()}
    assert got == set(db.sql(catalog.oracle_sql()["compound_words"]).fetchall())
    assert {w for w, _ in got} == {"sunsun", "sunflower", "sunflowergarden", "sunlightflowergarden", "flowersunlightgardensunlightgarden"}


def test_vocabulary_counts_as_the_index_does(spark, index):
    rows = [*TEXTS, (1, "cat tree mat", None), (None, "cat", None), (None, "cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {(r["term"], r["df"]) for r in build_index(docs, {"text": F.col("text")}).term_stats().collect()}
    assert {(r["term"], r["df"]) for r in vocabulary(distinct_postings(docs, F.col("text"))).collect()} == want


def test_neighbours_parts_grow_with_the_postings(spark, monkeypatch):
    """A task's share of the join by document doesn't depend on the session's number of parts."""
    monkeypatch.setattr(graph, "PART_POSTINGS", 8)
    posts = spark.createDataFrame([(f"t{k % 7}", k // 5) for k in range(200)], "term string, doc_id long").distinct()
    stats, seeds = vocabulary(posts), spark.createDataFrame([("t1",), ("t4",)], "term string")
    near = graph.neighbours(seeds, posts, stats)
    assert re.search(rf"hashpartitioning\(doc_id#\d+L, {-(-posts.count() // 8)}\)", near._jdf.queryExecution().executedPlan().toString())
    held = {t: {r["doc_id"] for r in posts.where(F.col("term") == t).collect()} for t in (f"t{k}" for k in range(7))}
    want = {(a, b, round(len(held[a] & held[b]) / len(held[a] | held[b]), 4)) for a in ("t1", "t4") for b in held if a != b and len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.25}
    assert {tuple(r) for r in near.collect()} == want
