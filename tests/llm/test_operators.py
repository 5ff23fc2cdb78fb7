"""Each operator on small tables: against brute force, and on odd rows, ties and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bwt, crf, decontamination, html_text, packing, pii, quality_rules, secret_scan, sharding, simhash, suffix_dedup, tokens, toxicity
from tessera.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, shard int, row long"
LONG = " ".join(f"word{k}" for k in range(30_000))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    texts = [None, "", " \n\t", LONG, "same text here, twice.", "same text here, twice.", "é ß 中文 ‮", "a", "#### $$ || <b>", "x" * 5000]
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), True, 1.0, 7, k) for k, t in enumerate(texts)]
    return rows + [rows[4], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(8)] + [(3, None), (None, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, None), (1, ""), (2, "word5 word6 word7 word8 word9 word10 word11"), (2, "word5 word6 word7 word8 word9 word10 word11")], "item_id long, text string")


def test_quality_rules(spark, odd, none):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(odd_rows()) and all(r["base_failed"] for r in got if r["n_words"] < 50)
    assert quality_rules.quality_rules(none).count() == 0
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd ef #g |".split()) + rng.choice(["", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.quality_rules(docs).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))


def test_hosts_decide(spark):
    """The same text goes on a host that fails often and stays on others; clean texts stay on either."""
    clean = " ".join(f"clean{k}" for k in range(80))
    junk = " ".join(f"## junk{k}" for k in range(80))
    soft = " ".join(["#"] * 6 + [f"mostly{k}" for k in range(80)])
    rows = [(k, junk, "bad") for k in range(50)] + [(100, soft, "bad"), (101, clean, "bad"), (102, soft, "good"), (103, soft, "small"), (104, clean, "small")] + [(200 + k, clean, "good") for k in range(50)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    kept = {k: r["kept"] for k, r in got.items()}
    assert not kept[0] and not kept[100] and kept[101] and kept[102] and kept[200]
    assert got[0]["host_rejected"] and not got[200]["host_rejected"]
    # A host of two documents, one of them failed, stays near the corpus.
    assert got[102]["shrunk_rate"] < got[103]["shrunk_rate"] < got[100]["shrunk_rate"] and not got[103]["host_rejected"]


def test_repeats_by_whole_hashes(spark):
    """A window that sorts between two equal ones by part of its hash doesn't hide them."""
    words = [f"w{k}" for k in range(3000)]
    rng = random.Random(9)
    many = [rng.choice(words) for _ in range(60_000)]
    text = " ".join(many + ["a1 b1 c1 x y z", "a1 b1 c1"])
    grams = Counter(zip(text.split(), text.split()[1:], text.split()[2:]))
    found = text.split()
    hit = {k + j for k in range(len(found) - 2) if grams[tuple(found[k : k + 3])] > 1 for j in range(3)}
    row = quality_rules.quality_rules(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).first()
    assert row["n_repeat_words"] == len(hit)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(5, 5), (1, 2), (2, 1)]
    label = {k: k for e in edges for k in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert all(label[r["node"]] == r["root"] for r in got)
    assert {r["node"] for r in got} == {k for k in label if label[k] != k}


def test_simhash(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows()) and {r["fingerprint"] for r in got if r["doc_id"] in (0, 1, 2)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(none).count() == 0
    for r in got:
        text = {k: t for k, t, *_ in odd_rows()}[r["doc_id"]] if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
            hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
            bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
            assert r["fingerprint"] == f"{bits:016x}"
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    prints = np.concatenate([prints, prints[:80] ^ np.uint64(5), prints[:40] ^ np.uint64(4 << 40)])
    rows = [(k, int(v), int(v), k) for k, v in enumerate(prints.view(np.int64))]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, lane0 long, x long, least long"), 1, 2, 4, 1, None, tile_rows=16)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]) <= 2]
    find = lambda k: roots.get(k, k)
    assert pairs and all(find(i) == find(j) for i, j in pairs) and len(roots) <= 2 * len(pairs)


def test_toxicity(spark, odd, none, labels):
    assert toxicity.score_toxicity(none, labels).count() == 0
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, marks = odd_rows(), []
    for k in range(20, 420):
        bad = k % 4 == 0
        rows.append((k, " ".join([word() for _ in range(30)] + (["zurgle" + word()] * 4 if bad else [])), "en", "s", 1, None, None, None, None))
        marks.append((k, int(bad)))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int"), trees=5).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] and r["doc_id"] >= 20 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(r["held_out"] for r in held)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.9
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.where("toxic = 0")).collect()} == {0.0}


def test_secret_scan(spark, odd, none):
    assert len(secret_scan.secret_scan(odd).collect()) == len(odd_rows()) and secret_scan.secret_scan(none).count() == 0
    texts = ["x  host=db.example.com AKIAABCDEFGH12 and aZ09aZ09aZ09aZ09aZ09bb ok", "aZ09aZ09aZ09aZ09aZ09bb alone", "é password: abcdefgh token=xyz", "0" * 40 + " AKIA" + "A" * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.secret_scan(docs).collect()}
    assert [k for k, *_ in got[0]] == ["endpoint", "weak_id", "weak_secret"] and got[1] == []
    assert got[2] == [("assign", 2, 20)] and [k for k, *_ in got[3]] == ["hex", "access"]


def test_links_reach_exactly_the_scope(spark):
    secret, ident = "aZ09aZ09aZ09aZ09aZ09bb", "AKIAABCDEFGH"
    gap = lambda n: ident + " " * (n - len(ident)) + secret
    docs = spark.createDataFrame([(0, gap(400)), (1, gap(401)), (2, " " * 399 + gap(400))], "doc_id long, text string")
    got = {r["doc_id"]: len(r["spans"]) for r in secret_scan.secret_scan(docs, scope=400).collect()}
    assert got == {0: 2, 1: 0, 2: 2}


def test_decontamination(spark, odd, none, items):
    got = decontamination.contamination(odd, items).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(3, 2, 0)} and len(got) == 2
    short = spark.createDataFrame([(7, "Word7, word8!"), (8, "ord9 w"), (9, "--")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(odd, short).collect()} == {(3, 7)}
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.limit(0)).count() == 0
    text = "the quick brown fox jumps over the lazy dog and then it sleeps for a while"
    blocks = list(decontamination.blocks_of(spark.createDataFrame([(k, text) for k in range(50)], "item_id long, text string"), "item_id", "text", 900))
    assert len(blocks) > 1 and sorted(i for b in blocks for i, _ in b) == list(range(50))


def test_myers_and_pieces_match_brute_force():
    rng = random.Random(1)

    def least(p, t):
        before = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            now = [i]
            for j, d in enumerate(t, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
            before = now
        return min(before)

    word = lambda n: "".join(rng.choice("abcde fg") for _ in range(n))
    items = [(k, decontamination.reduced(word(n))) for k, n in enumerate((90, 90, 70, 90, 16, 20, 30))]
    items = [(k, t) for k, t in items if len(t) >= 13]
    matcher = decontamination.Matcher(items, 0.08)
    for _ in range(150):
        s = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(s))
            s[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "y"])
        text = decontamination.reduced(word(20) + "".join(s) + word(20))
        found = matcher.find(text)
        for k, (_, item) in enumerate(items):
            d = least(item, text)
            assert (k in found) == (d <= int(0.08 * len(item))) and (k not in found or found[k][0] == d)


def test_sharding(spark, odd, none):
    got = sharding.shard_documents(odd, shards=4).collect()
    assert len(got) == len(odd_rows()) and sharding.shard_documents(none).count() == 0
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    rows = [(k, "x" * (10 + k % 50), "en", "s") for k in range(3000)] + [(5000 + k, "hot " * 10, "en", "s") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = Counter()
    for r in sharding.shard_documents(docs).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) < 1.02 * sum(sizes.values()) / 16


def test_equal_texts_share_a_shard(spark):
    """Small groups of equal texts stay whole, one that fills several shards is cut; sizes, checksums and slots are right."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 300))) for _ in range(900)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts + [t for t in texts[:300] for _ in range(2)] + ["hot " * 50] * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in sharding.shard_documents(docs, shards=8).collect()}
    where, bytes_in = {}, Counter()
    for k, text, *_ in rows:
        r = got[k]
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        where.setdefault(text, set()).add(r["shard"])
        bytes_in[r["shard"]] += r["size"]
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("hot")) and len(where["hot " * 50]) > 1
    assert max(bytes_in.values()) < 1.06 * sum(bytes_in.values()) / 8


def test_merged_transforms_match_plain_search():
    rng = random.Random(2)
    for _ in range(60):
        width, n = rng.randint(6, 14), rng.randint(1, 60)
        depth = rng.randint(2, width)
        rows = np.array([[rng.choice(b"abc") for _ in range(width)] for _ in range(n)], np.uint8)
        for row in rows:
            row[: rng.choice([0, 0, 1, 2])] = row[width - rng.choice([0, 0, 1, 2]) :] = bwt.END
        least = np.array([rng.randint(0, 9) for _ in range(n)])
        cuts = sorted(rng.sample(range(1, n + 1), rng.randint(0, min(4, n))))
        got = bwt.merged_repeats([bwt.transform(part, np.zeros(len(part), np.int64)) for part in np.split(rows, cuts)], least, depth)
        for i in range(n):
            for c in range(width - depth + 1):
                window = rows[i, c : c + depth]
                lesser = any((rows[j, c : c + depth] == window).all() and least[j] < least[i] for j in range(n))
                assert bool(int(got[i]) >> c & 1) == (lesser and bool((window != bwt.END).all()))


def _deduped(rows, depth=50):
    """Counts and digests by every window of every text."""
    last, first, out = 1 << 63, {}, []
    rows = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in rows:
        for a in range(len(raw) - depth + 1):
            first[raw[a : a + depth]] = min(i, first.get(raw[a : a + depth], last))
    for i, raw in rows:
        gone = {a + j for a in range(len(raw) - depth + 1) if first[raw[a : a + depth]] < i for j in range(depth)}
        kept = bytes(b for a, b in enumerate(raw) if a not in gone)
        out.append((i, len(raw), len(gone), sum(a - 1 not in gone for a in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup(spark, odd, none, hot):
    assert len(suffix_dedup.suffix_dedup(odd, hot=hot).collect()) == len(odd_rows()) and suffix_dedup.suffix_dedup(none).count() == 0
    rng = random.Random(8)
    line = "this is a line that stands in every document of the lot, and some more"
    parts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 90))) for _ in range(10)]
    one = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice([None, *range(60)]), one() + line) for _ in range(80)]  # ids are shared by different texts, or null
    rows += [(200, "ab" * 60), (201, "x" + "ab" * 60), (202, None), (203, ""), (None, None), *rows[:5], *((300 + k, rows[0][1]) for k in range(10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.suffix_dedup(docs, shard_bytes=2000, bucket_bytes=3000, hot=hot).collect()
    last = 1 << 63
    assert sorted((last if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _deduped(rows)


@pytest.mark.parametrize("often", [0, 1, 1 << 20])
def test_merged_buckets_are_bounded_by_their_strings(spark, monkeypatch, often):
    """A bucket's strings are merged some at a time however much of the texts repeats, and few windows of anchors that many shards seldom hold are spelled out."""
    monkeypatch.setattr(suffix_dedup, "MERGED", 4000)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    sizes, merge = [], suffix_dedup.merged_buckets

    def merged(transforms, depth):
        sizes.extend(r["n"] for r in transforms.groupBy("bucket").agg(F.sum(F.length("strings")).alias("n")).collect())
        return merge(transforms, depth)

    monkeypatch.setattr(suffix_dedup, "merged_buckets", merged)
    rng = random.Random(9)
    lot = ["".join(rng.choice("abcdefgh ") for _ in range(100)) for _ in range(30)]
    rows = [(k, "".join(rng.sample(lot, 5))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_dedup.suffix_dedup(docs, shard_bytes=2000, hot=4).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _deduped(rows)
    assert len(sizes) > 16 and max(sizes) < 4 * 4000


def test_hot_strings_are_spelled_out_once():
    """A passage that a shard holds a thousand times costs as many occurrences as it has, not one a window each."""
    passage = b"".join(bytes([97 + (k * k + 3 * k) % 23]) for k in range(120))
    held, ends = np.frombuffer(passage * 1000, np.uint8), np.arange(1001) * 120
    hashes = np.unique(suffix_dedup.anchored_runs(held, ends, 50)[0])
    bucket, rest = suffix_dedup._bucketed(hashes, 4)
    shared = np.unique(bucket.astype(np.uint64) << np.uint64(32) | rest)
    size = {}
    for hot in (False, True):
        _, _, _, found, packed = suffix_dedup.shard_strings(held, ends, np.arange(1000), shared, np.full(len(shared), hot), 50, 4)
        size[hot] = len(found)
        assert int(packed[0].sum()) <= (2000 if hot else 0)  # of 71000 windows; blocks cut some runs in two
    assert size[True] == size[False]


def test_viterbi_with_certain_tokens_is_viterbi():
    model = pii.trained()
    for words, _ in pii.labelled_lines(150, 21):
        ids = np.array([model.number(pii.word_features(w)) for w in words])
        ends = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        ends[0][0] = ends[1][-1] = True
        plain = crf.viterbi([model.emissions(ids, *ends)], model.transitions)[0]
        assert model.decode(ids, np.array([len(ids)])).tolist() == plain.tolist()


def test_pii(odd, none):
    assert pii.find_spans(odd).count() == len(odd_rows()) and pii.find_spans(none).count() == 0
    assert pii.mask_documents(odd).schema == odd.schema
    model = pii.trained()
    hits = wrong = missed = 0
    for words, tags in pii.labelled_lines(300, 99):
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        got = {(k, pii.KINDS[r]) for a, r, b in pii.field_spans([" ".join(words)], model, pii._Numbers(model)).get(0, []) for k, s in enumerate(starts) if a <= s < b}
        want = {(k, t) for k, t in enumerate(tags) if t != "O"}
        hits, wrong, missed = hits + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.95


# Sentences that no template makes, with what they hold.
WRITTEN = [
    ("Please ask Dr. Helen Moreau about the results.", {("name", "Helen Moreau")}),
    ("Our contact: Jonas Whitfield, second floor.", {("name", "Jonas Whitfield")}),
    ("Frau Ilse Brandt wohnt hier seit Jahren.", {("name", "Ilse Brandt")}),
    ("You can reach us by phone 415-555-0132 after noon.", {("local_phone", "415-555-0132")}),
    ("Call (212) 555-0187 for the front desk.", {("local_phone", "(212) 555-0187")}),
    ("tel 030.555.0199 is the office line", {("local_phone", "030.555.0199")}),
    ("His SSN 078-05-1120 was on the form.", {("id_number", "078-05-1120")}),
    ("passport X4512890 expired last year", {("id_number", "X4512890")}),
    ("write to helen (at) example (dot) org for details", {("spelled_email", "helen (at) example (dot) org")}),
    ("or mail jonas [at] widgets [dot] net today", {("spelled_email", "jonas [at] widgets [dot] net")}),
    ("They moved to 221 Baker Street last May.", {("address", "221 Baker Street")}),
    ("Visit 18 Harbor Road, near the port.", {("address", "18 Harbor Road")}),
    ("Mrs. O'Brien signed it.", {("name", "O'Brien")}),
    ("Monsieur Lefèvre et Madame Roux sont venus.", {("name", "Lefèvre"), ("name", "Roux")}),
    ("Deliver to 7 Elm Avenue before ten.", {("address", "7 Elm Avenue")}),
    ("In 2024 the price rose 12 percent to 1,250 dollars.", set()),
    ("Version 2.0.1 of the tool was released on 2024-03-04 at 10:30.", set()),
    ("See chapter 12, page 345, and figure 6.", set()),
    ("A dot at the end; look at the dot on the map.", set()),
    ("The street was empty and the road was long.", set()),
]


def test_field_on_written_sentences():
    model = pii.trained()
    wrong = missed = 0
    for text, want in WRITTEN:
        got = {(pii.KINDS[r], text[a:b]) for a, r, b in pii.field_spans([text], model, pii._Numbers(model)).get(0, [])}
        wrong, missed = wrong + len(got - want), missed + len(want - got)
    assert wrong <= 1 and missed <= 1


def test_masks_on_odd_rows(odd):
    rows = sorted(map(str, odd.collect()))
    assert sorted(map(str, pii.mask_documents(odd).collect())) == rows  # nothing to mask in them
    marked = odd.limit(1).selectExpr("* except (text)", "'mail a@b.cd now' as text").select(odd.columns)
    assert pii.mask_documents(marked).first()["text"] == "mail <EMAIL> now"


def test_base_secret_spans_match_plain_patterns(spark):
    """Random mixtures of parts of secrets: the base spans are those of the patterns, leftmost and without overlap."""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    plain = (("assign", assign, lambda m: len(m[2]) >= 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32))
    rng = random.Random(13)
    parts = ["password", "PassWd", "api_key", "apikey", "token", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6", "0" * 31, "deadbeef" * 4, "é", "\ue000", "abcdefgh", "short", "\n", "+/_.=-", "😀"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [k for k, *_ in plain]
    for r in secret_scan.secret_scan(docs).collect():
        text = texts[r["doc_id"]] or ""
        want = sorted((m.start(), kinds.index(k), k, m.end()) for k, pattern, fits in plain for m in pattern.finditer(text) if fits(m))
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] in kinds] == want, text


def test_planted_credentials_are_linked(spark):
    """Parts of one credential in prose: all are found near each other, none alone."""
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        ident, secret, host = "AKIA" + "".join(rng.choice("ABCDEF234567") for _ in range(8)), "aB3" + "".join(rng.choice("abcdefABCDEF0123456789") for _ in range(21)), f"host=db{k}.example.com"
        held = [(ident, secret), (ident, secret, host), (secret,), (ident,), (host, ident)][k % 5]
        rows.append((k, " ".join(x for part in held for x in (prose(12), part)) + " " + prose(12)))
        want[k] = {"weak_id": 1, "weak_secret": 1, "endpoint": int(host in held)} if k % 5 < 2 else {"weak_id": 0, "weak_secret": 0, "endpoint": 0}
    for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = Counter(s["kind"] for s in r["spans"])
        assert {k: found[k] for k in ("weak_id", "weak_secret", "endpoint")} == want[r["doc_id"]], rows[r["doc_id"]]


def test_base_pii_spans():
    kinds = lambda t: [(pii.KINDS[r], t[a:b]) for a, r, b in pii.base_spans(t)]
    assert kinds("a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1") == [("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8")]
    assert kinds("4111 1111 1111 1111 +1 (974) 555-3436") == [("card", "4111 1111 1111 1111"), ("phone", "+1 (974) 555-3436")]
    assert pii.masked("mail a@b.cd now", pii.base_spans("mail a@b.cd now")) == "mail <EMAIL> now"


def test_tokens_match_the_tokenizer():
    known = tokens.WordTokens(tokens.default_path())
    rng = random.Random(3)
    pool = "abcdefghijklmnopqrstuvwxyzABCZéèüßñÉçœŒſŞıªºµǅŉΩж中ðþ´`'’.,!?;:-0123456789<|>“”éİΣς"
    for k in range(3000):
        word = "".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))
        assert known[word.encode()] == known.whole(word)
    for text in ["it's  don't\n'll", "<|endoftext|> x", "á ́b", "x\x0by\x1fz", "ΑΣ ΑΣ. İ"]:
        assert known.encode(text) == known.whole(text)


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    known = tokens.word_tokens(tokens.default_path())
    want = Counter()
    for i, text, *_ in odd_rows():
        want[i] += len(known.encode(text)) // 4 + 1
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want and packing.pack(none).count() == 0
    whole = {r["sequence_id"]: 0 for r in rows}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == whole[r["sequence_id"]]
        whole[r["sequence_id"]] += r["length"]
    assert max(whole.values()) <= 4096 and sum(v < 4096 for v in whole.values()) <= 1


def test_neighbours_share_terms():
    texts = [np.array(x) for x in ([1, 2, 3, 9], [7, 8, 9], [1, 2, 3, 4, 9], [5, 6, 9])]
    index = packing.ShardIndex(texts, 16, np.ones(10), 3.5)
    assert index.neighbours(0, np.array([False, True, True, True]))[0] == 2
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(60)]
    held = np.array([sum(t in x for x in texts) for t in range(40)])
    idf, mean = np.log1p((60 - held + 0.5) / (held + 0.5)), np.mean([len(t) for t in texts])
    index, unused = packing.ShardIndex(texts, 99, idf, mean), rng.random(60) < 0.7
    for seed in range(60):
        score = np.zeros(60)
        for k, x in enumerate(texts):
            for t in np.unique(texts[seed]):
                tf = (x == t).sum()
                score[k] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        got = index.neighbours(seed, unused)
        assert set(got) == set(np.nonzero((score > 0) & unused)[0])
        assert np.all(np.diff(np.round(score[got], 9)) <= 0)


def test_alike_documents_meet_in_a_window(spark):
    """Copies with edits among many others share a sequence, though shards hold a small part of the corpus."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    groups = []
    for k in range(150):
        base = [rng.choice(words) for _ in range(60)]
        copies = [[w if rng.random() > 0.05 else rng.choice(words) for w in base] for _ in range(4)]
        groups += [(k, " ".join(c)) for c in copies]
    rng.shuffle(groups)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(groups)], "doc_id long, text string").repartition(6)
    at = {r["doc_id"]: r["sequence_id"] for r in packing.pack(docs, window=2048, shard_tokens=1 << 14).collect() if r["start"] == 0}
    together = sum(at[i] == at[j] for i in range(600) for j in range(i) if groups[i][0] == groups[j][0])
    assert together > 0.5 * 900


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for _ in range(40):
        emissions, transitions = rng.normal(size=(int(rng.integers(1, 5)), 3)), rng.normal(size=(3, 3))
        paths = itertools.product(range(3), repeat=len(emissions))
        best = max(paths, key=lambda p: sum(emissions[t, y] for t, y in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:])))
        assert crf.viterbi([emissions], transitions)[0].tolist() == list(best)


def test_words_are_read_whole():
    a, b = "1" * 70 + "x@", "1" * 70 + "x#"
    assert pii.word_features(a) != pii.word_features(b)


def test_html_attributes_may_hold_brackets(spark):
    pages = ['<p title="1 < 2 > 0">hello</p>', "<p title='a<b>c' class=x>hello</p>", '<p title="stray>hello</p>', '<a href="x>hello</a>', "<div>" * 70 + "<article><p>hello</p></article>"]
    assert [[t for t, *_ in html_text.leaf_blocks(p)] for p in pages] == [["hello"]] * 5
    rows = [(k, "u", "<article><p>A plain text of some words, as articles have.</p></article>" if k else "<div>" * depth + "<article><p>A plain text of some words, as articles have.</p></article>", 7) for k, depth in ((0, 70), (1, 0), (0, 5000))]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert {r["text"] for r in got} == {"A plain text of some words, as articles have."} and len(got) == 3
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html(spark):
    model = html_text.trained()
    right = total = 0
    for page in html_text.labelled_pages(80, 5):
        features, tags = html_text.labelled_blocks(page)
        if features:
            got = model.decode(np.array([model.number(f) for f in features]), np.array([len(features)]))
            right += sum(html_text.LABELS[g] == t for g, t in zip(got, tags))
            total += len(tags)
    assert right / total > 0.97
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp;  B</h1>'
        "<p>First <b>bold<br>text here.<p>Second &lt;one&gt; is a longer paragraph of text.</p></article><footer>&copy; x</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <!-- comment"), (4, "u", "<p>unclosed <!-- comment")]
    got = {r["page_id"]: r for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\n\nFirst bold text here.\n\nSecond <one> is a longer paragraph of text."
    assert got[2]["text"] == "" == got[3]["text"] and got[1]["n_chars"] == len(got[1]["text"])
