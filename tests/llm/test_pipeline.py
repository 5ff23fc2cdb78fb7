"""The pipeline's stages: their decisions take effect and clean documents stay."""

import random

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    clean = [_text(rng) for _ in range(20)]
    item = _text(rng, 30)
    near = clean[0].split()
    near[7] = "changed"
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100, clean[1]), (101, " ".join(near)), (102, "## junk " * 80), (103, clean[2] + " " + item.upper() + " " + clean[3]), (104, _text(rng) + " write to jane@example.org today"), (None, _text(rng)), (105, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r["doc_id"] for r in docs.collect()}
    every = set(range(20))
    assert ids["quality_rules"] == every | {100, 101, 103, 104, None}
    assert ids["simhash_near_dedup"] == every | {103, 104, None}
    assert ids["benchmark_decontamination"] == every | {104, None}
    masked = {r["doc_id"]: r for r in docs.collect()}
    assert "<EMAIL>" in masked[104]["text"] and masked[104]["n_chars"] == len(masked[104]["text"])
    assert all(masked[k]["text"] == clean[k] for k in every)
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids["pii"]
    assert P.run and len(P.STAGES) == 5
