"""The corpus pipeline stage by stage and as a whole, on a small corpus with planted cases."""

import random

import corpus_pipeline
from attesta.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = {"en": [f"the{i}" for i in range(80)] + ["the", "of", "and"] * 20, "fr": [f"le{i}é" for i in range(80)] + ["le", "de", "et"] * 20}
    passage = [f"p{i}" for i in range(60)]
    item = [f"bench{i}" for i in range(20)]
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        words = [rng.choice(word[lang]) for _ in range(rng.randrange(60, 140))]
        if i in (3, 5, 8):
            words[10:10] = passage
        if i in (20, 21):
            words[5:5] = item[:9] + ["changed"] + item[10:]
        rows.append([i, " ".join(words), lang if i % 10 else None, f"s{i % 4}", 0])
    near = rows[40][1].split()
    near[7] = "other"
    rows += [[200, rows[40][1], "en", "s1", 0], [201, " ".join(near), "en", "s1", 0], [202, None, "en", "s1", 0], [203, "12 34", "en", None, 0],
             [204, "", None, None, 0]]
    return [(*r[:4], len(r[1] or "")) for r in rows], " ".join(item)


def test_stages(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    every = {r[0] for r in rows}
    assert set(seen["language"]) == every - {202, 203, 204} and all(r.lang in ("en", "fr") for r in seen["language"].values())
    assert set(seen["near duplicates"]) == set(seen["language"]) - {200, 201}
    assert set(seen["repeats"]) == set(seen["near duplicates"])
    for i, r in seen["repeats"].items():
        assert ("p30" in r.text) is False and r.n_chars == len(r.text)
        if i not in (3, 5, 8, 20, 21):
            assert r.text == rows[i][1]
    assert set(seen["decontamination"]) == set(seen["repeats"]) - {20, 21}
    mixed = seen["mixing"]
    kept = spark.read.parquet(str(tmp_path / f"stage{len(corpus_pipeline.STAGES) - 2}"))
    taken = {r.doc_id: r.copies for r in mixing.copies(kept).withColumnRenamed("id", "doc_id").collect()}
    assert set(taken) == set(seen["decontamination"]) and all(r.taken == r.copies * r.size for r in mixed.values())
    assert {i: r.copies for i, r in mixed.items()} == {i: n for i, n in taken.items() if n > 0}
    whole = {r.doc_id: r.copies for r in queries.QUERIES["pipeline"](spark, str(tmp_path)).collect()}
    assert whole == {i: r.copies for i, r in mixed.items()}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
