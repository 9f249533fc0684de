"""The stages of the pipeline on a small folder of tables, against brute force on its own input."""

import random
import re

import corpus_pipeline


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    r = random.Random(8)
    words = ["".join(r.choices(["ba", "no", "ti", "re", "lu", "ka", "mi"], k=r.randint(1, 4))) for _ in range(600)]
    text = lambda k: " ".join(r.choices(words, k=k))
    clean = [(i, text(60), "en", f"s{i % 3}", 0) for i in range(240)]
    toxic = [(1000 + i, text(30) + " zorgish zorging zorged " + text(9), "en", "s0", 0) for i in range(80)]
    copies = [(2000 + i, clean[i][1].replace(" ", "  "), "en", "s1", 0) for i in range(10)]
    near = [(3000 + i, clean[20 + i][1] + " tail", "en", "s2", 0) for i in range(10)]
    items = [(i, text(30)) for i in range(3)]
    leaks = [(4000 + i, text(20) + " " + items[i][1], "en", "s1", 0) for i in range(3)]
    docs = spark.createDataFrame(clean + toxic + copies + near + leaks, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(d[0], 1, int(d[0] >= 1000)) for d in clean + toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len({d[0] for d in clean} - got) <= 4 and len(got & {d[0] for d in toxic}) <= 4
    assert not got & {d[0] for d in copies + near + leaks}


def write(spark, folder, docs, items=(), labels=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank string"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_every_stage_on_nulls_repeats_and_an_empty_table(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [
        (1, None, None, None, None, None), (2, "", "en", "a", 0, "x"), (None, "alone here", "en", None, 1, "x"), (3, "same text of five words", None, "a", 1, "y"),
        (3, "same text of five words", None, "a", 1, "y"), (3, "other text", "en", "a", 2, "z"), (4, long, "en", "b", 5, None), (5, long + " end", "en", "b", 5, None),
    ]
    read = write(spark, tmp_path, docs)
    want = {  # rows that each stage keeps of the table itself
        "toxicity": 8, "exact_dedup": 7, "near_dedup": 7, "decontaminate": 8,
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, read, str(tmp_path))
        if name != "mix":
            assert got.columns == read.columns and got.count() == want[name], name
        else:
            assert got.count() == len(docs)
        assert stage(spark, read.limit(0), str(tmp_path)).collect() == [], name
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, None, 3, 4}


def test_stages_are_what_brute_force_keeps(spark, tmp_path):
    from tests.llm.test_dedup import brute_near, corpus

    texts = corpus(21, 40)
    read = write(spark, tmp_path, [(i, t, "en", f"s{i % 3}", 0, "x") for i, t in enumerate(texts)], items=[(1, "no such words anywhere in these documents at all")])
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    kept = sorted(first.values())
    near = brute_near([(i, texts[i]) for i in kept])
    want = {i for i in kept if near[i][2]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == want and len(got) == len(want)
    assert len({(x.slot, x.pos) for x in got}) == len(got) and sorted({x.slot for x in got}) == list(range(len({x.slot for x in got})))
    for s in {x.source for x in got}:  # blocks of a source in order, each within one block of its share until a source ends
        assert sorted(x.block for x in got if x.source == s and x.pos == 0) == list(range(sum(x.source == s and x.pos == 0 for x in got)))
