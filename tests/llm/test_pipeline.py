"""The pipeline's chain on planted rows: which documents each stage keeps, and what the last one returns."""

import random

import corpus_pipeline
from demescope.session import scratch_path

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(spark, docs, labels, bench):
    folder = scratch_path(spark, "tables")
    spark.createDataFrame(docs, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_planted_documents_leave_at_their_stage(spark):
    rng = random.Random(6)

    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    item = [f"q{k}" for k in range(40)]
    # With 120 labelled rows toxic ones stayed, so there are 800: the network needs some steps.
    texts = {k: " ".join(prose(60)) for k in range(1000, 1800)}
    toxic = set(range(1400, 1800))
    for k in toxic:
        at = rng.randrange(60)
        texts[k] = " ".join([*prose(at), "vile", "scum", "filth", *prose(60 - at)])
    copied = prose(200)
    texts |= {200: " ".join(copied), 201: " ".join([*copied[:100], "other", *copied[101:]]), 202: " ".join(copied)}
    texts |= {300: " ".join([*prose(30), *item[20:], *prose(30), *item[:20]]), 301: " ".join([*prose(30), *item[:12]])}
    texts |= {400: None, 401: "", 402: "All rights reserved\n" + " ".join(prose(50)), 403: "All rights reserved\n" + " ".join(prose(50))}
    docs = [(k, t, "en", None if k == 400 else "t" if k in (402, 403) else "s", len(t or "")) for k, t in texts.items()]
    folder = written(spark, docs, [(k, 1, int(k in toxic)) for k in range(1000, 1800)], [(1, " ".join(item)), (2, None)])
    left = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder).persist()
        assert left.columns == [f.split()[0] for f in DOC.split(", ")]
        kept.append({r["doc_id"] for r in left.collect()})
    clean = set(texts) - toxic
    assert kept[0] == clean and kept[1] == clean
    assert kept[2] == clean - {201, 202} and kept[3] == clean - {201, 202, 300}
    cut = {r["doc_id"]: r for r in left.collect()}
    assert "reserved" not in cut[402]["text"] + cut[403]["text"] and cut[403]["n_chars"] == len(cut[403]["text"])
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == kept[3] and out.count() == len(kept[3])


def test_empty_tables(spark):
    assert corpus_pipeline.run(spark, written(spark, [], [], [])).count() == 0
