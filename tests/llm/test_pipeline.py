"""The pipeline's stages on a small folder of tables, each against what it must do to its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import packing, quality

rng = random.Random(11)


def prose(n):
    return " ".join(f"w{rng.randrange(3000)}x" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    shared = "\n".join(prose(30) for _ in range(2))
    bench = prose(30)
    clean = [prose(rng.randrange(60, 200)) for _ in range(120)]
    near = clean[0].split()
    near[5] = "changed"
    texts = clean + [
        " | ".join(prose(60).split()),
        f"{prose(60)}\n{shared}\n{prose(60)}",
        f"{prose(70)}\n{shared}\n{prose(50)}",
        " ".join(near),
        clean[1],
        f"{prose(30)} {bench} {prose(30)}",
        None,
    ]
    junk = [" | ".join(prose(60).split()) for _ in range(80)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(i, 0, 0) for i in range(len(texts), len(rows))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]

    def run(name, docs):
        out = steps[name](spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns
        return out.cache()

    kept = run("quality", docs)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert set(range(120)) <= ids and 120 not in ids and not any(i >= len(texts) for i in ids)
    lines = run("line_dedup", kept)
    by = {r.doc_id: r for r in lines.collect()}
    assert by[121].text == texts[121] and len(by[122].text.split("\n")) == 2 and by[122].n_chars == len(by[122].text)
    assert 124 not in by  # an exact copy has lost all its lines
    near = run("near_dedup", lines)
    left = {r.doc_id for r in near.collect()}
    assert 123 not in left and set(range(120)) <= left
    clean = run("decontaminate", near)
    assert left - {r.doc_id for r in clean.collect()} == {125}
    pieces = run("packing", clean).collect()
    assert {r.doc_id for r in pieces} == left - {125}
    assert sum(r.length for r in pieces) == packing.pieces(clean, packing.default_tokenizer()).agg(F.sum("length")).first()[0]


def test_run_is_the_stages_in_turn_and_takes_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() >= 120
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.THRESHOLD == 0.3
