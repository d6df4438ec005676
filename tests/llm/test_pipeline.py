"""The pipeline's stages, each on its own input, and run() as a whole."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from quillspark.llm import decontamination, mixing, near_duplicates

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], DATA).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    ids = [Counter(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]
    assert all(f.columns == columns for f in frames[:-1]) and sorted(frames[-1].columns) == sorted([*columns, "shard"])
    assert ids[1] == ids[0]  # all are clean
    kept = {r["doc_id"] for r in near_duplicates.near_duplicates(frames[1]).where("kept").collect()}
    assert ids[2] == Counter(kept)
    dirty = {r["doc_id"] for r in decontamination.contamination(frames[2], spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").collect()}
    assert dirty and ids[3] == Counter(kept - dirty)
    assert ids[4] == Counter(r["doc_id"] for r in mixing.mix_sources(frames[3]).collect()) and ids[5] == ids[4]
    whole = corpus_pipeline.run(spark, DATA)
    assert Counter(zip(*[[r[c] for r in whole.collect()] for c in ("doc_id", "shard")])) == Counter(zip(*[[r[c] for r in frames[-1].collect()] for c in ("doc_id", "shard")]))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, `row` string, _gone int, shard int"
    rows = [(1, None, "en", "s", None, "x", "y", 1, 2), (1, None, "en", "s", None, "x", "y", 1, 2), (2, "", None, None, 0, None, None, None, None), (3, "plain words here and there", "en", "s", 5, "x", "y", 1, 2), (None, "plain words", "en", None, 5, "x", "y", 1, 2)]
    for data in (rows, []):
        out = stage(spark, spark.createDataFrame(data, schema), DATA)
        got = out.collect()
        if name != "sharding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "row", "_gone", "shard"]
        assert len(got) <= 20 * max(1, len(data)) and (data or not got)
