"""The pipeline: each stage's decision takes effect and leaves clean documents alone."""


import pytest

import corpus_pipeline
from tidemark.llm import quality

from . import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents beside junk, toxic ones, copies and leaks, as small tables."""
    path = tmp_path_factory.mktemp("sf")
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source.unionByName(source.where("doc_id < 40").selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "n_chars")).unionByName(
        spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "src1", 0)], source.schema)
    ).write.parquet(str(path / "documents.parquet"))
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").write.parquet(str(path / f"{t}.parquet"))
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "mixing", "sharding"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas()
        ids = set(after["doc_id"])
        if n < 4:
            assert docs.columns == columns
        if name == "quality":
            known = {r["doc_id"]: r for r in labels.collect()}
            clean = [i for i, r in known.items() if r["quality"] == 1 and r["toxic"] == 0]
            assert len([i for i in clean if i in ids]) >= 0.98 * len(clean)
            assert not ids & {9000, 9001}
            kept = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("keep")
            assert {r["doc_id"] for r in kept.collect()} == ids
        elif name == "near_duplicates":
            assert sorted(after["doc_id"]) == sorted({c for _, c in brute.near_duplicates({i: t for i, t, _ in before}).values()})
        elif name == "benchmark":
            assert sorted(after["doc_id"]) == sorted(i for i, (_, hit, _) in brute.decontaminate({i: t for i, t, _ in before}, bench).items() if not hit)
        elif name == "mixing":
            times = after.groupby("doc_id").size()
            size = {i: len(brute.WORD.findall(t)) for i, t, _ in before}
            total = {}
            for i, _, s in before:
                total[s] = total.get(s, 0) + size[i]
            aim = brute.targets(total)
            assert ids <= set(size) and times.max() <= 3
            for s in total:
                mine = [i for i, _, x in before if x == s]
                assert abs(sum(size[i] * int(times.get(i, 0)) for i in mine) - aim[s]) <= max(size[i] for i in mine)
        else:
            assert sorted(after["doc_id"]) == sorted(i for i, _, _ in before)
            for _, part in after.groupby("shard"):
                assert sorted(part["slot"]) == list(range(len(part)))


def test_run_is_the_stages_in_turn(spark, folder):
    assert {"size", "shard", "slot"} < set(corpus_pipeline.run(spark, folder).columns)


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_take_more_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30").selectExpr("*", "'x' AS keep", "1 AS n_hit", "2 AS Positions", "3 AS shard")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 0, name


