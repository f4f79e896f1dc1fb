"""The pipeline's stages against plain versions, and on odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.plans.shared import shared_table


def test_stages_on_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared_table(stage(spark, docs, sf))
        assert after.columns == docs.columns, name
        before, kept = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert all(before[i] == r for i, r in kept.items())
        if name == "quality rules":
            assert {i for i, r in before.items() if len(r["text"].split()) < 10}.isdisjoint(kept)
        if name == "language ID":
            assert len(kept) >= 0.98 * len(before)
        if name == "SimHash near-dedup":
            grams = {i: frozenset(tuple(r["text"].encode().lower().split()[k : k + 5]) for k in range(max(1, len(r["text"].split()) - 4))) for i, r in before.items()}
            root = {i: i for i in grams}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a in grams:
                for b in grams:
                    if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
            assert set(kept) == {find(i) for i in grams}
        if name == "benchmark decontamination":
            assert set(kept) == {i for i, r in before.items() if not any(t in " ".join(r["text"].lower().split()) for t in items)}
        docs = after
    out = corpus_pipeline.encoding(spark, docs, sf)
    assert out.count() == docs.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, sf, stage):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "x"), (1, "", "en", "s", 0, "x"), (2, "a b " * 3000, None, "s", 1, "x"), (3, "one two three four five six seven eight nine ten", "en", "s", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    assert stage(spark, docs, sf).count() <= len(rows)
    assert stage(spark, docs.limit(0), sf).count() == 0
    assert stage(spark, docs.withColumn("fp", F.lit(1)), sf).count() <= len(rows)
