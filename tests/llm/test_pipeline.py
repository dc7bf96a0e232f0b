"""The pipeline stage by stage, and what of the llm folder the driver sees."""

import __spark_entry__
import corpus_pipeline
from facets.llm import credentials, fmindex, quality
from facets.llm.queries import QUERIES

import test_documents as brute


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(
        f"{folder}/benchmark.parquet").collect()]
    functions = dict(corpus_pipeline.STAGES)
    kept = docs
    for name in ("quality classifier", "SimHash near-dedup", "benchmark decontamination",
                 "secret scans"):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = functions[name](spark, kept, folder)
        assert kept.columns == docs.columns
        kept = kept.cache()
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after and len(after) == kept.count()
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            assert set(after) == {i for i, t in before.items()
                                  if model.score(t.encode()) >= quality.THRESHOLD}
        elif name == "SimHash near-dedup":
            group = brute.brute_components(
                {i: brute.brute_fingerprint(t) for i, t in before.items()})
            assert set(after) == set(group.values())
        elif name == "benchmark decontamination":
            assert set(after) == {i for i, t in before.items()
                                  if not brute.brute_hits(t, items, fmindex.WINDOW)[1]}
        else:
            assert set(after) == set(before)
            for i, t in before.items():
                spans = brute.brute_linked(t)
                assert (after[i] == t) == (not spans)
                assert after[i].count(credentials.MASK) <= len(spans) or not spans
    packed = functions["best-fit packing"](spark, kept, folder).toPandas()
    assert set(packed["doc_id"]) == set(after)
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(map(tuple, whole.values.tolist())) == sorted(map(tuple, packed.values.tolist()))


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert set(QUERIES) <= set(names)
