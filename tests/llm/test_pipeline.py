"""The pipeline's stages on the small messy table, each on what the one before returned."""

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, docs, tmp_path):
    import corpus_pipeline

    now, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, None)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts[name] = now.count()
    assert docs.count() > counts["language_id"] > counts["minhash_dedup"] == counts["substring_dedup"]
    assert counts["mixing"] and counts["packing"] >= counts["mixing"]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
