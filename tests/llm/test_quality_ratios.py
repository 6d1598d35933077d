"""The ratios of the quality rules reach a stage by family, from a written table."""

from __future__ import annotations

from corpusgrid.llm import quality

DOCS = [(i, " ".join(f"{'abcdefgh'[(i * k) % 8]}{'xyz'[k % 3]}{i % 3}" for k in range(1, 16 + i))) for i in range(20)]


def test_ratios_are_written_by_family(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    whole = quality.log_ratios(docs, docs.where("doc_id < 9").select("doc_id"))
    parts = {r["family"]: list(r["ratios"]) for r in quality.family_ratios(whole).collect()}
    assert [len(parts[k]) for k in range(len(quality.FAMILIES))] == list(quality.BUCKETS)
    assert sum((parts[k] for k in range(len(quality.FAMILIES))), []) == list(whole.first()["ratios"])


def test_scoring_neither_counts_the_ratios_nor_reads_another_familys(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    out = quality.quality(docs, docs.where("doc_id < 9").select("doc_id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    for k in range(len(quality.FAMILIES)):
        assert f" = {k})" in plan
    assert out.where("kept").count() + out.where("not kept").count() == len(DOCS)
