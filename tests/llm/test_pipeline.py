from collections import Counter

import corpus_pipeline as P
from heldout.llm import decontaminate, near_dedup, packing, quality_model, quality_rules
from tests.llm.fixtures import documents, empty, shingles
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator_and_brute_force(spark, tmp_path):
    docs = P.table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_classifier", "quality_rules", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    labels, items = P.table(spark, SF, "labels"), P.table(spark, SF, "benchmark")
    steps = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, steps[-1], SF).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == docs.columns for s in steps[:5])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] == {r["doc_id"] for r in quality_model.score_documents(steps[0], labels).filter("predicted = 1").collect()}
    assert ids[2] == {r["doc_id"] for r in quality_rules.judge(steps[1]).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    assert ids[3] == set(brute(rows).values())
    bench = [shingles(r["text"]) for r in items.collect()]
    want = {r["doc_id"] for r in steps[3].collect() if not any(b and len(b & shingles(r["text"])) >= 0.75 * len(b) for b in bench)}
    assert ids[4] == want and len(want) > 50
    pieces = steps[5].collect()
    assert {r["doc_id"] for r in pieces} == ids[4]
    held = Counter()
    for r in pieces:
        held[r["doc_id"]] += r["length"]
    assert all(held[r["doc_id"]] == r["doc_tokens"] for r in pieces)
    assert packing.CONTEXT == 4096 and decontaminate.CONTAINED == 0.75 and near_dedup.REGION > 1


def test_run_returns_the_packed_pieces(spark):
    out = P.run(spark, SF)
    assert "sequence_id" in out.columns and out.count() > 50


def test_awkward_and_empty_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages; an empty table gives no row."""
    for name, docs in (("odd", documents(spark)), ("none", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            P.table(spark, SF, other).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
    ids = {r["doc_id"] for r in documents(spark).collect()}
    out = P.run(spark, f"{tmp_path}/odd")
    found = [r["doc_id"] for r in out.collect()]
    assert set(found) <= ids and not {5, 6, 13} & set(found)  # without words a text fails the rules
    assert P.run(spark, f"{tmp_path}/none").count() == 0
