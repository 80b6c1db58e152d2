import zlib

import numpy as np

from heldout.llm import quality_model, toxicity
from heldout.llm.queries import table
from tests.llm.fixtures import documents, empty

SF = "/root/testdata/sf0.01"


def accuracy(spark, scored, label):
    labels = table(spark, SF, "labels").select("doc_id", label)
    rows = scored.select("doc_id", "held_out", "score", "predicted").join(labels.withColumnRenamed(label, "y"), "doc_id").filter("held_out").collect()
    ones = np.array([r["score"] for r in rows if r["y"] == 1])
    zeros = np.array([r["score"] for r in rows if r["y"] == 0])
    auc = np.mean(ones[:, None] > zeros[None]) + 0.5 * np.mean(ones[:, None] == zeros[None])
    return auc, np.mean([r["predicted"] == r["y"] for r in rows])


def test_quality_on_the_held_out_fold(spark):
    scored = quality_model.score_documents(table(spark, SF, "documents"), table(spark, SF, "labels"))
    auc, right = accuracy(spark, scored, "quality")
    assert auc > 0.97 and right > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored.collect())


def test_toxicity_on_the_held_out_fold(spark):
    """About 320 texts teach the network here, so the bar is lower than on larger tables."""
    auc, right = accuracy(spark, toxicity.score_documents(table(spark, SF, "documents"), table(spark, SF, "labels")), "toxic")
    assert auc > 0.8 and right > 0.85


def test_trees_separate_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = quality_model.fit_trees(x, y, trees=60, depth=3)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.97
    k = 17  # one row by hand through every tree
    total = model.base
    for f, c, leaf in zip(model.feature, model.cut, model.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(x[k, f[at]] > c[at])
        total += leaf[at - len(f)]
    assert np.isclose(total, model.raw(x[k : k + 1])[0])
    assert np.allclose(quality_model.fit_trees(np.zeros((0, 5)), np.zeros(0)).score(x[:3]), 0.5)
    assert (quality_model.fit_trees(x, np.ones(len(x))).score(x) > 0.99).all()


def test_awkward_rows(spark):
    docs, labels = documents(spark), table(spark, SF, "labels")
    none = spark.createDataFrame([], labels.schema)
    for module in (quality_model, toxicity):
        for taught in (labels, none, labels.unionByName(labels).withColumn("score", labels["quality"])):
            rows = module.score_documents(docs, taught).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert all(r["held_out"] for r in rows if r["doc_id"] is None)
            same = {r["score"] for r in rows if r["doc_id"] in (1, 3)}
            assert len(same) == 1
        assert module.score_documents(empty(spark), labels).count() == 0
    kept = quality_model.accepted(docs, labels)
    assert kept.columns == docs.columns


def test_statistics_of_any_text():
    for text in (b"", b" \n ", b"a", b"\n\n!!!", "é".encode(), b"x " * 30_000, b"line\n" * 50, b"\xff\xfe"):
        row = quality_model.statistics(text)
        assert len(row) == len(quality_model.FEATURES) and np.isfinite(row).all()


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    bad = ["trash", "scum"]
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "five"], 30)) + (" " + bad[i % 2] if i % 4 == 0 else "") for i in range(400)]
    hashes = [toxicity.WordHash().of(toxicity.words_of(t.encode())) for t in texts]
    y = np.array([float(i % 4 == 0) for i in range(400)])
    net = toxicity.train(hashes, y, epochs=4)
    whole = toxicity.Scorer(net).margins([t.encode() for t in texts])
    assert np.mean((whole > 0) == y) > 0.99
    one = np.concatenate([toxicity.Scorer(net, most=3).margins([t.encode()]) for t in texts[:50]])
    assert np.allclose(whole[:50], one, atol=1e-4)
    plain = toxicity.Scorer(net).margins([b"", b"...", b"one"])
    assert np.isfinite(plain).all()
