import numpy as np

from corpusflow.llm import quality, queries


def test_estimates_accuracies_from_overlaps():
    rnd = np.random.default_rng(0)
    bad = rnd.random(20_000) < 0.3
    right = [0.9, 0.8, 0.7, 0.6]
    votes = np.stack(
        [np.where((rnd.random(len(bad)) < p) == bad, quality.BAD, quality.GOOD) for p in right], 1
    )
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, rates = quality.expectation_maximisation(patterns, counts, rounds=500)
    assert np.abs(rates[1, :, quality.BAD] - right).max() < 0.06
    assert np.abs(rates[0, :, quality.GOOD] - right).max() < 0.06


def test_codes_round_trip():
    rnd = np.random.default_rng(1)
    votes = rnd.integers(0, 3, (50, quality.LABELLERS))
    codes = np.array([quality.coded(v.tolist()) for v in votes])
    assert (quality.decoded(codes) == votes).all()


def test_against_labels_it_has_not_seen(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op8_quality(spark, sf_dir).join(labels, "doc_id").collect()
    good = np.array([r["quality_score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["quality_score"] for r in rows if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.97
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.05


def test_fit_does_not_depend_on_partitions(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    assert (quality.fit(docs.repartition(5)) == quality.fit(docs.coalesce(1))).all()
