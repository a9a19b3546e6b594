import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import ann, retrieve
from corpusflow.plans import catalog

RNG = np.random.default_rng(5)


def table(spark, name, vectors):
    rows = [(i, i % 4, None if x is None else [float(y) for y in x]) for i, x in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, label int, embedding array<float>")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    vectors = list(RNG.normal(size=(300, 8)))
    vectors[100:200] = [vectors[100]] * 100  # a third are copies of one
    vectors[7], vectors[8] = None, np.zeros(8)
    docs = table(spark, "id", vectors).withColumn("title", F.concat(F.lit("t"), "id"))
    asked = [None, np.zeros(8), vectors[100], *RNG.normal(size=(57, 8))]
    queries = table(spark, "query_id", asked).drop("label")
    path = str(tmp_path_factory.mktemp("ann") / "index")
    # Slots of 20 vectors: the cell of the copies has several.
    index = ann.build_ann_index(docs, path, ann.mean_centroids(docs, "label"), 2, block_bytes=8 * 8 * 20)
    return docs, queries, index


def ranked(df):
    return [
        (r["query_id"], r["rank"], r["id"], r["title"], round(r["similarity"], 9))
        for r in df.orderBy("query_id", "rank").collect()
    ]


def test_all_cells_are_exact_search(made):
    docs, queries, index = made
    exact = retrieve.match_documents(docs, queries, 5, 0.1)
    found = ann.search(index, queries, 5, 0.1, n_probe=4)
    wanted = [(r["query_id"], r["rank"], r["id"]) for r in exact.orderBy("query_id", "rank").collect()]
    assert [x[:3] for x in ranked(found)] == wanted
    assert {x[3] for x in ranked(found)} <= {f"t{i}" for i in range(300)}


@pytest.mark.parametrize("n_probe", [None, 1, 3, 4])
def test_blocks_of_queries_give_the_same(made, n_probe):
    _, queries, index = made
    few = ranked(ann.search(index, queries, 5, 0.1, n_probe))
    assert few == ranked(ann.search(index, queries, 5, 0.1, n_probe, block_bytes=8 * 8 * 25))
    assert few and all(x[0] > 1 for x in few)  # NULL and zero queries have none


@pytest.mark.parametrize("turn_bytes, n_turns", [(8 * 8 * 1000, 1), (8 * 8 * 25, 3)])
def test_small_blocks_of_queries_take_no_more_jobs(made, monkeypatch, turn_bytes, n_turns):
    _, queries, index = made
    turns = []
    monkeypatch.setattr(retrieve, "stored", lambda df: turns.append(df) or df)
    monkeypatch.setattr(retrieve, "TURN_BYTES", turn_bytes, raising=False)
    found = ranked(ann.search(index, queries, 5, 0.1, block_bytes=8 * 8 * 5))
    assert found == ranked(ann.search(index, queries, 5, 0.1))
    assert len(turns) == n_turns


def test_only_the_cells_of_the_queries_are_read(spark, made):
    _, queries, index = made
    head = queries.where("query_id = 2").toArrow().select(["query_id", "embedding"])
    plan = ann._few(index, head, 5, 0.1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan
    assert "Exchange" not in plan


def test_documents_do_not_move_for_many_queries(spark, made):
    _, _, index = made
    vectors = spark.table(ann._registered(spark, index.path, index.n_buckets))
    queries = spark.range(50).select((F.col("id") % 7).alias("slot"))
    plan = (
        vectors.select("slot", "id").groupBy("slot").cogroup(queries.groupBy("slot"))
        .applyInArrow(lambda a, b: a, "slot long, id long")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_an_opened_index_is_the_same(spark, made):
    _, queries, index = made
    spark.sql(f"DROP TABLE {ann._table_name(index.path)}")  # as another application sees it
    again = ann.open_ann_index(spark, index.path)
    assert again.n_probe == 2 and np.array_equal(again.centroids, index.centroids)
    assert ranked(ann.search(again, queries, 5, 0.1)) == ranked(ann.search(index, queries, 5, 0.1))
    small = ann.search(again, queries, 5, 0.1, block_bytes=8 * 8 * 25)
    assert ranked(small) == ranked(ann.search(index, queries, 5, 0.1))


def test_probes_are_measured(spark, made, tmp_path):
    docs, queries, _ = made
    centroids = ann.mean_centroids(docs, "label")
    index = ann.build_ann_index(docs, str(tmp_path / "i"), centroids, None, queries, 5, 0.1)
    exact = retrieve.match_documents(docs, queries, 5, 0.1)
    found = ann.search(index, queries, 5, 0.1)
    assert retrieve.recall(exact, found).agg(F.avg("recall")).first()[0] >= 0.9
    assert ann.build_ann_index(docs, str(tmp_path / "j"), centroids).n_probe == 4


def test_empty_tables(spark, made, tmp_path):
    docs, queries, index = made
    centroids = ann.mean_centroids(docs, "label")
    empty = ann.build_ann_index(docs.where("false"), str(tmp_path / "e"), centroids, 1)
    assert ann.search(empty, queries).count() == 0
    assert ann.search(index, queries.where("false")).count() == 0
    with pytest.raises(ValueError, match="centroid"):
        ann.build_ann_index(docs, str(tmp_path / "n"), centroids.where("false"), 1)


def test_registered_index_finds_nine_in_ten(spark):
    sf = "/root/testdata/sf0.01"
    exact = {(r["query_id"], r["id"]) for r in catalog.match_documents(spark, sf).select("query_id", "id").collect()}
    found = {(r["query_id"], r["id"]) for r in catalog.approx_match_documents(spark, sf).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
