import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.functions import vectors
from corpusflow.operators import packing, retrieve

DOCS = "id bigint, content string, source_url string, title string, section string, embedding array<float>"


def docs(spark, vectors):
    return spark.createDataFrame(
        [(i, f"c{i}", f"u{i}", None, "", v) for i, v in enumerate(vectors)], DOCS
    )


def queries(spark, vectors):
    return spark.createDataFrame(
        [(i, f"q{i}", v) for i, v in enumerate(vectors)],
        "query_id bigint, question string, embedding array<float>",
    )


def ranked(df):
    return [(r.query_id, r["rank"], r.id) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("block_bytes", [retrieve.BLOCK_BYTES, 16])
def test_match_edges(spark, block_bytes):
    d = docs(spark, [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], None, [0.0, 3.0], [1.0, 1.0], [-1.0, 0.0]])
    q = queries(spark, [[5.0, 0.0], [0.0, 0.0], None, [0.0, -1.0]])
    found = retrieve.match_documents(d, q, 3, 0.25, block_bytes)
    assert ranked(found) == [(0, 1, 0), (0, 2, 1), (0, 3, 5)]  # ties by id; zero, NULL: none
    assert found.columns == [
        "query_id", "rank", "id", "content", "source_url", "title", "section", "similarity",
    ]
    # 1.0 is not strictly above a threshold of 1.0
    assert ranked(retrieve.match_documents(d, q, 3, 1.0, block_bytes)) == []
    left = retrieve.unanswered(q.select("query_id", "question"), found)
    assert sorted(r.query_id for r in left.collect()) == [1, 2, 3]
    assert left.first().answer == config.NO_MATCH_ANSWER


def test_wrong_dimension_is_an_error(spark):
    with pytest.raises(Exception, match="expected vectors of 2 dimensions"):
        retrieve.match_documents(docs(spark, [[1.0, 0.0, 1.0]]), queries(spark, [[1.0, 0.0]])).collect()


def test_no_query_vectors(spark):
    assert retrieve.match_documents(docs(spark, [[1.0]]), queries(spark, [None])).count() == 0


@pytest.fixture(scope="module")
def random_vectors(spark):
    rng = np.random.default_rng(1)
    # A third of the documents are copies of one vector.
    base = rng.normal(size=(400, 16))
    base[:130] = base[0]
    query = rng.normal(size=(60, 16))
    query[:20] = query[0]
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    qunit = query / np.linalg.norm(query, axis=1, keepdims=True)
    expected = []
    scores = np.float32(qunit).astype(float) @ np.float32(unit).astype(float).T
    for i, row in enumerate(scores):
        order = [j for j in np.lexsort((np.arange(400), -np.round(row, 9))) if row[j] > 0.1][:7]
        expected += [(i, n + 1, int(j)) for n, j in enumerate(order)]
    return docs(spark, base.tolist()).repartition(5), queries(spark, query.tolist()), expected


@pytest.mark.parametrize("block_bytes", [retrieve.BLOCK_BYTES, 16 * 8 * 50, 16 * 8 * 9])
def test_blocks_do_not_change_matches(random_vectors, block_bytes):
    d, q, expected = random_vectors
    assert ranked(retrieve.match_documents(d, q, 7, 0.1, block_bytes)) == expected


def test_approximate_search(random_vectors):
    d, q, expected = random_vectors
    centroids = retrieve.train_centroids(d, 8)
    every = retrieve.approx_match_documents(d, q, centroids, 8, 7, 0.1, 16 * 8 * 20)
    assert ranked(every) == expected
    exact = retrieve.match_documents(d, q, 7, 0.1)
    some = retrieve.approx_match_documents(d, q, centroids, 3, 7, 0.1)
    stored = retrieve.assign_cells(d, centroids).cache()
    assert ranked(retrieve.approx_match_documents(stored, q, centroids, 3, 7, 0.1)) == ranked(some)
    score = retrieve.recall(exact, some).agg(F.avg("recall")).first()[0]
    assert 0.4 < score <= 1.0
    assert retrieve.recall(exact, every).agg(F.min("recall")).first()[0] == 1.0


def test_probes_reach_the_target(random_vectors):
    d, q, _ = random_vectors
    centroids = retrieve.train_centroids(d, 8)
    exact = retrieve.match_documents(d, q, 7, 0.1)
    for target in (0.5, 0.9):
        n = retrieve.probes_for(d, q, centroids, 7, 0.1, target)
        some = retrieve.approx_match_documents(d, q, centroids, n, 7, 0.1)
        assert retrieve.recall(exact, some).agg(F.avg("recall")).first()[0] >= target
    assert retrieve.probes_for(d, q.where("false"), centroids) == 8
    assert retrieve.probes_for(d, q, centroids, 7, 0.1, 1.0) <= 8


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_recall(spark, sf):
    from corpusflow.plans import catalog

    score = catalog.approx_recall(spark, f"/root/testdata/{sf}").agg(
        F.avg("recall"), F.sum("n_found") / F.sum("n_exact")
    )
    assert min(score.first()) >= 0.9


MATCHES = (
    "query_id bigint, rank int, id bigint, content string, source_url string, title string, "
    "similarity double"
)


def model_pack(contents, safe):
    from test_text import model_truncate

    used, out = 0, []
    for content in contents:
        tokens = -(-len(content) // 4)
        left = safe - used
        if tokens <= left:
            out.append(content)
            used += tokens
        else:
            if left >= 50:
                out.append(model_truncate(content, left))
            break
    return out


def test_packing_matches_model(spark):
    rng = random.Random(2)
    rows, asked, expected = [], [], {}
    for q in range(300):
        contents = [
            "".join(rng.choice("abc. ") for _ in range(rng.choice([0, 0, 40, 199, 200, 201, 600])))
            for _ in range(rng.randint(1, 12))
        ]
        history = rng.choice([0, 100, 300, 5000])
        rows += [(q, n + 1, n, c, "u", None, 0.5) for n, c in enumerate(contents)]
        asked.append((q, "x" * rng.randint(0, 60), history))
        reserved = 2 + -(-len(asked[-1][1]) // 4) + 6 + history
        safe = int(np.floor((500 - reserved) * 0.95))
        chosen = model_pack(contents, safe)
        context = "\n\n".join(f"[{n + 1}] {c}" for n, c in enumerate(chosen))
        expected[q] = (context, len(chosen), reserved + -(-len(context) // 4))
    matches = spark.createDataFrame(rows, MATCHES).repartition(5)
    queries = spark.createDataFrame(asked, "query_id bigint, question string, history_tokens bigint")
    packed = packing.pack_context(matches, queries, "system", 500)
    got = {r.query_id: (r.context, r.n_selected, r.total_tokens) for r in packed.collect()}
    assert got == expected
    metrics = packing.retrieval_metrics(matches, packed, 500).collect()
    assert all(r.empty_context == (expected[r.query_id][1] == 0) for r in metrics)
    assert any(r.empty_context for r in metrics)


def source(spark, rows, homepages=()):
    df = spark.createDataFrame(
        [(0, n + 1, n, content, url, title, sim) for n, (url, sim, content, title) in enumerate(rows)],
        MATCHES,
    )
    return tuple(retrieve.pick_source(df, homepages).first())[1:]


@pytest.mark.parametrize(
    ("rows", "homepages", "expected"),
    [
        ([("h", 0.9, "a", "H")], ("h",), ("h", "H", "a")),
        ([("h", 0.9, "a", "H"), ("s", 0.3, "b", "")], ("h",), ("s", None, "b")),
        ([("a", 0.80, "x", "A"), ("b", 0.76, "y", "B"), ("b", 0.70, "yy", "BB")], (),
         ("b", "BB", "yy")),
        # chained near ties: 0.72 is not within 0.05 of the best
        ([("a", 0.80, "x", "A"), ("b", 0.76, "y", "B"), ("b", 0.7, "z", "C"),
          ("c", 0.72, "p", "P"), ("c", 0.6, "p", "P"), ("c", 0.6, "p", "P")], (), ("b", "B", "y")),
        ([("a", 0.80, "same", "A1"), ("a", 0.79, "four", "A2")], (), ("a", "A1", "same")),
        ([("", 0.9, "first", "F"), (None, 0.8, "second", "S")], (), ("", "F", "first")),
        ([("", 0.9, "first", "F"), ("u", 0.3, "second", "S")], (), ("u", "S", "second")),
    ],
)
def test_source_choice(spark, rows, homepages, expected):
    assert source(spark, rows, homepages) == expected


def test_prompts_and_generation(spark):
    asked = spark.createDataFrame([(1, "hva?"), (2, "fail")], "query_id bigint, question string")
    contexts = spark.createDataFrame([(1, "[1] a"), (2, "")], "query_id bigint, context string")
    history = spark.createDataFrame(
        [(1, [("user", "hei"), ("assistant", "hallo")])],
        "query_id bigint, history array<struct<role: string, text: string>>",
    )
    prompts = packing.assemble_prompts(contexts, asked, "sys", history)
    got = {r.query_id: [tuple(m) for m in r.messages] for r in prompts.collect()}
    assert got == {
        1: [("system", "sys"), ("user", "hei"), ("assistant", "hallo"),
            ("user", "Kontekst:\n[1] a\n\nSpørsmål: hva?")],
        2: [("system", "sys"), ("user", "Kontekst:\n\n\nSpørsmål: fail")],
    }

    def generator(messages):
        if "fail" in messages[-1]["content"]:
            raise RuntimeError
        return json.dumps([m["role"] for m in messages])

    answers = {r.query_id: r.answer for r in packing.generate_answers(prompts, generator).collect()}
    assert answers == {
        1: '["system", "user", "assistant", "user"]', 2: config.GENERATION_ERROR_ANSWER,
    }


@pytest.mark.parametrize("hot_rows", [0, 1, 100])
def test_cache_lookup(spark, hot_rows):
    rows = [(1, "A"), (2, "a"), (3, "A"), (4, "b"), (5, "b"), (6, None)]
    asked = spark.createDataFrame(rows, "query_id bigint, question string")
    cache = spark.createDataFrame([("A", "ans")], "question string, answer string")
    found = {r.query_id: r.answer for r in retrieve.cache_lookup(asked, cache, hot_rows).collect()}
    assert found == {1: "ans", 2: None, 3: "ans", 4: None, 5: None, 6: None}
    missed = retrieve.cache_misses(asked, cache, hot_rows).collect()
    assert sorted(r.query_id for r in missed) == [2, 4, 5, 6]


@pytest.mark.parametrize("threshold", [-2.0, 0.3])
def test_scoring_holds_little_for_many_queries(threshold):
    """Every document is above the lower threshold; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    queries, docs = rng.normal(size=(20_000, 8)), rng.normal(size=(3_000, 8))
    docs[1_000:2_000] = docs[0]
    queries, docs = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (queries, docs))
    tracemalloc.start()
    try:
        best = vectors.TopK(np.arange(20_000), queries, 5, threshold)
        for low in (0, 1_700):
            best.add(np.arange(low, min(low + 1_700, 3_000)), docs[low : low + 1_700])
        rows = best.result().to_pandas()
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
    for number in range(0, 20_000, 400):
        scores = np.einsum("ij,ij->i", docs, np.repeat(queries[number : number + 1], 3_000, axis=0))
        wanted = [j for j in np.lexsort((np.arange(3_000), -scores)) if scores[j] > threshold][:5]
        assert rows[rows.query_id == number].id.tolist() == wanted


def test_a_task_holds_little_besides_its_vectors():
    """Queries of a turn are made into unit vectors a few thousand at a time, candidates scored likewise."""
    import pyarrow as pa

    rng = np.random.default_rng(5)

    def table(name, n):
        flat = pa.array(rng.normal(size=n * 32).astype(np.float32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * 32 + 1, 32), pa.int32()), flat)
        return pa.table({name: pa.array(np.arange(n)), "embedding": lists})

    held, asked = table("id", 3000), table("query_id", 12_000)
    score = retrieve._scored_in_blocks("embedding", 32, 5, 0.3, 1 << 16)
    tracemalloc.start()
    found = score(held, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    units = [vectors.unit_rows(t.column("embedding"), 32)[1] for t in (held, asked)]
    scores = units[1][::97] @ units[0].T
    best = found.to_pandas().groupby("query_id")["id"].agg(set)
    for query, row in zip(range(0, 12_000, 97), scores, strict=True):
        order = np.argsort(-row)[:5]
        assert best.get(query, set()) == {int(i) for i in order if row[i] > 0.3}


def test_floor_needs_as_many_documents_as_matches():
    """Copies of a text and vectors that are no numbers leave the same matches."""
    docs = np.tile(np.array([[1.0, 0.0]]), (40, 1))
    docs[5] = np.nan
    docs[7:20] = [0.6, 0.8]
    for k in (1, 2, 3, 30):
        best = vectors.TopK(np.arange(1), np.array([[1.0, 0.0]]), k, 0.25)
        best.add(np.arange(40), docs)
        ones = [i for i in range(40) if i != 5 and not 7 <= i < 20]
        assert best.result().column(1).to_pylist() == (ones + list(range(7, 20)))[:k]
