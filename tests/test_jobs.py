"""Embedding job, sources and sinks, page stream, pipelines."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import lineage
from corpusflow.functions.lineage import in_sequence
from corpusflow.operators import embed
from corpusflow.plans import catalog, checks, pipelines
from corpusflow.sources import json_items, published, tables
from corpusflow.streaming import page_log, page_stream

CHUNKS = (
    "id string, content string, source_url string, title string, section string, "
    "chunk_index int, page_ord bigint, section_index int"
)


def chunk_rows(spark, n, parts=1):
    rows = [(f"c{i}", f"text {i}", "u", None, "", 0, i, 0) for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS).repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 100, 101])
def test_embedding_batches(spark, n):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        assert len(texts) <= 100
        return [[float(len(t)), 1.0] for t in texts]

    rows = embed.embed_chunks(chunk_rows(spark, n), model).collect()
    assert len(rows) == n and all(r.error is None for r in rows)
    assert all(r.embedding == [float(len(r.content)), 1.0] for r in rows)
    assert calls.value == -(-n // 100)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_failing_batches_are_marked(spark, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        def model(texts):
            if "text 13" in texts:
                raise RuntimeError("no service")
            return [[1.0]] * (len(texts) - ("text 25" in texts))

        df = embed.embed_chunks(chunk_rows(spark, 30, parts), model, batch_size=10)
        errors = {r.page_ord: r.error for r in df.collect()}
        summary, first = tuple(embed.embed_summary(df).first()), embed.first_errors(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [errors[i] for i in range(30)] == (
        [None] * 10 + ["no service"] * 10 + ["Expected 10 embeddings, got 9"] * 10
    )
    assert summary == (30, 10, 20)
    assert [r.id for r in first] == [f"c{i}" for i in range(10, 20)]


def test_hashing_embedder_is_deterministic():
    model = embed.hashing_embedder(8)
    assert model(["a b", "B a"])[0] == model(["x", "a b"])[1] == model(["B a"])[0]


def test_json_sources(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    page = {"source_url": "u", "title": None, "sections": [{"section_title": "a", "text": "b"}]}
    (tmp_path / "pages" / "a.json").write_text(json.dumps([page, {**page, "source_url": "v"}]))
    (tmp_path / "pages" / "b.json").write_text(json.dumps([{**page, "source_url": "w"}], indent=2))
    rows = tables.read_pages(spark, str(tmp_path / "pages")).orderBy("page_ord").collect()
    assert [r.source_url for r in rows] == ["u", "v", "w"]
    assert rows[0].sections[0].text == "b" and rows[0].title is None
    (tmp_path / "urls.json").write_text(json.dumps(["z", "a"]))
    urls = tables.read_urls(spark, str(tmp_path / "urls.json")).orderBy("ord").collect()
    assert [(r.ord, r.url) for r in urls] == [(0, "z"), (1, "a")]
    (tmp_path / "chunks.json").write_text(json.dumps([{"id": "i", "content": "c", "chunk_index": 3}]))
    chunk = tables.read_chunks(spark, str(tmp_path / "chunks.json")).first()
    assert (chunk.id, chunk.chunk_index, chunk.page_ord) == ("i", 3, 0)


def test_json_lines_and_arrays_keep_every_row(spark, tmp_path):
    page = ("u", None, [("a", "b")])
    df = spark.createDataFrame(
        [page] * 200,
        "source_url string, title string, "
        "sections array<struct<section_title: string, text: string>>",
    )
    path = str(tmp_path / "lines")
    tables.write_table(df.repartition(4), path, "json")
    back = tables.read_pages(spark, path)
    assert back.count() == 200 and back.select("page_ord").distinct().count() == 200
    urls = spark.createDataFrame([(k, f"u{k}") for k in range(50)], "ord bigint, url string")
    tables.write_table(urls, str(tmp_path / "urls"), "json")
    assert {r.url for r in tables.read_urls(spark, str(tmp_path / "urls")).collect()} == {
        f"u{k}" for k in range(50)
    }
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.json").write_text(json.dumps(["x", "y"]))
    (tmp_path / "mixed" / "b.json").write_text(json.dumps({"url": "z"}) + "\n\n")
    rows = tables.read_urls(spark, str(tmp_path / "mixed")).orderBy("ord").collect()
    assert [r.url for r in rows] == ["x", "y", "z"]


@pytest.mark.parametrize("text", ['["a", "b"', '["a"]\n["b"]', '{"url": "a"}\n{"url": ', "a"])
def test_malformed_json_raises(spark, tmp_path, text):
    (tmp_path / "good.json").write_text(json.dumps(["a"]))
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_urls(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(
    "text",
    [
        '["a"]["b"]', '["a"] trailing', '["a"],\n["b"]', '{"url":"a"} {"url":"b"}', '{"nope":"a"}',
        '["a"],', '["a",]', '[,"a"]', '["a" "b"]', '["a"]]', '{"url":"a"}]', '["a"} ', '"a\\', '[1]', '["a", {"url": 1}]',
        '["a\n"', '[["a"]]', '{"url":"a"},',
    ],
)
@pytest.mark.parametrize("block", [1, 4 << 20])
def test_json_that_is_more_or_less_than_expected_raises(spark, tmp_path, text, block, monkeypatch):
    monkeypatch.setattr(json_items.read_blocks, "__defaults__", (block,))
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|expected|tried to convert"):
        tables.read_urls(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("block", [1, 40, 4 << 20])
def test_json_in_blocks_keeps_every_element(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(json_items.read_blocks, "__defaults__", (block,))
    odd = ['a,b', 'x"y', 'back\\slash\\', ']', '[', '{"u": 1}', "line\nend", "", "ü,€", ",", '\\"', "tab\t"] * 3
    (tmp_path / "a.json").write_text(json.dumps(odd))
    (tmp_path / "b.json").write_text("\n \n" + json.dumps(odd, indent=1, ensure_ascii=False) + " \n")
    (tmp_path / "c.json").write_text("\n\n".join(json.dumps({"url": u, "n": [1, {"k": "]"}]}) for u in odd) + "\r\n")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text(" [ ] ")
    (tmp_path / "f.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(odd).encode())
    rows = tables.read_urls(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.url for r in rows] == odd * 4
    assert len({r.ord for r in rows}) == len(rows)


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_answer_cache_in_blocks(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(json_items.read_blocks, "__defaults__", (block,))
    wanted = {f"q{i}, \"{i}\"": {"answer": f"{{a{i}}}, ]", "more": [1, 2]} for i in range(20)}
    (tmp_path / "a.json").write_text(json.dumps(wanted))
    (tmp_path / "b.json").write_text("{}")
    got = {r.question: r.answer for r in tables.read_answer_cache(spark, str(tmp_path)).collect()}
    assert got == {q: a["answer"] for q, a in wanted.items()}
    for text in ('{"q": {"answer": "a"}} {"r": {"answer": "b"}}', '{"q": {"no": "a"}}', '[]', '{"q": "a"}', '{"q": {"answer": "a"},}'):
        (tmp_path / "b.json").write_text(text)
        with pytest.raises(Exception, match="(?i)malformed"):
            tables.read_answer_cache(spark, str(tmp_path)).collect()


def test_one_long_line_is_read_in_several_splits(spark, tmp_path):
    urls = [f"https://example.org/{k}?a={k},{k}" for k in range(20_000)]
    (tmp_path / "long.json").write_text(json.dumps(urls))
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64k")
    try:
        blocks = json_items.read_blocks(spark, str(tmp_path / "long.json"))
        assert blocks.rdd.getNumPartitions() > 5 and blocks.count() > 5
        rows = tables.read_urls(spark, str(tmp_path / "long.json")).orderBy("ord").collect()
    finally:
        spark.conf.set(setting, before)
    assert [r.url for r in rows] == urls and [r.ord for r in rows] == list(range(len(urls)))


def test_malformed_answer_cache_raises(spark, tmp_path):
    (tmp_path / "cache.json").write_text('{"q": {"answer": "a"}, ')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_answer_cache(spark, str(tmp_path)).collect()


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from corpusflow.functions.lineage import shared_folder

    def session(master, configured=None):
        made = []
        context = SimpleNamespace(
            master=master,
            getCheckpointDir=lambda: made[-1] if made else None,
            setCheckpointDir=made.append,
        )
        return SimpleNamespace(
            sparkContext=context, conf=SimpleNamespace(get=lambda key, default: configured)
        )

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs://x")) == "hdfs://x"
    assert shared_folder(session("local[4]")) and shared_folder(session("local"))


def test_answer_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.read_answer_cache(spark, path).count() == 0
    answers = spark.createDataFrame(
        [(0, "q0", "old"), (1, "q1", 'a "b"\nø'), (2, "q0", "new")],
        "ord bigint, question string, answer string",
    )
    row = tables.answer_cache_objects(answers).first()
    assert json.loads(row.json) == {"q0": {"answer": "new"}, "q1": {"answer": 'a "b"\nø'}}
    for size in (None, 10, 1):
        tables.write_answer_cache(answers, path, size)
        got = {tuple(r) for r in tables.read_answer_cache(spark, path).collect()}
        assert got == {("q0", "new"), ("q1", 'a "b"\nø')}


def test_full_refresh(spark, tmp_path):
    path = str(tmp_path / "index")
    embedded = embed.embed_chunks(chunk_rows(spark, 5), embed.hashing_embedder(4))
    assert tables.load_documents(embedded, path) == 0
    assert tables.load_documents(embedded.where("page_ord < 3"), path) == 5
    stored = published.published(spark, path)
    assert stored.count() == 3
    assert stored.columns == [
        "id", "content", "embedding", "source_url", "title", "section", "created_at",
    ]

    def broken(texts):
        raise SystemError

    failing = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(failing, path)
    assert published.published(spark, path).count() == 3


PAGES = (
    "page_ord bigint, source_url string, title string, "
    "sections array<struct<section_title: string, text: string>>"
)


def test_page_stream(spark, tmp_path):
    batches = [
        [(0, "u/a", "a0", []), (1, "u/b/", "b0", [])],
        [(0, "u/c", "c0", []), (1, "u/b", "b1", [])],
        [(0, "u/a/", "a1", [])],
    ]
    for number, rows in enumerate(batches):
        target = str(tmp_path / "in")
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(target)
        query = page_stream.upsert_stream(
            spark.readStream.schema(PAGES).parquet(target), str(tmp_path / "table"),
            str(tmp_path / "cp"), 4, availableNow=True,
        )
        query.awaitTermination(120)
        assert query.exception() is None
    rows = spark.read.parquet(str(tmp_path / "table")).orderBy("page_ord").collect()
    assert [(r.page_ord, r.source_url, r.title) for r in rows] == [
        (0, "u/a/", "a1"), (1, "u/b", "b1"), (2, "u/c", "c0"),
    ]


def test_crash_between_any_two_steps_leaves_a_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    tables.replace_table(spark.range(3), path)

    def fails(*_):
        raise OSError("gone")

    for step in ("write_state",):
        with monkeypatch.context() as broken:
            broken.setattr(published, step, fails)
            with pytest.raises(OSError):
                tables.replace_table(spark.range(5), path)
        assert published.published(spark, path).count() == 3
    # Cut off after the new pointer was written aside, before the rename.
    (tmp_path / "table" / "_current-aside").write_text('{"version": "v-none"}')
    reader = published.published(spark, path)
    assert tables.replace_table(spark.range(5), path) == 3
    assert published.published(spark, path).count() == 5
    assert reader.count() == 3  # an old reader keeps its version
    assert published.drop_old_versions(spark, path) == 2
    assert published.published(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        published.published(spark, str(tmp_path / "none"))


def log_rows(spark, path):
    rows = page_log.read_page_log(spark, path).orderBy("page_ord").collect()
    return [(r.page_ord, r.source_url, r.title) for r in rows]


def test_page_log(spark, tmp_path):
    path = str(tmp_path / "log")
    batches = [
        [(0, "u/a", "a0", []), (1, "u/b/", "b0", []), (2, "u/a/", "a1", [])],
        [],
        [(0, "u/c", "c0", []), (1, "u/b", "b1", [])],
        [(0, "u/a/", "a2", []), (1, "u/d", "d0", []), (1, "u/e", "e0", [])],
    ]
    seen = []
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, PAGES)
        page_log.append_batch(df, path, number)
        page_log.append_batch(df, path, number)  # run again after a failure
        seen.append(log_rows(spark, path))
        if number == 2:
            before = {p.name for p in (tmp_path / "log" / "log").iterdir()}
            page_log.compact(spark, path)
            assert log_rows(spark, path) == seen[-1]
            assert before == {p.name for p in (tmp_path / "log" / "log").iterdir()}
    assert seen[0] == seen[1] == [(0, "u/a/", "a1"), (1, "u/b/", "b0")]
    assert seen[2] == [(0, "u/a/", "a1"), (1, "u/b", "b1"), (3, "u/c", "c0")]
    assert sorted(seen[3]) == [
        (0, "u/a/", "a2"), (1, "u/b", "b1"), (3, "u/c", "c0"), (6, "u/d", "d0"), (6, "u/e", "e0"),
    ]
    page_log.drop_merged(spark, path)
    assert [p.name for p in (tmp_path / "log" / "log").iterdir()] == ["batch=3"]
    assert sorted(log_rows(spark, path)) == sorted(seen[3])
    page_log.compact(spark, path)
    page_log.compact(spark, path)
    assert sorted(log_rows(spark, path)) == sorted(seen[3])
    with pytest.raises(ValueError, match="after batch"):
        page_log.append_batch(spark.createDataFrame(batches[0], PAGES), path, 1)


def test_a_batch_that_was_cut_off_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    page_log.append_batch(spark.createDataFrame([(0, "u/a", "a0", [])], PAGES), path, 0)
    with monkeypatch.context() as broken:
        broken.setattr(page_log, "write_state", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            page_log.append_batch(spark.createDataFrame([(0, "u/a", "a1", [])], PAGES), path, 1)
    assert log_rows(spark, path) == [(0, "u/a", "a0")]
    page_log.append_batch(spark.createDataFrame([(0, "u/a", "a2", [])], PAGES), path, 1)
    assert log_rows(spark, path) == [(0, "u/a", "a2")]


def test_in_sequence_blocks(spark):
    rows = [(k, i * 3, i % 5) for k in range(3) for i in range(40 * k + 1)]
    df = spark.createDataFrame(rows, "k int, i bigint, n bigint")
    for block in (1, 7, 1000):
        got = in_sequence(df, ["k"], "i", F.col("n"), block_size=block).collect()
        for r in got:
            before = [n for k, i, n in rows if k == r.k and i < r.i]
            assert (r.seq, r.start) == (len(before), sum(before))
            assert (r.prev.i if r.prev else None) == (r.i - 3 if before else None)
            last = r.i == 3 * 40 * r.k
            assert (r.next.i if r.next else None) == (None if last else r.i + 3)


@pytest.mark.parametrize("name", sorted(checks.ORACLE_SQL))
def test_registered_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "events", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, folder)
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    expected = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, expected))


def test_every_query_is_registered_with_sql():
    import __spark_entry__ as entry

    rows_only = set(entry.queries()) - set(entry.oracle_sql()) - set(entry.LLM_QUERIES)
    assert rows_only == set()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_package_works_without_the_training_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "corpusflow", tmp_path / "corpusflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    check = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", check], cwd=tmp_path, check=True)
    # A missing library is no missing part.
    if (root / "corpus_pipeline.py").exists():
        check = (
            "import sys; sys.modules['zstandard'] = None\n"
            "try:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    assert e.name == 'zstandard'\n"
            "else:\n    raise SystemExit('hidden')"
        )
        subprocess.run([sys.executable, "-c", check], cwd=root, check=True)


def test_python_gets_batches_bounded_by_bytes(spark):
    """Pages as JSON, chunks and texts to embed are long: 10,000 rows of them are too many at once."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(6_000, numPartitions=1).select(F.repeat(F.lit("x"), 2_500).alias("text"))
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 15_000_000 and max(found) < 5_000_000


def test_a_chat_works_out_its_packed_rows_once(spark, monkeypatch):
    """The rows that contexts and sources are made of are stored, and not packed again for each."""
    kept = []

    def stored(df):
        kept.append(df.columns)
        return lineage.stored(df)

    monkeypatch.setattr(pipelines, "stored", stored)
    catalog.chat_prompts(spark, "/root/testdata/sf0.001")
    assert [c for c in kept if "truncated" in c]
