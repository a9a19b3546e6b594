import pytest

from corpusflow.operators import pages

RAW = (
    "page_ord bigint, url string, source_url string, markdown string, "
    "metadata struct<title: string, source_url: string>"
)
PAGES = (
    "page_ord bigint, source_url string, title string, "
    "sections array<struct<section_title: string, text: string>>"
)


def sections(spark, markdown, **options):
    df = spark.createDataFrame([(0, "https://a.com/p", None, markdown, ("Meta", None))], RAW)
    row = pages.extract_sections(df, **options).first()
    return row.title, [(s.section_title, s.text) for s in row.sections]


@pytest.mark.parametrize(
    ("markdown", "title", "expected"),
    [
        ("just text", "Meta", [("", "just text.")]),
        ("# Top\nbody", "Top", [("", "Top body.")]),
        ("lost\n## A\none\n### B \ntwo\n#### C\nthree", "Meta",
         [("A", "one."), ("B", "two C three.")]),
        ("## Empty\n\n## Full\nx", "Meta", [("Full", "x.")]),
        ("", "Meta", []),
        (None, "Meta", []),
        ("## L\n- a\n- b\n1. c", "Meta", [("L", "a. b. c.")]),
    ],
)
def test_sections(spark, markdown, title, expected):
    assert sections(spark, markdown) == (title, expected)


def test_preamble_can_be_kept(spark):
    assert sections(spark, "first\n## A\none", keep_preamble=True)[1] == [
        ("", "first."), ("A", "one."),
    ]


def test_boilerplate_is_dropped_on_request(spark):
    markdown = (
        "## Cookies\nlong enough text about things\n## A\ntwo words\n"
        "## B\na@b c@d e@f g@h i@j k@l\n## C\nDette er en lang og nyttig tekst om stedet\n"
        "## D\nLes vår Personvernerklæring og mer om den her"
    )
    assert len(sections(spark, markdown)[1]) == 5
    assert [t for t, _ in sections(spark, markdown, keep_all=False)[1]] == ["C"]


def test_source_url_and_exclusion(spark):
    rows = [
        (0, "", "https://a.com/s", "x", ("", "https://a.com/m")),
        (1, None, None, "x", (None, "https://a.com/m")),
        (2, "https://a.com/Login", None, "x", (None, None)),
        (3, None, "", "x", None),
    ]
    found = pages.extract_sections(spark.createDataFrame(rows, RAW)).orderBy("page_ord").collect()
    assert [(r.page_ord, r.source_url, r.title) for r in found] == [
        (0, "https://a.com/s", None), (1, "https://a.com/m", None), (3, "", None),
    ]


def test_html_to_markdown(spark):
    html = (
        "<html><head><title> T &amp; U</title><style>p{}</style></head><body><!-- c -->"
        "<script>var a='<p>';</script><h1>One</h1><p>a<br>b</p><ul><li>x</li><li>y</li></ul>"
        "<h2 class='q'>Two</h2>c &lt;d&gt;</body></html>"
    )
    df = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    row = pages.pages_to_markdown(df).first()
    assert row.metadata.title == "T & U"
    assert row.markdown == "# One\n\na\nb\n\n- x\n\n- y\n\n## Two\n\nc <d>"


def test_crawl_plan(spark):
    urls = spark.createDataFrame(
        [(2, "https://a.com/c"), (0, "https://a.com/a/"), (1, "https://a.com/b")],
        "ord bigint, url string",
    )
    known = spark.createDataFrame([(0, "https://a.com/a", None, [])], PAGES)

    def plan(*args, **kwargs):
        return [(r.ord, r.url) for r in pages.plan_crawl(*args, **kwargs).orderBy("ord").collect()]

    assert plan(urls, known, "s") == [(1, "https://a.com/b"), (2, "https://a.com/c")]
    assert plan(urls, known, "s", limit=1) == [(1, "https://a.com/b")]
    assert len(plan(urls, known, "s", force=True)) == 3
    assert plan(urls.where("ord = 0"), known, "s") == [(None, "s")]


def test_special_pages(spark):
    df = spark.createDataFrame([("https://a.com/Events/",), ("https://a.com/x",)], "url string")
    with pytest.warns(UserWarning, match="invalid URL pattern"):
        tagged = pages.tag_special_pages(df, ["/events$", "(bad"])
    assert {r.url: r.needs_load_more for r in tagged.collect()} == {
        "https://a.com/Events/": True, "https://a.com/x": False,
    }


def test_best_attempt(spark):
    rows = [("a", 1, "xx"), ("a", 2, "yyy"), ("a", 3, "zzz"), ("b", 1, ""), ("b", 2, None)]
    df = spark.createDataFrame(rows, "url string, attempt int, markdown string")
    assert [tuple(r) for r in pages.best_attempt(df).collect()] == [("a", 2, "yyy")]


def test_upsert_keeps_positions_and_is_idempotent(spark):
    old = spark.createDataFrame(
        [(0, "u/a", "a0", []), (1, "u/b/", "b0", []), (2, "u/a/", "a1", [])], PAGES
    )
    new = spark.createDataFrame(
        [(0, "u/c", "c0", []), (1, "u/b", "b1", []), (2, "u/c/", "c1", [])], PAGES
    )
    merged = pages.upsert_pages(old, new)
    assert sorted((r.page_ord, r.url_key, r.title) for r in merged.collect()) == [
        (0, "u/a", "a1"), (1, "u/b", "b1"), (3, "u/c", "c1"),
    ]
    again = pages.upsert_pages(merged.drop("url_key"), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))


def test_page_stream_writes_its_parts_in_several_tasks(spark, tmp_path, monkeypatch):
    from corpusflow.plans import catalog

    rows = [(i, f"text {i}", "en", f"src{i % 7}", 6) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(catalog, "_new_folder", lambda spark: str(tmp_path))
    got = {r.url_key: r.text for r in catalog.upsert_page_stream(spark, str(tmp_path)).collect()}
    # The batch of numbers 3 mod 4 comes last.
    last = {}
    for i in sorted(range(200), key=lambda i: (i % 4, i)):
        last[f"https://src{i % 7}/en"] = f"text {i}"
    assert got == last
    assert len(list((tmp_path / "crawled").glob("part-*"))) > 4
    assert len(list((tmp_path / "state/commits").glob("[0-9]*"))) == 4


def test_stats_and_outcome(spark):
    df = spark.createDataFrame([(0, "u", None, [("a", "xyz"), ("b", "")]), (1, "v", None, [])], PAGES)
    assert tuple(pages.page_stats(df).first()) == (2, 2, 3)
    log = spark.createDataFrame([("u", "ok"), ("v", "ok"), ("w", "failed")], "url string, status string")
    assert {tuple(r) for r in pages.crawl_outcome(log).collect()} == {("ok", 2), ("failed", 1)}
