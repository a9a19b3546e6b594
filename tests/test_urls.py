import pytest

from corpusflow import config
from corpusflow.config import Site
from corpusflow.operators import urls
from corpusflow.plans.pipelines import discover_urls

SITE = Site("https://a.com", ("https://b.org",))


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "url string")


def values(df, column="url"):
    return sorted(r[column] for r in df.collect())


def test_locs_are_trimmed_and_typed(spark):
    body = (
        "<loc> https://a.com/x </loc><loc></loc><loc>https://a.com/sitemap-2</loc>"
        "<loc>rel.xml</loc><loc>ftp://a.com</loc>"
    )
    df = spark.createDataFrame([("s", body)], "sitemap_url string, body string")
    assert sorted((r.loc, r.kind) for r in urls.sitemap_locs(df).collect()) == [
        ("https://a.com/sitemap-2", "sitemap"), ("https://a.com/x", "url"), ("rel.xml", "sitemap"),
    ]


def test_sitemap_walk(spark):
    def body(*locs):
        return "".join(f"<loc>{loc}</loc>" for loc in locs)

    root = "https://a.com/sitemap.xml"
    rows = [
        (root, body("c1.xml", "https://a.com/0", root)),  # cycle
        ("c1.xml", body("c2.xml", "https://a.com/1")),
        ("c2.xml", body("c3.xml", "https://a.com/2", "https://a.com/1")),
        ("c3.xml", body("c4.xml", "https://a.com/3")),
        ("c4.xml", body("https://a.com/4")),  # depth 4: too deep ...
        ("https://a.com/wp-sitemap.xml", body("d.xml")),
        ("d.xml", body("c3.xml")),  # c3 at depth 2 here, so c4 is reached at depth 3
    ]
    maps = spark.createDataFrame(rows, "sitemap_url string, body string")
    found = values(urls.expand_sitemaps(table(spark, "https://a.com"), maps))
    assert found == [f"https://a.com/{i}" for i in range(5)]
    without = maps.where("sitemap_url <> 'd.xml'")
    assert values(urls.expand_sitemaps(table(spark, "https://a.com"), without)) == [
        f"https://a.com/{i}" for i in range(4)
    ]


def test_links_are_resolved(spark):
    html = (
        '<a href="/x">1</a><a class="c" href=\'https://o.no/y\'>2</a><a href="//z.no/q">3</a>'
        '<a href="#top">4</a><a href="mailto:a@b.no">5</a><a href="rel/p">6</a><a>7</a>'
    )
    df = spark.createDataFrame([("https://a.com/d/e?q", html)], "url string, html string")
    assert values(urls.page_links(df), "link") == [
        "https://a.com/d/rel/p", "https://a.com/x", "https://o.no/y", "https://z.no/q",
    ]


@pytest.mark.parametrize(
    "href,link",
    [
        ("c.html", "https://x.org/a/c.html"),
        ("./c", "https://x.org/a/c"),
        ("../c?d=../e", "https://x.org/c?d=../e"),
        ("../../../c", "https://x.org/c"),
        ("..", "https://x.org/"),
        (".", "https://x.org/a/"),
        ("/q/../r/./s", "https://x.org/r/s"),
        ("?p=2&amp;q=3", "https://x.org/a/b?p=2&q=3"),
        ("//y.org/z", "https://y.org/z"),
        ("HTTP://y.org", "HTTP://y.org"),
        ("#top", None),
        ("javascript:void(0)", None),
        ("", None),
    ],
)
def test_link_forms(spark, href, link):
    html = f'<a id=1 href="{href}">a</a>' + (f"<a href={href}>b</a>" if href else "")
    df = spark.createDataFrame([("https://x.org/a/b?u=1", html)], "url string, html string")
    assert {r.link for r in urls.page_links(df).collect()} == ({link} if link else set())


def test_links_follow_the_base_element(spark):
    html = '<base target="_top" href="/root/x/"><a href="c">a</a><abbr href="no">b</abbr>'
    df = spark.createDataFrame(
        [("https://x.org/a/b", html), ("https://x.org", '<a href="c">a</a>')], "url string, html string"
    )
    assert values(urls.page_links(df), "link") == ["https://x.org/c", "https://x.org/root/x/c"]


def test_normalisation(spark):
    df = urls.normalize_urls(
        table(spark, "HTTP://WWW.A.com/X/", "https://www.aXcom/", "https://a.com//"),
        SITE.allowed_domains,
    )
    assert {r.url: (r.normalized, r.canonical) for r in df.collect()} == {
        "HTTP://WWW.A.com/X/": ("https://a.com/X", "https://a.com/x"),
        "https://www.aXcom/": ("https://www.aXcom", "https://www.axcom"),
        "https://a.com//": ("https://a.com/", "https://a.com/"),
    }


@pytest.mark.parametrize(
    ("url", "discover", "crawl"),
    [
        ("https://a.com/feedback", True, True),
        ("https://a.com/WP-Admin/x", True, True),
        ("https://a.com/page-sitemap.xml/", True, False),
        ("https://a.com/sitemap/list", False, True),
        ("https://a.com/xml", False, True),
        ("https://a.com/news", False, False),
    ],
)
def test_system_urls(spark, url, discover, crawl):
    df = table(spark, url)
    assert (urls.exclude_system_urls(df).count() == 0) is discover
    assert (urls.exclude_system_urls(df, config.CRAWL_EXCLUSIONS).count() == 0) is crawl


def test_allowed_domains(spark):
    df = table(
        spark, "https://www.a.com/x", "https://a.com.evil/x", "https://sub.B.org/x",
        "https://b.org/Login/x", "https://b.org/Login/", "https://c.net",
    )
    assert values(urls.allow_domains(df, SITE)) == [
        "https://a.com.evil/x", "https://b.org/Login/", "https://sub.B.org/x",
        "https://www.a.com/x",
    ]
    assert "https://a.com.evil/x" not in values(urls.allow_domains(df, SITE, strict_host=True))
    assert values(urls.allow_domains(df, Site("https://c.net"))) == ["https://c.net"]


def test_variants(spark):
    df = table(
        spark, "x", "x-2", "y-2", "y-2-2", "q-2/", "Q", "z-duplicate", "z-duplicate-duplicate",
    )
    # y-2-2 stays: its base y-2 contains "-2".
    assert values(urls.drop_variant_urls(df)) == ["Q", "x", "y-2", "y-2-2"]


def test_discovery_end_to_end(spark):
    first = table(spark, "https://www.a.com/P/", "https://a.com/P", "https://a.com/p", "https://x.y")
    second = table(spark, "https://a.com/p-2", "https://a.com/login", "https://b.org/e/")
    found = discover_urls(first, second, site=SITE)
    assert [r.url for r in found.collect()] == ["https://a.com/P", "https://b.org/e"]
    before = urls.union_urls(first, second)
    assert urls.url_summary(before, found, SITE).first().asDict() == {
        "total": 7, "kept": 2, "excluded": 5, "excluded_by_pattern": 1,
        "excluded_by_domain": 1, "from_start": 1, "from_related": 1,
    }


def test_page_types(spark):
    df = table(spark, "https://a.com/Kontakt", "https://a.com/category/x", "https://a.com/HOTELL")
    found = {r.name: r.found for r in urls.page_type_coverage(df).collect()}
    assert found == {
        "Kontakt": True, "Om oss": False, "Åpningstider": False, "Priser": False,
        "Parkering": False, "Overnatting": True, "category": True, "archive": False,
        "tag": False,
    }
    assert not any(r.found for r in urls.page_type_coverage(df.where("false")).collect())
