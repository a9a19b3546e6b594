"""URL inventory: discover, normalise, filter and deduplicate page URLs.

URL tables are DataFrames with a ``url`` column. Rules that compare URLs are column
expressions; the only shuffles are the set operations (distinct, grouping by canonical
form, the variant check) and the joins of the sitemap walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.config import Site, UrlExclusions
from corpusflow.functions import text as t
from corpusflow.functions.lineage import cut_lineage, lookup


# -- column rules ----------------------------------------------------------------------


def strip_scheme(url: str) -> str:
    return url.split("://", 1)[1] if url.startswith(("http://", "https://")) else url


def normalized_url(url: Column, allowed_domains: tuple[str, ...]) -> Column:
    """Strip one trailing slash and fold ``www`` variants of the allowed domains."""
    url = t.drop_trailing_slash(url)
    for domain in allowed_domains:
        www = r"(?iu)\Ahttps?://www\." + t.literal(strip_scheme(domain))
        url = F.regexp_replace(url, www, domain.replace("\\", "\\\\").replace("$", "\\$"))
    return url


def canonical_url(url: Column, allowed_domains: tuple[str, ...]) -> Column:
    return F.lower(normalized_url(url, allowed_domains))


def _normalize_value(url: str, allowed_domains: tuple[str, ...]) -> str:
    """``normalized_url`` for a configured URL (plain string)."""
    url = url[:-1] if url.endswith("/") else url
    for domain in allowed_domains:
        for scheme in ("http://", "https://"):
            prefix = scheme + "www." + strip_scheme(domain)
            if url.lower().startswith(prefix.lower()):
                url = domain + url[len(prefix):]
    return url


def is_system_url(url: Column, rules: UrlExclusions) -> Column:
    lowered = F.lower(url)
    return t.contains_any(lowered, rules.contains) | t.any_of(
        F.endswith(lowered, F.lit(suffix)) for suffix in rules.ends_with
    )


def from_start_url(url: Column, site: Site, strict_host: bool = False) -> Column:
    start = _normalize_value(site.start_url, site.allowed_domains)
    normalized = normalized_url(url, site.allowed_domains)
    matches = F.startswith(normalized, F.lit(start))
    if strict_host:
        following = F.substring(normalized, len(start) + 1, 1)
        matches = matches & following.isin("", "/", "?", "#")
    return matches


def _mentions_related(normalized: Column, site: Site) -> Column:
    hosts = [
        strip_scheme(_normalize_value(domain.lower(), site.allowed_domains))
        for domain in site.related_domains
    ]
    return t.contains_any(normalized, hosts)


def from_related_domain(url: Column, site: Site) -> Column:
    """A URL of a related domain that is not one of its login or admin pages."""
    normalized = normalized_url(F.lower(url), site.allowed_domains)
    return _mentions_related(normalized, site) & ~t.contains_any(
        normalized, config.RELATED_EXCLUSIONS
    )


def is_allowed(url: Column, site: Site, strict_host: bool = False) -> Column:
    return from_start_url(url, site, strict_host) | from_related_domain(url, site)


# -- sitemaps --------------------------------------------------------------------------


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """Every ``<loc>`` of ``sitemaps(sitemap_url, body)`` as ``(sitemap_url, loc, kind)``.

    ``kind`` is ``sitemap`` for child sitemaps and ``url`` for pages; other values are
    dropped.
    """
    loc = F.col("loc")
    return (
        sitemaps.select(
            "sitemap_url",
            F.explode(
                F.regexp_extract_all("body", F.lit(r"<loc>(.*?)</loc>"), F.lit(1))
            ).alias("loc"),
        )
        .select("sitemap_url", t.trim_ws(t.replace_all(loc, ("</?loc>", ""))).alias("loc"))
        .where(loc != "")
        .withColumn(
            "kind",
            F.when(F.contains(loc, F.lit("sitemap")) | F.endswith(loc, F.lit(".xml")), "sitemap")
            .when(F.startswith(loc, F.lit("http")), "url"),
        )
        .where(F.col("kind").isNotNull())
    )


def expand_sitemaps(
    seeds: DataFrame, sitemaps: DataFrame, max_depth: int = config.SITEMAP_MAX_DEPTH
) -> DataFrame:
    """Distinct page URLs reachable from the well-known sitemaps of ``seeds(url)``.

    Breadth first, one equi-join per depth, each sitemap expanded at its least depth.
    (A depth-first walk that marks visited sitemaps can lose the children of a sitemap it
    first meets at the depth limit; this walk finds a superset of its URLs.)
    """
    children = cut_lineage(
        sitemap_locs(sitemaps).where("kind = 'sitemap'").select("sitemap_url", "loc").distinct()
    )
    frontier = cut_lineage(
        seeds.select(
            F.explode(
                F.array(*[F.concat("url", F.lit(path)) for path in config.WELL_KNOWN_SITEMAPS])
            ).alias("sitemap_url")
        ).distinct()
    )
    visited = frontier
    for _ in range(max_depth):
        frontier = cut_lineage(
            children.join(frontier, "sitemap_url", "left_semi")
            .select(F.col("loc").alias("sitemap_url"))
            .distinct()
            .join(visited, "sitemap_url", "left_anti")
        )
        visited = visited.union(frontier)
    reached = sitemaps.join(visited, "sitemap_url", "left_semi")
    return (
        sitemap_locs(reached).where("kind = 'url'").select(F.col("loc").alias("url")).distinct()
    )


# -- links, filters, dedup -------------------------------------------------------------

# Entities decoded in link targets; the ampersand comes last.
_LINK_ENTITIES = (
    ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"),
    ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"),
)


def page_links(pages: DataFrame) -> DataFrame:
    """Outgoing links of ``pages(url, html)`` as ``(url, link)``, one row per anchor.

    Targets may be quoted or not; entities in them are decoded. Relative ones are resolved
    against the page's own path, or the page's ``<base>``, with ``.`` and ``..`` folded.
    Fragments, empty, script and mail targets are no pages and are dropped.
    """
    attribute = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
    hrefs = F.regexp_extract_all("html", F.lit(rf"(?i)<a\s(?:[^>]*?\s)?href{attribute}"), F.lit(1))
    base = _target(F.regexp_extract("html", rf"(?i)<base\s(?:[^>]*?\s)?href{attribute}", 1))
    start = t.let(
        base, lambda b: F.when(b == "", F.col("url")).otherwise(_resolved(b, F.col("url")))
    )
    # Everything is bound once per page or target, and the rows begin with the finished links.
    links = t.let(
        start,
        lambda b: F.transform(hrefs, lambda href: t.let(_target(href), lambda h: _resolved(h, b))),
    )
    return pages.select("url", F.explode(links).alias("link")).where(F.col("link").isNotNull())


def _target(attribute: Column) -> Column:
    """Value of an attribute, without its quotes and with its entities decoded."""
    value = t.trim_ws(F.regexp_replace(attribute, r"""\A["']|["']\z""", ""))
    for entity, character in _LINK_ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(character))
    return value


def _resolved(href: Column, base: Column) -> Column:
    """``href`` as an absolute address, NULL where it is no page."""
    origin = F.regexp_extract(base, r"\A(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"\Ahttps?://[^/?#]+([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    rooted = F.when(F.startswith(href, F.lit("/")), href).otherwise(F.concat(folder, href))
    return (
        F.when(href.rlike(r"(?i)\Ahttps?://"), href)
        .when(
            F.startswith(href, F.lit("//")),
            F.concat(F.regexp_extract(base, r"\A(https?:)", 1), href),
        )
        .when((href == "") | href.rlike(r"(?i)\A(#|[a-z][a-z0-9+.-]*:)"), None)
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .otherwise(F.concat(origin, _folded(rooted)))
    )


def _folded(target: Column) -> Column:
    """A rooted path with ``.`` and ``..`` taken out; query and fragment stay."""
    return t.let(target, _folded_path)


def _folded_path(target: Column) -> Column:
    path = F.regexp_extract(target, r"\A[^?#]*", 0)
    rest = F.substr(target, F.length(path) + 1)

    def fold(kept: Column, part: Column) -> Column:
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(part == "..", shorter)
            .when(part == ".", kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    folded = F.aggregate(parts, F.array().cast("array<string>"), fold)
    # A path that ends with a dot segment names a folder.
    end = F.when(path.rlike(r"/\.\.?\z") & (F.size(folded) > 0), "/").otherwise("")
    plain = F.concat(F.lit("/"), F.array_join(folded, "/"), end, rest)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), plain).otherwise(target)


def normalize_urls(urls: DataFrame, allowed_domains: tuple[str, ...]) -> DataFrame:
    """Add ``normalized`` and ``canonical`` forms."""
    return urls.withColumns(
        {
            "normalized": normalized_url(F.col("url"), allowed_domains),
            "canonical": canonical_url(F.col("url"), allowed_domains),
        }
    )


def exclude_system_urls(
    urls: DataFrame, rules: UrlExclusions = config.DISCOVER_EXCLUSIONS
) -> DataFrame:
    """Drop admin, login, feed and sitemap URLs. Substring rules: ``/feedback`` goes too."""
    return urls.where(~is_system_url(F.col("url"), rules))


def allow_domains(urls: DataFrame, site: Site, strict_host: bool = False) -> DataFrame:
    """Keep URLs of the start URL or of a related domain.

    The start-URL test is a plain prefix test (``https://a.com.evil`` passes for
    ``https://a.com``); ``strict_host`` asks for a boundary after the prefix.
    """
    return urls.where(is_allowed(F.col("url"), site, strict_host))


def dedup_urls(urls: DataFrame, allowed_domains: tuple[str, ...]) -> DataFrame:
    """One normalised URL per canonical form, the first in sorted order."""
    normalized = normalize_urls(urls, allowed_domains)
    return normalized.groupBy("canonical").agg(F.min("normalized").alias("url"))


def drop_variant_urls(urls: DataFrame) -> DataFrame:
    """Drop ``-duplicate`` URLs, and ``-2`` URLs whose base exists.

    A base that itself contains ``-2`` does not count. Only ``-2`` rows enter the join;
    all other rows stream past it.
    """
    lowered = F.lower("url")
    candidates = urls.where(~F.contains(lowered, F.lit("-duplicate")))
    ends_in_2 = lowered.rlike(r"-2/?\z")
    bases = (
        urls.where(~F.contains(lowered, F.lit("-2")))
        .select(t.drop_trailing_slash(lowered).alias("_base"))
        .distinct()
        .withColumn("_exists", F.lit(True))
    )
    numbered = candidates.where(ends_in_2).withColumn(
        "_base", F.regexp_replace(lowered, r"-2/?\z", "")
    )
    numbered = (
        lookup(numbered, bases, "_base")
        .where(F.col("_exists").isNull())
        .select(*urls.columns)
    )
    return candidates.where(~ends_in_2).unionByName(numbered)


def union_urls(*sources: DataFrame) -> DataFrame:
    """Set union of URL tables."""
    return reduce(DataFrame.unionByName, [df.select("url") for df in sources]).distinct()


# -- summaries -------------------------------------------------------------------------


def url_summary(
    before: DataFrame,
    after: DataFrame,
    site: Site,
    rules: UrlExclusions = config.DISCOVER_EXCLUSIONS,
) -> DataFrame:
    """One row of counts for a discovery run, both tables in one aggregate."""
    url = F.col("url")
    is_before = F.col("_side") == 0
    is_after = F.col("_side") == 1
    system = is_system_url(url, rules)
    normalized = normalized_url(url, site.allowed_domains)
    both = before.select("url", F.lit(0).alias("_side")).unionByName(
        after.select("url", F.lit(1).alias("_side"))
    )
    return both.agg(
        F.count_if(is_before).alias("total"),
        F.count_if(is_after).alias("kept"),
        (F.count_if(is_before) - F.count_if(is_after)).alias("excluded"),
        F.count_if(is_before & system).alias("excluded_by_pattern"),
        F.count_if(is_before & ~system & ~is_allowed(url, site)).alias("excluded_by_domain"),
        F.count_if(is_after & from_start_url(url, site)).alias("from_start"),
        F.count_if(is_after & _mentions_related(normalized, site)).alias("from_related"),
    )


def page_type_coverage(
    urls: DataFrame,
    page_types: dict[str, tuple[str, ...]] | None = None,
    listing_types: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """``(kind, name, found)`` per expected page type and per listing type.

    One partial aggregate over the URLs, then the single result row is unpivoted.
    """
    lowered = F.lower("url")
    groups = {
        "page_type": config.PAGE_TYPES if page_types is None else page_types,
        "listing": config.LISTING_TYPES if listing_types is None else listing_types,
    }
    flags = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(name).alias("name"),
            F.coalesce(F.bool_or(t.contains_any(lowered, needles)), F.lit(False)).alias("found"),
        )
        for kind, types in groups.items()
        for name, needles in types.items()
    ]
    return urls.agg(F.array(*flags).alias("flags")).select(F.inline("flags"))
