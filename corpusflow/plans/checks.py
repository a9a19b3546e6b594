"""The registered queries as ANSI SQL, written from the operators' definitions.

The statements share building blocks (as CTE text) but no code with the operators.
"""

from __future__ import annotations

from corpusflow import config
from corpusflow.config import ChunkRules, ChunkSizes
from corpusflow.plans import catalog as c


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_contains(expression: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expression}, {_quote(n)})" for n in needles) + ")"


def _any_ends(expression: str, needles) -> str:
    return "(" + " OR ".join(f"ends_with({expression}, {_quote(n)})" for n in needles) + ")"


def _count_contains(needles, *expressions: str) -> str:
    return " + ".join(
        "(" + " OR ".join(f"contains({e}, {_quote(n)})" for e in expressions) + ")::INT"
        for n in needles
    )


def _any_word(words) -> str:
    return "(?i)" + "|".join(word.replace(".", r"\.") for word in words)


def _replace(expression: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        expression = (
            f"regexp_replace({expression}, {_quote(pattern)}, {_quote(replacement)}, 'g')"
        )
    return expression


def _plain(expression: str, *rules: tuple[str, str]) -> str:
    for old, new in rules:
        expression = f"replace({expression}, {_quote(old)}, {_quote(new)})"
    return expression


def _words(expression: str) -> str:
    return f"len(regexp_extract_all({expression}, '\\S+'))"


def _tokens(expression: str) -> str:
    return f"ceil(length({expression}) * 0.25)::BIGINT"


def _truncate(text: str, tokens: str) -> str:
    """Cut ``text`` to ``tokens``; written with one list lambda for the cut-off head."""
    limit = f"(({tokens}) * 4)::BIGINT"
    last = "CASE WHEN contains(h, '{0}') THEN length(h) - strpos(reverse(h), '{0}') ELSE -1 END"
    sentence = "greatest(" + ", ".join(last.format(m) for m in ".!?") + ")"
    space = last.format(" ")
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE "
        f"list_transform([substr({text}, 1, {limit})], lambda h: "
        f"CASE WHEN {sentence} > {limit} * 0.7::DOUBLE THEN substr(h, 1, {sentence} + 1) "
        f"WHEN {space} > {limit} * 0.8::DOUBLE THEN substr(h, 1, {space}) || '...' "
        f"ELSE h || '...' END)[1] END"
    )


# -- URLs ------------------------------------------------------------------------------

_LINKS = r"""
hrefs AS (
  SELECT url, trim(unnest(regexp_extract_all(
    html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1))) AS href
  FROM pages),
resolved AS (
  SELECT url, CASE
    WHEN regexp_matches(href, '^(?i)https?://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
    WHEN href = '' OR regexp_matches(href, '^(?i)(#|[a-z][a-z0-9+.-]*:)') THEN NULL
    ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || href END AS link
  FROM hrefs),
page_links AS (SELECT url, link FROM resolved WHERE link IS NOT NULL),
all_urls AS (SELECT url FROM pages UNION ALL SELECT link FROM page_links)
"""

_SITEMAPS = """
sitemaps AS (
  SELECT page_id, 'https://site' || page_id || '.example/sitemap.xml' AS sitemap_url,
    [trim(' ' || url || ' '), '', 'ftp://x',
     'https://site' || (page_id + 1) || '.example/sitemap.xml',
     'https://site' || (page_id * 3) || '.example/sitemap.xml'] AS entries
  FROM pages),
locs AS (
  SELECT sitemap_url, loc, CASE
    WHEN contains(loc, 'sitemap') OR ends_with(loc, '.xml') THEN 'sitemap'
    WHEN starts_with(loc, 'http') THEN 'url' END AS kind
  FROM (SELECT sitemap_url, unnest(entries) AS loc FROM sitemaps) WHERE loc <> '')
"""

_VARIANTS = """
stems AS (
  SELECT url AS page, regexp_replace(url, '[?#].*$', '') AS base,
    regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS stem FROM pages),
variants AS (
  SELECT base AS url FROM stems WHERE contains(page, '/en/')
  UNION ALL SELECT stem || '-2' FROM stems
  UNION ALL SELECT stem || '-2/' FROM stems WHERE contains(page, '/fr/')
  UNION ALL SELECT stem || '-2-2' FROM stems WHERE contains(page, '/de/')
  UNION ALL SELECT stem || '-duplicate' FROM stems WHERE contains(page, '/es/'))
"""


def _host(url: str) -> str:
    return url.split("://", 1)[1]


def _normalized(expression: str) -> str:
    expression = f"regexp_replace({expression}, '/$', '')"
    for domain in c.SITE.allowed_domains:
        pattern = r"^(?i)https?://www\." + _host(domain).replace(".", r"\.")
        expression = f"regexp_replace({expression}, {_quote(pattern)}, {_quote(domain)})"
    return expression


# Parts and ends of system URLs.
_SYSTEM_PARTS = ("/wp-admin", "/wp-login", "/wp-content", "/wp-includes", "/wp-json",
                 "/login", "/admin", "/feed", "/rss")
_SYSTEM_ENDS = ("sitemap.xml", "sitemap.xml/", "sitemap_index.xml", "sitemap_index.xml/",
                "wp-sitemap.xml", "wp-sitemap.xml/", "page-sitemap.xml", "page-sitemap.xml/")
_CRAWL_PARTS = ("/login", "/admin", "/wp-admin", "/wp-login", "/wp-content", "/wp-includes",
                "/wp-json", "/feed", "/xml", "/rss", "/sitemap")


def _system(expression: str) -> str:
    low = f"lower({expression})"
    return f"({_any_contains(low, _SYSTEM_PARTS)} OR {_any_ends(low, _SYSTEM_ENDS)})"


def _from_start(expression: str) -> str:
    return f"starts_with({_normalized(expression)}, {_quote(c.SITE.start_url)})"


def _allowed(expression: str) -> str:
    normalized = _normalized(f"lower({expression})")
    related = _any_contains(normalized, [_host(d) for d in c.SITE.related_domains])
    blocked = _any_contains(normalized, ("/logg-inn/", "/login/", "/admin/"))
    return f"({_from_start(expression)} OR ({related} AND NOT {blocked}))"


_VARIANT_RULE = r"""
  NOT contains(lower(u.url), '-duplicate') AND NOT (
    regexp_matches(lower(u.url), '-2/?$') AND regexp_replace(lower(u.url), '-2/?$', '') IN (
      SELECT regexp_replace(lower(url), '/$', '') FROM {table}
      WHERE NOT contains(lower(url), '-2')))
"""

_DISCOVER = f"""{_LINKS},
found AS (SELECT DISTINCT url FROM all_urls),
unique_urls AS (
  SELECT min({_normalized('url')}) AS url FROM found
  WHERE NOT {_system('url')} AND {_allowed('url')}
  GROUP BY lower({_normalized('url')})),
discovered AS (SELECT url FROM unique_urls u WHERE {_VARIANT_RULE.format(table='unique_urls')})
"""


def _types_sql() -> str:
    rows = []
    for kind, types in (("page_type", c.PAGE_TYPES), ("listing", c.LISTING_TYPES)):
        for name, needles in types.items():
            found = f"coalesce(bool_or({_any_contains('lower(url)', needles)}), false)"
            rows.append(
                f"SELECT {_quote(kind)} AS kind, {_quote(name)} AS name, {found} AS found "
                "FROM all_urls"
            )
    return f"WITH {_LINKS} " + " UNION ALL ".join(rows)


# -- sections and chunks ---------------------------------------------------------------

_CLEAN_RULES = (
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"\(https?://[^\s)]+\)", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", r"\1"),
    (r"\*([^*]+)\*", r"\1"),
    (r"__([^_]+)__", r"\1"),
    (r"_([^_]+)_", r"\1"),
    (r"`[^`]+`", ""),
    (r"(?m)^>\s+", ""),
    (r"(?m)^[-*]{3,}$", ""),
    (r"(?m)^[-*+]\s+", ""),
    (r"(?m)^[0-9]+\.\s+", ""),
    (r"\s+", " "),
)


def _clean(expression: str) -> str:
    """Section cleaning; the data has no brackets, so that look-ahead rule is left out."""
    expression = _replace(expression, (r"<[^>]+>", ""))
    expression = _plain(
        expression, ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    )
    expression = f"trim({_replace(expression, *_CLEAN_RULES)})"
    return _replace(expression, (r" +([.!?] )", r"\1"))


def _worth_keeping(phrases) -> str:
    phrase = _any_contains("lower(text)", phrases) if phrases else "false"
    return (
        "length(text) >= 10 AND regexp_matches(text, '[a-zA-ZæøåÆØÅ]') "
        f"AND NOT (length(text) < 50 AND {phrase})"
    )


def _line_sections(phrases) -> str:
    return f"""
lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
cleaned AS (
  SELECT doc_id AS page_ord, source AS source_url, lang AS title,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT - 1 AS section_index,
    'Part ' || pos AS section_title, text
  FROM (SELECT doc_id, source, lang, pos, {_clean('line')} AS text FROM lines)
  WHERE {_worth_keeping(phrases)})
"""


# Chunk fold as a recursion over sentences. A chunk is a run of sentences, so the state is
# how many sentences lie before it; token, word and marker counts are prefix sums.
def _fold(_S: ChunkSizes) -> str:
    return f"""
sections AS (
  SELECT doc_id, source, lang, {_clean('text')} AS text FROM documents),
kept_sections AS (
  SELECT * FROM sections WHERE {_worth_keeping(("annonsørinnhold", "se annonsering",
      "utviklet av", "administrer samtykke", "administrer personvernet"))}
    AND length(text) >= 50),
pieces AS (
  SELECT doc_id, list_filter(string_split(
    regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p
  FROM kept_sections),
sentences AS (
  SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i, len(p) AS n FROM pieces),
sums AS (
  SELECT doc_id, i, n, s,
    sum(ceil({_words('s')} * 1.3::DOUBLE)::BIGINT) OVER w AS cum,
    sum({_words('s')}) OVER w AS words,
    sum((regexp_matches(s, '[0-9]')
         OR regexp_matches(s, {_quote(_any_word(_S.valuable_words))}))::INT) OVER w AS marks
  FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
prefix AS (
  SELECT doc_id, i, cum, words, marks FROM sums
  UNION ALL SELECT DISTINCT doc_id, 0, 0, 0, 0 FROM sums),
overlap_of AS (
  SELECT a.doc_id, a.i, min(b.i) AS lo FROM prefix a JOIN prefix b
    ON a.doc_id = b.doc_id AND b.i <= a.i AND a.cum - b.cum <= {_S.overlap_tokens}
  GROUP BY ALL),
steps AS (
  SELECT s.doc_id, s.i, s.n, s.cum, s.words, s.marks,
    p.cum AS prev_cum, p.words AS prev_words, p.marks AS prev_marks,
    x.cum AS next_cum,
    oa.lo AS before_lo, oa_p.cum AS before_cum, oa_p.words AS before_words,
    oa_p.marks AS before_marks,
    ob.lo AS after_lo, ob_p.cum AS after_cum, ob_p.words AS after_words,
    ob_p.marks AS after_marks
  FROM sums s
  JOIN prefix p ON p.doc_id = s.doc_id AND p.i = s.i - 1
  LEFT JOIN prefix x ON x.doc_id = s.doc_id AND x.i = s.i + 1
  JOIN overlap_of oa ON oa.doc_id = s.doc_id AND oa.i = s.i - 1
  JOIN prefix oa_p ON oa_p.doc_id = s.doc_id AND oa_p.i = oa.lo
  JOIN overlap_of ob ON ob.doc_id = s.doc_id AND ob.i = s.i
  JOIN prefix ob_p ON ob_p.doc_id = s.doc_id AND ob_p.i = ob.lo),
fold AS (
  SELECT doc_id, 0 AS i, 0 AS lo, 0::HUGEINT AS lo_cum, 0::HUGEINT AS lo_words,
    0::HUGEINT AS lo_marks, 0 AS emitted, NULL::INT AS a_lo, NULL::INT AS a_hi,
    NULL::INT AS c_lo, NULL::INT AS c_hi
  FROM (SELECT DISTINCT doc_id FROM sums)
  UNION ALL
  SELECT doc_id, i,
    CASE WHEN cut_after THEN greatest(lo, after_lo) ELSE lo END,
    CASE WHEN cut_after AND after_lo > lo THEN after_cum ELSE lo_cum END,
    CASE WHEN cut_after AND after_lo > lo THEN after_words ELSE lo_words END,
    CASE WHEN cut_after AND after_lo > lo THEN after_marks ELSE lo_marks END,
    emitted + (a_hi IS NOT NULL)::INT + cut_after::INT,
    a_lo, a_hi,
    CASE WHEN cut_after THEN lo END, CASE WHEN cut_after THEN i END
  FROM (
    SELECT *, i < n AND cum - lo_cum BETWEEN {_S.min_tokens} AND {_S.max_tokens}
        AND next_cum - lo_cum > {_S.max_tokens} AS cut_after
    FROM (
      SELECT doc_id, i, n, cum, next_cum, after_lo, after_cum, after_words, after_marks,
        emitted,
        CASE WHEN over THEN greatest(lo, before_lo) ELSE lo END AS lo,
        CASE WHEN over AND before_lo > lo THEN before_cum ELSE lo_cum END AS lo_cum,
        CASE WHEN over AND before_lo > lo THEN before_words ELSE lo_words END AS lo_words,
        CASE WHEN over AND before_lo > lo THEN before_marks ELSE lo_marks END AS lo_marks,
        CASE WHEN over AND good THEN lo END AS a_lo,
        CASE WHEN over AND good THEN i - 1 END AS a_hi
      FROM (
        SELECT f.lo, f.lo_cum, f.lo_words, f.lo_marks, f.emitted, s.*,
          s.i - 1 > f.lo AND s.cum - f.lo_cum > {_S.max_tokens} AS over,
          ceil((s.prev_words - f.lo_words) * 1.3::DOUBLE) >= {_S.min_tokens}
            OR (ceil((s.prev_words - f.lo_words) * 1.3::DOUBLE) >= {_S.valuable_min_tokens}
                AND s.prev_marks > f.lo_marks) AS good
        FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.i = f.i + 1)))),
runs AS (
  SELECT doc_id, a_lo AS lo, a_hi AS hi FROM fold WHERE a_hi IS NOT NULL
  UNION ALL SELECT doc_id, c_lo, c_hi FROM fold WHERE c_hi IS NOT NULL
  UNION ALL
  SELECT f.doc_id, f.lo, f.i FROM fold f JOIN sums s ON s.doc_id = f.doc_id AND s.i = f.i
  WHERE f.i = s.n AND f.lo < f.i AND (f.emitted = 0
    OR ceil((s.words - f.lo_words) * 1.3::DOUBLE) >= {_S.min_tokens}
    OR (ceil((s.words - f.lo_words) * 1.3::DOUBLE) >= {_S.valuable_min_tokens}
        AND s.marks > f.lo_marks))),
made AS (
  SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.hi, r.lo)::INT - 1
      AS chunk_index,
    string_agg(s.s, ' ' ORDER BY s.i) AS content
  FROM runs r JOIN sentences s ON s.doc_id = r.doc_id AND s.i > r.lo AND s.i <= r.hi
  GROUP BY r.doc_id, r.lo, r.hi),
chunks AS (
  SELECT substr(lower(regexp_replace(d.source, '[^a-zA-Z0-9]', '-', 'g')), 1, 30)
      || '-untitled-0-' || m.chunk_index AS id,
    m.content, d.source AS source_url, d.lang AS title, '' AS section, m.chunk_index,
    m.doc_id AS page_ord, 0 AS section_index
  FROM made m JOIN documents d ON d.doc_id = m.doc_id)
"""


_FOLD = _fold(c.SIZES)

_LINE_CHUNKS = """
chunks AS (
  SELECT unnest(string_split(text, chr(10))) AS content, source AS source_url, lang AS title,
    source AS section, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS chunk_index,
    doc_id AS page_ord, 0 AS section_index FROM documents)
"""


def _classified(_R: ChunkRules = c.RULES) -> str:
    def has_value(words) -> str:
        return (
            "(regexp_matches(content, '[0-9]') OR "
            f"regexp_matches(content, {_quote(_any_word(words))}))"
        )

    hits = _count_contains(_R.navigation_keywords, "lower(content)", "lower(section)")
    leads = " OR ".join(f"starts_with(lower(content), {_quote(x)})" for x in _R.navigation_leads)
    consent = " OR ".join(
        _any_contains(f"lower({column})", _R.consent_keywords)
        for column in ("content", "section", "title")
    )
    endings = _any_ends("trim(content)", _R.fragment_endings)
    return f"""
classified AS (
  SELECT *, CASE
    WHEN (length(content) < 50 AND {_any_contains('lower(content)', _R.navigation_phrases)})
      OR (NOT {has_value(_R.valuable_in_navigation)} AND (({hits}) >= 3
        OR (({hits}) >= 2 AND length(content) < 50)
        OR (({leads}) AND length(content) < 50))) THEN 'navigation/UI'
    WHEN ({consent}) AND NOT ({has_value(_R.valuable_in_consent)} AND length(content) > 100)
      THEN 'consent/legal'
    WHEN {_words('content')} < {_R.min_words} THEN 'too short'
    WHEN (ends_with(trim(content), '.') AND length(trim(content)) < 50
        AND length(trim(content)) - length(replace(trim(content), '.', '')) = 1)
      OR {endings} OR contains(content, '[]') OR contains(content, '[ ]')
      OR (len(fragments) > 5 AND len(list_filter(fragments, lambda f: length(f) >= 20)) = 0)
      THEN 'fragmented language'
    WHEN NOT (length(trim(content)) > 50 OR regexp_matches(content, '(?i)[a-zæøå]{{4,}}')
      OR regexp_matches(content, '[0-9]')) THEN 'low quality' END AS reason
  FROM (SELECT *, list_filter(list_transform(
      string_split_regex(trim(content), '[.!?]+'), lambda f: trim(f)), lambda f: f <> '')
      AS fragments FROM chunks)),
normed AS (
  SELECT *, (page_ord, section_index, chunk_index) AS ord,
    regexp_replace(regexp_replace(trim(lower(content)), '\\s+', ' ', 'g'), '[.,!?;:]', '', 'g')
      AS norm
  FROM classified),
tagged AS (
  SELECT * EXCLUDE (reason), CASE
    WHEN (reason IS NULL OR reason = 'low quality') AND first_ord < ord THEN 'duplicate'
    ELSE reason END AS reason
  FROM (SELECT *, min(CASE WHEN reason IS NULL THEN ord END) OVER (
      PARTITION BY norm) AS first_ord FROM normed))
"""


# -- raw pages -------------------------------------------------------------------------

_RAW_PAGES = """
raw AS (
  SELECT doc_id, source, 'https://' || source || '/' || doc_id AS source_url,
    string_split('# ' || source || chr(10) || chr(10) || replace(text, chr(10),
      chr(10) || '## About it' || chr(10) || '- item' || chr(10) || '1. first step!' || chr(10)
    ), chr(10) || '## About it') AS parts
  FROM documents),
bodies AS (
  SELECT doc_id, source, source_url, unnest(parts) AS body,
    generate_subscripts(parts, 1) AS pos, len(parts) AS n FROM raw)
"""
_EMPHASIS = (
    (r"\*\*([^*]+)\*\*", r"\1"),
    (r"\*([^*]+)\*", r"\1"),
    (r"__([^_]+)__", r"\1"),
    (r"_([^_]+)_", r"\1"),
    (r"(?m)^---$", ""),
    (r"(?m)^\*\*\*$", ""),
    (r"(?m)^>\s+", ""),
    (r"\s+", " "),
)
_PLAIN_RULES = (
    (r"`[^`]+`", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (r"(?m)^#{1,6}\s+", ""),
)
_PAGE_RULES = (
    (r"https?://[^\s)]+", ""),
    (r"www\.\S+", ""),
    *_PLAIN_RULES[2:3],
    (r"`[^`]+`", ""),
    *_EMPHASIS[:4],
    (r"(?m)^#{1,6}\s+", ""),
    *_EMPHASIS[4:],
)


def _page_text(body: str) -> str:
    """CTEs from ``bodies`` (with column ``body``) to ``texts`` (with column ``text``)."""
    bullet, number = r"(?m)^[-*+]\s+(.+)$", r"(?m)^[0-9]+\.\s+(.+)$"
    rest = _replace("plain", (bullet, ""))
    items = (
        f"list_concat(regexp_extract_all(plain, {_quote(bullet)}, 1), "
        f"regexp_extract_all({rest}, {_quote(number)}, 1))"
    )
    final = "CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END"
    blank = r"^\s+|\s+$"
    return f"""
plain AS (SELECT * EXCLUDE (body), {_replace(body, *_PLAIN_RULES)} AS plain FROM bodies),
listed AS (
  SELECT * EXCLUDE (plain), {rest} AS rest, list_filter(list_transform({items},
    lambda x: trim(x)), lambda x: x <> '') AS items, len({items}) AS n_items FROM plain),
joined AS (
  SELECT * EXCLUDE (rest, items, n_items), CASE WHEN n_items > 0 THEN
    {_replace('rest', (number, ''), (blank, ''))} || ' ' || array_to_string(
      list_transform(items, lambda t: {final}), ' ')
    ELSE rest END AS joined FROM listed),
flat AS (
  SELECT * EXCLUDE (joined), trim({_replace('joined', *_EMPHASIS)}) AS t FROM joined),
texts AS (
  SELECT * EXCLUDE (t), trim({_replace(f'({final})', *_PAGE_RULES)}) AS text FROM flat)
"""


_MARKDOWN_RULES = (
    *[(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
      for tag in ("script", "style", "noscript", "head")],
    (r"(?s)<!--.*?-->", ""),
    *[(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n\n" + "#" * n + " \\1\n\n")
      for n in range(1, 7)],
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|figure|footer|form|header|"
     r"html|main|nav|ol|p|pre|section|table|td|th|tr|ul|br|li)\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
)
_PAGE_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)


def _markdown() -> str:
    blank = r"^\s+|\s+$"
    body = _replace(
        _plain(_replace("html", *_MARKDOWN_RULES), *_PAGE_ENTITIES),
        (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n"), (blank, ""),
    )
    title = _plain(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", *_PAGE_ENTITIES)
    return f"""
markdown AS (SELECT page_id AS page_ord, url, {body} AS markdown,
  {_replace(title, (blank, ''))} AS title FROM pages)
"""


def _boilerplate(kind: str) -> str:
    """Condition that a section of ``texts`` is boilerplate."""
    patterns = c.BOILERPLATE_TEXT if kind == "text" else c.BOILERPLATE_TITLE
    joined = _quote("(?i)(?:" + "|".join(patterns) + ")")
    if kind == "title":
        return f"(title <> '' AND regexp_matches(lower(title), {joined}))"
    return f"""(length(text) < 10 OR ({_words('text')} <= 2 AND length(text) < 30)
      OR len(regexp_extract_all(text, 'https?://|@|www\\.')) > length(text) / 20
      OR regexp_matches(text, {joined}))"""


def _sections_sql(keep_all: bool) -> str:
    texts = _page_text("body")
    drop = (
        "" if keep_all
        else f"AND NOT {_boilerplate('title')} AND NOT {_boilerplate('text')}"
    )
    # The title is the section title: every section but a lone first part has one.
    return f"""
WITH {_RAW_PAGES}, {texts},
kept AS (
  SELECT * FROM (SELECT *, CASE WHEN n = 1 THEN '' ELSE 'About it' END AS title FROM texts)
  WHERE (n = 1 OR pos > 1) AND text <> '' {drop})
SELECT r.doc_id AS page_ord, r.source_url, r.source AS title,
  count(k.doc_id)::INT AS n_sections,
  coalesce(string_agg(k.title || '|' || k.text, chr(10) ORDER BY k.pos), '') AS sections
FROM raw r LEFT JOIN kept k ON k.doc_id = r.doc_id GROUP BY ALL
"""


# -- retrieval -------------------------------------------------------------------------


def _scored(name: str, docs: str, k: int, threshold: float) -> str:
    return f"""
{name} AS (
  SELECT query_id, id, sim,
    row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank
  FROM (
    SELECT q.vec_id AS query_id, d.id,
      list_cosine_similarity(d.embedding, q.embedding::DOUBLE[]) AS sim
    FROM embeddings q CROSS JOIN {docs} d)
  WHERE sim > {threshold} QUALIFY rank <= {k})
"""


_INDEX = """
doc_index AS (
  SELECT d.doc_id AS id, d.text AS content, d.source AS source_url, d.lang AS title,
    e.embedding::DOUBLE[] AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
asked AS (SELECT vec_id AS query_id, 'Question about group ' || label AS question
  FROM embeddings)
"""
_MATCHES = f"""{_INDEX}, {_scored('top', 'doc_index', c.K, c.THRESHOLD)},
matches AS (
  SELECT t.query_id, t.rank, t.id, d.content, d.source_url, d.title, '' AS section, t.sim
  FROM top t JOIN doc_index d ON d.id = t.id)
"""
# Cells are labels: mean vectors, every vector in the most similar cell, queries in the best ones.
_CELLS = f"""
components AS (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
centroids AS (
  SELECT label AS cell, list(mean ORDER BY pos) AS centroid
  FROM (SELECT label, pos, avg(x) AS mean FROM components GROUP BY label, pos) GROUP BY label),
near AS (
  SELECT e.vec_id, c.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY
    list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) DESC, c.cell) AS place
  FROM embeddings e CROSS JOIN centroids c),
stored AS (
  SELECT e.vec_id AS id, n.cell, e.embedding::DOUBLE[] AS embedding
  FROM embeddings e JOIN near n ON n.vec_id = e.vec_id AND n.place = 1)
"""


def _top(name: str, condition: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, id, sim,
    row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank
  FROM (
    SELECT q.vec_id AS query_id, d.id,
      list_cosine_similarity(d.embedding, q.embedding::DOUBLE[]) AS sim
    FROM embeddings q CROSS JOIN stored d {condition})
  WHERE sim > {c.THRESHOLD} QUALIFY rank <= {c.K})
"""


_PROBED = _top(
    "found",
    f"JOIN near n ON n.vec_id = q.vec_id AND n.cell = d.cell AND n.place <= {c.N_PROBE}",
)
_APPROX = f"""
WITH {_CELLS}, {_PROBED} SELECT query_id, rank, id, round(sim, 6) AS similarity FROM found"""

_FIXED_TOKENS = -(-len(c.SYSTEM) // 4) + 6
_PACKED = f"""{_MATCHES},
budgets AS (
  SELECT query_id, question, {_tokens('question')} + {_FIXED_TOKENS} AS reserved,
    floor(({c.CONTEXT_TOKENS} - {_tokens('question')} - {_FIXED_TOKENS}) * 0.95::DOUBLE)::BIGINT
      AS safe
  FROM asked),
running AS (
  SELECT m.*, b.safe, {_tokens('content')} AS tokens,
    coalesce(sum({_tokens('content')}) OVER (PARTITION BY m.query_id ORDER BY m.rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
  FROM matches m JOIN budgets b ON b.query_id = m.query_id),
selected AS (
  SELECT query_id, rank, id, tokens > safe - used AS truncated,
    CASE WHEN tokens <= safe - used THEN content
      ELSE {_truncate('content', 'safe - used')} END AS content
  FROM running
  WHERE used <= safe AND (tokens <= safe - used OR safe - used >= 50)),
contexts AS (
  SELECT b.query_id, b.question, coalesce(x.context, '') AS context,
    coalesce(x.n, 0)::INT AS n_selected,
    b.reserved + {_tokens("coalesce(x.context, '')")} AS total_tokens
  FROM budgets b LEFT JOIN (
    SELECT query_id, count(*) AS n,
      string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context
    FROM selected GROUP BY query_id) x ON x.query_id = b.query_id)
"""
_SOURCES = f"""{_MATCHES},
by_url AS (
  SELECT query_id, source_url AS url, max(sim) AS sim, count(*) AS n, min(rank) AS rank,
    arg_max({{'title': title, 'content': content}}, (length(content), -rank)) AS best,
    (source_url IN ({', '.join(map(_quote, c.HOMEPAGES))}))::INT AS home
  FROM matches GROUP BY query_id, source_url),
closest AS (
  SELECT *, sim >= max(sim) OVER (PARTITION BY query_id, home) - 0.05::DOUBLE AS close
  FROM by_url)
"""

# -- conversations ---------------------------------------------------------------------


def _history(marker: str) -> str:
    return f"""
history AS (
  SELECT conv_id, turn, role, text FROM conversations
  WHERE role IN ('user', 'assistant')
    AND NOT (role = 'assistant' AND contains(text, {_quote(marker)}))),
queries AS (SELECT conv_id, turn, text AS question FROM history WHERE role = 'user')
"""


_TRIM = f"""{_history('Hei! Jeg er')},
numbered AS (
  SELECT *, {_tokens('text')} AS tokens,
    lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role,
    lag({_tokens('text')}) OVER w AS prev_tokens, lead({_tokens('text')}) OVER w AS next_tokens,
    (sum({_tokens('text')}) OVER w - {_tokens('text')})::BIGINT AS start
  FROM history WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
units AS (
  SELECT *,
    role = 'assistant' AND coalesce(prev_role = 'user', false) AS answers,
    role = 'user' AND coalesce(next_role = 'assistant', false) AS answered
  FROM numbered),
placed AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN answers THEN start - prev_tokens ELSE start END AS unit_start,
    start + tokens + CASE WHEN answered THEN next_tokens ELSE 0 END AS unit_end,
    CASE WHEN answers THEN prev_tokens WHEN answered THEN tokens END AS user_tokens,
    turn * 2 - CASE WHEN answers THEN 3 ELSE 0 END AS pair_order
  FROM units),
reach AS (
  SELECT q.conv_id, q.turn, p.turn AS earlier, p.role, p.text, p.unit_start, p.user_tokens,
    p.pair_order, q.start - {c.HISTORY_TOKENS} AS edge,
    p.unit_end - q.start + {c.HISTORY_TOKENS} AS room
  FROM units q JOIN placed p ON p.conv_id = q.conv_id AND p.turn < q.turn
  WHERE q.role = 'user'),
trimmed AS (
  SELECT conv_id, turn, earlier, role, pair_order, CASE
    WHEN unit_start >= edge THEN text
    WHEN room < 50 OR {c.HISTORY_TOKENS} - room >= {c.HISTORY_TOKENS} * 0.9 THEN NULL
    WHEN user_tokens IS NULL THEN {_truncate('text', 'room')}
    WHEN role = 'user' AND room >= user_tokens + 50 THEN text
    WHEN role = 'user' THEN {_truncate('text', 'room')}
    WHEN room >= user_tokens + 50 THEN {_truncate('text', 'room - user_tokens')} END AS text
  FROM reach)
"""


def _trimmed_sql(order: str) -> str:
    return f"""
SELECT q.conv_id, q.turn, coalesce(sum({_tokens('t.text')}), 0)::BIGINT AS history_tokens,
  coalesce(string_agg(t.earlier || '|' || t.role || '|' || t.text, chr(10) ORDER BY t.{order}), '')
    AS history
FROM queries q LEFT JOIN trimmed t
  ON t.conv_id = q.conv_id AND t.turn = q.turn AND t.text IS NOT NULL
GROUP BY q.conv_id, q.turn
"""


_ANCHORS = f"""
anchors AS (
  SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id
  UNION ALL
  SELECT a.user_id, (SELECT min(e.ts) FROM events e
    WHERE e.user_id = a.user_id AND e.ts > a.opened + INTERVAL {c.WINDOW_SECONDS} SECONDS)
  FROM anchors a WHERE a.opened IS NOT NULL),
placed AS (
  SELECT e.event_id, e.user_id, e.ts, max(a.opened) AS opened
  FROM events e JOIN anchors a ON a.user_id = e.user_id AND a.opened <= e.ts
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, opened ORDER BY ts, event_id) AS rank,
    epoch_us(opened) + {c.WINDOW_SECONDS * 1_000_000} AS ends FROM placed)
"""

_CHAT = f"""{_TRIM},
context AS (
  SELECT q.conv_id, q.turn, string_agg(h.text, ' ' ORDER BY h.turn) AS context
  FROM queries q JOIN history h ON h.conv_id = q.conv_id AND h.turn < q.turn
  WHERE {_words('q.question')} <= {config.FOLLOW_UP_MAX_WORDS}
    AND length(h.text) < CASE WHEN h.role = 'assistant'
      THEN {config.FOLLOW_UP_ASSISTANT_CHARS} ELSE {config.FOLLOW_UP_USER_CHARS} END
  GROUP BY q.conv_id, q.turn),
searched AS (
  SELECT q.conv_id, q.turn, q.conv_id || '-' || q.turn AS query_id, q.question,
    q.question || coalesce(' ' || x.context, '') AS search_text
  FROM queries q LEFT JOIN context x ON x.conv_id = q.conv_id AND x.turn = q.turn),
vectors AS (
  SELECT s.query_id, e.embedding FROM searched s JOIN embeddings e
    ON e.vec_id = ('0x' || md5(s.search_text)[1:8])::BIGINT % (SELECT count(*) FROM embeddings)),
doc_index AS (
  SELECT d.doc_id AS id, d.text AS content, d.source AS source_url, d.lang AS title,
    e.embedding::DOUBLE[] AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
matches AS (
  SELECT query_id, id, sim, content, source_url, title,
    row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank
  FROM (
    SELECT q.query_id, d.*, list_cosine_similarity(d.embedding, q.embedding::DOUBLE[]) AS sim
    FROM vectors q CROSS JOIN doc_index d)
  WHERE sim > {c.CHAT_THRESHOLD} QUALIFY rank <= {c.K}),
histories AS (
  SELECT conv_id || '-' || turn AS query_id, coalesce(sum({_tokens('text')}), 0)::BIGINT AS tokens,
    string_agg(role || '|' || text, chr(10) ORDER BY earlier) AS messages
  FROM trimmed WHERE text IS NOT NULL GROUP BY conv_id, turn),
budgets AS (
  SELECT s.*, coalesce(h.tokens, 0) AS history_tokens, h.messages,
    {_tokens('question')} + {_FIXED_TOKENS} + coalesce(h.tokens, 0) AS reserved,
    floor(({c.CHAT_TOKENS} - {_tokens('question')} - {_FIXED_TOKENS} - coalesce(h.tokens, 0))
      * 0.95::DOUBLE)::BIGINT AS safe
  FROM searched s LEFT JOIN histories h ON h.query_id = s.query_id),
running AS (
  SELECT m.*, b.safe, {_tokens('content')} AS tokens,
    coalesce(sum({_tokens('content')}) OVER (PARTITION BY m.query_id ORDER BY m.rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
  FROM matches m JOIN budgets b ON b.query_id = m.query_id),
selected AS (
  SELECT query_id, rank, id, sim, source_url, title,
    CASE WHEN tokens <= safe - used THEN content
      ELSE {_truncate('content', 'safe - used')} END AS content
  FROM running
  WHERE used <= safe AND (tokens <= safe - used OR safe - used >= 50)),
packed AS (
  SELECT query_id, count(*)::INT AS n,
    string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context
  FROM selected GROUP BY query_id),
by_url AS (
  SELECT query_id, source_url AS url, max(sim) AS sim, count(*) AS n, min(rank) AS rank,
    (source_url IN ({', '.join(map(_quote, c.HOMEPAGES))}))::INT AS home
  FROM selected GROUP BY query_id, source_url),
closest AS (
  SELECT *, sim >= max(sim) OVER (PARTITION BY query_id, home) - 0.05::DOUBLE AS close
  FROM by_url),
shown AS (
  SELECT query_id, url FROM closest QUALIFY row_number() OVER (PARTITION BY query_id
    ORDER BY home, close DESC, n DESC, sim DESC, rank) = 1)
"""

_CACHE = """
cache AS (
  SELECT text AS question, 'cached answer of ' || min(conv_id) AS answer
  FROM conversations WHERE role = 'user' AND turn = 0 GROUP BY text),
asked AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user')
"""

_DOC_CHUNKS = """
SELECT 'doc-' || doc_id AS id, text AS content, source AS source_url, lang AS title,
  source AS section, 0 AS chunk_index, doc_id AS page_ord FROM documents
"""

_TIMINGS = """
timings AS (
  SELECT event_id AS request_id, (floor(value)::BIGINT + floor(value * 10)::BIGINT
    + CASE WHEN event_type = 'click' THEN 250 ELSE 0 END)::BIGINT AS total_ms FROM events)
"""

_UPSERT = """
old AS (
  SELECT doc_id, source, lang, text, 'old ' || doc_id AS title, 0 AS gen, doc_id AS ord
  FROM documents),
new AS (
  SELECT d.doc_id, source, lang, text, 'new ' || d.doc_id AS title, 1 AS gen, d.doc_id AS ord
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  WHERE l.quality = 1 AND lang <> 'en'),
both_sides AS (
  SELECT *, 'https://' || source || '/' || lang AS url_key
  FROM (SELECT * FROM old UNION ALL SELECT * FROM new))
"""

_MARKED = _replace(
    "'See https://a.example/x?y=1 or [here](https://b.example) [Kilde 12]. ' || text || "
    "' Basert på kilde en. <b>Mail</b> post@a.example og BASERT PÅ x.'",
    (r"https?://\S+", ""),
    (r"\[Kilde\s+[0-9]+\]", ""),
    (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
    (r"(?i)Basert på[^.]+\.", ""),
    (r"<[^>]+>", ""),
    (r"([a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\.[a-zA-Z0-9_-]+)", r'<a href="mailto:\1">\1</a>'),
)


# A call of the embedding job fails as a whole; calls begin anew every 4096 pages.
def _batches(size: int) -> str:
    return f"""
numbered AS (
  SELECT *, doc_id // 4096 AS block,
    (row_number() OVER (PARTITION BY doc_id // 4096 ORDER BY doc_id) - 1) // {size} AS call
  FROM documents),
batches AS (
  SELECT *, bool_or(contains(text, '@')) OVER (PARTITION BY block, call) AS failed FROM numbered)
"""


_BATCHES = _batches(c.BATCH)

ORACLE_SQL: dict[str, str] = {
    # tables
    "pages_from_json": """
        WITH lines AS (
          SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
        SELECT (doc_id // 50) * 4294967296 + doc_id % 50 AS page_ord, source AS source_url,
          lang AS title,
          string_agg(' Part ' || pos || '|' || line, chr(10) ORDER BY pos) AS sections
        FROM lines GROUP BY doc_id, source, lang""",
    "urls_from_json": """
        SELECT (page_id // 50) * 4294967296 + page_id % 50 AS ord, url FROM pages""",
    "chunks_from_json": f"""
        SELECT * REPLACE ((page_ord // 50) * 4294967296 + page_ord % 50 AS page_ord)
        FROM ({_DOC_CHUNKS})""",
    "answers_from_json": """
        SELECT text AS question, 'Answer "' || max(item_id) || '"' AS answer
        FROM benchmark GROUP BY text""",
    "answer_cache_objects": """
        SELECT place // 25 AS part, count(*)::INT AS n,
          '{' || string_agg(to_json(text) || ':' || to_json({'answer': 'Answer "' || item_id || '"'}),
            ',' ORDER BY text) || '}' AS json
        FROM (SELECT text, max(item_id) AS item_id,
            row_number() OVER (ORDER BY max(item_id)) - 1 AS place FROM benchmark GROUP BY text)
        GROUP BY place // 25""",
    "read_pages": """
        WITH lines AS (
          SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
        SELECT source AS source_url, lang AS title,
          string_agg(' Part ' || pos || '|' || line, chr(10) ORDER BY pos) AS sections
        FROM lines GROUP BY doc_id, source, lang""",
    "read_urls": "SELECT url FROM pages",
    "read_chunks": f"SELECT * EXCLUDE (page_ord) FROM ({_DOC_CHUNKS})",
    "read_answer_cache": """
        SELECT text AS question, 'Answer "' || max(item_id) || '"' AS answer
        FROM benchmark GROUP BY text""",
    # URLs
    "sitemap_locs": f"WITH {_SITEMAPS} SELECT * FROM locs WHERE kind IS NOT NULL",
    "expand_sitemaps": f"""
        WITH RECURSIVE {_SITEMAPS},
        walk AS (
          SELECT 'https://site' || page_id || '.example' || path AS sitemap_url, 0 AS depth
          FROM pages, (VALUES ('/sitemap.xml'), ('/sitemap_index.xml'), ('/wp-sitemap.xml'))
            AS p(path)
          WHERE starts_with(url, 'https://www.')
          UNION
          SELECT l.loc, w.depth + 1 FROM walk w JOIN locs l ON l.sitemap_url = w.sitemap_url
          WHERE l.kind = 'sitemap' AND w.depth < 3)
        SELECT DISTINCT loc AS url FROM locs
        WHERE kind = 'url' AND sitemap_url IN (SELECT sitemap_url FROM walk)""",
    "page_links_relative": r"""
        WITH hrefs AS (
          SELECT url, trim(unnest(regexp_extract_all(
            html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1))) AS href FROM pages),
        parts AS (
          SELECT url, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
            regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM hrefs)
        SELECT url, CASE
          WHEN href LIKE '/t%' THEN origin
            || coalesce(nullif(regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', ''), ''), '/')
            || substr(href, 2)
          WHEN href LIKE '/a%' THEN origin
            || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || substr(href, 2)
          WHEN href LIKE '/e%' THEN origin || path || '?e=1&x=' || substr(href, 3)
          WHEN href LIKE '/%' THEN origin || href END AS link
        FROM parts""",
    "page_links": f"WITH {_LINKS} SELECT url, link FROM page_links",
    "normalize_urls": f"""
        WITH {_LINKS} SELECT url, {_normalized('url')} AS normalized,
          lower({_normalized('url')}) AS canonical FROM all_urls""",
    "exclude_system_urls": f"""
        WITH {_LINKS}, more AS (
          SELECT unnest([url, regexp_replace(url, '/(en|de)/', '/Admin/', 'g') || 'x',
            url || '/page-sitemap.xml', url || '/sitemap/a']) AS url FROM all_urls)
        SELECT url FROM more WHERE NOT {_system('url')}""",
    "exclude_crawl_urls": f"""
        WITH {_LINKS}, more AS (
          SELECT unnest([url, regexp_replace(url, '/fr/', '/xml/', 'g'), url || '/sitemap/a'])
            AS url FROM all_urls)
        SELECT url FROM more WHERE NOT {_any_contains('lower(url)', (
            "/login", "/admin", "/wp-admin", "/wp-login", "/wp-content", "/wp-includes",
            "/wp-json", "/feed", "/xml", "/rss", "/sitemap"))}""",
    "allow_domains": f"WITH {_LINKS} SELECT url FROM all_urls WHERE {_allowed('url')}",
    "dedup_urls": f"""
        WITH {_LINKS} SELECT lower({_normalized('url')}) AS canonical,
          min({_normalized('url')}) AS url FROM all_urls GROUP BY ALL""",
    "drop_variant_urls": f"""
        WITH {_VARIANTS} SELECT url FROM variants u
        WHERE {_VARIANT_RULE.format(table='variants')}""",
    "union_urls": f"""
        WITH {_LINKS}, {_VARIANTS}
        SELECT url FROM all_urls UNION SELECT url FROM variants""",
    "url_summary": f"""
        WITH {_DISCOVER}
        SELECT (SELECT count(*) FROM found) AS total,
          (SELECT count(*) FROM discovered) AS kept,
          (SELECT count(*) FROM found) - (SELECT count(*) FROM discovered) AS excluded,
          (SELECT count(*) FROM found WHERE {_system('url')}) AS excluded_by_pattern,
          (SELECT count(*) FROM found WHERE NOT {_system('url')} AND NOT {_allowed('url')})
            AS excluded_by_domain,
          (SELECT count(*) FROM discovered WHERE {_from_start('url')}) AS from_start,
          (SELECT count(*) FROM discovered
            WHERE {_any_contains(_normalized('url'), [_host(d) for d in c.SITE.related_domains])})
            AS from_related""",
    "page_type_coverage": _types_sql(),
    "discover_urls": f"WITH {_DISCOVER} SELECT url FROM discovered ORDER BY url",
    # pages
    "plan_crawl": r"""
        SELECT page_id AS ord, regexp_replace(url, '[?#].*$', '') AS url FROM pages
        WHERE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')
          NOT IN (SELECT regexp_replace(url, '/$', '') FROM pages)
        ORDER BY ord""",
    "plan_crawl_limited": r"""
        SELECT page_id AS ord, regexp_replace(url, '[?#].*$', '') AS url FROM pages
        WHERE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')
          NOT IN (SELECT regexp_replace(url, '/$', '') FROM pages)
        ORDER BY ord LIMIT 20""",
    "tag_special_pages": r"""
        SELECT page_id AS ord, url, regexp_matches(regexp_replace(lower(url), '/$', ''),
          'page=\d+|^https://blog\.') AS needs_load_more FROM pages""",
    "best_attempt": """
        SELECT source AS url, doc_id AS attempt, text AS markdown FROM documents
        WHERE length(text) > 0
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1""",
    "pages_to_markdown": f"WITH {_markdown()} SELECT * FROM markdown",
    "extract_sections": _sections_sql(True),
    "extract_content_sections": _sections_sql(False),
    "page_sections": f"""
        WITH {_markdown()},
        bodies AS (SELECT page_ord, url, title AS page_title, markdown,
          markdown AS body FROM markdown
          WHERE NOT {_any_contains('lower(url)', _CRAWL_PARTS)}),
        {_page_text('body')}
        SELECT page_ord, url AS source_url,
          coalesce(nullif(trim(regexp_extract(markdown, '(?m)^#\\s+(.+)$', 1)), ''),
            nullif(page_title, '')) AS title,
          CASE WHEN text = '' THEN '' ELSE '|' || text END AS sections
        FROM texts""",
    "upsert_pages": f"""
        WITH {_UPSERT}
        SELECT url_key,
          arg_min(CASE WHEN gen = 0 THEN ord
            ELSE ord + 1 + (SELECT max(doc_id) FROM documents) END, (gen, ord)) AS page_ord,
          arg_max(title, (gen, ord)) AS title, arg_max(text, (gen, ord)) AS text
        FROM both_sides GROUP BY url_key""",
    "page_stats": """
        SELECT count(*) AS pages,
          sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS sections,
          sum(length(replace(text, chr(10), '')))::BIGINT AS text_chars
        FROM documents""",
    "crawl_outcome": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY ALL",
    # chunks
    "clean_sections": f"""
        WITH {_line_sections(("worthless", "ertion", "keit"))} SELECT * FROM cleaned""",
    "make_chunks": f"WITH RECURSIVE {_FOLD} SELECT * FROM chunks",
    "classify_chunks": f"""
        WITH {_LINE_CHUNKS}, {_classified()}
        SELECT page_ord, chunk_index, reason FROM classified""",
    "dedup_chunks": f"""
        WITH {_LINE_CHUNKS}, {_classified()}
        SELECT page_ord, chunk_index, reason FROM tagged""",
    "keep_first_chunks": f"""
        WITH {_LINE_CHUNKS}, {_classified()}
        SELECT page_ord, chunk_index, content FROM tagged WHERE reason IS NULL""",
    "cleaning_report": f"""
        WITH {_line_sections(())}, {_LINE_CHUNKS}, {_classified()},
        counts AS (
          SELECT count(*) AS made, count(*) FILTER (reason IS NULL) AS kept,
            count(*) FILTER (reason = 'navigation/UI') AS navigation,
            count(*) FILTER (reason = 'consent/legal') AS consent,
            count(*) FILTER (reason = 'too short') AS too_short,
            count(*) FILTER (reason = 'duplicate') AS duplicates,
            count(*) FILTER (reason IN ('fragmented language', 'low quality')) AS fragmented
          FROM tagged)
        SELECT (SELECT count(*) FROM documents) AS pages_before,
          (SELECT count(*) FROM lines) AS sections_before,
          (SELECT count(DISTINCT page_ord) FROM cleaned) AS pages_after,
          (SELECT count(*) FROM cleaned) AS sections_after,
          made AS chunks_created, kept AS chunks_kept, navigation, consent, too_short,
          duplicates, fragmented, made - kept AS chunks_removed,
          round((made - kept) * 100.0::DOUBLE / made, 1) AS removed_pct
        FROM counts""",
    "build_chunks": f"""
        WITH RECURSIVE {_FOLD}, {_classified()}
        SELECT id, content, source_url, title, section, chunk_index, page_ord, section_index
        FROM tagged WHERE reason IS NULL""",
    # The rules and sizes as they come.
    "classify_chunks_defaults": f"""
        WITH {_LINE_CHUNKS}, {_classified(ChunkRules())}
        SELECT page_ord, chunk_index, reason FROM classified""",
    "build_chunks_defaults": f"""
        WITH RECURSIVE {_fold(ChunkSizes())}, {_classified(ChunkRules())}
        SELECT id, content, source_url, title, section, chunk_index, page_ord, section_index
        FROM tagged WHERE reason IS NULL""",
    "embed_summary_defaults": f"""
        WITH {_batches(config.EMBED_BATCH)}
        SELECT count(*) AS total, count(*) FILTER (NOT failed) AS succeeded,
          count(*) FILTER (failed) AS failed FROM batches""",
    # embedding
    "embed_chunks": f"""
        SELECT id, {" || ',' || ".join(
            f"(length(content) - length(replace(content, '{v}', '')))" for v in "aeiou")}
          AS vector, NULL::VARCHAR AS error
        FROM ({_DOC_CHUNKS})""",
    "embed_summary": f"""
        WITH {_BATCHES}
        SELECT count(*) AS total, count(*) FILTER (NOT failed) AS succeeded,
          count(*) FILTER (failed) AS failed FROM batches""",
    "first_errors": f"""
        WITH {_BATCHES}
        SELECT 'doc-' || doc_id AS id, 'mail address' AS error FROM batches
        WHERE failed ORDER BY doc_id LIMIT 10""",
    "load_documents": f"""
        WITH {_BATCHES}
        SELECT text AS content, source AS source_url, lang AS title, source AS section,
          count(*) OVER () AS replaced
        FROM batches WHERE NOT failed""",
    # retrieval
    "match_documents": f"""
        WITH {_MATCHES} SELECT * EXCLUDE (sim), round(sim, 6) AS similarity FROM matches""",
    "build_ann_index": f"WITH {_CELLS} SELECT id, cell::INT AS cell FROM stored",
    "approx_match_documents": _APPROX,
    "approx_match_blocks": _APPROX,
    "approx_recall": f"""
        WITH {_CELLS}, {_PROBED}, {_top('exact', '')}
        SELECT e.query_id, count(*) AS n_exact, count(f.id) AS n_found,
          count(f.id)::DOUBLE / count(*) AS recall
        FROM exact e LEFT JOIN found f ON f.query_id = e.query_id AND f.id = e.id
        GROUP BY e.query_id""",
    "approx_match_all_cells": f"""
        WITH {_MATCHES} SELECT query_id, rank, id, round(sim, 6) AS similarity FROM matches""",
    "conversation_history": f"""
        WITH {_history('Nicht')}
        SELECT q.conv_id, q.turn, q.question, count(h.turn)::INT AS n,
          coalesce(string_agg(h.turn || '|' || h.role || '|' || h.text, chr(10)
            ORDER BY h.turn), '') AS history
        FROM queries q LEFT JOIN history h ON h.conv_id = q.conv_id AND h.turn < q.turn
        GROUP BY q.conv_id, q.turn, q.question""",
    "contextual_queries": f"""
        WITH {_history('Hei! Jeg er')},
        context AS (
          SELECT q.conv_id, q.turn, string_agg(h.text, ' ' ORDER BY h.turn) AS context
          FROM queries q JOIN history h ON h.conv_id = q.conv_id AND h.turn < q.turn
          WHERE {_words('q.question')} <= 25
            AND length(h.text) < CASE WHEN h.role = 'assistant' THEN 300 ELSE 120 END
          GROUP BY q.conv_id, q.turn)
        SELECT q.conv_id, q.turn, q.question,
          q.question || coalesce(' ' || c.context, '') AS search_text
        FROM queries q LEFT JOIN context c ON c.conv_id = q.conv_id AND c.turn = q.turn""",
    "trim_history": f"WITH {_TRIM} {_trimmed_sql('earlier')}",
    "trim_history_pairs_first": f"""
        WITH {_TRIM} SELECT conv_id, turn, history FROM ({_trimmed_sql('pair_order')})""",
    "select_matches": f"""
        WITH {_PACKED} SELECT query_id, rank, id, truncated, content FROM selected""",
    "pack_context": f"""
        WITH {_PACKED} SELECT query_id, context, n_selected, total_tokens FROM contexts""",
    "pick_source": f"""
        WITH {_SOURCES}
        SELECT query_id, url, best.title AS title, best.content AS content FROM closest
        QUALIFY row_number() OVER (PARTITION BY query_id
          ORDER BY home, close DESC, n DESC, sim DESC, rank) = 1""",
    "assemble_prompts": f"""
        WITH {_TRIM}
        SELECT q.conv_id || '-' || q.turn AS query_id,
          'system|{c.SYSTEM}' || chr(10)
          || coalesce(string_agg(t.role || '|' || t.text, chr(10) ORDER BY t.earlier)
            || chr(10), '')
          || 'user|Kontekst:' || chr(10) || '[1] ' || q.question || chr(10) || chr(10)
          || 'Spørsmål: ' || q.question AS messages
        FROM queries q LEFT JOIN trimmed t
          ON t.conv_id = q.conv_id AND t.turn = q.turn AND t.text IS NOT NULL
        GROUP BY q.conv_id, q.turn, q.question""",
    "chat_prompts": f"""
        WITH {_CHAT}
        SELECT b.query_id, b.search_text, b.history_tokens,
          CASE WHEN found THEN coalesce(p.n, 0) END AS n_selected,
          CASE WHEN found THEN b.reserved + {_tokens("coalesce(p.context, '')")} END
            AS total_tokens,
          s.url,
          CASE WHEN found THEN 'system|{c.SYSTEM}' || chr(10) || coalesce(b.messages || chr(10), '')
            || 'user|Kontekst:' || chr(10) || coalesce(p.context, '') || chr(10) || chr(10)
            || 'Spørsmål: ' || b.question END AS messages,
          CASE WHEN NOT found THEN {_quote(config.NO_MATCH_ANSWER)} END AS answer
        FROM (SELECT *, query_id IN (SELECT query_id FROM matches) AS found FROM budgets) b
        LEFT JOIN packed p ON p.query_id = b.query_id LEFT JOIN shown s ON s.query_id = b.query_id""",
    "build_index": f"""
        WITH RECURSIVE {_FOLD}, {_classified()},
        kept AS (
          SELECT *, page_ord // 4096 AS block,
            (row_number() OVER (PARTITION BY page_ord // 4096
              ORDER BY page_ord, section_index, chunk_index) - 1) // {config.EMBED_BATCH} AS call
          FROM tagged WHERE reason IS NULL),
        called AS (
          SELECT *, bool_or(contains(content, '@')) OVER (PARTITION BY block, call) AS failed FROM kept)
        SELECT content, source_url, title, section, {" || ',' || ".join(
            f"(length(content) - length(replace(content, '{v}', '')))" for v in "aeiou")} AS vector,
          (SELECT count(*) FROM called WHERE failed) AS failed
        FROM called WHERE NOT failed""",
    "cache_lookup": f"""
        WITH {_CACHE} SELECT a.question, a.conv_id, a.turn, c.answer
        FROM asked a LEFT JOIN cache c ON c.question = a.question""",
    "cache_misses": f"""
        WITH {_CACHE} SELECT question, conv_id, turn FROM asked
        WHERE question NOT IN (SELECT question FROM cache)""",
    "answer_cache_inputs": f"""
        WITH {_PACKED}
        SELECT query_id, {_quote(c.SYSTEM)} AS system,
          'Kontekst:' || chr(10) || context || chr(10) || chr(10) || 'Spørsmål: ' || question
            AS user
        FROM contexts WHERE query_id IN (SELECT query_id FROM matches)""",
    "generated_answers": f"""
        WITH {_PACKED},
        prompts AS (
          SELECT query_id, 'Kontekst:' || chr(10) || context || chr(10) || chr(10)
            || 'Spørsmål: ' || question AS content
          FROM contexts WHERE query_id IN (SELECT query_id FROM matches))
        SELECT query_id, CASE WHEN contains(content, 'group 3')
          THEN 'Beklager, det oppstod en feil ved generering av svar.'
          ELSE '2 messages, ' || length(content) || ' characters' END AS answer
        FROM prompts""",
    "unanswered": f"""
        WITH {_INDEX},
        good AS (SELECT d.* FROM doc_index d JOIN labels l ON l.doc_id = d.id
          WHERE l.quality = 1),
        {_scored('top', 'good', c.K, 0.6)}
        SELECT query_id, question, 'Beklager, jeg fant ingen relevant informasjon i databasen '
          || 'for å svare på spørsmålet ditt.' AS answer
        FROM asked WHERE query_id NOT IN (SELECT query_id FROM top)""",
    "retrieval_metrics": f"""
        WITH {_PACKED}
        SELECT x.query_id, count(m.id) AS n_matches, round(max(m.sim), 6) AS top_similarity,
          x.n_selected, x.total_tokens, {c.CONTEXT_TOKENS} AS budget,
          x.total_tokens > {c.CONTEXT_TOKENS} AS over_budget,
          x.n_selected = 0 AS empty_context
        FROM contexts x LEFT JOIN matches m ON m.query_id = x.query_id
        GROUP BY x.query_id, x.n_selected, x.total_tokens""",
    "sanitize_messages": f"SELECT conv_id, turn, {_MARKED} AS clean_text FROM conversations",
    # admission
    "rate_limit": f"""
        WITH RECURSIVE {_ANCHORS}
        SELECT event_id AS request_id, user_id AS client, rank <= {c.RATE} AS allowed,
          greatest({c.RATE} - rank, 0) AS remaining, ends AS reset_at_us,
          CASE WHEN rank > {c.RATE} THEN ceil((ends - epoch_us(ts)) / 1000000.0)::BIGINT END
            AS retry_after
        FROM ranked""",
    "client_keys": """
        SELECT event_id AS request_id, CASE
          WHEN event_type = 'click' THEN '10.0.0.' || user_id
          WHEN event_type = 'error' THEN ''
          WHEN event_type = 'view' THEN '172.16.0.' || user_id
          WHEN value > 10 THEN '192.168.0.' || user_id
          ELSE 'unknown' END AS client
        FROM events""",
    "request_timings": f"WITH {_TIMINGS} SELECT request_id, total_ms FROM timings",
    "timing_summary": f"""
        WITH {_TIMINGS} SELECT count(*) AS requests, round(avg(total_ms), 6) AS avg_ms,
          quantile_disc(total_ms, 0.5) AS median_ms, quantile_disc(total_ms, 0.95) AS p95_ms
        FROM timings""",
}

ORACLE_SQL["timing_windows_stream"] = """
    WITH timed AS (
      SELECT ts, (floor(value)::BIGINT + floor(value * 10)::BIGINT
        + CASE WHEN event_type = 'click' THEN 250 ELSE 0 END)::BIGINT AS total_ms FROM events),
    days AS (SELECT epoch_us(date_trunc('day', ts)) AS window_us, total_ms FROM timed
      UNION ALL SELECT NULL, total_ms FROM timed)
    SELECT window_us, count(*) AS requests, round(avg(total_ms), 6) AS avg_ms,
      true AS median_right, true AS p95_right
    FROM days GROUP BY window_us"""

# Other ways to the same results.
ORACLE_SQL["upsert_page_stream"] = """
    WITH crawled AS (
      SELECT 'https://' || source || '/' || lang AS url_key, 'old ' || doc_id AS title, text,
        doc_id % 4 AS batch, doc_id // 4 AS ord
      FROM documents),
    ends AS (SELECT batch, max(ord) + 1 AS size FROM crawled GROUP BY batch),
    starts AS (
      SELECT batch, coalesce(sum(size) OVER (ORDER BY batch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ends),
    placed AS (SELECT c.*, c.ord + s.start AS position FROM crawled c JOIN starts s USING (batch))
    SELECT url_key, min(position) AS page_ord, arg_max(title, position) AS title,
      arg_max(text, position) AS text
    FROM placed GROUP BY url_key"""
ORACLE_SQL["upsert_page_batches"] = ORACLE_SQL["upsert_pages"]
ORACLE_SQL["rate_limit_stream"] = ORACLE_SQL["rate_limit"]
