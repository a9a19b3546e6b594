"""Parameters and fixed values.

Everything here is data: operators take these as arguments and the defaults are the
values the engine has to share with existing deployments for its results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------------------
# numbers
# --------------------------------------------------------------------------------------

# Chunking (word-based token estimate).
CHUNK_MIN_TOKENS = 100
CHUNK_MAX_TOKENS = 1200
CHUNK_OVERLAP_TOKENS = 50
CHUNK_TOKENS_PER_WORD = 1.3
CHUNK_MIN_SECTION_CHARS = 50
CHUNK_VALUABLE_MIN_TOKENS = 50
CHUNK_MIN_WORDS = 15

# Chat side (character-based token estimate).
TOKENS_PER_CHAR = 0.25
CHARS_PER_TOKEN = 4
CONTEXT_BUDGET = 3000
HISTORY_BUDGET = 50000
PARTIAL_MIN_TOKENS = 50
CONTEXT_SAFETY = 0.95
HISTORY_NEARLY_FULL = 0.9

# Retrieval.
MATCH_COUNT = 12
MATCH_THRESHOLD = 0.25
SQL_MATCH_COUNT = 5
SQL_MATCH_THRESHOLD = 0.7
SOURCE_SIMILARITY_BAND = 0.05

# Follow-up questions.
FOLLOW_UP_MAX_WORDS = 3
FOLLOW_UP_ASSISTANT_CHARS = 1000
FOLLOW_UP_USER_CHARS = 500

# Embedding job, crawl, admission.
EMBED_BATCH = 100
CRAWL_LIMIT = 450
SITEMAP_MAX_DEPTH = 3
RATE_LIMIT_REQUESTS = 20
RATE_LIMIT_WINDOW_SECONDS = 60

# --------------------------------------------------------------------------------------
# texts
# --------------------------------------------------------------------------------------

CONTEXT_PREFIX = "Kontekst:\n"
QUESTION_PREFIX = "\n\nSpørsmål: "
# The fixed text whose tokens are reserved when a context is packed.
RESERVED_TEXT = "Kontekst:\n\nSpørsmål: "
NO_MATCH_ANSWER = (
    "Beklager, jeg fant ingen relevant informasjon i databasen for å svare på spørsmålet ditt."
)
GENERATION_ERROR_ANSWER = "Beklager, det oppstod en feil ved generering av svar."
WELCOME_MARKER = "Hei! Jeg er"
CITATION_PATTERN = r"\[Kilde\s+[0-9]+\]"
BASED_ON_PATTERN = r"(?iu)Basert på[^.]+\."
# What is taken out of, or rewritten in, a message before it is shown.
URL_START_PATTERN = r"https?://"
MARKDOWN_LINK_PATTERN = r"\[([^\]]+)\]\([^)]+\)"
TAG_PATTERN = r"<[^>]+>"
MAIL_PATTERN = r"([a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\.[a-zA-Z0-9_-]+)"
MAIL_LINK = '<a href="mailto:$1">$1</a>'

# --------------------------------------------------------------------------------------
# URL rules
# --------------------------------------------------------------------------------------

WELL_KNOWN_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")


@dataclass(frozen=True)
class UrlExclusions:
    """Substrings and suffixes (lower case) that mark a system URL."""

    contains: tuple[str, ...]
    ends_with: tuple[str, ...] = ()


DISCOVER_EXCLUSIONS = UrlExclusions(
    contains=(
        "/wp-admin", "/wp-login", "/wp-content", "/wp-includes", "/wp-json",
        "/login", "/admin", "/feed", "/rss",
    ),
    ends_with=(
        "sitemap.xml", "sitemap.xml/",
        "sitemap_index.xml", "sitemap_index.xml/",
        "wp-sitemap.xml", "wp-sitemap.xml/",
        "page-sitemap.xml", "page-sitemap.xml/",
    ),
)

CRAWL_EXCLUSIONS = UrlExclusions(
    contains=(
        "/login", "/admin", "/wp-admin", "/wp-login", "/wp-content", "/wp-includes",
        "/wp-json", "/feed", "/xml", "/rss", "/sitemap",
    ),
)

RELATED_EXCLUSIONS = ("/logg-inn/", "/login/", "/admin/")

# Expected page types: name -> substrings, any of which covers the type.
PAGE_TYPES: dict[str, tuple[str, ...]] = {
    "Kontakt": ("kontakt",),
    "Om oss": ("om-oss", "om oss"),
    "Åpningstider": ("åpningstid",),
    "Priser": ("pris",),
    "Parkering": ("parkering",),
    "Overnatting": ("overnatting", "hotell"),
}
LISTING_TYPES: dict[str, tuple[str, ...]] = {
    "category": ("/kategorier", "/category"),
    "archive": ("/arkiv", "/archive"),
    "tag": ("/tag",),
}

# --------------------------------------------------------------------------------------
# Word lists
# --------------------------------------------------------------------------------------

NAVIGATION_KEYWORDS = (
    "meny", "navigasjon", "footer", "header", "logg inn", "klikk her", "les mer",
    "tilbake", "neste", "forrige", "se flere", "se alle", "administrer", "utviklet av",
)
NAVIGATION_PHRASES = (
    "se annonsering utviklet av", "administrer samtykke", "administrer personvernet",
    "følg oss", "facebookinstagram",
)
NAVIGATION_LEADS = ("se flere", "se alle", "se mer", "les mer")
CONSENT_KEYWORDS = (
    "cookies", "cookie", "informasjonskapsler", "samtykke", "personvern", "privacy",
    "aksepter", "godta", "personvernerklæring", "personopplysninger", "databehandling",
    "gdpr", "rettigheter", "innsyn", "sletting",
)
MEANINGLESS_PHRASES = (
    "annonsørinnhold", "se annonsering", "utviklet av", "administrer samtykke",
    "administrer personvernet",
)
FRAGMENT_ENDINGS = ("Dette.", "Her får du.", "å.")

# Words that mark practical information; each rule has its own list.
VALUABLE_IN_CHUNKING = (
    "åpning", "åpent", "pris", "koster", "adresse", "telefon", "epost", "email",
    "klokken", "kl.",
)
VALUABLE_IN_NAVIGATION = (
    "åpning", "åpent", "pris", "koster", "adresse", "telefon", "epost", "email",
)
VALUABLE_IN_CONSENT = (
    "åpning", "åpent", "pris", "koster", "adresse", "telefon", "epost", "email",
    "klokken", "kl.", "åpner", "stenger",
)

# Section boilerplate, as case-insensitive patterns.
BOILERPLATE_TEXT = (
    r"administrer\s+samtykke",
    r"administrer\s+personvern",
    r"administrer\s+cookie",
    r"følg\s+oss",
    r"facebookinstagram",
    r"facebook\s*instagram",
    r"utviklet\s+av\s+god\s+dag",
    r"god\s+dag",
    r"ønsker\s+du\s+å\s+annonsere",
    r"se\s+annonsering",
    r"for\s+å\s+gi\s+de\s+bedste\s+opplevelsene\s+bruker\s+vi\s+og\s+våre\s+partnere"
    r"\s+teknologier\s+som\s+cookies",
    r"samtykke\s+til\s+disse\s+teknologiene",
    r"personvernerklæring",
    r"cookie.*erklæring",
    r"cookie.*policy",
    r"personvernpolicy",
    r"privacy\s+statement",
    r"privacy\s+policy",
    r"cookie\s+policy",
    r"dataforespørsels",
    r"databehandlingsavtale",
    r"ditt\s+samtykke",
    r"tilbakekalle\s+samtykke",
    r"cookie.*database",
    r"cmplz",
    r"wordpress.*cookie",
    r"vi\s+samler\s+eller\s+mottar\s+personlig\s+informasjon",
    r"grunnlaget\s+for\s+at\s+vi\s+kan\s+behandle",
    r"oppbevaringsperiode",
    r"rett\s+til\s+innsyn",
    r"rett\s+til\s+retting",
    r"rett\s+til\s+å\s+overføre",
    r"send\s+inn\s+en\s+forespørsel",
    r"denne\s+personvernerklæringen",
    r"denne\s+cookie.*erklæringen",
    r"akksepter.*benekte.*administrer",
    r"alltid\s+aktiv",
    r"funksjonell.*markedsføring.*statistikk",
    r"lagring\s+av\s+data\s+eller\s+tilgang",
    r"dette\s+var\s+litt\s+kjipt",
    r"hjemmeside\z",
)
BOILERPLATE_TITLE = (
    r"følg\s+oss",
    r"administrer",
    r"cookie",
    r"samtykke",
    r"personvern",
    r"privacy",
    r"ønske.*å\s+annonsere",
    r"se\s+annonsering",
    r"utviklet\s+av",
    r"god\s+dag",
    r"administrer.*samtykke",
    r"administrer.*personvern",
)


@dataclass(frozen=True)
class ChunkSizes:
    """Token sizes of the chunk fold."""

    min_tokens: int = CHUNK_MIN_TOKENS
    max_tokens: int = CHUNK_MAX_TOKENS
    overlap_tokens: int = CHUNK_OVERLAP_TOKENS
    valuable_min_tokens: int = CHUNK_VALUABLE_MIN_TOKENS
    valuable_words: tuple[str, ...] = VALUABLE_IN_CHUNKING


@dataclass(frozen=True)
class ChunkRules:
    """Word lists of the chunk classifier."""

    navigation_keywords: tuple[str, ...] = NAVIGATION_KEYWORDS
    navigation_phrases: tuple[str, ...] = NAVIGATION_PHRASES
    navigation_leads: tuple[str, ...] = NAVIGATION_LEADS
    consent_keywords: tuple[str, ...] = CONSENT_KEYWORDS
    fragment_endings: tuple[str, ...] = FRAGMENT_ENDINGS
    valuable_in_navigation: tuple[str, ...] = VALUABLE_IN_NAVIGATION
    valuable_in_consent: tuple[str, ...] = VALUABLE_IN_CONSENT
    min_words: int = CHUNK_MIN_WORDS


@dataclass(frozen=True)
class Site:
    """The crawled site and the domains that count as part of it."""

    start_url: str
    related_domains: tuple[str, ...] = ()
    homepage_urls: tuple[str, ...] = ()

    @property
    def allowed_domains(self) -> tuple[str, ...]:
        return (self.start_url, *self.related_domains)
