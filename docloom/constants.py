"""Limits, word lists and patterns that define the results."""

# Crawl scope.
ALLOWED_SCHEMES = ["http", "https"]
MAX_CRAWL_DEPTH = 5

# Columns that one table cell may span when a page is rendered.
MAX_COLSPAN = 1000
REJECTED_SUFFIXES = [
    "css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2",
    "ttf", "eot", "zip", "tar", "gz", "pdf", "xml", "json", "txt",
]

# Page extraction.
DEFAULT_TITLE = "Untitled"
NOISE_TAGS = ["script", "style", "meta", "link", "noscript", "iframe", "svg"]
NOISE_SELECTORS = [
    ".sidebar", "header", "footer", ".nav", ".menu", "#sidebar",
    ".navigation", ".toc", "#toc", ".footer", "#footer",
]

# Paths and links.
EMPTY_PATH_NAME = "file.md"
UNSAFE_PATH_CHARS = r"[^a-zA-Z0-9._-]"
LINK_PATTERN = r"\[([^\]]*)\]\(([^)]+)\)"
ABSOLUTE_LINK_PREFIXES = ["http:", "https:", "mailto:"]

# Search.
DEFAULT_MAX_RESULTS = 10
CONTEXT_LINES = 2
CONTEXTS_SHOWN = 3
HIT_PREFIX = "> "
PLAIN_PREFIX = "  "
UNKNOWN_FIELD = "Unknown"

# Bundles.
SIZE_LIMIT_BYTES = 8 * 1024 * 1024
LARGEST_FILES_LISTED = 10
DESCRIPTION_SUFFIX = " documentation assistant"

# Crawl log.
LOG_URL_PATTERN = r"--\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}--\s+(\S+)"
EXIT_OUTCOMES = {
    0: "complete",
    4: "network failure",
    6: "authentication failure",
    8: "server error",
}
OTHER_OUTCOME = "incomplete"
