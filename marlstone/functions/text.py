"""Text expressions: all built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
BYTES_PER_TOKEN = 3

#: Words that the sparse index leaves out.
STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "as", "at", "by", "be", "are", "was", "this", "that", "from"]
MAX_TERM_BYTES = 64

#: Noncharacters that mark, while a text is converted, where a tag begins and ends, and where a line must have ended.
_OPEN, _CLOSE, _LINE = "\ufdd0", "\ufdd1", "\ufdd2"
_BLOCKS = "p|div|ul|ol|blockquote|h[1-6]"
#: White space but for line feeds.
_BLANK = r"[\s&&[^\n]]"


def _tag(names: str, slash: str = "/?") -> str:
    return f"(?i){_OPEN}{slash}(?:{names})(?![a-z0-9])[^{_CLOSE}]*{_CLOSE}"


def _dropped(name: str) -> str:
    return rf"{name}(?![a-z0-9])[^{_CLOSE}]*{_CLOSE}.*?(?:{_OPEN}/{name}(?![a-z0-9])[^{_CLOSE}]*{_CLOSE}|\z)"


def html_to_text(html: Column) -> Column:
    """HTML as plain text: code blocks fenced, inline code ticked, list items, table rows and paragraphs kept apart, scripts and styles dropped.

    Tags are found from left to right, a '<' that opens none stays text; scripts and styles go up to their end tag, or to
    the text's end. What a tag stands for is written with a mark where a line must have ended, and marks become line feeds
    where there is none. Code tags between a block of code's tags are no ticks. Entities stay as they are. Outside fences
    lines are trimmed and runs of blanks collapsed; inside, indentation is kept. At most one blank line follows another.
    Three noncharacters (U+FDD0 to U+FDD2) become U+FFFD. Null stays null."""
    x = F.translate(html, _OPEN + _CLOSE + _LINE, "\ufffd" * 3)
    x = F.regexp_replace(x, "<((?:/?[A-Za-z]|[!?])[^>]*)>", f"{_OPEN}$1{_CLOSE}")
    x = F.regexp_replace(x, f"(?is){_OPEN}/?(?:{_dropped('script')}|{_dropped('style')})", "")
    # every part but the first begins with a tag of a block of code, which says whether it lies in one
    parts = F.split(x, f"(?i)(?={_OPEN}/?pre(?![a-z0-9]))")
    inside = rf"(?i)\A{_OPEN}pre(?![a-z0-9])"
    x = F.array_join(F.transform(parts, lambda part: F.when(part.rlike(inside), F.regexp_replace(part, _tag("code"), "")).otherwise(F.regexp_replace(part, _tag("code"), "`"))), "")
    for names, slash, by in (
        ("pre", "/?", f"{_LINE}{FENCE}\n"), ("br", "/?", "\n"), (_BLOCKS, "", _LINE), (_BLOCKS, "/", _LINE + "\n"), ("li", "", f"{_LINE}- "),
        ("tr", "", _LINE), ("tr", "/", " |\n"), ("td|th", "", "| "), ("td|th", "/", " "), ("table", "/?", _LINE),
    ):
        x = F.regexp_replace(x, F.lit(_tag(names, slash)), F.lit(by))
    x = F.regexp_replace(x, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", "")
    return normalize_text(F.regexp_replace(x, f"\n?{_LINE}+", "\n"))


def normalize_text(text: Column) -> Column:
    """The white-space part of html_to_text. A line that begins with a fence is one, whatever follows on it."""
    parts = F.split(text, rf"(?mdU)^{_BLANK}*{FENCE}[^\n]*(?:\n|\z)")

    def tidy(part: Column, i: Column) -> Column:
        right = rf"(?<!{_BLANK}){_BLANK}++$"
        prose = F.regexp_replace(F.regexp_replace(part, rf"(?mdU)^{_BLANK}++|{right}", ""), r"[ \t]{2,}", " ")
        return F.when(i % 2 == 0, prose).otherwise(F.regexp_replace(part, rf"(?mdU)^{_BLANK}++$|{right}", ""))

    joined = F.array_join(F.transform(parts, tidy), f"{FENCE}\n")
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)\A\s++|(?<!\s)\s++\z", ""), r"\n{3,}", "\n\n")


def has_code(text: Column) -> Column:
    return F.contains(text, F.lit(FENCE))


def parse_tags(tags: Column) -> Column:
    """|a|b| or <a><b> as an array; anything else, and null, as the empty one."""
    piped = F.filter(F.split(tags, r"\|"), lambda x: x != "")
    bracketed = F.regexp_extract_all(tags, F.lit("<([^>]+)>"), F.lit(1))
    return F.when(tags.startswith("|"), piped).when(tags.startswith("<"), bracketed).otherwise(F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """UTF-8 bytes divided by three, rounded up."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("int")


def full_text(title: Column, body: Column, answers: Column) -> Column:
    """Title, body and numbered answers, as they are chunked; nulls count as empty."""
    numbered = F.transform(F.coalesce(answers, F.array().cast("array<string>")), lambda a, i: F.concat(F.lit("\n\nAnswer "), (i + 1).cast("string"), F.lit(":\n"), F.coalesce(a, F.lit(""))))
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.array_join(numbered, ""))


def context_prefix(title: Column, tags: Column) -> Column:
    """Line put before every chunk of a document when it is indexed."""
    title = F.coalesce(title, F.lit(""))
    return F.when(F.size(tags) > 0, F.concat(title, F.lit(" ["), F.array_join(tags, ", "), F.lit("]\n"))).otherwise(F.concat(title, F.lit("\n")))


def normalize_for_hash(text: Column) -> Column:
    """Trimmed, with every run of white space as one blank, so that reflowed text hashes alike."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_for_hash(text), 256)


def chunk_id(doc_id: Column, index: Column, hashed: Column) -> Column:
    """32 hex digits that depend on document, place and content."""
    return F.substring(F.sha2(F.concat(doc_id.cast("string"), F.lit("\n"), index.cast("string"), F.lit("\n"), hashed), 256), 1, 32)


def as_uuid(hex32: Column) -> Column:
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def pipeline_tag(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def terms(text: Column) -> Column:
    """Terms of the sparse index, in order: ASCII letters and digits, with . - _ inside; lower-cased; no stop words, none over 64 bytes."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    raw = F.regexp_extract_all(lower, F.lit(r"[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?"), F.lit(0))
    return F.filter(raw, lambda t: (F.length(t) <= MAX_TERM_BYTES) & ~t.isin(STOPWORDS))


def excerpt(text: Column, length: int = 500) -> Column:
    return F.substring(text, 1, length)


def query_text(title: Column, body: Column) -> Column:
    """The title, followed by the body if that isn't blank."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat_ws(" ", title, body)).otherwise(title)


def citations(answer: Column, n_sources: Column) -> Column:
    """Distinct source numbers [n] of an answer that exist, ascending."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n_sources))))


def render_sources(texts: Column) -> Column:
    """Ranked excerpts, numbered, between markers that declare them untrusted."""
    numbered = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t))
    return F.concat(F.lit("<<<UNTRUSTED SOURCES\n"), F.array_join(numbered, "\n\n"), F.lit("\nUNTRUSTED SOURCES>>>"))


def cache_key(tenant: Column, query: Column) -> Column:
    """Hash of tenant and query, whatever the query's case and spacing."""
    return F.sha2(F.concat(F.coalesce(tenant, F.lit("")), F.lit("\n"), F.lower(normalize_for_hash(query))), 256)


def in_split(key: Column, fraction: float) -> Column:
    """Whether a key falls into the deterministic split of this share."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") < F.lit(int(fraction * (1 << 32)))
