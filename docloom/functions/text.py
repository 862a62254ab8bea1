"""Text, path and display functions over Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.schemas import GIST_CHARS, SNIPPET_CHARS

# The characters Unicode text counts as white space, as the inside of a regex class
# that Java and RE2 both read.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"

# File extensions per category, and which categories are on from the start.
CATEGORY_EXTENSIONS = {
    "text": ("txt", "md", "markdown", "rst", "text"),
    "code": (
        "py", "pyw", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "rs", "java",
        "cpp", "cc", "cxx", "hpp", "h", "hxx", "cs", "rb", "php",
    ),
    "pdf": ("pdf",),
    "office": ("docx", "doc", "odt"),
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff"),
    "video": ("mp4", "mov", "avi", "mkv", "webm"),
}
CATEGORIES = tuple(CATEGORY_EXTENSIONS)
SUPPORTED_CATEGORIES = ("text", "code", "pdf")

# File extensions per programming language.
LANGUAGE_EXTENSIONS = {
    "python": ("py", "pyw", "pyi"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "tsx"),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "cpp": ("cpp", "cc", "cxx", "hpp", "h", "hxx"),
    "csharp": ("cs",),
    "ruby": ("rb",),
    "php": ("php",),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Arrays are summed up in blocks of this size.
SUM_BLOCK = 256


def running_sums(values: Column) -> Column:
    """For each element of an array of numbers, the sum of those before it, as longs.

    Summed in blocks, since a fold that appends to its result copies it every time."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SUM_BLOCK).cast("int")),
        lambda b: F.slice(values, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)),
    )
    zero = F.lit(0).cast("long")

    def appended(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + x))

    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda a, x: a + x))
    begins = F.aggregate(totals, F.array(zero), appended)
    sums = F.zip_with(
        blocks,
        F.slice(begins, F.lit(1), F.size(blocks)),
        lambda block, begin: F.slice(F.aggregate(block, F.array(begin), appended), F.lit(1), F.size(block)),
    )
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(sums))


#: The same characters themselves.
WHITESPACE_CHARS = "".join(map(chr, (
    *range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))


def strip(text: Column) -> Column:
    # Looks at both ends only, where a pattern would be tried at every character.
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE_CHARS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{WHITESPACE}]")


def truncate_words(text: Column, max_chars: int = SNIPPET_CHARS) -> Column:
    """At most ``max_chars`` characters, cut at the last space when that is not too far back."""

    def shorten(cut: Column) -> Column:
        last_space = F.length(cut) - F.locate(" ", F.reverse(cut))
        at_space = cut.contains(" ") & (last_space > F.lit(max_chars * 0.7))
        return F.concat(
            F.when(at_space, F.substring(cut, F.lit(1), last_space)).otherwise(cut), F.lit("…")
        )

    return F.when(F.length(text) <= max_chars, text).otherwise(
        let(rstrip(F.substring(text, 1, max_chars)), shorten)
    )


def gist_of(text: Column) -> Column:
    return truncate_words(text, GIST_CHARS)


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 with undecodable bytes dropped and every line end turned into ``\\n``."""
    raw = content.cast("string")
    valid = F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    )
    return F.regexp_replace(valid, r"\r\n?", "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def extension_of(path: Column) -> Column:
    """Lower-cased extension without the dot; empty for dot-files and names without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)\z", 1))


def constant_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for entry in entries.items() for part in entry])


def _lookup(extension: Column, table: dict[str, tuple[str, ...]]) -> Column:
    by_extension = {ext: name for name, extensions in table.items() for ext in extensions}
    return F.element_at(constant_map(by_extension), extension)


def category_of(path: Column) -> Column:
    return _lookup(extension_of(path), CATEGORY_EXTENSIONS)


def language_of(path: Column) -> Column:
    return _lookup(extension_of(path), LANGUAGE_EXTENSIONS)


def is_supported(category: Column) -> Column:
    return category.isin(*SUPPORTED_CATEGORIES)


def position_meta(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def position_field(meta: Column, field: str) -> Column:
    return F.get_json_object(meta, f"$.{field}")


def search_terms(query: Column) -> Column:
    """White-space separated terms of more than one character."""
    return F.filter(
        F.split(strip(query), rf"[{WHITESPACE}]+"), lambda term: F.length(term) > 1
    )


def highlight(snippet: Column, query: Column) -> Column:
    """Wrap each query term in ``<mark>``, in turn, ignoring case."""

    def mark(text: Column, term: Column) -> Column:
        quoted = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        pattern = F.concat(F.lit("(?iu)(\\Q"), quoted, F.lit("\\E)"))
        return F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>"))

    return F.aggregate(search_terms(query), snippet, mark)


def relative_age(mtime: Column, now: Column) -> Column:
    age = now - mtime
    return (
        F.when(age < 60, F.lit("just now"))
        .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit("m ago")))
        .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit("h ago")))
        .when(age < 604800, F.concat(F.floor(age / 86400).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd"))
    )


def percent_score(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


# ``greatest`` passes over NULLs, so a missing distance or score is kept apart.
def vector_score(distance: Column) -> Column:
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1.0 - distance / 2.0))


def keyword_score(bm25: Column) -> Column:
    score = F.greatest(F.lit(0.0), 1.0 / (1.0 + F.greatest(F.lit(0.0), bm25)))
    return F.when(bm25.isNotNull(), score)
