"""Cutting texts, source code and paged texts into snippets.

A file's snippets are built as one array inside the row that holds its text, so cutting needs no
shuffle; the array is bounded by the caps below. Only paged text, whose pages are rows of their
own, is grouped, and only after each document has been cut down to the pages that can matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.text import WHITESPACE, WORD, gist_of, let, rstrip, strip, truncate_words
from docloom.schemas import (
    CHUNK_ID_STRIDE,
    CHUNK_STRUCT,
    FIXED_CHUNK_CHARS,
    GIST_CHARS,
    PAGE_CHUNK_CAP,
    SNIPPET_CHARS,
    TEXT_CHUNK_CAP,
)

# Where a definition starts, per language, in multi-line mode.
DEFINITION_PATTERNS = {
    "python": r"^\s*(?:async\s+)?def\s+\w+|^\s*class\s+\w+",
    "javascript": r"^\s*(?:export\s+)?(?:async\s+)?function\s+\w+|^\s*(?:export\s+)?class\s+\w+|^\s*(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?function",
    "typescript": r"^\s*(?:export\s+)?(?:async\s+)?function\s+\w+|^\s*(?:export\s+)?class\s+\w+|^\s*(?:export\s+)?interface\s+\w+|^\s*(?:export\s+)?type\s+\w+",
    "go": r"^\s*func\s+(?:\(\w+\s+\w+\)\s+)?\w+|^\s*type\s+\w+\s+struct|^\s*type\s+\w+\s+interface",
    "rust": r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+\w+|^\s*(?:pub\s+)?struct\s+\w+|^\s*(?:pub\s+)?enum\s+\w+|^\s*(?:pub\s+)?trait\s+\w+|^\s*impl\s+(?:<\w+>)?\s*\w+",
    "java": r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface|enum)\s+\w+|^\s*(?:public|private|protected)?\s*(?:static\s+)?\w+\s+\w+\s*\(",
    "cpp": r"^\s*(?:template\s*<[^>]+>\s*)?(?:class|struct)\s+\w+|^\s*(?:virtual\s+)?\w+\s+\w+\s*\([^)]*\)\s*(?:const)?\s*[{;]",
    "csharp": r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:class|interface|struct|enum)\s+\w+|^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?\w+\s+\w+\s*\(",
    "ruby": r"^\s*def\s+\w+|^\s*class\s+\w+|^\s*module\s+\w+",
    "php": r"^\s*function\s+\w+|^\s*class\s+\w+|^\s*interface\s+\w+|^\s*trait\s+\w+",
}

BLANK_LINE = rf"\n[{WHITESPACE}]*\n"


def compiled_pattern(pattern: str) -> str:
    """A pattern with ``\\s`` and ``\\w`` spelt out, reading only ``\\n`` as a line end."""
    spelt = pattern.replace(r"\s", f"[{WHITESPACE}]").replace(r"\w", f"[{WORD}]")
    return f"(?md){spelt}"


def _chunk(snippet: Column, meta: Column) -> Column:
    return F.struct(
        F.lit("text").alias("chunk_type"),
        snippet.alias("snippet"),
        meta.alias("position_meta"),
    )


def _result(gist: Column, chunks: Column) -> Column:
    return F.struct(gist.alias("gist"), chunks.alias("chunks"))


def _no_chunks() -> Column:
    return F.array().cast(f"array<{CHUNK_STRUCT.simpleString()}>")


def empty_result() -> Column:
    return _result(F.lit(""), _no_chunks())


def merge_chunks(chunks: Column, cap: int, max_chars: int = SNIPPET_CHARS) -> Column:
    """Join neighbouring pairs, round after round, until at most ``cap`` snippets are left.

    The rounds are a fold whose length is taken from the row itself: pairing is not associative,
    since every round cuts its snippets again.
    """

    def pair(first: Column, second: Column) -> Column:
        page = F.coalesce(
            tx.position_field(first["position_meta"], "page"),
            tx.position_field(second["position_meta"], "page"),
        ).cast("int")
        joined = F.concat(first["snippet"], F.lit(" "), second["snippet"])
        merged = F.struct(
            first["chunk_type"].alias("chunk_type"),
            truncate_words(joined, max_chars).alias("snippet"),
            F.when(page.isNotNull(), tx.position_meta(page=page)).alias("position_meta"),
        )
        return F.when(second.isNull(), first).otherwise(merged)

    def one_round(current: Column, _: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(current) - 1, F.lit(2))
        paired = F.transform(starts, lambda i: pair(F.get(current, i), F.get(current, i + 1)))
        return F.when(F.size(current) > cap, paired).otherwise(current)

    rounds = F.ceil(F.log2(F.size(chunks) / F.lit(cap))).cast("int") + 1
    return F.when(F.size(chunks) <= cap, chunks).otherwise(
        F.aggregate(F.sequence(F.lit(1), rounds), chunks, one_round)
    )


def paragraph_result(content: Column, cap: int = TEXT_CHUNK_CAP) -> Column:
    """Blank-line separated paragraphs, numbered before the empty ones are dropped."""

    def cut(paragraphs: Column) -> Column:
        numbered = F.transform(
            paragraphs, lambda p, i: F.struct(p.alias("body"), i.alias("paragraph"))
        )
        kept = F.slice(F.filter(numbered, lambda p: p["body"] != ""), 1, 2 * cap)
        chunks = F.transform(
            kept,
            lambda p: _chunk(
                truncate_words(p["body"]), tx.position_meta(paragraph=p["paragraph"])
            ),
        )
        substantial = F.get(F.filter(paragraphs, lambda p: F.length(p) > 50), 0)
        gist = gist_of(F.coalesce(substantial, F.get(paragraphs, 0)))
        return _result(gist, let(chunks, lambda c: merge_chunks(c, cap)))

    return let(F.transform(F.split(content, BLANK_LINE), strip), cut)


def fixed_size_result(content: Column, language: Column, cap: int = TEXT_CHUNK_CAP) -> Column:
    """Slices of 1000 characters; blank slices are skipped but keep their offset."""
    pieces = F.regexp_extract_all(content, F.lit(rf"(?s).{{1,{FIXED_CHUNK_CHARS}}}"), F.lit(0))
    numbered = F.transform(
        pieces,
        lambda p, i: F.struct(p.alias("body"), (i * FIXED_CHUNK_CHARS).alias("offset")),
    )
    kept = F.slice(F.filter(numbered, lambda p: ~tx.is_blank(p["body"])), 1, cap)
    chunks = F.transform(
        kept,
        lambda p: _chunk(
            truncate_words(p["body"]),
            tx.position_meta(language=language, offset=p["offset"]),
        ),
    )
    return _result(gist_of(content), chunks)


def _definitions(
    content: Column, language: Column, headers: Column, parts: Column, cap: int
) -> Column:
    """One snippet per definition, from its first character up to the next definition.

    ``headers`` are the matches of the definition pattern, ``parts`` the texts before, between and
    after them: zipped, they are the definitions in order. Text before the first one is dropped.
    """

    def line_ends(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))

    def cut(bodies: Column) -> Column:
        # The line each definition starts on: a running count of the line ends before it.
        first = line_ends(F.get(parts, 0)) + 1
        lines = F.transform(tx.running_sums(F.transform(bodies, line_ends)), lambda n: (n + first).cast("int"))
        chunks = F.zip_with(
            F.arrays_zip(headers.alias("header"), bodies.alias("body")),
            lines,
            lambda d, line: _chunk(
                truncate_words(rstrip(d["body"])),
                tx.position_meta(
                    language=language,
                    line=line,
                    header=F.substring(strip(d["header"]), 1, 80),
                ),
            ),
        )
        gist = gist_of(F.substring(content, 1, 3 * GIST_CHARS))
        return _result(gist, let(chunks, lambda c: merge_chunks(c, cap)))

    rests = F.slice(parts, F.lit(2), F.size(headers))
    return let(F.zip_with(headers, rests, lambda header, rest: F.concat(header, rest)), cut)


def code_result(
    content: Column,
    language: Column,
    cap: int = TEXT_CHUNK_CAP,
    patterns: dict[str, str] = DEFINITION_PATTERNS,
) -> Column:
    """Definitions where the language's pattern finds any, else slices of fixed size."""
    by_language = tx.constant_map({name: compiled_pattern(p) for name, p in patterns.items()})
    pattern = F.element_at(by_language, language)
    found = F.struct(
        language.alias("language"),
        F.regexp_extract_all(content, pattern, F.lit(0)).alias("headers"),
        F.split(content, pattern).alias("parts"),
    )

    def cut(f: Column) -> Column:
        return (
            F.when(f["headers"].isNull() | (content == ""), empty_result())
            .when(
                F.size(f["headers"]) > 0,
                _definitions(content, f["language"], f["headers"], f["parts"], cap),
            )
            .otherwise(fixed_size_result(content, f["language"], cap))
        )

    return let(found, cut)


# Category -> Column builder (content, path) -> struct<gist, chunks>. Categories whose contents
# are not read yet give an empty result, so that switching them on stays harmless.
Chunker = Callable[[Column, Column], Column]
_CHUNKERS: dict[str, Chunker] = {}


def register_chunker(category: str, chunker: Chunker) -> None:
    """Add or replace the chunker of a category."""
    _CHUNKERS[category] = chunker


def get_chunker(category: str) -> Chunker | None:
    return _CHUNKERS.get(category)


def all_chunkers() -> list[tuple[str, Chunker]]:
    """Registered chunkers, the built-in categories first and in their order."""
    known = [c for c in tx.CATEGORIES if c in _CHUNKERS]
    return [(c, _CHUNKERS[c]) for c in known + [c for c in _CHUNKERS if c not in known]]


register_chunker("text", lambda content, path: paragraph_result(content))
register_chunker("code", lambda content, path: code_result(content, tx.language_of(path)))
# The pages of a paged file are rows of their own, see extract_all.
for _category in ("pdf", "office", "image", "video"):
    register_chunker(_category, lambda content, path: empty_result())
_BUILT_IN = dict(_CHUNKERS)


@lru_cache(maxsize=16)
def _dispatch(application: str, content: str, chunkers: tuple[tuple[str, Chunker], ...]) -> Column:
    """The result column over all categories. It names columns only, so that the many small
    batches of a stream need not build the large expression anew; ``application`` ties it to its
    Spark application."""
    result = F.when(F.lit(False), empty_result())
    for category, chunker in chunkers:
        built = chunker(F.col(content), F.col("path"))
        result = result.when(F.col("file_type") == category, built)
    return result


#: Stands for no cap: more chunks than a row can hold.
NO_CAP = 1 << 29


def _capped(cap: int | None) -> dict[str, Chunker]:
    most = NO_CAP if cap is None else cap
    return {
        "text": lambda content, path: paragraph_result(content, most),
        "code": lambda content, path: code_result(content, tx.language_of(path), most),
    }


def extract(files: DataFrame, content: str = "content", cap: int | None = TEXT_CHUNK_CAP) -> DataFrame:
    """Add ``gist`` and ``chunks`` to rows of (path, file_type, content) in one pass.

    ``cap`` bounds the chunks of a text or source file, with the built-in chunkers; None keeps them all. ``error`` names
    what went wrong: a category without a chunker.
    """
    chunkers = tuple(all_chunkers())
    if cap != TEXT_CHUNK_CAP:
        own = _capped(cap)
        chunkers = tuple((c, own[c] if _BUILT_IN.get(c) is chunker and c in own else chunker) for c, chunker in chunkers)
    result = _dispatch(files.sparkSession.sparkContext.applicationId, content, chunkers)
    known = F.col("file_type").isin(*[category for category, _ in chunkers])
    return files.select("*", result.alias("_result")).select(
        *files.columns,
        F.col("_result.gist").alias("gist"),
        F.col("_result.chunks").alias("chunks"),
        F.when(~F.coalesce(known, F.lit(False)), F.lit("no_extractor")).alias("error"),
    )


def extract_pages(
    pages: DataFrame, cap: int = PAGE_CHUNK_CAP, doc: str = "doc_id"
) -> DataFrame:
    """Paged text (doc, page_no, page_text) to one row per document with gist and chunks.

    Every page that is not blank yields a paragraph, so only the first ``2 * cap`` of them can
    matter. The row-number limit is applied on the map side first: a document that owns a third of
    all pages still sends no more than ``2 * cap`` of them from any task.
    """
    limit = 2 * cap
    stripped = pages.select(doc, "page_no", strip(F.col("page_text")).alias("page_text")).filter(
        F.col("page_text") != ""
    )
    in_order = Window.partitionBy(doc).orderBy("page_no")
    first_pages = stripped.withColumn("_rank", F.row_number().over(in_order)).filter(
        F.col("_rank") <= limit
    )
    paragraphs = F.filter(
        F.transform(F.split("page_text", "\n\n"), strip), lambda p: p != ""
    )
    cut = first_pages.select(
        doc,
        "page_no",
        F.when(
            (F.col("page_no") <= 3) & (F.length("page_text") > 50),
            F.substring("page_text", 1, 500),
        ).alias("lead"),
        F.transform(
            F.slice(paragraphs, 1, limit),
            lambda p, i: _chunk(
                truncate_words(p), tx.position_meta(page=F.col("page_no"), paragraph=i)
            ),
        ).alias("chunks"),
    )
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    read = cut.withColumn(
        "_before", F.coalesce(F.sum(F.size("chunks")).over(before), F.lit(0))
    ).filter(F.col("_before") < limit)
    by_doc = read.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct("page_no", "lead", "chunks"))).alias("pages")
    )
    chunks = let(
        F.slice(F.flatten(F.transform("pages", lambda p: p["chunks"])), 1, limit),
        lambda c: merge_chunks(c, cap),
    )
    leads = F.filter(F.transform("pages", lambda p: p["lead"]), lambda t: t.isNotNull())
    built = by_doc.select(doc, leads.alias("leads"), chunks.alias("chunks"))
    return built.select(
        doc,
        gist_of(
            F.when(F.size("leads") > 0, F.array_join("leads", " ")).otherwise(
                F.get(F.col("chunks"), 0)["snippet"]
            )
        ).alias("gist"),
        "chunks",
    )


def extract_all(
    files: DataFrame, pages: DataFrame | None = None, content: str = "content", paged: DataFrame | None = None,
    cap: int | None = TEXT_CHUNK_CAP, page_cap: int | None = PAGE_CHUNK_CAP, owners: DataFrame | None = None,
) -> DataFrame:
    """One row per file with gist and chunks, each file cut as its category asks.

    Paged files take their texts from ``pages`` (file_id, page_no, page_text); without any they
    have an empty gist and no chunks. Contents are dropped here: nothing after needs them.

    Files without a file_id get it from ``owners`` (path, file_id) once they are cut, so that a long list of owners moves no contents; without an owner they are left out.

    The caps bound the chunks of a file, None keeps all. Where reading the contents costs, give the paged files, which need none, as ``paged``; else ``files`` holds both kinds.
    """
    if paged is None:
        is_paged = F.col("file_type").eqNullSafe("pdf")
        files, paged = files.filter(~is_paged), files.filter(is_paged).drop(content)
    in_row = extract(files, content, cap).drop(content)
    if owners is not None:
        in_row = in_row.join(owners, "path")
    if pages is None:
        read = paged.withColumn("gist", F.lit("")).withColumn("chunks", _no_chunks())
    else:
        cut = extract_pages(pages, NO_CAP if page_cap is None else page_cap, doc="file_id")
        read = (
            paged.join(cut, "file_id", "left")
            .withColumn("gist", F.coalesce("gist", F.lit("")))
            .withColumn("chunks", F.coalesce("chunks", _no_chunks()))
        )
    return in_row.unionByName(read.withColumn("error", F.lit(None).cast("string")))


def chunk_id(file_id: Column, ord_: Column) -> Column:
    """The key of a file's chunk."""
    return F.when(ord_ < CHUNK_ID_STRIDE, file_id * CHUNK_ID_STRIDE + ord_).otherwise(
        F.raise_error(F.lit(f"a file has more than {CHUNK_ID_STRIDE} chunks")).cast("long")
    )


def explode_chunks(extracted: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Rows with a ``chunks`` array to chunk rows; ids follow from the file and the order.

    The outer form of explode, since for the inner one Catalyst adds a filter on the size of the
    array, which computes the array, and so the whole cutting, again.
    """
    exploded = extracted.select(
        F.col(file_id).cast("long").alias("file_id"),
        F.posexplode_outer("chunks").alias("ord", "c"),
    )
    return exploded.filter(F.col("ord").isNotNull()).select(
        chunk_id(F.col("file_id"), F.col("ord")).alias("chunk_id"),
        "file_id",
        "ord",
        F.col("c.chunk_type").alias("chunk_type"),
        F.col("c.snippet").alias("snippet"),
        F.col("c.position_meta").alias("position_meta"),
    )
