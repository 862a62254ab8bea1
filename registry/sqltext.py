"""SQL counterparts of the column functions and input tables, as text."""

from __future__ import annotations

# Stated here once more, so that the SQL does not follow the code that it judges.
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\pL\pN_]"

# File extensions per category and per programming language.
_CATEGORIES = """
text: txt md markdown rst text
code: py pyw pyi js jsx mjs cjs ts tsx go rs java cpp cc cxx hpp h hxx cs rb php
pdf: pdf
office: docx doc odt
image: jpg jpeg png gif bmp webp tiff
video: mp4 mov avi mkv webm"""
_LANGUAGES = """
python: py pyw pyi
javascript: js jsx mjs cjs
typescript: ts tsx
go: go
rust: rs
java: java
cpp: cpp cc cxx hpp h hxx
csharp: cs
ruby: rb
php: php"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def truncate(x: str, n: int, var: str = "cut") -> str:
    space = f"length({var}) - position(' ' IN reverse({var}))"
    return (
        f"CASE WHEN length({x}) <= {n} THEN {x} ELSE list_transform("
        f"[{rstrip(f'substr({x}, 1, {n})')}], lambda {var}: "
        f"CASE WHEN contains({var}, ' ') AND {space} > {n * 0.7} "
        f"THEN substr({var}, 1, {space}) ELSE {var} END || '…')[1] END"
    )


def lookup(ext: str, table: str) -> str:
    rows = [line.split(": ") for line in table.strip().split("\n")]
    arms = " ".join(
        f"WHEN {ext} IN ({', '.join(repr(e) for e in names.split())}) THEN '{key}'" for key, names in rows
    )
    return f"CASE {arms} END"


def extension(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/\\]\.([^./\\]+)$', 1))"


def category(path: str) -> str:
    return lookup(extension(path), _CATEGORIES)


def language(path: str) -> str:
    return lookup(extension(path), _LANGUAGES)


def tokens(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def merge_round(chunks: str, cap: int, j: str = "j") -> str:
    """One round of pairing over a list of {snippet, meta}; metas are dropped."""
    joined = truncate(f"({chunks}[2*{j}+1].snippet || ' ' || {chunks}[2*{j}+2].snippet)", 150, f"cut{j}")
    return (
        f"CASE WHEN len({chunks}) <= {cap} THEN {chunks} ELSE "
        f"list_transform(range((len({chunks}) + 1) // 2), lambda {j}: "
        f"CASE WHEN 2*{j}+2 <= len({chunks}) "
        f"THEN {{'snippet': {joined}, 'meta': CAST(NULL AS VARCHAR)}} "
        f"ELSE {chunks}[2*{j}+1] END) END"
    )


EXTENSIONS = (".md", ".py", ".txt", ".rs", ".pdf", ".docx", ".png", ".bin")

# files: one per document, see registry.inputs.files
FILES = f"""
files AS (
  SELECT doc_id AS file_id,
         '/' || source || '/' || lang || '/d' || doc_id
           || (['{"', '".join(EXTENSIONS)}'])[doc_id % 8 + 1] AS path,
         CAST(substr(source, 4) AS BIGINT) AS location_id,
         {category("(['" + "', '".join(EXTENSIONS) + "'])[doc_id % 8 + 1]").replace("[^/\\\\]", "")} AS file_type,
         sha256(text) AS content_hash,
         1000.0::DOUBLE + doc_id AS mtime,
         CAST(strlen(text) AS BIGINT) AS size_bytes,
         CASE doc_id % 10 WHEN 7 THEN 'pending' WHEN 8 THEN 'error' WHEN 9 THEN 'skipped'
              ELSE 'indexed' END AS status
  FROM documents)"""

# paras: stripped paragraphs of every document, each line being one
PARAS = rf"""
paras AS (
  SELECT doc_id, list_transform(
           string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n{WS}*\n'),
           lambda p: {strip('p')}) AS ps
  FROM documents)"""


def chunks(cap: int = 150, rounds: int = 1) -> str:
    """kept -> merged -> chunks(chunk_id, file_id, ord, chunk_type, snippet, position_meta)."""
    steps, last = [], "kept"
    for r in range(rounds):
        name = f"merged{r}"
        steps.append(f"{name} AS (SELECT doc_id, {merge_round('c', cap)} AS c FROM {last})")
        last = name
    merged = ",\n".join(steps)
    return rf"""
{PARAS},
kept AS (
  SELECT doc_id, list_transform(
           list_filter(list_transform(ps, lambda p, i: {{'b': p, 'i': i - 1}}),
                       lambda s: s.b <> '')[1:{2 * cap}],
           lambda s: {{'snippet': {truncate('s.b', 150)},
                       'meta': '{{"paragraph":' || s.i || '}}'}}) AS c
  FROM paras),
{merged},
numbered AS (
  SELECT doc_id, generate_subscripts(c, 1) - 1 AS ord, unnest(c) AS k FROM {last}),
chunks AS (
  SELECT doc_id * 16777216 + ord AS chunk_id, doc_id AS file_id, CAST(ord AS INTEGER) AS ord,
         'text' AS chunk_type, k.snippet AS snippet, k.meta AS position_meta
  FROM numbered)"""


# toks: every token with its position; postings and corpus as the index holds them
TOKS = rf"""
toklists AS (SELECT chunk_id, file_id, {tokens('snippet')} AS ts FROM chunks),
toks AS (
  SELECT chunk_id, file_id, len(ts) AS chunk_len, unnest(ts) AS term,
         generate_subscripts(ts, 1) - 1 AS pos
  FROM toklists),
postings AS (
  SELECT term, chunk_id, file_id, chunk_len, count(*) AS tf, list(pos ORDER BY pos) AS positions
  FROM toks GROUP BY ALL),
corpus AS (
  SELECT count(*) AS n_chunks, CAST(sum(len(ts)) AS BIGINT) AS n_tokens,
         sum(len(ts)) / count(*) AS avg_len FROM toklists)"""


def share(n_times: str, df: str, tf: str, chunk_len: str) -> str:
    """A phrase's share of BM25; needs corpus in the FROM clause."""
    idf = f"ln((n_chunks - {df} + 0.5) / ({df} + 0.5))"
    return (
        f"-({n_times}) * (CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END) * {tf} * 2.2::DOUBLE "
        f"/ ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {chunk_len} / avg_len))"
    )


# Fixed values of the splitmix64 generator.
_STEP = 0x9E3779B97F4A7C15
_MIX_1 = 0xBF58476D1CE4E5B9
_MIX_2 = 0x94D049BB133111EB


def _splitmix(state: str) -> str:
    """One generator step over 64-bit states held as UBIGINT."""
    two64 = "18446744073709551616::UHUGEINT"

    def times(x: str, factor: int) -> str:
        return f"CAST((({x})::UHUGEINT * {factor}::UHUGEINT) % {two64} AS UBIGINT)"

    added = f"CAST((({state})::UHUGEINT + {_STEP}::UHUGEINT) % {two64} AS UBIGINT)"
    first = f"list_transform([{added}], lambda a: {times('xor(a, a >> 30)', _MIX_1)})[1]"
    second = f"list_transform([{first}], lambda b: {times('xor(b, b >> 27)', _MIX_2)})[1]"
    return f"list_transform([{second}], lambda c: xor(c, c >> 31))[1]"


_SEED = "CAST('0x' || " + " || ".join(f"substr(md5(snippet), {i}, 2)" for i in range(15, 0, -2)) + " AS UBIGINT)"


def hashed_units() -> str:
    """units(snippet, d, u): the components of the hashed vectors of texts(snippet); WITH must be RECURSIVE."""
    return f"""draws AS (
          SELECT snippet, 1 AS d, {_splitmix(_SEED)} AS x FROM texts
          UNION ALL
          SELECT snippet, d + 1, {_splitmix('x')} FROM draws WHERE d < 384),
        raw AS (
          SELECT snippet, d, CAST((x & 4294967295)::DOUBLE / 4294967295::DOUBLE * 2::DOUBLE - 1::DOUBLE AS FLOAT)::DOUBLE AS v
          FROM draws),
        lengths AS (SELECT snippet, sqrt(sum(v * v)) AS norm FROM raw GROUP BY snippet),
        units AS (
          SELECT snippet, d, CAST(v / norm AS FLOAT)::DOUBLE AS u FROM raw JOIN lengths USING (snippet))"""
