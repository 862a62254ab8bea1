"""Chunk extraction over whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import chunking
from registry import inputs, sqltext
from registry.base import query

_CHUNK_COLUMNS = "chunk_id, file_id, ord, chunk_type, snippet, position_meta"


@query(
    "chunk_paragraphs", f"WITH {sqltext.chunks()} SELECT {_CHUNK_COLUMNS} FROM chunks"
)
def chunk_paragraphs(spark, sf_dir):
    return inputs.cut_chunks(spark, sf_dir)


def _merge_sql() -> str:
    """Every paragraph kept, halved until at most 20 are left: one step per possible round."""
    rounds = 10
    steps, last = [], "cut_all"
    for r in range(rounds):
        steps.append(
            f"round{r} AS MATERIALIZED (SELECT doc_id, {sqltext.merge_round('c', 20)} AS c FROM {last})"
        )
        last = f"round{r}"
    return f"""WITH {sqltext.PARAS},
cut_all AS (
  SELECT doc_id, list_transform(
           list_filter(list_transform(ps, lambda p, i: {{'b': p, 'i': i - 1}}), lambda s: s.b <> ''),
           lambda s: {{'snippet': {sqltext.truncate('s.b', 150)},
                       'meta': '{{"paragraph":' || s.i || '}}'}}) AS c
  FROM paras),
{", ".join(steps)},
numbered AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS ord, unnest(c) AS k FROM {last})
SELECT doc_id AS file_id, CAST(ord AS INTEGER) AS ord, k.snippet AS snippet, k.meta AS position_meta
FROM numbered"""


@query("merge_chunks", _merge_sql())
def merge_chunks(spark, sf_dir):
    texts = inputs.paragraphs(spark, sf_dir)
    # A cap that no document reaches keeps every paragraph; the merge then halves them to 20.
    result = chunking.paragraph_result(F.col("content"), cap=1_000_000)
    merged = texts.select("file_id", result["chunks"].alias("chunks")).select(
        "file_id", F.posexplode(chunking.merge_chunks(F.col("chunks"), 20)).alias("ord", "c")
    )
    return merged.select("file_id", "ord", "c.snippet", "c.position_meta")


@query(
    "text_gist",
    f"""WITH {sqltext.PARAS}
        SELECT doc_id AS file_id, {sqltext.truncate(
            "coalesce(list_filter(ps, lambda p: length(p) > 50)[1], ps[1])", 300)} AS gist
        FROM paras""",
)
def text_gist(spark, sf_dir):
    return inputs.paragraphs(spark, sf_dir).select(
        "file_id", chunking.paragraph_result(F.col("content"))["gist"].alias("gist")
    )


_DEF = rf"(?m)^{sqltext.WS}*(?:async{sqltext.WS}+)?def{sqltext.WS}+{sqltext.WORD}+|^{sqltext.WS}*class{sqltext.WS}+{sqltext.WORD}+"
_CODE_TEXT = "('import x' || chr(10) || chr(10) || 'def ' || replace(text, chr(10), chr(10) || chr(10) || 'def '))"


def _code_sql(language: str = "python", text: str = _CODE_TEXT, pattern: str = _DEF, documents: str = "documents") -> str:
    steps, last = [], "cut_code"
    for r in range(4):
        steps.append(
            f"round{r} AS MATERIALIZED (SELECT doc_id, {sqltext.merge_round('c', 150)} AS c FROM {last})"
        )
        last = f"round{r}"
    return rf"""WITH code AS (SELECT doc_id, {text} AS content FROM {documents}),
found AS (
  SELECT doc_id, content, regexp_extract_all(content, '{pattern}') AS headers,
         string_split_regex(content, '{pattern}') AS parts
  FROM code),
bodies AS (
  SELECT doc_id, headers, parts[1] AS lead,
         list_transform(headers, lambda h, i: h || parts[i + 1]) AS bs
  FROM found WHERE len(headers) > 0),
lines AS (
  SELECT doc_id, headers, bs, list_transform(bs, lambda b, i:
           1 + length(array_to_string(list_prepend(lead, bs[1:i-1]), ''))
             - length(replace(array_to_string(list_prepend(lead, bs[1:i-1]), ''), chr(10), ''))) AS ls
  FROM bodies),
cut_code AS (
  SELECT doc_id, list_transform(bs, lambda b, i: {{
           'snippet': {sqltext.truncate('list_transform([b], lambda w: ' + sqltext.rstrip('w') + ')[1]', 150)},
           'meta': '{{"language":"{language}","line":' || ls[i] || ',"header":"'
                   || substr({sqltext.strip('headers[i]')}, 1, 80) || '"}}'}}) AS c
  FROM lines),
{", ".join(steps)},
fixed AS (
  SELECT doc_id, unnest(list_filter(list_transform(
           list_transform(range(0, length(content), 1000), lambda o: substr(content, o + 1, 1000)), lambda p, i: {{'b': p, 'o': (i - 1) * 1000}}),
           lambda s: {sqltext.strip('s.b')} <> '')[1:150]) AS s,
         generate_subscripts(list_filter(list_transform(range(0, length(content), 1000), lambda o: substr(content, o + 1, 1000)),
           lambda p: {sqltext.strip('p')} <> '')[1:150], 1) - 1 AS ord
  FROM found WHERE len(headers) = 0),
numbered AS (
  SELECT doc_id, generate_subscripts(c, 1) - 1 AS ord, unnest(c) AS k FROM {last})
SELECT doc_id * 16777216 + ord AS chunk_id, doc_id AS file_id, CAST(ord AS INTEGER) AS ord,
       'text' AS chunk_type, k.snippet AS snippet, k.meta AS position_meta FROM numbered
UNION ALL
SELECT doc_id * 16777216 + ord, doc_id, CAST(ord AS INTEGER), 'text', {sqltext.truncate('s.b', 150)},
       '{{"language":"{language}","offset":' || s.o || '}}' FROM fixed"""


CODE_CHUNKS = _code_sql()


@query("chunk_code", CODE_CHUNKS)
def chunk_code(spark, sf_dir):
    return chunking.explode_chunks(chunking.extract(inputs.code(spark, sf_dir)))


# Languages by document, with the word that makes a definition of each of its lines.
_KEYWORDS = (
    ("python", "py", "def"), ("javascript", "js", "function"), ("typescript", "ts", "interface"), ("go", "go", "func"), ("rust", "rs", "fn"),
    ("java", "java", "class"), ("cpp", "cpp", "struct"), ("csharp", "cs", "enum"), ("ruby", "rb", "module"), ("php", "php", "trait"),
)


def _languages_sql() -> str:
    parts = []
    for i, (language, _, word) in enumerate(_KEYWORDS):
        spelt = chunking.DEFINITION_PATTERNS[language].replace(r"\s", sqltext.WS).replace(r"\w", sqltext.WORD)
        text = f"('import x' || chr(10) || chr(10) || '{word} ' || replace(text, chr(10), chr(10) || chr(10) || '{word} '))"
        rows = f"(SELECT * FROM documents WHERE doc_id % {len(_KEYWORDS)} = {i})"
        parts.append(f"SELECT * FROM ({_code_sql(language, text, '(?m)' + spelt, rows)})")
    return " UNION ALL ".join(parts)


@query("chunk_languages", _languages_sql())
def chunk_languages(spark, sf_dir):
    """All documents as source code, each in one of ten languages."""
    kind = (F.col("doc_id") % len(_KEYWORDS)).cast("int")
    suffix = F.get(F.array(*[F.lit(f".{ext}") for _, ext, _ in _KEYWORDS]), kind)
    word = F.concat(F.get(F.array(*[F.lit(word) for _, _, word in _KEYWORDS]), kind), F.lit(" "))
    code = inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/d"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.lit("code").alias("file_type"),
        F.concat(F.lit("import x\n\n"), word, F.replace("text", F.lit("\n"), F.concat(F.lit("\n\n"), word))).alias("content"),
    )
    return chunking.explode_chunks(chunking.extract(code))


@query(
    "code_gist",
    f"""SELECT doc_id AS file_id, {sqltext.truncate(f"substr({_CODE_TEXT}, 1, 900)", 300)} AS gist
        FROM documents""",
)
def code_gist(spark, sf_dir):
    return chunking.extract(inputs.code(spark, sf_dir)).select("file_id", "gist")


_FIXED = "list_transform(range(0, length(text), 1000), lambda o: substr(text, o + 1, 1000))"


@query(
    "chunk_fixed",
    f"""WITH cut AS (
          SELECT doc_id, list_filter(list_transform({_FIXED}, lambda p, i: {{'b': p, 'o': (i - 1) * 1000}}),
                   lambda s: {sqltext.strip('s.b')} <> '')[1:150] AS c FROM documents),
        numbered AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS ord, unnest(c) AS s FROM cut)
        SELECT doc_id * 16777216 + ord AS chunk_id, doc_id AS file_id, CAST(ord AS INTEGER) AS ord,
               'text' AS chunk_type, {sqltext.truncate('s.b', 150)} AS snippet,
               '{{"language":"python","offset":' || s.o || '}}' AS position_meta FROM numbered""",
)
def chunk_fixed(spark, sf_dir):
    texts = inputs.documents(spark, sf_dir)
    cut = chunking.fixed_size_result(F.col("text"), F.lit("python"))
    return chunking.explode_chunks(
        texts.select(F.col("doc_id").alias("file_id"), cut["chunks"].alias("chunks"))
    )


_PAGES = rf"""
stripped AS (
  SELECT conv_id AS doc_id, turn + 1 AS page_no,
         {sqltext.strip("replace(text, chr(10), chr(10) || chr(10))")} AS page_text
  FROM conversations),
page_paras AS (
  SELECT doc_id, page_no, page_text, list_filter(list_transform(
           string_split(page_text, chr(10) || chr(10)), lambda p: {sqltext.strip('p')}),
           lambda p: p <> '') AS ps
  FROM stripped WHERE page_text <> ''),
all_paras AS (
  SELECT doc_id, page_no, generate_subscripts(ps, 1) - 1 AS paragraph, unnest(ps) AS body
  FROM page_paras),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, paragraph) - 1 AS ord
  FROM all_paras),
first_chunks AS (
  SELECT doc_id, ord, {sqltext.truncate('body', 150)} AS snippet,
         '{{"page":' || page_no || ',"paragraph":' || paragraph || '}}' AS meta
  FROM placed WHERE ord < 400)"""


@query(
    "chunk_pages",
    f"""WITH {_PAGES}
        SELECT doc_id * 16777216 + ord AS chunk_id, doc_id AS file_id, CAST(ord AS INTEGER) AS ord,
               'text' AS chunk_type, snippet, meta AS position_meta FROM first_chunks""",
)
def chunk_pages(spark, sf_dir):
    return chunking.explode_chunks(
        chunking.extract_pages(inputs.paged(spark, sf_dir)), file_id="doc_id"
    )


@query(
    "page_gist",
    f"""WITH {_PAGES},
        leads AS (
          SELECT doc_id, array_to_string(list(substr(page_text, 1, 500) ORDER BY page_no)
                   FILTER (WHERE page_no <= 3 AND length(page_text) > 50), ' ') AS lead
          FROM page_paras GROUP BY doc_id)
        SELECT leads.doc_id, {sqltext.truncate("coalesce(lead, snippet)", 300)} AS gist
        FROM leads JOIN first_chunks ON leads.doc_id = first_chunks.doc_id AND ord = 0""",
)
def page_gist(spark, sf_dir):
    return chunking.extract_pages(inputs.paged(spark, sf_dir)).select("doc_id", "gist")


_EXTRACT_TEXT = f"""
routed AS (SELECT file_id, path, file_type, replace(text, chr(10), chr(10) || chr(10)) AS content
           FROM files JOIN documents ON file_id = doc_id)"""


# The paged files among the documents, a line being a page: their chunks and gists.
SHEETS = rf"""
    sheets AS (
      SELECT file_id, list_filter(list_transform(string_split(text, chr(10)),
               lambda p: {sqltext.strip('p')}), lambda p: p <> '') AS ps
      FROM files JOIN documents ON file_id = doc_id WHERE file_type = 'pdf'),
    sheet_lists AS (
      SELECT file_id, list_transform(ps[1:400], lambda p:
               {{'snippet': {sqltext.truncate('p', 150)}, 'meta': CAST(NULL AS VARCHAR)}}) AS c
      FROM sheets),
    sheet_merged AS (SELECT file_id, {sqltext.merge_round('c', 200)} AS c FROM sheet_lists),
    sheet_chunks AS (
      SELECT file_id, generate_subscripts(c, 1) - 1 AS ord, unnest(c) AS k FROM sheet_merged),
    sheet_gists AS (
      SELECT file_id, array_to_string(list_transform(list_filter(
               list_transform(string_split(text, chr(10)), lambda p: {sqltext.strip('p')})[1:3],
               lambda p: length(p) > 50), lambda p: substr(p, 1, 500)), ' ') AS leads
      FROM files JOIN documents ON file_id = doc_id WHERE file_type = 'pdf')"""


@query(
    "extract_all",
    rf"""WITH {sqltext.FILES}, {sqltext.chunks()}, {_EXTRACT_TEXT},
    sliced AS (
      SELECT file_id, list_filter(list_transform(range(0, length(content), 1000),
               lambda o: substr(content, o + 1, 1000)), lambda p: {sqltext.strip('p')} <> '')[1:150] AS ps
      FROM routed WHERE file_type = 'code'),
    code_chunks AS (
      SELECT file_id, generate_subscripts(ps, 1) - 1 AS ord, unnest(ps) AS body FROM sliced),
    {SHEETS},
    cut AS (
      SELECT file_id, CAST(ord AS INTEGER) AS ord, snippet FROM chunks
      WHERE file_id IN (SELECT file_id FROM files WHERE file_type = 'text')
      UNION ALL
      SELECT file_id, CAST(ord AS INTEGER), {sqltext.truncate('body', 150)} FROM code_chunks
      UNION ALL
      SELECT file_id, CAST(ord AS INTEGER), k.snippet FROM sheet_chunks)
    SELECT r.file_id, r.file_type, c.ord, c.snippet,
           CASE r.file_type
             WHEN 'text' THEN (SELECT {sqltext.truncate(
               "coalesce(list_filter(ps, lambda p: length(p) > 50)[1], ps[1])", 300)}
               FROM paras WHERE doc_id = r.file_id)
             WHEN 'code' THEN {sqltext.truncate('r.content', 300)}
             WHEN 'pdf' THEN coalesce(
               (SELECT CASE WHEN leads <> '' THEN {sqltext.truncate('leads', 300)} END
                FROM sheet_gists g WHERE g.file_id = r.file_id),
               (SELECT k.snippet FROM sheet_chunks s WHERE s.file_id = r.file_id AND s.ord = 0), '')
             WHEN 'office' THEN '' WHEN 'image' THEN '' END AS gist,
           CASE WHEN r.file_type IN ('text', 'code', 'pdf', 'office', 'image') THEN NULL
                ELSE 'no_extractor' END AS error
    FROM routed r LEFT JOIN cut c ON r.file_id = c.file_id""",
)
def extract_all(spark, sf_dir):
    """Each file by its category; files without snippets stay, with their gist."""
    texts = inputs.paragraphs(spark, sf_dir).select("file_id", "content")
    files = inputs.files(spark, sf_dir).select("file_id", "path", "file_type")
    extracted = chunking.extract_all(files.join(texts, "file_id"), inputs.sheets(spark, sf_dir))
    return extracted.select(
        "file_id", "file_type", "gist", "error", F.posexplode_outer("chunks").alias("ord", "c")
    ).select("file_id", "file_type", "ord", F.col("c.snippet").alias("snippet"), "gist", "error")
