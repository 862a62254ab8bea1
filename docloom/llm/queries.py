"""The operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe_automaton, chat, contamination, lexical, line_dedup, maxent, packing, quality, secrets, simhash, structure_repair, token_files, url_filter
from docloom.llm.columns import once, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_simhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("_fp0")).alias("fingerprint"), "component_id")


@query(
    "op2_decontaminate",
    r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item_words AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
places AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p
  FROM item_words WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win FROM places),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT row_id, size, unnest(range(1, len(w) - size + 2)) AS p FROM words, sizes WHERE len(w) >= size),
found AS (
  SELECT s.row_id, s.size, s.p, item_id
  FROM starts s JOIN words d USING (row_id)
  JOIN windows i ON i.size = s.size AND i.win = array_to_string(list_slice(d.w, s.p, s.p + s.size - 1), ' ')),
hits AS (SELECT row_id, count(DISTINCT q) AS n FROM (
  SELECT row_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY row_id),
items AS (SELECT row_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (
  SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hits h USING (row_id) LEFT JOIN items i USING (row_id)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.with_findings(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hits = contamination.n_hit(F.col("_found.spans"))
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_found.items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query(
    "op3_url_filter",
    r"""
WITH rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS row_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT row_id, rhost || rpath AS rule, verdict FROM parts JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length(rhost || rpath) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (row_id)""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    index = url_filter.build_index(rules)
    return url_filter.judge(table(spark, sf_dir, "pages"), index, "page_id", "url")


@query("op4_lm_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = once(quality.with_measures(docs, keep=["doc_id", "lang"]), "measured")
    return quality.judge(measured).select(
        "doc_id",
        *[F.col(f"_quality.{c}").alias(c) for c in quality.COUNTS],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        *[F.col(f"_quality.{c}").alias(c) for c in quality.SHARES],
    )


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read(token_files.write(docs, token_files.new_folder(spark)))


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = chat.repair(table(spark, sf_dir, "conversations"))
    return repaired.select(
        "conv_id", "turn", "role", F.col("_done").alias("done"), F.col("_new_role").alias("new_role"),
        F.col("_inserted").alias("n_inserted"), F.col("_cost").alias("cost"), F.col("_piece").alias("rendered"),
    )


@query(
    "op8_line_dedup",
    r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT row_id, doc_id, line, pos, coalesce(doc_id < owner, false) AS gone FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id, doc_id""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.with_kept_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


@query("op11_bpe_automaton")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_automaton.encode(table(spark, sf_dir, "documents"), add=("_n_tokens", "_id_text", "_decoded"), keep=["doc_id"])
    return encoded.select(
        "doc_id",
        F.col("_n_tokens").alias("n_tokens"),
        F.sha2(F.col("_id_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op12_ranked_search",
    r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM words),
occurrences AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM words) GROUP BY ALL),
item_terms AS (
  SELECT item_row, term, count(*) AS times FROM (
    SELECT item_row, unnest(list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
    FROM (SELECT row_number() OVER () AS item_row, text FROM benchmark))
  GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM occurrences, totals WHERE term IN (SELECT term FROM item_terms) GROUP BY term, N),
lengths AS (SELECT row_id, doc_id, 100 - 75 + ((75 * len(w) * N) // L) AS m FROM words, totals WHERE len(w) > 0),
scored AS (
  SELECT item_row, row_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id
  FROM item_terms JOIN weights USING (term) JOIN occurrences USING (term) JOIN lengths USING (row_id)
  GROUP BY item_row, row_id),
ranked AS (
  SELECT item_row, doc_id, score, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked
JOIN (SELECT row_number() OVER () AS item_row, item_id FROM benchmark) USING (item_row) WHERE rank <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_structure_repair",
    """
WITH RECURSIVE hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS damage
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE damage <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place
  FROM hurt),
faults AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
  FROM placed),
-- From the last turn to the first: for each state (1 none yet, 2 system, 3 user, 4 assistant) cost, edits and lines of the best end.
ends AS (
  SELECT conv_id, max(place) + 1 AS place, [
      {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}, {'cost': 4, 'audit': 'II', 'lines': ['user:', 'assistant:']},
      {'cost': 2, 'audit': 'I', 'lines': ['assistant:']}, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}] AS best
  FROM faults GROUP BY conv_id
  UNION ALL
  SELECT conv_id, place, list_transform([1, 2, 3, 4], lambda s: list_min([
      turned[s],
      {'cost': turned[CASE WHEN s = 3 THEN 4 ELSE 3 END].cost + 2, 'audit': 'I' || turned[CASE WHEN s = 3 THEN 4 ELSE 3 END].audit,
       'lines': list_prepend(CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END, turned[CASE WHEN s = 3 THEN 4 ELSE 3 END].lines)},
      {'cost': turned[CASE WHEN s = 3 THEN 3 ELSE 4 END].cost + 4, 'audit': 'II' || turned[CASE WHEN s = 3 THEN 3 ELSE 4 END].audit,
       'lines': list_concat(CASE WHEN s = 3 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END, turned[CASE WHEN s = 3 THEN 3 ELSE 4 END].lines)}]))
  FROM (
    SELECT f.conv_id, f.place, list_transform([1, 2, 3, 4], lambda s: list_min([
        {'cost': best[s].cost + 3, 'audit': 'D' || best[s].audit, 'lines': best[s].lines},
        CASE WHEN fault NOT IN ('blank', 'duplicate') AND (initial = 's' AND s = 1 OR initial = 'u' AND s <> 3 OR initial = 'a' AND s = 3) THEN
          {'cost': best[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].cost + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END,
           'audit': 'K' || best[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].audit,
           'lines': list_prepend(role || ':' || text, best[CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].lines)} END,
        CASE WHEN fault NOT IN ('blank', 'duplicate') THEN
          {'cost': best[CASE WHEN s = 3 THEN 4 ELSE 3 END].cost + 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END,
           'audit': 'R' || best[CASE WHEN s = 3 THEN 4 ELSE 3 END].audit,
           'lines': list_prepend(CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || text, best[CASE WHEN s = 3 THEN 4 ELSE 3 END].lines)} END])) AS turned
    FROM ends e JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.place = e.place - 1)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best[1].cost, 0) AS BIGINT) AS cost,
  coalesce(best[1].audit, '') AS audit, sha256(coalesce(array_to_string(best[1].lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN (SELECT * FROM ends WHERE place = 1) e ON e.conv_id IS NOT DISTINCT FROM i.conv_id""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = structure_repair.summary(structure_repair.repair(structure_repair.damaged(conversations)))
    every = conversations.select("conv_id").distinct().withColumn("_group", structure_repair.conversation_key(F.col("conv_id")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, "_group", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
