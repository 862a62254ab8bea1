"""Line dedup: a line that many documents share stays only in the last document that holds it.

The key of a line is the line without ASCII white space at its ends and with A-Z in lower case. Every
line whose key is long enough gives a row of hashes, document and position. These rows are
partitioned by ranges of hashes and sorted by document (largest first) and position within, so that
each task streams through its hashes and marks the first row of every document. As hashes are even, so are
ranges of equal width: nothing is sampled, which would cut and hash all lines once more. A hash is salted
by document before that: a line that a third of all documents hold is spread over many ranges, and its
marks are summed per task before they meet. The result is not text but one keep bitmap for each document
that loses lines: bit ``i`` of the bitmap (byte ``i / 8``, lowest bit first) is 0 where line ``i`` goes. Bitmaps end
at the document's last line, documents that lose nothing have none, and a document of more lines than
one bitmap of Spark holds (32768) has several.

Built with DataFrame functions only. Defined results: a null or empty text is one empty line and keeps it;
a null id counts as one document below all others; rows that repeat an id are one document for counting, and keep
or lose their lines alike; an empty table gives an empty result; columns other than id and text pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.columns import ASCII_SPACE, ascii_lower, fingerprint, once

MIN_CHARS = 20
MIN_DOCUMENTS = 3
SALTS = 64
#: Ranges of hashes for each partition: they are dealt by number, and many of them come out even.
RANGES = 16
BITMAP_BITS = 32768


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _row_key(doc: Column, text: Column) -> list[Column]:
    """Rows of the same id and text are treated alike, so these name a row well enough."""
    first, second = fingerprint(F.coalesce(text, F.lit("")))
    return [doc.alias("doc"), first.alias("t1"), second.alias("t2")]


def drop_positions(docs: DataFrame, id_column: str, text_column: str, min_chars: int, min_documents: int) -> DataFrame:
    """(doc, t1, t2, pos): the lines that go."""
    text = F.col(text_column)
    lines = docs.select(
        *_row_key(F.col(id_column), text), F.posexplode(lines_of(text)).alias("pos", "line")
    ).withColumn("key", line_key(F.col("line")))
    h1, h2 = fingerprint(F.col("key"))
    rows = lines.filter(F.char_length("key") >= min_chars).select(
        h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"),
        "doc", "t1", "t2", "pos",
    )
    # The salt turns the hash's first six bits, so that the rows of a line lie in up to 64 ranges.
    turned = F.col("h1").bitwiseXOR(F.shiftleft(F.col("salt").cast("long"), 58))
    n_ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftright(F.shiftrightunsigned(turned, 33) * n_ranges, 31).cast("int")
    within = Window.partitionBy("_range", "h1", "h2", "salt").orderBy(F.col("doc").desc_nulls_last(), "pos")
    stream = rows.withColumn("_range", place).repartition("_range").withColumn(
        "first", (F.row_number().over(within) == 1) | ~F.col("doc").eqNullSafe(F.lag("doc").over(within))
    )
    stream = once(stream.drop("_range"), "line-stream")
    # Written, so that both sides of the join are plain shuffles, whose hot partitions Spark can split.
    shared = once(
        stream.groupBy("h1", "h2")
        .agg(F.sum(F.col("first").cast("long")).alias("n"), F.max("doc").alias("owner"))
        .filter((F.col("n") >= min_documents) & F.col("owner").isNotNull())
        .select("h1", "h2", "owner"),
        "shared-lines",
    )
    return (
        stream.join(shared, ["h1", "h2"])
        .filter(F.col("doc").isNull() | (F.col("doc") < F.col("owner")))
        .select("doc", "t1", "t2", "pos")
    )


def keep_bitmaps(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """(doc, t1, t2, dropped map<int, binary>): bitmaps of the lines that go, by bucket of 32768 lines, each
    cut after its last set byte, for the documents that lose any line. ``keeps`` reads them."""
    gone = drop_positions(docs, id_column, text_column, min_chars, min_documents)
    bits = gone.groupBy("doc", "t1", "t2", F.bitmap_bucket_number(F.col("pos").cast("long") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("pos").cast("long") + 1)).alias("bits"),
        F.max("pos").alias("last"),
    )
    cut = F.substring("bits", F.lit(1), (F.floor(F.col("last") % BITMAP_BITS / 8) + 1).cast("int"))
    return bits.groupBy("doc", "t1", "t2").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", cut.alias("bits")))).alias("dropped")
    )


def is_dropped(dropped: Column, pos: Column) -> Column:
    """Whether the bitmaps say that line ``pos`` (from 0) goes."""
    bits = dropped[F.floor(pos / BITMAP_BITS).cast("long") + 1]
    place = F.pmod(pos, F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # A byte beyond the end of a bitmap reads as empty, and so as null.
    return F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))


def with_kept_text(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``docs`` with the columns _n_lines, _n_dropped and _kept (the lines that stay, joined by \\n)."""
    bitmaps = keep_bitmaps(docs, id_column, text_column, min_chars, min_documents).select(
        F.col("doc").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("dropped").alias("_gone")
    )
    doc, t1, t2 = _row_key(F.col(id_column), F.col(text_column))
    joined = docs.join(
        bitmaps, doc.eqNullSafe(F.col("_doc")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left"
    )
    lines = lines_of(F.col(text_column))
    kept = F.filter(lines, lambda line, i: ~is_dropped(F.col("_gone"), i))
    text = F.coalesce(F.col(text_column), F.lit(""))
    gone = F.col("_gone").isNotNull()
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.size(lines).cast("long").alias("_n_lines"),
        F.when(gone, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("_n_dropped"),
        F.when(gone, F.array_join(kept, "\n")).otherwise(text).alias("_kept"),
    )
