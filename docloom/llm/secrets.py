"""Secret scan with corpus-wide ownership frequency.

Three base patterns (assignments of passwords and the like, access key ids, long hexadecimal runs) always report.
A wider pattern finds candidates: long runs of letters and digits of mixed kinds. Every value, of base
spans and of candidates, is hashed, and the hashes are counted over the whole corpus by distinct owner and by distinct
repository (owner, repository). A value that many owners hold is an example that was copied; a value that one
owner keeps, in few repositories, looks live. Live-looking candidates add spans of kind ``live`` to the base.

Positions come without Python: the texts between matches (``split``) and the matches (``regexp_extract_all``)
alternate, so a running sum of their lengths gives every start, in code points.

Counting never gathers a value's rows: (value, owner, repository) are made distinct with partial sums in every
task, so a value that a third of all documents hold arrives as one row for each owner, repository and task.

Built with DataFrame functions only. Defined results: a null text is empty and has no spans; a null owner or repository counts as one of
its own; rows of equal id and text share their result; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import fingerprint, once

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for the length in the pattern finds the same matches as dropping short ones later.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "live")

MIN_SECRET = 8
#: At most so many owners and repositories hold a live-looking value.
MAX_OWNERS = 1
MAX_REPOSITORIES = 2

#: Positions are summed in blocks, so that the work is in proportion to the number of matches.
BLOCK = 256

_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches as (start, end, kind, value), value being the given group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"),
        F.transform(found, F.char_length).alias("size"),
        values.alias("value"),
    )
    size = F.size(pairs)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")),
        lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)),
    )

    def length(pair: Column) -> Column:
        return pair["gap"] + F.coalesce(pair["size"], F.lit(0))

    begins = F.aggregate(
        F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, pair: n + length(pair))),
        F.array(F.lit(0)),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )

    def step(done: Column, pair: Column) -> Column:
        at = done["at"] + pair["gap"]
        span = F.struct(
            at.alias("start"), (at + pair["size"]).alias("end"), F.lit(kind).alias("kind"),
            pair["value"].alias("value"),
        )
        more = F.when(pair["size"].isNotNull(), F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((done["at"] + length(pair)).alias("at"), more.alias("spans"))

    def located(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("spans"))
        return F.aggregate(block, start, step, lambda done: done["spans"])

    spans = F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), located))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def base_spans(text: Column) -> Column:
    """All base spans of a text, unsorted."""
    assigned = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= MIN_SECRET)
    return F.concat(assigned, _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def candidate_spans(text: Column) -> Column:
    """Runs of 20 or more characters that mix digits with capital and small letters."""
    return F.filter(
        _spans(text, CANDIDATE, 3),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"),
    )


def ownership(spans: DataFrame, owner_column: str, repository_columns: tuple[str, ...]) -> DataFrame:
    """(v1, v2, n_owners, n_repositories) of the values in ``spans`` (v1, v2, owner, repository columns)."""
    places = spans.select("v1", "v2", owner_column, *repository_columns).distinct()
    # Distinct places first: what is counted per value is bounded by owners and repositories, not by documents.
    by_owner = places.groupBy("v1", "v2", owner_column).agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("v1", "v2").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner_column: str = "source",
    repository_columns: tuple[str, ...] = ("lang",),
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """Per row of ``docs``: id, spans array of (start, end, kind, value, n_owners, live), sorted by start, then kind."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    t1, t2 = fingerprint(text)
    found = once(
        docs.select(
            F.col(id_column).alias("id"), t1.alias("t1"), t2.alias("t2"),
            F.col(owner_column).alias("owner"),
            *[F.col(c).alias(f"repository{i}") for i, c in enumerate(repository_columns)],
            F.concat(base_spans(text), candidate_spans(text)).alias("spans"),
        ),
        "secret-spans",
    )
    v1, v2 = fingerprint(F.col("span.value"))
    places = [f"repository{i}" for i in range(len(repository_columns))]
    one = found.filter(F.size("spans") > 0).select(
        "id", "t1", "t2", "owner", *places, F.explode("spans").alias("span")
    ).select("*", v1.alias("v1"), v2.alias("v2"))
    counts = ownership(one, "owner", tuple(places))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = (
        one.select("id", "t1", "t2", "span", "v1", "v2").distinct()
        .join(counts, ["v1", "v2"])
        .withColumn("live", live)
        .filter((F.col("span.kind") < 3) | F.col("live"))
        .groupBy("id", "t1", "t2")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("span.start").alias("start"), F.col("span.kind").alias("kind"),
                        F.col("span.end").alias("end"), F.col("span.value").alias("value"), "n_owners", "live",
                    )
                )
            ).alias("judged")
        )
    )
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"j.{c}")) for c in ("id", "t1", "t2")]
    return (
        found.alias("f").join(judged.alias("j"), same[0] & same[1] & same[2], "left")
        .select(F.col("f.id").alias(id_column), F.coalesce("judged", F.array()).alias("spans"))
    )


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
