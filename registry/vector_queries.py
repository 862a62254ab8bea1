"""Embeddings and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import vectors as vec
from docloom.operators import cells, embedding, nearest
from docloom.sources.sizes import broadcast_if_small
from registry import inputs, sqltext
from registry.base import query


def centroids(spark, sf_dir):
    """The mean vector of every label: (query_id, embedding)."""
    cells = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("query_id"), F.posexplode("embedding").alias("pos", "x")
    )
    return (
        cells.groupBy("query_id", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
        .select("query_id", F.transform("cells", lambda c: c["x"]).alias("embedding"))
    )


CENTROIDS = """
cells AS (
  SELECT CAST(label AS BIGINT) AS query_id, generate_subscripts(embedding, 1) AS pos,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT query_id, pos, avg(x) AS x FROM cells GROUP BY ALL),
centroids AS (SELECT query_id, list(x ORDER BY pos) AS centroid FROM means GROUP BY query_id)"""

_DISTANCE = "round(list_cosine_distance(CAST(embedding AS DOUBLE[]), centroid), 9)"


@query(
    "cosine_distance",
    f"""WITH {CENTROIDS}
        SELECT vec_id, label, round({_DISTANCE}, 6) AS distance
        FROM embeddings JOIN centroids ON label = query_id""",
)
def cosine_distance(spark, sf_dir):
    """Distance of every vector from the mean of its label."""
    means = centroids(spark, sf_dir).select(
        F.col("query_id").alias("label"), F.col("embedding").alias("centroid")
    )
    rows = inputs.table(spark, sf_dir, "embeddings").join(broadcast_if_small(means), "label")
    distance = vec.cosine_distance(F.col("embedding"), F.col("centroid"))
    return rows.select("vec_id", "label", F.round(distance, 6).alias("distance"))


@query(
    "l2_normalize",
    """WITH scaled AS (
         SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1)) AS v
         FROM embeddings),
       normed AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM scaled)
       SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim,
              round(CAST(CAST(unnest(v) / norm AS FLOAT) AS DOUBLE), 6) AS value FROM normed""",
)
def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    rows = inputs.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(vec.l2_normalize(scaled)).alias("dim", "value")
    )
    return rows.select("vec_id", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(
    "vector_topk",
    f"""WITH {CENTROIDS.replace("CAST(label AS BIGINT) AS query_id", "CAST(0 AS BIGINT) AS query_id")},
        scored AS (SELECT vec_id AS chunk_id, {_DISTANCE} AS distance FROM embeddings, centroids)
        SELECT chunk_id, round(distance, 6) AS distance,
               CAST(row_number() OVER (ORDER BY distance, chunk_id) AS INTEGER) AS rank
        FROM scored QUALIFY rank <= 50""",
)
def vector_topk(spark, sf_dir):
    """The vectors nearest to the mean of all of them."""
    stored = inputs.table(spark, sf_dir, "embeddings")
    mean = (
        stored.select(F.posexplode("embedding").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("cells"))
        .select(F.lit(0).cast("long").alias("query_id"), F.col("cells.x").alias("embedding"))
    )
    return nearest.vector_topk(mean, _chunks(stored)).select(
        "chunk_id", F.round("distance", 6).alias("distance"), "rank"
    )


def _chunks(stored):
    return stored.select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("file_id"), "embedding"
    )


@query(
    "vector_topk_batch",
    f"""WITH {CENTROIDS},
        scored AS (
          SELECT query_id, vec_id AS chunk_id, {_DISTANCE} AS distance FROM embeddings, centroids)
        SELECT query_id, chunk_id, round(distance, 6) AS distance,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
        FROM scored QUALIFY rank <= 50""",
)
def vector_topk_batch(spark, sf_dir):
    """The vectors nearest to the mean of each label."""
    stored = _chunks(inputs.table(spark, sf_dir, "embeddings"))
    return nearest.vector_topk(centroids(spark, sf_dir), stored).select(
        "query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank"
    )


@query(
    "vector_topk_pruned",
    f"""WITH asked AS (
          SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS centroid FROM embeddings WHERE vec_id % 50 = 0),
        scored AS (
          SELECT query_id, vec_id AS chunk_id, {_DISTANCE} AS distance FROM embeddings, asked)
        SELECT query_id, chunk_id, round(distance, 6) AS distance,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank
        FROM scored QUALIFY rank <= 50""",
)
def vector_topk_pruned(spark, sf_dir):
    """Every fiftieth vector against all of them, stored by cell: cells too far away are not read."""
    stored = _chunks(inputs.table(spark, sf_dir, "embeddings"))
    asked = stored.filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return cells.vector_topk(asked, cells.store(stored)).select(
        "query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank"
    )


_DIMS = (1, 2, 100, 383, 384)


@query(
    "hash_embed",
    f"""WITH RECURSIVE {sqltext.chunks()},
        texts AS (SELECT DISTINCT snippet FROM chunks),
        {sqltext.hashed_units()},
        vectors AS (
          SELECT snippet, CAST(count(*) AS INTEGER) AS n_dims, round(sum(u), 4) AS total,
                 {", ".join(f"round(max(u) FILTER (d = {d}), 6) AS v{d}" for d in _DIMS)}
          FROM units GROUP BY snippet)
        SELECT chunk_id, n_dims, total, {", ".join(f"v{d}" for d in _DIMS)}
        FROM chunks JOIN vectors ON chunks.snippet = vectors.snippet""",
)
def hash_embed(spark, sf_dir):
    """The vector of every snippet: some of its 384 components, and their sum."""
    embedded = embedding.embed(inputs.cut_chunks(spark, sf_dir).select("chunk_id", "snippet"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return embedded.select(
        "chunk_id",
        F.size("embedding").alias("n_dims"),
        F.round(total, 4).alias("total"),
        *[F.round(F.col("embedding")[d - 1].cast("double"), 6).alias(f"v{d}") for d in _DIMS],
    )
