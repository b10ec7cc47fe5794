"""Queries over operators that train models."""

from __future__ import annotations

from pyspark.sql import functions as F

from casequeue.llm import centroids, quality, top_k
from casequeue.llm.common import table


def op6_quality(spark, sf_dir):
    return quality.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), top_k.quantized(F.col("embedding")).alias("v")
    )
    return top_k.top_k(vectors.where("id % 100 = 0"), vectors)


def op13_centroids(spark, sf_dir):
    vectors = centroids.clustered_vectors(
        table(spark, sf_dir, "embeddings"), F.col("embedding"), F.col("vec_id")
    )
    return centroids.cluster(vectors).withColumnRenamed("id", "vec_id")


def _clustering_sql(rounds: int = centroids.ROUNDS) -> str:
    """Each round as a step of its own; a distance is one sum over the components."""
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""a{step} AS (
  SELECT vec_id, row_id, e, arg_min(cluster, d * 64 + cluster) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, row_id, v.e, cluster, CAST(list_sum(list_transform(list_zip(v.e, c.e),
      lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{step} c)
  GROUP BY vec_id, row_id, e
)""")
        if step < rounds:
            steps.append(f"""m{step} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS e FROM (
    SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT cluster, unnest(e) AS x, unnest(range(64)) AS i FROM a{step}) GROUP BY cluster, i)
  GROUP BY cluster
),
c{step + 1} AS (SELECT cluster, coalesce(m.e, c.e) AS e FROM c{step} c LEFT JOIN m{step} m USING (cluster))""")
    return f"""WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding,
    lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, e
  FROM v QUALIFY cluster < 40
),
{",".join(steps)}
SELECT vec_id, a.cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


QUERIES = {
    "op5_top_k": op5_top_k,
    "op6_quality": op6_quality,
    "op13_centroids": op13_centroids,
}
ORACLES = {
    "op13_centroids": _clustering_sql(),
    "op5_top_k": """WITH v AS (
  SELECT vec_id, list_transform(embedding,
    lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1),
    lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
    AS INTEGER) AS rank, vec_id, score FROM scored) WHERE rank <= 10""",
}
