"""Clusters, indexes and codebooks over the stored vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering as K
from ..operators import codebooks as B
from ..operators import vector_index as I
from ..session import table
from .base import plan

UNIT = "e AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


@plan(
    "M6",
    f"""
WITH RECURSIVE {UNIT}, d AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, round(list_distance(x.v, y.v), 9) AS d FROM e x, e y WHERE list_distance(x.v, y.v) < 1.16),
n AS MATERIALIZED (SELECT a, count(*) AS n_near, count(*) >= 4 AS core FROM d WHERE d <= 1.15::DOUBLE GROUP BY a),
l AS MATERIALIZED (SELECT d.a, d.b, x.core FROM d JOIN n x ON d.a = x.a JOIN n y ON d.b = y.a WHERE d <= 1.15::DOUBLE AND y.core),
r(a, b) AS (SELECT a, b FROM l WHERE core UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a WHERE l.core),
c AS (SELECT a, min(b) AS cluster FROM r GROUP BY a),
o AS (SELECT l.a, arg_min(c.cluster, (d.d, l.b)) AS cluster FROM l JOIN d USING (a, b) JOIN c ON c.a = l.b WHERE NOT l.core GROUP BY l.a)
SELECT n.a AS vec_id, n_near, core, coalesce(c.cluster, o.cluster, -1) AS cluster FROM n LEFT JOIN c ON n.a = c.a LEFT JOIN o ON n.a = o.a""",
)
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters of all vectors by direction."""
    return K.dbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", 1.15, 4, cosine=True)


@plan("F29")
def index_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every twentieth vector from as many lists as a share of 0.95 needs by measurement."""
    e = table(spark, sf, "embeddings")
    index = I.InvertedLists(e, "vec_id", "embedding")
    return index.search(e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, index.probes_for(10, 0.95))


@plan("F29", f"WITH {UNIT}, s AS (SELECT x.vec_id AS query, y.vec_id AS other, round(1 - list_inner_product(x.v, y.v), 6) AS distance FROM e x JOIN e y ON x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, other) AS rank FROM s) SELECT query, rank, other, distance FROM r WHERE rank <= 10")
def index_neighbours_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The same from all lists: exact."""
    e = table(spark, sf, "embeddings")
    index = I.InvertedLists(e, "vec_id", "embedding")
    return index.search(e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, len(index.centres), digits=6)


@plan("M10")
def residual_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all vectors by three stages, and what each stage leaves over."""
    q = B.ResidualQuantiser(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return q.encoded().select(F.col("key").alias("vec_id"), F.array_join("codes", ",").alias("codes"), *[F.round(F.col("errors")[i], 5).alias(f"error_{i + 1}") for i in range(3)])


@plan("M6")
def ward_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all vectors by direction, merged up to a distance by Ward's linkage."""
    return K.agglomerative(table(spark, sf, "embeddings"), "vec_id", "embedding", 1.25, cosine=True)
