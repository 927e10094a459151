"""Tables that the rounds of an iterative operator leave in the shared folder, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder


class Stages:
    """Writes tables to the shared folder, so that a lost executor costs the round it is in at most, and deletes them when their readers are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def connected(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, label), written: for each node of the edges (a, b), which may be loops, the smallest node that it is connected with.

    A round hands each node the least label around it and then follows that label twice, so that long chains fall together in a logarithm of their length.
    """
    pairs = stages.write(edges.selectExpr("a", "b").unionByName(edges.selectExpr("b as a", "a as b")).distinct(), "graph-edges")
    labels = stages.write(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "graph-labels")  # both directions are there
    labels_of = lambda t, c, name: t.select(F.col("node").alias(c), F.col("label").alias(name))
    while True:
        around = pairs.join(labels_of(labels, "b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        new = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near", "node").alias("label"))
        for _ in range(2):
            further = labels_of(labels.filter("label < node"), "label", "further")
            new = new.join(further, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = stages.write(new, "graph-labels")
        stages.drop(labels)
        if new.filter("label <> old").isEmpty():
            stages.drop(pairs)
            return new.select("node", "label")
        labels = new
