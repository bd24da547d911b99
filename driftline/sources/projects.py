"""A registry of projects as an append-only table: the latest version of each counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, name string, source string, status string, settings string, updated_at timestamp, deleted boolean"


class Registry:
    """Inserts, updates and deletes append a version; readers take each id's last. Nothing is overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def _put(self, row: dict) -> None:
        self.spark.createDataFrame([tuple(row.get(c.split()[0]) for c in SCHEMA.split(", "))], SCHEMA).withColumn("updated_at", F.coalesce("updated_at", F.current_timestamp())).write.mode("append").parquet(self.path)

    def put(self, id: str, **values) -> None:
        """Insert or update: values not named stay as they are."""
        old = self.get(id)
        self._put({**(old.asDict() if old else {}), "updated_at": None, **values, "id": id, "deleted": False})

    def delete(self, id: str) -> None:
        self._put({"id": id, "deleted": True})

    def live(self) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*cols), "updated_at").alias("r")).select("r.*")
        return last.where("not deleted").drop("deleted")

    def get(self, id: str):
        return self.live().where(F.col("id") == id).first()

    def recent(self, n: int) -> DataFrame:
        return self.live().orderBy(F.desc("updated_at"), "id").limit(n)

    def by_source(self, source: str):
        """The latest project of a source."""
        return self.live().where(F.col("source") == source).orderBy(F.desc("updated_at"), "id").first()
