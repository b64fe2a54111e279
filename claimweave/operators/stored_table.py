"""A vector table kept under a path, changed in place: an upsert or a delete writes only the folders that hold rows it means."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.functions.time_ids import time_of_uuid, week_bucket
from claimweave.operators.blocks import column
from claimweave.operators.predicates import equality, value_of
from claimweave.operators.tables import fresh_path, written
from claimweave.operators.vector_table import delete, for_storage, upsert

FOLDER = ["week", "bucket"]


class StoredTable:
    """``rows`` under a path, a folder for each week of the ids' time and bucket of their hash, and ``about``, which has its columns.

    Ids without a time have week -1. Both follow from the id, so all versions of a row are in one
    folder, and changes read and write the folders of their ids alone. The rows of a change are
    complete in the shared folder before any folder of the table is replaced. Folders are replaced
    one after the other: a reader may see some before and some after the change, and a change that
    was broken off is made whole by running it again, which is safe after a finished one as well.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        self.schema, self.buckets, self.days, self.id = StructType.fromJson(about["schema"]), about["buckets"], about["days"], about["id"]

    @classmethod
    def create(cls, table: DataFrame, path: str | None = None, buckets: int = 16, days: int = 7, id: str = "id") -> StoredTable:
        """Stores a table. buckets: folders of a week; a change of one row rewrites one of them, so they should be as large as a task likes to write."""
        spark, path = table.sparkSession, path or fresh_path(table.sparkSession)
        rows = _filed(table, buckets, days, id)
        about = json.dumps({"schema": json.loads(rows.schema.json()), "buckets": buckets, "days": days, "id": id})
        rows.repartition(*FOLDER).write.mode("overwrite").partitionBy(*FOLDER).parquet(f"{path}/rows")
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return cls(spark, path)

    @property
    def rows(self) -> DataFrame:
        """The rows as they are now; searches and filters take them as they take any vector table."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def upsert(self, new: DataFrame, on_conflict: str = "update", order: str | None = None) -> StoredTable:
        """Rows of new ids are added, and those of known ones replaced, or left with on_conflict "ignore"; see ``vector_table.upsert`` for several rows of one id."""
        kind = self.schema[self.id].dataType
        new = _filed(new.withColumn(self.id, column(self.id).cast(kind)), self.buckets, self.days, self.id)
        new = written(new.select(*(column(f.name).cast(f.dataType).alias(f.name) for f in self.schema)))
        return self._replace(new.select(*FOLDER).distinct(), lambda now: upsert(now, new, self.id, on_conflict, order))

    def delete(self, ids: list | DataFrame | None = None, metadata_filter: dict | list[dict] | None = None, delete_all: bool = False) -> StoredTable:
        """Without the rows meant by exactly one criterion, as ``vector_table.delete``."""
        gone = lambda now: delete(now, ids, metadata_filter, delete_all, self.id)
        gone(self.rows)  # criteria that are none or several are an error before anything is read
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], StructType([self.schema[self.id]]))
        if ids is not None:
            ids = written(ids.select(column(self.id).cast(self.schema[self.id].dataType).alias(self.id)).where(column(self.id).isNotNull()))
            meant = _filed(ids, self.buckets, self.days, self.id)
        else:
            meant = self.rows.where(equality(value_of(self.rows), metadata_filter)) if metadata_filter else self.rows
        return self._replace(meant.select(*FOLDER).distinct(), gone)

    def drop(self) -> None:
        self._remove([""])

    def _replace(self, folders: DataFrame, change) -> StoredTable:
        """Writes the changed rows of the folders, and removes those that have none left."""
        folders = written(folders)
        few = F.broadcast(folders)  # a row for each folder of the table at most: its files are pruned by them
        kept = written(change(self.rows.join(few, FOLDER, "left_semi").select(*map(column, self.schema.names))))
        kept.repartition(*FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER).parquet(f"{self.path}/rows")
        empty = folders.join(kept.select(*FOLDER).distinct(), FOLDER, "left_anti").collect()  # names of folders
        self._remove([f"rows/week={r.week}/bucket={r.bucket}" for r in empty])
        return self

    def _remove(self, names: list[str]) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in names:
            fs.delete(path(f"{self.path}/{name}"), True)


def _filed(table: DataFrame, buckets: int, days: int, id: str) -> DataFrame:
    """With norm, time and week as ``for_storage`` gives them, where the table has what they are made of, and the bucket of the id."""
    if "embedding" in table.columns and id == "id":
        table = for_storage(table, days)
    week = F.lit(-1) if dict(table.dtypes)[id] != "string" else F.coalesce(week_bucket(time_of_uuid(column(id)), days), F.lit(-1))
    return table.withColumn("week", week.cast("long")).withColumn("bucket", F.pmod(F.xxhash64(column(id)), F.lit(buckets)).cast("int"))
