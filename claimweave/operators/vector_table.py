"""A vector table: storage by week, search, upsert, delete, metadata columns, and a stored inverted-file index."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.time_ids import in_range, time_of_uuid, week_bucket
from claimweave.functions.vectors import cosine_distance, distance_to, norm
from claimweave.operators.blocks import against_all, by_length, column
from claimweave.operators.cuts import finite, unit, whole
from claimweave.operators.predicates import Predicate, equality, value_of
from claimweave.operators.tables import fresh_path


#: Distances that a task of ``search_many`` holds at once, a few times over.
TILE = 1 << 19


def create_table(spark: SparkSession, name: str, path: str | None = None) -> None:
    """The empty vector table, unless there is one: partitioned by the week of the id's time."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, metadata STRING, contents STRING, embedding ARRAY<FLOAT>, norm DOUBLE, id_time TIMESTAMP, week BIGINT) USING parquet PARTITIONED BY (week){where}")


def for_storage(table: DataFrame, days: int = 7) -> DataFrame:
    """With what a search would otherwise compute for each row each time: the vector's norm, and the id's time and week, if ids are version-1 UUIDs."""
    out = table.withColumn("norm", norm(F.col("embedding").cast("array<double>")))
    if dict(table.dtypes)["id"] == "string":
        out = out.withColumn("id_time", time_of_uuid(F.col("id"))).withColumn("week", week_bucket(F.col("id_time"), days))
    return out


def store(table: DataFrame, path: str, days: int = 7) -> DataFrame:
    """The table written to a path, a folder for each week, and read from there."""
    out = for_storage(table, days)
    writer = out.write.mode("overwrite")
    (writer.partitionBy("week") if "week" in out.columns else writer).parquet(path)
    return table.sparkSession.read.parquet(path)


def _seconds(time: str | dt.datetime) -> float:
    t = dt.datetime.fromisoformat(time) if isinstance(time, str) else time
    return (t if t.tzinfo else t.replace(tzinfo=dt.UTC)).timestamp()


def filtered(table: DataFrame, metadata_filter: dict | list[dict] | None = None, predicates: Predicate | None = None, time_range: tuple | None = None, end_inclusive: bool = False, days: int = 7) -> DataFrame:
    """Rows that pass all filters given. A time range of ids prunes the weeks of a stored table, a day wider on both sides than the range, whatever the session's time zone."""
    of = value_of(table)
    if metadata_filter:
        table = table.where(equality(of, metadata_filter))
    if predicates is not None:
        table = table.where(predicates.on(of))
    if time_range:
        start, end = time_range
        if "week" in table.columns:
            if start is not None:
                table = table.where(F.col("week") >= int((_seconds(start) - 86400) // (days * 86400)))
            if end is not None:
                table = table.where(F.col("week") <= int((_seconds(end) + 86400) // (days * 86400)))
        table = table.where(in_range(F.col("id_time") if "id_time" in table.columns else time_of_uuid(F.col("id")), start, end, end_inclusive))
    return table


def search(table: DataFrame, query: list[float] | Column, limit: int = 5, id: str = "id", embedding: str = "embedding", **filters) -> DataFrame:
    """The nearest rows with their distance, ascending, ties by id. The query is a literal, so the scan keeps pushed filters and ends in a distributed top-k.

    A row whose vector is null or holds a null or non-finite component has no distance and isn't found; a zero vector has distance 1.
    """
    own_norm = F.col("norm") if "norm" in table.columns else None
    distance = cosine_distance(F.col(embedding), query) if isinstance(query, Column) else distance_to(F.col(embedding), query, own_norm)
    return filtered(table, **filters).where(whole(column(embedding))).withColumn("distance", distance).orderBy("distance", id).limit(limit)


def search_many(table: DataFrame, queries: DataFrame, limit: int = 5, id: str = "id", embedding: str = "embedding", lists: str | None = None, within: str | None = None, **filters) -> DataFrame:
    """(q, id, distance): the nearest rows of each of many queries (q, v), ascending by distance to nine places, ties by id.

    Rows stream past blocks of queries, and a task keeps ``limit`` rows of each query it holds.
    Rows and queries whose vector is null, or holds a null or non-finite component, have no
    distance; zero vectors have distance 1; vectors of different lengths aren't compared. lists: a
    column of the table that must be in the query's array ``lists``. within: a column of the queries
    with the distance beyond which a query asks for no rows.
    """
    q, rows = queries.where(F.col("v").isNotNull()), filtered(table, **filters)
    rows = rows.select(column(id).alias("id"), column(embedding).alias("v"), *([column(lists).alias("list")] if lists else [])).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    asked_kind = queries.schema["q"].dataType.simpleString()

    def start(batch: pa.RecordBatch) -> dict:
        asked = batch.column("lists").to_pylist() if lists else None
        bound = batch.column(within).to_numpy() if within else np.full(len(batch), np.inf)
        return {"q": batch.column("q"), "lists": asked, "bound": bound, "by": {x.shape[1]: (at, unit(x)) for at, x in by_length(batch.column("v"))}, "kept": [(np.zeros(0), np.zeros(0), pa.array([], batch_type(kind))) for _ in range(len(batch))]}

    def step(state: dict, batch: pa.RecordBatch) -> None:
        of_list = batch.column("list").to_numpy() if lists else None
        for at, x in by_length(batch.column("v")):
            own, u = state["by"].get(x.shape[1], (np.zeros(0, int), None))
            rows_t = unit(x).T
            for low in range(0, len(own), most := max(1, TILE // max(1, len(at)))):
                own_far = np.clip(1 - u[low : low + most] @ rows_t, 0, 2)
                far = np.round(own_far, 9)
                asks = far.min(1, initial=np.inf) <= state["bound"][own[low : low + most]]
                for place, d, true in zip(own[low : low + most][asks].tolist(), far[asks], own_far[asks], strict=True):
                    near = np.flatnonzero(d <= state["bound"][place] if of_list is None else (d <= state["bound"][place]) & np.isin(of_list[at], state["lists"][place]))
                    d, true = d[near], true[near]
                    if len(d) > limit:
                        few = np.flatnonzero(d <= np.partition(d, limit - 1)[limit - 1])
                        near, d, true = near[few], d[few], true[few]
                    had, truly, ids = state["kept"][place]
                    d = np.append(had, d)
                    first = np.argsort(d, kind="stable")[:limit]  # rows come in the order of ids
                    state["kept"][place] = d[first], np.append(truly, true)[first], pa.concat_arrays([ids, batch.column("id").take(pa.array(at[near]))]).take(pa.array(first))

    def finish(state: dict) -> pa.RecordBatch:
        own = np.repeat(np.arange(len(state["kept"])), [len(d) for d, _, _ in state["kept"]])
        return pa.RecordBatch.from_pydict({"q": state["q"].take(pa.array(own)), "id": pa.concat_arrays([i for _, _, i in state["kept"]]), "distance": np.concatenate([d for _, d, _ in state["kept"]])})

    batch_type = lambda k: {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]
    found = against_all(q.where(whole(F.col("v"))), rows.where(whole(F.col("v"))), start, step, finish, f"q {asked_kind}, id {kind}, distance double", "id")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("q", F.col("id").alias(id), "distance")


def search_text(table: DataFrame, text: str, model: Callable[[str], list[float]], limit: int = 5, **options) -> DataFrame:
    """The nearest rows to a text, embedded as the table's texts are, newlines as spaces."""
    return search(table, model(text.replace("\n", " ")), limit, **options)


def scored(found: DataFrame, id: str = "id", text: str = "contents") -> DataFrame:
    """Search results as id, text and score, which falls with the distance."""
    return found.select(id, F.col(text).alias("text"), (1 - F.col("distance")).alias("score"))


def upsert(table: DataFrame, new: DataFrame, id: str = "id", on_conflict: str = "update", order: str | None = None) -> DataFrame:
    """The next version of the table.

    Of new rows with one id the one counts that is last by ``order``, or without it the largest
    by all columns, so that a repeated run gives the same.
    """
    if on_conflict not in ("update", "ignore"):
        raise ValueError("on_conflict is update or ignore")
    columns = table.columns
    rank = F.struct(*([order] if order else []), F.to_json(F.struct(*(c for c in columns if c != id))))
    one = new.groupBy(id).agg(F.max_by(F.struct(*(c for c in columns if c != id)), rank).alias("x")).select(id, "x.*").select(*columns)
    if on_conflict == "update":
        return table.join(one.select(id), id, "left_anti").select(*columns).unionByName(one)
    return table.unionByName(one.join(table.select(id), id, "left_anti").select(*columns))


def delete(table: DataFrame, ids: list | DataFrame | None = None, metadata_filter: dict | list[dict] | None = None, delete_all: bool = False, id: str = "id") -> DataFrame:
    """The table without the rows meant by exactly one criterion; an empty list is none. Rows whose filter is null stay."""
    given = [ids is not None and not (isinstance(ids, list) and not ids), bool(metadata_filter), bool(delete_all)]
    if sum(given) != 1:
        raise ValueError("give exactly one of ids, metadata_filter and delete_all")
    if delete_all:
        return table.where(F.lit(False))
    if metadata_filter:
        return table.where(~F.coalesce(equality(value_of(table), metadata_filter), F.lit(False)))
    if isinstance(ids, list):
        return table.where(~F.col(id).isin(ids) | F.col(id).isNull())
    return table.join(ids.select(id), id, "left_anti").select(*table.columns)


def metadata_keys(table: DataFrame, metadata: str = "metadata", most: int = 1000) -> list[str]:
    """The keys that occur in the metadata, sorted; more than ``most`` different ones are an error."""
    keys = table.select(F.explode(F.json_object_keys(metadata)).alias("key")).distinct().limit(most + 1).collect()
    if len(keys) > most:
        raise ValueError(f"more than {most} metadata keys")
    return sorted(r.key for r in keys)


def expand_metadata(table: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """metadata keys as columns of the given types, by default all that occur, as text; missing ones are null."""
    keys = {k: "string" for k in metadata_keys(table)} if keys is None else keys
    variant = F.try_parse_json("metadata")
    return table.select(*[c for c in table.columns if c != "metadata"], *(F.try_variant_get(variant, f"$.{k}", t).alias(k) for k, t in keys.items()))


def results_frame(found: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Search results with metadata as columns and ids as text."""
    return expand_metadata(found, keys).withColumn("id", F.col("id").cast("string"))


class InvertedFile:
    """A stored approximate index: rows lie in a folder for each of a few lists, and a search reads the nearest lists only.

    Rows whose vector is null, empty or zero, holds a null or non-finite component, or has another length than most, are in no list. Centroids are fitted on at most ``sample`` rows, drawn by a hash of the id; every row is
    filed under its nearest. A search is exact among the rows it reads, by default three
    quarters of the lists: that gives a recall at 10 of 0.95 on vectors with next to no
    clusters; where there are clusters, fewer do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
        self.centroids, self.id, self.embedding = np.array(about["centroids"]), about["id"], about["embedding"]
        self.filed = spark.read.parquet(f"{path}/lists")

    @classmethod
    def create(cls, table: DataFrame, path: str | None = None, lists: int = 16, sample: int = 20_000, rounds: int = 10, id: str = "id", embedding: str = "embedding") -> InvertedFile:
        spark, path = table.sparkSession, path or fresh_path(table.sparkSession)
        table = table.where(F.col(embedding).isNotNull()).where(finite(F.col(embedding)))
        size = table.groupBy(F.size(embedding).alias("n")).count().orderBy(F.desc("count"), "n").first()
        if size is None:
            raise ValueError("no vectors to index")
        table = table.where(F.size(embedding) == size.n)
        rows = table.select(F.xxhash64(id).alias("h"), embedding).orderBy("h").limit(sample).collect()
        x = np.array([r[1] for r in rows], float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = x[:: max(1, len(x) // lists)][:lists].copy()
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            for k in range(len(c)):
                if (near == k).any():
                    c[k] = x[near == k].mean(0)
                    c[k] /= max(np.linalg.norm(c[k]), 1e-12)
        nearest = F.array_min(F.array(*(F.struct(distance_to(F.col(embedding), v.tolist()).alias("d"), F.lit(k).alias("k")) for k, v in enumerate(c))))
        filed = for_storage(table) if "norm" not in table.columns else table
        filed.withColumn("list_id", nearest["k"]).repartition("list_id", F.pmod(F.xxhash64(id), F.lit(8))).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        about = json.dumps({"centroids": c.tolist(), "id": id, "embedding": embedding})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return cls(spark, path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def probes(self, query: list[float], n: int | None = None) -> list[int]:
        """The lists that a search reads, nearest first."""
        n = math.ceil(0.75 * len(self.centroids)) if n is None else n
        return np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")[:n].tolist()

    def search_many(self, queries: DataFrame, limit: int = 5, probes: int | None = None, **filters) -> DataFrame:
        """(q, id, distance) of many queries (q, v), each among the rows of its nearest lists."""
        n = math.ceil(0.75 * len(self.centroids)) if probes is None else probes
        nearness = F.array(*(F.struct(distance_to(F.col("v"), c.tolist()).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(self.centroids)))
        asked = queries.withColumn("lists", F.transform(F.slice(F.array_sort(nearness), 1, n), lambda x: x["k"]))
        return search_many(self.filed, asked, limit, self.id, self.embedding, lists="list_id", **filters)

    def search(self, query: list[float], limit: int = 5, probes: int | None = None, **filters) -> DataFrame:
        """The nearest of the rows in the lists read; the filter on lists prunes folders."""
        near = self.filed.where(F.col("list_id").isin(self.probes(query, probes)))
        return search(near, query, limit, self.id, self.embedding, **filters).drop("list_id")
