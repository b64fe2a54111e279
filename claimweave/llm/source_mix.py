"""Mixing sources to target weights by systematic sampling.

Each source's target is its share of all words by weight, stopped at ``most`` times its size,
the excess going to the others by weight. A document of a source expects target / size copies.
Its documents stand in one order, by size class, so that neighbours are alike; expected copies
are summed up along it from one random offset, and a copy is taken at each whole number that
the sum crosses. The sum before a document is its rank times the rate, so the prefix sum needs
ranks only: within (source, size class, salt), plus the counts of the groups before. No task
holds a source; the largest group is a 4096th of a size class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import any_names, free, hashable, others

MOST, WEIGHTS, SEED = 3, (1, 2, 3), 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target) from (key, source_size): the level at which targets under their caps sum up to all words.

    In the order of cap over weight, the sources before the first whose cap lies above the
    level of the rest are stopped at their caps. Rows are sources, not documents.
    """
    by_key = Window.orderBy("key")
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weigh).withColumn("cap", (F.col("source_size") * most).cast("double"))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = caps.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(every)["level"]
    return levels.withColumn("target", F.least("cap", chosen * F.col("weight"))).select("key", "source_size", "target")


@any_names
def source_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies of each row.

    A null source is a source, the last; null and empty texts have size 0 and take no words.
    Rows are ordered by size class, salt, size and id; rows alike in these by all their
    columns, and alike in all they are interchangeable. The salt is a hash of the id, of the
    text where the id is null. Long texts are only counted. Columns of docs named like the new
    ones, whatever their case, are replaced. An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "copies")
    rest = others(docs, new)
    key, band, salt, before, place, words = free(docs, "_key", "_class", "_salt", "_before", "_rank", "_words")
    name = F.col(source).cast("string")
    bits = F.bin("size")
    keyed = docs.select(*rest, word_count(text).alias("size")).withColumns(
        {
            key: F.when(name.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), name)),
            band: F.concat(F.lpad(F.length(bits), 2, "0"), F.substring(bits, 1, 3)),
            salt: F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.col(text).cast("string"), F.lit(""))), 1, 3),
        }
    )
    groups = keyed.groupBy(key, band, salt).agg(F.count("*").alias("n"), F.sum("size").alias(words))
    sizes = groups.groupBy(F.col(key).alias("key")).agg(F.sum(words).alias("source_size"))
    goals = targets(sizes, weights, most).withColumnRenamed("key", key)
    earlier = Window.partitionBy(key).orderBy(band, salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n", words).join(goals, key)
    in_group = Window.partitionBy(key, band, salt).orderBy("size", id, F.xxhash64(*(hashable(docs, c) for c in rest)))
    ranked = keyed.withColumn(place, F.row_number().over(in_group)).join(offsets, [key, band, salt])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rank = F.col(before) + F.col(place)
    copies = F.floor(rank * rate + start) - F.floor((rank - 1) * rate + start)
    return ranked.select(*rest, "size", "source_size", "target", copies.cast("long").alias("copies"))
