"""Extracted documents into global claims, canonical claims, sources, events and entities.

A document is known by its path. Local ids are rewritten within each row by maps, so only the
keyed dedup of each collection, and the numbers of natural names, shuffle. Order is the path,
then the position in the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.json_text import has_key, json_object
from claimweave.functions.text import md5_id, train_text, unique_name
from claimweave.operators.numbering import dense_uid, running_total

_REFS = "ARRAY<STRING>"
#: titled: whether an entity has the key title, be it with null.
DOCUMENT = f"""title STRING, link STRING, filename STRING,
canonical_claims ARRAY<STRUCT<id STRING, text STRING, category STRING,
  supporting_claims {_REFS}, refuting_claims {_REFS}, uncertain_claims {_REFS}, claims {_REFS}>>,
claims ARRAY<STRUCT<id STRING, canonical_id STRING, type STRING, quote STRING, text STRING, target STRING, speaker STRING,
  categories {_REFS}, category STRING, sources {_REFS}, events {_REFS}, related_issues {_REFS}, counter_arguments {_REFS}>>,
sources ARRAY<STRUCT<id STRING, type STRING, name STRING, reference STRING>>,
events ARRAY<STRUCT<id STRING, name STRING, date STRING, description STRING, location STRING>>,
entities ARRAY<STRUCT<id STRING, type STRING, name STRING, title STRING, role STRING, titled BOOLEAN>>"""
_GROUPS = ("supporting_claims", "refuting_claims", "uncertain_claims")


def parse_documents(raws: DataFrame, path: str = "path", raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable) from JSON texts: the columns of DOCUMENT and path; and path and raw of what is no JSON object.

    Where a document has no key filename, its path's last part takes the place; a null stays null.
    """
    rows = raws.select(F.col(path).alias("path"), F.col(raw).alias("raw")).withColumn("v", F.try_parse_json("raw"))
    fine = json_object("raw") & F.col("v").isNotNull()  # a variant is made of text with more behind it too
    d = rows.where(fine).withColumn("d", F.from_json("raw", DOCUMENT)).select("path", "v", "d.*")
    titled = F.transform(F.try_variant_get("v", "$.entities", "array<variant>"), lambda x: has_key(x, "title"))
    entity = lambda e, t: e.withField("titled", F.coalesce(t, F.lit(False)))
    stem = F.element_at(F.split("path", "/"), -1)
    good = d.withColumn("entities", F.zip_with("entities", titled, entity)).withColumn("filename", F.when(has_key(F.col("v"), "filename"), F.col("filename")).otherwise(stem))
    return good.drop("v"), rows.where(~fine).select("path", "raw")


def _local(items: Column, key: Callable, last: bool) -> Column:
    """Map of local id to key(item); of repeated local ids the last or the first counts."""
    entries = F.transform(F.coalesce(items, F.array()), lambda x: F.struct(x["id"].alias("k"), key(x).alias("v")))
    other = (lambda i, j: j > i) if last else (lambda i, j: j < i)
    alone = F.filter(entries, lambda e, i: e["k"].isNotNull() & ~F.exists(F.filter(entries, lambda f, j: (f["k"] == e["k"]) & other(i, j)), lambda f: F.lit(True)))
    return F.map_from_entries(alone)


def _rewrite(refs: Column, known: Column) -> Column:
    return F.transform(refs, lambda r: F.coalesce(F.try_element_at(known, r), r))


def _kept(rows: DataFrame, last: bool) -> DataFrame:
    """One row of each id: the first or the last by path and position. It aggregates before it shuffles."""
    place = F.struct("path", "pos")
    pick = F.max_by if last else F.min_by
    return rows.groupBy("id").agg(pick(F.struct(*(c for c in rows.columns if c not in ("id", "path", "pos"))), place).alias("x")).select("id", "x.*")


def _exploded(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    return docs.select("path", *keep, F.posexplode(column).alias("pos", "x"))


def event_key(e: Column) -> Column:
    return unique_name(e["name"], e["date"])


def entity_key(e: Column) -> Column:
    return unique_name(e["name"], e["title"], ~F.coalesce(e["titled"], e["title"].isNotNull()))


def categories_of(claim: Column) -> Column:
    return F.coalesce(claim["categories"], F.when(claim["category"].isNotNull(), F.array(claim["category"])))


def by_md5(docs: DataFrame, compat: bool = False) -> dict[str, DataFrame]:
    """The five collections by md5 identity, from documents with a path.

    Events, sources and entities keep their first row, claims and canonical claims their last.
    Unmatched events, sources and claim references stay as they are, unmatched speakers and
    canonical ids become "". A canonical claim without one of its reference arrays keeps that
    one and those after it. compat: only the last canonical claim of each document survives,
    filed under the document's last claim.
    """
    event, entity = (lambda e: md5_id(event_key(e))), (lambda e: md5_id(entity_key(e)))
    text, name = (lambda c: md5_id(c["text"])), (lambda s: md5_id(s["name"]))
    kinds = {"events": event, "sources": name, "entities": entity, "canonical_claims": text, "claims": text}
    docs = docs.withColumns({f"known_{c}": _local(F.col(c), key, last=True) for c, key in kinds.items()})
    x, out = F.col("x"), {}

    def fields(column: str, key: Callable, names: list[str], uname: Callable | None = None) -> DataFrame:
        own = [uname(x).alias("uname")] if uname else []
        return _kept(_exploded(docs, column).select("path", "pos", key(x).alias("id"), *(x[c].alias(c) for c in names), *own), last=False)

    out["events"] = fields("events", event, ["name", "date", "description", "location"], event_key)
    out["sources"] = fields("sources", name, ["type", "name", "reference"])
    out["entities"] = fields("entities", entity, ["type", "name", "title", "role"], entity_key)

    known = [f"known_{c}" for c in ("events", "sources", "entities", "canonical_claims")]
    scalar = lambda ref, c: F.coalesce(F.try_element_at(f"known_{c}", ref), F.lit(""))
    rows = _exploded(docs, "claims", "link", "filename", *known).select(
        "path", "pos", text(x).alias("id"),
        scalar(x["canonical_id"], "canonical_claims").alias("canonical_id"),
        *(x[c].alias(c) for c in ("type", "quote", "text", "target")),
        scalar(x["speaker"], "entities").alias("speaker"),
        categories_of(x).alias("categories"),
        _rewrite(x["sources"], F.col("known_sources")).alias("sources"),
        _rewrite(x["events"], F.col("known_events")).alias("events"),
        F.coalesce("link", F.lit("")).alias("link"), F.col("filename").alias("file"),
    )
    out["claims"] = _kept(rows, last=True)

    rewritten, fine = [], F.lit(True)
    for c in _GROUPS:
        fine = fine & x[c].isNotNull()
        rewritten.append(F.when(fine, _rewrite(x[c], F.col("known_claims"))).otherwise(x[c]).alias(c))
    own = md5_id(F.try_element_at("claims", F.lit(-1))["text"])
    rows = _exploded(docs, "canonical_claims", "known_claims", "claims").select("path", "pos", text(x).alias("id"), x["text"].alias("text"), x["category"].alias("category"), *rewritten, own.alias("last_claim"))
    if compat:
        last = rows.groupBy("path").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "path")), "pos").alias("x")).select("path", "x.*")
        filed = last.withColumn("own", F.col("id")).withColumn("id", F.coalesce("last_claim", "id"))
        out["canonical_claims"] = _kept(filed, last=True).drop("id", "last_claim").withColumnRenamed("own", "id")
    else:
        out["canonical_claims"] = _kept(rows.drop("last_claim"), last=True)
    return out


def by_uid(docs: DataFrame) -> dict[str, DataFrame]:
    """The collections by natural name with dense numbers, from documents with a path; claims keep all rows and running numbers.

    Of repeated local ids the first counts. Events are known by name and date, sources and
    entities by name. Unmatched references stay as they are. A claim's number is its position
    plus the claims of the documents before, so references between claims need no join.
    """
    kinds = {"events": event_key, "sources": lambda s: s["name"], "entities": lambda e: e["name"]}
    out: dict[str, DataFrame] = {}
    keys = []
    for column, key in kinds.items():
        rows = _exploded(docs, column).withColumn("key", key(F.col("x")))
        uids = dense_uid(rows, "key", ["path", "pos"])
        first = rows.groupBy("key").agg(F.min_by("x", F.struct("path", "pos")).alias("x"))
        same = first["key"].eqNullSafe(uids["key"])
        out[column] = first.join(uids, same).select("uid", first["key"], "x.*")
        out[column] = out[column].drop("titled") if column == "entities" else out[column]
        local = docs.select("path", F.explode(_local(F.col(column), key, last=False)).alias("id", "key"))
        keys.append(local.join(uids, "key").select("path", F.lit(column).alias("kind"), "id", F.col("uid").cast("string").alias("uid")))
    listed = keys[0].unionByName(keys[1]).unionByName(keys[2])
    of_kind = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "uid")))).alias(f"known_{kind}")
    maps = listed.groupBy("path").agg(*(of_kind(kind) for kind in kinds))

    names = _local(F.col("entities"), lambda e: e["name"], last=False)
    places = _local(F.transform("claims", lambda c, i: F.struct(c["id"].alias("id"), i.alias("i"))), lambda c: c["i"], last=False)
    slim = docs.select("path", "link", "filename", "claims", names.alias("names"), places.alias("places"))
    counts = docs.select("path", F.coalesce(F.size("claims"), F.lit(0)).alias("n"))
    starts = running_total(counts, ["path"], F.greatest("n", F.lit(0)), "start").drop("n")
    x, start = F.col("x"), F.col("start")
    rows = slim.join(starts, "path").join(maps, "path", "left").select("*", F.posexplode("claims").alias("pos", "x"))
    categories = F.coalesce(categories_of(x), F.array().cast("array<string>"))
    refs = lambda c: F.coalesce(x[c], F.array().cast("array<string>"))
    numbers = F.transform_values("places", lambda k, p: (start + p).cast("string"))
    known = lambda kind: F.coalesce(f"known_{kind}", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))
    out["claims"] = rows.select(
        (start + F.col("pos")).alias("uid"), x["id"].alias("id"), x["text"].alias("text"), categories.alias("categories"),
        F.coalesce(F.try_element_at(known("entities"), x["speaker"]), x["speaker"]).alias("speaker"),
        _rewrite(refs("sources"), known("sources")).alias("sources"),
        _rewrite(refs("events"), known("events")).alias("events"),
        _rewrite(refs("counter_arguments"), numbers).alias("counter_arguments"),
        F.col("filename").alias("source_filename"), F.col("link").alias("source_weblink"),
        F.lit(None).cast("bigint").alias("embed_id"),
        train_text(x["text"], categories, F.try_element_at("names", x["speaker"])).alias("train_text"),
    )
    return out


def name_list(rows: DataFrame, name: str, uid: str = "uid") -> DataFrame:
    """One row: the distinct values of a column as an array, in the order of their first number. For reports: the array is one value."""
    first = rows.groupBy(name).agg(F.min(uid).alias("at"))
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda x: x[name]).alias("names"))


def load_tables(collections: dict[str, DataFrame], prefix: str = "") -> None:
    """Each collection as a table, replaced in full."""
    for name, df in collections.items():
        df.write.mode("overwrite").saveAsTable(f"{prefix}{name}")
