"""Writers: JSON, tables, reports, seen links and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimweave.functions.text import stamped_name


def with_file_name(extracted: DataFrame) -> DataFrame:
    """With a filename of the minute and a unique part; the name is drawn when the result is written."""
    return extracted.withColumn("filename", stamped_name(F.current_timestamp(), F.uuid()))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_files(df: DataFrame, path: str, name: str = "filename") -> None:
    """A folder for each file name, with the row as indented JSON."""
    pretty = F.to_json(F.struct(*df.columns), {"pretty": "true"})
    df.select(name, pretty.alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy(name).text(path)


def write_collections(collections: dict[str, DataFrame], folder: str) -> None:
    for name, df in collections.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_named_collections(collections: dict[str, DataFrame], folder: str, name: str = "name") -> None:
    """Each collection by number, and beside it the list of its names in the order of first sight: a line each, not one array."""
    for kind, df in collections.items():
        df.write.mode("overwrite").json(f"{folder}/{kind}")
        if name in df.columns:
            df.groupBy(name).agg(F.min("uid").alias("uid")).sort("uid").select(name).write.mode("overwrite").json(f"{folder}/{kind}_names")


def article_text(title: Column, link: Column, text: Column) -> Column:
    """An article as plain text: title, link, and paragraphs."""
    return F.concat_ws("\n", title, link, F.lit(""), text)


def write_articles(articles: DataFrame, folder: str) -> None:
    """Articles twice: as JSON and as plain text."""
    articles.write.mode("overwrite").json(f"{folder}/json")
    articles.select(article_text(F.col("title"), F.col("link"), F.col("text")).alias("value")).write.mode("overwrite").text(f"{folder}/txt")


def prompt_dump(asked: DataFrame, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """One text for each call: what was asked and what came back."""
    return asked.select(F.concat(F.lit("PROMPT:\n"), F.col(prompt), F.lit("\n\nRESPONSE:\n"), F.coalesce(reply, F.lit(""))).alias("value"))


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    df.write.mode("overwrite").jdbc(url, table, properties=properties)


def cluster_report(rows: DataFrame, label: str = "label", text: str = "contents", order: str = "id") -> DataFrame:
    """(label, report) in the order of labels: the label, a rule, and a line for each text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.lit("\t- "), x[text]))
    return rows.groupBy(label).agg(F.concat_ws("\n", F.col(label).cast("string"), F.lit("---"), F.array_join(listed, "\n")).alias("report")).orderBy(label)


def result_lines(found: DataFrame, distance: str = "distance", text: str = "contents") -> DataFrame:
    """Search results as lines to print, in their order."""
    return found.select(F.concat(F.format_number(distance, 4), F.lit("  "), F.col(text)).alias("line"))


def first_two_dimensions(vectors: DataFrame, label: str = "label") -> DataFrame:
    return vectors.select(F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"), label)


def save_seen(seen: DataFrame, read: DataFrame, path: str) -> None:
    """The union of links, as the table's next version beside the last; the caller points to it."""
    seen.select("link").unionByName(read.select("link")).distinct().write.mode("errorifexists").parquet(path)


def failures(extracted: DataFrame) -> DataFrame:
    """Rows that gave nothing, with what is needed to look into them: the error and the raw reply or page."""
    raw = [c for c in ("raw", "page") if c in extracted.columns]
    return extracted.where("status <> 'ok'").select("link", "error", *raw)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and counts that are gathered while it is written: by default rows, and failed ones where there is a status."""
    given = metrics or {"rows": F.count(F.lit(1)), **({"failed": F.count_if(F.col("status") != "ok")} if "status" in df.columns else {})}
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in given.items())), seen


def by_article_and_model(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("article", "model").json(path)
