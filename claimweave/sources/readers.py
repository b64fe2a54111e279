"""Readers: extracted JSON, feeds, pages, FAQ tables, word lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.html import article_udf, feed_paragraphs_udf, html_unescape, transcript_paragraphs_udf
from claimweave.functions.text import file_stem
from claimweave.operators.resolve import parse_documents

ARTICLE = "title STRING, link STRING, summary STRING, text STRING"
VECTORS = "id STRING, metadata STRING, contents STRING, embedding ARRAY<FLOAT>"


def _gathered(files: DataFrame) -> DataFrame:
    """Small files read many to a task: Spark's own packing counts each as some megabytes, which may leave a task to each file."""
    n = files.rdd.getNumPartitions()
    return files.coalesce(max(4 * files.sparkSession.sparkContext.defaultParallelism, n // 64))


def read_documents(spark: SparkSession, folder: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable): JSON files of the folder, whatever the case of .json. A document is known by its file's whole path."""
    files = spark.read.option("pathGlobFilter", "*.[jJ][sS][oO][nN]").option("recursiveFileLookup", recursive).text(folder, wholetext=True)
    return parse_documents(_gathered(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))))


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as JSON, an object a file; files named .JSON aren't read. filename: the file's name without its ending."""
    rows = spark.read.schema(ARTICLE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("filename", file_stem(F.col("_metadata.file_name")))


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question STRING, answer STRING, category STRING").option("header", True).option("sep", ";").csv(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """title, link, summary and text of saved feeds, an item a row."""
    schema = "title STRING, link STRING, description STRING, `content:encoded` STRING"
    return articles_of_items(spark.read.format("xml").schema(schema).option("rowTag", "item").load(path), "description", "content:encoded")


def articles_of_items(items: DataFrame, summary: str = "summary", content: str = "content") -> DataFrame:
    """Articles of feed items: paragraphs of the content, each with a space after it, and entities decoded once more."""
    parts = feed_paragraphs_udf(F.col(f"`{content}`"))
    text = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " "), F.lit(" "))).otherwise("")
    return items.select(html_unescape("title").alias("title"), "link", html_unescape(F.col(f"`{summary}`")).alias("summary"), html_unescape(text).alias("text"))


def feed_links(items: DataFrame) -> DataFrame:
    return items.select("title", "link")


def feed_dump(items: DataFrame) -> DataFrame:
    """link, and all that a feed says of the item, as JSON with what is missing as null."""
    return items.select("link", F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"}).alias("item"))


def fetch_pages(links: DataFrame, make: Callable[[], Callable[[str], str]], link: str = "link") -> DataFrame:
    """links with html and fetch_error, by a fetcher that is made once for each task; whatever it raises becomes the row's error."""
    names = links.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()

        def one(url: str | None) -> tuple[str | None, str | None]:
            try:
                return fetch(url), None
            except Exception as e:  # noqa: BLE001  a page that can't be had is a row of its own
                return None, f"fetch: {e}"

        for pdf in batches:
            got = pd.DataFrame([one(u) for u in pdf[link]], columns=["html", "fetch_error"], index=pdf.index)
            yield pd.concat([pdf[names], got], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields)
    return links.mapInPandas(run, f"{kinds}, html string, fetch_error string")


def articles_of_pages(pages: DataFrame, html: str = "html", link: str = "url", fetch_error: str | None = None, **options) -> DataFrame:
    """link, ok, title, summary, text, error of saved or fetched pages, and the page itself where it gave no article; see functions.html.article for the options."""
    rows = pages.withColumn("a", article_udf(**options)(F.col(html)))
    failed = F.col(fetch_error).isNotNull() if fetch_error else F.lit(False)
    ok = F.col("a.ok") & ~failed
    error = F.when(failed, F.col(fetch_error)).otherwise(F.col("a.error")) if fetch_error else F.col("a.error")
    page = F.when(~ok, F.col(html)).alias("page")
    return rows.select(F.col(link).alias("link"), ok.alias("ok"), "a.title", F.lit(None).cast("string").alias("summary"), "a.text", error.alias("error"), page)


def transcripts_of_pages(pages: DataFrame, html: str = "html", link: str = "url") -> DataFrame:
    return pages.select(F.col(link).alias("link"), F.posexplode(transcript_paragraphs_udf(F.col(html))).alias("position", "paragraph"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links to process again, a line each."""
    return read_lines(spark, path).select(F.trim("value").alias("link")).distinct()


def read_whole_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """Links seen before; none if there is no table yet. Other errors are raised."""
    try:
        return spark.read.schema("link STRING").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "link STRING")


def jdbc_options(url: str) -> tuple[str, dict[str, str]]:
    """(JDBC URL, properties) of a database URL with user, password, host, port and name."""
    parts = urlsplit(url)
    kind = parts.scheme.partition("+")[0].replace("postgres", "postgresql").replace("postgresqlql", "postgresql")
    host = f"{parts.hostname}:{parts.port}" if parts.port else parts.hostname
    given = {"user": parts.username, "password": parts.password}
    return f"jdbc:{kind}://{host}{parts.path}", {k: unquote(v) for k, v in given.items() if v}


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    """A table of a database; credentials come from the caller."""
    return spark.read.jdbc(url, table, properties=properties)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector table with the columns and types of ``VECTORS``, and what else it is stored with. A table without one of these is an error."""
    rows = spark.read.parquet(path)
    own = dict(part.split(" ", 1) for part in VECTORS.split(", "))
    lacking = own.keys() - set(rows.columns)
    if lacking:
        raise ValueError(f"not a vector table, it lacks {', '.join(sorted(lacking))}")
    return rows.select(*(F.col(n).cast(kind).alias(n) for n, kind in own.items()), *(c for c in rows.columns if c not in own))


def contents_and_embeddings(vectors: DataFrame, id: str = "id") -> DataFrame:
    """What clustering reads: contents and embedding, in the order of ids, as its result depends on order."""
    return vectors.select(id, "contents", "embedding").orderBy(id)


def read_claim_texts(spark: SparkSession, path: str) -> DataFrame:
    """(idx, text, categories) of a claims file: its texts by position, with all of its categories."""
    rows = spark.read.schema("claim_texts ARRAY<STRING>, claim_categories ARRAY<STRING>").option("multiLine", True).json(path)
    return _gathered(rows).select(F.posexplode("claim_texts").alias("idx", "text"), F.col("claim_categories").alias("categories"))
