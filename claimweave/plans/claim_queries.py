"""Queries on extracted documents, which are built from the conversations table: a file for each conversation.

Their files have equal names in two folders; some have no filename, or null; local ids repeat;
entities lack a title, or have null; references point to nothing. The SQL builds the same rows
from the table and resolves them by its own joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.operators import resolve as R
from claimweave.operators import vector_table as V
from claimweave.operators.tables import fresh_path
from claimweave.plans import models
from claimweave.sources import feeds, readers, writers
from claimweave.streaming import ingest
from claimweave.streaming.run_log import RunLog, measures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _object(fields: dict[str, Column], null: str) -> Column:
    """A JSON object's text, in which the field of that name is written where it is null; other null fields are left out."""
    rest = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items() if n != null)))
    with_null = F.concat(F.substring(rest, 1, 1), F.lit(f'"{null}":null,'), F.substring(rest, 2, 1 << 30))
    return F.when(fields[null].isNull(), with_null).otherwise(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))))


def raw_documents(spark: SparkSession, d: str) -> DataFrame:
    """(path, raw): the documents as JSON texts."""
    t, c = F.col("turn"), F.col("conv_id")
    title = F.when((c + t) % 3 == 2, "dr")
    entity = {"id": _text("n", t), "type": F.lit("person"), "name": _text("name ", t % 3), "role": F.col("role"), "title": title}
    bare = F.to_json(F.struct(*(v.alias(k) for k, v in entity.items() if k != "title")))
    claim = F.struct(
        _text("k", t).alias("id"), _text("c", t % 3).alias("canonical_id"), F.lit("analysis").alias("type"), _text("q", c, ".", t).alias("quote"), F.col("text"), F.lit("all").alias("target"),
        F.when(t % 6 != 5, _text("n", t + 1)).alias("speaker"), F.array("role", F.lit("all")).alias("categories"), F.array(_text("s", t % 3), F.lit("s9")).alias("sources"),
        F.array(_text("e", t), F.lit("e77")).alias("events"), F.array(_text("k", t + 1)).alias("counter_arguments"),
    )
    rows = _table(spark, d, "conversations").select(
        "conv_id", "turn",
        _object({"id": _text("e", t), "name": _text("event ", t % 3), "description": _text("seen in ", c, ".", t), "location": F.lit("x"), "date": F.when(t % 4 != 0, _text("2025-01-0", t + 1))}, "date").alias("event"),
        F.to_json(F.struct(_text("s", t % 3).alias("id"), F.col("role").alias("type"), _text("source ", F.col("role"), " ", t % 2).alias("name"), F.lit("").alias("reference"))).alias("source"),
        F.when((c + t) % 3 == 0, bare).otherwise(_object(entity, "title")).alias("entity"),
        F.to_json(claim).alias("claim"),
    )
    listed = rows.groupBy("conv_id").agg(*(F.array_join(F.array_sort(F.collect_list(F.struct("turn", x)))[x], ",").alias(f"{x}s") for x in ("event", "source", "entity", "claim")))
    refuting = F.when(c % 4 == 0, F.lit("")).otherwise(F.lit('"refuting_claims":["k1"],'))
    canon = [_text(f'{{"id":"c{j}","text":"canon ', c % 10, f' {j}","category":"cat{j}","supporting_claims":["k0","k99"],', refuting, '"uncertain_claims":["k0"]}') for j in (0, 1)]
    named = F.when(c % 5 == 0, '"filename":null,').when(c % 5 == 1, "").otherwise(_text('"filename":"named', c, '.json",'))
    link = F.when(c % 7 == 0, "").otherwise(_text('"link":"http://x/', c, '",'))
    raw = _text(
        '{"title":"T",', named, link, '"canonical_claims":[', canon[0], ",", canon[1], '],"claims":[', F.col("claims"),
        '],"sources":[', F.col("sources"), '],"events":[', F.col("events"), '],"entities":[', F.col("entitys"), "]}",
    )
    return listed.select(_text("d", c % 2, "/f", F.floor(c / 2), ".json").alias("path"), raw.alias("raw"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_documents(raw_documents(spark, d))[0]


def _joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


_BASE = """b AS (SELECT conv_id AS c, turn AS t, role AS r, text AS x, 'd' || (conv_id % 2) || '/f' || (conv_id // 2) || '.json' AS path,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
d AS (SELECT DISTINCT c, path, CASE WHEN c % 5 = 0 THEN NULL WHEN c % 5 = 1 THEN 'f' || (c // 2) || '.json' ELSE 'named' || c || '.json' END AS filename, CASE WHEN c % 7 <> 0 THEN 'http://x/' || c END AS link FROM b),
ev AS (SELECT *, 'e' || t AS id, 'event ' || (t % 3) AS name, CASE WHEN t % 4 <> 0 THEN '2025-01-0' || (t + 1) END AS date, name || ' ' || coalesce(date, 'None') AS uname FROM b),
so AS (SELECT *, 's' || (t % 3) AS id, 'source ' || r || ' ' || (t % 2) AS name FROM b),
en AS (SELECT *, 'n' || t AS id, 'name ' || (t % 3) AS name, CASE (c + t) % 3 WHEN 0 THEN name WHEN 1 THEN name || ' None' ELSE name || ' dr' END AS uname FROM b)"""


@query(f"WITH {_BASE} SELECT md5(uname) AS id, uname, name, date, 'seen in ' || c || '.' || t AS description FROM ev QUALIFY row_number() OVER (PARTITION BY uname ORDER BY path, pos) = 1")
def md5_events(spark, d):
    return R.by_md5(documents(spark, d))["events"].select("id", "uname", "name", "date", "description")


@query(f"WITH {_BASE} SELECT md5(name) AS id, name, r AS type FROM so QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, pos) = 1")
def md5_sources(spark, d):
    return R.by_md5(documents(spark, d))["sources"].select("id", "name", "type")


@query(f"WITH {_BASE} SELECT md5(uname) AS id, uname, name, r AS role FROM en QUALIFY row_number() OVER (PARTITION BY uname ORDER BY path, pos) = 1")
def md5_entities(spark, d):
    """A missing title gives the name alone, a null one reads None."""
    return R.by_md5(documents(spark, d))["entities"].select("id", "uname", "name", "role")


@query(f"""WITH {_BASE}, lastso AS (SELECT c, id, arg_max(name, pos) AS name FROM so GROUP BY 1, 2)
SELECT md5(b.x) AS id, b.x AS text, CASE WHEN b.t % 3 < 2 THEN md5('canon ' || (b.c % 10) || ' ' || (b.t % 3)) ELSE '' END AS canonical_id,
  CASE WHEN b.t % 6 <> 5 THEN coalesce(md5(en.uname), '') ELSE '' END AS speaker, b.r || ',all' AS categories,
  coalesce(md5(lastso.name), 's' || (b.t % 3)) || ',s9' AS sources, md5(ev.uname) || ',e77' AS events, coalesce(link, '') AS link, filename AS file
FROM b JOIN d USING (c) JOIN ev ON ev.c = b.c AND ev.t = b.t LEFT JOIN en ON en.c = b.c AND en.t = b.t + 1 LEFT JOIN lastso ON lastso.c = b.c AND lastso.id = 's' || (b.t % 3)
QUALIFY row_number() OVER (PARTITION BY b.x ORDER BY b.path DESC, b.pos DESC) = 1""")
def md5_claims(spark, d):
    """The last row of each text; of repeated local ids the last, unmatched references as they are or empty."""
    return R.by_md5(documents(spark, d))["claims"].select("id", "text", "canonical_id", "speaker", _joined("categories"), _joined("sources"), _joined("events"), "link", "file")


_CANON = f"""{_BASE}, k AS (SELECT c, t, md5(x) AS id FROM b),
cc AS (SELECT d.c, d.path, j AS pos, 'canon ' || (d.c % 10) || ' ' || j AS text,
  coalesce((SELECT id FROM k WHERE k.c = d.c AND t = 0), 'k0') AS k0, coalesce((SELECT id FROM k WHERE k.c = d.c AND t = 1), 'k1') AS k1 FROM d, (VALUES (0), (1)) v(j)),
ccr AS (SELECT *, md5(text) AS id, 'cat' || pos AS category, k0 || ',k99' AS supporting_claims, CASE WHEN c % 4 <> 0 THEN k1 END AS refuting_claims,
  CASE WHEN c % 4 <> 0 THEN k0 ELSE 'k0' END AS uncertain_claims FROM cc)"""


@query(f"WITH {_CANON} SELECT id, text, category, supporting_claims, refuting_claims, uncertain_claims FROM ccr QUALIFY row_number() OVER (PARTITION BY id ORDER BY path DESC, pos DESC) = 1")
def md5_canonical(spark, d):
    """Where one array is missing, it and those after it aren't rewritten."""
    groups = ("supporting_claims", "refuting_claims", "uncertain_claims")
    return R.by_md5(documents(spark, d))["canonical_claims"].select("id", "text", "category", *map(_joined, groups))


@query(f"""WITH {_CANON}, lastk AS (SELECT c, md5(arg_max(x, pos)) AS last FROM b GROUP BY 1)
SELECT ccr.id, text, category FROM ccr JOIN lastk USING (c) WHERE pos = 1 QUALIFY row_number() OVER (PARTITION BY last ORDER BY path DESC) = 1""")
def md5_canonical_compat(spark, d):
    """One canonical claim a document, filed under its last claim; of equal ones the last document's."""
    return R.by_md5(documents(spark, d), compat=True)["canonical_claims"].select("id", "text", "category")


_UIDS = f"""{_BASE}, first AS (SELECT kind, key, min({{'p': path, 'o': pos}}) AS f
  FROM (SELECT 'ev' AS kind, uname AS key, path, pos FROM ev UNION ALL SELECT 'so', name, path, pos FROM so UNION ALL SELECT 'en', name, path, pos FROM en) GROUP BY 1, 2),
uid AS (SELECT kind, key, CAST(row_number() OVER (PARTITION BY kind ORDER BY f.p, f.o) - 1 AS BIGINT) AS uid FROM first)"""


@query(f"WITH {_UIDS} SELECT uid, key, date FROM uid JOIN ev ON key = uname WHERE kind = 'ev' QUALIFY row_number() OVER (PARTITION BY key ORDER BY path, pos) = 1")
def uid_events(spark, d):
    return R.by_uid(documents(spark, d))["events"].select("uid", "key", "date")


@query(f"WITH {_UIDS} SELECT uid, key, r AS role FROM uid JOIN en ON key = name WHERE kind = 'en' QUALIFY row_number() OVER (PARTITION BY key ORDER BY path, pos) = 1")
def uid_entities(spark, d):
    """Known by name alone."""
    return R.by_uid(documents(spark, d))["entities"].select("uid", "key", "role")


@query(f"""WITH {_UIDS}, k AS (SELECT *, CAST(row_number() OVER (ORDER BY path, pos) - 1 AS BIGINT) AS uid FROM b), firstso AS (SELECT c, id, arg_min(name, pos) AS name FROM so GROUP BY 1, 2)
SELECT k.uid, 'k' || k.t AS id, k.x AS text, coalesce(CASE WHEN k.t % 6 <> 5 THEN coalesce(CAST(ue.uid AS VARCHAR), 'n' || (k.t + 1)) END, '') AS speaker,
  coalesce(CAST(us.uid AS VARCHAR), 's' || (k.t % 3)) || ',s9' AS sources, CAST(uv.uid AS VARCHAR) || ',e77' AS events, coalesce(CAST(k2.uid AS VARCHAR), 'k' || (k.t + 1)) AS counter_arguments,
  filename AS source_filename, link AS source_weblink, CAST(NULL AS BIGINT) AS embed_id, k.x || ' : ' || k.r || ' all' || CASE WHEN k.t % 6 <> 5 AND en.name IS NOT NULL THEN ': ' || en.name ELSE '' END AS train_text
FROM k JOIN d USING (c) JOIN ev ON ev.c = k.c AND ev.t = k.t JOIN uid uv ON uv.kind = 'ev' AND uv.key = ev.uname
LEFT JOIN en ON en.c = k.c AND en.t = k.t + 1 LEFT JOIN uid ue ON ue.kind = 'en' AND ue.key = en.name
LEFT JOIN firstso ON firstso.c = k.c AND firstso.id = 's' || (k.t % 3) LEFT JOIN uid us ON us.kind = 'so' AND us.key = firstso.name LEFT JOIN k k2 ON k2.c = k.c AND k2.t = k.t + 1""")
def uid_claims(spark, d):
    """All claims by running number; of repeated local ids the first, references between claims included."""
    names = ("sources", "events", "counter_arguments")
    claims = R.by_uid(documents(spark, d))["claims"]
    return claims.select("uid", "id", "text", F.coalesce("speaker", F.lit("")).alias("speaker"), *map(_joined, names), "source_filename", "source_weblink", "embed_id", "train_text")


@query(f"WITH {_UIDS} SELECT string_agg(key, '|' ORDER BY uid) AS names FROM uid WHERE kind = 'so'")
def source_name_list(spark, d):
    """The names in the order of first sight."""
    return R.name_list(R.by_uid(documents(spark, d))["sources"], "key").select(F.array_join("names", "|").alias("names"))


@query(f"WITH {_BASE} SELECT DISTINCT r AS category FROM b UNION SELECT 'all'")
def claim_categories(spark, d):
    return R.by_md5(documents(spark, d))["claims"].select(F.explode("categories").alias("category")).distinct()


@query("""SELECT CAST(conv_id AS VARCHAR) AS name, count(*) AS claims,
  CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'f' || conv_id || '.JSON' ELSE 'named' || conv_id || '.json' END AS filename FROM conversations GROUP BY conv_id""")
def json_directory_scan(spark, d):
    """Documents written as files in two folders and read back, nested folders and either case of the ending included."""
    docs = raw_documents(spark, d).select(F.regexp_extract("path", r"d(\d)", 1).cast("int").alias("a"), F.regexp_extract("path", r"f(\d+)", 1).cast("int").alias("b"), "raw")
    folder = write_files(docs.select(_text("d", F.col("a"), "/f", F.col("b") * 2 + F.col("a"), ".JSON").alias("path"), "raw"))
    good, _ = readers.read_documents(spark, folder, recursive=True)
    return good.select(F.regexp_extract("path", r"f(\d+)\.JSON$", 1).alias("name"), F.size("claims").cast("long").alias("claims"), "filename")


def write_files(rows: DataFrame) -> str:
    """(path, raw) as single files in a fresh shared folder, each written by the task that has the row."""
    folder = fresh_path(rows.sparkSession)
    root = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    if root.startswith("file:"):
        root = "file://" + root.removeprefix("file:").removeprefix("//")
    try:
        FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):  # a folder that only Spark's file system can open
        return _write_by_driver(rows, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent = f"{top}/{path}".rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(f"{top}/{path}") as out:
                    out.write(raw.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    rows.select("path", "raw").mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


def _write_by_driver(rows: DataFrame, folder: str) -> str:
    spark = rows.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(root, r.path))
        out.write(bytearray(r.raw.encode()))
        out.close()
    return folder


@query("SELECT 'd' || (conv_id % 2) || '/f' || (conv_id // 2) || '.json' AS path, CASE conv_id % 4 WHEN 0 THEN 'ok' ELSE 'unreadable' END AS kind FROM conversations GROUP BY conv_id")
def unreadable_documents(spark, d):
    """Cut off, trailing or non-object JSON is set aside with its path."""
    broken = F.regexp_extract("path", r"f(\d+)", 1).cast("int") * 2 + F.regexp_extract("path", r"d(\d)", 1).cast("int")
    raw = F.when(broken % 4 == 0, F.col("raw")).when(broken % 4 == 1, F.substring("raw", 1, 100)).when(broken % 4 == 2, F.concat("raw", F.lit(" more"))).otherwise(F.concat(F.lit("["), "raw", F.lit("]")))
    good, bad = R.parse_documents(raw_documents(spark, d).withColumn("raw", raw))
    return good.select("path", F.lit("ok").alias("kind")).unionByName(bad.select("path", F.lit("unreadable").alias("kind")))


@query("SELECT conv_id, turn, role || ' ' || turn AS text FROM conversations")
def claim_texts_scan(spark, d):
    """A claims file's texts by position."""
    rows = _table(spark, d, "conversations").select("conv_id", "turn", _text(F.col("role"), " ", F.col("turn")).alias("x"))
    listed = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"]).alias("claim_texts"), F.array(F.col("conv_id").cast("string")).alias("claim_categories"))
    files = write_files(listed.select(_text(F.col("conv_id"), ".json").alias("path"), F.to_json(F.struct("claim_texts", "claim_categories")).alias("raw")))
    found = readers.read_claim_texts(spark, files)
    return found.select(F.col("categories")[0].cast("long").alias("conv_id"), F.col("idx").cast("long").alias("turn"), "text")


@query("SELECT source AS label, string_agg(chr(9) || '- ' || doc_id, chr(10) ORDER BY doc_id) AS lines FROM documents GROUP BY 1")
def report_of_clusters(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("contents"))
    report = writers.cluster_report(rows.withColumnRenamed("source", "label"), order="doc_id")
    return report.select("label", F.substring_index("report", "---\n", -1).alias("lines"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings")
def scatter_dimensions(spark, d):
    rows = _table(spark, d, "embeddings")
    own = rows.select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"), "label")
    both = writers.first_two_dimensions(rows).join(own, ["x", "y", "label"])
    return both.select("vec_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "label")


@query("SELECT event_id, '{\"category\":\"' || event_type || '\",\"created_at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '\"}' AS metadata FROM events")
def record_metadata(spark, d):
    """What a record's metadata says: category and an ISO time."""
    rows = _table(spark, d, "events")
    return rows.select("event_id", T.metadata_json(F.col("ts").cast("timestamp"), category=F.col("event_type")).alias("metadata"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS k FROM events")
def metadata_discovery(spark, d):
    """Metadata keys found in the data, as columns; ids as text."""
    rows = _table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("metadata"))
    return V.results_frame(rows)


# --- text search and answers, by an embedder that SQL can follow


def letters(text: str) -> list[float]:
    """How often each letter a to z stands in a text."""
    return [float(text.count(chr(97 + k))) for k in range(26)]


_LETTERS = "[CAST(length({x}) - length(replace({x}, chr(CAST(97 + k AS INTEGER)), '')) AS DOUBLE) FOR k IN range(26)]"
_ASKED = "the other thing in this"
_FOUND = f"""SELECT item_id AS id, text, greatest(0.0, least(2.0, list_cosine_distance({_LETTERS.format(x="replace(text, chr(10), ' ')")}, {_LETTERS.format(x=f"'{_ASKED}'")}))) AS d FROM benchmark"""


def _texts(spark, d) -> DataFrame:
    rows = _table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("contents"), T.newline_to_space(F.col("text")).alias("line"))
    return models.embed(rows, "line", make=lambda: letters).drop("line")


@query(f"SELECT id, text AS contents, round(d, 6) + 0.0 AS distance FROM ({_FOUND}) ORDER BY d, id LIMIT 5")
def text_search(spark, d):
    found = V.search_text(_texts(spark, d), _ASKED, letters)
    return found.select("id", "contents", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"SELECT id, text, round(1 - d, 6) + 0.0 AS score FROM ({_FOUND}) ORDER BY d, id LIMIT 10")
def text_search_scores(spark, d):
    found = V.scored(V.search_text(_texts(spark, d), _ASKED, letters, 10))
    return found.select("id", "text", (F.round("score", 6) + 0.0).alias("score"))


@query(f"""WITH top AS (SELECT * FROM ({_FOUND}) ORDER BY d, id LIMIT 5),
o AS (SELECT *, len(list_intersect(list_distinct(string_split('{_ASKED}', ' ')), [w FOR w IN string_split_regex(lower(text), '\\s+') IF w <> ''])) AS n,
  row_number() OVER (ORDER BY d, id) AS k FROM top)
SELECT '{_ASKED}' AS question, arg_max(CASE WHEN n > 0 THEN text ELSE '' END, {{'n': n, 'k': -k}}) AS answer, max(n) > 0 AS enough_context, CAST(5 AS BIGINT) AS rows_of_context FROM o""")
def rag_answer(spark, d):
    """Search, context and answer in one plan; the answer is a stand-in's, by shared words."""
    found = V.search_text(_texts(spark, d), _ASKED, letters).withColumn("category", F.lit("item"))
    got = models.answer(found, _ASKED, ["distance", "id"])
    return got.select("question", "answer", "enough_context", F.size(F.from_json("context", "array<struct<content:string,category:string>>")).cast("long").alias("rows_of_context"))


# --- models, pages and runs


@query("SELECT n_name AS article, m AS model, CASE WHEN m = 'a' OR n_name < 'NATION_13' THEN 'ok' WHEN n_name = 'NATION_13' THEN 'failed' ELSE 'skipped' END AS status FROM nation CROSS JOIN (VALUES ('a'), ('b')) v(m)")
def sweep_until_error(spark, d):
    """Two models over all articles, one of which stops at the article that it fails on."""

    def stand_in(settings: models.ModelSettings) -> Callable[[str], str]:
        def reply(prompt: str) -> str:
            if settings.model == "b" and "Title: NATION_13\n" in prompt:
                raise OSError("down")
            return "{}"

        return reply

    articles = _table(spark, d, "nation").select(F.col("n_name").alias("link"), F.col("n_name").alias("title"), F.lit("").alias("text"))
    chosen = models.overridden((models.ModelSettings("own", "x"),), {"own": {"model": "a"}}) + (models.ModelSettings("own", "b"),)
    done = models.run_sweep(articles, list(chosen), models.Registry().add("own", stand_in), "Read.", stop_on_error=True)
    return done.select("article", "model", "status")


@query("SELECT url AS link, page_id % 5 <> 0 AND contains(html, '<h1') AS ok, CASE WHEN page_id % 5 = 0 THEN 'fetch: down' END AS error FROM pages")
def fetch_pages(spark, d):
    """Pages had from a fetcher, here a stand-in that fails on some, and read as articles."""
    pages = _table(spark, d, "pages").select(F.col("url").alias("link"), F.concat(F.when(F.col("page_id") % 5 == 0, "!").otherwise(""), "html").alias("saved"))

    def make() -> Callable[[str], str]:
        def fetch(saved: str) -> str:
            if saved.startswith("!"):
                raise OSError("down")
            return saved

        return fetch

    got = readers.fetch_pages(pages, make, link="saved")
    return readers.articles_of_pages(got, link="link", fetch_error="fetch_error", container="article", container_class=None).select("link", "ok", "error")


@query("SELECT page_id, 'T &' AS title, 'one two ' AS text FROM pages")
def feed_items(spark, d):
    """Feed items: link-only paragraphs go, each paragraph has a space after it, entities are decoded twice."""
    items = _table(spark, d, "pages").select(F.lit("T &amp;amp;").alias("title"), F.col("page_id").cast("string").alias("link"), F.lit("s").alias("summary"), F.lit("<p>one</p><p><a href='x'>ad</a></p><p>two</p>").alias("content"))
    unescaped = items.withColumn("title", F.lit("T &amp;"))
    return readers.articles_of_items(unescaped).select(F.col("link").cast("long").alias("page_id"), "title", "text")


def _feeds(spark: SparkSession, d: str) -> list[str]:
    """Saved feeds of the pages, fifty a feed: a page's html is an item's content."""
    pages = _table(spark, d, "pages").select("page_id", F.concat(F.lit("Page & "), "page_id").alias("title"), F.col("url").alias("link"), F.lit(None).cast("string").alias("summary"), F.col("html").alias("content"))
    return feeds.saved_feeds(pages, fresh_path(spark), F.floor(F.col("page_id") / 50))


@query("SELECT 'Page & ' || page_id AS title, url AS link, CAST(NULL AS VARCHAR) AS summary, md5(html) AS content FROM pages")
def feed_batch(spark, d):
    """All items of live feeds, by the feed data source, a task for each feed."""
    return feeds.feed_items(spark, _feeds(spark, d)).select("title", "link", "summary", F.md5("content").alias("content"))


@query("""SELECT url AS link, md5('{"title":"Page & ' || page_id || '","link":' || to_json(url) || ',"summary":null,"n":' || length(html) || '}') AS item FROM pages""")
def feed_dump(spark, d):
    """All that live feeds say of each item, what is missing as null."""
    items = feeds.feed_items(spark, _feeds(spark, d)).withColumn("n", F.length("content"))
    return readers.feed_dump(items.select("title", "link", "summary", "n")).select("link", F.md5("item").alias("item"))


@query("SELECT 'Page & ' || page_id AS title, url AS link FROM pages")
def feed_link_list(spark, d):
    """Titles and links of live feeds."""
    return readers.feed_links(feeds.feed_items(spark, _feeds(spark, d)))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, 'vector of ' || label AS contents, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def contents_scan(spark, d):
    """Contents and vectors of a stored table, in the order of ids."""
    path = fresh_path(spark)
    rows = _table(spark, d, "embeddings").select(_text(F.col("vec_id")).alias("id"), F.to_json(F.struct("label")).alias("metadata"), F.concat(F.lit("vector of "), "label").alias("contents"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows.write.parquet(path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return readers.contents_and_embeddings(readers.read_vectors(spark, path)).select("id", "contents", (F.round(total, 6) + 0.0).alias("total"))


@query("SELECT DISTINCT ON (url) url AS link, 'ok' AS status FROM pages ORDER BY url")
def feed_stream(spark, d):
    """Live feeds as a stream into the ingest, in micro-batches of at most 40 items, stopped once and started again: each link is extracted."""
    urls, folder = _feeds(spark, d), fresh_path(spark)
    up = lambda: [("up", lambda p: "{}")]
    for _ in range(2):
        items = readers.articles_of_items(feeds.feed_items(spark, urls, stream=True, most="40"))
        query_ = ingest.start_ingest(spark, None, f"{folder}/out", f"{folder}/c", make=up, once_a_link=True, available_now=False, poll="0 seconds", articles=items)
        ingest.drain(query_)
    return ingest.results(spark, f"{folder}/out").select("link", "status")


@query("SELECT count(*) AS articles, count(url) AS links, (SELECT count(*) FROM pages) AS results FROM pages")
def ingest_log(spark, d):
    """The run log of an ingest: what its micro-batches counted, beside the rows that they wrote."""
    folder = fresh_path(spark)
    _table(spark, d, "pages").select(_text(F.col("page_id")).alias("title"), F.col("url").alias("link"), F.lit("s").alias("summary"), F.col("html").alias("text")).write.json(f"{folder}/in")
    log = RunLog(spark, f"{folder}/log")
    ingest.start_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/c", make=lambda: [("up", lambda p: "{}")]).awaitTermination()
    sums = measures(log.close(), "articles", "links").agg(F.sum("articles").alias("articles"), F.sum("links").alias("links"))
    return sums.crossJoin(ingest.results(spark, f"{folder}/out").agg(F.count("*").alias("results")))  # a row each


def _ingested(spark: SparkSession, d: str) -> str:
    """Three starts over the pages' links, of which some are failed at first: down for odd pages, up, and once more from a new checkpoint. Returns the folder."""
    folder = fresh_path(spark)
    pages = _table(spark, d, "pages").select(_text(F.col("page_id") % 2).alias("title"), F.col("url").alias("link"), F.lit("s").alias("summary"), F.lit("Words.").alias("text"))
    pages.write.json(f"{folder}/in")

    def half(prompt: str) -> str:
        if "Title: 1" in prompt:
            raise OSError("down")
        return "{}"

    up = lambda: [("up", lambda p: "{}")]
    for make, checkpoint in ((lambda: [("half", half)], "a"), (up, "a"), (up, "b")):
        ingest.start_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/{checkpoint}", make=make).awaitTermination()
    return f"{folder}/out"


@query("SELECT DISTINCT url AS link FROM pages")
def ingest_seen(spark, d):
    """After a start with failures, one without, and one from a new checkpoint all links are seen."""
    return ingest.seen_links(spark, _ingested(spark, d))


@query("""SELECT 0 AS run, CASE WHEN page_id % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM pages GROUP BY page_id % 2
UNION ALL SELECT 1, 'ok', count(DISTINCT url) FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)""")
def ingest_runs(spark, d):
    """Rows by run and status: the second start takes up what failed, the third finds nothing new."""
    return ingest.results(spark, _ingested(spark, d)).groupBy("run", "status").agg(F.count("*").alias("n")).select(F.col("run").cast("int").alias("run"), "status", "n")
