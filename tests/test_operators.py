import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimweave.functions.html import article, feed_paragraphs, transcript_paragraphs
from claimweave.functions.json_text import json_object, json_strict
from claimweave.functions.text import claim_line, strip_fence, url_parts
from claimweave.operators import density as D
from claimweave.operators import graphs as G
from claimweave.operators import pairs as P
from claimweave.operators import tables
from claimweave.operators import vector_table as V
from claimweave.operators.numbering import numbered, running_total
from claimweave.operators.predicates import Predicate
from claimweave.operators.resolve import by_md5, by_uid, load_tables
from claimweave.plans import models as M
from claimweave.plans.models import call, stub_answer
from claimweave.sources import readers, writers
from claimweave.sources.readers import read_documents
from claimweave.streaming import ingest

DOC = {
    "title": "T", "link": "http://x/1", "filename": "a.json",
    "canonical_claims": [{"id": "c1", "text": "Tariffs rose", "category": "economy", "supporting_claims": ["k1"], "refuting_claims": [], "uncertain_claims": ["k9"]}],
    "claims": [{"id": "k1", "canonical_id": "c1", "type": "analysis", "quote": "q", "text": "Tariffs are up", "target": "t", "speaker": "n1", "categories": ["economy", "trade"], "sources": ["s1"], "events": ["e1", "e7"]}],
    "sources": [{"id": "s1", "type": "report", "name": "Report A", "reference": ""}],
    "events": [{"id": "e1", "name": "Tariff hearing", "date": "2025-03-04", "description": "d", "location": "l"}],
    "entities": [{"id": "n1", "type": "person", "name": "Jane Roe", "title": "economist", "role": "r"}],
}


def documents(spark, tmp_path, *docs):
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.JSON").write_text(json.dumps(d))
    (tmp_path / "bad.json").write_text("{not json")
    return read_documents(spark, str(tmp_path))


def test_md5_resolution(spark, tmp_path):
    other = json.loads(json.dumps(DOC)) | {"filename": "b.json"}
    other["events"][0]["description"] = "later"
    other["claims"][0]["quote"] = "newer"
    other["canonical_claims"].append({"id": "c2", "text": "Second", "category": "x", "supporting_claims": ["k1"], "uncertain_claims": ["k1"]})
    good, bad = documents(spark, tmp_path, DOC, other)
    assert bad.count() == 1
    out = by_md5(good)
    event = out["events"].collect()
    assert [(e.id, e.description) for e in event] == [("57cda44e44f9b28c1cde72e1ad596d82", "d")]
    claim = out["claims"].first()
    assert claim.quote == "newer" and claim.events == [event[0].id, "e7"] and claim.file == "b.json"
    cc = {c.text: c for c in out["canonical_claims"].collect()}
    assert cc["Tariffs rose"].supporting_claims == [claim.id] and cc["Tariffs rose"].uncertain_claims == ["k9"]
    assert cc["Second"].supporting_claims == [claim.id] and cc["Second"].uncertain_claims == ["k1"], "arrays after a missing one stay"
    compat = by_md5(good, compat=True)["canonical_claims"].collect()
    assert [c.text for c in compat] == ["Second"]


def test_uid_resolution(spark, tmp_path):
    good, _ = documents(spark, tmp_path, DOC)
    out = by_uid(good)
    claim = out["claims"].first()
    assert claim.uid == 0 and claim.events == ["0", "e7"] and claim.speaker == "0"
    assert claim.train_text == "Tariffs are up : economy trade: Jane Roe"


def test_same_file_names_are_different_documents(spark, tmp_path):
    """Equal base names in two folders, local ids alike: nothing passes from one to the other."""
    for folder, who in (("a", "Alpha"), ("b", "Beta")):
        (tmp_path / folder).mkdir()
        doc = json.loads(json.dumps(DOC)) | {"filename": None}
        doc["entities"][0]["name"] = who
        doc["claims"][0]["text"] = f"{who} says so"
        doc["claims"][0]["counter_arguments"] = ["k1", "k2"]
        (tmp_path / folder / "x.json").write_text(json.dumps(doc))
    docs, bad = read_documents(spark, str(tmp_path), recursive=True)
    assert bad.count() == 0 and {r.filename for r in docs.collect()} == {None}, "a filename of null stays null"
    claims = {r.text: r for r in by_uid(docs)["claims"].collect()}
    assert claims["Beta says so"].train_text == "Beta says so : economy trade: Beta" and claims["Beta says so"].speaker == "1"
    assert (claims["Alpha says so"].uid, claims["Beta says so"].uid) == (0, 1)
    assert claims["Beta says so"].counter_arguments == ["1", "k2"]


def test_files_are_written_by_tasks(spark, monkeypatch):
    """No row of them comes to the driver."""
    from pyspark.sql import DataFrame

    from claimweave.plans.claim_queries import write_files

    def none(self, *a, **b):
        raise AssertionError("rows on the driver")

    rows = spark.createDataFrame([("a/x.json", "{}"), ("a/b/y z.JSON", "ü\n"), ("w.json", "")], "path string, raw string").repartition(3)
    monkeypatch.setattr(DataFrame, "toLocalIterator", none)
    monkeypatch.setattr(type(rows), "toLocalIterator", none)
    folder = write_files(rows)
    found = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    assert sorted((r.p.rpartition(folder.rpartition("/")[2] + "/")[2], r.value) for r in found.collect()) == [("a/b/y%20z.JSON", "ü\n"), ("a/x.json", "{}")] + ([("w.json", "")] if found.count() == 3 else [])


def test_titles_missing_and_null(spark, tmp_path):
    doc = json.loads(json.dumps(DOC))
    doc["entities"] = [{"id": "n1", "name": "Alpha", "title": None}, {"id": "n2", "name": "Alpha"}, {"id": "n3", "name": "Alpha", "title": "dr"}]
    doc["claims"][0]["speaker"] = "n1"
    good, _ = documents(spark, tmp_path, doc)
    out = by_md5(good)
    names = {r.uname: r.id for r in out["entities"].collect()}
    assert set(names) == {"Alpha None", "Alpha", "Alpha dr"} and out["claims"].first().speaker == names["Alpha None"]


def test_documents_without_collections(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "T", "claims": [], "events": null}')
    (tmp_path / "b.json").write_text('{"claims": [{"id": "k", "text": "x", "speaker": "gone"}]} trailing')
    (tmp_path / "c.JSON").write_text('{"claims": [{"id": "k", "text": "x", "canonical_id": "gone"}]}')
    good, bad = read_documents(spark, str(tmp_path))
    assert good.count() == 2 and [r.path.rpartition("/")[2] for r in bad.collect()] == ["b.json"]
    claims = by_md5(good)["claims"].collect()
    assert [(c.speaker, c.canonical_id, c.file) for c in claims] == [("", "", "c.JSON")]
    assert by_uid(good)["claims"].first().speaker is None


def test_numbers_over_ranges(spark):
    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(7)
    assert [r.uid for r in numbered(df, ["k"]).orderBy("k").collect()] == list(range(1000))
    total, want = 0, {}
    for k, n in sorted(rows):
        want[k], total = total, total + n
    assert {r.k: r.before for r in running_total(df, ["k"], F.col("n"), "before").collect()} == want
    assert numbered(df.where("false"), ["k"]).count() == 0


def test_html():
    page = "<h1>A &amp;amp; B</h1><div class='article-body'><p>One<br>two<p><strong>ad</strong></p><div class='caption'><p>no</p></div><p> </p><p>three</p></div>"
    assert article(page) == (True, "A & B", "Onetwo three", None)
    assert article("<p>x</p>")[3] == "no_title" and article("<h1>t</h1>")[3] == "no_body"
    assert article("<h1>t</h1>", require_body=False) == (True, "t", "", None)
    assert feed_paragraphs("<p><a>x</a></p><p>y <a>z</a></p>") == ["y z"]
    assert transcript_paragraphs("<p class='speakable'>a<br>b</p><p class='q'>c</p>") == ["a\nb"]
    assert article(page, separator="")[2] == "Onetwothree"
    deep = "<h1>t</h1><div class='article-body'>" + "<div><span>" * 5000 + "<p>deep</p>"
    assert article(deep) == (True, "t", "deep", None)


def test_references_cut_off():
    page = "<h1>a&amp;&amp</h1><div class='article-body'><p>b &#38; &lt &quo &amp</p></div>"
    assert article(page) == (True, "a&&", "b & < &quo &", None)
    assert article(page, terminated=True) == (True, "a&&amp", "b & &lt &quo &amp", None)


def test_article_query_with_titles_cut_off(spark, tmp_path):
    """The query equals its SQL on pages whose title ends within a reference."""
    import duckdb

    from claimweave.plans.queries import ORACLES, QUERIES

    rows = [(i, f"u{i}", f"<h1>a&amp;{end}</h1><article><p>b{end}</p></article>") for i, end in enumerate(("&amp;", "&amp", "&am", "&", "&lt", "&quot", "&gt;"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["html_article_text"](spark, str(tmp_path)).select("link", "title", "text").collect())
    assert got == sorted(con.execute(f"SELECT link, title, text FROM ({ORACLES['html_article_text']})").fetchall())


def test_text_columns(spark):
    df = spark.createDataFrame([('```json\n{"a":1}```', 'x\nClaim: "yes" \n'), (" ```json{}", "plain ")], "a string, b string")
    got = df.select(strip_fence(F.col("a")), claim_line(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [('{"a":1}', "yes"), (" ```json{}", "plain")]
    strict = spark.createDataFrame([("{}",), ("{} x",), ("[1]",), (None,)], "s string").select(json_strict("s")["error"]).collect()
    assert [r[0] for r in strict] == [None, "bad_json", "bad_shape", "bad_json"]


def test_objects_are_told_text_by_text(spark):
    """As the strict parser says; and the memory doesn't follow the texts of a batch."""
    odd = ["{}", '{"a":1} ', "{} x", "[1]", "null", "", None, '{"a":NaN}', "{'a':1}"]
    rows = spark.createDataFrame([(t,) for t in odd], "s string")
    assert [tuple(r) for r in rows.select(json_object("s"), json_strict("s")["ok"]).collect()] == [(k in (0, 1, 7),) * 2 for k in range(len(odd))]
    batch = pa.array(['{"a":"' + "x" * 5000 + '"}'] * 2000)
    tracemalloc.start()
    assert json_object.func(batch).to_pylist() == [True] * 2000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1e6, most


def test_extraction_sends_python_the_prompts_alone(spark):
    """Other columns stay in Spark, of any type; a batch's replies come in several parts, each with its own prompt, and none is asked twice."""
    rows = spark.range(600, numPartitions=1).selectExpr("id", "map('k', id) AS m", "if(id = 7, null, concat('p', id)) AS asked", "1 AS `a.b`")
    out = M.extract(rows, "asked", lambda: [("first", lambda p: json.dumps({"p": p, "n": next(counter)})) for counter in [iter(range(10**6))]])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan and out.columns == ["id", "m", "asked", "a.b", "status", "error", "attempts", "provider", "reply", "raw"]
    got = out.orderBy("id").collect()
    assert [json.loads(r.reply) for r in got] == [{"p": "" if k == 7 else f"p{k}", "n": k} for k in range(600)]
    assert {(r.status, r.error, r.attempts, r.provider, r.raw) for r in got} == {("ok", None, 1, "first", None)} and got[9].m == {"k": 9}


def test_passwords_with_colons(spark):
    assert spark.createDataFrame([("ftp://me:pa:ss@h/x",)], "u string").select(url_parts(F.col("u"))["password"]).first()[0] == "pa:ss"


def test_url_parts(spark):
    df = spark.createDataFrame([("postgresql://me:se%3Acret@db.example:5433/news?x=1",), ("https://example.org/a",)], "u string")
    parts = url_parts(F.col("u"))
    got = df.select(*(c.alias(n) for n, c in parts.items())).collect()
    assert (got[0].user, got[0].host, got[0].port, got[0].path) == ("me", "db.example", 5433, "/news") and got[1].port is None and got[1].user is None
    assert readers.jdbc_options("postgresql://me:se%3Acret@db.example:5433/news") == ("jdbc:postgresql://db.example:5433/news", {"user": "me", "password": "se:cret"})


def test_retry_and_failover():
    replies = iter(["nope", "```json\n{}```"])
    assert call("p", [("m", lambda p: next(replies))])[:3] == ("ok", None, 2)

    def down(p):
        raise OSError("down")

    assert call("p", [("a", down), ("b", lambda p: "{}")])[3] == "b"
    assert call("p", [("a", lambda p: "x")])[:3] == ("failed", "bad_json", 3)
    assert call("p", [("a", lambda p: "x")])[5] == "x", "the raw reply is kept"
    assert call("p", [("a", lambda p: "[]")])[1] == "bad_shape"
    mixed = iter(["nope", "nope", OSError("down")])

    def failing(p):
        got = next(mixed)
        if isinstance(got, Exception):
            raise got
        return got

    assert call("p", [("a", failing), ("b", lambda p: "nope")])[:4] == ("failed", "bad_json", 4, "b"), "retries are shared"
    assert not stub_answer("zebra", '[{"content": "apple"}]')["enough_context"]


def test_settings_and_registry(spark):
    spark.conf.set("claimweave.search_limit", "7")
    assert M.Settings.of(spark).search_limit == 7 and M.Settings.of(spark).distance == 0.35
    spark.conf.unset("claimweave.search_limit")
    chosen = M.overridden((M.ModelSettings("a", "x"),), {"a": {"model": "y"}})
    assert chosen[0].model == "y"
    with pytest.raises(ValueError):
        M.overridden(chosen, {"b": {}})
    with pytest.raises(ValueError):
        M.Registry().client(chosen[0])
    rows = spark.createDataFrame([("hello",)], "prompt string")
    make = M.Registry().add("a", lambda settings: lambda p: json.dumps({"m": settings.model, "p": p})).maker(chosen)
    assert json.loads(M.extract(rows, "prompt", make).first().reply) == {"m": "y", "p": "hello"}


def test_vector_table(spark):
    rows = [(str(i), json.dumps({"price": i, "kind": "a" if i % 2 else "b"}), [float(i), 1.0]) for i in range(6)] + [("z", "{}", [0.0, 0.0])]
    t = spark.createDataFrame(rows, "id string, metadata string, embedding array<float>")
    assert V.search(t.where("id = 'z'"), [1.0, 0.0]).first().distance == 1.0
    found = V.search(t, [0.0, 1.0], 3, predicates=Predicate("price", ">", 1) & (Predicate("kind", "==", "a") | Predicate("price", "==", 4)))
    assert [r.id for r in found.collect()] == ["3", "4", "5"]
    for wrong in ({}, {"ids": []}, {"ids": ["1"], "delete_all": True}):
        with pytest.raises(ValueError):
            V.delete(t, **wrong)
    assert V.delete(t, metadata_filter={"kind": "a"}).count() == 4, "rows without the key stay"


def test_leader_clusters_equal_the_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    labels, n = [-1] * 60, 0
    d = 1 - x @ x.T
    for i in range(60):
        if labels[i] < 0:
            labels[i] = n
            for j in range(i + 1, 60):
                if labels[j] < 0 and d[i, j] <= 0.3:
                    labels[j] = n
            n += 1
    assert {r.id: r.label for r in P.leader_clusters(df, 0.3).collect()} == dict(enumerate(labels))


def test_hdbscan():
    x = np.array([[0.0], [0.1], [0.2], [5.0], [5.1], [5.2], [50.0]])
    labels = P.hdbscan_labels(np.abs(x - x.T))
    assert len(set(labels[:3])) == 1 and len(set(labels[3:6])) == 1 and labels[0] != labels[3]


def test_hdbscan_of_a_table(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (12, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])] + [rng.normal(size=(6, 3))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = P.hdbscan_labels(np.clip(1 - u @ u.T, 0, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = [r.label for r in D.hdbscan_all(df).orderBy("id").collect()]
    assert len(got) == len(x) and len(set(zip(got, want.tolist(), strict=True))) == len(set(got)) == len(set(want.tolist())), "the same clusters"
    assert D.hdbscan_all(df.limit(1)).collect()[0].label == -1


def test_spanning_trees_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(12, 3)))], "id long, embedding array<double>")
    one = sorted(map(tuple, P.spanning_tree(df).collect()))
    monkeypatch.setattr(P, "ONE_TASK", 0)
    assert one == sorted(map(tuple, P.spanning_tree(df).collect())) and len(one) == 11


def test_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 7)
    rng = np.random.default_rng(2)
    x = np.append(rng.normal(size=(40, 5)), np.zeros((1, 5)), axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = 1 - u @ u.T
    want = {(i, j) for i in range(41) for j in range(i + 1, 41) if d[i, j] <= 0.6}
    assert {(r.i, r.j) for r in P.close_pairs(df, 0.6).collect()} == want
    near = {}
    for r in G.graph_edges(df, 3, 0.1).collect():
        near.setdefault(r.src, []).append(r.dst)
    for i in range(41):
        best = sorted((j for j in range(41) if j != i and round(1 - d[i, j], 9) >= 0.1), key=lambda j: (-round(1 - d[i, j], 9), j))[:3]
        assert sorted(near.get(i, [])) == sorted(best)


def test_inverted_file_is_stored(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = V.InvertedFile.create(t, str(tmp_path / "index"))
    again = V.InvertedFile(spark, str(tmp_path / "index"))
    q = list(t.where("id = 1").first().embedding)
    found = again.search(q, 10, probes=4)
    assert "list_id" in found._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters")[2][:80]
    assert [r.id for r in again.search(q, 10, probes=16).collect()] == [r.id for r in V.search(t, q, 10).collect()]
    index.drop()
    assert not (tmp_path / "index").exists()


def test_filters_reach_the_scan(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", "embedding", F.lit("{}").alias("metadata"))
    plan = V.search(t, [1.0] * 64, 5, metadata_filter={"label": 3})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3" in plan.partition("PushedFilters")[2]
    stamps = spark.range(60).select(F.timestamp_seconds(F.lit(1_725_000_000) + F.col("id") * 86400).alias("ts"), "id")
    from claimweave.functions.time_ids import uuid_of_time

    rows = stamps.select(uuid_of_time(F.col("ts"), F.col("id")).alias("id"), F.lit("{}").alias("metadata"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    stored = V.store(rows, str(tmp_path / "t"))
    september = V.filtered(stored, time_range=("2024-09-01", "2024-09-30"), end_inclusive=True)
    assert september.count() == V.filtered(rows, time_range=("2024-09-01", "2024-09-30"), end_inclusive=True).count() == 29
    assert "week" in september._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters")[2][:120]
    assert V.filtered(stored, time_range=("2024-08-01", "2024-08-28")).count() == 0


def test_upsert_of_repeated_ids(spark):
    t = spark.createDataFrame([("a", "old", 1)], "id string, contents string, v int")
    new = spark.createDataFrame([("a", "x", 5), ("a", "y", 3), ("b", "z", 1)], "id string, contents string, v int")
    assert sorted(map(tuple, V.upsert(t, new, order="v").collect())) == [("a", "x", 5), ("b", "z", 1)]
    assert sorted(map(tuple, V.upsert(t, new, on_conflict="ignore").collect())) == [("a", "old", 1), ("b", "z", 1)]
    assert all(V.upsert(t, new.repartition(n)).where("id = 'a'").first().contents == "y" for n in (1, 3))


def test_metadata_keys(spark):
    t = spark.createDataFrame([("1", '{"a": 1}'), ("2", '{"b": "x", "a": null}'), ("3", None)], "id string, metadata string")
    assert V.metadata_keys(t) == ["a", "b"]
    assert [tuple(r) for r in V.results_frame(t).orderBy("id").collect()] == [("1", "1", None), ("2", None, "x"), ("3", None, None)]


def test_vector_table_is_created_once(spark, tmp_path):
    for _ in range(2):
        V.create_table(spark, "claim_vectors", str(tmp_path / "v"))
    assert spark.table("claim_vectors").columns == ["id", "metadata", "contents", "embedding", "norm", "id_time", "week"]
    spark.sql("DROP TABLE claim_vectors")


def test_embedding_and_answer(spark):
    rows = spark.createDataFrame([(1, "red apple\npie"), (2, "blue sky"), (3, None)], "id long, contents string")
    t = M.embed(rows, "contents")
    found = V.search_text(t, "red apple pie", M.hash_embedding, 2)
    assert found.first().id == 1 and found.first().distance == pytest.approx(0, abs=1e-6)
    got = M.answer(found.withColumn("category", F.lit("c")), "which red apple", ["distance", "id"]).first()
    assert got.enough_context and got.answer.startswith("red apple") and json.loads(got.context)[0]["category"] == "c"


def lines(path, *objects):
    path.write_text("\n".join(map(json.dumps, objects)))


def test_ingest_down_up_and_new_checkpoints(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    lines(source / "a.json", *({"title": "t", "link": f"l{i % 3}", "text": "Some words."} for i in range(4)))

    def broken(prompt):
        raise OSError("down")

    down, up = (lambda: [("a", broken)]), (lambda: [("a", M.stub_extractor)])
    start = lambda check, make: ingest.start_ingest(spark, str(source), out, str(tmp_path / check), make=make).awaitTermination()
    count = lambda: ingest.extracted(spark, out).count()
    start("one", down)
    assert count() == 0 and ingest.failed_articles(spark, out).count() == 3
    assert ingest.failed_articles(spark, out).first().error == "api: down"
    start("one", up)
    assert count() == 3 and ingest.failed_articles(spark, out).count() == 0, "the next start takes up what failed"
    start("two", up)
    assert count() == 3, "a new checkpoint reads the files again and finds all of it seen"
    lines(source / "b.json", {"title": "t", "link": "new", "text": "x."}, {"title": "t", "link": "l1", "text": "x."})
    start("one", up)
    assert count() == 4 and ingest.seen_links(spark, out).count() == 4
    before = ingest.results(spark, out).count()
    start("one", up)
    assert ingest.results(spark, out).count() == before


def test_shutdown_command(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.json", {"title": "t", "link": "l", "text": "x."})
    query = ingest.start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), available_now=False, poll="1 second")
    assert not ingest.command(query, "OTHER") and query.isActive
    assert ingest.command(query, "SHUTDOWN") and not query.isActive
    assert ingest.extracted(spark, str(tmp_path / "out")).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "faq.csv").write_text('question;answer;category\nWhat is "x" here?;It is "y;Shipping\n"Q;2";A2;Other\n')
    assert [tuple(r) for r in readers.read_faq(spark, str(tmp_path / "faq.csv")).collect()] == [('What is "x" here?', 'It is "y', "Shipping"), ("Q;2", "A2", "Other")]
    item = "<item><title>A &amp;amp; B</title><link>http://x</link><description>d</description><content:encoded><![CDATA[<p>one</p><p><a>ad</a></p>]]></content:encoded></item>"
    (tmp_path / "feed.xml").write_text(f'<rss xmlns:content="http://c"><channel>{item}</channel></rss>')
    got = readers.read_feed(spark, str(tmp_path / "feed.xml")).first()
    assert tuple(got) == ("A & B", "http://x", "d", "one ")
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "n1.json").write_text(json.dumps({"title": "t", "link": "l", "text": "x"}, indent=2))
    (tmp_path / "art" / "n2.JSON").write_text("{}")
    assert [r.filename for r in readers.read_articles(spark, str(tmp_path / "art")).collect()] == ["n1"]
    (tmp_path / "lines.txt").write_text("a\n\n  \n b \na\n")
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a", " b ", "a"]
    assert sorted(r.link for r in readers.read_links(spark, str(tmp_path / "lines.txt")).collect()) == ["a", "b"]
    assert readers.read_whole_text(spark, str(tmp_path / "lines.txt")) == "a\n\n  \n b \na\n"
    assert readers.read_seen(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "claims.json").write_text(json.dumps({"claim_texts": ["x", "y"], "claim_categories": ["c"]}, indent=1))
    assert [tuple(r) for r in readers.read_claim_texts(spark, str(tmp_path / "claims.json")).collect()] == [(0, "x", ["c"]), (1, "y", ["c"])]


def test_fetched_pages(spark):
    def make():
        def fetch(url):
            if url == "bad":
                raise OSError("gone")
            return "<h1>t</h1><div class='article-body'><p>x</p></div>" if url == "good" else "<p>no title</p>"

        return fetch

    links = spark.createDataFrame([("good",), ("bad",), ("odd",)], "link string")
    got = readers.articles_of_pages(readers.fetch_pages(links, make), link="link", fetch_error="fetch_error").collect()
    assert [(r.ok, r.text, r.error, r.page) for r in got] == [(True, "x", None, None), (False, None, "fetch: gone", None), (False, None, "no_title", "<p>no title</p>")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", "t", "l", "x y", 1), ("b.json", "u", "m", "z", 2)], "filename string, title string, link string, text string, uid long")
    named = writers.with_file_name(rows.drop("filename"))
    assert all(r.filename.endswith(".json") and "__" in r.filename for r in named.collect())
    writers.write_json_files(rows, str(tmp_path / "files"))
    assert json.loads((next((tmp_path / "files" / "filename=a.json").glob("*.txt"))).read_text())["title"] == "t"
    writers.write_collections({"rows": rows}, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/rows")).count() == 2
    writers.write_named_collections({"rows": rows.withColumnRenamed("title", "name")}, str(tmp_path / "n"))
    assert sorted(r.name for r in spark.read.json(str(tmp_path / "n/rows_names")).collect()) == ["t", "u"]
    writers.write_articles(rows.select("title", "link", "text"), str(tmp_path / "art"))
    assert spark.read.text(str(tmp_path / "art/txt"), wholetext=False).count() == 8 and spark.read.json(str(tmp_path / "art/json")).count() == 2
    asked = spark.createDataFrame([("ask", "say"), ("more", None)], "prompt string, reply string")
    assert [r.value for r in writers.prompt_dump(asked).collect()] == ["PROMPT:\nask\n\nRESPONSE:\nsay", "PROMPT:\nmore\n\nRESPONSE:\n"]
    seen = spark.createDataFrame([("l",), ("k",)], "link string")
    writers.save_seen(seen, rows, str(tmp_path / "seen"))
    assert sorted(r.link for r in readers.read_seen(spark, str(tmp_path / "seen")).collect()) == ["k", "l", "m"]
    done = spark.createDataFrame([("l", "ok", None, None), ("m", "failed", "bad_json", "raw text")], "link string, status string, error string, raw string")
    assert [tuple(r) for r in writers.failures(done).collect()] == [("m", "bad_json", "raw text")]
    watched, seen = writers.observed(done)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "failed": 1}
    writers.by_article_and_model(spark.createDataFrame([("a", "m", "r")], "article string, model string, reply string"), str(tmp_path / "sweep"))
    assert (tmp_path / "sweep" / "article=a" / "model=m").is_dir()
    assert writers.result_lines(spark.createDataFrame([(0.25, "x")], "distance double, contents string")).first().line == "0.2500  x"


def test_tables_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "a int")
    for _ in range(2):
        load_tables({"claims": rows}, "t_")
    assert spark.table("t_claims").count() == 1
    spark.sql("DROP TABLE t_claims")


def test_shared_folder(spark):
    t = tables.written(spark.range(5).toDF("id"))
    assert t.count() == 5 and tables.fresh_path(spark).startswith(tables.shared_folder(spark))
