"""The vector table changed in place, against the same changes of a dictionary; which files a change writes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimweave.functions.time_ids import uuid_of_time
from claimweave.operators import vector_table as V
from claimweave.operators.stored_table import StoredTable


def stamped(spark, numbers, label="old"):
    """Rows whose ids are of four weeks."""
    rows = spark.createDataFrame([(n, label) for n in numbers], "n long, label string")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("n", F.lit(4)) * 7 * 86400)
    return rows.select(uuid_of_time(at, F.col("n")).alias("id"), F.to_json(F.struct("label", "n")).alias("metadata"), F.col("label").alias("contents"), F.array(F.col("n").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


def files(kept):
    return {str(p.relative_to(kept.path)) for p in Path(kept.path).glob("rows/week=*/bucket=*/*.parquet")}


def folders(names):
    return {n.rpartition("/")[0] for n in names}


def now(kept):
    return {r.id: r.contents for r in kept.rows.select("id", "contents").collect()}


def of(df):
    return {r.id: r.contents for r in df.select("id", "contents").collect()}


def test_changes_write_their_folders_only(spark):
    kept = StoredTable.create(stamped(spark, range(200)), buckets=4)
    want, before = of(stamped(spark, range(200))), files(kept)
    assert now(kept) == want and len(folders(before)) == 16
    new = stamped(spark, [7, 500], "new")
    for _ in range(2):  # a second run changes nothing
        kept.upsert(new)
        assert now(kept) == want | of(new)
    after = files(kept)
    assert 0 < len(folders(before - after)) <= 2 and folders(after - before) == folders(before - after), "the others keep their files"
    kept.upsert(stamped(spark, [8, 501], "newer"), on_conflict="ignore")
    want |= of(new) | of(stamped(spark, [501], "newer"))
    assert now(kept) == want
    before = files(kept)
    gone = of(stamped(spark, [3]))
    kept.delete(list(gone))
    want = {i: x for i, x in want.items() if i not in gone}
    assert now(kept) == want and len(folders(before - files(kept))) == 1
    kept.delete(metadata_filter={"label": "newer"})
    assert now(kept) == {i: x for i, x in want.items() if x != "newer"}
    again = StoredTable(spark, kept.path)  # as another session finds it
    assert again.rows.count() == 200 and again.rows.columns == kept.rows.columns
    found = V.search(again.rows, [7.0, 1.0], 3, time_range=("2023-11-14", "2023-11-17"))
    assert found.count() == 3 and "week" in found.columns


def test_a_folder_without_rows_goes(spark):
    kept = StoredTable.create(stamped(spark, range(8)), buckets=1)
    kept.delete(stamped(spark, [1, 5, 999]).select("id"))
    assert now(kept) == of(stamped(spark, [0, 2, 3, 4, 6, 7])) and len(folders(files(kept))) == 3
    kept.upsert(stamped(spark, [5], "back"))
    assert now(kept) == of(stamped(spark, [0, 2, 3, 4, 6, 7])) | of(stamped(spark, [5], "back"))
    kept.delete(delete_all=True)
    assert now(kept) == {} and not files(kept)
    kept.upsert(stamped(spark, [2]))
    assert len(now(kept)) == 1
    kept.drop()
    assert not Path(kept.path).exists()


def test_odd_rows_and_criteria(spark):
    """Ids without a time are of week -1; rows without an id stay, as nothing can mean them; several rows of one id count as one."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, contents string")
    kept = StoredTable.create(rows, buckets=2)
    kept.upsert(spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id int, contents string"))
    assert sorted(r.contents for r in kept.rows.collect()) == ["b", "c", "y", "z"]
    kept.delete(spark.createDataFrame([(2,), (None,)], "id int"))
    assert sorted(r.contents for r in kept.rows.collect()) == ["c", "y", "z"]
    assert {r.week for r in kept.rows.collect()} == {-1}
    for wrong in ({}, {"ids": []}, {"ids": [1], "delete_all": True}):
        with pytest.raises(ValueError, match="exactly one"):
            kept.delete(**wrong)
    with pytest.raises(ValueError, match="update or ignore"):
        kept.upsert(rows, on_conflict="other")
    assert StoredTable.create(rows.limit(0)).upsert(rows.limit(2)).rows.count() == 2
