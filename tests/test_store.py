import json
import os

import pytest
from pyspark.sql import functions as F

from sectionweave.operators import columns, generate
from sectionweave.schemas import ARTICLE
from sectionweave.sources import store

GOOD = [{"article_id": str(i), "abstract_text": ["a"] * (i % 3), "section_names": ["Methods"], "sections": [["x", "y"]]} for i in range(40)]
BROKEN = ['{"article_id": "7", "abstract_text": ["a"', "no json", '{"article_id": "8", "sections": "text"}', "[1, 2]", '"text"', "5"]


def lines_of(folder, rows):
    for part in range(3):
        with open(f"{folder}/part{part}.txt", "w") as out:
            out.write("\n".join([*rows[part::3], "", "   "]) + "\n")
    return str(folder)


@pytest.fixture()
def mixed(tmp_path):
    (tmp_path / "in").mkdir()
    return lines_of(tmp_path / "in", [json.dumps(g) for g in GOOD] + BROKEN)


def test_broken_lines_are_put_aside_and_counted(spark, mixed, tmp_path):
    found = store.ingest_articles(spark, mixed, f"{tmp_path}/store", max_broken=len(BROKEN))
    assert (found.n_rows, found.n_broken) == (len(GOOD), len(BROKEN))
    assert sorted(r.line for r in found.broken.collect()) == sorted(BROKEN)
    assert {os.path.basename(r.file) for r in found.broken.collect()} <= {"part0.txt", "part1.txt", "part2.txt"}
    rows = {r.article_id: r.asDict() for r in found.rows.collect()}
    assert found.rows.columns == ARTICLE.names and rows == {g["article_id"]: g for g in GOOD}


def test_too_many_broken_lines_fail_the_job(spark, mixed, tmp_path):
    with pytest.raises(ValueError, match="6 broken lines, more than 5"):
        store.ingest_articles(spark, mixed, f"{tmp_path}/store", max_broken=5)
    assert spark.read.parquet(f"{tmp_path}/store").where("broken = 'true'").count() == len(BROKEN)


def test_nothing_broken_and_nothing_at_all(spark, tmp_path):
    for name, rows, wanted in (("good", [json.dumps(GOOD[0])], (1, 0)), ("empty", [], (0, 0))):
        (tmp_path / name).mkdir()
        found = store.ingest_articles(spark, lines_of(tmp_path / name, rows), f"{tmp_path}/{name}_store", max_broken=0)
        assert (found.n_rows, found.n_broken) == wanted == (found.rows.count(), found.broken.count())


def test_one_scan_writes_and_readers_prune(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", ["train", "val", None][i % 3]) for i in range(30)], "id long, text string, split string")
    for _ in range(2):  # the second time replaces the first
        store.write_split_store(rows, f"{tmp_path}/splits", "test_split_store")
    try:
        assert store.split_names(spark, "test_split_store") == ["train", "val"]
        part = store.read_split(spark, "test_split_store", "val")
        assert sorted(r.id for r in part.collect()) == list(range(1, 30, 3))
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(split" in plan and " = val)" in plan
        assert spark.table("test_split_store").count() == 30
        with pytest.raises(ValueError, match="no 'test' split, only train, val"):
            store.read_split(spark, "test_split_store", "test")
    finally:
        spark.sql("DROP TABLE test_split_store")


def loader(calls, fails):
    """A model that notes every text it is asked for, and fails at those that hold ``fails`` as long as the folder has no file ``mended``."""
    def load():
        def summarize(texts):
            for text in texts:
                if fails in text and not os.path.exists(f"{calls}/mended"):
                    raise ValueError("model failed")
                with open(f"{calls}/asked", "a") as out:
                    out.write(text + "\n")
            return [t.upper() for t in texts]
        return summarize
    return load


def test_a_run_that_broke_off_asks_for_missing_rows_only(spark, tmp_path):
    calls, kept = tmp_path / "calls", f"{tmp_path}/kept"
    calls.mkdir()
    texts = [f"text {i}" for i in range(60)] + ["text 3", "text 3", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, document string").repartition(4)
    last = F.pmod(F.xxhash64(F.sha2("document", 256)), F.lit(8)) == 7
    model = loader(str(calls), rows.where(last).first().document)  # in the last batch
    with pytest.raises(Exception, match="model failed"):
        generate.generate_resumable(rows, model, kept, n_batches=8)
    first = {r.made for r in spark.read.schema(generate.KEPT).parquet(kept).collect()} if os.path.isdir(kept) else set()
    asked = (calls / "asked").read_text().split("\n")[:-1]
    (calls / "asked").unlink()
    (calls / "mended").touch()
    found = {r.id: r.gen_sum for r in generate.generate_resumable(rows, model, kept, n_batches=8).collect()}
    assert found == {i: t and t.upper() for i, t in enumerate(texts)}
    again = (calls / "asked").read_text().split("\n")[:-1]
    assert 0 < len(first) < 60 and first <= {t.upper() for t in asked}
    assert sorted(again) == sorted({t for t in texts if t} - {t for t in texts if t and t.upper() in first})
    (calls / "asked").unlink()
    assert generate.generate_missing(rows, model, kept) == 0 and not (calls / "asked").exists()
    assert generate.generate_resumable(rows.limit(0), model, kept).count() == 0


def test_head_in_a_direction_of_its_own(spark):
    df = spark.createDataFrame([(i, i % 4, None if i % 5 == 0 else i) for i in range(30)], "id long, k long, v long").repartition(3)
    assert [r.id for r in columns.head(df, 4, F.col("id").desc()).collect()] == [29, 28, 27, 26]
    assert [r.id for r in columns.head(df, 3, ["k", F.desc("id")]).collect()] == [28, 24, 20]
    assert [r.id for r in columns.head(df, 2, F.col("v").asc_nulls_last()).collect()] == [1, 2]
    assert columns.head(df, 5, F.desc_nulls_first("v")).where("v IS NULL").count() == 5
