import json

import pytest

from sectionweave.plans import prepare
from sectionweave.session import scratch_path
from sectionweave.sources import readers, writers


def write(path, *records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def article(i, words=60):
    return {"article_id": i, "abstract_text": ["<S> " + "x " * words + "</S>"], "section_names": ["Methods"],
            "sections": [["x " * words]], "labels": None, "other": {"ignored": 1}}


def test_splits_prepared_written_and_read_back(spark, tmp_path):
    write(tmp_path / "train.txt", article("1"), article("2", 10))
    write(tmp_path / "val.txt", article("3", 55))
    write(tmp_path / "test.txt", article("4"))
    whole = readers.read_splits(spark, str(tmp_path))
    rows = prepare.prepare_section_rows(whole)
    writers.write_splits(rows, str(tmp_path), "pubs")
    got = {s: [r.article_id for r in readers.read_rows(spark, f"{tmp_path}/processed/pubs/{s}").collect()]
           for s in ("train", "val", "test")}
    assert got == {"train": ["1"], "val": ["3"], "test": ["4"]}
    assert [f.name for f in readers.read_rows(spark, f"{tmp_path}/processed/pubs/val").schema][:3] == [
        "article_id", "section_idx", "section_id"]


def test_malformed_article_fails(spark, tmp_path):
    path = write(tmp_path / "a.txt", article("1"), "{broken")
    with pytest.raises(Exception):
        readers.read_articles(spark, path).collect()


def test_co_location(spark, tmp_path):
    path = write(tmp_path / "a.txt", *(article(str(i)) for i in range(6)))
    assert readers.read_articles(spark, path, partitions=3).rdd.getNumPartitions() == 3


def test_json_pairs_keep_file_order(spark, tmp_path):
    path = write(tmp_path / "a.json", {"z": "text", "a": "sum"}, {"z": "t2", "a": "s2"})
    assert sorted(map(tuple, readers.read_pairs(spark, path).collect())) == [("t2", "s2"), ("text", "sum")]
    assert tuple(readers.read_pairs(spark, path, text_col="a", summary_col="z").where("text = 'sum'").first()) == ("sum", "text")


def test_json_fields_come_from_all_records(spark, tmp_path):
    path = write(tmp_path / "a.json", {"text": "x"}, {"text": "y", "summary": "s"})
    assert sorted(map(tuple, readers.read_pairs(spark, path).collect()), key=str) == [("x", None), ("y", "s")]
    both = readers.read_pair_splits(spark, {"train": path, "test": path}, text_col="text", summary_col="summary")
    assert sorted((r.split, r.text) for r in both.collect()) == [("test", "x"), ("test", "y"), ("train", "x"), ("train", "y")]


@pytest.mark.parametrize("read", [readers.read_rows, lambda s, p: readers.read_file(s, p, columns=["article_id"])])
def test_malformed_records_fail(spark, tmp_path, read):
    path = write(tmp_path / "a.json", {"article_id": "1"}, "{broken")
    with pytest.raises(Exception):
        read(spark, path).collect()


def test_csv_pairs_with_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "a.csv", "document,summary", '"one\ntwo, ""three""",short')
    assert tuple(readers.read_pairs(spark, path).first()) == ('one\ntwo, "three"', "short")


def test_format_check():
    assert readers.file_format("/x/y.json") == "json"
    with pytest.raises(ValueError):
        readers.file_format("/x/y.parquet")


def test_translations(spark, tmp_path):
    path = write(tmp_path / "a.json", {"translation": {"en": "x", "ro": "y"}})
    assert readers.read_translations(spark, path).first().translation == {"en": "x", "ro": "y"}


def test_named_dataset_and_split(spark, tmp_path):
    path = str(tmp_path / "set")
    spark.createDataFrame([("train", 1), ("test", 2)], "split string, x int").write.parquet(path)
    assert readers.load_split(spark, "mine", "test", {"mine": path}).first().x == 2
    with pytest.raises(ValueError, match="validation"):
        readers.load_split(spark, "mine", "validation", {"mine": path})


def test_text_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("2", "a\nb", " c<n>d\n"), ("1", "x", "y")], "article_id string, target_sum string, gen_sum string")
    writers.write_pairs(pairs, f"{tmp_path}/pairs")
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/pairs").select("article_id", "target_sum", "gen_sum").collect())) == [
        ("1", "x", "y"), ("2", "a b", " cd ")]
    writers.write_predictions(pairs, f"{tmp_path}/preds", order_by="article_id")
    files = sorted((tmp_path / "preds").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == ["y", "c<n>d"]
    writers.write_pairs(pairs, f"{tmp_path}/ordered", order_by=["article_id"])
    lines = "".join(f.read_text() for f in sorted((tmp_path / "ordered").glob("part-*"))).splitlines()
    assert [json.loads(line)["article_id"] for line in lines] == ["1", "2"]
    ci = spark.createDataFrame([("rouge1", "fmeasure", 0.5, 0.4, 0.6)], "metric string, statistic string, value double, lo double, hi double")
    writers.write_report(ci, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()][1:] == [
        "ROUGE-1:", "rouge_1_f_score: 0.5000 with confidence interval (0.4000, 0.6000)"]


def test_scratch_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path, other = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert path != other
    assert not root or path.startswith(f"{root.rstrip('/')}/x-")
