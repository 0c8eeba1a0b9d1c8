import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sectionweave.operators import columns, encode, generate, lookup
from sectionweave.operators.lookup import translate_arrays
from sectionweave.plans import evaluate
from sectionweave.sources.documents import vocabulary

PAIRS = [("a", "red blue  red", "blue"), ("b", "red green blue red blue", "red red red"), ("c", " ", ""),
         ("d", "unseen red", "red blue unseen")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "key string, text string, summary string")


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("red", 2), ("blue", 3), ("green", 4)], "token string, id int")


def rows(df):
    return {r.key: tuple(r[1:]) for r in df.collect()}


# Both ways to look words up must agree: broadcast, and join for a large table.
@pytest.mark.parametrize("limit", [10, 0])
def test_encode(pairs, vocab, limit):
    padded = encode.encode_pairs(pairs, vocab, 4, 2, pad=0, unk=1, keys=("key",), max_entries=limit)
    assert rows(padded) == {
        "a": ([2, 3, 2, 0], [1, 1, 1, 0], [3, -100]), "b": ([2, 4, 3, 2], [1, 1, 1, 1], [2, 2]),
        "c": ([0, 0, 0, 0], [0, 0, 0, 0], [-100, -100]), "d": ([1, 2, 0, 0], [1, 1, 0, 0], [2, 3])}
    kept = encode.encode_pairs(pairs, vocab, 4, 2, pad=0, ignore_pad=False, keys=("key",), max_entries=limit)
    assert rows(kept)["a"][2] == [3, 0]
    loose = encode.encode_pairs(pairs, vocab, 4, 2, unk=1, prefix="sum: ", keys=("key",), max_entries=limit)
    assert rows(loose)["a"] == ([1, 2, 3, 2], [1, 1, 1, 1], [3])
    assert rows(loose)["c"] == ([1], [1], [])
    assert padded.columns == ["key", "input_ids", "attention_mask", "labels"]


@pytest.mark.parametrize("limit", [10, 0])
def test_lookup_of_nulls_and_empty_arrays(spark, vocab, limit):
    df = spark.createDataFrame([("a", ["red", None, "x"]), ("b", []), ("c", None), ("d", ["red", None, "x"])],
                               "key string, words array<string>")
    got = rows(translate_arrays(df.repartition(3), ("words",), vocab, "token", "id", 7, limit))
    assert got == {"a": ([2, 7, 7],), "b": ([],), "c": (None,), "d": ([2, 7, 7],)}


@pytest.mark.parametrize("limit", [10, 0])
def test_decode_skips_padding_and_special_ids(pairs, vocab, limit):
    encoded = encode.encode_pairs(pairs, vocab, 4, 3, pad=0, unk=1, keys=("key",))
    back = encode.decode(encoded, vocab, 0, special=(1,), max_entries=limit).select("key", "text")
    assert rows(back) == {"a": ("blue",), "b": ("red red red",), "c": ("",), "d": ("red blue",)}
    assert encode.generated_length(encoded, 0).first().gen_len == 2.25


@pytest.mark.parametrize("limit", [10, 0])
def test_lookup_has_one_meaning_both_ways(spark, limit):
    table = spark.createDataFrame([("a", 9), ("a", 2), (None, 5), ("b", 3)], "token string, id long")
    df = spark.createDataFrame([("x", ["a", None, "b"]), ("y", ["a"])], "key string, words array<string>")
    assert rows(translate_arrays(df, ("words",), table, "token", "id", 0, limit)) == {"x": ([2, 0, 3],), "y": ([2],)}
    back = spark.createDataFrame([(3_000_000_000, "far"), (1, "near"), (1, "also")], "id long, token string")
    ids = spark.createDataFrame([("x", [1, 7, None])], "key string, words array<int>")
    assert rows(translate_arrays(ids, ("words",), back, "id", "token", "?", limit)) == {"x": (["also", "?", "?"],)}


def test_the_index_of_a_worker_takes_few_bytes_an_entry():
    n = 200_000
    index = lookup.build_index(pa.array([f"word{i}" for i in range(n)]), pa.array(range(n), pa.int32()))
    tracemalloc.start()
    try:
        found = lookup.look_up(index, pa.array(["word7", None, "", "none", f"word{n - 1}", "word7"]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.to_pylist() == [7, None, None, None, n - 1, 7]
    assert most < n and index.hashes.nbytes + index.keys.nbytes + index.values.nbytes < 32 * n


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(lookup, "_hashes", lambda items: np.array([len(s.as_py() or "") for s in items], "u8"))
    index = lookup.build_index(pa.array(["ab", "c", "cd", "ef", "g"]), pa.array([1, 2, 3, 4, 5]))
    assert index.longest_run == 3
    assert lookup.look_up(index, pa.array(["ef", "g", "xy", "cd", None, "c", "ab", "abc"])).to_pylist() == [4, 5, None, 3, None, 2, 1, None]
    empty = lookup.build_index(pa.array([], pa.string()), pa.array([], pa.int32()))
    assert lookup.look_up(empty, pa.array(["a", None])).to_pylist() == [None, None]


def test_caller_tokenizer_gets_the_length_and_is_loaded_once_per_worker(spark, pairs, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts, longest: [[*[len(w) for w in t.split()][:longest - 1], 9] for t in texts]

    def load_target():
        return lambda texts, longest: [[7] * min(longest, len(t.split())) for t in texts]

    got = rows(encode.encode_with(pairs.repartition(8), load, 3, 2, pad=0, keys=("key",), target_tokenizer=load_target))
    assert got["b"] == ([3, 5, 9], [1, 1, 1], [7, 7]) and got["c"] == ([9, 0, 0], [1, 0, 0], [-100, -100])
    loads = [name.name.split("-")[0] for name in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))


def test_vocabulary_numbers_are_dense(spark):
    texts = spark.createDataFrame([(" ".join(f"w{i % 700}" for i in range(3000)),)], "text string")
    ids = [r.id for r in vocabulary(texts.repartition(3), "text").collect()]
    assert sorted(ids) == list(range(2, 702))


def test_column_resolution():
    assert columns.resolve_columns(["a", "b", "c"]) == ("a", "b")
    assert columns.resolve_columns(["a", "b", "c"], text="c") == ("c", "b")
    assert columns.resolve_columns(["document", "summary"], dataset="xsum") == ("document", "summary")
    assert columns.resolve_columns(["a", "b"], dataset="unknown") == ("a", "b")
    for bad in ({"text": "z"}, {"summary": "z"}, {"dataset": "xsum"}):
        with pytest.raises(ValueError):
            columns.resolve_columns(["a", "b"], **bad)
    with pytest.raises(ValueError):
        columns.resolve_columns(["a"])


def test_language_resolution(spark):
    assert columns.resolve_languages("translation_en_to_ro") == ("en", "ro")
    assert columns.resolve_languages("translation", "en_XX", "ro_RO") == ("en", "ro")
    assert columns.resolve_languages("translation_en_to_ro", target="de_DE") == ("en", "de")
    with pytest.raises(ValueError):
        columns.resolve_languages("translation", "en")
    df = spark.createDataFrame([({"en": "x", "ro": "y"},)], "translation map<string,string>")
    assert tuple(columns.translation_pairs(df, "translation_ro_to_en").first()) == ("y", "x")


def test_head_and_counts(spark):
    df = spark.range(20).withColumn("split", F.when(F.col("id") < 15, "train").otherwise("test")).repartition(4)
    assert [r.id for r in columns.head(df, 3, "id").collect()] == [0, 1, 2]
    assert columns.head(df, None, "id").count() == 20
    assert columns.head(df, 0, "id").count() == 0 and columns.head(df, 50, "id").count() == 20
    counts = columns.sample_counts(df, 10, by=("split",)).collect()
    assert sorted(map(tuple, counts)) == [("test", 5), ("train", 10)]
    assert columns.sample_counts(df).first().samples == 20


def test_generation_batches_and_keeps_the_row(spark):
    def load():
        def summarize(texts):
            assert 0 < len(texts) <= 3
            return [f"{len(texts)}:{t}" for t in texts]
        return summarize

    df = spark.createDataFrame([(str(i), None if i == 4 else f"t{i}", [i]) for i in range(8)],
                               "article_id string, document string, extra array<int>").coalesce(1)
    out = {r.article_id: r for r in generate.generate(df, load, batch_size=3).collect()}
    assert out["0"].gen_sum == "3:t0" and out["7"].gen_sum == "1:t7" and out["4"].gen_sum is None
    assert out["5"].extra == [5]

    def short():
        return lambda texts: []

    with pytest.raises(Exception, match="returned 0 texts"):
        generate.generate(df, short).collect()


def test_only_the_text_goes_to_the_model(spark):
    rows = spark.createDataFrame([(1, "a b", "unused"), (2, None, "unused")], "k int, document string, target string")
    made = generate.generate(rows, lambda: lambda texts: [t.upper() for t in texts])
    assert [tuple(r) for r in made.orderBy("k").collect()] == [(1, "a b", "unused", "A B"), (2, None, "unused", None)]
    plan = made.select("k", "gen_sum")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "[run(document#" in plan
    assert "Project [k#" in plan and "target" not in plan.rsplit("LogicalRDD", 1)[0]


def test_compute_metrics(spark, vocab):
    df = spark.createDataFrame([("1", [2, 3, 4, 0], [2, 3, 4, -100]), ("2", [2, 2, 2, 2], [3, 3, -100, -100])],
                               "article_id string, pred_ids array<int>, labels array<int>")
    got = dict(map(tuple, evaluate.compute_metrics(df, vocab, 0).collect()))
    assert set(got) == {"rouge1", "rouge2", "rougeL", "rougeLsum", "gen_len"}
    assert got["gen_len"] == 3.5 and 0 <= got["rouge1"] <= 100
    got = dict(map(tuple, evaluate.compute_metrics(df, vocab, 0, "translation_en_to_ro").collect()))
    assert set(got) == {"bleu", "gen_len"}
