import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from sectionweave.functions import lcs
from sectionweave.operators import aggregate, assemble, bleu, rouge
from sectionweave.plans import evaluate
from sectionweave.sources import writers

SCHEMA = "article_id string, target_sum string, gen_sum string"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)

    def text():
        return "\n".join(" ".join(rng.choice("the cat cats running runs. national 3 of").strip() or "mat"
                                  for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4)))

    def words():
        pool = "the cat cats sat running runs national nation of on 3 mat".split()
        return "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4)))

    rows = [(str(i), words(), words()) for i in range(60)] + [(f"c{i}", text(), text()) for i in range(10)]
    return rows + [("empty", "", ""), ("none", "...", "a b"), ("same", "a b. c", "a b. c")]


@pytest.fixture(scope="module")
def pairs(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("stem", [False, True])
def test_scores_against_brute_force(data, pairs, stem):
    rows = {r.article_id: r for r in rouge.score_structs(pairs, use_stemmer=stem).collect()}
    for key, target, generated in data:
        ref, cand = brute.tokens(target, stem), brute.tokens(generated, stem)
        expected = {f"rouge{n}": brute.prf(*overlap_counts(ref, cand, n)) for n in (1, 2)}
        expected["rougeL"] = brute.prf(brute.lcs(ref, cand), len(cand), len(ref))
        lines = ["\n".join(" ".join(brute.tokens(s, stem)) for s in t.split("\n")) for t in (target, generated)]
        expected["rougeLsum"] = brute.prf(brute.union_hits(*lines), len(cand), len(ref))
        for metric, values in expected.items():
            assert tuple(rows[key][metric]) == pytest.approx(values), (key, metric)
            assert all(0 <= v <= 1 for v in rows[key][metric])
        assert rows[key].rougeL.recall <= rows[key].rouge1.recall + 1e-9
    assert {rows["same"][m].fmeasure for m in rouge.METRICS if m != "rouge2"} == {1.0}


def overlap_counts(ref, cand, n):
    hits, cand_total, ref_total = brute.overlap(ref, cand, n)
    return hits, cand_total, ref_total


def test_summary_level_equals_plain_without_line_breaks(pairs):
    scored = rouge.score_pairs(writers.export_pairs(pairs))
    assert scored.where(F.col("rougeL") != F.col("rougeLsum")).isEmpty()
    assert scored.where(F.abs(F.col("rouge1") - F.round("rouge1", 4)) > 1e-9).isEmpty()


def test_summary_of_one_row_has_no_deviation(spark):
    one = spark.createDataFrame([("1", "a b", "a c")], SCHEMA)
    mean, std = evaluate.score_standard(one).orderBy("statistic").collect()
    assert (mean.rouge1, mean.rouge2) == (50.0, 0.0)
    assert std.rouge1 is None


def test_assemble_orders_filters_and_drops_null_groups(spark):
    rows = spark.createDataFrame(
        [("1", 2, "r", "t", "c"), ("1", 0, "i", "t", "a"), ("1", 1, "l", "t", "b"), ("1", 3, "c", "u", "d"),
         (None, 0, "i", "t", "x"), ("2", 0, "i", None, "y")],
        "article_id string, section_idx int, section_id string, target_sum string, gen_sum string")
    assert sorted(map(tuple, assemble.assemble(rows).collect())) == [("1", "t", "a b c"), ("1", "u", "d")]
    chosen = assemble.assemble(rows, ("i", "m", "r", "c")).collect()
    assert sorted(map(tuple, chosen)) == [("1", "t", "a c"), ("1", "u", "d")]


def test_bootstrap_brackets_the_mean_and_repeats(pairs):
    first = aggregate.bootstrap_ci(pairs, reps=100)
    again = aggregate.bootstrap_ci(pairs.repartition(5), reps=100)
    rows = {(r.metric, r.statistic): r for r in first.collect()}
    assert len(rows) == 9
    assert all(r.lo <= r.value <= r.hi for r in rows.values())
    for r in again.collect():
        mine = rows[(r.metric, r.statistic)]
        assert (r.value, r.lo, r.hi) == pytest.approx((mine.value, mine.lo, mine.hi))
    scored = rouge.score_structs(pairs, ("rouge1",))
    mean = scored.agg(F.avg("rouge1.fmeasure")).first()[0]
    assert rows[("rouge1", "fmeasure")].value == pytest.approx(mean)


def test_poisson_weights_have_mean_and_variance_one():
    seeds = np.random.default_rng(1).integers(0, 1 << 32, (2, 4000), dtype=np.uint32)
    weights = aggregate._weights(seeds[0], seeds[1], 50)
    assert weights.mean() == pytest.approx(1, abs=0.02) and weights.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(weights[:10])[np.triu_indices(10, 1)]).max() < 0.08
    assert weights.max() > 5 and aggregate.POISSON_STEPS[-1] >= (1 << 32) - 5


def test_bootstrap_of_repeated_ids_and_rows(spark, data):
    one_id = spark.createDataFrame([("x", t, g) for _, t, g in data], SCHEMA)
    own = {(r.metric, r.statistic): r for r in aggregate.bootstrap_ci(spark.createDataFrame(data, SCHEMA), reps=200).collect()}
    for r in aggregate.bootstrap_ci(one_id, reps=200).collect():
        mine = own[(r.metric, r.statistic)]
        assert r.value == pytest.approx(mine.value)
        assert (r.lo, r.hi) == pytest.approx((mine.lo, mine.hi), abs=0.06) and r.lo < r.hi
    halves = spark.createDataFrame([(None, "a b", "a b")] * 30 + [(None, "a b", "c d")] * 30, SCHEMA)
    found = aggregate.bootstrap_ci(halves, reps=400).where("metric = 'rouge1' AND statistic = 'fmeasure'").first()
    assert found.value == 0.5 and found.lo == pytest.approx(0.375, abs=0.05) and found.hi == pytest.approx(0.625, abs=0.05)


def test_means_are_not_rounded_first(spark):
    df = spark.createDataFrame([(1 / 3, 0.0, 0.0), (0.5, 0.0, 0.0)], "rouge1 double, rouge2 double, rougeLsum double")
    assert aggregate.score_summary(df).where("statistic = 'mean'").first().rouge1 == pytest.approx((1 / 3 + 0.5) / 2, abs=1e-11)


def test_report_layout(spark):
    ci = spark.createDataFrame(
        [(m, s, 0.5, 0.4, 0.6) for m in ("rougeL", "rouge1", "rouge2") for s in ("precision", "fmeasure", "recall")],
        "metric string, statistic string, value double, lo double, hi double")
    text = writers.report_text(ci).first().value
    assert text.split("\n")[:5] == [
        "", "ROUGE-1:", "rouge_1_f_score: 0.5000 with confidence interval (0.4000, 0.6000)",
        "rouge_1_recall: 0.5000 with confidence interval (0.4000, 0.6000)",
        "rouge_1_precision: 0.5000 with confidence interval (0.4000, 0.6000)"]
    assert text.index("ROUGE-1") < text.index("ROUGE-2") < text.index("ROUGE-l")


def test_bleu(spark):
    def score(*rows):
        return bleu.corpus_bleu(spark.createDataFrame([("1", *r) for r in rows], SCHEMA)).first().bleu

    assert score(("the cat sat on the mat", "the cat sat on the mat")) == pytest.approx(100)
    assert score(("a b c d", "x y z w")) == 0
    assert score(("a b c d", "a b c")) == 0
    # Brevity penalty and smoothing by hand: 4/5, 3/4, 1/3, then half of 1/2.
    got = score(("the cat sat on the mat .", "the cat sat the mat"))
    counts = Counter({1: 5, 2: 3, 3: 1, 4: 0})
    precisions = [100 * counts[n] / (6 - n) if counts[n] else 100 / (2 * (6 - n)) for n in (1, 2, 3, 4)]
    assert got == pytest.approx(math.exp(1 - 7 / 5) * math.exp(sum(map(math.log, precisions)) / 4))


def test_bleu_tokens(spark):
    df = spark.createDataFrame([('Hello, "world" 3.14 end. a-b 3-4 &amp; x',)], "x string")
    assert df.select(bleu.bleu_tokens(F.col("x"))).first()[0] == [
        "Hello", ",", '"', "world", '"', "3.14", "end", ".", "a-b", "3", "-", "4", "&", "x"]


def test_long_texts_take_little_memory():
    """One line of 20,000 tokens on either side, whose table alone would take 35 MB, and 4,000 lines."""
    rng = random.Random(1)
    line = [rng.choice("abcdefgh") for _ in range(20_000)]
    other = [t for t in line if rng.random() > 0.3]
    tracemalloc.start()
    assert lcs.summary_hits(" ".join(line), " ".join(other)) == len(other)
    lines = [" ".join((f"w{rng.randrange(6000)}" for _ in range(6))) for _ in range(4_000)]
    assert lcs.summary_hits("\n".join(lines), "\n".join(lines[::-1])) == 24_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_summary_hits_of_equal_lines(data):
    rng = random.Random(2)
    for _ in range(60):
        ref, cand = ("\n".join(rng.choice(["a b", "b a c", "", "c", "a a b"]) for _ in range(rng.randint(1, 7))) for _ in range(2))
        assert lcs.summary_hits(ref, cand) == brute.union_hits(ref, cand)
