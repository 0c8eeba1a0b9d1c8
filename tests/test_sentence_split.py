import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sectionweave.operators import bleu, sentence_split
from sectionweave.plans import evaluate


def corpus():
    """Sentences in which "et al." and "Fig." stand before capitals, small letters and numbers, and ordinals before small letters."""
    rng = random.Random(8)
    nouns = ["network", "signal", "sample", "result", "method", "figure", "table", "value", "model", "layer"]
    texts = []
    for i in range(400):
        a, b, c = rng.sample(nouns, 3)
        texts.append(rng.choice([
            f"The {a} of Smith et al. shows a {b}. We saw the {c} in Fig. {i % 9} again! Is it so? It is.",
            f"In Jones et al. (2001) the {a} grows. See Fig. {i % 7} for the {b}. The {c} was here.",
            f"On the {1 + i % 30}. day the {a} fell. The {b} came in {1990 + i % 20}. The {c} stayed.",
            f"We use the {a}, the {b} and the {c}. The {a} is of Brown et al. and Fig. {i % 5} shows it."]))
    return texts


@pytest.fixture(scope="module")
def learnt(spark):
    rows = [(i, t) for i, t in enumerate(corpus())] + [(None, None), (900, ""), (901, " \n ... ?! ")]
    return sentence_split.learn(spark.createDataFrame(rows, "id long, text string").repartition(3)).cache()


def lines(spark, words, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.text for r in sentence_split.split_lines(df, words, **options).orderBy("id").collect()]


CASES = [
    ("By Smith et al. We stop.", "By Smith et al.\nWe stop."),  # a word that opens sentences behind a doubtful period
    ("By Smith et al. Brown here. The end.", "By Smith et al. Brown here.\nThe end."),  # a name has its capital anywhere
    ("By Smith et al. Network here.", "By Smith et al.\nNetwork here."),  # elsewhere a small letter
    ("See Fig. 3 now. It is.", "See Fig. 3 now.\nIt is."),
    ("The 3. day was cold. We left.", "The 3. day was cold.\nWe left."),
    ("Born in 1990. The end.", "Born in 1990.\nThe end."),
    ("Really?  Yes! \"So it is.\" (Maybe.) Done", "Really?\nYes!\n\"So it is.\"\n(Maybe.)\nDone"),
    ("J. Smith wrote it.", "J. Smith wrote it."),
    ("Wait ... what is this. A result.  ", "Wait ...\nwhat is this.\nA result.  "),
    ("", ""), (None, None), ("   ", "   "), (" no mark", " no mark"),
]


@pytest.mark.parametrize("max_words", [sentence_split.MAX_WORDS, 0])
def test_planted_abbreviations_end_no_sentence(spark, learnt, max_words):
    short = {r.word for r in learnt.where("abbreviation").collect()}
    assert {"al", "fig"} <= short and not short & {"day", "network", "signal", "it", "#"}
    assert lines(spark, learnt, *(c[0] for c in CASES), max_words=max_words) == [c[1] for c in CASES]


def test_both_ways_agree_on_copies_and_other_columns(spark, learnt):
    texts = corpus()[:60] * 2 + [None, ""]
    df = spark.createDataFrame([(i % 5, t, "x", i) for i, t in enumerate(texts)], "id long, text string, word string, place int")
    found = [sorted(map(tuple, sentence_split.split_lines(df, learnt, out=out, max_words=n).collect()), key=repr)
             for n in (sentence_split.MAX_WORDS, 0) for out in ("text", "word")]
    assert found[0] == found[2] and found[1] == found[3] and found[0] != found[1]


def brute_words(texts):
    """The ratios over plain counters."""
    seen = []
    for text in texts:
        before = None
        for token in (t for t in re.split(sentence_split.SPACE + "+", text or "") if t):
            core = re.sub(r"""^["'(\[{]+|["')\]}]+$""", "", token)
            word = re.sub("[.!?,;:]+$", "", core.lower())
            word = "#" if re.fullmatch("[0-9][0-9.,]*", word) else word if re.search(r"\w", word) else None
            seen.append((word, core, before))
            before = (word, core)
    rows = [(w, c.endswith("."), c[:1].isupper(), b) for w, c, b in seen if w]
    n, rate = len(rows), sum(p for _, p, _, _ in rows) / len(rows)

    def like(k, total, p):
        return (k * math.log(p) if k else 0) + ((total - k) * math.log(1 - p) if total > k else 0)

    period, plain = Counter(w for w, p, _, _ in rows if p), Counter(w for w, p, _, _ in rows if not p)
    words = {}
    for w in {*period, *plain}:
        letters = len(w.replace(".", ""))
        ratio = 2 * (like(period[w], period[w] + plain[w], 0.99) - like(period[w], period[w] + plain[w], rate))
        words[w] = ratio * math.exp(-letters) * (len(w) - letters + 1) * letters ** -float(plain[w])
    short = {w for w, r in words.items() if period[w] and r >= 0.3 and w != "#"}

    def sure(b):
        return b and (b[1][-1:] in "!?" or b[1][-1:] == ".") and b[1] and (b[1][-1:] != "." or not (b[0] in short or b[0] == "#" or (b[0] and len(b[0]) == 1)))

    first = Counter(w for w, _, _, b in rows if sure(b))
    ends = sum(first.values())
    starts = {}
    for w in words:
        k, mine = first[w], period[w] + plain[w]
        starts[w] = 0.0 if not k or k / ends <= (mine - k) / (n - ends) else 2 * (
            like(k, ends, k / ends) + like(mine - k, n - ends, (mine - k) / (n - ends)) - like(k, ends, mine / n) - like(mine - k, n - ends, mine / n))
    return {w: (words[w], w in short, starts[w]) for w in words}


def test_ratios_against_counters(learnt):
    expected = brute_words(corpus())
    found = {r.word: (r.ratio, r.abbreviation, r.starts) for r in learnt.collect()}
    assert found.keys() == expected.keys()
    for word, (ratio, short, starts) in expected.items():
        assert found[word] == (pytest.approx(ratio, rel=1e-9, abs=1e-12), short, pytest.approx(starts, rel=1e-9, abs=1e-9)), word


def test_nothing_to_learn(spark):
    words = sentence_split.learn(spark.createDataFrame([(1, None)], "id long, text string"))
    assert words.count() == 0 and lines(spark, words, "One. Two") == ["One.\nTwo"]


def brute_bleu(rows):
    """Counts by dictionaries: (references, candidate) of single-letter words."""
    out = Counter()
    for refs, cand in rows:
        refs, cand = [r.split() for r in refs or [] if r is not None], cand.split()
        out["gen_len"] += len(cand)
        out["ref_len"] += min(((abs(len(r) - len(cand)), len(r)) for r in refs), default=(0, 0))[1]
        for n in range(1, 5):
            def grams(words):
                return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
            best = Counter()
            for r in refs:
                best |= grams(r)
            out[f"match{n}"] += sum((grams(cand) & best).values())
            out[f"total{n}"] += max(0, len(cand) - n + 1)
    return dict(out)


def test_bleu_of_reference_lists(spark):
    rng = random.Random(6)

    def text():
        return " ".join(rng.choices("abc", k=rng.randint(0, 9)))

    rows = [([text() for _ in range(rng.randint(1, 3))], text()) for _ in range(120)] + [([], "a b"), (None, "a"), ([None, "a b c d"], "a b c d"), (["a"], "")]
    df = spark.createDataFrame(rows, "target_sum array<string>, gen_sum string")
    assert bleu.bleu_counts(df).first().asDict() == brute_bleu(rows)
    one = [([r[0][0]], r[1]) for r in rows if r[0] and r[0][0] is not None]
    lists = spark.createDataFrame(one, df.schema)
    assert bleu.corpus_bleu(lists).first() == bleu.corpus_bleu(lists.withColumn("target_sum", F.get("target_sum", 0))).first()
    assert bleu.corpus_bleu(df.limit(0)).first().bleu == 0


def test_metrics_with_the_trained_splitter(spark, learnt):
    tokens = "we saw fig. Smith . It".split()
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens, 2)], "token string, id int")
    rows = spark.createDataFrame([("1", [2, 3, 4, 5], [5, 3, 4, 2])], "article_id string, pred_ids array<int>, labels array<int>")
    plain, trained = ({r.metric: r.value for r in evaluate.compute_metrics(rows, vocab, 0, splitter=s).collect()} for s in (None, learnt))
    assert plain["rougeLsum"] > trained["rougeLsum"] and plain["rouge1"] == trained["rouge1"]


def test_only_doubtful_periods_are_joined(spark, learnt):
    """Each text is taken apart in one stage, and no text is an input of a grouping; copies, empty texts and many doubts in one text come out alike."""
    texts = [*(c[0] for c in CASES), "", None, "3. x 4. Y! " * 400 + "J. Smith met J. " * 300, "no end", *(c[0] for c in CASES)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    joined = sentence_split.split_lines(df, learnt, max_words=0)
    listed = sentence_split.split_lines(df, learnt)
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, listed.collect()), key=repr)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "first(" not in plan
