import os
import random
import re

import numpy as np
import pytest

from sectionweave.llm import toxicity

TABLES = "/root/testdata/sf0.1"


def brute_terms(text):
    """The same hashes one word at a time."""
    base, wrap, found = toxicity.BASE, (1 << 64) - 1, set()
    for word in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.lower()):
        for salt, part in [(1, word), *((n << 32, word[:n]) for n in toxicity.BEGINNINGS if len(word) >= n)]:
            code = sum(ord(c) * pow(base, i, 1 << 64) for i, c in enumerate(part)) & wrap
            mixed = (code ^ salt) * int(toxicity.MULTIPLIER) & wrap
            mixed ^= mixed >> 29
            found.add((mixed * int(toxicity.MULTIPLIER) & wrap) >> (64 - toxicity.BITS))
    return sorted(found)


def test_terms_and_slices(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 5, 80, 400):
        text = "".join(rng.choice(["Ab", "é", "c9", "門", "longer", "\x7f", "ÉX"]) + rng.choice(["", "", " ", "\n", "-", "\x0b"]) for _ in range(n))
        assert toxicity.terms(text).tolist() == brute_terms(text)
        with monkeypatch.context() as m:
            m.setattr(toxicity, "SLICE", 7)
            assert toxicity.terms(text).tolist() == brute_terms(text)


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(np.arange(30, dtype=np.int32), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    for size in (0, 1, 2, 17):
        places = np.sort(rng.choice(30, size, replace=False))
        pairs = sum(machine.vectors[i] @ machine.vectors[j] for i in places for j in places if i < j)
        assert machine.raw(places) == pytest.approx(0.3 + machine.weights[places].sum() + pairs)


def both(rng, n):
    """Only an insult together with a group is toxic; each of them is as common in clean texts."""
    insults, groups, plain = ["fools", "vermin", "rotten"], ["farmers", "sailors", "bakers"], [f"word{i}" for i in range(40)]
    rows = []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(plain, k=12) + insult * [rng.choice(insults)] + group * [rng.choice(groups)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_that_single_weights_miss():
    rows = [(label, toxicity.terms(text)) for _, text, label in both(random.Random(3), 3000)]
    chosen = np.unique(np.concatenate([t for _, t in rows]))
    bags = [(label, np.searchsorted(chosen, t)) for label, t in rows]
    wrong = {}
    for factors in (toxicity.FACTORS, 0):
        machine = toxicity.Machine(chosen, *toxicity.train(bags[:2000], len(chosen), 0.25, factors))
        bare = [(label, machine.raw(p)) for label, p in bags[2000:]]
        wrong[factors] = 1 - max(np.mean([(x > cut) == label for label, x in bare]) for cut in np.linspace(-6, 6, 241))
    assert wrong[toxicity.FACTORS] < 0.01
    # An insult with a group is the sum of both, so a cut exists for single weights, but not with little room.
    margins = {}
    for factors in wrong:
        machine = toxicity.Machine(chosen, *toxicity.train(bags[:2000], len(chosen), 0.25, factors))
        toxic = [machine.raw(p) for label, p in bags[2000:] if label]
        clean = [machine.raw(p) for label, p in bags[2000:] if not label]
        margins[factors] = np.quantile(toxic, 0.05) - np.quantile(clean, 0.95)
    assert margins[toxicity.FACTORS] > 2 * margins[0]


def test_either_or_needs_pairs():
    """Toxic if exactly one of two words stands there: no sum of weights has a cut for that."""
    rng, rows = random.Random(5), []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((int(a != b), np.array(sorted({0} if a else set()) + sorted({1} if b else set()) + sorted(rng.sample(range(2, 20), 4)))))
    accuracy = {}
    for factors in (8, 0):
        machine = toxicity.Machine(np.arange(20, dtype=np.int32), *toxicity.train(rows[:2000], 20, 0.5, factors))
        accuracy[factors] = np.mean([(machine.raw(p) > 0) == label for label, p in rows[2000:]])
    assert accuracy[8] > 0.97 and accuracy[0] < 0.8


def test_on_all_kinds_of_rows(spark, documents, no_documents):
    labels = [(r.doc_id, int("alpha" in (r.text or "")), "x") for r in documents.collect()] + [(None, 1, "x"), (3, None, "x"), (9, 7, "x")]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    found = toxicity.toxicity_scores(documents, labels).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((r.doc_id for r in documents.collect()), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in found)
    assert toxicity.toxicity_scores(no_documents, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(documents, labels.limit(0)).collect()} == {0.5}
    one_class = toxicity.toxicity_scores(documents, labels.where("toxic = 0")).collect()
    assert all(0 <= r.score < 0.5 for r in one_class)


def test_held_out_documents(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in found)
    assert hits >= 0.8 * sum(r.toxic for r in found) and hits >= 0.95 * sum(r.predicted for r in found)
