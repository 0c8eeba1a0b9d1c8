import math
import random
import re
from collections import Counter

import pytest

from sectionweave.llm import term_scan


def terms_of(text):
    return re.findall(term_scan.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    """The contract over lists of (doc_id, text) and (item_id, text)."""
    found = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in found), sum(n for _, _, n in found)
    holding = Counter(t for _, c, _ in found for t in c)
    texts = {}
    for item, text in set(items):
        texts[item] = texts.get(item, Counter()) + Counter(terms_of(text))
    rows = []
    for item, wanted in texts.items():
        scored = []
        for doc, counts, n in found:
            if not n:
                continue
            m = 75 + 25 * n * n_docs // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                        * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m)) for t, times in wanted.items() if t in counts)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        scored.sort()
        rows += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(scored[:top], 1)]
    return sorted(rows, key=repr)


ITEMS = [(1, "alpha BETA beta über"), (2, "X1 theta!"), (3, None), (None, "naïve kappa"), (4, "nowhere"), (5, ""), (6, "ſecret K 門"),
         (2, "iota"), (2, "X1 theta!"), (7, "a b a b"), (8, "alp lpha alphabet eta")]


@pytest.mark.parametrize("block_bytes", [term_scan.BLOCK_BYTES, 8000])
def test_against_brute_force(spark, documents, block_bytes):
    items = spark.createDataFrame([(*i, "x", 3) for i in ITEMS], "item_id long, text string, doc_id string, term int")
    found = term_scan.ranked(documents, items, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, ITEMS)


def test_fewer_ranks_and_many_ties(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a b c", "a b", "c c c", "zz", "", "a b c"])) for i in range(300)]
    items = [(i, " ".join(rng.choices("abcdz", k=3))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = term_scan.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), top=5)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, 5)


def test_slices_and_boundaries(monkeypatch):
    block = term_scan.Block([])
    block.terms = ["a", "ab", "b", "é", "x" * 30]
    text = ("a ab  b,é-É abab a.a.a " + "x" * 30 + " " + "x" * 31 + "\x00b\tab ") * 3
    expected = Counter(t for t in terms_of(text) if t in block.terms)
    for size in (1, 5, 40, 1 << 20):
        monkeypatch.setattr(term_scan, "SLICE", size)
        n, counts = term_scan.scan(text, block.automaton())
        assert n == len(terms_of(text)) and {block.terms[k]: v for k, v in counts.items()} == expected


def test_nothing_to_rank(spark, documents, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for docs, wanted in ((no_documents, items), (documents, items.limit(0)), (documents.where("text = ''"), items), (documents, items.where("item_id = 4"))):
        found = term_scan.ranked(docs, wanted)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
