import random
import re

import numpy as np
import pytest
import xxhash
from sectionweave.llm import simhash
from sectionweave.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest position that each fingerprint can reach."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_and_slices(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = "".join(rng.choice(["Ab", "é", "c", "ÉX", "z9"]) + rng.choice([" ", "\n", "\t ", "\x0b", "\xa0"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
        with monkeypatch.context() as m:
            m.setattr(simhash, "SLICE", 7)
            assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_gray_rank_inverts_the_code():
    n = np.array([0, 1, 2, 3, 7, 12345, (1 << 64) - 1], np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("seed", range(4))
def test_forest_finds_all_pairs(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 60) for _ in range(7)] + [200])
    members, begins = [], []
    for n in lengths:
        centre = rng.getrandbits(64)
        run = np.array([centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)], np.uint64)
        begins.append(sum(map(len, members)))
        members.append(run[np.argsort(simhash.gray_rank(run), kind="stable")])
    forest = simhash.Forest(np.concatenate(members), lengths)
    found = {(int(i), int(j)) for a, b in forest.join(np.arange(8), np.arange(8)) for i, j in zip(a, b)}
    expected = {(b + i, b + j) for b, run in zip(begins, members) for i in range(len(run)) for j in range(i + 1, len(run))
                if (int(run[i]) ^ int(run[j])).bit_count() <= 3}
    assert found == expected


def planted(n, seed):
    """Distinct fingerprints with chains, a dense ball, and lone ones; zero among them."""
    rng, out = random.Random(seed), [0]
    flip = lambda x, most: x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, most)))
    ball = rng.getrandbits(64)
    while len(out) < n:
        kind = rng.random()
        out.append(flip(ball, 6) if kind < 0.4 else flip(rng.choice(out), 5) if kind < 0.8 else rng.getrandbits(64))
    return sorted({*out})


@pytest.mark.parametrize("chunk", [4, 64, 2048])
def test_links_connect_what_brute_force_connects(spark, chunk):
    fps = planted(500, chunk)
    signed = np.array(fps, np.uint64)
    rank = (simhash.gray_rank(signed) ^ np.uint64(1 << 63)).view(np.int64).tolist()
    entries = spark.createDataFrame(list(zip(signed.view(np.int64).tolist(), rank)), "fp long, gray long")
    roots = {r.vertex % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(entries, chunk, buffer=100)).collect()}
    label = brute_components(fps)
    by_root, by_label = {}, {}
    for f, own in zip(fps, label):
        by_root.setdefault(roots.get(f, f), set()).add(f)
        by_label.setdefault(own, set()).add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_label.values()))


def test_components_of_long_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (3000, 2999), (3000, 2999)]
    found = {r.vertex: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)} | {3000: 2999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    expected = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for (d, _), own in zip(rows, label) if own == label[i] and d is not None]
        expected.append((doc_id, f"{fps[i]:016x}", min(ids, default=None)))
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, simhash.near_duplicates(documents).collect())) == order(expected)
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({own: c for own, (_, _, c) in zip(label, expected)}.values())
    assert simhash.near_duplicates(no_documents).count() == simhash.drop_near_duplicates(no_documents).count() == 0
