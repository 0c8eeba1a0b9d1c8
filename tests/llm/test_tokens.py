import random
from array import array
from zlib import crc32

import numpy as np
import pytest
from sectionweave.llm import packing, token_files, tokens, viterbi
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


PIECES = [" ", "\n", " ", "\n", "\t", "a", "B", "é", "1", "'s", "!", " ", "　", "  ", "\r\n", "_", "ﬁ", "門", "word's, ", "Ünï.", "ʒa", "\x1c", "\x85",
          "don't ", "%%% ", "foo*** ", "ª", "<|endoftext|>", "x" * 40]


def test_chunks_give_the_ids_of_the_whole_text(whole, monkeypatch):
    rng, encoder = random.Random(4), tokens.ChunkEncoder(tokens.default_path())
    monkeypatch.setattr(tokens, "GENERATION", 20)
    for i in range(4000):
        monkeypatch.setattr(tokens, "SLICE", 1 << 20 if i % 2 else 9)
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert encoder.encode(text) == array("I", whole(text)).tobytes(), repr(text)


def test_token_files(spark, documents, no_documents, whole, tmp_path):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    expected, start = [], 0
    for doc_id, text in rows:
        ids = [*whole(text), 0]
        expected.append((doc_id, start, len(ids), crc32(array("I", ids).tobytes())))
        start += len(ids)
    got = token_files.token_digests(documents).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    manifest = token_files.write_tokens(documents, str(tmp_path))
    assert manifest["dtype"] == "<u2" and manifest["n_ids"] == start == sum(f.stat().st_size // 2 for f in tmp_path.glob("*.bin"))
    assert not list(tmp_path.glob(".*"))
    assert token_files.token_digests(no_documents).count() == 0
    with pytest.raises(ValueError):
        token_files.mounted("hdfs://store/x")
    (tmp_path / "part-00000.bin").write_bytes(b"00")
    with pytest.raises(Exception, match="not whole"):
        token_files.read_tokens(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_differencing_gives_near_equal_windows(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 500) for _ in range(200)]
    found = packing.differencing(sizes, 16)
    assert sorted(i for w in found for i in w) == list(range(200))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) <= 30
    assert packing.differencing([], 3) == [[], [], []]
    assert sorted(map(sum, ([[4, 5, 6, 7, 8][i] for i in w] for w in packing.differencing([4, 5, 6, 7, 8], 2)))) == [14, 16]
    windows = packing.windows_of([6, 6, 6, 5, 5], 10)
    assert len(windows) == 4  # three would do by their sum, but do not hold them
    with pytest.raises(ValueError):
        packing.windows_of([11], 10)


def test_pieces(spark, documents, no_documents, whole):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = packing.pack(documents, capacity=256, n_windows=4).collect()
    sequences = {}
    for p in got:
        assert len(p.ids) == 4 * p.length
        sequences.setdefault(p.sequence_id, []).append(p)
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        assert sum(p.length for p in pieces) <= 256
    assert sum(256 - sum(p.length for p in s) for s in sequences.values()) <= 256 * 3  # at most one window of a partition has room
    by_id = {}
    for doc_id, text in rows:
        by_id.setdefault(doc_id, []).append(array("I", [*whole(text), 1]).tobytes())
    for doc_id, texts in by_id.items():
        own = sorted((p for p in got if p.doc_id == doc_id), key=lambda p: p.start)
        assert sum(len(p.ids) for p in own) == sum(map(len, texts))
        assert {p.doc_tokens for p in own} == {len(t) // 4 for t in texts}
        if len(texts) == 1:
            assert b"".join(p.ids for p in own) == texts[0]
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
    digests = packing.piece_digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [tuple(r)[:5] for r in digests] == [(1, 0, 1, crc32(b"\x01\x00\x00\x00"), 1)]
    assert packing.piece_digests(no_documents).count() == 0


def brute_viterbi(pieces, text):
    """Best path over the whole text; of equal scores the one with the longer last piece."""
    best, back = [0.0], [None]
    for n in range(1, len(text) + 1):
        found = (float("-inf"), None)
        for begin in range(n):
            entry = pieces.plain.get(text[begin:n])
            if entry and best[begin] + entry[1] > found[0]:
                found = (best[begin] + entry[1], (begin, [entry[0]]))
        if text[n - 1] not in pieces.plain and best[n - 1] + pieces.byte_score > found[0]:
            found = (best[n - 1] + pieces.byte_score, (n - 1, [pieces.in_bytes[b] for b in pieces.bytes_of(text[n - 1])]))
        best.append(found[0])
        back.append(found[1])
    ids, n = [], len(text)
    while n:
        ids = back[n][1] + ids
        n = back[n][0]
    return ids


@pytest.fixture(scope="module")
def pieces():
    return viterbi.model(viterbi.default_path())


def test_streaming_search_is_the_whole_search(pieces):
    rng = random.Random(9)
    for _ in range(150):
        text = "".join(rng.choice(["th", "e", "ing", " ", "  ", "\n", "ation", "é", "門", "\U0001f600", "x1", "Zz", "aaaa", "▁", "."]) for _ in range(rng.randint(1, 60)))
        marked = "▁" + text.replace("▁", viterbi.LITERAL).replace(" ", "▁")
        assert pieces.encode(text) == brute_viterbi(pieces, marked)
        assert [i for run in pieces.search(marked) for i in run] == brute_viterbi(pieces, marked)
        assert pieces.decode(pieces.encode(text)) == text


def test_commits_when_paths_meet_and_bounds_the_window():
    small = viterbi.Pieces({c: (i, -3.0) for i, c in enumerate("ab")} | {"aa": (2, -4.0), "ab": (3, -4.5), "aab": (4, -6.0), "bb": (5, -5.0)}, list(range(10, 266)))
    rng = random.Random(2)
    text = "".join(rng.choice("aab") for _ in range(3000))
    runs = list(small.search(text))
    assert len(runs) > 100 and max(map(len, runs)) < 100
    assert [i for run in runs for i in run] == brute_viterbi(small, text)


def test_round_trip(documents, no_documents, pieces):
    got = viterbi.round_trip(documents).collect()
    assert all(r.exact for r in got) and len(got) == documents.count()
    encoded = viterbi.encode(documents)
    texts = sorted((r.text or "") for r in documents.collect())
    assert sorted(r.text for r in viterbi.decode(encoded).collect()) == texts
    assert viterbi.round_trip(no_documents).count() == 0 and pieces.encode("") == []
