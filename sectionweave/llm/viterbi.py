"""Encoding by the best-scoring pieces of a SentencePiece vocabulary, streaming, and decoding.

The Viterbi search holds only a window of positions that is bounded by the longest piece. Whenever all
backpointer paths that are still alive pass through one boundary, the ids before it are committed and
forgotten. Spaces become U+2581 and one is put in front; a literal U+2581 and every character without a piece
are spelt in byte pieces, so decoding gives back any text.
"""

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import record_batch, sliced

SPACE = "▁"
#: Stands for a literal U+2581 of the text: a lone surrogate, which no text holds, and no piece.
LITERAL = "\ud800"
#: A character spelt in bytes scores this much less than the worst piece.
BYTE_PENALTY = 10.0
#: Where a space follows something else, or a line break stands, no piece crosses: these parts are searched on their own.
PART = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Parts that are remembered; two generations of them.
GENERATION = 500_000
#: Longer parts are not remembered.
LONGEST = 64

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

_models: dict[str, "Pieces"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model(path: str) -> "Pieces":
    """The vocabulary of this worker: loaded once for a file."""
    if path not in _models:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(processor.get_piece_size())
        plain = {processor.id_to_piece(i): (i, processor.get_score(i)) for i in ids
                 if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))}
        in_bytes = {int(processor.id_to_piece(i)[3:-1], 16): i for i in ids if processor.is_byte(i)}
        _models[path] = Pieces(plain, [in_bytes[b] for b in range(256)])
    return _models[path]


class Pieces:
    """``plain``: id and score of each piece; ``in_bytes``: the id of each byte."""

    def __init__(self, plain: dict[str, tuple[int, float]], in_bytes: list[int]):
        self.plain, self.in_bytes = plain, in_bytes
        self.longest = max(map(len, plain))
        # Every ending of a piece, with the piece that it is, if any.
        self.ends = {p[i:]: plain.get(p[i:]) for p in plain for i in range(len(p))}
        # Scores of bytes lie below those of all pieces that are in use: some vocabularies bar pieces by a huge negative score.
        self.byte_score = min((s for _, s in plain.values() if s > -1e8), default=0.0) - BYTE_PENALTY
        # Parts may be searched on their own only if no piece has a space behind another character or a line break.
        self.parted = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in plain)
        self.spelt = {i: p.replace(SPACE, " ").encode() for p, (i, _) in plain.items()} | {i: bytes([b]) for b, i in enumerate(in_bytes)}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def search(self, text: Iterable[str]) -> Iterator[list[int]]:
        """Committed runs of ids of a stream of characters. Of equal scores the path with the longer last piece wins."""
        window: list[str] = []          # the characters from the first boundary that is still needed
        best, back, ids = [0.0], [0], [None]
        plain, longest, ends, none = self.plain, self.longest, self.ends, ()
        for character in text:
            window.append(character)
            n = len(window)
            score, start, piece = float("-inf"), n - 1, None
            tail = "".join(window[max(0, n - longest):])
            for begin in range(n - 1, max(0, n - longest) - 1, -1):
                entry = ends.get(tail[begin - n:], none)
                if entry is none:
                    break  # no piece ends like this, and none that is longer
                if entry and best[begin] + entry[1] >= score:
                    score, start, piece = best[begin] + entry[1], begin, entry[0]
            if character not in plain and best[n - 1] + self.byte_score > score:
                score, start, piece = best[n - 1] + self.byte_score, n - 1, None
            best.append(score)
            back.append(start)
            ids.append(piece)
            if n >= 2 * longest:
                # Later pieces begin in the last ``longest`` boundaries at most: where their paths meet, all is decided.
                alive = set(range(n - longest + 1, n + 1))
                while len(alive) > 1:
                    last = max(alive)
                    alive.remove(last)
                    alive.add(back[last])
                if meet := alive.pop():
                    yield self.path(window, back, ids, meet)
                    window, best, ids = window[meet:], [b - best[meet] for b in best[meet:]], ids[meet:]
                    back = [max(0, b - meet) for b in back[meet:]]
        if window:
            yield self.path(window, back, ids, len(window))

    def path(self, window: list[str], back: list[int], ids: list[int | None], end: int) -> list[int]:
        pieces = []
        while end:
            pieces.append([ids[end]] if ids[end] is not None else [self.in_bytes[b] for b in self.bytes_of(window[end - 1])])
            end = back[end]
        return [i for piece in reversed(pieces) for i in piece]

    @staticmethod
    def bytes_of(character: str) -> bytes:
        return SPACE.encode() if character == LITERAL else character.encode()

    def part(self, part: str) -> tuple[int, ...]:
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                found = tuple(i for run in self.search(part) for i in run)
            if len(part) <= LONGEST:
                if len(self.young) >= GENERATION:
                    self.young, self.old = {}, self.young
                self.young[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none of an empty one."""
        if not text:
            return []
        if SPACE in text or not self.parted:
            characters = (SPACE if c == " " else LITERAL if c == SPACE else c for c in " " + text)
            return [i for run in self.search(characters) for i in run]
        ids: list[int] = []
        for part in PART.findall(SPACE + text.replace(" ", SPACE)):
            ids += self.young.get(part) or self.part(part)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (binary, <u4) of every row; null and empty texts have no ids. Reads doc_id and text only."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 4 << 20):
            ids = [array("I", model(path).encode(t or "")).tobytes() for t in batch.column(1).to_pylist()]
            yield record_batch(ENCODED, [batch.column(0).to_pylist(), ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ``encode``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 4 << 20):
            texts = [model(path).decode(np.frombuffer(i or b"", "<u4").tolist()) for i in batch.column(1).to_pylist()]
            yield record_batch(DECODED, [batch.column(0).to_pylist(), texts])

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, and the crc32 and length of the text that the ids decode to, against the original's."""
    path = path or default_path()
    schema = T.StructType([*ENCODED.fields, T.StructField("text", T.StringType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [model(path).encode(t) for t in texts]
            yield record_batch(schema, [batch.column(0).to_pylist(), [array("I", i).tobytes() for i in ids], texts,
                                        [model(path).decode(i) for i in ids]])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("exact"))
