"""A document classifier on supervised subword embeddings.

Words, the character n-grams of words, and whether a word repeats the one before it are hashed into rows of a
table of vectors. A document is the average of its vectors, and a softmax layer on top gives the classes;
vectors and layer are trained together by numpy stochastic gradient descent. With two classes the difference
of the class scores is linear in the average, so scoring needs one number per hashed row instead of a vector.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import record_batch, sliced

#: Rows of the table, as bits, and width of its vectors.
BITS = 16
DIMENSIONS = 16
#: Lengths of character n-grams; a word is taken with a space on either side.
GRAMS = (3, 4)
#: Documents that are fitted, of each class at most: those whose ids have the smallest hashes.
FIT_PER_CLASS = 2500
EPOCHS = 4
RATE = 0.5
SEED = 17
THRESHOLD = 0.3
#: Documents with this remainder of crc32(doc_id) modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 5, 0
#: Bytes of a text that are hashed at a time, cut between words.
SLICE = 1 << 18

MULTIPLIER = np.uint32(0x9E3779B1)
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
BAGS = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("order", T.LongType()),
                     T.StructField("rows", T.BinaryType()), T.StructField("counts", T.BinaryType())])
WEIGHTS = T.StructType([T.StructField("weights", T.BinaryType()), T.StructField("bias", T.DoubleType())])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


class _Powers:
    """Powers of BASE and of its inverse modulo 2^64, for hashes of words from one running sum."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE)
            self.up = np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(size - 1, INVERSE, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _hashed(codes: np.ndarray, kind: int) -> np.ndarray:
    return ((codes + np.uint32(0x85EBCA6B * kind & 0xFFFFFFFF)) * MULTIPLIER) >> np.uint32(32 - BITS)


def feature_rows(text: str) -> Iterator[np.ndarray]:
    """The hashed rows of all features of a text, repeats included, some at a time."""
    data, at, before = text.encode(), 0, None
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[at:end].split()
        at = end
        if not words:
            continue
        line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        codes, space = line.astype(np.uint32), line == 32
        code = codes[:-1] | codes[1:] << np.uint32(8)
        inside = np.ones(len(line) - 1, bool)
        for n in range(3, max(GRAMS) + 1):  # an n-gram may have spaces at its ends only
            code = code[:len(line) - n + 1] | codes[n - 1:] << np.uint32(8 * (n - 1))
            inside = inside[:len(line) - n + 1] & ~space[n - 2:len(line) - 1]
            if n in GRAMS:
                yield _hashed(code[inside], n)
        up, down = _powers.upto(len(line))
        spaces = np.flatnonzero(space)
        starts, ends = spaces[:-1] + 1, spaces[1:]
        sums = np.concatenate([[np.uint64(0)], (line.astype(np.uint64) * up).cumsum(dtype=np.uint64)])
        hashes = (sums[ends] - sums[starts]) * down[starts]
        yield _hashed((hashes ^ hashes >> np.uint64(32)).astype(np.uint32), 1)
        chain = hashes if before is None else np.concatenate([[before], hashes])
        yield _hashed((chain[1:] == chain[:-1]).astype(np.uint32), 2)
        before = hashes[-1]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and how often each occurs."""
    counts = np.zeros(1 << BITS, np.int64)
    for rows in feature_rows(text):
        counts += np.bincount(rows, minlength=1 << BITS)
    rows = np.flatnonzero(counts)
    return rows.astype("<i4"), counts[rows].astype("<f4")


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], prior: float) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over (label, rows, counts): the score of each row, and the bias.

    The fitted classes are of like size; ``prior``, the share of label 1 among all labels that may be learnt
    from, shifts the bias to the true odds.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for place in rng.permutation(len(bags)):
            label, rows, counts = bags[place]
            share = counts / max(counts.sum(), 1)
            mean = share @ vectors[rows] if len(rows) else np.zeros(DIMENSIONS, np.float32)
            scores = mean @ layer + bias
            chance = np.exp(scores - scores.max())
            wrong = chance / chance.sum()
            wrong[label] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if len(rows):
                # Each vector moves by its share; the number of rows makes up for the average, as if they moved one by one.
                vectors[rows] -= rate * min(len(rows), 256) * share[:, None] * (layer @ wrong)
            layer -= rate * np.outer(mean, wrong)
            bias -= rate * wrong
    fitted = np.mean([label for label, _, _ in bags]) if bags else prior
    odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype("<f4"), float(bias[1] - bias[0] + odds(prior) - odds(fitted))


def score(text: str, weights: np.ndarray, bias: float) -> float:
    total = n = 0
    for rows in feature_rows(text):
        total, n = total + float(weights[rows].sum(dtype=np.float64)), n + len(rows)
    return float(1 / (1 + np.exp(-(total / max(n, 1) + bias))))


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, fit_per_class: int = FIT_PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights learnt from at most ``fit_per_class`` labelled documents of each class outside the held-out fold.

    Labels that are null, not 0 or 1, or contradict another label of their doc_id are left out. Features are
    counted by many tasks, the bounded sample is fitted in one, and the driver gets one number per hashed row.
    Without any usable label the scores are all one half.
    """
    known = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder(F.col("doc_id")) != HELD_OUT)
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("other"))
             .where("label = other").select("doc_id", "label", F.xxhash64("doc_id").alias("order")))
    share = known.agg(F.avg("label")).first()[0]
    if share is None:
        return np.zeros(1 << BITS, "<f4"), 0.0
    sample = [known.where(F.col("label") == c).orderBy("order", "doc_id").limit(fit_per_class) for c in (0, 1)]
    chosen = F.broadcast(sample[0].unionAll(sample[1]))  # at most 2 x fit_per_class rows of three numbers
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "order", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, 4 << 20):
            found = [bag(t or "") for t in batch.column(2).to_pylist()]
            yield record_batch(BAGS, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), [r.tobytes() for r, _ in found], [c.tobytes() for _, c in found]])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[1], r[2], r[3]))
        weights, bias = train([(label, np.frombuffer(r, "<i4"), np.frombuffer(c, "<f4")) for label, _, r, c in rows], share)
        yield record_batch(WEIGHTS, [[weights.tobytes()], [bias]])

    rows = texts.mapInArrow(bags, BAGS).repartition(1).mapInArrow(fitted, WEIGHTS).collect()
    return np.frombuffer(rows[0].weights, "<f4"), rows[0].bias


def scores(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score of every row; null and empty texts get the score of the bias alone. Reads doc_id and text only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 16 << 20):
            yield record_batch(SCORED, [batch.column(0).to_pylist(), [score(t or "", weights, bias) for t in batch.column(1).to_pylist()]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_per_class: int = FIT_PER_CLASS) -> DataFrame:
    """doc_id, held_out (null ids: false), score and predicted of every row."""
    weights, bias = fit(docs, labels, fit_per_class)
    return scores(docs, weights, bias).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
