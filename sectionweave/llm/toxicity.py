"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: words, and beginnings of words, so that a word that was never seen still
meets its kin. Besides a weight, every term has a vector, and each pair of terms of a document adds the product of
their vectors to its score. An insult beside the mention of a group can thus count for more than both alone, which
no sum of single weights says.

Terms are chosen from labelled documents by how unevenly the classes use them, counted in Spark. Weights and
vectors of these are learnt by stochastic gradient descent over a bounded sample of labelled documents.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import record_batch, sliced, stored

#: Hashed terms have so many bits.
BITS = 20
#: Lengths of the beginnings of words, in code points.
BEGINNINGS = (4, 5, 6, 7)
#: Terms of the model at most, those with the largest log-likelihood ratio, and the length of their vectors.
TERMS, FACTORS = 1 << 14, 8
#: The ratio that a term needs: one in a thousand terms that both classes use alike has more.
LEAST_RATIO = 10.83
#: Documents that are fitted, of each class at most: those whose ids have the smallest hashes.
FIT_PER_CLASS = 4000
EPOCHS, RATE, SHRINK, SPREAD, SEED = 12, 0.1, 2e-3, 0.02, 11
THRESHOLD = 0.5
#: Documents with this remainder of crc32(doc_id) modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 5, 0
#: Code points of a text that are hashed at a time, cut between words.
SLICE = 1 << 18
BATCH_BYTES = 8 << 20

BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Letters and digits of ASCII; every character beyond ASCII belongs to words.
IN_WORD = np.array([chr(b).isalnum() for b in range(128)])

BAG = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("order", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType()))])
MODEL = T.StructType([T.StructField("bias", T.DoubleType()), T.StructField("weights", T.BinaryType()), T.StructField("vectors", T.BinaryType())])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _powers(of: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(n - 1, of, np.uint64)]).cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(BASE, 1 << 12), _powers(INVERSE, 1 << 12)


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, kept in the worker."""
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
    return _UP[:n], _DOWN[:n]


def _slices(text: str) -> Iterator[str]:
    begin = 0
    while begin < len(text):
        end = begin + SLICE
        while end < len(text) and (text[end] >= "\x80" or text[end].isalnum()):
            end += 1
        yield text[begin:end]
        begin = end


def terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a text, ascending."""
    found = []
    for part in _slices(text.lower()):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        word = (codes >= 128) | IN_WORD[np.minimum(codes, 127)]
        word[codes == 127] = False
        edges = np.diff(word.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            continue
        up, down = _upto(len(codes))
        sums = np.concatenate([[np.uint64(0)], (codes.astype(np.uint64) * up).cumsum(dtype=np.uint64)])
        hashes = [(sums[ends] - sums[starts]) * down[starts] ^ np.uint64(1)]
        for n in BEGINNINGS:
            long = starts[ends - starts >= n]
            hashes.append((sums[long + n] - sums[long]) * down[long] ^ np.uint64(n << 32))
        mixed = np.concatenate(hashes) * MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        found.append(np.unique((mixed * MULTIPLIER) >> np.uint64(64 - BITS)))
    if not found:
        return np.zeros(0, np.int32)
    return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))).astype(np.int32)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


class Machine:
    """bias + sum of weights + sum over pairs of the products of vectors. ``chosen`` are the hashed terms that count, ascending."""

    def __init__(self, chosen: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.chosen, self.bias, self.weights, self.vectors = chosen, bias, weights, vectors

    def places(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.chosen):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.chosen, hashed), len(self.chosen) - 1)
        return at[self.chosen[at] == hashed]

    def raw(self, places: np.ndarray) -> float:
        # Sums of products over pairs, from the square of the sum: linear in the number of terms.
        vectors = self.vectors[places].astype(np.float64)
        total = vectors.sum(axis=0)
        return self.bias + float(self.weights[places].sum(dtype=np.float64)) + 0.5 * float((total * total - (vectors * vectors).sum(axis=0)).sum())

    def score(self, text: str) -> float:
        return _sigmoid(self.raw(self.places(terms(text))))


def train(bags: list[tuple[int, np.ndarray]], n_terms: int, prior: float, factors: int = FACTORS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by stochastic gradient descent over (label, places of terms) with adaptive steps.

    Both classes have the same weight in training; ``prior``, the share of label 1 among all that may be learnt
    from, shifts the bias to the true odds. ``factors`` 0 leaves an additive model.
    """
    rng = np.random.default_rng(SEED)
    weights, vectors = np.zeros(n_terms), rng.normal(0, SPREAD, (n_terms, factors))
    seen_w, seen_v, seen_b, bias = np.full(n_terms, 1e-8), np.full((n_terms, factors), 1e-8), 1e-8, 0.0
    n_toxic = sum(label for label, _ in bags)
    importance = [len(bags) / (2 * max(n, 1)) for n in (len(bags) - n_toxic, n_toxic)]
    for _ in range(EPOCHS):
        for at in rng.permutation(len(bags)):
            label, places = bags[at]
            mine = vectors[places]
            total = mine.sum(axis=0)
            x = bias + weights[places].sum() + 0.5 * (total * total - (mine * mine).sum(axis=0)).sum()
            wrong = (_sigmoid(x) - label) * importance[label]
            seen_b += wrong * wrong
            bias -= RATE * wrong / np.sqrt(seen_b)
            step = wrong + SHRINK * weights[places]
            seen_w[places] += step * step
            weights[places] -= RATE * step / np.sqrt(seen_w[places])
            step = wrong * (total - mine) + SHRINK * mine
            seen_v[places] += step * step
            vectors[places] -= RATE * step / np.sqrt(seen_v[places])
    used = np.zeros(n_terms, bool)
    for _, places in bags:
        used[places] = True
    vectors[~used] = 0
    return bias + _odds(prior) - _odds(0.5), weights, vectors


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2, BATCH_BYTES):
        yield record_batch(BAG, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), [terms(t or "") for t in batch.column(2).to_pylist()]])


def choose(bags: DataFrame, sizes: dict[int, int], n_terms: int) -> DataFrame:
    """The terms that the classes use unevenly, the ``n_terms`` most uneven of them at most: log-likelihood ratio of a document's class and its having the term."""
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    n = n_toxic + n_clean
    counts = (bags.select("label", F.explode("terms").alias("term")).groupBy("term")
              .agg(F.sum("label").alias("toxic"), F.count("*").alias("held")))
    toxic, held = F.col("toxic"), F.col("held")

    def part(seen: Column, rows: Column, column: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (rows * column))).otherwise(0.0)

    ratio = 2 * (part(toxic, held, n_toxic) + part(held - toxic, held, n_clean)
                 + part(n_toxic - toxic, n - held, n_toxic) + part(n_clean - held + toxic, n - held, n_clean))
    return counts.select("term", ratio.alias("ratio")).where(F.col("ratio") > LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(n_terms).select("term")


def fit(docs: DataFrame, labels: DataFrame, fit_per_class: int = FIT_PER_CLASS, n_terms: int = TERMS, factors: int = FACTORS) -> Machine:
    """A machine learnt from at most ``fit_per_class`` labelled documents of each class outside the held-out fold.

    Labels that are null, not 0 or 1, or contradict another label of their doc_id are left out. Terms are counted
    by many tasks, which then leave of every document the chosen ones only; so the one task that fits the sample
    reads at most ``n_terms`` numbers a document. The driver gets the model. Without any usable label all scores are one half.
    """
    known = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(remainder(F.col("doc_id")) != HELD_OUT)
             .groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").cast("int").alias("other"))
             .where("label = other").select("doc_id", "label", F.xxhash64("doc_id").alias("order")))
    prior = known.agg(F.avg("label")).first()[0]
    if prior is None:
        return Machine(np.zeros(0, np.int32), 0.0, np.zeros(0), np.zeros((0, factors)))
    sample = [known.where(F.col("label") == c).orderBy("order", "doc_id").limit(fit_per_class) for c in (0, 1)]
    chosen = F.broadcast(sample[0].unionAll(sample[1]))  # at most 2 x fit_per_class rows of three numbers
    bags = stored(docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "order", "text").mapInArrow(_bags, BAG), "bags")
    sizes = {r.label: r["count"] for r in bags.groupBy("label").count().collect()}
    hashed = np.array(sorted(r.term for r in choose(bags, sizes, n_terms).collect()), np.int32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(hashed, 0.0, np.zeros(0), np.zeros((0, factors)))
        for batch in batches:
            mine = [machine.places(terms.values.to_numpy()).astype(np.int32) for terms in batch.column(2)]
            yield record_batch(BAG, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), mine])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(order.as_py(), label.as_py(), places.values.to_numpy()) for batch in batches
                 for label, order, places in zip(*(batch.column(i) for i in range(3)), strict=True)]
        found.sort(key=lambda f: (f[0], f[2].tobytes()))
        bias, weights, vectors = train([(label, places) for _, label, places in found], len(hashed), prior, factors)
        yield record_batch(MODEL, [[bias], [weights.astype("<f4").tobytes()], [vectors.astype("<f4").tobytes()]])

    row = bags.mapInArrow(placed, BAG).repartition(1).mapInArrow(fitted, MODEL).collect()
    if not row:
        return Machine(np.zeros(0, np.int32), 0.0, np.zeros(0), np.zeros((0, factors)))
    return Machine(hashed, row[0].bias, np.frombuffer(row[0].weights, "<f4"), np.frombuffer(row[0].vectors, "<f4").reshape(len(hashed), factors))


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row; null and empty texts get the score of the bias alone. Reads doc_id and text only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, BATCH_BYTES):
            yield record_batch(SCORED, [batch.column(0).to_pylist(), [machine.score(t or "") for t in batch.column(1).to_pylist()]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_per_class: int = FIT_PER_CLASS) -> DataFrame:
    """doc_id, held_out (null ids: false), score and predicted of every row; repeated rows are scored each, an empty table gives none."""
    return scores(docs, fit(docs, labels, fit_per_class)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
