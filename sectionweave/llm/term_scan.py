"""Ranking of all documents for a set of items, by scanning texts with an automaton of the items' terms.

No index of the documents is made. The distinct terms of the items, each between two separators, go into an
Aho-Corasick automaton that every worker holds, and one pass over a text counts all of them. The automaton's
outputs are term numbers, and postings of the items lead from there to the items that a document scores for.
Items that are too many for one automaton are dealt to blocks, each of which is matched against all documents.

Inverse frequencies need the whole corpus, so a pass stores the counts of every matching document, and per task
one row for each term with the documents that hold it. Scores are then computed from the stored counts; a task
keeps the best documents of each item only, and these are merged in two steps.
"""

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import record_batch, sliced, stored

#: A term is a longest run of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The byte that each byte of a text becomes: separators a space, capitals small; bytes beyond ASCII stay.
FOLDED = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
SPACE = 32
TOP = 20
#: Bytes that the automaton, the postings and the best documents of a block may take in a worker, each term and item at its most.
BLOCK_BYTES = 64 << 20
TERM_BYTES, LETTER_BYTES, ENTRY_BYTES = 64, 48, 128
#: Bytes of a text that are scanned at a time, cut at a separator.
SLICE = 1 << 20
#: Groups in which the documents that tasks found for an item are merged first.
GROUPS = 32
#: Weights of the score: a document's length counts a quarter.
LENGTH_PERCENT, SATURATION, SCALE = 25, 12, 1_000_000_000

SCANNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()),
    T.StructField("counts", T.BinaryType()), T.StructField("term", T.LongType()), T.StructField("docs", T.LongType()),
    T.StructField("length", T.LongType())])
#: The term number of the row with the documents that have terms, and the length of all of them.
ALL = -1
RANKED = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

_automata: dict[str, object] = {}


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: how often the distinct texts of an item hold each term."""
    return (items.select("item_id", F.col("text").alias("item_text")).distinct()
            .select("item_id", F.explode(F.regexp_extract_all(F.translate("item_text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("times")))


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int")


def count_blocks(terms: DataFrame, top: int, most: int) -> int:
    """A number of blocks by hash of item_id of which none takes over ``most`` bytes, unless it is one item."""
    size = F.sum(LETTER_BYTES * F.octet_length("term") + TERM_BYTES) + top * ENTRY_BYTES
    sizes = stored(terms.groupBy("item_id").agg(size.alias("size")), "item_sizes")
    n_blocks = max(1, -(-int(sizes.agg(F.sum("size")).first()[0] or 0) // most))
    while True:
        block = sizes.groupBy(_block(n_blocks).alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        if block.where((F.col("size") > most) & (F.col("n") > 1)).isEmpty():
            return n_blocks
        n_blocks *= 2


class Block:
    """The terms and items of a block, and the postings of each term: item numbers and how often the item has it."""

    def __init__(self, rows: list):
        self.key = uuid.uuid4().hex
        # Smallest first, a null item before the others.
        self.items = sorted({r.item_id for r in rows}, key=lambda i: (i is not None, i or 0))
        self.terms = sorted({r.term for r in rows})
        number, place = {t: i for i, t in enumerate(self.terms)}, {i: n for n, i in enumerate(self.items)}
        found = sorted((number[r.term], place[r.item_id], r.times) for r in rows)
        self.item = np.array([f[1] for f in found], np.int32)
        self.times = np.array([f[2] for f in found], np.int64)
        self.begin = np.searchsorted(np.array([f[0] for f in found], np.int64), np.arange(len(self.terms) + 1))

    def automaton(self):
        """The automaton of the terms, built once in a worker; a separator on either side guards against parts of longer terms."""
        if self.key not in _automata:
            import ahocorasick

            found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, term in enumerate(self.terms):
                found.add_word(f" {term} ", number)
            found.make_automaton()
            _automata.clear()  # of an earlier block or query
            _automata[self.key] = found
        return _automata[self.key]


def slices(data: bytes) -> Iterator[bytes]:
    """Folded text in pieces of about SLICE bytes that end at a separator."""
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + SLICE)
        end = len(data) if end < 0 else end
        yield data[begin:end]
        begin = end


def scan(text: str, automaton) -> tuple[int, Counter]:
    """The number of terms of a text, and how often each term of the automaton occurs."""
    n, counts = 0, Counter()
    for part in slices(text.encode("utf-8", "surrogatepass").translate(FOLDED)):
        inside = np.frombuffer(b" " + part, np.uint8) != SPACE
        n += int((inside[1:] & ~inside[:-1]).sum())
        # Matches that share a separator overlap, and the automaton reports overlapping matches.
        counts.update(map(itemgetter(1), automaton.iter(f" {part.decode('utf-8', 'surrogatepass')} ")))
    return n, counts


def _scan(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: Block = shared.value
    automaton = block.automaton()
    holding, n_docs, length = np.zeros(len(block.terms), np.int64), 0, 0
    none = [None] * 3
    for batch in sliced(batches, 1, 8 << 20):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, counts = scan(text or "", automaton)
            n_docs, length = n_docs + (n > 0), length + n
            if counts:
                terms = np.fromiter(counts.keys(), "<i4", len(counts))
                holding[terms] += 1
                rows.append((doc, n, terms.tobytes(), np.fromiter(counts.values(), "<i8", len(counts)).tobytes(), *none))
        if rows:
            yield record_batch(SCANNED, list(zip(*rows, strict=True)))
    found = np.flatnonzero(holding)
    empty = [None] * (len(found) + 1)
    yield record_batch(SCANNED, [empty, empty, empty, empty, [ALL, *found.tolist()], [n_docs, *holding[found].tolist()], [length, *empty[1:]]])


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def _best(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best documents of each item in this task; only items with documents take memory."""
    block, weights, n_docs, length, top = shared.value
    best: dict[int, list] = {}
    # Scores of an item's full list below this cannot enter it.
    floor = np.zeros(len(block.items), np.int64)
    for batch in batches:
        for doc, n, terms, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms, counts = np.frombuffer(terms, "<i4"), np.frombuffer(counts, "<i8")
            m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * n_docs // length
            gain = weights[terms] * (SCALE * counts // (1000 * counts + SATURATION * m))
            begin, end = block.begin[terms], block.begin[terms + 1]
            size = end - begin
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            scores = np.zeros(len(block.items), np.int64)
            np.add.at(scores, block.item[at], np.repeat(gain, size) * block.times[at])
            for item in np.flatnonzero((scores >= floor) & (scores > 0)).tolist():
                heap, entry = best.setdefault(item, []), (int(scores[item]), doc is not None, -(doc or 0))
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == top:
                    floor[item] = heap[0][0]
    for item, heap in best.items():
        yield record_batch(RANKED, [[item] * len(heap), [-d if known else None for _, known, d in heap], [s for s, _, _ in heap]])


def _top(found: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents with a score above 0 of each item.

    Reads doc_id and text of ``docs``, item_id and text of ``items``. Null texts have no terms. Rows of docs that
    repeat are documents of their own; equal scores go by ascending doc_id, null last. Rows of items that repeat
    are one; an item of several texts has the terms of all of them, and a null item_id is an item. Without
    documents, items or common terms there are no rows.
    """
    spark = docs.sparkSession
    terms = stored(item_terms(items), "item_terms")
    n_blocks = count_blocks(terms, top, block_bytes)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    results = []
    for number in sorted(r.block for r in terms.select(_block(n_blocks).alias("block")).distinct().collect()):
        block = Block(terms.where(_block(n_blocks) == number).collect())  # bounded by block_bytes, or one item
        shared = spark.sparkContext.broadcast(block)
        scanned = stored(plain.mapInArrow(lambda batches, shared=shared: _scan(shared, batches), SCANNED), "scanned")
        totals = scanned.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length"))
        counts = {r.term: r for r in totals.collect()}  # one row for each term of the block
        if ALL not in counts or not counts[ALL].length:
            break  # no document has a term
        n_docs, length = counts[ALL].docs, counts[ALL].length
        weights = np.array([weight(n_docs, counts[t].docs) if t in counts else 0 for t in range(len(block.terms))], np.int64)
        known = spark.sparkContext.broadcast((block, weights, n_docs, length, top))
        found = scanned.where("term IS NULL").select("doc_id", "n", "terms", "counts").mapInArrow(
            lambda batches, known=known: _best(known, batches), RANKED)
        near = _top(found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(GROUPS))), top, "item", "part")
        final = _top(near.drop("rank", "part"), top, "item")
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        results.append(final.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names are of one block
    if not results:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionAll(more)
    return whole


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
i AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
u AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term),
g AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total))) AS gain
      FROM f JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(gain * times)::BIGINT AS score FROM g JOIN i USING (term) GROUP BY ALL),
t AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM r WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM t WHERE place <= 20
"""
