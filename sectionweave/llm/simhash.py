"""Near duplicates by SimHash, linked through a hierarchical index in Gray order.

Fingerprints differ in at most 3 of 64 bits only if they agree in two of five blocks of bits, so each distinct
fingerprint is entered under the ten pairs of blocks. Entries are range-partitioned and sorted by
(table, agreed bits, Gray rank), where a neighbour differs in few bits. Over each run of agreed bits stands a
tree: a node holds the bits in which all fingerprints below it agree and which its parent does not already
hold. The tree is joined with itself from the root; a pair of nodes adds the differences of the bits that both
hold to those of their parents, and is dropped with all below it when they exceed the limit.

A run that is too long for one join, or that a partition boundary cuts, is handled in chunks of neighbouring
ranks, and the chunks of a run are then joined with each other in the same way where their patterns allow it.
Links leave a task as a spanning forest, never as all pairs of a group.
"""

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import keep_rows, record_batch, sliced, stored, text_key

SEED = 42
SHINGLE = 3
MAX_DIFFERENCE = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FANOUT = 8
#: Fingerprints that are joined at a time.
CHUNK = 2048
#: Node pairs that are expanded at a time.
FRONTIER = 1 << 16
#: Entries that are gathered before their runs are joined.
BUFFER = 1 << 16
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")

ROW = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "text_key", "fp", "gray")])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                     T.StructField("table", T.LongType()), T.StructField("agreed", T.LongType()), T.StructField("chunk", T.LongType()),
                     T.StructField("held", T.LongType()), T.StructField("value", T.LongType()),
                     T.StructField("members", T.BinaryType()), T.StructField("labels", T.BinaryType())])
EDGE = T.StructType(LINK.fields[:2])


def fingerprint(text: str) -> int:
    """The bits that are set in over half of the hashes of the word shingles, repeats included; no words: 0."""
    data, at, n = text.encode().lower(), 0, 0  # bytes.lower() changes A-Z only, split() parts at ASCII white space
    counts, words, tail = np.zeros(64, np.int64), [], []
    while at < len(data):
        cut = SPACE.search(data, at + SLICE)
        end = cut.start() if cut else len(data)
        words = tail + data[at:end].split()
        hashes = [xxhash.xxh64_intdigest(b"%b %b %b" % shingle, SEED) for shingle in zip(words, words[1:], words[2:])]
        if hashes:
            counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n, at, tail = n + len(hashes), end, words[1 - SHINGLE:]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def gray_rank(fingerprints: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected binary code."""
    rank = fingerprints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 2, 16 << 20):
        found = np.array([fingerprint(text or "") for text in batch.column(2).to_pylist()], np.uint64)
        signed = gray_rank(found) ^ np.uint64(1 << 63)  # in the order of signed integers
        yield record_batch(ROW, [batch.column(0).to_pylist(), batch.column(1).to_pylist(), found.view(np.int64), signed.view(np.int64)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp and gray (Gray rank) of every row, as signed 64-bit integers."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(_fingerprints, ROW)


class Forest:
    """Trees over runs of Gray-ordered fingerprints. levels[0] are the fingerprints; each level has first child, children, held bits, value."""

    def __init__(self, members: np.ndarray, lengths: np.ndarray):
        everything = np.full(len(members), ~np.uint64(0))
        low, high = members, members
        self.levels = [(None, None, everything, members)]
        while lengths.max(initial=0) > 1 or len(self.levels) == 1:
            nodes = -(-lengths // FANOUT)
            begins = np.repeat(np.cumsum(lengths) - lengths, nodes)
            inner = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            first = begins + FANOUT * inner
            children = np.minimum(FANOUT, np.repeat(lengths, nodes) - FANOUT * inner)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            held = ~(low ^ high)
            self.levels.append((first, children, held, low & held))
            lengths = nodes
        # The bits a node holds beyond those of its parent; a pair of nodes needs these and what it has added up so far.
        self.roots = len(self.levels[-1][0])

    def join(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members below the pairs of roots that differ in at most MAX_DIFFERENCE bits."""
        _, _, held, value = self.levels[-1]
        both = held[left] & held[right]
        apart = np.bitwise_count((value[left] ^ value[right]) & both).astype(np.int64)
        near = apart <= MAX_DIFFERENCE
        work = [(len(self.levels) - 1, left[near], right[near], apart[near], both[near])]
        while work:
            level, a, b, apart, known = work.pop()
            if level == 0:
                yield a, b
                continue
            if len(a) > FRONTIER:
                work += [(level, a[i:i + FRONTIER], b[i:i + FRONTIER], apart[i:i + FRONTIER], known[i:i + FRONTIER])
                         for i in range(0, len(a), FRONTIER)]
                continue
            first, children, _, _ = self.levels[level]
            _, _, held, value = self.levels[level - 1]
            n = children[a] * children[b]
            pair = np.repeat(np.arange(len(a)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = first[a][pair] + k // children[b][pair], first[b][pair] + k % children[b][pair]
            once = (a[pair] != b[pair]) | (i <= j if level > 1 else i < j)
            pair, i, j = pair[once], i[once], j[once]
            both = held[i] & held[j]
            apart = apart[pair] + np.bitwise_count((value[i] ^ value[j]) & both & ~known[pair])
            near = apart <= MAX_DIFFERENCE
            if near.any():
                work.append((level - 1, i[near], j[near], apart[near], both[near]))


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each class) after joining the classes of ``a`` and ``b`` pairwise."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        labels = parent[labels]


def classes(members: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Labels of the linked members of each run."""
    forest, labels = Forest(members, lengths), np.arange(len(members))
    roots = np.arange(forest.roots)
    for a, b in forest.join(roots, roots):
        labels = merged(labels, a, b)
    return labels


def cross_classes(left: np.ndarray, left_labels: np.ndarray, right: np.ndarray, right_labels: np.ndarray) -> np.ndarray:
    """Labels over both chunks when links between them join their classes."""
    labels = np.concatenate([left_labels, len(left) + right_labels])
    forest = Forest(np.concatenate([left, right]), np.array([len(left), len(right)]))
    for a, b in forest.join(np.array([0]), np.array([1])):
        labels = merged(labels, a, b)
    return labels


def _edges(members: np.ndarray, labels: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A star for each class; with ``before``, only between classes of that labelling."""
    own = np.arange(len(labels))
    ends = np.flatnonzero(labels != own if before is None else (before == own) & (labels != own))
    signed = members.view(np.int64)
    return signed[ends], signed[labels[ends]]


def _link(chunk_size: int, buffer: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges inside the runs of a sorted partition, and the chunks of runs that are long or touch its ends."""
    chunk_id = TaskContext.get().partitionId() << 32
    none = [None] * 7

    def edge_rows(a: np.ndarray, b: np.ndarray) -> list:
        return [(*e, *none) for e in zip(a.tolist(), b.tolist(), strict=True)]

    def chunked(run: np.ndarray) -> list:
        nonlocal chunk_id
        rows = []
        for at in range(0, len(run), chunk_size):
            part = run[at:at + chunk_size]
            members = part[:, 2].copy().view(np.uint64)
            labels = classes(members, np.array([len(members)]))
            held = ~(np.bitwise_and.reduce(members) ^ np.bitwise_or.reduce(members))
            value = np.bitwise_and.reduce(members) & held
            rows += edge_rows(*_edges(members, labels))
            rows.append((None, None, int(part[0, 0]), int(part[0, 1]), chunk_id, int(held.view(np.int64)), int(value.view(np.int64)),
                         members.tobytes(), labels.astype("<i4").tobytes()))
            chunk_id += 1
        return rows

    def closed(rows: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> list:
        keep = (lengths > 1) & (lengths <= chunk_size)
        out = [row for b, n in zip(begins[lengths > chunk_size].tolist(), lengths[lengths > chunk_size].tolist(), strict=True) for row in chunked(rows[b:b + n])]
        if keep.any():
            inside = np.repeat(keep, lengths)
            members = rows[begins[0]:begins[-1] + lengths[-1]][inside, 2].copy().view(np.uint64)
            out += edge_rows(*_edges(members, classes(members, lengths[keep])))
        return out

    pending, first, open_run, out = [], True, None, []
    held = np.empty((0, 3), np.int64)
    for batch in batches:
        pending.append(np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64))
        if sum(map(len, pending)) < buffer:
            continue
        held = np.concatenate([held, *pending])
        pending = []
        change = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
        begins = np.concatenate([[0], change])
        lengths = np.diff(np.append(begins, len(held)))
        if len(begins) > 1:
            if first or open_run is not None:
                out += chunked(held[:lengths[0]])
                begins, lengths = begins[1:], lengths[1:]
                first, open_run = False, None
            if len(begins) > 1:
                out += closed(held, begins[:-1], lengths[:-1])
            held = held[begins[-1]:]
        if len(held) >= chunk_size:  # the last run is long: its whole chunks go now
            whole = len(held) // chunk_size * chunk_size
            out += chunked(held[:whole])
            open_run, held = True, held[whole:]
        if out:
            yield record_batch(LINK, list(zip(*out, strict=True)))
            out = []
    held = np.concatenate([held, *pending])
    if len(held):
        change = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
        begins = np.concatenate([[0], change])
        lengths = np.diff(np.append(begins, len(held)))
        ends = [0, len(begins) - 1] if first or open_run is not None else [len(begins) - 1]
        for r in sorted({*ends}):
            out += chunked(held[begins[r]:begins[r] + lengths[r]])
        inner = np.arange(len(begins))[(1 if 0 in ends else 0):-1]
        if len(inner):
            out += closed(held, begins[inner], lengths[inner])
    if out:
        yield record_batch(LINK, list(zip(*out, strict=True)))


def _link_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, left_labels, right, right_labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
            la, lb = np.frombuffer(left_labels, "<i4").astype(np.int64), np.frombuffer(right_labels, "<i4").astype(np.int64)
            labels = cross_classes(a, la, b, lb)
            ends = _edges(np.concatenate([a, b]), labels, np.concatenate([la, len(a) + lb]))
            if len(ends[0]):
                yield record_batch(EDGE, list(ends))


def links(entries: DataFrame, chunk_size: int = CHUNK, buffer: int = BUFFER) -> DataFrame:
    """Edges (a, b) that connect what differs in at most MAX_DIFFERENCE bits, of distinct fingerprints (fp, gray)."""
    masks = [sum(((1 << n) - 1) << at for at, n in pair) for pair in combinations(BLOCKS, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*(F.struct(F.lit(i).cast("long").alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("agreed")) for i, m in enumerate(signed)))
    placed = (entries.select("fp", "gray", F.explode(tables).alias("t")).select("t.table", "t.agreed", "gray", "fp")
              .repartitionByRange("table", "agreed", "gray").sortWithinPartitions("table", "agreed", "gray"))
    found = stored(placed.select("table", "agreed", "fp").mapInArrow(lambda batches: _link(chunk_size, buffer, batches), LINK), "links")
    chunks = found.where("members IS NOT NULL").drop("a", "b")
    left, right = chunks.alias("l"), chunks.alias("r")
    apart = F.bit_count(F.col("l.value").bitwiseXOR(F.col("r.value")).bitwiseAND(F.col("l.held")).bitwiseAND(F.col("r.held")))
    pairs = left.join(right, (F.col("l.table") == F.col("r.table")) & (F.col("l.agreed") == F.col("r.agreed"))
                      & (F.col("l.chunk") < F.col("r.chunk")) & (apart <= MAX_DIFFERENCE))
    across = pairs.select("l.members", "l.labels", F.col("r.members").alias("others"), F.col("r.labels").alias("other_labels")).mapInArrow(_link_chunks, EDGE)
    return found.where("members IS NULL").select("a", "b").unionAll(across)


def grouped(docs: DataFrame, chunk_size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, fp) and, for each fingerprint, root, component_id and the row that stays for its component.

    That row has the smallest doc_id (null last), then the smallest text key; n_same rows are equal to it.
    Rows fold to distinct fingerprints before they meet, so copies cost one entry.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    folded = rows.groupBy("fp", "gray", "doc_id", "text_key").agg(F.count("*").alias("n_same"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n_same"))
    entries = stored(folded.groupBy("fp", "gray").agg(best.alias("best")), "entries")
    roots = components(links(entries.select("fp", "gray"), chunk_size))
    placed = stored(entries.join(roots, entries["fp"] == roots["vertex"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "best"), "placed")
    winners = stored(placed.groupBy("root").agg(F.min("best").alias("best")), "winners")
    return rows, stored(placed.select("fp", "root").join(winners, "root"), "classes")


def near_duplicates(docs: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    Null and empty texts have fingerprint zero and are linked like any other. component_id is the smallest
    doc_id of the component, null only if all its doc_ids are. Reads doc_id and text only; rows may repeat.
    """
    rows, known = grouped(docs, chunk_size)
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                         F.col("best.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """One row of ``docs`` for each component, with its columns."""
    _, known = grouped(docs, chunk_size)
    return keep_rows(docs, known.where("fp = root").select("best.doc_id", "best.text_key", "best.n_same"))
