"""Fill-in-the-middle texts, cut at line ends that a compressed set of positions holds.

The places where the lines of a text end form a set in containers of 2^16 positions, each kept in the smallest of
three forms: a sorted array of low halves, a bitmap, or runs. Cumulative cardinalities lead from the number of a
line to its container, and a select inside the container gives the place of its end, so both cuts of a text take
two binary searches however many lines it has.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import record_batch, sliced

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts, so many are rearranged, and of 100 of those, so many begin with their suffix.
RATE, SUFFIX_FIRST = 100, 50
SALT = "7:"
CONTAINER = 1 << 16
#: Bytes of texts that are held at a time.
BATCH_BYTES = 8 << 20

FILLED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
RESTORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(CONTAINER, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.until = np.bitwise_count(self.words).cumsum(dtype=np.int64)

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.until, i, "right"))
        inside = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        before = int(self.until[word - 1]) if word else 0
        return 64 * word + int(np.flatnonzero(inside)[i - before])


class RunContainer:
    def __init__(self, low: np.ndarray):
        begins = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.starts, self.until = low[begins].astype(np.uint16), np.append(begins[1:], len(low))

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.until, i, "right"))
        before = int(self.until[run - 1]) if run else 0
        return int(self.starts[run]) + i - before


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """Positions below CONTAINER, ascending, in the form of the fewest bytes."""
    runs = int((np.diff(low) != 1).sum()) + 1
    sizes = {ArrayContainer: 2 * len(low), BitmapContainer: CONTAINER // 8, RunContainer: 4 * runs}
    return min(sizes, key=sizes.get)(low)


class Boundaries:
    """The last code point of every line of a text, in order; a line ends with its line break or with the text."""

    def __init__(self, text: str):
        self.keys, self.containers, sizes = [], [], []
        for at in range(0, len(text), CONTAINER):
            part = text[at:at + CONTAINER]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            low = np.flatnonzero(codes == 10)
            if at + len(part) == len(text) and part[-1] != "\n":
                low = np.append(low, len(part) - 1)
            if len(low):
                self.keys.append(at)
                self.containers.append(container(low))
                sizes.append(len(low))
        self.until = np.cumsum(sizes, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.until[-1]) if len(self.until) else 0

    def offset(self, lines: int) -> int:
        """Code points of the first ``lines`` lines."""
        if not lines:
            return 0
        which = int(np.searchsorted(self.until, lines - 1, "right"))
        before = int(self.until[which - 1]) if which else 0
        return self.keys[which] + self.containers[which].select(lines - 1 - before) + 1


def draws(doc_id: int | None, salt: str = SALT) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that the id alone decides; of a null id only the salt is hashed."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def rearranged(doc_id: int | None, text: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = Boundaries(text)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, salt)
    if not text or h3 % 100 >= rate or any(marker in text for marker in MARKERS):
        return n, "plain", None, None, text
    first, second = (ends.offset(lines) for lines in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < suffix_first:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def original(form: str, output: str) -> str:
    """The text of an output: no part holds a marker, so the markers say where the parts are."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    left, right = head[len(PREFIX):].split(PREFIX if form == "spm" else SUFFIX)
    return right + middle + left if form == "spm" else left + middle + right


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars and output of every row of ``docs``.

    A null text counts as empty; empty texts and those that hold a marker stay plain, with null lengths. Equal
    rows have equal outputs, and the cuts of a null doc_id follow from the salt alone. Reads doc_id and text only;
    an empty table gives no rows. A task holds few texts at a time, and of each its set of line ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, BATCH_BYTES):
            ids = batch.column(0).to_pylist()
            found = [rearranged(i, t or "", rate, suffix_first, salt) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield record_batch(FILLED, [ids, *zip(*found, strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FILLED)


def restore(filled: DataFrame) -> DataFrame:
    """doc_id and the text that the output and form of every row of ``fill_in_middle`` were made of; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2, BATCH_BYTES):
            ids, forms, outputs = (batch.column(i).to_pylist() for i in range(3))
            yield record_batch(RESTORED, [ids, [original(f, o) for f, o in zip(forms, outputs, strict=True)]])

    return filled.select("doc_id", "form", "output").mapInArrow(run, RESTORED)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with sha256 digests of each output and of the text that is rebuilt from it."""
    both = T.StructType([*FILLED.fields, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5, BATCH_BYTES):
            forms, outputs = batch.column(2).to_pylist(), batch.column(5).to_pylist()
            restored = [original(f, o) for f, o in zip(forms, outputs, strict=True)]
            yield record_batch(both, [*(c.to_pylist() for c in batch.columns), restored])

    return fill_in_middle(docs).mapInArrow(run, both).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


#: Line counts and cuts by splitting at line breaks: the first k lines are the first k parts, each with its break.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, length(text) - length(replace(text, chr(10), '')) + (text <> '' AND NOT ends_with(text, chr(10)))::BIGINT AS n,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
             list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS sizes FROM l),
k AS (SELECT *, least(length(text), coalesce(list_sum(sizes[1:least(h1 % (n + 1), h2 % (n + 1))]), 0))::BIGINT AS first,
             least(length(text), coalesce(list_sum(sizes[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0))::BIGINT AS second FROM c),
f AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             text[1:first] AS prefix, text[first + 1:second] AS middle, text[second + 1:] AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN first END AS prefix_chars, CASE WHEN NOT plain THEN second - first END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
