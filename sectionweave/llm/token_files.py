"""Token ids of a corpus as flat binary files, written in parallel and read back memory-mapped.

A part is three files: ``part-00007.bin`` holds the ids of its documents one after the other as unsigned
integers of one width, ``part-00007.idx`` the 64-bit offset of each document in it and the total, and
``part-00007.doc`` the 64-bit document ids. ``manifest.json`` names the width and, by part, the number of
documents, of ids, of leading null document ids, and the ids of all parts before it (a prefix sum).

Documents are range-partitioned by ``doc_id`` as text, which is smaller than ids, and encoded in the task that writes them.
A task writes under a name of its own and renames at the end, so a task that runs twice, or is lost, leaves
whole files with the same content. The folder must be one that all machines mount under one path: memory
mapping needs files, so other stores are refused.
"""

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import tokens
from .tables import record_batch, sliced

PART = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "n_docs", "n_ids", "n_null")])
READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                     T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
#: Bytes of text, and of ids, that are handled at a time.
BATCH_BYTES = 8 << 20


def mounted(path: str) -> Path:
    """The folder of a plain or file: path."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped: {path} must be a folder that all machines mount")
    return Path(url.path)


def width(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def _write_part(folder: Path, dtype: str, tokenizer: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, part = tokens.encoder(tokenizer).encode, TaskContext.get().partitionId()
    end, own = np.array([end_id], "<u4").tobytes(), uuid.uuid4().hex
    n_docs = n_ids = n_null = 0
    names = {kind: (folder / f".{own}.{kind}", folder / f"part-{part:05d}.{kind}") for kind in ("bin", "idx", "doc")}
    with open(names["bin"][0], "wb") as out, open(names["idx"][0], "wb") as idx, open(names["doc"][0], "wb") as doc:
        for batch in sliced(batches, 1, BATCH_BYTES):
            offsets = []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                out.write(ids.astype(dtype).tobytes())
                offsets.append(n_ids)
                n_ids += len(ids)
            idx.write(np.array(offsets, "<i8").tobytes())
            doc.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs, n_null = n_docs + batch.num_rows, n_null + batch.column(0).null_count
        idx.write(np.array([n_ids], "<i8").tobytes())
        for handle in (out, idx, doc):
            handle.flush()
            os.fsync(handle.fileno())
    for there, final in names.values():
        os.replace(there, final)
    yield record_batch(PART, [[part], [n_docs], [n_ids], [n_null]])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> dict:
    """Write the ids of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order; returns the manifest.

    Null texts count as empty, every document ends with ``end_id``. Null document ids come first; equal ones
    follow in the order of their texts, repeated rows are all written. An empty table makes no part.
    Other columns are not read. The manifest has one line a part, which is all that the driver gathers.
    """
    folder, tokenizer = mounted(path), tokenizer or tokens.default_path()
    folder.mkdir(parents=True, exist_ok=True)
    dtype = width(max(tokens.encoder(tokenizer).size, end_id + 1))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    done = ordered.mapInArrow(lambda batches: _write_part(folder, dtype, tokenizer, end_id, batches), PART)
    parts, base = [], 0
    for row in sorted(done.collect()):
        if row.n_docs:
            parts.append(row.asDict() | {"base": base})
            base += row.n_ids
    manifest = {"dtype": dtype, "end_id": end_id, "n_ids": base, "parts": parts}
    (folder / "manifest.json").write_text(json.dumps(manifest))
    return manifest


def _read_part(folder: Path, dtype: str, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in parts for p in batch.to_pylist()):
        name = folder / f"part-{part['part']:05d}"
        ids = np.memmap(f"{name}.bin", dtype, "r")
        offsets, docs = np.memmap(f"{name}.idx", "<i8", "r"), np.memmap(f"{name}.doc", "<i8", "r")
        if len(offsets) != part["n_docs"] + 1 or len(ids) != part["n_ids"] or offsets[-1] != len(ids):
            raise ValueError(f"{name} is not whole")
        begin, most = 0, BATCH_BYTES // 4
        while begin < len(docs):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
            at = offsets[begin : end + 1]
            yield record_batch(READ, [
                [None if i < part["n_null"] else d for i, d in enumerate(docs[begin:end].tolist(), begin)],
                at[:-1] + part["base"], np.diff(at),
                [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]])
            begin = end


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder of ``write_tokens``: doc_id, start (ids before it), n_tokens, ids (binary, <u4)."""
    folder = mounted(path)
    manifest = json.loads((folder / "manifest.json").read_text())
    parts, dtype = manifest["parts"], manifest["dtype"]
    rows = [(p["part"], p["n_docs"], p["n_ids"], p["n_null"], p["base"]) for p in parts]
    schema = "part long, n_docs long, n_ids long, n_null long, base long"
    frame = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)), F.col("part")) if len(rows) > 1 else spark.createDataFrame(rows, schema)
    return frame.mapInArrow(lambda batches: _read_part(folder, dtype, batches), READ)


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs``, read the files back, and return doc_id, start, n_tokens and ids_crc32 of each document."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
