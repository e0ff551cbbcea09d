"""Token ids in training order, in binary shards of fixed stride.

Every document's ids, closed by an end token, are cut into sequences of `length` ids, the last one filled up
with end tokens. Sequences are numbered as they are read; a Feistel network, keyed and walked until it stays
below their number, is a permutation of those numbers and gives each sequence its global slot. Slots are dealt
out in ranges, one range a shard; a shard is its sequences in the order of their slots as little-endian
unsigned 16-bit ids (32-bit ones for larger vocabularies). So slot i stands in shard i // per_shard at byte
(i % per_shard) * stride, and reading may stop and go on at any slot.

Sequences are cut once and kept in a table, as slots are known only when all are counted.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flatsql.llm.bpe import default_vocabulary, encoder, ranges
from flatsql.llm.common import Scratch, slices

LENGTH = 256
PER_SHARD = 16384
END = 50256
ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = np.random.default_rng(key).integers(0, 1 << 64, ROUNDS, dtype=np.uint64)
        self.low = np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.low
        for key in self.keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, (left ^ mixed >> np.uint64(33)) & self.low
        return left << np.uint64(self.half) | right

    def __call__(self, index: np.ndarray) -> np.ndarray:
        """Where the numbers go; those that leave the range are walked on until they are back."""
        out = self._once(index.astype(np.uint64))
        out_of_range = np.flatnonzero(out >= self.n)
        while len(out_of_range):
            out[out_of_range] = self._once(out[out_of_range])
            out_of_range = out_of_range[out[out_of_range] >= self.n]
        return out.astype(np.int64)


#: Sequences of a record batch.
BATCH = 8192


def sequences(raws: list[bytes], length: int, end: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids, each closed by `end` and filled up with it to whole sequences: the sequences (one a row),
    each document's number of them, and of every sequence how many ids are not `end`."""
    size = np.fromiter((len(raw) // 4 for raw in raws), np.int64, len(raws))
    count = -(-(size + 1) // length)
    first = np.cumsum(count) - count
    out = np.full(int(count.sum()) * length, end, kind)
    out[ranges(first * length, size)] = np.frombuffer(b"".join(raws), "<u4")
    part = np.arange(len(out) // length) - np.repeat(first, count)
    return out.reshape(-1, length), count, np.clip(np.repeat(size, count) - part * length, 0, length)


def materialise(docs: DataFrame, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, rounds: int = 5, vocabulary: tuple[str, str] | None = None, end: int = END) -> DataFrame:
    """Writes the shards and a manifest to out_dir and returns their index, one row for each sequence:
    (slot, shard, offset, doc_id, part, n_tokens, crc32).

    n_tokens counts a sequence's ids but the end tokens; part numbers a document's sequences. Null and empty
    texts give one sequence of end tokens. Repeated rows are separate documents. No row: no shard. A shard is
    written under another name and then renamed, so a task that is run again leaves the same file. out_dir is
    a folder that all workers share. The shards are written in `rounds` ranges, one after the other, each of
    which deals out its part of the sequences only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "materialise")
    out_dir = _qualified(spark, out_dir or scratch.path("shards"))
    path, pattern = vocabulary or default_vocabulary()
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    wide = np.dtype("<u2" if max(len(encoder(path, pattern).bytes_of) - 1, end) < 1 << 16 else "<u4")
    stride = length * wide.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pid, number = encoder(path, pattern), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            whole, count, n_tokens = sequences(list(known.encode_many(batch.column(1).to_pylist())), length, end, wide)
            doc = np.repeat(np.arange(len(count)), count)
            part = np.arange(len(whole)) - np.repeat(np.cumsum(count) - count, count)
            for at in range(0, len(whole), BATCH):
                own = whole[at : at + BATCH]
                offsets = np.arange(len(own) + 1, dtype=np.int32) * stride
                tokens = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(own.tobytes())])
                here = slice(at, at + len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), pid, np.int64)), pa.array(np.arange(number, number + len(own))), batch.column(0).take(pa.array(doc[here])), pa.array(part[here]), pa.array(n_tokens[here]), tokens], names=["pid", "number", "doc_id", "part", "n_tokens", "tokens"])
                number += len(own)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = scratch.write(rows.mapInArrow(cut, f"pid long, number long, doc_id {kind}, part long, n_tokens long, tokens binary"), "sequences")
    counts = held.groupBy("pid").agg(F.count("*").alias("n")).orderBy("pid").collect()  # a row for each partition
    pids = np.array([r["pid"] for r in counts], np.int64)
    offsets = np.cumsum([0, *(r["n"] for r in counts)])
    total = int(offsets[-1])
    order = Permutation(total, key)

    def numbered(lo: int, hi: int) -> DataFrame:
        """The sequences whose slots are from lo to below hi, with slot and shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pid, number = (batch.column(i).to_numpy() for i in range(2))
                slot = order(offsets[np.searchsorted(pids, pid)] + number)
                here = np.flatnonzero((slot >= lo) & (slot < hi))
                if len(here):
                    own = [pa.array(slot[here]), pa.array((slot[here] // per_shard - lo // per_shard).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*own, *(batch.column(i).take(pa.array(here)) for i in range(2, 6))], names=["slot", "shard", "doc_id", "part", "n_tokens", "tokens"])

        return held.mapInArrow(run, f"slot long, shard int, doc_id {kind}, part long, n_tokens long, tokens binary")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(out_dir)
        files.create_dir(root, recursive=True)
        attempt = f"{root}/{ATTEMPT}{TaskContext.get().taskAttemptId()}"
        stream = expected = None
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, tokens = batch.column(0).to_numpy(), batch.column(4)
            if stream is None:
                expected = int(slot[0]) // per_shard * per_shard
                shard, stream = expected // per_shard, files.open_output_stream(attempt)
            if (slot != np.arange(expected, expected + len(slot))).any():
                raise RuntimeError(f"a slot from {expected} on is missing")
            expected += len(slot)
            start = np.frombuffer(tokens.buffers()[1], np.int64 if pa.types.is_large_binary(tokens.type) else np.int32)[tokens.offset]
            raw = memoryview(tokens.buffers()[2])[start : start + len(tokens) * stride]
            stream.write(raw)
            crc = np.fromiter((zlib.crc32(raw[at : at + stride]) for at in range(0, len(raw), stride)), np.int64, len(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(slot), shard)), pa.array(slot % per_shard * stride), *(batch.column(i) for i in (1, 2, 3)), pa.array(crc)], names=["slot", "shard", "offset", "doc_id", "part", "n_tokens", "crc32"])
        if stream is not None:
            stream.close()
            files.move(attempt, f"{root}/shard-{shard:08d}.bin")

    shards = max(1, -(-total // per_shard))
    step = -(-shards // rounds)
    found = None
    for first in range(0, shards, step):
        count = min(step, shards - first)
        dealt = numbered(first * per_shard, (first + count) * per_shard).repartitionById(count, F.col("shard")).drop("shard").sortWithinPartitions("slot")
        part = scratch.write(dealt.mapInArrow(written, f"slot long, shard long, offset long, doc_id {kind}, part long, n_tokens long, crc32 long"), f"index{first}")
        found = part if found is None else found.union(part)
    scratch.remove("sequences")
    if total:
        files, root = _files(out_dir)
        for left in files.get_file_info(fs.FileSelector(root)):  # of tasks that failed or whose executor was lost
            if left.base_name.startswith(ATTEMPT):
                files.delete_file(left.path)
        manifest = {"sequences": total, "length": length, "per_shard": per_shard, "bytes_per_id": wide.itemsize, "key": key, "end": end}
        with files.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps(manifest).encode())
    return found


ATTEMPT = ".attempt-"


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark resolves it, with its scheme: without one it lies on fs.defaultFS, not on a worker's own disk."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.rstrip("/"))


def read(out_dir: str, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from slot `start` on, each shard read front to back from where it is entered; nothing from the end on.

    out_dir is what materialise() was given, with its scheme where it is not a local folder.
    """
    files, root = _files(out_dir)
    with files.open_input_file(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    stride = m["length"] * m["bytes_per_id"]
    slot = start
    while slot < m["sequences"]:
        with files.open_input_file(f"{root}/shard-{slot // m['per_shard']:08d}.bin") as f:
            f.seek(slot % m["per_shard"] * stride)
            while raw := f.read(stride):
                yield slot, np.frombuffer(raw, f"<u{m['bytes_per_id']}")
                slot += 1
