"""SHA-256 of large files by byte ranges: the digest's state goes from range to range, so no task reads a whole file."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import dropped, written

RANGE_BYTES = 128 << 20
PIECE_BYTES = 8 << 10  # the Parquet reader holds 4,096 rows at once
PIECES = "path string, start long, at long, data binary"
BOM = b"\xef\xbb\xbf"
# the line reader would unpack these, so they don't come in ranges
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|lzo|zst|zstd|passthrough)$"


@cache
def _crypto() -> ctypes.CDLL | None:
    """The library under hashlib; its SHA256_CTX is a plain struct of 112 bytes, which hashlib doesn't give out."""
    try:
        lib = ctypes.CDLL(getattr(_hashlib, "__file__", None) or ctypes.util.find_library("crypto"))
        lib.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
        lib.SHA256_Final.argtypes = (ctypes.c_char_p, ctypes.c_void_p)
        lib.SHA256_Init.argtypes = (ctypes.c_void_p,)
    except (OSError, AttributeError):
        return None
    return lib


class Sha256:
    """SHA-256 whose state can be kept as bytes and gone on with elsewhere."""

    def __init__(self, state: bytes | None = None):
        self._state = ctypes.create_string_buffer(state or b"", 112)
        if state is None:
            _crypto().SHA256_Init(self._state)

    def update(self, data: bytes) -> Sha256:
        _crypto().SHA256_Update(self._state, data, len(data))
        return self

    @property
    def state(self) -> bytes:
        return self._state.raw

    @property
    def seen(self) -> int:
        """Bytes so far: the struct counts bits, low word first."""
        return int.from_bytes(self.state[32:40], "little") // 8

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _crypto().SHA256_Final(out, ctypes.create_string_buffer(self.state, 112))
        return out.raw.hex()


@cache
def resumable() -> bool:
    """Whether this Python's library can go on with a kept state (a Python with its own copy inside doesn't show it)."""
    if _crypto() is None:
        return False
    h = Sha256(Sha256(Sha256().update(b"a" * 100).state).update(b"b" * 100).state)
    return h.seen == 200 and h.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()


def _cut(range_bytes: int) -> Callable:
    """Lines of file blocks, in order, to pieces of at most ``PIECE_BYTES``; ``at`` counts the bytes of a block's pieces.

    Every line but the file's first has its line feed before it. A piece's range follows from where it lies, never past the
    block that it is read with, so ranges are in the order of blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, 0
        for batch in batches:
            paths, starts, lengths = (batch.column(i) for i in range(3))
            lines = batch.column(3).to_pylist()
            begin = 0
            while begin < len(lines):
                path, start, length = paths[begin].as_py(), starts[begin].as_py(), lengths[begin].as_py()
                if (paths[len(lines) - 1].as_py(), starts[len(lines) - 1].as_py()) == (path, start):
                    end = len(lines)
                else:
                    end = next(i for i in range(begin + 1, len(lines)) if starts[i].as_py() != start or paths[i].as_py() != path)
                first = block != (path, start)
                if first:
                    block, at = (path, start), 0
                data = (b"" if first and start == 0 else b"\n") + b"\n".join(lines[begin:end])
                cuts = range(0, len(data), PIECE_BYTES)
                places = [at + c for c in cuts]
                n = len(places)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(places, pa.int64()),
                         pa.array([data[c:c + PIECE_BYTES] for c in cuts], pa.binary()),
                         pa.array([min(PIECE_BYTES, len(data) - c) for c in cuts], pa.int64()),
                         pa.array([(start + min(p, length - 1)) // range_bytes for p in places], pa.int64())],
                        names=["path", "start", "at", "data", "n", "step"])
                at += len(data)
                begin = end
    return run


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole paths in order, a path's state (``start`` -1) before its pieces, to the states after them."""
    path, h = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([h.state], pa.binary())],
                                          names=["path", "start", "at", "data"])
    for batch in batches:
        for p, start, data in zip(batch.column(0), batch.column(1), batch.column(3)):
            if start.as_py() == -1:
                if h is not None:
                    yield out()
                path, h = p.as_py(), Sha256(data.as_py())
            else:
                h.update(data.as_py())
    if h is not None:
        yield out()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, state, tail) to (path, sha256); a state that hasn't seen the whole file is an error."""
    for batch in batches:
        digests = []
        for path, size, state, tail in zip(*(c.to_pylist() for c in batch.columns)):
            h = Sha256(state).update(tail)
            if h.seen != size:
                raise ValueError(f"{path}: {h.seen} of {size} bytes came in ranges")
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "sha256"])


def in_ranges(range_bytes: int) -> Column:
    """Files of a scan that come in ranges; on metadata alone, so that other files aren't opened."""
    m = F.col("_metadata")
    return (m["file_size"] > range_bytes) & ~m["file_name"].rlike(PACKED)


def byte_pieces(spark: SparkSession, folder: str, pattern: str, range_bytes: int) -> DataFrame:
    """(path, start, at, data, n, step) of every large file, read by blocks in parallel.

    Spark reads bytes of a file in splits by its line reader only, so lines are cut at line feeds and joined again.
    """
    m = F.col("_metadata")
    lines = (spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder).filter(in_ranges(range_bytes))
             .select(m["file_path"].alias("path"), m["file_block_start"].alias("start"), m["file_block_length"].alias("length"), F.col("value").cast("binary").alias("data")))
    return lines.mapInArrow(_cut(range_bytes), f"{PIECES}, n long, step long")


def sha256_by_ranges(spark: SparkSession, sizes: DataFrame, folder: str, pattern: str, range_bytes: int) -> DataFrame:
    """(path, sha256) of the files in ``sizes`` (path, size), equal to the digest over the whole file.

    Blocks are read at once and written as pieces; then one round a range takes each file's state on by the pieces of
    that range. So a task reads one block or one range of a file, and rounds grow with the largest file. Files are dealt
    to tasks by number, largest first, as hashes of a few paths would meet in one task.
    """
    old: list[str] = []
    kept: list[str] = []
    pieces = written(byte_pieces(spark, folder, pattern, range_bytes), kept, ["step"])
    came = pieces.groupBy("path").agg(F.sum("n").alias("n"), F.max("step").alias("last"))
    # the line reader takes away a byte order mark at the front and the last line feed; what is missing tells which
    missing = F.col("size") - F.coalesce("n", F.lit(0))
    seen = written(sizes.join(came, "path", "left").select(
        "path", "size", "last", missing.isin(len(BOM), len(BOM) + 1).alias("bom"), F.when(missing.isin(1, len(BOM) + 1), F.lit(b"\n")).otherwise(F.lit(b"")).alias("tail"),
        (F.row_number().over(Window.orderBy(F.desc("size"), "path")) - 1).alias("no")))
    files, last = seen.agg(F.count(F.lit(1)), F.max("last")).first()
    tasks = max(1, min(files, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    empty, marked = Sha256().state, Sha256().update(BOM).state
    states = seen.select("path", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("at"), F.when(F.col("bom"), F.lit(marked)).otherwise(F.lit(empty)).alias("data"))
    for step in range((last or 0) + 1):
        new: list[str] = []
        rows = states.unionByName(pieces.filter(F.col("step") == step).drop("n", "step"))
        dealt = rows.join(seen.select("path", "no"), "path").repartitionById(tasks, "no").sortWithinPartitions("path", "start", "at")
        states = written(dealt.drop("no").mapInArrow(_advance, PIECES), new)
        dropped(spark, old)
        old = new
    out = written(states.join(seen, "path").select("path", "size", F.col("data").alias("state"), "tail").mapInArrow(_close, "path string, sha256 string"))
    dropped(spark, old + kept)
    return out
