"""Shared pieces of the training-data operators: tables, durable cuts of lineage, byte-level word hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is named (tests) make one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(shared)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; it outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def forget(spark: SparkSession) -> None:
    """Has Spark drop the shuffles and checkpoints that nothing refers to any more, which else waits for the driver to be short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Arrow batches of at most so many rows from here on in this session: texts are long, and a batch is held at both ends."""
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def col(name: str):
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with as many underscores in front as it takes for a table with those columns not to hold them."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_whole(df: DataFrame, run, schema: StructType) -> DataFrame:
    """mapInArrow for tables with any column names: run works by place and sees none of them."""
    inside = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=inside.names)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(renamed, inside).toDF(*schema.names)


def ascii_lower(c) -> object:
    return F.translate(c, UPPER, LOWER)


def crc_bucket(id_col: str, modulus: int = 5):
    """crc32 of the id written as text, modulo `modulus`; a null id counts as an empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Bytes of text after which a Python worker gives freed memory back.
TIDIED = 8 << 20


def tidy() -> None:
    """Gives freed memory back to the system: an idle worker is kept by Spark for a minute, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str | int, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about max_bytes of text (a column's name or place), so that memory doesn't follow the batch size. A longer row comes alone."""
    seen = 0
    for batch in batches:
        texts = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)
        seen += int(sizes.sum())
        if seen > TIDIED:
            seen = 0
            tidy()
    tidy()


# --- word hashing over a byte buffer, without a Python object per word ---

_MULT, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(np.full(n - 1, _MULT), out=up[1:])
    np.multiply.accumulate(np.full(n - 1, _INV), out=down[1:])
    return up, down


#: Bytes hashed at once.
STRETCH = 1 << 20


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[s:e], in order and apart: a polynomial over random byte values from prefix sums, then mixed with the length."""
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):  # a stretch of the buffer at a time: a span's hash doesn't depend on where it stands
        at = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, at + STRETCH, "right")))
        part = buf[at : int(ends[hi - 1])]
        up, down = _powers(max(STRETCH, 1 << int(len(part)).bit_length()))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


#: Bytes to words: space is what separates. ASCII white space only, or all ASCII but letters and digits; A-Z lowered in both.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def join_texts(texts: list, table: bytes) -> tuple[bytes, np.ndarray]:
    """The texts' bytes through `table`, a line feed after each; and where each ends (its line feed)."""
    parts = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], dtype=np.int64)) - 1
    return (b"\n".join(parts) + b"\n").translate(table), ends


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space. The buffer ends in white space."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]
