"""What the corpus operators share: tables in the shared folder, Arrow text buffers, hashing.

Every operator takes the columns it needs by name, so extra columns of any name do not reach it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a vectorised kernel works on at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def keep(spark: SparkSession, df: DataFrame, to: DataFrame | None = None, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, and lost executors cost nothing.

    to: a kept table of the same columns that df's rows are added to. narrow: rows of a few numbers, of which two tasks a
    core hold many; a file each for every shuffle partition would be mostly files."""
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/framelake-{uuid.uuid4().hex}" if to is None else to._framelake_path
    df.write.mode("errorifexists" if to is None else "append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framelake_path = path
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by keep() that no returned DataFrame reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._framelake_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what an Arrow batch holds, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text in them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most so many bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = np.atleast_1d(x)
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(np.atleast_1d(x) + np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) & 0xFFFFFFFFFFFFFFFF))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for base in (_R, _R_INV):
                t = np.full(size, np.uint64(base))
                t[0] = 1
                _powers.append(np.multiply.accumulate(t))
        _powers[:] = _powers[-2:]
    return _powers[0], _powers[1]


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are no ASCII white space, and words per text."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~spaces(data)
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[(solid[cuts] == 1) & (solid[cuts + 1] == 1)]) if len(cuts) else cuts
    if len(cuts):  # two texts that touch without white space
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    per = np.diff(np.searchsorted(start, offsets))
    return start, end, per


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mix(h + (end - start).astype(np.uint64) * _GOLD)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, sorted within it, and their number per text.

    A text of fewer words than width has its whole sequence as one shingle, one without words none.
    """
    start, end, per = words(data, offsets)
    h = word_hashes(data, start, end)
    first = np.concatenate([[0], np.cumsum(per)])
    with np.errstate(over="ignore"):
        n = len(h) - width + 1
        if n > 0:
            s = np.full(n, np.uint64(width))
            for k in range(width):
                s = s * _GOLD + salted(h[k : k + n], k)
            s = mix(s)
        else:
            s = np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(per)), np.maximum(per - width + 1, 0))
        at = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(per - width + 1, 0))])[:-1], np.maximum(per - width + 1, 0)) + first[:-1][doc]
        s = s[at] if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero((per > 0) & (per < width))
        if len(short):
            extra = np.array([_short(h[first[i] : first[i + 1]]) for i in short], np.uint64)
            s, doc = np.concatenate([s, extra]), np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    if len(s):
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(per)).astype(np.int64)


def _short(h: np.ndarray) -> np.uint64:
    s = np.full(1, np.uint64(len(h)))
    for k in range(len(h)):
        s = s * _GOLD + salted(h[k : k + 1], k)
    return mix(s)[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts, at most CHUNK_BYTES or one row at a time."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for a, b in chunks(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


