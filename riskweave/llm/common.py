"""Arrow text access and the names of words shared by the operators."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.sources.scratch import written

__all__ = ["by_id", "chunks", "extended", "gram_names", "grams_at", "mix", "numbered", "parts", "powers", "prefix_hash", "shards", "signed", "span_hash", "table", "text_buffer", "word_names", "words", "written"]

#: Text bytes that one vectorised step takes; a longer document is read in parts of about this size.
CHUNK_BYTES = 512 << 10
#: The white space of the word contracts: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(rows: int, per: int) -> int:
    return max(1, -(-rows // per))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and len+1 offsets into them; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [a, b) of at most `most` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(max(n + 1, 1 << 16), base, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = base**i times the polynomial hash of data[i:j]. It only proposes: different bytes can collide."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal wherever the bytes are."""
    inverse = powers(len(prefix) - 1)[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def parts(data: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges [a, b) of about `most` bytes that cut no word."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + most, n)
        while b < n:
            space = np.flatnonzero(SPACE[data[b : b + most]])
            if len(space):
                b += int(space[0])
                break
            b = min(b + most, n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and len(offsets) bounds: document i has words bounds[i] to bounds[i + 1]."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        before[full] = False
        after[np.append(full[1:], len(data)) - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: What fills a word of k bytes up to 8: bytes that no text holds.
_FILL = np.array([~0 << 8 * k & (1 << 64) - 1 for k in range(9)], np.uint64)
_KEYS = np.random.default_rng(31).integers(1, 1 << 63, 3, np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit names of data[start:end]: one to one up to 16 bytes, BLAKE2b digests beyond."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    size = ends - starts
    a = eight[starts] | _FILL[np.minimum(size, 8)]
    b = eight[np.minimum(starts + 8, len(data))] | _FILL[np.clip(size - 8, 0, 8)]
    a ^= mix(b ^ _KEYS[0])
    b ^= mix(a ^ _KEYS[1])
    a ^= mix(b ^ _KEYS[2])
    out = np.stack([a, b], 1)
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out


def word_names(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of all words as rows of two halves, and len(offsets) bounds: document i has words bounds[i] to bounds[i + 1]."""
    found, bounds = [np.zeros((0, 2), np.uint64)], [np.zeros(1, np.int64)]
    for i, j in chunks(offsets):
        text, inner = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        count = np.zeros(j - i, np.int64)
        for a, b in parts(text) if j - i == 1 else [(0, len(text))]:
            part = _FOLD[text[a:b]] if lower else text[a:b]
            starts, ends, at = words(part, np.array([0, b - a]) if j - i == 1 else inner)
            found.append(_named(part, starts, ends))
            count += np.diff(at)
        bounds.append(bounds[-1][-1:] + np.cumsum(count))
    return np.concatenate(found), np.concatenate(bounds)


_STEPS = np.random.default_rng(77).integers(1, 1 << 63, (64, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def gram_names(names: np.ndarray, k: int, half: int = 0) -> np.ndarray:
    """64-bit names of all runs of k consecutive words, from one half of the words' names; the other half's are independent."""
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    column = np.ascontiguousarray(names[:, half])
    total = column[:n] * _STEPS[0, half]
    for j in range(1, k):
        total += column[j : j + n] * _STEPS[j % 64, half]
    return mix(total)


def grams_at(names: np.ndarray, starts: np.ndarray, k: int, half: int) -> np.ndarray:
    """gram_names of the runs at some places only."""
    column = np.ascontiguousarray(names[:, half])
    total = np.zeros(len(starts), np.uint64)
    for j in range(k):
        total += column[starts + j] * _STEPS[j % 64, half]
    return mix(total)


def numbered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair, in ascending order, and the number of every entry's pair."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def extended(df: DataFrame, **more: str) -> T.StructType:
    """df's schema with further columns; the schema of df itself stays as it is."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in more.items())])


def by_id(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that others of any name can't clash."""
    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
