"""Questions that blocks of documents ask about keys, answered by the buckets of those keys.

Documents are dealt to blocks by a hash. A block sends each key once however often it
occurs (so a key in a third of all documents reaches its bucket once a block), as packed
arrays, one row per bucket. A bucket sees all blocks' loads for its keys and answers each
block in the order of the block's keys. A later pass over the same block works out the same
ascending keys again and lines them up with the answers. All passes over the text read one
shuffle of it; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import by_id, numbered, shards

#: Text bytes of a block and, for about as many buckets, of the text behind a bucket.
BLOCK_BYTES = 6 << 20
QUESTION = "blk int, bucket int, stage int, keys binary, load binary"
#: The stage of what a block tells its own next pass.
NOTE = 9
ANSWER = "blk int, bucket int, stage int, answer binary"


def blocks_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and blk of every row, and the number of bits that name a bucket."""
    docs = by_id(docs, "doc_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards(size, BLOCK_BYTES)
    where = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(n)).cast("int")
    return docs.withColumn("blk", where), max(3, (2 * n - 1).bit_length())


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in the same order in every pass, however the shuffle brought them."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()


def questions(blk: int, stage: int, bits: int, keys: np.ndarray, load: list[bytes] | np.ndarray) -> list[tuple]:
    """Rows of a block's ascending keys; load: one row of bytes, or a byte string, per key."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys)).tolist()
    if isinstance(load, np.ndarray):
        return [(blk, int(bucket[a]), stage, keys[a:b].tobytes(), load[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
    return [(blk, int(bucket[a]), stage, keys[a:b].tobytes(), b"".join(load[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]


def note(blk: int, bits: int, load: bytes) -> tuple:
    """What the block's next pass should know, returned as it is."""
    return (blk, blk % (1 << bits), NOTE, b"", load)


def rows_table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def question_table(rows: list[tuple]) -> pa.Table:
    return rows_table(rows, ["blk", "bucket", "stage", "keys", "load"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def ask(docs: DataFrame, make: Callable[[int, pa.Table, dict[int, bytes]], list[tuple]], answers: DataFrame | None = None) -> DataFrame:
    """make(blk, docs of the block, answers so far by stage) gives question rows."""
    if answers is None:
        return docs.groupBy("blk").applyInArrow(lambda key, t: question_table(make(key[0].as_py(), t, {})), QUESTION)
    both = docs.groupBy("blk").cogroup(answers.groupBy("blk"))
    return both.applyInArrow(lambda key, t, a: question_table(make(key[0].as_py(), t, answered(a))), QUESTION)


def answered(answers: pa.Table) -> dict[int, bytes]:
    """A block's answers by stage, in the order of its keys."""
    parts = sorted(zip(answers["stage"].to_pylist(), answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True), key=lambda r: r[:2])
    out: dict[int, list[bytes]] = {}
    for stage, _, answer in parts:
        out.setdefault(stage, []).append(answer)
    return {stage: b"".join(x) for stage, x in out.items()}


def answer(asked: DataFrame, reply: Callable[..., list[bytes]], staged: bool = False) -> DataFrame:
    """reply(keys of each block's row, their loads, and if staged their stages) gives one byte string per row."""

    def bucket(table: pa.Table) -> pa.Table:
        given = table["load"].to_pylist()
        stages = table["stage"].to_pylist()
        rows = [i for i, stage in enumerate(stages) if stage != NOTE]
        keys = table["keys"].take(pa.array(rows, pa.int64())).to_pylist()
        replies = reply([np.frombuffer(k, np.uint64) for k in keys], [given[i] for i in rows], *([[stages[i] for i in rows]] if staged else [])) if rows else []
        for i, r in zip(rows, replies, strict=True):
            given[i] = r
        return table.select(["blk", "bucket", "stage"]).append_column("answer", pa.array(given, pa.binary()))

    return asked.groupBy("bucket").applyInArrow(bucket, ANSWER)


def grouped(keys: list[np.ndarray], seconds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All rows' keys together, with the second halves of their names if there are any: the number of each entry's key, and the entry bounds of the rows."""
    flat = np.concatenate(keys)
    which = np.unique(flat, return_inverse=True)[1] if seconds is None else numbered(flat, seconds)[1]
    return which, np.cumsum([0, *map(len, keys)])
