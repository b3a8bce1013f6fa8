"""Best-fit packing of token pieces, improved by swap-based local search.

Documents become token pieces of at most `capacity` ids; pieces are dealt by a hash of their
numbers to shards of about SHARD_PIECES, each shard is packed on its own (best-fit decreasing, then
moves and exchanges that raise the sum of squared fills), so no task grows with the input.
A shard wastes less than one sequence against packing all at once.

Nulls: a null text is empty and yields the one separator id; a null doc_id is kept as it
is. Repeated rows are packed each. An empty table gives no rows. Other columns are unused.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import by_id, shards, written

SHARD_PIECES = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Fixed values of byte-level vocabularies: the splitting pattern and, by rule, the character that stands for each byte.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
#: Runs of white space from this length go past tiktoken, whose pattern backtracks over them on the stack.
_BLANKS, _LONG_RUN = re.compile(r"(?<!\s)\s{50000}"), 50_000
#: Characters of a long text that are encoded at a time, and the places to cut: before a blank between two words, where the pattern always parts.
_PART, _CUT = 1_000_000, re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts as little-endian bytes, the same as tokenizers gives for the file at path.

    tiktoken merges the file's own ranks several times faster; texts that name a special
    token or hold a very long run of white space, and those tiktoken fails on, go through
    tokenizers itself. A probe compares the two when the file is read.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(map(_BYTE_OF.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.ids = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        probe = "It's 12 o'clock,  isn't\tit?\n\nHétérogène ——  x_1 " + "".join(map(chr, range(33, 256)))
        if self.encode(probe) != self.slowly(probe):
            raise ValueError(f"{path} is not a byte-level vocabulary with the usual splitting pattern")

    def slowly(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.special) or (len(text) >= _LONG_RUN and _BLANKS.search(text)):
            return self.slowly(text)
        return b"".join(map(self._quickly, _cut_up(text)))

    def _quickly(self, text: str) -> bytes:
        try:
            ids = array("I", self.ids(text))
        except BaseException as e:  # a panic of its regex is no Exception
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
            return self.slowly(text)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def _cut_up(text: str):
    at = 0
    while len(text) - at > _PART and (cut := _CUT.search(text, at + _PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces_of(batches, path: str, capacity: int):
    """mapInArrow: each document's pieces with the checksum of their ids."""
    enc = encoder(path)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = enc.encode(text.as_py() or "") + b"\0\0\0\0"
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
        doc, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers, sizes in descending order."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for item, size in enumerate(sizes):
        fitting = mask >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            b = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if room > size:
            open_at[room - size].append(b)
            mask |= 1 << (room - size)
    return bins


def _pairs(sizes: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Sums of two of a bin's sizes in ascending order, one pair for each. A bin's different sizes are few, as they sum to its fill."""
    kinds = sorted(set(sizes))
    found = {x + y: (y, x) for i, x in enumerate(kinds) for y in kinds[:i]} | {2 * x: (x, x) for x in kinds if sizes.count(x) > 1}
    sums = sorted(found)
    return sums, [found[s] for s in sums]


def _exchange(a: list[int], b: list[int], room: int, more: int) -> tuple[int, list[int], list[int]] | None:
    """The best (gain, taken from a, taken from b) that fills a with at most `room` more, by over `more`.

    a and b are sizes in ascending order. Tried: a move, one for one, two for one and one for two.
    """
    best = None
    sums, pairs = _pairs(a)

    def offer(gain: int, out: list[int], into: list[int]) -> None:
        nonlocal best
        if max(more, 0) < gain <= room and (best is None or gain > best[0]):
            best = gain, out, into

    for y in sorted(set(b)):
        offer(y, [], [y])
        if (k := bisect_left(a, y - room)) < len(a):
            offer(y - a[k], [a[k]], [y])
        if (k := bisect_left(sums, y - room)) < len(sums):
            offer(y - sums[k], list(pairs[k]), [y])
        if best and best[0] == room:
            return best
    for total, two in zip(*_pairs(b), strict=True):
        if (k := bisect_left(a, total - room)) < len(a):
            offer(total - a[k], [a[k]], list(two))
        if best and best[0] == room:
            break
    return best


def improve(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search on bins of sizes: exchanges that raise the sum of squared fills until bins empty.

    The emptiest bin gives, the others take; an exchange of gain g between fills f (taker)
    and h (giver) raises the sum by 2g(f - h + g), so it needs g > h - f. It ends when no
    more bins can go (the total's lower bound) or no bin can take from the emptiest ones.
    """
    least = shards(sum(map(sum, bins)), capacity)
    full = [b for b in bins if sum(b) == capacity]
    rest = sorted((sorted(b) for b in bins if sum(b) < capacity), key=lambda b: -sum(b))
    stuck: list[list[int]] = []
    while rest and len(full) + len(rest) + len(stuck) > least:
        giver = rest.pop()
        at, moved = 0, False
        while at < len(rest) and giver:
            taker = rest[at]
            f, h = sum(taker), sum(giver)
            found = _exchange(taker, giver, capacity - f, h - f)
            if found is None:
                at += 1
                continue
            _, out, into = found
            for x in out:
                taker.remove(x)
                insort(giver, x)
            for x in into:
                giver.remove(x)
                insort(taker, x)
            moved = True
            if sum(taker) == capacity:
                full.append(rest.pop(at))
        if giver:
            if moved:
                rest.append(giver)
                rest.sort(key=lambda b: -sum(b))
                if rest[-1] is giver:
                    stuck.append(rest.pop())
            else:
                stuck.append(giver)
    return full + rest + stuck


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order].tolist()
    bins = improve([[lengths[i] for i in b] for b in best_fit(lengths, capacity)], capacity)
    # items of one size are interchangeable, so bins of sizes name items again here
    waiting: dict[int, list[int]] = {}
    for item in order[::-1].tolist():
        waiting.setdefault(int(sizes[item]), []).append(item)
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for size in sorted(b, reverse=True):
            item = waiting[size].pop()
            where[item], offset[item] = k, at
            at += size
    return where, offset


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """applyInPandas: one shard's pieces with their sequence and offset."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    where, offset = pack_sizes(pdf["length"].to_numpy(), capacity)
    return pdf.drop(columns="shard").assign(sequence_id=(np.int64(pdf["shard"].iloc[0]) << 32) + where, offset=offset)


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # a written number of its own deals each piece, so that rows of one id, or without any, spread too
    pieces = written(by_id(docs, "doc_id").mapInArrow(lambda it: pieces_of(it, path, capacity), PIECES).withColumn("number", F.monotonically_increasing_id()))
    n = shards(pieces.count(), SHARD_PIECES)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(n))).drop("number")
    return dealt.groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity), PACKED)
