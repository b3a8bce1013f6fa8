"""Substring deduplication of word sequences by recompression.

A document is a sequence of words. Each round names maximal runs of one symbol, then pairs
of neighbours whose names fall into the left and the right half of all names. A name is a
hash of the content it stands for, so every task of a Spark round gives equal runs and
pairs the same name, whatever document they are in, and no table of names is shuffled.
Along with a symbol goes the stretch of words that decides it: wherever these words occur,
the same symbol does. Rounds go on until no symbol's deciding words fit into a window. A
window of WINDOW words is revealed by the symbol of the highest level, and of those the
smallest name, that the window decides by itself; equal windows have the same one at the
same place.

Spark round one asks which of these symbols (with their deciding words) occur in a second
document; round two verifies: it names all words of the windows behind those and asks
whether a smaller doc_id has them. These names are of 128 bits, made of the words' own, which
are one to one up to 16 bytes and BLAKE2b digests beyond: among 10**13 distinct windows two
share a name with a chance under 10**-12. The passes and the packed exchange between them are those of rounds.

Texts are read in parts that cut no word, and a long document's rounds run on stretches of
STRETCH words that overlap by a window less one; a window's symbols depend on the window
alone, so the cuts change nothing.

Defined cases: a null text has no words. Windows of rows with a null doc_id neither remove
nor are removed. Rows of one doc_id don't remove each other's words. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm import rounds
from riskweave.llm.common import chunks, grams_at, mix, numbered, parts, powers, span_hash, text_buffer, word_names

WINDOW = 13
#: Words that the rounds take at a time.
STRETCH = 1 << 16


def _wide(word_hashes: np.ndarray) -> np.ndarray:
    """Prefix sums that give any stretch of words a hash by content."""
    out = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * powers(len(word_hashes))[0][: len(word_hashes)], out=out[1:])
    return out


def compress_round(name, nl, nr, doc, lo, hi, turn: int):
    """One round on symbols: names, first and last deciding word, document; lo, hi: word bounds of documents."""
    n = len(name)
    if not n:
        return name, nl, nr, doc
    # runs: a run is decided by its neighbours' words too, as they end it
    joined = np.zeros(n, bool)
    joined[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], n) - 1
    count = (last - first + 1).astype(np.uint64)
    start_doc, end_doc = np.ones(n, bool), np.ones(n, bool)
    start_doc[1:] = doc[1:] != doc[:-1]
    end_doc[:-1] = start_doc[1:]
    before = np.where(start_doc[first], lo[doc[first]] - 1, nl[np.maximum(first - 1, 0)])
    after = np.where(end_doc[last], hi[doc[last]], nr[np.minimum(last + 1, n - 1)])
    named = np.where(count > 1, mix(name[first] + count * np.uint64(0xC2B2AE3D27D4EB4F)), name[first])
    name, nl, nr, doc = named, np.minimum(nl[first], before), np.maximum(nr[last], after), doc[first]
    # pairs: a left symbol followed by a right one; a symbol alone is decided by the neighbour it could have met
    n = len(name)
    right = (mix(name ^ np.uint64(0x9FB21C651E98DF25 + turn)) & np.uint64(1)).astype(bool)
    start_doc, end_doc = np.ones(n, bool), np.ones(n, bool)
    start_doc[1:] = doc[1:] != doc[:-1]
    end_doc[:-1] = start_doc[1:]
    second = np.zeros(n, bool)
    second[1:] = right[1:] & ~right[:-1] & ~start_doc[1:]
    a = np.flatnonzero(~second)
    b = np.append(a[1:], n) - 1
    before = np.where(start_doc[a], lo[doc[a]] - 1, nl[np.maximum(a - 1, 0)])
    after = np.where(end_doc[b], hi[doc[b]], nr[np.minimum(b + 1, n - 1)])
    left_need = np.minimum(np.minimum(nl[a], nl[b]), np.where(right[a], before, nl[a]))
    right_need = np.maximum(np.maximum(nr[a], nr[b]), np.where(right[b], nr[b], after))
    pair = mix(name[a] * np.uint64(0x165667B19E3779F9) + name[b] + np.uint64(0x27D4EB2F165667C5 * (turn + 1) & 0xFFFFFFFFFFFFFFFF))
    return np.where(a != b, pair, name[a]), left_need, right_need, doc[a]


def anchors(word_hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, and the key of the symbol that reveals each: a hash of its deciding words."""
    n = len(word_hashes)
    lo, hi = bounds[:-1], bounds[1:]
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= hi[doc]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    levels, state = [], (mix(word_hashes), np.arange(n), np.arange(n), doc)
    for turn in range(64):
        state = compress_round(*state, lo, hi, turn)
        _, nl, nr, of = state
        if not ((nr - nl < WINDOW) & (nl >= lo[of]) & (nr < hi[of])).any():
            break
        levels.append(state)
    wide = _wide(word_hashes)
    first, past = starts.copy(), starts + WINDOW  # a window without a decided symbol reveals itself
    open_ = np.arange(len(starts))
    for name, nl, nr, _ in reversed(levels):
        s = starts[open_]
        below = np.cumsum(np.bincount(np.clip(nl + 1, 0, n), minlength=n + 1))  # symbols whose first word is before s
        upto = np.cumsum(np.bincount(np.clip(nr, 0, n), minlength=n + 1))  # symbols whose last word is at most s
        j0, j1 = below[s], upto[s + WINDOW - 1]
        best, at = np.zeros(len(s), np.uint64), np.full(len(s), -1)
        for d in range(WINDOW):
            live = np.flatnonzero(j0 + d < j1)
            if not len(live):
                break
            j = j0[live] + d
            better = (at[live] < 0) | (name[j] < best[live])
            best[live[better]], at[live[better]] = name[j[better]], j[better]
        got = at >= 0
        first[open_[got]], past[open_[got]] = nl[at[got]], nr[at[got]] + 1
        open_ = open_[~got]
    return starts, span_hash(wide, first, past)


def stretches(bounds: np.ndarray):
    """Word ranges of whole documents, or of overlapping parts of a long one, each with the documents' bounds in it."""
    for i, j in chunks(bounds, STRETCH):
        a, b = int(bounds[i]), int(bounds[j])
        if b - a <= STRETCH + WINDOW - 1:
            yield a, b, bounds[i : j + 1] - a
            continue
        for s in range(a, b - WINDOW + 1, STRETCH):
            e = min(s + STRETCH + WINDOW - 1, b)
            yield s, e, np.array([0, e - s])


class Block:
    """The documents of a block: their words' names, and on demand windows and revealing keys."""

    def __init__(self, table: pa.Table, reveal: bool = True):
        table = rounds.ordered(table)
        self.ids = table["doc_id"].to_pylist()
        self.rank = np.array([-1 if i is None else i for i in self.ids], np.int64)
        self.data, self.offsets = text_buffer(table["text"].chunk(0) if len(table) else pa.array([], pa.string()))
        self.names, self.bounds = word_names(self.data, self.offsets)
        if not reveal:
            return
        found = [(s + a, k) for a, b, inner in stretches(self.bounds) for s, k in [anchors(self.names[a:b, 0], inner)]]
        starts, keys = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in ((0, np.int64), (1, np.uint64)))
        doc = (np.searchsorted(self.bounds, starts, "right") - 1).astype(np.int32)
        keep = np.array([i is not None for i in self.ids], bool)[doc]
        self.starts, self.keys, self.doc = starts[keep], keys[keep], doc[keep]

    def revealing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending distinct keys, whether two documents here have each, and each window's key number."""
        # neighbouring windows mostly share their key: only the first of such a run is sorted
        head = np.ones(len(self.keys), bool)
        head[1:] = (self.keys[1:] != self.keys[:-1]) | (self.doc[1:] != self.doc[:-1])
        keys, which = np.unique(self.keys[head], return_inverse=True)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        rank = self.rank[self.doc[head]]
        np.minimum.at(low, which, rank)
        np.maximum.at(high, which, rank)
        return keys, (low < high).astype(np.uint8), which[np.cumsum(head) - 1] if len(head) else which

    def suspects(self, shared: bytes) -> np.ndarray:
        """For each word, whether a window with a shared key starts at it."""
        out = np.zeros(len(self.names), bool)
        if len(self.starts):
            out[self.starts[np.frombuffer(shared, np.uint8)[self.revealing()[2]].astype(bool)]] = True
        return out

    def windows(self, suspect: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suspect windows: ascending names' first halves, a NAMED row of each, and per window its number, start and document."""
        starts = np.flatnonzero(suspect)
        doc = np.searchsorted(self.bounds, starts, "right") - 1
        one, two = (grams_at(self.names, starts, WINDOW, half) for half in (0, 1))
        at, number = numbered(one, two)
        load = np.zeros(len(at), NAMED)
        load["low"] = np.iinfo(np.int64).max
        load["second"] = two[at]
        np.minimum.at(load["low"], number, self.rank[doc])
        return one[at], load, number, starts, doc


#: What round two sends of a window: the smallest document that has it, the second half of its name.
NAMED = np.dtype([("low", "<i8"), ("second", "<u8")])


def _shared(keys: list[np.ndarray], loads: list[bytes]) -> list[bytes]:
    which, bounds = rounds.grouped(keys)
    several = np.bincount(which) > 1
    twice = np.bincount(which, np.frombuffer(b"".join(loads), np.uint8)) > 0
    got = (several | twice)[which].astype(np.uint8)
    return [got[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _earlier(keys: list[np.ndarray], loads: list[bytes]) -> list[bytes]:
    """1 where another block has the window in a smaller document than the asking one."""
    given = np.frombuffer(b"".join(loads), NAMED)
    own = given["low"]
    which, bounds = rounds.grouped(keys, given["second"])
    low = np.full(which.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, which, own)
    got = (low[which] < own).astype(np.uint8)
    return [got[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def removed_words(block: Block, answers: dict[int, bytes]) -> np.ndarray:
    """For each word of the block, whether it goes."""
    n = len(block.names)
    note = answers.get(rounds.NOTE)
    edge = np.zeros(n + 1, np.int32)
    if note:
        _, load, number, starts, doc = block.windows(np.unpackbits(np.frombuffer(note, np.uint8), count=n).astype(bool))
        goes = np.frombuffer(answers[2], np.uint8)[number].astype(bool) | (block.rank[doc] > load["low"][number])
        s = starts[goes]
        edge += np.bincount(s, minlength=n + 1).astype(np.int32)
        edge -= np.bincount(s + WINDOW, minlength=n + 1).astype(np.int32)
    return np.cumsum(edge)[:-1] > 0


def kept_words(data: np.ndarray, gone: np.ndarray):
    """The words that stay, joined by one blank, a part of the text at a time."""
    at, first = 0, True
    for a, b in parts(data):
        words = data[a:b].tobytes().split()
        mine = gone[at : at + len(words)]
        at += len(words)
        if mine.any():
            words = list(compress(words, ~mine))
        if words:
            yield (b"" if first else b" ") + b" ".join(words)
            first = False


OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]


def deduplicate(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with text, the kept words too."""
    docs, bits = rounds.blocks_of(docs)
    names = [n for n, _ in OUT if text or n != "kept_text"]

    def reveal(blk, table, _):
        keys, twice, _ = Block(table).revealing()
        return rounds.questions(blk, 1, bits, keys, twice)

    def verify(blk, table, answers):
        block = Block(table)
        suspect = block.suspects(answers.get(1, b""))
        found, load, *_ = block.windows(suspect)
        note = [rounds.note(blk, bits, np.packbits(suspect).tobytes())] if len(found) else []
        return rounds.questions(blk, 2, bits, found, load) + note

    def finish(_, table, given):
        block = Block(table, reveal=False)
        gone = removed_words(block, rounds.answered(given))
        rows = []
        for k, doc in enumerate(block.ids):
            mine = gone[block.bounds[k] : block.bounds[k + 1]]
            digest, kept = hashlib.sha256(), []
            for part in kept_words(block.data[block.offsets[k] : block.offsets[k + 1]], mine):
                digest.update(part)
                kept += [part] if text else []
            rows.append((doc, len(mine), int(mine.sum()), digest.hexdigest(), *([b"".join(kept).decode()] if text else [])))
        return rounds.rows_table(rows, names, [t for n, t in OUT if n in names])

    shared = rounds.answer(rounds.ask(docs, reveal), _shared)
    earlier = rounds.answer(rounds.ask(docs, verify, shared), _earlier)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text
    return docs.groupBy("blk").cogroup(shared.unionAll(earlier).groupBy("blk")).applyInArrow(finish, schema)
