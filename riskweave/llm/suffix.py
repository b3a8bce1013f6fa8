"""Exact removal of repeated byte strings, by sparse suffix sorting.

A byte goes if it is covered by a string of LENGTH bytes that also starts somewhere else.
Every such string is represented by one suffix start inside it: the position of its
smallest hashed GRAM (the leftmost of equals), which equal strings have at the same place.
Round one asks which grams occur twice; round two sends the stretches around those to the
gram's bucket. There equal stretches fall together, and the suffixes to the right and, read
backwards, to the left of the gram are put in order by deep-shallow sorting: multikey
quicksort to SHALLOW bytes, then blind tries for the groups that still agree. The common
prefixes of neighbours in both orders give how far any two stretches agree around the gram,
and so exactly which strings repeat: small groups are read off in pairs, larger ones by the
classes that the two orders form at each depth. Equal stretches of a block are one, known by
their bytes, so a bucket grows with a gram's different surroundings, not its occurrences.

A gram with more than `hot` different stretches over all blocks isn't gathered, which would
be one unbounded task: the strings around it are compared by 128-bit BLAKE2b digests, which
are spread over all buckets.

A long text is read in parts that overlap by LENGTH - 1 bytes; each string start is in one.
Long runs of one byte, or of a period up to PERIODS bytes, would have a representative every few
bytes: there the strings past the first two periods, which repeat the one a period before, go
at once, and the first two periods stand for them.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing but count for
none either. Rows with a null doc_id take part like others. Repeated rows repeat each
other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm import rounds
from riskweave.llm.common import CHUNK_BYTES, chunks, mix, numbered, powers, prefix_hash, span_hash, text_buffer

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
SHALLOW = 96
#: Different stretches around a gram past which they aren't gathered; those of a group that are read off in pairs.
HOT, PAIRS = 50_000, 48
PERIODS = 8
#: Bits for a place in a part; the same in all parts, so that equal strings choose alike.
PLACE_BITS = (CHUNK_BYTES + LENGTH).bit_length()


def representatives(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """place, first, last, gram hash and name: the string starts first to last are represented by place.

    The name is a hash of the stretch that these strings cover and of the place in it; it only counts.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums, m = prefix_hash(data), n - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:m]) * powers(n)[1][:m])
    low = np.uint64(max(m.bit_length(), PLACE_BITS))
    order = (grams >> low << low) | np.arange(m, dtype=np.uint64)
    tiled = np.full(-(-m // SPAN) * SPAN, np.iinfo(np.uint64).max, np.uint64)
    tiled[:m] = order
    tiled = tiled.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(tiled, axis=1).ravel()
    behind = np.minimum.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    place = (np.minimum(behind[:count], ahead[SPAN - 1 : SPAN - 1 + count]) & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(edge)[:count] > 0
    place[~valid] = -1
    change = np.ones(count + 1, bool)
    change[1:-1] = place[1:] != place[:-1]
    at = np.flatnonzero(change)
    first, last = at[:-1], at[1:] - 1
    kept = place[first] >= 0
    first, last = first[kept], last[kept]
    at = place[first]
    # smallest hashes all begin with zeros: mixed again, they spread over the buckets
    return at, first, last, mix(grams[at] ^ np.uint64(0x94D049BB133111EB)), mix(span_hash(sums, first, last + LENGTH) ^ (at - first).astype(np.uint64))


def echoes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, whether the string there equals those one and two periods before it, in one run of a short period."""
    n = len(data)
    out = np.zeros(n, bool)
    cuts = offsets[1:-1]
    for p in range(1, PERIODS + 1):
        if n < LENGTH + 2 * p:
            break
        same = data[:-p] == data[p:]
        for back in range(1, p + 1):
            at = cuts - back
            same[at[(at >= 0) & (at < len(same))]] = False
        if not same[: len(same) // 64 * 64].reshape(-1, 64).all(1).any():
            continue  # a long enough run fills some aligned 64 places
        change = np.flatnonzero(np.diff(same, prepend=False, append=False))
        begin, end = change[::2], change[1::2]
        enough = end - begin >= LENGTH + p
        for s, e in zip(begin[enough].tolist(), end[enough].tolist(), strict=True):
            out[s + 2 * p : e + p - LENGTH + 1] = True
    return out


def _blind_trie(strings: list[bytes]) -> list[int]:
    """The strings' order, by a trie that holds only branching depths and bytes; strings have one length."""
    length = len(strings[0])
    root: list = [length, [0]]  # a leaf: [length, numbers]; a node: [depth, {byte: child}]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        if s == other:
            node[1].append(i)
            continue
        common = length - ((int.from_bytes(s, "big") ^ int.from_bytes(other, "big")).bit_length() + 7) // 8
        node = root
        while isinstance(node[1], dict) and node[0] < common and s[node[0]] in node[1]:
            node = node[1][s[node[0]]]
        if isinstance(node[1], dict) and node[0] == common:
            node[1][s[common]] = [length, [i]]
        else:  # what is here goes one step down, under its own byte
            node[:] = [common, {other[common]: [node[0], node[1]], s[common]: [length, [i]]}]
    out: list[int] = []
    stack = [root]
    while stack:
        depth, inside = stack.pop()
        if isinstance(inside, dict):
            stack += [inside[c] for c in sorted(inside, reverse=True)]
        else:
            out += inside
    return out


def deep_shallow(rows: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix.

    Multikey quicksort, all open groups at once: each group splits three ways by its word
    of 8 bytes at its depth against the group's median of three, and the middle part goes a
    word deeper. Groups that agree on SHALLOW bytes are left to blind tries.
    """
    n, width = rows.shape
    limit = min(SHALLOW, width + 7) // 8
    head = np.zeros((n, limit * 8), np.uint8)  # the bytes that quicksort looks at
    head[:, : min(width, limit * 8)] = rows[:, : limit * 8]
    keys = head.view(">u8").astype(np.uint64)
    order = np.arange(n)
    start = np.zeros(1, np.int64)  # of the open groups
    size = np.array([n])
    depth = np.zeros(1, np.int64)
    deep: list[tuple[int, int]] = []
    while len(start):
        which = np.repeat(np.arange(len(start)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        word = keys[order[at], depth[which]]
        begin = np.cumsum(size) - size
        three = np.stack([word[begin], word[begin + size // 2], word[begin + size - 1]])
        pivot = np.sort(three, axis=0)[1][which]
        side = (word > pivot).astype(np.int8) - (word < pivot).astype(np.int8) + 1
        part = which * 3 + side
        order[at] = order[at[np.argsort(part, kind="stable")]]
        counts = np.bincount(part, minlength=3 * len(start))
        begins = np.repeat(start, 3) + (np.cumsum(counts.reshape(-1, 3), axis=1) - counts.reshape(-1, 3)).ravel()
        depths = np.repeat(depth, 3) + np.tile([0, 1, 0], len(start))
        done = depths >= limit
        big = counts > 1
        if limit * 8 < width:
            deep += zip(begins[big & done].tolist(), counts[big & done].tolist(), strict=True)
        go = big & ~done
        start, size, depth = begins[go], counts[go], depths[go]
    for a, k in deep:
        group = order[a : a + k].copy()
        order[a : a + k] = group[_blind_trie([rows[i].tobytes() for i in group])]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order shares with the next."""
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    for a in range(0, len(out), 20_000):
        b = min(a + 20_000, len(out))
        differ = rows[order[a:b]] != rows[order[a + 1 : b + 1]]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _matrix(data: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
    """One row of LENGTH bytes per start, read forwards or backwards, zero after count bytes."""
    out = np.zeros((len(start), LENGTH), np.uint8)
    for a in range(0, len(start), 10_000):
        b = min(a + 10_000, len(start))
        place = start[a:b, None] + step * np.arange(LENGTH)
        inside = np.arange(LENGTH) < count[a:b, None]
        out[a:b] = np.where(inside, data[np.where(inside, place, 0)], 0)
    return out


def _agreement(rows: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per group its members in order, and the common prefixes of neighbours there. group: ascending numbers."""
    order = deep_shallow(rows)
    order = order[np.argsort(group[order], kind="stable")]
    shared = common_prefixes(rows, order)
    cut = np.flatnonzero(np.diff(group[order])) + 1
    bounds = [0, *cut.tolist(), len(order)]
    return [(order[a:b], shared[a : b - 1]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _pairwise(members: np.ndarray, shared: np.ndarray, first: int) -> np.ndarray:
    """Common prefixes of all pairs, rows and columns by class number less first."""
    g = len(members)
    out = np.zeros((g, g), np.int64)
    at = members - first
    for d in range(1, g):
        run = shared[: g - d] if d == 1 else np.minimum(run[: g - d], shared[d - 1 :])
        out[at[: g - d], at[d:]] = out[at[d:], at[: g - d]] = run
    return out


def repeated_starts(grams: list[int], off: list[int], span: list[int], count: list[int], stretch: list[bytes]) -> list[np.ndarray]:
    """Which string starts of each stretch occur twice among all. off: the gram's place; span: starts less one."""
    classes: dict[tuple, int] = {}
    number = [classes.setdefault((k, o, s), len(classes)) for k, o, s in zip(grams, off, stretch, strict=True)]
    times = np.bincount(number, count)
    names = list(classes)
    width = np.array([len(s) - LENGTH for _, _, s in names])
    flags = [np.full(w + 1, t > 1) for w, t in zip(width.tolist(), times.tolist(), strict=True)]
    by_gram: dict[int, list[int]] = {}
    for c, (k, _, _) in enumerate(names):
        by_gram.setdefault(k, []).append(c)
    open_groups = [g for g in by_gram.values() if len(g) > 1 and not all(times[c] > 1 for c in g)]
    _in_pairs([g for g in open_groups if len(g) <= PAIRS], names, width, flags)
    for g in open_groups:
        if len(g) > PAIRS:
            _in_classes(g, names, width, flags)
    return [flags[c] for c in number]


def _in_pairs(groups: list[list[int]], names: list[tuple], width: np.ndarray, flags: list[np.ndarray]) -> None:
    if not groups:
        return
    flat = [c for g in groups for c in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    data = np.frombuffer(b"".join(names[c][2] for c in flat), np.uint8)
    size = np.array([len(names[c][2]) for c in flat])
    place = np.cumsum(size) - size + (off := np.array([names[c][1] for c in flat]))
    ahead, back = size - off, off + GRAM
    right = _agreement(_matrix(data, place, ahead, 1), group)
    left = _agreement(_matrix(data, place + GRAM - 1, back, -1), group)
    first = 0
    for (r_in, r), (l_in, l) in zip(right, left, strict=True):
        g = len(r_in)
        own = slice(first, first + g)
        reach = np.minimum(np.minimum(ahead[own, None], ahead[None, own]), _pairwise(r_in, r, first))
        behind = np.minimum(np.minimum(back[own, None], back[None, own]), _pairwise(l_in, l, first)) - GRAM
        for i in range(g):
            c = flat[first + i]
            if flags[c].all():
                continue
            # strings from `before` bytes ahead of the gram agree if both sides do; the start's number is off - before
            low, high = off[first + i] - behind[i], off[first + i] - (LENGTH - reach[i])
            low, high = np.maximum(low, 0), np.minimum(high, width[c])
            hit = (low <= high) & (np.arange(g) != i)
            for a, b in {*zip(low[hit].tolist(), high[hit].tolist(), strict=True)}:
                flags[c][a : b + 1] = True
        first += g


def _in_classes(group: list[int], names: list[tuple], width: np.ndarray, flags: list[np.ndarray]) -> None:
    """For each distance before the gram, strings whose two sides fall into one class of both orders repeat."""
    k, wide = len(group), width[group]
    data = np.frombuffer(b"".join(names[c][2] for c in group), np.uint8)
    off, size = np.array([names[c][1] for c in group]), wide + LENGTH
    place = np.cumsum(size) - size + off
    one = np.zeros(k, np.int64)
    ((right, after),) = _agreement(_matrix(data, place, size - off, 1), one)
    ((left, before),) = _agreement(_matrix(data, place + GRAM - 1, off + GRAM, -1), one)
    begin = np.cumsum(wide + 1) - (wide + 1)
    twice = np.zeros(int((wide + 1).sum()), bool)
    side = np.zeros((2, k), np.int64)
    for t in range(SPAN):  # bytes of the string before the gram
        mine = np.flatnonzero((t <= off) & (t >= off - wide))
        side[0, left] = np.concatenate([[0], np.cumsum(before < t + GRAM)])
        side[1, right] = np.concatenate([[0], np.cumsum(after < LENGTH - t)])
        _, which, times = np.unique(side[0, mine] * k + side[1, mine], return_inverse=True, return_counts=True)
        hit = mine[times[which] > 1]
        twice[begin[hit] + off[hit] - t] = True
    for c, a, w in zip(group, begin.tolist(), wide.tolist(), strict=True):
        flags[c] |= twice[a : a + w + 1]


class Block:
    """A block's texts with the representatives of all their strings."""

    def __init__(self, table: pa.Table, represent: bool = True):
        table = rounds.ordered(table)
        self.ids = table["doc_id"].to_pylist()
        self.data, self.offsets = text_buffer(table["text"].chunk(0) if len(table) else pa.array([], pa.string()))
        if not represent:
            return
        parts: list[list] = [[], [], [], [], []]
        echo = echoes(self.data, self.offsets)
        for a, b in self._pieces():
            inner = self.offsets[np.searchsorted(self.offsets, a, "left") : np.searchsorted(self.offsets, b, "right")]
            inner = np.unique(np.concatenate([[a], inner, [b]])) - a
            found = representatives(self.data[a:b], inner)
            echoed = np.concatenate([[0], np.cumsum(echo[a:b])])
            own = echoed[found[2] + 1] - echoed[found[1]] <= found[2] - found[1]
            for k, x in enumerate(found):
                parts[k].append(x[own] + a if k < 3 else x[own])
        self.place, self.first, self.last = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts[:3])
        self.grams, self.names = (np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts[3:])

    def _pieces(self):
        """Byte ranges of whole documents, or of a long one's parts, which share LENGTH - 1 bytes."""
        for i, j in chunks(self.offsets):
            a, b = int(self.offsets[i]), int(self.offsets[j])
            if b - a <= CHUNK_BYTES + LENGTH - 1:
                yield a, b
                continue
            for s in range(a, b - LENGTH + 1, CHUNK_BYTES):
                yield s, min(s + CHUNK_BYTES + LENGTH - 1, b)


def _gram_question(blk: int, table: pa.Table, bits: int) -> list[tuple]:
    """Stage 1: for each gram twice the number of its different stretches here, and one more if it occurs again here."""
    block = Block(table)
    at, _ = numbered(block.grams, block.names)
    keys, stretches = np.unique(block.grams[at], return_counts=True)
    times = np.unique(block.grams, return_counts=True)[1]
    return rounds.questions(blk, 1, bits, keys, (2 * stretches + (times > 1)).astype("<u4"))


def _how_often(keys: list[np.ndarray], loads: list[bytes], hot: int) -> list[bytes]:
    """0 once, 1 repeated, 2 with too many different stretches to gather."""
    which, bounds = rounds.grouped(keys)
    told = np.frombuffer(b"".join(loads), "<u4")
    again = (np.bincount(which) > 1) | (np.bincount(which, told & 1) > 0)
    code = (again.astype(np.uint8) + (np.bincount(which, told >> 1) > hot).astype(np.uint8) * again)[which]
    return [code[a:b].astype(np.uint8).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_HEAD = np.dtype([("off", "<u2"), ("span", "<u2"), ("count", "<u4")])
#: What stage 3 sends of a string: the second half of its digest, and how often it starts in the block.
_COUNTED = np.dtype([("second", "<u8"), ("count", "<u4")])


def _stretch_question(blk: int, table: pa.Table, answers: dict[int, bytes], bits: int) -> list[tuple]:
    """Stage 2: the distinct stretches around repeated grams; stage 3: digests of strings around hot ones."""
    block = Block(table)
    _, which = np.unique(block.grams, return_inverse=True)
    code = np.frombuffer(answers.get(1, b""), np.uint8)[which] if len(which) else np.zeros(0, np.uint8)
    mine = np.flatnonzero(code == 1)
    mine = mine[np.argsort(block.grams[mine], kind="stable")]
    first, last, gram, off = block.first[mine], block.last[mine], block.grams[mine], (block.place - block.first)[mine]
    raw = block.data.tobytes()
    known: dict[tuple[int, int, bytes], int] = {}
    item = np.array([known.setdefault((g, o, raw[a : b + LENGTH]), len(known)) for g, o, a, b in zip(gram.tolist(), off.tolist(), first.tolist(), last.tolist(), strict=True)], np.int64)
    heads = np.zeros(len(known), _HEAD)
    heads["off"], heads["span"], heads["count"] = [o for _, o, _ in known], [len(x) - LENGTH for *_, x in known], np.bincount(item, minlength=len(known))
    rows = rounds.questions(blk, 2, bits, np.array([g for g, *_ in known], np.uint64), [h.tobytes() + x for h, (*_, x) in zip(heads, known, strict=True)])
    hot = np.flatnonzero(code == 2)
    sizes = (block.last - block.first + 1)[hot]
    starts = np.repeat(block.first[hot] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    digest = lambda a: hashlib.blake2b(raw[a : a + LENGTH], digest_size=16).digest()
    halves = np.frombuffer(b"".join(map(digest, starts.tolist())), "<u8").reshape(-1, 2)
    at, number = numbered(halves[:, 0], halves[:, 1])
    load = np.zeros(len(at), _COUNTED)
    load["second"], load["count"] = halves[at, 1], np.bincount(number, minlength=len(at))
    rows += rounds.questions(blk, 3, bits, halves[at, 0], load)
    if len(mine) or len(hot):
        parts = np.array([len(mine), len(starts)]), first, last - first + 1, item, starts, number
        rows.append(rounds.note(blk, bits, b"".join(p.astype("<i8").tobytes() for p in parts)))
    return rows


def _sorted_out(keys: list[np.ndarray], loads: list[bytes], stages: list[int]) -> list[bytes]:
    out: list[bytes] = [b""] * len(keys)
    counted = [i for i, s in enumerate(stages) if s == 3]
    if counted:
        told = np.frombuffer(b"".join(loads[i] for i in counted), _COUNTED)
        which, bounds = rounds.grouped([keys[i] for i in counted], told["second"])
        again = (np.bincount(which, told["count"]) > 1)[which].astype(np.uint8)
        for k, i in enumerate(counted):
            out[i] = again[bounds[k] : bounds[k + 1]].tobytes()
    grams: list[int] = []
    off, span, count, stretch, where = [], [], [], [], []
    for i, stage in enumerate(stages):
        if stage == 2:
            at = 0
            for gram in keys[i].tolist():
                o, w, c = np.frombuffer(loads[i], _HEAD, 1, at)[0].item()
                at += _HEAD.itemsize
                grams.append(gram)
                off.append(o)
                span.append(w)
                count.append(c)
                stretch.append(loads[i][at : at + w + LENGTH])
                at += w + LENGTH
            where.append((i, len(grams)))
    if grams:
        flags = repeated_starts(grams, off, span, count, stretch)
        a = 0
        for i, b in where:
            out[i] = np.concatenate(flags[a:b]).astype(np.uint8).tobytes()
            a = b
    return out


def removed_bytes(block: Block, answers: dict[int, bytes]) -> np.ndarray:
    """For each byte of the block, whether it goes."""
    edge = np.zeros(len(block.data) + 1, np.int32)
    echo = np.flatnonzero(echoes(block.data, block.offsets))
    edge[echo] += 1
    edge[echo + LENGTH] -= 1
    told = np.frombuffer(answers.get(rounds.NOTE, b""), "<i8")
    if len(told):
        n, m = told[:2].tolist()
        first, size, item = told[2 : 2 + 3 * n].reshape(3, n)
        starts, number = told[2 + 3 * n :].reshape(2, m)
        flag = np.frombuffer(answers.get(2, b""), np.uint8)
        width = np.zeros(item.max(initial=-1) + 1, np.int64)
        width[item] = size
        begin = (np.cumsum(width) - width)[item]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        goes = flag[np.repeat(begin, size) + step].astype(bool) if n else np.zeros(0, bool)
        gone = [(np.repeat(first, size) + step)[goes], starts[np.frombuffer(answers.get(3, b""), np.uint8)[number].astype(bool)] if m else starts]
        gone = np.concatenate(gone)
        edge += np.bincount(gone, minlength=len(edge)).astype(np.int32)
        edge -= np.bincount(gone + LENGTH, minlength=len(edge)).astype(np.int32)
    return np.cumsum(edge)[:-1] > 0


OUT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def deduplicate(docs: DataFrame, kept: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; on request the kept bytes too.

    hot: different stretches of a gram from which on its strings are compared by digests.
    """
    docs, bits = rounds.blocks_of(docs)
    names = [n for n, _ in OUT if kept or n != "kept"]

    def finish(_, table, given):
        block = Block(table, represent=False)
        gone = removed_bytes(block, rounds.answered(given))
        rows = []
        for k, doc in enumerate(block.ids):
            a, b = block.offsets[k], block.offsets[k + 1]
            mine, data = gone[a:b], block.data[a:b]
            n = int(mine.sum())
            spans = int((mine[1:] & ~mine[:-1]).sum() + mine[:1].sum())
            left = (data[~mine] if n else data).tobytes()
            rows.append((doc, int(b - a), n, spans, hashlib.sha256(left).hexdigest(), *([left] if kept else [])))
        return rounds.rows_table(rows, names, [t for n, t in OUT if n in names])

    often = rounds.answer(rounds.ask(docs, lambda blk, t, _: _gram_question(blk, t, bits)), lambda keys, loads: _how_often(keys, loads, hot))
    around = rounds.answer(rounds.ask(docs, lambda blk, t, a: _stretch_question(blk, t, a, bits), often), _sorted_out, staged=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return docs.groupBy("blk").cogroup(around.groupBy("blk")).applyInArrow(finish, schema)
