"""Suffix-array dedup: every byte covered by a `length`-byte string of a document with a smaller id goes.

Strings that occur twice are found by threshold-bounded interval expansion. On a Burrows-Wheeler
transform, intervals of suffixes with a common prefix are extended backward by one byte at a time,
breadth-first, so the longest common prefixes of neighbouring suffixes come out by increasing value;
the expansion stops at the minimum length, and neighbours without a value by then share a string of it.

The corpus is cut so that no task holds more than a few MB. Of each string of `length` bytes, the anchor
is the ANCHOR-byte substring with the least hash (the first of equals): equal strings have equal anchors
at equal places. Documents are dealt to blocks, and blocks talk to buckets (of anchors) in packed messages:

1. each block sends the hashes of its anchors; buckets answer with those that two documents hold;
2. each block cuts the pieces around such anchors (all strings that have them), each distinct one once,
   and sends them to the anchor's bucket, with the smallest document that holds them; there the
   transform finds the equal strings among the pieces, and the smallest document of each is the answer
   (strings whose hash occurs once in the bucket have no equal and don't enter the transform);
3. each block marks the bytes covered.

Exact copies are one entry: only the smallest id of equal texts is searched. An anchor that over `hot`
documents hold is not one group: its strings are sent one by one, each to a bucket of its own hash. So a
passage in a third of all documents costs each bucket one message per block.

Null text is empty. A null id counts as larger than any other. Rows that agree in id and text get the same
result, and rows of one id never match each other. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored

LENGTH, ANCHOR, HOT = 50, 20, 2000
BLOCK_BYTES, BUCKET_BYTES, SUBS = 2 << 20, 2 << 20, 8
LAST = (1 << 63) - 1
#: Bytes that UTF-8 never has: between pieces, and at the end.
_GAP, _END = 0xFF, 0xFE
_CHUNK, _GATHERED = 1 << 15, 4 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_PLACES = np.arange(_CHUNK + (1 << 10), dtype=np.uint64)
_MESSAGE = "block int, bucket int, a binary, b binary, c binary, d binary"
_NAMES = ["block", "bucket", "a", "b", "c", "d"]


# ---------------------------------------------------------------- interval expansion


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first 64 bytes; text ends with a byte that it has nowhere else."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    width = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(ranked[1:] != ranked[:-1], out=new[1:])
        if width >= 64 or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1 if width < n else 0
        width *= 2


def unset_at(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether suffix i in the order shares `length` bytes with the one before it, by interval expansion.

    A queue holds intervals of suffixes with a common prefix of `depth` bytes. Each is extended backward by
    every byte that precedes it; where the end of an extended interval has no common prefix yet, it is `depth`."""
    n = len(text)
    before = text[order - 1]
    step = np.empty(n, np.int64)  # from a suffix to the one that is longer by the byte before it
    step[np.argsort(before, kind="stable")] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n])
    owner = np.empty(n, np.int64)
    first = True
    for _ in range(length):
        sizes = high - low
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) - np.repeat(ends - sizes - low, sizes)
        to = step[rows]
        owner[to] = np.repeat(np.arange(len(low)), sizes)
        to.sort()
        cut = np.empty(len(to), bool)
        cut[0] = True
        own, byte = owner[to], text[order[to]]
        cut[1:] = (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (byte[1:] != byte[:-1])
        starts = np.flatnonzero(cut)
        low, high = to[starts], to[np.append(starts[1:], len(to)) - 1] + 1
        fresh = unset[high] | (first & (high == n))
        first = False
        unset[high] = False
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    return unset[:n]


def smallest_holder(pieces: list[bytes], holders: np.ndarray, length: int) -> np.ndarray:
    """For each `length`-byte string of each piece, in order, the smallest holder of any piece that has it."""
    text = np.frombuffer(bytes([_GAP]).join(pieces) + bytes([_GAP, _END]), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    counts = sizes - (length - 1)
    total = int(counts.sum())
    places = np.arange(total) - np.repeat(np.cumsum(counts) - counts - begins, counts)
    order = sorted_suffixes(text)
    group = np.cumsum(~unset_at(text, order, length)) - 1
    of = np.empty(len(text), np.int64)
    of[order] = group
    mine = of[places]
    least = np.full(int(group[-1]) + 1, LAST, np.int64)
    np.minimum.at(least, mine, np.repeat(holders, counts))
    return least[mine]


# ---------------------------------------------------------------- anchors


def _rolled(buf: np.ndarray, n: int, width: int) -> np.ndarray:
    """A number for each of the first n substrings of `width` bytes in buf, equal for equal ones: eight bytes at a time."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(n + max(0, width - 8), np.uint64, padded, strides=(1,)).copy()
    if width < 8:
        eight &= np.uint64((1 << 8 * width) - 1)
    whole = eight[:n].copy()
    for at in [*range(8, width - 7, 8), *([width - 8] if width > 8 and width % 8 else [])]:
        whole *= _MIX[0]
        whole += eight[at : at + n]
    return whole


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[3]
    h = (h ^ (h >> np.uint64(33))) * _MIX[4]
    return h ^ (h >> np.uint64(32))


def anchored(buf: np.ndarray, sizes: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, id): runs of consecutive strings of documents (of the given sizes, end to end in buf) with one anchor."""
    w = length - anchor + 1
    ends = np.cumsum(sizes)
    whole_string = np.ones(len(buf), bool)
    whole_string[np.maximum(ends[:, None] - np.arange(1, length), (ends - sizes)[:, None])] = False
    out: list[list[np.ndarray]] = [[], [], []]
    for c in range(0, len(buf) - length + 1, _CHUNK):
        m = min(_CHUNK, len(buf) - length + 1 - c)
        whole = _rolled(buf[c : c + m + length - 1], m + w - 1, anchor)
        key = whole >> np.uint64(29)
        key ^= whole
        key *= _MIX[2]
        key &= np.uint64(0xFFFFFFFFFFF00000)
        key |= _PLACES[: len(key)] if len(key) <= len(_PLACES) else np.arange(len(key), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if w > span:
            key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
        # a key holds its place, so two are equal only for the same anchor
        cut, within = np.ones(m, bool), whole_string[c : c + m]
        cut[1:] = (key[1:m] != key[: m - 1]) | (within[1:] != within[:-1])
        cut = np.flatnonzero(cut)
        count, mine = np.diff(np.append(cut, m)), within[cut]
        cut = cut[mine]
        out[0].append(cut + c)
        out[1].append(count[mine])
        out[2].append(_mixed(whole[(key[cut] & np.uint64(0xFFFFF)).astype(np.int64)]))
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in out)


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, as many as its size, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, end to end, and where each begins and the last ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _distinct(buf: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The spans of buf with each distinct text once, in the order in which they come: the text of each span, and the texts."""
    which, texts, known, a, ends = [np.zeros(0, np.int64)], [pa.array([], pa.large_binary())], 0, 0, np.cumsum(sizes)
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + _GATHERED, "right")))
        offsets = np.concatenate(([0], np.cumsum(sizes[a:b]))).astype(np.int64)
        bodies = buf[_ragged(begins[a:b], sizes[a:b])]
        part = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(bodies)]).dictionary_encode()
        which.append(part.indices.to_numpy().astype(np.int64) + known)
        texts.append(part.dictionary)
        known, a = known + len(part.dictionary), b
    whole = pa.concat_arrays(texts).dictionary_encode()
    return whole.indices.to_numpy().astype(np.int64)[np.concatenate(which)], whole.dictionary


def _least(holders: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """The smallest holder of each of n texts."""
    out = np.full(n, LAST, np.int64)
    np.minimum.at(out, which, holders)
    return out


def _hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of `length` bytes in buf."""
    return _mixed(_rolled(buf, len(buf) - length + 1, length))


class Block:
    """The first copies among a block's documents that have `length` bytes, end to end, and their runs of anchors."""

    def __init__(self, docs: pa.Table, told: list[dict], length: int, anchor: int):
        self.first = {x["a"] for x in told if x["bucket"] < 0}
        # by key: a shuffle gives the rows in any order, and answers go by the order of pieces
        at = {key: i for i, key in enumerate(docs["key"].to_pylist()) if key in self.first}
        self.keys = sorted(at)
        bodies = docs["text"]
        texts = [np.frombuffer(bodies[at[key]].as_buffer(), np.uint8) for key in self.keys]
        self.ids = np.array([int.from_bytes(key[:8], "big", signed=True) for key in self.keys], np.int64)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.buf = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.start, self.count, self.id = anchored(self.buf, self.sizes, length, anchor)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.append(np.searchsorted(self.start, self.begins), len(self.start))))
        self.told = [x for x in told if x["bucket"] >= 0]

    def told_as(self, buckets: int) -> np.ndarray:
        """What stands for each anchor: its bucket, then 32 bits that the bucket is told."""
        return ((self.id % np.uint64(buckets)) << np.uint64(32)) | (self.id >> np.uint64(32))

    def pieces(self, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The runs around shared anchors: their indices, which of the texts to send stands for each (or for hot anchors, for its
        first string), where the texts of its strings are listed (-1 unless hot), and that list; then what is sent, each distinct
        text once: bytes, smallest holder, bucket, sub-bucket."""
        keys = [(np.uint64(x["bucket"]) << np.uint64(32)) | np.frombuffer(x["a"], np.uint32).astype(np.uint64) for x in self.told]
        keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
        hot = np.frombuffer(b"".join(x["b"] for x in self.told), np.uint8)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        mine = self.told_as(buckets)
        at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
        shared = np.flatnonzero(keys[at] == mine) if len(keys) else np.zeros(0, np.int64)
        sizes = self.count[shared] + length - 1
        which, texts = _distinct(self.buf, self.start[shared], sizes)
        least = _least(self.ids[self.doc[shared]], which, len(texts))
        of = np.empty(len(texts), np.int64)
        of[which] = shared
        is_hot = hot[at[of]].astype(bool)
        plain, split = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        data, offsets = _bytes_of(texts)
        n = np.diff(offsets)[split] - (length - 1)
        strings, each = _distinct(data, _ragged(offsets[split], n), np.full(int(n.sum()), length, np.int64))
        low = _least(np.repeat(least[split], n), strings, len(each))
        own = _hashes(_bytes_of(each)[0], length)[::length] if len(each) else np.zeros(0, np.uint64)
        h = np.concatenate((self.id[of[plain]], own))
        sent = pa.concat_arrays([texts.take(pa.array(plain)), each])
        stands, listed = np.empty(len(texts), np.int64), np.full(len(texts), -1, np.int64)
        stands[plain] = np.arange(len(plain))
        listed[split] = np.cumsum(n) - n
        strings = strings + len(plain)
        stands[split] = strings[listed[split]]
        as_int = lambda x: x.astype(np.int64)
        return shared, stands[which], listed[which], strings, sent, np.concatenate((least[plain], low)), as_int((h >> np.uint64(8)) % np.uint64(buckets)), as_int(h % np.uint64(SUBS))


def _rows(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_NAMES)


def _block_of(docs: pa.Table, right: pa.Table) -> int:
    return (docs if len(docs) else right)["block"][0].as_py()


# ---------------------------------------------------------------- what blocks and buckets do


def _say_anchors(docs, right, *, length, anchor, buckets):
    """1: a block's anchors, by bucket: a: 32-bit hashes, b: how many of its documents hold each (255 at most)."""
    block = Block(docs, right.to_pylist(), length, anchor)
    told = block.told_as(buckets)
    order = np.argsort(told, kind="stable")  # documents stay in order
    told, doc = told[order], block.doc[order]
    once = np.concatenate(([True], (told[1:] != told[:-1]) | (doc[1:] != doc[:-1])))[: len(told)]
    told = told[once]
    at = np.flatnonzero(np.concatenate(([True], told[1:] != told[:-1]))[: len(told)])
    times, told = np.minimum(np.diff(np.append(at, len(told))), 255).astype(np.uint8), told[at]
    ids, bucket = told.astype(np.uint32), (told >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)].tolist()
    me = _block_of(docs, right)
    return _rows([(me, int(bucket[i]), ids[i:j].tobytes(), times[i:j].tobytes(), b"", b"") for i, j in zip(cuts, [*cuts[1:], len(bucket)])])


def _answer_anchors(messages, *, hot):
    """A bucket's answer to each block: a: the hashes that two documents hold, b: whether over `hot` documents do."""
    rows = messages.to_pylist()
    parts = [np.frombuffer(x["a"], np.uint32) for x in rows]
    ids, at = np.unique(np.concatenate(parts), return_inverse=True)
    held = np.bincount(at, np.frombuffer(b"".join(x["b"] for x in rows), np.uint8))
    out, k = [], 0
    for x, part in zip(rows, parts, strict=True):
        mine = held[at[k : k + len(part)]]
        k += len(part)
        keep = mine > 1
        if keep.any():
            out.append((x["block"], x["bucket"], part[keep].tobytes(), (mine[keep] > hot).astype(np.uint8).tobytes(), b"", b""))
    return _rows(out)


def _say_pieces(docs, right, *, length, anchor, buckets):
    """2: a block's distinct pieces, by bucket: a: their bytes, b: sizes, c: smallest holders, d: sub-buckets."""
    block = Block(docs, right.to_pylist(), length, anchor)
    *_, texts, least, bucket, sub = block.pieces(buckets, length)
    order = np.argsort(bucket, kind="stable")
    data, offsets = _bytes_of(texts.take(pa.array(order)))
    sizes, least, sub, bucket = np.diff(offsets).astype(np.uint32), least[order], sub[order].astype(np.uint8), bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(bucket)].tolist()
    me = _block_of(docs, right)
    return _rows([(me, int(bucket[i]), data[offsets[i] : offsets[j]].tobytes(), sizes[i:j].tobytes(), least[i:j].tobytes(), sub[i:j].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(bucket)])])


def _holders_found(texts: pa.Array, holders: np.ndarray, length: int) -> np.ndarray:
    """For each `length`-byte string of each text, in order, the smallest holder of any text that has it. Strings whose hash no other has
    can't occur twice; the runs of the others are searched."""
    data, offsets = _bytes_of(texts)
    counts = np.diff(offsets) - (length - 1)
    found = np.repeat(holders, counts)
    h = _hashes(data, length)[_ragged(offsets[:-1], counts)]
    order = np.argsort(h)
    h = h[order]
    same = np.concatenate(([False], h[1:] == h[:-1], [False]))
    twice = np.zeros(len(h) + 1, bool)
    twice[order] = same[1:] | same[:-1]
    starts = np.zeros(len(h) + 1, bool)
    begins = np.cumsum(counts) - counts
    starts[begins] = True
    # runs of strings that may occur twice, none beyond its text
    first = np.flatnonzero(twice[:-1] & (starts[:-1] | ~np.concatenate(([False], twice[:-2]))))
    if len(first):
        last = np.flatnonzero(twice[:-1] & (starts[1:] | ~twice[1:] | (np.arange(1, len(h) + 1) == len(h))))
        of = np.searchsorted(begins, first, "right") - 1
        places = first - begins[of] + offsets[of]
        sizes = last - first + 1
        raw = data.tobytes()
        pieces = [raw[a : a + n] for a, n in zip(places.tolist(), (sizes + length - 1).tolist())]
        found[_ragged(first, sizes)] = smallest_holder(pieces, holders[of], length)
    return found


def _answer_pieces(messages, *, length):
    """A bucket's answer to each block: for each of its pieces a: the number of runs (none: the block knows as much),
    b: each run's strings, c: the smallest document that holds them."""
    rows = messages.to_pylist()
    sizes = [np.frombuffer(x["b"], np.uint32) for x in rows]
    ends = np.cumsum([len(x) for x in sizes])
    sizes = np.concatenate(sizes).astype(np.int64)
    said = np.frombuffer(b"".join(x["c"] for x in rows), np.int64)
    which, texts = _distinct(np.frombuffer(b"".join(x.pop("a") for x in rows), np.uint8), np.cumsum(sizes) - sizes, sizes)
    holders, subs = _least(said, which, len(texts)), np.empty(len(texts), np.uint8)
    subs[which] = np.frombuffer(b"".join(x["d"] for x in rows), np.uint8)
    n, first = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    run_sizes, run_values, known = [], [], 0
    whole = texts.nbytes <= BUCKET_BYTES // 8
    for s in [None] if whole else range(SUBS):
        own = np.arange(len(texts)) if s is None else np.flatnonzero(subs == s)
        if not len(own):
            continue
        mine = texts.take(pa.array(own))
        found = _holders_found(mine, holders[own], length)
        counts = np.diff(_bytes_of(mine)[1]) - (length - 1)
        begins = np.cumsum(counts) - counts
        cut = np.concatenate(([True], found[1:] != found[:-1]))
        cut[begins] = True
        cut = np.flatnonzero(cut)
        run_sizes.append(np.diff(np.append(cut, len(found))))
        run_values.append(found[cut])
        first[own] = np.searchsorted(cut, begins) + known
        n[own] = np.diff(np.append(first[own], known + len(cut)))
        known += len(cut)
    run_sizes, run_values = np.concatenate(run_sizes).astype(np.uint32), np.concatenate(run_values)
    out = []
    for x, a, b in zip(rows, [0, *ends.tolist()], ends.tolist()):
        mine = which[a:b]
        new = (n[mine] > 1) | (run_values[first[mine]] != said[a:b])
        if new.any():
            at = _ragged(first[mine[new]], n[mine[new]])
            out.append((x["block"], x["bucket"], np.where(new, n[mine], 0).astype(np.uint32).tobytes(), run_sizes[at].tobytes(), run_values[at].tobytes(), b""))
    return _rows(out)


def _mark(docs, right, *, length, anchor, buckets, texts_too):
    """3: every row of a block: what its text loses, and what is left of it if texts_too."""
    told = right.to_pylist()
    answers = {x["bucket"]: x for x in told if x["d"] is None}
    block = Block(docs, [x for x in told if x["d"] is not None], length, anchor)
    shared, stands, listed, strings, texts, least, bucket, _ = block.pieces(buckets, length)
    # the runs of each text that was sent: as the bucket says, else all of it is the smallest holder's that the block knows
    counts = np.diff(_bytes_of(texts)[1]) - (length - 1)
    order = np.argsort(bucket, kind="stable")
    n, size, value = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ordered = bucket[order]
    for b in np.unique(ordered).tolist():
        if x := answers.get(b):
            n[np.searchsorted(ordered, b) : np.searchsorted(ordered, b, "right")] = np.frombuffer(x["a"], np.uint32)
            size.append(np.frombuffer(x["b"], np.uint32).astype(np.int64))
            value.append(np.frombuffer(x["c"], np.int64))
    times = np.maximum(n, 1)
    run_size, run_value, told_of = np.repeat(counts[order], times), np.repeat(least[order], times), np.repeat(n > 0, times)
    run_size[told_of], run_value[told_of] = np.concatenate(size), np.concatenate(value)
    begin, first, n_runs = np.cumsum(times) - times, np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    first[order], n_runs[order] = begin, times
    run_begin = np.cumsum(run_size) - run_size
    covered = np.zeros(len(block.buf), bool)
    if len(shared):
        start, holder, count = block.start[shared], block.ids[block.doc[shared]], block.count[shared]
        hot = np.flatnonzero(listed >= 0)
        plain = np.flatnonzero(listed < 0)
        # the runs of each plain piece, then each string of the hot ones
        times = n_runs[stands[plain]]
        run, occ = _ragged(first[stands[plain]], times), np.repeat(plain, times)
        own = strings[_ragged(listed[hot], count[hot])]
        begin = np.concatenate((start[occ] + run_begin[run] - run_begin[first[stands[occ]]], _ragged(start[hot], count[hot])))
        long = np.concatenate((run_size[run], np.ones(len(own), np.int64)))
        value = np.concatenate((run_value[run], run_value[first[own]]))
        hit = value < np.concatenate((holder[occ], np.repeat(holder[hot], count[hot])))
        begin, end = begin[hit], (begin + long + length - 1)[hit]
        order = np.argsort(begin)
        begin, reach = begin[order], np.maximum.accumulate(end[order])
        cut = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))[: len(begin)]
        change = np.zeros(len(block.buf) + 1, np.int8)
        change[begin[cut]], change[reach[np.append(cut[1:], len(begin))[: len(cut)] - 1]] = 1, -1
        covered = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    found = {}
    for d, (key, a, n) in enumerate(zip(block.keys, block.begins.tolist(), block.sizes.tolist())):
        gone = covered[a : a + n]
        if gone.any():
            kept = block.buf[a : a + n][~gone].tobytes()
            found[key] = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    nothing = hashlib.sha256(b"").hexdigest()
    for key, text in zip(docs["key"].to_pylist(), docs["text"]):
        n = text.as_buffer().size
        if key in found:
            removed, spans, digest, kept = found[key]
        elif n >= length and key not in block.first:  # a copy of a smaller document's text
            removed, spans, digest, kept = n, 1, nothing, b""
        else:
            removed, spans, digest, kept = 0, 0, key[8:].hex(), text.as_buffer().to_pybytes() if texts_too else b""
        out["n_bytes"].append(n)
        out["n_removed"].append(removed)
        out["n_spans"].append(spans)
        out["kept_sha256"].append(digest)
        # bytes of a character that was cut are left out
        out["kept"].append(kept.decode("utf-8", "ignore") if texts_too else None)
    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
    return pa.table({"row": docs["row"], **{c: pa.array(v, types[c]) for c, v in out.items()}})


def _searched(docs: DataFrame, carried: Column, key: str, text: str, length: int, anchor: int, hot: int, block_bytes: int, bucket_bytes: int, texts_too: bool) -> DataFrame:
    """row (what is carried of each row), n_bytes, n_removed, n_spans, kept_sha256 and kept (null unless texts_too) of every row of docs."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), carried.alias("row"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    size = F.octet_length("text").cast("long")
    firsts = stored(rows.where(size >= length).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.sum(size).alias("bytes")), "firsts")
    total = firsts.agg(F.sum("bytes")).first()[0] or 0
    blocks, buckets = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / bucket_bytes))
    of = F.pmod(F.xxhash64("doc_id", "sha"), F.lit(blocks)).cast("int").alias("block")
    name = F.unhex(F.concat(F.lpad(F.hex("doc_id"), 16, "0"), "sha"))
    first = firsts.select(of, F.lit(-1).alias("bucket"), name.alias("a"), *[F.lit(b"").alias(x) for x in "bcd"])
    # one exchange of the texts serves all three passes; so what they tell each other is part of one plan
    dealt = rows.select(of, name.alias("key"), "text", "row").groupBy("block")
    o = {"length": length, "anchor": anchor, "buckets": buckets}
    said = dealt.cogroup(first.groupBy("block")).applyInArrow(lambda a, b: _say_anchors(a, b, **o), _MESSAGE)
    shared = said.groupBy("bucket").applyInArrow(lambda x: _answer_anchors(x, hot=hot), _MESSAGE)
    known = first.unionByName(shared)
    said = dealt.cogroup(known.groupBy("block")).applyInArrow(lambda a, b: _say_pieces(a, b, **o), _MESSAGE)
    answers = said.groupBy("bucket").applyInArrow(lambda x: _answer_pieces(x, length=length), _MESSAGE)
    answers = answers.withColumn("d", F.lit(None).cast("binary"))
    told = known.unionByName(answers).groupBy("block")
    long, string = T.LongType(), T.StringType()
    result = T.StructType([rows.schema["row"], *[T.StructField(c, t) for c, t in (("n_bytes", long), ("n_removed", long), ("n_spans", long), ("kept_sha256", string), ("kept", string))]])
    return dealt.cogroup(told).applyInArrow(lambda a, b: _mark(a, b, texts_too=texts_too, **o), result)


def suffix_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    length: bytes of the strings that count; anchor: less than that. hot: documents beyond which an anchor's
    strings are dealt out one by one. block_bytes, bucket_bytes: text that one task holds at once."""
    found = _searched(docs, F.struct(F.col(key).alias("id")), key, text, length, anchor, hot, block_bytes, bucket_bytes, False)
    return found.select(F.col("row.id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs, all columns, with what is kept of each text (null stays null). A character that a cut left in part goes too."""
    others = [c for c in docs.columns if c != text]
    carried = F.struct(F.col(text).isNull().alias("none"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))
    found = _searched(docs, carried, key, text, length, anchor, hot, block_bytes, bucket_bytes, True)
    kept = F.when(~F.col("row.none"), F.col("kept"))
    return found.select(*[kept.alias(c) if c == text else F.col(f"row.others.`{c}`").alias(c) for c in docs.columns])
