"""Sorted suffix runs: anchors of byte texts, front coding, and a merge that never compares a known common prefix again.

Every string of ``length`` bytes holds one anchor, the start of the ``GRAM``
bytes with the smallest hash in it, so equal strings hold it at the same place.
One suffix per anchor is sorted, not one per byte.  Its key is the text right of
the anchor, as far as a string with that anchor reaches, and then the text left
of it, backwards.  A key row is ``[right | left | lengths]``, padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import zstandard

GRAM = 8  # bytes of an anchor; fewer mean fewer anchors, but more chance companions
LEVEL = 9  # of zstd, for runs that are exchanged
CHUNK = 2 << 20  # bytes of text whose hashes are held at once, besides one text
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shape:
    """Sizes that follow from the length of the strings looked for."""

    def __init__(self, length: int):
        if not GRAM < length < GRAM + 63:  # the starts of an anchor fit in 63 bits
            raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 62}")
        self.length, self.window, self.left = length, length - GRAM + 1, length - GRAM
        self.width = length + self.left + 2
        self.sides = (slice(0, length), slice(length, self.width - 2))


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` neighbours."""
    low, span = values, 1
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = window - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _rows(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, width)[at]


def _anchors(texts: Sequence[bytes], shape: Shape) -> tuple[np.ndarray, ...]:
    """Keys, text number, first start and number of starts of every anchor of the texts, all at least ``length`` bytes long."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    total = len(data)
    padded = np.concatenate((data, np.zeros(shape.width + 8, np.uint8)))
    gram = np.ndarray(total, np.uint64, padded.data, 0, (1,)) * _A
    gram ^= gram >> np.uint64(29)
    gram *= _B
    packed = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(total, dtype=np.uint64)
    low = _smallest(packed, shape.window)
    starts = np.arange(total - shape.length + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = starts[starts + shape.length <= ends[owner[: len(starts)]]]
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    lo, hi, at = starts[first], starts[last], anchor[first]
    right, left = hi + shape.length - at, at - lo
    keys = np.zeros((len(at), shape.width), np.uint8)
    keys[:, : shape.length] = _rows(padded, at, shape.length)
    keys[:, : shape.length][np.arange(shape.length) >= right[:, None]] = 0
    back = np.concatenate((data[::-1], np.zeros(shape.left, np.uint8)))
    keys[:, shape.length : -2] = _rows(back, total - at, shape.left)
    keys[:, shape.length : -2][np.arange(shape.left) >= left[:, None]] = 0
    keys[:, -2], keys[:, -1] = right, left
    text = owner[at]
    return keys, text, lo - (ends - sizes)[text], hi - lo + 1


def anchors(texts: Sequence[bytes], shape: Shape) -> tuple[np.ndarray, ...]:
    """As ``_anchors`` for any texts, in chunks; shorter texts have none."""
    parts, chunk, size = [], [], 0
    for k, text in enumerate(texts):
        if len(text) >= shape.length:
            chunk.append(k)
            size += len(text)
        if size and (size >= CHUNK or k + 1 == len(texts)):
            keys, text_at, lo, n = _anchors([texts[i] for i in chunk], shape)
            parts.append((keys, np.array(chunk)[text_at], lo, n))
            chunk, size = [], 0
    if size:
        keys, text_at, lo, n = _anchors([texts[i] for i in chunk], shape)
        parts.append((keys, np.array(chunk)[text_at], lo, n))
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros((0, shape.width), np.uint8), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def places(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key: a hash of its anchor, so keys that share a string share a bucket."""
    h = np.ascontiguousarray(keys[:, :GRAM]).view(np.uint64)[:, 0] * _B
    h ^= h >> np.uint64(31)
    return ((h * _A >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def sort_order(keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bucket, key), and a rank that equal (bucket, key) share, in that order; eight bytes decide at a time, only where earlier ones tie."""
    n, width = keys.shape
    order = np.argsort(bucket, kind="stable")
    group = bucket[order]
    group = np.concatenate(([0], np.cumsum(group[1:] != group[:-1]))) if n else group
    tied = np.arange(n)
    for at in range(0, width, 8):
        same = np.zeros(len(tied), bool)
        step = group[tied[1:]] == group[tied[:-1]]
        same[1:] |= step
        same[:-1] |= step
        tied = tied[same]
        if not len(tied):
            break
        word = np.zeros((len(tied), 8), np.uint8)
        part = keys[order[tied], at : at + 8]
        word[:, : part.shape[1]] = part
        word = word.view(">u8")[:, 0].astype(np.uint64)
        new = np.lexsort((word, group[tied]))
        order[tied] = order[tied][new]
        word, old = word[new], group[tied]
        bump = np.zeros(n, np.int64)
        bump[tied[1:]] = (old[1:] == old[:-1]) & (word[1:] != word[:-1])
        fresh = np.concatenate(([0], (group[1:] != group[:-1]).astype(np.int64)))
        group = np.cumsum(fresh + bump)
    return order, group


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix that each sorted key shares with the one before it; 0 for the first."""
    out = np.zeros(len(keys), np.uint8)
    for at in range(1, len(keys), 1 << 16):
        end = min(len(keys), at + (1 << 16))
        differs = keys[at:end] != keys[at - 1 : end - 1]
        out[at:end] = np.where(differs.any(1), differs.argmax(1), keys.shape[1])
    return out


def _sent(lcp: np.ndarray, right: np.ndarray, left: np.ndarray, shape: Shape) -> np.ndarray:
    """Which bytes of the keys a front-coded run holds: those after the common prefix that are not padding."""
    column = np.arange(shape.width - 2, dtype=np.int16)
    edge = np.where(column < shape.length, right[:, None].astype(np.int16), shape.length + left[:, None].astype(np.int16))
    return (column >= lcp[:, None]) & (column < edge)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of whole numbers, so that equal high bytes lie together."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8")[:, 0].copy()



def pack_run(keys: np.ndarray, numbers: Sequence[np.ndarray], shape: Shape) -> list[bytes]:
    """A sorted run, front coded: [right tails, left tails, prefixes and lengths, one entry per array of numbers]."""
    z = zstandard.ZstdCompressor(level=LEVEL)
    lcp = common_prefixes(keys)
    tails: tuple[list, list] = ([], [])
    for at in range(0, len(keys), 1 << 16):
        part = keys[at : at + (1 << 16)]
        sent = _sent(lcp[at : at + (1 << 16)], part[:, -2], part[:, -1], shape)
        for side, columns in zip(tails, shape.sides):
            side.append(part[:, columns][sent[:, columns]].tobytes())
    sizes = np.stack((lcp, keys[:, -2], keys[:, -1])).tobytes()
    return [z.compress(x) for x in (*map(b"".join, tails), sizes, *map(_planes, numbers))]


def unpack_run(parts: Sequence[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys, common prefixes and numbers of a run."""
    z = zstandard.ZstdDecompressor()
    lcp, right, left = np.frombuffer(z.decompress(parts[2]), np.uint8).reshape(3, -1)
    n = len(lcp)
    keys = np.zeros((n, shape.width), np.uint8)
    keys[:, -2], keys[:, -1] = right, left
    for raw, columns in zip(parts, shape.sides):
        tails, at = np.frombuffer(z.decompress(raw), np.uint8), 0
        for first in range(0, n, 1 << 16):
            rows = slice(first, min(n, first + (1 << 16)))
            sent = _sent(lcp[rows], right[rows], left[rows], shape)[:, columns]
            count = int(sent.sum())
            part = keys[rows, columns]
            part[sent] = tails[at : at + count]
            keys[rows, columns] = part
            at += count
    order = np.arange(n)
    for column in range(shape.width - 2):
        source = np.maximum.accumulate(np.where(lcp <= column, order, 0))
        kept = source != order
        if kept.any():
            keys[kept, column] = keys[source[kept], column]
    column = np.arange(shape.length)
    for first in range(0, n, 1 << 16):  # what stands after a shorter key's end was not part of a shared prefix
        rows = slice(first, min(n, first + (1 << 16)))
        keys[rows, : shape.length][column >= right[rows, None]] = 0
        keys[rows, shape.length : -2][np.arange(shape.left) >= left[rows, None]] = 0
    return keys, lcp, [_unplanes(z.decompress(x)) for x in parts[3:]]


def merge_runs(runs: Sequence[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, row, common prefix with the row before) of all sorted runs (keys, common prefixes) in order, by a loser tree.

    Every waiting key knows its common prefix with the key sent last.  Of two
    keys the one with the longer prefix is the smaller; only equal prefixes make
    the bytes behind them compared, and the loser then knows its prefix with the
    winner.  Equal keys come in the order of the runs.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    keys = [r[0][0] if r[0] else None for r in runs] + [None] * (size - count)
    prefix = [0] * size
    row = [0] * size
    losers = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the prefix of the loser becomes its prefix with the winner."""
        a, b = keys[x], keys[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        p, q = prefix[x], prefix[y]
        if p > q:
            return x, y
        if q > p:
            return y, x
        if a[p:] == b[p:]:
            if x > y:
                x, y = y, x
            prefix[y] = len(a)
            return x, y
        while a[p] == b[p]:
            p += 1
        if a[p] < b[p]:
            prefix[y] = p
            return x, y
        prefix[x] = p
        return y, x

    winners = [0] * (2 * size)
    winners[size:] = range(size)
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while keys[top] is not None:
        at = row[top]
        yield top, at, prefix[top]
        source, shared = runs[top]
        at += 1
        row[top] = at
        if at < len(source):
            keys[top] = source[at]
            prefix[top] = shared[at]
        else:
            keys[top] = None
        node = (size + top) >> 1
        while node:
            other = losers[node]
            p, q = prefix[top], prefix[other]
            if keys[other] is not None and (keys[top] is None or p <= q):
                if keys[top] is None or p < q:
                    losers[node], top = top, other
                else:
                    top, losers[node] = play(top, other)
            node >>= 1
