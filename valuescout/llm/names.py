"""Names of token strings, computed many documents at a time with numpy.

A name is a number that equal strings share. Names of length 2h come from
pairs of names of length h (`doubled`); names of any length come from running
sums (`Running`). Both are used together, so that two different strings would
have to collide in two independent 64-bit families to be taken for equal.
"""

import ctypes
import functools

import numpy as np
import pyarrow as pa

U = np.uint64
_PLACE = U((1 << 28) - 1)  # low bits of a key that hold a place in the block
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK_TOKENS = 1 << 19
_POWER_STEP = 1 << 18


def _table(seed):
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


_BYTES = (_table(11), _table(29))


def mixed(x, y=None):
    """One well spread number from one or two; all arithmetic is modulo 2**64."""
    z = np.multiply(x, U(0xBF58476D1CE4E5B9))
    if y is not None:
        part = np.multiply(y, U(0x94D049BB133111EB))
        part += y >> U(29)
        z ^= part
    z ^= z >> U(31)
    z *= U(0xD6E8FEB86659FD93)
    z ^= z >> U(32)
    return z


def doubled(names, length, target):
    """Names of `target` tokens from names of `length`: pairs at offsets that
    grow twofold. Entry p names the tokens from p on; the last target - length
    entries of the input have no successor and are left out."""
    while length < target:
        step = min(length, target - length)
        names = mixed(names[: len(names) - step], names[step:]) if step < len(names) else names[:0]
        length += step
    return names


class Running:
    """Names of any slice of a token array, from running sums of powers."""

    _powers = {}

    def __init__(self, tokens):
        up, self._down = self._power(len(tokens) + 1)
        self._sums = np.zeros(len(tokens) + 1, U)
        np.cumsum(tokens * up[: len(tokens)], out=self._sums[1:])

    @classmethod
    def _power(cls, n):
        if cls._powers.get("n", 0) < n:
            n = -(-n // _POWER_STEP) * _POWER_STEP
            up, down = np.full(n, U(_BASE)), np.full(n, U(_BASE_INVERSE))
            up[0] = down[0] = 1
            if n > 1 << 22:  # a single huge document: do not keep its powers
                return np.cumprod(up), np.cumprod(down)
            cls._powers = {"n": n, "up": np.cumprod(up), "down": np.cumprod(down)}
        return cls._powers["up"], cls._powers["down"]

    def names(self, start, stop):
        total = (self._sums[stop] - self._sums[start]) * self._down[start]
        return mixed(total, (stop - start).astype(U))


class ByteTokens:
    """The UTF-8 bytes of a block of texts as tokens."""

    least_window = 32  # a quarter of a window is named from eight bytes on

    def __init__(self, raw):
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        eight, length = data.astype(U), 1
        while length < 8 and len(eight) > length:  # eight bytes are their own name
            eight = eight[:-length] | (eight[length:] << U(8 * length))
            length *= 2
        self._eight = eight if length == 8 else eight[:0]
        self.running = Running(_BYTES[0][data])

    def grams(self, k):
        return doubled(self._eight, 8, k)


class WordTokens:
    """The words of a block of texts: runs without space, tab, CR, LF, VT, FF."""

    least_window = 4

    def __init__(self, raw):
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.stop = edge[::2], edge[1::2]
        self.data = data
        begins = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.first = np.searchsorted(self.start, begins)
        self.names = Running(_BYTES[0][data]).names(self.start, self.stop)
        self.running = Running(Running(_BYTES[1][data]).names(self.start, self.stop))

    def grams(self, k):
        return doubled(self.names, 1, k)


def blocks(ids, texts, size=BLOCK_TOKENS):
    """Lists of ids and UTF-8 texts of about `size` bytes; null texts are empty."""
    some, raw, total = [], [], 0
    for i, text in zip(ids, texts):
        data = b"" if text is None else text.encode() if isinstance(text, str) else text
        some.append(i)
        raw.append(data)
        total += len(data)
        if total >= size:
            yield some, raw
            some, raw, total = [], [], 0
    if some:
        yield some, raw


def lazily(column):
    """The values of an Arrow column, each made when it is asked for."""
    return (value.as_py() for value in column)


def give_back():
    """Return freed memory to the system: Python workers outlive their tasks,
    and what one stage has freed would count beside the next one's needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def tidily(function):
    """The same generator function; when it has ended, its memory is returned."""

    @functools.wraps(function)
    def run(*args):
        yield from function(*args)
        give_back()

    return run


def _sliding_min(x, width):
    cover = 1
    while 2 * cover <= width:
        x = np.minimum(x[:-cover], x[cover:])
        cover *= 2
    return np.minimum(x[: len(x) - (width - cover)], x[width - cover :]) if cover < width else x


def anchored(grams, first, n, k):
    """Split all windows of `n` tokens by their anchor, the least k-gram inside.

    Equal windows have equal anchors at equal places, so windows can be
    compared anchor by anchor. Consecutive windows with the same anchor form a
    span. Returns document number, first and last window start, and anchor
    place of each span, in order; places count from the start of the block.
    """
    none = np.zeros(0, np.int64)
    total = int(first[-1])
    if total < n:
        return none, none, none, none
    least = grams & ~_PLACE
    least |= np.arange(len(grams), dtype=U)
    least = _sliding_min(least, n - k + 1)[: total - n + 1]
    least &= _PLACE
    anchor = least.astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for start, stop in zip(first[:-1].tolist(), first[1:].tolist()):
        valid[max(start, stop - n + 1) : stop] = False  # a window would leave its document
    # no document begins right after a valid place, so that spans end with them
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new & valid)
    if not len(lo):
        return none, none, none, none
    last = np.ones(len(anchor), bool)
    last[:-1] = new[1:] | ~valid[1:]
    hi = np.flatnonzero(last & valid)
    doc = np.searchsorted(first, lo, side="right") - 1
    return doc, lo, hi, anchor[lo]


def sorted_by(name, *others):
    """Order of rows by name, then by the others, the last one first.

    Most names stand alone, so only rows that share one are sorted further.
    """
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    same = np.zeros(len(order), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:].copy()
    rows = order[same]
    order[same] = rows[np.lexsort((*[x[rows] for x in others], name[rows]))]
    return order
