"""One-permutation MinHash with optimal densification, many documents at a time."""

import numpy as np

from valuescout.llm.names import WordTokens, doubled, mixed

SHINGLE = 5
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(raw, size=SHINGLE):
    """Distinct shingle names of a block of texts, sorted by (text, name).

    Returns the number of the text and the name of each shingle, and per text
    the number of words. A text with fewer words than `size` has its whole
    word sequence as its one shingle; one without words has none.
    """
    tokens = WordTokens([r.translate(_LOWER) for r in raw])
    first, words = tokens.first, np.diff(tokens.first)
    grams = doubled(tokens.names, 1, size)
    text = np.repeat(np.arange(len(raw)), words)
    inside = np.arange(len(grams)) + size <= first[1:][text[: len(grams)]]
    short = np.flatnonzero((words > 0) & (words < size))
    whole = tokens.running.names(first[short], first[short + 1])
    text = np.concatenate([text[: len(grams)][inside], short])
    name = np.concatenate([grams[inside], mixed(whole, whole + _U(1))])
    order = np.argsort(text, kind="stable")
    text, name = text[order], name[order]
    edge = np.searchsorted(text, np.arange(len(raw) + 1))
    for start, stop in zip(edge, edge[1:]):
        name[start:stop].sort()
    new = np.ones(len(name), bool)
    new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
    return text[new], name[new], words


def set_keys(text, name, count):
    """Two independent 64-bit keys per set: equal sets have equal keys."""
    edge = np.searchsorted(text, np.arange(count + 1))
    keys = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(name, np.full(len(name), salt, _U)))])
        keys.append(mixed(total[edge[1:]] - total[edge[:-1]], np.diff(edge).astype(_U)))
    return keys, np.diff(edge)


def signatures(text, name, count, bins):
    """The least name per bin and text.

    One permutation deals the shingles to bins; names are well spread, so
    their order serves as the permutation. An empty bin copies the bin
    that its own fixed random order of bins reaches first among the filled
    ones, so that it agrees in two sets with probability equal to their
    similarity, independently of the other bins.
    """
    # `name` is sorted within each text, so is the cell, and firsts are least
    cell = text * bins + (((name >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    found = np.zeros(count * bins, _U)
    filled = np.zeros(count * bins, bool)
    found[cell[new]] = name[new]
    filled[cell[new]] = True
    found, filled = found.reshape(count, bins), filled.reshape(count, bins)
    out = found.copy()
    rng = np.random.Generator(np.random.PCG64(7))
    tries = np.stack([rng.permutation(bins) for _ in range(bins)], axis=1)
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for step in tries:
        if not len(row):
            break
        hit = filled[row, step[bin_]]
        out[row[hit], bin_[hit]] = found[row[hit], step[bin_[hit]]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def band_keys(signature, rows):
    """One key per band of `rows` bins; the band's number is part of it."""
    count, bins = signature.shape
    bands = signature.reshape(count, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=_U), bands.shape[:2])
    for r in range(rows):
        key = mixed(key, bands[:, :, r])
    return key
