"""Edit similarity of many pairs of texts at once, over arrays of character numbers."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd

#: So many cells of a table of common runs are held at once; a pair of texts with more of its own is matched by itself.
CELLS, MOST_CELLS = 1 << 23, 1 << 26
#: Characters are counted in so many buckets, and so many of the "holds at least k of bucket c" are multiplied.
BUCKETS, PLANES = 64, 256
#: Rows and columns of a product; pairs that are matched at once.
ROWS, COLUMNS, PAIRS = 512, 4096, 1 << 17


def character_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters of the texts one after the other as small numbers from 2 on, and where each text begins and how long it is."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(points.max(initial=0)) + 1, bool)
    known[points] = True
    numbers = np.cumsum(known) + 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return numbers.astype(np.uint8 if numbers[-1] < 256 else np.uint32)[points], np.cumsum(size) - size, size


def _longest(codes: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of the longest common run of each pair of spans, its place in a and in b; of several the first in a, then in b."""
    la, lb, n = int(na.max()), int(nb.max()), len(a)

    def spans(at: np.ndarray, size: np.ndarray, most: int, filler: int) -> np.ndarray:
        whole = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, most)[at].T)
        whole[np.arange(most)[:, None] >= size] = filler
        return whole

    left, right = spans(a, na, la, 0), spans(b, nb, lb, 1)
    kind = np.uint8 if min(la, lb) < 256 else np.uint32
    runs, best, end = np.empty((la, lb, n), kind), np.zeros(n, kind), np.zeros(n, np.int64)
    for i, row in enumerate(runs):  # row[j]: length of the common run that ends at i and j
        same = (right == left[i]).view(np.uint8)
        row[0] = same[0]
        if i:
            np.add(runs[i - 1, :-1], 1, out=row[1:])
            row[1:] *= same[1:]
        else:
            row[1:] = same[1:]
        most = row.max(0)
        end[most > best] = i
        np.maximum(best, most, out=best)
    size = best.astype(np.int64)
    return size, end - size + 1, runs[end, :, np.arange(n)].argmax(1) - size + 1


def matched_characters(codes: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
    """Characters that SequenceMatcher (without junk) matches in each pair of spans: begins ``a`` and ``b`` in ``codes``, lengths ``na`` and ``nb``.

    The longest common run is matched, then the parts before and after it, for all pairs level by level. Where a pair
    can't come to ``need`` any more it is left, with fewer than ``need`` found.
    """
    found, pair = np.zeros(len(a), np.int64), np.flatnonzero((na > 0) & (nb > 0))
    large = na * nb > MOST_CELLS
    for p in np.flatnonzero(large):
        blocks = SequenceMatcher(None, codes[a[p] : a[p] + na[p]].tolist(), codes[b[p] : b[p] + nb[p]].tolist(), autojunk=False).get_matching_blocks()
        found[p] = sum(x.size for x in blocks)
    pair = pair[~large[pair]]
    a, na, b, nb = (x[pair] for x in (a, na, b, nb))
    codes = np.append(codes, np.zeros(max(na.max(initial=0), nb.max(initial=0)), codes.dtype))  # spans are read at the length of the longest
    while len(pair):
        order = np.lexsort((nb, na))  # like lengths together, as the table has those of the longest
        pair, a, na, b, nb = (x[order] for x in (pair, a, na, b, nb))
        parts, at = [], 0
        while at < len(pair):
            stop = min(len(pair), at + max(1, CELLS // int(na[at] * nb[at])))
            while stop > at + 1 and int(na[stop - 1] * nb[at:stop].max()) * (stop - at) > CELLS:
                stop = at + max(1, min((stop - at) * 3 // 4, CELLS // int(na[at] * nb[at])))
            some = slice(at, stop)
            size, i, j = _longest(codes, a[some], na[some], b[some], nb[some])
            hit = np.flatnonzero(size)
            p, x, nx, y, ny, size, i, j = (v[hit] for v in (pair[some], a[some], na[some], b[some], nb[some], size, i, j))
            np.add.at(found, p, size)
            parts += [(p, x, i, y, j), (p, x + i + size, nx - i - size, y + j + size, ny - j - size)]
            at = stop
        pair, a, na, b, nb = (np.concatenate(x) for x in zip(*parts))
        left = (na > 0) & (nb > 0)
        if need is not None:
            left &= (found + np.bincount(pair[left], np.minimum(na, nb)[left], len(found)) >= need)[pair]
        pair, a, na, b, nb = (x[left] for x in (pair, a, na, b, nb))
    return found


def _bounds(codes: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices; where row x of the first times row y of the second is negative, the texts x and y stay below the threshold.

    A ratio r means at least r (la + lb) / 2 characters in common, counted with repeats. They are the planes ("holds at
    least k of bucket c") that both texts are in; of the planes that are left out, all of x count as common.
    """
    n = len(size)
    counts = np.bincount(np.repeat(np.arange(n) * BUCKETS, size) + codes % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)
    shares = np.array([(counts >= k).mean(0) for k in range(1, int(counts.max()) + 1)])
    k, c = np.nonzero(shares)
    chosen = np.argsort(-(shares * (1 - shares))[k, c], kind="stable")[:PLANES]
    planes = counts[:, c[chosen]] > k[chosen]
    one = np.ones((n, 1), np.float32)
    rest = size - planes.sum(1) - size * threshold / 2 + 1e-3 + 1e-5 * size.max()  # room for rounding
    return np.hstack([planes, rest[:, None], one]).astype(np.float32), np.hstack([planes, one, -size[:, None] * threshold / 2]).astype(np.float32)


def near_texts(keys: np.ndarray, texts: list[str], side: np.ndarray, threshold: float) -> Iterator[pd.DataFrame]:
    """``a``, ``b``, ``ratio`` of the pairs of a text of side 0 and one of side 1 (or of two of side 0, if there is no other) from the threshold on.

    The smaller key is ``a``, as the ratio may depend on the order.
    """
    order = np.lexsort((np.fromiter(map(len, texts), np.int64, len(texts)), side))
    keys, side = keys[order], side[order]
    codes, at, size = character_numbers([texts[i] for i in order])
    first, second = _bounds(codes, size, threshold)
    cut = int((side == 0).sum())
    alone = cut == len(side)

    def judged(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        turned = keys[y] < keys[x]
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        both = size[x] + size[y]
        ratio = 2.0 * matched_characters(codes, at[x], size[x], at[y], size[y], np.ceil(both * (threshold / 2) - 1e-9)) / both
        keep = (ratio >= threshold) & (keys[x] != keys[y])
        return pd.DataFrame({"a": keys[x[keep]], "b": keys[y[keep]], "ratio": ratio[keep]})

    held, many = [], 0
    for i in range(0, cut, ROWS):
        stop = min(i + ROWS, cut)
        for j in range(i if alone else cut, len(side), COLUMNS):
            if size[j] * threshold > size[stop - 1] * (2 - threshold) + 1e-6:
                break  # all from here on are too long
            x, y = np.divmod(np.flatnonzero(first[i:stop] @ second[j : j + COLUMNS].T >= 0), min(COLUMNS, len(side) - j))
            x, y = x + i, y + j
            held.append((x[x < y], y[x < y]))
            many += len(held[-1][0])
            while many >= PAIRS:
                x, y = (np.concatenate(v) for v in zip(*held))
                yield judged(x[:PAIRS], y[:PAIRS])
                held, many = [(x[PAIRS:], y[PAIRS:])], many - PAIRS
    if many:
        yield judged(*(np.concatenate(v) for v in zip(*held)))
