"""Periodic runs of words by an enhanced suffix array: branching tandem repeats of LCP intervals, rotated into runs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
import hashlib
from itertools import chain, count
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import batch_of, column_of, text_slices

EXPONENT = 4       # a run is at least this many periods long
LEAST_WORDS = 6    # and has at least this many words

RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])
RESULT_DDL = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


class SuffixArray:
    """Suffix array, inverse and LCP array of many word sequences at once.

    ``symbols`` holds all sequences one after the other and ``text`` the
    number of each one's sequence; a suffix ends with its sequence, and
    suffixes of different sequences are never alike. Ranks are refined by
    prefix doubling: ``levels[k][i]`` is the first place, in sorted order, of
    all suffixes that begin with the same 2^k words as ``i``; only places that
    are still shared are sorted again. A word takes about 16 bytes and 4 more for each
    doubling that its chunk needs.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray):
        n = self.n = symbols.size
        self.text = text
        kinds = int(symbols.max()) + 1 if n else 1
        order = np.argsort(text * kinds + symbols, kind="stable")
        keys = (text * kinds + symbols)[order]
        rank = np.empty(n + 1, dtype=np.int64)
        rank[n] = -1
        rank[order] = self._heads(keys)
        self.levels = [rank.astype(np.int32)]
        step, open_ = 1, np.arange(n)
        while True:
            shared = np.bincount(rank[:n], minlength=n)[rank[open_]] > 1
            open_ = open_[shared]
            if not open_.size:
                break
            beyond = np.minimum(open_ + step, n)
            here = text[np.minimum(beyond, n - 1)] == text[open_]
            after = np.where((open_ + step < n) & here, rank[beyond], -1)
            order = np.lexsort((after, rank[open_]))
            open_, after = open_[order], after[order]
            groups = rank[open_]
            first = np.flatnonzero(np.diff(groups, prepend=-1))
            place = np.arange(open_.size) - np.repeat(first, np.diff(first, append=open_.size)) + groups
            new = np.ones(open_.size, dtype=bool)
            new[1:] = (groups[1:] != groups[:-1]) | (after[1:] != after[:-1])
            starts = np.flatnonzero(new)
            rank = rank.copy()
            rank[open_] = np.repeat(place[starts], np.diff(starts, append=open_.size))
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.inverse = rank[:n]
        self.array = np.empty(n, dtype=np.int64)
        self.array[self.inverse] = np.arange(n)
        self.lcp = self._lcp()

    @staticmethod
    def _heads(keys: np.ndarray) -> np.ndarray:
        """For sorted keys, the place of the first equal one."""
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, dtype=np.int64)
        return np.repeat(first, np.diff(first, append=keys.size))

    def _lcp(self) -> np.ndarray:
        """``lcp[k]``: words that suffixes ``k - 1`` and ``k`` of the array have in common; 0 at the first."""
        lcp = np.zeros(self.n, dtype=np.int64)
        pairs = np.arange(1, self.n)
        highest = np.full(self.n, -1)
        for k, level in enumerate(self.levels):
            pairs = pairs[level[self.array[pairs - 1]] == level[self.array[pairs]]]
            highest[pairs] = k
        for k in range(len(self.levels) - 1, -1, -1):
            level, at = self.levels[k], np.flatnonzero(highest >= k)
            at = at[level[self.array[at - 1] + lcp[at]] == level[self.array[at] + lcp[at]]]
            lcp[at] += 1 << k
        return lcp

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``, ``a < b`` in one sequence: a rotation to the left for each."""
        moved = np.zeros(a.size, dtype=np.int64)
        first = np.searchsorted(self.text, self.text[a]) if a.size else a
        # Blocks of falling size; the largest may fit many times.
        for k in range(len(self.levels) - 1, -1, -1):
            level, size, at = self.levels[k], 1 << k, np.arange(a.size)
            while at.size:
                at = at[a[at] - moved[at] - size >= first[at]]
                at = at[level[a[at] - moved[at] - size] == level[b[at] - moved[at] - size]]
                moved[at] += size
                if k < len(self.levels) - 1:
                    break
        return moved


def next_not_above(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a value not above its own, or the size: steps of growing, then falling powers of two."""
    n = values.size
    out = np.arange(1, n + 1)
    low = [values]
    at = np.flatnonzero(values > 0)     # an interval of depth 0 is nobody's
    at = at[(out[at] < n) & (values[np.minimum(out[at], n - 1)] > values[at])]
    moving, k = at, 0
    while moving.size:
        if k == len(low):
            half = low[-1]
            low.append(np.minimum(half[: n - (1 << k) + 1], half[(1 << (k - 1)) :]) if n >= 1 << k else np.zeros(0, dtype=values.dtype))
        fits = out[moving] + (1 << k) <= n
        moving = moving[fits]
        moving = moving[low[k][out[moving]] > values[moving]]
        out[moving] += 1 << k
        k += 1
    for j in range(len(low) - 1, -1, -1):
        some = at[out[at] + (1 << j) <= n]
        some = some[low[j][out[some]] > values[some]]
        out[some] += 1 << j
    return out


def branching_squares(suffixes: SuffixArray, least_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every branching square: the words at its end do not go on with the period.

    For each LCP interval of depth p, each suffix i of all child intervals but
    the largest asks the inverse array if i + p or i - p lies in the interval,
    in another child. Intervals of under ``least_size`` suffixes are left out.
    """
    lcp, n = suffixes.lcp, suffixes.n
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return none, none
    after = next_not_above(lcp)                                     # a child that starts at k ends before after[k]
    before = n - 1 - next_not_above(lcp[::-1])[::-1]
    bounds = np.flatnonzero(lcp > 0)                                # a place where two children of an interval meet
    # Bounds of one interval point to the first of them; the left end is where a smaller value stands before it.
    first = np.arange(n)
    linked = bounds[lcp[before[bounds]] == lcp[bounds]]
    first[linked] = before[linked]
    while True:
        further = first[first]
        if np.array_equal(further, first):
            break
        first = further
    heads = bounds[first[bounds] == bounds]
    right = np.zeros(n, dtype=np.int64)
    np.maximum.at(right, first[bounds], after[bounds])
    large = right[first[bounds]] - before[first[bounds]] >= least_size
    heads, bounds = heads[right[heads] - before[heads] >= least_size], bounds[large]
    if not heads.size:
        return none, none
    head = np.concatenate([heads, first[bounds]])                   # children: the leftmost, and one from each bound
    begin = np.concatenate([before[heads], bounds])
    end = np.concatenate([heads, after[bounds]])
    order = np.lexsort((end - begin, head))
    largest = np.zeros(order.size, dtype=bool)
    largest[order[np.append(np.diff(head[order]) != 0, True)]] = True
    head, begin, end = head[~largest], begin[~largest], end[~largest]
    sizes = end - begin
    member = np.repeat(begin - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    head, begin, end = (np.repeat(x, sizes) for x in (head, begin, end))
    depth, here = lcp[head], suffixes.array[member]
    starts, periods = [], []
    for sign in (1, -1):
        other = here + sign * depth
        inside = (other >= 0) & (other < n)
        place = suffixes.inverse[np.where(inside, other, 0)]
        square = inside & (place >= before[head]) & (place < right[head]) & ((place < begin) | (place >= end))
        starts.append(np.minimum(here, other)[square])
        periods.append(depth[square])
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(symbols: np.ndarray, text: np.ndarray, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (sequence, start, length, period), by sequence, start and period; starts count from the sequence's beginning.

    The last ``exponent`` periods of a run with period p begin with the same p words, so the
    interval of depth p with its last square has as many suffixes; smaller ones are left out.
    """
    if not symbols.size:
        return np.zeros((0, 4), dtype=np.int64)
    suffixes = SuffixArray(symbols, text)
    start, period = branching_squares(suffixes, exponent)
    moved = suffixes.common_before(start, start + period)           # rotate each square to the left as far as it goes
    start, length = start - moved, 2 * period + moved
    long = length >= np.maximum(least, exponent * period)
    found = np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)
    # Squares of several periods make the same run; its smallest period comes first.
    same = np.append(False, (np.diff(found[:, 0]) == 0) & (np.diff(found[:, 1]) == 0)) if len(found) else np.zeros(0, dtype=bool)
    found = found[~same]
    sequence = text[found[:, 0]]
    found = np.column_stack([sequence, found[:, 0] - np.searchsorted(text, sequence), found[:, 1:]])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def repeated_words(key: str, words: list[bytes]) -> list[bytes]:
    """The words, or for one key in ten those with a stretch of the text repeated to its end, as the key's CRC says."""
    h = zlib.crc32(key.encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return (words[:a] + unit * (-(-(n - a) // p)))[:n]


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    if not len(runs):
        return doc_id, 0, None, None, None, None, _hex(b""), _hex(b" ".join(words))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    start, length, period = runs[np.lexsort((runs[:, 3], runs[:, 1], -runs[:, 2]))[0], 1:].tolist()
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs[:, 1:].tolist())
    return doc_id, len(runs), start, length, period, 1000 * length // period, _hex(listed.encode()), _hex(b" ".join([words[k] for k in kept]))


def repetitions(docs: DataFrame, *, planted: bool = False, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> DataFrame:
    """Per row: its periodic runs of words, the longest of them, and digests of all runs and of the text without repeats.

    A run is a longest stretch of words in which words one period apart are
    equal, with its smallest period and ``exponent`` periods and ``least``
    words at least; ``planted`` first repeats words in one document of ten.
    A word that any run holds beyond its first period falls out of the
    collapsed text. NULL and empty texts have no words and no runs, NULL ids
    count as the empty text. Every row is worked on by itself, repeated rows
    too, without a shuffle; texts of about a megabyte together share one
    suffix array, a longer text has its own. An empty table gives no row;
    other columns are ignored.
    """

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            ids, numbers = column_of(batch, "doc_id"), defaultdict(count().__next__)
            texts = [(t or b"").split() for t in column_of(batch, "text")]     # of bytes: the six ASCII blanks alone
            if planted:
                texts = [repeated_words("" if i is None else str(i), words) for i, words in zip(ids, texts, strict=True)]
            sizes = [len(words) for words in texts]
            symbols = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=sum(sizes))
            runs = find_runs(symbols, np.repeat(np.arange(len(texts)), sizes), exponent, least)
            cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            rows = [_row(i, words, runs[cut[k] : cut[k + 1]]) for k, (i, words) in enumerate(zip(ids, texts, strict=True))]
            yield batch_of(RESULT, **{f.name: [r[c] for r in rows] for c, f in enumerate(RESULT)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(worked, RESULT_DDL)
