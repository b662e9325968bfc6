"""Fingerprints by prefix polynomial hashes over code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievemark.llm.common import batch_of, column_of, texts_of, whole_text
from sievemark.session import materialize

# A prime below 2^31 (products fit in 64 bits) and two bases.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 739_391_217)
SPAN = 32

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime; grown by doubling and kept."""
    have = _tables.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while have.size < n:
        have = np.concatenate([have, have * np.uint64(pow(base, have.size, PRIME)) % np.uint64(PRIME)])
    _tables[base] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHash:
    """Prefix arrays of one text: any span compares in constant time.

    ``sums[b][i]`` is the sum of (code + 1) * base^j over the first ``i`` code
    points, modulo the prime, for two bases. Two spans are equal when their
    sums agree after both are moved to the same power.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.n = codes.size
        shifted = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in BASES:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(shifted * powers(base, self.n) % np.uint64(PRIME), out=sums[1:])
            sums %= np.uint64(PRIME)
            self.sums.append(sums)

    def value(self) -> tuple[int, ...]:
        return tuple(int(s[-1]) for s in self.sums)

    def span_equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        for base, a, b in zip(BASES, self.sums, other.sums, strict=True):
            p = powers(base, max(i, j) + 1)
            left = (int(a[i + length]) - int(a[i])) * int(p[j]) % PRIME
            right = (int(b[j + length]) - int(b[j])) * int(p[i]) % PRIME
            if left != right:
                return False
        return True

    def common_prefix(self, i: int, other: PrefixHash, j: int, limit: int) -> int:
        """Length, at most ``limit``, of the longest common extension of two positions, by binary search."""
        low, high = 0, limit
        while low < high:
            middle = (low + high + 1) // 2
            if self.span_equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def common_suffix(self, i: int, other: PrefixHash, j: int, limit: int) -> int:
        """Length, at most ``limit``, of the longest common ending before two positions, by binary search."""
        low, high = 0, limit
        while low < high:
            middle = (low + high + 1) // 2
            if self.span_equal(i - middle, other, j - middle, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the spans at ``starts``, wherever they stand: inverse powers move each to power 0."""
        out = np.zeros(starts.size, dtype=np.uint64)
        for base, sums in zip(BASES, self.sums, strict=True):
            difference = (sums[starts + SPAN] + np.uint64(PRIME) - sums[starts]) % np.uint64(PRIME)
            inverse = powers(pow(base, -1, PRIME), self.n)[starts]
            out = (out << np.uint64(31)) | (difference * inverse % np.uint64(PRIME))
        return out

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places chosen by content alone, after a blank or at every eighth code, where a span fits, and their spans' hashes."""
        if self.n < SPAN:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        here = self.codes[: self.n - SPAN + 1]
        chosen = (here & np.uint32(7)) == 0
        chosen[1:] |= here[:-1] == 32
        starts = np.flatnonzero(chosen)
        return starts, self.spans(starts)

    def window(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchors whose spans lie in [low, high), and ``low`` itself."""
        if high - low < SPAN:
            return self.anchors[0][:0], self.anchors[1][:0]
        starts, hashes = self.anchors
        i, j = np.searchsorted(starts, [low, high - SPAN + 1])
        if i < j and starts[i] == low:
            return starts[i:j], hashes[i:j]
        first = np.array([low])
        return np.concatenate([first, starts[i:j]]), np.concatenate([self.spans(first), hashes[i:j]])


def fingerprint(value: tuple[int, ...], n: int) -> str:
    """The number of code points and both hashes of the whole text: equal texts, equal fingerprints."""
    return f"{n:x}-" + "".join(f"{v:08x}" for v in value)


def among(some: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of ``some`` are among the sorted values."""
    at = np.searchsorted(sorted_values, some)
    return sorted_values[np.minimum(at, sorted_values.size - 1)] == some


def shared(a: PrefixHash, a_span: tuple[int, int], b: PrefixHash, b_span: tuple[int, int]) -> int:
    """Code points of both windows in spans, at anchors, that the other window has too."""
    (left, left_hash), (right, right_hash) = a.window(*a_span), b.window(*b_span)
    if not left.size or not right.size:
        return 0
    hits = among(left_hash, np.sort(right_hash))
    if not hits.any():
        return 0
    back = among(right_hash, np.sort(left_hash[hits]))
    return sum(int(np.minimum(np.diff(starts), SPAN).sum()) + SPAN for starts in (left[hits], right[back]))


def likeness(a: PrefixHash, b: PrefixHash) -> float:
    """Share of both texts that the other also has, from 0 to 1.

    The longest common beginning and ending count in full; between them, the
    code points that lie in a span of 32, taken at places chosen by content,
    which the other text has too. Two empty texts are 1.
    """
    if a.n == b.n and a.value() == b.value():
        return 1.0
    short = min(a.n, b.n)
    head = a.common_prefix(0, b, 0, short)
    tail = a.common_suffix(a.n, b, b.n, short - head)
    return (2 * (head + tail) + shared(a, (head, a.n - tail), b, (head, b.n - tail))) / (a.n + b.n)


def edited_value(own: PrefixHash, after: PrefixHash) -> tuple[int, ...]:
    """The edited text's value, from the sums of the two texts it is made of."""
    kept = own.n - own.n // 2
    taken = min(own.n // 2, after.n)
    return tuple(
        (int(a[kept]) + int(b[taken]) * pow(base, kept, PRIME)) % PRIME for base, a, b in zip(BASES, own.sums, after.sums, strict=True)
    )


def edited_likeness(own: PrefixHash, after: PrefixHash) -> float:
    """``likeness`` of a text and its edited text, which need not be hashed: beyond what it keeps it is a window of the next text."""
    kept = own.n - own.n // 2
    taken = min(own.n // 2, after.n)
    n = kept + taken
    if own.n == n and own.value() == edited_value(own, after):
        return 1.0
    more = own.common_prefix(kept, after, 0, taken)
    tail = own.common_suffix(own.n, after, taken, taken - more)
    middle = shared(own, (kept + more, own.n - tail), after, (more, taken - tail))
    return (2 * (kept + more + tail) + middle) / (own.n + n)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
RESULT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
OPEN = pa.schema([*RESULT, ("part", pa.int64()), ("role", pa.string()), ("text", pa.string())])
OPEN_DDL = RESULT_DDL + ", part long, role string, text string"


def compared(doc_id: int | None, text: str, own: PrefixHash, following: str, after: PrefixHash) -> dict:
    """A document's row, given the document that follows it."""
    edited = edited_text(text, following)
    return {
        "doc_id": doc_id, "n_chars": own.n,
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": fingerprint(own.value(), own.n), "edited_fingerprint": fingerprint(edited_value(own, after), len(edited)),
        "near_edited": edited_likeness(own, after), "near_next": likeness(own, after),
    }


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return batch_of(schema, **{f.name: [r.get(f.name) for r in rows] for f in schema})


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and their likeness.

    Documents follow each other by descending ``doc_id`` (NULL last; equal ids
    by text), and the first follows the last. Texts are range-partitioned once;
    a task compares neighbours as it reads them, and only each partition's
    first and last text are paired in a second step. NULL text counts as empty.
    A table of one row has itself as the next document; an empty table gives
    no row.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple[int | None, str, PrefixHash] | None = None
        for batch in batches:
            out = []
            for doc_id, text in zip(column_of(batch, "doc_id"), texts_of(batch), strict=True):
                own = PrefixHash(code_points(text))
                if last is None:
                    out.append({"doc_id": doc_id, "part": part, "role": "head", "text": text})
                else:
                    out.append(compared(*last, text, own) | {"part": part, "role": "row"})
                last = doc_id, text, own
            yield _rows(out, OPEN)
        if last is not None:
            yield _rows([{"doc_id": last[0], "part": part, "role": "tail", "text": last[1]}], OPEN)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([
                compared(doc_id, text, PrefixHash(code_points(text)), following, PrefixHash(code_points(following)))
                for doc_id, text, following in zip(column_of(batch, "doc_id"), texts_of(batch), texts_of(batch, "following"), strict=True)
            ], RESULT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"
    )
    walked = materialize(ordered.mapInArrow(walk, OPEN_DDL), "walked")
    # One number per partition: the part whose first text follows each part's last text.
    parts = walked.filter("role = 'head'").select("part")
    following = parts.select(
        "part",
        F.coalesce(
            F.lead("part").over(W.orderBy("part")),
            F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("next_part"),
    )
    heads = walked.filter("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    ends = (
        walked.filter("role = 'tail'").select("doc_id", "text", "part")
        .join(following, "part").join(heads, "next_part").select("doc_id", "text", "following")
    )
    done = walked.filter("role = 'row'").select(*[f.name for f in RESULT])
    return done.unionByName(ends.mapInArrow(join_ends, RESULT_DDL))
