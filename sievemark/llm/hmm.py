"""Hidden Markov language model trained by Baum-Welch counts summed over partitions.

A word has a class: the most frequent words one each, other words one of a
fixed number by their last bytes, the end of a text one. Hidden states emit
classes; a class emits its words in proportion to their smoothed counts. The
model therefore has a bounded number of parameters per state while its word
counts cover the whole training corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import batch_of, column_of, fold, hash_sample, row_numbers, text_slices, texts_of, whole_text
from sievemark.session import materialize

HELD_OUT_FOLD = 1
STATES = 12
HEAD_WORDS = 200_000
LEVELS = 8
OWN_CLASS = 4_096
TAIL_CLASSES = 2_048
TAIL_BYTES = 3
HEAD_WORD_BYTES = 64
END_CLASS = OWN_CLASS + TAIL_CLASSES
CLASSES = END_CLASS + 1
START_ROWS = 800
START_TOKENS = 512
START_ROUNDS = 10
ROUNDS = 2
COUNTER_WORDS = 300_000
BATCH_TOKENS = 400_000
SMOOTHING = 0.05


def words_of(text: str) -> list[bytes]:
    """Tokens without the end: ASCII letters in lower case, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return OWN_CLASS + zlib.crc32(word[-TAIL_BYTES:]) % TAIL_CLASSES


def _tail_class_column(word: Column) -> Column:
    from_byte = F.greatest(F.length(word) - (TAIL_BYTES - 1), F.lit(1))
    return (F.crc32(F.substring(word, from_byte, F.lit(TAIL_BYTES))) % TAIL_CLASSES + OWN_CLASS).cast("int")


# --- counts -------------------------------------------------------------------------------------------------------

COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training rows; the end of a text is not a row here."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()
        for part in text_slices(batches):
            for text in texts_of(part):
                counter.update(words_of(text))
            if len(counter) > COUNTER_WORDS:
                yield batch_of(COUNTS, word=list(counter), n=list(counter.values()))
                counter.clear()
        if counter:
            yield batch_of(COUNTS, word=list(counter), n=list(counter.values()))

    training = docs.filter(fold(F.col("doc_id")) != HELD_OUT_FOLD).select(whole_text().alias("text"))
    return training.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The most frequent words with counts and classes, corpus totals and class totals: bounded in size."""

    words: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    types: int
    ends: int
    class_counts: np.ndarray

    @property
    def divisor(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / self.divisor)

    def class_mass(self) -> np.ndarray:
        """Smoothed counts a class's words share, so that a class's words and its unknown word add to one.

        Only classes by last bytes can meet an unknown word, which counts a
        half. A class of one word gives it all its probability, and so does
        the end, which is itself unknown where there is no training row.
        """
        mass = self.class_counts.copy()
        mass[OWN_CLASS:END_CLASS] += 0.5
        if not self.ends:
            mass[END_CLASS] = 0.5
        return mass

    def log_class(self) -> np.ndarray:
        """log10 of each class's share; of no meaning for the classes no text can have."""
        mass = self.class_mass()
        return np.log10(np.where(mass > 0, mass, 1.0) / self.divisor)


def frequent(counts: DataFrame, most: int = HEAD_WORDS) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: all above a count that is found from a small histogram."""
    short = counts.filter(F.length("word") <= HEAD_WORD_BYTES).withColumn("level", F.floor(F.log2("n") * LEVELS))
    lowest, taken = None, 0
    for level, n in sorted(short.groupBy("level").count().collect(), reverse=True):
        taken += n
        if taken > most:
            break
        lowest = level
    if lowest is None:
        return []
    found = [(bytes(r["word"]), r["n"]) for r in short.filter(F.col("level") >= lowest).select("word", "n").collect()]
    return sorted(found, key=lambda w: (-w[1], w[0]))


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    """Collect what is bounded: ``HEAD_WORDS`` words of at most ``HEAD_WORD_BYTES`` bytes, and class totals."""
    head = frequent(counts)
    words = {w: k for k, (w, _) in enumerate(head)}
    classes = np.array([k if k < OWN_CLASS else tail_class(w) for k, (w, _) in enumerate(head)], dtype=np.uint16)
    totals = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    class_counts = np.zeros(CLASSES)
    by_tail = counts.groupBy(_tail_class_column(F.col("word")).alias("class")).agg(F.sum(F.col("n") + 0.5).alias("mass"))
    for r in by_tail.collect():
        class_counts[r["class"]] += r["mass"]
    for k, (w, n) in enumerate(head[:OWN_CLASS]):
        class_counts[tail_class(w)] -= n + 0.5
        class_counts[k] = n + 0.5
    class_counts[END_CLASS] = ends + 0.5 if ends else 0.0
    class_counts = np.maximum(class_counts, 0.0)
    return Lexicon(words, np.array([n for _, n in head], dtype=np.int64), classes, (totals["tokens"] or 0) + ends, (totals["types"] or 0) + bool(ends), ends, class_counts)


# --- encoding -----------------------------------------------------------------------------------------------------

ENCODED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_score", pa.float64()),
    ("classes", pa.binary()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
])
ENCODED_DDL = (
    "row long, doc_id long, n_tokens long, head_known long, head_score double, classes binary, rare array<binary>, times array<int>"
)


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """One row per document: class numbers of its tokens, the base score of its frequent words, its other words.

    The lexicon's word table is broadcast; its size is bounded by ``HEAD_WORDS``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_ = shared.value
        get, classes = lexicon_.words.get, lexicon_.classes
        base = lexicon_.log_base(lexicon_.counts)
        end_score = float(lexicon_.log_base(np.array([lexicon_.ends]))[0])
        numbers = row_numbers()
        for part in text_slices(batches):
            out: dict[str, list] = {f.name: [] for f in ENCODED}
            for doc_id, text in zip(column_of(part, "doc_id"), texts_of(part), strict=True):
                words = words_of(text)
                place = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
                rest = np.flatnonzero(place < 0)
                found = place[place >= 0]
                rare = Counter(words[i] for i in rest.tolist())
                codes = np.empty(len(words) + 1, dtype="<u2")
                codes[-1] = END_CLASS
                codes[:-1] = classes[place] if classes.size else 0
                codes[rest] = [tail_class(words[i]) for i in rest.tolist()]
                out["row"].append(next(numbers))
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(words) + 1)
                out["head_known"].append(found.size + (lexicon_.ends > 0))
                out["head_score"].append(float(base[found].sum()) + end_score)
                out["classes"].append(codes.tobytes())
                out["rare"].append(list(rare))
                out["times"].append(list(rare.values()))
            yield batch_of(ENCODED, **out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(encoded, ENCODED_DDL)


# --- Baum-Welch ---------------------------------------------------------------------------------------------------


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


def by_length(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences of falling length in batches of bounded tokens; a longer sequence is a batch of its own."""
    batch: list[np.ndarray] = []
    tokens = 0
    for s in sorted(sequences, key=len, reverse=True):
        if batch and tokens + len(s) > BATCH_TOKENS:
            yield batch
            batch, tokens = [], 0
        batch.append(s)
        tokens += len(s)
    if batch:
        yield batch


def laid_out(batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by position (all first tokens, all second ones, ...) and where each position begins."""
    lengths = np.array([len(s) for s in batch])
    active = np.bincount(lengths, minlength=lengths[0] + 1)[::-1].cumsum()[::-1][1:]
    begin = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(begin[-1], dtype=np.int64)
    for k, s in enumerate(batch):
        flat[begin[: len(s)] + k] = s
    return flat, begin


def forward(model: Hmm, flat: np.ndarray, begin: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Scaled forward recursion over a batch: log10 likelihoods, and if kept the scaled variables and scales."""
    n = int(begin[1])
    total = np.zeros(n)
    scaled = np.empty((flat.size, model.start.size)) if keep else None
    scales = np.empty(flat.size) if keep else np.empty(0)
    before = np.empty((0, 0))
    for t in range(begin.size - 1):
        a, b = begin[t], begin[t + 1]
        now = (model.start if t == 0 else before[: b - a] @ model.move) * model.emit[flat[a:b]]
        scale = now.sum(axis=1)
        before = now / scale[:, None]
        total[: b - a] += np.log10(scale)
        if scaled is not None:
            scaled[a:b] = before
            scales[a:b] = scale
    return total, scaled, scales


@dataclass
class Expected:
    """Expected counts; sums over sequences are sums of these."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def zero(states: int) -> Expected:
        return Expected(np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)))

    def add(self, model: Hmm, sequences: list[np.ndarray]) -> None:
        states = model.start.size
        for batch in by_length(sequences):
            flat, begin = laid_out(batch)
            _, alpha, scales = forward(model, flat, begin, keep=True)
            gamma = alpha
            later = np.ones((0, states))
            moved = np.zeros((states, states))
            for t in range(begin.size - 2, -1, -1):
                a, b = begin[t], begin[t + 1]
                beta = np.ones((b - a, states))
                if later.shape[0]:
                    k = later.shape[0]
                    weighted = later * model.emit[flat[b : b + k]] / scales[b : b + k, None]
                    beta[:k] = weighted @ model.move.T
                    moved += alpha[a : a + k].T @ weighted
                later = beta
                gamma[a:b] *= beta  # a position's scaled variables are not needed by earlier ones
            self.move += moved * model.move
            self.start += gamma[: begin[1]].sum(axis=0)
            for k in range(states):
                self.emit[:, k] += np.bincount(flat, weights=gamma[:, k], minlength=CLASSES)

    def model(self, prior: np.ndarray) -> Hmm:
        """Re-estimated parameters; emissions are smoothed towards the classes' shares."""
        start = self.start + 1e-2
        move = self.move + 1e-2
        weight = SMOOTHING * CLASSES
        emit = self.emit + weight * prior[:, None]
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(sequences: list[np.ndarray], prior: np.ndarray, states: int, rounds: int, seed: int = 11) -> Hmm:
    """Starting values by Baum-Welch on a bounded sample, from random responsibilities per sequence."""
    rng = np.random.default_rng(seed)
    counts = Expected.zero(states)
    stay = np.eye(states) * 20 + 1
    for s in sequences:
        share = rng.dirichlet(np.full(states, 0.3))
        counts.start += share
        counts.emit += np.bincount(s, minlength=CLASSES)[:, None] * share
        counts.move += stay * share[:, None]
    model = counts.model(prior)
    for _ in range(rounds if sequences else 0):
        counts = Expected.zero(states)
        counts.add(model, sequences)
        model = counts.model(prior)
    return model


PARTIAL = pa.schema([("kind", pa.int32()), ("state", pa.int32()), ("item", pa.int32()), ("n", pa.float64())])


def baum_welch(encoded: DataFrame, model: Hmm, prior: np.ndarray) -> Hmm:
    """One round over every training row: each task sums its expected counts, Spark sums the tasks'.

    What reaches the driver is one number per state and state, and per state and class.
    """
    states = model.start.size

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Expected.zero(states)
        waiting: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            for codes in column_of(batch, "classes"):
                waiting.append(np.frombuffer(codes, dtype="<u2"))
                tokens += waiting[-1].size
                if tokens > BATCH_TOKENS:
                    counts.add(model, waiting)
                    waiting, tokens = [], 0
        if waiting:
            counts.add(model, waiting)
        for kind, table in enumerate((counts.start[:, None], counts.move, counts.emit.T)):
            state, item = np.nonzero(table)
            yield batch_of(PARTIAL, kind=np.full(state.size, kind), state=state, item=item, n=table[state, item])

    rows = encoded.filter(fold(F.col("doc_id")) != HELD_OUT_FOLD).select("classes")
    summed = rows.mapInArrow(expected, "kind int, state int, item int, n double").groupBy("kind", "state", "item").agg(F.sum("n").alias("n"))
    counts = Expected.zero(states)
    for r in summed.toArrow().to_pylist():
        if r["kind"] == 0:
            counts.start[r["state"]] = r["n"]
        elif r["kind"] == 1:
            counts.move[r["state"], r["item"]] = r["n"]
        else:
            counts.emit[r["item"], r["state"]] = r["n"]
    return counts.model(prior)


SCORED = pa.schema([("row", pa.int64()), ("class_score", pa.float64())])


def class_scores(encoded: DataFrame, model: Hmm, log_class: np.ndarray) -> DataFrame:
    """Per row, log10 of the exact likelihood of its classes, less log10 of the classes' shares."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(c, dtype="<u2") for c in column_of(batch, "classes")]
            order = sorted(range(len(codes)), key=lambda i: len(codes[i]), reverse=True)
            out = np.zeros(len(codes))
            done = 0
            for part in by_length(codes):
                flat, begin = laid_out(part)
                out[order[done : done + len(part)]] = forward(model, flat, begin, keep=False)[0]
                done += len(part)
            out -= [log_class[c].sum() for c in codes]
            yield batch_of(SCORED, row=column_of(batch, "row"), class_score=out)

    return encoded.select("row", "classes").mapInArrow(scored, "row long, class_score double")


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Base and model log10 probability of every document.

    Learned from the rows outside the held-out fold, all of them: word counts
    over all tokens, and ``rounds`` rounds of Baum-Welch over all sequences,
    started from a bounded sample (the ``START_ROWS`` first ids by hash among
    texts of at most ``START_TOKENS`` tokens). ``score`` is the base score,
    less the classes' shares, plus the exact likelihood of the class sequence
    by the scaled forward recursion: the log10 probability of the words and the end of
    the text under the whole model. Over all texts these probabilities add to
    one, with one unknown word for each class by last bytes. NULL text is empty: one token, the end.
    Repeated rows are separate documents. An empty table gives no row;
    without training rows only the unknown word has probability.
    """
    counts = materialize(word_counts(docs), "counts")
    ends = docs.filter(fold(F.col("doc_id")) != HELD_OUT_FOLD).count()
    lex = lexicon(counts, ends)
    encoded = materialize(encode(docs, lex), "encoded")
    prior = lex.class_mass() / lex.class_mass().sum()
    short = encoded.filter((fold(F.col("doc_id")) != HELD_OUT_FOLD) & (F.col("n_tokens") <= START_TOKENS)).select("row", "classes")
    sample = [np.frombuffer(r["classes"], dtype="<u2") for r in hash_sample(short, "row", START_ROWS).collect()]
    model = first_model(sample, prior, states, START_ROUNDS)
    for _ in range(rounds):
        model = baum_welch(encoded, model, prior)
    rare = (
        encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
        .select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    )
    n = F.coalesce("n", F.lit(0))
    rare_scores = (
        rare.join(counts, "word", "left")
        .select("row", F.when(n > 0, F.col("times")).otherwise(0).alias("known"),
                (F.col("times") * F.log10((n + 0.5) / F.lit(lex.divisor))).alias("score"))
        .groupBy("row").agg(F.sum("known").alias("rare_known"), F.sum("score").alias("rare_score"))
    )
    base = F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))
    return (
        encoded.select("row", "doc_id", "n_tokens", "head_known", "head_score")
        .join(class_scores(encoded, model, lex.log_class()), "row").join(rare_scores, "row", "left")
        .select(
            "doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "n_tokens",
            (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
            (base + F.col("class_score")).alias("score"),
        )
    )
