"""Attention-based multiple-instance quality classifier: a document is a bag of passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import batch_of, column_of, fold, hash_sample, text_slices, texts_of, whole_text
from sievemark.llm.spans import Words

PASSAGE_WORDS = 64
TRAINING_ROWS = 4_000
HELD_OUT_FOLD = 0
THRESHOLD = 0.3
EPOCHS = 300

FEATURES = (
    "log words", "word length", "short words", "long words", "letters", "capitals", "title words", "digits", "bangs",
    "stops", "symbols", "bars", "other marks", "same as previous", "distinct words", "most frequent word", "lines", "beyond ascii",
)

_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "\"'()[]-"]] = True


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[ends] - total[starts]).astype(np.float64)


def passages(texts: list[str], size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of ``size`` words and the text each belongs to, in order.

    A text without words is one passage of zeros.
    """
    words = Words([t.encode("utf-8", "surrogatepass") for t in texts])
    counts = np.diff(words.first)
    per_text = np.maximum(1, -(-counts // size))
    owner = np.repeat(np.arange(len(texts)), per_text)
    features = np.zeros((owner.size, len(FEATURES)))
    if not words.hash.size:
        return features, owner
    data = words.data
    within = np.arange(words.hash.size) - words.first[words.doc]
    begin = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    passage = begin[words.doc] + within // size
    filled, first_word = np.unique(passage, return_index=True)
    last_word = np.append(first_word[1:], words.hash.size) - 1
    a, b = words.start[first_word], words.end[last_word]
    n_words = (last_word - first_word + 1).astype(np.float64)
    n_bytes = np.maximum(b - a, 1).astype(np.float64)
    follows = np.concatenate([[0], data[:-1]])
    accented_upper = (follows == 0xC3) & (data >= 0x80) & (data <= 0x9E)
    upper = _UPPER[data] | accented_upper
    lower = _LOWER[data] | ((data >= 0x80) & ~accented_upper)
    n_upper, n_lower = _sums(upper, a, b), _sums(lower, a, b)
    length = words.end - words.start
    per_word = lambda flags: np.add.reduceat(flags.astype(np.float64), first_word) / n_words
    same = np.zeros(words.hash.size, dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((words.hash, passage))
    new = np.ones(words.hash.size, dtype=bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    runs = np.flatnonzero(new)
    run_length = np.diff(np.append(runs, words.hash.size))
    distinct = np.add.reduceat(new.astype(np.float64), first_word)
    run_owner = np.searchsorted(filled, passage[order][runs])
    frequent = np.zeros(filled.size)
    np.maximum.at(frequent, run_owner, run_length)
    columns = (
        np.log1p(n_words), per_word(length) / 10, per_word(length <= 3), per_word(length >= 15), (n_upper + n_lower) / n_bytes,
        n_upper / np.maximum(n_upper + n_lower, 1), per_word(upper[words.start]), _sums(_DIGIT[data], a, b) / n_words,
        _sums(data == ord("!"), a, b) / n_words, _sums(_STOP[data], a, b) / n_words, _sums(_SYMBOL[data], a, b) / n_words,
        _sums(data == ord("|"), a, b) / n_words, _sums(_MARK[data], a, b) / n_words, per_word(same), distinct / n_words,
        frequent / n_words, _sums(data == ord("\n"), a, b) / n_words, _sums(data >= 0x80, a, b) / n_bytes,
    )
    features[filled] = np.stack(columns, axis=1)
    return features, owner


def _segments(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Encoder, gated attention and output weights; a few hundred numbers."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def attend(self, features: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Forward pass: encodings, attention within each bag, weighted representations, probabilities."""
        w = self.weights
        starts = _segments(owner, n)
        x = (features - self.mean) / self.spread
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["attend"]), _sigmoid(h @ w["gate"])
        raw = (t * g) @ w["score"]
        raw = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
        attention = raw / np.add.reduceat(raw, starts)[owner]
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": attention, "z": z, "p": _sigmoid(z @ w["out"] + w["out_bias"][0])}

    def score(self, texts: list[str]) -> np.ndarray:
        features, owner = passages(texts)
        return self.attend(features, owner, len(texts))["p"]


def train(features: np.ndarray, owner: np.ndarray, labels: np.ndarray, width: int = 16, gates: int = 8,
          epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Fit by full-batch Adam on the bags' cross entropy. Only bag labels are used; attention is learned from them."""
    rng = np.random.default_rng(seed)
    d = features.shape[1]
    n = labels.size
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    spread = features.std(axis=0) if n else np.ones(d)
    share = min(max(labels.mean(), 0.01), 0.99) if n else 0.5
    model = AttentionModel(
        features.mean(axis=0) if n else np.zeros(d), np.where(spread > 1e-9, spread, 1.0),
        {"encode": draw(d, width), "encode_bias": np.zeros(width), "attend": draw(width, gates), "gate": draw(width, gates),
         "score": draw(gates), "out": np.zeros(width), "out_bias": np.array([np.log(share / (1 - share))])},
    )
    w = model.weights
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, (epochs if n else 0) + 1):
        f = model.attend(features, owner, n)
        error = (f["p"] - labels) / n
        dz = error[:, None] * w["out"]
        from_z = dz[owner]
        da = (from_z * f["h"]).sum(axis=1)
        mean_da = np.add.reduceat(f["a"] * da, _segments(owner, n))
        draw_score = f["a"] * (da - mean_da[owner])
        dt = draw_score[:, None] * w["score"] * f["g"] * (1 - f["t"] ** 2)
        dg = draw_score[:, None] * w["score"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * from_z + dt @ w["attend"].T + dg @ w["gate"].T
        de = dh * (1 - f["h"] ** 2)
        gradients = {
            "encode": f["x"].T @ de, "encode_bias": de.sum(axis=0), "attend": f["h"].T @ dt, "gate": f["h"].T @ dg,
            "score": (f["t"] * f["g"]).T @ draw_score, "out": f["z"].T @ error, "out_bias": np.array([error.sum()]),
        }
        for name, value in w.items():
            slope = gradients[name] + decay * value * (not name.endswith("bias"))
            first, second = moments[name]
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


BAG_DDL = "label int, features binary"
BAG = pa.schema([("label", pa.int32()), ("features", pa.binary())])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> AttentionModel:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    The sample is the documents with the smallest hashes of their id, so it
    is the same on every run; it bounds what the driver holds to ``rows``
    documents' passage features. Rows whose label is not 0 or 1 are not used. Without
    labelled rows every score is 0.5.
    """
    chosen = hash_sample(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
        .groupBy("doc_id").agg(F.max("label").alias("label")),
        "doc_id", rows,
    )

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = texts_of(part)
            features, owner = passages(texts)
            starts = [*_segments(owner, len(texts)), owner.size]
            yield batch_of(
                BAG, label=column_of(part, "label"),
                features=[features[a:b].astype("<f4").tobytes() for a, b in zip(starts, starts[1:], strict=False)],
            )

    # At most ``rows`` ids and labels are broadcast.
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    )
    found = [
        (r["label"], np.frombuffer(r["features"], dtype="<f4").reshape(-1, len(FEATURES)).astype(np.float64))
        for r in sample.mapInArrow(bags, BAG_DDL).collect()
    ]
    found.sort(key=lambda r: (r[0], r[1].shape[0], r[1].tobytes()))
    if not found:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0, dtype=int), np.zeros(0))
    owner = np.repeat(np.arange(len(found)), [r[1].shape[0] for r in found])
    return train(np.concatenate([r[1] for r in found]), owner, np.array([r[0] for r in found], dtype=np.float64))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only the text is read for the score."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield batch_of(SCORED, doc_id=column_of(part, "doc_id"), score=model.score(texts_of(part)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled training rows and score every document.

    NULL and empty texts are one empty passage and get a score like any
    other; repeated rows are scored alike; columns beyond ``doc_id`` and
    ``text`` are not read; an empty table gives no row.
    """
    return score(docs, fit(docs, labels))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier accepts, with all their columns."""
    model = fit(docs, labels)
    columns = docs.columns
    schema = docs.schema
    keep_at = THRESHOLD

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield part.filter(pa.array(model.score(texts_of(part)) >= keep_at))

    return docs.select(*columns).mapInArrow(kept, schema)
