"""Toxicity scores from a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of learned vectors for its hash and the hashes of its first four and five bytes, so inflected
forms share what their stem has taught. Filters over one, two and three words are max-pooled over the whole text and
weighed by a logistic layer. Hashes that few training texts hold have no vector, and every vector keeps a second hash, so
an unknown word counts as nothing instead of as whatever shares its slot.

Only the text is scored. The language serves to pick the threshold at which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanferry.llm.shipping import Shared
from spanferry.llm.words import Folding, flat_texts, mixed, owners

TRAINING_ROWS = 8_000  # labelled rows a model is fitted on, at most about this many
TRAINING_BYTES = 24_000_000  # and their texts together, at most about this much
LEAST_TEXTS = 3  # training texts that must hold a hash before it has a vector
SLOTS = 1 << 20
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 12
CHUNK_WORDS = 1 << 16
SLICE_BYTES = 1 << 20
DEFAULT_THRESHOLD = 0.7

_NOT_WORDS = np.array([b for b in range(128) if not chr(b).isalnum()], np.uint8)
_KINDS = (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three hashes per word of all texts, and the word each text begins at (one more than texts)."""
    folding = Folding(_NOT_WORDS)
    data, offsets = flat_texts(texts)
    begins, ends = folding.spans(data, offsets)
    found = [folding.hashes(data, begins, np.minimum(ends, begins + n) if n else ends) for n in (0, 4, 5)]
    return np.stack([mixed(h ^ np.uint64(k)) for h, k in zip(found, _KINDS)], axis=1), owners(offsets, begins)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE_BYTES``, one text at least."""
    lengths = np.cumsum(np.diff(flat_texts(texts)[1]))
    at = 0
    while at < len(texts):
        done = lengths[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lengths, done + SLICE_BYTES, side="right")))
        yield at, to
        at = to


def _all_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_features` of all texts, slice by slice: its intermediate arrays stay small."""
    parts, bounds, words = [], [np.zeros(1, np.int64)], 0
    for at, to in _slices(texts):
        features, begins = word_features(texts.slice(at, to - at))
        parts.append(features)
        bounds.append(begins[1:] + words)
        words += len(features)
    return np.concatenate(parts), np.concatenate(bounds)


@dataclass
class Model:
    """Weights, the slots of known hashes, and the threshold of each language."""

    slots: np.ndarray
    checks: np.ndarray
    vectors: np.ndarray
    filters: dict[int, np.ndarray]
    shifts: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, features: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for hashes; 0, a vector of zeros, for unknown ones."""
        out = np.empty(features.shape, self.slots.dtype)
        for a in range(0, len(features), CHUNK_WORDS):
            part = features[a : a + CHUNK_WORDS]
            rows = self.slots[(part & np.uint64(SLOTS - 1)).astype(np.int64)]
            out[a : a + CHUNK_WORDS] = np.where(self.checks[rows] == part, rows, 0)
        return out

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Max-pooled filter outputs, 0 at least, per text; long texts go chunk by chunk."""
        texts = len(bounds) - 1
        out = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(rows), CHUNK_WORDS):
            b = min(a + CHUNK_WORDS, len(rows))
            near = rows[a : b + max(WIDTHS) - 1]
            x = self.vectors[near[:, 0]]
            for k in range(1, near.shape[1]):
                x = x + self.vectors[near[:, k]]
            first = int(np.searchsorted(bounds, a, side="right")) - 1
            for at, width in enumerate(WIDTHS):
                n = min(b, len(rows) - width + 1) - a
                if n <= 0:
                    continue
                y = x[:n] @ self.filters[width][0]
                for j in range(1, width):
                    y += x[j : j + n] @ self.filters[width][j]
                y += self.shifts[width]
                columns = slice(at * FILTERS, (at + 1) * FILTERS)
                text = first
                cuts = np.clip(bounds[first:] - a, 0, n)
                stops = np.clip(bounds[first + 1 :] - width + 1 - a, 0, n)
                used = np.flatnonzero(stops > cuts[:-1])
                if not len(used):
                    continue
                # Windows that reach into the next text count for nobody.
                edges = np.stack([cuts[used], stops[used]], axis=1).ravel()
                y = np.concatenate([y, np.zeros((1, FILTERS), np.float32)])
                best = np.maximum.reduceat(y, edges, axis=0)[::2]
                out[text + used, columns] = np.maximum(out[text + used, columns], best)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score in 0 to 1 per text, whole texts; null counts as empty."""
        out = np.empty(len(texts))
        for at, to in _slices(texts):
            features, bounds = word_features(texts.slice(at, to - at))
            out[at:to] = _logistic(self.pooled(self.rows(features), bounds) @ self.weights + self.bias)
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(np.asarray(x, np.float64), -30, 30)))


def _vocabulary(features: np.ndarray, texts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and second hashes of the hashes that enough ``texts`` (one per word) hold at the words ``used``; the commoner of two in a slot stays."""
    once = []
    places = texts[used].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(features.shape[1]):
        # One entry for each hash and text: equal pairs have equal keys.
        column = features[used, k]
        once.append(column[np.unique(mixed(column + places), return_index=True)[1]])
    hashes, counts = np.unique(np.concatenate(once), return_counts=True)
    hashes, counts = hashes[counts >= LEAST_TEXTS], counts[counts >= LEAST_TEXTS]
    hashes = hashes[np.argsort(counts, kind="stable")]
    slots, checks = np.zeros(SLOTS, np.int32), np.zeros(len(hashes) + 1, np.uint64)
    slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)] = np.arange(1, len(hashes) + 1)
    checks[1:] = hashes
    return slots, checks


def train(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, use: np.ndarray, seed: int = 3, batch: int = 64) -> Model:
    """Fit a model on the texts ``use`` of those given as word features; Adam on the logistic loss, the same for the same rows."""
    draw = np.random.Generator(np.random.PCG64(seed))
    texts = np.repeat(np.arange(len(labels)), np.diff(bounds))
    used = np.isin(texts, use)
    slots, checks = _vocabulary(features, texts, used)
    del used, texts
    model = Model(
        slots, checks, np.zeros((len(checks), SIZE), np.float32),
        {w: draw.normal(0, 0.4, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.full(FILTERS, 0.05, np.float32) for w in WIDTHS},
        draw.normal(0, 0.4, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
    )
    rate = min(max(labels[use].mean(), 1e-3), 1 - 1e-3)
    bias = np.array([np.log(rate / (1 - rate))], np.float32)
    rows = model.rows(features)
    tensors = [*model.filters.values(), *model.shifts.values(), model.weights, bias]
    first, second = ([np.zeros_like(t) for t in tensors] for _ in range(2))
    vectors_first, vectors_second = np.zeros_like(model.vectors), np.zeros_like(model.vectors)
    steps_an_epoch = -(-len(use) // batch)
    epochs = int(np.clip(-(-900 // steps_an_epoch), 4, 60))
    step, steps = 0, epochs * steps_an_epoch
    for _ in range(epochs):
        order = draw.permutation(use)
        for a in range(0, len(order), batch):
            step += 1
            chosen = order[a : a + batch]
            spans = [(bounds[i], bounds[i + 1]) for i in chosen]
            known = np.concatenate([rows[s:e] for s, e in spans]).copy()
            if draw.random() < 0.5:
                known[:, 0] = 0  # learn from stems alone, too
            ends = np.cumsum([e - s for s, e in spans])
            x = model.vectors[known].sum(axis=1)
            pooled = np.zeros((len(chosen), len(WIDTHS) * FILTERS), np.float32)
            best = np.full(pooled.shape, -1, np.int64)
            for at, width in enumerate(WIDTHS):
                n = len(x) - width + 1
                if n <= 0:
                    continue
                y = sum(x[j : j + n] @ model.filters[width][j] for j in range(width)) + model.shifts[width]
                for i, (s, e) in enumerate(zip(np.r_[0, ends[:-1]], ends - width + 1)):
                    if e > s:
                        top = y[s:e].argmax(axis=0)
                        pooled[i, at * FILTERS : (at + 1) * FILTERS] = y[s + top, np.arange(FILTERS)]
                        best[i, at * FILTERS : (at + 1) * FILTERS] = s + top
            active = pooled > 0
            pooled *= active
            error = ((_logistic(pooled @ model.weights + bias[0]) - labels[chosen]) / len(chosen)).astype(np.float32)
            grads = [np.zeros_like(t) for t in tensors]
            grads[-2][:], grads[-1][0] = pooled.T @ error, error.sum()
            back = error[:, None] * model.weights[None, :] * active
            touched, pushes = [], []
            for at, width in enumerate(WIDTHS):
                i, f = np.nonzero(active[:, at * FILTERS : (at + 1) * FILTERS])
                g, place = back[i, at * FILTERS + f], best[i, at * FILTERS + f]
                grads[len(WIDTHS) + at] += np.bincount(f, g, FILTERS).astype(np.float32)
                for j in range(width):
                    one_hot = np.zeros((len(f), FILTERS), np.float32)
                    one_hot[np.arange(len(f)), f] = g
                    grads[at][j] += x[place + j].T @ one_hot
                    touched.append(known[place + j])
                    pushes.append(g[:, None] * model.filters[width][j][:, f].T)
            pace = 0.02 * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for t, g, m, v in zip(tensors, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                t -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            if touched:
                # Vectors move only where a filter looked: their moments rest in between.
                word_rows, where = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
                push = np.repeat(np.concatenate(pushes), known.shape[1], axis=0)
                g = np.stack([np.bincount(where, push[:, d], len(word_rows)) for d in range(SIZE)], axis=1).astype(np.float32)
                m = vectors_first[word_rows] = vectors_first[word_rows] * np.float32(0.9) + np.float32(0.1) * g
                v = vectors_second[word_rows] = vectors_second[word_rows] * np.float32(0.999) + np.float32(0.001) * g * g
                model.vectors[word_rows] -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
                model.vectors[0] = 0
    model.bias = float(bias[0])
    return model


def _boundary(logits: np.ndarray, labels: np.ndarray) -> float:
    """Where to cut: below the lowest text that the best F1 accepts, two thirds of the way to the next one."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    at = int(f1.argmax())
    return float(logits[order[at]] + 2 * logits[order[min(at + 1, len(order) - 1)]]) / 3


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1, midway to the next lower score; the default where a language has one class only."""
    if not 0 < labels.sum() < len(labels):
        return DEFAULT_THRESHOLD
    return float(np.clip(_boundary(scores, labels), 0.3, 0.9))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang",
        max_rows: int = TRAINING_ROWS, max_bytes: int = TRAINING_BYTES) -> Model | None:
    """A model from labelled rows; None when they do not hold both classes.

    Rows without a label are left out. At most about ``max_rows`` rows and ``max_bytes`` of text are
    used, picked by a hash of ``key``: the model's size and the work of the driver are bounded by them. Four in five fit the weights; the rest set the thresholds.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.col(lang).alias("l"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    share = min(1.0, max_rows / max(size["n"], 1), max_bytes / max(size["b"] or 1, 1))
    picked = rows.where(F.pmod(F.xxhash64("k", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("k", F.xxhash64("t"))
    table = picked.toArrow()
    labels = np.array(table["y"].to_pylist(), np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    features, bounds = _all_features(table["t"].combine_chunks())
    aside = np.arange(len(labels)) % 5 == 4
    kept = np.flatnonzero(~aside)
    if labels[kept].min() == labels[kept].max():
        kept = np.arange(len(labels))
    model = train(features, bounds, labels, kept)
    logits = model.pooled(model.rows(features), bounds) @ model.weights + model.bias
    if 0 < labels[aside].sum() < aside.sum():
        # A model of few rows is timid: raise all scores until the boundary found on the rows set aside is the default threshold.
        # A text without a known word stays below every threshold.
        room = max(np.log(0.25 / 0.75) - model.bias, 0)
        shift = np.clip(np.log(DEFAULT_THRESHOLD / (1 - DEFAULT_THRESHOLD)) - _boundary(logits[aside], labels[aside]), 0, room)
        model.bias += float(shift)
        logits = logits + shift
    scores = _logistic(logits)
    langs = np.array([x or "" for x in table["l"].to_pylist()])
    for name in np.unique(langs):
        mine = aside & (langs == name)
        model.thresholds[str(name)] = _threshold(scores[mine], labels[mine])
    return model


def score(model: Model | None, text: Column, spark) -> Column:
    """Score of a text, 0 to 1; without a model, 0. Null counts as empty."""
    if model is None:
        return F.lit(0.0)
    shared = Shared(spark, model)  # bounded by the training rows

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return scored(text)


def rejects(model: Model | None, score: Column, lang: Column) -> Column:
    """Whether a score reaches the threshold of its language; null and unknown languages use the default."""
    out = F.lit(DEFAULT_THRESHOLD)
    for name, threshold in (model.thresholds if model else {}).items():
        out = F.when(F.coalesce(lang, F.lit("")) == name, F.lit(threshold)).otherwise(out)
    return score >= out


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled documents that are not held out: ``doc_id, text, lang, toxic``, about ``max_rows`` of them.

    A document with several labels takes the highest; of rows that repeat an id one is used; null ids have no label.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = 1.0 if total <= max_rows else max_rows / total
    # Broadcast bound: max_rows ids.
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``rejected``, by a model fitted on ``labels`` outside the held-out rows.

    Every whole text is scored in one pass without a shuffle. Empty and null texts get the score of no words, repeated
    rows equal scores, an empty table no rows. Columns of these names are replaced; all others stay.
    """
    model = fit(training_rows(docs, labels))
    out = docs.withColumn("toxicity", score(model, F.col("text"), docs.sparkSession))
    return out.withColumn("rejected", rejects(model, F.col("toxicity"), F.col("lang")))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`score_documents` rejects; all columns and their names stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = score_documents(docs.select(row, "doc_id", "text", "lang"), labels)
    return scored.where("not rejected").select("_row.*")
