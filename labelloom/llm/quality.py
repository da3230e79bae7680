"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Grades are ordered, P(grade <= j) = sigmoid(threshold_j - score), and all thresholds share one weight
vector, score = w . x. Features are hashed and present or absent: the words of a text, the shapes of its
words and their immediate repetitions by the share of the text that they pass, its length and variety. The
model gives the expected grade and the tail probability P(grade >= j) that selection uses.

Fitting takes a bounded sample of labelled rows (`graded`: `max_rows`, chosen by a hash of the id), staged once as
narrow rows of feature numbers; each L-BFGS step is a Spark job whose tasks return one gradient each. The
features are those hashes that occur in `min_docs` texts of the sample and whose presence depends on the
grade by a chi-square test; hashes have 40 bits, so that words do not share a weight in practice. Scoring
is a map over whole texts; the model goes along with the tasks and its size is bounded by the sample.

Defined results: null and empty texts have the feature of no words only; labels with a null rating
or without a document are no samples; without any labelled row every document has the top grade.
"""

from __future__ import annotations

import math
import operator
import pickle
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import map_slices, one_per_worker
from labelloom.session import broadcast_if_small, stage_table

#: Labelled rows that a fit takes at most, texts that a feature needs, and partitions of a gradient step.
MAX_ROWS, MIN_DOCS, PARTITIONS = 20_000, 5, 6
#: Chi-square by grade that a feature must reach, about one in 10^6 by chance for three grades.
LEAST_CHI2 = 27.0
#: Steps and penalty of the fit.
STEPS, PENALTY = 30, 3e-5
#: A share of a text counts once at each of these denominators that it reaches.
LEVELS = (64, 16, 4)
#: Entries of a worker's store of words (twice).
WORDS_KEPT = 50_000
_EDGE = re.compile(r"^\W+|\W+$")
_RUN = re.compile(r"(.)\1+")


def hashed(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") >> 24


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, other characters as they are; runs of one kind shortened."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1+", kinds)


def word_features(raw: str) -> tuple[int, str]:
    return hashed("w", _EDGE.sub("", raw).lower()), sys.intern(shape(raw))


def levels(kind: str, value: str, count: int, total: int) -> list[int]:
    return [hashed(kind, f"{value}:{level}") for level in LEVELS if count * level >= total] if count else []


def text_features(words: list[str]) -> list[int]:
    """Length and variety in coarse steps, and words that repeat the word before them."""
    if not words:
        return [hashed("t", "none")]
    variety = f"{int(math.log2(len(words)))}:{int(10 * len(set(words)) / len(words))}"
    again = sum(map(operator.eq, words, words[1:]))
    return [hashed("t", variety), *levels("r", "again", again, len(words))]


class Store:
    """word -> value of a function of it; the less used half goes when the store is full."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def all(self, words: list[str]) -> list:
        found = list(map(self.young.get, words))
        if None in found:
            found = [self._one(w) if v is None else v for w, v in zip(words, found, strict=True)]
        return found

    def _one(self, word):
        value = self.young.get(word) or self.old.get(word) or self.make(word)
        if len(word) <= 64:
            if len(self.young) >= WORDS_KEPT:
                self.old, self.young = self.young, {}
            self.young[word] = value
        return value


def text_hashes(text: str | None, store: Store) -> set[int]:
    """All features of a text."""
    words = (text or "").split()
    found = store.all(words)
    out = {w for w, _ in found}
    for form, count in Counter(f for _, f in found).items():
        out.update(levels("s", form, count, len(words)))
    out.update(text_features(words))
    return out


class OrdinalModel:
    """Weights by hash and rising thresholds."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.weights = dict(zip(hashes.tolist(), weights.tolist(), strict=True))
        self.thresholds = [float(t) for t in thresholds]
        self.store = Store(self._word)
        self.forms = Store(self._form)

    def _word(self, raw: str) -> tuple[float, str, int]:
        w, form = word_features(raw)
        return self.weights.get(w, 0.0), form, w

    def _form(self, form: str) -> tuple[float, ...]:
        """Weight of a shape that is as frequent as each level, by rising share."""
        each = [self.weights.get(hashed("s", f"{form}:{level}"), 0.0) for level in LEVELS]
        return tuple(math.fsum(each[: k + 1]) for k in range(len(LEVELS)))

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        found = self.store.all(words)
        # a word counts once, however it is written
        parts = list({h: w for w, _, h in found if w}.values())
        for form, count in Counter(f for _, f, _ in found).items():
            passed = sum(count * level >= len(words) for level in LEVELS)
            if passed:
                parts.append(self.forms.all([form])[0][passed - 1])
        parts += [self.weights.get(h, 0.0) for h in text_features(words)]
        return math.fsum(parts)


def _model_of(data: bytes) -> OrdinalModel:
    return one_per_worker(_loaded, data)


def _loaded(data: bytes) -> OrdinalModel:
    return OrdinalModel(*pickle.loads(data))


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def loss_and_gradient(scores: np.ndarray, grades: np.ndarray, thresholds: np.ndarray):
    """Sum of negative log-likelihoods with its derivatives by score and by threshold."""
    bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
    high, low = _sigmoid(bounds[grades + 1] - scores), _sigmoid(bounds[grades] - scores)
    chance = np.maximum(high - low, 1e-12)
    up, down = high * (1 - high) / chance, low * (1 - low) / chance
    by_threshold = np.zeros(len(thresholds))
    inner = grades < len(thresholds)
    np.add.at(by_threshold, grades[inner], -up[inner])
    inner = grades > 0
    np.add.at(by_threshold, grades[inner] - 1, down[inner])
    return -np.log(chance).sum(), up - down, by_threshold


def _minimize(objective, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps."""
    x = start
    value, gradient = objective(x)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, kept = gradient.copy(), []
        for s, y in reversed(history):
            a = s @ direction / (s @ y)
            direction -= a * y
            kept.append(a)
        if history:
            s, y = history[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(history, reversed(kept), strict=True):
            direction += (a - y @ direction / (s @ y)) * s
        step, slope = (1.0 if history else 1.0 / max(1.0, np.abs(gradient).sum())), gradient @ direction
        while step > 1e-6:
            new = x - step * direction
            new_value, new_gradient = objective(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12:
            history = [*history[1 - memory :], (s, y)]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
    return x


def fit(
    labelled: DataFrame,
    grade: str = "grade",
    text_column: str = "text",
    grades: int = 3,
    min_docs: int = MIN_DOCS,
    least_chi2: float = LEAST_CHI2,
    steps: int = STEPS,
    penalty: float = PENALTY,
) -> bytes | None:
    """The pickled arrays of a model (hashes, weights, thresholds) from rows with a grade 0 to `grades - 1`.

    `labelled` is a bounded sample, see `graded`.
    """
    chosen = labelled.where(F.col(grade).isNotNull()).select(F.col(grade).cast("int").alias("grade"), F.col(text_column).alias("text"))

    def extract():
        store = Store(word_features)

        def apply(batch):
            return [batch.column(0), [sorted(text_hashes(t, store)) for t in batch.column(1).to_pylist()]]

        return apply

    rows = stage_table(
        map_slices(chosen.repartition(PARTITIONS), extract, "grade int, hashes array<bigint>"),
        "quality-sample",
    )
    by_grade = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = sum(by_grade.values())
    if not size:
        return None
    each = rows.select("grade", F.explode("hashes").alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in by_grade]
    )
    expected = {g: F.col("n") * F.lit(n / size) for g, n in by_grade.items()}
    chi2 = sum(((F.col(f"g{g}") - e) * (F.col(f"g{g}") - e) / e for g, e in expected.items()), F.lit(0.0))
    telling = each.where((F.col("n") >= min_docs) & (F.col("n") < size)).where(chi2 * size / (size - F.col("n")) >= least_chi2)
    hashes = np.sort(np.array([r["h"] for r in telling.select("h").collect()], np.int64))  # bounded by the sample

    def renumber():
        def apply(batch):
            out = []
            for found in batch.column(1).to_pylist():
                found = np.array(found, np.int64)
                at = np.searchsorted(hashes, found)
                out.append(at[np.append(hashes, -1)[at] == found].astype("<i4").tobytes())
            return [batch.column(0), out]

        return apply

    packed = stage_table(map_slices(rows, renumber, "grade int, numbers binary"), "quality-numbers")
    width, cuts = len(hashes), grades - 1
    seen = np.cumsum([by_grade.get(g, 0) + 0.5 for g in range(grades)])[:-1] / (size + 0.5 * grades)
    base = np.log(seen / (1 - seen))

    def spread(x):  # thresholds from free parameters: the first, then logarithms of the gaps
        return np.cumsum(np.concatenate([x[:1], np.exp(x[1:])]))

    def objective(x: np.ndarray):
        weights, free = x[:width], x[width:]
        thresholds = spread(free)

        def step(batches):
            loss, grad, by_threshold = 0.0, np.zeros(width), np.zeros(cuts)
            for batch in batches:
                y = batch.column(0).to_numpy()
                numbers = [np.frombuffer(b, "<i4") for b in batch.column(1).to_pylist()]
                rows_ = np.repeat(np.arange(len(y)), [len(n) for n in numbers])
                flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
                scores = np.bincount(rows_, weights[flat], len(y))
                part, by_score, by_cut = loss_and_gradient(scores, y, thresholds)
                loss += part
                grad += np.bincount(flat, by_score[rows_], width)
                by_threshold += by_cut
            yield pa.RecordBatch.from_arrays(
                [pa.array([loss]), pa.array([grad.tobytes()]), pa.array([by_threshold.tobytes()])], names=["loss", "w", "t"]
            )

        parts = packed.mapInArrow(step, "loss double, w binary, t binary").collect()  # one row a task of the fixed number
        grad = sum(np.frombuffer(p["w"]) for p in parts) / size + penalty * weights
        by_threshold = sum(np.frombuffer(p["t"]) for p in parts) / size
        tail = np.cumsum(by_threshold[::-1])[::-1]  # a free parameter moves its threshold and all later ones
        by_free = tail * np.concatenate([[1.0], np.exp(free[1:])])
        return sum(p["loss"] for p in parts) / size + 0.5 * penalty * weights @ weights, np.concatenate([grad, by_free])

    start = np.concatenate([np.zeros(width), base[:1], np.log(np.maximum(np.diff(base), 1e-3))])
    best = _minimize(objective, start, steps)
    return pickle.dumps((hashes, best[:width], spread(best[width:])))


def graded(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, grade, text) of labelled documents: 0 toxic, 1 of low quality, 2 good.

    Of more than `max_rows` labels about so many are taken, those with the smallest hashes of their ids. They
    are few and narrow, so the texts are filtered in the scan.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    rated = labels.where("quality is not null and toxic is not null and doc_id is not null").select("doc_id", grade.alias("grade"))
    share = min(1.0, max_rows / max(1, rated.count()))
    chosen = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return documents.select("doc_id", "text").join(broadcast_if_small(chosen), "doc_id").select(F.col("doc_id").alias("id"), "grade", "text")


def score_texts(df: DataFrame, model: bytes | None, text_column: str = "text", grades: int = 3, prefix: str = "") -> DataFrame:
    """All columns of `df` with `score`, `expected_grade` and `tail_probs`, the array of P(grade >= j) for j from 1.

    The new names may be given a `prefix`, where `df` has such columns of its own.
    """
    others = [c for c in df.columns if c != text_column]
    narrow = df.select(*others, F.col(text_column).cast("string").alias(text_column))
    added = T._parse_datatype_string(f"`{prefix}score` double, `{prefix}expected_grade` double, `{prefix}tail_probs` array<double>")

    def make():
        known = _model_of(model) if model is not None else None

        def apply(batch):
            texts = batch.column(len(others)).to_pylist()
            scores = np.array([known.score(t) if known else 0.0 for t in texts])
            if known:
                tails = _sigmoid(scores[:, None] - np.array(known.thresholds)[None, :])
            else:
                tails = np.ones((len(texts), grades - 1))
            return [*batch.columns, scores, tails.sum(axis=1), tails.tolist()]

        return apply

    return map_slices(narrow, make, T.StructType([*narrow.schema.fields, *added.fields]))


def kept(tail: Column, least: float = 0.5) -> Column:
    return tail >= least


def quality_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: score, expected grade, probability of the top grade and the decision."""
    model = fit(graded(documents, labels))
    scored = score_texts(documents.select("doc_id", "text"), model).drop("text")
    top = F.round(F.element_at("tail_probs", -1), 6)
    return scored.select(
        "doc_id",
        F.round("score", 6).alias("score"),
        F.round("expected_grade", 6).alias("expected_grade"),
        F.round(F.element_at("tail_probs", 1), 6).alias("clean_prob"),
        top.alias("tail_prob"),
        kept(top).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` with an accepted text, with all their columns; texts are scored in place."""
    model = fit(graded(docs, labels))
    scored = score_texts(docs, model, prefix="__quality_")
    return scored.where(kept(F.element_at("__quality_tail_probs", -1))).select(*docs.columns)
