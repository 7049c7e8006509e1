"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each text gives a short vector of statistics. Random Fourier features approximate a Gaussian
kernel over the standardised statistics; every partition sums its part of the normal
equations of a ridge fit, and only those sums (features x features) reach the driver. The
features are rounded to 1/4096, so the sums are exact integers and do not depend on how rows
are partitioned or retried. Calibration is isotonic over out-of-fold ridge scores, pooled at
the score's own precision (1/4096).

Labels are used only where the caller says so; id, language, source and label are never
inputs of a score.

Defined results: a null text scores as an empty one; empty texts have a score; a document
with several labels counts with the smallest; repeated rows are scored alike; without any
labelled row, or with one class only, the score is the share of good labels (0.5 without
labels).
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import blocks_for, checkpointed, words

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "distinct_pairs",
    "repeated_next", "repeated_runs", "upper", "digit", "symbol", "stop", "space", "line_break", "distinct_lines",
    "short_lines", "upper_words", "marked_words", "letter_entropy", "longest_word", "first_half_gap",
)
FEATURES, GRID, SEED = 320, 4096, 20260
RIDGE, WIDTH = 1.0, 5.0
# Rows whose sums a task makes, about.
BLOCK = 8192


def _kinds() -> np.ndarray:
    """Class of every byte: 1 upper, 2 lower or beyond ASCII, 3 digit, 4 full stop, 5 space, 6 line break, 0 symbol."""
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[97:123], kind[128:], kind[48:58] = 1, 2, 2, 3
    kind[[46, 44, 63]], kind[[32, 9, 11, 12]], kind[[10, 13]] = 4, 5, 6
    return kind


_KIND = _kinds()


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text, in the order of STATISTICS; zeros for an empty one."""
    text = text or ""
    found = words(text)
    if not found:
        return [float(np.log1p(len(text)))] + [0.0] * (len(STATISTICS) - 1)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_KIND[data], minlength=7) / len(data)
    letters = np.bincount(data, minlength=256)
    letters = letters[letters > 0] / len(data)
    code: dict[str, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in found], np.int64)
    n = len(ids)
    length = np.array([len(w) for w in code], np.int64)
    sizes = length[ids]
    counts = np.bincount(ids)
    pairs = ids[:-1] * len(code) + ids[1:]
    same = float(np.mean(ids[1:] == ids[:-1])) if n > 1 else 0.0
    # Runs of five words that repeat inside the text.
    fives = sum(ids[i:n - 4 + i] * np.int64(1_000_003) ** i for i in range(5)) if n > 4 else np.zeros(0, np.int64)
    lines = [line for line in text.split("\n") if line.strip()]
    upper = np.array([w.upper() == w and w.lower() != w for w in code])[ids]
    marked = np.array([not w[-1].isalnum() and w[-1] not in ".,?" for w in code])[ids]
    half = n // 2
    gap = abs(len(np.unique(ids[:half])) - len(np.unique(ids[half:2 * half]))) / half if half else 0.0
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), float(sizes.mean()), float(sizes.std()), len(code) / n, float(counts.max() / n),
        len(np.unique(pairs)) / max(1, n - 1), same, 1.0 - len(np.unique(fives)) / max(1, len(fives)) if len(fives) else 0.0,
        float(share[1]), float(share[3]), float(share[0]), float(share[4]), float(share[5]), float(share[6]),
        len(set(lines)) / len(lines), float(np.mean([len(line) < 20 for line in lines])), float(upper.mean()), float(marked.mean()),
        float(-(letters * np.log(letters)).sum()), float(np.log1p(length.max())), gap,
    ]


def with_statistics(df: DataFrame, text: str, name: str) -> DataFrame:
    """All columns but the text, and the statistics of the text as one array column."""
    kept = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.DoubleType(), False))])

    def run(batches):
        for batch in batches:
            rows = [statistics(v.as_py()) for v in batch.column(text)]
            columns = [batch.column(c) for c in kept] + [pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    return df.mapInArrow(run, schema)


@dataclasses.dataclass
class Model:
    """What tasks need to score a vector of statistics; a few hundred kilobytes at most."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def projection(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features on a grid of 1/4096, and a constant."""
        rng = np.random.default_rng(SEED)
        omega = rng.normal(0.0, 1.0 / WIDTH, (len(self.centre), FEATURES))
        phase = rng.uniform(0.0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.centre) / self.scale, -8.0, 8.0)
        waves = np.round(np.cos(z @ omega + phase) * GRID) / GRID
        return np.hstack([waves, np.round(z / 8.0 * GRID) / GRID, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Ridge score at its precision of 1/4096."""
        w = self.weights if weights is None else weights
        return np.round(np.clip(self.projection(x) @ w, -1.0, 2.0) * GRID) / GRID

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.levels[0])
        return np.interp(self.raw(x), self.knots, self.levels)


def _solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    return np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)


def isotonic(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted scores; block means at their mean scores."""
    blocks: list[list[float]] = []
    for at, weight, hits in zip(x, n, good):
        blocks.append([at * weight, weight, hits])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # Half a hit is added to each side so that no block claims certainty.
    return (np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1.0) for b in blocks]))


def fit(train: DataFrame, stats: str, good: str, fold: str) -> Model:
    """Fit on rows of statistics, a 0/1 label and a 0/1 fold.

    The driver receives two vectors of moments, two gram matrices of a fixed size and at
    most 3 x 4096 score cells, however many rows there are.
    """
    size = len(STATISTICS)
    rows = train.agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good"), *[
        f(F.col(stats)[i]).alias(f"{k}{i}") for i in range(size) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, hits = rows["n"], rows["good"] or 0
    share = hits / n if n else 0.5
    if n == 0 or hits in (0, n):
        return Model(np.zeros(size), np.ones(size), np.zeros(0), np.zeros(0), np.array([share]))
    # Rounded, so that the order of summation does not reach the features.
    centre = np.array([float(f"{rows[f'm{i}']:.6g}") for i in range(size)])
    scale = np.array([float(f"{rows[f's{i}']:.6g}") or 1.0 for i in range(size)])
    model = Model(centre, scale, np.zeros(0), np.zeros(0), np.zeros(0))
    width = FEATURES + size + 1

    def sums(batches):
        gram, moment = np.zeros((2, width, width)), np.zeros((2, width))
        for batch in batches:
            y, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (good, fold))
            if not len(y):
                continue
            z = model.projection(np.array(batch.column(stats).to_pylist(), float))
            for f in (0, 1):
                mine = part == f
                gram[f] += z[mine].T @ z[mine]
                moment[f] += y[mine] @ z[mine]
        for f in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([f * width + i for i in range(width)], pa.int32()),
                 pa.array([[*gram[f, i], moment[f, i]] for i in range(width)], pa.list_(pa.float64()))], names=["line", "sums"])

    # A task's matrices take 1.9 MB whatever its rows are, so tasks that hold few rows are put together.
    partial = train.select(stats, good, fold).coalesce(blocks_for(n, BLOCK)).mapInArrow(sums, "line int, sums array<double>")
    total = partial.groupBy("line").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("sums"))
    lines = {r["line"]: r["sums"] for r in total.collect()}
    both = np.array([[lines[f * width + i] for i in range(width)] for f in (0, 1)])
    gram, moment = both[:, :, :-1], both[:, :, -1]
    model.weights = _solve(gram.sum(0), moment.sum(0))
    crossed = [_solve(gram[1 - f], moment[1 - f]) for f in (0, 1)]

    def cells(batches):
        for batch in batches:
            part = batch.column(fold).to_numpy(zero_copy_only=False)
            if not len(part):
                continue
            x = np.array(batch.column(stats).to_pylist(), float)
            raw = np.where(part == 0, model.raw(x, crossed[0]), model.raw(x, crossed[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.round(raw * GRID).astype(np.int64)), batch.column(good).cast(pa.int64())], names=["cell", "good"])

    pooled = train.select(stats, good, fold).mapInArrow(cells, "cell long, good long").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).collect()
    pooled.sort(key=lambda r: r["cell"])
    model.knots, model.levels = isotonic(*(np.array([r[c] for r in pooled], float) for c in ("cell", "n", "good")))
    model.knots = model.knots / GRID
    return model


def scored(df: DataFrame, model: Model, stats: str, name: str) -> DataFrame:
    """Adds the calibrated score of a column of statistics."""
    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array(x.to_pylist(), float).reshape(-1, len(STATISTICS))), pa.float64())

    return df.withColumn(name, score(F.col(stats)))


def text_score(model: Model, text: Column) -> Column:
    """Calibrated score of whole texts, for a filter that keeps all other columns as they are."""
    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        rows = [statistics(v.as_py()) for v in x]
        return pa.array(model.score(np.array(rows, float).reshape(-1, len(STATISTICS))), pa.float64())

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not used: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train_and_score(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """One row per document with ``doc_id``, ``held_out``, ``score`` and ``predicted``; and the model.

    Texts are read once: their statistics (about 200 bytes a document) are kept in the
    checkpoint folder and serve the fit and the scores.
    """
    stats = checkpointed(with_statistics(docs.select("doc_id", "text"), "text", "stats"))
    marks = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").cast("long").alias("good"))
    fold = (F.crc32(F.col("doc_id").cast("string")) % 3 == 2).cast("int")
    train = stats.dropDuplicates(["doc_id"]).join(marks, "doc_id").select("stats", "good", fold.alias("fold"))
    model = fit(checkpointed(train), "stats", "good", "fold")
    out = scored(stats, model, "stats", "score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted")), model
