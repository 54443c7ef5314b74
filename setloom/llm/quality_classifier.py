"""Quality scores from random Fourier features of document statistics.

A document becomes a dozen statistics of its text. A fixed random projection and a cosine turn these into features
whose inner products approximate a Gaussian kernel. The ridge regression of labels on features needs the sums of their
products only: each partition adds up its own, and the sums (of fixed size, whatever the input) are added by a grouped
aggregation, whose result goes to the driver. Scores are calibrated by isotonic regression: labelled scores are counted in bins of fixed number, and pooled
where they aren't ascending.

The label, language, source and id of a document are never among its statistics. Labels are learned only from rows with
``crc32(doc_id as text) mod 5`` other than 0; the others are held out. All such rows are used, whatever their number.

Defined results: null and blank texts have the statistics of the empty text and get its score. Rows that repeat a doc_id
are scored each by its own text; a repeated label counts each time; rows without a label (or with a null one) aren't learned from.
Without any label to learn from, every score is 0.5. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle

FOLDS = 5
FEATURES = 256
#: Width of the Gaussian kernel, in standard deviations of a statistic.
WIDTH = 4.0
RIDGE = 1e-2
SEED = 7
BINS = 512
THRESHOLD = 0.3
#: Bytes of a text that are counted at once.
CHUNK = 1 << 20
STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "upper", "digit", "symbol", "punctuation", "other_ascii", "non_ascii",
    "space", "line_words", "distinct_words", "repeated_lines", "end_marks", "capitalised", "top_word",
)

_KIND = np.zeros(256, np.int64)  # 0: other ASCII
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b"#*$%&|<>!@^~_=+{}[]\\", 4), (b".,;:?'\"()-", 5), (b" \t\n\r\x0b\x0c", 6)):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 7


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.zeros(8, np.int64)
    for at in range(0, len(raw), CHUNK):
        kinds += np.bincount(_KIND[np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at)], minlength=8)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n, size, rows = max(1, len(words)), max(1, len(raw)), max(1, len(lines))
    return [
        np.log1p(len(words)), np.log1p(len(raw)), (size - kinds[6]) / n, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[0] / size, kinds[7] / size,
        kinds[6] / size, np.log1p(len(words) / rows), len(counts) / n, 1 - len(set(lines)) / rows, sum(x[-1:] in b".!?" for x in lines) / rows,
        sum(w[:1].isupper() for w in words) / n, max(counts.values(), default=0) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each document, settled: texts are read once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    return settle(docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, x array<double>"), "statistics")


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(STATISTICS))


@dataclass(frozen=True)
class Model:
    """Standardisation, ridge weights and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    steps: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        omega = draw.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
        phase = draw.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ omega + phase
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.steps)


def _fit_ridge(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights from the normal equations; a partition sends one matrix, and those are summed by entry."""
    blank = Model(mean, scale, np.zeros(0), np.zeros(0), np.zeros(0))
    size = FEATURES + 2

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                y = np.asarray(part.column(1), np.float64)
                f = np.concatenate([blank.features(_matrix(part.column(0))), y[:, None]], axis=1)
                total += f.T @ f
        yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sums = rows.select("x", "y").mapInArrow(each, "i long, row array<double>")
    by_row = sums.groupBy("i").agg(F.array(*[F.sum(F.element_at("row", j + 1)) for j in range(size)]).alias("row"))
    total = np.array([r.row for r in by_row.orderBy("i").collect()])  # (FEATURES + 2) rows, whatever the input
    gram, right = total[:-1, :-1], total[:-1, -1]
    penalty = RIDGE * max(1.0, np.trace(gram) / len(gram)) * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def pooled(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic means: neighbours whose means descend are pooled."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, counts, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in blocks])


def fit(rows: DataFrame) -> Model:
    """Of labelled rows (x, y), y 0 or 1: the model. Three passes over settled statistics."""
    stats = [F.avg(F.element_at("x", k + 1)) for k in range(len(STATISTICS))] + [F.stddev_pop(F.element_at("x", k + 1)) for k in range(len(STATISTICS))]
    got = rows.agg(*stats, F.count(F.lit(1))).first()
    if not got[-1]:
        zeros = np.zeros(len(STATISTICS))
        return Model(zeros, zeros + 1, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean, scale = np.array(got[: len(STATISTICS)]), np.maximum(np.array(got[len(STATISTICS) : -1]), 1e-9)
    uncalibrated = Model(mean, scale, _fit_ridge(rows, mean, scale), np.zeros(0), np.zeros(0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            y = np.asarray(b.column(1), np.float64)
            raw = np.concatenate([uncalibrated.raw(_matrix(b.slice(at, 4096).column(0))) for at in range(0, b.num_rows, 4096)] or [np.zeros(0)])
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=y, minlength=BINS)
        full = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(ones[full])], ["bin", "n", "ones"])

    bins = rows.select("x", "y").mapInArrow(each, "bin long, n double, ones double").groupBy("bin").agg(F.sum("n"), F.sum("ones")).orderBy("bin").collect()
    at, n, ones = (np.array(c, np.float64) for c in zip(*bins, strict=True))
    # a label of each kind is added over all bins together, so that no score is surely 0 or 1
    prior = (ones.sum() + 1) / (n.sum() + 2)
    return Model(mean, scale, uncalibrated.weights, (at + 0.5) / BINS * 2 - 0.5, pooled(ones + prior, n + 1))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    stats = with_statistics(docs)
    known = labels.where("quality is not null").select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("double").alias("y"))
    learn = stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_labelled")).select("x", "y")
    model = fit(settle(learn, "labelled"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                score = np.clip(model.score(_matrix(part.column(1))), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    scored = stats.mapInArrow(each, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
