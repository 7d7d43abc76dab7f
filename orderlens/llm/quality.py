"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic
calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .base import crc_mod, mix, owner, row_sums, seen_before, slices, stored, words

CLASSES = [r"[#*$%&|<>]", r"!", r"[.,;:?]", r"[0-9]", r"[A-Z]", r"[\x20\x09-\x0D]", r"\n",
           r"[^\x00-\x7F]", r"[.!?][\x20\x09-\x0D]", r"\|", r"[()\[\]{}=_/\\@~^]"]
N_FEATURES = len(CLASSES) + 12


def features(texts: pa.Array) -> np.ndarray:
    """Statistics of each text, one row each; null is the empty text."""
    texts = pc.fill_null(texts, "")
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    shares = [pc.count_substring_regex(texts, c).to_numpy(zero_copy_only=False) for c in CLASSES]
    codes, offsets, values = words(texts, lower=True)
    n = np.diff(offsets).astype(float)
    size = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(float)[codes] if len(codes) else codes
    doc = owner(offsets)
    one = np.maximum(n, 1)
    spread = row_sums(size * size, offsets) / one - (row_sums(size, offsets) / one) ** 2
    again, _ = seen_before(doc * np.int64(max(len(values), 1)) + codes)
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    same = ~first & (codes == np.concatenate(([-1], codes[:-1]))) if len(codes) else first
    pair, triple = np.zeros(len(codes)), np.zeros(len(codes))
    for width, out in ((2, pair), (3, triple)):
        if len(codes) >= width:
            at = np.flatnonzero(doc[width - 1:] == doc[:len(doc) - width + 1])
            later, _ = seen_before(mix(doc[at], *[codes[at + i] for i in range(width)]))
            out[at[later]] = 1
    lines = pc.split_pattern(texts, "\n")
    cut = lines.offsets.to_numpy().astype(np.int64)
    cut = cut - cut[0]
    line = lines.flatten().dictionary_encode()
    repeated, _ = seen_before(owner(cut) * np.int64(max(len(line.dictionary), 1))
                              + line.indices.to_numpy(zero_copy_only=False))
    n_lines = np.maximum(np.diff(cut), 1).astype(float)
    whole = np.maximum(chars, 1)
    return np.column_stack([
        *[s / whole for s in shares],
        np.log1p(chars), np.log1p(n), row_sums(size, offsets) / one, np.sqrt(np.maximum(spread, 0)),
        row_sums(again.astype(float), offsets) / one, row_sums(same.astype(float), offsets) / one,
        row_sums(pair, offsets) / one, row_sums(triple, offsets) / one,
        row_sums((size > 20).astype(float), offsets) / one, row_sums((size <= 3).astype(float), offsets) / one,
        row_sums(repeated.astype(float), cut) / n_lines, np.log1p(n / n_lines)])


def _measured(batches):
    for batch in slices(batches, "text"):
        table = features(batch.column("text"))
        flat = pa.array(table.astype(np.float64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * N_FEATURES, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column("others"), lists], names=["others", "features"])


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and an array of text statistics; nothing is shuffled."""
    rows = docs.select(F.struct(*keep).alias("others"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["others"].dataType.simpleString()
    done = rows.mapInArrow(_measured, f"others {kind}, features array<double>")
    return done.select("others.*", "features")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray    # raw scores
    levels: np.ndarray   # their calibrated scores, never falling

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / self.frequency.shape[1])
        return np.column_stack([waves, np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def isotonic(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest never falling sequence, weighted by n."""
    level, size, width = [], [], []
    for v, w in zip(values, n):
        level.append(float(v))
        size.append(float(w))
        width.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            v2, w2, c2 = level.pop(), size.pop(), width.pop()
            level[-1] = (level[-1] * size[-1] + v2 * w2) / (size[-1] + w2)
            size[-1] += w2
            width[-1] += c2
    return np.repeat(level, width)


def _moments(batches):
    total = np.zeros((3, N_FEATURES))
    for batch in batches:
        x = matrix(batch.column("features"))
        total += np.stack([np.full(N_FEATURES, len(x)), x.sum(0), (x * x).sum(0)])
    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])


def _normal(model: QualityModel):
    def run(batches):
        size = model.frequency.shape[1] + 1
        gram, target = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                x = model.expand(matrix(part.column("features")))
                gram += x.T @ x
                target += x.T @ part.column("label").to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram.ravel(), target]).tolist()])], names=["sums"])
    return run


BINS = 1000


def _binned(model: QualityModel):
    def run(batches):
        for batch in batches:
            raw = np.clip(model.raw(matrix(batch.column("features"))), -0.5, 1.5)
            at = np.minimum(((raw + 0.5) / 2 * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], names=["bin", "label"])
    return run


def fit(labelled: DataFrame, fit_rows: int = 200_000, waves: int = 256, width: float = 3.0,
        ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """Fits on rows (key, features, label 0 or 1).

    At most about `fit_rows` labelled rows are used, chosen by a hash of the key when there are more:
    the bound on what the sums below are formed over. Four of five of them form the normal equations,
    one row of sums per task, 8 tasks; the others calibrate, counted in 1,000 bins. `width` is the
    Gaussian kernel's standard deviation in units of the square root of the number of statistics.
    """
    n = labelled.count()
    share = min(1.0, fit_rows / n) if n else 1.0
    place = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    rows = stored(labelled.filter(place < share * 1_000_000).withColumn("calibrate", place % 5 == 0)
                  .coalesce(8), "quality-fit")
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES),
                         rng.normal(size=(N_FEATURES, waves)) / (width * np.sqrt(N_FEATURES) / 2),
                         rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1),
                         np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    learn = rows.filter("not calibrate")
    sums = sum((np.array(r[0]) for r in learn.mapInArrow(_moments, "sums array<double>").collect()),
               np.zeros(3 * N_FEATURES)).reshape(3, -1)
    if not sums[0, 0]:
        return model
    model.mean = sums[1] / sums[0]
    model.scale = np.sqrt(np.maximum(sums[2] / sums[0] - model.mean ** 2, 0))
    model.scale[model.scale < 1e-9] = 1.0
    size = waves + 1
    total = sum((np.array(r[0]) for r in learn.mapInArrow(_normal(model), "sums array<double>").collect()),
                np.zeros(size * size + size))
    gram, target = total[:size * size].reshape(size, size), total[size * size:]
    model.weight = np.linalg.solve(gram + ridge * sums[0, 0] / waves * np.eye(size), target)
    bins = rows.filter("calibrate").mapInArrow(_binned(model), "bin int, label int").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()
    if not bins:
        bins = rows.mapInArrow(_binned(model), "bin int, label int").groupBy("bin").agg(
            F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()
    n = np.array([b["n"] for b in bins], float)
    model.knots = np.array([(b["bin"] + 0.5) / BINS * 2 - 0.5 for b in bins])
    model.levels = isotonic(np.array([b["good"] for b in bins]) / n, n)
    return model


def _scored(model: QualityModel):
    def run(batches):
        for batch in batches:
            score = model.score(matrix(batch.column("features"))) if batch.num_rows else np.zeros(0)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "features"}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(score)], names=[*columns, "score"])
    return run


def _fitted(docs, labels, id_col, text_col, label_col, folds, held_fold, options):
    rows = stored(measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                           ["doc_id"]), "statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
        .filter("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = rows.filter(crc_mod(F.col("doc_id"), folds) != held_fold).join(known, "doc_id").select(
        F.col("doc_id").cast("string").alias("key"), "features", "label")
    return rows, fit(labelled, **options)


def _passed(model: QualityModel, threshold: float, text_col: str):
    def run(batches):
        for batch in slices(batches, text_col):
            score = model.score(features(batch.column(text_col)))
            yield batch.filter(pa.array(score >= threshold))
    return run


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 5, held_fold: int = 0,
                   threshold: float = 0.3, **options) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, all columns as they are.

    Fits like `quality_classifier` and measures the texts again while they pass, so documents are
    neither joined nor shuffled. Same defined cases.
    """
    _, model = _fitted(docs, labels, id_col, text_col, label_col, folds, held_fold, options)
    return docs.mapInArrow(_passed(model, threshold, text_col), docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       label_col: str = "quality", folds: int = 5, held_fold: int = 0,
                       threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document.

    Only labels of rows whose crc32(id) modulo `folds` is not `held_fold` are learnt from. Scores use
    the text alone: whole texts are measured, no label, language, source or id is an input.

    Defined cases: null and empty texts have zero statistics and are scored like others; a document
    with several labels takes their largest; null labels and labels of unknown documents are not
    used; without labels every score is 0.5; null ids are never learnt from; an empty table gives an
    empty result; other columns are not read.
    """
    rows, model = _fitted(docs, labels, id_col, text_col, label_col, folds, held_fold, options)
    held = crc_mod(F.col("doc_id"), folds) == held_fold
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
