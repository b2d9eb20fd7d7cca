"""Quality classifier by compression: two Zstandard dictionaries, one built from good and one from bad labelled texts.

A text is cut into blocks, each compressed on its own with either dictionary. The difference of the two total sizes,
normalised by the text's bytes and some more (`evidence`), is turned into the probability of a good text by a logistic
curve fitted to other labelled texts. The curve also weighs how much of that sum the text's own bytes are, so that a
text of a few words, whose difference says little, gets about the odds of short texts. Of EVIDENCE, the bytes with the
least logarithmic loss by cross-validation over the texts that the curve is fitted to are taken; no other text is asked.

Training is on a bounded sample (`Sample`): what reaches the driver does not grow with the corpus. Scoring is one pass
over the documents in their own partitions, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import extras_apart

LEVEL = 3
BLOCK = 512
DICTIONARY_BYTES = 112_640
THRESHOLD = 0.7
#: Bytes of text at which a difference counts half: what is tried, and what holds for fewer than FEW texts of a class.
EVIDENCE, DEFAULT_EVIDENCE, FEW, FOLDS = (16, 32, 64, 128, 256, 512), 64, 20, 5


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: texts per class for the dictionaries, texts per class to fit the curve, and the
    bytes of the texts that a dictionary is built from. Rows are taken in the order of a hash of their id, whole texts
    as long as they fit in the bytes; only a text longer than all these bytes is passed over."""

    dictionary_texts: int = 2000
    curve_texts: int = 2000
    dictionary_bytes: int = 16_384_000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    length: float = 0.0
    evidence: int = DEFAULT_EVIDENCE


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


class _Compressor:
    def __init__(self, dictionary: bytes):
        loaded = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
        if loaded:
            loaded.precompute_compress(level=LEVEL)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=False, write_dict_id=False)

    def size(self, text: bytes) -> int:
        return sum(len(self.zstd.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def _differences(texts: Iterator[bytes], good: _Compressor, bad: _Compressor) -> np.ndarray:
    """Of each text, compressed size with the bad dictionary less that with the good one, and its bytes."""
    return np.array([(bad.size(t) - good.size(t), len(t)) for t in texts], np.int64).reshape(-1, 2)


def _normalised(measured: np.ndarray, evidence: int) -> np.ndarray:
    """Difference and bytes, each over the bytes and `evidence` more."""
    return measured / (measured[:, 1:] + evidence)


def _probability(x: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30)))


def _choose_evidence(measured: np.ndarray, y: np.ndarray) -> int:
    """Of EVIDENCE, the one with the least loss over FOLDS parts, each judged by a curve of the others."""
    if min((y == 0).sum(), (y == 1).sum()) < FEW:
        return DEFAULT_EVIDENCE
    # Parts hold as much of each class as any other.
    part = np.empty(len(y), int)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % FOLDS

    def loss(evidence: int) -> float:
        x, total = _normalised(measured, evidence), 0.0
        for k in range(FOLDS):
            p = _probability(x[part == k], _fit_curve(x[part != k], y[part != k]))
            total -= np.log(np.where(y[part == k] == 1, p, 1 - p)).sum()
        return total

    return min(EVIDENCE, key=loss)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slopes of a logistic curve in two variables with a slight ridge, by Newton's method."""
    if not len(x) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(share / (1 - share))), 0.0, 0.0
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a, w = np.c_[np.ones(len(x)), (x - mean) / spread], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(3), a.T @ (y - p) - 1e-3 * w)
    slopes = w[1:] / spread
    return float(w[0] - slopes @ mean), float(slopes[0]), float(slopes[1])


def _last_orders(rows: list[Row], most: int) -> dict[int, int]:
    """Of each class, the last `_order` up to which the texts of these rows, in order, have at most so many bytes."""
    last: dict[int, int] = {}
    for y in (0, 1):
        total = 0
        for order, same in groupby((r for r in rows if r["_y"] == y), lambda r: r["_order"]):
            total += sum(r["_n"] for r in same)
            if total > most:
                break
            last[y] = order
    return last


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: Sample = Sample()) -> Model:
    """A model of label_col (0 or 1) from the rows of labels, which the caller has cut down to what may be learned from.

    Half of the ids, by a hash, build the dictionaries; the others fit the curve. Null ids, labels and texts are left
    out; an id with both labels is, too. Without any labelled text every score is 0.5.
    """
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z")
    clean = clean.select("_id", "_y", F.pmod(F.xxhash64("_id"), F.lit(2)).alias("_half"), F.xxhash64("_id", F.lit(1)).alias("_order"))
    picked = None
    for half, most in ((0, sample.dictionary_texts), (1, sample.curve_texts)):
        for y in (0, 1):
            part = clean.where((F.col("_half") == half) & (F.col("_y") == y)).orderBy("_order", "_id").limit(most)
            picked = part if picked is None else picked.union(part)
    # At most 2 * (dictionary_texts + curve_texts) ids are broadcast.
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(picked), "_id")
    sized = chosen.where("_half = 0").withColumn("_n", F.octet_length("_text")).where(F.col("_n") <= sample.dictionary_bytes)
    last = _last_orders(sized.select("_y", "_order", "_n").orderBy("_order", "_n").limit(2 * sample.dictionary_texts).collect(), sample.dictionary_bytes)
    fits = F.lit(False)
    for y, order in last.items():
        fits = fits | ((F.col("_y") == y) & (F.col("_order") <= order))
    whole_texts = sized.where(fits).orderBy("_order", "_text").limit(2 * sample.dictionary_texts).select("_y", "_text").collect()
    texts = [[r["_text"].encode() for r in whole_texts if r["_y"] == y] for y in (0, 1)]
    bad, good = (_dictionary(x, DICTIONARY_BYTES) for x in texts)
    measured = _with_difference(chosen.where("_half = 1").select("_y", "_order", "_text"), "_text", good, bad).select("_y", "_order", "_d", "_n").orderBy("_order", "_d", "_n").limit(2 * sample.curve_texts).collect()
    sizes, y = np.array([(r["_d"], r["_n"]) for r in measured], float).reshape(-1, 2), np.array([r["_y"] for r in measured], float)
    evidence = _choose_evidence(sizes, y)
    intercept, slope, length = _fit_curve(_normalised(sizes, evidence), y)
    # The sample has as many of either class as there are, up to its bound; the labels' own odds take its place.
    whole, part = ({y: 1 + n for y, n in x} for x in (clean.groupBy("_y").count().collect(), Counter(r["_y"] for r in measured).items()))
    if slope and len(whole) == 2:
        intercept += float(np.log(whole[1] / whole[0] * part[0] / part[1]))
    return Model(good, bad, intercept, slope, length, evidence)


def _with_difference(docs: DataFrame, text_col: str, good: bytes, bad: bytes) -> DataFrame:
    at = docs.columns.index(text_col)
    out = T.StructType([*docs.schema.fields, T.StructField("_d", T.LongType()), T.StructField("_n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_good, by_bad = _Compressor(good), _Compressor(bad)
        for b in batches:
            d = _differences((x.as_py() or b"" for x in b.column(at).cast(pa.binary())), by_good, by_bad)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d[:, 0]), pa.array(d[:, 1])], names=[*b.schema.names, "_d", "_n"])

    return docs.mapInArrow(run, out)


@extras_apart("text_col")
def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: likelier good) and `predicted` (1 from the threshold on).

    The score depends on the whole text alone. Null texts count as empty and get the curve's value at length 0.
    Rows keep their order and number; other columns pass through, and ones named score or predicted give way.
    """
    rest = docs.drop("score", "predicted")
    whole = F.col("_n") + model.evidence
    line = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.intercept) + F.lit(model.slope) * F.col("_d") / whole + F.lit(model.length) * F.col("_n") / whole))
    scored = _with_difference(rest, text_col, model.good, model.bad).withColumn("score", 1 / (1 + F.exp(-line)))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).select(*rest.columns, "score", "predicted")
