"""Quality classifier from compressed sizes.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut
into short segments, each compressed alone with either dictionary, so that the dictionaries and
not the text's own past explain it. The difference of the two sizes, over the text's length and
a constant that holds short texts back, is the only signal. A logistic curve of it, fitted on
labelled rows that built no dictionary and weighted back to the classes' true shares, is the score.

Training takes a bounded, documented sample of rows (``SAMPLE_ROWS`` of each class, chosen by a hash
of the id), each with its whole text; scoring reads every whole text. Where the texts of a class are
too short to train a dictionary, all of them together are the dictionary.

Defined results: null text counts as empty and is scored; labels other than 0 and 1, null labels
and labels of unknown documents aren't learned from; several labels of one document count once,
by their smallest, and of documents that share an id the text that comes first; with one class only, every score is that class; with none, 0.5. Where a class has
no text for its dictionary, or only one class is left for the curve (which needs a handful of labelled
rows), every score is the share of good ones among all labels. A row without
an id is scored and, having no label, not learned from. Repeated rows get equal scores; extra columns
are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import few

#: Labelled rows taken from each class at most; half build a dictionary, half fit the curve.
SAMPLE_ROWS = 4000
SEGMENT = 256
DICTIONARY_BYTES = 65536
LEVEL = 3
#: Bytes of a frame that hold no text.
FRAME = 9
#: Bytes added to a length, so that a few bytes saved in a short text say little.
SHORT = 20


def segments(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)]


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries, and the curve's centre, scale, intercept and slope; ``constant`` where nothing could be learned."""

    good: bytes = b""
    bad: bytes = b""
    centre: float = 0.0
    scale: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0
    constant: float | None = None

    def compressors(self):
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(sizes), self.constant)
        x = (size_difference(sizes) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * x, -35, 35)))


def sizes_of(texts: list[str | None], compressors) -> np.ndarray:
    """Rows of: bytes under the good dictionary, under the bad one, plain bytes."""
    good, bad = (c.compress for c in compressors)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        parts = segments(text)
        out[i] = sum([len(good(p)) for p in parts]) - FRAME * len(parts), sum([len(bad(p)) for p in parts]) - FRAME * len(parts), sum(map(len, parts))
    return out


def size_difference(sizes: np.ndarray) -> np.ndarray:
    """Bytes that the good dictionary saves over the bad one, for each byte of text."""
    return (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 2] + SHORT)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Intercept and slope by Newton steps for weighted logistic regression, with a unit ridge on the slope."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.eye(a.shape[1])
    ridge[0, 0] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def dictionary(parts: list[bytes]) -> bytes:
    """A dictionary trained on segments; where they hold too little for that, the segments themselves."""
    import zstandard

    if sum(map(len, parts)) > DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # segments that have nothing in common
            pass
    return b"".join(parts)


def train_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on labelled rows for which ``learn``, a condition on the column ``id``, holds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learn)
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(shares) < 2:
        return QualityModel(constant=float(next(iter(shares), 0.5)))
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("curve", F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(2)) == 1)
    # at most 2 * sample_rows ids are broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label", "curve").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def cut(batches):
        for b in few(batches):
            out = []
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                out += [(label, part) for part in segments(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["label", "part"])

    built = texts.filter(~F.col("curve")).select("label", "text").mapInArrow(cut, "label int, part binary").orderBy("label", "part").toArrow()
    labels_of, parts = np.array(built.column("label").to_pylist()), built.column("part").to_pylist()
    by_label = {k: [p for p, v in zip(parts, labels_of, strict=True) if v == k] for k in (0, 1)}
    if not min(map(len, by_label.values())):
        return QualityModel(constant=shares.get(1, 0) / sum(shares.values()))
    good, bad = dictionary(by_label[1]), dictionary(by_label[0])
    model = QualityModel(good, bad)

    def measure(batches):
        compressors = model.compressors()
        for b in few(batches):
            m = sizes_of(b.column("text").to_pylist(), compressors)
            yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array(m[:, i]) for i in range(3))], names=["label", "g", "b", "n"])

    found = texts.filter("curve").select("label", "text").mapInArrow(measure, "label int, g double, b double, n double").orderBy("label", "g", "b", "n").toArrow()
    y = np.array(found.column("label").to_pylist(), dtype=float)
    if not 0 < y.sum() < len(y):
        return QualityModel(constant=shares.get(1, 0) / sum(shares.values()))
    x = size_difference(np.column_stack([found.column(c).to_numpy() for c in ("g", "b", "n")]))
    centre, scale = float(x.mean()), float(x.std()) + 1e-9
    share = shares[1] / (shares[0] + shares[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    intercept, slope = _logistic((x - centre) / scale, y, weight)
    return QualityModel(good, bad, centre, scale, float(intercept), float(slope))


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score in 0..1 (higher: good likelier) for every whole text."""

    def run(batches):
        compressors = model.compressors() if model.constant is None else None
        for b in few(batches):
            sizes = sizes_of(b.column(1).to_pylist(), compressors) if compressors else np.zeros((b.num_rows, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(sizes), pa.float64())], names=["id", "score"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose whole text scores ``threshold`` or more."""
    place = df.columns.index(text_col)

    def run(batches):
        compressors = model.compressors() if model.constant is None else None
        for b in few(batches):
            sizes = sizes_of(b.column(place).to_pylist(), compressors) if compressors else np.zeros((b.num_rows, 3))
            yield b.filter(pa.array(model.score(sizes) >= threshold))

    return df.mapInArrow(run, df.schema)
