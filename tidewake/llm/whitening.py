r"""Whitening of embeddings by the covariance of all of them.

Entries become integers, x = floor(64 c) + 1 000 000, so sums are exact whatever the order in which
they are added. With S = n q + r for the sum S of a dimension over n rows, its mean is q + r/n, and
(x - q) - r/n is centred before anything is multiplied: what is rounded is a small number, not the
difference of large ones. ``RowMatrix`` adds up the products of the centred rows; divided by n they
are the covariance, whose eigenvectors and values are found at once (its side is the dimension). They
are broadcast, and rows are projected in slices. The covariance of the whitened rows, centred again,
is added up the same way and held against the identity.

Defined results: rows whose vector is null, or holds null or non-finite entries or entries that are
too large for x, are dropped, as are empty vectors and those of another length than most have (the
longest of equally frequent lengths); repeated rows and ids count as often as they are there; equal
eigenvalues have any basis of their space; a component without variance (not above the rounding of
the largest) can't be scaled and isn't returned, so a single row or copies of one give no rows; extra
columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import Tables, few

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this don't fit into a long once they are scaled.
LARGEST = 2.0**56


def integer_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array<bigint>) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fits = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    rows = embeddings.filter(F.coalesce(fits & (F.size(vector_col) > 0), F.lit(False))).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    return Tables(embeddings.sparkSession, "whitening-rows").write(rows)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def exact_sums(rows: DataFrame) -> list[int]:
    """The sum of each dimension of x; one number for each dimension comes to the driver."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for b in few(batches):
            x = _matrix(b["x"])
            safe = int(np.abs(x).max()) < 2**62 // len(x)
            part = [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]
            total = [a + p for a, p in zip(total, part)] if total else part
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["dim", "total"])

    found = rows.select("x").mapInArrow(sums, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).orderBy("dim")
    return [int(r["total"]) for r in found.collect()]


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of v v' over the vectors of a column of arrays."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    spark = embeddings.sparkSession
    rows = integer_rows(embeddings, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).take(2)
    if len(lengths) > 1:
        rows = rows.filter(F.size("x") == lengths[0]["length"])
    n = lengths[0]["count"] if lengths else 0
    out = "vec_id: {}, n: bigint, deviation: decimal(38,0), whitened: array<double>".format(rows.schema["vec_id"].dataType.simpleString())
    values, vectors, share = np.zeros(0), np.zeros((0, 0)), []
    whole, part = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n:
        whole, part = (np.array(x, dtype=np.int64) for x in zip(*(divmod(s, n) for s in exact_sums(rows))))
        centres = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(r / n).alias("f")) for q, r in zip(whole.tolist(), part.tolist())))
        centred = rows.select(F.zip_with("x", centres, lambda x, c: (x - c["q"]).cast("double") - c["f"]).alias("c"))
        covariance = gramian(centred, "c") / n
        e, v = np.linalg.eigh(covariance)
        e, v = e[::-1], v[:, ::-1]
        used = int(np.sum(e[:components] > max(e[0], 0) * len(e) * np.finfo(float).eps))
        values, vectors, share = e[:used], v[:, :used], (e[:used] / np.trace(covariance)).tolist()
    sent = spark.sparkContext.broadcast((n, whole, part, vectors / np.sqrt(values)))

    def project(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, whole, part, turn = sent.value
        for f in frames:
            x = np.stack(f["x"].to_list()) - whole if len(f) else np.zeros((0, len(whole)), np.int64)
            most = (int(np.abs(x).max()) + 1) * n if len(x) else 0
            apart = n * (x if x.shape[1] * most**2 < 2**63 else x.astype(object)) - part
            yield pd.DataFrame({"vec_id": f["vec_id"], "n": n, "deviation": [Decimal(int(d)) for d in (apart * apart).sum(axis=1)], "whitened": list((x - part / max(n, 1)) @ turn)})

    done = Tables(spark, "whitening").write(rows.mapInPandas(project, out))
    error = identity_error(done, n, len(values))
    flat = done.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, share)) if share else F.array().cast("array<double>"), F.col("k") + 1)
    return flat.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def identity_error(done: DataFrame, n: int, used: int) -> float | None:
    """The largest entry of the whitened rows' covariance minus the identity; none without components."""
    if not used:
        return None
    means = done.agg(*(F.avg(F.col("whitened")[k]).alias(f"m{k}") for k in range(used))).first()
    centred = done.select(F.zip_with("whitened", F.array(*map(F.lit, means)), lambda w, m: w - m).alias("c"))
    return float(np.abs(gramian(centred, "c") / n - np.eye(used)).max())
