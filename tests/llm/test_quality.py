import zlib

import pytest
from pyspark.sql import functions as F

from tidewake.llm import quality

GOOD = "the river ran past the old mill and the children walked home along the quiet road before dark "
BAD = "BUY!! NOW!! CLICK&&& HERE### WIN%%% CASH!! FREE*** OFFER!! "


def rows(n=120):
    docs = [(i, (GOOD if i % 2 else BAD) * (1 + i % 4) + str(i), "x") for i in range(n)]
    return docs, [(i, i % 2, 9) for i in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = rows()
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0), (77777, 0, 0), (7, 3, 0)], "doc_id bigint, quality int, score int")
    return docs, labels, quality.train_quality(docs, labels, F.crc32(F.col("id").cast("string")) % 4 != 2)


def test_held_out_rows_are_told_apart(trained):
    docs, _, model = trained
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    out = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert len(held) > 10 and all((out[i] >= 0.7) == bool(i % 2) for i in held)


def test_tricky_rows_get_scores_and_repeats_equal_ones(spark, trained):
    model = trained[2]
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, GOOD, 0), (3, GOOD * 3000, 0), (3, GOOD * 3000, 1)], "doc_id bigint, text string, score int")
    out = [(r.doc_id, r.score) for r in quality.score_quality(df, model).collect()]
    assert len(out) == 5 and all(0 <= s <= 1 for _, s in out)
    by = dict(out)
    assert by[1] == by[2] and len({s for i, s in out if i == 3}) == 1
    assert quality.score_quality(df.limit(0), model).collect() == []


def test_training_again_gives_the_same_model(spark, trained):
    docs, labels, model = trained
    again = quality.train_quality(docs.repartition(5), labels.repartition(3), F.crc32(F.col("id").cast("string")) % 4 != 2)
    assert again == model


def test_missing_classes(spark, trained):
    docs, labels, _ = trained
    assert quality.train_quality(docs, labels.limit(0), F.lit(True)).constant == 0.5
    assert quality.train_quality(docs, labels.filter("quality = 1"), F.lit(True)).constant == 1.0


def test_filter_keeps_columns_and_good_rows(trained):
    docs, _, model = trained
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id % 2 for r in kept.collect()} == {1}


def test_scores_equal_brute_force(spark, trained):
    """Each segment compressed with a compressor of its own, the difference over the length, the curve."""
    import math

    import zstandard

    docs, _, model = trained
    texts = [None, "", GOOD, BAD, "é" * 500, GOOD * 40 + BAD * 40, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")

    def size(part: bytes, raw: bytes) -> int:
        return len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False).compress(part)) - 9

    for r in quality.score_quality(df, model).collect():
        raw = (texts[r.doc_id] or "").encode()
        parts = [raw[i : i + quality.SEGMENT] for i in range(0, len(raw), quality.SEGMENT)]
        saved = sum(size(p, model.bad) - size(p, model.good) for p in parts) / (len(raw) + 20)
        z = model.intercept + model.slope * (saved - model.centre) / model.scale
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))))


def test_several_labels_and_ids_that_repeat(spark):
    docs = [(i % 60, (GOOD if i % 2 else BAD) * 3 + str(i), "x") for i in range(120)]
    labels = [(i, i % 2) for i in range(60)]
    docs, schema = spark.createDataFrame(docs, "doc_id bigint, text string, label string"), "doc_id bigint, quality int"
    once = quality.train_quality(docs, spark.createDataFrame(labels, schema), F.lit(True))
    again = quality.train_quality(docs, spark.createDataFrame(labels + labels + [(i, 1) for i in range(0, 60, 2)], schema), F.lit(True))
    assert once == again and once.constant is None


def test_filter_of_tables_with_clashing_columns(trained, spark):
    model = trained[2]
    df = spark.createDataFrame([(1, GOOD * 3, 0.1, 5), (None, BAD * 3, 0.2, 5), (1, None, 0.3, 5)], "doc_id bigint, text string, score double, label int")
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and 0.1 in {r.score for r in kept.collect()}


def test_training_equals_brute_force(spark):
    """Dictionaries from all segments of whole texts, however long, and a curve where its gradient vanishes."""
    import numpy as np
    import zstandard

    texts = [(GOOD if i % 3 else BAD) * 8 * (1 + i % 9) + f"{i} {i * i} " for i in range(400)]
    texts[3], texts[4] = BAD[::-1] * 2000 + "zq" * 400, GOOD[::-1] * 2000 + "jk" * 400
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, "a longer copy" + texts[9] * 3)] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id bigint, quality int")
    model = quality.train_quality(docs, labels, F.lit(True))
    texts[9] = min(texts[9], "a longer copy" + texts[9] * 3)
    curve = {r[0] for r in spark.range(400).filter(F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(2)) == 1).collect()}
    cut = lambda raw: [raw[i : i + quality.SEGMENT] for i in range(0, len(raw), quality.SEGMENT)]
    for label, got in ((1, model.good), (0, model.bad)):
        parts = sorted(p for i, t in enumerate(texts) if i not in curve and (i % 3 > 0) == label for p in cut(t.encode()))
        assert sum(map(len, parts)) > quality.DICTIONARY_BYTES and got == zstandard.train_dictionary(quality.DICTIONARY_BYTES, parts, level=3).as_bytes()
    sizes = quality.sizes_of([texts[i] for i in sorted(curve)], model.compressors())
    y = np.array([i % 3 > 0 for i in sorted(curve)], float)
    x = (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 2] + 20)
    assert (model.centre, model.scale) == pytest.approx((x.mean(), x.std() + 1e-9))
    x = (x - model.centre) / model.scale
    share = sum(i % 3 > 0 for i in range(400)) / 400
    residual = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) * (y - 1 / (1 + np.exp(-(model.intercept + model.slope * x))))
    assert abs(residual.sum()) < 1e-3 and abs((residual * x).sum() - model.slope) < 1e-3


def test_a_handful_of_rows(spark):
    """No switch by size: few labelled rows make dictionaries too, where both classes have text on both sides."""
    docs = spark.createDataFrame([(i, (GOOD if i % 2 else BAD) + str(i)) for i in range(16)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id bigint, quality int")
    model = quality.train_quality(docs, labels, F.lit(True))
    out = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert model.constant is None and all((out[i] > 0.5) == bool(i % 2) for i in out)
    empty = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.col("text")))
    assert quality.train_quality(empty, labels, F.lit(True)).constant == 0.5
