import collections
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup_and_joins import components
from tidewake.llm import mixing, quality, queries
from tidewake.llm.common import id_remainder

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage got and gave."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, str(DATA)).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((docs, made))
        docs = made
    return out


def test_quality_keeps_what_scores_well(spark, stages):
    docs, made = stages[0]
    model = quality.train_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"), id_remainder(F.col("id"), 4) != 2)
    want = {r.doc_id for r in quality.score_quality(docs, model).collect() if r.score >= 0.7}
    assert {r.doc_id for r in made.collect()} == want and made.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i, y in labels.items() if y == 1 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(i in want for i in good) >= 0.8 * len(good)


def test_exact_copies_go(stages):
    docs, made = stages[1]
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in made.collect()) == sorted(min(g)[1] for g in groups.values())


def test_near_copies_go(stages):
    docs, made = stages[2]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    roots, _ = components([r.text for r in rows], 5, 80)
    assert sorted(r.doc_id for r in made.collect()) == sorted({rows[i].doc_id for i in roots})


def test_mix_repeats_rows(stages):
    docs, made = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    assert collections.Counter(r.doc_id for r in made.collect()) == collections.Counter({i: n for i, n in copies.items() if n}) and made.columns == docs.columns


def test_ids_equal_the_library(stages):
    docs, made = stages[4]
    tool = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((r.doc_id, tool.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((r.doc_id, r.ids) for r in made.collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(DATA))) == key(stages[4][1])


def test_stages_take_empty_tables(spark, stages):
    docs = stages[0][0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
    assert docs.collect() == []
