import random

from pyspark.sql import functions as F

from tests.llm.test_dedup_and_joins import frame, sets_of
from tidewake.llm import jaccard


def test_links_are_counted_within_components(spark):
    rng = random.Random(9)
    texts = [None, "", "one", "one", "a b c"]
    for _ in range(6):
        base = [rng.choice([f"w{i}" for i in range(300)]) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(["x", "y", "z", "q"])
            texts.append(" ".join(words))
    sets = [sets_of(t, 3) for t in texts]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)
    want = {i: sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert any(n >= 2 and len({frozenset(b) for b in sets if near(sets[i], b)}) > 2 for i, n in want.items())
    found = jaccard.jaccard_components(frame(spark, texts), 3, 90).collect()
    assert {r.doc_id: r.n_links for r in found} == want


def test_links_of_repeated_ids(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", "x y z u v w", "a b c d e f", None], [4, 4, None, None, 5])
    found = jaccard.jaccard_components(df, 3, 90).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in found) == [(-1, 0), (-1, 2), (4, 2), (4, 2), (5, 0)]


def test_links_across_chunks(spark, monkeypatch):
    """Chunks of a few documents or elements, so that components meet in many tasks."""
    rng = random.Random(3)
    base = [rng.choice([f"w{i}" for i in range(300)]) for _ in range(80)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    sets = [sets_of(t, 3) for t in texts]
    want = [sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    for docs, items, columns in ((7, 1 << 18, 10), (256, 500, 4096)):
        monkeypatch.setattr(jaccard, "CHUNK_DOCS", docs)
        monkeypatch.setattr(jaccard, "CHUNK_ITEMS", items)
        monkeypatch.setattr(jaccard, "MATRIX_COLUMNS", columns)
        found = {r.doc_id: r.n_links for r in jaccard.jaccard_components(frame(spark, texts), 3, 85).collect()}
        assert [found[i] for i in range(len(texts))] == want and max(want) > 20


def test_pairs_of_many_keys_are_passed_on_once(spark):
    """Documents of different components that share dozens of keys made a row for each of them."""
    rng = random.Random(4)
    keys = {i: set(rng.sample(range(60), 40)) for i in range(12)} | {20: {0, 99}, 21: {99}}
    rows = spark.createDataFrame([(k, i, i // 2, 5, [i]) for i, mine in keys.items() for k in mine], "key bigint, node bigint, comp bigint, n bigint, bits array<bigint>")
    found = [tuple(r) for r in jaccard.pairs_across(jaccard.with_keys_before(rows), F.col("na") == F.col("nb")).collect()]
    want = {(a, b) for a in keys for b in keys if a // 2 < b // 2 and keys[a] & keys[b]}
    assert set(found) == want and len(want) > 60
    assert len(found) == len(want) < sum(len(keys[a] & keys[b]) for a, b in want) / 15
    assert all(len(r.before) <= jaccard.KEYS_BEFORE for r in jaccard.with_keys_before(rows).collect())
