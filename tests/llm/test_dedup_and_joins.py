import random
import re

import pytest

from tidewake.llm import common, exact_dedup, jaccard
from tidewake.llm.common import WORD_PATTERN

SCHEMA = "doc_id bigint, text string, name string, key int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def test_blocks_of_any_size_give_exact_groups(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    texts += [None, "", " \n", "a b", "ab", "a b", "x" * 3000, "x" * 2999 + "y", "x " * 3000, "😀" * 9]
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), block=4).collect()}
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for i, t in enumerate(bare):
        group = [j for j, u in enumerate(bare) if u == t]
        best = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (found[i].keep_id, found[i].group_size, found[i].kept) == (best, len(group), i == best)


def test_repeated_and_missing_ids_keep_one_row(spark):
    df = frame(spark, ["a", "a", "b", "b", "c"], [1, 1, None, None, None])
    out = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in out) == 3 and {r.keep_id for r in out if r.group_size == 2} == {1, None}
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == ["a", "b", "c"]
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []


def sets_of(text, k):
    words = re.findall(WORD_PATTERN, (text or "").translate({c: chr(c + 32) for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def components(texts, k, num):
    sets, root = [sets_of(t, k) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, num):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "   ", "One", "one", "one two", "ONE two", "É é", "a b c"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40, 150, 400]))]
        for _ in range(9):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, len(base) // 15, len(base) // 30])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)]
            texts.append(" ".join(words))
    want, sizes = components(texts, k, num)
    found = {r.doc_id: r for r in jaccard.jaccard_components(frame(spark, texts), k, num, 100).collect()}
    assert [found[i].component_id for i in range(len(texts))] == want
    assert [found[i].n_shingles for i in range(len(texts))] == sizes
    kept = jaccard.keep_first(frame(spark, texts), k, num, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")


def test_repeated_ids_and_empty_tables(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", "x y z u v w", "a b c d e f"], [4, 4, None, None])
    out = jaccard.jaccard_components(df, 3, 90).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert sum(r.first for r in out) == 2 and jaccard.keep_first(df, 3, 90).count() == 2
    assert jaccard.jaccard_components(df.limit(0), 3, 90).collect() == []


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (10, 60, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 25 :], rng.integers(0, 1 << 63, n // 50).astype(np.uint64)]))
        one, two = ({band: (set(keys.tolist()), bits) for band, keys, bits in jaccard.sketches(x, 90, 100)} for x in (a, b))
        common = set(one) & set(two)
        assert common
        for band in common:
            assert int(np.bitwise_count(one[band][1] ^ two[band][1]).sum()) <= len(np.setxor1d(a, b))
            assert one[band][0] & two[band][0]


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(4, "a b c d e f", 1, 2, 3, 4), (4, "a b c d e f", 1, 2, 3, 4), (None, "x y", 1, 2, 3, 4)], "doc_id bigint, text string, _row int, _own int, _key int, _gone int")
    for kept in (exact_dedup.keep_one(df), jaccard.keep_first(df, 3, 90)):
        assert kept.columns == df.columns and [tuple(r[2:]) for r in kept.collect()] == [(1, 2, 3, 4)] * 2


def test_hot_groups_and_joins_by_shuffle_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice([f"w{i}" for i in range(50)]) for _ in range(60)]
    texts = [" ".join(base)] * 40 + [" ".join(base[:i] + ["q"] + base[i + 1 :]) for i in range(30)] + ["other words here"] * 3 + [None]
    df = frame(spark, texts)
    want = sorted(map(tuple, jaccard.jaccard_components(df, 3, 80).drop("row").collect()), key=str)
    exact = sorted(map(tuple, exact_dedup.exact_dedup(df, block=16).collect()))
    for most, least in ((1000, 0),):  # every group of two rows is a hot one
        monkeypatch.setattr(common, "MOST_HOT", most)
        monkeypatch.setattr(common, "LEAST_HOT", least)
        assert sorted(map(tuple, jaccard.jaccard_components(df, 3, 80, most_ids=0).drop("row").collect()), key=str) == want
        assert sorted(map(tuple, exact_dedup.exact_dedup(df, block=16).collect())) == exact


def test_very_long_texts(spark):
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(120_000))
    texts = [long, long + " more", long[: len(long) // 2], "w1 w2 w3"]
    found = {r.doc_id: r for r in jaccard.jaccard_components(frame(spark, texts), 3, 90).collect()}
    want, sizes = components(texts, 3, 90)
    assert [found[i].component_id for i in range(4)] == want and [found[i].n_shingles for i in range(4)] == sizes
    assert [r.group_size for r in exact_dedup.exact_dedup(frame(spark, [long, long.replace(" ", "\n"), long[:-1]])).orderBy("doc_id").collect()] == [2, 2, 1]
