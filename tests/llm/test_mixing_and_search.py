import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import mixing, queries, search
from tidewake.llm.common import WORD_PATTERN

LOWER = {c: chr(c + 32) for c in range(65, 91)}


def documents(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "d", None])
        rows.append((i, rng.choice([None, "", " ".join(f"W{rng.randrange(90)}" for _ in range(rng.choice([1, 5, 40, 900])))]) if i % 9 == 0 else " ".join(f"w{int(rng.paretovariate(0.8)) % 300}" for _ in range(rng.randrange(1, 60))), source, "x"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), "doc_id bigint, text string, source string, size string")


def test_mix_equals_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r for r in con.sql(f"SELECT doc_id, size, source_size, round(target, 6), copies, taken FROM ({queries.OP9_SQL})").fetchall()}
    got = {r.doc_id: tuple(r) for r in mixing.mix_sources(docs).select("doc_id", "size", "source_size", F.round("target", 6), "copies", "taken").collect()}
    assert got == want


def test_mix_meets_targets_and_repeats(docs):
    a = mixing.mix_sources(docs).collect()
    assert sorted(map(str, a)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    taken, target = collections.Counter(), {}
    for r in a:
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
        assert r.taken <= 3 * r.size
    for s, (t, size) in target.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 20) and t <= 3 * size + 1e-6
    assert sum(t for t, _ in target.values()) == pytest.approx(sum(size for _, size in target.values()))


def test_mix_of_odd_tables(spark, docs):
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, None, "t")], "doc_id bigint, text string, source string")
    out = mixing.mix_sources(odd).collect()
    assert len(out) == 4 and all(0 <= r.taken <= 3 * r.size for r in out)
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r.copies for r in mixing.mix_sources(odd).collect())
    assert {r.taken for r in mixing.mix_sources(odd.filter("text IS NULL")).collect()} == {0}


def test_inclusion_follows_unequal_probabilities(spark):
    """Many sources with the same 60 sizes are as many draws: each size is sampled as often as its probability says."""
    rng, draws = random.Random(4), 160
    sizes = [rng.choice([1, 3, 9, 30, 80, 250, 600]) for _ in range(60)] + [2500]
    rows = [(s * 1000 + i, "w " * n, f"s{s:03d}") for s in range(draws) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix_sources(df, weights=(1, 2)).collect()
    for weight in (1, 2):
        mine = [r for r in out if int(r.source[1:]) % 2 == weight - 1]
        target, total = mine[0].target, sum(sizes)
        # c by bisection, so that the expected words are the target
        low, high = 0.0, 3.0
        for _ in range(80):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(3, c * n.bit_length()) * n for n in sizes) < target else (low, c)
        assert 0 < target <= 3 * total
        for n in sorted(set(sizes)):
            expected = min(3, c * n.bit_length())
            got = [r.copies for r in mine if r["size"] == n]
            spread = math.sqrt(max(expected % 1 * (1 - expected % 1), 0.02) / len(got))
            assert {math.floor(expected), math.ceil(expected)} >= set(got) or n < 31  # the closing document may be small
            assert abs(sum(got) / len(got) - expected) < 5 * spread + 0.06
    assert any(r.taken for r in out if r["size"] == 2500) and not all(r.taken for r in out if r["size"] == 2500)


def test_rows_of_the_mix_keep_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "a b", "s", 7, 8, 9, 1), (1, "a b", "s", 7, 8, 9, 2), (None, "c", None, 7, 8, 9, 3)], "doc_id bigint, text string, source string, _key int, _row int, _copies int, bits int")
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and {tuple(r[3:6]) for r in rows.collect()} == {(7, 8, 9)}


def test_reruns_of_repeated_ids_agree(spark):
    """Rows that share ids, in one, three and seven partitions and two orders: the same mix, to the row."""
    rows = [(None if i % 11 == 0 else i % 40, f"{'word ' * (1 + i * 7 % 60)}{i % 90}", "abc"[i % 3]) for i in range(450)] * 2
    runs, texts = set(), set()
    for n, order in ((1, "text"), (3, "source"), (7, "text")):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(n).sortWithinPartitions(F.desc(order))
        runs.add(tuple(sorted(map(str, mixing.mix_sources(df).collect()))))
        texts.add(tuple(sorted(map(str, mixing.mixed_rows(df).collect()))))
    assert len(runs) == 1 and len(texts) == 1


def test_mix_of_rows_without_ids_and_of_long_texts(spark):
    rows = [(None, f"w{i} " * (i % 7 + 1), "s") for i in range(300)] + [(1, "x " * 40_000, "t"), (2, "y", "t"), (3, "z " * 500, "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a = mixing.mix_sources(df).collect()
    assert sorted(map(str, a)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    assert all(r.taken <= 3 * r["size"] for r in a) and max(r["size"] for r in a) == 40_000


def test_search_equals_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 64)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(search, "BLOCKS_AT_ONCE", 3)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 2)
    rows = documents()
    tf = [collections.Counter(re.findall(WORD_PATTERN, (t or "").translate(LOWER))) for _, t, _, _ in rows]
    length = [sum(c.values()) for c in tf]
    mean, n = sum(length) / len(rows), len(rows)
    df = collections.Counter(w for c in tf for w in c)
    found = collections.defaultdict(list)
    for r in search.search(docs.repartition(6), F.col("doc_id") % 50 == 0, k=5, query_terms=60).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    for q in range(0, n, 50):
        scores = [sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, m in tf[q].items() if w in c) for i, c in enumerate(tf)]
        want = [i for i in sorted(range(n), key=lambda i: (-round(scores[i], 9), i)) if scores[i] > 0][:5]
        assert [i for i, _ in found.get(q, [])] == want
        assert [s for _, s in found.get(q, [])] == pytest.approx([scores[i] for i in want])


def test_shards_reach_workers_one_by_one(spark, docs, monkeypatch):
    """A shard may have tens of megabytes, so that a batch of several is too much beside them."""
    monkeypatch.setattr(search, "SHARD_ROWS", 8)
    made = search._searcher

    def watched(*args):
        inner = made(*args)

        def run(batches):
            def each():
                for b in batches:
                    assert b.num_rows == 1
                    yield b

            yield from inner(each())

        return run

    monkeypatch.setattr(search, "_searcher", watched)
    assert search.search(docs.coalesce(1), F.col("doc_id") % 50 == 0, k=2).count() > 0


def test_search_of_odd_tables(spark, docs):
    assert search.search(docs.limit(0), F.lit(True)).collect() == []
    odd = spark.createDataFrame([(0, None, 1), (1, " ", 1), (2, "a b", 1), (2, "a b", 1), (None, "A", 1)], "doc_id bigint, text string, rank int")
    out = search.search(odd, F.lit(True), k=2).collect()
    assert sorted((r.query_id or -1, r["rank"]) for r in out) == [(-1, 1), (-1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]


@pytest.mark.parametrize("dense, bound, at_once, blocks, first", [(3, 8, 7, 1, 1), (1, 1, 64, 3, 2), (500, 500, 1000, 2, 9)])
def test_a_shard_answers_many_queries_at_once(spark, docs, monkeypatch, dense, bound, at_once, blocks, first):
    """One pass over a shard for many queries, whose sums of 32 bits leave no score, order or tie to rounding."""
    for name, value in (("DENSE_TERMS", dense), ("BOUND_TERMS", bound), ("QUERIES_AT_ONCE", at_once), ("BLOCK_DOCS", 4), ("BLOCKS_AT_ONCE", blocks), ("FIRST_BLOCKS", first), ("SHARD_ROWS", 60)):
        monkeypatch.setattr(search, name, value)
    calls, inner = [], search.Shard.search
    monkeypatch.setattr(search.Shard, "search", lambda *a: calls.append(1) or inner(*a))
    # copies, and texts of five to seven words, which a mean of 10^9 words sets apart by some 10^-9 of a score
    rows = [(i, t) for i, t, _, _ in documents(200)] + [(1000 - i, " ".join(["near", "by", *"vwxyz"[: 3 + i % 3]])) for i in range(60)]
    index = search.build_index(spark.createDataFrame(rows, "id bigint, text string").coalesce(1)).toArrow().to_batches(max_chunksize=1)
    mean, rng = 1e9, random.Random(5)
    known = search.Keys()
    tf = [collections.Counter(search.words_of(t)) for _, t in rows]
    asked = [{w: rng.uniform(0.1, 9) for w in tf[q]} for q in range(0, len(rows), 2) if tf[q]]
    queries_ = []
    for q, words in enumerate(asked):
        queries_ += sorted((q, known.keys[known[w]], weight, w) for w, weight in words.items())
    number_of = {x: i for i, x in enumerate(sorted({x[1] for x in queries_}))}
    names, starts = np.unique([x[0] for x in queries_], return_index=True)

    class Shared:
        value = (names, np.append(starts, len(queries_)), np.array(sorted(number_of)), np.array([number_of[x[1]] for x in queries_]), np.array([x[2] for x in queries_]))

    found = collections.defaultdict(list)
    for b in search._searcher(Shared, mean, 5)(iter(index)):
        for r in b.to_pylist():
            found[r["query"]].append((r["id"], r["score"]))
    for q in names.tolist():
        terms = [(x[3], x[2]) for x in queries_[starts[q] :] if x[0] == q]
        scores = {}
        for (i, _), c in zip(rows, tf, strict=True):
            total = 0.0
            for w, weight in terms:
                if w in c:
                    total += weight * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)))
            if total > 0:
                scores[i] = total
        want = sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:5]
        assert [i for i, _ in found[q]] == want
        assert [s for _, s in found[q]] == pytest.approx([scores[i] for i in want], rel=1e-12)
    assert len(calls) == len(index) * -(-len(names) // at_once)
