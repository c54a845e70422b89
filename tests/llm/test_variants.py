import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewake.llm import variants


def damaged(rows):
    """Counts of all words after the damage, run by run."""
    found = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    forms, near = {}, {w: [v for v in words if is_near(v, w)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return out


def found(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(df).collect()}


def test_words_of_texts(spark):
    rows = [(i, f"Éternel ÉTERNEL éternel× straßen-straßenbahn{i % 3} ab abcdefg abcdefgh{'' if i % 2 else '_x'} ÿÿÿÿÿÿÿ") for i in range(60)]
    rows += [(None, "nowhere nowhere"), (7, None), (8, ""), (8, "×÷ ÷÷÷÷÷÷÷ a1b2c3d"), (9, "x" * 40_000 + " " + "x" * 40_000), (9, "x" * 40_000 + " " + "x" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "run": F.lit(3)})
    got = {r.word: r.n for r in variants.damaged_words(docs).collect()}
    assert got == damaged(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_words_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(250):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 11)))
        words[w] = rng.choice([2, 3, 20, 30, 400, 400, 9000])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcz") + w[i:], w[:i] + rng.choice("abcz") + w[i + 1 :], w[:i] + w[i] + w[i:]])
            if len(w) >= 7:
                words[w] = rng.choice([2, 2, 2, 20, 25, 250])
    assert found(spark, words) == plain(words)


def test_repeated_letters_ties_and_chains(spark):
    words = {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500, "aaaaaaaaaa": 5000, "baaaaaa": 50, "abaaaaa": 50, "zzzzzzz": 2, "zzzzzzzy": 19}
    got = found(spark, words)
    assert got == plain(words)
    assert {(w, root) for w, _, root, *_ in got} >= {("aaaaaaa", "aaaaaaaaaa"), ("aaaaaaaa", "aaaaaaaaaa"), ("zzzzzzz", "zzzzzzz")}


def test_hot_shards_are_cut_again(spark, monkeypatch):
    """Words that share all but a few letters: shards go over both bounds, in the plan and inside a task."""
    monkeypatch.setattr(variants, "MOST_WORDS", 4)
    monkeypatch.setattr(variants, "LEAST_HOT", 2)
    monkeypatch.setattr(variants, "MOST_HOT", 10)
    rng = random.Random(4)
    words = {"common" + "".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))) + rng.choice(["", "ending"]): rng.choice([2, 40, 900]) for _ in range(300)}
    assert found(spark, words) == plain(words)


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert variants.spelling_variants(variants.damaged_words(docs)).collect() == []
    assert found(spark, {"lonesome": 3}) == {("lonesome", None, "lonesome", 3, 0, None)}


def test_count_filter_loses_no_pair_and_drops_others():
    base = [(w, 1) for w in ("abcdefgh", "abcxefgh", "abcdeffh", "abzzefgh")]
    longer = [(w, 1) for w in ("abccdefgh", "abcxxefgh", "abqdefghh")]
    pairs = {(base[i][0], (longer if k else base)[j][0]) for i, j, k in variants.shard_pairs(base, longer, 2, 5)}
    everything = {(a, b) for i, (a, _) in enumerate(base) for b in [x for x, _ in base[:i]] + [x for x, _ in longer] if is_near(a, b) and a[:2] == b[:2] and a[5:] == b[len(b) - 3 :]}
    assert pairs == everything and variants.above([[1, 3, 5], [1, 5, 9], [5]], 2) == [1, 5]
