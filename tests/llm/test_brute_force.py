"""Language identification, search and scores against plain versions, with ties, very long texts and clashing columns."""

import collections
import math
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.test_models import LOWER, brute_scores, prose
from tidewake.llm import ctw, exact_dedup, jaccard, langid, mixing, search
from tidewake.llm.common import WORD_PATTERN


def grams(word):
    """Hash buckets of the byte n-grams of a word between spaces."""
    raw = f" {word} ".encode()
    for n in langid.ORDERS:
        for i in range(len(raw) - n + 1):
            code = (int.from_bytes(raw[i : i + n], "big") + (n << 40)) * 0x9E3779B97F4A7C15 % (1 << 64)
            yield code >> 48


def script(word):
    names = collections.Counter()
    for ch in word:
        names[next(n for s, n in reversed(list(zip(langid.SCRIPT_STARTS, langid.SCRIPT_NAMES, strict=True))) if ord(ch) >= s)] += 1
    return min(names, key=lambda s: (-names[s], s))


def plain_language(train, texts):
    words = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    counts, letters = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang in train:
        if lang is not None and text is not None:
            for w in words(text):
                counts[lang].update(grams(w))
                letters[lang][script(w)] += len(w)
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    uses = {x: {s for s, n in letters[x].items() if n >= langid.SCRIPT_SHARE * sum(letters[x].values())} for x in langs}

    def scores(w):
        raw = [sum(math.log((counts[x][g] + 0.5) / total[x]) for g in grams(w)) / langid.TEMPER for x in langs]
        allowed = [script(w) in uses[x] for x in langs]
        return [v if a or not any(allowed) else min(raw) - 4 * langid.SWITCH for v, a in zip(raw, allowed, strict=True)]

    out = []
    for text in texts:
        ws = words(text)
        if not ws or not langs:
            out.append(("und", 0.0, 0))
            continue
        table = [scores(w) for w in ws]
        best = {i: (v, [i]) for i, v in enumerate(table[0])}
        for row in table[1:]:
            best = {j: max(((v - langid.SWITCH * (i != j) + row[j], [*path, j]) for i, (v, path) in best.items()), key=lambda x: x[0]) for j in range(len(langs))}
        path = max(best.values(), key=lambda x: x[0])[1]
        held = collections.Counter()
        for w, j in zip(ws, path, strict=True):
            held[j] += len(w)
        top = min(held, key=lambda j: (-held[j], j))
        out.append((langs[top], held[top] / sum(held.values()), 1 + sum(a != b for a, b in zip(path, path[1:]))))
    return out


def test_languages_equal_a_plain_version(spark):
    rng = random.Random(6)
    train = [(prose(x, rng.randrange(3, 30), rng), x) for x in ("en", "de", "ru") for _ in range(12)] + [("no language", None), (None, "en"), ("", "de")]
    texts = [prose(rng.choice(["en", "de", "ru"]), rng.randrange(1, 20), rng) for _ in range(25)] + [prose("en", 9, rng) + " " + prose(x, 9, rng) for x in ("de", "ru", "de")] + [None, "", "1 2", "zzz", "日本", "ÄÖÜ ж", "½ ② 3²", "x² ½y Ⅷ", "ª٣º", "a\u0301b", "\u0301", "𝒜𝟙", "_a_1b"]
    model = langid.train_languages(spark.createDataFrame(train, "text string, lang string"))
    df = spark.createDataFrame([(i, t, "clash", 0.0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang_pred string, score double")
    found = {r.doc_id: (r.lang_pred, r.score, len(r.spans)) for r in langid.predict_languages(df, model).collect()}
    for i, want in enumerate(plain_language(train, texts)):
        assert found[i][0] == want[0] and found[i][1] == pytest.approx(want[1]) and found[i][2] == want[2], texts[i]


def test_equal_languages_go_to_the_first(spark):
    model = langid.train_languages(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    assert langid.predict_languages(spark.createDataFrame([(1, "same"), (2, "other")], "doc_id bigint, text string"), model).select("lang_pred").distinct().collect() == [("a",)]


def test_scores_of_long_texts_ties_and_missing_ids(spark):
    rng = random.Random(1)
    long = prose("en", 4000, rng)
    texts = [long, long, "the the", None, prose("de", 50, rng)]
    df = spark.createDataFrame([(None, t, 1.0, 2) for t in texts] + [(7, "x " * 30_000, 1.0, 2)], "doc_id bigint, text string, base_score double, row int")
    out = ctw.score_texts(df, F.col("doc_id") == 7, broadcast_words=5).collect()
    want = brute_scores(texts, texts, ctw.DEPTH)
    assert sorted(r.score for r in out if r.doc_id is None) == pytest.approx(sorted(want), rel=1e-9)
    held = next(r for r in out if r.doc_id == 7)
    assert held.held_out and held.n_tokens == 30_001 and held.bits_per_byte > 0 and not any(r.held_out for r in out if r.doc_id is None)


def test_search_of_ties_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 16)
    monkeypatch.setattr(search, "BLOCKS_AT_ONCE", 2)
    rng = random.Random(3)
    texts = ["alpha beta"] * 30 + [" ".join(f"w{rng.randrange(400)}" for _ in range(60_000)), "alpha " * 5000, None, ""] + ["beta gamma"] * 8
    df = spark.createDataFrame([(i if i % 9 else None, t, 0, 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, rank int, score double").repartition(3)
    found = search.search(df, F.col("doc_id") == 1, k=7).orderBy("rank").collect()
    lengths = [len(re.findall(WORD_PATTERN, (t or "").translate(LOWER))) for t in texts]
    n, mean = len(texts), sum(lengths) / len(texts)
    tf = [collections.Counter(re.findall(WORD_PATTERN, (t or "").translate(LOWER))) for t in texts]
    score = lambda i: sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for w in ("alpha", "beta") if tf[i][w] for d in [sum(w in c for c in tf)])
    ids = [i if i % 9 else None for i in range(n)]
    want = sorted((i for i in range(n) if score(i) > 0), key=lambda i: (-round(score(i), 9), ids[i] is None, ids[i] or 0))[:7]
    assert [(r.doc_id, r.query_id) for r in found] == [(ids[i], 1) for i in want]
    assert [r["score"] for r in found] == pytest.approx([score(i) for i in want])


def test_words_that_share_a_hash_are_seen(spark):
    """In one shard and across shards: equal keys with other check bits are a clash."""
    row = lambda keys, checks, clash: ([1], [1], keys, checks, list(range(len(keys) + 1)), [0] * len(keys), [1] * len(keys), clash)
    schema = f"ids array<bigint>, {search._INDEX}"
    seen = lambda *rows: {r.key: (r.df, r.clash) for r in search._frequencies(spark.createDataFrame(list(rows), schema)).collect()}
    assert seen(row([5, 6], [1, 2], False), row([5], [1], False)) == {5: (2, False), 6: (1, False)}
    assert seen(row([5, 6], [1, 2], False), row([5], [3], False))[5][1] and seen(row([5], [1], True))[5][1]


def test_clashing_names_in_all_helpers(spark):
    schema = "doc_id bigint, text string, source string, row bigint, id bigint, u double, size int, key string, level int, `a.b` string"
    df = spark.createDataFrame([(1, "a b c", "s", 9, 9, 0.1, 9, "k", 9, "n"), (2, "d e", "t", 9, 9, 0.1, 9, "k", 9, "n")], schema)
    assert {r.doc_id for r in exact_dedup.exact_dedup(df).collect()} == {1, 2} and mixing.mix_sources(df).count() == 2
    for kept in (exact_dedup.keep_one(df), mixing.mixed_rows(df), jaccard.keep_first(df)):
        assert kept.columns == df.columns and {r["a.b"] for r in kept.collect()} <= {"n"}
