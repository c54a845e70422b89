import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import ctw, langid
from tidewake.llm.common import WORD_PATTERN

SPEECH = {"en": "the and of that with from this which have were their there", "de": "der und die das mit von nicht werden haben einer durch über", "ru": "это как что они мы был для его она все"}
LOWER = {c: chr(c + 32) for c in range(65, 91)}


def prose(lang, n, rng):
    return " ".join(rng.choice(SPEECH[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang, 30, rng), lang, 1) for i, lang in enumerate(sorted(SPEECH) * 20)] + [(900, None, "en", 1), (901, "words", None, 1)]
    return langid.train_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int"))


def test_languages_and_spans(spark, languages):
    rng = random.Random(2)
    mixed = prose("en", 40, rng) + " " + prose("de", 15, rng)
    texts = [prose("ru", 9, rng), prose("de", 9, rng), mixed, None, "", "12 !!", prose("en", 60_000, rng), "日本語"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id bigint, text string, lang_pred string")
    out = {r.doc_id: r for r in langid.predict_languages(df, languages).collect()}
    assert [out[i].lang_pred for i in range(7)] == ["ru", "de", "en", "und", "und", "und", "en"] and out[None].lang_pred == "ru"
    assert out[7].lang_pred in languages.languages and all(0 <= r.score <= 1 for r in out.values()) and out[3].score == 0
    assert [s.lang for s in out[2].spans] == ["en", "de"] and sum(s.words for s in out[2].spans) == 55
    assert langid.predict_languages(df.limit(0), languages).collect() == []


def test_constant_paths_are_viterbi_paths():
    rng = np.random.default_rng(0)

    def plain(s, penalty):
        value, back = s[0].copy(), []
        for row in s[1:]:
            moved = value.max() - penalty
            back.append(np.where(value >= moved, np.arange(len(row)), value.argmax()))
            value = np.maximum(value, moved) + row
        best = value.max()
        return best

    for _ in range(300):
        s = rng.normal(0, rng.choice([0.5, 2, 5]), (rng.integers(1, 40), 3))
        path = langid.viterbi(s, 3.0)
        got = s[np.arange(len(s)), path].sum() - 3.0 * (np.diff(path) != 0).sum()
        assert got == pytest.approx(plain(s, 3.0))


def test_nothing_learned(spark):
    model = langid.train_languages(spark.createDataFrame([], "text string, lang string"))
    out = langid.predict_languages(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), model).first()
    assert (out.lang_pred, out.score) == ("und", 0.0)


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


def brute_scores(train, texts, depth):
    """Context-tree weighting by the definition, over dictionaries."""
    line = lambda t: (" ".join(re.findall(WORD_PATTERN, (t or "").translate(LOWER))) + "\n").encode()
    counts = collections.defaultdict(lambda: [0, 0])

    def steps(text):
        b = b"\n" * depth + line(text)
        for i in range(depth, len(b)):
            node = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                yield b[i - depth : i], node, bit
                node = node << 1 | bit

    for t in train:
        for context, node, bit in steps(t):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
    children = collections.defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))
    weighted, share = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            weighted[key], share[key] = own, 1.0
        else:
            weighted[key] = np.logaddexp(own, sum(weighted[c] for c in children[key])) - math.log(2)
            share[key] = math.exp(own - math.log(2) - weighted[key])
    out = []
    for t in texts:
        total = 0.0
        for context, node, bit in steps(t):
            done, left, one = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = context[depth - d :], node
                if key not in counts:
                    break
                p = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
                one = done + left * p
                done, left = done + left * share[key] * p, left * (1 - share[key])
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


@pytest.mark.parametrize("strings, words", [(10**6, 10**6), (0, 3)])
def test_scores_equal_brute_force(spark, strings, words):
    rng = random.Random(4)
    texts = [prose(rng.choice(["en", "de"]), rng.randrange(1, 25), rng) for _ in range(30)] + [None, "", "  ", "Zzz QQQ", "ÄÖ äö", "the"]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id bigint, text string, score double")
    out = {r.doc_id: r for r in ctw.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, broadcast_strings=strings, broadcast_words=words).collect()}
    want = brute_scores(train, texts, ctw.DEPTH)
    tokens = [re.findall(WORD_PATTERN, (t or "").translate(LOWER)) + [None] for t in texts]
    c = collections.Counter(w for i, ws in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i in range(len(texts)):
        assert out[i].score == pytest.approx(want[i], abs=1e-6)
        size = len((" ".join(tokens[i][:-1]) + "\n").encode())
        assert out[i].bits_per_byte == pytest.approx(-want[i] * math.log2(10) / size, abs=1e-6)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]))
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)


def test_strings_move_once_for_a_group_of_texts(spark):
    """What is written and joined are distinct strings of groups, not the strings of every text; groups end at a bound."""
    rng = random.Random(5)
    texts = [prose("en", 40, rng) for _ in range(8)] * 40 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").select("row", F.col("row").alias("id"), F.lit(False).alias("held_out"), "text").coalesce(1)
    strings = lambda ts: set(ctw.strings_of([ctw.line_of(ctw.words_of(t)) for t in ts])[0].tolist())
    for held, least in ((10**6, 1), (50, 2)):
        rows = ctw.grouped(df, held=held, chunk=2000).collect()
        assert {r.row: r.text for r in rows if r.key is None} == dict(enumerate(texts))
        groups = collections.defaultdict(lambda: ([], []))
        for r in rows:
            groups[r.group][r.key is None].append(r.text if r.key is None else r.key)
        assert len(groups) >= least
        assert all(len(keys) == len(set(keys)) and set(keys) == strings(ts) for keys, ts in groups.values())
    scores = [{r.id: r.score for r in ctw.score_texts(df, F.col("id") % 7 == 1, id_col="id", broadcast_strings=n).collect()} for n in (0, 10**6)]
    assert scores[0] == scores[1] and len(scores[0]) == len(texts)


def test_scores_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    r = ctw.score_texts(df, F.lit(True)).first()
    assert r.score == pytest.approx(-3 * 8 * math.log10(2)) and (r.n_known, r.train_tokens) == (0, 0)
    assert ctw.score_texts(df.limit(0), F.lit(True)).collect() == []
    assert ctw.score_texts(spark.createDataFrame([(None, "ab"), (None, "ab")], "doc_id bigint, text string"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1).count() == 2


def test_lookup_finds_all_and_only_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    table = ctw.Lookup(keys[::2], keys[::2].astype(float))
    values, hit = table.find(keys)
    assert hit[::2].all() and not hit[1::2].any() and (values[::2] == keys[::2]).all()
