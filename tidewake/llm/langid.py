"""Language identification for whole, possibly mixed-language texts.

A word's script (by Unicode range) narrows the languages to those that use it in the training
texts. The rest get a score from hashed byte n-grams of the word, and Viterbi over the words,
with a penalty for each change of language, labels spans. The document's language is the one
whose spans hold most letters; its score is their share.

Most texts are in one language, where the path is constant: this is so if no run of words gains
more than half a penalty under another language (k deviating spans cost k - 1 penalties at least, k
if any word keeps the language, and a single span over all words gains nothing), a test over
running sums. Only other texts go through the step-by-step recursion.

The model has a fixed size: one number for each language and hash bucket. All training texts
are counted, whole.

Defined results: null texts and texts without letters are ``und`` with score 0; equal scores go
to the first language by code point; rows without a language or text teach nothing; if nothing
was learned, every text is ``und``. Repeated rows count as often as they occur; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Cost of a change of language, in nats of tempered word scores.
SWITCH = 6.0
#: N-grams of several orders overlap: their evidence is divided by this.
TEMPER = 2.0
#: A language uses a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: Distinct words that a worker remembers.
KNOWN_WORDS = 300_000

#: First code point of ranges, and the script of each.
SCRIPT_STARTS = [0x0000, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00]
SCRIPT_NAMES = ["latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han", "other"]
SCRIPTS = sorted(set(SCRIPT_NAMES))

_LETTERS = re.compile(r"[^\W\d_]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def script_of(word: str) -> int:
    """Index in SCRIPTS of the script of most of a word's characters."""
    if not _BEYOND_LATIN.search(word):
        return SCRIPTS.index("latin")
    found = Counter(SCRIPT_NAMES[bisect_right(SCRIPT_STARTS, ord(c)) - 1] for c in word)
    return SCRIPTS.index(min(found, key=lambda s: (-found[s], s)))


def words_of(text: str | None) -> list[str]:
    """Runs of letters. The pattern also takes numbers that aren't decimal digits (fractions, superscripts, Roman numerals); these part words."""
    found = _LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of ``" word "`` in bytes, and the index of the word of each."""
    raw = (" " + "  ".join(words) + " ").encode()
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(w.encode()) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    out, who = [], []
    code = np.zeros(len(b), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        if n not in ORDERS:
            continue
        inside = owner[: len(b) - n + 1] == owner[n - 1 :]
        h = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(48))[inside].astype(np.int64))
        who.append(owner[: len(b) - n + 1][inside])
    return np.concatenate(out), np.concatenate(who)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: log-probabilities, languages x buckets
    logs: np.ndarray
    #: languages x scripts
    uses: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """words x languages; languages that don't use the word's script get the lowest score."""
        buckets, who = ngram_buckets(words)
        out = np.stack([np.bincount(who, weights=row[buckets], minlength=len(words)) for row in self.logs], axis=1) / TEMPER
        allowed = self.uses[:, [script_of(w) for w in words]].T
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, out, out.min(axis=1, keepdims=True) - 4 * SWITCH)


def viterbi(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each row, where each change of label costs ``penalty``."""
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(len(scores), best)
    n, k = scores.shape
    value, labels = scores[0].tolist(), range(k)
    back = []
    for row in scores[1:].tolist():
        top = max(value)
        at, moved = value.index(top), top - penalty
        back.append([at if moved > value[j] else j for j in labels])
        value = [(moved if moved > value[j] else value[j]) + row[j] for j in labels]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def train_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all whole texts of ``docs``; what reaches the driver is languages x (buckets + scripts) rows at most."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        pending: dict[str, Counter] = {}

        def flush():
            for lang, words in pending.items():
                row = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                keys, times = list(words), np.fromiter(words.values(), dtype=np.int64)
                for at in range(0, len(keys), 50_000):
                    part, n = keys[at : at + 50_000], times[at : at + 50_000]
                    buckets, who = ngram_buckets(part)
                    row[:BUCKETS] += np.bincount(buckets, weights=n[who], minlength=BUCKETS).astype(np.int64)
                    np.add.at(row, BUCKETS + np.array([script_of(w) for w in part]), n * np.array([len(w) for w in part]))
            pending.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pending.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, pending.values())) > KNOWN_WORDS:
                flush()
        flush()
        for lang, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = tuple(sorted(set(found.column("lang").to_pylist())))
    counts = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    at = {x: i for i, x in enumerate(names)}
    counts[[at[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams, letters = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return LanguageModel(names, np.log(grams / grams.sum(axis=1, keepdims=True)), uses & (letters > 0))


def predict_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, spans: spans are arrays of (lang, words) in text order."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size for each language

    def run(batches):
        m = shared.value
        index: dict[str, int] = {}
        table = np.empty((0, len(m.languages)))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                words = [words_of(t) for t in b.column(1).to_pylist()] if m.languages else [[]] * b.num_rows
                new = list(dict.fromkeys(w for ws in words for w in ws if w not in index))
                if len(index) + len(new) > KNOWN_WORDS:
                    index, table = {}, table[:0]
                    new = list(dict.fromkeys(w for ws in words for w in ws))
                if new:
                    index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                    parts = [m.word_scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
                    table = np.vstack([table, *parts])
                langs, scores, spans = [], [], []
                for ws in words:
                    if not ws:
                        langs.append("und"), scores.append(0.0), spans.append([])
                        continue
                    path = viterbi(table[np.fromiter(map(index.__getitem__, ws), dtype=np.int64, count=len(ws))])
                    letters = np.bincount(path, weights=np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)), minlength=len(m.languages))
                    edges = np.flatnonzero(np.diff(path)) + 1
                    bounds = [0, *edges.tolist(), len(path)]
                    langs.append(m.languages[int(letters.argmax())])
                    scores.append(float(letters.max() / letters.sum()))
                    spans.append([{"lang": m.languages[path[i]], "words": j - i} for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["id", "lang_pred", "score", "spans"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())])
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
