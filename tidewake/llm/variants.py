"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter.

Words are letter runs of the texts; occurrences are damaged by a fixed rule (a code point goes where
a checksum of document and run says so), counted, and kept from ``min_count`` occurrences of
``min_length`` code points on. Two words are near if one inserted, deleted or replaced code point
makes one of the other.

The index is dealt out before it is built. The shorter of two near words is cut into three pieces;
an edit touches one of them, so the two words agree on everything before and after that piece, and
meet in the shard of this (piece, before, after): a word goes to three shards as the shorter or
equally long one, and to three as the longer one. Inside a shard the strings of the piece are
indexed by positional bigrams (with marks for both ends). A string of m code points has m + 1 of
them; a replacement spoils two at most and moves none, an insertion spoils one and moves those
behind it by one place. So posting lists of the same length and place (for words one longer, of the
same place and of the next) are merged by a heap, and words that turn up m - 1 times (m times) at
least are verified. A pair is taken in the one shard whose piece holds the place where the two first
differ; counts and best forms are added up in the shard, so pairs never leave it.

A shard may hold any share of all words (a long common beginning with many endings). Those above a
fifty-thousandth of all rows are found by a count and cut again, by piece of their piece, before any
rows are gathered; smaller ones above ``MOST_WORDS`` are cut again in their task. Pieces of one code
point end this: the alphabet bounds what a shard of them can hold.

Defined results: null text has no words; a null id counts as an empty one in the checksum; repeated
rows count as often as they are there; ties of forms go to the smallest word in code-point order;
extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from heapq import merge
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import LEAST_HOT, MOST_HOT, Tables, lower_ascii

RUN = r"[A-Za-zÀ-ÿ]"
#: One occurrence in so many loses a code point.
DAMAGE = 31
#: A form occurs so many times as often.
RATIO = 10
PIECES = 3
#: Words of a shard that are indexed at once; larger shards are cut again.
MOST_WORDS = 128

#: Words of a shard: (word, occurrences) of the base length, and of one code point more.
Words = Sequence[tuple[str, int]]


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word, n: lower-cased runs after the damage, of a minimal length and number of occurrences."""
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(id_text.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGE == 0, F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# ---- one shard


def bigrams(piece: str) -> list[tuple[int, str]]:
    marked = f"^{piece}$"
    return [(k, marked[k : k + 2]) for k in range(len(marked) - 1)]


def above(lists: Iterable[list[int]], least: int) -> list[int]:
    """Numbers that turn up ``least`` times or more in sorted lists, by a heap over the lists."""
    return [x for x, same in groupby(merge(*lists)) if sum(1 for _ in same) >= least]


def shard_pairs(base: Words, longer: Words, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """(i, j, whether j counts ``longer``) for the near words of a shard whose edit lies in base[start:end]."""
    m, length = end - start, len(base[0][0])
    index: dict[tuple[int, str], list[int]] = defaultdict(list)
    for j, (word, _) in enumerate(longer):
        for gram in bigrams(word[start : end + 1]):
            index[gram].append(j)
    own: dict[tuple[int, str], list[int]] = defaultdict(list)
    for i, (word, _) in enumerate(base):
        grams = bigrams(word[start:end])
        lists = [own[g] for g in grams if g in own]
        for j in above(lists, m - 1) if m > 1 else range(i):
            if one_edit(base[j][0], word, start, end, length):
                yield i, j, False
        for g in grams:
            own[g].append(i)
        if longer:
            lists = [index[g] for k, gram in grams for g in ((k, gram), (k + 1, gram)) if g in index]
            for j in above(lists, m):
                if one_edit(word, longer[j][0], start, end, length):
                    yield i, j, True


def one_edit(a: str, b: str, start: int, end: int, length: int) -> bool:
    """Whether b is a with one code point replaced or inserted, first unlike a at a place of the piece."""
    at = len(commonprefix((a, b)))
    return (start <= at < end or at == end == length) and (a[at + 1 :] if len(b) == length else a[at:]) == b[at + 1 :]


def cut(start: int, end: int, pieces: int = PIECES) -> list[tuple[int, int]]:
    """Pieces of a range; none is empty."""
    bounds = [start + (end - start) * k // pieces for k in range(pieces + 1)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


def shards(base: Words, longer: Words, start: int, end: int) -> Iterator[tuple[Words, Words, int, int]]:
    """The shard itself, or what it falls into where it is large."""
    if len(base) + len(longer) <= MOST_WORDS or end - start == 1:
        if base:
            yield base, longer, start, end
        return
    for a, b in cut(start, end):
        parts: dict[tuple[str, str], tuple[list, list]] = defaultdict(lambda: ([], []))
        for row in base:
            parts[row[0][:a], row[0][b:]][0].append(row)
        for row in longer:
            parts[row[0][:a], row[0][b + 1 :]][1].append(row)
        for left, right in parts.values():
            if left and len(left) + len(right) > 1:
                yield from shards(left, right, a, b)


def shard_totals(words: Words, length: int, start: int, end: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words in this shard, occurrences of the best of them, the best) for all words with any."""
    found: dict[str, tuple[int, int, str]] = {}
    base, longer = [w for w in words if len(w[0]) == length], [w for w in words if len(w[0]) > length]
    for left, right, a, b in shards(base, longer, start, end):
        for i, j, is_longer in shard_pairs(left, right, a, b):
            for (word, _), (other, n) in (pair := (left[i], (right if is_longer else left)[j])), pair[::-1]:
                count, best_n, best = found.get(word, (0, 0, ""))
                if n > best_n or n == best_n and other < best:
                    best_n, best = n, other
                found[word] = count + 1, best_n, best
    for word, rest in found.items():
        yield word, *rest


_TOTALS = "word string, n_near bigint, best_n bigint, best string"


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are in order of their shard; the last shard of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []

    def closed(table: pa.Table) -> pa.RecordBatch:
        keys = table["key"].to_numpy()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        last = np.r_[first[1:], len(keys)]
        several = last - first > 1
        out: list[tuple[str, int, int, str]] = []
        for a, b in zip(first[several].tolist(), last[several].tolist()):
            part = table.slice(a, b - a)
            words = list(zip(part["word"].to_pylist(), part["n"].to_pylist()))
            out += shard_totals(words, *(part[c][0].as_py() for c in ("length", "start", "end")))
        columns = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch["key"].to_numpy()
        unlike = np.flatnonzero(keys != keys[-1])
        begins = int(unlike[-1]) + 1 if len(unlike) else 0
        if held and held[0]["key"][0].as_py() != keys[0].item() or begins:
            yield closed(pa.Table.from_batches([*held, batch.slice(0, begins)]))
            held = []
        held.append(batch.slice(begins))
    if held:
        yield closed(pa.Table.from_batches(held))


# ---- all shards


def _sharded(words: DataFrame, start: Column, end: Column, length: Column) -> DataFrame:
    """word, n, length, start, end, key: a row for each shard of each word; ``start`` and ``end`` bound the piece that is cut."""
    each = words.select("word", "n", length.alias("length"), start.cast("int").alias("from"), end.cast("int").alias("to"))
    each = each.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(PIECES)))))
    first, last = ((F.col("from") + F.floor((F.col("to") - F.col("from")) * k / PIECES)).cast("int") for k in (F.col("k"), F.col("k") + 1))
    each = each.select("word", "n", "length", first.alias("start"), last.alias("end")).filter("start < end")
    behind = F.col("end") + 1 + F.length("word") - F.col("length")
    return each.withColumn("key", F.xxhash64("length", "start", "end", F.substring("word", F.lit(1), F.col("start")), F.substring("word", behind, F.length("word"))))


def near_words(words: DataFrame, min_length: int = 7) -> DataFrame:
    """word, n_near, best_n, best for all words (word, n) with a near word; words are distinct."""
    tables = Tables(words.sparkSession, "variants")
    roles = words.withColumn("length", F.explode(F.array(F.length("word"), F.length("word") - 1))).filter(F.col("length") >= min_length)
    rows, found = _sharded(roles, F.lit(0), F.col("length"), F.col("length")), []
    limit = max(rows.count() // MOST_HOT, 8 * LEAST_HOT)
    while True:
        hot = tables.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("end") - F.col("start")).alias("letters")).filter((F.col("rows") > limit) & (F.col("letters") > 1)).select("key"))
        some = not hot.isEmpty()
        cold = rows.join(F.broadcast(hot), "key", "left_anti") if some else rows
        found.append(tables.write(cold.repartition("key").sortWithinPartitions("key").mapInArrow(_totals, _TOTALS)))
        if not some:
            break
        again = tables.write(rows.join(F.broadcast(hot), "key", "left_semi"))
        rows = _sharded(again.withColumnsRenamed({"start": "from", "end": "to"}), F.col("from"), F.col("to"), F.col("length"))
    parts = found[0]
    for f in found[1:]:
        parts = parts.unionByName(f)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    totals = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return totals.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): forms are followed to the last one, twice as far in each round. Forms make no circles."""
    tables = Tables(forms.sparkSession, "variant-roots")
    now = tables.write(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        joined = tables.write(joined)
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, min_length: int = 7) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words (word, n) of ``min_length`` code points at least."""
    tables = Tables(words.sparkSession, "variant-forms")
    words = tables.write(words.select("word", "n"))
    known = words.join(near_words(words, min_length), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = tables.write(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(known.filter("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
