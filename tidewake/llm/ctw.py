"""Language-model scores by context-tree weighting over bytes, beside a unigram baseline.

A text is its lower-cased words, joined by a space and ended by a newline. Every byte is eight
binary decisions, each in the context of the decisions before it and of up to ``DEPTH`` bytes
before the byte. A node (context, decisions) has a Krichevsky-Trofimov estimate from its counts;
its weighted probability is half its own estimate's and half the product of its children's, from
the deepest contexts up. A prediction mixes the estimates of all depths on the way down, each
node passing on the share that its children's probability has in its own; the deepest node that
training saw takes what is left.

The counts that all nodes need are those of byte strings of ``DEPTH + 1`` bytes. They are counted
over all texts (with count 0 where only unseen texts have them), so that the model is a table:
string, log-probability of its last byte. Contexts of three bytes and more are worked out where
their strings are, strings being dealt by their last three context bytes; the counts of shorter
ones are at most 2^24 and are put together on the driver. Scoring looks strings up: in a
broadcast table while a count shows that it has at most ``BROADCAST_STRINGS`` rows, else by a
join. Words of the baseline are looked up in the same two ways, the most frequent in a broadcast
table of bounded size and all others by a join.

Defined results: null text counts as empty, whose only token is the end; rows without an id are
learned from; extra columns are ignored; repeated rows are learned from as often as they occur
and get equal scores; an empty table gives an empty table. Words and strings of all texts are
used, whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import WORD_PATTERN, Tables, few, lower_az

DEPTH = 5
#: Context bytes by which strings are dealt; shorter contexts are worked out on the driver.
DEALT = 3
BROADCAST_STRINGS = 4_000_000
BROADCAST_WORDS = 1_000_000
#: Distinct words, and strings, that a worker holds before it passes their counts on.
HELD_WORDS, HELD_STRINGS = 200_000, 1_500_000
CHUNK_BYTES = 4_000_000
#: Bytes of the texts of a group, about; it ends before where it has more than HELD_STRINGS distinct strings.
GROUP_BYTES = 128_000_000

_WORDS = re.compile(WORD_PATTERN).findall
_LN10 = float(np.log(10))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORDS(lower_az(text))


def line_of(words: list[str]) -> bytes:
    return (" ".join(words) + "\n").encode()


def strings_of(lines: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the depth + 1 bytes that end at every byte, and where each line starts; before a line stand newlines."""
    pad = b"\n" * depth
    b = np.frombuffer(pad + pad.join(lines), dtype=np.uint8)
    code = np.zeros(len(b) - depth, dtype=np.int64)
    for i in range(depth + 1):
        code = (code << 8) | b[i : len(b) - depth + i]
    lengths = np.array([len(x) for x in lines])
    keep = np.ones(len(code), dtype=bool)
    ends = np.cumsum(lengths + depth)
    for i in range(depth):
        keep[(ends[:-1] - depth + i)] = False
    return code[keep], np.concatenate([[0], np.cumsum(lengths)[:-1]])


class WordKeys(dict):
    """word → signed 64-bit key, of bounded size."""

    def __missing__(self, word: str) -> int:
        k = word_key(word)
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = k
        return k


def word_key(word: str) -> int:
    return max(xxhash.xxh64_intdigest(word) - (1 << 63), _FREE + 1)


#: What a free slot of a lookup table holds.
_FREE = -(1 << 63)


class Lookup:
    """Open addressing over arrays: a few gathers for each key where a binary search needs twenty."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(int(2 * len(keys)).bit_length(), 4)
        self.keys, self.values = np.full(1 << self.bits, _FREE), np.zeros(1 << self.bits)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] == _FREE)
            slots, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[slots], self.values[slots] = keys[left[taken]], values[left[taken]]
            stay = np.ones(len(left), dtype=bool)
            stay[taken] = False
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, and which of them are there."""
        at = self._home(keys)
        held = self.keys[at]
        out, hit = self.values[at], held == keys
        rest = np.flatnonzero(~hit & (held != _FREE))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            found = held == keys[rest]
            out[rest[found]], hit[rest[found]] = self.values[at[found]], True
            going = ~found & (held != _FREE)
            rest, at = rest[going], at[going]
        return out, hit


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series after a shift by eight."""
    y = x + 8
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one context length: keys (context << 8 | decisions), counts, weighted log-probability."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = log_kt(n0, n1)
        if below is None:
            self.weighted, self.share = own, np.ones(len(own))
        else:
            self.weighted = np.logaddexp(own, below) - np.log(2)
            self.share = np.exp(own - np.log(2) - self.weighted)
        self.seen = n0 + n1 > 0
        self.one = (n1 + 0.5) / (n0 + n1 + 1)

    def up(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """keys, n0, n1 and summed weighted log-probability of the parents, which have ``length`` context bytes."""
        parents, at = np.unique(self.keys & ((1 << (8 * length + 8)) - 1), return_inverse=True)
        total = lambda v: np.bincount(at, weights=v, minlength=len(parents))
        return parents, total(self.n0), total(self.n1), total(np.where(self.seen, self.weighted, 0.0))


def deepest(codes: np.ndarray, counts: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The level of full contexts; node keys and bits of every string, eight of each."""
    byte = codes & 255
    steps = np.arange(8)
    nodes = (1 << steps)[None, :] | (byte[:, None] >> (8 - steps)[None, :])
    bits = (byte[:, None] >> (7 - steps)[None, :]) & 1
    keys = ((codes >> 8)[:, None] << 8) | nodes
    distinct, at = np.unique(keys.ravel(), return_inverse=True)
    weights = np.repeat(counts.astype(float), 8)
    ones = np.bincount(at, weights=weights * bits.ravel(), minlength=len(distinct))
    both = np.bincount(at, weights=weights, minlength=len(distinct))
    return Level(distinct, both - ones, ones, None), at.reshape(-1, 8), bits


def upper_levels(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, length: int) -> list[Level]:
    """Levels ``length`` down to 0, from the counts of the first and what its children give."""
    levels = [Level(keys, n0, n1, below)]
    for k in range(length - 1, -1, -1):
        levels.append(Level(*levels[-1].up(k)))
    return levels


class Mixture:
    """For nodes on their way down: what is mixed so far, what is left, and the prediction if the deepest node seen takes what is left."""

    def __init__(self, done: np.ndarray, left: np.ndarray, one: np.ndarray):
        self.done, self.left, self.one = done, left, one

    @classmethod
    def start(cls, n: int) -> Mixture:
        return cls(np.zeros(n), np.ones(n), np.full(n, 0.5))

    def through(self, levels: list[Level], lengths: list[int]) -> Mixture:
        """Mixes in ``levels``, shortest contexts first, for the nodes of the last one; a node that training didn't see changes nothing."""
        keys = levels[-1].keys
        for level, length in zip(levels, lengths, strict=True):
            at = np.searchsorted(level.keys, keys & ((1 << (8 * length + 8)) - 1))
            seen, share, one = level.seen[at], level.share[at], level.one[at]
            self.one = np.where(seen, self.done + self.left * one, self.one)
            self.done = np.where(seen, self.done + self.left * share * one, self.done)
            self.left = np.where(seen, self.left * (1 - share), self.left)
        return self


def count_all(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n for rows (train, text): strings (kind 0, all texts), words (1) and texts (2) of training texts."""

    def run(batches):
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        lines: dict[bool, list[bytes]] = {True: [], False: []}
        size = {True: 0, False: 0}
        texts = 0

        def pack(kind: int, keys: np.ndarray, n: np.ndarray):
            for i in range(0, len(keys), 500_000):
                k = keys[i : i + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + 500_000].astype(np.int64))], names=["kind", "key", "n"])

        def merged():
            if not parts:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)

        def take(train: bool):
            if lines[train]:
                codes, n = np.unique(strings_of(lines[train], depth)[0], return_counts=True)
                parts.append((codes, n if train else np.zeros(len(codes), np.int64)))
                lines[train], size[train] = [], 0

        def word_rows():
            yield from pack(1, np.fromiter(map(word_key, words), dtype=np.int64, count=len(words)), np.fromiter(words.values(), dtype=np.int64, count=len(words)))
            words.clear()

        for b in batches:
            for train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words_of(text)
                lines[train].append(line_of(found))
                size[train] += len(lines[train][-1])
                if train:
                    words.update(found)
                    texts += 1
                if size[train] > CHUNK_BYTES:
                    take(train)
                    if sum(len(p[0]) for p in parts) > HELD_STRINGS:
                        one = merged()
                        parts = [one]
                        if len(one[0]) > HELD_STRINGS // 2:
                            yield from pack(0, *one)
                            parts = []
                if len(words) > HELD_WORDS:
                    yield from word_rows()
        take(True)
        take(False)
        yield from pack(0, *merged())
        yield from word_rows()
        if texts:
            yield from pack(2, np.zeros(1, np.int64), np.array([texts]))

    return docs.mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _partition_arrays(batches) -> tuple[np.ndarray, np.ndarray]:
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def string_model(tables: Tables, strings: DataFrame, depth: int = DEPTH, partitions: int = 12) -> DataFrame:
    """key, logp for rows (key, n): natural log-probability of each string's last byte after the others."""
    by_context = lambda: strings.repartition(partitions, F.shiftright(F.col("key"), 8).bitwiseAND((1 << (8 * DEALT)) - 1))

    def local(codes: np.ndarray, counts: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
        first, at, bits = deepest(codes, counts)
        levels = [first]
        for k in range(depth - 1, DEALT - 1, -1):
            levels.append(Level(*levels[-1].up(k)))
        return levels, at, bits

    def upward(batches):
        codes, counts = _partition_arrays(batches)
        if len(codes):
            levels, _, _ = local(codes, counts)
            arrays = levels[-1].up(DEALT - 1)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["key", "n0", "n1", "below"])

    sums = by_context().mapInArrow(upward, "key bigint, n0 double, n1 double, below double").groupBy("key")
    top = sums.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).orderBy("key").toArrow()
    keys, n0, n1, below = (top.column(i).to_numpy() for i in range(4))
    if not len(keys):
        return strings.select("key", F.lit(0.0).alias("logp"))
    levels = upper_levels(keys, n0, n1, below, DEALT - 1)[::-1]
    top = Mixture.start(len(keys)).through(levels, list(range(DEALT)))
    shared = tables.spark.sparkContext.broadcast((keys, top.done, top.left, top.one))

    def downward(batches):
        codes, counts = _partition_arrays(batches)
        if not len(codes):
            return
        found, at, bits = local(codes, counts)
        top_keys, *mixed = shared.value
        place = np.searchsorted(top_keys, found[0].keys & ((1 << (8 * DEALT)) - 1))
        one = Mixture(*(m[place] for m in mixed)).through(found[::-1], list(range(DEALT, depth + 1))).one
        p = np.where(bits == 1, one[at], 1 - one[at])
        logp = np.log(p).sum(axis=1)
        order = np.argsort(codes)
        for i in range(0, len(order), 500_000):
            o = order[i : i + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(codes[o]), pa.array(logp[o])], names=["key", "logp"])

    return tables.write(by_context().mapInArrow(downward, "key bigint, logp double"))


def grouped(source: DataFrame, depth: int = DEPTH, held: int = HELD_STRINGS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """group, key, row, id, held_out, text: the rows of ``source`` with their group (key null), and each distinct string of a group (all others null)."""

    def run(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        codes, lines, size = np.empty(0, np.int64), [], 0

        def merged() -> np.ndarray:
            return np.unique(np.concatenate([codes, np.unique(strings_of(lines, depth)[0])])) if lines else codes

        def key_rows(b: pa.RecordBatch):
            for i in range(0, len(codes), 500_000):
                k = codes[i : i + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part | number)), pa.array(k), *(pa.nulls(len(k), c.type) for c in b.columns)], names=["group", "key", *b.schema.names])

        for b in few(batches, 128):
            new = [line_of(words_of(t)) for t in b.column("text").to_pylist()]
            lines += new
            size += sum(map(len, new))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part | number)), pa.nulls(b.num_rows, pa.int64()), *b.columns], names=["group", "key", *b.schema.names])
            if size > chunk:
                codes, lines, size = merged(), [], 0
            if len(codes) > held:
                yield from key_rows(b)
                codes, number = np.empty(0, np.int64), number + 1
        codes = merged()
        if len(codes):
            yield from key_rows(b)

    return source.mapInArrow(run, T.StructType([T.StructField("group", T.LongType()), T.StructField("key", T.LongType()), *(T.StructField(f.name, f.dataType) for f in source.schema)]))


def _table(df: DataFrame, value: str) -> Lookup:
    found = df.select("key", value).toArrow()
    return Lookup(found.column(0).to_numpy(), found.column(1).to_numpy().astype(float))


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, broadcast_strings: int = BROADCAST_STRINGS, broadcast_words: int = BROADCAST_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row; rows with ``held_out`` aren't learned from.

    ``bits_per_byte`` is the code length of a text's words, a space between and a newline at the end, for each of these bytes.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "ctw")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = tables.write(count_all(source.select((~F.col("held_out")).alias("train"), "text"), depth))
    strings, words = counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1").select("key", "n")
    totals = counts.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    rows, sums = {r["kind"]: r["rows"] for r in totals}, {r["kind"]: r["n"] for r in totals}
    n_strings, ends = rows.get(0, 0), sums.get(2, 0)
    n = sums.get(1, 0) + ends
    v = rows.get(1, 0) + (1 if ends else 0)
    floor = n + 0.5 * (v + 1)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_strings // 500_000))
    model = string_model(tables, strings, depth, partitions)
    in_memory = n_strings <= broadcast_strings
    # the least count at which words are still few enough to broadcast, from the counts of counts
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n"))
    least, so_far = 1 << 62, 0
    for r in by_count.toLocalIterator():
        so_far += r["c"]
        if so_far > broadcast_words:
            break
        least = r["n"]
    frequent = _table(words.filter(F.col("n") >= least), "n")
    frequent.values = np.log10((frequent.values + 0.5) / floor)
    known = spark.sparkContext.broadcast((frequent, _table(model, "logp") if in_memory else None))
    settled = so_far <= broadcast_words  # every word of the training texts is in the broadcast table

    def scores(whole: pa.RecordBatch, frequent: Lookup, model_table: Lookup, ids: WordKeys):
        for start in range(0, whole.num_rows, 128):
            b = whole.slice(start, 128)
            lists = [words_of(t) for t in b.column("text").to_pylist()]
            out = {k: [] for k in ("n_tokens", "n_known", "base", "rare")}
            lines = [line_of(ws) for ws in lists]
            codes, starts = strings_of(lines, depth)
            score = np.add.reduceat(model_table.find(codes)[0], starts) / _LN10
            for ws in lists:
                mine = np.fromiter(map(ids.__getitem__, ws), dtype=np.int64, count=len(ws))
                logs, hit = frequent.find(mine)
                out["n_tokens"].append(len(ws) + 1)
                out["n_known"].append(int(hit.sum()) + (1 if ends else 0))
                rest, m = np.unique(mine[~hit], return_counts=True)
                base = logs[hit].sum() + np.log10((ends + 0.5) / floor)
                if settled:
                    base += m.sum() * np.log10(0.5 / floor)
                    rest, m = rest[:0], m[:0]
                out["base"].append(float(base))
                out["rare"].append([{"key": x, "m": y} for x, y in zip(rest.tolist(), m.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("key", pa.int64()), ("m", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("held_out"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(score, pa.float64()), pa.array([len(x) for x in lines], pa.int64()), pa.array(out["rare"], kind)],
                names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_scored", "rare"],
            )

    def run(batches):
        frequent, model_table = known.value
        ids = WordKeys()
        for whole in batches:
            yield from scores(whole, frequent, model_table, ids)

    def run_groups(batches):
        """The same for rows by group, in each the strings with their values and then the texts."""
        frequent, _ = known.value
        ids, at, parts, model_table = WordKeys(), None, [], None
        for whole in batches:
            group, is_text = whole.column("group").to_numpy(), whole.column("key").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((group[1:] != group[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(group)], strict=True):
                if start == end:
                    continue
                b = whole.slice(start, end - start)
                if group[start] != at:
                    at, parts, model_table = group[start], [], None
                if not is_text[start]:
                    parts.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "logp")])
                    continue
                if model_table is None:
                    model_table, parts = Lookup(*(np.concatenate(p) for p in zip(*parts, strict=True))), []
                yield from scores(b, frequent, model_table, ids)

    listed = "array<struct<key:bigint,m:bigint>>"
    source = source.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    fields = [source.schema["row"], source.schema["id"], source.schema["held_out"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score")), T.StructField("n_scored", T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(c, T._parse_datatype_string(listed)) for c in ("rare",))])
    if in_memory:
        scored = source.mapInArrow(run, schema)
    else:
        # few large groups: the more texts share a table, the fewer strings move
        texts = max(-(-sums.get(0, 0) // group_bytes), 3 * spark.sparkContext.defaultParallelism)
        marked = tables.write(grouped(source.coalesce(texts), depth))
        found = marked.filter("key IS NOT NULL").join(model, "key")
        rows_of = marked.filter("key IS NULL").withColumn("logp", F.lit(None).cast("double")).unionByName(found)
        rows_of = rows_of.repartition(max(partitions, texts), "group").sortWithinPartitions("group", F.col("key").asc_nulls_last())
        scored = tables.write(rows_of.mapInArrow(run_groups, schema))
        tables.drop(marked)
    plain = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_scored"]
    if not settled:
        if in_memory:
            scored = tables.write(scored)
        rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.key", "x.m")
        rare = rare.join(words.filter(F.col("n") < least), "key", "left")
        extra = rare.select("row", F.when(F.col("n") > 0, F.col("m")).otherwise(0).alias("known"), (F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / floor)).alias("base"))
        extra = extra.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        scored = scored.join(extra, "row", "left").select("row", "id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), (F.col("base_score") + zero("base")).alias("base_score"), "score", "n_scored")
    return scored.select(*plain).select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * math.log2(10) / F.col("n_scored")).alias("bits_per_byte"))
