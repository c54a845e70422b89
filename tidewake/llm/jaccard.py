"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Its sketch has two parts, for each band of
set sizes that it takes part in: parity bits (each shingle flips one bit), whose Hamming distance
to another document's can't exceed the number of elements in only one of the sets; and K blocks,
each the XOR of the hashes of the shingles that fall in it. For similarity t at most
D = floor(n (1 - t) / t) elements differ, n being the smaller set's size, so at most D blocks do,
and documents are joined on (band, block number, XOR). Blocks that many documents share are left
out: of its K blocks each document keeps the D + 1 rarest. The rarest block that a pair has in
common is among them on both sides, as at most D rarer ones can differ. Pairs are compared by
size, then by Hamming distance, and what is left is verified on the sets.

Documents with equal sets are one class and are joined once. Of the classes that share a key, each
is first verified against the first of them; then the first of each component found so far against
that of the key's first component; and what still shares a key across components is compared pair by
pair, a pair of many keys under the first that it shares. So no link that joins components is left
out, and a group of many near copies isn't made into all of its pairs. Links lie inside components,
and there all of them are counted, each class with its members: a component is cut into chunks of a
bounded number of elements, each two chunks meet in one task, and a product of their incidence
matrices gives the size of every intersection.

Defined results: null and empty texts, and texts without words, have no shingles and are linked
with nothing; a text with fewer words than a shingle has one shingle, the whole sequence; rows
with equal sets are linked, repeated rows included; the component's id is its smallest id (null
if all are null); extra columns are ignored, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import WORD_PATTERN, Tables, columns_of, few, free_name, join_groups, join_spread, lower_az, with_key

#: Words whose hash a worker remembers.
KNOWN_WORDS = 200_000
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Growth of the number of blocks from band to band.
GROWTH = 1.4

_WORDS = re.compile(WORD_PATTERN).findall
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of ``h`` over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """word → 64-bit hash."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if len(word) <= 48:
            self[word] = h
        return h


def shingle_set(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = _WORDS(lower_az(text)) if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(h))
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = _mixed(total * _MIX[2] + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def bands(n_max: int) -> list[int]:
    """Block counts 1, 2, 3 ... growing by GROWTH."""
    out = [1]
    while out[-1] < n_max:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


_BANDS = bands(1 << 40)
#: The low bits of a join key, which hold its band.
BAND_MASK = 127
#: Blocks over the least number that the pigeonhole needs, so that frequent blocks can be left out.
SPARE = 1.25
#: Bits of the parity sketch for each block, and at most: rows of every key carry it, so it mustn't grow with the text.
BITS, MOST_BITS = 8, 1024


def allowed_difference(n: int, num: int, den: int) -> int:
    """Elements in only one of two sets of similarity num/den or more, the smaller of size n."""
    return n * (den - num) // num


def band_of(n: int, num: int, den: int) -> int:
    need = allowed_difference(n, num, den) + 1
    return 0 if need == 1 else int(np.searchsorted(_BANDS, int(need * SPARE) + 1))


def sketches(shingles: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, join key of each block, parity bits) for each band that the document takes part in."""
    n = len(shingles)
    if not n:
        return
    smallest = -(-n * num // den)
    for band in range(band_of(smallest, num, den), band_of(n, num, den) + 1):
        k = _BANDS[band]
        if k == 1:
            continue  # no element may differ: equal sets, which are one class
        block = ((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        edges = np.searchsorted(block, np.arange(k + 1, dtype=np.uint64))
        so_far = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mixed(shingles))])
        words = so_far[edges[1:]] ^ so_far[edges[:-1]]
        keys = _mixed(words * _MIX[2] + _mixed(np.arange(k, dtype=np.uint64) + np.uint64(band << 40)))
        keys = keys & ~np.uint64(BAND_MASK) | np.uint64(band)
        size = min(-(-k * BITS // 64) * 64, MOST_BITS)
        parity = (np.bincount((_mixed(shingles + _MIX[2]) % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
        yield band, keys, np.packbits(parity, bitorder="little").view(np.uint64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit sums over a set: 128 bits that tell sets of a size apart."""
    return len(shingles), int(shingles.sum(dtype=np.uint64).astype(np.int64)), int(_mixed(shingles ^ _MIX[2]).sum(dtype=np.uint64).astype(np.int64))


_PART = "array<struct<band:int,bits:array<bigint>>>"


def features(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """row, id, n, f1, f2, keys, parts for rows (row, id, text)."""

    def run(batches):
        known = WordHashes()
        kind = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.list_(pa.int64()))]))
        for b in few(batches):
            prints, keys, parts = [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, words, known)
                prints.append(fingerprint(s))
                mine = list(sketches(s, num, den))
                keys.append(np.concatenate([m[1] for m in mine]).view(np.int64) if mine else np.empty(0, np.int64))
                parts.append([{"band": band, "bits": bits.view(np.int64)} for band, _, bits in mine])
            columns = [pa.array([p[i] for p in prints], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array(keys, pa.list_(pa.int64())), pa.array(parts, kind)], names=["row", "id", "n", "f1", "f2", "keys", "parts"])

    fields = [docs.schema["row"], docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2"))]
    schema = T.StructType([*fields, T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("parts", T._parse_datatype_string(_PART))])
    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """n, f1, f2, items for rows (id, text)."""

    def run(batches):
        known = WordHashes()
        for b in few(batches):
            sets = [shingle_set(t, words, known) for t in b.column(1).to_pylist()]
            prints = [fingerprint(s) for s in sets]
            columns = [pa.array([p[i] for p in prints], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["n", "f1", "f2", "items"])

    return docs.mapInArrow(run, "n bigint, f1 bigint, f2 bigint, items array<bigint>")


def connect(tables: Tables, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that edges (a, b) reach. Labels and edges are contracted until no edge is left."""
    labels = nodes.select("node", F.col("node").alias("comp"))
    edges = tables.write(edges.filter("a <> b").select("a", "b").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("p")).filter("p < a")
        hooks = tables.write(hooks)
        for _ in range(2):
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            hooks = tables.write(hooks.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
        to = hooks.select(F.col("a").alias("comp"), "p")
        labels = tables.write(labels.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
        moved = edges.join(hooks, "a", "left").select(F.coalesce("p", "a").alias("a"), "b")
        moved = moved.join(hooks.select(F.col("a").alias("b"), "p"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        edges = tables.write(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


#: Keys that a row carries of those before its own.
KEYS_BEFORE = 16


def with_keys_before(rows: DataFrame) -> DataFrame:
    """The rows (key, node, ...) with ``before``: the node's last keys before this one, in an order that all nodes have in common."""
    return rows.withColumn("before", F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-KEYS_BEFORE, -1)))


def pairs_across(rows: DataFrame, close: Column) -> DataFrame:
    """The pairs (a, b) of rows (key, node, comp, n, bits, before) that share a key across components and for which ``close`` holds, given na, nb, bits_a, bits_b.

    A pair that also shares one of the keys before meets there, so it is passed on under the first key that
    it shares, and again only after ``KEYS_BEFORE`` keys that are a side's own.
    """

    def side(x: str) -> DataFrame:
        return rows.select(F.col("key").alias(f"key_{x}"), F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"), F.col("before").alias(f"before_{x}"))

    meet = (F.col("key_a") == F.col("key_b")) & (F.col("comp_a") < F.col("comp_b")) & close & ~F.arrays_overlap("before_a", "before_b")
    return side("a").join(side("b"), meet).select("a", "b")


#: Documents, and elements of their sets, of a chunk that is compared with another.
CHUNK_DOCS, CHUNK_ITEMS = 256, 1 << 18
#: Columns of an incidence matrix that are held at once.
MATRIX_COLUMNS = 4096


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets with all others, or with one another."""
    both = sets + (others or [])
    sizes = np.array([len(s) for s in both])
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = times > 1  # what occurs once is in no intersection
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(shared.sum())
    out = np.zeros((len(sets), len(others) if others else len(sets)), dtype=np.float64)
    for at in range(0, width, MATRIX_COLUMNS):
        a, b = np.searchsorted(column, [at, at + MATRIX_COLUMNS])
        m = np.zeros((len(both), min(MATRIX_COLUMNS, width - at)), dtype=np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[: len(sets)] @ (m[len(sets) :] if others else m).T
    return out.astype(np.int64)


def count_links(labels: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int, total: int) -> DataFrame:
    """node, across: the members of other classes (node, n, members) that a node of (node, comp) is linked with; nodes without links may be missing."""
    rows = labels.join(classes, "node")
    cost = F.sum(F.greatest(F.lit(1.0 / CHUNK_DOCS), F.col("n") / CHUNK_ITEMS))
    comps = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.ceil(cost).cast("int").alias("chunks")).filter("size > 1")
    rows = join_groups(rows, comps, ["comp"], "size", total).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).join(sets, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("comp", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "members", "items")

    def linked(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        (_, lo, hi), nodes, members = group[0][:3], np.array([g[4] for g in group]), np.array([g[5] for g in group], dtype=np.float64)
        items, n = [g[6] for g in group], np.array([len(g[6]) for g in group])
        if lo == hi:
            common = intersections(items)
            near = common * den >= (n[:, None] + n - common) * num
            np.fill_diagonal(near, False)
            return nodes, near @ members
        left = np.array([g[3] == lo for g in group])
        if left.all() or not left.any():
            return nodes[:0], members[:0]
        order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
        k = int(left.sum())
        common = intersections([items[i] for i in order[:k]], [items[i] for i in order[k:]])
        n, members = n[order], members[order]
        near = common * den >= (n[:k, None] + n[k:] - common) * num
        return nodes[order], np.concatenate([near @ members[k:], members[:k] @ near])

    def run(batches):
        group: list[tuple] = []

        def done():
            nodes, sums = linked(group)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.round(sums).astype(np.int64))], names=["node", "across"])

        for b in batches:
            items = b.column("items")
            flat, at = items.values.to_numpy(zero_copy_only=False), items.offsets.to_numpy()
            for i, x in enumerate(zip(*(b.column(c).to_pylist() for c in ("comp", "lo", "hi", "chunk", "node", "members")), strict=True)):
                if group and group[0][:3] != x[:3]:
                    yield done()
                    group.clear()
                group.append((*x, flat[at[i] : at[i + 1]]))
        if group:
            yield done()

    found = rows.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInArrow(run, "node bigint, across bigint")
    return found.groupBy("node").agg(F.sum("across").alias("across"))


def _smaller(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A table to join with: broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= limit else df


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", most_ids: int = BROADCAST_IDS, count: bool = True) -> DataFrame:
    """id_col, row, n_shingles, n_links, component_id, component_rows, first: ``n_links`` counts the other rows that are similar enough, ``first`` marks one row, of the smallest id, of each component. Without ``count`` links are not counted (null)."""
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = tables.write(features(source, words, num, den))
    plain = tables.write(found.select("row", "id", "n", "f1", "f2"))
    prints = ["n", "f1", "f2"]
    # classes of equal sets, and the rows that aren't their class's first
    top = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("top")
    classes = tables.write(plain.filter("n > 0").groupBy(*prints).agg(F.min("row").alias("node"), F.min("id").alias("id"), F.count(F.lit(1)).alias("members"), top))
    n_rows = plain.count()
    repeats = tables.write(join_groups(plain.filter("n > 0"), classes.filter("members > 1").select(*prints, "node", "members"), prints, "members", n_rows).filter("row <> node").select("row"))
    firsts = found.filter("n > 0").join(_smaller(repeats, most_ids), "row", "left_anti")
    # each key moves once, with its document alone; what documents don't share goes at once
    keys = firsts.select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    by_key = Window.partitionBy("key")
    shared = tables.write(keys.withColumn("times", F.count(F.lit(1)).over(by_key)).filter("times > 1"))
    bits = tables.write(found.filter("n > 0").select(F.col("row").alias("node"), "parts"))
    tables.drop(found, repeats)
    # of a document's blocks in a band, the rarest D + 1 are joined on; unshared ones are the rarest of all
    blocks = F.element_at(F.array(*(F.lit(float(b)) for b in _BANDS)), F.col("band") + 1).cast("long")
    by_band = Window.partitionBy("node", "band")
    sized = shared.join(plain.select(F.col("row").alias("node"), "n"), "node").withColumn("band", F.col("key").bitwiseAND(BAND_MASK).cast("int"))
    quota = F.floor(F.col("n") * (den - num) / num).cast("long") + 1 - (blocks - F.count(F.lit(1)).over(by_band))
    kept = sized.withColumn("quota", quota).withColumn("nth", F.row_number().over(by_band.orderBy("times", "key"))).filter("nth <= quota").select("key", "node", "n", "band")
    head = F.min(F.struct("node", "n")).over(by_key)
    kept = tables.write(kept.withColumn("c", F.count(F.lit(1)).over(by_key)).withColumn("head", head).filter("c > 1").drop("c"))
    tables.drop(shared)
    # sketches and sets of the documents that share a key
    nodes = tables.write(kept.select("node").distinct())
    bits = tables.write(bits.join(nodes, "node"))
    wanted = tables.write(classes.join(nodes, "node").select("node", *prints, "id"))
    ids = _smaller(wanted.select(F.col("id").alias("w_id")).distinct(), most_ids)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("w_id")), "left_semi")
    sets = tables.write(shingle_sets(texts, words).join(wanted.drop("id"), prints).dropDuplicates(["node"]).select("node", "items"))
    tables.drop(wanted)

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)

    def near_sizes(n: Column, m: Column) -> Column:
        return F.least(n, m) * den >= F.greatest(n, m) * num

    def near(n: Column, m: Column, distance: Column) -> Column:
        # |A and B| (den + num) >= num (|A| + |B|), with |A and B| = (|A| + |B| - difference) / 2
        return (n + m - distance) * (den + num) >= 2 * num * (n + m)

    def links(pairs: DataFrame, filtered: bool = False) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, of pairs (a, b, na, nb, band); an ``a`` may have any number of pairs."""
        total = pairs.count()
        x = pairs
        if not filtered:
            own = lambda c: F.filter(c, lambda p: p["band"] == F.col("band"))[0]["bits"]
            x = join_spread(x, bits.select(F.col("node").alias("a"), F.col("parts").alias("parts_a")), "a", total).join(bits.select(F.col("node").alias("b"), F.col("parts").alias("parts_b")), "b")
            x = tables.write(x.filter(near(F.col("na"), F.col("nb"), apart(own("parts_a"), own("parts_b")))).select("a", "b"))
            total = x.count()
        x = join_spread(x.select("a", "b"), sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a", total).join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
        common = F.size(F.array_intersect("items_a", "items_b"))
        return tables.write(x.filter(common * den >= (F.size("items_a") + F.size("items_b") - common) * num).select("a", "b"))

    def merged(labels: DataFrame, linked: DataFrame) -> DataFrame:
        ends = linked.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        to = connect(tables, labels.select(F.col("comp").alias("node")).distinct(), ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        return tables.write(labels.join(to.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp").select("node", F.col("to").alias("comp")))

    def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows whose key still joins components."""
        x = rows.select("key", "node", "n", "band").join(labels, "node").withColumn("low", F.min("comp").over(by_key)).withColumn("high", F.max("comp").over(by_key))
        return tables.write(x.filter("low < high").select("key", "node", "n", "band", "comp"))

    # each against the first of its key
    pairs = kept.filter(F.col("node") != F.col("head.node")).select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb"), "band")
    pairs = pairs.filter(near_sizes(F.col("na"), F.col("nb"))).groupBy("a", "b", "na", "nb").agg(F.min("band").alias("band"))
    labels = connect(tables, nodes, links(tables.write(pairs)))
    # the first of each component against that of the key's first component
    rows = mixed(kept, labels)
    first = rows.groupBy("key", "comp", "band").agg(F.min(F.struct("node", "n")).alias("x")).withColumn("head", F.min(F.struct("comp", "x")).over(by_key)).filter(F.col("comp") != F.col("head.comp"))
    pairs = first.select(F.col("head.x.node").alias("a"), F.col("x.node").alias("b"), F.col("head.x.n").alias("na"), F.col("x.n").alias("nb"), "band")
    pairs = pairs.filter(near_sizes(F.col("na"), F.col("nb"))).groupBy("a", "b", "na", "nb").agg(F.min("band").alias("band"))
    labels = merged(labels, links(tables.write(pairs)))
    # what is left, pair by pair across components; only pairs that can be similar enough are passed on
    rows = mixed(rows, labels)
    left = bits.select("node", F.explode("parts").alias("part")).select("node", "part.band", "part.bits")
    rows = tables.write(with_keys_before(rows).join(left, ["node", "band"]))
    close = near_sizes(F.col("na"), F.col("nb")) & near(F.col("na"), F.col("nb"), apart(F.col("bits_a"), F.col("bits_b")))
    labels = merged(labels, links(tables.write(pairs_across(rows, close).distinct()), filtered=True))
    across = labels.select("node", F.lit(None).cast("long").alias("across")).limit(0)
    if count:
        across = tables.write(count_links(labels, classes.select("node", "n", "members"), sets, num, den, n_rows))
    tables.drop(kept, bits, rows, sets)
    each = classes.join(labels, "node", "left").join(across, "node", "left")
    n_links = F.col("members") - 1 + F.coalesce("across", F.lit(0)) if count else F.lit(None).cast("long")  # the others of its class, and all members of linked classes
    each = tables.write(each.select(*prints, "members", "id", "top", n_links.alias("n_links"), F.coalesce("comp", "node").alias("comp")))
    wholes = each.groupBy("comp").agg(F.min("id").alias("component_id"), F.sum("members").alias("component_rows"), F.min("top").alias("top"), F.count(F.lit(1)).alias("classes"))
    wholes = tables.write(wholes)
    each = join_groups(each.drop("id", "top"), wholes, ["comp"], "classes", n_rows)
    each = tables.write(each.select(*prints, "members", "n_links", "component_id", "component_rows", F.col("top.row").alias("first_row")))
    member = join_groups(plain.filter("n > 0"), each, prints, "members", n_rows)
    alone = plain.filter("n = 0").select("*", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("component_rows"), F.col("row").alias("first_row"))
    out = member.drop("members").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "row", F.col("n").alias("n_shingles"), "n_links", "component_id", "component_rows", (F.col("row") == F.col("first_row")).alias("first"))


def keep_first(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whatever these are called, without those linked to a row of a smaller id.

    Where ids repeat or are null, rows are told apart by a written row number, and the earliest of a group stays.
    """
    rows, key = with_key(docs, id_col, "jaccard-rows")
    gone_key = free_name("_gone", rows)
    found = jaccard_components(rows, words, num, den, key, text_col, count=False).filter("NOT first").select(F.col(key).alias(gone_key))
    gone = Tables(docs.sparkSession, "jaccard-gone").write(found)
    return rows.join(_smaller(gone), F.col(key) == F.col(gone_key), "left_anti").select(*columns_of(docs))
