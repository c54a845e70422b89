"""Exact deduplication by deterministic block naming.

A text without its white space is cut into blocks of ``BLOCK`` characters. The distinct blocks
are sorted and numbered, so a block's integer name stands for its content. Then adjacent names
are paired, the distinct pairs sorted and numbered in turn, and so on, until every document has
one name. Two documents have the same name at the same level exactly if their texts are equal:
names come from contents, never from hashes alone.

Blocks are looked up by a 64-bit hash once it is shown that no two distinct blocks share one; if
some do, the hashes are drawn anew from another seed. Each level halves what is left and drops
the documents that are done, so the text itself is shuffled once, one copy of each block for
each task at most. Groups of copies are counted before they are shuffled and never gathered.

Defined results: null text counts as empty, and empty texts are equal; the row with the most
code points in its original text stays, then the smallest id (null ids last), then one row of
those that repeat the id; extra columns are ignored, whatever their names; an empty table gives
an empty table. Built-in functions only.

A block, a pair or a text may be that of any share of the rows: the few names that are so common
are broadcast, and only the rows of the others move to their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import SPACE_PATTERN, Tables, columns_of, free_name, join_groups

BLOCK = 2048


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys, sorted within their partitions, with an integer name each and the rows that have it."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("uses")).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256: a row for each document."""
    spark = docs.sparkSession
    tables = Tables(spark, "exact-dedup")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bare = F.regexp_replace("text", f"{SPACE_PATTERN}+", "")
    blocks = F.regexp_extract_all(bare, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    for seed in range(8):
        digest = digest_of(seed)
        pieces = source.select(F.explode(blocks).alias("block"))
        names = tables.write(_numbered(pieces.select(digest(F.col("block")).alias("key"), "block"), ["block"]).select("key", "name", "uses"))
        if names.groupBy("key").count().filter("count > 1").isEmpty():
            break
        tables.drop(names)
    else:
        raise ValueError("no seed tells all blocks apart")
    rows = source.select(
        F.monotonically_increasing_id().alias("row"), "id", F.length("text").alias("points"), F.sha2(bare.cast("binary"), 256).alias("text_sha256"), blocks.alias("blocks")
    )
    rows = tables.write(rows.select("row", "id", "points", "text_sha256", F.size("blocks").alias("n"), F.transform("blocks", digest).alias("keys")))
    most, n_rows, n_pieces = (x or 0 for x in rows.agg(F.max("n"), F.count(F.lit(1)), F.sum("n")).first())
    level = join_groups(rows.select("row", F.posexplode("keys").alias("pos", "key"), "n"), names, ["key"], "uses", n_pieces).select("row", "pos", "name", "n")
    done = rows.filter("n = 0").select("row", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))
    depth, width = 0, 1
    while width < most:
        state = tables.write(level)
        done = done.unionByName(state.filter(F.col("n") <= width).select("row", F.lit(depth).alias("level"), "name"))
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = (
            state.filter(F.col("n") > width)
            .groupBy("row", half.alias("pos"), "n")
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        )
        names = tables.write(_numbered(pairs.select("left", "right"), ["left", "right"]))
        level = join_groups(pairs, names, ["left", "right"], "uses", n_pieces).select("row", "pos", "name", "n")
        depth, width = depth + 1, width * 2
    done = done.unionByName(level.select("row", F.lit(depth).alias("level"), "name"))
    named = tables.write(rows.select("row", "id", "points", "text_sha256").join(done, "row"))
    best = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = tables.write(named.groupBy("level", "name").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")))
    out = join_groups(named, groups, ["level", "name"], "group_size", n_rows)
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def digest_of(seed: int):
    """The lookup key of a block."""
    return (lambda x: F.xxhash64(x)) if not seed else (lambda x: F.xxhash64(x, F.lit(seed)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Null ids and texts, ties and repeats are as for ``exact_dedup``: of rows that repeat an id and a text, one stays.
    """
    spark, own, nth, its_id, its_sha = docs.sparkSession, *(free_name(x, docs) for x in ("_own", "_nth", "_kept_id", "_kept_sha"))
    found = Tables(spark, "exact-dedup-kept").write(exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(its_id), F.col("text_sha256").alias(its_sha)))
    bare = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE_PATTERN}+", "")
    marked = docs.withColumn(own, F.sha2(bare.cast("binary"), 256))
    out = marked.join(found, F.col(id_col).eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_sha)), "left_semi")
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():  # repeated ids: one row for each text
        first = Window.partitionBy(id_col, own).orderBy(F.desc_nulls_last(F.length(text_col)), text_col)
        out = out.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1)
    return out.select(*columns_of(docs))
