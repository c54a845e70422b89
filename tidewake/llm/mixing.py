"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Sources share the corpus's size by weight; a target stops at ``MOST`` times its
source's size, and the excess is shared out again by weight until none is above (the level at
which this settles is found at once from sources in order of size for each unit of weight).

Inside a source, a document is expected in e copies, in proportion to its priority (the bits of its
size: a text of 1 000 words counts ten, one of 30 words five) and ``MOST`` at most, so that the
expected words are the source's target. Its floor(e) whole copies are certain. What is left of e
is its inclusion probability p, more than 0 however long the text is, and the documents are ranked
by the odds of a random number u, made from the id, over the odds of p. The sample has a fixed size,
the words that the whole copies leave of the target: documents are taken in order of rank up to it.
One more document, the one whose size is nearest to what is then missing, is taken if that brings
the source nearer to its target. (Where a document is longer than twice what is missing it would
take the source farther from its target than leaving it out does; the sample passes it over.)

A source may be any share of the corpus: ranks aren't computed by sorting it, but by sums over
buckets of the order, refined where the cut falls, so that only the few rows of the last bucket
are ordered one by one. A row without an id has its random number from its text.

Defined results: null text has size 0 and is taken 0 words; a null source is a source, last in
order; sources without words get target 0; equal orders go by id, then by a hash of the text, and
what then ties is alike in all that the mix reads; rows that repeat an id, or a text without one,
have the same random number and are taken one by one; reruns give the same rows, however they are
partitioned; extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import WORD_PATTERN, Tables, columns_of, free_name, with_key

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Buckets of each refinement, and refinements.
BUCKETS, LEVELS = 4096, 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows (source, size); as many rows as sources."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    each = each.withColumn("weight", weight.cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    each = each.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weight"),
    )
    left, weight_left = F.col("total") - most * F.col("full_size"), F.col("all_weight") - F.col("full_weight")
    each = each.withColumn("full", left.cast("double") * F.col("weight") > (most * F.col("source_size")).cast("double") * weight_left)
    level = left.cast("double") / weight_left
    each = each.withColumn("level", F.max(F.when(~F.col("full"), F.struct(-F.col("full_weight"), level.alias("level")))).over(everything)["level"])
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return each.select("source", "source_size", target.alias("target"))


def inclusion(rows: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """source, bits, source_size, target, base, p, rest for each source and number of bits of a size.

    e = least(most, c * bits), with c such that the expected words of the source are its target; base = floor(e),
    p = e - base, and rest is the target without the words of the whole copies. At most 64 rows for each source.
    """
    each = rows.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    each = each.alias("w").join(targets.alias("t"), F.col("w.source").eqNullSafe(F.col("t.source"))).select("w.source", "bits", "words", "source_size", "target")
    longer = Window.partitionBy("source").orderBy(F.desc("bits")).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.partitionBy("source").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    left = F.col("target") - most * F.coalesce(F.sum("words").over(longer), F.lit(0))
    each = each.withColumn("c", left / F.nullif(F.sum(F.col("bits") * F.col("words")).over(shorter), F.lit(0)))
    each = each.withColumn("full", F.coalesce(F.col("c") * F.col("bits") >= most, F.lit(False)))
    each = each.withColumn("c", F.max(F.when(~F.col("full"), F.struct("bits", "c"))).over(whole)["c"])
    e = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.coalesce(F.col("c") * F.col("bits"), F.lit(0.0)), F.lit(float(most))))
    each = each.withColumn("e", F.greatest(e, F.lit(0.0))).withColumn("base", F.floor("e").cast("long"))
    each = each.withColumn("p", F.least(F.col("e") - F.col("base"), F.lit(1 - 1e-9)))
    return each.select("source", "bits", "source_size", "target", "base", "p", (F.col("target") - F.sum(F.col("base") * F.col("words")).over(whole)).alias("rest"))


#: Ids, and rows of a plan, that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, key_col: str | None = None) -> DataFrame:
    """id_col, source, size, source_size, target, copies, taken: a row for each document. ``key_col`` is returned in place of the id."""
    tables = Tables(docs.sparkSession, "mix")
    digits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))), F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = tables.write(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(key_col or id_col).alias("key"), F.xxhash64(text_col).alias("hash"), F.col(source_col).alias("source"), words.alias("size"), ((digits.cast("double") + 0.5) / 2.0**52).alias("u")
        ).withColumn("bits", F.length(F.bin("size")))
    )
    plan = tables.write(inclusion(rows, source_targets(rows, weights, most), most))
    few = plan.count() <= BROADCAST_IDS
    t = plan.select(F.col("source").alias("t_source"), F.col("bits").alias("t_bits"), "source_size", "target", "base", "p", "rest")
    full = rows.join(F.broadcast(t) if few else t, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("bits") == F.col("t_bits"))).drop("t_source", "t_bits")
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    full = full.withColumn("q", F.when((F.col("size") > 0) & (F.col("p") > 0), q)).withColumn("z", F.col("q") / (1 + F.col("q")))
    step = F.lit(0).cast("long")
    # the bucket numbers of an order: z in base BUCKETS
    scaled = F.col("z")
    for k in range(LEVELS):
        step = F.least(F.floor(scaled * BUCKETS).cast("long"), F.lit(BUCKETS - 1))
        full = full.withColumn(f"b{k}", step)
        scaled = scaled * BUCKETS - F.col(f"b{k}")
    full = tables.write(full.drop("z"))
    cut = plan.select("source", "rest").distinct().withColumn("sum", F.lit(0).cast("long"))
    for k in range(LEVELS):
        inside = full.filter("q IS NOT NULL").select("source", "size", *(f"b{i}" for i in range(k + 1)))
        c = cut.select(F.col("source").alias("c_source"), "rest", "sum", *(F.col(f"b{i}").alias(f"c{i}") for i in range(k)))
        on = F.col("source").eqNullSafe(F.col("c_source"))
        for i in range(k):
            on = on & (F.col(f"b{i}") == F.col(f"c{i}"))
        found = inside.join(c, on).groupBy("source", "rest", "sum", *(f"b{i}" for i in range(k + 1))).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy(f"b{k}").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("after", F.col("sum") + F.sum("n").over(upto)).filter(F.col("after") > F.col("rest"))
        first = Window.partitionBy("source").orderBy(f"b{k}")
        found = found.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
        cut = tables.write(found.select("source", "rest", (F.col("after") - F.col("n")).alias("sum"), *(f"b{i}" for i in range(k + 1))))
    c = cut.select(F.col("source").alias("c_source"), F.col("sum").alias("c_sum"), F.lit(True).alias("has_cut"), *(F.col(f"b{i}").alias(f"c{i}") for i in range(LEVELS)))
    marked = full.join(c, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    own, at = (F.struct(*(F.col(f"{x}{i}").alias(f"b{i}") for i in range(LEVELS))) for x in "bc")
    place = F.when(F.col("q").isNull(), "out").when(F.col("has_cut").isNull(), "in").when(own < at, "in").when(own == at, "cut").otherwise("out")
    marked = marked.withColumn("place", place)
    keep = ["row", "id", "key", "hash", "source", "size", "source_size", "target", "base", "rest", "q", "u", "place"]
    order = Window.partitionBy("source").orderBy("q", "u", "id", "hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.filter("place = 'cut'").withColumn("fits", F.col("c_sum") + F.sum("size").over(order) <= F.col("rest"))
    last = last.withColumn("place", F.when(F.col("fits"), "in").otherwise("out"))
    placed = tables.write(marked.filter("place <> 'cut'").select(*keep).unionByName(last.select(*keep)))
    taken = placed.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("place") == "in", F.col("size"))), F.lit(0)).alias("got"))
    g = taken.select(F.col("source").alias("g_source"), "got")
    spare = placed.filter("place = 'out' AND size > 0 AND base < " + str(most)).join(g, F.col("source").eqNullSafe(F.col("g_source")))
    miss = F.col("rest") - F.col("got")
    spare = spare.filter((miss > 0) & (F.abs(F.col("size") - miss) < miss))
    pick = spare.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - miss).alias("off"), F.coalesce("q", F.lit(float("inf"))).alias("q"), F.col("u"), F.col("id"), F.col("hash"), F.col("row"))).alias("p"))
    pick = pick.select(F.col("p.row").alias("p_row"))
    out = placed.join(F.broadcast(pick) if few else pick, F.col("row") == F.col("p_row"), "left")
    copies = F.col("base") + ((F.col("place") == "in") | F.col("p_row").isNotNull()).cast("long")
    return out.select(F.col("key").alias(key_col or id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, whatever these are called, as often as the mix takes it.

    Where ids repeat or are null, rows are told apart by a written row number; their random numbers come from id and text all the same.
    """
    rows, key = with_key(docs, id_col, "mix-rows")
    its_key, copies, nth = (free_name(x, rows) for x in ("_key", "_copies", "_copy"))
    plan = mix_sources(rows, id_col, text_col, source_col, weights, most, seed, key).filter("copies > 0").select(F.col(key).alias(its_key), F.col("copies").cast("int").alias(copies))
    plan = Tables(docs.sparkSession, "mix-plan").write(plan)
    out = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_IDS else plan, F.col(key) == F.col(its_key))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns_of(docs))
