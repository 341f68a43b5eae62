"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream (documents in the order of a hash chunk and doc_id), cut into blocks of a fixed
length. Output shards have equally many slots; each shard gives every source the whole part of its expected number of
slots and draws the remaining ones from the multinomial of the fractions. A source's slots are numbered over all shards;
number j takes block perm(j mod blocks) on pass j div blocks, perm being a swap-or-not permutation of the source's
block indices. Blocks and documents meet in a join on (source, block index).

Sources are ranked by code point, null last. An empty table gives an empty mix; a document without words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseek.llm.common import WORD, parts, saved

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
PASSES = 2
BLOCK = 64
SLOTS = 1024
CHUNKS = 1024
CELLS = 1024
ROUNDS = 12
SEED = 17


def running(df: DataFrame, by: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``, the sum of ``value`` over the rows before in (chunk, order) of each ``by``.

    Summed within chunks and, over their totals, between them: no window holds all rows of one key.
    """
    totals = df.groupBy(*by, chunk).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, chunk, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_i", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(totals.hint("merge"), [*by, chunk]).withColumn(out, F.col("_i") + F.col("_o")).drop("_i", "_o")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source, source_size) with sid, weight and target: budget x all sizes, shared by weight, at most passes x size.

    Filling up by weight until sources are full gives each min(full size, level x weight); the level is found from
    sums along the order of full size / weight.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(one) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("full", F.col("source_size") * F.lit(float(passes))).withColumn("_r", F.col("full") / F.col("weight"))
    w = Window.orderBy("_r", "sid")
    s = s.withColumn("_p", F.coalesce(F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_w", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy()
    s = s.withColumn("_level", (F.sum("source_size").over(every) * F.lit(budget) - F.col("_p")) / F.col("_w"))
    s = s.withColumn("_level", F.min_by(F.when(F.col("_r") >= F.col("_level"), F.col("_level")), F.when(F.col("_r") >= F.col("_level"), F.struct("_r", "sid"))).over(every))
    return s.select("source", "sid", "source_size", "weight", F.least("full", F.coalesce("_level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of the values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Where the permutation of 0..n-1 that belongs to key puts i (swap-or-not rounds)."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, r), n) - x, n)
        swap = F.xxhash64(F.lit(SEED + 1), key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, turn)


def placed(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with uid, size, start in their source's stream and its figures; the sources; uid and ``keep`` of each document."""
    sized = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("_h"), *keep,
    )
    sized = saved(sized)
    sources = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, passes))
    there = sources.withColumnRenamed("source", "_s")
    out = sized.select("uid", "doc_id", "size", "source", "_h").join(there, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Null and repeated doc_ids are told apart by their texts, so that they do not add up in one chunk.
    out = out.withColumn("_c", F.pmod(F.xxhash64("_h"), F.lit(CHUNKS)))
    return saved(running(out, ["sid"], "_c", ["doc_id", "_h", "uid"], "size", "start").drop("_c", "_h")), sources, sized


def drawn(sources: DataFrame, block: int = BLOCK, slots: int = SLOTS, passes: int = PASSES) -> DataFrame:
    """(sid, block, pass): the blocks that the slots of all output shards take."""
    s = sources.where("target > 0 and source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    total = s.agg(F.sum("want")).first()[0] or 0.0
    shards = max(1, -(-int(total + 0.5) // slots))
    size = max(1, round(total / shards))
    if not total:
        return s.select("sid", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pass")).limit(0)
    s = s.withColumn("mean", F.col("want") * F.lit(size / total)).withColumn("whole", F.floor("mean")).withColumn("part", F.col("mean") - F.col("whole"))
    w = Window.orderBy("sid")
    s = s.withColumn("hi", F.sum("part").over(w)).withColumn("lo", F.coalesce(F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = saved(s.select("sid", "blocks", "whole", "lo", "hi"))
    span = s.agg(F.max("hi")).first()[0]
    rest = int(round(span))
    # Whole parts: the same number of slots in every shard.
    first = s.where("whole > 0").select("sid", "blocks", "whole", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // 256))).alias("g")).repartition(parts(sources.sparkSession), "sid", "g")
    first = first.select("sid", "blocks", F.explode(F.sequence(F.col("g") * 256 * F.col("whole"), F.least(F.lit(shards), (F.col("g") + 1) * 256) * F.col("whole") - 1)).alias("j"))
    out = first
    if rest:
        # The other slots: a uniform number finds its source through the cells that the source's interval touches.
        cell = lambda c: F.floor(c / span * CELLS).cast("long")
        near = s.where("hi > lo").select("*", F.explode(F.sequence(F.least(cell(F.col("lo")), F.lit(CELLS - 1)), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))).alias("cell"))
        spark = sources.sparkSession
        draw = spark.range(shards * rest).select("id", (F.floor(F.col("id") / rest)).alias("shard"), (unit(F.lit(SEED + 2), F.col("id")) * F.lit(span)).alias("u"))
        draw = draw.withColumn("cell", F.least(cell(F.col("u")), F.lit(CELLS - 1)))
        draw = draw.join(near, "cell").where("u >= lo and u < hi").select("sid", "blocks", "whole", "id", F.lit(1).alias("one"), F.floor(F.col("id") / 65536).alias("_c"))
        draw = running(saved(draw), ["sid"], "_c", ["id"], "one", "n")
        out = first.union(draw.select("sid", "blocks", (F.col("n") + F.col("whole") * shards).alias("j")))
    out = out.select("sid", "blocks", (F.col("j") % F.col("blocks")).alias("i"), F.floor(F.col("j") / F.col("blocks")).alias("pass")).where(F.col("pass") < passes)
    return out.select("sid", permuted(F.col("i"), F.col("blocks"), F.col("sid")).alias("block"), F.col("pass").cast("long").alias("pass"))


def taken(at: DataFrame, sources: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """(uid, block, times, words): what the mix takes of each document, by block; documents without words have none."""
    times = drawn(sources, block, passes=passes).groupBy("sid", "block").agg(F.count("*").alias("times"))
    span = at.where("size > 0").select("uid", "sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    words = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.greatest(F.col("block") * block, F.col("start"))
    return span.join(times.hint("merge"), ["sid", "block"]).select("uid", "block", "times", (words * F.col("times")).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs (doc_id, text, source), repeated ones and those with a
    null doc_id too. Null and empty texts have size 0 and nothing taken; other columns are not read."""
    at, sources, _ = placed(docs, [], weights, budget, passes)
    sums = taken(at, sources, block, passes).groupBy("uid").agg(F.sum("words").alias("taken"))
    return at.join(sums.hint("merge"), "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """docs with text cut to the words that the mix takes, once for each pass that takes any of them.

    A text that is taken whole stays as it is; otherwise its taken words are joined by single spaces. n_chars follows.
    """
    names = docs.columns
    at, sources, sized = placed(docs, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")], weights, budget, passes)
    picked = drawn(sources, block, passes=passes)
    span = at.where("size > 0").select("uid", "sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    low, high = F.greatest(F.col("block") * block, F.col("start")) - F.col("start"), F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")
    got = span.join(picked.hint("merge"), ["sid", "block"]).select("uid", "pass", "size", F.struct(low.alias("lo"), (high - low).alias("n")).alias("piece"))
    got = got.groupBy("uid", "pass").agg(F.sort_array(F.collect_list("piece")).alias("took"), F.sum("piece.n").alias("n"))
    out = sized.join(got.hint("merge"), "uid")
    words = F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # The words are an element of an outer array, so that they are split once and not for each piece.
    cut = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("took", lambda p: F.slice(w, (p["lo"] + 1).cast("int"), p["n"].cast("int")))), " ")), F.lit(0))
    text = F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(cut)
    return out.select(*[text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in names])
