"""Text operators of ingest: escaping, tokens, lengths, masks, ids, batches and other small list operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseek.functions.prefix import running_before

QUERY_TOKENS, DOC_TOKENS = 32, 512
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def unescaped(text: Column) -> Column:
    """Written-out \\n, \\r, \\t as the characters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\n", "\n"), r"\\r", "\r"), r"\\t", "\t")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def passage(title: Column, text: Column) -> Column:
    """Title and passage as one text; no title leaves the passage."""
    return F.when(F.coalesce(F.length(title), F.lit(0)) > 0, F.concat(title, F.lit(" | "), text)).otherwise(text)


def tokens(text: Column, most: int) -> Column:
    """Lower-case words between white space, the first ``most`` of them."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.slice(words, 1, most)


def masked(words: Column) -> Column:
    """Without words that are a single punctuation mark."""
    return F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, PUNCTUATION)), w))


#: Marks of the older tokeniser, and its longest query.
START, END, QUERY_MARK, DOC_MARK, FILL, PAD = "[CLS]", "[SEP]", "[Q]", "[D]", "[MASK]", "[PAD]"
LONGEST_QUERY = 500


def clamped_length(length: Column, least: int = QUERY_TOKENS) -> Column:
    """Tokens of a query that is searched in full: between the usual number and ``LONGEST_QUERY``."""
    return F.least(F.lit(LONGEST_QUERY), F.greatest(F.lit(least), length))


def marked_query(words: Column, most: int = QUERY_TOKENS, context: Column | None = None) -> Column:
    """Start, query mark, words and end, cut to ``most`` and filled up with masks; a context's tokens and end follow."""
    mark = lambda *m: F.array(*map(F.lit, m))
    out = F.concat(mark(START, QUERY_MARK), F.slice(words, 1, most - 3), mark(END))
    out = F.concat(out, F.array_repeat(F.lit(FILL), F.lit(most) - F.size(out)))
    return out if context is None else F.concat(out, context, mark(END))


def marked_documents(df: DataFrame, key: str, words: Column, size: int, most: int = DOC_TOKENS) -> DataFrame:
    """key, tokens (start, document mark, words, end, padded to the longest of the batch), batch and slot: batches of
    ``size`` in the order of length, and, to put results back, place: the row's number in the order of key."""
    mark = lambda *m: F.array(*map(F.lit, m))
    rows = df.select(key, F.concat(mark(START, DOC_MARK), F.slice(words, 1, most - 3), mark(END)).alias("_t")).withColumn("_n", F.size("_t"))
    rows = numbered(rows, key, "place").withColumn("_at", F.col("_n") * F.lit(1 << 40) + F.col("place"))
    rows = numbered(rows, "_at", "_r").withColumn("batch", F.floor(F.col("_r") / size)).withColumn("slot", F.col("_r") % size)
    longest = rows.groupBy("batch").agg(F.max("_n").alias("_m"))
    return rows.join(longest, "batch").select(key, F.concat("_t", F.array_repeat(F.lit(PAD), F.col("_m") - F.col("_n"))).alias("tokens"), "batch", "slot", "place")


def positions(df: DataFrame, key: str, words: Column) -> DataFrame:
    """One row for each token: key, pos, token."""
    return df.select(key, F.posexplode(words).alias("pos", "token"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that come more than once: what a scan of unique ids must find empty."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def numbered(df: DataFrame, key: str, out: str = "pid") -> DataFrame:
    """Dense ids from 0 in the order of a key of distinct numbers, without one window over all rows."""
    return running_before(df.withColumn("_one", F.lit(1)), key, "_one", out).drop("_one")


def chunks(df: DataFrame, key: str, size: int, length: str) -> DataFrame:
    """Chunks of ``size`` consecutive rows: passage_offset, num_passages, embedding_offset, num_embeddings."""
    rows = numbered(df, key, "_p").groupBy(F.floor(F.col("_p") / size).alias("chunk")).agg(F.min("_p").alias("passage_offset"), F.count("*").alias("num_passages"), F.sum(length).alias("num_embeddings"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("embedding_offset", F.coalesce(F.sum("num_embeddings").over(before), F.lit(0)))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    return numbered(df, key, "_p").withColumn("batch", F.floor(F.col("_p") / size)).withColumn("offset", F.col("batch") * size).drop("_p")


def padded_groups(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(group, items): values in the order of key, ``size`` to a group, the last one filled up with nulls."""
    rows = numbered(df.select(key, F.col(value).alias("_v")), key, "_p").groupBy(F.floor(F.col("_p") / size).alias("group")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_v").alias("v")))).alias("_x"))
    return rows.select("group", F.concat(F.col("_x.v"), F.array_repeat(F.lit(None), F.lit(size) - F.size("_x"))).alias("items"))


def zipped(*lists: Column) -> Column:
    """Lists turned to a list of tuples, as long as the longest."""
    return F.arrays_zip(*lists)


def zipped_to_first(first: Column, second: Column) -> Column:
    """Each element of first with the element of second at its place, second starting again when it ends."""
    return F.transform(first, lambda x, i: F.struct(x.alias("a"), F.when(F.size(second) > 0, F.get(second, i % F.size(second))).alias("b")))


def grouped_by_first(df: DataFrame, first: str, *rest: str) -> DataFrame:
    return df.groupBy(first).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("items"))


def offsets(df: DataFrame, key: str, length: str) -> DataFrame:
    """Start and end of each row's stretch of a packed array, in the order of key."""
    return running_before(df.select(key, length), key, length, "start").select(key, "start", (F.col("start") + F.col(length)).alias("end"))


def numeric_id(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]+$"), value.cast("long"))


def distinct_in_order(df: DataFrame, value: str, order: str, out: str = "place") -> DataFrame:
    """Each value once, with the place (from 0) of its first row in the order of a column of distinct numbers."""
    return numbered(df.groupBy(value).agg(F.min(order).alias("_first")), "_first", out).drop("_first")


def titled(title: Column, text: Column) -> Column:
    """Title and text of a benchmark corpus as one text, a space between them even where one is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
