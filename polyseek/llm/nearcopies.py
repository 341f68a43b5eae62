"""SimHash near-dedup at a similarity of word shingles: fingerprints meet at covering-code anchors, every link is confirmed
by exact Jaccard similarity, and MinHash bands add the pairs whose fingerprints are further apart than anchors reach.

Texts of equal shingle sets collapse to one row first. Of the others those pairs are candidates that simhash.py links by
their fingerprints' anchors, within 3 bits. All are dealt to a bucket by each of ``BANDS`` keys of ``ROWS`` minima too, where
a pair at similarity s meets with probability 1 - (1 - s^ROWS)^BANDS (0.99995 at 0.8; about 10 bits differ there). Buckets
with the same members are compared once. Rows are told apart by a key of their own, never by doc_id. On request candidates
meet by prefixes of their shingles instead of bands (prefix_buckets()), which misses no link and costs more.

A bucket of more than ``HOT`` members is dealt in chunks of about ``CHUNK``, each with the same few members as pivots, so
that copies of one text join across chunks through them. Members that are not in their bucket's largest component after
that go past every chunk once, so no link between components is lost; the cost of this grows with the number of such
members times the bucket, not with the square of a group of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.common import arrow, column, parts, saved, small_batches, word_bounds
from polyseek.llm.components import connected_components
from polyseek.llm.simhash import fingerprint_links, majority

WIDTH = 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 25, 5
#: Members of a bucket that are compared in one task, at most, members of a chunk of larger ones, and pivots (about).
HOT, CHUNK, PIVOTS = 512, 256, 32
#: A sample of one row in EVERY tells which shingles are frequent: those that OFTEN of its rows hold, FREQUENT of them at most.
EVERY, OFTEN, FREQUENT = 64, 8, 1 << 20
#: Rows whose numbers are broadcast instead of being joined in a shuffle, at most.
WHOLE = 8 << 20
#: Whether candidates meet by prefixes (all links) or by MinHash bands.
EXACT = False
SEED = 42
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``width`` words; none without a word, one if there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    start, end = word_bounds(words)
    last = max(1, len(words) - width + 1)
    stop = end[width - 1 :] if len(words) >= width else end[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(start[:last].tolist(), stop.tolist(), strict=True)], dtype="<u8"))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band, none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = hashes[at : at + 512, None] * _FACTORS + _SHIFTS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning set of the links among sets: rows already joined to a pivot are not compared with it again."""
    a, b = LEAST
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    out = []
    for p in range(len(sets)):
        if (root == root[p]).all():
            break
        ok = (root != root[p]) & (b * np.minimum(sizes, sizes[p]) >= a * np.maximum(sizes, sizes[p]))
        for at in np.array_split(np.flatnonzero(ok), max(1, int(sizes[ok].sum()) >> 20)):
            if not len(at):
                continue
            flat = np.concatenate([sets[i] for i in at])
            owner = np.repeat(np.arange(len(at)), sizes[at])
            pos = np.minimum(np.searchsorted(sets[p], flat), sizes[p] - 1)
            both = np.bincount(owner[sets[p][pos] == flat], minlength=len(at))
            for q in at[b * both >= a * (sizes[at] + sizes[p] - both)].tolist():
                if root[q] != root[p]:
                    out.append((p, q))
                    root[root == root[q]] = root[p]
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, row), sorted, of keys that have several, with a digest of all rows of the key."""

    def several(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(bounds)
        many = np.flatnonzero(sizes > 1)
        keep = np.repeat(sizes > 1, sizes)
        who = [d for g in many.tolist() for d in [xxhash.xxh3_128_digest(rows[bounds[g] : bounds[g + 1]].tobytes())] * int(sizes[g])]
        return pa.RecordBatch.from_pydict({"key": keys[keep], "row": rows[keep], "who": pa.array(who, pa.binary())})

    rest: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, rows = (batch.column(i).to_numpy() for i in range(2))
        if not len(keys):
            continue
        if rest and rest[0][0][0] == keys[-1]:  # one key so far
            rest.append((keys, rows))
            continue
        keys, rows = (np.concatenate([*(r[i] for r in rest), x]) for i, x in enumerate((keys, rows)))
        cut = int(np.searchsorted(keys, keys[-1]))
        rest = [(keys[cut:], rows[cut:])]
        if cut:
            yield several(keys[:cut], rows[:cut])
    if rest:
        yield several(*(np.concatenate([r[i] for r in rest]) for i in range(2)))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (key, salt, role, row, hashes), sorted by the first three: those of role 0 of one (key, salt) among
    each other, or, where there are any of role 1, these in blocks with those."""
    now, held, block = None, [], []

    def found() -> pa.RecordBatch:
        rows = held + block
        pairs = linked([h for _, h in rows])
        return pa.RecordBatch.from_pydict({"a": pa.array([rows[p][0] for p, _ in pairs], pa.int64()), "b": pa.array([rows[q][0] for _, q in pairs], pa.int64())})

    streamed = False
    for batch in batches:
        for key, salt, role, row, h in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (key, salt) != now:
                if block or (not streamed and len(held) > 1):
                    yield found()
                now, held, block, streamed = (key, salt), [], [], False
            if role:
                streamed = True
                if len(block) == CHUNK:
                    yield found()
                    block = []
            (block if role else held).append((row, np.frombuffer(h, dtype="<u8")))
    if block or (not streamed and len(held) > 1):
        yield found()


def compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among rows (key, salt, role, row)."""
    dealt = rows.join(sets.hint("merge"), "row").select("key", "salt", "role", "row", "hashes")
    dealt = dealt.repartition(parts(rows.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "role")
    return saved(dealt.mapInArrow(_edges, "a long, b long"))


def large_buckets(buckets: DataFrame) -> DataFrame:
    """(key, n, one) of the buckets of more than ``HOT`` rows; one is the least key of those with the same members."""
    spot = F.xxhash64("row")
    big = buckets.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.shiftright(spot, 20)).alias("_a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("_b")).where(F.col("n") > HOT)
    one = big.groupBy("n", "_a", "_b").agg(F.min("key").alias("one"))
    return saved(big.join(one, ["n", "_a", "_b"]).select("key", "n", "one"))


def prefix_size(n: int) -> int:
    """How many shingles of n, the first in any fixed order, hold one that every set of similarity ``LEAST`` has among its own first."""
    a, b = LEAST
    return n - -(-a * n // b) + 1 if n else 0


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted table."""
    at = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
    return table[at] == values if len(table) else np.zeros(len(values), dtype=bool)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)


def frequent_shingles(slim: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold, as far as a sample of rows shows: those in ``OFTEN`` or more of one row in
    ``EVERY``, the ``FREQUENT`` most frequent at most. Which they are changes how many candidates meet, never which links."""

    def every(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in column(batch, "text")]
        return {"key": _signed(np.concatenate([np.zeros(0, "<u8"), *sets]))}

    some = slim.where(F.pmod(F.xxhash64("row"), F.lit(EVERY)) == 0).select("text")
    found = arrow(some, every, "key long", most=1 << 20).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = found.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()  # at most FREQUENT numbers
    return np.sort(found.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63))


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, row), sorted by key, of keys that have more than one; no key is held as a whole."""
    last, sent = None, True
    for batch in batches:
        keys, rows = (batch.column(i).to_numpy() for i in range(2))
        if not len(keys):
            continue
        again = np.concatenate([[last is not None and last[0] == keys[0]], keys[1:] == keys[:-1]])
        keep = again | np.concatenate([again[1:], [False]])
        out = [(keys[keep], rows[keep])]
        if again[0] and not sent:
            out.insert(0, (np.array([last[0]]), np.array([last[1]])))
        yield pa.RecordBatch.from_pydict({"key": np.concatenate([k for k, _ in out]), "row": np.concatenate([r for _, r in out])})
        last, sent = (keys[-1], rows[-1]), bool(keep[-1])


def prefix_buckets(slim: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, row) of keys with several rows: rows of distinct by the shingles of their prefixes; two rows of similarity ``LEAST`` or
    more share a key, always. The order of shingles, of which a prefix takes the first, is that of their hashes, frequent
    ones last. One shuffle carries a fifth of the shingles, and only what is shared is written."""
    spark = slim.sparkSession
    late = spark.sparkContext.broadcast(frequent_shingles(slim))  # at most FREQUENT numbers

    def prefixes(batch: pa.RecordBatch) -> dict:
        part = []
        for t in column(batch, "text"):
            s = shingles(t)
            behind = _in(s, late.value)
            part.append(np.concatenate([s[~behind], s[behind]])[: prefix_size(len(s))])
        sizes = np.array([len(p) for p in part], dtype=np.int64)
        return {"key": _signed(np.concatenate([np.zeros(0, "<u8"), *part])), "row": np.repeat(batch.column(0).to_numpy(), sizes)}

    there = distinct.select("row")
    there = F.broadcast(there) if there.count() <= WHOLE else there.hint("merge")  # 8 bytes a row
    entries = arrow(slim.select("row", "text").join(there, "row", "left_semi"), prefixes, "key long, row long", most=1 << 20)
    dealt = entries.repartition(parts(spark), "key").sortWithinPartitions("key")
    return saved(dealt.mapInArrow(_several, "key long, row long"))


def kept_rows(docs: DataFrame, key: str, exact: bool = EXACT) -> DataFrame:
    """The ``key`` of the row that stays of each group of docs (key, doc_id, text): that of least doc_id, nulls last.

    Groups are joined by links of similarity ``LEAST`` or more. With ``exact`` candidates meet by prefix_buckets() instead of
    MinHash bands, so that no link is missed. Texts without a word are copies of each other; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in column(batch, "text")]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        fp = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
        return {"row": batch.column(0), "doc_id": batch.column(1), "digest": pa.array(digest, pa.binary()), "fp": fp, "keys": pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))}

    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    sketches = arrow(slim, sketch, "row long, doc_id long, digest binary, fp long, keys array<long>", most=1 << 20)
    first = sketches.groupBy("digest").agg(F.min(F.struct(order.alias("o"), "fp", "keys")).alias("f"))
    distinct = saved(first.select("f.o.row", "f.o.doc_id", "f.fp", "f.keys"))
    # Pairs by fingerprint: linked ones, and rows of one fingerprint with the least of them.
    prints = distinct.where(F.size("keys") > 0).select("row", "fp")
    reps = saved(prints.groupBy("fp").agg(F.min("row").alias("rep")))
    near = fingerprint_links(reps).union(prints.join(reps, "fp").where("row <> rep").select("row", "rep"))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = saved(near.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("row")))
    buckets = prefix_buckets(slim, distinct) if exact else distinct.select("row", F.explode("keys").alias("key")).select("key", "row")
    large = large_buckets(buckets)
    any_large = not large.isEmpty()
    cold = buckets.join(large.select("key"), "key", "left_anti") if any_large else buckets
    met = saved(cold.repartition(parts(spark), "key").sortWithinPartitions("key", "row").mapInArrow(_shared, "key long, row long, who binary"))
    alike = met.groupBy("who").agg(F.min("key").alias("key")).select("key")
    members = saved(met.select("key", "row").join(alike.hint("merge"), "key"))
    todo = members.union(near).select("key", F.lit(0).alias("salt"), F.lit(0).alias("role"), "row")
    big = None
    if any_large:
        big = saved(buckets.join(large.where("key = one").select("key", "n"), "key").withColumn("salts", F.ceil(F.col("n") / CHUNK).cast("int")))
        todo = todo.union(big.select("key", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("role"), "row"))
        pivots = big.where(F.pmod(F.xxhash64("row", "key"), F.col("n")) < PIVOTS)
        todo = todo.union(pivots.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "row"))

    def sets_of(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column(0), "hashes": pa.array([shingles(t).tobytes() for t in column(batch, "text")], pa.binary())}

    wanted = slim.select("row", "text").join(todo.select("row").distinct().hint("merge"), "row", "left_semi")
    sets = saved(arrow(wanted, sets_of, "row long, hashes binary", most=1 << 20))
    edges = compared(todo, sets)
    roots = connected_components(edges)
    if any_large:
        named = big.join(roots, F.col("row") == F.col("v"), "left").select("key", "row", "salts", F.coalesce("root", "row").alias("root"))
        sizes = named.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("c")).where("c > 1")
        named = saved(named.join(main.select("key", F.col("m.root").alias("main")), "key"))
        apart = named.where("root <> main")
        if not apart.isEmpty():
            todo = named.select("key", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("role"), "row")
            todo = todo.union(apart.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("role"), "row"))
            roots = connected_components(edges.union(compared(todo, sets)))
    grouped = distinct.select("row", "doc_id").join(roots, F.col("row") == F.col("v"), "left").withColumn("component", F.coalesce("root", "row"))
    return grouped.groupBy("component").agg(F.min(order).alias("o")).select(F.col("o.row").alias(key))
