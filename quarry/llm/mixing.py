"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document gets a uniform position u from a hash; block floor(u * n) of its source is
one of n blocks of about ``block_words`` words, so a block is a random part of its source. (Blocks
hold more words where there would be over ``MOST_BLOCKS`` of them: draws of more are not exact.)
Two trees split exact block numbers on the driver, one row per source:

* ``deal`` gives every source's blocks to the output shards: each node deals its blocks to its
  two halves by a multivariate hypergeometric draw, so shards get equal numbers of blocks, each
  block belongs to one shard, and a shard's blocks of a source are a range of block numbers;
* a source's target becomes whole passes over its blocks plus a remainder. ``split_quota``
  splits the blocks that the remainder needs among the shards, hypergeometrically by the blocks
  each shard has, so that they are a draw without replacement from all blocks of the source.

A shard then takes its quota from its blocks in permuted (hash) order. Blocks hold different
numbers of words: the chosen blocks in order of shards, then the others, are cumulated, and the
remainder ends inside one block, whose documents are taken in hash order up to the exact word,
so the words taken equal the rounded target. ``shards`` shuffles each shard's draws locally.

Only the blocks of one source and shard (one row per ``block_words`` words) are ever sorted
together; documents are sorted within the blocks that hold a remainder's end. Texts are read
once and never moved.

Defined cases: a null text has size 0; a null source is a source of its own, last in the
order of weights; sources of size 0 get target 0; an empty table gives an empty result;
repeated rows are rows of their own; columns besides doc_id, text and source are ignored;
more than ``max_sources`` sources are refused, since their rows go through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_tokens, settle, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20240131
#: Blocks of all sources together, besides one a source; numpy draws exactly from pools of under 10**9.
MOST_BLOCKS = 500_000_000
LANES = "sk string, source_size long, target double, n_blocks long, whole long, rest long, shard int, first long, owned long, quota long"


def targets(sizes: list[int], weights: list[float], ceiling: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above ceiling times its size; what is cut off is
    shared among the others by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > ceiling * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = ceiling * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def deal(counts: np.ndarray, n_shards: int, seed: int = SEED) -> np.ndarray:
    """int64 [sources, shards]: how many of each source's blocks each shard owns. Each node deals its
    blocks to two halves without replacement, in proportion to their shards."""
    out = np.zeros((len(counts), n_shards), np.int64)

    def node(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(have, total * (mid - lo) // (hi - lo), method="marginals")
        node(left, lo, mid)
        node(have - left, mid, hi)

    node(np.asarray(counts, np.int64), 0, n_shards)
    return out


def split_quota(quota: np.ndarray, owned: np.ndarray, seed: int = SEED) -> np.ndarray:
    """int64 [sources, shards]: the parts of each source's quota that its shards draw, of the blocks they own
    (owned, [sources, shards]): each node splits its quota between its halves hypergeometrically."""
    out = np.zeros_like(owned)
    sums = np.concatenate((np.zeros((len(owned), 1), np.int64), np.cumsum(owned, axis=1)), axis=1)

    def node(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi, 1]))
        left = rng.hypergeometric(sums[:, mid] - sums[:, lo], sums[:, hi] - sums[:, mid], have)
        node(left, lo, mid)
        node(have - left, mid, hi)

    if len(owned):
        node(np.asarray(quota, np.int64), 0, owned.shape[1])
    return out


def _unit(*cols: Column) -> Column:
    """A double in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = 3.0, n_shards: int = 16,
        block_words: int = 1_000_000, seed: int = SEED, max_sources: int = 1_000_000, max_broadcast_blocks: int = 50_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, shard (that owns its block),
    shard_blocks (blocks the shard draws of the source, in all passes), and draws, an array of (pass, shard, words,
    place) of which words sum to taken; place orders a shard's draws."""
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    text = text_or_empty()
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("sk"), n_tokens(text).alias("size"), _unit(F.col("doc_id"), text, F.lit(seed)).alias("u"))
    sized = settle(sized, "mix-sizes")
    found = sized.groupBy("sk", "source").agg(F.sum("size").alias("size")).limit(max_sources + 1).toArrow().to_pylist()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # str order is code point order
    sizes = np.array([r["size"] for r in found], np.int64)
    goal = np.array(targets(sizes.tolist(), [weights[i % len(weights)] for i in range(len(found))], ceiling), np.float64)
    n_blocks = np.maximum(1, -(-sizes // max(block_words, -(-int(sizes.sum()) // MOST_BLOCKS))))
    words = np.minimum(np.rint(goal), np.floor(ceiling * sizes)).astype(np.int64)
    whole = words // np.maximum(sizes, 1)
    rest = words - whole * sizes
    need = np.minimum(n_blocks, np.ceil(rest / np.maximum(sizes, 1) * n_blocks).astype(np.int64))  # blocks of the remainder
    owned = deal(n_blocks, n_shards, seed)
    quota = split_quota(need, owned, seed)
    # one row per source and shard
    each = lambda x: pa.array(np.repeat(x, n_shards))
    first = np.cumsum(owned, axis=1) - owned
    columns = {
        "sk": pa.array([r["sk"] for r in found for _ in range(n_shards)], pa.string()), "source_size": each(sizes), "target": each(goal), "n_blocks": each(n_blocks), "whole": each(whole), "rest": each(rest),
        "shard": pa.array(np.tile(np.arange(n_shards, dtype=np.int32), len(found))), "first": pa.array(first.ravel()), "owned": pa.array(owned.ravel()), "quota": pa.array(quota.ravel()),
    }
    lanes = settle(spark.createDataFrame(pa.table(columns), LANES), "mix-lanes")
    src = F.broadcast(lanes.where("shard = 0").select("sk", "source_size", "target", "n_blocks"))  # one row per source, counted above

    placed = sized.join(src, "sk").withColumn("block", F.floor(F.col("u") * F.col("n_blocks")))
    blocks = settle(placed.groupBy("sk", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    owner = lanes.where("owned > 0").groupBy("sk").agg(F.max("whole").alias("whole"), F.max("rest").alias("rest"), F.array_sort(F.collect_list(F.struct("first", "owned", "quota", "shard"))).alias("lanes"))  # n_shards a source
    mine = lambda f: F.element_at(F.filter("lanes", lambda x: x["first"] <= F.col("block")), -1)[f]
    dealt = blocks.join(F.broadcast(owner), "sk").select("sk", "block", "words", "whole", "rest", mine("shard").alias("shard"), mine("quota").alias("quota"), mine("owned").alias("owned"))
    order = [F.xxhash64("sk", "block", F.lit(seed)), F.col("block")]
    dealt = dealt.withColumn("chosen", F.row_number().over(Window.partitionBy("sk", "shard").orderBy(*order)) <= F.col("quota"))
    # a remainder takes the chosen blocks in order of shards, then (where those hold too few words) the others
    groups = dealt.groupBy("sk", "chosen", "shard").agg(F.sum("words").alias("sum"))
    ahead = F.sum("sum").over(Window.partitionBy("sk").orderBy(F.desc("chosen"), "shard")) - F.col("sum")  # two rows a shard
    groups = groups.select("sk", "chosen", "shard", ahead.alias("ahead"))
    inner = Window.partitionBy("sk", "chosen", "shard").orderBy(*order)
    dealt = dealt.join(groups, ["sk", "chosen", "shard"]).withColumn("before", F.col("ahead") + F.sum("words").over(inner) - F.col("words"))
    take = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))
    per_block = dealt.select("sk", "block", "shard", (F.col("whole") * F.col("owned") + F.col("quota")).alias("shard_blocks"), "whole", take.cast("long").alias("take"), ((take > 0) & (take < F.col("words"))).alias("cut"))
    if int(n_blocks.sum()) <= max_broadcast_blocks:
        per_block = F.broadcast(per_block)
    found_ = placed.join(per_block, ["sk", "block"])
    at_end = Window.partitionBy("sk", "block").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = found_.where("cut").withColumn("ahead", F.coalesce(F.sum("size").over(at_end), F.lit(0)))
    both = found_.where("not cut").withColumn("ahead", F.lit(0).cast("long")).unionByName(inside)
    part = F.when(F.col("cut"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("take") - F.col("ahead")))).when(F.col("take") > 0, F.col("size")).otherwise(F.lit(0))
    passes = F.sequence(F.lit(0).cast("long"), F.col("whole"))
    draws = F.transform(passes, lambda p: F.struct(p.alias("pass"), F.col("shard").alias("shard"), F.when(p < F.col("whole"), F.col("size")).otherwise(part).cast("long").alias("words"), F.xxhash64("u", p, F.lit(seed + 1)).alias("place")))
    both = both.withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return both.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "shard", "shard_blocks", "draws")


def shards(mixed: DataFrame, n_parts_per_shard: int = 1) -> DataFrame:
    """The draws of mix(), one row each, dealt to partitions by shard (and a slice of place) and
    shuffled inside them: shard, place, doc_id, pass, words."""
    each = mixed.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "d.place", "doc_id", "d.pass", "d.words")
    return each.withColumn("slice", F.pmod("place", F.lit(n_parts_per_shard))).repartition("shard", "slice").sortWithinPartitions("shard", "place", "doc_id").drop("slice")
