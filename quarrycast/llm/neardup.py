"""Near-duplicate texts by a chosen-path set similarity join.

Each text is a set of word n-grams, of which a worker keeps the hashes, a row of minhash values and a
bit sketch. Exact copies form one class with one representative. Representatives enter a forest: a root for
each of `trees` minhash coordinates; a node's members branch by the value that they have at coordinates
which the node chooses. A node of at most `leaf` members is compared exhaustively; a larger one branches
again, on `branch` coordinates. A pair of similarity s meets at a root with probability s, and below it
with s(1 - (1 - s q)^branch) where q is the same one level deeper, so that at s = 0.7 and two branches no
fewer than 0.57 of the pairs survive any depth; independent trees raise that to the target recall.
Nodes that are still large at the last level, and those that branching hardly thins out (clusters of texts
that are all alike), are compared in full too, split into blocks of pairs over tasks. Candidates whose sketches are too far
apart are dropped (4 standard deviations below the threshold), the rest is verified on the sets, so precision is 1.
Only node, id, size and sketch of a member pass through the forest; the sets are made again from the texts of the
candidates alone, and never stored for all texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycast.llm.words import Shingler, mix, words
from quarrycast.runtime import cut, ship

COORDINATES = 64  #: minhash values of a text that nodes choose from
BITS = 256  #: one-bit minhashes in a sketch
SKETCH = [f"s{k}" for k in range(BITS // 64)]  #: its columns
SIGMAS = 4.0  #: standard deviations of the sketch distance that a true pair may be off
BLOCK = 2_000  #: members of a part, of which two at a time are compared in a node that isn't branched any more
DENSE = 0.8  #: a node with at least this share of its parent's members is one that branching can't thin out


def trees_for(threshold: float, recall: float, branch: int) -> int:
    """Trees after which a pair at the threshold is met with probability recall, however deep its nodes are.

    An error where there are more than coordinates to start them from.
    """
    q = 1.0
    for _ in range(200):
        q = 1 - (1 - threshold * q) ** branch
    met = threshold * q
    needed = max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if 0 < met < 1 else 1 if met >= 1 else COORDINATES + 1
    if needed > COORDINATES:
        raise ValueError(f"a recall of {recall} at the threshold {threshold} needs more trees than the {COORDINATES} coordinates allow; use more branches, or a higher threshold")
    return needed


def _texts(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts]).alias("t"))


def sketches(df: DataFrame, key: str, texts: list[str], n: int) -> DataFrame:
    """(id, class, size, hashes, s0..) of each row whose words make at least one n-gram; class is a digest of the set."""
    schema = "id bigint, class binary, size int, hashes array<int>, " + ", ".join(f"{c} bigint" for c in SKETCH)
    seeds = mix(np.arange(1, COORDINATES + BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            at, digest, sizes, hashes, bits = [], [], [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                g = shingle(words(t))
                if not len(g):
                    continue
                at.append(i)
                digest.append(hashlib.md5(g.tobytes()).digest())
                sizes.append(len(g))
                least = _least(g, seeds)
                hashes.append((least[:COORDINATES] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                bits.append(np.packbits((least[COORDINATES:] & np.uint64(1)).astype(np.uint8)).view(np.int64))
            if not at:
                continue
            h = np.concatenate(hashes)
            ends = pa.array(np.arange(0, len(h) + 1, COORDINATES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(digest, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(h)), *map(pa.array, np.ascontiguousarray(np.stack(bits).T))], ["id", "class", "size", "hashes", *SKETCH])

    return _texts(df, key, texts).mapInArrow(run, schema)


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, grams), the sorted hashes of the n-grams of each row of (id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            grams = [shingle(words(t)).view(np.int64) for t in batch.column("t").to_pylist()]
            ends = np.cumsum([0, *map(len, grams)])
            flat = np.concatenate(grams) if grams else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "grams"])

    return rows.mapInArrow(run, "id bigint, grams array<bigint>")


def _least(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the smallest seeded hash of the set, in slices so that long texts need no large table."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    step = 256
    with np.errstate(over="ignore"):
        for a in range(0, len(grams), step):
            x = (grams[a : a + step, None] ^ seeds[None, :]) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
            np.minimum(out, x.min(axis=0), out=out)
    return out


def _branches(node: Column, hashes: Column, level: int, how_many: int) -> Column:
    """The child nodes of a member: for each coordinate that the node chooses, the hash of (node, coordinate, value)."""
    picks = [F.pmod(F.xxhash64(node, F.lit(level), F.lit(k)), F.lit(COORDINATES)).cast("int") for k in range(how_many)]
    return F.array(*[F.xxhash64(node, F.lit(level), F.lit(k), p, F.element_at(hashes, p + 1)) for k, p in enumerate(picks)])


def _forest(reps: DataFrame, trees: int, branch: int, leaf: int, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Members (node, id, size, s0..) of all leaves by level, and (with n, the node's members) of nodes to compare in blocks."""
    keep = ["id", "size", *SKETCH]
    # roots: every tree has its own coordinate
    roots = F.array(*[F.xxhash64(F.lit(k), F.element_at("hashes", k + 1)) for k in range(trees)])
    members = reps.select(F.explode(roots).alias("node"), F.lit(None).cast("bigint").alias("parent"), *keep)
    leaves, blocked = [], []
    for level in range(levels + 1):
        counts = members.groupBy("node").agg(F.count("*").alias("n"))
        sized = cut(members.join(counts.where("n > 1"), "node"))
        leaves.append(sized.where(F.col("n") <= leaf).select("node", *keep))
        large = sized.where(F.col("n") > leaf)
        dense = F.coalesce(F.col("n") >= DENSE * F.col("parent"), F.lit(False)) | F.lit(level == levels)
        blocked.append(large.where(dense).select("node", "n", *keep))
        thin = large.where(~dense)
        if level == levels or thin.isEmpty():
            break
        # only members of nodes that branch need their minhash values again
        thin = thin.join(reps.select("id", "hashes").hint("merge"), "id")  # never broadcast, whatever its size
        members = thin.select(F.explode(_branches(F.col("node"), F.col("hashes"), level, branch)).alias("node"), F.col("n").alias("parent"), *keep)
    return leaves, blocked


def _block_pairs(large: DataFrame, threshold: float) -> DataFrame:
    """Near pairs (a, b) of nodes that aren't branched: every member meets every other in one pair of parts."""
    parts = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("id"), parts)
    all_parts = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    left, right = large.withColumn("i", own).withColumn("j", all_parts), large.withColumn("j", own).withColumn("i", all_parts)
    on = (F.col("a.node") == F.col("b.node")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return left.alias("a").join(right.alias("b"), on & (F.col("a.id") < F.col("b.id")) & _near("a", "b", threshold)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _near(a: str, b: str, threshold: float) -> Column:
    """The sketches and the sizes of a and b allow for the threshold."""
    agree = (1 + threshold) / 2
    most = int(BITS * (1 - agree) + SIGMAS * math.sqrt(BITS * agree * (1 - agree)))
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    sizes = F.least(f"{a}.size", f"{b}.size") >= F.lit(threshold - 1e-9) * F.greatest(f"{a}.size", f"{b}.size")
    return sizes & (apart <= most)


def class_pairs(df: DataFrame, key: str, texts: list[str], threshold: float = 0.8, n: int = 5, recall: float = 0.999, leaf: int = 48, branch: int = 2, levels: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members (id, rep), pairs (a, b, similarity) of different representatives, a < b).

    A class holds the rows whose sets of n-grams are the same; rep is its least id. Pairs are those of
    similarity (Jaccard) threshold or more. Rows whose words make no n-gram, null texts among them, and rows
    with a null key are in no class. Repeated rows count once. Empty tables give empty results.
    """
    ship(df.sparkSession)
    trees = trees_for(threshold, recall, branch)
    rows = df.where(F.col(key).isNotNull())
    base = cut(sketches(rows, key, texts, n))
    pure = base.groupBy("class", "id").agg(F.first(F.struct("size", "hashes", *SKETCH)).alias("s"))
    firsts = base.groupBy("class").agg(F.min("id").alias("rep"))
    members = cut(base.select("id", "class").distinct().join(firsts.hint("merge"), "class").select("id", "rep", "class"))
    reps = cut(pure.join(members.where("id = rep").select("class", "id").hint("merge"), ["class", "id"], "left_semi").select("id", "s.*"))
    leaves, blocked = _forest(reps, trees, branch, leaf, levels)
    # nodes of different levels have different hashes, so all leaves are joined at once
    small = reduce(DataFrame.unionByName, leaves)
    near = small.alias("a").join(small.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.id") < F.col("b.id")) & _near("a", "b", threshold)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    pairs = cut(near.unionByName(_block_pairs(reduce(DataFrame.unionByName, blocked), threshold)).distinct())
    # the sets of candidates only; repeated rows of an id have one text each, by its class
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _sets(_texts(rows, key, texts).join(wanted, "id", "left_semi"), n).groupBy("id").agg(F.first("grams").alias("grams"))
    sets = cut(sets)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s")).withColumn("similarity", F.col("c") / (F.col("s") - F.col("c")))
    return members.select("id", "rep"), both.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def all_pairs(df: DataFrame, key: str, texts: list[str], **kw) -> DataFrame:
    """(id_a, id_b) of all pairs of rows whose similarity is at least the threshold, copies included."""
    members, pairs = class_pairs(df, key, texts, **kw)
    a = members.select(F.col("id").alias("id_a"), F.col("rep").alias("a"))
    b = members.select(F.col("id").alias("id_b"), F.col("rep").alias("b"))
    same = a.join(b, (F.col("a") == F.col("b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    other = pairs.join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return same.unionByName(other)


def classes(df: DataFrame, key: str, texts: list[str], **kw) -> DataFrame:
    """(id, class_id, links): one row per text with its class of exact copies and the number of near classes."""
    members, pairs = class_pairs(df, key, texts, **kw)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
