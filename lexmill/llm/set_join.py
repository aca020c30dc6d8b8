"""All similar pairs between set-valued records (problem 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.hashing import mix
from lexmill.sources.tables import Scratch, spread

_U = np.uint64
#: A node of at most so many records is compared pair by pair in a task, a larger one in salted blocks.
SMALL_NODE = 1024
#: Expected records of a node at which branching ends.
LEAF = 128
#: Tokens in at least this share of all sets do not branch; they count for the similarity. Tokens in less than the lower
#: share count as being in just that: at most (mean tokens of a set) / RARE tokens are more frequent, a proven bound.
COMMON, RARE = 0.2, 1e-4
#: Chance with which a pair at the threshold shares a leaf of one of the trees.
FOUND = 0.998
#: Branchings of a path at most; what is still together then is compared in blocks.
DEEPEST = 16
_BITS, _BINS = 128, 16


def sketches(record: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 one-bit minwise hashes of each set, in two words; two sets of similarity J agree on a bit with a chance of at
    least (1 + J) / 2. Each of eight hashes throws the tokens into 16 bins, of which the least one gives a bit; a bin that
    is empty in both sets agrees."""
    out = np.zeros((2, n), _U)
    base = mix(tokens)
    for turn in range(_BITS // _BINS):
        h = mix(base + _U(0x9E3779B97F4A7C15 * (turn + 1) % (1 << 64)))
        least = np.full(n * _BINS, np.iinfo(np.uint64).max, _U)
        np.minimum.at(least, record * _BINS + (h & _U(_BINS - 1)).astype(np.int64), h >> _U(4))
        bits = (least.reshape(n, _BINS) & _U(1)) << np.arange(_BINS, dtype=_U)
        word, place = divmod(turn * _BINS, 64)
        out[word] |= bits.sum(1, dtype=_U) << _U(place)
    return out[0], out[1]


def most_different(threshold: float) -> int:
    """Bits in which sketches may differ before a pair is given up: four standard deviations over the mean at the
    threshold, a chance of some 3 in 100,000 for a pair at it."""
    p = (1 - threshold) / 2
    return min(_BITS, math.ceil(_BITS * p + 4 * math.sqrt(_BITS * p * (1 - p))))


def grow(
    tokens: np.ndarray, share: np.ndarray, sizes: np.ndarray, chance: np.ndarray, root: int, expected: float, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Leaves ``(owner, path)`` of a tree. At each node a token that is not on the path yet is chosen if its hash with the
    path falls below the record's chance, so all records at a node choose alike; a path names its tokens in the order of
    choice. It ends where ``expected`` records times the shares of its tokens come to ``LEAF`` or less, which all records
    at the node find alike, too, without being counted."""
    offset = np.r_[0, np.cumsum(sizes)]
    limit = (np.minimum(chance, 1.0) * float(1 << 53)).astype(_U)
    owner = np.arange(len(sizes))
    path, left = np.full(len(owner), root, _U), np.full(len(owner), math.log(max(expected, 1e-9) / LEAF))
    used = np.zeros((len(owner), 0), _U)
    done_owner, done_path = [owner[left <= 0]], [path[left <= 0]]
    owner, path, used, left = owner[left > 0], path[left > 0], used[left > 0], left[left > 0]
    for level in range(DEEPEST):
        n = sizes[owner]
        at = np.repeat(np.arange(len(owner)), n)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + offset[owner[at]]
        h = mix(path[at] + tokens[place] * _U(0xD6E8FEB86659FD93) + _U(seed * 64 + level + 1))
        chosen = np.flatnonzero((h >> _U(11)) <= limit[owner[at]])
        chosen = chosen[(used[at[chosen]] != tokens[place[chosen], None]).all(1)]
        at, place, h = at[chosen], place[chosen], h[chosen]
        owner, path, left = owner[at], mix(h), left[at] + share[place]
        used = np.c_[used[at], tokens[place]]
        end = left <= 0
        done_owner.append(owner[end])
        done_path.append(path[end])
        owner, path, used, left = owner[~end], path[~end], used[~end], left[~end]
        if not len(owner):
            break
    return np.concatenate([*done_owner, owner]), np.concatenate([*done_path, path])


def trees_for(depth: int, found: float = FOUND) -> int:
    """Trees that a pair needs to share a leaf of one of them with chance ``found``, if one of its branches is kept alive on
    average at each of ``depth`` levels: such a pair is still alive in one tree with chance q, q' = 1 - exp(-q) a level."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - found) / math.log(1 - alive)) if alive < 1 else 1


def _branching(sizes: np.ndarray, rare: np.ndarray, threshold: float) -> np.ndarray:
    """The chance of a branching token of sets of ``sizes`` tokens, ``rare`` of which branch.

    Whatever the other's size, a similar set shares at least a share t, the threshold, of this one's tokens (of sets of
    like size more, but one may hold the other), so at least |rare| - (1 - t) |all| rare ones: a chance of one over that
    keeps one branch alive on average.
    """
    return 1.0 / np.maximum(rare - (1 - threshold) * sizes, 1.0)


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and tokens of a batch whose first columns are an id and an array of longs."""
    lists = batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    return batch.column(0).to_numpy(), np.r_[0, np.cumsum(sizes)], lists.flatten().to_numpy().view(_U)


def _paths(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n: int, threshold: float, trees: int, all_tokens: bool) -> DataFrame:
    """``(path, id, s1, s2)`` of every set at the leaves of every tree; no shuffle, each set is followed alone. ``frequent``
    has the sorted tokens of at least ``RARE`` of the sets and their shares."""
    sent = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shares = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # bounds the memory of a level
                ids, offset, flat = _rows_of(batch.slice(start, 500))
                record = np.repeat(np.arange(len(ids)), np.diff(offset))
                one, two = sketches(record, flat, len(ids))
                at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                share = np.where(known[at] == flat, shares[at], RARE) if len(known) else np.full(len(flat), RARE)
                branching = (share < COMMON) | all_tokens
                rare = np.bincount(record[branching], minlength=len(ids))
                chance = _branching(np.diff(offset), rare, threshold)
                tokens, logs = mix(flat[branching]), np.log(share[branching])
                for tree in range(trees):
                    owner, path = grow(tokens, logs, rare, chance, tree * 2 + all_tokens + 1, n, tree)
                    arrays = [path.view(np.int64), ids[owner], one[owner].view(np.int64), two[owner].view(np.int64)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["path", "id", "s1", "s2"])

    return spread(sets.select("id", "tokens"), "id").mapInArrow(run, "path long, id long, s1 long, s2 long")


def _nodes(paths: DataFrame, differ: int, small_node: int = SMALL_NODE) -> DataFrame:
    """Of small nodes the pairs ``(a, b)`` whose sketches allow the similarity; of larger ones each record as
    ``(a, null, path, s1, s2)``. One shuffle by path; sorted runs stream through, only one node's records are held."""

    def pairs(path: np.ndarray, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
        left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(path))  # rows to the end of the node
        at, step = np.flatnonzero(left > 1), 1
        while len(at):
            hit = np.bitwise_count((one[at + step] ^ one[at]).view(_U)) + np.bitwise_count((two[at + step] ^ two[at]).view(_U)) <= differ
            hit &= ids[at + step] != ids[at]
            a.append(ids[at[hit]])
            b.append(ids[at[hit] + step])
            step += 1
            at = at[left[at] > step]
        x, y = np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])
        return batch_of(np.minimum(x, y), np.maximum(x, y))

    def batch_of(a, b=None, *rest) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        columns = [pa.array(a), none if b is None else pa.array(b), *map(pa.array, rest or ())]
        return pa.RecordBatch.from_arrays(columns + [none] * (5 - len(columns)), ["a", "b", "path", "s1", "s2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [np.zeros(0, np.int64)] * 4, None
        for batch in batches:
            rows = [np.r_[held[i], batch.column(i).to_numpy()] for i in range(4)]
            path, ids = rows[:2]
            if not len(path):
                continue
            edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
            sizes = np.repeat(np.diff(edges), np.diff(edges))
            open_run = np.arange(len(path)) >= edges[-2]
            big = (sizes > small_node) | (path == large if large is not None else False)
            large = path[-1] if big[-1] else None
            done = ~open_run & ~big & (sizes > 1)
            held = [x[open_run & ~big] for x in rows]
            if done.any():
                yield pairs(*(x[done] for x in rows))
            if big.any():
                yield batch_of(ids[big], None, path[big], rows[2][big], rows[3][big])
        if len(held[0]) > 1:
            yield pairs(*held)

    rows = paths.repartition("path").sortWithinPartitions("path", "id")
    return rows.mapInArrow(run, "a long, b long, path long, s1 long, s2 long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    x = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    found = pairs.distinct().join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return found.where(F.col("both") >= threshold * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("a", "b")


def similar_sets(
    sets: DataFrame, scratch: Scratch, threshold: float = 0.7, trees: int | None = None, small_node: int = SMALL_NODE, exact: bool = False
) -> DataFrame:
    """``(a, b)``, a < b: pairs of the distinct sets ``(id, tokens)`` with |x n y| / |x u y| >= ``threshold``.

    Recursive chosen-path splitting: each tree branches records on randomly chosen shared tokens until so few records are
    to be expected at a node that all of them can be compared by sketch; nodes that turn out large are compared in salted
    blocks, so nothing is capped and no pair in a node is lost. Candidates are then verified exactly on whole sets. Very
    common tokens do not branch; if some sets consist of hardly anything else, a second forest over all tokens finds
    their pairs. The number of trees (``trees``, or ``trees_for`` the mean depth and one more level) sets the recall;
    ``exact`` finds every pair by ``prefix_pairs`` instead.
    """
    n = sets.count()
    if n < 2:
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    counts = scratch.keep(sets.select(F.explode("tokens").alias("t")).groupBy("t").count())
    if exact:
        return _verified(prefix_pairs(sets, counts, threshold), sets, threshold)
    listed = counts.where(F.col("count") >= max(RARE * n, 2)).orderBy("t").toArrow()
    known, share = listed.column(0).to_numpy().view(_U), listed.column(1).to_numpy() / n
    order = np.argsort(known)
    known, share = known[order], share[order]
    common = known[share >= COMMON].view(np.int64)  # at most mean size / COMMON tokens
    log = F.log(F.greatest(F.col("count") / n, F.lit(RARE)))
    usual = counts.where(F.col("count") < COMMON * n).agg(F.sum(log * F.col("count")) / F.sum("count")).first()[0] or math.log(COMMON)
    depth, differ = math.ceil(max(math.log(n / LEAF), 0.0) / -usual) + 1, most_different(threshold)
    rare = F.size(F.filter("tokens", lambda t: ~t.isin([int(x) for x in common]))) if len(common) else F.size("tokens")
    is_hard = rare - (1 - threshold) / (1 + threshold) * F.size("tokens") < 0.27 * F.size("tokens")
    hard = sets.where(is_hard).limit(1).count()
    pairs = None
    for every in [False] + [True] * (hard > 0):
        asked = sets if every else sets.where(~is_hard)
        paths = _paths(asked, (known, share), n, threshold, trees or trees_for(depth * (2 if every else 1)), every)
        level = scratch.keep(_nodes(paths, differ, small_node))
        found = level.where("b is not null").select("a", "b")
        large = level.where("b is null").select(F.col("a").alias("id"), "path", "s1", "s2")
        if large.limit(1).count():
            salted = large.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
            other = large.select("path", F.col("id").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(32)))).alias("salt"))
            close = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= differ
            found = found.unionByName(salted.join(other, ["path", "salt"]).where((F.col("id") < F.col("b")) & close).select(F.col("id").alias("a"), "b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return _verified(pairs, sets, threshold)


def prefix_pairs(sets: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: candidates that hold every similar pair. Two similar sets share one of the rarest |x| - ceil(t |x|) + 1
    tokens of either, so these are joined; sets whose sizes differ too much are no candidates."""
    flat = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(counts, "t")
    ranked = flat.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "t"))).alias("x"))
    prefix = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    rows = ranked.select("id", "n", F.explode(F.slice("x", F.lit(1), prefix)["t"]).alias("t"))
    other = rows.select(F.col("id").alias("b"), F.col("n").alias("m"), "t")
    near = (F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("m") >= threshold * F.col("n") - 1e-9)
    return rows.join(other, "t").where((F.col("id") < F.col("b")) & near).select(F.col("id").alias("a"), "b")


def all_pairs(links: DataFrame, members: DataFrame, scratch: Scratch, salts: int = 16) -> DataFrame:
    """``(doc_a, doc_b)``: the links between sets and the equality within them, for all records that hold them."""
    shared = scratch.keep(members.join(members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "id", "left_semi"))
    left = shared.select("id", F.col("doc_id").alias("x"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    right = shared.select("id", F.col("doc_id").alias("y"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(salts)))).alias("salt"))
    equal = left.join(right, ["id", "salt"]).where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))
    a, b = (members.select(F.col("id").alias(k), F.col("doc_id").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    linked = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    return linked.unionByName(equal)
