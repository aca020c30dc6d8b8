"""Most similar vectors for every vector (problem 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.bags import MOST_IDS
from lexmill.llm.hashing import mix
from lexmill.sources.tables import Scratch, small, spread, without_hot_repeats

_U = np.uint64
FIELDS = ("normalized_weight", "normalized_count")
#: Dimensions of the projection, places that a term takes in it, dimensions of a 4-bit code.
DIMENSIONS, PLACES, PART = 128, 4, 2
#: Rows that centroids are fitted on, at most and for each list; rows for the codebooks. Every row is indexed.
SAMPLE, SAMPLE_OF_LIST, SAMPLE_OF_CODES = 65_536, 64, 6_144
#: Rows of a list on average, lists that a query visits at least, index rows that are scanned at once.
LIST, VISITED, BLOCK = 1000, 6, 4096
#: Blocks of a group.
GROUP = 4
#: Standard deviations of the part of a neighbour's offset that points to another list; lists within them are visited.
REACH = 2.5
#: Candidates of a query in a block up to which they are verified as pairs, beyond which the query is compared exactly
#: with the whole block; how far their estimate may fall short.
RERANKED, SLACK = 64, 0.15
#: Weight of the residual's part along the vector against that across it.
PARALLEL = 4.0


@dataclass
class Model:
    """Centroids (lists, d), codebooks (parts, 16, 2), the number of blocks of each list, and the groups of blocks that lie
    together: a query travels once to a group, with a mask of the blocks in it that it asks."""

    centroids: np.ndarray
    codebooks: np.ndarray
    blocks: np.ndarray

    def __post_init__(self) -> None:
        # lists in a chain, each followed by the nearest one that is left
        order, left = [0], np.ones(len(self.centroids), bool)
        left[0] = False
        while left.any():
            rest = np.flatnonzero(left)
            order.append(int(rest[(self.centroids[rest] @ self.centroids[order[-1]]).argmax()]))
            left[order[-1]] = False
        self.base = np.r_[0, np.cumsum(self.blocks)]
        place = np.concatenate([np.arange(self.base[x], self.base[x + 1]) for x in order])
        self.slot = np.empty(len(place), np.int64)  # of each block: group * GROUP + bit
        self.slot[place] = np.arange(len(place))
        self.list_of = np.repeat(np.arange(len(self.blocks)), self.blocks)[place]  # of each slot


def project(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sparse vectors by signed feature hashing as unit vectors of ``DIMENSIONS``; equal vectors stay equal and inner
    products are unbiased before scaling."""
    out = np.zeros(n * DIMENSIONS)
    for place in range(PLACES):
        h = mix(term + _U(0x51ED270B * (place + 1)))
        at = row * DIMENSIONS + (h % _U(DIMENSIONS)).astype(np.int64)
        out += np.bincount(at, value * np.where(h >> _U(63), 1.0, -1.0), minlength=n * DIMENSIONS)
    out = out.reshape(n, DIMENSIONS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def anisotropic_codes(residual: np.ndarray, unit: np.ndarray, codebooks: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes (n, parts) that minimise |e|^2 + (PARALLEL - 1) <e, unit>^2 for the error e, part by part: an error along
    the vector changes its inner products with the queries it matters for, one across it hardly does."""
    n, parts = len(residual), len(codebooks)
    r, u = residual.reshape(n, parts, PART), unit.reshape(n, parts, PART)
    codes = np.empty((n, parts), np.uint8)
    along = np.zeros((n, parts), np.float32)
    for turn in range(rounds):
        total = along.sum(1)
        for m in range(parts):
            book = codebooks[m].astype(np.float32)
            part = (r[:, m] * u[:, m]).sum(1)[:, None] - u[:, m] @ book.T
            cost = (book**2).sum(1)[None] - 2 * (r[:, m] @ book.T)
            rest = (total - along[:, m])[:, None] if turn else 0.0
            cost += (PARALLEL - 1) * (rest + part) ** 2
            codes[:, m] = best = cost.argmin(1)
            new = part[np.arange(n), best]
            total += new - along[:, m]
            along[:, m] = new
    return codes


def fit(sample: np.ndarray, rows: int, seed: int = 7) -> Model:
    """Spherical k-means for the lists, then codebooks of the residuals under the score-aware loss."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(round(rows / LIST), len(sample) // 8 or 1))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(5):
        nearest = _nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids).astype(np.float32)
    nearest = _nearest(sample, centroids, 1)[:, 0]
    counts = np.bincount(nearest, minlength=lists)
    blocks = np.maximum(np.ceil(counts * (rows / len(sample)) / BLOCK), 1).astype(np.int64)
    part = rng.permutation(len(sample))[:SAMPLE_OF_CODES]
    unit, residual = sample[part], sample[part] - centroids[nearest[part]]
    parts = DIMENSIONS // PART
    r, u = residual.reshape(-1, parts, PART), unit.reshape(-1, parts, PART)
    books = np.stack([r[rng.choice(len(r), 16, replace=len(r) < 16), m] for m in range(parts)]).astype(np.float32)
    for _ in range(4):
        codes = anisotropic_codes(residual, unit, books)
        chosen = np.stack([books[m][codes[:, m]] for m in range(parts)], 1)
        along = np.einsum("nmp,nmp->nm", r - chosen, u)
        total = along.sum(1)
        for m in range(parts):  # weighted least squares for each codeword
            w, rest = u[:, m], total - along[:, m]
            left = np.eye(PART)[None] + (PARALLEL - 1) * w[:, :, None] * w[:, None, :]
            right = r[:, m] + (PARALLEL - 1) * w * (rest + (r[:, m] * w).sum(1))[:, None]
            a = np.stack([np.bincount(codes[:, m], left[:, i, j], 16) for i in range(PART) for j in range(PART)], 1).reshape(16, PART, PART)
            b = np.stack([np.bincount(codes[:, m], right[:, i], 16) for i in range(PART)], 1)
            used = np.bincount(codes[:, m], minlength=16) > 0
            books[m][used] = np.linalg.solve(a[used], b[used][..., None])[..., 0]
    return Model(centroids, books, blocks)


def _nearest(rows: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` centroids with the highest inner product of each row, best first."""
    k = min(k, len(centroids))
    out = np.empty((len(rows), k), np.int64)
    for at in range(0, len(rows), 4096):
        score = rows[at : at + 4096] @ centroids.T
        top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.tile(np.arange(k), (len(score), 1))
        order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
        out[at : at + 4096] = np.take_along_axis(top, order, 1)
    return out


def _visited(rows: np.ndarray, centroids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest list of each row, and ``(row, list)`` of all that it visits: the ``VISITED`` nearest, and every other
    that a vector with a cosine of ``least`` to the row may be filed in. Such a one lies off by at most the sine of their
    angle, and for it to be in another list, that offset must cross the plane between the two centroids; its part in the
    direction between them has a deviation of 1 / sqrt(``DIMENSIONS``). A group that takes up many lists has all of them visited."""
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    reach = REACH * math.sqrt(max(1 - least * least, 0.0) / DIMENSIONS)
    home, who, lists = [], [], []
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        nearest = _nearest(part, centroids, VISITED)
        score = part @ centroids.T
        best = nearest[:, 0]
        near = score[np.arange(len(part)), best][:, None] - score <= reach * apart[best]
        np.put_along_axis(near, nearest, True, 1)
        r, c = np.nonzero(near)
        home.append(best)
        who.append(r + at)
        lists.append(c)
    return np.concatenate(home), np.concatenate(who), np.concatenate(lists)


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[np.ndarray]]:
    """Whole runs of equal values of a sorted column: columns of a batch up to its last, open run, which is held."""
    held = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
        key = rows[column]
        if not len(key):
            continue
        cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        held = [x[cut:] for x in rows]
        if cut:
            yield [x[:cut] for x in rows]
    if held is not None and len(held[0]):
        yield held


def entries(rows: DataFrame) -> DataFrame:
    """``(doc_id, term, normalized_weight, normalized_count)`` of a term_document_info table, terms hashed, repeated
    rows dropped within tasks; null and NaN values are 0."""
    values = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).cast(rows.schema[f].dataType).alias(f) for f in FIELDS]
    return rows.where("doc_id is not null and term is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("term").alias("term"), *values)


def records(rows: DataFrame) -> DataFrame:
    """``(doc_id, terms, normalized_weight, normalized_count)``: the distinct terms of each record and their values, in one
    pass over ``entries``. Rows come sorted by record; repeats are dropped as they stream (of differing ones the largest
    values count), so a record of any number of repeated rows needs no more memory than its distinct terms and a batch."""
    kinds = [rows.schema[f].dataType.simpleString() for f in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, term, *values in _groups(batches, 0):
            at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (term[1:] != term[:-1])])
            values, ids, term = [np.maximum.reduceat(v, at) for v in values], ids[at], term[at]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            offsets = pa.array(np.r_[starts, len(ids)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term, *values)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), *lists], ["doc_id", "terms", *FIELDS])

    shape = ", ".join(f"{f} array<{k}>" for f, k in zip(FIELDS, kinds, strict=True))
    calm = without_hot_repeats(rows, "doc_id")
    return calm.repartition("doc_id").sortWithinPartitions("doc_id", "term").mapInArrow(run, f"doc_id long, terms array<long>, {shape}")


def vectors(kept: DataFrame) -> DataFrame:
    """``(field, doc_id, digest, dense)`` of each vector of ``records`` that is not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            term, owner = batch.column(1).flatten().to_numpy().view(_U), np.repeat(np.arange(batch.num_rows), sizes)
            for field in range(len(FIELDS)):
                value = batch.column(2 + field).flatten().to_numpy().astype(np.float64)
                live = np.flatnonzero(value != 0)
                if not len(live):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[live[1:]] != owner[live[:-1]]])
                ends, t, v = np.r_[starts[1:], len(live)], term[live], value[live]
                dense = project(np.repeat(np.arange(len(starts)), ends - starts), t, v, len(starts))
                small_ints = np.rint(dense * (127 / np.maximum(np.abs(dense).max(1, keepdims=True), 1e-9))).astype(np.int8)
                digests = [xxhash.xxh128_digest(t[a:b].tobytes() + v[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(np.full(len(starts), field, np.int32)), pa.array(names[owner[live[starts]]])]
                columns += [pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in small_ints], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["field", "doc_id", "digest", "dense"])

    return kept.mapInArrow(run, "field int, doc_id long, digest binary, dense binary")


def _of_field(kept: DataFrame, name: str) -> DataFrame:
    """``(field, name, terms, values)`` of the records ``kept``: a row for each field."""
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f).cast("array<double>").alias("values")) for k, f in enumerate(FIELDS)))).alias("x")
    return kept.select(F.col("doc_id").alias(name), "terms", both).select("x.field", name, "terms", "x.values")


def _dense(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of 8-bit ones."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIMENSIONS).astype(np.float32)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _candidates(reps: DataFrame, models: dict[int, Model], least: float, slack: float, reranked: int) -> DataFrame:
    """``(field, a, b)``, a < b: pairs whose estimated similarity reaches ``least - slack``. A query with more than
    ``reranked`` of them in a block gives ``(field, a, null, block)`` instead, and each row that is filed in such a block
    ``(field, null, b, block)``, for ``_whole_blocks``. A row is filed with its codes in one block of its nearest list
    and asks all blocks of the lists it visits; blocks stream through one after the other."""
    sent = reps.sparkSession.sparkContext.broadcast(models)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for field, model in sent.value.items():
                at = np.flatnonzero(fields == field)
                if not len(at):
                    continue
                name, dense = ids[at], _dense(batch.column(2).take(pa.array(at)))
                own, who, visited = _visited(dense, model.centroids, least)
                codes = anisotropic_codes(dense - model.centroids[own], dense, model.codebooks)
                packed = (codes[:, ::2] | (codes[:, 1::2] << 4)).astype(np.uint8)
                home = model.slot[model.base[own] + (mix(name.view(_U)) % model.blocks[own].astype(_U)).astype(np.int64)]
                times = model.blocks[visited]
                who = np.repeat(who, times)
                asked = model.slot[np.repeat(model.base[visited], times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)]
                groups = len(model.slot) // GROUP + 1
                order = np.argsort(who * groups + asked // GROUP, kind="stable")
                who, asked = who[order], asked[order]
                first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (asked[1:] // GROUP != asked[:-1] // GROUP)])
                masks = np.bitwise_or.reduceat(1 << asked % GROUP, first)
                who, asked = who[first], asked[first]
                raw = batch.column(2).take(pa.array(at))
                side = np.repeat([0, 1], [len(home), len(asked)]).astype(np.int32)
                data = pa.concat_arrays([pa.array([x.tobytes() for x in packed], pa.binary()), raw.take(pa.array(who))])
                columns = [np.r_[home, asked] // GROUP * 2 + field, side, np.r_[name, name[who]], np.r_[1 << home % GROUP, masks].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), data], ["group", "side", "id", "mask", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, filed = None, None
        waiting: list[pa.RecordBatch] = []

        def decode() -> dict[int, tuple[np.ndarray, np.ndarray]]:
            """Ids and decoded rows of each filed block. The codes are looked up in the tables; a row's score is the sum of
            its looked-up parts against the query's, all of which one matrix product gives."""
            model = sent.value[group % 2]
            packed = np.frombuffer(b"".join(x for part in waiting for x in part.column(4).to_pylist()), np.uint8).reshape(-1, DIMENSIONS // PART // 2)
            ids, masks = (np.concatenate([x.column(k).to_numpy() for x in waiting]) for k in (2, 3))
            out = {}
            for mask in np.unique(masks):
                own, bit = np.flatnonzero(masks == mask), int(mask).bit_length() - 1
                codes = np.empty((len(own), DIMENSIONS // PART), np.uint8)
                codes[:, ::2], codes[:, 1::2] = packed[own] & 15, packed[own] >> 4
                values = np.concatenate([model.codebooks[m][codes[:, m]] for m in range(codes.shape[1])], 1)
                out[bit] = ids[own], (values + model.centroids[model.list_of[group // 2 * GROUP + bit]]).astype(np.float32)
            return out

        def found(a: np.ndarray | None, b: np.ndarray | None, bit: int | None) -> pa.RecordBatch:
            n = len(b if a is None else a)
            names = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (a, b)]
            at = pa.nulls(n, pa.int64()) if bit is None else pa.array(np.full(n, group * GROUP + bit))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, group % 2, np.int32)), *names, at], ["field", "a", "b", "block"])

        for batch in batches:
            key, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1]), True]) if len(key) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if key[s] != group:
                    group, filed, opened, waiting = int(key[s]), None, set(), []
                part = batch.slice(s, e - s)
                if side[s] == 0:
                    waiting.append(part)
                    continue
                if not waiting:
                    continue
                if filed is None:
                    filed = decode()
                for at in range(0, e - s, 1024):
                    chunk = part.slice(at, 1024)
                    queries, ids, masks = _dense(chunk.column(4)), chunk.column(2).to_numpy(), chunk.column(3).to_numpy()
                    for bit, (names, decoded) in filed.items():
                        own = np.flatnonzero(masks >> bit & 1)
                        if not len(own):
                            continue
                        asking = ids[own]
                        score = queries[own] @ decoded.T
                        score[asking[:, None] == names[None]] = -2
                        close = score >= least - slack
                        many = close.sum(1) > reranked
                        if many.any():
                            if bit not in opened:
                                yield found(None, names, bit)
                            opened.add(bit)
                            yield found(asking[many], None, bit)
                            close[many] = False
                        q, x = np.nonzero(close)
                        if len(q):
                            yield found(np.minimum(asking[q], names[x]), np.maximum(asking[q], names[x]), None)

    rows = spread(reps.select("field", "doc_id", "dense"), "doc_id").mapInArrow(assign, "group long, side int, id long, mask int, data binary")
    sorted_rows = rows.repartition("group").sortWithinPartitions("group", "side")
    return sorted_rows.mapInArrow(scan, "field int, a long, b long, block long").distinct()


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes, terms and values, as unit vectors, of a batch (block, side, id, terms, values)."""
    sizes = np.diff(batch.column(3).offsets.to_numpy())
    values = batch.column(4).flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    return batch.column(2).to_numpy(), sizes, batch.column(3).flatten().to_numpy(), values / np.repeat(np.sqrt(np.add.reduceat(values * values, starts)), sizes)


def _whole_blocks(asked: DataFrame, kept: DataFrame, k: int, least: float, digits: int) -> DataFrame:
    """``(field, a, b)``, a < b: of the ``asked`` blocks ``(field, block, side, id)`` the pairs of a filed row (side 0) and
    an asking one (side 1) that are among the ``k`` best of either there, by exact similarity and then smaller id, and
    reach ``least``. Blocks stream through; one block's filed rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filed, waiting = None, None, []
        for batch in batches:
            key, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1]), True]) if len(key) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if key[s] != block:
                    block, filed, waiting = int(key[s]), None, []
                if side[s] == 0:
                    waiting.append(_sparse(batch.slice(s, e - s)))
                    continue
                if filed is None:
                    filed, sizes, terms, values = (np.concatenate(x) for x in zip(*waiting, strict=True))
                    words, place = np.unique(terms, return_inverse=True)
                    starts, waiting = np.cumsum(sizes) - sizes, []
                    best = np.full((k, len(filed)), -1.0)  # of each filed row so far
                for at in range(s, e, 256):
                    asking, lengths, t, v = _sparse(batch.slice(at, min(256, e - at)))
                    score, end = np.empty((len(asking), len(filed))), np.cumsum(lengths)
                    for i, (a, b) in enumerate(zip(end - lengths, end, strict=True)):
                        weights, spot = np.zeros(len(words)), np.minimum(np.searchsorted(words, t[a:b]), len(words) - 1)
                        known = words[spot] == t[a:b]
                        weights[spot[known]] = v[a:b][known]
                        score[i] = np.add.reduceat(weights[place] * values, starts)
                    score = np.round(score, digits)
                    score[asking[:, None] == filed[None]] = -2
                    of_asking = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    of_filed = np.argsort(-score, axis=0, kind="stable")[:k]
                    top = np.take_along_axis(score, of_filed, 0)
                    chosen = np.zeros(score.shape, bool)
                    np.put_along_axis(chosen, of_filed, top > best[-1], 0)  # earlier ones have smaller ids
                    np.put_along_axis(chosen, of_asking, True, 1)
                    best = -np.sort(-np.concatenate([best, top]), axis=0)[:k]
                    q, x = np.nonzero(chosen & (score >= least))
                    columns = [np.full(len(q), block // GROUP % 2, np.int32), np.minimum(asking[q], filed[x]), np.maximum(asking[q], filed[x])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["field", "a", "b"])

    rows = asked.join(_of_field(kept, "id"), ["field", "id"]).select("block", "side", "id", "terms", "values")
    return rows.repartition("block").sortWithinPartitions("block", "side", "id").mapInArrow(run, "field int, a long, b long").distinct()


def _exact(pairs: DataFrame, kept: DataFrame, digits: int) -> DataFrame:
    """``(field, a, b, similarity)``: cosines in double precision. A pair of records that is a candidate by both fields is
    joined with their terms once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            wanted = batch.column(2).to_numpy()
            codes = np.unique(np.concatenate([batch.column(k).flatten().to_numpy() for k in (3, 6)]), return_inverse=True)[1].astype(np.int64)
            own = [np.repeat(np.arange(batch.num_rows), np.diff(batch.column(k).offsets.to_numpy())) for k in (3, 6)]
            left, right = own[0] << 32 | codes[: len(own[0])], own[1] << 32 | codes[len(own[0]) :]
            order = np.argsort(left)
            at = np.minimum(np.searchsorted(left[order], right), max(len(left) - 1, 0))
            shared = np.flatnonzero(left[order][at] == right) if len(left) else at[:0]
            at = order[at[shared]]
            for field in range(len(FIELDS)):
                x, y = (batch.column(k + field).flatten().to_numpy().astype(np.float64) for k in (4, 7))
                norm = np.sqrt(np.bincount(own[0], x * x, batch.num_rows) * np.bincount(own[1], y * y, batch.num_rows))
                dot = np.bincount(own[0][at], x[at] * y[shared], batch.num_rows)
                asked = np.flatnonzero((wanted >> field & 1).astype(bool) & (norm > 0))
                columns = [pa.array(np.full(len(asked), field, np.int32)), *(batch.column(k).take(pa.array(asked)) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.round(dot[asked] / norm[asked], digits))], ["field", "a", "b", "similarity"])

    x = kept.select(F.col("doc_id").alias("a"), F.col("terms").alias("t"), *(F.col(f).alias(f"t{k}") for k, f in enumerate(FIELDS)))
    y = kept.select(F.col("doc_id").alias("b"), F.col("terms").alias("u"), *(F.col(f).alias(f"u{k}") for k, f in enumerate(FIELDS)))
    asked = pairs.groupBy("a", "b").agg(F.bit_or(F.col("field") + 1).alias("fields"))
    rows = asked.join(x, "a").join(y, "b").select("a", "b", "fields", "t", "t0", "t1", "u", "u0", "u1")
    return rows.mapInArrow(run, "field int, a long, b long, similarity double")


def nearest(
    rows: DataFrame, scratch: Scratch, k: int = 5, least: float = 0.9, digits: int = 6, slack: float = SLACK, reranked: int = RERANKED
) -> DataFrame:
    """``(field, doc_id, other, similarity)``: of each vector of ``entries`` the ``k`` most similar others with a cosine of
    at least ``least``; equal similarities rank by smaller id.

    Every vector is indexed and asks. Equal vectors are folded first: a class of any size is one row of the index, and
    only its k + 1 smallest members can be anyone's neighbours. Index: signed feature hashing, k-means lists,
    residuals in 4-bit codes under a score-aware anisotropic loss; centroids and codebooks are fitted on at most
    ``SAMPLE`` rows. Scans estimate, the exact sparse vectors decide; a query that more than ``reranked`` of a block seem
    near to is compared exactly with all of that block. All-zero vectors have no
    neighbours, null and NaN values are 0, repeated rows count once, an empty table gives no rows, other columns are ignored. A
    neighbour is lost if neither of a pair lies in a list that the other visits, or its estimate is off by more than
    ``slack``.
    """
    spark = rows.sparkSession
    kept = scratch.keep(records(rows))
    all_rows = scratch.keep(vectors(kept))
    first = F.min_by("dense", "doc_id").alias("dense")
    classes = scratch.keep(all_rows.groupBy("field", "digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), first))
    reps = classes.select("field", F.col("id").alias("doc_id"), "dense")
    models = {}
    for field, n in reps.groupBy("field").count().collect():
        share = min(1.0, min(SAMPLE, max(SAMPLE_OF_LIST * n / LIST, SAMPLE_OF_CODES)) * 0.95 / n)
        chosen = reps.where((F.col("field") == field) & (F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000)))
        sample = _dense(chosen.select("dense").limit(SAMPLE).toArrow().column(0).combine_chunks())
        models[field] = fit(sample, n)
    if not models:
        return spark.createDataFrame([], "field string, doc_id long, other long, similarity double")
    scanned = scratch.keep(_candidates(reps, models, least, slack, reranked))
    pairs = scanned.where("block is null").select("field", "a", "b")
    wanted = scratch.keep(scanned.select(F.explode(F.array("a", "b")).alias("doc_id")).where("doc_id is not null").distinct())
    if wanted.count() <= MOST_IDS:  # fewer terms to shuffle; beyond it the filter would cost a shuffle of its own
        kept = kept.join(F.broadcast(wanted), "doc_id", "left_semi")
    asked = scanned.where("block is not null").select("field", "block", F.when(F.col("a").isNull(), 0).otherwise(1).alias("side"), F.coalesce("a", "b").alias("id"))
    if asked.limit(1).count():
        pairs = scratch.keep(pairs.unionByName(_whole_blocks(asked, kept, k, least, digits)).distinct())
    close = scratch.keep(_exact(pairs, kept, digits).where(F.col("similarity") >= least))
    both = close.unionByName(close.select("field", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    by_rank = Window.partitionBy("field", "a").orderBy(F.desc("similarity"), "b")
    links = both.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k).drop("r")
    equal = classes.where("n > 1").select("field", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    links = scratch.keep(links.unionByName(equal))
    used = small(scratch.keep(links.select("field", F.col("a").alias("id")).distinct()), MOST_IDS)
    members = scratch.keep(
        all_rows.select("field", "digest", "doc_id").join(classes.select("field", "digest", "id").join(used, ["field", "id"], "left_semi"), ["field", "digest"]).select("field", "id", "doc_id")
    )
    by_id = Window.partitionBy("field", "id").orderBy("doc_id")
    firsts = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select("field", F.col("id").alias("b"), F.col("doc_id").alias("other"))
    found = members.withColumnRenamed("id", "a").join(links, ["field", "a"]).join(firsts, ["field", "b"]).where("doc_id <> other")
    top = Window.partitionBy("field", "doc_id").orderBy(F.desc("similarity"), "other")
    ranked = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)
    names = F.array(*map(F.lit, FIELDS))
    return ranked.select(names[F.col("field")].alias("field"), "doc_id", "other", "similarity")
