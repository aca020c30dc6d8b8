"""Near-duplicate records with small edits (problem 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import process_lines
from lexmill.llm.bags import MOST_IDS
from lexmill.llm.components import components
from lexmill.llm.hashing import fold_copies, mix
from lexmill.sources.tables import Scratch, small

_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Record index and 64-bit hash of each distinct run of ``k`` words of each text, by record and hash."""
    split = [t.split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    words = np.fromiter((_hashes[w] for x in split for w in x), _U, int(sizes.sum()))
    record = np.repeat(np.arange(len(texts)), sizes)
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = np.zeros(n, _U)
    for j in range(k):
        h = mix(h + words[j : j + n] + _U(j + 1))
    inside = record[:n] == record[k - 1 :]
    record, h = record[:n][inside], h[inside]
    order = np.lexsort((h, record))
    record, h = record[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (record[1:] != record[:-1])
    return record[first], h[first]


def article_texts(articles: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, text, lines)``: of each article the processed text or, where that is null, the lines it is made of.
    Of repeated rows the newest hold; rows without either are left out."""
    at = F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp")).alias("_at")
    rows = articles.where("doc_id is not null and (processed_text is not null or text_lines is not null)").select("doc_id", "processed_text", "text_lines", at)
    repeated = scratch.keep(rows.groupBy("doc_id").agg(F.max("_at").alias("_newest"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    newest = rows.join(small(repeated, MOST_IDS), "doc_id", "left").where("_newest is null or _newest = _at")
    lines = F.when(F.col("processed_text").isNull(), F.col("text_lines"))
    return newest.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("processed_text").alias("text"), lines.alias("lines"))


def _batches(batches: Iterator[pa.RecordBatch], stop: frozenset[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for batch in batches:
        ids, texts, lines = (batch.column(i) for i in range(3))
        whole = [
            t if t is not None else process_lines(rest.as_py() or (), stop) for t, rest in zip(texts.to_pylist(), lines, strict=True)
        ]
        yield ids.to_numpy(zero_copy_only=False).astype(np.int64), whole


def shared_runs(texts: DataFrame, stop: frozenset[str], k: int, threshold: float, often: int = 16) -> DataFrame:
    """``(doc_id, size, tokens, counts)``: of each record that can have a partner at all the number of its runs and, sorted,
    those that occur in another record, too, with the number of records seen to hold them. Exact: the overlap of two sets with that similarity is at least the
    ``threshold``'s share of either, and an overlap consists of shared runs only.

    The one large shuffle sends each (run, record) to the run's place, sorted; there a single pass with constant
    memory tells runs of one record from shared ones, however many records share them. A run that ``often`` or more
    records of a batch hold is known to be shared where it is found: all but the first of these rows go to the
    record's place instead, so a run of a third of all records is no burden to one task.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, whole in _batches(batches, stop):
            record, h = shingle_sets(whole, k)
            sizes = np.bincount(record, minlength=len(ids))[record]
            _, first, at, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            h, hot = h.view(np.int64), (n[at] >= often) & (first[at] != np.arange(len(h)))
            # a known run's place is that of its record; its count, negative, tells it from the others
            place = np.where(hot, mix(ids[record].view(_U)).view(np.int64), h)
            columns = [place, ids[record], sizes.astype(np.int32), np.where(hot, -n[at], 0).astype(np.int32), np.where(hot, h, 0)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["place", "doc_id", "size", "known", "h"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (run, record, size, whether it was sent on) of the row before this batch
        for batch in batches:
            h, ids, size, known, run = (batch.column(i).to_numpy() for i in range(5))
            if (hot := known < 0).any():
                columns = [ids[hot], size[hot], run[hot], -known[hot]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc_id", "size", "h", "count"])
                h, ids, size = h[~hot], ids[~hot], size[~hot]
            if not len(h):
                continue
            sent = np.zeros(len(h), bool)
            if last is not None:
                h, ids, size, sent = (np.r_[x, y] for x, y in zip(last, (h, ids, size, sent), strict=True))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
            h, ids, size, sent = h[first], ids[first], size[first], sent[first]
            hit = np.zeros(len(h), bool)
            hit[1:] = h[1:] == h[:-1]
            hit[:-1] |= hit[1:].copy()
            new = hit & ~sent
            edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            count = np.repeat(np.diff(edges), np.diff(edges))
            count[edges[-2] :] = np.maximum(count[-1], 64)  # the run may go on; only costs depend on it
            last = (h[-1:], ids[-1:], size[-1:], (hit | sent)[-1:])
            yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(size[new]), pa.array(h[new]), pa.array(count[new].astype(np.int32))], ["doc_id", "size", "h", "count"])

    runs = texts.mapInArrow(emit, "place long, doc_id long, size int, known int, h long")
    parts = runs.repartition("place").sortWithinPartitions("place", "doc_id").mapInArrow(shared, "doc_id long, size int, h long, count int")
    sets = parts.groupBy("doc_id").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("h", "count"))).alias("runs"))
    runs = F.col("runs")  # a repeated row may have come both ways
    once = F.filter(runs, lambda x, i: (i == 0) | (x["h"] != F.coalesce(F.get(runs, i - 1)["h"], F.bitwise_not(x["h"]))))
    sets = sets.select("doc_id", "size", once.alias("runs"))
    able = sets.where(F.size("runs") >= F.ceil(F.col("size") * threshold - 1e-9))
    return able.select("doc_id", "size", F.col("runs.h").alias("tokens"), F.col("runs.count").alias("counts"))


class Partitions:
    """Universe partitioning by the pigeonhole principle, for a similarity of sets |x n y| / |x u y| >= ``threshold``.

    A set has n shared tokens of ``size`` in all; the others can only differ. Numbers n fall into bands. A band with up
    to U has ``segments(U)`` segments, into which hashes divide the tokens. With c = 2t / (1 + t) the shared tokens of a
    set and of one with at most U differ in at most n - c * size + (1 - c) * U; if a probe gives its segments
    allowances that sum up to more than that, some segment differs by less than its allowance. Allowance 1
    means equal segments, 2 means that they differ in at most one token, found in the one-deletion neighbourhoods.
    """

    def __init__(self, threshold: float, step: float = 1.25, per_token: float = 0.75):
        self.t, self.step, self.per_token = threshold, step, per_token

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(sizes, 1)) / math.log(self.step) + 1e-9).astype(np.int64)

    def largest(self, band: np.ndarray) -> np.ndarray:
        return np.maximum(np.ceil(self.step ** (band + 1.0) - 1e-9).astype(np.int64) - 1, 1)

    def segments(self, largest: np.ndarray) -> np.ndarray:
        differ = (1 - self.t) / self.t * largest
        return np.maximum(np.ceil(differ * self.per_token).astype(np.int64), 1)

    @staticmethod
    def _parts(record: np.ndarray, h: np.ndarray, count: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
        """Non-empty segments (record, segment, size, content, lowest and second lowest count of a token) and, for each
        token, its segment's index and its code."""
        segment = (mix(h ^ _U(0x5851F42D4C957F2D)) % m.astype(_U)[record]).astype(np.int64)
        order = np.lexsort((count, segment, record))
        record, segment, code, count = record[order], segment[order], mix(h[order]), count[order]
        start = np.ones(len(record), bool)
        start[1:] = (record[1:] != record[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(start)
        content = np.add.reduceat(code, at) if len(at) else code[:0]
        size = np.diff(np.r_[at, len(record)])
        second = count[np.minimum(at + 1, max(len(count) - 1, 0))]
        return record[at], segment[at], size, content, count[at], second, np.cumsum(start) - 1, code

    @staticmethod
    def _key(band: np.ndarray, segment: np.ndarray, kind: int, content: np.ndarray) -> np.ndarray:
        return mix(mix(band.astype(_U) * _U(1 << 32) + segment.astype(_U) * _U(2) + _U(kind)) ^ content)

    def index(self, record: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(record, key)`` under which a set is filed: its segments, and its segments with one token left out."""
        band = self.band(n)
        r, s, size, content, _, _, owner, code = self._parts(record, h, np.zeros(len(h), np.int64), self.segments(self.largest(band)))
        whole = self._key(band[r], s, 0, content)
        longer = size[owner] > 1
        o = owner[longer]
        less = self._key(band[r[o]], s[o], 1, content[o] - code[longer])
        return np.r_[r, r[o]], np.r_[whole, less]

    def probe(
        self, record: np.ndarray, h: np.ndarray, count: np.ndarray, n: np.ndarray, sizes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(record, key)`` that find every similar set with at most the record's number of shared tokens, and the
        records for which the allowances would have to be spent on empty segments, too.

        Cost decides on allowances. A segment equals at most as many others as its rarest token has records; with
        one token free it is as many as the second rarest has. The cheapest are taken; empty segments equal too many.
        """
        own, out_r, out_k, hard = self.band(n), [], [], np.zeros(len(n), bool)
        low = self.band(np.ceil(sizes * self.t - 1e-9).astype(np.int64))
        c = 2 * self.t / (1 + self.t)
        for back in range(int((own - low).max(initial=0)) + 1):
            band = own - back
            largest = np.minimum(self.largest(band), n)
            need = np.floor(n - c * sizes + (1 - c) * largest + 1e-9).astype(np.int64) + 1
            live = (band >= low) & (n > 0) & (need > 0)
            keep = live[record]
            r, s, size, content, rarest, second, owner, code = self._parts(record[keep], h[keep], count[keep], self.segments(self.largest(band)))
            if not len(r):
                continue
            longer = np.flatnonzero(size > 1)
            offered = np.r_[r, r[longer]]
            order = np.lexsort((np.r_[rarest, second[longer]], offered))
            first_of = np.searchsorted(offered[order], offered[order])
            rank = np.empty(len(offered), np.int64)
            rank[order] = np.arange(len(order)) - first_of
            hard |= live & (np.bincount(offered, minlength=len(n)) < need)
            taken = rank < need[offered]
            once, twice = np.zeros(len(r), bool), np.zeros(len(r), bool)
            once[:] = taken[: len(r)]
            twice[longer] = taken[len(r) :]
            once |= twice
            o = owner[twice[owner]]
            out_r += [r[once], r[twice], r[o]]
            out_k += [
                self._key(band[r[once]], s[once], 0, content[once]),
                self._key(band[r[twice]], s[twice], 1, content[twice]),
                self._key(band[r[o]], s[o], 0, content[o] - code[twice[owner]]),
            ]
        return np.concatenate(out_r or [record[:0]]), np.concatenate(out_k or [h[:0]]), hard


#: Rows of one key that are compared pair by pair at once; beyond it a key is large and meets by leaders first.
LARGE_KEY = 400
#: Longs of a set's bitmap.
WORDS = 8
INDEX, PROBE, HARD = 0, 1, 2
_LOW = (1 << 30) - 1
PAIR, MORE = 3, 4
_meeting = "kind int, key long, id long, n int, size int, other long"


def _keys(sets: DataFrame, partitions: Partitions) -> DataFrame:
    """``(key, packed, id)``: the keys under which each set is filed and those that it asks for; ``packed`` holds the kind,
    the number of shared tokens and that of all, in this order, and so sorts by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):  # bounds the memory
            ids, sizes, runs = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            n = np.diff(runs.offsets.to_numpy()).astype(np.int64)
            h, record = runs.flatten().to_numpy().view(_U), np.repeat(np.arange(len(ids)), n)
            filed, asked = partitions.index(record, h, n), partitions.probe(record, h, batch.column(3).flatten().to_numpy(), n, sizes)
            hard = np.flatnonzero(asked[2])
            r = np.r_[filed[0], asked[0], hard]
            kind = np.repeat([INDEX, PROBE, HARD], [len(filed[0]), len(asked[0]), len(hard)])
            key = np.r_[filed[1], asked[1], mix(ids[hard].view(_U))].view(np.int64)
            packed = (kind.astype(np.int64) << 60) | (n[r] << 30) | sizes[r]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, packed, ids[r])], ["key", "packed", "id"])

    return sets.select("id", "size", "tokens", "counts").mapInArrow(run, "key long, packed long, id long")


def _meet(keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(PAIR, key, probe, ..., other)`` of the keys' small groups; of large groups the pairs with the leader and
    all rows as ``MORE``, the side in ``other``; ``HARD`` rows as they are. One shuffle by key; sorted groups stream
    through, of which at most ``LARGE_KEY`` rows are held."""

    def fits(p: np.ndarray, i: np.ndarray, ids: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
        smaller = (n[i] < n[p]) | ((n[i] == n[p]) & (ids[i] < ids[p]))
        return smaller & (n[i] >= threshold * size[p] - 1e-9) & (n[p] >= threshold * size[i] - 1e-9)

    def batch_of(kind, key, ids, n, size, other) -> pa.RecordBatch:
        columns = [np.broadcast_to(np.int32(kind), len(ids)) if np.isscalar(kind) else kind.astype(np.int32), key, ids, n.astype(np.int32), size.astype(np.int32), other.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["kind", "key", "id", "n", "size", "other"])

    def all_of(rows: list[np.ndarray]) -> pa.RecordBatch:
        kind, key, ids, n, size = rows
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        filed = np.bincount(group, kind == INDEX, minlength=len(edges)).astype(np.int64)
        p = np.flatnonzero(kind == PROBE)
        count = filed[group[p]]
        a = np.repeat(p, count)
        b = np.repeat(edges[group[p]], count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        ok = fits(a, b, ids, n, size)
        a, b = a[ok], b[ok]
        zero = np.zeros(len(a), np.int64)  # columns that a pair has no use for
        return batch_of(PAIR, zero, ids[a], zero, zero, ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.int64)]
        large, leader = None, None
        for batch in batches:
            new_key, packed, new_ids = (batch.column(i).to_numpy() for i in range(3))
            fresh = ((packed >> 60).astype(np.int32), new_key, new_ids, packed >> 30 & _LOW, packed & _LOW)
            rows = [np.r_[x, y] for x, y in zip(held, fresh, strict=True)]
            kind, key = rows[0], rows[1]
            if not len(key):
                continue
            start = np.r_[True, key[1:] != key[:-1]]
            edges = np.flatnonzero(np.r_[start, True])
            length = np.repeat(np.diff(edges), np.diff(edges))
            still_open = np.arange(len(key)) >= edges[-2]
            big = (length > LARGE_KEY) | (key == large if large is not None else False)
            special = kind == HARD
            if special.any():
                yield batch_of(HARD, *(x[special] for x in rows[1:]), rows[2][special])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s <= LARGE_KEY and not big[s]:
                    continue
                part = [x[s:e] for x in rows]
                if part[1][0] != large:
                    large, leader = part[1][0], [x[:1] for x in part] if part[0][0] == INDEX else None
                if leader is None:
                    continue  # nothing is filed under the key
                yield batch_of(MORE, *part[1:], part[0])
                p = np.flatnonzero(part[0] == PROBE) + 1
                joined = [np.r_[x, y] for x, y in zip(leader, part, strict=True)]
                p = p[fits(p, np.zeros(len(p), np.int64), *joined[2:])]
                yield batch_of(PAIR, *(x[p] for x in joined[1:]), np.repeat(joined[2][:1], len(p)))
            done = ~big & ~still_open & ~special
            if done.any():
                yield all_of([x[done] for x in rows])
            keep = ~big & still_open & ~special
            held = [x[keep] for x in rows]
        if len(held[1]):
            yield all_of(held)

    rows = keys.repartition("key").sortWithinPartitions("key", "packed", "id")
    return rows.mapInArrow(run, _meeting)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, compared in full. Tokens are fetched only for pairs whose bitmaps leave
    it open: sets differ in at least as many tokens as their bitmaps do in bits, which bounds the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset = batch.column(2).offsets.to_numpy().astype(np.int64)
            h = mix(batch.column(2).flatten().to_numpy().view(_U) ^ _U(0x2545F4914F6CDD1D))
            bits = np.zeros((batch.num_rows, 64 * WORDS), np.uint8)
            bits[np.repeat(np.arange(batch.num_rows), np.diff(offset)), (h % _U(64 * WORDS)).astype(np.int64)] = 1
            words = np.packbits(bits, axis=1).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(offset).astype(np.int32)), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "shared", *(f"w{i}" for i in range(WORDS))])

    shape = "id long, size int, shared int, " + ", ".join(f"w{i} long" for i in range(WORDS))
    maps = scratch.keep(sets.select("id", "size", "tokens").mapInArrow(run, shape))
    one, other = (maps.select(*(F.col(c).alias(s + ("" if c == "id" else c)) for c in maps.columns)) for s in "ab")
    differ = sum((F.bit_count(F.col(f"aw{i}").bitwiseXOR(F.col(f"bw{i}"))) for i in range(WORDS)), F.lit(0))
    most = F.least(F.floor((F.col("ashared") + F.col("bshared") - differ) / 2), F.col("ashared"), F.col("bshared"))
    open_ = pairs.join(one, "a").join(other, "b").where(most >= threshold * (F.col("asize") + F.col("bsize") - most) - 1e-9)
    pairs = scratch.keep(open_.select("a", "b"))
    a = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"), F.col("size").alias("n"))
    b = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"), F.col("size").alias("m"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(a, "a").join(b, "b").withColumn("both", both)
    return found.where(F.col("both") >= threshold * (F.col("n") + F.col("m") - F.col("both")) - 1e-9).select("a", "b")


def near_duplicates(texts: DataFrame, scratch: Scratch, stop: frozenset[str] = frozenset(), k: int = 3, threshold: float = 0.5) -> DataFrame:
    """``(group_id, doc_id)``: groups of records linked, directly or through others, by sets of runs of ``k`` words
    with a similarity of ``threshold`` or more; ``group_id`` is the smallest id, no group has one member.

    ``texts`` is ``article_texts``. Records of fewer than ``k`` words have no runs and no group; empty tables give no
    rows. Copies are folded into their smallest id first, so a group of equal records of any size is one set. Keys
    with few sets meet pair by pair. A key of many sets meets in two rounds: all with one leader, which links large
    families in linear time, then all pairs of different components. No link between different
    sets is lost, and none is looked for twice within a family.
    """
    sets, members = fold_copies(shared_runs(texts, stop, k, threshold), scratch, F.size("tokens") == F.col("size"))
    met = scratch.keep(_meet(_keys(sets, Partitions(threshold)), threshold))
    pairs = met.where(F.col("kind") == PAIR).select(F.col("id").alias("a"), F.col("other").alias("b"))
    links = scratch.keep(_verified(pairs.distinct(), sets, threshold, scratch))
    linked = scratch.keep(components(links, scratch))
    kinds = {r.kind for r in met.where(F.col("kind") != PAIR).select("kind").distinct().collect()}
    rest = None
    if MORE in kinds:
        rows = met.where(F.col("kind") == MORE).join(small(linked, MOST_IDS), "id", "left").withColumn("component", F.coalesce("component", "id"))
        asked = rows.where(F.col("other") == PROBE).select("key", F.col("id").alias("a"), F.col("n").alias("m"), F.col("component").alias("c"))
        filed = rows.where(F.col("other") == INDEX).select("key", F.col("id").alias("b"), "n", "component")
        mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        ordered = F.struct("n", "b") < F.struct(F.col("m").alias("n"), F.col("a").alias("b"))
        rest = asked.join(mixed, "key", "left_semi").join(filed, "key").where((F.col("c") != F.col("component")) & ordered).select("a", "b")
    if HARD in kinds:  # of these so many of the rarest runs that a partner must have one of them meet all sets' runs
        hard = met.where(F.col("kind") == HARD).select("id").distinct()
        runs = F.transform(F.sort_array(F.arrays_zip("counts", "tokens")), lambda x: x["tokens"])
        prefix = F.slice(runs, 1, F.greatest(F.size("tokens") - F.ceil(F.col("size") * threshold - 1e-9) + 1, F.lit(1)).cast("int"))
        asked = sets.join(hard, "id", "left_semi").select(F.explode(prefix).alias("h"), F.col("id").alias("a"), F.size("tokens").alias("m"))
        filed = sets.select(F.explode("tokens").alias("h"), F.col("id").alias("b"), F.size("tokens").alias("n"))
        more = asked.join(filed, "h").where("n < m or (n = m and b < a)").select("a", "b")
        rest = more if rest is None else rest.unionByName(more)
    if rest is not None:
        linked = components(links.unionByName(_verified(rest.distinct(), sets, threshold, scratch)), scratch)
    placed = members.join(linked, "id", "left").select("doc_id", F.coalesce("component", "id").alias("group_id"))
    sizes = placed.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    return placed.join(sizes, "group_id").select("group_id", "doc_id")
