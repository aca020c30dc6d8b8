"""Evaluation texts that leak into training text (problem 9)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of test items per automaton. More items are split into several automata, each its own pass.
MOST_CHARACTERS = 20_000_000
_word = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return _word.findall(text.lower())


class ItemAutomaton:
    """Generalised suffix automaton of word sequences. Every state stands for a set of runs of words that occur at
    the same places of the items; its suffix link leads to the longest shorter run that occurs at more places."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.ids: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, text in items:
            sequence = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            if len(sequence) >= least:
                sequences.append((item, sequence))
        for _, sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        self.anchor = [self._anchor(s) for s in range(len(self.link))]
        self.items: dict[int, set[int]] = {}
        for item, sequence in sequences:
            state = 0
            for at, symbol in enumerate(sequence):
                state = self.step[state][symbol]
                if at + 1 >= least:
                    self.items.setdefault(self.anchor[state], set()).add(item)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The target of ``symbol`` from ``state`` as a state whose longest run comes through ``state``."""
        target = self.step[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.step[last]:
            return self._split(last, symbol)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and symbol not in self.step[state]:
            self.step[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol)
        return new

    def _anchor(self, state: int) -> int:
        """Of the state and its suffixes the one whose runs include one of exactly ``least`` words, or -1."""
        if self.length[state] < self.least:
            return -1
        while self.length[self.link[state]] >= self.least:
            state = self.link[state]
        return state

    def match(self, ids: list[int | None]) -> list[tuple[int, int, int]]:
        """``(item, first word, end word)`` of the runs of at least ``least`` words that an item has too; runs of one
        item that overlap come as one."""
        found: dict[int, list[list[int]]] = {}
        state = length = 0
        for at, symbol in enumerate(ids):
            step = self.step[state].get(symbol)
            while step is None and state:
                state = self.link[state]
                length = self.length[state]
                step = self.step[state].get(symbol)
            if step is None:
                continue
            state, length = step, length + 1
            if length >= self.least:
                # the suffix of ``least`` words may belong to items that the longer run does not
                anchor = self.anchor[state]
                for item in self.items[anchor]:
                    runs = found.setdefault(item, [])
                    start = at + 1 - self.least
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = at + 1
                    else:
                        runs.append([start, at + 1])
        return [(item, *run) for item, runs in found.items() for run in runs]


_automata: dict[str, ItemAutomaton] = {}


def _automaton(items: list[tuple[int, str]], least: int) -> ItemAutomaton:
    key = hashlib.md5(repr((items, least)).encode()).hexdigest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = ItemAutomaton(items, least)
    return _automata[key]


def find_spans(automaton: ItemAutomaton, text: str) -> list[tuple[int, int, int]]:
    """``(item, first word, end word)`` for one text. Only stretches of words that all occur in the items can match;
    the rest is skipped."""
    known = automaton.ids
    sequence = words(text)
    mask = bytes(map(known.__contains__, sequence))
    out = []
    for run in re.finditer(b"\x01{%d,}" % automaton.least, mask):
        start, end = run.span()
        out += [(item, a + start, b + start) for item, a, b in automaton.match([known[w] for w in sequence[start:end]])]
    return out


def without_spans(text: str, spans: list[tuple[int, int]], most_covered: float) -> str | None:
    """The text without the spans of words; null if they cover more than ``most_covered`` of its words. Words are those of
    the lower-cased text; each of its characters is known by the one that it came from, as lower-casing can make several
    of one, and so the rest of the text stays as it is."""
    source = [i for i, c in enumerate(text) for _ in c.lower()]
    places = [(source[m.start()], source[m.end() - 1] + 1) for m in _word.finditer(text.lower())]
    covered = set()
    for a, b in spans:
        covered.update(range(a, b))
    if len(covered) > most_covered * len(places):
        return None
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    at, out = 0, []
    for a, b in merged:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def leaks(documents: DataFrame, items: DataFrame, least: int = 13, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """``(doc_id, item_id, first_word, end_word)``: each run of at least ``least`` consecutive words (spans overlapping
    within one item are joined) that a document's text shares with an item.

    Null texts and ids match nothing, items of fewer words neither, empty tables give no rows; repeated documents
    give repeated rows; other columns are ignored. Items are a small held-out set: a sum on the cluster proves the
    size before they are sent to the executors, and what exceeds ``most_characters`` goes into further automata by
    a hash of the id, each with its own pass over the documents. Documents are streamed without a shuffle.
    """
    from pyspark.sql import functions as F

    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = size // most_characters + 1
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part.distinct().toLocalIterator()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value, least)
            for batch in batches:
                found = [
                    (key, *span)
                    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for span in find_spans(automaton, text.as_py())
                ]
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "first_word", "end_word"])

        found = rows.mapInArrow(run, "doc_id long, item_id long, first_word int, end_word int")
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, found: DataFrame, most_covered: float = 0.5) -> DataFrame:
    """``(doc_id, items, text)`` of the documents that hold leaks: the items concerned and the text without the
    leaked spans, null where they cover more than ``most_covered`` of its words and the document should go."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: without_spans(t, [(x["first_word"], x["end_word"]) for x in s], most_covered))

    spans = found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.collect_set(F.struct("first_word", "end_word")).alias("spans")
    )
    return documents.select("doc_id", "text").where("text is not null").join(spans, "doc_id").select("doc_id", "items", cut("text", "spans").alias("text"))
