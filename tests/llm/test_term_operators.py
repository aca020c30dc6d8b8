"""Bags, frequencies, distinctive terms, similar sets and near-duplicates against brute force."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import is_term_word
from lexmill.llm import distinctive, frequency, near_dup, set_join
from lexmill.llm.bags import term_bags, term_sets
from lexmill.llm.components import components
from lexmill.llm.hashing import fold_copies
from lexmill.sources.tables import Scratch

POSTINGS = "term string, doc_id long, tf long, indexed_at timestamp, token string, size int"
ARTICLES = "doc_id long, path string, text_lines array<string>, processed_text string, processed_words array<string>, ingested_at timestamp, n int, h long"


def articles_of(spark, rows):
    return spark.createDataFrame([(i, "p", lines, text, words, None, 1, 2) for i, lines, text, words in rows], ARTICLES)


def postings_of(spark, rows):
    return spark.createDataFrame([(t, d, n, None, "x", 3) for t, d, n in rows], POSTINGS)


@pytest.fixture(scope="module")
def tables(spark):
    postings = [("oil", 1, 2), ("oil", 1, 2), ("gas", 1, None), ("12", 1, 5), ("ab", 1, 5), (None, 1, 1), ("wheat", 2, 1), ("oil", 2, 1), ("1980", 5, 1), ("oil", None, 1)]
    articles = [(1, None, None, ["never"]), (3, None, None, ["corn", "corn", "oil", "77", "a"]), (3, None, None, ["corn", "corn", "oil", "77", "a"]), (4, None, None, []), (6, None, None, None), (5, None, None, ["late"])]
    return postings_of(spark, postings), articles_of(spark, articles)


BAGS = {1: {"oil": 2, "gas": 1}, 2: {"wheat": 1, "oil": 1}, 3: {"corn": 2, "oil": 1}, 5: {"late": 1}}


def test_bags(tables, scratch):
    bags = term_bags(*tables, scratch)
    assert bags.n == 4
    got = defaultdict(dict)
    for r in bags.rows.collect():
        got[r.doc_id][r.term] = r.tf
    assert got == BAGS
    sets = {r.doc_id: len(r.tokens) for r in term_sets(*tables, scratch).collect()}
    assert sets == {k: len(v) for k, v in BAGS.items()}


def test_empty_tables(spark, scratch):
    empty = postings_of(spark, []), articles_of(spark, [])
    bags = term_bags(*empty, scratch, keep=True)
    assert bags.n == 0 and frequency.term_frequencies(bags.rows).count() == 0
    for model in ("geometric", "document"):
        assert distinctive.distinctive_terms(bags, scratch, model, top=3).count() == 0
    sets, members = fold_copies(term_sets(*empty, scratch), scratch)
    assert set_join.all_pairs(set_join.similar_sets(sets, scratch), members, scratch).count() == 0
    assert near_dup.near_duplicates(near_dup.article_texts(empty[1], scratch), scratch).count() == 0


def test_frequencies(tables, scratch):
    bags = term_bags(*tables, scratch)
    got = {r.term: (r.occurrences, r.records) for r in frequency.term_frequencies(bags.rows).collect()}
    assert got == {"oil": (4, 3), "gas": (1, 1), "wheat": (1, 1), "corn": (2, 1), "late": (1, 1)}
    marks = frequency.term_frequencies(bags.rows).select("term", frequency.mark(F.col("records"), bags.n).alias("m"))
    assert {r.term: r.m for r in marks.collect()} == {"oil": "common", "gas": "rare", "wheat": "rare", "corn": "rare", "late": "rare"}


def test_distinctive(tables, scratch):
    bags = term_bags(*tables, scratch, keep=True)
    df = Counter(t for b in BAGS.values() for t in b)
    tf = Counter({t: sum(b.get(t, 0) for b in BAGS.values()) for t in df})
    got = {(r.doc_id, r.term): r.score for r in distinctive.distinctive_terms(bags, scratch, "document", "none", "none").collect()}
    assert got == {(d, t): pytest.approx(n * math.log10(4 / df[t])) for d, b in BAGS.items() for t, n in b.items()}
    mean = sum(sum(b.values()) for b in BAGS.values()) / 4
    for r in distinctive.distinctive_terms(bags, scratch).collect():
        f, rate = BAGS[r.doc_id][r.term] * math.log2(1 + mean / sum(BAGS[r.doc_id].values())), tf[r.term] / 4
        assert r.score == pytest.approx((math.log2(1 + rate) - f * math.log2(rate / (1 + rate))) / (f + 1))
    ties = distinctive.distinctive_terms(bags, scratch, "document", "none", "none", top=1).collect()
    assert {(r.doc_id, r.term) for r in ties} == {(1, "gas"), (2, "wheat"), (3, "corn"), (5, "late")}


def families(seed, count, vocabulary=400, size=40):
    """Sets of words: families of edited copies, exact copies and unrelated ones."""
    rng = random.Random(seed)
    words = [f"word{i:04d}" for i in range(vocabulary)]
    rows = {}
    for k in range(count):
        base = rng.sample(words, rng.randint(5, size))
        for j in range(rng.choice([1, 1, 2, 5])):
            own = set(base)
            for _ in range(rng.randint(0, 8) if j else 0):
                own ^= {rng.choice(words)}
            rows[k * 10 + j + 1] = sorted(own)
    return rows


def brute_pairs(rows, threshold):
    ids = sorted(rows)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = set(rows[a]), set(rows[b])
            if s | t and len(s & t) >= threshold * len(s | t):
                out.add((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets(spark, scratch, seed):
    rows = families(seed, 120)
    rows[5000] = rows[5001] = ["titl", "only"]
    postings = postings_of(spark, [(t, d, 1) for d, ts in rows.items() if d % 2 for t in ts])
    articles = articles_of(spark, [(d, None, None, ts) for d, ts in rows.items() if not d % 2])
    sets, members = fold_copies(term_sets(postings, articles, scratch), scratch)
    got = {tuple(r) for r in set_join.all_pairs(set_join.similar_sets(sets, scratch), members, scratch).collect()}
    expected = brute_pairs(rows, 0.7)
    assert got <= expected and len(got) >= 0.98 * len(expected)
    exact = set_join.similar_sets(sets, scratch, exact=True)
    assert {tuple(r) for r in set_join.all_pairs(exact, members, scratch).collect()} == expected


def test_similar_sets_in_one_large_family(spark, scratch):
    """All sets are near-copies of one, so nodes cannot be split: nothing is lost."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    rows = {i: sorted(set(base) ^ {rng.choice(base), f"x{i}"}) for i in range(120)}
    sets = spark.createDataFrame([(i, [hash(t) for t in ts]) for i, ts in rows.items()], "id long, tokens array<long>")
    got = {tuple(r) for r in set_join.similar_sets(scratch.keep(sets), scratch).collect()}
    assert got == brute_pairs(rows, 0.7)


def test_similar_sets_that_hold_one_another(spark, scratch):
    """Sets of 100 tokens and shortened ones of 70 at the threshold, in a family whose nodes are large."""
    rng = random.Random(4)
    rows, expected = {i: [f"u{i}_{j}" for j in range(12)] for i in range(3000, 5600)}, set()
    for i in range(1, 401):
        rows[i] = [f"base{j}" for j in range(60)] + [f"own{i}_{j}" for j in range(40)]
        if i <= 150:
            rows[1000 + i] = sorted(rng.sample(rows[i], 70))
            expected.add((i, 1000 + i))
    frame = spark.createDataFrame([(i, ts) for i, ts in rows.items()], "id long, terms array<string>")
    sets = scratch.keep(frame.select("id", F.sort_array(F.transform("terms", lambda t: F.xxhash64(t))).alias("tokens")))
    got = {tuple(r) for r in set_join.similar_sets(sets, scratch).collect()}
    assert got <= expected and len(got) >= 0.98 * len(expected)


def test_nodes_are_lossless(spark):
    """Runs of any length across batches: every pair of a small node, every record of a large one."""
    rng = random.Random(5)
    rows = [(rng.randint(1, 60), i, -1, 5) for i in range(1, 700)] + [(99, i, 0, 5) for i in range(1000, 1200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = set_join._nodes(spark.createDataFrame(rows, "path long, id long, s1 long, s2 long"), 128).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    by = defaultdict(list)
    for p, i, *_ in rows:
        by[p].append(i)
    pairs = {(a, b) for v in by.values() if len(v) <= set_join.SMALL_NODE for a in v for b in v if a < b}
    assert {(r.a, r.b) for r in got if r.b is not None} == pairs
    large = {(r.path, r.a) for r in got if r.b is None}
    assert large == {(p, i) for p, v in by.items() if len(v) > set_join.SMALL_NODE for i in v}


@pytest.mark.parametrize("small_node", [3, 24])
def test_large_nodes_in_salted_blocks(spark, scratch, small_node):
    """Nodes that are too large for a task lose nothing."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    rows = {i: sorted(set(base) ^ {rng.choice(base), f"x{i}"}) for i in range(60)}
    sets = spark.createDataFrame([(i, [hash(t) for t in ts]) for i, ts in rows.items()], "id long, tokens array<long>")
    got = {tuple(r) for r in set_join.similar_sets(scratch.keep(sets), scratch, small_node=small_node).collect()}
    assert got == brute_pairs(rows, 0.7)


def test_trees_grow_with_the_depth():
    assert set_join.trees_for(5) == 20 < set_join.trees_for(6) < set_join.trees_for(9) < set_join.trees_for(18)


def brute_groups(texts, k, threshold):
    sets = {i: {tuple(t.split()[j : j + k]) for j in range(len(t.split()) - k + 1)} for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    size = Counter(root(i) for i in sets)
    return {(root(i), i) for i in sets if size[root(i)] > 1}


def edited(seed, count, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for k in range(count):
        base = rng.choices(vocabulary, k=rng.randint(1, words))
        for j in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(rng.randint(0, 6) if j else 0):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            texts[k * 10 + j + 1] = " ".join(own)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates(spark, scratch, seed):
    texts = edited(seed, 150)
    rows = [(i, None, t, None) for i, t in texts.items()]
    rows += rows[:20] + [(90000, None, None, None), (90001, None, "", None), (90002, None, "two words", None), (90003, None, "two words", None), (None, None, "a b c d", None)]
    got = {tuple(r) for r in near_dup.near_duplicates(near_dup.article_texts(articles_of(spark, rows), scratch), scratch).collect()}
    assert got == brute_groups(texts, 3, 0.5)


def test_near_duplicates_of_a_large_family(spark, scratch, monkeypatch):
    """Keys that many sets share go by leaders first and by components then."""
    monkeypatch.setattr(near_dup, "LARGE_KEY", 6)
    base = " ".join(f"b{i}" for i in range(60))
    texts = {i: f"x{i} {base} y{i}" for i in range(1, 60)} | {100 + i: f"{base} {base.replace('b', 'c')} z{i}" for i in range(40)} | {i: base for i in range(200, 240)}
    rows = articles_of(spark, [(i, None, t, None) for i, t in texts.items()])
    got = {tuple(r) for r in near_dup.near_duplicates(near_dup.article_texts(rows, scratch), scratch).collect()}
    assert got == brute_groups(texts, 3, 0.5)


def test_run_in_half_of_all_records(spark, scratch):
    """Rows of a hot run go to their records' places, the groups are those of brute force; repeated rows change nothing."""
    texts = edited(7, 60) | {9000 + i: "a b c d e f " + " ".join(f"own{i}x{j}" for j in range(3 if i % 3 else 9)) for i in range(90)}
    rows = [(i, None, t, None) for i, t in texts.items()]
    frame = near_dup.article_texts(articles_of(spark, rows + rows[-40:]), scratch)
    parts = near_dup.shared_runs(frame.coalesce(1), frozenset(), 3, 0.1, often=4)
    for r in parts.collect():
        assert len(set(r.tokens)) == len(r.tokens) == len(r.counts)
    got = {tuple(r) for r in near_dup.near_duplicates(frame, scratch).collect()}
    assert got == brute_groups(texts, 3, 0.5)


def test_article_texts(spark, scratch):
    from datetime import datetime

    rows = [(1, "p", ["Oil rose"], None, None, None, 1, 2), (1, "p", ["Oil rose"], "newer text", None, datetime(2021, 1, 1), 1, 2), (2, "p", ["The oil", None], None, None, None, 1, 2)]
    texts = near_dup.article_texts(spark.createDataFrame(rows, ARTICLES), scratch)
    assert sorted((r.doc_id, r.text, r.lines) for r in texts.collect()) == [(1, "newer text", None), (2, None, ["The oil", None])]


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_partitions_find_every_similar_pair(t):
    rng = np.random.default_rng(4)
    partitions = near_dup.Partitions(t)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = rng.choice(2**60, n, replace=False).astype(np.uint64)
        drop = int(rng.integers(0, n))
        b = np.concatenate([a[drop:], rng.choice(2**60, int(rng.integers(0, n)), replace=False).astype(np.uint64)])
        if len(b) > len(a):
            a, b = b, a
        if not len(b) or len(np.intersect1d(a, b)) < t * len(np.union1d(a, b)):
            continue
        count = rng.integers(2, 50, len(a))
        zero = lambda x: np.zeros(len(x), np.int64)
        filed = set(partitions.index(zero(b), b, np.array([len(b)]))[1].tolist())
        _, keys, hard = partitions.probe(zero(a), a, count, np.array([len(a)]), np.array([len(a)]))
        assert hard[0] or filed & set(keys.tolist())


def test_components(spark, scratch):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(7, 7), (200, 300), (300, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_term_words():
    assert is_term_word("abc") and not is_term_word("ab")


def test_shuffle_files_go_when_a_table_is_written(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    scratch, before = Scratch(spark, sweep=True), files()
    kept = scratch.keep(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        left = {x for x in files() - before if x.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_bitmaps_lose_no_similar_pair(spark, scratch):
    rng = random.Random(4)
    base = [rng.sample(range(400), 60) for _ in range(6)]
    sets = {i: sorted({*rng.sample(base[i % 6], rng.randint(20, 60)), *rng.sample(range(400, 900), rng.randint(0, 30))}) for i in range(60)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    rows = spark.createDataFrame([(i, len(x), x) for i, x in sets.items()], "id long, size int, tokens array<long>")
    got = near_dup._verified(spark.createDataFrame(pairs, "a long, b long"), rows, 0.5, scratch)
    alike = {(a, b) for a, b in pairs if 2 * len({*sets[a]} & {*sets[b]}) >= len({*sets[a]} | {*sets[b]})}
    assert {(r.a, r.b) for r in got.collect()} == alike and 20 < len(alike) < len(pairs)
    assert spark.read.parquet(f"{scratch.root}/{scratch.used}").count() < len(pairs) / 2
