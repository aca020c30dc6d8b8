"""Queries over small tables."""

import datetime
import os

import pytest

from lexmill.operators import cluster
from lexmill.plans import queries

SF = "/root/testdata/sf0.001"
ARTICLES = "doc_id long, text_lines array<string>, processed_text string, ingested_at timestamp"


def day(n):
    return datetime.datetime(2020, 1, n)


def test_process_articles(spark, tmp_path):
    rows = [
        (1, ["Oil prices"], None, day(1)),  # not processed yet
        (2, ["Old corn"], "old", day(1)), (2, ["New wheat", None], "new", day(3)), (2, ["Mid gas"], None, day(2)), (2, ["Undated"], "x", None),
        (3, None, "stored", day(1)),
        (4, None, None, day(2)), (4, ["Last lines"], None, None),
    ]
    spark.createDataFrame(rows, ARTICLES).write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([("new",)], "word string").write.parquet(f"{tmp_path}/stop_words.parquet")
    got = {r.doc_id: r.processed for r in queries.process_articles(spark, str(tmp_path)).collect()}
    assert got == {1: "oil price \n", 2: "wheat \n\n", 4: "last line \n"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_process_articles_as_stored(spark):
    """All articles with text lines; where a text is stored, the same."""
    stored, ids = {}, set()
    for r in spark.read.parquet(f"{SF}/articles.parquet").where("text_lines is not null").collect():
        ids.add(r.doc_id)
        if r.processed_text is not None:
            stored.setdefault(r.doc_id, set()).add(r.processed_text)
    got = {r.doc_id: r.processed for r in queries.process_articles(spark, SF).collect()}
    assert set(got) == ids and stored and all(got[d] in texts for d, texts in stored.items())


def settled(texts, k):
    """k-means by largest dot product of binary vectors over their sizes until nothing changes: clusters and rounds."""
    vectors = {d: {w: 1 / len(set(t.split())) for w in set(t.split())} for d, t in texts.items()}
    means, was, rounds = {c: vectors[d] for c, d in enumerate(sorted(texts)[:k])}, None, 0
    while True:
        rounds += 1
        score = lambda v, c: round(sum(x * means[c].get(w, 0) for w, x in v.items()), 12)
        now = {d: max(means, key=lambda c: (score(v, c), -c)) for d, v in vectors.items()}
        if now == was:
            return now, rounds
        was = now
        for c in set(now.values()):
            own = [vectors[d] for d in now if now[d] == c]
            means[c] = {w: sum(v.get(w, 0) for v in own) / len(own) for w in set().union(*own)}


def test_kmeans_until_nothing_changes(spark, scratch, tmp_path):
    """More rounds than ten; fewer than are needed are an error."""
    texts = {i: " ".join(f"word{k}" for k in range(i, i + 5)) for i in range(60)}  # a chain, its seeds all at one end
    expected, rounds = settled(texts, 10)
    assert rounds > 12
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.cluster for r in queries.kmeans_clusters(spark, str(tmp_path)).collect()} == expected
    docs = queries._docs(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        cluster.k_means(queries._vectors(spark, str(tmp_path)), docs, scratch, most_rounds=3)
