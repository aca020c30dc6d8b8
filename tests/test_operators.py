import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import cluster, index, pairs, vector_model as vsm
from lexmill.plans import queries
from lexmill.sources import index_files, sgml
from lexmill.sources.tables import without_hot_repeats
from lexmill.streaming.ingest import stream_postings

TEXTS = {1: "oil prices rose oil", 2: "wheat prices fell", 3: "oil and wheat and gas", 4: "", 5: None, 6: "gas gas gas pipeline"}
DOCS = "doc_id long, text string, term string, tf int"  # clashing columns


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, v, "x", 9) for k, v in TEXTS.items()], DOCS)


def bags():
    return {k: [w for w in (v or "").split() if text.is_term_word(w)] for k, v in TEXTS.items()}


def test_postings(docs):
    got = {(r.doc_id, r.term): r.tf for r in index.postings(docs).collect()}
    assert got == {(d, t): 1 for d, b in bags().items() for t in b}
    counts = {(r.doc_id, r.term): r.tf for r in index.postings(docs, tf="count").collect()}
    assert counts == {(d, t): b.count(t) for d, b in bags().items() for t in b}


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], DOCS)
    rows = index.postings(none)
    assert rows.count() == 0 and index.inverted_index(rows).count() == 0
    assert vsm.vector_model(rows, 0).count() == 0
    assert vsm.most_similar(vsm.vector_model(rows, 0), none).count() == 0
    query = index.query_table(spark, ["oil"])
    assert vsm.ranked(vsm.scores(vsm.vector_model(rows, 0), query, none)).count() == 0


def test_boolean(docs):
    rows = index.postings(docs)
    ask = lambda q: sorted(r.doc_id for r in index.boolean_and(rows, q).collect())
    assert ask(["oil", "oil", "wheat"]) == [3] and ask(["oil"]) == [1, 3]
    assert ask(["oil", "unknown"]) == ask([]) == ask(["oil", ""]) == []
    assert index.keywords("Oil  prices") == ["Oil", "", "price"]
    assert index.keywords("Oil, prices", document_like=True) == ["oil", "price"]


def brute_model():
    sets = {d: set(b) for d, b in bags().items()}
    n = len(sets)
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    weight = {d: {t: math.log10(n / df[t]) for t in s} for d, s in sets.items()}
    return sets, weight


def test_model_and_ranking(spark, docs):
    sets, weight = brute_model()
    model = vsm.vector_model(index.postings(docs), len(TEXTS)).cache()
    for r in model.collect():
        total = sum(x * x for x in weight[r.doc_id].values())
        assert r.norm_tf == pytest.approx(1 / len(sets[r.doc_id])) and r.norm_weight == pytest.approx(weight[r.doc_id][r.term] / total)
    sums = model.groupBy("doc_id").agg(F.sum("norm_tf").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    got = [(r["rank"], r.doc_id) for r in vsm.ranked(vsm.scores(model, index.query_table(spark, ["oil", "oil", "unknown"]), docs), 6).collect()]
    assert [d for _, d in got][:2] == [1, 3] or [d for _, d in got][:2] == [3, 1]
    assert [r for r, _ in got] == [1, 2, 3, 4, 5, 6] and [d for _, d in got][2:] == [2, 4, 5, 6]
    l2 = vsm.vector_model(index.postings(docs), len(TEXTS), norm="l2")
    assert all(r.s == pytest.approx(1) for r in l2.groupBy("doc_id").agg(F.sum(F.col("norm_weight") ** 2).alias("s")).collect())


def test_term_in_all_documents(spark):
    rows = index.postings(spark.createDataFrame([(1, "oil"), (2, "oil")], "doc_id long, text string"))
    assert all(r.norm_weight is None for r in vsm.vector_model(rows, 2).collect())


def test_similarity(docs):
    sets, weight = brute_model()
    model = vsm.vector_model(index.postings(docs), len(TEXTS)).cache()
    got = {(r.a, r.b): r.tf_sim for r in vsm.similarities(model).collect()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b]:
                assert got.pop((a, b)) == pytest.approx(len(sets[a] & sets[b]) / len(sets[a]) / len(sets[b]))
    assert not got
    matrix = {(r.a, r.b): r.sim for r in vsm.similarity_matrix(model).collect()}
    assert matrix and all(matrix[b, a] == v for (a, b), v in matrix.items())
    best = {r.doc_id: r for r in vsm.most_similar(model, docs).collect()}
    assert best[4].tf_doc is None and best[4].tf_sim == 0 and best[2].tf_doc == 1


def test_k_means(spark, scratch):
    rng = random.Random(1)
    words = {0: ["oil", "gas", "well"], 1: ["wheat", "corn", "rice"]}
    rows = [(i, " ".join(rng.choices(words[i % 2], k=6))) for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = index.postings(docs).groupBy("doc_id").agg((1 / F.count("*")).alias("v"))
    vectors = index.postings(docs).join(sizes, "doc_id").select("doc_id", "term", "v")
    found = cluster.k_means(vectors, docs, scratch, k=2)
    got = {r.doc_id: r.cluster for r in found.assigned.collect()}
    assert got == {i: (i % 2 if i < 40 else 0) for i in range(41)} and found.rounds < 20
    assert cluster.quality(vectors, found.assigned, found.means, 2).first().quality > 0.2
    more = cluster.k_means(vectors, docs.limit(1), scratch, k=5)
    assert more.assigned.count() == 1


def test_arrays(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [2.0, 5.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    got = rows.select(cluster.array_dot(F.col("a"), F.col("b")).alias("d"), cluster.array_distance(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.d for r in got] == [11, 2, None, 0] and got[0].e == pytest.approx(8**0.5) and got[1].e == pytest.approx(26**0.5)


SAMPLE = """<!DOCTYPE lewis SYSTEM "lewis.dtd">
<REUTERS A="1">
<TEXT>&#2;
<TITLE>Oil prices</TITLE>
don't U.S.
</BODY></TEXT>
</REUTERS>
<REUTERS A="2">
<TEXT TYPE="X">one</TEXT>
kept since still on
</REUTERS>
</REUTERS>
<REUTERS A="3">
never closed"""


@pytest.mark.parametrize("block", [1, 2, 100])
def test_sgml(spark, tmp_path, block):
    (tmp_path / "a.sgm").write_text(SAMPLE + "\n")
    lines = sgml.check_header(sgml.read_lines(spark, [str(tmp_path / "a.sgm")]))
    got = [(r.article, r.line) for r in sgml.text_lines(lines, block).orderBy("line_no").collect()]
    assert got == [(0, "<TITLE>Oil prices</TITLE>"), (0, "don't U.S."), (1, "kept since still on"), (1, "</REUTERS>")]
    assert sorted(r.doc_id for r in sgml.document_ids(lines).collect()) == [1, 2]


def test_sgml_bad_header_and_newest(spark):
    rows = spark.createDataFrame([("p", 0, "no header"), ("p", 1, None)], "path string, line_no int, line string")
    with pytest.raises(Exception, match="no header in p"):
        sgml.check_header(rows).collect()
    twice = rows.withColumn("ingested_at", F.lit(None).cast("timestamp")).unionByName(rows.withColumn("line", F.lit("new")).withColumn("ingested_at", F.current_timestamp()))
    assert {r.line for r in sgml.newest_lines(twice).collect()} == {"new"}
    assert sgml.articles(rows.limit(0)).count() == 0


def test_index_files(spark, docs, tmp_path):
    rows = index.postings(docs).cache()
    nested = index.inverted_index(rows)
    index_files.write_index(nested, str(tmp_path / "text"))
    expected = sorted((r.doc_id, r.term, 1) for r in rows.collect())
    assert sorted(map(tuple, index_files.read_index(spark, str(tmp_path / "text")).collect())) == expected
    index_files.write_compressed(nested, str(tmp_path / "index.bin"))
    assert sorted(map(tuple, index_files.read_compressed(spark, str(tmp_path / "index.bin")).collect())) == expected
    index_files.write_compressed(nested.limit(0), str(tmp_path / "empty.bin"))
    assert index_files.read_compressed(spark, str(tmp_path / "empty.bin")).count() == 0


def test_sinks(spark, docs, tmp_path):
    report = vsm.most_similar(vsm.vector_model(index.postings(docs), len(TEXTS)), docs)
    index_files.write_similarities(report, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), sep=";", header=True)
    assert back.columns == ["Document", "TF_MostSimilar", "TF_Sim", "TF_IDF_MostSimilar", "TF_IDF_Sim"] and back.count() == len(TEXTS)
    done = spark.createDataFrame([(2, "b \n"), (1, "a \n")], "doc_id long, processed_text string")
    index_files.write_processed(done, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() >= 4
    block = spark.createDataFrame([(["x", "y"],)], "l array<string>").select(index_files.article_block(F.col("l")).alias("b")).first().b
    lines = spark.createDataFrame([(2, ["z"]), (1, ["x", "y"])], "doc_id long, lines array<string>")
    index_files.write_article_blocks(lines.coalesce(1), str(tmp_path / "blocks"))
    whole = "".join(r.value for r in spark.read.text(str(tmp_path / "blocks"), wholetext=True).collect())
    assert whole.startswith(block) and whole.count("ARTICLE -----\n") >= 2
    assert block == "\n-------- ARTICLE --------\nx\ny\n------- END OF ARTICLE -----\n"


def test_stop_word_file_and_stream(spark, docs, tmp_path):
    (tmp_path / "stop.txt").write_text("the\n\nand\n")
    stop = index_files.read_stop_words(spark, str(tmp_path / "stop.txt"))
    assert sorted(r.word for r in stop.collect()) == ["and", "the"]
    assert "and" not in {r.word for r in index.tokens(docs, stop).collect()}
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    stream_postings(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == index.postings(docs).count()


def test_hot_repeats(spark):
    rows = spark.createDataFrame([(1, "a")] * 30 + [(2, "b"), (2, "b")], "doc_id long, term string")
    assert without_hot_repeats(rows, "doc_id", 40).count() == 32 and without_hot_repeats(rows, "doc_id", 20).count() == 2


def test_stemmed(spark, docs):
    got = {r.term for r in index.postings(docs, stemmed=True).collect()}
    assert {"price", "oil", "wheat"} <= got and "prices" not in got


def shuffled_rows(spark):
    """Rows written to shuffles so far by this session."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def alike_texts(n):
    """Documents that share one word, so that all pairs have it, besides words of few."""
    rng = random.Random(3)
    return {i: " ".join(["shared", *(f"word{rng.randrange(60)}" for _ in range(rng.randrange(1, 12)))]) for i in range(n)}


def brute_similarities(texts):
    sets = {d: set(t.split()) for d, t in texts.items()}
    idf = {t: math.log10(len(texts) / sum(t in s for s in sets.values())) for t in set().union(*sets.values())}
    size = {d: sum(idf[t] ** 2 for t in s) for d, s in sets.items()}
    return {
        (a, b): (len(c) / len(sets[a]) / len(sets[b]), sum(idf[t] ** 2 for t in c) / size[a] / size[b])
        for a in sets for b in sets if a < b and (c := sets[a] & sets[b])
    }


@pytest.fixture()
def alike_tables(spark, tmp_path):
    texts = alike_texts(400)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return texts, str(tmp_path)


def test_most_similar_shuffles_no_pairs(spark, alike_tables):
    """79,800 pairs share a word; what is shuffled is of the size of the documents."""
    texts, folder = alike_tables
    before = shuffled_rows(spark)
    got = {r.doc_id: r for r in queries.most_similar_document(spark, folder).collect()}
    assert shuffled_rows(spark) - before < 20_000
    half = brute_similarities(texts)
    both = half | {(b, a): v for (a, b), v in half.items()}
    for d in texts:
        for k, (other, value) in enumerate(((got[d].tf_doc, got[d].tf_sim), (got[d].tfidf_doc, got[d].tfidf_sim))):
            near = [(-round(both[d, x][k], 12), x) for x in texts if x != d]
            assert value == pytest.approx(-min(near)[0], abs=2e-12) and -value <= min(near)[0] + 2e-12
            assert other in {x for v, x in near if v <= min(near)[0] + 2e-12}


@pytest.mark.parametrize("signed", [False, True])
def test_best_of_panels(spark, signed):
    """Two panels in small chunks, terms in dense columns and not: the largest product each, of equal ones the smallest id."""
    rng = np.random.default_rng(5)
    terms = 300
    full = np.zeros((240, terms))
    for row in full:
        at = np.unique((terms * rng.random(rng.integers(1, 30)) ** 3).astype(int))
        row[at] = rng.integers(1, 4, len(at)) * (rng.choice([-1, 1], len(at)) if signed else 1)
    full[7] = full[100] = full[101]

    def panel(a, b):
        row, term = np.nonzero(full[a:b])
        start = np.r_[0, np.cumsum(np.bincount(row, minlength=b - a))]
        value = full[a:b][row, term]
        return pairs.Rows(np.arange(a, b), start, term, value, value / 3, np.ones(b - a), np.full(b - a, 0.5))

    want = full @ full.T
    np.fill_diagonal(want, -np.inf)
    whole, one, other = panel(0, 240), panel(0, 110), panel(110, 240)
    for tasks in ([(whole, whole)], [(one, one), (one, other), (other, other)]):
        best = {}
        for x, y in tasks:
            for columns in pairs.best_columns(x, y, terms, 9, 32, 50):
                for doc, *found in zip(*(c.tolist() for c in columns), strict=True):
                    for k, (value, near) in enumerate((found[:2], found[2:])):
                        if near is not None:
                            best[doc, k] = max(best.get((doc, k), (0, 0)), (value, -near))
        for d in range(240):
            for k, scale in enumerate((1, 1 / 36)):
                top = want[d].max() * scale
                assert best.get((d, k)) == ((pytest.approx(top, abs=1e-9), -int(want[d].argmax())) if top > 0 else None)


def test_similarity_pairs_shuffle_no_pairs(spark, alike_tables):
    """All 79,800 pairs come out, from shuffles of the size of the documents."""
    texts, folder = alike_tables
    before = shuffled_rows(spark)
    rows = queries.similarity_pairs(spark, folder).collect()
    assert shuffled_rows(spark) - before < 20_000
    want = brute_similarities(texts)
    assert len(rows) == len(want) == 79_800 and {(r.a, r.b) for r in rows} == set(want)
    for r in rows:
        assert (r.tf_sim, r.tfidf_sim) == (pytest.approx(want[r.a, r.b][0], abs=1e-12), pytest.approx(want[r.a, r.b][1], abs=1e-6))


def test_similarity_matrix_shuffles_no_pairs(spark, alike_tables):
    """Both directions of all 79,800 pairs come out, from shuffles of the size of the documents."""
    texts, folder = alike_tables
    before = shuffled_rows(spark)
    rows = queries.similarity_matrix(spark, folder).collect()
    assert shuffled_rows(spark) - before < 20_000
    want = brute_similarities(texts)
    got = {(r.a, r.b): r.sim for r in rows}
    assert len(rows) == len(got) == 2 * len(want)
    assert all(got[a, b] == got[b, a] == pytest.approx(tf, abs=1e-12) for (a, b), (tf, _) in want.items())
