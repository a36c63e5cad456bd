"""Search by bounds and by cells against search over everything."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tidemark.operators.cells as cells_module
from tidemark.functions import pytext
from tidemark.functions import text as tx
from tidemark.operators import bounds
from tidemark.operators import index as ix
from tidemark.operators import rerank as rrk
from tidemark.operators import retrieval as ret
from tidemark.operators.cells import build_cells, visited
from tidemark.plans import catalog, engine_rows


def corpus(spark, n=600, seed=0):
    """Chunks of words with very unequal frequencies, in two sources, with copies."""
    r = np.random.default_rng(seed)
    odds = 1 / np.arange(1, 121) ** 1.1
    rows = []
    for i in range(n):
        words = r.choice(120, int(r.integers(3, 90)), p=odds / odds.sum())
        rows.append(("ab"[i % 2], f"c{i}", i // 3, [f"t{w}" for w in words]))
    rows += [("a", f"copy{i}", 5, rows[0][3]) for i in range(30)]
    return spark.createDataFrame(rows, "source string, chunk_id string, doc_pos long, tokens array<string>")


def asked(spark, seed=1):
    r = np.random.default_rng(seed)
    rows = [(f"q{k}", qi, f"t{w}", int(r.integers(1, 3))) for k in range(25) for qi in range(2) for w in set(r.integers(0, 130, int(r.integers(1, 9))).tolist())]
    return spark.createDataFrame(rows, "qid string, qi int, term string, qtf long")


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_bounded_bm25_like_plain(spark, k):
    chunks = corpus(spark)
    posts, sources = ix.postings(chunks), ix.source_stats(chunks)
    stats, terms = ix.term_stats(posts, sources), asked(spark)
    rows = lambda found: sorted((r.qid, r.qi, r.source, r.chunk_id, r["rank"], round(r.score, 9)) for r in found.collect())
    plain = rows(ret.bm25(terms, posts, sources, stats, k))
    assert plain and rows(ret.bm25_bounded(terms, posts, sources, stats, bounds.impact_blocks(posts, sources), k)) == plain


def test_frequent_terms_are_mostly_not_scored(spark):
    """A rare term with a frequent one: of the frequent one's postings few are read, and as many pairs are counted as there are."""
    chunks = corpus(spark, 3000)
    posts, sources = ix.postings(chunks), ix.source_stats(chunks)
    blocks = bounds.impact_blocks(posts, sources)
    terms = spark.createDataFrame([("q", 0, t, 1) for t in ("t0", "t1", "t60", "t75", "t90")], "qid string, qi int, term string, qtf long")
    stats = ix.term_stats(posts, sources)
    read = bounds.postings_read(terms, posts, sources, stats, blocks, 5).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("all", "early", "chosen")]).collect()
    of = {r.term: r for r in read}
    assert of["t0"]["all"] > 2000 and of["t0"].early + of["t0"].chosen < 0.2 * of["t0"]["all"]
    assert bounds.pairs_asked(terms, stats) == sum(r["all"] for r in read)


def test_no_postings(spark):
    chunks = corpus(spark, 10).limit(0)
    posts, sources = ix.postings(chunks), ix.source_stats(chunks)
    assert ret.bm25_bounded(asked(spark), posts, sources, ix.term_stats(posts, sources), bounds.impact_blocks(posts, sources), 5).count() == 0


def vectors(spark, n, dims, spots, seed=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(spots, dims))
    x = centre[r.integers(0, spots, n)] + r.normal(size=(n, dims)) * 0.15
    x[: n // 5] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2] = 0
    rows = [("ab"[i % 2], f"c{i}", i // 2, v.tolist()) for i, v in enumerate(x)]
    q = centre[r.integers(0, spots, 30)] + r.normal(size=(30, dims)) * 0.1
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "source string, chunk_id string, doc_pos long, x array<double>"), spark.createDataFrame([(f"q{k}", 0, s, v.tolist()) for k, v in enumerate(q) for s in "abz"], "qid string, qi int, source string, q array<double>")


@pytest.mark.parametrize(("rows", "k"), [(4096, 5), (16, 3), (4096, 5000)])
def test_cells_like_all_pairs(spark, monkeypatch, rows, k):
    monkeypatch.setattr(cells_module, "ROWS", rows)
    chunks, questions = vectors(spark, 700, 6, 12)
    hits, visits = visited(questions, build_cells(chunks), k)
    got = {(r.qid, r.source, r.chunk_id): (r["rank"], round(r.score, 9)) for r in ret.ranked(hits, k).collect()}
    want = {(r.qid, r.source, r.chunk_id): (r["rank"], round(r.score, 9)) for r in ret.nearest(questions, chunks, k).collect()}
    assert got == want and want
    assert visits.count() == visits.select("qid", "source", "cell").distinct().count()


def test_few_cells_are_visited(spark):
    chunks, questions = vectors(spark, 4000, 6, 40)
    cells = build_cells(chunks)
    _, visits = visited(questions, cells, 5)
    total = cells.cells.where("source = 'a'").count() * 60
    assert visits.count() < 0.35 * total, (visits.count(), total)


def test_cells_of_nothing(spark):
    chunks, questions = vectors(spark, 20, 4, 2)
    assert visited(questions, build_cells(chunks.limit(0)), 5)[0].count() == 0
    assert visited(questions.limit(0), build_cells(chunks), 5)[0].count() == 0


def test_a_large_batch_goes_by_bounds(spark, monkeypatch):
    """Whole search with both arms: the same lists whichever way it goes, with tables made for the batch or beforehand."""
    from tidemark.config import EngineConfig
    from tidemark.operators.retrieval import search_lists

    rows = corpus(spark, 200).withColumn("text", F.array_join("tokens", " ")).withColumn("display_text", F.col("text")).drop("tokens").withColumn("context_header", F.lit(None).cast("string"))
    config = EngineConfig().variant({"index.dense.dims": 16})
    index = ix.build_index(rows, config, lambda df: df.cache())
    analysed = spark.createDataFrame([(f"q{i}", [f"t{i} t{i + 9} t0", f"t{i} t1"]) for i in range(12)], "qid string, all_queries array<string>")
    lists = lambda own: sorted((r.arm, r.qid, r.qi, r.source, r.chunk_id, r["rank"], round(r.score, 8)) for r in search_lists(analysed, own, config).collect())
    plain = lists(index)
    monkeypatch.setattr(ret, "MOST_PAIRS", 10)
    assert plain and lists(index) == plain and lists(ix.with_bounds(index, config)) == plain


def test_pairs_are_scored_where_their_chunk_is(spark):
    """A chunk's pairs are added up without a shuffle of pairs: one exchange deals postings by chunk, one the best of each task."""
    chunks = corpus(spark, 300)
    posts, sources = ix.postings(chunks), ix.source_stats(chunks)
    stats = ix.term_stats(posts, sources)
    terms = spark.createDataFrame([(f"q{i}", 0, f"t{i % 7}", 1) for i in range(40)], "qid string, qi int, term string, qtf long")
    found = ret.bm25(terms, posts, sources, stats, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() and "hashpartitioning(qid" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(qid" in line and "chunk_id" in line]


def test_a_task_adds_up_a_bounded_number_of_pairs(spark, monkeypatch):
    """pairs are dealt among more tasks as they grow."""
    rows = spark.createDataFrame([(1000,), (2000,)], "n long")
    assert bounds.tasks_for(rows, "n") == spark.sparkContext.defaultParallelism and bounds.tasks_for(rows.where("n < 0"), "n") >= 1
    monkeypatch.setattr(bounds, "PAIRS_OF_A_TASK", 100)
    assert bounds.tasks_for(rows, "n") == 30


def test_postings_are_counted_in_their_row(spark):
    """No shuffle or hash table of postings; only equal ids are added up."""
    rows = spark.createDataFrame([("s", "a", 1, ["x", "y", "x"]), ("s", "b", 2, []), ("s", "c", 3, ["z"]), (None, None, None, ["é", "e", "é"])], "source string, chunk_id string, doc_pos long, tokens array<string>")
    want = {("s", "x", "a", 1, 3, 2), ("s", "y", "a", 1, 3, 1), ("s", "z", "c", 3, 1, 1), (None, "é", None, None, 3, 2), (None, "e", None, None, 3, 1)}
    posts = ix.postings(rows)
    assert {tuple(r) for r in posts.collect()} == want and "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    assert posts.columns == ["source", "term", "chunk_id", "doc_pos", "dl", "tf"]
    twice = ix.postings(rows.union(rows))
    assert {tuple(r) for r in twice.collect()} == {(*p[:5], 2 * p[5]) for p in want}
    stats = {r.source: (r.n, r.avgdl) for r in ix.source_stats_of(rows, posts).collect()}
    assert stats == {r.source: (r.n, r.avgdl) for r in ix.source_stats(rows).collect()} == {"s": (3, 4 / 3), None: (1, 3.0)}


def test_texts_are_cut_and_counted_in_one_pass(spark):
    """Chunks without tokens give the postings that their tokens give, in several parts of a batch too; no shuffle."""
    texts = [None, "", "the of", "ﬁne Ｆｕｌｌ 𝐀bold naïve İstanbul ß ½ № ⅷ", "v1.2.3-beta a-b.c/d__e dead--letter 1.2 v3 running passes bus boxes agreed", "tab\tnew\nline " * 3]
    rows = spark.createDataFrame([("s" if i % 2 else None, f"c{i}", i, t) for i, t in enumerate(texts)], "source string, chunk_id string, doc_pos long, text string")
    got = ix.postings(rows)
    want = ix.postings(rows.withColumn("tokens", tx.tokenize(F.col("text"))))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    batch = pa.RecordBatch.from_pylist([{"source": "s", "chunk_id": str(i), "doc_pos": i, "text": f"x{i} y z y"} for i in range(9)])
    whole = [r for part in ix.counted_texts([batch]) for r in part.to_pylist()]
    least, ix.POSTINGS_AT_ONCE = ix.POSTINGS_AT_ONCE, 5
    try:
        parts = list(ix.counted_texts([batch]))
    finally:
        ix.POSTINGS_AT_ONCE = least
    assert len(parts) == 5 and [r for part in parts for r in part.to_pylist()] == whole and whole[0]["dl"] == 4


def test_words_a_worker_remembers_are_bounded(monkeypatch):
    monkeypatch.setattr(pytext, "KNOWN", 2)
    known: dict = {}
    assert pytext.term_counts("x1 x2 x3 the a-bb x1", known) == {"x1": 2, "x2": 1, "x3": 1, "a-bb": 1, "bb": 1} and len(known) <= 2
    monkeypatch.setattr(pytext, "LONG", 1)
    assert pytext.term_counts("x1 x2 x1", {}) == {"x1": 2, "x2": 1}


def test_an_index_of_the_tables_copies_no_text(spark):
    """The chunks are read from the documents again; what is written is smaller than the texts, which a copy holds twice."""
    built = engine_rows.index(spark, "/root/testdata/sf0.001")
    assert all(f.endswith("documents.parquet") or "/documents.parquet/" in f for f in built.chunks.inputFiles())
    assert all("text" not in getattr(built, name).columns for name in ("postings", "source_stats", "term_stats"))


def test_statistics_of_a_search_are_those_of_its_terms(spark, monkeypatch):
    """counts of terms that no question has are not shuffled; those of the others are the index's."""
    seen, made = [], ix.term_stats
    monkeypatch.setattr(catalog.ix, "term_stats", lambda posts, sources: seen.append(made(posts, sources)) or seen[-1])
    found = catalog.searched(spark, "/root/testdata/sf0.001")
    asked = {r.term for r in ret.phrasings(catalog.questions(spark, "/root/testdata/sf0.001").select("qid", F.array("query").alias("all_queries"))).select("term").distinct().collect()}
    sources, posts = catalog.indexed(spark, "/root/testdata/sf0.001")
    got = {tuple(r) for r in seen[0].collect()}
    assert found.count() and got == {tuple(r) for r in made(posts, sources).collect() if r.term in asked}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_floors_keep_scores_in_their_tasks(spark, monkeypatch, k):
    """With many tasks the lists are the same, and scores under the floors of a part of the chunks are not dealt out."""
    chunks = corpus(spark, 900)
    posts, sources = ix.postings(chunks), ix.source_stats(chunks)
    stats, terms = ix.term_stats(posts, sources), asked(spark)
    rows = lambda found: sorted((r.qid, r.qi, r.source, r.chunk_id, r["rank"], round(r.score, 9)) for r in found.collect())
    plain = rows(ret.bm25(terms, posts, sources, stats, k))
    pairs = terms.join(posts, "term").select("qid", "qi", "source", "chunk_id").distinct().count()
    seen, real = [], ret.ranked
    monkeypatch.setattr(ret, "ranked", lambda hits, k: seen.append(hits.count()) or real(hits, k))
    monkeypatch.setattr(bounds, "PAIRS_OF_A_TASK", pairs // 30)
    assert plain and rows(ret.bm25(terms, posts, sources, stats, k)) == plain
    assert sum(seen) < 0.6 * pairs if k < 10 else seen[-1] == pairs


def test_statistics_are_those_of_the_terms_asked(spark):
    """An index for one batch writes no statistics of all terms; those asked for are the same."""
    built = engine_rows.index(spark, "/root/testdata/sf0.001")
    terms = ret.phrasings(engine_rows.analysed(spark, "/root/testdata/sf0.001"))
    asked_for = {r.term for r in terms.select("term").distinct().collect()}
    got = {tuple(r) for r in built.stats_of(terms).collect()}
    assert not built.counted and got == {tuple(r) for r in built.term_stats.collect() if r.term in asked_for}
    assert {tuple(r) for r in built.vocabulary_of(terms).collect()} == {tuple(r) for r in built.vocabulary.collect() if r.term in asked_for}


@pytest.mark.parametrize("name", ["label_grades", "claims_found"])
def test_queries_of_chunks_alone_build_no_index(spark, monkeypatch, name):
    """they read the chunks; no posting is made."""
    engine_rows.forget()
    monkeypatch.setattr(engine_rows.ix, "postings", None)
    assert engine_rows.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_texts_of_other_chunks_are_not_shuffled(spark, monkeypatch, most):
    """The ids of a pool go to the texts although Spark would not broadcast them; with too many ids both are shuffled."""
    chunks = engine_rows.chunk_rows(spark, "/root/testdata/sf0.001")
    rows = ret.without_texts(chunks).where("doc_pos % 7 = 0")
    monkeypatch.setattr(ret, "IDS_AT_ONCE", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ret.with_texts(rows, chunks)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {(r.chunk_id, r.text) for r in got.select("chunk_id", "text").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {(r.chunk_id, r.text) for r in chunks.where("doc_pos % 7 = 0").select("chunk_id", "text").collect()}
    assert ("BroadcastHashJoin" in plan) == (most > 0)


def with_words(chunks):
    return chunks.select("source", "chunk_id", "doc_pos", F.concat_ws(" ", "tokens").alias("text"), F.concat_ws(" ", "tokens").alias("display_text"), F.lit(None).cast("string").alias("context_header"))


@pytest.mark.parametrize(("k", "pairs", "cells"), [(1, 1 << 20, 1 << 22), (5, 700, 1 << 22), (5, 1 << 20, 300), (1000, 900, 900)])
def test_a_batch_is_searched_in_the_rows_of_its_chunks(spark, monkeypatch, k, pairs, cells):
    """An index for a batch has no posting of another term; lengths, statistics and lists are those of the whole index, without a posting shuffled."""
    monkeypatch.setattr(ret, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(ret, "CELLS_AT_ONCE", cells)
    odd = spark.createDataFrame([("a", "none", 7, None), ("b", "empty", 8, []), (None, "x", 9, ["t1"]), ("a", "nowhere", None, ["t1", "t3"]), ("a", "no place", None, ["t1", "t3"])], "source string, chunk_id string, doc_pos long, tokens array<string>")
    chunks, terms = with_words(corpus(spark, 900).union(odd)).repartition(3).cache(), asked(spark)
    posts = ix.postings(chunks)
    sources = ix.source_stats_of(chunks, posts)
    config = engine_rows.CONFIG.variant({"retrieval.top_k_per_source": k})
    built = ix.build_index(chunks, config, ret.packed, copied=False, counted=False, asked=terms)
    few = {r.term for r in terms.select("term").distinct().collect()}
    assert {tuple(r) for r in built.postings.collect()} == {tuple(r) for r in posts.collect() if r.term in few} and built.rows.count() == chunks.count()
    assert {(r.source, r.n, round(r.avgdl, 9)) for r in built.source_stats.collect()} == {(r.source, r.n, round(r.avgdl, 9)) for r in sources.collect()}
    rows = lambda found: sorted((r.qid, r.qi, r.source, r.chunk_id, str(r.doc_pos), r["rank"], round(r.score, 9)) for r in found.collect())
    want = rows(ret.bm25(terms, posts, sources, ix.term_stats(posts, sources), k))
    made = ret.packed(ret.with_stats(terms, built.source_stats, built.stats_of(terms)))
    seen, real = [], ret.bm25_in_rows
    monkeypatch.setattr(ret, "phrasings", lambda rows: rows)
    monkeypatch.setattr(ret, "bm25_in_rows", lambda *a: seen.append(real(*a)) or seen[-1])
    assert want and rows(ret.search_lists(terms, built, config)) == want and len(seen) == 1
    # Only each task's best and their equals leave it.
    lists = made.select("qid", "qi", "source").distinct().count()
    out = built.rows.mapInArrow(ret.best_of_rows(made.collect(), k, 1.5, 0.75), "qid string, qi int, source string, chunk_id string, doc_pos long, score double")
    assert out.count() <= 1.5 * k * lists * built.rows.rdd.getNumPartitions()


def test_a_batch_with_repeated_ids_adds_them_up(spark):
    """Postings of equal ids are added up, so such chunks are not searched row by row."""
    chunks, terms = with_words(corpus(spark, 60)), asked(spark)
    built = ix.build_index(chunks.union(chunks.where("doc_pos < 9")), engine_rows.CONFIG, ret.packed, copied=False, counted=False, asked=terms)
    few = {r.term for r in terms.select("term").distinct().collect()}
    assert built.rows is None and {tuple(r) for r in built.postings.collect()} == {tuple(r) for r in ix.postings(chunks.union(chunks.where("doc_pos < 9"))).collect() if r.term in few}


def test_an_index_of_the_questions_is_smaller_than_one_of_the_texts(spark):
    built = engine_rows.index(spark, "/root/testdata/sf0.001")
    assert built.rows is not None and built.postings.count() < 0.5 * ix.postings(engine_rows.chunk_rows(spark, "/root/testdata/sf0.001")).count()


@pytest.mark.parametrize("most", [1 << 15, 0])
def test_a_pool_goes_to_its_texts(spark, monkeypatch, most):
    """F8: no text is shuffled while a pool is small; where it is not, or chunks repeat, each text is joined once."""
    chunks = engine_rows.chunk_rows(spark, "/root/testdata/sf0.001").where("doc_pos % 7 = 0")
    rows = ret.without_texts(chunks)
    want = sorted((r.chunk_id, r.text) for r in chunks.collect())
    monkeypatch.setattr(ret, "POOL_AT_ONCE", most)
    got = ret.with_texts(rows, chunks)
    assert sorted((r.chunk_id, r.text) for r in got.select("chunk_id", "text").collect()) == want
    assert ("Exchange hashpartitioning" in got._jdf.queryExecution().executedPlan().toString()) == (most == 0)
    assert sorted((r.chunk_id, r.text) for r in ret.with_texts(rows, chunks.union(chunks)).select("chunk_id", "text").collect()) == want


def test_reranking_moves_no_text(spark):
    """scores and places go to the candidates, which are written once and not shuffled."""
    rows, _ = engine_rows.retrieved(spark, "/root/testdata/sf0.001")
    final, _ = rrk.rerank(rows, engine_rows.CONFIG)
    assert all("Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString() for df in (rrk.features(rows), final))
    assert "text" in final.columns and final.count() == engine_rows.final(spark, "/root/testdata/sf0.001").count() > 0
    assert not set(ret.TEXTS) & set(engine_rows.featured(spark, "/root/testdata/sf0.001").columns)
