"""The pipeline's stages against brute-force versions of their decisions."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.toxicity import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def write(spark, folder):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7))) for _ in range(600)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(k, say(30)) for k in range(6)]
    docs, labels = [], []
    for i in range(400):
        text = say(r.randint(20, 120))
        kind = r.random()
        if kind < 0.2:
            text += f" zorg{r.choice('abc')}s vile zorg{r.choice('abc')}t vile"
        elif kind < 0.3 and docs:
            text = docs[r.randrange(len(docs))][1]
        elif kind < 0.35:
            half = r.choice(bench)[1].split()
            text = " ".join([text, *half[15:], "x", *half[:15]])
        elif kind < 0.45:
            text += f" {KEY}"
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int("vile" in text)))
    docs += [(1000, None, None, None, None), (1001, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, dict(bench)


def sets_of(docs):
    out = {}
    for i, t, *_ in docs:
        w = WORD.findall(t or "")
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, bench = write(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]

    clean = steps["toxicity"](spark, frame, folder)
    bad = {r.doc_id for r in toxicity(frame, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert bad == {i for i, t, *_ in docs if "vile" in (t or "")}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - bad

    left = [d for d in docs if d[0] not in bad]
    sets, seen, gone = sets_of(left), {}, set()
    for i in sorted(sets):
        if any(sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in seen):
            gone.add(i)
        seen[i] = True
    single = steps["near_duplicates"](spark, clean, folder)
    left = [d for d in left if d[0] not in gone]
    assert gone and single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(d[0] for d in left)

    pure = steps["decontamination"](spark, single, folder)
    leaks = {d[0] for d in left if any(len(set(d[1].split()) & set(b.split())) == len(set(b.split())) for b in bench.values() if d[1])}
    left = [d for d in left if d[0] not in leaks]
    assert leaks and pure.columns == columns and sorted(r.doc_id for r in pure.collect()) == sorted(d[0] for d in left)

    safe = steps["secrets"](spark, pure, folder)
    got = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == columns and set(got) == {d[0] for d in left}
    for i, t, *_ in left:
        want = t.replace(KEY, "[redacted]") if t else t
        assert got[i].text == want and got[i].n_chars == (len(want) if want is not None else None)

    mixed = steps["mixing"](spark, safe, folder).collect()
    assert all(0 < r.taken <= 3 * r.size and r.size == len(WORD.findall(r.text)) for r in mixed)
    whole = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, r.taken) for r in whole.collect()} == {(r.doc_id, r.taken) for r in mixed}
    assert corpus_pipeline.run(spark, folder).agg(F.sum("taken")).first()[0] == sum(r.taken for r in mixed)


def test_empty_tables(spark, tmp_path):
    """No documents give no documents; neither labels nor a benchmark are needed."""
    folder = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and out.columns[-4:] == ["size", "source_size", "target", "taken"]


def test_registered():
    assert corpus_pipeline.ORACLE_SQL is None
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    assert set(ORACLES) <= set(QUERIES)


def test_near_duplicates_from_80(spark, tmp_path):
    """Lone pairs of 90 shingles each: two changed words leave 80 of 100 in common, four words changed side by side 82 of 98, three apart 75 of 105."""
    docs, gone = [], set()
    for k in range(30):
        base = [f"w{k}x{i}" for i in range(94)]
        for changed in ((20, 60), (40, 41, 42, 43), (20, 40, 60)):
            other = [f"{w}{changed}".replace(" ", "") for w in base]
            docs.append(" ".join(other))
            for i in changed:
                other[i] += "new"
            docs.append(" ".join(other))
            if len(changed) != 3:
                gone.add(len(docs) - 1)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - gone


def test_clashing_columns(spark):
    """Columns named like those that the stages add for themselves stay, in the near-duplicate and the mixing stage."""
    from tidemark.llm.minhash import one_of_each

    rows = [(i, f"alpha beta gamma delta epsilon zeta eta theta {i // 2}" if i < 6 else f"text {i} of its own with some more words {i}", "s", i, i, i, i, i) for i in range(10)] + [(9, "again a text of id nine that is long enough", "s", 9, 9, 9, 9, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, marked int, gone int, rows int, `row` int, `_row` int")
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    got = kept.collect()
    assert all((r.marked, r.gone, r.rows, r._row) == (r.doc_id,) * 4 for r in got) and sorted(r.doc_id for r in got) == [0, 2, 4, 6, 7, 8, 9]
