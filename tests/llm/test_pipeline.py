"""The pipeline's stages one after the other, against the operators' plain versions."""

from __future__ import annotations

import __spark_entry__ as spark_entry
from pyspark.sql import functions as F
import corpus_pipeline

from fleetvitals.llm.queries import table
from fleetvitals.session import stored

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        seen.append((name, docs))
    by = {name: {r.doc_id: r for r in df.collect()} for name, df in seen}
    assert all(df.columns == list(corpus_pipeline.COLUMNS) for _, df in seen[:-1])
    before = [(i, r.text) for i, r in by["toxicity"].items()]
    groups = brute.near_duplicates(before)
    assert set(by["near_dedup"]) == {i for i, (_, label) in groups.items() if label == i}
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    items = [(str(i), t) for i, t in items]
    grams = {tuple(w[k:k + 10]) for _, t in items for w in [brute.words(t)]
             for k in range(max(1, len(w) - 9))}
    lengths = {len(g) for g in grams}
    clean = {i for i, r in by["near_dedup"].items() for w in [brute.words(r.text)]
             if not any(tuple(w[k:k + n]) in grams for n in lengths for k in range(len(w) - n + 1))}
    assert set(by["decontamination"]) == clean == set(by["bpe"])
    assert len(by["language_id"]) == table(spark, FOLDER, "documents").count()


def test_texts_in_no_learnt_language_go(spark):
    docs = table(spark, FOLDER, "documents")
    foreign = ("Hyvää huomenta kaikille ystäville, jotka tulivat tänne kauempaa kuin me. "
               "Kylmä talvi jäätää järvet ja pitkät yöt hiljentävät metsän. ") * 4
    rubbish = " ".join(f"xq{i}zvk wjjpq{i * 7} wrtzqqgk vbnmzxcv" for i in range(30))
    cyrillic = "Быстрая лиса прыгает через ленивую собаку и бежит домой. " * 4
    rows = [(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate((foreign, rubbish, cyrillic))]
    more = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(
        rows, docs.select(*corpus_pipeline.COLUMNS).schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, more, FOLDER).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_rows_without_id_are_kept_once(spark):
    prose = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    item = next(r.text for r in table(spark, FOLDER, "benchmark").collect()
                if len(brute.words(r.text)) >= 10)
    rows = [(1, prose(1)), (2, prose(2)), (None, prose(1)), (None, prose(2) + " end"),
            (None, prose(3)), (None, prose(3)), (None, prose(3) + " end"), (None, prose(4)),
            (None, item), (2**63 - 1, prose(5)), (None, prose(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = stored(corpus_pipeline.near_dedup(spark, docs, FOLDER), "kept-rows")
    found = sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=lambda x: x[1])
    assert [x for x in found if x[0]] == [(1, prose(1)), (2, prose(2)), (2**63 - 1, prose(5))]
    own = [t for i, t in found if not i]
    assert len(own) == 3 and {t.removesuffix(" end") for t in own} == {prose(3), prose(4), item}
    clean = {r.text for r in corpus_pipeline.benchmark_free(spark, kept, FOLDER).collect()}
    assert clean == {t for _, t in found} - {item}


def test_every_query_is_registered():
    names = set(spark_entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {
        f"op{i}" for i in range(1, 14)}


def test_ids_with_several_texts_leave_no_copy(spark):
    prose = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(3, a), (5, a), (5, b), (9, b), (7, c), (7, c), (2**62 + 5, a + " end"), (11, ""), (11, ""),
            (11, None), (12, prose(4)), (12, prose(5)), (None, prose(6)), (None, prose(6))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    results = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(order)], schema)
        docs = docs.withColumn("source", F.lit("s"))
        kept = corpus_pipeline.near_dedup(spark, docs.repartition(3), FOLDER)
        results.append(sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())))
    assert results[0] == results[1]
    assert [x for x in results[0] if x[0] not in (11, 12)] == [(0, prose(6)), (3, a), (7, c)]
    assert [t for i, t in results[0] if i == 11] == ["", ""]
    assert len([t for i, t in results[0] if i == 12]) == 1

