"""Language, toxicity and URL models: held-out accuracy, exact scores, odd rows."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetvitals.llm import langid, toxicity, urls
from fleetvitals.llm.queries import URL_RULES, language, table, toxic_texts
from fleetvitals.llm.text import fold

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in table(spark, FOLDER, "documents").collect()}


def test_language_is_right_on_held_out_texts(spark, documents):
    found = language(spark, FOLDER).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {
        i for i in documents if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def plain_code_length(text: bytes, counts: dict, order: int) -> float:
    """Bits of a text under one language, by the recursion itself."""
    def chance(context: bytes, byte: int) -> float:
        lower = (lambda b: chance(context[1:], b)) if context else (lambda b: 1 / 256)
        seen = counts.get(context, {})
        total, kinds = sum(seen.values()), len(seen)
        if not total:
            return lower(byte)
        if byte in seen:
            return seen[byte] / (total + kinds)
        left = 1 - sum(lower(b) for b in seen)
        return kinds / (total + kinds) * lower(byte) / left

    return sum(-math.log2(chance(text[max(0, i - order):i], b)) for i, b in enumerate(text))


def test_code_lengths_are_those_of_the_recursion(spark):
    texts = [(1, "banana bandana", "x"), (3, "abracadabra", "y"), (4, "banal cabana", "x")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in texts], SCHEMA)
    used = [(t.encode(), lang) for i, t, lang in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    model = langid.fit(docs, contexts=10_000)
    probes = [b"banana", b"abraca", b"zebra ban", b"b"]
    found = langid.code_lengths(probes, model)
    for at, lang in enumerate(model.langs):
        counts: dict = defaultdict(Counter)
        for text, own in used:
            if own == lang:
                for i, byte in enumerate(text):
                    for order in range(min(i, langid.ORDER) + 1):
                        counts[text[i - order:i]][byte] += 1
        for row, probe in enumerate(probes):
            assert found[row, at] == pytest.approx(
                plain_code_length(probe, counts, langid.ORDER), rel=1e-4)


def test_language_of_texts_with_zero_bytes(spark):
    rows = [(i, "t\0h\0e a\0\0bc the and of \0with", "en", "s", 1) for i in range(1, 30)]
    rows += [(100 + i, "der die\0das und", "de", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs)
    found = {r.doc_id: r.lang_pred for r in langid.judged(docs, model).collect()}
    assert found == {i: lang for i, _, lang, _, _ in rows}
    # A zero byte costs nothing and ends the context, as the end of a text does.
    apart, whole = (langid.code_lengths(t, model) for t in ([b"the", b"and"], [b"the\0and"]))
    assert apart.sum(axis=0) == pytest.approx(whole[0], rel=1e-6)


def test_rare_languages_are_learnt_beside_large_ones(spark):
    rows = [(i, f"the and of {i} with a thing{i} that was there", "en", "s", 1) for i in range(3000)]
    rows += [(5000 + i, f"der die das {i} und", "de", "s", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs, contexts=60, train_rows=50)
    assert model.langs == ["de", "en"]
    found = langid.judged(docs, model).collect()
    assert all(r.lang_pred == ("de" if r.doc_id >= 5000 else "en") for r in found)
    # Of the 60 contexts, those of the rare language are not left out.
    de, en = langid.code_lengths([b"der die das und"], model)[0]
    assert de < 0.5 * en
    assert langid.level([10, 2000, 5000], 3010) == 1500 and langid.level([3, 4], 100) == 4


def test_learning_holds_little_beside_the_model(spark):
    """Of all nodes, bytes and languages the driver has one table, of four bytes a value."""
    random = np.random.RandomState(7)
    rows = [(100 * lang + i, "".join(chr(97 + c) for c in random.randint(0, 26, 150)), f"l{lang}", "s", 1)
            for lang in range(40) for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tracemalloc.start()
    model = langid.fit(docs, contexts=8_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.langs) == 40 and model.bits.nbytes > 20 << 20
    assert peak < 4 * model.bits.nbytes


def test_language_of_odd_rows(spark):
    rows = [(i, f"the and of {i} with", "en", "s", 1) for i in range(1, 41)]
    rows += [(100 + i, f"der die das {i} und", "de", "s", 1) for i in range(40)]
    odd = [(500, None, "en", None, None), (501, "", None, None, None), (502, "12 .. %", None, None, None),
           (None, "und die der das", None, None, None), (503, "the with", None, None, None),
           (503, "the with", None, None, None), (504, "with the of " * 60_000, None, None, None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    found = langid.judged(docs, langid.fit(docs)).collect()
    own = sorted((r.doc_id or -1, r.lang_pred) for r in found if (r.doc_id or 999) >= 500)
    assert own == [(-1, "de"), (500, "und"), (501, "und"), (502, "und"), (503, "en"), (503, "en"),
                   (504, "en")]
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    empty = docs.limit(0)
    assert langid.judged(empty, langid.fit(empty)).collect() == []
    assert {r.lang_pred for r in langid.judged(docs, langid.fit(empty)).collect()} == {"und"}


def test_toxic_texts_are_told_on_held_out_labels(spark):
    found = {r.doc_id: r for r in toxic_texts(spark, FOLDER).collect()}
    labels = [r for r in table(spark, FOLDER, "labels").collect() if found[r.doc_id].held_out]
    right = sum(found[r.doc_id].predicted == r.toxic for r in labels)
    assert right >= 0.9 * len(labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"plain text number {i} here" + (" awful" if i % 3 == 0 else ""), None, None, None)
         for i in range(200)] + [(900, None, None, None, None), (901, "", None, None, None),
                                 (None, "awful", None, None, None)], SCHEMA)
    labels = spark.createDataFrame(
        [(i, 1, int(i % 3 == 0)) for i in range(200)] + [(1, 0, 0), (None, 1, 1), (2, 1, None)],
        "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, toxicity.Rates(l1=2.0, epochs=8))
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(found) == 203 and found[900].score == found[901].score
    assert all(found[i].predicted == int(i % 3 == 0) for i in range(200))
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).collect() == []


def test_an_id_in_many_rows_is_learnt_from_once(spark):
    texts = {i: f"vile awful words {i}" if i % 3 == 0 else f"kind calm words {i}" for i in range(60)}
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    hot = next(i for i in texts if zlib.crc32(str(i).encode()) % 5)
    repeated = [(hot, texts[hot], None, None, None)] * 2000 + [
        (hot, f"other words {n}", None, None, None) for n in range(1000)]
    docs = spark.createDataFrame(repeated + [
        (i, t, None, None, None) for i, t in texts.items() if i != hot], SCHEMA)
    least = docs.where(f"doc_id = {hot}").orderBy(F.xxhash64("text"), "text").first().text
    single = spark.createDataFrame([
        (i, least if i == hot else t, None, None, None) for i, t in texts.items()], SCHEMA)
    rates = toxicity.Rates(l1=0.5)
    models = [{r.place: r.weight for r in toxicity.fit(d, labels, rates).collect()}
              for d in (docs, single)]
    assert models[0] == models[1] and len(models[0]) > 1
    # What reaches the learner is bounded in rows, whatever the copies.
    explained = toxicity.fit(docs, labels, rates)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" in explained.split("MapInArrow")[-1]


def test_weights_are_those_of_a_plain_learner():
    rng = np.random.RandomState(1)
    rates = toxicity.Rates(l1=0.3)
    learner, z, n = toxicity.Ftrl(rates), defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= rates.l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * rates.l1) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    for _ in range(60):
        at, label = np.unique(rng.randint(0, 30, 8)), int(rng.rand() < 0.4)
        learner.learn(at, label)
        g = 1 / (1 + math.exp(-sum(map(weight, at)))) - label
        g *= rates.positive if label else 1
        for i, w in [(i, weight(i)) for i in at]:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rates.alpha * w
            n[i] += g * g
    every = np.arange(30)
    assert np.allclose(learner.weights(every), [weight(i) for i in every])


def test_limits_judge_every_text_held_back(spark, monkeypatch):
    docs = spark.range(400_000).selectExpr("id as doc_id", "concat('the word ', id) as text", "'en' as lang")
    back = docs.where((fold(F.col("doc_id"), langid.FOLDS) != langid.HELD_OUT)
                      & (fold(F.col("doc_id"), langid.PARTS) == langid.BACK))
    model, judged, seen = langid.fit(docs.where("doc_id < 200")), langid.judged, []
    monkeypatch.setattr(langid, "judged", lambda df, *rest, **more: seen.append(df) or judged(df, *rest, **more))
    assert set(langid.limits(docs, model)) == {"en"}
    assert seen[0].count() == back.count() > langid.TRAIN_ROWS


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_hosts_and_paths(spark):
    rows = ["http://a.net/x", "HTTP://A.Example.NET/en/1?q#f", "https://example.com/de/", "x.org/fr/",
            "http://b.org/fr/2", "http://b.org/FR/2", "ftp://net/", "http://net", "http://fakenet/",
            "http://example.net/en", "://h?p/fr/", None, "", "http://u.example.com#/de/"]
    found = {r.page_id: r for r in urls.judged(
        pages(spark, [(i, u, None) for i, u in enumerate(rows)]), URL_RULES).collect()}
    assert [(r.host, r.path, r.rule) for _, r in sorted(found.items())] == [
        ("a.net", "/x", "net/"), ("a.example.net", "/en/1", "example.net/en/"),
        ("example.com", "/de/", "example.com/de/"), ("", "", None), ("b.org", "/fr/2", "org/fr/"),
        ("b.org", "/FR/2", None), ("net", "/", "net/"), ("net", "", None), ("fakenet", "/", None),
        ("example.net", "/en", "net/"), ("h", "", None), ("", "", None), ("", "", None),
        ("u.example.com", "", None)]
    assert {r.verdict for r in found.values()} <= {"allow", "block"}
    assert found[1].verdict == "allow" and found[0].verdict == "block"


def test_url_scores_are_those_of_the_recursion(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(i, f"http://good{letters[i % 20]}.org/fr/{i}", None) for i in range(60)]
    rows += [(100 + i, f"http://bad{letters[i % 19]}.net/x{i}", None) for i in range(60)]
    rows += [(300, "http://goodz.org/en/1", None), (301, "http://bad9.info/x", None)]
    found = {r.page_id: r for r in urls.judged(pages(spark, rows), URL_RULES).collect()}
    assert found[300].verdict == "allow" and found[301].verdict == "block"
    counts = {"a": defaultdict(Counter), "r": defaultdict(Counter)}
    folded = lambda r: "".join("0" if c.isdigit() else c for c in r.host + r.path)
    for row in found.values():
        if row.rule and zlib.crc32(folded(row).encode()) % urls.FOLDS:
            text = urls.PAD * urls.ORDER + folded(row) + urls.LAST
            for i in range(urls.ORDER, len(text)):
                for order in range(urls.ORDER + 1):
                    counts["a" if row.verdict == "allow" else "r"][text[i - order:i]][text[i]] += 1

    def chance(kind, context, c):
        lower = chance(kind, context[1:], c) if context else 1 / urls.CHARACTERS
        seen = counts[kind].get(context)
        return (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    for page in (300, 301):
        text = urls.PAD * urls.ORDER + folded(found[page]) + urls.LAST
        ratios = [math.log(chance("a", text[i - urls.ORDER:i], text[i])
                           / chance("r", text[i - urls.ORDER:i], text[i]))
                  for i in range(urls.ORDER, len(text))]
        assert found[page].score == pytest.approx(sum(ratios) / len(ratios))


def test_urls_without_pages_or_classes(spark):
    assert urls.judged(pages(spark, []), URL_RULES).collect() == []
    found = urls.judged(pages(spark, [(1, "http://a.example/", None), (1, "http://a.example/", None)]),
                        URL_RULES).collect()
    assert [(r.rule, r.verdict) for r in found] == [(None, "allow")] * 2
