"""Operators on documents against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from fleetvitals.llm import bpe, decontaminate, minhash, oracles, shards, token_store
from fleetvitals.llm.components import components
from fleetvitals.session import new_folder

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD_FILE, BYTE_FILE = (f"/opt/tokenizers/{n}.json" for n in ("word_bpe_49k", "byte_bpe_50k"))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def test_near_duplicates_agree_with_all_pairs(docs, rows):
    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    wanted = brute.near_duplicates(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_large_group_of_near_copies_is_one_component_or_as_linked(spark):
    import random
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(60)] = f"x{i}y{rng.randrange(99)}"
        texts.append((i, " ".join(own)))
    found = minhash.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_duplicates(texts)


def test_rows_of_one_id_are_in_one_component(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, None), (20, ""), (20, "x y"), (21, None)]
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(3, 3), (5, 3), (9, 3), (20, 20), (21, 21)}
    assert sum(r.kept for r in found) == 4


@pytest.mark.parametrize("copies", [400, 4000])
def test_repeated_rows_are_compared_once(spark, copies, monkeypatch):
    base = [f"w{i}" for i in range(40)]
    one, two = " ".join(base), " ".join([*base, "end"])
    rows = [(k % 2 + 1, (one, two)[k % 2]) for k in range(2 * copies)] + [
        (7, " ".join(f"z{k}y{i}" for i in range(9))) for k in range(copies)]
    real, sizes = minhash.confirmed, []

    def counted(pairs, texts, percent):
        sizes.append((pairs.count(), texts.count(), texts.select("node").distinct().count()))
        return real(pairs, texts, percent)

    monkeypatch.setattr(minhash, "confirmed", counted)
    found = minhash.near_duplicates(frame(spark, rows))
    assert {(r.doc_id, r.component_id) for r in found.select("doc_id", "component_id").distinct().collect()} == {
        (1, 1), (2, 1), (7, 7)}
    # One text to a class, and as many text pairs as candidate pairs.
    assert sizes and all(n == nodes and pairs <= 2 * copies for pairs, n, nodes in sizes)


def test_near_duplicates_of_odd_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (9, None), (9, ""), (None, "alone in the world it is")]
    named = frame(spark, rows).selectExpr("*", "1 as node", "2 as label", "'x' as component_id")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept)
                   for r in minhash.near_duplicates(named).collect())
    assert found == [(0, 2, 0, False), (0, 4, 5, False), (5, 4, 5, True), (5, 4, 5, True),
                     (9, 0, 9, True), (9, 0, 9, True)]


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_contamination_agrees_with_a_search(spark, rows, part_bytes):
    long = " ".join(f"q{i}" for i in range(40))
    items = [("b", " ".join(f"Q{i}" for i in range(5, 25))), ("a", "short item"), ("c", None),
             ("d", "..."), ("e", " ".join(f"q{i}" for i in range(12, 30))), ("a", "q39 end")]
    texts = rows + [(100_001, f"({long})! short, ITEM"), (100_002, "a SHORT-item"), (100_003, "q39 end")]
    benchmark = spark.createDataFrame(items + [(None, "in the wild")], "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate.benchmark_hits(
        frame(spark, texts), benchmark, part_bytes=part_bytes).collect()}
    for doc_id, text in texts:
        n_words, n_hit, named = brute.contamination(text, items)
        row = found[doc_id]
        assert (row.n_words, sum(r.word_to - r.word_from for r in row.runs), list(row["items"])) == (
            n_words, n_hit, named)
        assert all(brute.words(text[r.start:r.stop if hasattr(r, "stop") else r["end"]])
                   == brute.words(text)[r.word_from:r.word_to] for r in row.runs)


@pytest.mark.parametrize("window", [1, 2, 10])
def test_pieces_hold_every_window_once_or_more(window):
    rng = random.Random(3)
    for n in (0, 1, 9, 10, 11, 40, 300):
        words = [bytes([97 + rng.randrange(4)]) * rng.randint(1, 9) for _ in range(n)]
        pieces = [p.split() for p in decontaminate._cut(words, window, 50)]
        cut = {tuple(p[i:i + window]) for p in pieces for i in range(max(1, len(p) - window + 1))}
        assert cut == {tuple(words[i:i + window]) for i in range(max(1, n - window + 1)) if n}
        assert all(sum(len(w) + 1 for w in p) < 50 + 2 * window * 10 for p in pieces)


def test_one_item_with_most_rows_and_text_makes_no_large_part(spark, monkeypatch):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(4_000))
    items = [("hot", long)] * 30 + [("hot", f"hot text number {i} of many such") for i in range(300)]
    items += [(f"i{i}", f"an item of its own called {i} and nothing else") for i in range(200)]
    benchmark = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    pieces = decontaminate._pieces(
        benchmark.selectExpr("item_id as item", "text as words"), 10, 1_000)
    dealt = decontaminate._parts(pieces, 4_000).collect()
    sizes = Counter()
    for r in dealt:
        sizes[r.at] += len(r.words)
    assert len(dealt) == len({(r["item"], r.words) for r in dealt}) and max(sizes.values()) < 5_200
    assert sum(sizes.values()) < 2 * sum(len(t) for _, t in set(items))
    cut = decontaminate._pieces
    monkeypatch.setattr(decontaminate, "_pieces", lambda rows, window: cut(rows, window, 1_000))
    texts = [(1, long[2_000:9_000]), (2, "so hot text number 7 of many such, too"), (3, long), (4, "none")]
    found = {r.doc_id: r for r in decontaminate.benchmark_hits(
        frame(spark, texts), benchmark, part_bytes=20_000).collect()}
    for doc_id, text in texts:
        row, wanted = found[doc_id], brute.contamination(text, sorted(set(items)))
        assert (row.n_words, sum(r.word_to - r.word_from for r in row.runs), list(row["items"])) == wanted


def test_contamination_without_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(not r.runs for r in decontaminate.benchmark_hits(docs, none).collect())
    assert decontaminate.benchmark_hits(frame(spark, []), none).collect() == []


def test_bpe_agrees_with_the_library(spark, docs, rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BYTE_FILE)
    found = {r.doc_id: r for r in bpe.round_trips(docs, BYTE_FILE).collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        row = found[doc_id]
        assert row.n_tokens == len(ids), text
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    ids = bpe.encoded(docs, BYTE_FILE)
    assert {r.doc_id: r.text for r in bpe.decoded(ids, BYTE_FILE).collect()} == {
        i: t or "" for i, t in rows}


def test_chunks_cover_a_text_and_follow_its_content():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(500))
    places = bpe.chunk_places(text)
    assert places[0][0] == 0 and places[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(places, places[1:]))
    moved = {("xy " + text)[a:b] for a, b in bpe.chunk_places("xy " + text)}
    assert len(moved & {text[a:b] for a, b in places}) >= len(places) - 2


def test_words_agree_with_the_library(rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD_FILE)
    encoder = bpe.word_encoder(WORD_FILE)
    for _, text in rows:
        ids = np.frombuffer(encoder.encode(text or ""), encoder.kind).tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids, text


def test_token_store_is_in_order_and_keyed(spark, rows, docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD_FILE)
    folder = new_folder(spark, "test-store")
    token_store.write_store(docs, folder, WORD_FILE, 2)
    found = {r.doc_id: r for r in token_store.read_store(spark, folder).collect()}
    at, ids_of = 0, {}
    for doc_id, text in sorted(rows):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        row = found[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at, ids_of[doc_id] = at + len(ids), ids.tobytes()
    wanted = spark.createDataFrame([(r[0],) for r in rows[::3]] + [(1,), (None,), (10**9,)], "doc_id long")
    got = {r.doc_id: bytes(r.ids) for r in token_store.lookup(spark, folder, wanted).collect()}
    assert got == {r[0]: ids_of[r[0]] for r in rows[::3]}


def test_token_store_of_repeated_and_null_ids(spark):
    folder = new_folder(spark, "test-store")
    token_store.write_store(frame(spark, [(4, "b"), (4, "a"), (None, "c"), (None, None), (4, "a")]),
                            folder, WORD_FILE, 2)
    found = sorted((r.start, r.doc_id, r.copy, r.n_tokens)
                   for r in token_store.read_store(spark, folder).collect())
    assert found == [(0, None, 0, 1), (1, None, 1, 2), (3, 4, 0, 2), (5, 4, 1, 2), (7, 4, 2, 2)]
    empty = new_folder(spark, "test-store")
    token_store.write_store(frame(spark, []), empty, WORD_FILE, 2)
    assert token_store.read_store(spark, empty).collect() == []


def test_token_store_of_an_id_with_most_rows(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD_FILE)
    texts = [(i, f"text {i}") for i in range(40)] + [(20, "hot one " * (1 + i % 3)) for i in range(300)]
    texts += [(20, "always the same")] * 300 + [(None, f"none {i % 9}") for i in range(200)]
    folder = new_folder(spark, "test-store")
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        token_store.write_store(frame(spark, texts).repartition(6), folder, WORD_FILE, 2)
    finally:
        spark.conf.unset(coalesced)
    blocks = spark.read.parquet(f"{folder}/blocks").where("20 between first_id and last_id")
    parts = {r.part for r in blocks.collect()}
    found = sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.start)
    ids = [library.encode(t, add_special_tokens=False).ids + [2] for _, t in texts]
    digests = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
               for (i, _), x in zip(texts, ids, strict=True)]
    assert len(parts) > 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(digests)
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    order = [(r.doc_id is not None, r.doc_id or 0, r.copy) for r in found]
    assert order == sorted(set(order)) and Counter(r.doc_id for r in found) == Counter(i for i, _ in texts)
    assert max(c for _, i, c in order if i == 20) == 600
    wanted = spark.createDataFrame([(i,) for i in range(-1, 42)], "doc_id long")
    got = token_store.lookup(spark, folder, wanted).collect()
    firsts = {r.doc_id: (r.start, r.n_tokens) for r in found if r.copy == 0 and r.doc_id is not None}
    assert {r.doc_id: (r.start, r.n_tokens) for r in got} == firsts and len(got) == len(firsts) == 40


def test_lookup_over_the_widest_span_of_ids(spark):
    ids = [-2**63 + 1, -5, 0, 7, 2**63 - 1]
    folder = new_folder(spark, "test-store")
    token_store.write_store(frame(spark, [(i, str(i)) for i in ids] + [(None, "x")]), folder, WORD_FILE, 2)
    wanted = spark.createDataFrame([(i,) for i in ids + [8, -2**63 + 2]], "doc_id long")
    assert sorted(r.doc_id for r in token_store.lookup(spark, folder, wanted).collect()) == ids


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 7, 1000):
        keys = token_store.keys_of(np.arange(n) * 17, np.zeros(n, int))
        slots = token_store.slots_of(keys, token_store.perfect_hash(keys), n)
        assert sorted(slots.tolist()) == list(range(n))


def test_slots_balance_bytes_and_number_places(spark):
    texts = [(i, "x" * (i * 37 % 500)) for i in range(3000)] + [(None, "é"), (7, "again"), (7, "again")]
    records = shards.records(frame(spark, texts)).cache()
    slot_map = shards.initial_map(shards.slot_bytes(records), 24).cache()
    placed = shards.placed(records, slot_map).collect()
    assert len(placed) == len(texts)
    by = {}
    for row in placed:
        by.setdefault(row.shard, []).append(row)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) < 0.02 * max(sizes)
    assert all(sorted(r.place for r in own) == list(range(len(own))) for own in by.values())
    assert {(r["size"], r.text_crc32) for r in placed if r.doc_id is None} == {
        (10, zlib.crc32("é".encode()))}
    grown = shards.rebalanced_map(slot_map, shards.slot_bytes(records), 25, 2).collect()
    before = {r.virtual_slot: r.shard for r in slot_map.collect()}
    moved = [r for r in grown if r.shard != before[r.virtual_slot]]
    assert {r.shard for r in moved} == {24}
    assert sum(r.bytes for r in moved) < sum(r.bytes for r in grown) / 20
    assert len(grown) == len(before) and {r.version for r in grown} == {2}
    records.unpersist()
    slot_map.unpersist()


def test_slots_of_an_id_with_a_third_of_the_rows(spark):
    texts = [(i, "x" * (500 + i % 300)) for i in range(1500)]
    texts += [(7, "y" * (500 + i % 300)) for i in range(400)] + [(7, "again " * 100)] * 300
    texts += [(None, "nobody " * 90)] * 200
    records = shards.records(frame(spark, texts).repartition(5)).cache()
    keys, seen = [], {}
    often = {i for i, n in Counter(i for i, _ in texts).items() if n > 1}
    for i, text in texts:
        raw, own = text.encode(), "" if i is None else str(i)
        copy = seen[i, text] = seen.get((i, text), -1) + 1
        keys.append(f"{own}:{len(raw) + 8}:{zlib.crc32(raw)}:{copy}" if i in often else own)
    slots = [int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % shards.SLOTS for k in keys]
    found = records.collect()
    assert Counter((r.record_key, r.virtual_slot) for r in found) == Counter(zip(keys, slots))
    sizes = shards.slot_bytes(records).cache()
    slot_map = shards.initial_map(sizes, 24).cache()
    by, placed = {}, shards.placed(records, slot_map).collect()
    for row in placed:
        by.setdefault(row.shard, []).append(row)
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", texts)
    told = db.execute("select doc_id, text_crc32, shard, slot, virtual_slot from ("
                      + oracles.SLOTS + ")").fetchall()
    assert Counter(told) == Counter(
        (r.doc_id, r.text_crc32, r.shard, r.place, r.virtual_slot) for r in placed)
    total = [sum(r["size"] for r in own) for own in by.values()]
    # The last slot dealt makes the difference, and no slot holds many rows.
    assert len(by) == 24 and max(total) - min(total) <= max(r.bytes for r in sizes.collect()) < 8 * 808
    assert all(sorted(r.place for r in own) == list(range(len(own))) for own in by.values())
    for frame_ in (records, sizes, slot_map):
        frame_.unpersist()


def test_slots_of_an_empty_table(spark):
    records = shards.records(frame(spark, []))
    assert shards.placed(records, shards.initial_map(shards.slot_bytes(records), 24)).collect() == []


@pytest.mark.parametrize("nodes_at_once", [1 << 20, 40])
@pytest.mark.parametrize("kind", ["none", "random", "chain", "hub"])
def test_components_by_contraction_and_by_star_rounds(spark, kind, nodes_at_once):
    draw = random.Random(5)
    links = {
        "none": [(7, 7)],
        "random": [(draw.randrange(2_500), draw.randrange(2_500)) for _ in range(2_200)],
        "chain": [(i, i + 1) for i in range(900)],
        "hub": [(0, i) for i in range(1, 900)] * 2 + [(2_000, 2_001)],
    }[kind]
    label = {}
    for a, b in links:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            small, large = sorted((x, y), key=len)
            large |= small
            label.update(dict.fromkeys(small, large))
    expected = {n: min(group) for n, group in label.items() if len(group) > 1}
    rows = spark.createDataFrame(links, "a long, b long").repartition(12)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "50")
    try:
        found = components(rows, nodes_at_once).collect()
    finally:
        spark.conf.set(batch, before)
    assert {r.node: r.label for r in found} == expected and len(found) == len(expected)


def test_runs_between_blanks_are_parted_once():
    encoder = bpe.Encoder(WORD_FILE, bpe.WORD_PIECES, lower=True)
    parted = []
    encoder.runs.make = lambda run, make=encoder.runs.make: parted.append(run) or make(run)
    long = "x1" * bpe.RUN_CHARS
    texts = ["It's we'LL,'s ab12. ¿Qué?", "it's we'll\tit's\n", f"{long} a {long}", " ", "ß½ 'tis--don't 3rd"]
    for text in texts:
        wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(wanted, encoder.kind).tobytes(), text
    assert parted.count("it's") == 1 and parted.count(long) == 2
    assert all(len(run) <= bpe.RUN_CHARS for run in encoder.runs)
