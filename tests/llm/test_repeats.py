"""Runs, token alignment and repeated passages against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetvitals.llm import align, queries, runs, substrings

from . import brute

BYTE_FILE, PIECE_FILE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, n_words string, runs int, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- runs ---

@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4), st.integers(0, 70), st.integers(0, 10 ** 9), st.integers(1, 20))
def test_runs_are_those_of_the_definition(letters, n, seed, period):
    rng = random.Random(seed)
    words = [rng.randrange(letters) for _ in range(n)]
    if n and seed % 3:
        a = rng.randrange(n)
        words = [words[i if i < a else a + (i - a) % min(period, n - a)] for i in range(n)]
    assert runs.runs_of(np.array(words, np.int64)) == brute.periodic_runs(words)


def test_long_periodic_texts_take_linear_lists_of_lags():
    for words in ([0] * 60_000, list(range(7)) * 9_000, ([1, 2] * 300 + [3]) * 60):
        found = runs.runs_of(np.array(words, np.int64))
        assert (0, len(words), {60_000: 1, 63_000: 7, 36_060: 601}[len(words)]) in found


def test_collapsed_runs_of_odd_rows(spark):
    looped = " ".join("abc" * 5)
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "a " * 11), (5, "a\n" * 12),
            (6, looped), (6, looped), (None, "x " + looped), (7, "Ab ab " * 7), (8, "é\x85 " * 40)]
    found = runs.collapsed_runs(frame(spark, rows)).collect()
    shown = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    assert shown == [
        (0, 16, [(1, 15, 3)], "x a b c"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""),
        (4, 11, [], " ".join("a" * 11)), (5, 12, [(0, 12, 1)], "a"),
        (6, 15, [(0, 15, 3)], "a b c"), (6, 15, [(0, 15, 3)], "a b c"),
        (7, 14, [(0, 14, 2)], "Ab ab"), (8, 40, [(0, 40, 1)], "é\x85")]
    assert runs.collapsed_runs(frame(spark, [])).collect() == []


def test_the_query_on_runs_agrees_with_a_plain_version(spark, tmp_path):
    rows = [(10 * i + 3, t) for i, (_, t) in enumerate(brute.corpus(seed=5, groups=14))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for doc_id, text in rows:
        words = brute.blank_words(text)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            looped += 1
        all_runs = brute.periodic_runs(words) if len(words) < 400 else runs.runs_of(
            runs.word_numbers([w.encode() for w in words]))
        gone = {i for s, n, p in all_runs for i in range(s + p, s + n)}
        best = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = found[doc_id]
        assert r.n_runs == len(all_runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == (
            (*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in all_runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert looped > 5


# --- alignment ---

@pytest.fixture(scope="module")
def pair():
    return align.Pair(BYTE_FILE, PIECE_FILE)


TOKEN_TEXTS = [t for t in brute.ODD_TEXTS if t] + [
    "<|endoftext|> <s>a</s> <unk> <0x41>", "a\0b", "  x ", "tail ", "\t\n \n x", "▁a ▁", "日本 १२ ½",
    "It's we'LL 'tis don'T ''s", "combíning", "<pad></s>▁▁ x"]


def test_ids_are_those_of_the_libraries_also_in_pieces(pair, monkeypatch):
    library = Tokenizer.from_file(BYTE_FILE)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    rng = random.Random(4)
    texts = TOKEN_TEXTS + ["".join(rng.choices(" ab1é.\n\t'ß٣日-_sS  ", k=rng.randint(1, 60)))
                           for _ in range(300)]
    for size in (align.PIECE_CHARS, 8):
        monkeypatch.setattr(align.parted, "__defaults__", (size,))
        for text in texts:
            a = library.encode(" " + text, add_special_tokens=False).ids
            b = pieces.encode(text)
            same = all(b"".join(t[i] for i in ids) == (" " + text).encode()
                       for ids, t in ((a, pair.a_bytes), (b, pair.b_bytes)))
            assert pair.encoded(text) == ((a, b) if same else ([], [])), text


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)))
def test_groups_end_where_both_ends_meet(a, b, both):
    a, b = sorted(a | both | {121}), sorted(b | both | {121})
    groups = align.aligned(a, b)
    common = sorted(set(a) & set(b))
    assert [a[i] for i in groups.a_last] == common == [b[j] for j in groups.b_last]


def test_stretches_name_the_same_groups_as_a_plain_walk(pair):
    rng = random.Random(11)
    texts = [t for t in TOKEN_TEXTS if pair.encoded(t)[0]] + [
        " ".join("".join(rng.choices("abdeimnorst", k=rng.randint(1, 9))) for _ in range(n))
        for n in (1, 40, 400)]
    for text in texts:
        a, b = (np.array(ids) for ids in pair.encoded(text))
        a_ends, b_ends = (np.cumsum(sizes[ids]).tolist() for sizes, ids in (
            (pair.a_sizes, a), (pair.b_sizes, b)))
        groups = align.aligned(a_ends, b_ends)
        plain, done = [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            own = [",".join(str(t) for t, e in zip(ids, ends, strict=True) if done < e <= end)
                   for ids, ends in ((a, a_ends), (b, b_ends))]
            plain.append("|".join(own))
            done = end
        assert align._groups_text(a, b, groups, pair) == ";".join(plain)


def test_the_query_on_alignment_agrees_with_a_plain_version(spark, pair, tmp_path):
    rows = list(enumerate([None, "", *TOKEN_TEXTS, *TOKEN_TEXTS[:5]]))
    rows += [(None, "no id here"), (3, "twice the id"), (3, "twice the id")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    wanted, links = [], Counter()
    per_row = []
    for doc_id, text in rows:
        a, b = pair.encoded(text) if text else ([], [])
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in
                ((a, pair.a_bytes), (b, pair.b_bytes))]
        groups, own, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end), ends[1].index(end)
            groups.append(",".join(map(str, a[i:x + 1])) + "|" + ",".join(map(str, b[j:y + 1])))
            own.append((a[x], b[y]))
            i, j = x + 1, y + 1
        links.update(own)
        per_row.append((doc_id, len(a), len(b), groups, own))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    for doc_id, n_a, n_b, groups, own in per_row:
        wanted.append((doc_id if doc_id is not None else -1, n_a, n_b, len(groups), len(own),
                       sum(links[k] == most[k[1]] for k in own), sum(links[k] for k in own),
                       sha(";".join(groups)) if groups else ""))
    for limit in (align.BROADCAST_IDS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(align, "BROADCAST_IDS", limit)
            found = queries.token_alignment(spark, str(tmp_path)).collect()
        shown = sorted((r.doc_id if r.doc_id is not None else -1, *list(r)[1:]) for r in found)
        assert shown == sorted(wanted)


def test_alignment_of_an_empty_table(spark):
    assert align.cross_alignment(frame(spark, []), BYTE_FILE, PIECE_FILE).collect() == []


# --- repeated passages ---

def passages(seed: int, letters: int = 400):
    """Texts with shared passages around the window, copies, self-repeats and hot lines."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(letters)}" for _ in range(n)]
    shared = [some(n) for n in (34, 35, 36, 50, 90, 200)]
    line = some(40)
    texts = [None, "", "a b", "z " * 34, "y " * 35, "x " * 36, "éè " * 80, "k\x85k " * 50]
    for _ in range(60):
        words = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(shared)[rng.choice([0, 0, 5]):] + some(rng.randint(0, 30))
        if rng.random() < 0.5:
            words += line + some(rng.randint(0, 9))
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [texts[-1], texts[-1], texts[-2] + " more", " ".join(some(50) * 2)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


def shown(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed,
                   [tuple(x) for x in r.removed], r.kept) for r in df.collect())


@pytest.mark.parametrize("hot,shard,copies", [(1000, 500, 200), (3, 2, 1), (0, 10 ** 6, 200)])
def test_removed_words_are_those_of_the_definition(spark, monkeypatch, hot, shard, copies):
    monkeypatch.setattr(substrings, "COPIES", copies)
    rows = passages(11)
    found = substrings.without_repeats(frame(spark, rows).repartition(3), hot=hot, shard_segments=shard)
    wanted = sorted((i if i is not None else -1, *rest) for i, *rest in brute.without_repeats(rows, 35))
    assert shown(found) == wanted
    assert sum(r[2] > 0 for r in wanted) > 30


def test_small_windows_few_letters_and_shuffled_lists(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_VERDICTS", 0)
    monkeypatch.setattr(substrings, "BROADCAST_IDS", 0)
    monkeypatch.setattr("fleetvitals.llm.text.BROADCAST_IDS", 0)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(40)]
    found = substrings.without_repeats(frame(spark, rows), window=9, hot=20)
    assert shown(found) == sorted(brute.without_repeats(rows, 9))


def test_repeats_of_empty_and_single_tables(spark):
    assert substrings.without_repeats(frame(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(99))
    assert shown(substrings.without_repeats(frame(spark, [(1, text)]))) == [(1, 99, 0, [], text)]
    assert shown(substrings.without_repeats(frame(spark, [(1, text), (1, text)]))) == [
        (1, 99, 99, [(0, 99)], "")] * 2


def test_an_automaton_counts_occurrences():
    rng = random.Random(8)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        automaton = substrings.SuffixAutomaton()
        for words in sequences:
            automaton.add(words, 1)
        automaton.finish()
        windows = Counter(tuple(w[i:i + 5]) for w in sequences for i in range(len(w) - 4))
        for words in sequences:
            assert list(automaton.repeated_ends(words, 5)) == [
                i + 4 for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1]
