"""Plain versions of the operators, and a small corpus with the cases that matter."""

from __future__ import annotations

import random
import re
from itertools import combinations

ODD_TEXTS = [None, "", "   \n\t", "one", "one two three", "One TWO three", "... !!! ---",
             "éè über naïve café", "a b c\x1cd\u0085e", "\U0001f600 你好 привет",
             "<|endoftext|> in <|startoftext|>text", "it's we'll I'M don'T  two  blanks \n\n lines ",
             "x" * 5000, "word " * 3000, "0123456789 12½ 3² İstanbul"]


def corpus(seed: int = 7, groups: int = 12) -> list[tuple[int, str | None]]:
    """(doc_id, text): odd texts, copies, near copies at and around 0.75, chains of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    texts = list(ODD_TEXTS)
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(8, 120))]
        texts += [" ".join(base), " ".join(base), " ".join(base).upper()]
        for _ in range(rng.randint(1, 8)):
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = word()
            if rng.random() < 0.5:
                changed += [word() for _ in range(rng.randint(1, 9))]
            texts.append(" ".join(changed))
            base = changed if rng.random() < 0.4 else base
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * i + 3, texts[at]) for i, at in enumerate(order)]


def shingles(text: str | None) -> set[tuple[str, ...]]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (number of shingles, smallest id reached)."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def contamination(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, list]:
    own, hit, named = words(text), set(), set()
    for item, item_text in items:
        other = words(item_text)
        for at in range(max(1, len(other) - 9) if other else 0):
            window = other[at:at + 10]
            for i in range(len(own) - len(window) + 1):
                if own[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    named.add(item)
    return len(own), len(hit), sorted(named)


def blank_words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, lag by lag."""
    n, runs = len(words), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            start = i
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(12, 2 * q):
                part = words[start - q:i]
                if all(part[d:] != part[:-d] for d in range(1, q)):
                    runs.append((start - q, length, q))
            i += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def without_repeats(rows: list[tuple[int, str | None]], window: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, removed spans, kept text) of every row."""
    split = [(i, blank_words(t)) for i, t in rows]
    seen: dict[tuple, int] = {}
    for _, own in split:
        for at in range(len(own) - window + 1):
            key = tuple(own[at:at + window])
            seen[key] = seen.get(key, 0) + 1
    found = []
    for i, own in split:
        gone = [False] * (len(own) + 1)
        for at in range(len(own) - window + 1):
            if seen[tuple(own[at:at + window])] > 1:
                gone[at:at + window] = [True] * window
        spans, start = [], None
        for at, g in enumerate(gone):
            if g and start is None:
                start = at
            elif not g and start is not None:
                spans.append((start, at))
                start = None
        found.append((i, len(own), sum(gone), spans,
                      " ".join(w for w, g in zip(own, gone[:-1], strict=True) if not g)))
    return found
