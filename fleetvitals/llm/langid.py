"""Language identification by prediction by partial matching over bytes.

The context tree holds the byte sequences of up to four bytes that training texts show
often, a node's suffixes always with it. A language's statistics at a node give every
byte a probability: a byte seen after it by its count, the others share the escape
probability t / (n + t), n being what followed and t how many different bytes, by
their probabilities at the node's suffix, without those seen; below the root all bytes
are alike. Statistics are frozen after training, so the code length of a byte under
each language is a table look-up, the sum over a text its exact code length, and the
language with the shortest code is predicted.

The tree is an automaton: from a node a byte leads to the longest suffix that is a
node. Both tables are bounded by the number of contexts and sent to every executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.session import stored

from .text import as_list, fold, slices

ORDER = 4
FOLDS, HELD_OUT = 4, 2
# At most about so many texts are learnt from, dealt equally to languages where they have
# them and chosen by a hash of their id.
TRAIN_ROWS = 12_000
CONTEXTS = 8_000
# The texts of this part of the ids, in none of the folds held out, set the bounds of `limits`.
PARTS, BACK = 16, 5
# A text's bits a byte may lie so far over the middle of its language, or over what all but
# one in 1,000 have; a short text's by this much more, over the root of its bytes.
LEAST_OVER, QUANTILE, SHORT = 2.0, 0.999, 12.0
NONE = "und"
AT_ONCE = 1 << 19
_GRAMS = "lang string, gram long, n long"


@dataclass
class Model:
    """Tables over nodes and symbols; symbol 0 is a gap between texts, the last one any other byte."""

    langs: list[str]
    symbol: np.ndarray  # 256: byte to symbol
    goto: np.ndarray    # node * symbols + symbol to the next node, times symbols
    bits: np.ndarray    # node * symbols + symbol, language: code length


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): five bytes, packed into a number, and how often they follow each other.

    Before a text stand four zero bytes, so its first bytes are counted in short contexts.
    """
    schema = docs.sparkSession.createDataFrame([], _GRAMS).schema

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            by: dict[bytes, list[bytes]] = {}
            for lang, text in zip(*[as_list(c) for c in part.columns], strict=True):
                by.setdefault(lang, []).append(b"\0" * ORDER + text)
            for lang, own in by.items():
                for group in groups(own):
                    grams, n = np.unique(_grams(b"".join(group)), return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang.decode()] * len(grams)),
                        "gram": pa.array(grams), "n": pa.array(n)})

    found = docs.select("lang", "text").mapInArrow(count, schema)
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(texts: bytes) -> np.ndarray:
    """Every byte with the four before it, as one number; zero bytes end none."""
    codes = np.frombuffer(texts, np.uint8)
    grams = np.zeros(max(0, len(codes) - ORDER), np.int64)
    for place in range(ORDER + 1):
        grams = (grams << 8) | codes[place:len(codes) - ORDER + place]
    return grams[(grams & 255) != 0]


def _usable(docs: DataFrame) -> DataFrame:
    usable = docs.select("doc_id", "text", "lang").where(
        "lang is not null and text is not null and doc_id is not null")
    return usable.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def level(counts: list[int], rows: int) -> int:
    """The most texts a language may give so that all together give about `rows`, one at least."""
    left, found = rows, sorted(counts)
    for at, n in enumerate(found):
        fair = left // (len(found) - at)
        if n > fair:
            return max(1, fair)
        left -= n
    return max([1, *found])


def _drawn(usable: DataFrame, rows: int) -> DataFrame:
    """About `rows` texts at most, by hash of the id.

    Languages are counted first. One with fewer texts than an equal part of the rows gives
    all of them, and what it leaves goes to the others, which give equally many.
    """
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    most = level(list(counts.values()), rows)
    cut = {lang: 0.95 * most / n for lang, n in counts.items() if n > most}
    if not cut:
        return usable
    share = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])[F.col("lang")]
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003
    return usable.where(F.coalesce(drawn, F.lit(True)))


def fit(docs: DataFrame, contexts: int = CONTEXTS, train_rows: int = TRAIN_ROWS,
        hold_back: bool = False) -> Model:
    """Learn from texts with a lang, in folds other than 2, about `train_rows` of them at most.

    With `hold_back` the texts that `limits` uses are left out too.

    Of L languages each gives all its texts or `train_rows` / L at least. The `contexts`
    contexts of the largest share of their languages' bytes, summed over languages, become
    nodes, so a language counts alike however many texts it has. What comes to the driver
    is bounded by contexts times bytes times languages.
    """
    usable = _usable(docs)
    if hold_back:
        usable = usable.where(fold(F.col("doc_id"), PARTS) != BACK)
    usable = _drawn(usable, train_rows)
    grams = stored(_counted(usable), "grams")
    levels = None
    for order in range(ORDER + 1):
        mask = (1 << 8 * (order + 1)) - 1
        cut = grams.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(
            F.sum("n").alias("n")).withColumn("order", F.lit(order))
        # Contexts that reach before a text or over a zero byte in it are no contexts, at no
        # order, so that a context's suffixes are there wherever it is.
        for place in range(1, order + 1):
            cut = cut.where(F.shiftright("gram", 8 * place).bitwiseAND(255) != 0)
        levels = cut if levels is None else levels.unionByName(cut)
    levels = stored(levels.withColumn("context", F.shiftright("gram", 8)), "levels")
    # Whole numbers: no rounding of sums can set a context before its suffix.
    sizes = F.broadcast(levels.where("order = 0").groupBy("lang").agg(F.sum("n").alias("size")))
    each = levels.groupBy("order", "context", "lang").agg(F.sum("n").alias("n")).join(sizes, "lang")
    part = (F.col("n") / F.col("size") * F.lit(float(1 << 40))).cast("long")
    nodes = stored(each.groupBy("order", "context").agg(F.sum(part).alias("total")).orderBy(
        F.col("total").desc(), "order", "context").limit(contexts).select("order", "context"), "nodes")
    found = levels.join(nodes, ["order", "context"]).select(
        "order", "context", F.col("gram").bitwiseAND(255).cast("int").alias("byte"), "lang", "n")
    return _tables(found.toArrow())


def _tables(counts: pa.Table) -> Model:
    """The automaton and code lengths from counts by order, context, byte and language.

    Beside the code lengths the driver holds the counts as they came, those of one node as a
    table, and the probabilities of the nodes that are suffixes of others.
    """
    if not len(counts):
        return Model([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    orders, contexts, codes, times = (
        counts.column(c).to_numpy() for c in ("order", "context", "byte", "n"))
    own_langs = counts.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(own_langs.dictionary.to_pylist())
    lang_at = {lang: i for i, lang in enumerate(langs)}
    own_langs = np.array([lang_at[x] for x in own_langs.dictionary.to_pylist()])[
        own_langs.indices.to_numpy()]
    bytes_seen = np.unique(codes).astype(int)
    symbol = np.full(256, len(bytes_seen) + 1, np.int32)
    symbol[0] = 0
    symbol[bytes_seen] = np.arange(1, len(bytes_seen) + 1)
    size = len(bytes_seen) + 2
    # A context has 32 bits at most, so these sort by order, then context; the root is 0.
    keys = (orders.astype(np.int64) << 32) | contexts
    nodes = np.union1d(keys, [0])
    names = [(k >> 32, k & 0xFFFFFFFF) for k in nodes.tolist()]
    number = {name: i for i, name in enumerate(names)}
    rows = np.searchsorted(nodes, keys)
    by_node = np.argsort(rows, kind="stable")
    firsts = np.searchsorted(rows[by_node], np.arange(len(names) + 1))
    suffix = [0 if not o else number[(o - 1, c & ((1 << 8 * (o - 1)) - 1))] for o, c in names]
    lowers = set(suffix)
    chances: dict[int, np.ndarray] = {}
    bits = np.empty((len(names), size, len(langs)), np.float32)
    for node in range(len(names)):  # suffixes come first: they are shorter
        at = by_node[firsts[node]:firsts[node + 1]]
        n = np.zeros((size, len(langs)))
        np.add.at(n, (symbol[codes[at]], own_langs[at]), times[at])
        lower = chances[suffix[node]] if node else np.full((size, len(langs)), 1 / 256)
        seen, total = n > 0, n.sum(axis=0)
        kinds = seen.sum(axis=0)
        # At the root the other bytes are single ones of 256; elsewhere the suffix's total is 1.
        left = np.maximum(1 - np.where(seen, lower, 0).sum(axis=0), 1e-9)
        own = np.where(seen, n / np.maximum(total + kinds, 1),
                       kinds / np.maximum(total + kinds, 1) * lower / left)
        chance = np.where(total > 0, own, lower)
        if node in lowers:
            chances[node] = chance
        bits[node] = -np.log2(np.maximum(chance, 1e-12))
    bits[:, 0, :] = 0
    goto = np.zeros((len(names), size), np.int32)
    for node, (order, context) in enumerate(names):
        for at, byte in enumerate(bytes_seen.tolist(), 1):
            length, longer = order + 1, (context << 8) | byte
            if length > ORDER:
                length, longer = ORDER, longer & ((1 << 8 * ORDER) - 1)
            while length and (length, longer) not in number:
                length -= 1
                longer &= (1 << 8 * length) - 1
            goto[node, at] = number[(length, longer)] if length else 0
    return Model(langs, symbol, (goto * size).ravel(), bits.reshape(-1, len(langs)))


def code_lengths(texts: list[bytes], model: Model) -> np.ndarray:
    """Bits of each text (row) under each language (column). Zero bytes cost nothing and end contexts."""
    gap = b"\0" * ORDER
    starts = np.cumsum([ORDER] + [len(t) + ORDER for t in texts])
    codes = model.symbol[np.frombuffer(gap + gap.join(texts) + gap, np.uint8)]
    ends = starts[:-1] + [len(t) for t in texts]
    sums = np.zeros((len(texts), len(model.langs)))
    for first in range(ORDER, len(codes), AT_ONCE):
        last = min(first + AT_ONCE, len(codes))
        at = np.zeros(last - first, np.int32)
        for back in range(ORDER, 0, -1):
            at = model.goto[at + codes[first - back:last - back]]
        total = np.cumsum(model.bits[at + codes[first:last]], axis=0, dtype=np.float64)
        total = np.vstack([np.zeros((1, total.shape[1])), total])
        a, b = np.clip(starts[:-1], first, last) - first, np.clip(ends, first, last) - first
        sums += total[b] - total[a]
    return sums


def allowance(n_bytes: Column) -> Column:
    """Bits a byte that a text of so many bytes may lie over the bound of long ones."""
    return F.lit(SHORT) / F.sqrt(F.greatest(n_bytes, F.lit(1)))


def limits(docs: DataFrame, model: Model) -> dict[str, float]:
    """Bits a byte up to which a long text is in a language, from all texts held back from learning.

    A language none of whose texts was held back has the largest bound of the others;
    if no text at all was, there is no bound. What comes to the driver is a row a language.
    """
    back = _usable(docs).where(fold(F.col("doc_id"), PARTS) == BACK)
    found = judged(back, model, keep=("lang",)).where("lang = lang_pred and n_bytes > 0")
    rate = F.col("bits") / F.col("n_bytes")
    rows = found.groupBy("lang").agg(
        F.percentile_approx(rate, 0.5).alias("middle"),
        F.percentile_approx(rate - allowance(F.col("n_bytes")), QUANTILE).alias("high")).collect()
    known = {r.lang: max(LEAST_OVER * r.middle, r.high) for r in rows}
    return {lang: known.get(lang, max(known.values())) for lang in model.langs} if known else {}


_models: dict[str, Model] = {}


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, bits, n_bytes) of every row of `docs`, whole texts.

    `keep` adds its columns. `bits` is the code length under the predicted language,
    `n_bytes` the number of bytes it is of, zero bytes not counted.

    The score is the probability of the predicted language if all were equally likely
    before. Texts that are null or have no letter, and all texts if no language was
    learnt, are "und" with score 0. Repeated rows come out as often as they went in.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    names = list(dict.fromkeys([id_col, text_col, *keep]))
    shown = [n for n in names if n != text_col or n in keep]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in shown)
    schema = docs.sparkSession.createDataFrame([], f"{schema}, lang_pred string, score double, bits double, n_bytes long").schema

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _models.get(name)
        if own is None:
            _models.clear()
            own = _models[name] = sent.value
        for part in slices(parts):
            texts = [t or b"" for t in as_list(part.column(text_col))]
            langs, scores, bits = [], [], []
            for group in groups(texts):
                found = _predicted(group, own)
                langs += found[0]
                scores += found[1]
                bits += found[2]
            sizes = [len(t) - t.count(0) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in shown], pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(bits, pa.float64()),
                 pa.array(sizes, pa.int64())],
                names=[*shown, "lang_pred", "score", "bits", "n_bytes"])

    return docs.select(*names).mapInArrow(judge, schema)


def groups(texts: list[bytes]) -> list[list[bytes]]:
    """The texts in order, in groups of about AT_ONCE bytes."""
    groups, size = [], AT_ONCE
    for text in texts:
        if size >= AT_ONCE:
            groups.append([])
            size = 0
        groups[-1].append(text)
        size += len(text) + ORDER
    return groups


def _predicted(texts: list[bytes], model: Model) -> tuple[list[str], list[float], list[float]]:
    if not model.langs:
        return [NONE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    bits = code_lengths(texts, model)
    best = bits.argmin(axis=1)
    over = bits - bits.min(axis=1, keepdims=True)
    score = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
    letters = [has_letter(t) for t in texts]
    return ([model.langs[b] if ok else NONE for b, ok in zip(best.tolist(), letters, strict=True)],
            [s if ok else 0.0 for s, ok in zip(score.tolist(), letters, strict=True)],
            bits.min(axis=1).tolist())
