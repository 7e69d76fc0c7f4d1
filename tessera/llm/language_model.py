"""Language-model scoring: a log-bilinear neural model with noise-contrastive estimation, over counts of the whole corpus.

The commonest words, the end of a text and classes of all other words, by their last two bytes, are the symbols. The
vector of the next symbol is predicted from those of the last two; a symbol's score is the product with its own vector
and a bias. Training goes in rounds: in each, every task goes on from the same parameters over the symbols of its own
texts, telling them from noise drawn by frequency, and the tasks' parameters are averaged by the tokens behind them. So
more texts mean more steps behind each average. Batched matrix products over all contexts give each its normaliser, so
token probabilities add up to one; "any other word" is shared out by the words' counts in all training texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, portions, small, sums, written

#: Symbols: CLASSES of other words, the end of a text (and what precedes its first word), then the commonest words.
CLASSES = 61
END = CLASSES
WIDTH, NOISE, BATCH, ROUNDS, RATE = 24, 64, 2048, 3, 0.15
#: Words with at least a HOT-th of all tokens are known to every task: HOT words at most. The others are joined by the word.
HOT = 1_000_000
#: Distinct words or symbol triples a task gathers before it hands them on or puts them together.
GATHER = 400_000
#: Triples that are written as one row: as rows of their own they would cost Spark more than the training.
PACKED = 100_000
#: A task's parameters as a row.
TRAINED = "part long, tokens double, parameters binary"


@dataclass
class Vocabulary:
    hot: dict[bytes, int]  # number of each word that every task knows
    counts: np.ndarray  # by number
    symbols: np.ndarray  # by number
    noise: np.ndarray  # probability of each symbol
    tokens: int  # all training tokens
    types: int  # distinct ones
    other_tokens: np.ndarray  # by class, without the commonest words
    other_types: np.ndarray
    texts: int

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers (-1: not known to every task) and symbols."""
        number = np.fromiter(map(self.hot.get, words, repeat(-1)), np.int64, len(words))
        symbol = np.append(self.symbols, np.int32(0))[number]
        rare = np.flatnonzero(number < 0)
        symbol[rare] = np.fromiter((word_class(words[k]) for k in rare), np.int32, len(rare))
        return number, symbol


def _laid_out(texts: list[bytes], v: Vocabulary) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts together: words, how many each text has, their numbers and symbols, and the (last but one, last, next)
    symbols of all tokens, a row each; a text has one token more than words."""
    words: list[bytes] = []
    n = np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.lower().split()
        words += own
        n[k] = len(own)
    number, symbol = v.of(words)
    begin = np.cumsum(n + 3) - (n + 3)  # two ends before a text and one after it
    s = np.full(int((n + 3).sum()), END, np.int64)
    s[np.arange(len(words)) + np.repeat(begin + 2 - (np.cumsum(n) - n), n)] = symbol
    at = np.arange(int((n + 1).sum())) + np.repeat(begin + 2 - (np.cumsum(n + 1) - (n + 1)), n + 1)
    return words, n, number, symbol, np.stack([s[at - 2], s[at - 1], s[at]])


def word_class(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big") % CLASSES


def class_of(word: Column) -> Column:
    """word_class() in SQL."""
    return (F.conv(F.hex(F.substring(word, -2, 2)), 16, 10).cast("int") % CLASSES).alias("class")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return rows

    for batch in small(batches):
        for text in batch.column("text").to_pylist():
            counts.update(text.lower().split())
        if len(counts) > GATHER:
            yield out()
    yield out()


def vocabulary(counts: DataFrame, n_texts: int, most_symbols: int) -> Vocabulary:
    other_tokens, other_types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy(class_of(F.col("word"))).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        other_tokens[r["class"]], other_types[r["class"]] = r["c"], r["n"]
    tokens, types = int(other_tokens.sum()) + n_texts, int(other_types.sum()) + (n_texts > 0)
    rows = sorted(((bytes(r["word"]), r["c"]) for r in counts.filter(F.col("c") >= tokens / HOT).collect()), key=lambda r: (-r[1], r[0]))
    c = np.array([n for _, n in rows], np.int64)
    short = min(most_symbols, len(rows))
    symbols = np.array([END + 1 + k if k < short else word_class(w) for k, (w, _) in enumerate(rows)], np.int32)
    for w, n in rows[:short]:
        other_tokens[word_class(w)] -= n
        other_types[word_class(w)] -= 1
    noise = np.concatenate([other_tokens + 1, [n_texts + 1], c[:short] + 1]).astype(float)
    return Vocabulary({w: k for k, (w, _) in enumerate(rows)}, c, symbols, noise / noise.sum(), tokens, types, other_tokens, other_types, n_texts)


def start(v: Vocabulary) -> list[np.ndarray]:
    """Vectors of context symbols and of predicted ones, weights of the last and the last but one, biases; then, for each
    of these, the sums of squared slopes that its steps are divided by."""
    rng, n = np.random.default_rng(7), len(v.noise)
    p = [rng.normal(0, 0.1, (n, WIDTH)), rng.normal(0, 0.1, (n, WIDTH)), np.ones(WIDTH), np.ones(WIDTH) * 0.5, np.log(v.noise)]
    return [x.astype(np.float32) for x in (*p, *(np.full_like(x, 1e-3) for x in p))]


def _by_row(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal rows together, where each begins in it, and which row that is; most: over the largest."""
    order = np.argsort(rows.astype(np.int16) if most <= 1 << 15 else rows, kind="stable")  # short numbers are sorted by digit
    own = rows[order]
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    return order, begin, own[begin]


def _add_rows(to: np.ndarray, by: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray) -> None:
    """Adds each of values to its row of `to`; a row may be named several times."""
    order, begin, rows = by
    to[rows] += np.add.reduceat(values[order], begin, axis=0)


def train(state: list[np.ndarray], triples: np.ndarray, weight: np.ndarray, noise: np.ndarray, seed: int) -> None:
    """Noise-contrastive estimation over distinct (last but one, last, next) with their counts, each once; changes state."""
    p, size = state[:5], state[5:]
    context, target, near, far, bias = p
    rng, grads = np.random.default_rng(seed), [np.zeros_like(x) for x in p]
    log_noise, shares = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
    order = rng.permutation(len(triples))
    for k in range(0, len(order), BATCH):
        rows = order[k : k + BATCH]
        u, v, w = triples[rows].T
        part = (weight[rows] / weight[rows].sum()).astype(np.float32)
        drawn = np.minimum(np.searchsorted(shares, rng.random(NOISE)), len(noise) - 1)
        of_v, of_u, of_w, of_drawn = context[v], context[u], target[w], target[drawn]
        made = of_v * near + of_u * far
        true = np.einsum("ij,ij->i", made, of_w) + bias[w] - log_noise[w]
        a = part / (1 + np.exp(np.clip(true, -30, 30)))  # what raises the true scores
        false = made @ of_drawn.T + (bias[drawn] - log_noise[drawn])
        b = np.negative(np.clip(false, -30, 30, out=false), out=false)
        np.exp(b, out=b)
        b += 1
        np.divide(-part[:, None], b, out=b)  # what lowers those of noise
        of_made = a[:, None] * of_w + b @ of_drawn
        for g in grads:
            g.fill(0)
        predicted = _by_row(np.concatenate([w, drawn]), len(noise))
        _add_rows(grads[1], predicted, np.concatenate([a[:, None] * made, b.T @ made]))
        _add_rows(grads[4], predicted, np.concatenate([a, b.sum(0)]))
        _add_rows(grads[0], _by_row(np.concatenate([v, u]), len(noise)), np.concatenate([of_made * near, of_made * far]))
        grads[2][:], grads[3][:] = (of_made * of_v).sum(0), (of_made * of_u).sum(0)
        for x, s, g in zip(p, size, grads, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)


def _together(codes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(place, np.concatenate(weights), len(code)).astype(np.int64)


def _triples(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """text -> codes of its (last but one, last, next) symbols, as steps from the one before, and their counts, PACKED of them
    in a row; a code may come again."""
    n, codes, pending = len(v.noise), [], 0

    def out() -> pa.RecordBatch:
        code, weight = _together(codes, [np.ones(len(c)) for c in codes])
        codes.clear()
        parts = range(0, len(code), PACKED)
        packed = [[np.diff(code[k : k + PACKED], prepend=0).astype("<i8").tobytes() for k in parts], [weight[k : k + PACKED].astype("<i8").tobytes() for k in parts]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in packed], names=["code", "weight"])

    for batch in portions(batches, "text"):
        u, last, w = _laid_out(batch.column("text").to_pylist(), v)[-1]
        codes.append((u * n + last) * n + w)
        pending += len(w)
        if pending > 4 * GATHER:
            yield out()
            pending = 0
    if codes:
        yield out()


def _trained(batches: Iterator[pa.RecordBatch], state: list[np.ndarray], noise: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """code, weight -> one row: the task's parameters, and the tokens behind them."""
    n, tokens, codes, weights, pending = len(noise), 0, [], [], 0
    state, task = [x.copy() for x in state], TaskContext.get().partitionId()

    def learn() -> None:
        nonlocal pending
        code, weight = _together(codes, weights)
        codes.clear()  # before what training takes itself
        weights.clear()
        triples = np.empty((len(code), 3), np.int32)
        for c, own in enumerate((code // (n * n), code // n % n, code % n)):
            triples[:, c] = own
        del code, own
        train(state, triples, weight, noise, seed * 1_000_003 + task)
        pending = 0

    for batch in batches:
        for code, weight in zip(batch.column("code"), batch.column("weight"), strict=True):
            codes.append(np.cumsum(np.frombuffer(code.as_py(), "<i8")))
            weights.append(np.frombuffer(weight.as_py(), "<i8"))
            pending, tokens = pending + len(codes[-1]), tokens + int(weights[-1].sum())
            if pending > 2 * GATHER:
                learn()
    if pending:
        learn()
    if tokens:
        flat = np.concatenate([x.ravel() for x in state]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([float(tokens)]), pa.array([flat.tobytes()], pa.binary())], names=["part", "tokens", "parameters"])


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "tokens"])
    total = sum(t * np.frombuffer(x, "<f4").astype(float) for t, x in zip(rows["tokens"], rows["parameters"], strict=True))
    return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "tokens": [rows["tokens"].sum()], "parameters": [(total / rows["tokens"].sum()).astype("<f4").tobytes()]})


def fit(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The parameters after some rounds of training in every task and averaging, 64 tasks' at a time until few are left."""
    triples = written(texts.mapInArrow(partial(_triples, v=v), "code binary, weight binary"), "triples")
    state = start(v)
    ends = np.cumsum([x.size for x in state])
    for k in range(rounds):
        rows = written(triples.mapInArrow(partial(_trained, state=state, noise=v.noise, seed=k), TRAINED), "parameters")
        while (n := rows.count()) > 64:
            rows = written(rows.withColumn("part", F.pmod("part", F.lit(max(1, n // 64)))).groupBy("part").applyInPandas(_mean, TRAINED), "parameters")
        got = rows.collect()
        if not got:
            break
        flat = np.frombuffer(_mean(pd.DataFrame([r.asDict() for r in got]))["parameters"][0], "<f4")
        state = [flat[e - x.size : e].reshape(x.shape).copy() for x, e in zip(state, ends, strict=True)]
    discard(triples)
    return [x.astype(float) for x in state[:5]]


@dataclass
class Tables:
    """Parts of a symbol's log10 probability: by the last symbol, by the last but one, and the normaliser of both."""

    near: np.ndarray
    far: np.ndarray
    normal: np.ndarray

    @staticmethod
    def of(p: list[np.ndarray]) -> Tables:
        context, target, near, far, bias = p
        by_near, by_far = (context * near) @ target.T + bias, (context * far) @ target.T
        normal = np.empty((len(bias), len(bias)))
        for u in range(len(bias)):  # a batch of contexts: all last symbols after one
            x = by_near + by_far[u]
            top = x.max(1)
            normal[u] = top + np.log(np.exp(x - top[:, None]).sum(1))
        return Tables(*((x / np.log(10)).astype(np.float32) for x in (by_near, by_far, normal)))


def _scored(batches: Iterator[pa.RecordBatch], v: Vocabulary, t: Tables) -> Iterator[pa.RecordBatch]:
    """What a task knows of each text's scores, and the words and their counts that it doesn't know."""
    logs = np.append(np.log10(v.counts + 1.0), 0.0)
    shared = np.zeros(len(v.noise))  # what a class's words share its probability by
    shared[:CLASSES] = np.log10(v.other_tokens + v.other_types + 1.0)
    row = TaskContext.get().partitionId() << 36
    for batch in portions(batches, "text"):
        words, n, number, symbol, (u, last, w) = _laid_out(batch.column("text").to_pylist(), v)
        score = sums(t.near[last, w] + t.far[u, w] - t.normal[u, last], n + 1) - sums(shared[w], n + 1)
        score += sums(np.where(symbol < CLASSES, logs[number], 0.0), n)
        base = sums(logs[number], n) + np.log10(v.texts + 1.0)
        known = sums(number >= 0, n).astype(np.int64) + (v.texts > 0)
        ends = np.cumsum(n)
        unknown = np.flatnonzero(number < 0)
        cut = np.searchsorted(unknown, np.append(0, ends)).tolist()
        rare = [Counter([words[i] for i in unknown[a:b].tolist()]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        out = [(row + 1 + k, *x, list(r), list(r.values())) for k, (*x, r) in enumerate(zip((n + 1).tolist(), known.tolist(), base.tolist(), score.tolist(), rare, strict=True))]
        row += len(out)
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "model", "words", "times"])


def score(docs: DataFrame, held_out=None, most_symbols: int = 640) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words, A-Z lower-cased, and one end. Texts that aren't held_out (a Column over doc_id; none:
    no text) are learnt from. A null text is an empty one: its end only. Rows that repeat an id, or have none, are
    scored each. With nothing to learn from, every token has the same probability. Columns other than doc_id and text
    are not read. An empty table gives an empty result.
    """
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    known = rows.filter(~F.col("held_out"))
    counts = written(known.select("text").mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    v = vocabulary(counts, known.count(), most_symbols)
    tables = Tables.of(fit(known.select("text"), v))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = written(rows.mapInArrow(partial(_scored, v=v, t=tables), f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, model double, words array<binary>, times array<long>"), "scored")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts.filter(F.col("c") < v.tokens / HOT), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("times").alias("known"))
    out = parts.drop("words", "times").join(found, "row", "left")
    logs, all_ = F.coalesce("logs", F.lit(0.0)), float(np.log10(v.tokens + v.types + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * all_).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
