"""Quality by a generalised additive model with pairwise interactions.

Measures of a text are cut into bins at quantiles. Boosting goes round the measures again and again: each in turn gets a
shallow tree on what the others leave unexplained, added at a low rate to its lookup table; then the pairs of measures
that explain most of the rest get tables of their own in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, small, sums

MEASURES = (
    "words", "word_length", "distinct_words", "commonest_word", "repeated_next", "odd_ends", "no_letters", "upper_case",
    "digits", "signs", "beyond_ascii", "sentence_words", "line_words", "repeated_lines",
)
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, RATE, LEAST_ROWS = 250, 0.06, 10
CACHE = 400_000
LETTER = re.compile(r"[^\W\d_]")
ODD_END = re.compile(r"[^\w\s.,;:!?'\")\]…»]$")
#: Kinds of bytes: 1 upper case, 2 digit, 3 other ASCII sign, 4 part of a character beyond ASCII, 5 end of a sentence, 6 of a line, 7 lower case.
KIND = np.zeros(256, np.uint8)
KIND[[ord(c) for c in "!\"#$%&'()*+,-/:;<=>@[\\]^_`{|}~"]] = 3
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:], KIND[[ord(c) for c in ".?!"]], KIND[10] = 1, 7, 2, 4, 5, 6


class Measurer:
    """Rows of MEASURES of whole texts; an empty text's are zeros."""

    def __init__(self) -> None:
        self.words, self.traits = Words(), np.empty((0, 3))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.words.full(CACHE):
            self.__init__()
        if not texts:
            return np.empty((0, len(MEASURES)))
        numbers = [self.words.numbers(x.split()) for x in texts]
        fresh = [w.decode("utf-8", "replace") for w in self.words.take()]
        traits = [(len(w), ODD_END.search(w) is not None, LETTER.search(w) is None) for w in fresh]
        self.traits = np.concatenate([self.traits, np.array(traits, float).reshape(-1, 3)])
        flat, n = np.concatenate(numbers), np.array([len(x) for x in numbers], np.int64)
        length, odd, bare = (sums(self.traits[flat, k], n) for k in range(3))
        distinct, most, again, lines, twice = (np.zeros(len(texts)) for _ in range(5))
        for k, x in enumerate(numbers):
            if len(x):
                _, c = np.unique(x, return_counts=True)
                distinct[k], most[k], again[k] = len(c), c.max(), np.count_nonzero(x[1:] == x[:-1])
                own = [y for y in texts[k].split(b"\n") if y.strip()]
                lines[k], twice[k] = len(own), len(own) - len(set(own))
        sizes = np.array([len(x) for x in texts], np.int64)
        kinds = KIND[np.frombuffer(b"".join(texts), np.uint8)]
        upper, digits, signs, beyond, stops, lower = (sums(kinds == k, sizes) for k in (1, 2, 3, 4, 5, 7))
        share = lambda a, b: a / np.maximum(b, 1)
        return np.stack([
            np.log1p(n), share(length, n), share(distinct, n), share(most, n), share(again, n), share(odd, n), share(bare, n),
            share(upper, upper + lower), share(digits, sizes), share(signs, sizes), share(beyond, sizes),
            share(n, stops), share(n, lines), share(twice, lines),
        ], 1)


@dataclass
class Model:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        value = np.full(len(x), self.base)
        for k, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            value += t[np.searchsorted(cut, x[:, k], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            value += t[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of a tree of depth two over ordered bins, from their gradient, curvature and row sums."""

    def cut(a: int, b: int) -> int | None:
        gs, hs, ns = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
        better = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
        better = np.where((ns[:-1] >= LEAST_ROWS) & (ns[-1] - ns[:-1] >= LEAST_ROWS), better, 0)
        return a + 1 + int(better.argmax()) if len(better) and better.max() > 1e-9 else None

    leaves, out = [(0, len(g))], np.zeros(len(g))
    for _ in range(2):
        cuts = [(a, cut(a, b), b) for a, b in leaves]
        leaves = [part for a, c, b in cuts for part in ([(a, c), (c, b)] if c else [(a, b)])]
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best four-leaf tree over a grid, with one cut of each measure, and what it explains."""

    def corners(w: np.ndarray) -> list[np.ndarray]:
        """For each place of the two cuts, the sums of the four parts."""
        s = w.cumsum(0).cumsum(1)
        low, rows, cols = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
        return [low, rows - low, cols - low, s[-1, -1] - rows - cols + low]

    total = sum(_gain(a, b) for a, b in zip(corners(g), corners(h), strict=True))
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    out = np.zeros(g.shape)
    for a in (slice(0, i + 1), slice(i + 1, None)):
        for b in (slice(0, j + 1), slice(j + 1, None)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + 1.0)
    return out, float(total.max() - _gain(g.sum(), h.sum()))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labels y (0 or 1) given rows x of measures."""
    n, m = x.shape
    p = (y.sum() + 1) / (n + 2)
    cuts, pair_cuts = ([_cuts(x[:, k], b) for k in range(m)] for b in (BINS, PAIR_BINS))
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(pair_cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    value = np.full(n, np.log(p / (1 - p)))
    slopes = lambda: (y - (q := 1 / (1 + np.exp(-value))), q * (1 - q))
    for _ in range(ROUNDS):
        for k in range(m):
            g, h = slopes()
            size = len(tables[k])
            step = RATE * _shallow(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), np.bincount(bins[k], minlength=size))
            tables[k] += step
            value += step[bins[k]]
    shape = lambda i, j: (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        a, b = shape(i, j)
        return np.bincount(coarse[i] * b + coarse[j], w, a * b).reshape(a, b)

    g, h = slopes()
    able = [(i, j) for i, j in combinations(range(m), 2) if min(shape(i, j)) > 1]
    pairs = sorted(able, key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[1])[:PAIRS]
    pair_tables = [np.zeros(shape(*p)) for p in pairs]
    for _ in range(ROUNDS // 2):
        for k, (i, j) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[0]
            pair_tables[k] += step
            value += step[coarse[i], coarse[j]]
    return Model(cuts, float(np.log(p / (1 - p))), tables, pair_cuts, pairs, pair_tables)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    measure = Measurer()
    for batch in small(batches):
        rows = measure(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["quality", "measures"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    measure = Measurer()
    for batch in small(batches):
        p = model.score(measure(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def fit(docs: DataFrame, labels: DataFrame, most_per_label: int = 6000) -> Model:
    """Learns from docs (doc_id, text: binary) that have a label (doc_id, quality).

    From about most_per_label rows of either label at most, chosen by a hash of the id (a row of measures of each
    reaches the driver); where that leaves rows out, the base rate is set right again. A document with several labels
    has the lowest; null labels and ids are left out. Without rows of both labels every text gets the same score.
    """
    own = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    n = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    part = {k: min(1.0, most_per_label / max(1, n.get(k, 0))) for k in (0, 1)}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = F.broadcast(own.filter(place < F.when(F.col("quality") == 1, part[1]).otherwise(part[0])))  # 2 * most_per_label rows
    got = docs.join(sample, "doc_id").select("quality", "text").mapInArrow(_measured, "quality int, measures binary").collect()
    x = np.frombuffer(b"".join(r["measures"] for r in got)).reshape(-1, len(MEASURES))
    y = np.array([r["quality"] for r in got], float)
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return Model([], float(np.log(p / (1 - p))), [], [], [], [])
    model = boost(x, y)
    model.base += float(np.log(part[0] / part[1]))
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out=None, **bounds) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    held_out: a Column over doc_id; those rows' labels aren't learnt from. A null text is an empty one, whose measures
    are zeros. Rows that repeat an id, or have none, are scored each. Other columns, whatever their names, are not read.
    An empty table gives an empty result.
    """
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    model = fit(rows.filter(~F.col("held_out")).select("doc_id", "text"), labels.select("doc_id", "quality").filter(~held), **bounds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scored, model=model, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")
