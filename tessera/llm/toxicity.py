"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings sums the subsequences of three letters that they share, the lesser weight of both; each
skipped letter multiplies a weight by DECAY. So a word that holds an insult with inserted letters, signs or gaps stays similar to it.
Landmarks are the words and word beginnings that set the labelled toxic texts apart. The machine, with squared hinge
loss over similarities whitened by the landmarks' own kernel matrix, learns from the words of labelled sentences; the
decision values of a text's words, the largest and the sum of those over zero, become a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, small, written

#: Weight of a skipped letter, the furthest that a subsequence reaches, the power that the similarity is raised to.
DECAY, REACH, DEGREE = 0.6, 5, 4
#: Letters of a string that the kernel sees at a time, word beginnings that can be landmarks, the least similarity that counts.
LONGEST, BEGINNINGS, LEAST = 24, range(3, 9), 0.4
#: Letters from one of a long word's strings to the next, letters of a token that is joined with its neighbours.
STEP, SHORT = 12, 3
#: The similarity, before the power, from which a word of a toxic text is taken to hold the landmark.
HOLDS = 0.95
#: Nats that the label counts of a string must give before it can be a landmark.
EVIDENCE = 11.5
#: Words whose numbers a task remembers, and those compared at a time.
CACHE, PART = 250_000, 8192
#: A text's share of the evidence, in whole numbers, so that sums don't depend on their order; near copies divide it.
SHARE = 1 << 20
#: Similarities (of strings with landmarks) in memory at a time in a task, and at most those the machine learns from:
#: where there would be more, from the words that are most like a landmark.
CELLS, MOST_CELLS = 1 << 21, 1 << 24
#: The most letters in landmarks for which their subsequences are looked up in a table of all.
DENSE = 128
NOT_LETTER = re.compile(r"[\W\d_]+")
#: Signs that most often stand around a word of letters only.
SIGNS = ".,;:!?\"'()"


def pieces(word: bytes) -> list[str]:
    """A word as the kernel sees it: letters in lower case, after a mark where the word or what follows a sign begins.

    Each of these beginnings goes on over the signs after it. Strings that overlap reach to the end of a long word.
    """
    text = word.decode("utf-8", "replace").lower()
    plain = text.strip(SIGNS)
    if plain.isalpha() and len(plain) <= LONGEST:
        return ["^" + plain]
    parts = [p for p in NOT_LETTER.split(text) if p]
    whole, begin = "".join(parts), [0]
    for p in parts[:-1]:
        begin.append(begin[-1] + len(p))
    inner = set(range(STEP, len(whole) - STEP, STEP)).difference(begin) if len(whole) > LONGEST else ()
    marked = ["^" + whole[k : k + LONGEST] for k in begin if k == 0 or k + 3 <= len(whole)]
    return list(dict.fromkeys([*marked, *(whole[k : k + LONGEST] for k in sorted(inner))]))


def _subsequences(strings: list[str], number: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to skip letters: (string's number, code of the three letters, weight). number: of each letter by code point."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    known = number[np.minimum(codes, len(number) - 1)]
    owner = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    for j in range(2, REACH + 1):
        same = np.flatnonzero(owner[j:] == owner[:-j])
        if not len(same):
            continue
        first, last = known[same], known[same + j]
        for i in range(1, j):
            middle = known[same + i]
            ok = (first > 0) & (middle > 0) & (last > 0)
            yield owner[same[ok]], (first[ok] * size + middle[ok]) * size + last[ok], DECAY ** (j - 2)


class Kernel:
    """Similarities of words with landmarks: the share of a landmark's subsequences, by weight, that the word has, to DEGREE."""

    def __init__(self, landmarks: list[str]) -> None:
        alphabet = sorted({c for s in landmarks for c in s})
        self.size = len(alphabet) + 1
        self.number = np.zeros(max([ord(c) for c in alphabet], default=0) + 2, np.int64)
        for k, c in enumerate(alphabet):
            self.number[ord(c)] = k + 1
        self.m = m = len(landmarks)
        found = list(_subsequences(landmarks, self.number, self.size)) if m else []
        # a subsequence occurs in few landmarks: for each, where its entries begin, their landmarks and weights
        keys = np.concatenate([code * m + own for own, code, _ in found] or [np.empty(0, np.int64)])
        entries, place = np.unique(keys, return_inverse=True)
        self.weight = np.bincount(place, np.concatenate([np.full(len(own), weight) for own, _, weight in found] or [np.empty(0)]), len(entries))
        self.landmark = entries % max(m, 1)
        self.code, self.begin, count = np.unique(entries // max(m, 1), return_index=True, return_counts=True)
        self.count = np.append(count, 0)  # the last one: of a subsequence in no landmark
        self.begin = np.append(self.begin, 0)
        self.own = np.maximum(np.bincount(self.landmark, self.weight, m), 1e-9)
        self.dense = None
        if self.size <= DENSE:
            self.dense = np.full(self.size**3, len(self.code), np.int32)
            self.dense[self.code] = np.arange(len(self.code))

    def gram(self) -> np.ndarray:
        """The similarities of the landmarks with each other, made symmetric."""
        shared = np.zeros((self.m, self.m))
        for begin, count in zip(self.begin[:-1], self.count[:-1], strict=True):
            own, weight = self.landmark[begin : begin + count], self.weight[begin : begin + count]
            shared[np.ix_(own, own)] += np.minimum.outer(weight, weight)
        return (shared / np.sqrt(np.outer(self.own, self.own))) ** DEGREE

    def _rows(self, code: np.ndarray) -> np.ndarray:
        """The number of each subsequence's entries; the last one for those in no landmark."""
        if self.dense is not None:
            return self.dense[code]
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, at, len(self.code))

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the strings with a similarity of LEAST or more (before the power), and their similarities."""
        parts = list(self.parts(strings))
        return np.concatenate([which for which, _ in parts]), np.concatenate([rows for _, rows in parts])

    def parts(self, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for some strings after others: the more landmarks, the fewer at a time."""
        part = max(1, min(PART, CELLS // max(self.m, 1)))
        for k in range(0, max(1, len(strings)), part):
            which, rows = self._part(strings[k : k + part])
            yield k + which, rows

    def _part(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m, keys, weights = self.m, [], []
        for own, code, weight in _subsequences(strings, self.number, self.size) if strings and m else ():
            hit = self._rows(code) < len(self.code)
            keys.append(own[hit] * self.size**3 + code[hit])
            weights.append(np.full(len(keys[-1]), weight))
        if not keys:
            return np.empty(0, np.int64), np.empty((0, m), np.float32)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(place, np.concatenate(weights), len(key))
        own, row = key // self.size**3, self._rows(key % self.size**3)
        count = self.count[row]
        entry = np.repeat(self.begin[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.minimum(np.repeat(weight, count), self.weight[entry])
        out = np.bincount(np.repeat(own, count) * m + self.landmark[entry], both, len(strings) * m).reshape(len(strings), m) / self.own
        good = np.flatnonzero(out.max(1) >= LEAST)
        return good, (out[good] ** DEGREE).astype(np.float32)


class Reader:
    """Numbers of the words in whole texts; short tokens in a row, whatever signs are between, count as one word more."""

    def __init__(self) -> None:
        self.words, self.strings, self.size = Words(), [], np.empty(0, np.int64)  # strings: of each word
        self.joined: dict[bytes, bytes] = {}
        self.total = 0

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [x.split() for x in texts]
        numbers = [self.words.numbers(x) for x in split]
        self._learn()
        for k, n in enumerate(numbers):
            place = np.flatnonzero(self.size[n])
            size = self.size[n[place]]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], size <= SHORT, [False]]).astype(np.int8)))
            runs = []
            for a, b in edge.reshape(-1, 2):
                if b - a > 1:
                    key = n[place[a:b]].tobytes()
                    if key not in self.joined:
                        self.joined[key] = b" ".join(split[k][i] for i in place[a:b])
                    runs.append(self.joined[key])
            if runs:
                numbers[k] = np.concatenate([n, self.words.numbers(runs)])
        self._learn()
        return numbers

    def _learn(self) -> None:
        fresh = self.words.take()
        made = list(map(pieces, fresh))
        self.strings += made
        self.total += sum(map(len, made))
        # letters, without the mark: up to LONGEST of them, but only whether there are SHORT or none matters
        self.size = np.concatenate([self.size, np.fromiter((len(own[0]) - 1 for own in made), np.int64, len(made))])


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on a word's similarities: the machine's weights times the whitening
    bias: float
    line: np.ndarray  # of a text's log odds: on its most toxic word's value, on all of its toxic words, and alone
    base: float  # the score of a text none of whose words is similar to a landmark


class Scanner:
    """The value of the most toxic word of each whole text (NaN: none is similar to a landmark), and the log of 1 plus
    the sum of the toxic words' values."""

    def __init__(self, model: Model) -> None:
        self.model, self.kernel = model, Kernel(model.landmarks)
        self.forget()

    def forget(self) -> None:
        self.reader, self.value = Reader(), np.empty(0, np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.reader.total > CACHE:
            self.forget()
        numbers = self.reader(texts)
        fresh = self.reader.strings[len(self.value) :]
        value = np.full(len(fresh), np.nan, np.float32)
        owner = np.repeat(np.arange(len(fresh)), [len(p) for p in fresh])
        for which, rows in self.kernel.parts([s for p in fresh for s in p]):
            np.fmax.at(value, owner[which], rows @ self.model.weights + np.float32(self.model.bias))  # a word's most toxic string
        self.value = np.concatenate([self.value, value])
        out = np.full((len(texts), 2), np.nan)
        for k, n in enumerate(numbers):
            v = self.value[n]
            v = v[~np.isnan(v)]
            if len(v):
                out[k] = v.max(), np.log1p(np.maximum(v, 0).sum(dtype=float))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = self(texts)
        p = 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.model.line, -30, 30)))
        return np.where(np.isnan(x[:, 0]), self.model.base, p)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, share, text -> string, shares of the texts that have it by label; string: a word (with a mark for its end) or a beginning."""
    reader, index, of_word = Reader(), Words(), []
    totals = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in small(batches):
        for toxic, share, n in zip(batch.column("toxic").to_pylist(), batch.column("share").to_pylist(), reader(batch.column("text").to_pylist()), strict=True):
            for word in reader.strings[len(of_word) :]:
                of_word.append(np.unique(index.numbers([x for s in word if len(s) > 3 for x in (s + "$", *(s[: k + 1] for k in BEGINNINGS if k < len(s) and s[0] == "^"))])))
            if len(index) > len(totals[0]):
                totals = [np.concatenate([t, np.zeros(len(index) - len(t) + 100_000, np.int64)]) for t in totals]
            if len(n):
                totals[toxic][np.unique(np.concatenate([of_word[i] for i in np.unique(n)]))] += share
    strings = list(index)
    for k in range(0, len(strings), 50_000):
        part = strings[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array(t[k : k + len(part)]) for t in (totals[1], totals[0]))], names=["string", "toxic", "clean"])


def _similar(batches: Iterator[pa.RecordBatch], landmarks: list[str]) -> Iterator[pa.RecordBatch]:
    """Those of the counted words that are similar to a landmark."""
    kernel = Kernel(landmarks)
    for batch in small(batches):
        for which, _ in kernel.parts([w.rstrip("$") for w in batch.column("string").to_pylist()]):
            yield batch.take(pa.array(which))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    scan = Scanner(model)
    for batch in small(batches):
        p = scan.score(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names[:2], "score", "predicted"])


def _told(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scan = Scanner(model)
    for batch in small(batches):
        x = scan(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("share"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "share", "most", "all"])


def _cleaned(batches: Iterator[pa.RecordBatch], model: Model, threshold: float, text_at: int) -> Iterator[pa.RecordBatch]:
    scan = Scanner(model)
    for batch in small(batches):
        yield batch.filter(pa.array(scan.score([(x or "").encode() for x in batch.column(text_at).to_pylist()]) < threshold))


def machine(z: np.ndarray, toxic: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine with squared hinge loss: Newton's method over the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    y, w = np.where(toxic > 0, 1.0, -1.0), np.zeros(x.shape[1])
    keep = np.eye(len(w)) / cost
    keep[-1, -1] = 1e-3  # the bias is hardly held back
    active = np.ones(len(y), bool)
    for _ in range(50):
        a = x[active] * weight[active, None]
        w = np.linalg.solve(keep + a.T @ x[active], a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def odds_line(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the log odds of label 1 given rows x, with Platt's targets: logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    n1, n0 = (weight * toxic).sum(), (weight * (1 - toxic)).sum()
    t = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    keep = 1e-3 * np.eye(x.shape[1])
    loss = lambda v: float(np.sum(weight * (np.logaddexp(0, x @ v) - t * (x @ v))) + v @ keep @ v / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (p - t)) + keep @ w)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return w


def choose_landmarks(counts: list[tuple], n_toxic: int, n_clean: int, most: int) -> list[str]:
    """Strings that set toxic texts apart, the clearest first, each but once with what it begins or what begins it.

    All of them: where there are more than most, a ValueError says so.
    """
    chosen: dict[str, None] = {}
    beginnings: set[str] = set()
    for string, toxic, clean in sorted(counts, key=lambda r: (r[2] * 40 - r[1], -len(r[0]), r[0])):
        bare = string.rstrip("$")
        own = [bare[:k] for k in range(1, len(bare) + 1)]
        if toxic / n_toxic > 30 * (clean + 0.5) / (n_clean + 1) and bare not in beginnings and not any(b in chosen for b in own):
            chosen[bare] = None
            beginnings.update(own)
    if len(chosen) > most:
        raise ValueError(f"{len(chosen)} landmarks set toxic texts apart, more than the {most} that most_landmarks allows")
    return list(chosen)


def _taught(landmarks: list[str], words: list[tuple[str, float, float]]) -> tuple[Model, np.ndarray]:
    """The machine over words: of clean sentences those similar to a landmark, of toxic ones those that hold one.

    Virtual examples, each landmark with a sign inserted at each place, are added where they are more like it than any
    clean word is: the boundary then lies where insertions are caught and no clean word is. Also the values of those
    and of the toxic sentences' words.
    """
    kernel = Kernel(landmarks)
    forms = [(k, s[:i] + "\0" + s[i:]) for k, s in enumerate(landmarks) for i in range(1, len(s) + 1)]
    room = max(1, MOST_CELLS // len(landmarks) - len(forms))
    if len(words) > room:
        like = np.zeros(len(words))
        for which, rows in kernel.parts([w for w, _, _ in words]):
            like[which] = rows.max(1)
        words = [words[k] for k in sorted(np.argsort(-like, kind="stable")[:room])]
    which, rows = kernel([w for w, _, _ in words])
    toxic, clean = (np.array([words[k][c] for k in which], float) for c in (1, 2))
    holds = rows.max(1, initial=0) >= HOLDS**DEGREE
    bad, good = (clean == 0) & holds, clean > 0
    most = rows[good].max(0, initial=0)
    hit, made = kernel([f for _, f in forms])
    of = np.array([forms[k][0] for k in hit], int)
    made = made[made[np.arange(len(made)), of] > 1.1 * most[of]]
    x = np.vstack([rows[bad], made, rows[good]]).astype(float)
    y = np.concatenate([np.ones(bad.sum() + len(made)), np.zeros(good.sum())])
    weight = np.concatenate([np.log1p(toxic[bad]), np.ones(len(made)), np.log1p(clean[good])])
    value, vector = np.linalg.eigh(kernel.gram() + 1e-3 * np.eye(len(landmarks)))
    whiten = vector / np.sqrt(value) @ vector.T
    w, bias = machine(x @ whiten, y, weight)
    model = Model(landmarks, whiten @ w, bias, np.zeros(3), 0.0)
    return model, x[y > 0] @ model.weights + bias


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_clean: int = 8000, most_landmarks: int = 1024) -> Model:
    """Learns from docs (doc_id, text: binary) that have a label (doc_id, toxic).

    From about most_toxic and most_clean labelled rows at most, chosen by a hash of the id: these bound what reaches
    the driver (words similar to a landmark, with counts). All of those are learnt from, near copies with a share of one
    text's weight each; the same rows give the same model, to the last bit. A document with several labels is toxic if one
    says so; null labels and ids are left out. Without any toxic or any clean row, or any string that sets them apart,
    every text gets the same score. Every string with the evidence is a landmark or covered by one, up to most_landmarks
    of them, the clearest first, from 20 times as many candidates; beyond MOST_CELLS similarities the machine learns from
    the words that are most like a landmark. Strings that fewer labelled texts show than EVIDENCE asks for aren't known.
    """
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    part = F.when(F.col("toxic") == 1, (1 << 20) * most_toxic / max(1, n.get(1, 0))).otherwise((1 << 20) * most_clean / max(1, n.get(0, 0)))
    sample = F.broadcast(own.filter(place < part))  # most_toxic + most_clean rows
    # texts that share their longest words are taken for copies or near copies: all are learnt from, as one text together
    words = F.array_distinct(F.split(F.lower(F.col("text").cast("string")), "\\s+"))
    longest = F.slice(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), 1, 2)
    found = written(docs.join(sample, "doc_id").select("toxic", "text", longest.alias("longest")), "labelled")
    alike = F.broadcast(found.groupBy("longest", "toxic").agg(F.count("*").alias("alike")))  # of the sample's rows
    rows = found.join(alike, ["longest", "toxic"]).select("toxic", F.floor(F.lit(SHARE) / F.col("alike")).cast("long").alias("share"), "text")
    n = {r["toxic"]: r["share"] / SHARE for r in rows.groupBy("toxic").agg(F.sum("share").alias("share")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    constant = Model([], np.empty(0), 0.0, np.zeros(3), (n_toxic + 1) / (n_toxic + n_clean + 2))
    if not n_toxic or not n_clean:
        return constant
    counted = rows.mapInArrow(_counted, "string string, toxic long, clean long").groupBy("string").agg(*[(F.sum(c) / SHARE).alias(c) for c in ("toxic", "clean")])
    counts = written(counted, "strings")
    # twice as many nats as chance gives the best of some thousand strings
    p, total = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    nats = F.col("toxic") * F.log(F.col("toxic") / (total * p)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (total * (1 - p)))).otherwise(0.0)
    apart = counts.filter((F.col("toxic") > 0) & (F.col("toxic") / n_toxic > 30 * (F.col("clean") + 0.5) / (n_clean + 1)) & (nats >= EVIDENCE))
    best = apart.orderBy(F.col("clean") * 40 - F.col("toxic"), -F.length("string"), "string").limit(20 * most_landmarks).collect()
    landmarks = choose_landmarks([tuple(r) for r in best], n_toxic, n_clean, len(best))[:most_landmarks]
    if not landmarks:
        return constant
    # sorted: sums over them are then the same again
    similar = sorted(tuple(r) for r in counts.filter("string LIKE '%$'").mapInArrow(partial(_similar, landmarks=landmarks), counts.schema).collect())
    model, alone = _taught(landmarks, [(string.rstrip("$"), toxic, clean) for string, toxic, clean in similar])
    told = np.array(sorted(tuple(r) for r in rows.mapInArrow(partial(_told, model=model), "toxic int, share long, most double, all double").fillna(-1e9).collect()), float)
    hit, share = told[:, 2] > -1e9, told[:, 1] / SHARE
    model.base = ((told[~hit, 0] * share[~hit]).sum() + 1) / (share[~hit].sum() + 2)
    # texts with one toxic word only, which the labelled ones may lack, weigh as a tenth of the toxic texts
    x = np.vstack([told[hit, 2:], np.stack([alone, np.log1p(np.maximum(alone, 0))], 1)])
    y = np.concatenate([told[hit, 0], np.ones(len(alone))])
    weight = np.concatenate([share[hit], np.full(len(alone), 0.1 * n_toxic / max(1, len(alone)))])
    x = np.hstack([x, np.ones((len(x), 1))])
    model.line = odds_line(x, y, weight)
    if model.line[1] < 0:  # more toxic words never speak for a text
        model.line = odds_line(x * [1, 0, 1], y, weight)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out=None, **bounds) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    held_out: a Column over doc_id; those rows' labels aren't learnt from. All texts without a word that is similar to a
    landmark have one score, the share of toxic ones among such labelled texts; so has a null or empty text. Rows that repeat an id are scored each; a row without an id too, but is never learnt from. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    known = labels.select("doc_id", "toxic")
    model = fit(rows.filter(~F.col("held_out")).select("doc_id", "text"), known.filter(~held), **bounds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scored, model=model, threshold=threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out=None, **bounds) -> DataFrame:
    """The rows of docs that score under threshold, with all their columns, where they are: nothing is shuffled.

    Nulls, empty and long texts, repeated rows and empty tables as in toxicity(); columns may have any names.
    """
    held = F.lit(False) if held_out is None else held_out
    known = docs.filter(~held).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    model = fit(known, labels.select("doc_id", "toxic").filter(~held), **bounds)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow can't quote every name
    kept = plain.mapInArrow(partial(_cleaned, model=model, threshold=threshold, text_at=docs.columns.index("text")), plain.schema)
    return kept.toDF(*docs.columns)
