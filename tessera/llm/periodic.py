"""Periodic runs of words by repeated k-gram masking and Main-Lorentz.

A run of period q and length L >= max(least, times * q) agrees with itself q words on, over an overlap of L - q words, so
each of its words lies in a k-gram that occurs again in the document when k is the least overlap that any period can have.
Words outside such k-grams are masked: they can't be in a run. Main-Lorentz then looks through the stretches that are
left, all of a batch at once: at every split of a balanced halving, for every period, the repetition across the split is
extended to both sides, by binary search over prefix fingerprints; runs that are found are held against the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, mix64, portions

#: Pairs of a split and a period that are looked at together.
PAIRS = 1 << 19
#: Fingerprints are polynomials modulo these primes.
PRIMES = (2_147_483_647, 2_147_483_629)


def least_overlap(least: int, times: int) -> int:
    """The least L - q of any run of period q: the longest k-gram that each word of each run lies in twice."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def masked(ids: np.ndarray, ends: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its document has more than once (or, by a chance of hashing, seems to)."""
    n = len(ids)
    keep = np.zeros(n + 1, np.int32)
    if n < k:
        return keep[:n] > 0
    grams = doc[: n - k + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        grams += ids[j : n - k + 1 + j].astype(np.uint64) * mix64(np.uint64([0x9E3779B97F4A7C15 * (j + 1) % 2**64]))
    grams = mix64(grams)
    at = np.flatnonzero(np.arange(k, n + 1) <= ends[doc[: n - k + 1]])
    grams = grams[at]
    slot = (grams >> np.uint64(64 - max(10, int(4 * len(at)).bit_length()))).astype(np.int64)
    often = np.bincount(slot)[slot] > 1 if len(at) else np.zeros(0, bool)
    at, grams = at[often], grams[often]
    order = np.argsort(grams)
    same = np.diff(grams[order]) == 0
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = at[again]
    np.add.at(keep, at, 1)
    np.add.at(keep, at + k, -1)
    return np.cumsum(keep[:n]) > 0


class _Prints:
    """Fingerprints of all substrings of a sequence of numbers."""

    def __init__(self, w: np.ndarray) -> None:
        values, self.tables = mix64(w.astype(np.uint64)), []
        for prime, base in zip(PRIMES, (1_103_515_245, 1_812_433_253), strict=True):
            p, power = np.uint64(prime), np.ones(1, np.uint64)
            while len(power) <= len(w):
                power = np.concatenate([power, power * (power[-1] * np.uint64(base) % p) % p])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values % p * power[: len(w)] % p) % p])
            self.tables.append((p, power, sums))

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray, tables: int = 2) -> np.ndarray:
        """Whether the words from i and from j > i on agree over length: no is certain, yes nearly so."""
        out = np.ones(len(i), bool)
        for p, power, sums in self.tables[:tables]:
            out &= (sums[i + length] + p - sums[i]) % p * power[j - i] % p == (sums[j + length] + p - sums[j]) % p
        return out

    def extent(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i and j on, or back from before them, agree: most at most."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            fit = self.same(i - middle * back, j - middle * back, middle)
            low, high = np.where(fit, middle, low), np.where(fit, high, middle - 1)
        return low


def runs_of(w: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int) -> np.ndarray:
    """Maximal runs (start, end, smallest period) within stretches of w: begin and end hold each word's stretch, where both are equal there is none."""
    prints, found = _Prints(w), [np.zeros((0, 4), np.int64)]
    block = 1
    while block < len(w):
        middle = np.arange(block, len(w), 2 * block)
        most = np.minimum(block // 2, (end[middle] - begin[middle]) // times)
        middle, most = middle[most > 0], most[most > 0]
        cuts = np.searchsorted(np.cumsum(most), np.arange(PAIRS, most.sum() + PAIRS, PAIRS)) if len(most) else []
        for a, b in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(most)], strict=False):
            m = np.repeat(middle[a:b], most[a:b])
            p = np.arange(len(m)) - np.repeat(np.cumsum(most[a:b]) - most[a:b], most[a:b]) + 1
            # of a run across the split, two periods or more lie on one side of it
            for at in (m, m - 2 * p):
                fits = (at >= begin[m]) & (at + 2 * p <= end[m])
                x, q, own = at[fits], p[fits], m[fits]
                met = prints.same(x, x + q, q, tables=1)
                x, q, own = x[met], q[met], own[met]
                start = x - prints.extent(x, x + q, x - begin[own], True)
                stop = x + q + prints.extent(x, x + q, end[own] - x - q, False)
                long = stop - start >= np.maximum(least, times * q)
                found.append(np.stack([start, stop, q, x], 1)[long])
        block *= 2
    every = np.concatenate(found)
    runs = every[np.lexsort(every.T[[2, 1, 0]])]
    if len(runs):  # the smallest period of those that are as far as each other
        runs = runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(1))]
    whole = [np.array_equal(w[s : e - q], w[s + q : e]) for s, e, q, _ in runs.tolist()]
    if not all(whole):  # a chance of hashing: measured again, word by word
        again = [_extended(w, x, q, int(begin[x]), int(end[x])) for _, _, q, x in every.tolist()]
        runs = np.array(sorted({r for r in again if r[1] - r[0] >= max(least, times * r[2])}), np.int64).reshape(-1, 3)
        runs = runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(1))] if len(runs) else runs
    return runs[:, :3]


def _extended(w: np.ndarray, x: int, q: int, low: int, high: int) -> tuple[int, int, int]:
    ahead = np.flatnonzero(w[x : high - q] != w[x + q : high])
    behind = np.flatnonzero(w[low:x] != w[low + q : x + q])
    return low if not len(behind) else low + int(behind[-1]) + 1, high if not len(ahead) else x + q + int(ahead[0]), q


def _found(ids: np.ndarray, sizes: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs (document, start in it, length, period) of documents of these sizes, in order."""
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keep = masked(ids, ends, doc, least_overlap(least, times))
    edge = np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8))
    cut = (ends - sizes)[1:][sizes[1:] > 0]
    cut = np.unique(cut[(cut > 0) & (cut < len(keep))])
    cut = cut[keep[cut] & keep[cut - 1]]  # a document ends within a stretch
    first, last = (np.sort(np.concatenate([np.flatnonzero(edge == s), cut])) for s in (1, -1))
    first, last = first[last - first >= least], last[last - first >= least]
    if not len(first):
        return np.zeros((0, 4), np.int64)
    length = last - first
    place = np.cumsum(length) - length
    of = np.arange(length.sum()) + np.repeat(first - place, length)
    begin, end = np.repeat(place, length), np.repeat(place + length, length)
    runs = runs_of(ids[of], begin, end, least, times)
    at = of[runs[:, 0]]
    out = np.stack([doc[at], at - (ends - sizes)[doc[at]], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    return out[np.lexsort(out.T[[3, 1, 0]])]


def _periodic(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    """id, text (bytes) -> id, n_words, runs, collapsed."""
    for batch in portions(batches, "text"):
        numbers, texts = Words(), [text.split() for text in batch.column("text").to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.concatenate([numbers.numbers(t) for t in texts])
        runs = _found(ids, sizes, least, times)
        place = (np.cumsum(sizes) - sizes)[runs[:, 0]] + runs[:, 1]
        drop = np.zeros(len(ids) + 1, np.int32)
        np.add.at(drop, place + runs[:, 3], 1)
        np.add.at(drop, place + runs[:, 2], -1)
        stay, upto = np.cumsum(drop[:-1]) == 0, np.cumsum(sizes).tolist()
        some = set(runs[:, 0].tolist())
        kept = [b" ".join(compress(t, stay[e - len(t) : e].tolist()) if k in some else t) for k, (t, e) in enumerate(zip(texts, upto, strict=True))]
        each = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
        offsets = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
        columns = [batch.column("id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), each), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row for each row of docs: its id, n_words, runs (array of start, length, period) and collapsed.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch with smallest period q (words q
    apart are identical) of max(least, times * q) words at least that no neighbour extends; least > times >= 2. Runs are in
    order of start, then period. collapsed: the words, joined by a space, without those that a run holds after its first
    period. A null or empty text has no words, no run and an empty rest. Rows that repeat an id are each their own; a null
    id stays null. An empty table gives an empty result; other columns are not read. No row leaves its task.
    """
    if not least > times >= 2:
        raise ValueError("a run has two periods at least, and more words than periods")
    kind = docs.schema[id_col].dataType.simpleString()
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (id_col, text_col)]
    rows = docs.select(quoted[0].alias("id"), F.coalesce(quoted[1], F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(partial(_periodic, least=least, times=times), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
