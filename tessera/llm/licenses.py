"""License scans by patience alignment.

Words that occur once in a template and once in a stretch of text are anchors; the longest increasing run of anchors is
kept, and the gaps between them are aligned in the same way. The share of a template's words that are aligned is its
coverage. Stretches to align are found by each template's rarest words, so a text without these costs a look-up a word.
Licenses that share wording cover the same stretch: the one that leaves fewest words over, of its own and the text's, stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small
from tessera.llm.license_texts import TEMPLATES

PART = re.compile(rb"[0-9a-z]+(?:[.\-][0-9a-z]+)*")


def parts(text: bytes) -> list[bytes]:
    """Words without the signs around them, A-Z lower-cased."""
    return PART.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first number, whose second numbers rise: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[bytes], b: list[bytes], a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places of equal words in a[a0:a1] and b[b0:b1], rising in both."""
    a1, b1 = len(a) if a1 is None else a1, len(b) if b1 is None else b1
    head, tail = [], []
    while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        head.append((a0, b0))
        a0, b0 = a0 + 1, b0 + 1
    while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
        tail.append((a1, b1))
    middle: list[tuple[int, int]] = []
    if a0 < a1 and b0 < b1:
        once: dict[bytes, list[int]] = {}
        for side, words, low, high in ((0, a, a0, a1), (1, b, b0, b1)):
            for k in range(low, high):
                seen = once.setdefault(words[k], [0, 0, -1, -1])
                seen[side] += 1
                seen[side + 2] = k
        anchors = _increasing(sorted((i, j) for x, y, i, j in once.values() if x == y == 1))
        last = (a0 - 1, b0 - 1)
        for i, j in [*anchors, (a1, b1)] if anchors else []:
            middle += align(a, b, last[0] + 1, i, last[1] + 1, j)
            if i < a1:
                middle.append((i, j))
            last = (i, j)
    return head + middle + tail[::-1]


class Template:
    def __init__(self, name: str, text: str, frequency: dict[bytes, int], coverage: float) -> None:
        self.name, self.words, self.coverage = name, parts(text.encode()), coverage
        n = len(self.words)
        self.slack = 3 + n // 4
        # a text with the coverage lacks fewer places than this, so one of the rarest so many is there
        need = n - int(np.ceil(coverage * n)) + 1
        self.keys = sorted(range(n), key=lambda k: (frequency.get(self.words[k], 0), self.words[k], k))[:need]

    def best(self, words: list[bytes], places: dict[bytes, list[int]]) -> tuple | None:
        """(coverage, first word, last word, words between that aren't the template's) of the stretch that covers most; the first of equals."""
        n, starts = len(self.words), set()
        for k in self.keys:
            starts.update(p - k for p in places.get(self.words[k], ()))
        found, done = None, -n - self.slack  # a start before the text: its first words are missing
        for s in sorted(starts):
            if s <= done:  # a stretch that the last one's slack takes in
                continue
            low, high = max(0, s - self.slack), min(len(words), s + n + 2 * self.slack)
            done = s + self.slack
            pairs = self.inner(align(self.words, words, 0, n, low, high))
            share = len(pairs) / n
            if share >= self.coverage and (found is None or share > found[0]):
                found = (share, pairs[0][1], pairs[-1][1], pairs[-1][1] - pairs[0][1] + 1 - len(pairs))
        return found

    def inner(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Without stray words at the ends, which lie further off than the slack."""
        while len(pairs) > 1 and pairs[1][1] - pairs[0][1] > self.slack + pairs[1][0] - pairs[0][0]:
            pairs = pairs[1:]
        while len(pairs) > 1 and pairs[-1][1] - pairs[-2][1] > self.slack + pairs[-1][0] - pairs[-2][0]:
            pairs = pairs[:-1]
        return pairs


def clearest(found: list[tuple[Template, tuple]]) -> list[tuple[Template, tuple]]:
    """Of those that share more than half of a stretch, the one that aligns most and leaves least over; the first of equals."""

    def worth(x: tuple[Template, tuple]) -> float:
        n, (share, first, last, _) = len(x[0].words), x[1]
        return 3 * share * n - n - (last - first + 1)

    kept: list[tuple[Template, tuple]] = []
    for t, f in sorted(found, key=lambda x: -worth(x)):
        shared = [min(f[2], g[2]) - max(f[1], g[1]) + 1 for _, g in kept]
        if not any(2 * n > min(f[2] - f[1], g[2] - g[1]) + 1 for n, (_, g) in zip(shared, kept, strict=True)):
            kept.append((t, f))
    return kept


def _scanned(batches: Iterator[pa.RecordBatch], templates: dict[str, str], coverage: float) -> Iterator[pa.RecordBatch]:
    # common words of prose are poor keys: they count as frequent in themselves
    frequency = dict.fromkeys((b"the", b"of", b"to", b"and", b"in", b"is", b"or", b"a", b"this", b"for", b"with", b"that", b"are", b"at", b"be", b"not", b"by", b"as", b"you", b"any", b"was", b"if", b"it", b"on", b"from"), 1000)
    for text in templates.values():
        for w in parts(text.encode()):
            frequency[w] = frequency.get(w, 0) + 1
    all_ = [Template(n, t, frequency, coverage) for n, t in templates.items()]
    keys = {t.words[k] for t in all_ for k in t.keys}
    # a key as part of a white-space word: only words that hold one are taken apart
    seen: dict[bytes, bool] = {}
    for batch in small(batches):
        rows: list[tuple] = []
        for number, text in enumerate(batch.column("text").to_pylist()):
            raw = set(text.lower().split())
            hit = False
            for w in raw:
                if (known := seen.get(w)) is None:
                    known = seen[w] = not keys.isdisjoint(parts(w))
                if known:
                    hit = True
                    break
            if not hit:
                continue
            words = parts(text)
            places: dict[bytes, list[int]] = {}
            for k, w in enumerate(words):
                if w in keys:
                    places.setdefault(w, []).append(k)
            found = [(t, f) for t in all_ if (f := t.best(words, places))]
            rows += [(number, t.name, *f) for t, f in clearest(found)]
        if len(seen) > 800_000:
            seen = {}
        if rows:
            number, *columns = zip(*rows, strict=True)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(number)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "license", "coverage", "first_word", "last_word", "extra_words"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """A row for each row of docs and license that its text covers: doc_id, license, coverage, first_word, last_word, extra_words.

    Words are counted without the signs around them, from 0; extra_words lie within the stretch and aren't the license's.
    Where licenses cover the same stretch, the one that aligns most words and leaves fewest over counts. Of several stretches the one with the largest coverage
    counts, the first of equals. A null, empty or blank text holds no license. Rows that repeat an id, or have none, are
    scanned each. An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    task = partial(_scanned, templates=TEMPLATES if templates is None else templates, coverage=coverage)
    return rows.mapInArrow(task, f"doc_id {kind}, license string, coverage double, first_word long, last_word long, extra_words long")
