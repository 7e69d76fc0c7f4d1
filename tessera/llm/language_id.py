"""Language identification by words first, and by shorter and shorter character n-grams for words never seen.

A known word adds its log frequency in each language. For a word not in the list, its n-grams of five letters are
looked up, and if none of them is known those of four, and so on down to single letters; their mean log frequency
stands for the word. A run of letters longer than a word, as in scripts without spaces, counts as words one after
another. The language with the largest sum is the text's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, mix64, small, sums, written

NOT_LETTER = re.compile(r"[\W\d_]+")
#: The longest n-grams, letters of a piece that a longer word is cut into, added to every count.
N, LONGEST, ADDED = 5, 40, 0.5
#: Table cells (words or n-grams times languages) that a task has in memory at most.
CELLS = 16_000_000
CACHE = 400_000
UNDETERMINED = "und"


def pieces(word: bytes) -> list[str]:
    """The letters of a word in lower case; of a long one, pieces that reach to its end and share N - 1 letters, so that
    each n-gram of N is in one. None for a word without letters."""
    whole = NOT_LETTER.sub("", word.decode("utf-8", "replace").lower())
    if len(whole) <= LONGEST:
        return [whole] if whole else []
    return [whole[k : k + LONGEST] for k in range(0, len(whole) - N + 1, LONGEST - N + 1)]


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, key) of each n-gram of the words between marks for their ends."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    if len(codes) < n:
        return owner[:0], codes[:0]
    key = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k])
    whole = owner[: len(key)] == owner[n - 1 :]
    return owner[: len(key)][whole], key[whole]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray  # (words, languages)
    keys: list[np.ndarray]  # of n-grams by length, sorted
    gram_logs: list[np.ndarray]

    def vectors(self, words: list[str]) -> np.ndarray:
        """Log frequencies of the words in each language."""
        out = np.zeros((len(words), len(self.languages)))
        place = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        known = place >= 0
        out[known] = self.word_logs[place[known]]
        rest = np.flatnonzero(place == -1)
        for n in range(N, 0, -1):
            if not len(rest):
                break
            owner, key = grams([words[i] for i in rest], n)
            if not len(self.keys[n]) or not len(key):
                continue
            at = np.minimum(np.searchsorted(self.keys[n], key), len(self.keys[n]) - 1)
            hit = self.keys[n][at] == key
            owner, logs = owner[hit], self.gram_logs[n][at[hit]]
            count = np.bincount(owner, minlength=len(rest))
            found = count > 0
            for k in range(len(self.languages)):
                out[rest[found], k] = np.bincount(owner, logs[:, k], len(rest))[found] / count[found]
            rest = rest[~found]
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, word, count: words of a partition that is part of a bounded sample."""
    counts: dict[str, Counter] = {}
    seen: dict[bytes, list[str]] = {}
    for batch in small(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = counts.setdefault(lang, Counter())
            for word, n in Counter(text.split()).items():
                if word not in seen:
                    seen[word] = pieces(word)
                for piece in seen[word]:
                    own[piece] += n
    for lang, own in counts.items():
        words = list(own)
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([own[w] for w in part], pa.int64())], names=["lang", "word", "count"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, count -> lang, n, key, count."""
    for batch in small(batches):
        words, count = batch.column("word").to_pylist(), np.asarray(batch.column("count"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            for n in range(1, N + 1):
                owner, key = grams([words[i] for i in own], n)
                keys, place = np.unique(key, return_inverse=True)
                total = np.bincount(place, count[own][owner], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(total)], names=["lang", "n", "key", "count"])


def _frequent(counts: DataFrame, by: list[str], langs: list[str], most: int) -> list:
    """The `most` commonest of counts, with their counts by the number of the language."""
    number = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))])
    own = F.collect_list(F.struct(F.element_at(number, F.col("lang")).alias("k"), "count"))  # a row for each language at most
    return counts.groupBy(*by).agg(F.sum("count").alias("all"), own.alias("own")).orderBy(F.desc("all"), *by).limit(most).collect()


def fit(docs: DataFrame, most_per_language: int = 2500, most_words: int = 40_000, most_grams: int = 80_000, most_languages: int = 1000) -> Model | None:
    """Learns from docs (doc_id, text: binary, lang), null languages left out.

    From about most_per_language documents of each language, chosen by a hash of the id, and whole texts of those; the
    commonest words and n-grams make the model, fewer of them where many languages need the room. None if no language is
    known. Every language is learnt: more than most_languages, for which the tables are laid out, raise a ValueError.
    """
    known = docs.filter("lang IS NOT NULL")
    sizes = known.groupBy("lang").count().limit(most_languages + 1).collect()
    if not sizes:
        return None
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages")
    langs = sorted(r["lang"] for r in sizes)
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], float((1 << 20) * most_per_language / r["count"])) for r in sizes], "lang string, part double"))
    sample = known.filter(F.col("text").isNotNull()).join(share, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("part"))
    words = written(sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count")), "words")
    top = _frequent(words, ["word"], langs, min(most_words, CELLS // (2 * len(langs))))
    parts = words.mapInArrow(_gram_counts, "lang string, n int, key long, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))
    grams_ = _frequent(parts, ["n", "key"], langs, min(most_grams, CELLS // (2 * len(langs))))

    def logs(rows: list) -> np.ndarray:
        c = np.full((len(rows), len(langs)), ADDED)
        for i, r in enumerate(rows):
            for x in r["own"]:
                c[i, x["k"]] += x["count"]
        return np.log(c / c.sum(0))

    keys, tables = [np.empty(0, np.uint64)], [np.empty((0, len(langs)))]
    for n in range(1, N + 1):
        rows = [r for r in grams_ if r["n"] == n]
        key = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(key)
        keys.append(key[order])
        tables.append(logs(rows)[order])
    return Model(langs, {r["word"]: k for k, r in enumerate(top)}, logs(top), keys, tables)


def _identified(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    words, table, lettered = Words(), [], np.empty(0, bool)
    for batch in small(batches):
        texts = batch.column("text").to_pylist()
        if words.full(CACHE):
            words, table, lettered = Words(), [], np.empty(0, bool)
        numbers = [words.numbers(x.split()) if x else np.empty(0, np.int32) for x in texts]
        fresh = [pieces(w) for w in words.take()]
        count = np.fromiter(map(len, fresh), np.int64, len(fresh))
        lettered = np.concatenate([lettered, count > 0])
        flat, sizes = np.concatenate(numbers) if numbers else np.empty(0, np.int32), np.array([len(n) for n in numbers], np.int64)
        has_letter = sums(lettered[flat], sizes) > 0
        if model is None:
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        else:
            each = model.vectors([p for own in fresh for p in own])
            own = np.zeros((len(fresh), len(model.languages)))
            np.add.at(own, np.repeat(np.arange(len(fresh)), count), each)
            table = np.concatenate([table, own]) if len(table) else own
            total = np.stack([sums(table[flat, k], sizes) for k in range(len(model.languages))], 1)
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = total.argmax(1)
            pred = [model.languages[b] if h else UNDETERMINED for b, h in zip(best, has_letter, strict=True)]
            score = np.where(has_letter, p[np.arange(len(texts)), best], 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, held_out=None, **bounds) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score (the share of the best language's likelihood).

    held_out: a Column over doc_id; those rows aren't learnt from. A null text, or one without any letter, is `und` with
    score 0, as is every text if no language is known. Ties go to the language that comes first. Rows that repeat an id
    or have none are rows like others. Columns other than doc_id, text and lang are not read. An empty table gives an
    empty result.
    """
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"), "lang")
    model = fit(rows.filter(~F.col("held_out")).drop("held_out"), **bounds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.drop("lang").mapInArrow(partial(_identified, model=model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
