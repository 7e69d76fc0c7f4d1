"""Repeated byte strings across documents by two-stage suffix sorting.

A string of `length` bytes is dealt out by the least fingerprint of the grams in it, so that equal strings meet, wherever
they start. Stretches of starts with the same least fingerprint are pieces; only a piece's key and digest are dealt out at
first, some fifty bytes for some hundred and fifty of text. Pieces whose key nothing else has, and whose gram they have once, hold no repeated string.
Equal pieces are repeated as a whole, however many they are. Of the others, those that meet different pieces with the
same key, the texts are brought together by key, and their suffixes sorted in two stages: only suffixes smaller than
their successors are sorted directly, the others are induced from these by a scan of the buckets of first bytes. A start
is repeated if its suffix shares `length` bytes with a neighbour. Where very many different pieces share a key, each start
is dealt out by the digest of its string instead, so that no task gets them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, portions, small, written

#: Bytes that a gram has; bytes of text that are fingerprinted together, starts in a piece at most.
GRAM, CHUNK, PIECE = 96, 1 << 20, 2048
#: Bytes of pieces of a key that one task sorts: with more, starts are dealt out one by one. Bytes that are sorted together.
HOT, SORTED = 1 << 20, 1 << 19
#: Parts that the places of one string are dealt out in.
SALTS = 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return [p[: n + 1] for p in _POWERS]


def least_grams(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `length` bytes, the least fingerprint of the grams in it; the fingerprints."""
    n, wide = len(text), length - gram + 1
    power, inverse = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:n])])
    prints = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    filled = np.full(-len(prints) % wide, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([prints, filled]).reshape(-1, wide)
    before = np.minimum.accumulate(rows, 1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    return np.minimum(after[:starts], before[wide - 1 : wide - 1 + starts]), prints


def pieces_of(text: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, first start, number of starts, and whether it has the key's gram twice, of the pieces of texts that end at `ends`."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    key, prints = least_grams(text, length, gram)
    begins = np.concatenate([[0], ends[:-1]])
    size = ends - begins
    stretch = np.zeros(len(text) + 1, np.int8)
    long = size >= length
    np.add.at(stretch, begins[long], 1)
    np.add.at(stretch, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(stretch[: len(key)]) > 0)
    new = np.ones(len(at), bool)
    new[1:] = (key[at[1:]] != key[at[:-1]]) | (np.diff(at) > 1)
    new |= np.isin(at, begins)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    parts = -(-n // PIECE)
    first, n = np.repeat(first, parts), np.repeat(n, parts)
    part = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    key, at, n = key[at[first]], at[first] + part * PIECE, np.minimum(n - part * PIECE, PIECE)
    grams = n + length - gram
    place = np.cumsum(grams) - grams
    same = prints[np.arange(grams.sum()) + np.repeat(at - place, grams)] == np.repeat(key, grams)
    return key, at, n, np.add.reduceat(same, place, dtype=np.int64) > 1 if len(n) else np.zeros(0, bool)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, text -> k1, k2, key, start, n, twice, digest: a row for each piece."""
    for batch in portions(batches, "text", CHUNK):
        texts = batch.column("text").to_pylist()
        whole = len(texts) > 1 or len(texts[0]) <= 2 * CHUNK
        # a longer text in parts that share a string less a byte: no start is left out or twice there
        for begin in [0] if whole else range(0, max(1, len(texts[0]) - length + 1), CHUNK):
            data = b"".join(texts) if whole else texts[0][begin : begin + CHUNK + length - 1]
            ends = np.cumsum([len(t) for t in texts]) if whole else np.array([len(data)])
            key, at, n, twice = pieces_of(np.frombuffer(data, np.uint8), ends, length, gram)
            doc = np.searchsorted(ends, at, "right")
            start = at - (ends - np.diff(ends, prepend=0))[doc] + begin
            digests = [hashlib.blake2b(data[a : a + m + length - 1], digest_size=16).digest() for a, m in zip(at.tolist(), n.tolist(), strict=True)]
            of = pa.array(doc)
            columns = [batch.column("k1").take(of), batch.column("k2").take(of), pa.array(key.view(np.int64)), pa.array(start), pa.array(n.astype(np.int32)), pa.array(twice), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "key", "start", "n", "twice", "digest"])


def suffix_order(data: bytes, depth: int) -> np.ndarray:
    """The starts of data's suffixes in order of their first `depth` bytes at least."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    runs = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # the last of each run of a byte
    rises = np.append(text[runs[:-1]] < text[runs[:-1] + 1], False)  # the end counts as smaller than any byte
    small_ones = np.flatnonzero(np.repeat(rises, np.diff(runs, prepend=-1)))
    pair = text[small_ones].astype(np.uint16) << 8 | text[small_ones + 1]
    order = np.argsort(pair, kind="stable")
    edges = np.flatnonzero(np.diff(pair[order], prepend=-1, append=1 << 16))
    placed = small_ones[order]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            placed[a:b] = sorted(placed[a:b].tolist(), key=lambda i: data[i : i + depth])
    upto = np.searchsorted(text[placed], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        here = [np.concatenate(waiting[c])] if waiting[c] else []
        while here and len(here[-1]):  # those of the same byte, each induced by the one before
            back = here[-1][here[-1] > 0] - 1
            here.append(back[text[back] == c])
        bucket = np.concatenate([*here, placed[upto[c] : upto[c + 1]]])
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        back = back[text[back] > c]
        firsts = text[back]
        back = back[np.argsort(firsts, kind="stable")]
        counts = np.bincount(firsts, minlength=256)
        for d in np.flatnonzero(counts).tolist():
            begin = counts[:d].sum()
            waiting[d].append(back[begin : begin + counts[d]])
    return np.concatenate(out).astype(np.int64)


def repeated_starts(windows: list[bytes], length: int) -> list[np.ndarray]:
    """For each window, whether each of its starts is that of a string of `length` bytes that starts elsewhere in windows too."""
    data = b"".join(windows)
    sizes = np.array([len(w) for w in windows])
    ends = np.cumsum(sizes)
    fits = np.zeros(len(data) + 1, np.int8)
    np.add.at(fits, ends - sizes, 1)
    np.add.at(fits, ends - length + 1, -1)
    fits = np.cumsum(fits[:-1]) > 0
    order = suffix_order(data, length)
    order = order[fits[order]]
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    pair = np.arange(len(order) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        pair = pair[eights[order[pair] + k] == eights[order[pair + 1] + k]]
    again = np.zeros(len(data), bool)
    again[order[pair]] = again[order[pair + 1]] = True
    return [again[e - s : e - length + 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """k1, k2, text, items (start, n, key, alone, hot) -> a row for each item: its text, or where hot the digests of its strings."""
    for batch in portions(batches, "text", CHUNK):
        for k1, k2, text, items in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "asked")), strict=True):
            for a in range(0, len(items), 256):
                some = items[a : a + 256]
                parts = [text[x["start"] : x["start"] + x["n"] + length - 1] for x in some]
                prints = [[hashlib.blake2b(t[k : k + length], digest_size=16).digest() for k in range(x["n"])] if x["hot"] else None for x, t in zip(some, parts, strict=True)]
                own = {c: pa.array([x[c] for x in some], t) for c, t in (("key", pa.int64()), ("start", pa.int64()), ("alone", pa.bool_()))}
                texts = pa.array([None if x["hot"] else t for x, t in zip(some, parts, strict=True)], pa.binary())
                ids = [pa.array([k] * len(some), pa.int64()) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([*ids, *own.values(), texts, pa.array(prints, pa.list_(pa.binary()))], names=["k1", "k2", *own, "text", "prints"])


def _sorted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows in order of key, k1, k2, start -> k1, k2, start, n: stretches of repeated starts of those that are alone."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], []]
        for (_, k1, k2, start, alone, _), again in zip(rows, repeated_starts([r[5] for r in rows], length), strict=True):
            if alone and again.any():
                edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                for column, values in zip(out, ([k1] * len(edge), [k2] * len(edge), (start + edge[:, 0]).tolist(), (edge[:, 1] - edge[:, 0]).tolist()), strict=True):
                    column += values
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["k1", "k2", "start", "n"])

    rows: list[tuple] = []
    size, place = 0, None
    for batch in small(batches):
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "k1", "k2", "start", "alone", "text")), strict=True):
            if row[:4] == place:  # of rows that repeat id and text
                continue
            if size > SORTED and row[0] != place[0]:
                yield judged(rows)
                rows, size = [], 0
            rows.append(row)
            place, size = row[:4], size + len(row[5])
    if rows:
        yield judged(rows)


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """id, text, stretches of repeated starts -> id, n_bytes, spans, kept."""
    for batch in portions(batches, "text"):
        spans, kept, sizes = [], [], []
        for text, stretches in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist(), strict=True):
            own: list[list[int]] = []
            for start, n in sorted((x["start"], x["n"]) for x in stretches or []):
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], start + n + length - 1)
                else:
                    own.append([start, start + n + length - 1])
            spans.append([{"start": a, "length": b - a} for a, b in own])
            kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(text)], strict=True)))
            sizes.append(len(text))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: its id, n_bytes, spans (array of start, length: what is removed) and kept (the other bytes).

    Texts count as UTF-8 bytes, a null one as empty. A byte is removed if a string of `length` bytes that covers it also
    starts anywhere else, in the same text or another row's; all is judged on the texts as given, so every copy of a
    repeated passage goes. Matches don't cross rows. Spans are maximal and in order; a cut may split a character, so kept
    is binary. Rows that repeat an id, a null id too, are each their own: two rows of one id and text are copies. An empty
    table gives an empty result; other columns are not read. length > gram >= 8.
    """
    if not length > gram >= 8:
        raise ValueError("a string is longer than a gram, and a gram has eight bytes at least")
    kind = docs.schema[id_col].dataType.simpleString()
    ident, text = (F.col("`" + c.replace("`", "``") + "`") for c in (id_col, text_col))
    rows = docs.select(ident.alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit(1)).alias("k2"), "id", "text")
    pieces = rows.select("k1", "k2", "text").filter(F.length("text") >= length).mapInArrow(partial(_pieces, length=length, gram=gram), "k1 long, k2 long, key long, start long, n int, twice boolean, digest binary")
    pieces = written(pieces, "pieces")
    several = pieces.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 OR twice").select("key")
    met = written(pieces.join(several, "key", "left_semi"), "met")
    classes = met.groupBy("key", "digest").agg(F.count("*").alias("members"), F.min(F.struct("k1", "k2", "start")).alias("first"), F.first("n").alias("n"), F.max("twice").alias("twice"))
    classes = written(classes, "classes")
    kinds = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + length - 1).alias("bytes"), F.max("twice").alias("twice")).filter("kinds > 1 OR twice")
    known = classes.join(kinds.select("key", (F.col("bytes") > HOT).alias("hot")), "key", "left").filter("hot IS NOT NULL OR members > 1")
    items = met.drop("n", "twice").join(known, ["key", "digest"])
    # one of each class is compared with other classes
    asked = F.col("hot").isNotNull() & (F.struct("k1", "k2", "start") == F.col("first"))
    items = items.select("k1", "k2", "start", "n", "key", (F.col("members") == 1).alias("alone"), "hot", asked.alias("asked")).filter("asked OR NOT alone").distinct()
    item, stretch = F.struct("start", "n", "key", "alone", "hot"), F.struct("start", F.col("n").cast("long").alias("n"))
    by_doc = items.groupBy("k1", "k2").agg(F.collect_list(F.when(F.col("asked"), item)).alias("asked"), F.collect_list(F.when(~F.col("alone"), stretch)).alias("whole"))
    texts = written(rows.join(by_doc, ["k1", "k2"], "left"), "texts")

    windows = texts.filter("size(asked) > 0").select("k1", "k2", "text", "asked").mapInArrow(partial(_texts, length=length), "k1 long, k2 long, key long, start long, alone boolean, text binary, prints array<binary>")
    windows = written(windows, "windows")
    together = windows.filter("text IS NOT NULL").drop("prints").repartition("key").sortWithinPartitions("key", "k1", "k2", "start")
    found = together.select("key", "k1", "k2", "start", "alone", "text").mapInArrow(partial(_sorted, length=length), "k1 long, k2 long, start long, n long")
    strings = windows.filter("prints IS NOT NULL").select("k1", "k2", "key", "start", "alone", F.posexplode("prints").alias("at", "print"))
    strings = strings.select("k1", "k2", "key", "alone", (F.col("start") + F.col("at")).alias("start"), "print")
    place = F.struct("k1", "k2", "start")
    # a string may be at very many places: each of some parts of them learns by one row whether there is another
    strings = strings.withColumn("salt", F.pmod(F.xxhash64("k1", "k2", "start"), F.lit(SALTS)).cast("int"))
    parts = strings.groupBy("key", "print", "salt").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    often = parts.groupBy("key", "print").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a < b").select("key", "print")
    often = parts.join(often, ["key", "print"], "left_semi").select("key", "print", "salt")
    dealt = strings.filter("alone").join(often, ["key", "print", "salt"], "left_semi").select("k1", "k2", "start", F.lit(1).cast("long").alias("n"))
    found = found.unionByName(dealt).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    some = texts.filter("asked IS NOT NULL").join(found, ["k1", "k2"], "left")
    some = some.select("id", "text", F.when(F.col("parts").isNull(), F.col("whole")).otherwise(F.concat("whole", "parts")).alias("stretches"))
    schema = f"id {kind}, n_bytes long, spans array<struct<start: long, length: long>>, kept binary"
    none = texts.filter("asked IS NULL").select("id", F.length("text").cast("long").alias("n_bytes"), F.expr("CAST(array() AS array<struct<start: bigint, length: bigint>>)").alias("spans"), F.col("text").alias("kept"))
    return some.mapInArrow(partial(_kept, length=length), schema).unionByName(none).withColumnRenamed("id", id_col)
