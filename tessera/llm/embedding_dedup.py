"""Near duplicates of vectors by iterative quantisation and multi-index Hamming tables.

Rotations of the principal directions are learnt on a bounded sample so that signs of the rotated coordinates are
balanced binary codes. The codes are cut into parts; a table for each part finds the vectors that agree on it, and these
are told apart by the Hamming distance of whole codes. Up to there only codes of eight bytes are dealt out, and a bucket
gives a spanning forest of what is near, not pairs. What is connected so is brought together with its vectors, once, and
compared in blocks by matrix products of the original vectors. Equal vectors are one class from the start.

One rule sets the tables for any number of vectors: a part has LEAST_WIDTH bits and one for each doubling of the largest
label over that, so that a bucket stays as large as it is and all work grows with the vectors. Rotations are learnt on
half of the sample; the other half's vectors, each turned away by just the threshold's angle in several directions, say
how many tables there must be for MISSED of them at most to be in none, and what Hamming distance that share is within.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, written
from tessera.llm.union_find import components

#: Codes in a bucket, about, and bits that a part has at least; codes of a bucket that meet in one task at most.
BUCKET, LEAST_WIDTH, CODES = 1024, 4, 8192
#: Vectors in a block; rows of a block that are compared at a time; vectors of small groups that share a shelf.
BLOCK, STRIP, SHELF = 4096, 512, 16_384
#: The most bits of a part and the most tables (a part is narrower where more would be needed, and buckets larger), the
#: share of turned vectors that no table may find, and turned vectors that are tried at least.
MOST_WIDTH, MOST_TABLES, MISSED, TRIED = 24, 96, 0.001, 8192


def rotation(x: np.ndarray, seed: int = 5, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) so that the signs of (x - mean) @ projection are balanced codes: 64 bits at most."""
    mean = x.mean(0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    main = vectors[:, ::-1][:, :64]
    v = (x - mean) @ main
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, main @ r


@dataclass
class Index:
    """Tables for unit vectors of one length: parts of `width` bits of codes by several rotations; near: the distance of codes within which vectors may be linked."""

    size: int
    width: int
    tables: int
    rotations: list[tuple[np.ndarray, np.ndarray]]
    near: int = 64

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The part of each row in each table."""
        if not self.width:
            return np.zeros((len(x), 1), np.int64)
        out = []
        for mean, turn in self.rotations:
            bits = (x - mean) @ turn >= 0
            for k in range(0, bits.shape[1] - self.width + 1, self.width):
                out.append(bits[:, k : k + self.width] @ (1 << np.arange(self.width, dtype=np.int64)))
        return np.stack(out[: self.tables], 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The whole code of each row, by the first rotation."""
        if not self.rotations:
            return np.zeros(len(x), np.uint64)
        mean, turn = self.rotations[0]
        bits = (x - mean) @ turn >= 0
        return bits @ (np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64))


def turned(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """Each row turned by the threshold's angle in some direction."""
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    aside /= np.maximum(np.sqrt((aside**2).sum(1, keepdims=True)), 1e-12)
    return min(threshold, 1.0) * x + np.sqrt(max(0.0, 1 - threshold**2)) * aside


def index(sample: np.ndarray, threshold: float, width: int) -> Index:
    """Rotations of half of the sample, and tables enough for the other half.

    Of TRIED turned vectors or more, the share in no table, and that of a larger distance of codes, is MISSED at most,
    three more being counted than there were: the bound that holds with a chance of 95 % where none was.
    """
    size = sample.shape[1]
    width = min(width, size)
    if not width or len(sample) < 2 or threshold <= 0:
        return Index(size, 0, 1, [])
    fitted, aside = (sample[::2], sample[1::2]) if len(sample) >= 64 else (sample, sample)
    rng = np.random.default_rng(11)
    some = np.tile(aside[: 2 * TRIED], (-(-TRIED // len(aside)), 1))
    other = turned(some, threshold, rng)
    made, lost = Index(size, width, MOST_TABLES, []), np.ones(len(some), bool)
    most = int(MISSED * len(some)) - 3
    while True:
        made.rotations.append(rotation(fitted, 5 + len(made.rotations)))
        one = Index(size, width, MOST_TABLES, made.rotations[-1:])
        before = (len(made.rotations) - 1) * one.parts(some[:1]).shape[1]
        if not before:
            apart = np.sort(np.bitwise_count(one.codes(some) ^ one.codes(other)))
            made.near = int(apart[len(apart) - 1 - most])
        for k, same in enumerate((one.parts(some) == one.parts(other)).T):
            lost &= ~same
            if lost.sum() <= most:
                made.tables = before + k + 1
                return made
        if before + one.parts(some[:1]).shape[1] >= MOST_TABLES:
            return index(sample, threshold, width - 1)  # so wide a part would take too many tables


def _coded(batches: Iterator[pa.RecordBatch], known: Index | None) -> Iterator[pa.RecordBatch]:
    """p1, label, size, embedding -> p1, code, parts, label, size."""
    for batch in small(batches):
        lists, size = batch.column("embedding"), np.asarray(batch.column("size"))
        flat, begin = np.asarray(lists.flatten()), np.cumsum(size) - size
        parts: list[list[int]] = [[0]] * len(size)
        codes = np.zeros(len(size), np.uint64)
        if known is not None and (rows := np.flatnonzero(size == known.size)).size:
            x = unit(flat[begin[rows, None] + np.arange(known.size)].astype(float))
            codes[rows] = known.codes(x)
            for k, p in zip(rows, known.parts(x).tolist(), strict=True):
                parts[k] = p
        names = ["p1", "code", "parts", "label", "size"]
        columns = [batch.column("p1"), pa.array(codes.view(np.int64)), pa.array(parts, pa.list_(pa.int64())), batch.column("label"), batch.column("size")]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _forest(ids: np.ndarray, codes: np.ndarray, first: np.ndarray, second: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each of a bucket's classes that is near another, with the least that it is connected to here. first, second:
    those rows that are compared, with each other or, where they differ, one side with the other."""
    root, met = np.arange(len(ids)), np.zeros(len(ids), bool)
    for begin in range(0, len(first), STRIP):
        own = first[begin : begin + STRIP]
        close = np.bitwise_count(codes[own, None] ^ codes[None, second]) <= near
        close &= own[:, None] != second[None, :]
        for k in np.flatnonzero(close.any(1)):
            these = np.append(second[close[k]], own[k])
            met[these] = True
            roots = np.unique(root[these])
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
    some = np.flatnonzero(met)
    return ids[some], ids[root[some]]


def _near(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket, low, high -> (u, v) of what is near by code, of each bucket's pair of blocks."""

    def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.flatnonzero((np.diff(rows[:3]) != 0).any(0)) + 1
        out = []
        for own in np.split(rows, group, axis=1):
            if own.shape[1] > 1:
                own = own[:, np.argsort(own[4], kind="stable")]
                one, other = (np.flatnonzero(own[3] == own[k, 0]) for k in (1, 2))
                out.append(_forest(own[4], own[5].view(np.uint64), one, other, near))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["u", "v"])

    held = np.zeros((6, 0), np.int64)
    for batch in small(batches):
        held = np.concatenate([held, np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "low", "high", "block", "p1", "code")])], axis=1)
        if held.shape[1] > CODES and len(edges := np.flatnonzero((np.diff(held[:3]) != 0).any(0))):
            yield from told(held[:, : edges[-1] + 1])
            held = held[:, edges[-1] + 1 :]
    yield from told(held)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _compared(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within small groups, or of two blocks of a large one: class, vectors linked, the least class it is united with here.

    No more than a strip of a block's pairs is in memory at a time.
    """
    rows = rows.sort_values(["part", "cid", "p1", "p2"], kind="stable")
    low, high = (int(rows[c].iloc[0]) for c in ("low", "high"))
    x = unit(np.stack(rows["embedding"].to_numpy()).astype(float))
    block, part, n = rows["block"].to_numpy(), rows["part"].to_numpy(), rows["n"].to_numpy().astype(float)
    links, root = np.zeros(len(rows)), np.arange(len(rows))
    starts = np.flatnonzero(np.diff(part, prepend=part[0] - 1, append=part[-1] + 1))
    for first, last in zip(starts[:-1], starts[1:], strict=True):
        here = np.arange(first, last)
        a, b = here[block[here] == low], here[block[here] == high]
        for begin in range(0, len(a), STRIP):
            own = a[begin : begin + STRIP]
            linked = x[own] @ x[b].T >= threshold
            if low == high:
                linked &= own[:, None] < b[None, :]
            if not linked.any():
                continue
            links[own] += linked @ n[b]
            links[b] += n[own] @ linked
            for k in np.flatnonzero(linked.any(1)):
                met = np.unique(np.append(root[b[linked[k]]], root[own[k]]))
                if len(met) > 1:
                    within = root[first:last]
                    within[np.isin(within, met[1:])] = met[0]
    some = np.flatnonzero(links)
    own, least = rows.iloc[some], rows["cid"].to_numpy()[root[some]]
    return pd.DataFrame({"p1": own["p1"].to_numpy(), "p2": own["p2"].to_numpy(), "cid": own["cid"].to_numpy(), "n_links": links[some].astype(np.int64), "least": least})


def _in_blocks(rows: DataFrame, key: list[str], most: int, split: str) -> DataFrame:
    """rows with block, low, high: those of a key with more than `most` rows once for each pair of blocks that theirs is in."""
    large = written(rows.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > most), "large")
    blocks = F.coalesce(F.ceil(F.col("members") / most).cast("int"), F.lit(1))
    placed = rows.join(large, key, "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(split), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    return placed.withColumn("pair", F.explode(pairs)).withColumns({"low": F.col("pair.low"), "high": F.col("pair.high")}).drop("pair", "members")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, most_fitted: int = 20_000, width: int | None = None) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors with equal labels, not null, and equal lengths are linked when their cosine in doubles is threshold or more;
    equal vectors always are. A null, zero or non-finite vector, one with a null component, without a label or without
    an id is linked with nothing. Rows that repeat an id are vectors of their own, each with its own links and component.
    An empty table gives an empty result; other columns are not read.

    The rotations are learnt on about most_fitted vectors of the commonest length, chosen by a hash of the id; vectors
    of other lengths are all compared, in blocks, within each label and length. width: bits of a part; None: by the rule above.
    """
    inner = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if inner == "float" else "array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    key = [F.xxhash64("label", "embedding").alias("p1"), F.xxhash64("embedding", "label", F.lit(1)).alias("p2")]
    classes = rows.filter("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"))
    classes = written(classes.select("cid", "label", F.size("embedding").alias("size"), "n", *key, "embedding"), "vectors")

    by_label = classes.groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    commonest, known, total = by_label.orderBy(F.desc("all"), "size").limit(1).collect(), None, 0
    if commonest:
        size, most, total = commonest[0]
        bits = max(LEAST_WIDTH, int(np.ceil(np.log2(max(most, 1) / BUCKET)))) if width is None else width
        share = int((1 << 20) * most_fitted / total)
        chosen = classes.filter((F.col("size") == size) & (F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < share)).select("cid", "p1", "embedding")
        sample = np.array([r["embedding"] for r in sorted(chosen.collect(), key=lambda r: (r["cid"], r["p1"]))], float).reshape(-1, size)
        known = index(unit(sample) if len(sample) else sample, threshold, min(bits, MOST_WIDTH))
    near = known.near if known is not None else 64
    coded = classes.select("p1", "label", "size", "embedding").mapInArrow(partial(_coded, known=known), "p1 long, code long, parts array<long>, label long, size int")
    each = coded.select("p1", "code", "label", "size", F.posexplode("parts").alias("table", "part")).select(F.xxhash64("label", "size", "table", "part").alias("bucket"), "p1", "code")
    each = _in_blocks(written(each, "codes"), ["bucket"], CODES, "p1")
    dealt = each.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    links = dealt.select("bucket", "low", "high", "block", "p1", "code").mapInArrow(partial(_near, near=near), "u long, v long").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    # what is connected by codes meets once, with its vectors
    groups = components(links)
    groups = groups.select(F.col("node").alias("p1"), "component").union(groups.select("component", "component").distinct())
    meet = _in_blocks(classes.join(groups, "p1").withColumnRenamed("component", "part"), ["label", "size", "part"], BLOCK, "p2")
    shelf = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(1 + total // SHELF))).otherwise(F.xxhash64("part"))
    meet = meet.withColumn("shelf", shelf).withColumn("alone", F.col("blocks") > 1)

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        return _compared(rows, threshold)

    found = meet.groupBy("label", "size", "alone", "shelf", "low", "high").applyInPandas(compared, "p1 long, p2 long, cid long, n_links long, least long")
    found = written(found, "links")
    comp = components(found.filter("cid != least").select(F.greatest("cid", "least").alias("u"), F.least("cid", "least").alias("v")))
    links = found.groupBy("p1", "p2").agg(F.sum("n_links").alias("n_links"))
    of_class = classes.select("p1", "p2", "cid", "n").join(links, ["p1", "p2"], "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    of_class = written(of_class.select("p1", "p2", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "classes")
    ids = rows.select("vec_id", *[F.when(F.col("embedding").isNotNull(), k).alias(n) for k, n in zip(key, ("p1", "p2"), strict=True)])
    out = ids.join(of_class, ["p1", "p2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
