"""Near duplicates by SuperMinHash signatures, banding, verification on whole shingle sets, and union-find.

SuperMinHash draws, for each shingle, a permutation of the signature's places and gives the j-th of them a value in
[j, j + 1). Places of one shingle are so correlated, which lowers the variance, and once the largest value of a
signature is under j no later draw can change it: few draws are made. Documents with equal sets are one class from then
on. Classes that share a band are compared on their sets, first with one hub of the bucket, then with random hubs of
parts of it, and only those of a bucket that are still apart by their rarest shingles. Where all of these are shared by
many, as in a large group of copies of a text that isn't there itself, sets are compared by what they differ in from the
group: first with the one nearest to it, of all and of those that share a difference, then by their rarest differences. A
bucket of n near copies costs some n comparisons, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Words, discard, mix64, named, small, unused, written
from tessera.llm.union_find import components

#: A pair at the threshold of 0.8 shares none of 24 bands of 4 with a chance of (1 - 0.8 ** 4) ** 24, 3 in a million.
BANDS, BAND_ROWS = 24, 4
CACHE, CHUNK = 250_000, 150_000
#: Members of a part of a bucket that share a random hub, about.
PART = 64
#: Sets of those still apart that may share a shingle for it to be compared by; what more share is compared by differences.
OFTEN = 64


class Shingler:
    """Sets of 64-bit shingle hashes, sorted, from whole texts; a text with fewer words is one shingle, one without words has none."""

    def __init__(self, size: int) -> None:
        self.size, self.words, self.hashes = size, Words(), np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.words.full(CACHE):
            self.words, self.hashes = Words(), np.empty(0, np.uint64)
        numbers = [self.words.numbers(x.lower().split()) for x in texts]
        fresh = self.words.take()
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))])
        return [self._set(self.hashes[n]) for n in numbers]

    def _set(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        width = min(self.size, len(h))
        x = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            x = mix64(x + h[k : len(h) - width + 1 + k])
        return np.unique(x)


def superminhash(flat: np.ndarray, owner: np.ndarray, n_sets: int, places: int) -> np.ndarray:
    """Signatures (n_sets, places) of sets given as elements and the number of the set that each belongs to.

    A value is (draw << 32) + a random number: the integer form of r + j.
    """
    sig = np.full(n_sets * places, np.iinfo(np.int64).max, np.int64)
    for begin in range(0, len(flat), CHUNK):
        x, own = flat[begin : begin + CHUNK], owner[begin : begin + CHUNK]
        order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(x), 1))
        for j in range(places):
            alive = (sig.reshape(n_sets, places).max(1) >= np.int64(j) << 32)[own]
            if not alive.all():
                x, own, order = x[alive], own[alive], order[alive]
            if not len(x):
                break
            h = mix64(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + ((h >> np.uint64(32)) % np.uint64(places - j)).astype(np.int64)
            rows = np.arange(len(x))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            np.minimum.at(sig, own * places + place, (np.int64(j) << 32) + (h & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return sig.reshape(n_sets, places)


def _signed(batches: Iterator[pa.RecordBatch], size: int, bands: int, band_rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_shingles, two fingerprints of the set, its bands."""
    shingles = Shingler(size)
    for batch in small(batches):
        sets = shingles(batch.column("text").to_pylist())
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), n)
        sig = superminhash(flat, owner, len(sets), bands * band_rows).view(np.uint64).reshape(len(sets), bands, band_rows)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
        for k in range(band_rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        prints = []
        for salt in (1, 2):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(flat * np.uint64(2) + np.uint64(salt)), dtype=np.uint64)])
            ends = np.cumsum(n)
            prints.append(pa.array((total[ends] - total[ends - n]).view(np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(np.ascontiguousarray(key).view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *prints, lists], names=["doc_id", "n_shingles", "print1", "print2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    shingles = Shingler(size)
    for batch in small(batches):
        sets = shingles(batch.column("text").to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["cid", "shingles"])


def _differences(apart: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """Members of a bucket, (bucket, part, cid, n, component), with the shingles by which theirs in `common` differ from the bucket's core.

    The core is what more than half of the members have. Two sets that share shingles of `common` only are near where
    2 * (100 + percent) times the number of differences that they share is the sum of their `far` at least. So two sets
    whose `far` is 0 or less together are near, and near to the one whose `far` is least; any other near ones share a difference.
    """
    inside = apart.join(common, "cid")
    per_part = inside.groupBy("bucket", "part").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    several = per_part.groupBy("bucket").agg(F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("bucket", "m")
    told = per_part.select("bucket", "part").join(several, "bucket")  # to each part of a bucket
    inside = written(inside.join(told, ["bucket", "part"]), "inside")
    core = inside.select("bucket", "m", F.explode("common").alias("s")).groupBy("bucket", "s").agg(F.count("*").alias("has"), F.first("m").alias("m"))
    core = core.filter("2 * has > m").groupBy("bucket").agg(F.collect_list("s").alias("core"))
    told = told.drop("m").join(core, "bucket", "left")
    inside = inside.join(told, ["bucket", "part"]).withColumn("core", F.coalesce("core", F.expr("CAST(array() AS array<bigint>)")))
    inside = inside.withColumn("differ", F.concat(F.array_except("common", "core"), F.array_except("core", "common"))).withColumn("size", F.size("differ"))
    far = (F.col("size") - F.size("common")) * (100 + percent) + 2 * percent * F.col("n")
    inside = written(inside.select("bucket", "part", "cid", "n", "component", "differ", "size", far.alias("far")), "far")
    # who shares all of its differences with another is near to it only up to this
    most = inside.groupBy("bucket").agg(F.max(F.col("size") * 2 * (100 + percent) - F.col("far")).alias("most"))
    told = inside.select("bucket", "part").distinct().join(most, "bucket")
    return inside.join(told, ["bucket", "part"]).filter("far <= most").drop("most")


def _with_nearest(differ: DataFrame, percent: int) -> DataFrame:
    """Sets with the `hub` that is nearest to the core, of their bucket and of those that share each of their differences, if they may be near."""
    hub = F.min(F.struct("far", "cid", "n", "component", "size")).alias("hub")
    parts = differ.select("bucket", "part").distinct()
    of_bucket = differ.join(parts.join(differ.groupBy("bucket").agg(hub), "bucket"), ["bucket", "part"]).drop("differ", "part")
    each = differ.withColumn("s", F.explode("differ")).drop("differ", "part")
    of_difference = each.join(each.groupBy("bucket", "s").agg(hub), ["bucket", "s"]).drop("s")
    may = F.least("size", "hub.size") * 2 * (100 + percent) >= F.col("far") + F.col("hub.far")
    return of_bucket.unionByName(of_difference).filter("component != hub.component").filter(may)


def _rarest_differences(differ: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Those of each set's differences, rarest of its bucket first, one of which any near set shares that isn't in its component.

    `main` are the sets in the component of the one nearest to the core: no two of these are to be compared.
    """
    now = differ.drop("component").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    per_part = now.groupBy("bucket", "part").agg(F.min(F.struct("far", "component")).alias("first"))
    parts = per_part.select("bucket", "part")
    now = now.join(parts.join(per_part.groupBy("bucket").agg(F.min("first").alias("first")), "bucket"), ["bucket", "part"])
    now = now.withColumn("main", F.col("component") == F.col("first.component"))
    other = now.filter("NOT main").groupBy("bucket").agg(F.min("far").alias("other"))
    now = now.join(parts.join(other, "bucket"), ["bucket", "part"]).withColumn("least", F.when(F.col("main"), F.col("other")).otherwise(F.col("first.far")))
    shared = lambda place: (F.col("size") - place + 1) * 2 * (100 + percent) >= F.col("far") + F.col("least")
    each = now.filter(shared(F.lit(1))).withColumn("s", F.explode("differ")).drop("differ", "part")
    # what sets of one component only have comes first, and is only counted
    often = each.groupBy("bucket", "s").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    own = Window.partitionBy("bucket", "cid")  # one document's differences
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "s"))
    each = each.join(often, ["bucket", "s"]).withColumn("place", place).filter(shared(F.col("place")))
    return each.select("bucket", "s", "cid", "n", "component", "main", "size", "far", "place")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id (long), n_shingles, component_id, kept.

    Texts are linked when 100 * |A and B| >= percent * |A or B| for their sets of `size`-word shingles, A-Z lower-cased.
    A text with fewer words is one shingle; a null, empty or blank text has none, is linked with nothing and stays. A
    row without an id is linked with nothing and stays. Rows that repeat an id are one document, linked by any of their
    texts. Equal texts are linked through their class. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).cast("binary").alias("text"))
    signed = written(rows.mapInArrow(partial(_signed, size=size, bands=bands, band_rows=band_rows), "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>"), "signed")
    same = ["n_shingles", "print1", "print2"]
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")

    # the members of buckets of two or more classes
    in_bucket = classes.select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    several = in_bucket.groupBy("bucket").agg(F.min("cid").alias("hub"), F.min_by("n", "cid").alias("hub_n"), F.count("*").alias("members")).filter("members > 1")
    # a written table and a merge join: both sides are plain shuffles, of which Spark deals out a hot bucket's rows anew
    several = written(several, "buckets")
    part = F.pmod(F.xxhash64("cid", F.lit(1)), F.ceil(F.col("members") / PART))
    members = written(in_bucket.join(several.hint("merge"), "bucket").withColumn("part", part), "members")
    needed = members.select("cid").distinct()
    texts = rows.join(needed.hint("merge"), rows["doc_id"] == needed["cid"], "left_semi")  # ids without a size bound: never broadcast
    sets = written(texts.mapInArrow(partial(_sets, size=size), "cid long, shingles array<long>"), "sets")

    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent  # noqa: E731  else the sizes alone rule it out

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of pairs (u, v) whose whole sets are near enough."""
        x = pairs.join(sets.select(F.col("cid").alias("u"), F.col("shingles").alias("a")), "u")
        x = x.join(sets.select(F.col("cid").alias("v"), F.col("shingles").alias("b")), "v")
        x = x.withColumn("both", F.size(F.array_intersect("a", "b")))
        return x.filter(F.col("both") * 100 >= (F.size("a") + F.size("b") - F.col("both")) * percent).select("u", "v")

    def joined(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The components so far, and the members of those buckets that hold several."""
        comp = components(links)
        at = members.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        open_ = at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("members").alias("members")).filter("low != high")
        # told to each part of a bucket, so that the join's keys hold some PART rows
        parts = open_.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / PART) - 1)).alias("part"))
        return comp, written(at.join(parts, ["bucket", "part"]).select("bucket", "part", "cid", "n", "component"), "open")

    first = members.filter("hub != cid").filter(near(F.col("n"), F.col("hub_n"))).select(F.col("cid").alias("u"), F.col("hub").alias("v")).distinct()
    links = written(linked(first), "linked")
    comp, apart = joined(links)

    hub = F.min_by(F.struct("cid", "n", "component"), F.xxhash64("cid", F.lit(2)))
    hubs = apart.groupBy("bucket", "part").agg(hub.alias("hub"))
    second = apart.join(hubs, ["bucket", "part"]).filter(F.col("component") != F.col("hub.component")).filter(near(F.col("n"), F.col("hub.n")))
    links = written(links.union(linked(second.select(F.col("cid").alias("u"), F.col("hub.cid").alias("v")).distinct())), "linked")
    comp, apart = joined(links)

    # what is still apart: near sets share one of their rarest shingles, of as many as may be missing from the other and one more
    who = apart.groupBy("cid").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    each = sets.join(who, "cid").select("cid", "n", "component", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often")).filter("often > 1")
    # shingles that only one has come first in its order, and are only counted
    own = Window.partitionBy("cid")  # one document's shingles
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "s"))
    least = F.ceil(F.col("n") * percent / 100)  # what a near set shares with it
    crowded = F.count_if(F.col("often") > OFTEN).over(own) >= least
    lead = each.join(often, "s").withColumn("place", place).withColumn("crowded", crowded)
    lead = lead.filter((F.col("place") <= F.col("n") - least + 1) & (F.col("often") <= OFTEN) | F.col("crowded") & (F.col("often") > OFTEN))
    lead = written(lead.select("cid", "n", "component", "s", "often", "place"), "lead")
    rare = lead.filter(F.col("often") <= OFTEN)
    a, b = rare.alias("a"), rare.alias("b")
    third = a.join(b, F.col("a.s") == F.col("b.s")).filter("a.cid > b.cid AND a.component != b.component").filter(near(F.col("a.n"), F.col("b.n")))
    # the first shingle that a near pair shares leaves enough after it in both
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    third = third.filter((rest + 1) * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent).select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v"))

    # near sets that share none of those share shingles only that more than OFTEN have: they are compared by what they differ in
    # from what most of their bucket have
    common = written(lead.filter(F.col("often") > OFTEN).groupBy("cid").agg(F.collect_list("s").alias("common")), "common")
    differ = written(_differences(apart, common, percent), "differ")
    fourth = _with_nearest(differ, percent).filter(near(F.col("n"), F.col("hub.n"))).select(F.col("cid").alias("u"), F.col("hub.cid").alias("v"))
    links = written(links.union(linked(third.union(fourth).distinct())), "linked")
    comp = components(links)
    tokens = written(_rarest_differences(differ, comp, percent), "tokens")
    a, b = tokens.filter("NOT main").alias("a"), tokens.alias("b")
    fifth = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.s") == F.col("b.s"))).filter("(b.main OR a.cid > b.cid) AND a.component != b.component").filter(near(F.col("a.n"), F.col("b.n")))
    rest = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    fifth = fifth.filter((rest + 1) * 2 * (100 + percent) >= F.col("a.far") + F.col("b.far"))
    comp = components(links.union(linked(fifth.select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v")).distinct())))

    of_class = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select(*same, F.coalesce("component", "cid").alias("component_id"))
    of_class = written(of_class, "components")
    for t in (links, members, several, sets, apart, lead, common, differ, tokens, classes):
        discard(t)
    out = signed.drop("bands").join(of_class, same, "left")
    # a row without an id has no class of its own, though its text may have one
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that stay, with all their columns: exactly one of each group, that with the smallest id.

    Groups are of rows: of those that repeat an id, each counts by its own text, as does a row without an id, which is
    larger than any other. Of several rows with the smallest id, one stays. A text without words is in no group and
    stays. Columns may have any names; an empty table gives an empty result. Each row's number is written once, with the row.
    """
    row = unused(docs.columns, "_row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = keyed.select(F.col(row).alias("row"), named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    groups = near_groups(texts, id_col="row", text_col="text", **settings).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    kept = groups.join(texts.drop("text"), "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(kept, row, "left_semi").select(*map(named, docs.columns))
