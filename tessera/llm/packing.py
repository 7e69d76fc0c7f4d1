"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens. Each task packs the
documents of its own partition, so nothing is shuffled: a bounded pool of pieces is kept, and the open sequence takes
the piece with the largest dot product of its needs and what the sequence has left, each in parts of the limit. When
no whole piece fits any more, one is cut to fill the rest. What a task can't fill a sequence with at its end, some pieces
at most, goes to a second pass with that of its neighbours; sequences that can't be filled there are cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, small, written

#: Pieces that wait for a place, at most, besides those of one batch.
POOL = 256
#: Words whose ids a task remembers, and rows it gathers before it hands them on.
CACHE, ROWS = 700_000, 4096
#: Limits for instruction data: a quarter of an example is its prompt, and the loss limit binds where pieces have less of it.
INSTRUCTIONS = {"max_tokens": 2048, "max_segments": 64, "max_loss": 1792, "prompt_share": 0.25}
#: Tasks whose last pieces are packed together.
NEIGHBOURS = 64
#: A text whose tokens, by a tokenizer that never joins over white space, are those of its words.
PROBE = "Ab c  d\te 1.\nf \u2014 \u00e9\u00e9 \"g\" 1234\r\n x_y"
#: Parts words that are encoded in one call; a sign that is a token of its own.
MARK = "\x01"
#: Encoders of this Python worker: its next task knows the words of the last one.
_ENCODERS: dict = {}


class WordEncoder:
    """Token ids of texts by a public tokenizer: each distinct word is encoded once, where it never joins what white space parts."""

    def __init__(self, path: str | None, end_id: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.by_word = self._ids([PROBE]).tolist() == self._ids(PROBE.split()).tolist() and len(self._ids([MARK])) == 1
        self.mark = self._ids([MARK])[0] if self.by_word else None
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = Words(), np.empty(0, np.uint32)
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and how many each has: many words in one call, parted by a mark."""
        if not any(MARK in w for w in words):
            texts = [f" {MARK} ".join(words[k : k + 64]) + f" {MARK}" for k in range(0, len(words), 64)]
            flat = self._ids(texts)
            ends = np.flatnonzero(flat == self.mark)
            if len(ends) == len(words):
                return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1
        got = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            got = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
            return [np.array([*e.ids, self.end_id], np.uint32) for e in got]
        if self.words.full(CACHE):
            self.forget()
        numbers = [self.words.numbers(x.split()) for x in texts]
        if fresh := self.words.take():
            ids, count = self._encode([w.decode("utf-8", "replace") for w in fresh])
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        count = self.count[flat]
        place = np.repeat(self.begin[flat] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ids = self.ids[place]
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(n) for n in numbers], dtype=np.int64)] if numbers else []
        out, begin = [], 0
        for end in ends:
            out.append(np.append(ids[begin:end], np.uint32(self.end_id)))
            begin = end
        return out


class Packer:
    """Gives the pieces of examples a sequence and a place in it, through `emit(example, start, length, sequence, offset)`."""

    def __init__(self, emit: Callable, max_tokens: int, max_segments: int, max_loss: int, first_sequence: int = 0) -> None:
        self.emit, self.caps = emit, np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.sequence = first_sequence
        self.waiting: list[tuple] = []  # (example, start, end, loss_from)

    def add(self, example, start: int, end: int, loss_from: int) -> None:
        """The example's tokens from start to end; those from loss_from on bear loss. Where loss is no limit of its own,
        what fills a sequence by itself is placed at once."""
        if end - start > self.max_tokens > self.max_loss and start < loss_from < end:
            # a long example's prompt is by itself: it fills sequences that have no room for loss any more
            self.add(example, start, loss_from, loss_from)
            start = loss_from
        while start < end:
            stop = self._reach(start, end, loss_from, self.max_tokens, self.max_loss)
            if stop - start == self.max_tokens <= self.max_loss:
                self._close([(example, start, stop, loss_from)])
            else:
                self.waiting.append((example, start, stop, loss_from))
            start = stop
        if len(self.waiting) >= 2 * POOL:
            self.pack(POOL)

    @staticmethod
    def _reach(start: int, end: int, loss_from: int, tokens: int, loss: int) -> int:
        """Where a piece from start ends at the latest."""
        return min(end, start + tokens, max(start, loss_from) + loss)

    def pack(self, leave: int = 0) -> list[tuple]:
        """Fills sequences until `leave` pieces or fewer wait. At the end (leave 0), returns the pieces that fill none."""
        pool, short = self.waiting, []
        need = lambda s, e, lf: (e - s, 1, max(0, e - max(s, lf)))
        needs = np.array([need(s, e, lf) for _, s, e, lf in pool], float).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        left = len(pool)
        while left > leave:
            room, pieces = self.caps.copy(), []
            while left and room[0] > 0 and room[1] > 0:
                gain = needs @ (room / self.caps**2)
                fits = alive & (needs <= room).all(1)
                if fits.any():
                    k = int(np.where(fits, gain, -1).argmax())
                    example, start, end, loss_from = pool[k]
                    alive[k], left = False, left - 1
                else:  # cut the one that wants most of what is left; without room for loss, one that begins without it
                    able = alive if room[2] > 0 else alive & (needs[:, 0] > needs[:, 2])
                    if not able.any():
                        break
                    k = int(np.where(able, gain, -1).argmax())
                    example, start, stop, loss_from = pool[k]
                    end = self._reach(start, stop, loss_from, int(room[0]), int(room[2]))
                    pool[k] = (example, end, stop, loss_from)
                    needs[k] = need(end, stop, loss_from)
                room -= need(start, end, loss_from)
                pieces.append((example, start, end, loss_from))
            if leave or room[0] == 0:
                self._close(pieces)
            else:
                short += pieces
        self.waiting = [p for p, a in zip(pool, alive, strict=True) if a]
        return short

    def finish(self, pieces: list[tuple]) -> None:
        """Places pieces that fill no sequence: those of each that can be made of them, at powers of two."""
        room, own = self.caps.copy(), []
        for example, start, end, loss_from in pieces:
            own_needs = np.array((end - start, 1, max(0, end - max(start, loss_from))), float)
            if own and (own_needs > room).any():
                self._close(own)
                room, own = self.caps.copy(), []
            room -= own_needs
            own.append((example, start, end, loss_from))
        if own:
            self._close(own)

    def _close(self, pieces: list[tuple]) -> None:
        """A full sequence, or several whose lengths are powers of two."""
        total = sum(e - s for _, s, e, _ in pieces)
        sizes = [total] if total == self.max_tokens else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        pieces = list(reversed(pieces))
        for size in sizes:
            offset = 0
            while offset < size:
                example, start, end, loss_from = pieces.pop()
                if (stop := min(end, start + size - offset)) < end:
                    pieces.append((example, stop, end, loss_from))
                self.emit(example, start, stop - start, self.sequence, offset)
                offset += stop - start
            self.sequence += 1


class Rows:
    """Placed pieces and those left over as rows of `schema`; an example is (doc_id, where its ids begin, ids, doc_tokens)."""

    def __init__(self, schema: pa.Schema, with_ids: bool) -> None:
        self.rows, self.schema, self.with_ids = [], schema, with_ids

    def placed(self, example, start: int, length: int, sequence: int, offset: int) -> None:
        doc_id, first, ids, n = example
        piece = ids[start - first : start - first + length]
        self.rows.append((doc_id, start, length, zlib.crc32(piece.astype("<u4").tobytes()), n, sequence, offset, piece.astype(np.int32) if self.with_ids else None, None, None))

    def left(self, pieces: list[tuple], task: int) -> None:
        for (doc_id, first, ids, n), start, end, loss_from in pieces:
            self.rows.append((doc_id, start, end - start, None, n, None, None, ids[start - first : end - first].astype(np.int32), loss_from, task))

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.schema.types, strict=True)], schema=self.schema)
        self.rows = []
        return made


def _pack_task(batches: Iterator[pa.RecordBatch], path, end_id: int, limits: tuple[int, int, int], prompt_share: float, with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encode = _ENCODERS.get((path, end_id)) or WordEncoder(path, end_id)
    _ENCODERS[path, end_id] = encode
    task = TaskContext.get().partitionId()
    out = Rows(schema, with_ids)
    packer = Packer(out.placed, *limits, first_sequence=task << 36)
    for batch in small(batches):
        n_loss = batch.column("n_loss").to_pylist()
        for doc_id, ids, loss in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), n_loss, strict=True):
            n = len(ids)
            packer.add((doc_id, 0, ids, n), 0, n, int(n * prompt_share) if loss is None else n - min(max(loss, 0), n))
        if len(out.rows) > ROWS:
            yield out.batch()
    out.left(packer.pack(), task)
    if out.rows:
        yield out.batch()


def _pack_left(table: pa.Table, limits: tuple[int, int, int], with_ids: bool, schema: pa.Schema) -> pa.Table:
    """The last pieces of NEIGHBOURS tasks: packed in the order of their tasks, so a second run gives the same."""
    table = table.sort_by([("task", "ascending"), ("number", "ascending")])
    out = Rows(schema, with_ids)
    group = table.column("task")[0].as_py() // NEIGHBOURS
    packer, short = Packer(out.placed, *limits, first_sequence=1 << 62 | group << 32), []
    columns = [table.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids", "loss_from")]
    for doc_id, start, length, n, ids, loss_from in zip(*columns, strict=True):
        packer.waiting.append(((doc_id, start, np.array(ids, np.uint32), n), start, start + length, loss_from))
        if len(packer.waiting) >= 2 * POOL:
            packer.pack(POOL)
    short = packer.pack()
    packer.finish(short)
    return pa.Table.from_batches([out.batch()])


def pack(docs: DataFrame, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, prompt_share: float = 0.0) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    tokenizer: the path of a tokenizer file on the executors; None: word_bpe_49k.json of public_tokenizers. loss_col:
    how many tokens at an example's end bear loss; where it is null or not given, all but the first prompt_share of
    them. max_loss None: as max_tokens. A null text is empty and gives one piece, its end id. Each row of docs is an
    example of its own, also one that repeats an id or has none. An empty table gives an empty result. Only the named
    columns are read. A task that is run again packs its partition in the same way.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    if max_tokens < 1 or max_tokens & (max_tokens - 1) or min(limits) < 1:
        raise ValueError("max_tokens must be a power of two, and every limit at least 1")
    if not 0 <= prompt_share <= 1:
        raise ValueError("prompt_share is a share")
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [StructField("doc_id", docs.schema[id_col].dataType), *(StructField(n, LongType()) for n in names), StructField("ids", ArrayType(IntegerType()))]
    schema = StructType([*fields, StructField("loss_from", LongType()), StructField("task", LongType())])
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), (F.col(loss_col) if loss_col else F.lit(None)).cast("long").alias("n_loss"))
    first = rows.mapInArrow(partial(_pack_task, path=tokenizer, end_id=end_id, limits=limits, prompt_share=prompt_share, with_ids=with_ids, schema=arrow), schema)
    first = written(first.withColumn("number", F.monotonically_increasing_id()), "pieces")

    def again(left: pa.Table) -> pa.Table:
        return _pack_left(left, limits, with_ids, arrow)

    left = first.filter("sequence_id IS NULL").groupBy(F.floor(F.col("task") / NEIGHBOURS)).applyInArrow(again, schema)
    out = ["doc_id", *names, *(["ids"] if with_ids else [])]
    return first.filter("sequence_id IS NOT NULL").select(*out).union(left.select(*out))
