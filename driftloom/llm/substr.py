"""Repeated passages across documents: fixed-block anchors, rolling probes, maximal exact repeats."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, chunks, partitions, ship

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a block's hash that are sent beside its bucket's. A chance agreement only adds a suspect.
WITHIN = 31
#: Kinds of rows: an answer about anchors, suspect windows, an answer about windows, a group's note to itself.
PROBE, ANCHORED, WINDOWS, GONE, NOTE = range(5)
_OUT = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_SCHEMA = "bucket long, g long, kind int, a binary, b binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * _STEP + words[k : len(words) - n + 1 + k]
    return mix(total)


# -- rows of packed values ---------------------------------------------------------------------------------------------


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``data`` cut to one binary value a row, of ``sizes`` elements each."""
    cuts = np.concatenate([[0], np.cumsum(sizes * data.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array | pa.ChunkedArray, kind: type | str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a binary column in a row, and how many each of its rows has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.binary())
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if cuts[0] == cuts[-1]:
        return np.empty(0, kind), np.diff(cuts)
    return np.frombuffer(column.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].copy().view(kind), np.diff(cuts) // np.dtype(kind).itemsize


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the flags of rows stand if each row begins a byte, and the bytes of each row."""
    wide = -(-sizes // 8)
    return np.repeat(np.cumsum(wide) * 8 - wide * 8 - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), wide


def _bits(flags: np.ndarray, sizes: np.ndarray) -> pa.Array:
    place, wide = _places(sizes)
    out = np.zeros(int(wide.sum()) * 8, bool)
    out[place] = flags
    return _binary(np.packbits(out), wide)


def _flags(column: pa.Array | pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    return np.unpackbits(_flat(column, np.uint8)[0]).astype(bool)[_places(sizes)[0]]


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_keys)))


def _table(bucket: np.ndarray, g: np.ndarray | int, kind: int, a: pa.Array, b: pa.Array | None = None) -> pa.Table:
    n = len(bucket)
    g = np.full(n, g, np.int64) if np.isscalar(g) else g
    return pa.Table.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(g), pa.array(np.full(n, kind, np.int32)), a, pa.nulls(n, pa.binary()) if b is None else b], schema=_OUT)


# -- a group of documents ----------------------------------------------------------------------------------------------


class _Codes(dict):
    """Numbers of distinct words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


class Group:
    """The documents of one group: word digests in a row, document bounds, their distinct blocks, and their windows.

    All that is exchanged about a group is in the order of sorted hashes, so that it doesn't depend on the order of rows.
    """

    def __init__(self, table: pa.Table, window: int, bits: int):
        self.ids, self.copies, texts = [], [], []
        for batch in table.to_batches():
            self.ids += batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            self.copies += batch.column(batch.schema.get_field_index("copies")).to_pylist()
            texts += as_bytes(batch, "text")
        self.g, self.window, self.block, self.bits = table.column("g")[0].as_py(), window, (window + 1) // 2, bits
        self.words = [t.split() for t in texts]
        size = np.fromiter(map(len, self.words), np.int64, len(texts))
        n = int(size.sum())
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        codes = _Codes()
        code = np.fromiter(map(codes.__getitem__, chain.from_iterable(self.words)), np.int64, n)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, codes)), "<u8").reshape(-1, 2)
        self.high, self.low = (digests[code, k] for k in (0, 1)) if n else (np.empty(0, np.uint64),) * 2
        self.doc = np.repeat(np.arange(len(texts)), size)
        offset = np.arange(n) - self.starts[self.doc]
        left = self.ends[self.doc] - np.arange(n)
        self.at = np.flatnonzero(left >= self.block)  # where a block lies within one document
        self.whole = left >= window
        blocks = rolling(self.high, self.block)[self.at] if len(self.at) else np.empty(0, np.uint64)
        self.values, self.which, count = np.unique(blocks >> np.uint64(64 - bits - WITHIN), return_inverse=True, return_counts=True)
        self.anchors = np.zeros(len(self.values), bool)
        self.anchors[self.which[offset[self.at] % self.block == 0]] = True
        self.repeated = self.anchors & (count > 1)
        self.buckets = (self.values >> np.uint64(WITHIN)).astype(np.int64)

    def _spread(self, answers: pa.Table, buckets: np.ndarray) -> np.ndarray:
        """Answers by bucket as a flag for each value; ``buckets`` are those of the values, in order."""
        out = np.zeros(len(buckets), bool)
        if answers.num_rows:
            named = answers.column("bucket").to_numpy()
            start = np.searchsorted(buckets, named)
            sizes = np.searchsorted(buckets, named, "right") - start
            out[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = _flags(answers.column("a"), sizes)
        return out

    def found(self, answers: pa.Table) -> np.ndarray:
        """Which distinct blocks another group has too, as an anchor there or here."""
        return self._spread(answers, self.buckets)

    def suspect(self, found: np.ndarray) -> None:
        """Windows around hits: their starts, and the distinct ones by digest with the smallest id of each."""
        hit = (self.repeated | found)[self.which]
        mark = np.zeros(len(self.high) + 1, np.int64)
        mark[self.at[hit] + 1] = 1
        total = np.cumsum(mark)
        start = np.flatnonzero(self.whole)
        self.start = start[total[start + self.window - self.block + 1] > total[start]]
        if not len(self.start):
            self.digest = np.empty((0, 2), np.uint64)
            self.least, self.same, self.own = (np.empty(0, np.int64) for _ in range(3))
            self.window_buckets = np.empty(0, np.int64)
            return
        high, low = rolling(self.high, self.window)[self.start], rolling(self.low, self.window)[self.start]
        self.own = np.array(self.ids, np.int64)[self.doc[self.start]]
        order = np.lexsort((self.own, low, high))
        high, low = high[order], low[order]
        first = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        self.digest = np.column_stack([high[first], low[first]])
        self.least = self.own[order][first]
        self.same = np.empty(len(order), np.int64)
        self.same[order] = np.cumsum(first) - 1
        self.window_buckets = (self.digest[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def gone(self, answers: pa.Table) -> np.ndarray:
        """Words in windows that a smaller id has, here or elsewhere: windows that follow one another are one repeat."""
        cover = np.zeros(len(self.high) + 1, np.int64)
        if len(self.start):
            elsewhere = self._spread(answers, self.window_buckets)
            hit = self.start[((self.least[self.same] < self.own) | elsewhere[self.same])]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + self.window, -1)
        return np.cumsum(cover)[:-1] > 0


def _probe(window: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """A row a bucket: the distinct rolling blocks here, each with a bit that tells whether it is an anchor."""
        group = Group(table, window, bits)
        start, sizes = _runs(group.buckets)
        within = (group.values & np.uint64((1 << WITHIN) - 1)).astype(np.uint32) << np.uint32(1) | group.anchors
        return _table(group.buckets[start], group.g, PROBE, _binary(within.astype(np.uint32), sizes))

    return run


def _windows(window: int, bits: int, base: int, kind: str):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """A row a bucket: digests of suspect windows here, each with its smallest id; and what was found, for later."""
        if not docs.num_rows:
            return _OUT.empty_table()
        group = Group(docs, window, bits)
        found = group.found(answers)
        group.suspect(found)
        start, sizes = _runs(group.window_buckets)
        rows = _table(group.window_buckets[start], group.g, WINDOWS, _binary(group.digest.ravel(), 2 * sizes), _binary((group.least - base).astype(kind), sizes))
        if not found.any():
            return rows
        note = _table(np.array([group.g % (1 << bits)]), group.g, NOTE, pa.array([np.packbits(found).tobytes()], pa.binary()))
        return pa.concat_tables([rows, note])

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("copies", pa.int64())])
_RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, copies long"


def _result(ids: list, words: list[list[bytes]], masks: list[list[bool] | None], copies: list[int], text: bool) -> pa.Table:
    out: list[list] = [[] for _ in _RESULT]
    for doc_id, own, mask, n in zip(ids, words, masks, copies, strict=True):
        kept = b" ".join(own if mask is None else [w for w, gone in zip(own, mask, strict=True) if not gone])
        row = (doc_id, len(own), sum(mask) if mask else 0, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if text else None, n)
        for column, x in zip(out, row, strict=True):
            column.append(x)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _RESULT, strict=True)], schema=_RESULT)


def _extend(window: int, bits: int, text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Extend hits to maximal repeats, window by window, and leave their words out."""
        if not docs.num_rows:
            return _RESULT.empty_table()
        group = Group(docs, window, bits)
        kind = answers.column("kind").to_numpy()
        note = answers.filter(pa.array(kind == NOTE)).column("a").to_pylist()
        found = np.unpackbits(np.frombuffer(note[0], np.uint8), count=len(group.values)).astype(bool) if note else np.zeros(len(group.values), bool)
        group.suspect(found)
        gone = group.gone(answers.filter(pa.array(kind == GONE)))
        masks = [part.tolist() if (part := gone[i:j]).any() else None for i, j in zip(group.starts.tolist(), group.ends.tolist(), strict=True)]
        return _result(group.ids, group.words, masks, group.copies, text)

    return run


# -- buckets -----------------------------------------------------------------------------------------------------------


def _whole_buckets(batches: Iterator[pa.RecordBatch], least: int = 10_000) -> Iterator[pa.Table]:
    """Runs of at least ``least`` rows, where there are, with all rows of each bucket; rows come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(0)[-1].as_py()
        if sum(b.num_rows for b in held) < least or held[0].column(0)[0].as_py() == last:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.searchsorted(table.column(0).to_numpy(), last))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _answered(table: pa.Table, flags: np.ndarray, sizes: np.ndarray, kind: int) -> pa.Table:
    """To each group whose row has a flag set a row with its flags."""
    some = np.add.reduceat(flags.astype(np.int64), np.cumsum(sizes) - sizes) > 0 if len(sizes) else np.empty(0, bool)
    return _table(table.column("bucket").to_numpy()[some], table.column("g").to_numpy()[some], kind, _bits(flags[np.repeat(some, sizes)], sizes[some]))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each group which of its blocks are an anchor somewhere and occur in another group too."""
    for table in _whole_buckets(batches):
        sent, sizes = _flat(table.column("a"), np.uint32)
        block = np.repeat(table.column("bucket").to_numpy(), sizes) << WITHIN | (sent >> np.uint32(1)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        start, count = _runs(block[order])
        known = np.add.reduceat((sent[order] & np.uint32(1)).astype(np.int64), start) > 0
        flags = np.empty(len(block), bool)
        flags[order] = np.repeat(known & (count > 1), count)
        yield from _answered(table, flags, sizes, ANCHORED).to_batches()


def _least(batches: Iterator[pa.RecordBatch], id_kind: str) -> Iterator[pa.RecordBatch]:
    """To each group which of its windows a smaller id has in another group. Notes pass."""
    for table in _whole_buckets(batches):
        kind = table.column("kind").to_numpy()
        yield from table.filter(pa.array(kind == NOTE)).cast(_OUT).to_batches()
        table = table.filter(pa.array(kind == WINDOWS)).combine_chunks()
        if not table.num_rows:
            continue
        ids, sizes = _flat(table.column("b"), id_kind)
        high, low = _flat(table.column("a"), np.uint64)[0].reshape(-1, 2).T
        order = np.lexsort((low, high))
        fresh = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
        smallest = np.minimum.reduceat(ids[order], np.flatnonzero(fresh))
        flags = np.empty(len(ids), bool)
        flags[order] = smallest[np.cumsum(fresh) - 1] < ids[order]
        yield from _answered(table, flags, sizes, GONE).to_batches()


def remove_repeats(docs: DataFrame, window: int = 13, group_mb: float = 8.0, text: bool = False) -> DataFrame:
    """Drop words of windows of ``window`` words that also start in a document with a smaller doc_id.

    Documents are dealt to groups of about ``group_mb`` MB of text by a hash. Each group indexes the non-overlapping blocks
    of its documents as anchors and probes with every rolling block; a block is half a window, so that each window holds a
    whole anchor of the document it repeats. Short hashes of both meet in buckets, which answer to each group what is an
    anchor and stands in another group too. Around those hits whole windows are compared by 128-bit digests, which gives
    each window's smallest doc_id; hits extend, window by window, to maximal repeats, whose words go. A passage in any number
    of documents is one hash for each group.

    A group sends a row for each bucket, of about 40 hashes: rows follow the words, whatever the number of partitions. One
    shuffle of texts serves all three passes over them. Beyond 2 TB groups grow by the root of the text, and buckets with
    them, so that groups and buckets both stay small enough for a task.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the text, only if ``text``). Null text has no words. A row
    without doc_id keeps all words and takes none from others. Rows with an equal doc_id are one document in comparisons,
    each with its own result; rows equal in id and text, of any number, are compared once. Windows never cross documents;
    other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.where("doc_id is not null")
    sizes = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.max("n"), F.sum("size"), F.min("doc_id"), F.max("doc_id")).first()
    total = float(sizes[1] or 0)
    group = max(group_mb * (1 << 20), math.sqrt(32 * total))
    groups, bits = max(1, math.ceil(total / group)), max(6, int(math.log2(group / 240)))
    # ids are sent as their distance from the smallest, in four bytes where that is enough
    base, kind = sizes[2] or 0, "<u4" if (sizes[3] or 0) - (sizes[2] or 0) < 1 << 32 else "<u8"
    known = known.groupBy("doc_id", "text").agg(F.count("*").alias("copies")) if (sizes[0] or 0) > 1 else known.withColumn("copies", F.lit(1).cast("long"))
    dealt = known.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"), "doc_id", "text", "copies")

    def by_bucket(sent: DataFrame) -> DataFrame:
        return sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")

    sent = dealt.groupBy("g").applyInArrow(_probe(window, bits), _SCHEMA)
    first = by_bucket(sent).mapInArrow(_anchored, _SCHEMA)
    suspects = dealt.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(_windows(window, bits, base, kind), _SCHEMA)
    second = by_bucket(suspects).mapInArrow(lambda it: _least(it, kind), _SCHEMA)
    found = dealt.groupBy("g").cogroup(second.groupBy("g")).applyInArrow(_extend(window, bits, text), _RESULT_SCHEMA)
    if (sizes[0] or 0) > 1:
        # a row for each copy, by thousands, so that no array is long
        found = found.withColumn("k", F.explode(F.expr("sequence(0L, (copies - 1) div 1000)")))
        found = found.withColumn("k", F.explode(F.expr("sequence(1L, least(1000L, copies - 1000 * k))")))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = [t.split() for t in as_bytes(part, "text")]
            yield from _result([None] * len(words), words, [None] * len(words), [1] * len(words), text).to_batches()

    lone = rows.where("doc_id is null").select("text").mapInArrow(plain, _RESULT_SCHEMA)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    return found.select(*columns).unionByName(lone.select(*columns))
