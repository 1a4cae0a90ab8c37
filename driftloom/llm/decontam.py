"""Benchmark decontamination with an FM-index over each shard of training text."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, chunks, ship

#: Word bytes after lower-casing: digits, letters and all of a non-ASCII character. Everything else separates.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Phrases:
    """Test phrases: distinct windows of words by length, the items of each, and the vocabulary that they use."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[k : k + window])].add(item)
        names = sorted({w for p in owners for w in p})
        self.code = {w: k for k, w in enumerate(names, 1)}
        self.items = [sorted(s) for s in owners.values()]
        by: dict[int, list[int]] = defaultdict(list)
        phrases = list(owners)
        for k, p in enumerate(phrases):
            by[len(p)].append(k)
        self.lengths = {n: (np.array(ks), np.array([[self.code[w] for w in phrases[k]] for k in ks], np.int64)) for n, ks in sorted(by.items())}
        self.shortest = min(self.lengths, default=0)


class FMIndex:
    """Suffix-sorted word codes: Burrows-Wheeler transform in a wavelet matrix, every ``step``-th position sampled.

    Code 0 separates passages. Each separator sorts as a word of its own, so that a passage's suffixes part early.
    """

    def __init__(self, codes: np.ndarray, step: int = 8):
        n = len(codes)
        breaks = codes == 0
        rank = np.where(breaks, np.cumsum(breaks) - 1, codes + breaks.sum()).astype(np.int64)
        width = 1
        while True:
            after = np.full(n, -1, np.int64)
            after[: n - width] = rank[width:]
            key = rank * (int(rank.max(initial=0)) + 2) + after + 1
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank[order] = fresh
            if n == 0 or fresh[-1] == n - 1:
                break
            width *= 2
        self.size, self.suffix = n, order
        self.bwt = codes[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=1))])
        self.planes: list[tuple[np.ndarray, int]] = []
        row = self.bwt
        for bit in range(max(1, int(codes.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            self.planes.append((np.concatenate([[0], np.cumsum(ones)]), int(n - ones.sum())))
            row = np.concatenate([row[ones == 0], row[ones == 1]])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(breaks, at, 0))
        self.sampled = (breaks | ((at - start) % step == 1))[order]  # each passage's first word, as no step leads over a separator

    def rank(self, code: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each code stands in the transform before each position: down the wavelet matrix."""
        low, high = np.zeros_like(upto), upto
        for depth, (ones, zeros) in enumerate(self.planes):
            bit = (code >> (len(self.planes) - 1 - depth)) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``phrases`` at once: their ranges of sorted suffixes."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        top, known = len(self.first) - 1, 1 << len(self.planes)
        for k in range(phrases.shape[1] - 1, -1, -1):
            code = phrases[:, k]
            there = code < min(top, known)
            code = np.where(there, code, 0)
            low, high = self.first[code] + self.rank(code, low), self.first[code] + self.rank(code, high)
            high = np.where(there, high, low)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of sorted suffixes: steps back through the text to a sampled one."""
        rows, steps, open_ = rows.copy(), np.zeros(len(rows), np.int64), ~self.sampled[rows]
        while open_.any():
            at = rows[open_]
            code = self.bwt[at]
            rows[open_] = self.first[code] + self.rank(code, at)
            steps[open_] += 1
            open_ = ~self.sampled[rows]
        return self.suffix[rows] + steps


def find(texts: list[bytes], phrases: Phrases) -> tuple[list[list[bytes]], list[np.ndarray | None], list[set[str]]]:
    """For each text its words, the words hit (None: none), and the items found.

    A shard's index holds runs of words of the test vocabulary that are as long as the shortest phrase; no phrase can
    stand anywhere else, so that nothing is lost.
    """
    words = [words_of(t) for t in texts]
    get = phrases.code.get
    flat = np.fromiter((get(w, 0) for ws in words for w in [*ws, b""]), np.int64)
    hit: list[np.ndarray | None] = [None] * len(texts)
    items: list[set[str]] = [set() for _ in texts]
    inside = flat > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= phrases.shortest
    start, end = start[long], end[long]
    if not len(start) or not phrases.shortest:
        return words, hit, items
    size = end - start + 1  # with a separator before it
    base = np.cumsum(size) - size
    source = np.repeat(start - 1 - base, size) + np.arange(size.sum())
    codes = np.where(np.arange(len(source)) == np.repeat(base, size), 0, flat[np.maximum(source, 0)])
    index = FMIndex(codes)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    for length, (ids, rows) in phrases.lengths.items():
        low, high = index.search(rows)
        count = high - low
        some = count > 0
        if not some.any():
            continue
        count, low, ids = count[some], low[some], ids[some]
        total = np.cumsum(count) - count
        at = source[index.locate(np.repeat(low - total, count) + np.arange(count.sum()))]
        for phrase, place in zip(np.repeat(ids, count).tolist(), at.tolist(), strict=True):
            d = int(np.searchsorted(begin, place, "right")) - 1
            if hit[d] is None:
                hit[d] = np.zeros(len(words[d]), bool)
            hit[d][place - begin[d] : place - begin[d] + length] = True
            items[d].update(phrases.items[phrase])
    return words, hit, items


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of runs of hit words, merged over what separates them."""
    places = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(places[i][0], places[j - 1][1]) for i, j in zip(edge[::2], edge[1::2], strict=True)]


def cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for i, j in gone:
        out.append(text[at:i])
        at = j
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, block_mb: int) -> list:
    """The benchmark as broadcasts of at most ``block_mb`` MB of text each."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks, held, size = [], [], 0
    for r in rows.toLocalIterator():
        held.append((r["item"], r["text"].encode()))
        size += len(held[-1][1])
        if size >= block_mb << 20:
            blocks.append(context.broadcast(held))
            held, size = [], 0
    return [*blocks, context.broadcast(held)]


def _search(texts: list[bytes], blocks: list, ready: Phrases | None, window: int) -> tuple[list, list, list]:
    """What ``find`` gives, over all blocks together. A worker holds one block at a time: each is let go before the next."""
    hits = items = None
    for block in blocks:
        words, hit, found = find(texts, ready or Phrases(block.value, window))
        if len(blocks) > 1:
            vars(block).pop("_value", None)  # read again from the worker's disk for the next chunk of texts
        if hits is None:
            hits, items = hit, found
        else:
            hits = [b if a is None else a if b is None else a | b for a, b in zip(hits, hit, strict=True)]
            items = [a | b for a, b in zip(items, found, strict=True)]
    return words, hits, items


_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, clean string"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_mb: int = 16, clean: bool = False) -> DataFrame:
    """Find the benchmark's windows of ``window`` words (or whole shorter items) in documents.

    The benchmark is read in blocks of at most ``block_mb`` MB of text (one item at least), each broadcast by itself and
    searched in every shard. Driver and workers hold one block at a time, the others are on disk, so that memory doesn't
    depend on the benchmark's size. Returns a row per document: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, spans (merged byte spans of hit words) and clean, the text without them (only if ``clean``).
    Null text has no words; a benchmark row without text or words has no windows; one without item_id counts as item ''.
    Items with an equal id are one. Repeated documents each give a row; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = _blocks(benchmark, block_mb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Phrases(blocks[0].value, window) if len(blocks) == 1 else None
        for part in chunks(batches, "text", 8 << 20 if ready else 32 << 20):
            texts = as_bytes(part, "text")
            words, hits, items = _search(texts, blocks, ready, window)
            out: list[list] = [[] for _ in range(7)]
            for text, ws, h, found in zip(texts, words, hits, items, strict=True):
                gone = spans(text, h) if h is not None else []
                row = (len(ws), int(h.sum()) if h is not None else 0, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h is not None, [{"start": i, "end": j} for i, j in gone], cut(text, gone).decode("utf-8", "replace") if clean else None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "clean"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with benchmark passages cut from text (and n_chars adapted where present).

    A document that is left without any word by the cut goes; every other row stays, in whatever number.
    """
    ship(docs.sparkSession)
    blocks, columns = _blocks(benchmark, 16), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Phrases(blocks[0].value, window) if len(blocks) == 1 else None
        for part in chunks(batches, "text", 8 << 20 if ready else 32 << 20):
            texts = as_bytes(part, "text")
            _, hits, _ = _search(texts, blocks, ready, window)
            keep = [h is None or not h.all() for h in hits]
            new = {i: cut(t, spans(t, h)).decode("utf-8", "replace") for i, (t, h) in enumerate(zip(texts, hits, strict=True)) if h is not None}
            arrays = list(part.columns)
            if new:
                at = columns.index("text")
                arrays[at] = pa.array([new.get(i, old) for i, old in enumerate(arrays[at].to_pylist())], arrays[at].type)
                if "n_chars" in columns:
                    at = columns.index("n_chars")
                    arrays[at] = pa.array([len(new[i]) if i in new else old for i, old in enumerate(arrays[at].to_pylist())], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
