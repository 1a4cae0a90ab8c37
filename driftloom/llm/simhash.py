"""Near-duplicate documents: 64-bit SimHash fingerprints joined by a binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, chunks, partitions, ship, stored

BITS, BLOCK, SUB, REST = 64, 16, 12, 36


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of word shingles; a text with fewer words is one shingle, one with none has fingerprint zero."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = (ends[shingle - 1 :] - 1).tolist()
    first = [0, *ends[: len(words) - shingle].tolist()]
    return majority(np.array([digest(line[a:b], seed) for a, b in zip(first, last, strict=True)], np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, *more: str) -> DataFrame:
    """(doc_id, fp) and the long columns named by ``more`` for each row; fp holds the unsigned fingerprint's bits as a signed
    long. Null text has no words."""
    ship(docs.sparkSession)
    names = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(part, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], [*names, "fp"])

    rows = docs.select(*(F.col(n).cast("long").alias(n) for n in names), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


def find_min(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the pairs (a[i], b[i]) in ``label``, which names each element's smallest member."""
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_components(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, budget: int, width: int = 1 << 18) -> np.ndarray:
    """Components of "at most ``budget`` differing bits" inside each range [start, end) of sorted distinct values.

    Each range is a binary trie. Pairs of its nodes go down together, adding up the bits in which they differ; a pair
    over the budget is dropped, and so is one whose leaves are all in one component already. A pass with a budget of one
    comes first: it joins dense clusters cheaply, so that the full pass has few pairs left there. Pairs wait on a stack in
    blocks of ``width``, which bounds memory.
    """
    n = len(values)
    label = np.arange(n)
    ones = [np.concatenate([[0], np.cumsum((values >> np.uint64(k)) & np.uint64(1), dtype=np.int64)]) for k in range(bits)]
    for limit in dict.fromkeys((min(1, budget), budget)):
        breaks = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        stack = [(bits, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
        while stack:
            depth, a0, a1, b0, b1, used = stack.pop()
            same = (breaks[a1 - 1] == breaks[a0]) & (breaks[b1 - 1] == breaks[b0]) & (label[a0] == label[b0])
            keep = ~same & (used <= limit) & ((a0 != b0) | (a1 - a0 > 1))
            a0, a1, b0, b1, used = a0[keep], a1[keep], b0[keep], b1[keep], used[keep]
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                x, y = a0[single], b0[single]
                near = np.bitwise_count(values[x] ^ values[y]) <= limit
                if near.any():
                    label = find_min(label, x[near], y[near])
                    breaks = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
                a0, a1, b0, b1, used = a0[~single], a1[~single], b0[~single], b1[~single], used[~single]
            if not len(a0) or not depth:
                continue
            if len(a0) > width:
                for at in range(0, len(a0), width):
                    s = slice(at, at + width)
                    stack.append((depth, a0[s], a1[s], b0[s], b1[s], used[s]))
                continue
            c = ones[depth - 1]
            am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
            own = a0 == b0
            more = (used + 1).astype(np.int8)
            kids = [(a0, am, b0, bm, used, (am > a0) & (bm > b0)), (am, a1, bm, b1, used, (a1 > am) & (b1 > bm)), (a0, am, bm, b1, more, (am > a0) & (b1 > bm) & (more <= limit)), (am, a1, b0, bm, more, (a1 > am) & (bm > b0) & (more <= limit) & ~own)]
            stack.append((depth - 1, *(np.concatenate([k[i][k[5]] for k in kids]) for i in range(5))))
    return label


def _links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Stars (node, root) of the components found under each key; rows come sorted by key."""

    def solve(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        block, sub = (key >> 30).astype(np.uint64), ((key >> 12) & 3).astype(np.uint64)
        rest = _without(_without(fp.view(np.uint64), block * np.uint64(BLOCK), BLOCK), sub * np.uint64(SUB), SUB)
        order = np.lexsort((rest, key))
        key, rest, rep = key[order], rest[order], rep[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        many = ends - starts > 1
        label = trie_components(rest, starts[many], ends[many], REST, budget) if many.any() else np.arange(len(key))
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        root = least[label]
        far = root != rep
        return pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(root[far])], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        part = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append(part)
        size += batch.num_rows
        if size < 200_000:
            continue
        key, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(key, key[-1]))
        held, size = [(key[cut:], fp[cut:], rep[cut:])], len(key) - cut
        if cut:
            yield solve(key[:cut], fp[:cut], rep[:cut])
    if size:
        yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _without(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``x`` with the ``width`` bits from bit ``at`` on cut out."""
    low = (np.uint64(1) << at) - np.uint64(1)
    high = np.minimum(at + np.uint64(width), np.uint64(63))
    above = np.where(at + np.uint64(width) > 63, np.uint64(0), x >> high)
    return (x & low) | (above << at)


def _keys(fp: F.Column) -> F.Column:
    """Sixteen keys: one of four blocks of 16 bits, then one of four blocks of 12 bits of the other 48.

    Two fingerprints within three bits agree in some block, and their other 48 bits in some sub-block, so that they
    meet under a key; 28 equal bits keep the groups under a key small at any number of rows.
    """
    out = []
    for b in range(4):
        value = F.shiftrightunsigned(fp, BLOCK * b).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << (BLOCK * b)) - 1))
        rest = low if b == 3 else F.shiftleft(F.shiftrightunsigned(fp, BLOCK * b + BLOCK), BLOCK * b).bitwiseOR(low)
        for s in range(4):
            sub = F.shiftrightunsigned(rest, SUB * s).bitwiseAND(F.lit(0xFFF))
            out.append(F.lit(b << 30).cast("long").bitwiseOR(F.shiftleft(value, 14)).bitwiseOR(F.lit(s << 12).cast("long")).bitwiseOR(sub))
    return F.array(*out)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges`` (a, b) is the end of one edge, or the root of some, and not both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.min("e.to").alias("low"), F.max("e.to").alias("high"), F.max(F.col("e.to").isNull()).alias("root"))
    return nodes.where("low is not null and (low <> high or root)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest node reachable from each node of ``edges`` (a, b), by large-star and small-star rounds.

    Every round is two aggregations by node with map-side partial minima; nothing is collected. Rounds are written to
    the shared folder, and end when the edges are stars.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(now):
        now = stored(star(star(now, True), False).distinct(), "edges")
    return now.select(F.col("a").alias("v"), F.col("b").alias("root"))


def linked(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of a stored table (doc_id, fp): the smallest doc_id reachable.

    Each key's fingerprints are a binary trie, joined with itself; links make components. component_id is null for a
    fingerprint that no row with a doc_id reaches.
    """
    if not 0 <= budget <= 3:
        raise ValueError("budget must be from 0 to 3")
    own = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    keyed = own.where("rep is not null").select(F.explode(_keys(F.col("fp"))).alias("key"), "fp", "rep")
    keyed = keyed.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    edges = keyed.mapInArrow(lambda it: _links(it, budget), "a long, b long")
    return own.join(components(edges), own["rep"] == F.col("v"), "left").select(F.col("fp"), F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id, the smallest doc_id reachable over links.

    Fingerprints link at ``budget`` (at most 3) or fewer differing bits. Exact copies, of any number, are one fingerprint
    before anything is joined. Null text and text without words have fingerprint zero and link like others. A row
    without doc_id names no component but gets that of its fingerprint, null if no other row has it. Repeated rows each
    give a row. Columns beside doc_id and text are ignored; an empty table gives none.
    """
    fps = stored(fingerprints(docs, shingle), "simhash")
    return fps.join(linked(fps, budget), "fp").select("doc_id", "fp", "component_id")


def fp_hex(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component in ``found`` (doc_id, mark, component_id), and those without id.

    ``mark`` is xxhash64 of the text, so that rows of one id but different texts are judged apart. Each id stays once: of
    several rows the one with the smallest text. Columns travel as one value, so that names can't clash.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    packed = packed.select("row", F.col("row").getField("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row").getField("text").cast("string")).alias("mark"))
    # a merge join at every size: the ids that stay are as many as the documents, so never to be broadcast
    keep = stored(found.where("doc_id = component_id").groupBy("doc_id", "mark").agg(F.count("*").alias("n")), "kept")
    several = stored(keep.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1").select("doc_id"), "several")
    stay = packed.join(keep.select("doc_id", "mark").hint("merge"), ["doc_id", "mark"], "left_semi")
    rows = packed.where("doc_id is null").select("row")
    if several.isEmpty():
        rows = rows.unionByName(stay.select("row"))
    else:
        text = F.col("row").getField("text")
        once = stay.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.struct(text.alias("text"), F.to_json("row").alias("all"))).alias("row"))
        rows = rows.unionByName(stay.join(several, "doc_id", "left_anti").select("row")).unionByName(once.select("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """Of each component keep the document with the smallest id, once; rows without an id stay."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    fps = stored(fingerprints(marked, shingle, "mark"), "simhash")
    return keep_smallest(docs, fps.join(linked(fps.select("doc_id", "fp"), budget), "fp").select("doc_id", "mark", "component_id"))
