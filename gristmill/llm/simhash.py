"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at ``THRESHOLD`` or fewer differing bits. The
bits are cut into three blocks, so of four differences one block holds at most
one. On each block the anchors are the words of a covering code: a perfect
Hamming code on 15 bits beside free bits, with covering radius 1. A
fingerprint's home is the anchor nearest to it; it is also replicated to every
anchor within radius + 1 = 2. Linked fingerprints then meet at the home of
either, and only there are they compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import graph, store

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: (first bit, bits) of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15
#: Homes at one anchor beyond which its comparisons are split into cells.
HOT = 20_000
#: Rows of one comparing task, and candidate pairs compared at a time.
TASK_ROWS = 200_000
TILE = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle in order; all words are one shingle where they are fewer than ``size``."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: len(words) - size + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist())], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; 0 for a text without words."""
    return majority(shingle_hashes(text, size))


def majority(values: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    if not len(values):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):  # bounded memory for very long texts
        part = values[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Hamming syndrome of 15-bit words: the place (1 to 15) of their error, 0 for code words."""
    found = np.zeros(len(words), np.int64)
    for place in range(1, CODE_BITS + 1):
        found ^= np.where((words >> (place - 1)) & 1, place, 0)
    return found


def anchors(values: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Homes of block values, and (rows, anchors) of all anchors within 2."""
    code, free = values & ((1 << CODE_BITS) - 1), bits - CODE_BITS
    error = _syndrome(code)
    flip = np.where(error > 0, 1 << np.maximum(error - 1, 0), 0)
    home = values ^ flip
    every, off, on = np.arange(len(values)), np.flatnonzero(error > 0), np.flatnonzero(error == 0)
    near = [(every, home)]
    singles = [1 << (CODE_BITS + k) for k in range(free)]
    near += [(every, home ^ one) for one in singles]
    near += [(on, home[on] ^ a ^ b) for i, a in enumerate(singles) for b in singles[i + 1:]]
    for a in range(1, CODE_BITS + 1):  # code words at distance 3 from the home that share the error's place
        b = a ^ error[off]
        rows = (b > a) & (a != error[off])
        near.append((off[rows], home[off][rows] ^ (1 << (a - 1)) ^ (1 << (b[rows] - 1)) ^ flip[off][rows]))
    return home, near


def placements(prints: DataFrame) -> DataFrame:
    """(anchor, fp, home): where each distinct fingerprint stands, and whether at its home."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for cut in range(0, len(every), 5000):
                fp = every[cut:cut + 5000]
                for block, (first, bits) in enumerate(BLOCKS):
                    value = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
                    home, near = anchors(value, bits)
                    rows = np.concatenate([np.arange(len(fp))] + [r for r, _ in near])
                    at = np.concatenate([home] + [a for _, a in near]) | (block << 32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at), pa.array(fp[rows]), pa.array(np.arange(len(rows)) < len(fp))],
                        names=["anchor", "fp", "home"])

    return prints.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


class Forest:
    """Union-find over 0..n-1 by whole arrays; the root is the least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[nodes]
            if np.array_equal(up, nodes):
                return nodes
            nodes = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            a, b = low[apart], high[apart]
            np.minimum.at(self.parent, b, a)

    def flat(self) -> np.ndarray:
        self.parent = self.roots(self.parent)
        return self.parent


def compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fp, root fp) that join all fingerprints linked at these anchors.

    Every home is compared with every replica at its anchor, in tiles of
    bounded size; links become a forest at once and are never listed in pairs.
    """
    names = np.unique(fp)
    node = np.searchsorted(names, fp)
    forest = Forest(len(names))
    order = np.argsort(anchor[~home], kind="stable")
    there, copies = anchor[~home][order], node[~home][order]
    homes, at = node[home], anchor[home]
    low, high = np.searchsorted(there, at, "left"), np.searchsorted(there, at, "right")
    bits = names.view(np.uint64)
    row = 0
    while row < len(homes):
        total = np.cumsum((high - low)[row:row + TILE])
        take = max(1, int(np.searchsorted(total, TILE, "right")))
        lo, hi, mine = low[row:row + take], high[row:row + take], homes[row:row + take]
        for skip in range(0, int((hi - lo).max(initial=0)), TILE):  # one home with more replicas than a tile
            a, n = lo + skip, np.clip(hi - lo - skip, 0, TILE)
            left = np.repeat(mine, n)
            right = copies[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(left))]
            close = np.bitwise_count(bits[left] ^ bits[right]) <= threshold
            forest.link(left[close], right[close])
        row += take
    root = forest.flat()
    away = np.flatnonzero(root != np.arange(len(names)))
    return names[away], names[root[away]]


def links(prints: DataFrame) -> DataFrame:
    """(u, v) edges that connect exactly what is linked among distinct ``fp``."""
    spark = prints.sparkSession
    prints = store.stash(prints.select("fp").distinct(), "fingerprints")
    placed = placements(prints)
    # an anchor with many homes is split into cells x cells comparisons
    hot = store.stash(placed.where("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
                      .select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("cells")), "hot-anchors")
    cells = F.coalesce(F.col("cells"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), cells)
    spread = placed.join(hot, "anchor", "left").select(
        "anchor", "fp", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("other"))
    cell = F.xxhash64("anchor", F.when(F.col("home"), F.col("own")).otherwise(F.col("other")),
                      F.when(F.col("home"), F.col("other")).otherwise(F.col("own")))
    width = 3 * 17 * prints.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-width // TASK_ROWS))
    rows = spread.select(cell.alias("anchor"), "fp", "home", F.pmod(cell, F.lit(parts)).cast("int").alias("part"))

    def run(group: pa.Table) -> pa.Table:
        u, v = compare(*(group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home")))
        return pa.table({"u": u, "v": v})

    return rows.groupBy("part").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hex digits) and ``component_id`` per document.

    A null or empty text has no words and fingerprint zero, linked like any
    other. Equal fingerprints are one node, so any number of copies costs one
    row. Repeated rows each get their row. The component is named by its
    smallest doc_id (nulls apart; null if it has no other). An empty table
    gives no row; other columns are not read.
    """
    store.bound_batches(docs.sparkSession)
    prints = store.stash(fingerprints(docs), "document-fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(graph.components(links(prints)), F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, columns as given.

    The one with the smallest doc_id stays (null last); of several under it,
    or without any, the first by text and then by the other columns.
    """
    store.bound_batches(docs.sparkSession)
    prints = store.stash(fingerprints(docs), "document-fingerprints")
    return graph.first_rows(docs, lambda t: int(np.uint64(fingerprint(t)).view(np.int64)),
                            prints.withColumnRenamed("fp", "node"), graph.components(links(prints)))
