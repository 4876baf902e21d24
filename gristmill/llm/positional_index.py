"""A distributed positional inverted index, and phrase and proximity search on it.

Documents are gathered into blocks of bounded size. The index has one row for
each term of each block, with the ascending positions of the term in the block,
and one row for each block that says which document stands where. A test item is
looked up where its rarest terms occur: those terms lead to the blocks, and
inside a block the windows' position lists, shifted by the place of the term in
the window, are intersected from the rarest term on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import store
from gristmill.llm.words import plain_words

#: Words of a block. A longer document goes on in the next block.
BLOCK = 1 << 20
#: Words that the next block repeats of a document cut there, so nothing shorter is lost.
REACH = 256
#: Test words that meet a block in one task.
TEST_WORDS = 1 << 20
#: Candidate places that are intersected at a time.
TILE = 1 << 20


@dataclass(frozen=True)
class Index:
    """``postings``: block, term, n, positions (32-bit), ascending. ``blocks``: block, starts
    (32-bit position of every part), firsts (64-bit number of its first word in its document), rows
    (64-bit row of its document). ``documents``: row, doc_id, n_words."""

    postings: DataFrame
    blocks: DataFrame
    documents: DataFrame


class _Block:
    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.words: list[list[bytes]] = []
        self.starts, self.firsts, self.rows = [], [], []

    def add(self, words: list[bytes], first: int, row: int) -> None:
        self.starts.append(self.size)
        self.firsts.append(first)
        self.rows.append(row)
        self.words.append(words)
        self.size += len(words) + 1  # a place without a term keeps phrases inside their document

    def postings(self) -> tuple[list[bytes], np.ndarray, list[bytes]]:
        """Terms, how often each occurs, and their positions."""
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in self.words])
        at = np.concatenate([np.arange(s, s + len(w), dtype=np.int32) for s, w in zip(self.starts, self.words)])
        at, n = at[np.argsort(ids, kind="stable")], np.bincount(ids, minlength=len(numbers))
        ends = np.cumsum(n).tolist()
        return list(numbers), n, [at[a:b].tobytes() for a, b in zip([0, *ends], ends)]


def build(docs: DataFrame, block: int = BLOCK, reach: int = REACH) -> Index:
    """The index of every whole text of ``docs`` (doc_id, text), written to the shared folder.

    A null or empty text has no words and no postings, but its row in
    ``documents``. Rows are numbered, so null or repeated ids stay apart.
    """
    store.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("block", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("positions", pa.binary()), ("firsts", pa.binary()),
              ("rows", pa.binary()), ("row", pa.int64()), ("doc_id", None), ("n_words", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 22 bits name the task, 20 the block, 21 the document in it
        number, id_kind = TaskContext.get().partitionId() << 20, None

        def batch_of(size: int, **columns) -> pa.RecordBatch:
            kinds = [(k, t or id_kind) for k, t in fields]
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(size, t) for k, t in kinds], names=[k for k, _ in fields])

        def written(b: _Block) -> Iterator[pa.RecordBatch]:
            if not b.size:
                return
            terms, n, positions = b.postings()
            at = pa.array([b.number] * len(terms), pa.int64())
            for a in range(0, len(terms), 10_000):
                yield batch_of(len(terms[a:a + 10_000]), block=at[a:a + 10_000], term=pa.array(terms[a:a + 10_000], pa.binary()).cast(pa.string()),
                               n=pa.array(n[a:a + 10_000]), positions=pa.array(positions[a:a + 10_000], pa.binary()))
            yield batch_of(1, block=pa.array([b.number]), positions=pa.array([np.array(b.starts, np.int32).tobytes()]),
                           firsts=pa.array([np.array(b.firsts, np.int64).tobytes()]), rows=pa.array([np.array(b.rows, np.int64).tobytes()]))

        now = _Block(number)
        for batch in batches:
            id_kind, rows, n_words = batch.column("doc_id").type, [], []
            for text in batch.column("text"):
                words = plain_words(text.as_py())
                row = (now.number << 21) + len(now.starts)
                rows.append(row)
                n_words.append(len(words))
                first = 0
                while True:
                    part = words[first:first + block]
                    now.add(part, first, row)
                    if now.size >= block:
                        yield from written(now)
                        now = _Block(now.number + 1)
                    if first + block >= len(words):
                        break
                    first += block - reach
            yield batch_of(len(rows), row=pa.array(rows, pa.int64()), doc_id=batch.column("doc_id"), n_words=pa.array(n_words, pa.int64()))
        yield from written(now)

    made = store.stash(docs.select("doc_id", "text").mapInArrow(
        run, f"block long, term string, n long, positions binary, firsts binary, rows binary, row long, doc_id {kind}, n_words long"), "positional-index")
    return Index(made.where("term is not null").select("block", "term", "n", "positions"),
                 made.where("rows is not null").select("block", F.col("positions").alias("starts"), "firsts", "rows"),
                 made.where("row is not null").select("row", "doc_id", "n_words"))


def test_items(items: DataFrame) -> DataFrame:
    """(item, name, terms) of the rows of ``items`` (item_id, text) that have words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[w.decode() for w in plain_words(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(terms, pa.list_(pa.string()))], names=["name", "terms"])

    found = items.select(F.col("item_id").cast("string").alias("name"), "text").mapInArrow(run, "name string, terms array<string>")
    return store.stash(found.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "test-items")


def anchors(terms: list[str], seen: list[int], window: int) -> set[str]:
    """The rarest term of every window, of those whose terms all occur."""
    width = min(window, len(terms))
    out = set()
    for a in range(len(terms) - width + 1):
        at = min(range(a, a + width), key=seen.__getitem__)
        if seen[at]:
            out.add(terms[at])
    return out


def meetings(index: Index, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(block, item, terms) wherever a rarest term of an item's window occurs, and the postings of all test terms."""
    wanted = items.select(F.explode("terms").alias("term")).distinct()
    postings = index.postings.join(wanted, "term", "left_semi")
    frequency = postings.groupBy("term").agg(F.sum("n").alias("seen"))
    placed = items.select("item", F.posexplode("terms").alias("at", "term")).join(frequency, "term", "left")
    counted = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "term", F.coalesce("seen", F.lit(0)).alias("seen")))).alias("by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, by in zip(batch.column("item").to_pylist(), batch.column("by").to_pylist())
                    for t in sorted(anchors([b["term"] for b in by], [b["seen"] for b in by], window))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item", "term"])

    led = counted.mapInArrow(run, "item long, term string")
    there = index.postings.select("term", "block").join(led, "term").select("block", "item").distinct()
    return store.stash(there.join(items, "item"), "meetings"), postings


class _Postings:
    """Position lists of a block as one ascending array of (term, position)."""

    def __init__(self, terms: list[str], positions: list[bytes]):
        lists = [np.frombuffer(p, np.int32).astype(np.int64) for p in positions]
        self.number = {t: i for i, t in enumerate(terms)}
        self.n = np.array([len(p) for p in lists], np.int64)
        self.keys = np.concatenate([*(p | i << 32 for i, p in enumerate(lists)), np.zeros(0, np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the terms stand at these positions."""
        key = term << 32 | at
        found = np.searchsorted(self.keys, key)
        return (at >= 0) & (self.keys[np.minimum(found, len(self.keys) - 1)] == key)

    def following(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first position of each term from ``at`` on, or a very late one."""
        found = np.searchsorted(self.keys, term << 32 | np.maximum(at, 0))
        key = self.keys[np.minimum(found, len(self.keys) - 1)]
        return np.where((found < len(self.keys)) & (key >> 32 == term), key & 0xFFFFFFFF, 1 << 40)


def windows(postings: _Postings, terms: list[list[str]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers and places of all windows whose terms all occur, the rarest first, and the item
    of each; the lists of shorter windows repeat their rarest term."""
    number, n, rows, places, owner = postings.number, postings.n.tolist(), [], [], []
    for item, words in enumerate(terms):
        ids = [number.get(t, -1) for t in words]
        width = min(window, len(ids))
        for a in range(len(ids) - width + 1):
            part = ids[a:a + width]
            if min(part) < 0:
                continue
            order = sorted(range(width), key=lambda k: n[part[k]])
            order += order[:1] * (window - width)
            rows.append([part[k] for k in order])
            places.append(order)
            owner.append(item)
    return (np.array(rows, np.int64).reshape(-1, window), np.array(places, np.int64).reshape(-1, window), np.array(owner, np.int64))


def _tiles(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, which of its places) in tiles of bounded size."""
    ends = np.cumsum(size)
    for low in range(0, int(ends[-1]) if len(ends) else 0, TILE):
        flat = np.arange(low, min(low + TILE, int(ends[-1])))
        at = np.searchsorted(ends, flat, "right")
        yield at, flat - (ends[at] - size[at])


def phrases(postings: _Postings, rows: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, first position, end) of every exact occurrence."""
    width = places.max(axis=1, initial=0) + 1
    for at, which in _tiles(postings.n[rows[:, 0]]):
        start = (postings.keys[postings.first[rows[at, 0]] + which] & 0xFFFFFFFF) - places[at, 0]
        for k in range(1, rows.shape[1]):
            kept = postings.holds(rows[at, k], start + places[at, k])
            at, start = at[kept], start[kept]
        yield at, start, start + width[at]


def neighbourhoods(postings: _Postings, rows: np.ndarray, places: np.ndarray, slack: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, first position, end) of the least stretches of a document that hold all terms of a
    window, in any order, and are at most ``slack`` words longer than it."""
    width = places.max(axis=1, initial=0) + 1
    for at, which in _tiles(postings.n[rows[:, 0]]):
        anchor = postings.keys[postings.first[rows[at, 0]] + which] & 0xFFFFFFFF
        ends_at = np.concatenate([starts[1:], [1 << 40]])[np.searchsorted(starts, anchor, "right") - 1]
        found = []
        for back in range(int(width.max(initial=0)) + slack):
            start = anchor - back
            own = np.zeros(len(at), bool)
            last = anchor.copy()
            for k in range(rows.shape[1]):
                own |= postings.holds(rows[at, k], start)
                last = np.maximum(last, postings.following(rows[at, k], start))
            good = own & (last - start < width[at] + slack) & (last < ends_at) & (start >= starts[np.searchsorted(starts, anchor, "right") - 1])
            found.append((at[good], start[good], last[good] + 1))
        at, start, end = (np.concatenate(c) for c in zip(*found))
        # of stretches with one end only the shortest, of those with one start as well
        order = np.lexsort((-start, end, at))
        at, start, end = at[order], start[order], end[order]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1])
        at, start, end = at[first], start[first], end[first]
        order = np.lexsort((end, start, at))
        at, start, end = at[order], start[order], end[order]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1])
        yield at[first], start[first], end[first]


def find(index: Index, items: DataFrame, window: int = 10, slack: int | None = None) -> DataFrame:
    """(row, item, name, start, end): words start..end-1 of a document that match a window of an item.

    A window is ``window`` consecutive words of an item; an item of fewer, but
    not none, is one window. Without ``slack`` a match is the exact phrase;
    with it, a stretch of one document with all terms of the window in any
    order, at most ``slack`` words longer than the window, that holds no such
    stretch. Matches of an item that overlap or touch are joined into one.
    """
    reach = window + (slack or 0)
    if reach > REACH:
        raise ValueError(f"window and slack must not exceed {REACH} words together")
    every = test_items(items)
    there, postings = meetings(index, every, window)
    total = every.agg(F.sum(F.size("terms"))).head()[0] or 0
    slices = -(-total // TEST_WORDS) or 1
    there = there.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int"))
    known = index.blocks.select("block", F.lit(None).cast("string").alias("term"), F.col("starts").alias("positions"), "firsts", "rows").unionByName(
        postings.select("block", "term", "positions", F.lit(None).cast("binary").alias("firsts"), F.lit(None).cast("binary").alias("rows")))
    known = known.withColumn("slice", F.explode(F.lit(list(range(slices)))) if slices > 1 else F.lit(0))

    def run(key: tuple, known: pa.Table, met: pa.Table) -> pa.Table:
        kinds = {"row": pa.int64(), "item": pa.int64(), "name": pa.string(), "start": pa.int64(), "end": pa.int64()}
        if not len(known) or not len(met):
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        terms, positions = known.column("term").to_pylist(), known.column("positions").to_pylist()
        head = terms.index(None)
        starts = np.frombuffer(positions[head], np.int32).astype(np.int64)
        firsts, rows = (np.frombuffer(known.column(c)[head].as_py(), np.int64) for c in ("firsts", "rows"))
        del terms[head], positions[head]
        held = _Postings(terms, positions)
        numbers, places, owner = windows(held, met.column("terms").to_pylist(), window)
        matches = phrases(held, numbers, places) if slack is None else neighbourhoods(held, numbers, places, slack, starts)
        found = [np.zeros((3, 0), np.int64), *(np.stack([owner[at], a, b]) for at, a, b in matches)]
        item, a, b = np.concatenate(found, axis=1)
        part = np.searchsorted(starts, a, "right") - 1
        order = np.lexsort((a, part, item))
        item, a, b, part = item[order], a[order], b[order], part[order]
        new = np.ones(len(a), bool)
        # matches of one item in one document by start: a gap before a start opens a new stretch
        group = np.cumsum(np.concatenate([[0], (item[1:] != item[:-1]) | (part[1:] != part[:-1])])[:len(a)]) if len(a) else a
        furthest = np.maximum.accumulate(b + (group << 33)) - (group << 33) if len(a) else b
        new[1:] = (group[1:] != group[:-1]) | (a[1:] > furthest[:-1])
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(a)) - 1 if len(a) else opens
        shift, names = firsts[part[opens]] - starts[part[opens]], np.array(met.column("name").to_pylist(), object)
        ids = met.column("item").to_numpy()
        return pa.table({"row": pa.array(rows[part[opens]], kinds["row"]), "item": pa.array(ids[item[opens]], kinds["item"]),
                         "name": pa.array(names[item[opens]].tolist(), kinds["name"]), "start": pa.array(a[opens] + shift, kinds["start"]),
                         "end": pa.array(furthest[closes] + shift, kinds["end"])})

    return known.groupBy("block", "slice").cogroup(there.groupBy("block", "slice")).applyInArrow(
        run, "row long, item long, name string, start long, end long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slack: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, ``item_ids`` of every row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    ``n_hit`` counts the words inside any match, ``item_ids`` lists the
    matching items as strings, sorted (an item without an id is not listed, but
    its matches count). A document without words, and every document where
    there are no items, has no hits. Null or repeated ids each keep their row;
    other columns are not read.
    """
    index = build(docs)
    found = store.stash(find(index, items, window, slack), "matches")
    by_start = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", "end").distinct().withColumn("before", F.max("end").over(by_start))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))
    hit = spans.groupBy("row").agg(F.sum(new).alias("n_hit"))
    named = found.select("row", "name").distinct().groupBy("row").agg(F.sort_array(F.collect_list("name")).alias("item_ids"))
    return index.documents.join(hit, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
