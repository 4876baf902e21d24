"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes where a string of ``LENGTH`` bytes covers it that also starts
earlier in the corpus. Positions that share their first bytes form a bucket;
buckets are refined by sorting on the bucket identifiers of later offsets, and
each refinement reuses the identifiers of the one before, so the known depth
doubles until it reaches ``LENGTH``.

Over a whole corpus only some positions need that. Of every window of LENGTH
bytes the q-gram with the least hash is an anchor, which owns the window, so
equal windows have equal anchors at the same place. The anchors (about one
position in forty) are the first, corpus-wide buckets. Spark deals them by
q-gram:

1. an anchor whose q-gram occurs once owns no repeated window;
2. an anchor whose surroundings, the windows that it owns, occurred before is
   repeated with all of them;
3. the others, at the edges of repeats, send their surroundings to the task of
   their q-gram, which refines their suffixes byte-exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import store

LENGTH = 100
GRAM = 24
#: Grams of a window; a window that holds the gram at place a starts from a - REACH to a.
GRAMS = LENGTH - GRAM + 1
REACH = GRAMS - 1
#: Text of a block of documents, anchors that one task sorts, and bytes that one task refines.
BLOCK_BYTES, SORT_ROWS, REFINE_BYTES = 8 << 20, 400_000, 2 << 20
#: Different surroundings of one gram beyond which their windows are dealt in
#: slices of so many starts, by the bytes that all windows of a slice hold, so
#: that no gram fills one task.
HOT, SLICE = 20_000, 8

_PIECE = 256 << 10
_LAST = (1 << 63) - 1
_SHIFTS = (np.uint64(8), np.uint64(16), np.uint64(32))


# --- anchors ------------------------------------------------------------------------------

def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one integer; the last 7 positions are left out."""
    out = data.astype(np.uint64)
    for step, shift in zip((1, 2, 4), _SHIFTS):
        more = out[step:] << shift
        more |= out[:-step]
        out = more
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM = 24 bytes at each position."""
    v = packed(data)
    out = store.mix(v[16:] + np.uint64(0x9E3779B97F4A7C15))
    out = store.mix(out + v[8:-8])
    return store.mix(out + v[:-16])


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


@dataclass
class Anchors:
    """Anchors of a block: place in its bytes, document (row), bounds of the
    surroundings, gram hash, hash of the surroundings."""

    at: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    around: np.ndarray


def _anchors_of_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of some whole documents, given as [start, end) of ``data``."""
    hashes = gram_hashes(data)
    low = _slide(hashes, GRAMS, np.minimum)
    edge = np.zeros(len(low) + 1, np.int64)  # window starts inside one document
    keep = ends - starts >= LENGTH
    np.add.at(edge, starts[keep], 1)
    np.add.at(edge, ends[keep] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    low = np.where(valid, low, np.uint64(0))
    pad = np.zeros(REACH, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), GRAMS, np.maximum)
    at = np.flatnonzero((high == hashes) & (hashes > 0))
    doc = np.searchsorted(starts, at, "right") - 1
    first, last = starts[doc], ends[doc] - GRAM
    inside = (at >= first) & (at <= last)
    at, doc, first, last = at[inside], doc[inside], first[inside], last[inside]
    gram = hashes[at]
    low, high = _owned(at, doc, gram, first, last + GRAM)
    around = ((at - low) * 1000 + high - at).astype(np.uint64)
    for step in (*range(-REACH, LENGTH - GRAM, GRAM), LENGTH - GRAM):
        around = store.mix(around * np.uint64(0x9E3779B97F4A7C15) + hashes[np.clip(at + step, low, high - GRAM)])
    return at, doc, low, high, gram, around


def _owned(at: np.ndarray, doc: np.ndarray, gram: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) of the windows that each anchor owns: those without a lesser gram."""
    low, high = np.maximum(at - REACH, first), np.minimum(at + LENGTH, end)
    for side in (-1, 1):
        left = np.arange(len(at))
        for k in range(1, GRAMS):  # until a lesser gram is met or out of reach
            left = left[(left + side * k >= 0) & (left + side * k < len(at))]
            other = left + side * k
            near = (doc[other] == doc[left]) & (np.abs(at[other] - at[left]) < GRAMS)
            left, other = left[near], other[near]
            if not len(left):
                break
            less = gram[other] < gram[left]
            if side < 0:
                low[left[less]] = np.maximum(low[left[less]], at[other[less]] + 1)
            else:
                high[left[less]] = np.minimum(high[left[less]], at[other[less]] + GRAM - 1)
            left = left[~less]
    return low, high


def find_anchors(data: np.ndarray, offsets: np.ndarray) -> Anchors:
    """Anchors of all documents of a block, in order of document and place."""
    found: list[tuple[np.ndarray, ...]] = []
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _PIECE, "right")) - 1)
        low, high = offsets[row], offsets[end]
        if high - low >= LENGTH:
            at, doc, left, right, gram, around = _anchors_of_piece(data[low:high], offsets[row:end] - low, offsets[row + 1:end + 1] - low)
            found.append((at + low, doc + row, left + low, right + low, gram, around))
        row = end
    if not found:
        return Anchors(*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    return Anchors(*(np.concatenate(c) for c in zip(*found)))


# --- blocks of documents ------------------------------------------------------------------

@dataclass
class Block:
    """The distinct documents of a block in corpus order, and their anchors.

    ``lead`` marks the first anchor of each (gram, surroundings) in the block.
    """

    docs: np.ndarray
    names: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    anchors: Anchors
    lead: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> "Block":
        docs = table.column("_doc").combine_chunks().to_numpy(zero_copy_only=False)
        names = table.column("_name").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.lexsort((names, docs))
        same = np.concatenate([[False], (docs[order][1:] == docs[order][:-1]) & (names[order][1:] == names[order][:-1])])
        order = order[~same[:len(order)]]
        data, offsets = store.text_bytes(table.column("text").combine_chunks().take(pa.array(order)))
        anchors = find_anchors(data, offsets)
        by = np.lexsort((anchors.around, anchors.gram))  # stable, so in corpus order within a class
        new = np.ones(len(by), bool)
        new[1:] = (anchors.gram[by][1:] != anchors.gram[by][:-1]) | (anchors.around[by][1:] != anchors.around[by][:-1])
        lead = np.zeros(len(by), bool)
        lead[by[new]] = True
        return Block(docs[order], names[order], data, offsets, anchors, lead)

    def deal(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, its leading anchors) in a fixed order."""
        lead = np.flatnonzero(self.lead)
        bucket = (self.anchors.gram[lead] >> np.uint64(16)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        lead, bucket = lead[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        return [(int(bucket[part[0]]), lead[part]) for part in np.split(np.arange(len(lead)), cuts) if len(part)]


def _offers(buckets: int):
    """Per block: its leading anchors to their buckets, as arrays."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block.of(table)
        dealt = block.deal(buckets)
        a = block.anchors
        return pa.table({
            "bucket": pa.array([b for b, _ in dealt], pa.int32()), "block": pa.array([key[0].as_py()] * len(dealt), pa.int32()),
            "gram": pa.array([a.gram[i].tobytes() for _, i in dealt], pa.binary()),
            "around": pa.array([a.around[i].tobytes() for _, i in dealt], pa.binary()),
            "doc": pa.array([block.docs[a.doc[i]].tobytes() for _, i in dealt], pa.binary())})

    return run


def _join(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


#: What a bucket answers about a leading anchor: nothing to do, all around it
#: is repeated, to be refined, to be refined in slices.
REPEATED, EDGE, CROWDED = 1, 2, 3


def judge_bucket(gram: np.ndarray, around: np.ndarray, doc: np.ndarray, hot: int = HOT) -> np.ndarray:
    """The answer for each anchor of a bucket (0 where nothing is to do)."""
    answer = np.zeros(len(gram), np.uint8)
    if not len(gram):
        return answer
    order = np.lexsort((doc, around, gram))
    g, a = gram[order], around[order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new_class = new_gram | np.concatenate([[True], a[1:] != a[:-1]])
    classes = np.add.reduceat(new_class.astype(np.int64), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
    answer[order] = np.where(~new_class, REPEATED, np.where(classes > hot, CROWDED, np.where(classes > 1, EDGE, 0)))
    return answer


def _answers(table: pa.Table, hot: int) -> pa.Table:
    """Per bucket: what each block needs to know of the anchors that it sent."""
    counts = np.array([len(x) // 8 for x in table.column("gram").to_pylist()], np.int64)
    answer = judge_bucket(_join(table.column("gram"), np.uint64), _join(table.column("around"), np.uint64), _join(table.column("doc"), np.int64), hot)
    parts = np.split(answer, np.cumsum(counts)[:-1]) if len(counts) else []
    said = [np.flatnonzero(p) for p in parts]
    keep = [i for i, s in enumerate(said) if len(s)]
    return pa.table({
        "block": table.column("block").take(pa.array(keep, pa.int64())), "bucket": table.column("bucket").take(pa.array(keep, pa.int64())),
        "place": pa.array([said[i].astype(np.int32).tobytes() for i in keep], pa.binary()),
        "answer": pa.array([parts[i][said[i]].tobytes() for i in keep], pa.binary())})


_FOUND = "_doc long, _name long, spans binary, key long, start long, bytes binary"


def _found(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = ("_doc", "_name", "spans", "key", "start", "bytes")
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def union(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Disjoint [start, end) rows that cover the same places, touching ones joined."""
    if not len(low):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    return np.stack([low[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]], axis=1)


def _resolve(buckets: int):
    """Per block: spans that are surely repeated, and the surroundings still to be refined."""
    def run(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _found([])
        block = Block.of(table)
        a, state = block.anchors, np.zeros(len(block.lead), np.uint8)
        state[~block.lead] = REPEATED
        answers = dict(zip(said.column("bucket").to_pylist(), zip(said.column("place").to_pylist(), said.column("answer").to_pylist())))
        for bucket, index in block.deal(buckets):
            if bucket in answers:
                place, answer = answers[bucket]
                state[index[np.frombuffer(place, np.int32)]] = np.frombuffer(answer, np.uint8)
        low, high = a.low, a.high
        rows: list[tuple] = []
        sure = np.flatnonzero(state == REPEATED)
        for part in np.split(sure, np.flatnonzero(np.diff(a.doc[sure])) + 1):
            if len(part):
                doc = a.doc[part[0]]
                spans = union(low[part], high[part]) - block.offsets[doc]
                rows.append((block.docs[doc], block.names[doc], spans.astype(np.int64).tobytes(), None, None, None))
        raw = block.data.tobytes()
        for i in np.flatnonzero(state >= EDGE).tolist():
            doc, p, q, at = a.doc[i], int(low[i]), int(high[i]), int(a.at[i])
            shift = int(block.offsets[doc])
            if state[i] == EDGE:
                rows.append((block.docs[doc], block.names[doc], None, int(a.gram[i].view(np.int64)), p - shift, raw[p:q]))
                continue
            for step in range((p - at) // SLICE, (q - LENGTH - at) // SLICE + 1):
                first, last = max(p, at + step * SLICE), min(q - LENGTH, at + step * SLICE + SLICE - 1)
                core = raw[at + step * SLICE + SLICE - 1:at + step * SLICE + LENGTH]  # in every window of the slice
                key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=b"%d" % step).digest(), "little", signed=True)
                rows.append((block.docs[doc], block.names[doc], None, key, first - shift, raw[first:last + LENGTH]))
        return _found(rows)

    return run


# --- refinement ---------------------------------------------------------------------------

def refine(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bucket pointers of all positions of ``data`` at ``depth`` bytes.

    Two positions that have ``depth`` bytes after them get equal pointers just
    when those bytes are equal; pointers grow with the strings' order. The
    first buckets are 8-grams. A round sorts the members of each bucket that
    is still shared by the pointers at the offset known so far, and writes the
    new pointers before the next round reads them; a bucket of one is settled.
    """
    n = len(data)
    if n < 8:
        return np.arange(n)
    kind = np.int32 if n < 1 << 30 else np.int64
    keys = packed(data).byteswap(inplace=True)  # first byte most significant: pointers follow byte order
    order = np.argsort(keys, kind="stable").astype(kind)
    keys = keys[order]
    pointer = np.full(n, n, kind)
    pointer[order] = _first_of_runs(keys[1:] != keys[:-1], np.arange(len(order), dtype=kind))
    del keys
    known = 8
    while known < depth:
        step = min(known, depth - known)
        ranked = pointer[order]  # members of a bucket are neighbours
        same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
        shared = np.flatnonzero(same[1:] | same[:-1]).astype(kind)
        del ranked, same
        if not len(shared):
            break
        members = order[shared]
        later = np.where(members + step < n, pointer[np.minimum(members + step, n - 1)], kind(n))
        by = np.lexsort((later, pointer[members]))
        members, later = members[by], later[by]
        del by
        bucket = pointer[members]
        order[shared] = members
        changed = (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1])
        del bucket, later
        pointer[members] = _first_of_runs(changed, shared)
        known += step
    return pointer


def _first_of_runs(changed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For members in order, the place (ascending) of the first of their run."""
    firsts = places.copy()
    firsts[1:][~changed] = 0
    return np.maximum.accumulate(firsts, out=firsts)


def repeated_windows(docs: np.ndarray, names: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> list[tuple]:
    """(_doc, _name, spans) where windows of these strings also start earlier."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    pointer = refine(np.frombuffer(b"".join(texts), np.uint8))
    by = np.lexsort((names, docs))
    new = np.concatenate([[True], (docs[by][1:] != docs[by][:-1]) | (names[by][1:] != names[by][:-1])])[:len(by)]
    ranks = np.empty(len(by), np.int32)  # of documents
    ranks[by] = np.cumsum(new) - 1
    docs, names = docs[by[new]], names[by[new]]
    begin = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - LENGTH + 1, 0)
    first_window = np.cumsum(windows) - windows
    unit = np.repeat(np.arange(len(texts), dtype=np.int32), windows)
    number = np.arange(len(unit))
    where = number + (starts - first_window)[unit]
    number += (begin - first_window)[unit]
    bucket, d = pointer[number], ranks[unit]
    del pointer, number, unit
    order = np.lexsort((where, d, bucket))
    where, d, bucket = where[order], d[order], bucket[order]
    del order
    if not len(d):
        return []
    first = _first_of_runs(bucket[1:] != bucket[:-1], np.arange(len(bucket)))
    del bucket
    again = (d != d[first]) | (where != where[first])  # another start than the earliest
    d, where = d[again], where[again]
    del first, again
    order = np.lexsort((where, d))
    d, where = d[order], where[order]
    rows = []
    for part in np.split(np.arange(len(d)), np.flatnonzero(d[1:] != d[:-1]) + 1):
        if len(part):
            rows.append((docs[d[part[0]]], names[d[part[0]]], union(where[part], where[part] + LENGTH).tobytes()))
    return rows


def _refine_part(table: pa.Table) -> pa.Table:
    arrays = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("_doc", "_name", "start")]
    rows = repeated_windows(*arrays, table.column("bytes").to_pylist())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("_doc", pa.int64()), ("_name", pa.int64()), ("spans", pa.binary())))})


# --- the operator -------------------------------------------------------------------------

def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(_doc, _name, spans) rows: what to remove, several rows for some documents."""
    size = store.byte_count(docs, "text")
    blocks, buckets = max(1, size // BLOCK_BYTES), max(1, 2 * size // (GRAMS * SORT_ROWS))
    dealt = docs.select("_doc", "_name", "text", F.pmod(F.xxhash64("_doc"), F.lit(blocks)).cast("int").alias("block"))
    offers = dealt.groupBy("block").applyInArrow(_offers(buckets), "bucket int, block int, gram binary, around binary, doc binary")
    answers = offers.groupBy("bucket").applyInArrow(lambda t: _answers(t, hot), "block int, bucket int, place binary, answer binary")
    found = store.stash(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_resolve(buckets), _FOUND), "repeats")
    edges = found.where("key is not null")
    parts = max(1, store.byte_count(edges, "bytes") // REFINE_BYTES)
    refined = edges.select("_doc", "_name", "start", "bytes", F.pmod("key", F.lit(parts)).cast("int").alias("part")).groupBy("part").applyInArrow(
        _refine_part, "_doc long, _name long, spans binary")
    return found.where("spans is not null").select("_doc", "_name", "spans").union(refined)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The given columns and: n_bytes, n_removed, n_spans, kept (binary), kept_sha256, kept_text.

    ``kept_text`` leaves out bytes of a character that was cut apart.

    Documents come in order of doc_id (null last), those with one doc_id in an
    order fixed by their texts. Rows equal in doc_id and text are one document,
    whose result each of them gets. A null text is empty: nothing is removed.
    An empty table gives no row. Columns of the added names are replaced.
    """
    store.bound_batches(docs.sparkSession)
    added = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "kept_text")
    docs = docs.drop(*added)
    keyed = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "_name": F.xxhash64(F.coalesce("text", F.lit("")))})
    spans = repeats(keyed, hot).groupBy("_doc", "_name").agg(F.collect_list("spans").alias("_spans"))
    joined = keyed.join(spans, ["_doc", "_name"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = store.text_bytes(batch.column("text"))
            rows = []
            for i, found in enumerate(batch.column("_spans").to_pylist()):
                raw = data[at[i]:at[i + 1]]
                spans = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found]) if found else np.zeros((0, 2), np.int64)
                spans = union(spans[:, 0], spans[:, 1])
                keep = np.ones(len(raw), bool)
                for low, high in spans.tolist():
                    keep[low:high] = False
                kept = raw[keep].tobytes()
                rows.append((len(raw), len(raw) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]],
                                             names=[*batch.schema.names[:-1], *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, kept_text string")
