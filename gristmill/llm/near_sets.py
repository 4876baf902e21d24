"""Near duplicates by SimHash, checked by exact Jaccard of word shingles.

Texts are read once: each becomes a node (its set of shingles), a fingerprint,
a sketch from which the difference of two sets is bounded from below, its first
shingles and a few least hashes. Sets whose SimHash fingerprints are linked, or
that have a least hash in common, are candidates in stars first, which joins
most copies at a linear number of pairs. Copies beyond the fingerprints' radius
are found by the prefix filter, so no link is lost: two sets that are alike share one of their first shingles in any
one order of all shingles (frequent ones last), so only sets that meet there and
are not of one component yet are compared, by their sketches, inside the task
where they meet. Of the pairs that sketches cannot rule out, a task first passes
on a spanning forest to be compared whole. Between the components that are still
apart, the whole sets of members with such a partner come to the task, once each,
and it passes on a spanning forest of the pairs that are alike: never pairs
themselves, of which a group may have the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import graph, simhash, store

SHINGLE = 5
#: Sets are alike from this Jaccard on, as a fraction.
ALIKE, OF = 4, 5
#: Least number of texts sampled for the order, and the most shingles it puts last.
SAMPLE, MOST = 5000, 200_000
#: Least hashes of each set, by multipliers.
STARS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
#: Slots of a sketch per shingle, at least. Common shingles cancel, so few are enough.
SLOTS = 1
#: Prefix entries of one task, members of one cell of a large group, and members compared in one task.
ENTRIES, CELL, TASK = 500_000, 2000, 100_000
#: Bytes of sketches or of whole sets that one task holds, and of whole sets on one side of a cell.
TASK_BYTES, CELL_BYTES = 64 << 20, 16 << 20
#: Bits that mark the hashes of wanted texts before texts are shuffled, 64 in a row, so 2^18 rows are broadcast at most.
MARKS = 1 << 24
#: Pairs looked at and bytes of sketches compared at a time.
PAIRS, TILE = 1 << 20, 8 << 20


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's distinct shingles, in order."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def node(hashes: np.ndarray) -> int:
    """The name of a set, a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED)).view(np.int64))


def parity(hashes: np.ndarray) -> bytes:
    """Per slot, whether an odd number of hashes falls there."""
    bits = 1 << max(8, (SLOTS * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows of 64-bit words) on half as many slots: the halves fall onto each other."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def possible(size: np.ndarray, bits: np.ndarray, other: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """Which sets of these sizes and sketches can be alike to the others, row by row and on the same
    number of slots; never false for alike ones."""
    apart = np.bitwise_count(bits ^ other_bits).sum(axis=1, dtype=np.int64)
    fit = ALIKE * np.maximum(size, other) <= OF * np.minimum(size, other)
    return fit & ((OF + ALIKE) * apart <= (OF - ALIKE) * (size + other))


def prefix(hashes: np.ndarray, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes of a set, of which an alike set has one among its first: those
    not in ``late`` (ascending) by value, then the others by ``rank``."""
    n = len(hashes)
    place = np.zeros(n, np.int64)
    if len(late):
        at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
        place = np.where(late[at] == hashes, rank[at] + 1, 0)
    return hashes[np.lexsort((hashes, place))[:n - -(-ALIKE * n // OF) + 1]]


def frequent(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that several sampled texts hold, the rarest first, and of those that
    one task should not gather. The sample grows with the rows, so that each of the latter is seen."""
    sample = max(SAMPLE, 40 * rows // ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["part"])

    chosen = docs.select("text").where(F.rand(0) < sample / max(rows, 1))
    counted = chosen.mapInArrow(run, "part long").groupBy("part").count().where("count > 2")
    most = counted.orderBy(F.desc("count"), "part").limit(MOST).collect()
    crowded = [r["part"] for r in most if r["count"] * rows > ENTRIES * min(sample, rows) // 2]
    return np.array([r["part"] for r in reversed(most)], np.int64).view(np.uint64), np.sort(np.array(crowded, np.int64).view(np.uint64))


def prepare(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """doc_id, text_hash, node, size, fp (SimHash of the set), sketch, prefix and mins of every row."""
    order = np.argsort(late)
    shared = docs.sparkSession.sparkContext.broadcast((late[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            mins = [(s * STARS[:, None]).min(axis=1).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)), pa.array([parity(s) for s in sets], pa.binary()), pa.array([prefix(s, *shared.value).tobytes() for s in sets], pa.binary()),
                 pa.array(mins, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "size", "fp", "sketch", "prefix", "mins"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, node long, size long, fp long, sketch binary, prefix binary, mins array<long>")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(u, v): the least node of each component of linked fingerprints with its others."""
    prints = nodes.where("size > 0").select("node", "fp")
    roots = graph.components(simhash.links(prints)).withColumnsRenamed({"node": "fp"})
    rooted = prints.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u != last").select("root", "u")
    return rooted.join(first, "root").where("u != node").select("u", F.col("node").alias("v"))


def stars(marked: DataFrame) -> DataFrame:
    """(u, v): the least node of each least hash with the others that have it."""
    keys = marked.where("size > 0").select(F.posexplode("mins").alias("at", "least"), "node").select(F.xxhash64("at", "least").alias("key"), "node").distinct()
    first = keys.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u != last").select("key", "u")
    return keys.join(first, "key").where("u != node").select("u", F.col("node").alias("v")).distinct()


def meetings(marked: DataFrame, crowded: np.ndarray) -> DataFrame:
    """(id, node): the nodes whose prefixes share a shingle, at least two under each id.

    Groups of the same nodes are one. A crowded shingle is no group of one
    task: its nodes are dealt by themselves and named by the shingle.
    """
    spark = marked.sparkSession
    entries = marked.agg(F.sum(F.octet_length("prefix"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // (8 * ENTRIES)))
    hot = spark.sparkContext.broadcast(crowded)

    def is_hot(at: np.ndarray) -> np.ndarray:
        there = hot.value
        return there[np.minimum(np.searchsorted(there, at), len(there) - 1)] == at if len(there) else np.zeros(len(at), bool)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = dict(zip(batch.column("node").to_pylist(), batch.column("prefix").to_pylist()))
            at = np.frombuffer(b"".join(found.values()), np.uint64)
            if not len(at):
                continue
            names = np.repeat(np.array(list(found), np.int64), [len(p) // 8 for p in found.values()])
            part = ((at ^ np.where(is_hot(at), names.view(np.uint64), np.uint64(0))) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            at, names, (kinds, starts) = at[by], names[by], np.unique(part[by], return_index=True)
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(at)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array([at[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([names[a:b].tobytes() for a, b in cuts], pa.binary())],
                names=["part", "hashes", "names"])

    def meet(group: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(group.column("hashes").to_pylist()), np.uint64)
        names = np.frombuffer(b"".join(group.column("names").to_pylist()), np.int64)
        by = np.lexsort((names, at))
        at, names = at[by], names[by]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (names[1:] != names[:-1])
        at, names = at[new], names[new]
        alone = is_hot(at)
        ids, members = [at[alone].view(np.int64)], [names[alone]]
        at, names = at[~alone], names[~alone]
        _, first, n = np.unique(at, return_index=True, return_counts=True)
        seen = set()
        for a, k in zip(first[n > 1].tolist(), n[n > 1].tolist()):
            nodes = names[a:a + k]
            if (name := node(nodes)) not in seen:
                seen.add(name)
                ids.append(np.full(k, name))
                members.append(nodes)
        return pa.table({"id": pa.array(np.concatenate(ids)), "node": pa.array(np.concatenate(members))})

    dealt = marked.where("size > 0").select("node", "prefix").mapInArrow(deal, "part long, hashes binary, names binary")
    return dealt.groupBy("part").applyInArrow(meet, "id long, node long").distinct()


def close_pairs(cell: np.ndarray, size: np.ndarray, sketches: list[bytes], root: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Places (a, b) of sets of one cell that can be alike, of different roots and, in cells that
    have two sides, of different sides."""
    return np.concatenate([np.zeros((2, 0), np.int64), *close_tiles(cell, size, sketches, root, side)], axis=1)


def close_tiles(cell: np.ndarray, size: np.ndarray, sketches: list[bytes], root: np.ndarray, side: np.ndarray) -> Iterator[np.ndarray]:
    """``close_pairs``, a bounded number at a time."""
    cell = np.unique(cell, return_inverse=True)[1]
    order = np.lexsort((size, cell))
    cell, size, root, side = cell[order], size[order], root[order], side[order]
    two = np.zeros(int(cell.max(initial=-1)) + 1, bool)
    two[cell[side]] = True
    width = np.array([len(sketches[k]) // 8 for k in order], np.int64)
    row = np.zeros(len(order), np.int64)
    tables: dict[int, np.ndarray] = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        tables[w] = np.frombuffer(b"".join(sketches[k] for k in order[at]), np.uint64).reshape(-1, w)
    # partners of a member are those after it in its cell that are not too large
    end = np.searchsorted(cell << 32 | size, cell << 32 | OF * size // ALIKE, "right")
    total = np.cumsum(end - np.arange(len(end)) - 1)
    for low in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        flat = np.arange(low, min(low + PAIRS, int(total[-1])))
        a = np.searchsorted(total, flat, "right")
        b = end[a] - (total[a] - flat)
        kept = (root[a] != root[b]) & ((side[a] != side[b]) | ~two[cell[a]])
        a, b = a[kept], b[kept]
        kinds = width[a] << 32 | width[b]
        for kind in np.unique(kinds).tolist():
            narrow, wide = kind >> 32, kind & 0xFFFFFFFF
            at = np.flatnonzero(kinds == kind)
            step = max(1, TILE // (8 * wide))
            for first in range(0, len(at), step):
                x, y = a[at[first:first + step]], b[at[first:first + step]]
                one, other = tables[narrow][row[x]], tables[wide][row[y]]
                while other.shape[1] > narrow:
                    other = folded(other)
                fit = possible(size[x], one, size[y], other)
                yield np.stack([order[x[fit]], order[y[fit]]])


def spanning(tiles: Iterator[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Of pairs of members (2 x n, in tiles), those that join labels which the pairs before do not join."""
    up, kept = list(range(int(label.max(initial=-1)) + 1)), [np.zeros((2, 0), np.int64)]

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for tile in tiles:
        top = np.array([find(x) for x in range(len(up))], np.int64)
        low, high = np.sort(top[label[tile]], axis=0)
        at = np.flatnonzero(low != high)
        joining = at[np.unique(low[at] << 32 | high[at], return_index=True)[1]]
        found = []
        for k, a, b in zip(joining.tolist(), low[joining].tolist(), high[joining].tolist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append(k)
        kept.append(tile[:, found])
    return np.concatenate(kept, axis=1)


def alike_forest(tiles: Iterator[np.ndarray], sets: list[bytes], label: np.ndarray) -> np.ndarray:
    """Of pairs of members (2 x n, in tiles), alike ones that join all labels which alike pairs join. A
    member is compared whole with those of its partners that nothing joins to it yet."""
    label, kept = label.copy(), []
    size = np.array([len(s) // 8 for s in sets], np.int64)
    values, held = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    held = np.split(held, np.cumsum(size)[:-1])
    mark = np.zeros(len(values), bool)
    for tile in tiles:
        low, high = np.sort(tile[:, label[tile[0]] != label[tile[1]]], axis=0)
        pairs = np.unique(low << 32 | high)
        one, other = pairs >> 32, pairs & 0xFFFFFFFF
        for low, high in zip(at := np.flatnonzero(np.diff(one, prepend=-1)), [*at[1:], len(one)]):
            x = one[low]
            mark[held[x]] = True
            cuts = np.cumsum(8 * size[other[low:high]]) // TILE
            for some in np.split(other[low:high], np.flatnonzero(np.diff(cuts)) + 1):
                some = some[label[some] != label[x]]
                if not len(some):
                    continue
                common = np.add.reduceat(mark[np.concatenate([held[y] for y in some])].astype(np.int64), np.cumsum(size[some]) - size[some])
                for y in some[OF * common >= ALIKE * (size[x] + size[some] - common)]:
                    if label[x] != label[y]:
                        kept.append((x, y))
                        label[label == label[y]] = label[x]
            mark[held[x]] = False
    return np.array(kept, np.int64).reshape(-1, 2).T


def placed(groups: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """cell, node, size, width, root and side of the members of groups of several components.

    The members of a group's commonest component need not meet each other, so
    they are compared with the others only. Large groups become cells of others
    against others and of others against the commonest component, each side of
    a cell of bounded members and bytes of whole sets.
    """
    known = nodes.select("node", "size", F.octet_length("sketch").alias("width")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = groups.join(known, "node")
    held = members.groupBy("id", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    whole = held.groupBy("id").agg(F.sum("n").alias("all"), F.sum("words").alias("all_words"), F.max(F.struct("n", "root", "words")).alias("most")).where(F.col("all") > F.col("most.n"))

    def cells_of(n: Column, words: Column) -> Column:
        return F.ceil(F.greatest(n / CELL, 8 * words / CELL_BYTES)).cast("int")

    whole = whole.select("id", F.col("most.root").alias("most"), cells_of(F.col("all") - F.col("most.n"), F.col("all_words") - F.col("most.words")).alias("rest_cells"),
                         cells_of(F.col("most.n"), F.col("most.words")).alias("most_cells"))
    members = members.join(whole, "id").withColumn("side", F.col("root") == F.col("most"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side"), F.col("most_cells")).otherwise(F.col("rest_cells"))).cast("int")
    rests, mosts = F.sequence(F.lit(0), F.col("rest_cells") - 1), F.sequence(F.lit(0), F.col("most_cells") - 1)
    mine = F.col("own")
    against_most = F.when(F.col("side"), F.transform(rests, lambda k: F.struct(F.lit(1).alias("kind"), k.alias("a"), mine.alias("b")))).otherwise(
        F.transform(mosts, lambda k: F.struct(F.lit(1).alias("kind"), mine.alias("a"), k.alias("b"))))
    against_rest = F.when(~F.col("side"), F.transform(rests, lambda k: F.struct(F.lit(0).alias("kind"), F.least(mine, k).alias("a"), F.greatest(mine, k).alias("b"))))
    cells = F.concat(against_most, F.coalesce(against_rest, F.array().cast("array<struct<kind: int, a: int, b: int>>")))
    return store.stash(members.withColumn("own", own).select("node", "root", "side", "size", "width", F.explode(cells).alias("c"), "id").select(
        F.xxhash64("id", "c").alias("cell"), "node", "size", "width", "root", "side"), "cells")


def tasks(rows: DataFrame, size: Column) -> int:
    """Tasks that hold TASK rows and TASK_BYTES of this size each."""
    held, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).head()
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK), -(-size // TASK_BYTES))


def across(groups: DataFrame, nodes: DataFrame, roots: DataFrame, tell: str) -> DataFrame:
    """Of the sets that meet in a group, are of different components and are not ruled out by sketches:
    as a ``forest`` the pairs (u, v) of each task that join what its other pairs do not, fewer than it
    has members; else the ``members`` of such pairs (cell, node, size, root, side), each once a cell."""
    cells = placed(groups, nodes, roots)
    parts = tasks(cells, F.col("width"))
    rows = cells.drop("width").join(nodes.select("node", "sketch"), "node").withColumn("part", F.pmod("cell", F.lit(parts)).cast("int"))

    def tiles(group: pa.Table) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray]:
        cell, name, size, root, side = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "node", "size", "root", "side"))
        return close_tiles(cell, size, group.column("sketch").to_pylist(), root, side), name, root

    def forest(group: pa.Table) -> pa.Table:
        found, name, root = tiles(group)
        # a set is in several cells of the task, under one label
        u, v = name[spanning(found, np.unique(root, return_inverse=True)[1])]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    def members(group: pa.Table) -> pa.Table:
        partnered = np.zeros(group.num_rows, bool)
        for tile in tiles(group)[0]:
            partnered[tile] = True
        return group.filter(pa.array(partnered)).select(["cell", "node", "size", "root", "side"])

    rows = rows.select("part", "cell", "node", "size", "root", "side", "sketch").groupBy("part")
    if tell == "forest":
        return rows.applyInArrow(forest, "u long, v long").distinct()
    return rows.applyInArrow(members, "cell long, node long, size long, root long, side boolean")


def compared(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): alike pairs of members of one cell, enough to join all components that such pairs join.
    Each set comes once to each task that has a cell of it; no pair leaves a task but those of its forest."""
    members = store.stash(members, "members")
    parts = tasks(members, 8 * F.col("size"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["node", "hashes"])

    sets = store.stash(texts_of(docs, nodes, members.select("node").distinct()).mapInArrow(whole, "node long, hashes binary"), "member-sets")
    dealt = members.withColumn("part", F.pmod("cell", F.lit(parts)).cast("int")).groupBy("part", "node").agg(
        F.first("root").alias("root"), F.collect_list("cell").alias("cells"), F.collect_list("side").alias("sides"))

    def forest(group: pa.Table) -> pa.Table:
        name, root = (group.column(c).combine_chunks().to_numpy() for c in ("node", "root"))
        hashes, sketch = group.column("hashes").to_pylist(), group.column("sketch").to_pylist()
        own = np.repeat(np.arange(len(name)), pc.list_value_length(group.column("cells")).to_numpy())
        cell, side = (pc.list_flatten(group.column(c)).to_numpy() for c in ("cells", "sides"))
        size = np.array([len(h) // 8 for h in hashes], np.int64)
        tiles = close_tiles(cell, size[own], [sketch[k] for k in own], root[own], side)
        u, v = name[alike_forest((own[t] for t in tiles), hashes, np.unique(root, return_inverse=True)[1])]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    rows = dealt.join(nodes.select("node", "sketch"), "node").join(sets, "node").select("part", "node", "root", "sketch", "hashes", "cells", "sides")
    return rows.groupBy("part").applyInArrow(forest, "u long, v long").distinct()


def ruled_in(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that their sketches don't rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for n, one, m, other in zip(*(batch.column(c).to_pylist() for c in ("u_size", "u_sketch", "v_size", "v_sketch"))):
                a, b = (np.frombuffer(x, np.uint64)[None] for x in (one, other))
                while a.shape != b.shape and ALIKE * max(n, m) <= OF * min(n, m):
                    a, b = (folded(a), b) if a.shape > b.shape else (a, folded(b))
                kept.append(a.shape == b.shape and bool(possible(np.array([n]), a, np.array([m]), b)[0]))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch")), side)
    return pairs.mapInArrow(run, "u long, v long")


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text: one text of each wanted node. Only these are shuffled, and the few others that
    fall on one of their marks."""
    wanted = store.stash(nodes.join(wanted, "node", "left_semi").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "wanted")

    def row_and_bit(value: Column) -> tuple[Column, Column]:
        place = F.pmod(value, F.lit(MARKS))
        return F.floor(place / 64).alias("row"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit")

    marks = wanted.select(*row_and_bit(F.col("first_hash"))).groupBy("row").agg(F.bit_or("bit").alias("bits"))
    marked = docs.select("doc_id", "text", *row_and_bit(F.xxhash64("text"))).join(F.broadcast(marks), "row").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return marked.join(wanted, (F.xxhash64("text") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "node", "text").dropDuplicates(["node"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike."""
    pairs = store.stash(pairs, "candidate-pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, two in zip(batch.column("one"), batch.column("two")):
                a, b = shingles(one.as_py()), shingles(two.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(OF * common >= ALIKE * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    texts = store.stash(texts_of(docs, nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "candidate-texts")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("one")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("two")), "v")
    return both.select("u", "v", "one", "two").mapInArrow(compare, "u long, v long")


def components(docs: DataFrame, marked: DataFrame, crowded: np.ndarray) -> DataFrame:
    """(node, root) of the nodes that are linked to a lesser one; ``marked`` is what ``prepare`` returns."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = store.stash(marked.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), first), "nodes")
    near = by_fingerprint(nodes).union(stars(marked)).distinct()
    linked = store.stash(verified(docs, nodes, ruled_in(near, nodes)), "star-links")
    groups = store.stash(meetings(marked, crowded), "meetings")
    # most of what is still apart joins through few pairs; after that, every pair that is left is looked at
    found = verified(docs, nodes, across(groups, nodes, graph.components(linked), "forest"))
    linked = store.stash(linked.union(found), "links")
    found = compared(docs, nodes, across(groups, nodes, graph.components(linked), "members"))
    return graph.components(store.stash(linked.union(found), "links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component of alike documents, columns as given.

    Texts without words are alike. The first row by doc_id (null last), text
    and the other columns stays; repeated rows leave one. An empty table gives
    no row. Columns of any name may follow doc_id and text. The hashes of a
    text, some 15 bytes a word, are held while it is read; of a pair that is
    compared whole, those of both texts.
    """
    store.bound_batches(docs.sparkSession)
    late, crowded = frequent(docs, docs.count())
    marked = store.stash(prepare(docs, late), "sets")
    roots = components(docs, marked, crowded)
    spare = store.unused(docs.columns)
    rows = marked.groupBy("doc_id", "text_hash", "node").agg(F.count(F.lit(1)).alias("n")).join(roots, "node", "left").select(
        "doc_id", "text_hash", "n", F.coalesce("root", "node").alias("root"))
    rows = store.stash(rows, "document-roots")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("least"))
    chosen = rows.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("least")))
    shared = chosen.groupBy("root").agg(F.sum("n").alias("rows")).where("rows > 1").select("root", F.lit(True).alias("shared"))
    chosen = store.stash(chosen.join(shared, "root", "left").select("doc_id", "text_hash", "root", F.coalesce("shared", F.lit(False)).alias("shared")), "chosen")

    def found(some: DataFrame) -> DataFrame:
        some = some.select(*(F.col(c).alias(spare(c)) for c in ("doc_id", "text_hash", "root")))
        return docs.join(some, F.col("doc_id").eqNullSafe(F.col(spare("doc_id"))) & (F.xxhash64("text") == F.col(spare("text_hash"))))

    # texts are shuffled by component only where several rows have its least doc_id
    order = Window.partitionBy(spare("root")).orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    first = found(chosen.where("shared")).withColumn(spare("place"), F.row_number().over(order)).where(F.col(spare("place")) == 1)
    return found(chosen.where("not shared")).select(*docs.columns).union(first.select(*docs.columns))
