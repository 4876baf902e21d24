"""Exact similarity joins of token sets inside groups.

Only tokens that a second set of the query holds can be common, so each set is
first reduced to those; sets left with too few are done. In one order of tokens
(rarest first) two sets that are alike share one of their first tokens, so the
reduced sets meet there, and they are compared inside the task where they meet:
by size, by the place of the shared token, by their counts per value range, and
only then as whole sets. Pairs that fail never leave a task, and a pair that
meets under several tokens is settled at the first of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gristmill.session import bound_batches, cut_lineage

#: Members of one cell of a crowded token, and tokens compared in one task.
CELL, TASK_TOKENS = 2000, 4_000_000
#: Value ranges counted by the suffix filter.
RANGES = 256


def reduced(rows: DataFrame, threshold: float) -> DataFrame:
    """query_id, at, marks, size, tokens, spectrum, lone, first of the sets that can be alike to another.

    ``rows`` has query_id, an ordered ``at`` (a struct) that is unique in a query,
    ``set`` of distinct 64-bit tokens, and ``marks``. ``tokens`` are those shared
    with another set of the query, rarest first, ``lone`` counts the others, and
    the first ``first`` of the tokens are met by any set that is alike.
    """
    sized = rows.withColumns({"size": F.size("set"), "row": F.xxhash64("query_id", "at")}).where("size > 0 and query_id is not null")
    size, shared = F.col("size"), F.size("tokens")
    first = size - F.ceil(size * threshold - 1e-9).cast("int") + 1 - (size - shared)
    return sized.join(_shared(sized), "row").where(first > 0).select(
        "query_id", "at", "marks", "size", "tokens", "spectrum", (size - shared).alias("lone"), first.alias("first"))


def spectrum(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each range of values; at 255 a count stops, which only brings spectra closer."""
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def _shared(sized: DataFrame) -> DataFrame:
    """(row, tokens, spectrum): tokens that a second row of the query holds, rarest first.

    A token goes by a hash of the query and itself. Tokens travel in blocks,
    first to the part of the token, where they are counted, then to the part of the row.
    """
    spark = sized.sparkSession
    bound_batches(spark)
    held = sized.agg(F.sum(F.col("size").cast("long"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // TASK_TOKENS + 1)

    def blocks(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
        by = np.argsort(part, kind="stable")
        kinds, starts = np.unique(part[by], return_index=True)
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(by)]))
        return pa.table({"part": pa.array(kinds.astype(np.int64)), **{
            n: pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()) for n, c in ((n, c[by]) for n, c in columns.items())}})

    def read(table: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("set")
            width = np.diff(sets.offsets.to_numpy())
            query, name = (np.repeat(batch.column(c).to_numpy(), width) for c in ("query", "row"))
            token = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ query.view(np.uint64)
            token = (token ^ (token >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            if len(token):
                yield from blocks(token % np.uint64(parts), {"token": token, "name": name}).to_batches()

    def count(group: pa.Table) -> pa.Table:
        token, name = read(group, "token", np.uint64), read(group, "name", np.int64)
        by = np.argsort(token, kind="stable")
        token, name = token[by], name[by]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        times = np.diff(np.append(starts, len(token)))
        n = np.repeat(times, times).astype(np.int32)
        kept = n > 1
        return blocks(name[kept].view(np.uint64) % np.uint64(parts), {"token": token[kept], "name": name[kept], "n": n[kept]})

    def gather(group: pa.Table) -> pa.Table:
        token, name, n = read(group, "token", np.uint64), read(group, "name", np.int64), read(group, "n", np.int32)
        by = np.lexsort((token, n, name))
        token, name = token[by], name[by]
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        ends = np.append(starts, len(name))
        return pa.table({"row": pa.array(name[starts]), "tokens": pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(token.view(np.int64))),
                         "spectrum": pa.array([spectrum(token[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    dealt = sized.select("row", F.xxhash64("query_id").alias("query"), "set").mapInArrow(deal, "part long, token binary, name binary")
    counted = dealt.groupBy("part").applyInArrow(count, "part long, token binary, name binary, n binary")
    return counted.groupBy("part").applyInArrow(gather, "row long, tokens array<long>, spectrum binary")


def _cells(members: DataFrame, directed: bool) -> DataFrame:
    """The members at each of their first tokens, in cells of bounded size.

    Where ``directed``, members with ``open`` look for earlier ones, and a token
    without an open member is left out. Large groups become cells x cells, each
    pair of members meeting in one of them.
    """
    met = members.select("query_id", "at", "open", F.posexplode(F.slice("tokens", 1, F.col("first"))).alias("place", "token"))
    groups = met.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("wanted"), F.max(F.when(F.col("open"), F.col("at"))).alias("last"), F.min("at").alias("least"))
    groups = groups.where("n > 1" + (" and wanted and last > least" if directed else "")).select("query_id", "token", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    placed = met.join(groups, ["query_id", "token"]).withColumn("own", F.pmod(F.xxhash64("at"), F.col("cells")).cast("int"))
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    spread = placed.withColumn("other", F.explode(every))
    if directed:  # cell (i, j): open members of i look for earlier members of j
        ways = F.filter(F.array(F.when(F.col("open"), F.struct(F.col("own").alias("a"), F.col("other").alias("b"), F.lit(True).alias("looks"), (F.col("own") == F.col("other")).alias("found"))),
                                F.when(~F.col("open") | (F.col("own") != F.col("other")), F.struct(F.col("other").alias("a"), F.col("own").alias("b"), F.lit(False).alias("looks"), F.lit(True).alias("found")))),
                        lambda w: w.isNotNull())
    else:
        ways = F.array(F.struct(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.lit(True).alias("looks"), F.lit(True).alias("found")))
    return spread.withColumn("way", F.explode(ways)).select(
        F.xxhash64("query_id", "token", "way.a", "way.b").alias("cell"), "query_id", "at", "place", "own", F.col("way.a").alias("low"), F.col("way.b").alias("high"),
        F.col("way.looks").alias("looks"), F.col("way.found").alias("found"))


class _Group:
    """The members of one task, with what the filters need."""

    def __init__(self, table: pa.Table, threshold: float):
        self.threshold = threshold
        self.column = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "place", "size", "lone", "own", "low", "high", "looks", "found")}
        at = table.column("at").combine_chunks()
        fields = {f"f{i}": f for i, f in enumerate(at.flatten())}
        order = pc.sort_indices(pa.table({"cell": table.column("cell"), **fields}), [("cell", "ascending"), *((f, "ascending") for f in fields)])
        self.order = order.to_numpy()
        self.query = table.column("query_id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        self.spectra = np.frombuffer(b"".join(table.column("spectrum").to_pylist()), np.uint8).reshape(-1, RANGES)
        self.tokens = []
        if "tokens" in table.column_names:
            tokens = table.column("tokens").combine_chunks()
            ends = tokens.offsets.to_numpy()
            flat = tokens.values.to_numpy(zero_copy_only=False)
            self.tokens = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.sorted: dict[int, np.ndarray] = {}

    def cells(self):
        """Rows of each cell, by ``at``."""
        cell = self.column["cell"][self.order]
        for rows in np.split(self.order, np.flatnonzero(np.diff(cell)) + 1):
            if len(rows) > 1:
                yield rows

    def spectrum(self, rows: np.ndarray) -> np.ndarray:
        return self.spectra[rows].astype(np.int16)

    def candidates(self, k: int, rows: np.ndarray, spectra: np.ndarray) -> np.ndarray:
        """Which of the rows before the k-th pass the filters against it."""
        c, t, row = self.column, self.threshold, rows[k]
        before = rows[:k]
        size, mine = c["size"][before].astype(np.int64), int(c["size"][row])
        least = np.ceil(t / (1 + t) * (size + mine) - 1e-9)
        after = np.minimum(size - c["lone"][before] - c["place"][before], mine - int(c["lone"][row]) - int(c["place"][row]))
        fit = (np.minimum(size, mine) >= t * np.maximum(size, mine) - 1e-9) & (after >= least) & (self.query[before] == self.query[row])
        at = np.flatnonzero(fit)
        apart = np.abs(spectra[at] - spectra[k]).sum(axis=1, dtype=np.int64) + c["lone"][before[at]] + int(c["lone"][row])
        return at[apart <= size[at] + mine - 2 * least[at]]

    def similarity(self, one: int, two: int) -> float:
        for r in (one, two):
            if r not in self.sorted:
                self.sorted[r] = np.sort(self.tokens[r])
        common = len(np.intersect1d(self.sorted[one], self.sorted[two], assume_unique=True))
        return common / (int(self.column["size"][one]) + int(self.column["size"][two]) - common)

    def first_meeting(self, one: int, two: int) -> bool:
        """Whether the sets share no token before this one, as the filter by place supposes."""
        before = [self.tokens[r][:int(self.column["place"][r])] for r in (one, two)]
        return not np.isin(*before, assume_unique=True).any()


def _met(members: DataFrame, threshold: float, directed: bool) -> DataFrame:
    """Cells joined with the sets of their members, dealt to tasks by cell.

    What passes the filters is found by sizes and spectra alone first, so that
    only members with a likely partner in a cell bring their whole sets there.
    """
    spark = members.sparkSession
    cells = cut_lineage(_cells(members, directed))
    columns = cells.columns

    def likely(table: pa.Table) -> pa.Table:
        group, kept = _Group(table, threshold), np.zeros(len(table), bool)
        looks, found = group.column["looks"], group.column["found"]
        for rows in group.cells():
            spectra = group.spectrum(rows)
            for k in np.flatnonzero(looks[rows]):
                near = rows[group.candidates(k, rows, spectra)]
                near = near[found[near]]
                kept[near] = True
                kept[rows[k]] |= len(near) > 0
        return table.select(columns).filter(pa.array(kept))

    def dealt(rows: DataFrame, tokens: float) -> DataFrame:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens) // TASK_TOKENS + 1)
        return rows.withColumn("part", F.pmod("cell", F.lit(parts)).cast("int"))

    light = cells.join(members.select("query_id", "at", "size", "lone", "spectrum"), ["query_id", "at"])
    kept = cut_lineage(dealt(light, cells.count() * RANGES / 8).groupBy("part").applyInArrow(likely, cells.schema))
    rows = kept.join(members.select("query_id", "at", "marks", "size", "tokens", "lone", "spectrum"), ["query_id", "at"])
    width = members.agg(F.sum(F.size("tokens")) / F.count(F.lit(1))).head()[0] or 0
    return dealt(rows, kept.count() * width)


def _kinds(members: DataFrame) -> StructType:
    query, at = (members.schema[c].dataType for c in ("query_id", "at"))
    return StructType([StructField("query_id", query), StructField("later", at), StructField("earlier", at)])


def links(rows: DataFrame, threshold: float) -> DataFrame:
    """(query_id, earlier, later, similarity) of all pairs of sets that are alike, each once."""
    members = cut_lineage(reduced(rows, threshold).withColumn("open", F.lit(True)))

    def run(table: pa.Table) -> pa.Table:
        group, one, two, value = _Group(table, threshold), [], [], []
        low, high, own = (group.column[c] for c in ("low", "high", "own"))
        for members in group.cells():
            spectra = group.spectrum(members)
            for k in range(1, len(members)):
                row = members[k]
                for j in group.candidates(k, members, spectra):
                    other = members[j]
                    if low[row] != high[row] and own[row] == own[other] or not group.first_meeting(row, other):
                        continue
                    found = group.similarity(row, other)
                    if found >= threshold - 1e-12:
                        one.append(other)
                        two.append(row)
                        value.append(found)
        one, two = pa.array(one, pa.int64()), pa.array(two, pa.int64())
        return pa.table({"query_id": table.column("query_id").take(two), "later": table.column("at").take(two),
                         "earlier": table.column("at").take(one), "similarity": pa.array(value, pa.float64())})

    found = _met(members, threshold, False).groupBy("part").applyInArrow(run, _kinds(members).add("similarity", DoubleType()))
    return found.select("query_id", "earlier", "later", "similarity")


def losers(rows: DataFrame, threshold: float, linked: Callable[[float, list, list], bool] | None = None) -> DataFrame:
    """(query_id, at) of the sets that an earlier kept set excludes, as a scan in order finds them.

    Two sets are linked from ``threshold`` on if ``linked(similarity, marks,
    marks)`` agrees. Each round finds for every undecided set only the first
    earlier one that is linked and not lost: without any it is kept, after a
    kept one it is lost, else it waits. So a round has one row per set, however
    many copies there are, and the rounds follow the longest chain of waits.
    """
    members = cut_lineage(reduced(rows, threshold).withColumn("open", F.lit(True)))
    out = members.select("query_id", "at").limit(0)

    def run(table: pa.Table) -> pa.Table:
        group, one, two = _Group(table, threshold), [], []
        looks, found = group.column["looks"], group.column["found"]
        marks = table.column("marks")
        for members in group.cells():
            spectra = group.spectrum(members)
            for k in range(1, len(members)):
                row = members[k]
                if not looks[row]:
                    continue
                for j in group.candidates(k, members, spectra):
                    other = members[j]
                    if not found[other]:
                        continue
                    value = group.similarity(row, other)
                    if value >= threshold - 1e-12 and (linked is None or linked(value, marks[int(other)].as_py(), marks[int(row)].as_py())):
                        one.append(other)
                        two.append(row)
                        break
        one, two = pa.array(one, pa.int64()), pa.array(two, pa.int64())
        return pa.table({"query_id": table.column("query_id").take(two), "later": table.column("at").take(two), "earlier": table.column("at").take(one)})

    while True:
        met = _met(members, threshold, True).groupBy("part").applyInArrow(run, _kinds(members)).groupBy("query_id", "later").agg(F.min("earlier").alias("earlier"))
        found = cut_lineage(met)
        waits = found.select("query_id", F.col("later").alias("earlier"), F.lit(True).alias("waits"))
        judged = found.join(waits, ["query_id", "earlier"], "left")
        lost = cut_lineage(judged.where("waits is null").select("query_id", F.col("later").alias("at")))
        open_now = judged.where("waits").select("query_id", F.col("later").alias("at"), F.lit(True).alias("waits"))
        out = out.unionByName(lost)
        members = cut_lineage(members.join(lost, ["query_id", "at"], "left_anti").join(open_now, ["query_id", "at"], "left")
                              .withColumn("open", F.col("waits").isNotNull()).drop("waits"))
        if members.where("open").isEmpty():
            return out
