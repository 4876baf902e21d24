"""Periodic runs of words by a suffix automaton with link-cut access.

The suffix links of a text's automaton form a tree; the path from a prefix to
the root names all suffixes of that prefix. Appending a word recolours this
path with the prefix's end. The pieces of one colour that are met on the way
name the last earlier end of every suffix: where such an end is no further away
than the suffix is long, the suffix holds a square, whose period is the
distance and which reaches back as far as the piece's longest suffix. Squares
of one start and one period at successive ends are one run. Paths are kept as
heavy paths, on each of which the pieces form a stack, so an appended word costs
a logarithm of the text's length on average.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm import store

#: A run repeats its period at least so often and is at least so many words long.
TIMES, LEAST = 4, 6


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest suffix of every state, and the state of every prefix."""
    nexts, link, length, ends = [{}], [-1], [0], []
    last = 0
    for word in ids:
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = state
            at = link[at]
        if at >= 0:
            to = nexts[at][word]
            if length[at] + 1 == length[to]:
                link[state] = to
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and nexts[at].get(word) == to:
                    nexts[at][word] = copy
                    at = link[at]
                link[to] = link[state] = copy
        ends.append(state)
        last = state
    return link, length, ends


def squares(ids: list[int]) -> dict[tuple[int, int], int]:
    """The last word of every stretch that holds a square, by its first word and period."""
    link, length, ends = automaton(ids)
    order = np.argsort(length, kind="stable").tolist()
    size, heavy, head = [1] * len(link), [-1] * len(link), [0] * len(link)
    for state in reversed(order[1:]):
        up = link[state]
        size[up] += size[state]
        if heavy[up] < 0 or size[state] > size[heavy[up]]:
            heavy[up] = state
    for state in order[1:]:
        head[state] = head[link[state]] if heavy[link[state]] == state else state
    found: dict[tuple[int, int], int] = {}
    stacks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, state in enumerate(ends):
        reach: dict[int, int] = {}  # longest common suffix with an earlier prefix, by distance
        while state > 0:
            top, longest, met = head[state], length[state], 0
            stack = stacks[top]
            while stack and stack[-1][0] <= longest:
                met, end = stack.pop()
                if met >= i - end:
                    reach[i - end] = max(met, reach.get(i - end, 0))
            if stack and met < longest and longest >= i - stack[-1][1]:
                far = i - stack[-1][1]
                reach[far] = max(longest, reach.get(far, 0))
            stack.append((longest, i))
            state = link[top]
        for far, common in reach.items():
            found[i - far - common + 1, far] = i
    return found


def _counts_inside(ids: np.ndarray) -> np.ndarray:
    """How often the three words from each place on occur in these words."""
    pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    return n[at]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which no run lies.

    A run of four periods and six words repeats every three of its words at
    least three times, so a rarer triple is in no run.
    """
    todo, out = [(0, len(ids))], []
    while todo:
        first, end = todo.pop()
        if end - first < LEAST:
            continue
        rare = np.flatnonzero(_counts_inside(ids[first:end]) < 3)
        if not len(rare):
            out.append((first, end))
            continue
        edges = np.concatenate([[-1], rare, [end - first - 2]])
        for k in np.flatnonzero(np.diff(edges) > LEAST - 2).tolist():
            part = first + int(edges[k]) + 1, first + int(edges[k + 1]) + 2
            # judged again only where at most half is left, so the work stays n log n
            (todo if 2 * (part[1] - part[0]) <= end - first else out).append(part)
    return out


def periodic_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    ids = np.fromiter(map(defaultdict(count().__next__).__getitem__, words), np.int64, len(words))
    if len(ids) < LEAST:
        return []
    common = np.bincount(ids)[ids] >= TIMES
    edges = np.concatenate([[-1], np.flatnonzero(~common), [len(ids)]])
    out = []
    for k in np.flatnonzero(np.diff(edges) > LEAST).tolist():
        base = int(edges[k]) + 1
        for first, end in stretches(ids[base:edges[k + 1]]):
            for (start, period), last in squares(ids[base + first:base + end].tolist()).items():
                if last - start + 1 >= max(LEAST, TIMES * period):
                    out.append((base + first + start, last - start + 1, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those of a run after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs``, ``best`` and ``collapsed`` of every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than ASCII white space. A run is a maximal
    stretch with a smallest period that it repeats four times or more, of at
    least six words; ``runs`` lists (start, length, period) by start and
    period, ``best`` is the run with the greatest length/period (ties: smallest
    start, then period; null without a run), and ``collapsed`` joins by spaces
    the words that are in no run after that run's first period. A null or empty
    text has no words, no runs and an empty ``collapsed``; repeated rows and
    null ids each keep their row; other columns are not read.

    Every text is one row of one task. Its words take about 60 bytes each;
    the automaton, a kilobyte a word, covers only stretches that repeat.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        names = ("start", "length", "period")
        for batch in batches:
            n_words, every, best, left = [], [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = periodic_runs(words)
                n_words.append(len(words))
                every.append([dict(zip(names, r)) for r in runs])
                best.append(dict(zip(names, min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))) if runs else None)
                left.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(every, pa.list_(kind)), pa.array(best, kind),
                 pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    store.bound_batches(docs.sparkSession)
    kind, span = docs.schema["doc_id"].dataType.simpleString(), "struct<start: long, length: long, period: long>"
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<{span}>, best {span}, collapsed string")
