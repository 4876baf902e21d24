"""Packing of token sequences by bin completion.

Documents are tokenized and cut in Spark. Only the histogram of piece lengths,
at most ``CAPACITY`` numbers, reaches the driver. There a branch-and-bound
search completes bins around the largest remaining length with undominated
fillings; best-fit decreasing gives the first incumbent. A filling is used as
often as the histogram allows at once, so the search does not depend on the
number of documents. Spark then deals the pieces to the planned places.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import store

CAPACITY = 1024
END = 2
#: Nodes the search may visit, fillings it tries at a node, steps to find them.
NODES, BRANCHES, STEPS = 20_000, 6, 400
#: Pieces of one length and salt that one task numbers.
GROUP_ROWS = 100_000

_TEXT_BYTES = 4 << 20
_MOST_CACHED = 800_000
#: Unknown words that are merged as one text.
_TOGETHER = 20_000
# Fixed value: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Filling = tuple[tuple[int, int], ...]  # (length, copies) by falling length


# --- tokens -----------------------------------------------------------------------------

class Encoder:
    """Token ids as little-endian bytes, with a bounded cache of encoded words.

    A single space between two other characters always starts a token in the
    byte-level pattern, so a text may be cut there and its words encoded by
    themselves. Words of common characters that are not known yet are merged together, as one
    text with single spaces, by ranks: where the tokenizer lists its merges by
    rising id, the least merge first is the least id first. Other words, and
    texts that name an added token, go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        import json
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        cut, vocabulary = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.get_vocab(with_added_tokens=False)
        written = {cut(chr(c))[0][0]: c for c in range(128)}  # how the pre-tokenizer writes each byte
        for c in (*range(128, 2048, 64), *range(128, 192), 0x800, *range(0x1000, 0x10000, 0x1000), 0x10000, *range(0x40000, 0x110000, 0x40000)):
            if not 0xD800 <= c < 0xE000:
                written.update(zip(cut(chr(c))[0][0], chr(c).encode()))
        added = self.tokenizer.get_added_tokens_decoder()
        ranks = {bytes(map(written.__getitem__, name)): i for name, i in vocabulary.items() if i not in added and all(ch in written for ch in name)}
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.plain = re.compile("[!-~\u00a1-\u017f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]+").fullmatch if made == sorted(made) else lambda word: None
        self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(max(ranks.values()) + 1, bool)
        self.starts[[i for name, i in ranks.items() if name.startswith(b" ")]] = True
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.added = [t.content for t in added.values()]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as the tokenizer gives them."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of words after ``lead``."""
        plain = [w for w in words if self.plain(w)] if lead else []
        known = set(plain)
        others = [w for w in words if w not in known]
        found = dict(zip(others, self.ids([lead + w for w in others])))
        for k in range(0, len(plain), _TOGETHER):
            some = plain[k:k + _TOGETHER]
            ids = np.array(self.ranks.encode_ordinary("".join(lead + w for w in some)), "<u4")
            at, raw = (np.flatnonzero(self.starts[ids]) * 4).tolist(), ids.tobytes()
            found.update(zip(some, (raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        start = 0
        while start < len(texts):  # the words of about 4 MiB of text at a time
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= _TEXT_BYTES):
                size += len(texts[end])
                end += 1
            cut = [None if any(name in t for name in self.added) else t.split(" ") for t in texts[start:end]]
            fresh = set().union(*filter(None, cut)).difference(self.later)
            odd = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
            heads, rest = set(), set()
            for k, words in enumerate(cut):
                if words and not odd.isdisjoint(words):
                    cut[k] = words = self.cut(texts[start + k])
                if words:
                    heads.add(words[0])
                    rest.update(words[1:])
            passing = []  # words beyond the cache's bound are forgotten after this round
            for known, words, lead in ((self.first, heads, ""), (self.later, rest, " ")):
                new = list(words.difference(known))
                room = max(0, _MOST_CACHED - len(known))
                known.update(self.words(new, lead))
                passing += [(known, w) for w in new[room:]]
            later = self.later.__getitem__
            for text, words in zip(texts[start:end], cut):
                yield self.first[words[0]] + b"".join(map(later, words[1:])) if words else self.ids([text])[0]
            for known, w in passing:
                del known[w]
            start = end

    def forget(self) -> None:
        """Leave no word to the tasks that the same worker runs next, of whatever query."""
        self.first, self.later = {}, {}


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces.

    A document is its ids and then END. Only documents longer than CAPACITY
    are cut; all their pieces but the first are full.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        tail = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows, numbers = [], []
            for i, ids in enumerate(_ENCODERS[tokenizer].encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += tail
                total = len(ids) // 4
                begin, end, piece = 0, (total - 1) % CAPACITY + 1, 0
                while begin < total:
                    rows.append(i)
                    numbers.append((piece, begin, end - begin, zlib.crc32(ids[4 * begin:4 * end])))
                    begin, end, piece = end, end + CAPACITY, piece + 1
            columns = np.array(numbers, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        _ENCODERS[tokenizer].forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the plan -----------------------------------------------------------------------------

def best_fit(counts: list[int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: (filling, number of bins)."""
    open_bins: list[dict[Filling, int]] = [{} for _ in range(capacity + 1)]  # by space left
    for length in range(capacity, 0, -1):
        left = counts[length]
        space = length
        while left and space <= capacity:
            if not open_bins[space]:
                space += 1
                continue
            filling, bins = open_bins[space].popitem()
            copies = min(space // length, -(-left // bins)) if left >= bins else 1
            used = min(bins, left // copies)
            if bins > used:
                open_bins[space][filling] = bins - used
            _add(open_bins[space - copies * length], filling + ((length, copies),), used)
            left -= used * copies
        copies = capacity // length
        if left >= copies:
            _add(open_bins[capacity - copies * length], ((length, copies),), left // copies)
        if left % copies:
            _add(open_bins[capacity - left % copies * length], ((length, left % copies),), 1)
    return [(filling, bins) for found in open_bins for filling, bins in found.items()]


def _add(found: dict[Filling, int], filling: Filling, bins: int) -> None:
    found[filling] = found.get(filling, 0) + bins


def fillings(gap: int, counts: list[int]) -> list[Filling]:
    """Undominated ways to fill ``gap``, least waste first, larger lengths first.

    One length that fits exactly dominates all else. A filling is dominated
    where one or two of its lengths could be exchanged for one longer length
    that is left and still fits.
    """
    if gap == 0 or not any(counts[1:gap + 1]):
        return [()]
    if counts[gap]:
        return [((gap, 1),)]
    at_most = [0] * (gap + 1)  # the greatest length there is, up to each
    for length in range(1, gap + 1):
        at_most[length] = length if counts[length] else at_most[length - 1]
    found: dict[Filling, int] = {}
    steps, exact = STEPS, 0

    def search(space: int, ceiling: int, chosen: list[list[int]]) -> None:
        nonlocal steps, exact
        length = at_most[min(space, ceiling)]
        if not length:
            found[tuple((a, b) for a, b in chosen)] = space
            exact += space == 0
            return
        while length and steps > 0 and exact < BRANCHES:
            steps -= 1
            most = min(counts[length], space // length)
            chosen.append([length, most])
            search(space - most * length, length - 1, chosen)
            chosen.pop()
            length = at_most[length - 1]

    search(gap, gap, [])
    kept = [f for f, waste in found.items() if not _dominated(f, waste, at_most, counts)]
    return sorted(kept or found, key=lambda f: (found[f], len(f), [-length for length, _ in f]))[:BRANCHES]


def _dominated(filling: Filling, waste: int, at_most: list[int], counts: list[int]) -> bool:
    if not waste:
        return False
    used = dict(filling)
    sums = [length for length in used]
    flat = [length for length, copies in filling for _ in range(min(copies, 2))]
    sums += [a + b for i, a in enumerate(flat) for b in flat[i + 1:]]
    for total in set(sums):
        better = at_most[min(total + waste, len(at_most) - 1)]
        if better > total and counts[better] > used.get(better, 0) or better == total and total not in used:
            return True
    return False


@dataclass
class _Node:
    counts: list[int]
    bins: int
    waste: int
    plan: tuple | None  # linked (filling, bins, rest)


def complete(counts: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Bin completion: (filling, number of bins) for a histogram of lengths.

    Depth first around the largest length; a node is cut off when the space
    wasted so far already rules out fewer bins than the incumbent has. Ends
    when the incumbent meets the lower bound or ``nodes`` are visited.
    """
    total = sum(length * n for length, n in enumerate(counts))
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    fewest = sum(bins for _, bins in best)
    stack = [_Node(list(counts), 0, 0, None)]
    while stack and fewest > bound and nodes:
        node = stack.pop()
        nodes -= 1
        if node.waste > (fewest - 1) * capacity - total:
            continue
        largest = next((length for length in range(capacity, 0, -1) if node.counts[length]), 0)
        if not largest:
            if node.bins < fewest:
                fewest, best, plan = node.bins, [], node.plan
                while plan:
                    best.append((plan[0], plan[1]))
                    plan = plan[2]
            continue
        rest = list(node.counts)
        rest[largest] -= 1
        children = []
        for filling in fillings(capacity - largest, rest):
            whole = dict(filling)
            whole[largest] = whole.get(largest, 0) + 1
            times = min(node.counts[length] // copies for length, copies in whole.items())
            after = list(node.counts)
            for length, copies in whole.items():
                after[length] -= copies * times
            waste = capacity - sum(length * copies for length, copies in whole.items())
            pattern = tuple(sorted(whole.items(), reverse=True))
            children.append(_Node(after, node.bins + times, node.waste + waste * times, (pattern, times, node.plan)))
        stack += reversed(children)
    return best


def places(plan: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset): where the pieces
    of a length go by their rank among equals. One row for each length of a
    filling, so as many as the plan has, whatever the number of pieces."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, bins in sorted(plan, reverse=True):
        offset = 0
        for length, copies in filling:
            rows.append((length, given.get(length, 0), copies, sequence, offset))
            given[length] = given.get(length, 0) + copies * bins
            offset += length * copies
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- the pieces in their places -----------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is END alone. Repeated rows are pieces of their own.
    An empty table gives no row. Other columns are not read.
    """
    store.bound_batches(docs.sparkSession)
    found = store.stash(pieces(docs, tokenizer), "pieces")
    salts = max(1, found.count() // GROUP_ROWS)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # lengths x salts rows: each salt's first rank among the pieces of its length
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.stash(per_salt.select("length", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-counts")
    counts = [0] * (CAPACITY + 1)
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # CAPACITY rows at most
        counts[r["length"]] = r["n"]
    table = places(complete(counts))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = (rows[:, 0] << 50) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = rows[np.searchsorted(key, (length << 50) + rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            turn = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + turn // np.maximum(row[:, 2], 1)),
                 pa.array(row[:, 4] + turn % np.maximum(row[:, 2], 1) * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(order) - 1).join(starts.select("length", "salt", "base"), ["length", "salt"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*columns, (F.col("base") + F.col("place")).alias("rank")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
