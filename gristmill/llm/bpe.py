"""Byte-level BPE encoding and decoding of whole texts.

Texts stay in their partitions: nothing is shuffled, and no word is common
enough to be hot. A task remembers the ids and decoded bytes of the words that
it met, so a word is merged about once a task. Merging takes the adjacent pair
of least rank, the leftmost first, until none is left. Short words look for it
in a list; others keep a heap, which takes n log n steps for n bytes, whatever
the word's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm import store

#: Characters of words that a task remembers, each word counted as so many more.
REMEMBERED, EACH = 32 << 20, 64
#: Bytes of a word up to which looking through its list of pairs takes less than a heap.
SHORT = 64
#: Above all ranks.
NONE = 1 << 62


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """The (piece, rank) lines of a rank file; a vocabulary is bounded."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(piece), int(rank)) for piece, rank in map(bytes.split, lines)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: its own, or those of the pieces that the ranked merges leave."""
    if word in ranks:
        return [ranks[word]]
    return merge_short(word, ranks) if len(word) <= SHORT else merge_long(word, ranks)


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of a short word: the least rank is looked for in a list of all."""
    rank = ranks.get
    cut = list(range(len(word) + 1))  # where pieces start, and the end
    pair = [rank(word[i:i + 2], NONE) for i in range(len(word) - 1)]  # ranks of neighbours
    while pair and (least := min(pair)) < NONE:
        i = pair.index(least)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = rank(word[cut[i]:cut[i + 2]], NONE)
        if i:
            pair[i - 1] = rank(word[cut[i - 1]:cut[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of a word of any length: the least rank comes from a heap."""
    n = len(word)
    after = list(range(1, n + 1))  # where the piece that starts here ends
    before = list(range(-1, n - 1))  # where the piece before it starts
    pair = [ranks.get(word[i:i + 2], -1) for i in range(n - 1)] + [-1]  # rank of it and the next one
    heap = [(r, i) for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if pair[i] != r:  # one of the two was merged since
            continue
        gone = after[i]
        end = after[i] = after[gone]
        pair[gone] = pair[i] = -1
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i:after[end]], -1)) >= 0:
                pair[i] = r
                heappush(heap, (r, i))
        if (left := before[i]) >= 0:
            pair[left] = r = ranks.get(word[left:end], -1)
            if r >= 0:
                heappush(heap, (r, left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:after[i]]])
        i = after[i]
    return ids


class Coder:
    """Ids (little-endian) and decoded bytes of texts, by parts and words met before.

    A single space between two other characters always starts a match of the
    pattern, so parts cut there are matched apart, each distinct part once.
    Parts and words are remembered together, without a space that leads them;
    those with white space at an end are not parts of other texts, so they are
    remembered apart.
    """

    _cut = re.compile(r"(?<=\S) (?=\S)").split

    def __init__(self, pattern: str, ranks: list[tuple[bytes, int]]):
        import regex

        self.match = regex.compile(pattern).findall
        self.ranks = dict(ranks)
        self.pieces = {r: p for p, r in ranks}
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, tuple[bytes, bytes]] = {}
        self.later: dict[str, tuple[bytes, bytes]] = {}  # after a space
        self.odd: dict[str, tuple[bytes, bytes]] = {}
        self.size = 0

    def _place(self, text: str) -> tuple[dict[str, tuple[bytes, bytes]], str]:
        """Where this part or word is remembered, and by which name."""
        known, name = (self.later, text[1:]) if text[0] == " " else (self.first, text)
        return (self.odd, text) if not name or name[0].isspace() or name[-1].isspace() else (known, name)

    def _word(self, word: str) -> tuple[bytes, bytes]:
        known, name = self._place(word)
        if name not in known:
            ids = merge(word.encode("utf-8", "surrogatepass"), self.ranks)
            known[name] = pack(f"<{len(ids)}I", *ids), b"".join([self.pieces[i] for i in ids])
            self.size += len(word) + EACH
        return known[name]

    def _part(self, part: str) -> tuple[bytes, bytes]:
        words = self.match(part)
        if len(words) == 1:
            return self._word(words[0])
        known, name = self._place(part)
        if name not in known:
            found = [self._word(w) for w in words]
            known[name] = b"".join([f[0] for f in found]), b"".join([f[1] for f in found])
            self.size += len(part) + EACH
        return known[name]

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        if not text:
            return b"", b""
        if self.size > REMEMBERED:
            self.forget()
        head, *rest = parts = text.split(" ")
        found = [self.first.get(head), *map(self.later.get, rest)]
        if None in found:
            # what is known has no white space at its ends, so only others can be cut wrongly
            if any(f is None and (not p or p[0].isspace() or p[-1].isspace()) for p, f in zip(parts, found)):
                head, *rest = self._cut(text)
                found = [self.first.get(head), *map(self.later.get, rest)]
            found = [f or self._part(p) for p, f in zip([head, *[" " + p for p in rest]], found)]
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])


def _library(path: str, pattern: str):
    """The library's own encoding by the same ranks, which the tests hold the merges against."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(read_ranks(path)), special_tokens={})


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256.

    A null or empty text has no tokens. Repeated rows each get theirs; an empty
    table gives no row. Other columns are not read.
    """
    store.bound_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pattern, ranks.value)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column("text"):
                ids, plain = coder.round_trip(text.as_py() or "")
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
