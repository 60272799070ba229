"""Byte-level BPE with the ranks of a public vocabulary: encoding and decoding.

A text is split by the pattern of the vocabulary and every match is encoded on its own. A match that is a token as it
stands is that token. Else its bytes are merged pair by pair, always the leftmost pair of the least rank:

* a segment tree over byte positions holds, at leaf i, the rank of the pair that the token starting at byte i forms with its
  right neighbour, and in every inner node the least rank below it, so that the root names the next merge and the way down
  that keeps to the left child on ties leads to its leftmost place;
* live tokens are linked to their neighbours; a merge removes the right one and updates the leaves of three places, each in
  logarithmic time. A match of n bytes takes O(n log n), however long it is.

Many short matches are merged side by side, a tree each, as rows of numpy arrays. Matches repeat, so each process keeps their
ids, up to a bound, and starts anew beyond it.

Defined results: a null or empty text has no ids (an empty array) and decodes to no bytes; an id that is null or not in the vocabulary raises
an error on decoding; bytes that are not UTF-8 are read as U+FFFD; null ids, equal rows and other columns come back untouched (a column with the
name of the result is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

NO_RANK = 1 << 60
# A process remembers the ids of about so many matches of so many bytes in all; those of at most SHORT bytes are merged side by side.
REMEMBERED = 300_000
REMEMBERED_BYTES = 32 << 20
SHORT = 128
# Texts of about so many bytes are split, and matches merged, at a time.
CHUNK_BYTES = 1 << 20
AT_ONCE = 8192


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    rank = ranks.get
    whole = rank(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # The token at live position i covers piece[i:after[i]]; before[i] is the live position to its left.
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # least[1] is the root, least[size + i] the leaf of position i.
    size = 1 << (n - 1).bit_length()
    level = [rank(piece[i:i + 2], NO_RANK) for i in range(n - 1)]
    level += [NO_RANK] * (size - n + 1)
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    least = [NO_RANK, *chain.from_iterable(reversed(levels))]

    while (lowest := least[1]) != NO_RANK:
        node = 1
        while node < size:
            node *= 2
            if least[node] != lowest:
                node += 1
        i = node - size
        gone, left = after[i], before[i]
        end = after[i] = after[gone]
        changes = [(gone, NO_RANK), (i, NO_RANK)]
        if end < n:
            before[end] = i
            changes[1] = (i, rank(piece[i:after[end]], NO_RANK))
        if left >= 0:
            changes.append((left, rank(piece[left:end], NO_RANK)))
        for position, value in changes:
            node = position + size
            least[node] = value
            while node > 1:
                other = least[node ^ 1]
                node >>= 1
                if other < value:
                    value = other
                if least[node] == value:
                    break
                least[node] = value

    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:after[at]]])
        at = after[at]
    return ids


class Pairs:
    """The rank of the token that two neighbouring tokens merge into, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, merged in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = merged
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.keys.tolist()] or [NO_RANK], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.merged) - 1)
        hit = (left >= 0) & (right >= 0)
        if len(self.keys):
            hit &= self.keys[at] == wanted
        return np.where(hit, self.merged[at], NO_RANK)


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(ids of many short matches end to end, how many each has): a segment tree each, and every round merges one pair in each."""
    n = np.array([len(p) for p in pieces])
    size = 1 << int(n.max() - 1).bit_length()
    width = size + 1
    rows = len(pieces)
    # Beyond the end of a match stands -1, which pairs with nothing.
    token = np.full((rows, width), -1, np.int64)
    inside = np.arange(width) < n[:, None]
    token[inside] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    least = np.full((rows, 2 * size), NO_RANK, np.int64)
    least[:, size:] = pairs(token[:, :-1], token[:, 1:])
    half = size
    while half > 1:
        least[:, half // 2:half] = np.minimum(least[:, half:2 * half:2], least[:, half + 1:2 * half:2])
        half //= 2
    after = np.tile(np.arange(1, width + 1), (rows, 1)).ravel()
    before = np.tile(np.arange(-1, width - 1), (rows, 1)).ravel()
    token, inside, least = token.ravel(), inside.ravel(), least.ravel()

    row = np.arange(rows)
    depth = size.bit_length() - 1
    while True:
        lowest = least[row * 2 * size + 1]
        more = lowest < NO_RANK
        row, lowest = row[more], lowest[more]
        if not len(row):
            break
        tree, text = row * 2 * size, row * width
        node = np.ones(len(row), np.int64)
        for _ in range(depth):
            node *= 2
            node += least[tree + node] != lowest
        i = node - size
        gone = after[text + i]
        end, left = after[text + gone], before[text + i]
        token[text + i] = lowest
        inside[text + gone] = False
        after[text + i] = end
        before[text + end] = i
        has_left = left >= 0
        here = token[text + i]
        # A match that begins at i has no left neighbour; its first leaf is then written twice.
        beside = np.where(has_left, left, i)
        right_rank = pairs(here, token[text + end])
        left_rank = np.where(has_left, pairs(token[text + beside], here), right_rank)
        least[tree + size + np.minimum(gone, size - 1)] = NO_RANK
        least[tree + size + i] = right_rank
        least[tree + size + beside] = left_rank
        for position in (gone, i, beside):
            node = np.minimum(position, size - 1) + size
            for _ in range(depth):
                node >>= 1
                low = tree + 2 * node
                least[tree + node] = np.minimum(least[low], least[low + 1])
    return token[inside], inside.reshape(rows, width).sum(1)


class Numbers(dict):
    """Numbers texts in the order in which they are first asked for; `new` gathers them."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Codec:
    """Texts to ids and ids to bytes; the ids of matches are remembered up to a bound."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self._forget()

    @functools.cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.ranks)

    @functools.cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def _forget(self) -> None:
        self.numbers, self.held = Numbers(), 0
        # The ids of match i stand in ids[ends[i]:ends[i + 1]].
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Merge the matches met for the first time."""
        data = [p.encode() for p in self.numbers.new]
        self.numbers.new = []
        # A match that is a token as it stands is not merged.
        whole = np.array([self.ranks.get(b, -1) for b in data], np.int32)
        sizes = np.array([len(b) for b in data])
        self.held += int(sizes.sum())
        counts = np.ones(len(data), np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[whole[order] < 0]
        parts, at = [whole[whole >= 0]], 0
        places = [np.flatnonzero(whole >= 0)]
        for size in (4, 8, 16, 32, 64, SHORT):
            end = int(np.searchsorted(sizes[order], size, "right"))
            for begin in range(at, end, AT_ONCE):
                some = order[begin:min(end, begin + AT_ONCE)]
                ids, counts[some] = merge_many([data[i] for i in some], self.byte_ids, self.pairs)
                parts.append(ids.astype(np.int32))
                places.append(some)
            at = end
        for i in order[at:]:
            ids = np.array(merge(data[i], self.ranks), np.int32)
            counts[i] = len(ids)
            parts.append(ids)
            places.append(np.array([i]))
        # The parts hold matches by size; back to the order in which they were met.
        place = np.concatenate(places)
        made = _gathered(np.concatenate(parts), np.concatenate([[0], np.cumsum(counts[place])]), np.argsort(place))
        self.ids = np.concatenate([self.ids, made])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        if len(self.numbers) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        split = [np.fromiter(map(self.numbers.__getitem__, m), np.int32, len(m)) for m in map(self.matches, texts)]
        if self.numbers.new:
            self._learn()
        matches = np.concatenate([np.zeros(0, np.int32), *split])
        counts = np.concatenate([[0], np.cumsum((self.ends[1:] - self.ends[:-1])[matches])])
        bounds = counts[np.concatenate([[0], np.cumsum([len(m) for m in split], dtype=np.int64)])]
        return _gathered(self.ids, self.ends, matches), bounds[1:] - bounds[:-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _gathered(values: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The stretches values[ends[i]:ends[i + 1]] of all wanted i, end to end."""
    counts = ends[wanted + 1] - ends[wanted]
    shift = ends[wanted] - (np.cumsum(counts) - counts)
    return values[np.repeat(shift, counts) + np.arange(int(counts.sum()))]


@functools.lru_cache(maxsize=4)
def codec(ranks: str, pattern: str) -> Codec:
    """The codec of a rank file, once per process."""
    return Codec(ranks, pattern)


def _fields(frame: DataFrame, without: str, keep: list[str] | None) -> tuple[list[str], str]:
    fields = [f for f in frame.schema.fields if f.name != without and (keep is None or f.name in keep)]
    return [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def encode(
    frame: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "tokens", keep: list[str] | None = None,
) -> DataFrame:
    """The rows of `frame` with the ids of `text` as an array `into`.

    `ranks` is a file that every worker can open; `keep` names the columns to return, all by default.
    """
    kept, schema = _fields(frame, into, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(ranks, pattern)
        for batch in batches:
            for begin, size in _chunks(batch.column(text)):
                rows = batch.slice(begin, size)
                texts = [(t or b"").decode("utf-8", "replace") for t in rows.column(text).cast(pa.binary()).to_pylist()]
                ids, counts = codes.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], made], [*kept, into])

    return frame.mapInArrow(run, ", ".join(filter(None, [schema, f"`{into}` array<int>"])))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of a batch of about CHUNK_BYTES each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes) // CHUNK_BYTES
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(number)), bool), number[1:] != number[:-1]]))
    yield from zip(begin.tolist(), np.diff([*begin, len(number)]).tolist(), strict=True)


def decode(
    frame: DataFrame, ranks: str, pattern: str, tokens: str = "tokens", into: str = "decoded", keep: list[str] | None = None,
) -> DataFrame:
    """The rows of `frame` with the bytes that the ids in `tokens` stand for, as a binary column `into`."""
    kept, schema = _fields(frame, into, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codec(ranks, pattern)
        for batch in batches:
            # Row by row: the ids of one text at a time become Python numbers.
            made = pa.array([codes.decode(ids.as_py() or ()) for ids in batch.column(tokens)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], made], [*kept, into])

    return frame.mapInArrow(run, ", ".join(filter(None, [schema, f"`{into}` binary"])))
