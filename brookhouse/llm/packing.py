"""Packing documents into training sequences: non-negative least squares over length patterns.

A document is its token ids and an end id. Every full window of a document is a sequence of its own;
what is left, its tail, is shorter than the window. For the tails:

1. Their lengths are counted: a histogram of at most `window` - 1 numbers, whatever the size of the data.
2. All combinations of up to three lengths that fill the window exactly are enumerated, and repeat counts
   x >= 0 are solved so that the lengths they use come closest to the histogram (least squares).
3. The counts are rounded down to what the histogram holds.
4. The residual tails are packed greedily: laid end to end and cut wherever a window is full.

So no sequence but the last one is padded, and the last one by less than a window. Planning sees only the
histogram. A tail finds its place from its length and its rank among the tails of that length: each task
ranks its own tails, and the offsets of the tasks come from a grouped count, so a length that a third of
all documents share is still ranked in parallel.

The ids are those of the tokenizer file. They are made by the same vocabulary's rank file, which gives the same
ids (tests compare both) in a quarter of the time; without a rank file the tokenizer file does the work. Texts that hold
the literal of an added token of the tokenizer file, such as <|endoftext|>, are always encoded by the file itself.

Defined results: a null or empty text is the end id alone; equal rows are packed one by one; a null id stays
null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import stored

END_ID = 0
# Sequence numbers of full windows: the task's number above, the window's below.
TASK_SHIFT = 36

TAILS = "doc_id bigint, doc_tokens bigint, full_crcs array<bigint>, first_full bigint, tail int, tail_ids binary, task bigint, rank bigint"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)

_encoders: dict[tuple, Callable[[str], list[int]]] = {}


def encoder(tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids as the tokenizer file gives them without special tokens added around; kept per process."""
    key = (tokenizer, ranks, pattern)
    if key not in _encoders:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(tokenizer)

        def whole(text: str) -> list[int]:
            return loaded.encode(text, add_special_tokens=False).ids

        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            ordinary = tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
            # The file cuts these literals out of a text before it splits words; the ranks do not know them.
            added = [token.content for token in loaded.get_added_tokens_decoder().values()]
            _encoders[key] = lambda text: whole(text) if any(x in text for x in added) else ordinary(text)
        else:
            _encoders[key] = whole
    return _encoders[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def patterns(histogram: np.ndarray, window: int) -> np.ndarray:
    """All combinations of one to three present lengths with the sum `window`; unused places are 0."""
    present = np.flatnonzero(histogram)
    has = np.zeros(window + 1, bool)
    has[present] = True
    found = []
    for a in present:
        b = present[present >= a]
        rest = window - a - b
        pair = b[rest == 0]
        found += [(a, x, 0) for x in pair]
        ok = rest >= b
        ok[ok] = has[rest[ok]]
        found.append(np.column_stack([np.full(ok.sum(), a), b[ok], rest[ok]]))
    rows = [np.asarray(f).reshape(-1, 3) for f in found]
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, by accelerated projected gradient."""
    n = len(histogram)
    target = histogram.astype(float)
    target[0] = 0.0
    flat = combos.ravel()
    used = (combos > 0).astype(float)

    def usage(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (used * x[:, None]).ravel(), n)

    # The largest eigenvalue of A'A bounds the step; a few power rounds find it.
    v = np.ones(len(combos))
    for _ in range(20):
        v = (usage(v)[combos] * used).sum(1)
        top = np.linalg.norm(v) or 1.0
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        gradient = ((usage(y) - target)[combos] * used).sum(1)
        new = np.maximum(0.0, y - gradient / (1.1 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole repeat counts that the histogram can pay for, largest first, and what is left of the histogram."""
    left = histogram.copy()
    left[0] = 0
    chosen = []
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths, each = np.unique(combos[i][combos[i] > 0], return_counts=True)
        times = int(min((left[lengths] // each).min(), int(x[i] + 0.5)))
        if times:
            left[lengths] -= times * each
            chosen.append((combos[i][combos[i] > 0], times))
    return chosen, left


class Plan:
    """Where the tail with a given length and rank goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        taken = np.zeros(len(histogram), np.int64)
        sequence = 0
        combos = patterns(histogram, window)
        chosen, left = rounded(combos, solve(combos, histogram), histogram) if len(combos) else ([], histogram.copy())
        for lengths, times in chosen:
            offset = 0
            for length, each in zip(*np.unique(lengths, return_counts=True), strict=True):
                spans.setdefault(int(length), []).append((int(taken[length]), int(each), sequence, offset))
                taken[length] += times * each
                offset += int(length * each)
            sequence += times
        # Residual tails, longest first, as one stream.
        left[0] = 0
        sizes = left * np.arange(len(left))
        self.base = sizes[::-1].cumsum()[::-1] - sizes
        self.taken, self.first_cut = taken, sequence
        self.spans = {k: np.array(v, np.int64) for k, v in spans.items()}

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(begin, end) within the tail with (sequence, offset) of each piece."""
        if rank < self.taken[length]:
            spans = self.spans[length]
            begin, each, sequence, offset = spans[np.searchsorted(spans[:, 0], rank, "right") - 1]
            turn, slot = divmod(rank - begin, each)
            return [(0, length, int(sequence + turn), int(offset + slot * length))]
        at, done, found = int(self.base[length] + (rank - self.taken[length]) * length), 0, []
        while done < length:
            sequence, offset = divmod(at + done, self.window)
            size = min(length - done, self.window - offset)
            found.append((done, done + size, self.first_cut + sequence, offset))
            done += size
        return found


def pack(
    documents: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
    text: str = "text", doc_id: str = "doc_id", window: int = 1024,
) -> DataFrame:
    """One row per piece, as in PIECES, with the piece's `ids` as little-endian unsigned 32-bit numbers left out."""

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        n_full = 0
        for batch in batches:
            rows = []
            for key, body in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(body or ""), END_ID], dtype="<u4")
                full, tail = divmod(len(ids), window)
                crcs = [crc(ids[i * window:(i + 1) * window]) for i in range(full)]
                rows.append((
                    None if pd.isna(key) else int(key), len(ids), crcs, n_full, tail, ids[full * window:].tobytes(), task, int(seen[tail])))
                n_full += full
                seen[tail] += 1
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in TAILS.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    slim = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tails = stored(slim.mapInPandas(tokenise, TAILS), "packtails")

    counts = tails.groupBy("task", "tail").agg(F.count("*").alias("n"))
    # At most `window` rows come to the driver.
    histogram = np.zeros(window, np.int64)
    for row in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        histogram[row["tail"]] = row["n"]
    plan = Plan(histogram, window)

    before = W.partitionBy("tail").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("task", "tail", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = tails.join(offsets, ["task", "tail"]).withColumn("rank", F.col("rank") + F.col("before"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                key = None if pd.isna(r.doc_id) else int(r.doc_id)
                first = ((int(r.task) + 1) << TASK_SHIFT) + int(r.first_full)
                for i, c in enumerate(r.full_crcs):
                    rows.append((key, i * window, window, int(c), r.doc_tokens, first + i, 0))
                if r.tail:
                    ids = np.frombuffer(r.tail_ids, "<u4")
                    begun = r.doc_tokens - r.tail
                    for a, b, sequence, offset in plan.places(int(r.tail), int(r.rank)):
                        rows.append((key, begun + a, b - a, crc(ids[a:b]), r.doc_tokens, sequence, offset))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return placed.select(
        "doc_id", "doc_tokens", "full_crcs", "first_full", "tail", "tail_ids", "task", "rank").mapInPandas(cut, PIECES)
