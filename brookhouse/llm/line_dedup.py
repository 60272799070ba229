"""Line dedup by pairwise alignment: patience diff against earlier documents, common blocks go from the later one.

Documents with equal texts form a class whose first document (smallest id) stands for it; the others are copies. The result
is that of aligning every class with every earlier class, without making all these pairs:

1. A block that is deleted consists of runs: adjacent lines with at least `min_words` words that have fewer without their last,
   or without their first line. Only an earlier class with one of these runs can delete it.
2. Each class is aligned with the first holder of each of its runs.
3. Runs that still have a line left are aligned with their next earlier holders: `rare` of them, then `rare` times as many
   each round, until all lines of the run are gone or no earlier holder is left.

So pairs grow with the number of runs and with the alignments that leave a shared run standing (its lines cross others, or come
several times); only a run that no earlier holder deletes meets them all. Only hashes of lines and runs and word counts
travel; texts do not meet.

Patience diff matches equal lines at both ends of a range, then the lines that occur once in both ranges, in their
longest rising sequence, and goes on between these. Matched lines that follow each other in both documents form a block.
A block with at least `min_words` words is deleted from the later document.

Equality of lines, runs and texts is that of 64-bit hashes. Defined results: a null or empty text has one line without a word
and stays as it is; copies lose all lines if they have `min_words` words; rows with one id are one document and keep
their lines among each other if their texts are equal; a null id is later than all others; an empty table gives an
empty table; columns other than the text come back untouched (`lines` is replaced).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .anchors import mixed
from .common import WORD, stored

LAST = 2 ** 63 - 1
# The most holders of a run that one round takes; Spark limits ranks up to 1000 before the shuffle.
MOST = 512
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2 ** 64)


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int], words: list[int]) -> list[tuple[int, int]]:
    """Matched (line of a, line of b), rising in both; `words` are the word counts of the lines of b."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        seen: dict[int, int] = {}
        for j in range(b0, b1):
            if b[j] in once and words[j]:
                seen[b[j]] = -1 if b[j] in seen else j
        pairs = [(once[h], j) for h, j in seen.items() if j >= 0 and once[h] >= 0]
        pairs = [pairs[i] for i in _rising([i for i, _ in pairs])]
        if not pairs:
            continue
        # Each range starts with a matched pair, which the loop at its head takes.
        for (i, j), (i2, j2) in zip(pairs, [*pairs[1:], (a1, b1)], strict=True):
            todo.append((i, i2, j, j2))
        todo.append((a0, pairs[0][0], b0, pairs[0][1]))
    return sorted(found)


def deleted(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of b in blocks of matched lines with enough words."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for pair in [*align(a, b, words), (-9, -9)]:
        if pair != (before[0] + 1, before[1] + 1):
            if sum(words[j] for j in block) >= min_words:
                out += block
            block = []
        block.append(pair[1])
        before = pair
    return out


def runs(h: np.ndarray, w: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, last line) of the shortest runs with min_words words from each line on, and up to each line."""
    n = len(h)
    total = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    place = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words) - 1
    begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
    on, back = end < n, begin >= 0
    # Lines without a word have no end of their own.
    lo = np.concatenate([place[on], begin[back]])
    hi = np.concatenate([np.maximum(end, place)[on], place[back]])
    lo, hi = np.unique(np.column_stack([lo, hi]), axis=0).T if len(lo) else (lo, hi)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]))
        away = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BACK))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h.view(np.uint64)) * power[:n], dtype=np.uint64)])
        key = mixed((sums[hi + 1] - sums[lo]) * away[lo] + (hi - lo).astype(np.uint64))
    return key.view(np.int64), lo.astype(np.int32), hi.astype(np.int32)


def dedup(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 8, rare: int = 8) -> DataFrame:
    """The rows of `documents` with the text shortened and a struct `lines` of n_lines, n_deleted and words_left."""
    kept = [f.name for f in documents.schema.fields if f.name != "lines"]
    others = [c for c in kept if c != text]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ranked = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST))
    keyed = documents.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text).cast("string").alias("text"), F.xxhash64(body).alias("k"), ranked.alias("f"))

    split = F.split(F.coalesce("text", F.lit("")), "\n")
    own = keyed.select("k", "f", F.transform(split, lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))).alias("x"))
    classes = own.groupBy("k").agg(F.min("f").alias("f"), F.max("f").alias("last"), F.first("x").alias("x"))
    classes = stored(classes.select("k", "f", "last", F.col("x.h").alias("h"), F.col("x.w").alias("w")), "classes")

    def cut_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [runs(np.asarray(h, np.int64), np.asarray(w, np.int64), min_words) for h, w in zip(batch["h"], batch["w"], strict=True)]
            n = [len(x[0]) for x in found]
            if sum(n):
                run, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"k": np.repeat(batch["k"].to_numpy(), n), "f": np.repeat(batch["f"].to_numpy(), n), "run": run, "lo": lo, "hi": hi})

    every = stored(classes.mapInPandas(cut_runs, "k bigint, f bigint, run bigint, lo int, hi int"), "runs")
    # A class that holds a run twice is one holder.
    holders = every.groupBy("run").agg(F.min(F.struct("f", "k")).alias("at"), F.max(F.struct("f", "k")).alias("last")).filter("at <> last")
    holders = stored(holders.select("run", "at"), "holders")
    shared = stored(every.join(holders.hint("merge"), "run"), "shared")
    later = shared.filter(F.struct("f", "k") != F.col("at"))
    pairs = stored(later.select(F.col("at.k").alias("a"), F.col("k").alias("b")).distinct(), "pairs")
    ranges = stored(later.groupBy("k", "f").agg(F.collect_list(F.struct("run", "lo", "hi")).alias("x")), "ranges")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [deleted(list(a), list(b), list(w), min_words) for a, b, w in zip(batch["ha"], batch["hb"], batch["w"], strict=True)]
            out = pd.DataFrame({"k": batch["b"], "gone": found})
            yield out[out["gone"].map(len) > 0]

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(classes.select(F.col("k").alias("a"), F.col("h").alias("ha")).hint("merge"), "a").join(
            classes.select(F.col("k").alias("b"), F.col("h").alias("hb"), "w").hint("merge"), "b")
        return both.select("b", "ha", "hb", "w").mapInPandas(compare, "k bigint, gone array<int>")

    def standing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, f, x, gone in zip(batch["k"], batch["f"], batch["x"], batch["gone"], strict=True):
                drop = set(() if gone is None else gone)
                out += {(k, f, r["run"]) for r in x if any(i not in drop for i in range(r["lo"], r["hi"] + 1))}
            yield pd.DataFrame(out, columns=["k", "f", "run"])

    def merged(gone: DataFrame) -> DataFrame:
        return gone.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    gone = stored(merged(aligned(pairs)), "gone")
    step, tried = rare, holders
    while True:
        # Runs with a line left and an earlier holder that is not yet tried.
        left = ranges.join(gone.hint("merge"), "k", "left").select("k", "f", "x", "gone").mapInPandas(standing, "k bigint, f bigint, run bigint")
        left = stored(left.join(tried, "run").filter(F.struct("f", "k") > F.col("at")), "standing")
        open_runs = left.select("run", "at").distinct()
        more = shared.select("run", "f", "k").join(open_runs, "run").filter(F.struct("f", "k") > F.col("at")).select("run", "f", "k").distinct()
        rank = F.row_number().over(W.partitionBy("run").orderBy("f", "k"))
        more = stored(more.withColumn("rank", rank).filter(F.col("rank") <= step).select("run", F.struct("f", "k").alias("by")), "more")
        new = left.select("run", "f", F.col("k").alias("b")).join(more, "run").filter(F.col("by") < F.struct("f", F.col("b").alias("k")))
        new = new.select(F.col("by.k").alias("a"), "b").distinct().join(pairs, ["a", "b"], "left_anti")
        new = stored(new, "pairs")
        tried = stored(more.groupBy("run").agg(F.max("by").alias("at")), "tried")
        if tried.isEmpty():
            break
        pairs = pairs.union(new)
        gone = stored(merged(gone.union(aligned(new))), "gone")
        step = min(max(step, 1) * max(rare, 2), MOST)
    copied = classes.filter("last > f").select("k", F.col("f").alias("first"))
    fate = stored(gone.join(copied, "k", "full"), "fate")

    # Sort-merge at every size, as in the pair joins: a trial on a sample then moves as much per document as the corpus.
    words_of = keyed.join(fate.hint("merge"), "k", "left").select("row", "text", F.coalesce(F.col("f") > F.col("first"), F.lit(False)).alias("copy"), "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t, copy, gone in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines = (t or "").split("\n")
                n = [len(_words(x)) for x in lines]
                out = range(len(lines)) if copy and sum(n) >= min_words else gone or ()
                drop = set(out)
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t)
                counts.append((len(lines), len(drop), sum(c for i, c in enumerate(n) if i not in drop)))
            made = pa.StructArray.from_arrays([pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], ["n_lines", "n_deleted", "words_left"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), made], ["row", "text", "lines"])

    row_type = keyed.schema["row"].dataType.simpleString()
    done = words_of.mapInArrow(cut, f"row {row_type}, text string, lines struct<n_lines:bigint,n_deleted:bigint,words_left:bigint>")
    return done.select(*[F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in kept], "lines")


def _words(line: str) -> list[str]:
    """Words between blanks, \\t, \\n, \\v, \\f and \\r; str.split() would also cut at other white space."""
    return [w for w in line.translate(_BLANK).split(" ") if w]


_BLANK = dict.fromkeys(range(9, 14), " ")
