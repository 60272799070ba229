"""Toxicity scores by a bidirectional gated recurrent network over words and pieces of words.

Every text is cut into overlapping windows of SIZE words, STRIDE words apart, to its last word. A window is
read in both directions by a gated recurrent network (llm.gru) whose inputs are the word, its first and its last
characters; attention pools the states, and a logistic output scores the window. The score of a text is that of
its worst window, brought to a probability by a logistic fit on the training texts. All windows of all texts are
scored, whole, in chunks of bounded size.

Labels belong to texts, not to windows. For training, a toxic text gives the windows around its words that
speak most for the label (log odds over the training texts), other texts give their windows with the highest such
words and some at random. Training takes up to `per_class` texts per label, in the order of a hash of their
content, each whole and of at most `longest` characters (documented bounds: the model is a classifier).

Defined results: null texts and texts without a word score 0; equal texts score alike; without labels of both
kinds all texts score the share of label 1 (0 if there is none); rows with a null label teach nothing; a
text with both labels teaches both; other columns come back untouched, one named `toxicity` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .gru import CHUNK, Network, Vocabulary, windows, word_hashes

SIZE, STRIDE = 48, 36


class Scorer:
    def __init__(self, vocabularies: list[np.ndarray], network: Network | None, line: tuple[float, float], prior: float):
        self.hashes, self.network, self.line, self.prior = vocabularies, network, line, prior

    def ready(self) -> None:
        self.vocabularies = [Vocabulary(h) for h in self.hashes]
        self.tables = self.network.projected() if self.network else {}


def streams(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts, words per text, hashes of their words) for groups of texts of about CHUNK bytes; longer texts come alone."""
    group: list[int] = []
    size = 0

    def made(group: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(texts[i] for i in group) + b"\n", np.uint8)
        ends = np.cumsum([len(texts[i]) + 1 for i in group])
        begins, hashes = [], []
        at = 0
        while at < len(data):
            # A chunk ends after a separator, so that no word is cut; a word of a whole chunk is cut.
            stop = min(len(data), at + CHUNK)
            if stop < len(data):
                back = data[at:stop][::-1][:1 << 16]
                gap = np.flatnonzero(np.isin(back, SEPARATORS))
                stop -= int(gap[0]) if len(gap) else 0
            begin, found = word_hashes(data[at:stop])
            begins.append(begin + at)
            hashes.append(found)
            at = stop
        begin = np.concatenate(begins)
        counts = np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))
        return group, counts, np.concatenate(hashes, 1)

    for i, text in enumerate(texts):
        if group and size + len(text) + 1 > CHUNK:
            yield made(group)
            group, size = [], 0
        group.append(i)
        size += len(text) + 1
    if group:
        yield made(group)


SEPARATORS = np.array([9, 10, 11, 12, 13, 32], np.uint8)


def logits(scorer: Scorer, texts: list[bytes]) -> np.ndarray:
    """The highest window output of each text, -inf where there is no word."""
    worst = np.full(len(texts), -np.inf)
    for group, counts, hashes in streams(texts):
        ids = np.stack([v.ids(h) for v, h in zip(scorer.vocabularies, hashes, strict=True)])
        made = windows(counts, ids, SIZE, STRIDE)
        if len(made.owner):
            np.maximum.at(worst, np.array(group)[made.owner], scorer.network.logits(made, scorer.tables))
    return worst


def scores(scorer: Scorer, texts: list[bytes]) -> np.ndarray:
    if scorer.network is None:
        return np.array([scorer.prior if t else 0.0 for t in texts])
    worst = logits(scorer, texts)
    a, b = scorer.line
    with np.errstate(over="ignore"):
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(a * np.where(np.isfinite(worst), worst, 0) + b, -40, 40))), 0.0)


def fitted(texts: list[bytes], labels: np.ndarray, most_known: int = 8000, least_texts: int = 3, seed: int = 6) -> Scorer:
    """A scorer from training texts."""
    prior = float(labels.mean()) if len(labels) else 0.0
    if len(np.unique(labels)) < 2:
        return Scorer([], None, (1.0, 0.0), prior)
    rng = np.random.default_rng(seed)
    owner, columns = [], [[], [], []]
    counts = np.zeros(len(texts), np.int64)
    for group, n, hashes in streams(texts):
        counts[group] = n
        owner.append(np.repeat(group, n))
        for column, h in zip(columns, hashes, strict=True):
            column.append(h)
    owner_of = np.concatenate(owner)
    hashes = [np.concatenate(c) for c in columns]
    n_pos, n_neg = int(labels.sum()), int(len(labels) - labels.sum())
    vocabularies, speaks = [], np.zeros(len(owner_of))
    for column in hashes:
        known, place = np.unique(column, return_inverse=True)
        pairs = np.unique(place.astype(np.int64) * len(texts) + owner_of)
        word, text = pairs // len(texts), pairs % len(texts)
        pos = np.bincount(word, labels[text], len(known))
        neg = np.bincount(word, 1 - labels[text], len(known))
        odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        seen = pos + neg
        expected = seen * n_pos / (n_pos + n_neg)
        # How far the count in toxic texts is from chance. Words within chance would only be learned by heart,
        # so they stay unknown, except the most frequent ones.
        far = (pos - expected) / np.sqrt(expected * n_neg / (n_pos + n_neg) + 0.1)
        speaks = np.maximum(speaks, np.where((seen >= least_texts) & (far >= 3), odds, 0)[place])
        rank = np.argsort(-seen, kind="stable")
        frequent = np.zeros(len(known), bool)
        frequent[rank[:200]] = True
        use = rank[((seen >= least_texts) & (np.abs(far) >= 3) | frequent)[rank]]
        rank = use[np.argsort(-np.abs(far[use]), kind="stable")][:most_known]
        vocabularies.append(known[rank])
    scorer = Scorer(vocabularies, Network([len(v) + 1 for v in vocabularies]), (1.0, 0.0), prior)
    scorer.ready()

    ids = np.stack([v.ids(h) for v, h in zip(scorer.vocabularies, hashes, strict=True)])
    made = windows(counts, ids, SIZE, STRIDE)
    # The strongest word of every window decides which windows teach.
    first = np.cumsum(counts) - counts
    near = windows(counts, np.arange(len(owner_of))[None, :], SIZE, STRIDE)
    peak = np.where(near.mask, speaks[near.ids[0]], -np.inf).max(0)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, made.owner, peak)
    positive = labels[made.owner] == 1
    drawn = rng.random(len(made.owner)) < 2.0 / np.maximum(1, np.bincount(made.owner, minlength=len(texts)))[made.owner]
    chosen = np.where(positive, peak >= np.maximum(best[made.owner] - 0.5, 1.0), drawn | (peak >= best[made.owner]))
    chosen = np.flatnonzero(chosen)
    part = type(made)(made.ids[:, :, chosen], made.mask[:, chosen], made.owner[chosen])
    scorer.network.fit(part, positive[chosen].astype(np.float32))
    scorer.tables = scorer.network.projected()

    # A logistic line from the worst window to the label: smoothed targets, Newton steps with damping.
    worst = logits(scorer, texts)
    seen = np.isfinite(worst)
    x = np.clip(worst[seen], -12, 12)
    y = np.where(labels[seen] == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s = p * (1 - p) + 1e-4
        g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum()])
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - d[0], b - d[1]
    scorer.line = (float(max(a, 0.05)), float(b))
    return scorer


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = 1200, longest: int = 20_000,
) -> Scorer:
    """A scorer from the texts that `labels` marks with 0 or 1.

    Only whole texts teach, as a label holds for a whole text; those of more than `longest` characters are left out of the sample.
    Labels meet hashes of texts, not texts. Hashes are uniform, so the per_class smallest of a label lie below a bound that its
    number of texts gives; what lies below it, about twice as many as needed, comes to the driver, and no task ranks a whole
    label. The chosen texts are then picked out by a scan.
    """
    fit = documents.filter(F.length(text).between(1, longest))
    hashed = fit.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    marks = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    slim = stored(hashed.select("key", "h").join(marks, "key").select("y", "h").distinct(), "labelled")
    chosen = []
    for row in slim.groupBy("y").count().collect():
        share = min(1.0, 2 * per_class / row["count"])
        while True:
            end = int(-2**63 + share * 2**64) if share < 1 else 2**63 - 1
            found = sorted(r["h"] for r in slim.filter((F.col("y") == row["y"]) & (F.col("h") <= end)).collect())
            if len(found) >= min(per_class, row["count"]):
                break
            share = min(1.0, 2 * share)
        chosen += [(h, row["y"]) for h in found[:per_class]]
    if not chosen:
        return fitted([], np.zeros(0, np.int64))
    picked = hashed.filter(F.col("h").isin([h for h, _ in chosen])).groupBy("h").agg(F.min("text").alias("text"))
    texts = {r["h"]: r["text"].encode() for r in picked.collect()}
    chosen.sort()
    return fitted([texts[h] for h, _ in chosen], np.array([y for _, y in chosen], np.int64))


_ready: dict[int, Scorer] = {}


def score(documents: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The rows of `documents` with a column `toxicity` (0 to 1) added."""
    kept = [f for f in documents.schema.fields if f.name != "toxicity"]
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    key = id(shared)
    own = documents.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ready:
            _ready.clear()
            shared.value.ready()
            _ready[key] = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores(_ready[key], texts), pa.float64())], ["row", "toxicity"])

    done = own.mapInArrow(read, f"row {own.schema['row'].dataType.simpleString()}, toxicity double")
    return done.select(*[F.col("row")[f.name].alias(f.name) for f in kept], "toxicity")
