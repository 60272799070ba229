"""Language identification by prediction by partial matching (PPM) over bytes.

Every language has a tree of byte contexts up to ORDER bytes long with the counts of what followed them.
A byte costs, in the longest known context, its part of the counts where the context knows it, or else an
escape (as likely as the number of distinct followers, method C) and its cost in the context shortened by one
byte, in which the bytes that were just ruled out no longer count (exclusion). Below the empty context all
remaining bytes are alike. So the code length of a text is exact: it is what an arithmetic coder with these
statistics would need. The statistics are frozen once trained; a text does not change them.

With frozen statistics, the cost of a byte depends on the ORDER bytes before it alone. Each task therefore
unfolds the trees into tables once: from the ORDER bytes before to the longest known context, and from that
and the byte to the cost. Scoring is then a few table look-ups per byte, over the whole text.

Training takes up to `sample_chars` characters per language from the labelled texts, whole texts in the
order of a hash of their content, the last one cut, and not more than MOST texts (a documented bound: the
model is a classifier).

Defined results: `und` with score 0 for null texts and texts without a letter, and for all texts when
nothing was learned; ties go to the first language by name; every text is read whole, in slices of SLICE
bytes; equal rows are scored one by one; other columns come back untouched, one named `language` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql.types import StringType, StructField, StructType

from .common import stored

ORDER = 3
UNKNOWN = "und"
SLICE = 1 << 20
START = b"\n" * ORDER
# Bytes of evidence that the score weighs: it is the posterior of an average stretch of this length.
EVIDENCE = 48
# Texts per language that training looks at, at most.
MOST = 2000


class Model:
    """Counts of byte n-grams per language; small enough to travel with the tasks."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        for language in self.languages:
            # Every text starts after ORDER line feeds; keys hold ORDER context bytes and the byte itself.
            keys = [key for text in samples[language] if text for key in [_keys(np.frombuffer(START + text, np.uint8))]]
            self.grams.append(np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint32), np.zeros(0, int)))


def _keys(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    return (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]


class Tables:
    """A model unfolded for scoring: one shared context number and, per language, costs by context and byte."""

    def __init__(self, model: Model):
        self.languages = model.languages
        used = np.unique(np.concatenate([np.concatenate([(k >> s) & 255 for s in (0, 8, 16, 24)]) for k, _ in model.grams]))
        # Bytes that no sample holds share one symbol: they cost the same everywhere.
        self.symbol = np.full(256, len(used), np.intp)
        self.symbol[used] = np.arange(len(used))
        self.n = n = len(used) + 1
        unused = 256 - len(used)

        contexts = [np.unique(np.concatenate([self._fold(k >> 8, order) for k, _ in model.grams])) for order in range(ORDER + 1)]
        # The number of the longest context that any language knows, by the last ORDER symbols.
        self.context = np.zeros(n ** ORDER, np.int32)
        base, starts = 0, []
        for order, known in enumerate(contexts):
            starts.append(base)
            view = self.context.reshape(-1, n ** order) if order else self.context.reshape(-1, 1)
            if order:
                view[:, known] = np.arange(base, base + len(known), dtype=np.int32)
            base += len(known)
        self.rows, self.costs = [], []
        for keys, counts in model.grams:
            row = np.zeros(base, np.int32)
            tables, below = [np.full((1, n), np.log2(256.0))], None
            done = 1
            for order in range(ORDER + 1):
                ctx, followers = self._fold(keys >> 8, order), self.symbol[keys & 255]
                own, place = np.unique(ctx, return_inverse=True)
                table = np.zeros((len(own), n))
                np.add.at(table, (place, followers), counts)
                below = self._costs(table, own, order, below, unused)
                tables.append(below[2])
                number = starts[order] + np.searchsorted(contexts[order], own)
                row[number] = done + np.arange(len(own))
                # A context this language lacks falls back on its longest known ending.
                if order:
                    lacking = np.setdiff1d(contexts[order], own, assume_unique=True)
                    shorter = lacking % n ** (order - 1) if order > 1 else np.zeros(len(lacking), np.int64)
                    row[starts[order] + np.searchsorted(contexts[order], lacking)] = row[
                        starts[order - 1] + np.searchsorted(contexts[order - 1], shorter)]
                done += len(own)
            self.rows.append(row)
            self.costs.append(np.concatenate(tables).astype(np.float32).ravel())

    def _fold(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """The last `order` context bytes as one number over symbols."""
        number = np.zeros(len(contexts), np.int64)
        for back in range(order - 1, -1, -1):
            number = number * self.n + self.symbol[(contexts >> (8 * back)) & 255]
        return number

    def _costs(self, table: np.ndarray, own: np.ndarray, order: int, below: tuple | None, unused: int) -> tuple:
        """(contexts, counts, costs) of one order. Costs of an order look at the counts of all lower orders."""
        seen = table > 0
        total, distinct = table.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            cost = np.where(seen, -np.log2(table / (total + distinct)), 0.0)
        escape = -np.log2(distinct / (total + distinct))
        # Walk down: `excluded` bytes were known to a longer context and are out.
        chain = []
        level, ctx = below, own
        while level is not None:
            ctx = ctx % self.n ** (len(level[3]) - 1) if len(level[3]) > 1 else np.zeros(len(own), np.int64)
            place = np.searchsorted(level[0], ctx)
            chain.append(level[1][place])
            level = level[4]
        excluded, spent, open_ = seen.copy(), np.repeat(escape, self.n, 1), ~seen
        for counts in chain:
            free = np.where(excluded, 0.0, counts)
            known = free > 0
            total, distinct = free.sum(1, keepdims=True), known.sum(1, keepdims=True)
            some = distinct > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                here = -np.log2(free / (total + distinct))
                step = np.where(some, -np.log2(distinct / (total + distinct)), 0.0)
            hit = known & open_
            cost = np.where(hit, spent + np.where(hit, here, 0.0), cost)
            open_ &= ~known
            excluded |= known
            spent = spent + step
        # Below the empty context: all bytes not ruled out are alike.
        left = (self.n - 1 - excluded[:, :-1].sum(1, keepdims=True)) + unused
        cost = np.where(open_, spent + np.log2(np.maximum(left, 1)), cost)
        return own, table, cost, range(order + 1), below

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits per language of the bytes ORDER.. of `data`, summed over runs that begin at `starts`."""
        s = self.symbol[data]
        number = self.context.take((s[:-3] * self.n + s[1:-2]) * self.n + s[2:-1])
        s = s[3:]
        out = np.empty((len(starts), len(self.languages)))
        for i, (row, cost) in enumerate(zip(self.rows, self.costs, strict=True)):
            bits = cost.take(row.take(number).astype(np.intp) * self.n + s)
            out[:, i] = np.add.reduceat(bits, starts, dtype=np.float64)
        return out


def score(tables: Tables, texts: list[bytes]) -> np.ndarray:
    """Code lengths in bits, one row per text and one column per language; empty texts cost nothing."""
    bits = np.zeros((len(texts), len(tables.languages)))
    group: list[int] = []
    size = 0

    def flush() -> None:
        # Texts of a group are laid end to end, each after ORDER line feeds; those bytes belong to no text.
        data = np.frombuffer(b"".join(START + texts[i] for i in group), np.uint8)
        ends = np.cumsum([len(texts[i]) + ORDER for i in group])
        begins = np.concatenate([[0], ends[:-1]])
        # Position p of the summed array is byte p + ORDER; between texts lie ORDER positions to leave out.
        cuts = np.column_stack([begins, ends - ORDER]).ravel()[:-1]
        bits[group] += tables.lengths(data, cuts)[::2]

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > SLICE:
            whole = np.frombuffer(START + text, np.uint8)
            for at in range(0, len(text), SLICE):
                bits[i] += tables.lengths(whole[at:at + SLICE + ORDER], np.zeros(1, int))[0]
            continue
        if group and size + len(text) > SLICE:
            flush()
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        flush()
    return bits


_tables: dict[int, Tables] = {}


def _loaded(key: int, model: Model) -> Tables:
    if key not in _tables:
        _tables.clear()
        _tables[key] = Tables(model)
    return _tables[key]


def _by_name(values: dict[str, int]) -> Column:
    """The value of the row's language."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), F.col("lang"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_chars: int = 150_000) -> Model:
    """The model of the languages in `labelled`; rows without a text or a language teach nothing."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & (F.length("text") > 0) & (F.col("lang") != UNKNOWN))
    rows = rows.select("lang", "text", F.least(F.length("text"), F.lit(sample_chars)).alias("n"), F.xxhash64("text").alias("h"))
    # Equal texts count once. Hashes are uniform, so the MOST smallest of a language lie below a bound that its number of texts
    # gives (all but with a chance under 1e-100). Only what lies below it, some 2 * MOST numbers, is ranked, so no task ranks a
    # whole language; the texts themselves are fetched by their hash afterwards.
    found = stored(rows.groupBy("lang", "h").agg(F.max("n").alias("n")), "hashes")
    counts = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    bounds = {name: -2**63 + 2**65 * MOST // n if n > 2 * MOST else 2**63 - 1 for name, n in counts.items()}
    order = W.partitionBy("lang").orderBy("h")
    slim = found.filter(F.col("h") <= _by_name(bounds)).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= MOST)
    slim = slim.withColumn("before", F.sum("n").over(order) - F.col("n")).filter(F.col("before") < sample_chars)
    # One number per language comes to the driver, as the model will; a scan then finds the texts below it.
    ends = {r["lang"]: r["end"] for r in slim.groupBy("lang").agg(F.max("h").alias("end")).collect()}
    part = rows.filter(F.col("h") <= _by_name(ends)).groupBy("lang", "h").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
    samples: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    # Fewer than 2 * sample_chars characters per language.
    for row in sorted(part.collect(), key=lambda r: (r["lang"], r["h"])):
        left = room.get(row["lang"], sample_chars)
        samples.setdefault(row["lang"], []).append(row["text"][:left].encode())
        room[row["lang"]] = max(0, left - len(row["text"]))
    return Model(samples)


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `documents` with a struct `language` of lang, score and bits_per_byte added."""
    kept = [f for f in documents.schema.fields if f.name != "language"]
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    key = id(shared)
    inner = "lang string, score double, bits_per_byte double"
    own = documents.select(
        F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), F.col(text).alias("text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = _loaded(key, model) if model.languages else None
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            texts = [t if ok else b"" for t, ok in zip(batch.column("text").cast(pa.binary()).to_pylist(), letters, strict=True)]
            n = len(texts)
            names: list[str] = [UNKNOWN] * n
            scores, rate = np.zeros(n), np.zeros(n)
            if tables is not None and n:
                bits = score(tables, texts)
                per = bits / np.maximum([len(t) for t in texts], 1)[:, None]
                best = per.argmin(1)
                lead = per[np.arange(n), best]
                odds = np.exp2(-(per - lead[:, None]) * EVIDENCE).sum(1)
                names = [tables.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                scores, rate = np.where(letters, 1 / odds, 0.0), np.where(letters, lead, 0.0)
            made = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(rate)], ["lang", "score", "bits_per_byte"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), made], ["row", "language"])

    schema = StructType([StructField("row", own.schema["row"].dataType)])
    tagged = own.mapInArrow(tag, f"row {schema['row'].dataType.simpleString()}, language struct<{inner.replace(' ', ':').replace(',:', ',')}>")
    return tagged.select(*[F.col("row")[f.name].alias(f.name) for f in kept], "language")
