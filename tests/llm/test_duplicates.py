"""Vectors, lines, byte strings, shingles: brute force on the sample and on odd input."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from brookhouse.llm import line_dedup, ngram_join, suffix_dedup, vectors
from brookhouse.llm.components import components
from helpers import FOLDER, clashing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def closed(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    rng.shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame([tuple(map(int, x)) for x in links], "a long, b long"), "a", "b").collect()}
    want = closed(600, links)
    assert found == {i: w for i, w in enumerate(want) if w != i}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def vector_truth(rows, threshold):
    usable = [
        r[2] is not None and len(r[2]) > 0 and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if usable[i] and usable[j] and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links.append((j, i))
    n = Counter(i for pair in links for i in pair)
    return [(r[0], n[i], rows[k][0]) for (i, r), k in zip(enumerate(rows), closed(len(rows), links), strict=True)]


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, monkeypatch, block):
    """Groups of near copies, equal rows, unusable vectors; small blocks cut hot buckets."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        base = rng.normal(size=16)
        for _ in range(12):
            rows.append((len(rows), int(c % 3), [float(x) for x in base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])]))
    rows += [(len(rows) + i, 1, rows[20][2]) for i in range(20)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 4, [1.0] * 4]
    rows += [(1000 + i, 1, v) for i, v in enumerate(odd)] + [(2000, None, [1.0] * 16), (2001, None, [1.0] * 16)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), "k", "id", "n")
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(frame, recall=0.999999).collect()}
    exact = [(i, y, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows]
    assert list(got.values()) and [got[r[0]] for r in rows] == vector_truth(exact, 0.93)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vector_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in entry.queries()["op3_embedding_near_dedup"](spark, FOLDER).collect()}
    assert [got[r.vec_id] for r in rows] == vector_truth([(r.vec_id, r.label, r.embedding) for r in rows], 0.93)


def test_align():
    a = "a b c d e f".split()
    assert line_dedup.align(a, "x b c y e f".split(), [1] * 6) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert line_dedup.align(a, "d e a b".split(), [1] * 4) in ([(0, 2), (1, 3)], [(3, 0), (4, 1)])
    assert line_dedup.align([], a, [1] * 6) == [] and line_dedup.align(a, a, [1] * 6) == [(i, i) for i in range(6)]


def test_lines_empty(empty):
    assert line_dedup.dedup(empty).count() == 0


def suffix_truth(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        left = bytes(x for x, m in zip(d, mask, strict=True) if not m)
        out.append((len(d), len(d) - len(left), sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1])), hashlib.sha256(left).hexdigest()))
    return out


def suffix_found(frame, **how):
    out = suffix_dedup.remove_repeats(frame, **how).collect()
    return Counter((r.doc_id, r.deduped.n_bytes, r.deduped.n_removed, r.deduped.n_spans, hashlib.sha256(bytes(r.deduped.kept)).hexdigest()) for r in out)


@pytest.mark.parametrize("how", [{}, {"length": 40, "gram": 10}, {"length": 40, "gram": 10, "group_limit": 1}])
def test_suffixes(sample, odd, how):
    for frame in (sample, odd):
        rows = frame.collect()
        want = Counter((r.doc_id, *t) for r, t in zip(rows, suffix_truth([r.text for r in rows], how.get("length", 400)), strict=True))
        assert suffix_found(clashing(frame, "row", "k", "g", "deduped"), **how) == want


def test_suffixes_empty(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL", 4)
    tokens = np.random.default_rng(2).integers(0, 4, (500, 3)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(tokens)
    assert [tuple(x) for x in tokens[order]] == sorted(map(tuple, tokens)) and sorted(order) == list(range(500))


def shingle_sets(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def shingle_truth(rows, size, num, den):
    sets = shingle_sets([t for _, t in rows], size)
    links = [
        (j, i) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j])]
    root = closed(len(rows), links)
    least = {}
    for (key, _), r in zip(rows, root, strict=True):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(key, len(s), least.get(r)) for (key, _), s, r in zip(rows, sets, root, strict=True)]


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_shingles(sample, odd, size, num, den):
    for frame in (sample, odd):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = ngram_join.similar_groups(clashing(frame, "k", "c", "n"), size=size, num=num, den=den).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(shingle_truth(rows, size, num, den))


def test_shingles_near_copies(spark, monkeypatch):
    """Sets of every size with few edits, groups over several blocks, a shared passage in unlike documents."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(100_000)}"
    rows = []
    for n in [1, 2, 3, 4, 5, 7, 9, 10, 12, 15, 20, 33, 64, 130, 400, 900]:
        base = [word() for _ in range(n)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.integers(0, max(2, n // 40 + 2))):
                copy[rng.integers(n)] = word()
            rows.append((len(rows), " ".join(copy[rng.integers(0, 2):] or copy)))
    passage = [word() for _ in range(60)]
    rows += [(1000 + i, " ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))])) for i in range(40)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(shingle_truth(rows, 4, 85, 100))


def test_keep_one(odd, empty):
    kept = ngram_join.keep_one(clashing(odd, "_row"), size=5, num=80, den=100).collect()
    # Of 1, 2, 2, 3 and a null id the first stays; texts without words all stay.
    assert Counter(r.doc_id for r in kept) == Counter([1, 4, 5, 6, None, 7, 8, 9, 9, 10, 11, 12])
    assert ngram_join.keep_one(empty).count() == 0


def all_earlier(rows, min_words=8):
    """Lines left after a patience diff with every earlier document, by an aligner of its own."""
    def match(a, b, words):
        if not a or not b:
            return []
        if a[0] == b[0]:
            return [(0, 0)] + [(i + 1, j + 1) for i, j in match(a[1:], b[1:], words[1:])]
        if a[-1] == b[-1]:
            return match(a[:-1], b[:-1], words[:-1]) + [(len(a) - 1, len(b) - 1)]
        both = [(a.index(x), j) for j, x in enumerate(b) if words[j] and a.count(x) == 1 and b.count(x) == 1]
        best = []
        for n, (i, _) in enumerate(both):
            # Of equally long chains the latest.
            best.append(max((best[m] for m in reversed(range(n)) if both[m][0] < i), key=len, default=[]) + [both[n]])
        chain = max(reversed(best), key=len, default=[])
        out = []
        for (i, j), (i2, j2) in zip([(0, 0), *chain], [*chain, (len(a), len(b))], strict=True) if chain else ():
            out += [(i + x, j + y) for x, y in match(a[i:i2], b[j:j2], words[j:j2])]
        return out

    out = []
    for n, text in enumerate(rows):
        b, gone = text.split("\n"), set()
        words = [len(WORD.findall(x)) for x in b]
        for a in rows[:n]:
            run = []
            for i, j in [*match(a.split("\n"), b, words), (-9, -9)]:
                if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
                    gone |= {y for _, y in run} if sum(words[y] for _, y in run) >= min_words else set()
                    run = []
                run.append((i, j))
        out.append("\n".join(x for i, x in enumerate(b) if i not in gone))
    return out


def line_truth(rows, min_words=8):
    """The whole rule: each text loses what aligns with any earlier one; later rows of a text lose it whole."""
    last = 2 ** 63 - 1
    first = {}
    for key, text in rows:
        t = text or ""
        first[t] = min(first.get(t, last), last if key is None else key)
    order = sorted(first, key=lambda t: first[t])
    lines = {t: t.split("\n") for t in order}
    words = {t: [len(WORD.findall(x)) for x in lines[t]] for t in order}
    spoken = {t: {x for x, n in zip(lines[t], words[t], strict=True) if n} for t in order}
    gone = {}
    for n, t in enumerate(order):
        gone[t] = set()
        for p in order[:n]:
            run = []
            for pair in [*(line_dedup.align(lines[p], lines[t], words[t]) if spoken[p] & spoken[t] else ()), (-9, -9)]:
                if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
                    if sum(words[t][j] for _, j in run) >= min_words:
                        gone[t] |= {j for _, j in run}
                    run = []
                run.append(pair)
    out = []
    for key, text in rows:
        t = text or ""
        later = (last if key is None else key) > first[t] and sum(words[t]) >= min_words
        drop = set(range(len(lines[t]))) if later else gone[t]
        out.append((key, "\n".join(x for i, x in enumerate(lines[t]) if i not in drop) if drop else text, len(drop)))
    return Counter(out)


def test_lines(sample, odd):
    for frame in (sample, odd):
        got = Counter((r.doc_id, r.text, r.lines.n_deleted) for r in line_dedup.dedup(clashing(frame, "row", "k", "f", "lines")).collect())
        assert got == line_truth([(r.doc_id, r.text) for r in frame.collect()])


@pytest.mark.parametrize("rare", [8, 2])
def test_lines_with_all_earlier_documents(spark, rare):
    """Frequent lines whose first holder has them in another order, twice, or without the rest of a passage."""
    rng = np.random.default_rng(8)
    long = [f"common line {i} with more than eight words in it" for i in range(4)]
    short = ["share this", "", "read more here", "next page"]
    rows = []
    for n in range(60):
        own = [f"own {n} {i} of few words" for i in range(3)]
        lines = [*own, *(long[i] for i in rng.choice(4, 3)), *(short[i] for i in rng.choice(4, 4))]
        rows.append("\n".join(lines[i] for i in rng.permutation(len(lines))))
    rows += ["\n".join([f"head {n}", "read more here", "a passage of four words", "next page", f"tail {n}"]) for n in range(20)]
    rows += ["\n".join([f"own {n}", "a passage of four words", f"other {n}", "read more here"]) for n in range(20, 24)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame, rare=rare).collect()}
    assert [got[i] for i in range(len(rows))] == all_earlier(rows)


def test_shingles_growing_versions(spark):
    """Versions that grow across a level: the third is a leader of the fourth and a member where its own leader does not link with it."""
    rows = [
        (40 * c + i, " ".join(f"c{c}w{x}" for x in range(n))) for c in range(40) for i, n in enumerate((21, 24, 28, 32))]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(shingle_truth(rows, 1, 85, 100))


def test_suffixes_of_copies_are_sorted_once(spark, monkeypatch):
    """Many exact copies and a near copy: a bucket gets each context once."""
    from pyspark.sql import GroupedData

    seen, apply = [], GroupedData.applyInPandas

    def spy(self, *how):
        if "bucket" in self._df.columns:
            seen.append((self._df.count(), self._df.select("g", "c").distinct().count()))
        return apply(self, *how)

    for kind in {GroupedData, *GroupedData.__subclasses__()}:
        monkeypatch.setattr(kind, "applyInPandas", spy)
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(300))
    texts = [text] * 40 + [text[:700] + " changed " + text[700:]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = Counter((i, *t) for i, t in enumerate(suffix_truth(texts, 400)))
    assert suffix_found(frame) == want
    assert seen and all(n == different > 0 for n, different in seen)


def test_shingle_cells_are_bounded(spark, monkeypatch):
    """Pages of one template that do not link with each other: no cell holds more than about two blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    cells, keep = [], ngram_join.stored

    def spy(frame, label):
        out = keep(frame, label)
        if label == "cells":
            cells.append(out)
        return out

    monkeypatch.setattr(ngram_join, "stored", spy)
    rows = [(i, " ".join([*(f"t{x}" for x in range(30)), *(f"own{i}w{x}" for x in range(5))])) for i in range(160)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(shingle_truth(rows, 1, 85, 100))
    # Blocks are dealt by hash, so they are uneven.
    sizes = [r["count"] for c in cells for r in c.groupBy(*[n for n in c.columns if n not in ("c", "ask")]).count().collect()]
    assert len(sizes) > 50 and max(sizes) <= 6 * 8


def test_suffix_query_on_planted_passages(spark, tmp_path):
    """Passages of over 50 words go from 400 bytes on, everywhere they stand; shorter ones and clean texts stay."""
    def words(seed, n, size):
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), size)) for _ in range(n))

    long, short = words(1, 70, 7), words(2, 80, 6).replace("é", "e")[:399]
    assert len(long.split()) > 50 < len(short.split()) and len(long.encode()) > 400 and len(short.encode()) == 399
    clean = [words(10 + i, 150, 6) for i in range(6)]
    # Unlike letters beside the passages, so that none reaches further.
    texts = [f"{c[:300]}{'ABCDEF'[i]}{p}{'KLMNOP'[i]}{c[300:]}" for i, (c, p) in enumerate(zip(clean, [long, long, long, short, short, ""], strict=True))]
    # With the same bytes before it, the short passage reaches 400.
    texts += [f"{words(30, 90, 6)} X{short}Y {words(31, 90, 6)}", f"{words(32, 90, 6)} X{short}Z {words(33, 90, 6)}", None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["op6_suffix_dedup"](spark, str(tmp_path)).collect()}
    gone = [long] * 3 + [""] * 3 + [f" X{short}"] * 2 + [""] * 2
    for i, (text, lost, truth) in enumerate(zip(texts, gone, suffix_truth(texts, 400), strict=True)):
        r, text = got[i], text or ""
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == truth
        assert (r.n_removed, r.n_chars) == (len(lost.encode()), len(text) - len(lost))
    assert len(got) == len(texts)
