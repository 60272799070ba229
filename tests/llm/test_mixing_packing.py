"""Mixing, packing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from brookhouse.llm import mixing, packing
from brookhouse.llm.queries import tokenizer_files
from helpers import FOLDER, clashing


def test_mixture_weights(spark):
    rows = [(i, "s" + str(0 if i < 600 else 1 + i % 4), "a b c d e") for i in range(1000)]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string"), "row", "s", "mix", "epoch")
    drawn = mixing.mix(frame, target_entropy=0.95, max_repeats=2.0, n_blocks=16).collect()
    tokens = Counter()
    for r in drawn:
        tokens[r.source] += r.mix.n_tokens
    share = {r.source: r.mix.weight for r in drawn}
    assert sum(share.values()) == pytest.approx(1)
    assert -sum(w * np.log(w) for w in share.values()) >= 0.95 * np.log(5) - 1e-9
    for source, weight in share.items():
        assert 0 <= weight * 5000 - tokens[source] < 6
    times = Counter(r.doc_id for r in drawn)
    assert max(times.values()) <= 2
    # Within an epoch no document comes twice.
    assert max(Counter((r.doc_id, r.mix.epoch) for r in drawn).values()) == 1


def test_mixture_limits_repeats(spark):
    rows = [(i, "big" if i else "tiny", "a b c d e f g h i j") for i in range(101)]
    drawn = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), target_entropy=1.0, max_repeats=3.0).collect()
    assert Counter(r.source for r in drawn)["tiny"] in (2, 3)


def test_mixture_odd(odd, empty):
    drawn = mixing.mix(odd).collect()
    assert drawn and all(r.mix.n_tokens > 0 for r in drawn)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd.filter("text is null or text = ''")).count() == 0


def check_pieces(texts, pieces, window=1024):
    encode = packing.encoder(tokenizer_files()["tokenizer"])
    left = defaultdict(Counter)
    for key, t in texts:
        left[key][tuple([*encode(t or ""), 0])] += 1
    by_sequence = defaultdict(list)
    found = defaultdict(Counter)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        found[p.doc_id][(p.start, p.length, p.ids_crc32, p.doc_tokens)] += 1
    for key, docs in left.items():
        spans = sorted(found[key].elements())
        assert sum(s[1] for s in spans) == sum(len(d) * n for d, n in docs.items())
        for start, length, crc, total in spans:
            assert any(len(d) == total and zlib.crc32(np.array(d[start:start + length], "<u4").tobytes()) == crc for d in docs)
        if sum(docs.values()) == 1:
            at = 0
            for start, length, _, _ in spans:
                assert start == at
                at += length
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_packing(sample, odd, empty):
    for frame in (sample, odd):
        pieces = packing.pack(clashing(frame, "task", "tail", "rank"), **tokenizer_files()).collect()
        assert check_pieces([(r.doc_id, r.text) for r in frame.collect()], pieces) < 1024
    assert packing.pack(empty, **tokenizer_files()).count() == 0


def test_rank_file_gives_the_same_ids(sample, odd):
    files = tokenizer_files()
    slow, fast = packing.encoder(files["tokenizer"]), packing.encoder(**files)
    texts = [r.text for r in sample.union(odd).collect() if r.text] + ["<|endoftext|> x", "  a\n\n b\t\t", "don't I'll 12³ ½", " 　 漢字 🤝🏽", "a\x1c b\x85 c"]
    assert all(slow(t) == fast(t) for t in texts)


def test_ids_are_those_of_the_untouched_tokenizer_file(spark, sample):
    """Literals of added tokens get their own id, in both encoders and in packed pieces."""
    from tokenizers import Tokenizer

    files = tokenizer_files()
    plain = Tokenizer.from_file(files["tokenizer"])
    literals = [t.content for t in plain.get_added_tokens_decoder().values()]
    texts = [f"a {x} b" for x in literals] + [f"{x}{x}\n {x}  c" for x in literals] + ["a <|endoftext|> b", "<|endoftext|", "<|endoftext|>", ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [64, 220, 50256, 275] in want
    for encode in (packing.encoder(files["tokenizer"]), packing.encoder(**files)):
        assert [encode(t) for t in texts] == want
        assert all(encode(r.text) == plain.encode(r.text, add_special_tokens=False).ids for r in sample.collect())
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **files).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(w) + 1 for i, w in enumerate(want)}


def test_plan_is_exact():
    rng = np.random.default_rng(4)
    for histogram in (rng.integers(0, 40, 128), np.where(np.arange(128) == 90, 5000, 0), np.zeros(128, int), np.where(np.arange(128) % 2 == 0, 3, 0)):
        histogram = histogram.astype(np.int64)
        histogram[0] = 7
        plan, used = packing.Plan(histogram, 128), Counter()
        for length in range(1, 128):
            for rank in range(histogram[length]):
                at = 0
                for a, b, sequence, offset in plan.places(length, rank):
                    assert a == at
                    at = b
                    for slot in range(offset, offset + b - a):
                        used[(sequence, slot)] += 1
                assert at == length
        assert not used or max(used.values()) == 1
        total = int((histogram * np.arange(128)).sum())
        assert len({s for s, _ in used}) == -(-total // 128)


def test_least_squares_fit():
    histogram = np.zeros(64, np.int64)
    histogram[[20, 44, 10, 27]] = [30, 10, 20, 20]
    combos = packing.patterns(histogram, 64)
    x = packing.solve(combos, histogram)
    use = np.zeros(64)
    for c, n in zip(combos, x, strict=True):
        for length in c[c > 0]:
            use[length] += n
    assert set(map(tuple, combos)) == {(20, 44, 0), (10, 10, 44), (10, 27, 27)} and (x >= 0).all()
    # No better than the best grid point around it.
    assert ((use - histogram) ** 2).sum() < ((np.zeros(64) - histogram) ** 2).sum()


def test_pipeline(spark, sample):
    docs = sample.filter("doc_id % 2 = 0 or doc_id < 60")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns and docs.count() > 0, name
        if name != "mixture":
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    encode = packing.encoder(tokenizer_files()["tokenizer"])
    assert sum(p.length for p in pieces) == sum(len(encode(r.text or "")) + 1 for r in docs.collect())


def test_pipeline_stages_take_odd_tables(spark, odd, empty):
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, clashing(frame, "row", "k", "text_key", "extra"), FOLDER).count()


def test_registered():
    found = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in found] == list(range(1, 11)) and "pipeline" in entry.queries()
    assert corpus_pipeline.STAGES[0][0] == "language"
