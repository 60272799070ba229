"""Quality, language, extraction, toxicity: brute force, held-out accuracy, odd input."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from brookhouse.llm import extract, gru, labeller, langid, quality, toxicity
from brookhouse.llm.blocks import blocks
from compare import differences
from helpers import FOLDER, clashing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_mixing", "op11_conversation_prefix_trie", "op13_merkle_manifest"])
def test_matches_sql(spark, name):
    assert differences(spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_quality_counts(odd):
    rows = quality.clean(clashing(odd, "row", "t", "w", "kept", "quality")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = WORD.findall(r.text or "")
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        n = Counter(grams)
        repeated = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
        assert q.n_dup_lines == len(lines) - len(set(lines))
        assert q.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert q.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert r.kept == 1


def test_quality_lines(spark):
    good = "A plain sentence with enough words to stand on its own feet here."
    bad = ["Home | About | Contact | Help", "Home About Contact", "*** *** ###", "buy!! now!! win!!", "Click here to subscribe to our newsletter today"]
    own = [" ".join(f"{w}{i}" for w in good.split()) + "." for i in range(10)]
    rows = [(1, "\n".join(own + bad)), (2, "\n".join(f"w{i} | b{i} | c{i} | d{i}" for i in range(40))), (3, "\n".join(own))]
    out = {r.doc_id: r.quality for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_bad_lines == 5 and out[1].kept and out[1].clean_text == out[3].clean_text
    assert not out[2].base_failed and not out[2].kept
    assert out[3].kept and out[3].n_bad_lines == 0


def test_quality_and_others_empty(spark, empty):
    assert quality.clean(empty).count() == 0
    model = langid.train(empty)
    assert langid.identify(empty, model).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract(pages, extract.train(pages)).count() == 0


def code_length(samples, text):
    """The definition, byte by byte with dictionaries."""
    counts = {}
    for sample in samples:
        d = langid.START + sample
        for i in range(3, len(d)):
            for o in range(4):
                counts.setdefault(d[i - o:i], Counter())[d[i]] += 1
    d, total = langid.START + text, 0.0
    for i in range(3, len(d)):
        out = set()
        for o in (3, 2, 1, 0):
            seen = {k: v for k, v in counts.get(d[i - o:i], {}).items() if k not in out}
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if d[i] in seen:
                total -= math.log2(seen[d[i]] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds))
            out |= set(seen)
        else:
            total += math.log2(max(1, 256 - len(out)))
    return total


def test_code_lengths(sample, monkeypatch):
    texts = [r.text.encode() for r in sample.orderBy("doc_id").limit(14).collect()]
    samples = {"a": [t[:300] for t in texts[:3]], "b": [t[:200] for t in texts[3:6]]}
    tables = langid.Tables(langid.Model(samples))
    tried = [t[:150] for t in texts[6:]] + [b"", b"a", bytes(range(255)), "Ωмир".encode()]
    expected = np.array([[code_length(samples[x], t) for x in tables.languages] for t in tried])
    assert np.abs(langid.score(tables, tried) - expected).max() < 1e-3
    # Slices of long texts and groups of short ones give the same sums.
    monkeypatch.setattr(langid, "SLICE", 64)
    assert np.abs(langid.score(tables, tried) - expected).max() < 1e-3


def test_language_held_out(spark):
    out = entry.queries()["op2_language_id"](spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_sample_is_the_smallest_hashes(spark, monkeypatch):
    """With a bound on the ranked hashes the sample is that of ranking all, copies counted once."""
    monkeypatch.setattr(langid, "MOST", 200)
    rows = [(f"{lang} {i % n} text", lang) for lang, n, copies in (("en", 3000, 2), ("de", 150, 3)) for i in range(n * copies)]
    frame = spark.createDataFrame(rows, "text string, lang string").withColumn("h", F.xxhash64("text"))
    taken = []
    monkeypatch.setattr(langid, "Model", lambda samples: taken.append(samples))
    langid.train(frame)
    want = {}
    for r in frame.distinct().orderBy("h").collect():
        want.setdefault(r.lang, []).append(r.text.encode())
    assert taken == [{"en": want["en"][:200], "de": want["de"]}]


def test_language_odd(odd):
    model = langid.train(odd, sample_chars=500)
    rows = langid.identify(clashing(odd, "row", "letters", "language"), model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        known = any(c.isalpha() for c in r.text or "")
        assert (r.language.lang != "und") == known and r.letters == 1
        assert known or r.language.score == 0
    assert {r.language.lang for r in langid.identify(odd, langid.train(odd.limit(0))).collect()} == {"und"}


def test_blocks():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><div class="top menu"><a href="/x">Home</a></div>
    <article><h1>A &amp; B</h1><p>One<br>two <b>bold</b>.<p>Three &lt;3 &am<script>var t="</p>";</script></article><!-- note --><footer>&copy; x"""
    found = [(b.path[-1] if b.path else "", b.text, b.linked) for b in blocks(page)]
    assert found == [
        ("title", "T", 0), ("div top menu", "Home", 4), ("h1", "A & B", 0), ("p", "One", 0), ("p", "two bold.", 0), ("p", "Three <3 &am", 0), ("footer", "© x", 0)]
    assert blocks("") == [] and blocks("  \n ") == [] and blocks("plain")[0].text == "plain"


def test_extraction_against_marked_articles(spark):
    out = entry.queries()["op4_html_extraction"](spark, SMALL).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(out) == len(html)
    right = 0
    for r in out:
        cut = blocks(html[r.page_id])
        marks = extract.weak_labels(cut)
        right += r.text == " ".join(b.text for b, m in zip(cut, marks, strict=True) if m)
        assert r.n_chars == len(r.text)
    assert right >= 0.99 * len(out)


def test_extraction_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no tags"), (4, "<<p>>"), (5, "<div>" * 3000 + "deep"), (5, "<div>" * 3000 + "deep")], "page_id long, html string")
    assert extract.extract(clashing(pages, "row", "main_text"), extract.train(pages)).count() == 6


def numeric_check(network, names, loss):
    for name in names:
        w = network.w[name]
        place = tuple(np.array(w.shape) // 2)
        kept = w[place]
        w[place] = kept + 1e-4
        up = loss()[0]
        w[place] = kept - 1e-4
        down = loss()[0]
        w[place] = kept
        assert loss()[1][name][place] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=2e-5)


def test_gradients():
    rng = np.random.default_rng(0)
    network = gru.Network([5, 5, 5], 4, 3)
    network.w = {k: v.astype(float) for k, v in network.w.items()}
    mask = np.ones((6, 4), bool)
    mask[4:, 1] = mask[2:, 3] = False
    ids, y = rng.integers(0, 5, (3, 6, 4)), np.array([1, 0, 1, 0.0])
    numeric_check(network, network.w, lambda: network.gradients(ids, mask, y))
    lstm = labeller.Labeller(4)
    lstm.w = {k: v.astype(float) for k, v in lstm.w.items()}
    x = rng.normal(size=(6, 4, labeller.WIDTH))
    marks = rng.integers(0, 2, (6, 4)).astype(float)
    numeric_check(lstm, lstm.w, lambda: lstm.gradients(x, mask, marks))


def test_words_and_windows(monkeypatch):
    texts = [b"One two-THREE, four", b"", "über one".encode(), b"x " * 100]
    got = [h for _, n, hashes in toxicity.streams(texts) for h in np.split(hashes[0], np.cumsum(n)[:-1])]
    assert [len(h) for h in got] == [4, 0, 2, 100] and got[0][0] == got[2][1]
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    again = [h for _, n, hashes in toxicity.streams(texts) for h in np.split(hashes[0], np.cumsum(n)[:-1])]
    assert all((a == b).all() for a, b in zip(got, again, strict=True))
    made = gru.windows(np.array([0, 5, 100]), np.arange(105)[None, :], 48, 36)
    assert made.owner.tolist() == [1, 2, 2, 2] and set(made.ids[0][made.mask].tolist()) == set(range(105))


def test_toxicity_finds_words(spark):
    rng = np.random.default_rng(3)
    plain = ["river", "hill", "mill", "old", "runs", "sea", "past", "beyond", "light", "stone", "bird", "green"]
    rows = []
    for i in range(400):
        text = list(rng.choice(plain, rng.integers(5, 300)))
        if i % 4 == 0:
            text[rng.integers(len(text))] = ["vile", "rotten", "horrid"][i % 3]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.train(frame.filter("doc_id < 300"), frame.select("doc_id", "toxic"))
    held = toxicity.score(clashing(frame, "row", "toxicity"), scorer).filter("doc_id >= 300").collect()
    assert np.mean([(r.toxicity >= 0.3) == (r.toxic == 1) for r in held]) > 0.97


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, None), (None, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.toxicity <= 1 for r in rows)
    assert all(r.toxicity == 0 for r in rows if not (r.text or "").strip())


def test_quotes_outside_of_values_lose_no_text():
    def texts(page):
        return [b.text for b in blocks(page)]

    assert texts("<p title=it's>First part.</p><p>Second don't stop.</p><p>Third.</p>") == ["First part.", "Second don't stop.", "Third."]
    assert texts("<p title=it's>two") == ["two"]
    assert texts("""<p a="x>y" b='q>r' c>in</p>out<br/>x""") == ["in", "out", "x"]
    assert texts("""<div =x ' " y=>t</div>""") == ["t"]
    assert texts("""<a href=x"y>z">k</a>""") == ["""z">k"""]
    assert texts("""<p a = "b" c="d"e>one</p ">two""") == ["one", "two"]
    assert texts("a < b and <3 > 2 <b>x</b> don't") == ["a < b and <3 > 2 x don't"]
    assert texts("<p " + "a='" * 50_000) == []


def test_toxicity_learns_from_whole_texts(spark):
    """Held-out figures on the sample; a text beyond the bound teaches nothing."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = entry.queries()["op9_toxicity"](spark, SMALL).collect()
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    found = sum(p for y, p in held if y)
    false = sum(p for y, p in held if not y)
    assert found >= 0.6 * sum(y for y, _ in held) and false <= 0.05 * len(held)
    long = spark.createDataFrame([(1, "fine words " * 3000 + "vile", 1), (2, "fine words", 0)], "doc_id long, text string, toxic int")
    assert toxicity.train(long, long.select("doc_id", "toxic")).prior == 0.0
