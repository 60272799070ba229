"""Prefix trie, byte-level BPE and Merkle manifest against plain versions and public libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import FOLDER, clashing
from pyspark.sql import functions as F

from brookhouse.llm import bpe, merkle, order, parens, prefix_trie, queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, depth int"


# Ordering


@pytest.mark.parametrize("n", [0, 1, 500])
def test_in_order(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice("aaaaab"), rng.randrange(50), rng.randrange(-9, 9), rng.randrange(2**60)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "g string, k bigint, v bigint, x bigint").repartition(3)
    got = order.in_order(frame, "g", [F.col("k"), F.col("v"), F.col("x")], "t", add=("v",), xor=("x",)).collect()
    expected = []
    for g in "ab":
        total = mixed = 0
        for pos, (_, k, v, x) in enumerate(sorted(r for r in rows if r[0] == g)):
            total, mixed = total + v, mixed ^ x
            expected.append((g, k, v, x, pos, total, mixed))
    assert sorted(map(tuple, got)) == sorted(expected)


# Balanced parentheses


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 3000])
@pytest.mark.parametrize("reach", [1, 3, 10**6])
def test_find_close(n, reach):
    rng = np.random.default_rng(n)
    parent = np.array([-1 if i % 50 == 0 else rng.integers(max(0, i - reach), i) for i in range(n)], np.int64)
    trie, nodes = parens.encode(parent)
    stack, close = [], {}
    for i, bit in enumerate(trie.bits):
        if bit:
            stack.append(i)
        else:
            close[stack.pop()] = i
    opens = trie.opens()
    assert sorted(nodes.tolist()) == list(range(n))
    assert trie.find_close(opens).tolist() == [close[i] for i in opens]
    leaves = set(range(n)) - set(parent.tolist())
    assert trie.leaves[-1] == len(leaves)


# Prefix trie


def trie_truth(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, role.encode(), text.encode(), role, text))
    turns = {c: [x[4:] for x in sorted(found, key=lambda x: x[:4])] for c, found in turns.items()}
    whole = {}
    for c, own in turns.items():
        head = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:head] + own[head:])
    members, children = {}, {}
    for c, path in whole.items():
        for depth in range(len(path) + 1):
            members.setdefault(path[:depth], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        under = children.get(node, [])
        below[node] = sum(below[u][0] for u in under) if under else 1, saved + sum(below[u][1] for u in under)
    out = Counter()
    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if len(whole[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out[(min(found), len(node), parent, len(found), len(children.get(node, [])), *below[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def small_conversations():
    rng = random.Random(4)
    ids = [*range(-150, -90), *range(95, 230), None]
    odd = [
        (c, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "a"]), rng.choice([None, "", "x", "yé😀"]), 1)
        for c in ids for _ in range(rng.randrange(0, 5))]
    nested = [(c, t, "u", f"t{t}", 1) for c in range(1000, 1030) for t in range(c - 990)]
    return odd, [*nested, *[(5000, t, "u", f"t{t}", 1) for t in range(300)], *[(c, 1, "u", "same", 1) for c in range(6000, 6080)]]


@pytest.mark.parametrize("shard_convs", [20_000, 30, 3])
def test_prefix_trie(spark, shard_convs):
    odd, deep = small_conversations()
    for rows in (odd, deep + odd):
        frame = clashing(spark.createDataFrame(rows, CONVERSATIONS), "n_convs", "pos", "a")
        got = Counter(map(tuple, prefix_trie.prefix_trie(frame, shard_convs).collect()))
        assert got == trie_truth([r[:4] for r in rows])


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.prefix_trie(empty).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", 1)], CONVERSATIONS)).collect() == []


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    codes = bpe.codec(RANKS, PATTERN)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codes.ranks, special_tokens={})


def strings():
    rng = random.Random(1)
    pool = "ab  \n\t'sé1ü.漢字‍😀!\x85\xa0"
    mixed = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    letters = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 140))) for _ in range(3000)]
    # Matches beyond the side-by-side trees, ties included.
    long = ["x" * 5000, "ab" * 4000, " " * 3000 + "q", "é" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    points = ["a" + chr(p) + "b " + chr(p) + chr(p) + " 1" for p in range(0, 0x3000) if not 0xD800 <= p < 0xE000]
    return mixed + letters + long + points + ["", "<|endoftext|>"]


def test_ids_are_those_of_the_library(library, monkeypatch):
    for remembered in (bpe.REMEMBERED, 50):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        codes = bpe.Codec(RANKS, PATTERN)
        texts = strings()
        for at in range(0, len(texts), 1500):
            part = texts[at:at + 1500]
            ids, counts = codes.encode(part)
            ends = np.cumsum(counts)
            for text, end, n in zip(part, ends, counts, strict=True):
                found = ids[end - n:end].tolist()
                assert found == library.encode_ordinary(text)
                assert codes.decode(found) == text.encode()


def test_encode_and_decode_tables(sample, odd, empty, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 5000)
    for frame in (sample, odd, empty):
        coded = bpe.encode(clashing(frame, "tokens", "decoded", "odd name"), RANKS, PATTERN)
        out = bpe.decode(coded, RANKS, PATTERN)
        got = Counter((r.doc_id, r.text, tuple(r.tokens), bytes(r.decoded)) for r in out.collect())
        expected = Counter(
            (r.doc_id, r.text, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in frame.collect())
        assert got == expected
        assert out.columns == [*frame.columns, "odd name", "tokens", "decoded"]
    assert bpe.encode(odd, RANKS, PATTERN, keep=["doc_id"]).columns == ["doc_id", "tokens"]


def test_codec_query(spark, library):
    rows = {r.doc_id: r for r in queries.op12_bpe_codec(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_sha256) == (len(ids), digest)
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# Merkle manifest


def node(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([node(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, place):
    for level in tree[:-1]:
        other = place ^ 1
        yield (level[other] if other < len(level) else None), place & 1
        place >>= 1


def manifest_truth(rows):
    def leaf(row):
        return node("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for found in groups.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[name]]) for name in names]
    top = levels([tree[-1][0] for tree in trees])
    out = Counter()
    for turn, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for place, row in enumerate(groups[name]):
            witness = [*siblings(tree, place), *siblings(top, turn)]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            digest = leaf((*row[:3], row[3] + 1, row[4]) if hit else row)
            for other, left in witness:
                digest = node(digest) if other is None else node(other, digest) if left else node(digest, other)
            root = top[-1][0]
            out[(row[0], tree[0][place], tree[-1][0], root, node(*[s for s, _ in witness if s]), digest, digest == root)] += 1
    return out


@pytest.mark.parametrize("bits", [10, 2])
def test_manifest(spark, sample, odd, tmp_path, monkeypatch, bits):
    """Blocks of four leaves make several layers of trees that all end at different heights."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    single = odd.filter("doc_id = 1")
    for i, frame in enumerate((odd, single, sample)):
        clashing(frame, "root", "leaf", "pos").coalesce(1).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = Counter(map(tuple, queries.op13_merkle_manifest(spark, f"{tmp_path}/{i}").collect()))
        assert got == manifest_truth([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in frame.collect()])


def test_manifest_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert out.collect() == [] and len(out.columns) == 7


def test_forest_equals_levels():
    for n in (1, 2, 3, 5, 8, 13, 64, 100):
        digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        forest = merkle.Forest()
        for digest in digests:
            forest.append(digest)
        tree = levels([d.hex() for d in digests])
        assert forest.finish((n - 1).bit_length()).hex() == tree[-1][0]
        for place, witness in enumerate(forest.witnesses):
            assert [w and w.hex() for w in witness] == [s for s, _ in siblings(tree, place)]
