"""Words and pieces that weak hashes confuse, texts cut in parts, and long chains of near copies, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("agendum.llm")

from agendum.llm import common, ngramjoin, substring, tokens, wordhash
from agendum.llm.components import components


def thue_morse(n, a="a", b="b"):
    """A pattern for which every polynomial hash modulo a power of two meets that of its complement."""
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


SIZES = (16, 64, 128, 1024, 2048, 8192)
PATTERNS = [w for n in SIZES for w in (thue_morse(n), thue_morse(n, "b", "a"))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_patterns_and_parts(name, monkeypatch):
    made = tokens.Pieces(tokens.vocabulary(name))
    library = lambda t: made.tokenizer.encode(t, add_special_tokens=False).ids
    for texts in (PATTERNS, [" ".join(PATTERNS)], PATTERNS[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in made.ids(texts)] == [library(t) for t in texts]
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta9", "it's", "<x>", "Élan", " two", "\n", "a b"]) for _ in range(3000))
    whole = tokens.parts
    monkeypatch.setattr(tokens, "parts", lambda t: whole(t, 400))
    assert len(list(tokens.parts(long))) > 10 and "".join(tokens.parts(long)) == long
    assert np.frombuffer(made.ids([None, long, ""])[1], "<u4").tolist() == library(long)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_one_hash_are_told_apart(name, monkeypatch):
    real = wordhash.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda d, s, e: np.where(e - s < 8, real(d, s, e), np.uint64(1)))
    made = tokens.Pieces(tokens.vocabulary(name))
    texts = ["alphabetical numbers considerable", "considerable numbers", "alphabetical x", "short"]
    for _ in range(2):  # met in one batch, then with those kept
        assert [np.frombuffer(x, "<u4").tolist() for x in made.ids(texts)] == [made.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_hashes_of_words_and_runs_differ():
    rng = random.Random(1)
    made = {"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 90))) for _ in range(4000)} | set(PATTERNS)
    w = wordhash.Words([" ".join(sorted(made))])
    assert len(set(w.hash.tolist())) == len(w.hash) == len(made)
    for n in (2, 3, 8, 15, 32, 35):
        two = wordhash.Words([" ".join(thue_morse(n)), " ".join(thue_morse(n, "b", "a")), " ".join("ab" * n)[: 2 * n - 1]])
        assert len({int(x) for x in two.runs(two.first[:-1], n)}) == len({tuple(x) for x in (thue_morse(n), thue_morse(n, "b", "a"), ("ab" * n)[:n])})


def test_repeats_and_links_of_patterns(spark):
    rng = random.Random(4)
    filler = ["".join(rng.choice("cdefg") for _ in range(5)) for _ in range(60)]
    texts = []
    for n, word in enumerate(PATTERNS):  # windows that differ in one word stand once; runs of patterned words too
        texts.append(" ".join([*filler[:17], word, *filler[17:34]]) + f" end{n // 2}")
    texts += [" ".join(thue_morse(64)), " ".join(thue_morse(64, "b", "a"))]
    split = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in substring.remove_repeats(df).collect():
        w = split[r.doc_id]
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
    short = [f"{a} x y z q" for a in PATTERNS]  # one shingle each, no two alike
    found = ngramjoin.similar_documents(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")).collect()
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in found)


def shingles(text):
    w = re.findall(r"[a-z0-9]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("block", [1024, 6])
def test_a_long_chain_is_compared_by_buckets(spark, block):
    """Each text shares most of its words with the next ones only; beside it stand a large group and a bucket of both."""
    rng = random.Random(9)
    stream = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2400)]
    texts = [" ".join(stream[n * 8 : n * 8 + 100]) for n in range(280)]
    base = stream[:100]
    for n in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(100)] = f"z{rng.randint(0, 40)}"
        texts.append(" ".join(w))
    sets, links, root = [shingles(t) for t in texts], Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.similar_documents(df, block=block).collect()}
    assert got == {n: (find(n), links[n]) for n in range(len(texts))}
    # The rows of texts that are dealt out grow with the chain, not with its square.
    sketch = ngramjoin.Sketcher(5, 192)
    values = [(n, sketch.values(s).tobytes(), len(texts[n])) for n, s in enumerate(sketch.shingles(texts)) if n < 280]
    dealt = lambda some: ngramjoin.meetings(spark.createDataFrame(some, "no long, values binary, chars long"), len(some), 32, 6, block, 10**6).count()
    half, whole = dealt(values[:140]), dealt(values)
    assert whole <= 2.5 * half and (block < 1024 or whole <= 33 * len(values))


def test_components_with_a_hot_centre(spark):
    edges = [(0, n) for n in range(1, 3000)] + [(n, n + 1) for n in range(5000, 5060)] + [(7, 7), (None, 3), (9000, 9001), (9001, 9000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "hot").collect()}
    assert got == {**{n: 0 for n in range(3000)}, **{n: 5000 for n in range(5000, 5061)}, 9000: 9000, 9001: 9000}
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_hot_keys_are_joined_like_others(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    for most in (1, 10_000):
        got = common.join_hot(left, right, "k", 5000, most)
        assert got.count() == 5000 and got.filter("k = 1 and m <> 2999 or k > 1 and m <> id").isEmpty()


def test_scopes_delete_what_is_consumed(spark):
    from pathlib import Path

    with common.scope():
        a = common.stored(spark.range(3), "gone")
        with common.scope():
            b = common.keep(common.stored(a.selectExpr("id + 1 as id"), "kept"))
        assert sorted(r.id for r in b.collect()) == [1, 2, 3]
        folders = [Path(p.removeprefix("file://")) for p in common._scopes[-1]]
        assert all(p.is_dir() for p in folders) and len(folders) == 2
    assert not any(p.exists() for p in folders)
