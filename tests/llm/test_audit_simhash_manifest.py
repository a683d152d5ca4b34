"""The filter audit, SimHash components and the Merkle manifest against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash

pytest.importorskip("agendum.llm")

from pyspark.sql import functions as F

from agendum.llm import filteraudit, merkle, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- filter audit


def failing(docs):
    """(part, letters that fail) of each row of (id, text, lang)."""
    out = []
    for i, text, lang in docs:
        t = text or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in docs)
        out.append((lang or "", {f for f, bad in fails.items() if bad}))
    return out


def walked(docs, labels):
    """Every order walked through, document by document."""
    rows, out = failing(docs), {}
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    shapley = Counter()
    for order in permutations("ABCDE"):
        for (i, *_), (part, fails) in zip(docs, rows, strict=True):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part, "".join(order), step), Counter())
                if f in fails:
                    c["redundant" if gone else "removed"] += 1
                    if not gone:
                        c["good_lost"] += i in good
                        c["toxic_lost"] += i in toxic
                        shapley[part, f] += 1
                    c["unique_fails"] += len(fails) == 1
                    gone = True
                c["kept"] += not gone
    return {(*k, *(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_every_order_of_filters_is_that_of_walking_it(spark):
    rng = random.Random(5)
    long = [" ".join(rng.choice(["ab", "Cd", "é", "EFGHIJ", f"w{n}"]) for n in range(rng.choice([30, 100, 150]))) for _ in range(25)]
    texts = [None, "", " \t\n", "short #", "A" * 50, *long, *long[:8], long[0], None, "日本 $"]
    texts += [" ".join(f"x{n}" for n in range(k)) for k in (99, 100, 101)] + ["ab " * 200 + " ".join(f"y{n}" for n in range(800))]
    docs = [(rng.randrange(60), t, rng.choice(["en", "fr", None, ""])) for t in texts] + [(None, long[3], "en"), (None, long[3], "en")]
    docs += [docs[9], docs[9]]  # rows that share the smallest id
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("N", F.lit(1)).repartition(3)
    found = filteraudit.audit(filteraudit.failing_rows(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), list("ABCDE"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) == 600 * len({x or "" for *_, x in docs})
    assert set(rows) == walked(docs, labels)


def test_parity_sums_come_back_as_cells(spark):
    rows = [("p", m & 1 > 0, False, bool(m & 1), bool(m & 2), bool(m & 4), m * m + 1) for m in range(8)]
    df = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, x boolean, y boolean, z boolean, n long")
    sums = filteraudit.parity_sums(df, ["x", "y", "z"])
    assert {len(r.w) for r in sums.collect()} == {8} and sums.count() == 2
    cells = filteraudit.mask_cells(sums, ["x", "y", "z"]).first()
    assert cells["all"] == [m * m + 1 for m in range(8)] and cells["good"] == [(m * m + 1) * (m & 1) for m in range(8)] and cells["toxic"] == [0] * 8
    assert filteraudit.audit(df, ["x"]).count() == 1
    with pytest.raises(ValueError, match="filters"):
        filteraudit.audit(df, list("xyzuvwt"))


# ---- SimHash


def brute_print(text, width=3):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, most=3):
    """For each place the places of its component, by comparing all."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_components_of_texts_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \t ", "one", "ONE", "one two", "a b c", "A  b\nc", "a b c a b c"]
    for _ in range(30):
        base = [word() for _ in range(rng.randint(3, 150))]
        texts += [" ".join(base)] + [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in rng.sample(range(len(base)), 2)]
    texts += [texts[20].upper(), "w " * 400_000 + "end", ("x" * 3_000_000) + " y z " + "q" * 2_000_000]
    docs = [(n * 7 % 1000 if n % 19 else None, t) for n, t in enumerate(texts)] + [(5, texts[12]), (5, texts[12])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).repartition(5)
    prints = [brute_print(t) for _, t in docs]
    least = {}
    for g, (d, _) in zip(grouped(prints), docs, strict=True):
        least[g] = d if least.get(g) is None else least[g] if d is None else min(d, least[g])
    want = Counter((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(docs, prints, grouped(prints), strict=True))
    assert Counter(map(tuple, simhash.similar_documents(df).collect())) == want
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_trees_lose_no_link(spark):
    rng = np.random.default_rng(3)
    points = list(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    for p in points[:300]:  # chains of copies a few bits apart, half of them out of reach
        for k in range(4):
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                p = p ^ np.uint64(1 << b)
            points.append(p)
    middle = np.uint64(0x0F0F0F0F12345678)
    points += [middle] + [middle ^ np.uint64(1 << a) for a in range(64)] + [middle ^ np.uint64(1 << a | 1 << b) for a in range(64) for b in range(a)]
    prints = sorted({int(p) for p in points})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard_rows=60).collect()
    at = {x: n for n, x in enumerate(signed)}
    assert edges and all((prints[at[e.a]] ^ prints[at[e.b]]).bit_count() for e in edges)
    found = simhash.Forest(len(prints))
    found.link(np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))
    want = simhash.Forest(len(prints))
    values = np.array(prints, np.uint64)
    for n, v in enumerate(values):
        near = np.flatnonzero(np.bitwise_count(values ^ v) <= 3)
        want.link(near, np.full(len(near), n))
    everything = np.arange(len(prints))
    assert (found.find(everything) == want.find(everything)).all()


def test_borders_send_few(spark):
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    metrics = [(0xFFFFFFFF, 1), (int(simhash.ALL), 3)]
    tree = simhash.fit_tree(points[::4], 64, metrics)
    dealt = list(simhash.route(tree, points))
    assert sum(len(h) for _, h, _ in dealt) == len(points) and len(dealt) == 64
    assert sum(len(v) for *_, v in dealt) < 4 * len(points)  # of 63 other shards each


# ---- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proofs(nodes, arity=8):
    """The root over the nodes, and for each node its sides by level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // arity * arity
            sides[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + arity])))
            at[i] = a // arity
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], sides


def brute_manifest(docs):
    leaf = lambda d, text: h(field(d[0]), field(d[1]), field(d[2]), field(d[3]), field(text))
    parts = {}
    for d in docs:
        parts.setdefault(d[2], []).append((d, leaf(d, d[4])))
    made = []
    for lang in sorted(parts, key=lambda x: (x is not None, (x or "").encode())):
        rows = sorted(parts[lang], key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
        made.append((rows, *proofs([x for _, x in rows])))
    root, above = proofs([sub for _, sub, _ in made])
    for (rows, sub, sides), upper in zip(made, above, strict=True):
        for (d, own), path in zip(rows, sides, strict=True):
            touched = d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            node = leaf(d, d[4].translate(LOWER)) if touched else own
            for left, right in path + upper:
                node = h(left, node, right)
            yield d[0], own, sub, root, h(*(x for side in path + upper for x in side)), node, node == root


@pytest.mark.parametrize("height", [1, 3])
def test_proofs_are_those_of_the_whole_tree(spark, height):
    rng, docs = random.Random(9), []
    for lang, n in [(None, 9), ("", 1), ("en", 700), ("ä", 64), ("fr", 65), ("zz", 8), *((f"l{k}", 2) for k in range(70))]:
        docs += [(rng.randrange(2000), rng.choice(["web", None, "ü"]), lang, rng.choice([None, 3]), rng.choice(["Text é", "low", None, "", "A" * 200])) for _ in range(n)]
    docs += [docs[40]] * 3 + [(None, "s", "en", 1, "NULL id"), (None, None, "en", None, None), (1, "long", "en", 9, "Ab " * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumn("Leaf", F.lit(1)).repartition(4)
    now = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}
    found = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], changed=now, height=height)
    rows = Counter(tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert rows == Counter(brute_manifest(docs))
    assert {r[-1] for r in rows} == {True, False}


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame([(1, "en", "x")], "doc_id long, lang string, text string")
    row = merkle.manifest(df, ["doc_id", "text"]).first()
    leaf = h("1:1", "1:x")
    assert (row.leaf, row.subroot, row.root, row.folded_root, row.verified) == (leaf, leaf, leaf, leaf, True) and row.proof_sha256 == h()
    assert merkle.manifest(df.limit(0), ["doc_id", "text"]).count() == 0


@pytest.mark.parametrize("arity,levels,n", [(2, 4, 16), (2, 4, 11), (8, 2, 64), (8, 2, 57), (8, 3, 300), (3, 3, 19), (8, 1, 1)])
def test_traversal_holds_two_runs_a_level(monkeypatch, arity, levels, n):
    leaves = [h(str(i)).encode() for i in range(n)]
    nodes = [leaves]
    for _ in range(levels):
        nodes.append([merkle.digest(nodes[-1][i : i + arity]) for i in range(0, len(nodes[-1]), arity)])
    assert merkle.block_root(leaves, levels, arity) == nodes[levels][0]
    made, most = [], 0
    real = merkle.Treehash.__init__
    monkeypatch.setattr(merkle.Treehash, "__init__", lambda self, *a: (real(self, *a), made.append(self))[0])
    for i, path in enumerate(merkle.traversal(leaves, levels, arity)):
        for level, (left, right) in enumerate(path):
            at = i // arity**level
            run = at // arity * arity
            assert left == b"".join(nodes[level][run:at]) and right == b"".join(nodes[level][at + 1 : run + arity])
        most = max(most, max(len(t.nodes) + sum(map(len, t.stack)) for t in made[-2 * levels :]))
    assert most <= arity * (levels + 1)
