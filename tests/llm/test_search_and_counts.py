"""Operators against brute force on small fixtures with nulls, ties, repeats, empty and long texts and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("agendum.llm")

from agendum.llm import binout, licenses, packing, quality, tokencount, topk, urls
from agendum.llm.tokens import Pieces, vocabulary

TEXTS = [
    None, "", " ", "A", "Hello, world! it's 3 o'clock", "don't they'll we've I'm you'd he's 'll", "É\u0301t\u00e9 na\u00efve \u0130stanbul \u03a3\u03c3\u03a3",
    "a\u00a0b \u00a0c\n\nd\t e  ", "x" * 5000, "the " * 3000, "<|endoftext|> in <|startoftext|>the text", "\u4e2d\u6587 \U0001f600!!!***", "1234567890 \u00b2\u00bd",
    "Licensed under the Apache License, Version 2.0.\nMIT License mit license", "same text", "same text",
]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(n if n % 5 else None, t, "x", 1) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, start int")
    return df if extra else df.select("doc_id", "text")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    made = Pieces(vocabulary(name), max_pieces=5)
    rng = np.random.default_rng(0)
    alphabet = list("ab'stSreL,.!<|>1²Éé \t\n\x85\x1c\xa0\u2003中ß×") + ["\u0301"]
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(0, 20))) for _ in range(3000)]
    for part in range(0, len(texts), 200):
        some = texts[part : part + 200]
        for t, ids in zip(some, made.ids(some)):
            assert np.frombuffer(ids, "<u4").tolist() == made.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(1)
    alphabet = list("ab'stSreLlvdm,.!<|>1²Éé \t\n\x85\x1c\xa0中ß×Σ") + ["\u0301"]
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(500)]
    rows = tokencount.token_counts(docs(spark, texts), vocabulary("word_bpe_49k.json")).collect()
    want = Counter((x or "", len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for x in texts)
    assert Counter((r.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert tokencount.token_counts(docs(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_state_maps_compose_for_any_chunk():
    to, out = tokencount.splitter()
    kinds = np.random.default_rng(2).integers(0, tokencount.CLASSES, 3000).astype(np.uint8)
    whole = tokencount.starts_of_words(kinds, to, out, chunk=4096)
    for chunk in (1, 2, 7, 64):
        assert (tokencount.starts_of_words(kinds, to, out, chunk) == whole).all()


def test_a_key_of_many_rows_spreads_over_files(spark, tmp_path):
    import json

    rows = [(7, "same text")] * 900 + [(7, f"text {n}") for n in range(900)] + [(n, "x") for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = binout.write_records(df, f"file://{tmp_path}/h", vocabulary("byte_bpe_50k.json"), end_id=0, files=8)
    files = json.loads((tmp_path / "h" / "manifest.json").read_text())["files"]
    ranged = binout.read_records(spark, path, range_bytes=500)  # several tasks read one file
    assert ranged.rdd.getNumPartitions() > 2 * len(files)
    assert Counter(map(tuple, ranged.collect())) == Counter(map(tuple, binout.read_records(spark, path).collect())) == Counter(map(tuple, binout.read_records(spark, path, seed=1, range_bytes=500).collect()))
    sized = binout.write_records(df, f"file://{tmp_path}/s", vocabulary("byte_bpe_50k.json"), end_id=0, file_bytes=1000)
    assert len(json.loads((tmp_path / "s" / "manifest.json").read_text())["files"]) >= 8
    assert Counter((r.start, r.ids) for r in binout.read_records(spark, sized).collect()) == Counter((r.start, r.ids) for r in binout.read_records(spark, path).collect())
    assert sum(f["records"] for f in files) == len(rows) and max(f["records"] for f in files) < 700
    keys = [r.key for r in sorted(binout.read_records(spark, path).collect(), key=lambda r: r.start)]
    assert keys == sorted(k for k, _ in rows)


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    path = binout.write_records(docs(spark), f"file://{tmp_path}/r", vocabulary("byte_bpe_50k.json"), end_id=0, files=3)
    rows = sorted(binout.read_records(spark, path).collect(), key=lambda r: r.start)
    want = sorted([((n if n % 5 else None), x or "") for n, x in enumerate(TEXTS)], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (key, x) in zip(rows, want, strict=True):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert (r.key, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (key, start, ids)
        start += len(ids)
    shuffled = binout.read_records(spark, path, seed=3).collect()
    assert Counter(map(tuple, shuffled)) == Counter(map(tuple, rows))
    damaged = next((tmp_path / "r").glob("*.bin"))
    data = bytearray(damaged.read_bytes())
    data[-1] ^= 1
    damaged.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        binout.read_records(spark, path).collect()
    assert binout.read_records(spark, binout.write_records(docs(spark, []), f"file://{tmp_path}/e", vocabulary("byte_bpe_50k.json"), 0)).count() == 0


def test_frame_widths_and_nulls():
    for key, ids in ((None, []), (-5, [1, 2]), (7, [70_000, 1])):
        k, raw = binout.unframe(memoryview(binout.frame(key, np.array(ids, np.uint32))))
        assert (k, np.frombuffer(raw, "<u4").tolist()) == (key, ids)


def test_packing_is_gapless_and_tight(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    packed = packing.pack_documents(docs(spark), vocabulary("word_bpe_49k.json"), end_id=1, capacity=64)
    rows = packed.pieces.join(packed.placement, "piece_uid").collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length <= 4 * 64
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in TEXTS)
    assert sum(r.length for r in rows) == total
    assert len(bins) <= -(-total // 64) + 1
    assert packing.pack_documents(docs(spark, []), vocabulary("word_bpe_49k.json"), 1).placement.count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    capacity, rng = 10, np.random.default_rng(4)
    lengths = rng.integers(1, 11, 200)
    where, offset, n = packing.sum_of_squares(lengths, capacity)
    level = {}
    for size, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        gaps = Counter(capacity - x for x in level.values() if x < capacity)
        score = lambda g: sum(v * v for v in g.values())
        choices = []
        for gap in {g for g in gaps if g >= size} | {capacity}:
            after = gaps.copy()
            if gap in gaps and gap != capacity:
                after[gap] -= 1
            if gap - size:
                after[gap - size] += 1
            choices.append(score(after))
        taken = gaps.copy()
        assert level.get(b, 0) == o
        if b in level:
            taken[capacity - o] -= 1
        level[b] = o + size
        if level[b] < capacity:
            taken[capacity - level[b]] += 1
        assert score(taken) == min(choices) and level[b] <= capacity
    assert n == len(level)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), [int(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    rows = vectors + [(1000, None), (None, [1, 1, 1, 1]), (1001, [5, 5]), (1002, [1, 2]), (7, [3, 3, 3, 3])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.top_k(df, df.filter("vec_id % 25 = 0 or vec_id > 999"), k=5, shard_rows=40, block_rows=4).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, v in rows:
        if q is None or v is None or (q % 25 and q < 1000):
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if w is not None and i is not None and i != q and len(w) == len(v))[:5]
        assert sorted(found.get(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_scaled_vectors(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(topk.scaled(F.col("v"))).collect()]
    assert got == [[128, -1], None, None, None, None, []]


RULES = [urls.UrlRule("allow", "org"), urls.UrlRule("block", "example.org", "/es/"), urls.UrlRule("block", "example.org", "/en/1"), urls.UrlRule("allow", "com", "/fr/"), urls.UrlRule("block", "com", "/de/"), urls.UrlRule("block", "a.com", ""), urls.UrlRule("allow", "a.com", "/x/y")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_urls_against_all_rules(spark, most):
    tried = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "http://xexample.org/es/", "https://m.example.org/en/123?q#f", "http://org", "http://b.com/de/", "http://b.com?de/", "http://a.com", "http://z.a.com/x/yz", "http://a.com/x", "a://b://c.org/", "http://b.com/de/", "http://e.org:80/"]
    df = spark.createDataFrame([(n, u, "old") for n, u in enumerate(tried)], "page_id long, url string, RULE string")
    rows = urls.judge_urls(df, RULES, max_bytes=most).collect()
    assert len(rows) == len(tried)
    for r in rows:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(str(x)), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and str(best), best.verdict if best else "allow")


def test_licenses(spark):
    texts = [*TEXTS, "x " * 30 + "this work is licensed under the GNU General Public License, version 3. " + "y " * 40, "GNU GENERAL PUBLIC LICENSE", "released by the mit of the license under"]
    rows = licenses.scan(docs(spark, texts)).collect()
    by = {r.text: r for r in rows}
    assert by["GNU GENERAL PUBLIC LICENSE"].labels == "gpl" and by["GNU GENERAL PUBLIC LICENSE"].score == 1.0
    assert by[texts[-3]].labels == "gpl,gpl-3.0" and by[texts[-3]].first_word == 36 == by[texts[-3]].last_word
    lic = by[TEXTS[13]]
    assert (lic.n_base, lic.first_word, lic.last_word, lic.base_labels, lic.labels) == (3, 3, 10, "apache,mit", "apache,apache-2.0,mit")
    assert (by[None].n_words, by[None].first_word, by[None].labels, by[None].score) == (0, None, "", 0.0)
    # The filters lose no block: brute force over all blocks and templates.
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        want = set()
        for a in range(0, len(words), 24):
            block = set(words[a : a + 48])
            for t, label in licenses.TEMPLATES.items():
                if len(block & set(t.split())) >= 0.9 * len(set(t.split())) - 1e-9:
                    want.add((a, label))
        assert {(s.start, s.label) for s in r.spans} == want


def test_long_templates_are_looked_for_whole(spark):
    long = " ".join(f"w{n}" for n in range(200))
    both = {long: "own", "released under the mit license": "mit"}
    assert {size: list(t.values()) for size, t in licenses.by_block(both, 48).items()} == {48: ["mit"], 768: ["own"]}
    rows = licenses.scan(docs(spark, [long, "x " * 90 + long.upper() + " y" * 40, " ".join(long.split()[:60]), " ".join(long.split()[:185])], extra=False), both).collect()
    assert sorted((len(r.text.split()), r.labels, r.score) for r in rows) == [(60, "", 0.0), (185, "own", 0.925), (200, "own", 1.0), (330, "own", 1.0)]


def test_every_character_is_counted_as_by_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    counter, library, every = tokencount.Counter(path), Tokenizer.from_file(path), tokencount.every_character()
    texts = ["".join(f"a{c}b A{c}'{c} " for c in every[i : i + 400]) for i in range(0, len(every), 400)]
    assert counter.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_quality_counts_and_list(spark):
    texts = [*TEXTS, "a b c d e f g h " * 3, "one two three\none two three\n\n  \nfour # * |"]
    rows = quality.text_counts(docs(spark, texts)).collect()
    for r in rows:
        x = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        c = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        gone = set()
        for i in range(len(words) - 7):
            if c[tuple(words[i : i + 8])] > 1:
                gone |= set(range(i, i + 8))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(x.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone))


def test_quality_list_is_learned_from_labels(spark):
    good = [" ".join(f"word{i * 31 % 97}x{n}" for i in range(40)) for n in range(150)]
    bad = [" ".join(f"w{i}*** {n}" for i in range(40)) for n in range(60)]
    df = spark.createDataFrame([(n, t, True) for n, t in enumerate(good + bad)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(n, int(n < 150), 0) for n in range(0, 210, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(df, labels, least_bad=5).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id) if not r.kept] == list(range(150, 210))
    none = quality.judge(df, labels.limit(0)).collect()
    assert all(r.kept and r.rule == 0 for r in none)
