"""The registered queries over a small folder of tables, against DuckDB where there is SQL and brute force where there is none."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("agendum.llm")

from agendum.llm import queries
from agendum.llm.tokens import vocabulary
from tests.llm import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, top = random.Random(11), tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(50))
    texts = [None, "", " \n ", "short", "Released under the MIT License.", "CC BY-NC 4.0 and the GNU General Public License", "<|endoftext|>", "a b c d e f g h " * 9]
    for n in range(70):
        texts.append(" ".join(word() for _ in range(rng.randint(5, 120))) + (f"\n{passage}" if n % 6 == 0 else ""))
    texts += [texts[20], texts[21], texts[22] + " tail", texts[23].upper(), "Licensed under the Apache License, Version 2.0. " * 3]
    texts += [" ".join(word() + "***" for _ in range(60)) for _ in range(30)] + ["word " * 9000]
    docs = [(n if n != 40 else None, t, "en", f"src{n % 4}" if n % 13 else None, len(t or "")) for n, t in enumerate(texts)]
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    save("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    save("labels", [(n, int(n < 82 or n > 112), 0) for n in range(len(texts)) if n % 3], "doc_id long, quality int, toxic int")
    vectors = [(n, [rng.uniform(-1, 1) for _ in range(6)] if n % 17 else None, 0) for n in range(160)] + [(160, [float("nan")] * 6, 0), (161, [None] * 6, 0), (100, [0.5] * 6, 0)]
    save("embeddings", vectors[:-1], "vec_id long, embedding array<float>, label int")
    urls = [None, "", "https://a.example.org/es/x", "https://example.org/en/12?q", "http://B.ORG#x", "http://b.com/de/", "http://b.com/fr/1", "nothing", "http://org/"]
    save("pages", [(n, u, "<p>") for n, u in enumerate(urls)], "page_id long, url string, html string")
    return str(top), docs


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_are_those_of_the_sql(spark, tables, name):
    import duckdb

    top, _ = tables
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        where = "WHERE doc_id IS NOT NULL" if t == "documents" and name in ("op8_ngram_jaccard", "op10_substring_dedup", "op3_license_scan") else ""
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{top}/{t}.parquet/*.parquet') {where}")
    want = c.sql(queries.ORACLE[name]).fetchall()
    columns = [d[0] for d in c.sql(queries.ORACLE[name]).description]
    got = queries.QUERIES[name](spark, top)
    if "doc_id" in got.columns:  # SQL joins by id, so the row without one is left out there
        got = got.filter("doc_id is not null")
        want = [r for r in want if r[columns.index("doc_id")] is not None]
    plain = lambda rows: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert sorted(got.columns) == sorted(columns)
    found = plain(got.select(columns).collect())
    if name in ("op8_ngram_jaccard", "op10_substring_dedup"):  # the row without an id is a text of its own and changes no other
        assert sum(found.values()) == len(want)
    assert found == plain(want)


def test_records_and_counts(spark, tables):
    from tokenizers import Tokenizer

    top, docs = tables
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    start, want = 0, set()
    for d, x, *_ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_records(spark, top).collect()} == want
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x, *_ in docs}
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, top).collect()}
    assert counts == {(d, len((x or "").encode()), len(ids[d]), len(ids[d]) > 2048) for d, x, *_ in docs}
    rows = queries.op7_best_fit_packing(spark, top).collect()
    bins = {}
    for r in rows:
        own = [*ids[r.doc_id], 1]
        assert r.start == 4096 * r.piece and own[r.start : r.start + 4096] == own[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids.values())
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) <= -(-sum(len(x) + 1 for x in ids.values()) // 4096) + 1


def test_quality_query(spark, tables):
    top, docs = tables
    rows = {r.doc_id: r for r in queries.op9_quality_rules(spark, top).collect()}
    for d, x, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        c = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {j for i in range(len(words) - 7) if c[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        r = rows[d]
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (len(words), len(repeated), failed)
        junk = (x or "").count("*") > 50
        assert r.kept == (not failed and not junk)


def test_mix_query(spark, tables):
    top, docs = tables
    tokens = Counter()
    for _, x, _, s, _ in docs:
        tokens[s] += len((x or "").split())
    (_, budgets), longest = brute.plan(dict(tokens), None, 0.9, 2.0), max(len((x or "").split()) for _, x, *_ in docs)
    spent, seen = Counter(), Counter()
    for r in queries.op2_temperature_mix(spark, top).collect():
        spent[r.source] += r.n_tokens
        seen[r.doc_id, r.mix_epoch] += 1
    assert all(b - longest < spent[s] <= b for s, b in budgets.items())
    assert set(seen.values()) == {1} and {d for d, e in seen if e == 0} == {d for d, *_ in docs}


def test_sha_of_nothing_left(spark, tables):
    top, docs = tables
    rows = {r.doc_id: r for r in queries.op10_substring_dedup(spark, top).collect()}
    whole = next(n for n, (_, x, *_) in enumerate(docs) if x == docs[20][1])
    assert whole == 20 and rows[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
