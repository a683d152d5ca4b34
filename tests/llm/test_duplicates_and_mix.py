"""Near duplicates, repeated passages, mixing and the pipeline against brute force."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("agendum.llm")

from agendum.llm import common, mixing, ngramjoin, substring
from tests.llm import brute

LOWER = {c: c + 32 for c in range(65, 91)}


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(n)]


def family_texts():
    """Groups of copies and near copies, chains, short, empty and long texts."""
    rng, out = random.Random(7), [None, "", "  \n", "one", "one", "ONE!", "a b c d", "a b c d", "a b c d e", "x " * 3000, "x " * 2999]
    for g in range(6):
        base = words(80, g)
        for n in range(12):
            w = list(base)
            for _ in range(n % 5):
                w[rng.randrange(80)] = "changed"
            out.append(" ".join(w))
    base = words(60, 99)
    for n in range(10):  # a chain: neighbours are close, the ends are not
        out.append(" ".join(base[n * 2 :] + words(n * 2, 1000 + n)))
    return out + [" ".join(words(50, 500 + n)) for n in range(20)] + ["Q " * 6] * 5


def frame(spark, texts):
    return spark.createDataFrame([(n, t, "s", n) for n, t in enumerate(texts)], "doc_id long, text string, n_removed string, class long")


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [1024, 8])
def test_similar_documents_are_all_found(spark, block):
    texts = family_texts()
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = ngramjoin.similar_documents(frame(spark, texts), block=block).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {n: (find(n), links[n]) for n in range(len(texts))}
    kept = ngramjoin.keep_one(frame(spark, texts), block=block)
    assert kept.columns == ["doc_id", "text", "n_removed", "class"]
    empty = {n for n, s in enumerate(sets) if not s}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(n) for n in range(len(texts))} | empty)


def test_repeated_rows_and_null_ids_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, "z z z z z z z"), (None, None), (None, None)], "doc_id long, text string")
    assert Counter(r.n_links for r in ngramjoin.similar_documents(df).collect()) == Counter({2: 3, 0: 3})
    assert sorted(str(r.text) for r in ngramjoin.keep_one(df).collect()) == ["None", "None", "a b c d e f", "z z z z z z z"]
    assert ngramjoin.similar_documents(df.limit(0)).count() == 0


def test_pruning_keeps_pairs_that_may_reach_the_threshold():
    least = ngramjoin.least_agreements(192, 0.8, 1e-6)
    assert all(a <= b <= a + 1 for a, b in zip(least, least[1:]))
    for n in (16, 64, 192):  # the posterior just below the bound is under the tolerance
        from math import comb

        tail = lambda m: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(least[n]) >= 1e-6 > (tail(least[n] - 1) if least[n] else 0)


def brute_repeats(texts, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("width", "period"), [(35, 21), (35, 13), (12, 7), (40, 31)])
def test_repeats_at_any_alignment(spark, width, period):
    rng = random.Random(width)
    passage, texts = words(width + 3, 1), [None, "", "a", "loop " * 200, "same text here " * 20, "same text here " * 20]
    for n in range(60):  # the passage at every offset, whole, cut short by one word, and with a changed word
        part = passage[: width + rng.randint(-1, 3)]
        if n % 7 == 0:
            part = part[:5] + ["other"] + part[6:]
        texts.append(" ".join(words(n, 100 + n) + part + words(rng.randint(0, 9), 300 + n)))
    texts += [" ".join(words(90, 900 + n)) for n in range(10)]
    df = frame(spark, texts)
    got = substring.remove_repeats(df, width=width, period=period)
    assert got.columns == ["doc_id", "text", "class", "n_words", "n_removed"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == dict(enumerate(brute_repeats(texts, width)))
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_covers_hold_every_difference():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("options", [{}, {"budget": 3000}, {"target_entropy": 0.9}, {"budget": 3000, "target_entropy": 0.9}, {"budget": 3000, "target_entropy": 0.9, "repetition_limit": 5}, {"target_entropy": 0.9, "repetition_limit": 2}, {"budget": 10**6, "repetition_limit": 2}])
def test_plan_is_that_of_brute_force(spark, options):
    for tokens in ({"a": 1000, "b": 100, "c": 10, "none": 0}, {f"s{n}": 1 + n * n for n in range(300)}) if options else ({}, {"x": 0}, {"x": 7}):
        got = mixing.find_plan(spark.createDataFrame(list(tokens.items()), "mix_source string, tokens long"), **options)
        alpha, budgets = brute.plan(tokens, options.get("budget"), options.get("target_entropy"), options.get("repetition_limit"))
        assert abs(got.alpha - alpha) < 1e-9
        for s, w in brute.weights(tokens, alpha).items():
            share = tokens[s] / sum(tokens.values())
            assert abs(share**got.alpha / got.powers - w) < 1e-9 and abs(got.tokens * w - budgets[s]) < 1.001


@pytest.mark.parametrize(("budget", "most_sent"), [(None, 10_000), (700, 10_000), (12_000, 10_000), (12_000, 2), (None, 2)])
def test_mix_spends_its_budgets(spark, budget, most_sent):
    rng = random.Random(3)
    rows = [(n if n % 9 else None, f"s{min(3, n % 10)}" if n % 11 else None, " ".join(words(rng.randint(0, 30), n)), n) for n in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, MIX_EPOCH int")
    got = mixing.mix(df, budget=budget, block_tokens=60, most_sent=most_sent).collect()
    tokens, of = Counter(), {}
    for _, s, t, _n in rows:
        tokens[s] += len(t.split())
    _, budgets = brute.plan(dict(tokens), budget, 0.9, 2.0)
    for r in got:
        of.setdefault((r.source, r.mix_epoch), []).append(r)
    # Every epoch's permutation stands whole in a mix that goes beyond it; the last one taken is the longest beginning that fits.
    beyond = {}
    for r in mixing.mix(df, budget=40_000, block_tokens=60).collect():
        beyond.setdefault((r.source, r.mix_epoch), []).append(r)
    place = lambda r: (r.mix_block, r.mix_place)
    for s, b in budgets.items():
        whole, rest = divmod(b, tokens[s])
        for e in range(whole + 1):
            order, want = sorted(beyond[s, e], key=place), []
            assert sum(len(r.text.split()) for r in order) == tokens[s]
            left = tokens[s] if e < whole else rest
            for p in sorted({place(r) for r in order}):
                same = [r for r in order if place(r) == p]
                left -= sum(len(r.text.split()) for r in same)
                if left < 0 or e == whole and not rest:
                    break
                want += [(r.doc_id, r.text) for r in same]
            assert Counter((r.doc_id, r.text) for r in of.get((s, e), [])) == Counter(want), (s, e)
    assert mixing.mix(df.limit(0)).count() == 0


def test_sources_without_words_are_taken_once(spark):
    rows = [(1, "a", "one two"), (2, "b", None), (3, "b", " "), (4, None, ""), (5, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(r.doc_id for r in mixing.mix(df).filter("mix_epoch = 0").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.doc_id for r in mixing.mix(df.filter("doc_id in (2, 3, 4)")).collect()) == [2, 3, 4]


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = [" ".join(words(120, n)) for n in range(60)]
    junk = [" ".join(w + "***" for w in words(60, 300 + n)) for n in range(25)]
    passage = " ".join(words(60, 777))
    texts = good + [good[0], good[1] + " more"] + junk + [f"{' '.join(words(50, 2000 + n))} {passage}" for n in range(3)]
    rows = [(n, t, "en", f"src{min(2, n % 9)}", len(t)) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "concat('k', doc_id) as kept", "doc_id as N_WORDS", "doc_id + 1 as mix_epoch")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(n, int(not 62 <= n < 87), 0) for n in range(len(texts)) if n % 4 != 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = df, []
    for _, stage in pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        seen.append(docs)
    kept = {r.doc_id for r in seen[0].collect()}
    assert kept == set(range(62)) | {87, 88, 89}
    assert {r.doc_id for r in seen[1].collect()} == set(range(60)) | {87, 88, 89}
    cut = {r.doc_id: r for r in seen[2].collect()}
    assert all(passage not in cut[n].text and cut[n].n_chars == len(cut[n].text) for n in (87, 88, 89)) and cut[5].text == good[5]
    assert all(d.columns == df.columns for d in seen[:4])
    assert all((r.kept, r.N_WORDS, r.mix_epoch) == (f"k{r.doc_id}", r.doc_id, r.doc_id + 1) for d in seen[:4] for r in d.collect())
    assert {r.doc_id for r in seen[3].collect()} == set(cut)
    bins = Counter()
    for r in seen[4].collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096 and seen[4].count() == seen[3].count()
    assert Counter(map(tuple, pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "ids_crc32").collect())) == Counter(map(tuple, seen[4].select("doc_id", "length", "ids_crc32").collect()))


def test_fresh_names_do_not_clash(spark):
    assert common.fresh(spark.createDataFrame([(1,)], "Text_Key int"), "text_key") == "text_key_"
