"""Language identification, importance resampling and ranked search against brute force or held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterspark.llm import importance, language, lexical, q_llm

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "lorem " * 40_000 + "ipsum"
TEXTS = ["The cat, the DOG and the bird", None, "", "   \n\t", "ÀÉ straße naïve 42 x9", "a" * 5000 + " b", LONG,
         "the cat the cat", "the cat the cat", "İstanbul\x00 ok \x7f end", "one two three four five six seven " * 5]


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def table(spark, rows, key="doc_id"):
    """A table with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, f"{key} long, text string")
    for c in ("term", "score", "rank", "weight", "bucket", "segment", "block", "_item", "lang_pred", "n", "h", "counts", "rate"):
        df = df.withColumn(c, F.lit("x"))
    return df


# ---------------------------------------------------------------- CRC and importance


def test_crc_of_spans_is_crc32():
    rng = np.random.default_rng(5)
    data = np.frombuffer(rng.bytes(400_000), np.uint8)
    start = rng.integers(0, 1000, 400)
    size = np.concatenate([np.arange(1, 201), rng.integers(1, 70, 190), rng.integers(5_000, 390_000, 10)])
    end = start + size
    assert importance.crc32_spans(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    n = np.array([0, 1, 63, 64, 65, 1 << 20])
    assert importance.length_constants(n).tolist() == [zlib.crc32(bytes(int(x))) for x in n]


@pytest.mark.parametrize("width", [1, 3])
def test_features_are_the_runs_of_words(width):
    at = 0
    for ids, begin, many in importance.text_features(pa.array(TEXTS), 10_000, width):
        for i in range(len(many)):
            w = words(TEXTS[at + i])
            want = [zlib.crc32(" ".join(w[j:j + k]).encode()) % 10_000 for k in range(1, width + 1) for j in range(len(w) - k + 1)]
            assert sorted(ids[begin[i]:begin[i + 1]].tolist()) == sorted(want) and many[i] == len(w)
        at += len(many)
    assert at == len(TEXTS)


def brute_resample(docs, target, percent, least):
    code = lambda t: [zlib.crc32(w.encode()) % 10_000 for w in words(t)]
    s, t = Counter(b for _, x in docs for b in code(x)), Counter(b for x in target for b in code(x))
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        ids = code(text)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ss + 10000.0) / ((s[b] + 1.0) * (tt + 10000.0)))) for b in ids]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(ids), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("percent", [0, 10, 50, 100])
def test_resampling_matches_brute_force(spark, percent):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdeé", k=3)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(80)]
    docs += [(None, "null key " * 12)]
    target = [None, "", "the cat and the dog", " ".join(vocab[:20])]
    got = importance.resample(table(spark, docs), table(spark, list(enumerate(target)), "item_id"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(docs, target, percent, 20)


def test_resampling_empty_tables_and_repeated_rows(spark):
    docs, none = table(spark, [(7, "a b c " * 10)] * 40 + [(8, "x y z " * 10)] * 40), table(spark, [], "item_id")
    rows = importance.resample(docs, none).collect()
    assert len(rows) == 80 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 9))
    assert importance.resample(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- ranked search


def brute_search(docs, items, k=10):
    tf = [(key, Counter(words(t))) for key, t in docs]
    tf = [(key, c, sum(c.values())) for key, c in tf if c]
    n_docs, n_terms = len(tf), sum(n for _, _, n in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in items:
        query, found = Counter(words(text)), []
        for key, c, n in tf:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                        for w, times in query.items() if c[w])
            if score > 0:
                found.append((-score, key is not None, key or 0, key))
        out += [(item, r + 1, key, -s) for r, (s, _, _, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    weight = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(rng.choices(vocab, weight, k=rng.randint(0, 60)))) for i in range(n)]
    items = [(j, " ".join(rng.choices(vocab, weight, k=rng.randint(1, 12)))) for j in range(30)]
    return docs, items


@pytest.mark.parametrize("bands", [(0.02, 0.2), (0.5,), (), (0.01, 0.05, 0.1, 0.4)])
def test_search_matches_brute_force(spark, monkeypatch, bands):
    docs, items = corpus(1)
    docs += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "w1 w2 w150"), (5, "w199 w3")]
    items += [(50, None), (51, ""), (52, "nowhere found"), (None, "w150 W199"), (3, "w1 w1 w1 cat"), (3, "straße")]
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 64)
    monkeypatch.setattr(lexical, "COPY_SEGMENTS", 2)
    got = lexical.search(table(spark, docs), table(spark, items, "item_id"), 10, bands, block_items=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items)


def test_search_is_exact_when_hashes_collide(spark):
    docs, items = corpus(2, 120)
    got = lexical.search(table(spark, docs), table(spark, items, "item_id"), 5, mask=0xE0 << 56)  # 8 hash values in all
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, 5)


def test_search_ties_repeated_rows_and_empty_tables(spark):
    docs = [(9, "same words here")] * 4 + [(i, "same words here") for i in range(20, 5, -1)] + [(100 + i, "other") for i in range(50)]
    items = [(1, "same words"), (1, "same words")]
    rows = lexical.search(table(spark, docs), table(spark, items, "item_id")).collect()
    want = sorted([9] * 4 + list(range(6, 21)))[:10]
    assert len(rows) == 20 and sorted(r["doc_id"] for r in rows) == sorted(want * 2)
    assert Counter(r["rank"] for r in rows) == {k: 2 for k in range(1, 11)}
    empty_docs, empty_items = table(spark, []), table(spark, [], "item_id")
    for d, i in ((empty_docs, table(spark, items, "item_id")), (table(spark, docs), empty_items),
                 (table(spark, [(1, None), (2, "...")]), table(spark, items, "item_id"))):
        assert lexical.search(d, i).count() == 0


def test_pruning_keeps_partial_scores_that_can_still_win():
    assert lexical._least_kept(np.array([5, 1, 9]), 2) == 5 and lexical._least_kept(np.array([5, 1]), 3) == 0
    assert (lexical.contributions(np.array([1, 10**6]), np.array([1, 1]), 10, 10**9) < lexical.MOST_PER_WEIGHT).all()


# ---------------------------------------------------------------- languages


def test_language_contract_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    rows = q_llm.QUERIES["op11_language_id"](spark, SF).collect()
    assert len(rows) == len(lang) and {r["lang_pred"] for r in rows} <= {v for v, _ in lang.values()} | {"und"}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in lang[r["doc_id"]][1] or ""))
    test = [r["lang_pred"] == lang[r["doc_id"]][0] for r in rows if r["held_out"] and lang[r["doc_id"]][0]]
    assert len(test) > 200 and np.mean(test) > 0.97


def test_language_ignores_held_out_labels_and_other_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("source", F.lit("zz")).withColumn(
        "lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(x, language.fit(x)).collect()} for x in (docs, other))
    assert a == b


def test_languages_of_one_family_are_told_apart_by_their_pair():
    rng = random.Random(4)
    stems = {"en": ["the", "and", "that", "with"], "de": ["der", "und", "dass", "mit"], "nl": ["het", "dat", "een", "met"],
             "fr": ["les", "dans", "pour"], "es": ["los", "para", "con"], "qx": ["lös", "parä", "cön", "con"]}
    texts, langs = [], []
    for code, stem in stems.items():
        for _ in range(40):
            texts.append(" ".join(rng.choices(stem, k=rng.randint(2, 30))))
            langs.append(code)
    data, off = language.letters(pa.array(texts))
    s = language.Settings(buckets=1024)
    counts = np.stack([language.gram_counts(data[off[i]:off[i + 1]], s.buckets) for i in range(len(texts))])
    m = language.train(counts, langs, np.arange(len(texts)) % 4 == 0, s)
    names = [tuple(m.languages[i] for i in f) for f in m.families]
    assert ("de", "en", "nl") in names and ("es", "fr", "qx") in names  # an unlisted code joins the nearest family
    assert len(m.pairs) == 6
    got, score = language.predict(m, counts)
    assert np.mean([m.languages[k] == v for k, v in zip(got, langs)]) > 0.98 and (score <= 1).all()


def test_gram_counts_do_not_depend_on_blocks(monkeypatch):
    data, off = language.letters(pa.array(["Ab, cd!", None, "", "x1y", LONG]))
    assert data[off[0]:off[1]].tobytes() == b"ab cd " and data[off[3]:off[4]].tobytes() == b"x y"
    whole = language.gram_counts(data, 256)
    monkeypatch.setattr(language, "BLOCK", 1000)
    assert (language.gram_counts(data, 256) == whole).all() and whole.sum() == 4 * len(data) - 6


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (2, "1234 !?", "en"), (None, "ñandú 5", None), (3, LONG, "en"), (7, "the the", "en"), (7, "the the", "en"),
            (5, "日本", None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, score string, held_out string")
    unlabelled = language.identify(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(unlabelled) == 8 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in unlabelled)
    one = language.identify(docs, language.fit(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in one) == [
        (0, "en"), (1, "und"), (2, "und"), (2, "und"), (3, "en"), (5, "en"), (7, "en"), (7, "en")]
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).count() == 0
