"""Quality rules and sharding against brute force."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from meterspark.llm import quality_rules, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {g for g in windows if windows.count(g) > 1}
    covered = {i + j for i, g in enumerate(windows) if g in often for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", "   \n\t", "one", "a b c a b c", "a b\na b\n\n \nä ö", "x " * 60, "#$% the and of " * 20,
         "the cat sat on the mat and the dog ran to it " + " ".join(f"w{i}" for i in range(80)), "a\x0bb\x0cc\rd a\x0bb\x0cc", "é" * 3000]


def documents(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    if extra:
        for c in ("w", "l", "s", "p", "id", "runs", "size", "n_words", "bucket", "_group", "virtual_slot", "a"):
            df = df.withColumn(c, F.lit("x"))
    return df


def test_rules_match_brute_force(spark):
    docs = documents(spark, TEXTS + TEXTS)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(TEXTS + TEXTS):
        r, e = got[i], base_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e, repr(t)
        failed = e[0] < 50 or 100 * e[4] > 50 * e[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert got[8]["kept"] and not got[7]["kept"]


def test_rules_are_one_projection(spark):
    plan = quality_rules.apply_rules(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_empty_table(spark):
    assert quality_rules.apply_rules(documents(spark, TEXTS).limit(0)).count() == 0


def test_custom_rule_reports_its_name(spark):
    rules = (quality_rules.Rule("few_symbols", "n_symbols", "n_words", None, 0.01),)
    r = quality_rules.apply_rules(documents(spark, ["# " + " ".join(f"w{i}" for i in range(60))]), rules).first()
    assert r["failed_rules"] == ["few_symbols"] and not r["kept"]


def test_shards_are_even_and_gapless(spark):
    texts = [("t" * (i * 7 % 97)) if i % 9 else None for i in range(500)]
    rows = sharding.shard_documents(documents(spark, texts), 16).collect()
    assert len(rows) == 500
    load, places = {}, {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["place"])
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 98
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_sharding_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 4, 64).collect()
    assert len(rows) == 4 and len({(r["shard"], r["place"]) for r in rows}) == 4
    assert sharding.shard_documents(docs.limit(0), 4, 64).count() == 0


@pytest.mark.parametrize("n", [5, 3])
def test_rebalance_edits_the_map(spark, n):
    sizes = [(i * 37) % 101 + 1 for i in range(256)]
    old = sharding.initial_map(sizes, 4)
    new = sharding.rebalance(old, sizes, n)
    assert new.version == 2 and set(new.shard) == set(range(n))
    moved = [s for s in range(256) if old.shard[s] != new.shard[s]]
    if n == 5:
        assert all(new.shard[s] == 4 for s in moved)
    loads = new.loads()
    assert max(loads) - min(loads) <= 202
    folder = sharding.store_map(spark, old)
    sharding.store_map(spark, new, folder)
    assert sharding.load_map(spark, folder, 1) == old and sharding.load_map(spark, folder, 2) == new
