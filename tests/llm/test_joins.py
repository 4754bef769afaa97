"""N-gram join, decontamination and substring removal against brute force."""

import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterspark.llm import common, decontaminate, ngram_join, shingles, suffix_dedup
from meterspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("id", "n", "hist", "label", "a", "b", "star", "runs", "_gone", "_row", "_twice", "class", "u", "v"):
            df = df.withColumn(c, F.lit(1))
    return df


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def corpus(seed=1, groups=12, copies=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = r.choices(vocab, k=45)
    texts = [None, "", " ", "one two", "one two", "One  TWO", "a b c d e", "a b c d f", "x"]
    for g in range(groups):
        base = r.choices(vocab, k=r.choice([6, 12, 40, 120, 300]))
        for _ in range(r.randrange(1, copies)):
            w = base[:]
            for _ in range(r.randrange(0, max(2, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    for _ in range(60):  # one passage in many otherwise different documents
        texts.append(" ".join(r.choices(vocab, k=r.randrange(1, 30)) + passage + r.choices(vocab, k=r.randrange(1, 30))))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,cap", [(1, 8), (2, 2)])
def test_join_components_match_brute_force(spark, seed, cap):
    texts = corpus(seed)
    got = ngram_join.link_components(table(spark, list(enumerate(texts))), cap=cap).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


@pytest.mark.parametrize("cap,block", [(8, 1024), (2, 1024), (2, 5)])
def test_all_links_of_dense_groups_are_listed_and_counted(spark, cap, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    r, texts = random.Random(7), corpus(3, groups=5)
    base = [f"d{i}" for i in range(120)]
    for i in range(30):  # one dense group; some of its pairs link and some do not
        w = base[:]
        for j in r.sample(range(120), i % 4):
            w[j] = f"e{i}_{j}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j]
            and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    df = table(spark, list(enumerate(texts)))
    got = {x["doc_id"]: x["n_links"] for x in ngram_join.link_components(df, cap=cap).collect()}
    assert got == {i: sum(i in p for p in want) for i in range(len(texts))}
    member, links, _ = ngram_join.similarity_links(df, cap=cap)
    first = {x["doc_id"]: x["class"] for x in member.collect()}
    listed = [tuple(x) for x in links.collect()]
    assert len(listed) == len(set(listed))
    assert set(listed) == {tuple(sorted((first[i], first[j]))) for i, j in want if first[i] != first[j]}


def test_join_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(5, a), (5, b), (2, b), (9, a), (None, a), (7, c), (7, c)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"]) for r in
                 ngram_join.link_components(table(spark, rows)).collect())
    assert got == [(-1, None), (2, 2), (5, 2), (5, 2), (7, 7), (7, 7), (9, 2)]
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in ngram_join.keep_one(table(spark, rows)).collect())
    assert kept == [-1, 2, 7]
    assert ngram_join.keep_one(table(spark, rows)).columns == table(spark, rows).columns


def test_near_copy_of_either_text_of_a_repeated_id(spark):
    a, b = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(300))
    near = a.replace("a119", "x")
    for rows in ([(1, b), (1, a), (2, near)], [(1, a), (2, near), (1, b)], [(5, a), (5, b), (2, near), (9, b.replace("b0 ", "y ")), (7, "c d")]):
        got = sorted(tuple(r) for r in ngram_join.link_components(table(spark, rows)).select("doc_id", "component_id", "n_links").collect())
        least = min(d for d, t in rows if t != "c d")
        want = []
        for d, t in rows:
            s = shingle_set(t)
            links = sum(100 * len(s & shingle_set(u)) >= 80 * len(s | shingle_set(u)) for _, u in rows) - 1
            want.append((d, d if t == "c d" else least, links))
        assert got == sorted(want)


def test_join_empty_table(spark):
    empty = table(spark, [(1, "a")]).limit(0)
    assert ngram_join.link_components(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    bands = ngram_join.Bands(80, 4000)
    with np.errstate(over="ignore"):
        for size in [*range(1, 40), 100, 333, 1000]:
            for k2, n2 in (ngram_join.FIRST, ngram_join.FINE):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                drop = rng.integers(0, len(a) // 9 + 1)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(drop), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                    continue
                key, own = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands, k2, n2)
                assert set(key[own == 0].tolist()) & set(key[own == 1].tolist()), (size, drop)


def test_histogram_bound_never_drops_a_link():
    assert ngram_join.may_link(np.array([2]), np.array([9]), np.array([9]), 80)[0]
    assert not ngram_join.may_link(np.array([3]), np.array([9]), np.array([9]), 80)[0]


def test_long_run_is_paired_in_bounded_memory():
    n, rng = 5000, np.random.default_rng(1)
    hist = rng.integers(0, 9, (n, ngram_join.CELLS)).astype(np.uint8)
    hist[7] = hist[4321]
    one = np.zeros(n, np.uint64), np.arange(n), np.arange(n), np.full(n, 500), hist, 80
    tracemalloc.start()
    a, b, _ = ngram_join.open_trees(*one)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(a.tolist(), b.tolist())) == [(4321, 7)] and peak < 150 << 20


def test_bucket_of_near_pairs_sends_a_tree():
    n = 3000
    hist = np.zeros((n, ngram_join.CELLS), np.uint8)
    a, b, _ = ngram_join.open_trees(np.zeros(n, np.uint64), np.arange(n), np.arange(n), np.full(n, 500), hist, 80)
    assert len(a) == n - 1 and set(b.tolist()) == {0}  # of 4.5 million pairs


def test_merged_roots_are_the_smallest_members():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    root = ngram_join.merged(np.arange(300), a, b)
    want = list(range(300))
    for _ in range(300):
        for x, y in zip(a.tolist(), b.tolist()):
            want[x] = want[y] = min(want[x], want[y])
    assert root.tolist() == want


def test_long_runs_are_split_over_tasks(spark):
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"x{r.randrange(10**6)}" for _ in range(30)])) for i in range(40)]
    rows += [(100 + i, t.replace("p59", f"q{i}")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scope = ngram_join.set_profiles(df, 5).join(df, "doc_id").select("doc_id", "text", F.col("doc_id").alias("label"), "n", "hist")
    blocks = ngram_join._blocks(scope, 4, ngram_join.Bands(80, 100), 5, *ngram_join.FINE, fine=True).cache()
    trees = [{r["node"]: r["component"] for r in components(ngram_join._open_candidates(blocks, 80, long=n), "a", "b").collect()}
             for n in (ngram_join.LONG, 7)]
    assert trees[0] == trees[1] and all(trees[0][i] == trees[0][100 + i] for i in range(40))


def test_signature_blocks_are_small_and_hold_histograms_of_mixed_runs_only(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(200))) for i in range(1000, 1040)]
                               + [(i, "one two three four five six seven " * 3 + f"t{i % 2}") for i in range(8)], "doc_id long, text string")
    bands = ngram_join.Bands(80, 300)
    blocks = ngram_join._blocks(df, 3000, bands, 5, *ngram_join.FIRST).toArrow()
    by_bucket = [blocks.filter(pa.array([b == i for b in blocks.column("bucket").to_pylist()])) for i in set(blocks.column("bucket").to_pylist())]
    entries = [ngram_join._entries(t) for t in by_bucket]
    keys = sum(len(e[0]) for e in entries)
    assert {int(d) for e in entries for d in e[1]} > set(range(1000, 1040)) and sum(len(set(e[0].tolist())) for e in entries) > keys / 2
    assert sum(len(k) for k in blocks.column("keys").to_pylist()) == ngram_join.KEY_BYTES * keys  # eight bytes before
    profiles = ngram_join.set_profiles(df, 5).join(df, "doc_id")
    for label, some in ((F.lit(1).cast("long"), 0), (F.col("doc_id"), 2)):
        scope = profiles.select("doc_id", "text", label.alias("label"), "n", "hist")
        fine = ngram_join._blocks(scope, 40, bands, 5, *ngram_join.FINE, fine=True).toArrow()
        held = {int(d) for x in fine.column("docs").to_pylist() for d in np.frombuffer(x, "<i8")}
        assert held <= set(range(8)) and len(held) >= some  # sets that share no key with another component leave no block


def test_shuffle_files_of_a_stored_table_go_with_its_query(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {str(f) for f in re.findall(r"shuffle_\d+_\d+_\d+[.]data", disk.getAllFiles().mkString(" "))}

    before, df = files(), spark.range(5000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    out = common.stored(df, "test")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    else:
        raise AssertionError(files() - before)
    assert out.agg(F.sum("count")).first()[0] == 5000


def test_components_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 260)) and got[301] == 300


def words_of(t):
    return next(iter(decontaminate.texts_words(pa.array([t]))))[2]


def edited(r, words, n, pool):
    w = list(words)
    for _ in range(n):
        k, how = r.randrange(len(w)), r.randrange(3)
        if how == 0:
            w[k] = r.choice(pool)
        elif how == 1 and len(w) > 5:
            del w[k]
        else:
            w.insert(k, r.choice(pool))
    return w


def test_fit_distance_is_exact():
    r = random.Random(3)
    for _ in range(300):
        a = [r.randrange(4) for _ in range(r.randrange(1, 9))]
        b = [r.randrange(4) for _ in range(r.randrange(0, 14))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.fit_distance(np.array(a, np.uint64), np.array(b, np.uint64))[0] == min(row)


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(9)
    pool = [f"p{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(pool, k=r.randrange(15, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "tiny item"), (63, "p1")]
    rows, planted = [], {}
    for d in range(240):
        w = r.choices(pool[1:], k=r.randrange(0, 200))
        w = [x for x in w if x != "p1"]
        if d % 3 == 0:
            i = r.randrange(60)
            n = len(items[i][1].split())
            planted[d] = (i, d % 2 == 0)
            w = w + edited(r, items[i][1].split(), 0 if d % 2 == 0 else max(1, n // 20), pool[1:]) + r.choices(pool[2:], k=20)
        rows.append((d, " ".join(w).upper() if d % 5 == 0 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "before tiny, Item after"), (902, "before tiny, Item after"), (903, "tiny p2 item")]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find_matches(docs, bench).collect()]
    pairs = {(d, i) for d, i, _ in got}
    exact = {(d, i) for d, (i, e) in planted.items() if e}
    near = {(d, i) for d, (i, e) in planted.items() if not e}
    assert exact <= pairs and len(near & pairs) >= 0.9 * len(near)
    assert {d for d, _ in pairs} <= set(planted) | {902} and (902, 62) in pairs and (903, 62) not in pairs
    assert all(e == 0 for d, i, e in got if (d, i) in exact)
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in rows} - {d for d, _ in pairs}


@pytest.mark.parametrize("length", [8, 15, 30, 50])
def test_every_text_within_the_edits_is_found(spark, length):
    r, pool = random.Random(length), [f"v{i}" for i in range(300)]
    items = [[r.choice(pool) for _ in range(length)] for _ in range(25)]
    most, docs, want = length // 5, [], set()
    for i, w in enumerate(items):
        spread = sorted(r.sample(range(length), most))
        variants = [w[most:], ["zz"] * most + w[most:], w[:-most], [x for j, x in enumerate(w) if j not in spread],
                    ["zz" if j in spread else x for j, x in enumerate(w)],
                    [y for j, x in enumerate(w) for y in (["zz", x] if j in spread else [x])]]
        for v in variants:
            around = [[f"a{r.randrange(10**6)}" for _ in range(20)] for _ in range(2)]
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(around[0] * (len(docs) % 2) + v + around[1])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(m[0], m[1]) for m in decontaminate.find_matches(df, bench).collect()} >= want
    assert decontaminate.clean_documents(df, bench).count() == 0


def test_match_span_covers_the_item(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = table(spark, [(1, "é before " + item + " after")])
    m = decontaminate.find_matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert ("é before " + item + " after").encode()[m["start"]:m["end"]].decode() == item


def test_decontamination_blocks_and_empty(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(7)], "item_id long, text string")
    docs = table(spark, [(i, f"x {' '.join(f'i{i}w{j}' for j in range(12))} y") for i in range(7)])
    s = decontaminate.Settings(block=3)
    assert sorted((r[0], r[1]) for r in decontaminate.find_matches(docs, items, s).collect()) == [(i, i) for i in range(7)]
    assert decontaminate.find_matches(docs, items.limit(0)).count() == 0
    assert decontaminate.find_matches(docs.limit(0), items).count() == 0
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == 7


def brute_removal(rows, width):
    seen, out = set(), []
    for _, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - width + 1):
            w = data[k:k + width]
            if w in seen:
                gone[k:k + width] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width,seed,bits", [(100, 1, 64), (20, 2, 64), (9, 3, 64), (100, 1, 8), (20, 2, 11)])
def test_removed_bytes_match_brute_force(spark, width, seed, bits):
    # with few bits different strings share hashes, and only their bytes tell them apart
    r = random.Random(seed)
    shared = ["".join(r.choices("abcd é\n", k=r.randrange(width - 5, 3 * width))) for _ in range(6)]
    texts = [None, "", "a" * (5 * width), "ab" * width, "é" * width]
    for _ in range(60):
        texts.append("".join(r.choice(shared) if r.random() < 0.5 else "".join(r.choices("abcdefgh ", k=r.randrange(1, width)))
                             for _ in range(r.randrange(1, 8))))
    texts += texts[10:20]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in
           suffix_dedup.remove_repeats(table(spark, rows), width, bits=bits).collect()}
    assert [got[i] for i, _ in rows] == brute_removal(rows, width)


def test_removal_order_of_null_and_repeated_ids(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = [(None, t), (4, t), (4, "zz" + t), (4, "aa" + t), (-3, "q" + t)]
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -99, x["n_bytes"], x["n_removed"]) for x in
                 suffix_dedup.remove_repeats(table(spark, rows), 100).collect())
    assert got == [(-99, 150, 0), (-3, 151, 150), (4, 150, 150), (4, 152, 150), (4, 152, 150)]
    assert suffix_dedup.remove_repeats(table(spark, rows).limit(0), 100).count() == 0


def test_a_string_in_every_document_is_one_entry_of_a_block():
    n = 5000
    packer = suffix_dedup.Packer(8, 0, 4, True)
    packer.add(np.arange(n, 0, -1), np.full(n, 7), np.full(n, 10, np.uint64))
    told, sent = list(packer.send(True))
    doc, pos, key = suffix_dedup.unpack(pa.Table.from_batches([sent]), 8)
    assert (doc.tolist(), pos.tolist(), key.tolist(), sent["bucket"].to_pylist()) == ([1], [7], [10], [2])
    doc, pos, source, gap = suffix_dedup.unpack(pa.Table.from_batches([told]), -1)
    assert sorted(doc) == list(range(2, n + 1)) and set(source) == {1} and set(gap) == {0} and min(told["bucket"].to_pylist()) >= 4


def test_covers_are_difference_covers():
    for v, c in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_shingle_words_match_the_pattern():
    texts = ["A b\tC", "", "é Ü\x0bx", " lead trail ", "a\x1cb c", "x" * 3_000_000]
    for t in texts:
        raw, off = shingles.text_buffers(pa.array([t]))
        with np.errstate(over="ignore"):
            _, start, end, _ = shingles.words(raw, off)
        assert [t.encode()[a:b].decode() for a, b in zip(start, end)] == WORD.findall(t)
