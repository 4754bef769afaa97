"""Packing and token files: exact round trips with the plain tokenizer."""

import io
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterspark.llm import packing, token_store, tokens
from meterspark.llm.q_llm import tokenizer_path

ODD = [None, "", " ", "a", " a", "a ", "a  b", "a\n\nb c\n d", "x \t y", "<|endoftext|> b", "it's we'll", "1234 56", "\x1c a \x1f b", "ß é́",
       "the cat sat " * 700, "nb sp"]


def plain(name, texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_equals_tokenizer(name):
    more = ODD + ["“quoted” text", "trailing\u00a0", "\u2003lead x", "\u3000", "é à", "x" * 3000 + " y", "ends with à", "tab\tin word"]
    enc = tokens.WordEncoder(tokenizer_path(name), 2, cache_words=5)
    for texts in (more, more[::-1], more[:3], more[3:4], []):
        assert [x.tolist() for x in enc.encode(pa.array(texts, pa.string()))] == plain(name, texts)
    big = tokens.WordEncoder(tokenizer_path(name), None)
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() + [2] for x in big.encode(pa.array(["pad", *more, "end"]).slice(1, len(more)))] == plain(name, more)


def test_packing_contract(spark):
    texts = ODD + [" ".join(f"word{j}" for j in range(i * 13 % 400)) for i in range(300)]
    rows = packing.pack_documents(table(spark, texts), tokenizer_path("byte_bpe_50k.json"), group_pieces=64).collect()
    want = plain("byte_bpe_50k.json", texts)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for d, ids in enumerate(want):
        own = sorted(got[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids)
        assert len(own) == 1 or all(r["length"] == 1024 for r in own[1:])
        assert len(own) == max(1, math.ceil(len(ids) / 1024))
        assert all(r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]]) for r in own)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(seqs) <= 1.08 * math.ceil(sum(map(len, want)) / 1024) + 2


def test_sum_of_squares_choice_is_the_smallest():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 20, 200)
    where, offset = packing.sum_of_squares(sizes, 20)
    fill = {}
    for s, b, o in zip(sizes.tolist(), where.tolist(), offset.tolist()):
        gaps = [20 - x for x in fill.values() if x < 20]

        def cost(g):
            left = list(gaps)
            left.remove(g)
            left += [g - s] if g > s else []
            return sum(left.count(x) ** 2 for x in set(left))

        fits = {g for g in gaps if g >= s}
        assert o == fill.get(b, 0)
        if fits:
            assert cost(20 - fill[b]) == min(map(cost, fits))
        else:
            assert b not in fill
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= 20


def test_packing_spreads_rows_without_own_keys(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, "a b c") for _ in range(300)] + [(7, "a b c") for _ in range(300)], "doc_id long, text string")
    rows = packing.pack_documents(docs.withColumn("_group", F.lit(1)), path, group_pieces=100).collect()
    groups = {}
    for r in rows:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(rows) == 600 and len(groups) == 6 and max(groups.values()) < 200


def test_packing_is_tight(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(["word"] * int(n)) for n in np.minimum(rng.exponential(250, 1500) + 1, 1020)]
    rows = packing.pack_documents(table(spark, texts), tokenizer_path("byte_bpe_50k.json")).collect()
    least = math.ceil(sum(r["length"] for r in rows) / 1024)
    assert len({r["sequence_id"] for r in rows}) <= least + 3


def test_packing_empty_table(spark):
    assert packing.pack_documents(table(spark, ["a"]).limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_file_round_trip_reads_only_what_is_asked():
    rng = np.random.default_rng(5)
    docs = {k: rng.integers(0, 60000, int(rng.integers(0, 900)), dtype=np.uint32) for k in range(200)}
    docs[77] = rng.integers(0, 60000, 50_000, dtype=np.uint32)  # spans frames
    sink = io.BytesIO()
    w = token_store.Writer(sink, 2, frame_bytes=4096)
    for k, ids in docs.items():
        w.add(k, ids.tobytes())
    w.close()
    data = sink.getvalue()
    r = token_store.Reader(io.BytesIO(data), len(data))
    assert [x.tolist() for _, x in r.find([5, 77, 199])] == [docs[k].tolist() for k in (5, 77, 199)]
    assert 0 < r.frames_read < len(r.sums)
    assert all(np.array_equal(r.ids(i), docs[i]) for i in range(200))
    broken = bytearray(data)
    import zstandard

    z = zstandard.ZstdCompressor().compress(b"\0" * 4096)
    assert len(z) < r.place[1]
    broken[:len(z)] = z  # a valid frame with other content
    with pytest.raises(ValueError, match="checksum"):
        token_store.Reader(io.BytesIO(bytes(broken)), len(data)).ids(0)


def test_frames_are_plain_zstandard():
    import zstandard

    sink = io.BytesIO()
    w = token_store.Writer(sink, 4, frame_bytes=64)
    ids = np.arange(70_000, 70_100, dtype="<u4")
    w.add(1, ids.tobytes())
    w.close()
    out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read(400)
    assert np.array_equal(np.frombuffer(out, "<u4"), ids)


def test_token_files_contract(spark):
    texts = ODD + [f"doc {i} " * (i % 40) for i in range(200)]
    manifest = token_store.write(table(spark, texts), tokenizer_path("word_bpe_49k.json"), least_files=3)
    got = {r["doc_id"]: r for r in token_store.read(spark, manifest).collect()}
    at = 0
    for d, ids in enumerate(plain("word_bpe_49k.json", texts)):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_null_repeated_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "z"), (3, "a"), (1, None)], "doc_id long, text string")
    path = tokenizer_path("word_bpe_49k.json")
    rows = token_store.read(spark, token_store.write(docs, path, least_files=2)).orderBy("start").collect()
    many = spark.createDataFrame([(5, f"t {i % 40}") for i in range(400)], "doc_id long, text string")
    manifest = token_store.write(many, path, least_files=8)
    assert manifest.count() > 4 and manifest.agg({"n_docs": "sum"}).first()[0] == 400  # one key, several files
    assert [r["doc_id"] for r in rows] == [None, 1, 3, 3] and rows[-1]["start"] == sum(r["n_tokens"] for r in rows[:-1])
    assert token_store.read(spark, token_store.write(docs.limit(0), path)).count() == 0
