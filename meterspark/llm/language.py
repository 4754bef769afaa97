"""Language identification by hierarchical discrimination.

A text is first given a language family by linear support vector machines (one
per family against the rest); inside the family one-versus-one machines, each
trained only on the texts of its two languages, vote on the language.  Closely
related languages are thus told apart by machines that spend their whole
weight on what differs between them.

Features are runs of one to four UTF-8 bytes of the lower-cased text, everything
that is no letter counting as one space; they are hashed into ``buckets`` and
counted over the whole text, and the square roots of their shares are the vector
(its length is 1, so texts of all lengths are comparable).

Families come from ``FAMILY_OF``; a learned language that is not listed there
joins the family whose average vector is nearest to its own.  Training reads a
bounded sample: about ``max_rows`` labelled documents, evenly over at most ``max_languages``
languages (the most frequent ones), chosen by hash; a short piece of each is
a training row of its own, so short texts are known too.  Only hashed counts reach the driver.
Scoring streams every document once, with a model of fixed size and no shuffle; long
texts are counted a block at a time.

Defined results: NULL, empty and letterless texts are ``und`` with score 0, as is
everything when no labelled row was given; with one learned language every other
text is that language with score 1; equal votes go to the larger sum of
probabilities, then to the language first in order; equal texts get equal results;
a NULL key hashes as the empty string; columns other than doc_id, text and (for
learning) lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import crc_mod

UNKNOWN = "und"
# Families of common languages by their two-letter codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "malayic": ("id", "ms"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Longest run of bytes; text bytes counted at a time.
GRAM, BLOCK = 4, 1 << 20
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[c for c in range(128) if not chr(c).isalpha()]] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Settings:
    buckets: int = 1 << 12
    max_rows: int = 1500
    max_languages: int = 128
    piece: tuple[int, int] = (24, 240)
    ridge: float = 1e-4


@dataclass
class Model:
    """``weights``: a column per machine (families, then pairs), the last row being the constants."""

    s: Settings
    languages: tuple[str, ...] = ()
    families: tuple[tuple[int, ...], ...] = ()
    pairs: tuple[tuple[int, int], ...] = ()
    weights: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 1.0)


def letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with every run of other ASCII characters as one space, and where each begins (+ total)."""
    raw, offsets = shingles.text_buffers(pc.utf8_lower(col.cast(pa.large_string())))
    base = int(offsets[0])
    data, off = _SPACED[raw[base:int(offsets[-1])]], offsets - base
    if not len(data):
        return data, off
    keep = data != 32
    keep[1:] |= data[:-1] != 32
    keep[off[:-1][off[:-1] < len(data)]] |= True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def gram_counts(data: np.ndarray, buckets: int) -> np.ndarray:
    """Counts per bucket of all runs of 1 to ``GRAM`` bytes of one text."""
    out = np.zeros(buckets, np.int64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), BLOCK):
            part = data[a:a + BLOCK + GRAM - 1].astype(np.uint64)
            code = np.zeros(len(part), np.uint64)
            for n in range(1, GRAM + 1):
                m = min(len(part) - n + 1, BLOCK)  # runs that begin in this block
                if m <= 0:
                    break
                code = code[:len(part) - n + 1] * np.uint64(256) + part[n - 1:]
                out += np.bincount((((code[:m] + (np.uint64(n) << np.uint64(40))) * _MIX) >> shift).astype(np.int64), minlength=buckets)
    return out


def vectors(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares, with a constant 1 at the end (a row of zeros for a text without runs)."""
    x = np.ones((len(counts), counts.shape[1] + 1), np.float32)
    np.divide(counts, np.maximum(counts.sum(1, keepdims=True), 1), out=x[:, :-1], casting="same_kind")
    np.sqrt(x, out=x)
    return x


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 20) -> np.ndarray:
    """Linear machine with squared hinge loss: Newton steps on the rows inside the margin, solved by conjugate gradients.

    Rows of weight 0 take no part (so all machines share one matrix).
    """
    w = np.zeros(x.shape[1], np.float32)
    weight = (weight / weight.sum()).astype(np.float32)

    def loss(w):
        return 0.5 * ridge * float(w @ w) + float(weight @ np.maximum(1 - y * (x @ w), 0) ** 2)

    now = loss(w)
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        ca = weight * (slack > 0)
        g = ridge * w - 2 * (ca * y * slack) @ x
        d, r = np.zeros_like(w), g.copy()
        p, rr = r.copy(), float(r @ r)
        small = 1e-4 * rr
        for _ in range(50):
            if rr <= small:
                break
            q = ridge * p + 2 * (ca * (x @ p)) @ x
            a = rr / max(float(p @ q), 1e-30)
            d, r = d + a * p, r - a * q
            new = float(r @ r)
            p, rr = r + (new / rr) * p, new
        size = 1.0
        while size > 1e-3 and loss(w - size * d) > now:
            size /= 2
        new = loss(w - size * d)
        if new > now * (1 - 1e-4):
            break
        w, now = w - size * d, new
    return w


def _families(languages: tuple[str, ...], x: np.ndarray, y: np.ndarray) -> tuple[tuple[int, ...], ...]:
    """Languages grouped by family; unlisted ones join the family with the nearest average vector."""
    groups: dict[str, list[int]] = {}
    for i, code in enumerate(languages):
        if code.lower() in FAMILY_OF:
            groups.setdefault(FAMILY_OF[code.lower()], []).append(i)
    mean = [x[y == i, :-1].mean(0) for i in range(len(languages))]
    listed = {f: np.mean([mean[i] for i in v], axis=0) for f, v in groups.items()}
    for i, code in enumerate(languages):
        if code.lower() not in FAMILY_OF:
            near = max(listed, key=lambda f: float(mean[i] @ listed[f])) if listed else code
            groups.setdefault(near, []).append(i)
    return tuple(tuple(sorted(v)) for _, v in sorted(groups.items()))


def _even(sign: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Row weights that give both sides the same sum; 0 for rows that are not used."""
    out = np.zeros(len(sign))
    for side in (1, -1):
        rows = used & (sign == side)
        out[rows] = 1.0 / max(rows.sum(), 1)
    return out


def _scale(margin: np.ndarray) -> float:
    """Factor that makes a sigmoid of these signed margins (positive: right) most likely."""
    grid = 2.0 ** np.arange(-2, 6.5, 0.5)
    return float(min(grid, key=lambda a: np.logaddexp(0, -a * margin).mean())) if len(margin) else 1.0


def train(counts: np.ndarray, languages: list[str], back: np.ndarray, s: Settings | None = None) -> Model:
    """Fit on gram counts and languages of the sample; rows in ``back`` only calibrate the score."""
    s = s or Settings()
    taught = {lang for lang, b in zip(languages, back) if not b}
    back = np.array([b and lang in taught for lang, b in zip(languages, back)], bool)  # a language's only rows are learned
    names = tuple(sorted(set(languages)))
    m = Model(s, names)
    if len(names) < 2:
        return m
    y = np.array([names.index(lang) for lang in languages])
    x, tr, va = vectors(counts), ~back, back
    m.families = _families(names, x, np.where(tr, y, -1))
    of = np.array([next(f for f, v in enumerate(m.families) if i in v) for i in range(len(names))])
    cols, sure = [], ([], [])

    def machine(sign: np.ndarray, among: np.ndarray, kind: int) -> None:
        w = fit_svm(x, sign.astype(np.float32), _even(sign, among & tr), s.ridge)
        cols.append(w)
        sure[kind].append((sign * (x @ w))[among & va])

    for f in range(len(m.families) if len(m.families) > 1 else 0):
        machine(np.where(of[y] == f, 1, -1), tr | va, 0)
    m.pairs = tuple(p for v in m.families for p in combinations(v, 2))
    for i, j in m.pairs:
        machine(np.where(y == i, 1, -1), (y == i) | (y == j), 1)
    m.weights = np.stack(cols, axis=1)
    m.scale = tuple(_scale(np.concatenate(v)) if v else 1.0 for v in sure)
    return m


def predict(m: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and score of every row of gram counts."""
    n = len(counts)
    if len(m.languages) < 2:
        return np.zeros(n, np.int64), np.ones(n)
    f = vectors(counts) @ m.weights
    k = f.shape[1] - len(m.pairs)
    if k:
        z = m.scale[0] * f[:, :k]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        family, sure = f[:, :k].argmax(1), p.max(1)
    else:
        family, sure = np.zeros(n, np.int64), np.ones(n)
    votes, belief = np.zeros((n, len(m.languages))), np.zeros((n, len(m.languages)))
    for c, (i, j) in enumerate(m.pairs):
        margin = f[:, k + c]
        q = 1 / (1 + np.exp(-np.clip(m.scale[1] * margin, -30, 30)))
        votes[:, i] += margin >= 0
        votes[:, j] += margin < 0
        belief[:, i] += q
        belief[:, j] += 1 - q
    lang, score = np.zeros(n, np.int64), np.zeros(n)
    for v, members in enumerate(m.families):
        rows = np.flatnonzero(family == v)
        if len(members) == 1:
            lang[rows], score[rows] = members[0], sure[rows]
            continue
        own = belief[np.ix_(rows, members)]
        pick = (votes[np.ix_(rows, members)] * 4 * len(members) + own).argmax(1)
        lang[rows] = np.array(members)[pick]
        score[rows] = sure[rows] * own[np.arange(len(rows)), pick] / np.maximum(own.sum(1), 1e-12)
    return lang, np.clip(score, 0, 1)


def has_letter(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _held_out() -> F.Column:
    return crc_mod(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 3) == 1


def _sample(docs: DataFrame, s: Settings) -> DataFrame:
    """(lang, h, counts): hashed counts of the sampled labelled documents and of a short piece of each."""
    able = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        ~_held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.max_languages)
    rates = [(r["lang"], min(1.0, s.max_rows / r["count"])) for r in sizes.collect()]
    rates = [(lang, min(1.0, rate / len(rates))) for lang, rate in rates]
    rate = docs.sparkSession.createDataFrame(rates, "lang string, rate double")  # at most ``max_languages`` rows
    h = F.xxhash64(F.lit(11), "doc_id", "text")
    picked = (able.join(F.broadcast(rate), "lang").withColumn("h", h)
              .where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("lang", "h", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, h in enumerate(b.column(1).to_pylist()):
                text = letters(b.column(2).slice(i, 1))[0]
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                size = int(rng.integers(*s.piece))
                at = int(rng.integers(0, max(len(text) - size, 0) + 1))
                out += [(i, gram_counts(x, s.buckets)) for x in (text, text[at:at + size])]
            row = pa.array([i for i, _ in out], pa.int64())
            packed = [np.column_stack([np.flatnonzero(c), c[c > 0]]).astype("<u4").tobytes() for _, c in out]
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(packed, pa.binary())],
                                             ["lang", "h", "counts"])

    # the limit only bounds the sample when very many rows repeat one document
    return picked.mapInArrow(run, "lang string, h long, counts binary").limit(8 * s.max_rows)


def fit(docs: DataFrame, s: Settings | None = None) -> Model:
    """Learn from text and non-NULL ``lang`` of the documents that are not held out."""
    s = s or Settings()
    rows = sorted(((r["h"], r["lang"], bytes(r["counts"])) for r in _sample(docs, s).collect()))  # bounded by ``max_rows``
    counts = np.zeros((len(rows), s.buckets), np.float32)
    for i, (_, _, packed) in enumerate(rows):
        at = np.frombuffer(packed, "<u4").reshape(-1, 2)
        counts[i, at[:, 0]] = at[:, 1]
    return train(counts, [lang for _, lang, _ in rows], np.array([(h >> 7) % 4 == 0 for h, _, _ in rows], bool), s)


def identify(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = pa.array([*m.languages, UNKNOWN], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = has_letter(b.column(1)) if m.languages else np.zeros(b.num_rows, bool)
            lang, score = np.full(b.num_rows, len(m.languages)), np.zeros(b.num_rows)
            for x, y in shingles.slices(shingles.text_buffers(b.column(1))[1]):
                data, off = letters(b.column(1).slice(x, y - x))
                rows = np.flatnonzero(known[x:y])
                for a in range(0, len(rows), 256):
                    part = rows[a:a + 256]
                    counts = np.stack([gram_counts(data[off[i]:off[i + 1]], m.s.buckets) for i in part])
                    lang[x + part], score[x + part] = predict(m, counts)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(lang, pa.int64())), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
