"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters and digits, A-Z lower-cased) hash into a fixed embedding
table; a word's embedding is the sum of its own row and the rows of its first
bytes, so inflected forms share what they have in common.  Filters of several widths slide over the whole text, each filter's
maximum over all positions is kept (so the place and the length of a text do
not matter), and one dense layer gives the logit.  Embeddings start from the
shrunk class log-odds of their bucket.  A share of the training rows is kept
back to calibrate the probability and, per language, the decision threshold;
each language's threshold is mapped to 0.3.  The language is guessed from the
function words of the text itself, never read from a column.

Training reads a bounded sample of labelled rows (``max_rows`` documents of at
most ``max_words`` words together, both parameters); scoring streams every
document once with a model of fixed size, and a task holds one Arrow batch.

Defined results: NULL and empty texts get the score of a text without words;
a label table without both classes gives every document the base rate;
repeated label rows of a document count once (label 1 wins); other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import crc_mod

# Function words that tell four languages apart.
LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "are", "this", "be", "as", "by"),
    "de": ("der", "die", "das", "und", "ist", "zu", "den", "mit", "von", "nicht", "ein", "eine", "im", "des", "auf", "sich"),
    "fr": ("le", "la", "les", "et", "est", "des", "du", "une", "un", "que", "qui", "dans", "pour", "au", "par", "pas"),
    "es": ("el", "los", "las", "que", "y", "en", "por", "con", "para", "una", "del", "se", "su", "al", "lo", "como"),
}
LANGUAGES = (*LANGUAGE_WORDS, "other")
SEED_DECISION = 0.3
#: Bytes of the word prefixes that have embeddings of their own.
PREFIXES = (4, 5)
COLUMNS = 1 + len(PREFIXES)


@dataclass
class Settings:
    buckets: int = 1 << 18
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    shrink: float = 12.0
    max_rows: int = 8000
    max_words: int = 4_000_000


@dataclass
class Model:
    """Fixed-size parameters; ``cut`` and ``scale`` are the calibration per language."""

    s: Settings
    base: float
    emb: np.ndarray | None = None
    w: list = field(default_factory=list)
    b: list = field(default_factory=list)
    dense: np.ndarray | None = None
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    cut: tuple[float, ...] = ()


def _language_table(buckets: int) -> np.ndarray:
    table = np.full(buckets, -1, np.int8)
    for k, words in enumerate(LANGUAGE_WORDS.values()):
        table[buckets_of(pa.array([" ".join(words)]), buckets)[0][:, 0]] = k
    return table


def buckets_of(texts: pa.Array, buckets: int) -> list[np.ndarray]:
    """Buckets of every word and its prefixes (a row per word) of every whole text."""
    out = []
    raw, offsets = shingles.text_buffers(texts)
    with np.errstate(over="ignore"):
        for a, b in shingles.slices(offsets):
            h, _, _, first = shingles.words(raw, offsets[a:b + 1], shingles.NOT_ALNUM, PREFIXES)
            ids = (h & np.uint64(buckets - 1)).astype(np.int32)
            out += np.split(ids, first[1:-1]) if b > a else []
    return out


def _join(docs: list[np.ndarray], pad: int, bucket_pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one row, each followed by ``pad`` empty positions; and where each begins."""
    blank = np.full((pad, COLUMNS), bucket_pad, np.int32)
    begin = np.concatenate([[0], np.cumsum([len(d) + pad for d in docs])])
    return np.concatenate([x for d in docs for x in (d, blank)]), begin


def _responses(m: Model, ids: np.ndarray) -> np.ndarray:
    """Response of every filter at every position (one product for all taps of all widths, then shifted sums)."""
    taps = m.emb[ids].sum(1) @ np.concatenate([w[j] for w in m.w for j in range(len(w))], axis=1)
    f, at, out = m.s.filters, 0, np.empty((len(ids), m.s.filters * len(m.s.widths)), np.float32)
    for k, width in enumerate(m.s.widths):
        r = out[:, k * f:(k + 1) * f]
        r[:] = taps[:, at:at + f] + m.b[k]
        for j in range(1, width):
            r[:-j] += taps[j:, at + j * f:at + (j + 1) * f]
        at += width * f
    return out


def _pool(r: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Maximum of every filter over every text, at least 0."""
    out = np.stack([r[a:b].max(0) for a, b in zip(begin[:-1], begin[1:])])
    return np.maximum(out, 0, out=out)


def logits(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    ids, begin = _join(docs, max(m.s.widths), m.s.buckets)
    return _pool(_responses(m, ids), begin) @ m.dense + m.bias


def train(docs: list[np.ndarray], y: np.ndarray, s: Settings | None = None, seed: int = 1) -> Model:
    """Fit embeddings, filters and the dense layer with Adam on whole texts."""
    s = s or Settings()
    y = np.asarray(y, np.float32)
    base = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.05
    m = Model(s, base)
    if not len(y) or y.min() == y.max():
        return m
    rng = np.random.default_rng(seed)
    in_pos, in_all = np.zeros(s.buckets + 1), np.zeros(s.buckets + 1)
    for d, label in zip(docs, y):
        u = np.unique(d)
        in_all[u] += 1
        in_pos[u] += label
    odds = np.log((in_pos + s.shrink * base) / (in_all + s.shrink) / base)
    m.emb = rng.normal(0, 0.05, (s.buckets + 1, s.dim)).astype(np.float32)
    m.emb[:, 0] = odds
    m.emb[s.buckets] = 0
    m.w = [rng.normal(0, 0.2, (k, s.dim, s.filters)).astype(np.float32) for k in s.widths]
    for w in m.w:
        w[:, 0, : s.filters // 2] = np.abs(w[:, 0, : s.filters // 2]) + 0.5  # half of the filters start as evidence detectors
    m.b = [np.full(s.filters, 0.05, np.float32) for _ in s.widths]
    m.dense = rng.normal(0, 0.3, s.filters * len(s.widths)).astype(np.float32)
    m.bias = float(np.log(base / (1 - base)))
    state: dict[str, list] = {}
    step = 0

    def adam(key: str, p: np.ndarray, g: np.ndarray, rate: float) -> None:
        v = state.setdefault(key, [np.zeros_like(p), np.zeros_like(p)])
        v[0] = 0.9 * v[0] + 0.1 * g
        v[1] = 0.999 * v[1] + 0.001 * g * g
        p -= rate * (v[0] / (1 - 0.9**step)) / (np.sqrt(v[1] / (1 - 0.999**step)) + 1e-7)

    bias = np.array([m.bias], np.float32)
    second = np.full(s.buckets + 1, 1e-6, np.float32)  # running squared gradient per embedding row
    for epoch in range(s.epochs):
        rate = s.rate * (1 - 0.8 * epoch / max(1, s.epochs - 1))
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            pick = order[at:at + s.batch]
            step += 1
            ids, begin = _join([docs[i] for i in pick], max(s.widths), s.buckets)
            full = _responses(m, ids)
            pool = _pool(full, begin)
            z = pool @ m.dense + bias[0]
            dz = ((1 / (1 + np.exp(-z)) - y[pick]) / len(pick)).astype(np.float32)
            dpool = (dz[:, None] * m.dense) * (pool > 0)
            adam("dense", m.dense, pool.T @ dz + 1e-4 * m.dense, rate)
            adam("bias", bias, np.array([dz.sum()], np.float32), rate)
            rows, grads = [], []
            peak = np.stack([a + full[a:b].argmax(0) for a, b in zip(begin[:-1], begin[1:])])
            for k, width in enumerate(s.widths):
                own = slice(k * s.filters, (k + 1) * s.filters)
                d, place = dpool[:, own], peak[:, own]
                gw = np.zeros_like(m.w[k])
                for j in range(width):
                    idx = ids[np.minimum(place + j, len(ids) - 1)]
                    gw[j] = np.einsum("dfe,df->ef", m.emb[idx].sum(2), d)
                    rows.append(idx.ravel())
                    grads.append(np.repeat((d[:, :, None] * m.w[k][j].T[None]).reshape(-1, s.dim), COLUMNS, axis=0))
                adam(f"w{k}", m.w[k], gw, rate)
                adam(f"b{k}", m.b[k], d.sum(0), rate)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            uniq, inv = np.unique(rows, return_inverse=True)
            g = np.zeros((len(uniq), s.dim), np.float32)
            np.add.at(g, inv, grads)
            second[uniq] = 0.95 * second[uniq] + 0.05 * (g * g).mean(1)
            m.emb[uniq] -= 0.3 * rate * g / (np.sqrt(second[uniq])[:, None] + 1e-4)
            m.emb[s.buckets] = 0
    m.bias = float(bias[0])
    return m


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def languages(docs: list[np.ndarray], buckets: int, table: np.ndarray | None = None) -> np.ndarray:
    """Index into ``LANGUAGES``, guessed from function words (``other`` without any)."""
    table = _language_table(buckets) if table is None else table
    out = np.full(len(docs), len(LANGUAGES) - 1)
    for i, d in enumerate(docs):
        k = table[d[:, 0]]
        n = np.bincount(k[k >= 0], minlength=len(LANGUAGE_WORDS))
        if n.sum():
            out[i] = n.argmax()
    return out


def calibrate(m: Model, docs: list[np.ndarray], y: np.ndarray, least: int = 40) -> Model:
    """Platt scaling on held-back rows, then the F1-best threshold of each language (of all rows where few)."""
    y = np.asarray(y, float)
    m.cut = (SEED_DECISION,) * len(LANGUAGES)
    if m.emb is None or len(y) < 20 or y.min() == y.max():
        return m
    z = logits(m, docs).astype(float)
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    def loss(a, b):
        t = a * z + b
        return float((np.logaddexp(0, t) - target * t).sum()) + 1e-2 * a * a

    for _ in range(50):  # damped Newton steps on the two parameters
        p = _sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum() + 2e-2 * a, (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 2e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        d, now, size = np.linalg.solve(h, g), loss(a, b), 1.0
        while size > 1e-4 and loss(a - size * d[0], b - size * d[1]) > now:
            size /= 2
        a, b = a - size * d[0], b - size * d[1]
    m.scale = (float(max(a, 1e-3)), float(b))
    p = _sigmoid(m.scale[0] * z + m.scale[1])

    def best(p, y):
        order = np.argsort(-p, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
        k = int(f1.argmax())
        low = p[order[k + 1]] if k + 1 < len(p) else 0.0
        return float(np.clip((p[order[k]] + low) / 2, 0.02, 0.98))

    everywhere = best(p, y)
    lang = languages(docs, m.s.buckets)
    cuts = []
    for k in range(len(LANGUAGES)):
        own = lang == k
        cuts.append(best(p[own], y[own]) if own.sum() >= least and y[own].sum() >= 5 else everywhere)
    m.cut = tuple(cuts)
    return m


def scores(m: Model, docs: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
    """Calibrated scores; a language's threshold lies at 0.3."""
    if m.emb is None:
        return np.full(len(docs), min(m.base, 0.29))
    p = _sigmoid(m.scale[0] * logits(m, docs).astype(float) + m.scale[1])
    cut = np.array(m.cut)[languages(docs, m.s.buckets, table)]
    low = p * SEED_DECISION / cut
    return np.where(p < cut, low, SEED_DECISION + (p - cut) * (1 - SEED_DECISION) / (1 - cut))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_words: int):
    """At most ``max_rows`` labelled (text, label) rows in hash order, of at most ``max_words`` words together."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
           .agg(F.max(label).alias("_label")))
    pick = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # a bounded heap per task
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(pick), "doc_id")
    return rows.where(F.octet_length("text") <= 4 * max_words)


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None, seed: int = 1) -> Model:
    """Train on four fifths of the sample and calibrate on the rest (chosen by hash of the key)."""
    s = s or Settings()
    rows = sample_labelled(docs, labels, "toxic", s.max_rows, s.max_words)
    n = s.buckets

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [x.tobytes() for x in buckets_of(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.binary()), b.column(2)], ["doc_id", "w", "y"])

    kind = docs.schema["doc_id"].dataType
    small = rows.select("doc_id", "text", F.col("_label").cast("int").alias("y")).mapInArrow(
        ids, T.StructType([T.StructField("doc_id", kind), T.StructField("w", T.BinaryType()), T.StructField("y", T.IntegerType())]))
    words, y, back, left = [], [], [], s.max_words
    for r in small.withColumn("back", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) == 0).orderBy(
            F.xxhash64("doc_id"), "doc_id", "w").toLocalIterator():
        d = np.frombuffer(r["w"], np.int32).reshape(-1, COLUMNS)
        if len(d) <= left:
            left -= len(d)
            words.append(d)
            y.append(r["y"])
            back.append(r["back"])
    y, back = np.array(y, int), np.array(back, bool)
    pick = lambda keep: [d for d, k in zip(words, keep) if k]
    return calibrate(train(pick(~back), y[~back], s, seed), pick(back), y[back])


def score_documents(docs: DataFrame, m: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(m)  # fixed size: buckets x dim floats
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = _language_table(model.s.buckets)
        for b in batches:
            words = buckets_of(b.column(1), model.s.buckets)
            out, at = [], 0
            while at < len(words):  # about 2**18 words at a time
                end, n = at, 0
                while end < len(words) and (end == at or n + len(words[end]) <= 1 << 18):
                    n += len(words[end])
                    end += 1
                out.append(scores(model, words[at:end], table))
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())],
                                             ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows (crc32 of the key mod 4 = 2) are never read."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    m = fit(docs, labels.where(~held).select("doc_id", "toxic"), s)
    return score_documents(docs, m).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= F.lit(SEED_DECISION)).cast("int").alias("predicted"))
