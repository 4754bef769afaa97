"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Each view has its own logistic classifier (numpy).  In every round each view
is fitted on its training set, calibrated on rows kept back, and hands its most
confident labels on unlabelled documents to the *other* view's training set.
In the end the two calibrated logits are combined on the kept-back rows, and a
document is kept unless its combined probability of being good falls below the
threshold that keeps ``keep_clean`` of the good kept-back rows.

Fitting reads bounded samples (``max_labelled`` labelled and ``max_pool``
unlabelled documents, both parameters, chosen by hash of the key); only their
feature vectors reach the driver.  Scoring streams every document once with a
model of fixed size; no shuffle.

Defined results: NULL text counts as empty and NULL metadata as the word
"null"; without labels of both classes every document is kept with the base
rate as score; repeated label rows count once (the lower label wins); equal
documents get equal scores; columns other than doc_id, text, lang, source and
n_chars are ignored, and missing metadata columns count as NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles

META = ("lang", "source", "n_chars")
META_BUCKETS = 64
_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)], "upper": [*range(65, 91)], "digit": [*range(48, 58)],
    "space": [32, 9, 11, 12, 13], "line": [10], "bang": [33, 63], "symbol": [35, 42, 36, 37, 38, 60, 62, 64, 94, 126, 92],
    "pipe": [124], "stop": [46, 44, 59, 58], "bracket": [40, 41, 91, 93, 123, 125], "markup": [60, 62, 47, 61],
}


@dataclass
class Settings:
    max_labelled: int = 6000
    max_pool: int = 6000
    rounds: int = 4
    confident: float = 0.97
    share: float = 0.15
    keep_clean: float = 0.995


def text_features(texts: pa.Array) -> np.ndarray:
    """Dense content features of every whole text: character classes, words, repetition, lines."""
    raw, offsets = shingles.text_buffers(texts)
    rows = []
    with np.errstate(over="ignore"):
        for a, b in shingles.slices(offsets):
            off = offsets[a:b + 1] - offsets[a]
            data = raw[offsets[a]:offsets[b]]
            counts = np.zeros((len(_CLASSES), b - a))
            for k, codes in enumerate(_CLASSES.values()):
                table = np.zeros(256, np.int64)
                table[codes] = 1
                run = np.concatenate([[0], np.cumsum(table[data])])
                counts[k] = run[off[1:]] - run[off[:-1]]
            h, start, end, first = shingles.words(raw, offsets[a:b + 1])
            size = (end - start).astype(float)
            sums = np.concatenate([[0.0], np.cumsum(size)])
            squares = np.concatenate([[0.0], np.cumsum(size * size)])
            n = np.diff(first)
            many = np.maximum(n, 1)
            n_bytes = np.diff(off)
            long_ = np.maximum(n_bytes, 1)
            mean = (sums[first[1:]] - sums[first[:-1]]) / many
            var = np.maximum((squares[first[1:]] - squares[first[:-1]]) / many - mean**2, 0)
            repeat = np.zeros((b - a, 3))
            for i, (p, q) in enumerate(zip(first[:-1], first[1:])):
                w = h[p:q]
                if len(w):
                    repeat[i, 0] = len(np.unique(w)) / len(w)
                if len(w) > 3:
                    g = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7)
                    repeat[i, 1] = 1 - len(np.unique(g)) / len(g)
                    repeat[i, 2] = np.mean(w[1:] == w[:-1])
            ratio = (counts / long_).T
            caps = counts[1] / np.maximum(counts[0], 1)
            per_line = np.log1p(n / (counts[5] * 0 + counts[list(_CLASSES).index("line")] + 1))
            rows.append(np.column_stack([
                ratio, np.sqrt(ratio), caps, np.log1p(n), np.minimum(np.log1p(n), 5), mean, np.sqrt(var), repeat,
                np.sqrt(repeat[:, 1]), per_line, counts[5] / many, counts[6] / many, counts[7] / many, counts[8] / many, n == 0]))
    return np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, 0), np.float32)


def meta_features(meta: dict[str, list]) -> np.ndarray:
    """Hashed language and source, and the declared length."""
    n = len(meta["lang"])
    out = np.zeros((n, 2 * META_BUCKETS + 3), np.float32)
    for k, name in enumerate(("lang", "source")):
        words = pa.array([f"{name}-{'null' if v is None else v}".replace(" ", "_") for v in meta[name]], pa.string())
        raw, offsets = shingles.text_buffers(words)
        with np.errstate(over="ignore"):
            h, _, _, first = shingles.words(raw, offsets) if n else (np.zeros(0, np.uint64), 0, 0, np.zeros(1, int))
        if n:
            out[np.arange(n), k * META_BUCKETS + (h[first[:-1]] % np.uint64(META_BUCKETS)).astype(int)] = 1
    size = np.array([-1.0 if v is None else max(float(v), 0.0) for v in meta["n_chars"]])
    out[:, -3] = np.log1p(np.maximum(size, 0))
    out[:, -2] = size < 0
    out[:, -1] = np.minimum(size, 300) / 300
    return out


@dataclass
class Logistic:
    """Standardised logistic regression with a Platt scale on top."""

    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return z @ self.w[:-1] + self.w[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -30, 30)


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (reg * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + reg * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-9)
        d, size = np.linalg.solve(h, g), 1.0
        while size > 1e-3 and loss(w - size * d) > now:
            size /= 2
        new = loss(w - size * d)
        if new > now - 1e-7 * (1 + abs(now)):
            break
        w, now = w - size * d, new
    return w


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, xv: np.ndarray, yv: np.ndarray) -> Logistic:
    x = x.astype(float)
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-6] = 1
    m = Logistic(mean, std, _newton(np.clip((x - mean) / std, -8, 8), y, weight, 3.0))
    if 0 < yv.sum() < len(yv):
        scale = _newton(m.raw(xv)[:, None], yv, np.ones(len(yv)), 0.05)
        m.a, m.b = float(max(scale[0], 0.0)), float(scale[1])
    return m


@dataclass
class Model:
    base: float
    text: Logistic | None = None
    meta: Logistic | None = None
    mixed: np.ndarray | None = None
    cut: float = 0.0
    rounds: tuple = ()

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text view, the metadata view and both."""
        if self.text is None:
            p = np.full(len(xt), self.base)
            return p, p, p
        zt, zm = self.text.logit(xt), self.meta.logit(xm)
        z = self.mixed[0] * zt + self.mixed[1] * zm + self.mixed[2]
        sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        return sig(zt), sig(zm), sig(z)


def co_train(xt, xm, y, back, pt, pm, s: Settings | None = None) -> Model:
    """Labelled text/metadata features and labels (``back``: kept back), features of the unlabelled pool."""
    s = s or Settings()
    y, back = np.asarray(y, float), np.asarray(back, bool)
    m = Model(float((y.sum() + 1) / (len(y) + 2)))
    tr, va = ~back, back
    if not len(y) or len(set(y[tr])) < 2 or len(set(y[va])) < 2:
        return m
    own = {"t": (xt, pt), "m": (xm, pm)}
    extra: dict[str, dict[int, float]] = {"t": {}, "m": {}}  # pseudo-labels each view was given
    log = []

    def fitted(v):
        x, p = own[v]
        idx = sorted(extra[v])
        labels = np.array([extra[v][i] for i in idx])
        full = np.concatenate([x[tr], p[idx]]) if idx else x[tr]
        weight = np.concatenate([np.ones(tr.sum()), np.full(len(idx), 0.5)])
        return fit_view(full, np.concatenate([y[tr], labels]), weight, x[va], y[va])

    views = {v: fitted(v) for v in own}
    for _ in range(s.rounds if len(pt) else 0):
        given = {}
        for v, other in (("t", "m"), ("m", "t")):
            p = 1 / (1 + np.exp(-views[v].logit(own[v][1])))
            new = 0
            for label, sure, rate in ((1.0, p, m.base), (0.0, 1 - p, 1 - m.base)):
                most = int(np.ceil(s.share * rate * len(p)))
                order = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= s.confident and i not in extra[other]]
                for i in order[:most]:
                    extra[other][int(i)] = label
                    new += 1
            given[v] = new
        log.append((given["t"], given["m"]))
        if not any(given.values()):
            break
        views = {v: fitted(v) for v in own}
    m.text, m.meta = views["t"], views["m"]
    z = np.column_stack([m.text.logit(xt[va]), m.meta.logit(xm[va])])
    m.mixed = _newton(z, y[va], np.ones(va.sum()), 0.05)
    m.mixed[:2] = np.maximum(m.mixed[:2], 0)
    m.rounds = tuple(log)
    p = m.score(xt[va], xm[va])[2]
    good = np.sort(p[y[va] == 1])
    # the largest cut that keeps the wanted share of good rows, never above an even chance
    m.cut = float(min(0.5, good[int((1 - s.keep_clean) * len(good))]))
    return m


def _with_meta(docs: DataFrame) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    cols = [F.col(c).cast("double" if c == "n_chars" else "string").alias(c) if c in have
            else F.lit(None).cast("double" if c == "n_chars" else "string").alias(c) for c in META]
    return docs.select("doc_id", "text", *cols)


def _features(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., t binary, m binary): feature vectors computed in the tasks."""
    fields = [rows.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("t", T.BinaryType()), T.StructField("m", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = text_features(b.column("text"))
            m = meta_features({c: b.column(c).to_pylist() for c in META})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x.tobytes() for x in t], pa.binary()),
                                              pa.array([x.tobytes() for x in m], pa.binary())], [*keep, "t", "m"])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Model:
    s = s or Settings()
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
           .agg(F.min("quality").cast("int").alias("_y")))
    h = F.xxhash64("doc_id")
    picked = one.orderBy(h, "doc_id").limit(s.max_labelled)  # a bounded heap per task
    base = _with_meta(docs)
    known = base.join(F.broadcast(picked), "doc_id")
    pool = base.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(s.max_pool)
    pool = pool.distinct().join(F.broadcast(picked.select("doc_id")), "doc_id", "left_anti")
    free = base.join(F.broadcast(pool), "doc_id")
    lab = _features(known, "doc_id", "_y").select("_y", "t", "m", (F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0).alias("back"),
                                                  F.xxhash64("doc_id").alias("h"), "doc_id").collect()
    una = _features(free, "doc_id").select("t", "m", F.xxhash64("doc_id").alias("h"), "doc_id").collect()
    lab, una = sorted(lab, key=lambda r: (r["h"], str(r["doc_id"]), r["t"])), sorted(una, key=lambda r: (r["h"], str(r["doc_id"]), r["t"]))

    def grid(rows, c):
        return np.stack([np.frombuffer(r[c], np.float32) for r in rows]) if rows else np.zeros((0, 1), np.float32)

    return co_train(grid(lab, "t"), grid(lab, "m"), [r["_y"] for r in lab], [r["back"] for r in lab],
                    grid(una, "t"), grid(una, "m"), s)


def score_documents(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, score_text, score_meta, score (probability of good quality) and kept of every document."""
    base = _with_meta(docs)
    schema = T.StructType([base.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in ("score_text", "score_meta", "score")),
                           T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = m.score(text_features(b.column("text")), meta_features({c: b.column(c).to_pylist() for c in META}))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= m.cut)],
                                                 ["doc_id", "score_text", "score_meta", "score", "kept"])

    return base.mapInArrow(run, schema)


def keep_good(docs: DataFrame, m: Model) -> DataFrame:
    """The rows of ``docs`` the model keeps, all columns unchanged (judged row by row, so repeated keys are safe)."""
    names = docs.columns
    at = {c: next((i for i, x in enumerate(names) if x.lower() == c), None) for c in META}
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                meta = {c: [None] * b.num_rows if i is None else b.column(i).to_pylist() for c, i in at.items()}
                keep = m.score(text_features(b.column(text)), meta_features(meta))[2] >= m.cut
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
