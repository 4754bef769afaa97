"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Patterns report what they match (kinds ``assign``, ``access``, ``hex``).  The
novelty pass looks at every other token-like string that has a word of
sensitive context shortly before or after it.  Its novelty is its marginal cost: the
compressed bytes of (surrounding text + candidate) less those of the
surrounding text alone, with a dictionary of code identifiers primed in.  Known
identifiers, repeats of the surroundings and natural-language pieces cost
little; key material costs about its own length and is reported (``novel``).
A long candidate is judged in pieces, since over many characters the entropy
coder learns any alphabet; it is reported whole when a piece is novel.  What a
piece must cost falls with the alphabet that the whole candidate keeps to.

One narrow scan, no shuffle; a task holds one Arrow batch.  Positions are code
points of the whole text, end exclusive.  Defined results: NULL text counts as
empty, an empty text has no spans, repeated rows give repeated results, an
empty table gives an empty table, other columns pass through ``redact``
unchanged whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "novel")

# The three base patterns.  Letters of the keywords match in either case (ASCII only).
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Words that make their surroundings sensitive.
CONTEXT = re.compile(r"(?ai:passw(?:or)?d|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key"
                     r"|credential|bearer|signature|client[ _-]?id|auth[ _-]?(?:key|code))")
#: Each alternative of ``CONTEXT`` holds one of these.
_STEMS = ("passw", "passphrase", "pwd", "secret", "token", "api", "access", "private", "credential", "bearer", "signature",
          "client", "auth")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
REACH, AROUND, NOVELTY, PIECE = 48, 256, 0.9, 24
#: Hexadecimal digits hold half a byte each.
UPPER_HEX, HEX_NOVELTY = re.compile(r"[0-9A-F]+"), 0.5

# Identifiers that primed compression treats as known.
IDENTIFIERS = (
    "import from return class function const static public private void string number boolean default export require "
    "self this None null true false undefined print console.log logger.info logging.getLogger os.environ.get process.env "
    "config.get settings.py application.properties username password passwd secret token api_key apikey access_key_id "
    "secret_access_key client_secret client_id refresh_token access_token session_token authorization bearer signature "
    "private_key public_key BEGIN RSA PRIVATE KEY example placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 https://www.example.com/index.html "
    "request.headers response.status_code getElementById addEventListener constructor prototype toString parseInt "
    "SELECT FROM WHERE INSERT INTO VALUES UPDATE DELETE CREATE TABLE PRIMARY KEY localhost 127.0.0.1 ")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False)


def novelty(around: str, candidate: str, known: int | None = None) -> float:
    """Marginal compressed bytes of ``candidate`` after ``around``, per byte of it (``known``: compressed bytes of ``around``)."""
    z = _compressor()
    before, extra = around.encode("utf-8", "replace"), candidate.encode()
    return (len(z.compress(before + extra)) - (len(z.compress(before)) if known is None else known)) / len(extra)


def _mentions(low: str, stems: tuple[str, ...]) -> bool:
    """Whether a lower-cased text holds a stem (a plain search, so most texts skip the slow patterns)."""
    return any(s in low for s in stems)


def base_spans(text: str, low: str | None = None) -> list[tuple[str, int, int]]:
    out = []
    if _mentions(text.lower() if low is None else low, ("passw", "secret", "token", "api")):
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # Runs of 16 and more: a shorter run matches nothing, a longer one is taken whole.
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def is_novel(around: str, word: str, least: float = NOVELTY) -> bool:
    """Whether some piece of about ``PIECE`` characters costs what key material of the word's alphabet costs."""
    if UPPER_HEX.fullmatch(word):
        least = min(least, HEX_NOVELTY)
    cut = max(1, len(word) // PIECE)
    edge = [len(word) * i // cut for i in range(cut + 1)]
    known = len(_compressor().compress(around.encode("utf-8", "replace")))
    pieces = dict.fromkeys(word[x:y] for x, y in zip(edge, edge[1:]))  # equal pieces cost the same
    return any(novelty(around, p, known) >= least for p in pieces)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _gaps(a: int, b: int, spans: list[tuple[int, int]], ends: list[int]) -> list[tuple[int, int]]:
    """The parts of [a, b) that no span covers (``spans``: disjoint and in order, ``ends``: their ends)."""
    out = []
    for i in range(bisect_right(ends, a), len(spans)):
        x, y = spans[i]
        if x >= b:
            break
        if x > a:
            out.append((a, x))
        a = max(a, y)
    return [*out, (a, b)] if a < b else out


def novel_spans(text: str, known: list[tuple[str, int, int]], least: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Incompressible token-like strings at most ``REACH`` characters after or before a sensitive word.

    Sensitive words split the runs of token characters; each part of 16 and more characters is judged once, so the
    time grows with the text, however many sensitive words one run holds.
    """
    context = [c.span() for c in CONTEXT.finditer(text)]
    if not context:
        return []
    begins, ends = [a for a, _ in context], [b for _, b in context]
    taken = _merged([(a, b) for _, a, b in known])
    taken_ends = [b for _, b in taken]
    found = []
    for run in CANDIDATE.finditer(text):
        for a, b in _gaps(run.start(), run.end(), context, ends):
            before, after = bisect_right(ends, a) - 1, bisect_left(begins, b)
            near = before >= 0 and a - ends[before] <= REACH or after < len(begins) and begins[after] - b <= REACH
            if b - a < 16 or not near:
                continue
            rest = "".join(text[x:y] for x, y in _gaps(a, b, taken, taken_ends))
            if len(rest) < 16 and not re.search("[0-9]", rest):
                continue  # reported already, but for a name or a sign
            word = text[a:b]
            if re.search("[0-9]", word) and re.search("[A-Za-z]", word) and is_novel(
                    text[max(0, a - AROUND):a] + text[b:b + AROUND], word, least):
                found.append(("novel", a, b))
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then by kind as listed in ``KINDS``."""
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    more = novel_spans(text, base) if _mentions(low, _STEMS) else []
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every span of every document, ordered by start, then kind."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": x, "end": y} for k, x, y in find_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, shape)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, a, b in find_spans(text):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; all columns stay (NULL text stays NULL)."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            new = [None if (s := t.as_py()) is None else redacted(s, mark) for t in b.column(at)]
            cols[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def digests(spans: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and the text of all spans."""
    def joined(keep):
        s = F.filter("spans", keep) if keep else F.col("spans")
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")

    def count(k):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    return spans.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(lambda x: x["kind"] != "novel"), 256).alias("base_sha256"), joined(None).alias("spans"),
                        count("novel"))
