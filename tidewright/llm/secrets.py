r"""Secret scans: keyword automaton, anchored patterns at its hits, checksums last.

One Aho-Corasick pass over a text finds every keyword; a pattern is then tried
only at the places hit, so a clean text costs one automaton pass.  Long
hexadecimal runs have no keyword and are found as byte runs of a whole chunk.
Tokens with an embedded checksum (a base-62 CRC-32 in the last six signs) are
reported only if the checksum holds.

Defined results: a null or empty text has no spans (digest of the empty string);
matches of one kind never overlap, a match that is too short still takes its
place and is then dropped; positions are code points, the end exclusive; a very
long text is scanned whole; repeated rows are scanned alike; an empty table gives
no rows; the scan reads no other columns, redaction keeps them all.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.textkernel import chunks, flat

#: The base kinds' patterns and least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def base62_crc(body: str) -> str:
    """CRC-32 of the token body as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def ascii_lower(text: str) -> str:
    """Lower case for A-Z alone, so that positions stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def keyword_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Spans of all kinds that have a keyword, as (start, end, kind)."""
    out: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KEYWORDS, 0)  # where the kind's last match ended
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(ascii_lower(text)))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m is not None and len(m[2]) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m is not None and len(m[0]) >= ACCESS_LEAST
        else:
            m = CHECKED.match(text, start)
            good = m is not None and base62_crc(m[1]) == m[2]
        if m is not None:
            free[kind] = m.end()
            if good:
                out.append((start, m.end(), kind))
    return out


def hex_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start and end (code points of the text) of each long run of hexadecimal digits."""
    edge = np.zeros(len(buf) + 1, bool)
    inside = np.concatenate([_IS_HEX[buf], [False]])
    edge[off] = True
    edge[0] = True
    edge[1:] |= inside[1:] != inside[:-1]
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = inside[starts] & (ends - starts >= HEX_LEAST) if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(off, starts, "right") - 1
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    return doc, points[starts] - points[off[doc]], points[ends] - points[off[doc]]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every text of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            found = [keyword_spans(t, automaton) if t else [] for t in texts]
            for d, s, e in zip(*(x.tolist() for x in hex_runs(*flat(batch.column(1))))):
                found[d].append((s, e, "hex"))
            base = [[x for x in f if x[2] in KINDS[:3]] for f in found]
            count = [[sum(x[2] == k for x in b) for b in base] for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written(f) for f in found])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows with every span of the text replaced; all other columns stay. Overlapping spans give one mark."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in chunks(batches):
            texts = batch.column(at).to_pylist()
            found = [keyword_spans(t, automaton) if t else [] for t in texts]
            for d, s, e in zip(*(x.tolist() for x in hex_runs(*flat(batch.column(at))))):
                found[d].append((s, e, "hex"))
            for d, spans in enumerate(found):
                if spans:
                    out, done = [], 0
                    for s, e, _ in sorted(spans):
                        if s >= done:
                            out += [texts[d][done:s], mark]
                        done = max(done, e)
                    texts[d] = "".join([*out, texts[d][done:]])
            new = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(columns))], columns)

    return docs.mapInArrow(run, docs.schema)
