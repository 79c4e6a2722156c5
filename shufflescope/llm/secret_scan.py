"""Secret scans: fixed patterns, and random-looking strings found by their token efficiency.

Natural words cost a byte-level BPE vocabulary few tokens for their length; random strings cost many.  A candidate run
of ``[A-Za-z0-9+/_=-]`` of ``MIN_CHARS`` or more is a ``random`` span if it has under ``CHARS_PER_TOKEN`` characters a
token and is neither a known digest (hex of a digest's length), a UUID, an integer, nor an identifier made of words
(snake, kebab, camel case or a path of them).  Words are told from chance by the vocabulary too: in lower case they
have ``WORD_CHARS_PER_TOKEN`` letters a token or more.

Null texts count as empty.  Each input row gives one row (no spans: empty string, the digest of the empty string);
spans are in code points, end exclusive, ordered by start, then assign, access, hex, random.  Base patterns always
stay; the method only adds ``random`` spans, and none inside a base span.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_batches, documents, record_batch, small_batches, text_rows
from .encoders import path_of

KINDS = ("assign", "access", "hex", "random")
MIN_CHARS, CHARS_PER_TOKEN, WORD_CHARS_PER_TOKEN = 20, 2.0, 2.5
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Every match of _ASSIGN holds one of these; a text without them is not searched.
_ASSIGN_WORDS = ("passw", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 characters or more
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
#: Lengths of the hexadecimal digests in common use: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_KNOWN = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d+|[-_=+/]+", re.I | re.A)
#: A part of an identifier: a word, perhaps with a capital and a short number after it.
_PART = re.compile(r"[A-Z]?[a-z]{2,}\d{0,4}|[A-Z]{2,}\d{0,4}|[a-z]\d{0,4}|\d{1,4}")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@functools.cache
def vocabulary(file: str):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def looks_random(s: str, tokens) -> bool:
    if len(s) in _DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) or _KNOWN.fullmatch(s):
        return False
    parts = [p for q in re.split(r"[-_/=+]+", s) if q for p in _CAMEL.split(q)]
    if all(_PART.fullmatch(p) for p in parts) and sum(map(len, parts)) >= 3.5 * len(parts):
        words = re.findall("[a-z]+", " ".join(parts).lower())
        if sum(map(len, words)) >= WORD_CHARS_PER_TOKEN * sum(len(tokens.encode_ordinary(f" {w}")) for w in words):
            return False
    return len(s) / len(tokens.encode_ordinary(s)) < CHARS_PER_TOKEN


def scan(text: str, tokens) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of all spans, in order."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = list(found)
    for m in _RUN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, _, b in base) and looks_random(m[0], tokens):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
_DDL = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def _row(doc_id, spans):
    said = lambda keep: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < keep)
    counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
    return (doc_id, *counts, hashlib.sha256(said(3).encode()).hexdigest(), said(4))


def secret_spans(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    file = ranks or path_of("byte_bpe_50k.tiktoken")

    def find(batches):
        tokens = vocabulary(file)
        for ids, texts in doc_batches(batches):
            yield record_batch(_OUT, *zip(*(_row(i, scan(t, tokens)) for i, t in zip(ids, texts, strict=True)), strict=True))

    return text_rows(docs).mapInArrow(find, _DDL)


def redact(text: str, tokens) -> str:
    """The text with each span replaced by <SECRET>; spans that overlap become one."""
    out, at, upto = [], 0, -1
    for a, _, b in scan(text, tokens):
        if a >= upto:
            out += [text[at:a], "<SECRET>"]
        upto = at = max(b, upto)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, ranks: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all other columns, rows and null texts stay as they are."""
    small_batches(docs.sparkSession)
    file = ranks or path_of("byte_bpe_50k.tiktoken")
    at = docs.columns.index(column)

    def clean(batches):
        tokens = vocabulary(file)
        for batch in batches:
            done = [None if t is None else redact(t, tokens) for t in batch.column(at).to_pylist()]
            columns = [pa.array(done, type=batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
