"""Operator 2, secret scans: base patterns plus credentials linked from several parts.

Parts of a credential (identifier, secret, endpoint) are found with their code
point spans. Strong parts are reported as they are. Weak parts are reported only
where complementary parts co-occur: an interval join within a scope (a paragraph: text
between blank lines) finds parts of other roles. A weak secret needs an identifier or
an endpoint, a weak identifier needs a secret, an endpoint needs a secret and an
identifier; parts that complete one another share no character. A weak secret within
an endpoint (a key in an ordinary URL) needs an identifier: another URL is no complement.
Within an endpoint, ``/`` ends an opaque token.

The join needs no pairs: a part has a disjoint partner in its scope if one ends before
it begins or begins behind its end, so the least end and the greatest start of a role
in a scope decide. For endpoints the same holds of disjoint pairs of a secret and an
identifier.

Defined results: null text is empty; empty texts have no spans (the digest of an
empty string); an empty table gives no rows; rows are scanned one by one, so repeated
rows get equal results; very long texts are scanned whole, in time that grows with
their length; spans that start together are ordered by kind, then end; extra columns
are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

Span = tuple[int, int]
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds of the base, in their order.
BASE = ("assign", "access", "hex")
#: Kinds that the method may add.
WEAK = ("weak_secret", "weak_id", "endpoint")
#: Least code points of an opaque token.
OPAQUE = 20

_WEAK_ID = re.compile(r"(?:user(?:name)?|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.A | re.I)
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{4,}|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:-]{4,}", re.A | re.I)
_OPAQUE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{{OPAQUE},}}={{0,2}}(?![A-Za-z0-9+/_=-])")
_BLANK = re.compile(r"\n[ \t]*\n")
_MIXED = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]")
_NEVER, _AFTER = -1, 1 << 62


def base_spans(text: str) -> dict[str, list[Span]]:
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def _opaque(token: str) -> bool:
    """Lower and upper case letters, and digits that touch letters: as keys have, and words, titles and years have not."""
    return bool(_MIXED.search(token)) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class Spans:
    """Spans by start, with running maxima of their ends."""

    def __init__(self, spans: list[Span]):
        self.all = sorted(spans)
        self.starts, self.reach = [s for s, _ in self.all], list(accumulate((e for _, e in self.all), max))

    def meets(self, start: int, end: int) -> bool:
        """Whether a span shares a character with start:end."""
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def _opaque_spans(text: str, tokens: list[Span], ends: Spans) -> list[Span]:
    """Tokens that are opaque; those that meet an endpoint are cut at slashes."""
    out = []
    for s, e in tokens:
        if "/" in text[s:e] and ends.meets(s, e):
            pieces = [(s + p.start(), s + p.end()) for p in re.finditer("[^/]+", text[s:e])]
        else:
            pieces = [(s, e)]
        out += [(a, b) for a, b in pieces if b - a >= OPAQUE and _opaque(text[a:b]) and not text.startswith("AKIA", a)]
    return out


class Scope:
    """What decides about partners within one scope: a role's least end and greatest start."""

    def __init__(self, secrets: list[Span], ids: list[Span], ends: list[Span]):
        self.first, self.last = {}, {}
        for role, spans in (("secret", secrets), ("id", ids), ("endpoint", ends)):
            self.first[role] = min((e for _, e in spans), default=_AFTER)
            self.last[role] = max((s for s, _ in spans), default=_NEVER)
        # disjoint pairs of a secret and an identifier: the least end and the greatest start of all of them
        two = ((secrets, "id"), (ids, "secret"))
        self.pair_end = min((e for spans, other in two for s, e in spans if s >= self.first[other]), default=_AFTER)
        self.pair_start = max((s for spans, other in two for s, e in spans if e <= self.last[other]), default=_NEVER)

    def has(self, role: str, span: Span) -> bool:
        """Whether a part of the role shares no character with the span."""
        return self.first[role] <= span[0] or self.last[role] >= span[1]

    def has_pair(self, span: Span) -> bool:
        """Whether a secret and an identifier, disjoint from one another, share no character with the span."""
        around = self.first["secret"] <= span[0] and self.last["id"] >= span[1] or self.first["id"] <= span[0] and self.last["secret"] >= span[1]
        return around or self.pair_end <= span[0] or self.pair_start >= span[1]


def weak_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Weak parts that complementary parts of their scope complete."""
    short = [m.span() for m in _ASSIGN.finditer(text) if 6 <= m.end(2) - m.start(2) < 12]
    tokens = [m.span() for m in _OPAQUE.finditer(text) if _opaque(m[0])]
    if not (base["assign"] or base["hex"] or short or tokens):  # every weak part needs a secret
        return {k: [] for k in WEAK}
    taken = Spans([s for kind in BASE for s in base[kind]])
    free = lambda spans: sorted(s for s in spans if not taken.meets(*s))
    endpoint = free(m.span() for m in _ENDPOINT.finditer(text))
    ends = Spans(endpoint)
    weak_secret = free(short + _opaque_spans(text, tokens, ends))
    weak_id = free(m.span() for m in _WEAK_ID.finditer(text))
    edges = [0, *(m.end() for m in _BLANK.finditer(text))]
    inside: dict[int, tuple[list[Span], list[Span], list[Span]]] = {}
    for role, spans in enumerate((base["assign"] + base["hex"] + weak_secret, base["access"] + weak_id, endpoint)):
        for s in spans:
            inside.setdefault(bisect_right(edges, s[0]), ([], [], []))[role].append(s)
    scopes = {k: Scope(*parts) for k, parts in inside.items()}
    scope = lambda s: scopes[bisect_right(edges, s[0])]
    return {
        "weak_secret": [s for s in weak_secret if scope(s).has("id", s) or not ends.meets(*s) and scope(s).has("endpoint", s)],
        "weak_id": [s for s in weak_id if scope(s).has("secret", s)],
        "endpoint": [s for s in endpoint if scope(s).has_pair(s)],
    }


def _joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    rows = sorted((s, k, e) for k, kind in enumerate(kinds) for s, e in spans[kind])
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in rows)


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    digest = hashlib.sha256(_joined(base, BASE).encode()).hexdigest()
    spans = _joined(base | weak_spans(text, base), BASE + WEAK)
    return len(base["assign"]), len(base["access"]), len(base["hex"]), digest, spans


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and spans (``kind:start:end`` by start, comma-joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py()) for t in batch.column(1)]
            cols = [batch.column(0), *(zip(*found, strict=True) if found else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if k else c for k, (c, f) in enumerate(zip(cols, _SCHEMA, strict=True))], schema=_SCHEMA)

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """text with every reported span replaced by mark; overlapping spans are replaced together."""
    spans = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in scan_text(text)[4].split(",") if x))
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with spans redacted in ``text``; ``n_chars``, where there is one, follows the text. Null text stays null."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else redact_text(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = text_batches(docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op2's base, which SQL can tell (places it can't)."""
    return op2_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
ORACLE = {
    "secret_counts": rf"""
    with t as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id, len(list_filter(regexp_extract_all(text, '(?:{_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 12)) as n_assign,
      len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) as n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 16)) as n_hex from t
    """
}
