"""Secret scans over a trigram inverted index.

Each rule's regular expression is read with the standard library's parser and turned into a Boolean query over
trigrams that every match must hold. Documents are indexed in segments of bounded size (trigram -> sorted document
numbers, over text with A-Z lower-cased); the query's postings are intersected and united, and only the documents
left are verified with the expression itself. A rule without mandatory trigrams (hex digits alone) scans all.

Spans count code points, end exclusive; matches of a rule are leftmost and don't overlap.

Defined results: null and empty texts give no spans; long texts are scanned whole; repeated rows give repeated
rows; an empty table gives none; other columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SEGMENT_BYTES = 4 << 20
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Kept only if this group is at least so long.
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
ADDED = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("pay", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("map", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^/:@\x00-\x20]+:[^/:@\x00-\x20]+@"),
)

# A query is True (all documents), a trigram, or ("and" | "or", queries).


def _join(op: str, parts: list):
    if op == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]):
    """Query of a text that holds one of the strings."""
    options = []
    for s in sorted(strings):
        raw = s.encode()
        options.append(_join("and", [raw[i : i + 3] for i in range(len(raw) - 2)]))
    return _join("or", options)


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all lower-cased strings a tree matches, or None where they are many; query)."""
    exact: set[str] | None = {""}
    run, queries = {""}, []
    for op, arg in tree:
        found, query = _node(op, arg)
        if found is not None and len(found) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in found}
            exact = None if exact is None else run
            continue
        exact = None
        queries.append(_of_strings(run))
        if found is not None:
            run = found
        else:
            queries.append(query)
            run = {""}
    queries.append(_of_strings(run))
    return (run if exact is not None else None), _join("and", queries)


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, True
    if op is K.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                chars.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars if len(chars) <= 8 else None), True
    if op is K.SUBPATTERN:
        return _walk(arg[3])
    if op is K.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        query = _join("or", [q if e is None else _of_strings(e) for e, q in parts])
        united = None if any(e is None for e, _ in parts) else set().union(*(e for e, _ in parts))
        return (united if united is not None and len(united) <= MOST_STRINGS else None), query
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, getattr(K, "POSSESSIVE_REPEAT", K.MAX_REPEAT)):
        least, most, body = arg
        found, query = _walk(body)
        if found is not None and most == 1:
            return (found | {""} if least == 0 else found), True
        if found is not None and least == most and len(found) ** least <= MOST_STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in found}
            return out, True
        return None, True if least == 0 else (query if found is None else _of_strings(found))
    if op is K.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """Trigrams (bytes, lower case) that a text with a match must hold, or True where nothing is mandatory."""
    exact, query = _walk(_parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def trigrams_of(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """Postings of the wanted trigrams over some texts."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.n = len(texts)
        # Two zero bytes part the documents, so no trigram spans two of them unless it holds a zero byte.
        data = np.frombuffer(b"\0\0".join([t.lower() for t in texts]) + b"\0\0", np.uint8)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        codes = data[:-2].astype(np.uint32)
        codes <<= 8
        codes |= data[1:-1]
        codes <<= 8
        codes |= data[2:]
        at = np.flatnonzero(table[codes])
        doc = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique(codes[at].astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64))
        keys, places = np.unique(pairs >> np.uint64(32), return_index=True)
        docs = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.postings = {int(k): p for k, p in zip(keys, np.split(docs, places[1:]), strict=True)} if len(keys) else {}

    def matching(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.empty(0, np.int64))
        parts = [self.matching(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def scanner(rules: tuple[Rule, ...]) -> Callable[[list[str | None]], list[list[tuple[int, int, int]]]]:
    """texts -> for each its (start, number of the rule, end), sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    # A long run is the only way to a long match of a bare repeated class: then the length is part of the search.
    direct = [re.compile(r.pattern[:-1] + f"{{{r.least},}}") if r.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", r.pattern) else None for r in rules]
    compiled = [re.compile(r.pattern) for r in rules]
    table = np.zeros(1 << 24, bool)
    for q in queries:
        for t in trigrams_of(q):
            table[int.from_bytes(t, "big")] = True

    def scan(texts):
        found: list[list] = [[] for _ in texts]
        segment = Segment([(t or "").encode("utf-8", "surrogatepass") for t in texts], table)
        for k, rule in enumerate(rules):
            finder = direct[k] or compiled[k]
            for d in segment.matching(queries[k]).tolist():
                if texts[d]:
                    for m in finder.finditer(texts[d]):
                        a, b = m.span(rule.group)
                        if b - a >= rule.least:
                            found[d].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found

    return scan


def segments(column: pa.Array, most: int = SEGMENT_BYTES) -> Iterator[list[str | None]]:
    from .tokens import slices

    for a, b in slices(column, most):
        yield a, b


def spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) of every document, sorted by start and then by the rules' order."""

    def run(batches):
        scan = scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for a, b in segments(batch.column(1)):
                found = scan(batch.column(1).slice(a, b - a).to_pylist())
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(kind))], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, from the operator's spans."""
    names = [r.kind for r in BASE]

    def run(batches):
        for batch in batches:
            rows = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in x] for x in batch.column(1).to_pylist()]
            base = [[s for s in x if s.partition(":")[0] in names] for x in rows]
            count = [pa.array([sum(s.startswith(k + ":") for s in x) for x in base], pa.int64()) for k in names]
            sha = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in base])
            yield pa.RecordBatch.from_arrays([batch.column(0), *count, sha, pa.array([",".join(x) for x in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.arrow(spans(docs), run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
