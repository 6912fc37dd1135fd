"""Secret scans through a trigram inverted index."""

from __future__ import annotations

import hashlib
import re
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import pieces, rows_of

#: Kind, pattern (bytes; letters are ASCII), flags, least length, group that the length is of. Order is the order of kinds.
RULES = (
    ("assign", rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I, 12, 2),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18, 0),
    ("hex", rb"[0-9a-f]+", 0, 16, 0),
    ("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, 0),
    ("bearer", rb"bearer\x20+[A-Za-z0-9._~+/=-]+", re.I, 23, 0),
    ("webtoken", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, 0),
)
BASE_KINDS = 3


def trigram_query(tree, flags: int):
    """A Boolean query that every match's text satisfies: ('and'|'or', [...]) over lower-case trigrams; None means any text."""

    def both(parts):
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)

    def literal(run):
        low = bytes(run).lower()
        return both([low[i : i + 3] for i in range(len(low) - 2)])

    found, run = [], []

    def flush():
        if run:
            found.append(literal(run))
            run.clear()

    for op, arg in tree:
        if op is K.LITERAL and arg < 256:
            run.append(arg)
        elif op is K.SUBPATTERN:
            inner = list(arg[3])
            if all(o is K.LITERAL for o, _ in inner):
                run.extend(a for _, a in inner)
            else:
                flush()
                found.append(trigram_query(inner, flags))
        elif op is K.BRANCH:
            flush()
            options = [trigram_query(list(x), flags) for x in arg[1]]
            found.append(None if any(o is None for o in options) else ("or", options))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
            flush()
            found.append(trigram_query(list(arg[2]), flags))
        else:
            flush()
    flush()
    return both(found)


def _trigrams(query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Scanner:
    """Compiled rules, their trigram queries and the table of the trigrams that these name."""

    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(p, f), least, group, trigram_query(_parser.parse(p, f), f)) for kind, p, f, least, group in rules]
        self.rank = {kind: i for i, (kind, *_) in enumerate(rules)}
        grams = sorted(set().union(*(_trigrams(q) for *_, q in self.rules)))
        self.number = {g: i + 1 for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)
        for g, i in self.number.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, data: np.ndarray, offs: np.ndarray) -> dict[int, np.ndarray]:
        """Rows that hold each trigram; a trigram doesn't cross rows."""
        low = self.lower[data].astype(np.uint32)
        if len(low) < 3:
            return {}
        hits = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(hits)
        row = rows_of(at, offs)
        own = at + 3 <= offs[row + 1]
        pairs = np.unique(hits[at[own]].astype(np.int64) << 40 | row[own])
        gram, row = pairs >> 40, pairs & ((1 << 40) - 1)
        cuts = np.searchsorted(gram, np.arange(1, len(self.number) + 2))
        return {g: row[cuts[g - 1] : cuts[g]] for g in range(1, len(self.number) + 1)}

    def candidates(self, query, posts: dict[int, np.ndarray]) -> np.ndarray:
        if isinstance(query, bytes):
            return posts.get(self.number[query], np.zeros(0, np.int64))
        out = None
        for part in query[1]:
            rows = self.candidates(part, posts)
            out = rows if out is None else np.intersect1d(out, rows, True) if query[0] == "and" else np.union1d(out, rows)
        return out

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Spans (start, rule, end) in bytes by row, in order; all kept matches of all rules."""
        n = len(offs) - 1
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        posts = self.postings(data, offs)
        whole = data.tobytes()
        for r, (_, pattern, least, group, query) in enumerate(self.rules):
            rows = np.arange(n) if query is None else self.candidates(query, posts)
            if query is None and pattern.pattern == rb"[0-9a-f]+":
                rows = self._long_runs(data, offs, least)
            for i in rows.tolist():
                text = whole[offs[i] : offs[i + 1]]
                found[i] += [(m.start(), r, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        for spans in found:
            spans.sort()
        return found

    @staticmethod
    def _long_runs(data: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
        """The full scan of the one rule without trigrams: rows with least hex digits in a row, by a pass over every byte."""
        digit = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], digit.view(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        return np.unique(np.concatenate([rows_of(start[(long := end - start >= least)], offs), rows_of(end[long] - 1, offs), *([np.arange(rows_of(a, offs), rows_of(b - 1, offs) + 1) for a, b in zip(start[long], end[long])])])) if len(start) and (end - start >= least).any() else np.zeros(0, np.int64)


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return sorted((int(lead[a]), r, int(lead[b])) for a, r, b in spans)


def _scanned(batches, columns, redact):
    s = scanner()
    kinds = [kind for kind, *_ in s.rules]
    joined = lambda spans: ",".join(f"{kinds[r]}:{a}:{b}" for a, r, b in spans)
    for batch in batches:
        for a, b, data, offs in pieces(batch.column("text")):
            whole, rows = data.tobytes(), s.scan(data, offs)
            carried = [batch.column(c).slice(a, b - a) for c in columns]
            if redact:
                clean = batch.column("text").slice(a, b - a).to_pylist()
                for i, spans in enumerate(rows):
                    if spans:
                        clean[i] = redacted(whole[offs[i] : offs[i + 1]], spans, kinds)
                at = columns.index("text")
                yield pa.RecordBatch.from_arrays([*carried[:at], pa.array(clean, batch.column("text").type), *carried[at + 1 :]], list(columns))
                continue
            rows = [in_code_points(whole[offs[i] : offs[i + 1]], spans) for i, spans in enumerate(rows)]
            base = [[x for x in spans if x[1] < BASE_KINDS] for spans in rows]
            counts = [pa.array([sum(x[1] == r for x in spans) for spans in base], pa.int64()) for r in range(BASE_KINDS)]
            yield pa.RecordBatch.from_arrays(
                [*carried, *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array(list(map(joined, rows)), pa.string())],
                [*columns, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def redacted(text: bytes, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """text with every span, overlapping ones joined, replaced by a mark of its first kind."""
    out, at, merged = [], 0, []
    for a, r, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, r, b])
    for a, r, b in merged:
        out += [text[at:a], f"<{kinds[r]}>".encode()]
        at = b
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def find_secrets(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of every rule in every whole text, in code points, one narrow pass.

    Each run of rows gets an inverted index of the trigrams that the rules' Boolean queries name; postings are
    intersected and united, and only candidates are verified by the regex. A rule without mandatory trigrams
    (hex) reads every byte. Null text counts as empty (no spans); null ids are carried; repeated rows stand
    each for itself; an empty table gives no rows.
    """
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(lambda it: _scanned(it, carry, False), f"{own}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by <kind>; other rows and columns stay as they are."""
    columns = tuple(docs.columns)
    return docs.mapInArrow(lambda it: _scanned(it, columns, True), docs.schema)
