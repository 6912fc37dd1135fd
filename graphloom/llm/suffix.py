"""Suffix-array dedup with a run-length index over repeated material."""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import routing
from graphloom.llm.common import BASE, BYTE, U, mix, pieces, prefix, repeated, rows_of, span

#: Length of a match in bytes, and of the substrings that anchor it.
LENGTH, GRAM = 100, 48
#: Bits of an anchor's hash. Segments are asked for if they share it, so it must tell apart all anchors of a large input.
BITS = 40
#: Bits of a position within a slice; the rest of an order key is the anchor's hash.
PLACE = 24
SLICE = 1 << 20
#: Bytes that one index is built over, or one group of segments with a common anchor.
INDEXED = 1 << 20


def segments(batch, hot):
    """Runs of byte windows with a common anchor: the leftmost least substring of GRAM bytes in each window.

    With each run the bytes, its place there and its width. Windows of hot anchors are runs of their own.
    """
    for a, b, data, offs in pieces(batch.column("text")):
        keys = batch.column("key").slice(a, b - a).to_numpy(zero_copy_only=False)
        if len(data) <= SLICE:
            yield _segments(data, offs, keys, 0, hot)
        else:  # a single long text, in slices that overlap by a window less a byte
            for at in range(0, len(data), SLICE):
                part = data[at : at + SLICE + LENGTH - 1]
                yield _segments(part, np.array([0, len(part)]), keys, at, hot)


def _segments(data, offs, keys, base, hot):
    empty = {k: np.zeros(0, np.int64) for k, _ in routing.FIELDS}, (data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))
    width, count = LENGTH - GRAM + 1, len(data) - LENGTH + 1
    if count <= 0:
        return empty
    sums = prefix(BYTE[data], BASE)
    at = np.arange(len(data) - GRAM + 1)
    grams = span(sums, at, at + GRAM, BASE)
    least = (grams & ~U((1 << PLACE) - 1)) | at.astype(U)
    done = 1
    while done < width:  # least[i] becomes the least of the next width keys
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    anchor = (least & U((1 << PLACE) - 1)).astype(np.int64)[:count]
    start = at[:count]
    row = rows_of(start, offs)
    whole = start + LENGTH <= offs[row + 1]
    start, anchor, row = start[whole], anchor[whole], row[whole]
    if not len(start):
        return empty
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    n = np.diff(np.append(head, len(start)))
    first, row = start[head], row[head]
    # an anchor is the least of many by its upper bits, which are near zero therefore: they are mixed again
    rows = {"h": (mix(grams[anchor[head]]) >> U(64 - BITS)).astype(np.int64), "s": span(sums, first, first + n + LENGTH - 1, BASE), "key": keys[row], "start": first - offs[row] + base, "n": n}
    return routing.spread(rows, hot, lambda of, step: span(sums, first[of] + step, first[of] + step + LENGTH, BASE), (data, first, n + LENGTH - 1), bits=BITS)


def content(text: bytes, start: np.ndarray, n: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist())]


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of segments, for matches of up to LENGTH bytes.

    Suffixes stand by their first LENGTH bytes, then by place in the text, so that the strings of one interval
    stand from first to last. Kept are the runs of equal preceding bytes, with the counts that give a rank within
    them and the text position at each run's front end, and the bounds of intervals one byte short of LENGTH. A run
    also ends where the interval of a repeated string begins; so its first place is the position at a run's end.
    """

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64)
        total = int(sizes.sum()) + len(parts)
        self.ends = np.cumsum(sizes + 1) - 1  # place of each part's end mark
        self.heads = self.ends - sizes
        code = np.zeros(total, np.int64)
        real = np.ones(total, bool)
        real[self.ends] = False
        code[real] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
        self.code, self.sizes = code, sizes
        left = np.repeat(self.ends, sizes + 1) - np.arange(total)  # bytes up to the end mark

        def ahead(values, k):
            out = np.zeros(total, np.int64)
            out[: total - k] = values[k:]
            out[left < k] = 0
            return out

        rank = np.zeros(total, np.int64)
        for k in range(7):
            rank = rank << 9 | ahead(code, k)
        known = 7
        while True:
            order = np.argsort(rank)
            s = rank[order]
            rank = np.empty(total, np.int64)
            rank[order] = np.cumsum(np.append(True, s[1:] != s[:-1]))
            if known * 2 >= LENGTH:
                break
            rank = rank << 32 | ahead(rank, known)
            known *= 2
        places = rank << 32 | ahead(rank, LENGTH - known)
        order = np.argsort(places, kind="stable")
        s = places[order]
        full = left[order] >= LENGTH
        group = np.append(True, s[1:] != s[:-1])
        starts = np.flatnonzero(group)
        many = np.diff(np.append(starts, total)) > 1
        heads = starts[many & full[starts]]
        shorter = (rank << 32 | ahead(rank, LENGTH - 1 - known))[order]
        self.bounds = np.append(np.flatnonzero(np.append(True, shorter[1:] != shorter[:-1])), total)
        before = np.where(np.isin(order, self.heads), 0, code[order - 1])
        ends = np.append(True, before[1:] != before[:-1])
        ends[heads] = True
        run = np.flatnonzero(ends)
        self.sample_at, self.sample = run, order[run]
        length = np.diff(np.append(run, total))
        by_code = np.lexsort((run, before[run]))
        run, length, kind = run[by_code], length[by_code], before[run][by_code]
        self.runs, self.lengths = (kind << 40) | run, length
        cum = np.cumsum(length) - length
        self.cum = cum - cum[np.searchsorted(kind, kind)]
        self.first = np.searchsorted(np.sort(code), np.arange(258))
        self.total = total

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c precedes a suffix among the first i."""
        at = np.searchsorted(self.runs, (c << 40) | i) - 1
        own = (at >= 0) & (self.runs[at] >> 40 == c)
        return np.where(own, self.cum[at] + np.minimum(i - (self.runs[at] & ((1 << 40) - 1)), self.lengths[at]), 0)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Part and offset of windows that also start earlier, by matching statistics of all parts side by side.

        Each part is read from its end; its interval takes one byte at a time and, once LENGTH long, is told by the
        interval's sample whether the string starts earlier, and gives up its last byte.
        """
        parts = np.argsort(-self.sizes, kind="stable")
        lo, hi = np.zeros(len(parts), np.int64), np.full(len(parts), self.total, np.int64)
        sizes, out = self.sizes[parts], []
        for step in range(int(self.sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -step, "left"))  # parts longer than step
            lo, hi = lo[:live], hi[:live]
            place = self.ends[parts[:live]] - 1 - step
            c = self.code[place]
            lo, hi = self.first[c] + self._rank(c, lo), self.first[c] + self._rank(c, hi)
            if step >= LENGTH - 1:
                some = np.flatnonzero(hi - lo > 1)
                if len(some):
                    earliest = self.sample[np.searchsorted(self.sample_at, lo[some])]
                    some = some[earliest < place[some]]
                    out.append((parts[some], place[some] - self.heads[parts[some]]))
                k = np.searchsorted(self.bounds, lo, "right")
                lo, hi = self.bounds[k - 1], self.bounds[k]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def anchors(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Offset of the anchor in each segment: the leftmost least of its substrings of GRAM bytes."""
    out = np.zeros(len(at), np.int64)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, "right")) - 1)
        lo, hi = at[a], at[b - 1] + n[b - 1] + LENGTH - 1
        sums = prefix(BYTE[flat[lo:hi]], BASE)
        places = np.arange(hi - lo - GRAM + 1)
        order = (span(sums, places, places + GRAM, BASE) & ~U((1 << PLACE) - 1)) | places.astype(U)
        begin = at[a:b] - lo
        cuts = np.stack([begin, begin + n[a:b] + LENGTH - GRAM], 1).ravel()
        least = np.minimum.reduceat(np.append(order, ~U(0)), cuts)[::2]
        out[a:b] = (least & U((1 << PLACE) - 1)).astype(np.int64) - begin
        a = b
    return out


def halved(flat: np.ndarray, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of segments (at, h, key, start, n) that may share windows, by a longer anchor.

    A window holds more than its anchor: half of what is left of its LENGTH lies right of the anchor, or else left
    of it. By which, a segment is cut in two with an anchor longer by that half. Parts whose longer anchor is no
    other's hold no repeat and are left out; nothing is decided on the others.
    """
    at, n, start = rows["at"], rows["n"], rows["start"]
    m, half = anchors(flat, at, n), (LENGTH - GRAM) // 2
    first = np.maximum(0, m - (LENGTH - GRAM - half))
    right, left = first < n, first > 0
    both = lambda a, b: np.concatenate([a[right], b[left]])
    parts = {"at": both(at + first, at), "h": both(rows["h"], rows["h"]), "key": both(rows["key"], rows["key"]), "start": both(start + first, start), "n": both(n - first, np.minimum(n, first))}
    core = both(at + m, at + m - half)
    sums = prefix(BYTE[flat], BASE)
    parts["anchor"] = span(sums, core, core + GRAM + half, BASE)
    many, _ = repeated(parts["anchor"])
    parts = {k: v[many] for k, v in parts.items()}
    parts["s"] = span(sums, parts["at"], parts["at"] + parts["n"] + LENGTH - 1, BASE)
    return parts


def compare(rows, blobs):
    """Repeated windows among segments with a common anchor: byte-equal ones are merged, and an index tells of the rest.

    An index is built over different segments of whole groups of one anchor at a time, and all of them are
    streamed through it; what it finds in the first of equal segments holds for all, which are marked already.
    """
    order = np.lexsort((rows["start"], rows["key"], rows["h"]))
    h = rows["h"][order]
    size = np.array([len(blobs[i]) for i in order], np.int64)
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    ends = np.append(heads[1:], len(h))
    upto = np.cumsum(size)
    a = 0
    while a < len(heads):  # whole groups of one anchor
        begin = upto[heads[a]] - size[heads[a]]
        b = max(a + 1, int(np.searchsorted(upto[ends - 1], begin + 4 * INDEXED, "right")))
        own = order[heads[a] : ends[b - 1]]
        flat = np.frombuffer(b"".join(blobs[i] for i in own), np.uint8)
        width = size[heads[a] : ends[b - 1]]
        at = upto[heads[a] : ends[b - 1]] - width - begin
        part = {"at": at, "s": span(prefix(BYTE[flat], BASE), at, at + width, BASE), "h": rows["h"][own], "key": rows["key"][own], "start": rows["start"][own], "n": rows["n"][own]}
        left, marks = merged_equals(flat, part)
        yield marks
        many, _ = repeated(left["h"])
        left, marks = merged_equals(flat, halved(flat, {k: v[many] for k, v in left.items()}))
        yield marks
        yield from _indexed(flat, left)
        a = b


def merged_equals(flat: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], tuple]:
    """rows without those whose bytes equal an earlier row's, and (key, start, n) of those."""
    stays, marked, head_of = routing.firsts(rows, False)
    some = np.flatnonzero(marked)
    if len(some):
        other = some[~routing.same_bytes(flat, rows["at"][some], rows["at"][head_of[some]], rows["n"][some] + LENGTH - 1)]
        stays[other], marked[other] = True, False
    return {k: v[stays] for k, v in rows.items()}, tuple(rows[k][marked] for k in ("key", "start", "n"))


def _indexed(flat, rows):
    """Matching statistics of segments that share an anchor with another, an index for some groups of equal anchors at a time."""
    many, _ = repeated(rows["anchor"])
    order = np.flatnonzero(many)[np.argsort(rows["anchor"][many], kind="stable")]
    rows = {k: v[order] for k, v in rows.items()}
    anchor = rows["anchor"]
    heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))[: len(anchor)]
    ends = np.append(heads[1:], len(anchor))
    size = np.cumsum(rows["n"] + LENGTH - 1)
    whole = flat.tobytes()
    a = 0
    while a < len(heads):
        begin = size[heads[a] - 1] if heads[a] else 0
        b = max(a + 1, int(np.searchsorted(size[ends - 1], begin + INDEXED, "right")))
        own = np.arange(heads[a], ends[b - 1])
        # several groups share an index; their order in its text must be that of the texts, over all groups
        own = own[np.lexsort((rows["start"][own], rows["key"][own]))]
        parts = [whole[x:y] for x, y in zip(rows["at"][own].tolist(), (rows["at"] + rows["n"] + LENGTH - 1)[own].tolist())]
        part, offset = RunLengthIndex(parts).repeats()
        yield rows["key"][own][part], rows["start"][own][part] + offset, np.ones(len(part), np.int64)
        a = b


def removed(text: bytes, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of bytes that the window runs cover."""
    _, s, k = routing.merged(np.zeros(len(start), np.int64), start, n + LENGTH - 1)
    return s, s + k


def _digested(batches):
    for b in batches:
        out = []
        for text, runs in zip(routing.unzipped(b.column("z")), b.column("runs")):
            s, e = removed(text, *routing.runs_of(runs))
            d, at = hashlib.sha256(), 0
            for x, y in zip(s.tolist(), e.tolist()):
                d.update(text[at:x])
                at = y
            d.update(text[at:])
            out.append((len(text), int((e - s).sum()), len(s), d.hexdigest()))
        cols = [pa.array(x, t) for x, t in zip(zip(*out), (*[pa.int64()] * 3, pa.string()))] if out else [pa.array([], t) for t in (*[pa.int64()] * 3, pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(text: bytes, runs) -> str:
    s, e = removed(text, *runs)
    at, kept = 0, []
    for x, y in zip(s.tolist(), e.tolist()):
        kept.append(text[at:x])
        at = y
    return b"".join([*kept, text[at:]]).decode("utf-8", "ignore")


def repeated_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with keys, and the runs of byte windows that also start earlier, by key."""
    own = routing.keyed(docs)
    return own, routing.repeats(own, segments, content, compare, by_text=False)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 after removing every byte of a repeated 100-byte string.

    Null texts are empty and lose nothing; texts under 100 bytes have no window. Rows with one doc_id and different
    texts are different documents, ordered by a hash; equal rows are one document and get its result each; null
    doc_ids come last. Other columns are ignored; an empty table gives no rows. Long texts are read in slices.
    """
    own, marks = repeated_bytes(docs.select("doc_id", "text"))
    return routing.with_marks(own, marks).select("doc_id", "z", "runs").mapInArrow(_digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes of text, other columns as they were; a character cut in two goes whole."""
    plain, names = routing.renamed(docs)
    own, marks = repeated_bytes(plain)
    return routing.with_all(docs, own, names, marks, _cut)
