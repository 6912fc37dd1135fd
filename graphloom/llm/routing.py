"""What the two exact substring operators share: routing segments by content, and removing what they mark.

A window is a run of fixed length (bytes or words) of one text. Each window belongs to an anchor that its content
alone picks, so equal windows anywhere have equal anchors. A segment is the run of windows of one anchor
occurrence. Segments travel as packed arrays, a bucket of anchor hashes at a time:

1. every scan task packs its segments by bucket; of equal segments in its own rows it sends the first alone;
2. each bucket asks for the content of segments that share an anchor, or settles equal ones by their hashes;
3. the content goes, compressed, to the bucket of its anchor, where the operator compares windows exactly;
4. marked window runs come back to their texts.

There are as many buckets as the input has BUCKET bytes, so a task's share doesn't grow with the input. Of equal
segments a bucket gets one from each scan task. An anchor that stands in very many different segments (a passage with
many surroundings) is known from a sample of the texts; its windows are routed each by its own content, so that they
spread over all buckets. Which anchors are treated so doesn't change the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U, mix
from graphloom.session import materialize, scratch

#: Segments that a scan task holds before it sends them.
HELD = 500_000
#: Bytes of text whose segments one bucket holds, about.
BUCKET = 32 << 20
#: Bytes of text, about, that hot anchors are looked for in; an anchor is hot if it is estimated to stand in more than
#: HOT different segments and was seen in SEEN of the sample at least.
SAMPLED, HOT, SEEN = 16 << 20, 50_000, 8
MARK, ASK = 1, 2
FIELDS = (("h", "<u4"), ("s", "<u8"), ("key", None), ("start", None), ("n", "<u1"))
PLACES = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
MARKS = "kind int, h long, key long, start long, n long"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with one more column, `key`, that orders them like doc_id and is unique to a text; doc_id as a long.

    docs may have more columns, but none named key; see renamed() for those that have.

    Where doc_id is unique and never null, it is the key. Else different (doc_id, text) get numbers in the order
    of doc_id, nulls last, then of a hash of the text; equal rows share one and so their result. What is returned
    has an attribute `odd` that tells which.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        out = docs.withColumn("key", F.col("doc_id"))
        out.odd = False
        return out
    own = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    ids = own.select("doc_id", "digest").distinct().repartitionByRange(F.col("doc_id").asc_nulls_last(), "digest").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "digest")
    ids = materialize(ids.select("doc_id", "digest", F.monotonically_increasing_id().alias("key")), "keys")
    same = own["doc_id"].eqNullSafe(ids["doc_id"]) & (own["digest"] == ids["digest"])
    out = materialize(own.join(ids, same).select(ids["key"], *(own[c] for c in docs.columns)), "keyed")
    out.odd = True
    return out


def _zip(batches):
    c = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array([c.compress(t.encode()) if t is not None else None for t in b.column("text").to_pylist()], pa.binary())], ["key", "doc_id", "z"])


def zipped(docs: DataFrame) -> DataFrame:
    """docs with text compressed, as it is dealt out."""
    return docs.select("key", "doc_id", "text").mapInArrow(_zip, "key long, doc_id long, z binary")


def unzipped(column: pa.Array) -> Iterator[bytes]:
    d = zstandard.ZstdDecompressor()
    for z in column:
        yield d.decompress(z.as_buffer()) if z.is_valid else b""


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def packed(rows: dict[str, np.ndarray], blob: bytes = b"") -> bytes:
    """Arrays as bytes: a key is what it exceeds the one before by. h has 40 bits at most; s may be left out."""
    key, h = rows["key"], rows["h"].astype(U)
    steps, high = np.diff(key, prepend=key[:1]), (h >> U(32)).astype("<u1")
    parts = [h.astype("<u4"), rows["s"].astype("<u8") if "s" in rows else None, _narrow(steps.astype(U)), _narrow(rows["start"]), rows["n"].astype("<u1"), high if high.any() else None]
    head = np.array([len(key), key[0], *(0 if p is None else p.itemsize for p in parts)], "<i8").tobytes()
    return head + b"".join(p.tobytes() for p in parts if p is not None) + blob


def unpacked(data: bytes) -> tuple[dict[str, np.ndarray], memoryview]:
    n, first, *sizes = np.frombuffer(data, "<i8", 8).tolist()
    at, out = 64, {}
    for name, size in zip([*(k for k, _ in FIELDS), "high"], sizes):
        out[name] = np.frombuffer(data, f"<u{size}", n, at) if size else np.zeros(n, U)
        at += n * size
    out["key"] = np.cumsum(out["key"].astype(np.int64)) + first
    out["h"] = out["h"] | out.pop("high").astype(np.int64) << 32
    return {k: v.astype(np.int64) if k != "s" else v for k, v in out.items()}, memoryview(data)[at:]


def firsts(rows: dict[str, np.ndarray], by_text: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows stay and which are marked, of rows whose segments are equal by hash, and the first row of each marked one's equals.

    The row of the smallest (key, start) stays and the rest are marked. by_text: all rows of the smallest key
    stay, since windows that repeat within one text don't count.
    """
    n = len(rows["s"])
    stays, marked, head_of = np.ones(n, bool), np.zeros(n, bool), np.arange(n)
    order = np.argsort(rows["s"])
    s = rows["s"][order]
    same = np.zeros(n + 1, bool)
    same[1:n] = s[1:] == s[:-1]
    among = order[same[:-1] | same[1:]]
    if len(among):
        among = among[np.lexsort((rows["start"][among], rows["key"][among], rows["h"][among], rows["s"][among]))]
        s, h, key, start = (rows[c][among] for c in ("s", "h", "key", "start"))
        head = np.append(True, (s[1:] != s[:-1]) | (h[1:] != h[:-1]))
        group = np.cumsum(head) - 1
        least, first = key[head][group], start[head][group]
        again = ~head & (key == least) & (start == first)  # an equal row of the input, read as one text
        later = key > least if by_text else ~head & ~again
        marked[among[later]], stays[among[later]] = True, False
        stays[among[again]] = False
        head_of[among] = among[head][group]
    return stays, marked, head_of


def same_bytes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Whether the runs of width bytes at a and at b are equal."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(width)
    k = 0
    while k < len(a):
        z = max(k + 1, int(np.searchsorted(ends, ends[k] - width[k] + (1 << 20), "right")))
        w = width[k:z]
        first = np.cumsum(w) - w
        step = np.arange(int(w.sum())) - np.repeat(first, w)
        equal = flat[np.repeat(a[k:z], w) + step] == flat[np.repeat(b[k:z], w) + step]
        out[k:z] = np.logical_and.reduceat(equal, first) if len(first) else True
        k = z
    return out


def merged(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with touching ones of a text joined."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], (start + n)[order]
    if not len(key):
        return key, start, end
    # ends are made to ascend within a text, so that a run ends where the next start lies beyond all before
    base = np.cumsum(np.append(0, key[1:] != key[:-1]))
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + base * span)
    new = np.append(True, start[1:] + base[1:] * span > reach[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(key)) - 1
    return key[heads], start[heads], reach[tails] - base[tails] * span - start[heads]


def _marks(key, start, n, kind=MARK, h=None) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(key), kind, np.int32)), pa.array(np.zeros(len(key), np.int64) if h is None else h.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(np.asarray(x, np.int64)) for x in (key, start, n))], ["kind", "h", "key", "start", "n"])


def _by_bucket(rows: dict[str, np.ndarray], buckets: int, kind: int) -> pa.RecordBatch:
    """A packed row for each bucket."""
    order = np.lexsort((rows["start"], rows["key"]))
    bucket = (mix(rows["h"][order].astype(U)) % U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = order[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(heads[1:], len(bucket))
    out = [packed({k: v[order[a:b]] for k, v in rows.items()}) for a, b in zip(heads, ends)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), kind, np.int32)), pa.array(bucket[heads].astype(np.int32)), pa.array(out, pa.binary())], schema=PLACES)


def scan(batches, segments: Callable, buckets: int, by_text: bool, hot: np.ndarray):
    """Step 1. Rows of kind 0 hold segments, rows of kind MARK hold runs that are settled here.

    segments(batch, hot) yields rows, and the bytes that they stand in with their places there and widths, or None;
    with bytes, equality is seen in them.
    """
    held, count = [], 0

    def send():
        rows = {k: np.concatenate([x[k] for x, _ in held]) for k, _ in FIELDS}
        stays, marked, head_of = firsts(rows, by_text)
        if held[0][1] is not None and marked.any():
            flat = np.concatenate([c[0] for _, c in held])
            base = np.cumsum([0, *(len(c[0]) for _, c in held)])
            at, width = np.concatenate([c[1] + x for (_, c), x in zip(held, base)]), np.concatenate([c[2] for _, c in held])
            some = np.flatnonzero(marked)
            other = some[~same_bytes(flat, at[some], at[head_of[some]], width[some])]
            stays[other], marked[other] = True, False
        held.clear()
        if stays.any():
            # equal segments are settled by s or by their bytes; those need no s
            yield _by_bucket({k: v[stays] for k, v in rows.items() if by_text or k != "s"}, buckets, 0)
        if marked.any():
            key, start, n = merged(rows["key"][marked], rows["start"][marked], (rows["n"][marked] & 127).astype(np.int64))
            data = np.stack([key, start, n]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([MARK], pa.int32()), pa.array([int(key[0]) % buckets], pa.int32()), pa.array([data], pa.binary())], schema=PLACES)

    for batch in batches:
        for rows, where in segments(batch, hot):
            if len(rows["h"]):
                held.append((rows, where))
                count += len(rows["h"])
            if count >= HELD:
                yield from send()
                count = 0
    if held:
        yield from send()


def _anchors(batches, segments: Callable):
    """Different segments of a task's rows by anchor."""
    for batch in batches:
        for rows, _ in segments(batch, np.zeros(0, np.int64)):
            if len(rows["h"]):
                order = np.lexsort((rows["s"], rows["h"]))
                h, s = rows["h"][order], rows["s"][order]
                new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(s[new].view(np.int64))], ["h", "s"])


def hot_anchors(docs: DataFrame, segments: Callable, size: int) -> np.ndarray:
    """Anchors that stand in very many different segments, in ascending order; no more than the sample has room for."""
    every = max(1, size // SAMPLED)
    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", "text")
    counts = some.mapInArrow(lambda it: _anchors(it, segments), "h long, s long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return np.array(sorted(r["h"] for r in counts.where(F.col("n") > max(SEEN, HOT // every)).select("h").collect()), np.int64)


def spread(rows: dict[str, np.ndarray], hot: np.ndarray, window: Callable, where=None, index: int = 0, bits: int = 32):
    """rows with the segments of hot anchors cut into their windows, each a segment of its own; window(segment, step) hashes one.

    bits: how many h has.
    """
    if not len(hot) or not len(rows["h"]):
        return rows, where
    at = np.minimum(np.searchsorted(hot, rows["h"]), len(hot) - 1)
    own = np.flatnonzero(hot[at] == rows["h"])
    if not len(own):
        return rows, where
    n = (rows["n"][own] & 127).astype(np.int64)
    of = np.repeat(own, n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    s = window(of, step)
    cut = {"h": (s >> U(64 - bits)).astype(np.int64), "s": s, "key": rows["key"][of], "start": rows["start"][of] + step, "n": np.full(len(of), 1 | index << 7, np.int64)}
    rest = np.ones(len(rows["h"]), bool)
    rest[own] = False
    if where is not None:
        flat, place, width = where
        where = flat, np.concatenate([place[rest], place[of] + step]), np.concatenate([width[rest], np.repeat(width[own] - n + 1, n)])
    return {k: np.concatenate([rows[k][rest], cut[k]]) for k, _ in FIELDS}, where


def gathered(batches, kinds: tuple[int, ...] = (0,)):
    """Per bucket, of rows that come sorted by bucket: its packed data; data of other kinds one by one."""
    bucket, data = None, []
    for batch in batches:
        for kind, b, d in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
            if kind not in kinds:
                yield kind, [d]
                continue
            if b != bucket and data:
                yield 0, data
                data = []
            bucket = b
            data.append(d)
    if data:
        yield 0, data


def settle(batches, by_text: bool):
    """Step 2. by_text: equal segments are settled by their hashes. Else the bytes of all that share an anchor are asked for."""
    for kind, data in gathered(batches):
        if kind == MARK:
            yield _marks(*np.frombuffer(data[0], "<i8").reshape(3, -1))
            continue
        parts = [unpacked(d)[0] for d in data]
        rows = {k: np.concatenate([p[k] for p in parts]) for k, _ in FIELDS}
        del parts
        index, rows["n"] = rows["n"] >> 7 > 0, rows["n"] & 127
        if by_text:
            stays, marked, _ = firsts(rows, by_text)
            if marked.any():
                yield _marks(*merged(rows["key"][marked], rows["start"][marked], rows["n"][marked]))
            rows, index = {k: v[stays] for k, v in rows.items()}, index[stays]
        order = np.argsort(rows["h"], kind="stable")
        h, s, key, index = rows["h"][order], rows["s"][order], rows["key"][order], index[order]
        head = np.append(True, h[1:] != h[:-1])
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        if by_text:  # a probe needs an indexed block of a smaller text, a block a probe of a larger one
            many = np.minimum.reduceat(s, at) != np.maximum.reduceat(s, at)
            first_index = np.minimum.reduceat(np.where(index, key, np.int64(2**63 - 1)), at)
            last_key = np.maximum.reduceat(key, at)
            ask = many[group] & ((first_index[group] < key) | (index & (key < last_key[group])))
        else:
            ask = (np.diff(np.append(at, len(h))) > 1)[group]
        ask = order[ask]
        if len(ask):
            yield _marks(rows["key"][ask], rows["start"][ask], rows["n"][ask], ASK, rows["h"][ask])


def fetch(batches, content: Callable, buckets: int):
    """Step 3: content(text, starts, counts) gives the bytes that go with each asked segment."""
    held, size, c = [], 0, zstandard.ZstdCompressor(level=1)

    def send():
        h, key, start, n = (np.concatenate([x[i] for x in held]) for i in range(4))
        blobs = [b for x in held for b in x[4]]
        held.clear()
        bucket = (mix(h.astype(U)) % U(buckets)).astype(np.int64)
        out = []
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            own = own[np.argsort(key[own], kind="stable")]
            widths = np.array([len(blobs[i]) for i in own], "<u4")
            rows = {"h": h[own], "key": key[own], "start": start[own], "n": n[own]}
            out.append((0, int(b), c.compress(packed(rows, widths.tobytes() + b"".join(blobs[i] for i in own)))))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], schema=PLACES)

    for batch in batches:
        for key, text, asked in zip(batch.column("key").to_pylist(), unzipped(batch.column("z")), batch.column("asked")):
            v = asked.values
            h, start, n = (v.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            blobs = content(text, start, n)
            held.append((h, np.full(len(h), key, np.int64), start, n, blobs))
            size += sum(map(len, blobs)) + 32 * len(blobs)
            if size > 10 << 20:
                yield send()
                size = 0
    if held:
        yield send()


def compared(batches, compare: Callable):
    """Step 4: compare(rows, blobs) gives (key, start, n) of repeated window runs in one bucket."""
    z = zstandard.ZstdDecompressor()
    for _, data in gathered(batches):
        parts, blobs = [], []
        for d in data:
            rows, blob = unpacked(z.decompress(d))
            widths = np.frombuffer(blob, "<u4", len(rows["h"]))
            ends = np.cumsum(widths, dtype=np.int64) + 4 * len(widths)
            blobs += [bytes(blob[e - w : e]) for e, w in zip(ends.tolist(), widths.tolist())]
            parts.append(rows)
        rows = {k: np.concatenate([p[k] for p in parts]) for k, _ in FIELDS}
        for key, start, n in compare(rows, blobs):
            if len(key):
                yield _marks(*merged(key, start, n))


def repeats(docs: DataFrame, segments: Callable, content: Callable, compare: Callable, by_text: bool) -> DataFrame:
    """(key, start, n): runs of n windows from start that also occur earlier. docs: keyed()."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    hot = hot_anchors(docs, segments, size)
    with scratch(spark) as scope:
        routed = docs.select("key", "text").mapInArrow(lambda it: scan(it, segments, buckets, by_text, hot), "kind int, bucket int, data binary")
        settled = routed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: settle(it, by_text), MARKS)
        settled = materialize(settled, "settled")
        asked = settled.where(F.col("kind") == ASK).groupBy("key").agg(F.collect_list(F.struct("h", "start", "n")).alias("asked"))
        texts = zipped(docs).select("key", "z").join(asked.hint("shuffle_hash"), "key")
        fetched = texts.mapInArrow(lambda it: fetch(it, content, buckets), "kind int, bucket int, data binary")
        found = fetched.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: compared(it, compare), MARKS)
        return scope.keep(materialize(settled.where(F.col("kind") == MARK).unionByName(found).select("key", "start", "n"), "repeats"))


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, doc_id, z, runs): each text with its window runs, null if it has none. Equal rows of docs come once each."""
    runs = marks.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return zipped(docs).join(runs.hint("shuffle_hash"), "key", "left")


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... besides doc_id and text, so that no name of its own can clash."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = {c: plain[names[docs.columns.index(c)]].alias(c) for c in ("doc_id", "text")}
    return plain.select(*names, own["doc_id"], own["text"]), names


def with_all(docs: DataFrame, own: DataFrame, names: list[str], marks: DataFrame, cut: Callable) -> DataFrame:
    """docs with text cut by its runs, all other columns as they were. own: keyed(renamed(docs))."""
    runs = marks.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    at = docs.columns.index("text")

    def cut_all(batches):
        for b in batches:
            texts = b.column(names[at])
            new = [cut(t.encode(), runs_of(r)) if t is not None else None for t, r in zip(texts.to_pylist(), b.column("runs"))]
            yield pa.RecordBatch.from_arrays([pa.array(new, texts.type) if i == at else b.column(c) for i, c in enumerate(names)], names)

    plain = own.select(*names, "key")
    return plain.join(runs.hint("shuffle_hash"), "key", "left").select(*names, "runs").mapInArrow(cut_all, plain.select(names).schema).toDF(*docs.columns)


def runs_of(scalar: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    if not scalar.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = scalar.values
    return v.field(0).to_numpy(zero_copy_only=False), v.field(1).to_numpy(zero_copy_only=False)
