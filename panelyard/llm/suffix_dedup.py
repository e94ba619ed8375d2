"""Removal of repeated byte strings by threshold-bounded interval expansion on a
Burrows-Wheeler transform.

A string of ``least`` bytes is repeated if it also starts earlier. Candidates are found first:
every window of ``least`` bytes picks its smallest 32-gram (by hash) as anchor, so equal
windows pick equal anchors at equal places, and a run of windows with one anchor is a segment.
Segments that are equal as a whole need no sorting: all but the earliest are covered. Where an
anchor has different segments, one of each is brought together by anchor, and a
Burrows-Wheeler transform of them is built. Intervals of strings are then extended backward,
breadth first: strings of length l give the places where the common prefix of suffix-array
neighbours is exactly l, for increasing l, and the expansion stops at ``least``. Neighbours
that have no value by then share ``least`` bytes or more; of each such class all but the
earliest start are covered. An anchor with very many segments is first split by content, and
what is still too much for one transform is compared by digests of its single windows.

Coverage only ever grows: any earlier equal string, wherever it is seen, is proof enough. So
tasks thin what they send: of equal segments seen by a task one goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import NULL_ID, batches_of, checked_broadcast, inverse, mix, new_folder, powers, random_words, row_key, small_batches, stored, stored_alone, text_buffer

GRAM = 32
FLUSH_SEGMENTS = 250_000
CHUNK_BYTES = 1 << 19
HOT_ANCHOR = 2000  # distinct segments of an anchor beyond which it is split by content
STRIPE = 8
HOT_STRIPE = 2000  # pieces of a key beyond which they are compared window by window

_BYTES = random_words(256, 21)
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("count", "<u2"), ("lead", "<u2")])
COVER, REQUEST, SEGMENT = 0, 1, 2


class Hasher:
    """Hashes of substrings of a buffer, from prefix sums modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def load(self, raw: np.ndarray) -> None:
        if len(self.up) < len(raw) + 1:
            self.up, self.down = powers(_BASE, len(raw) + 1), powers(inverse(_BASE), len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.up[: len(raw)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def segments_of(hasher: Hasher, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, texts: np.ndarray, least: int) -> np.ndarray:
    """The segments of all texts of a buffer; ``ids`` and ``texts`` are the rows' keys."""
    if len(raw) < least:
        return np.zeros(0, _SEGMENT)
    hasher.load(raw)
    grams = hasher.every(GRAM)
    bits = np.uint64(len(raw).bit_length())
    at = np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_minimum((grams >> bits << bits) | at, least - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - least + 1, 0))
    if not len(doc):
        return np.zeros(0, _SEGMENT)
    counts = np.maximum(lengths - least + 1, 0)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][doc]
    anchor = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), _SEGMENT)
    out["count"] = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    out["anchor"] = grams[anchor[first]]
    out["hash"] = hasher.spans(begin, begin + out["count"].astype(np.int64) - 1 + least)
    out["doc"] = ids[doc[first]]
    out["text"] = texts[doc[first]]
    out["start"] = begin - offsets[doc[first]]
    out["lead"] = anchor[first] - begin
    return out


def thinned(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each group of equal segments, in order of anchor, and the others. A
    repeated row's segment is the same occurrence and is dropped."""
    return earliest(s[np.lexsort((s["start"], s["text"], s["doc"], s["hash"], s["anchor"]))])


def earliest(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``thinned``, for segments in order of anchor, hash, document and start."""
    same = np.zeros(len(s), bool)
    same[1:] = (s["anchor"][1:] == s["anchor"][:-1]) & (s["hash"][1:] == s["hash"][:-1]) & (s["count"][1:] == s["count"][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
    later = same & ((s["doc"] != s["doc"][head]) | (s["text"] != s["text"][head]) | (s["start"] != s["start"][head]))
    return s[~same], s[later]


FOUND = "kind int, anchor long, hash long, doc long, text long, place long"
_FOUND_TYPES = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("anchor", "hash", "doc", "text", "place")]])


def _records(kind: int, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(s), 50_000):
        p = s[at : at + 50_000]
        place = (p["start"].astype(np.int64) << 32) | (p["count"].astype(np.int64) << 16) | p["lead"].astype(np.int64)
        # a run that is known to be covered is dealt by its row, not by an anchor that may be hot
        anchor = p["doc"] ^ p["text"] if kind == COVER else p["anchor"].view(np.int64)
        columns = [np.full(len(p), kind, np.int32), anchor, p["hash"].view(np.int64), p["doc"], p["text"], place]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_FOUND_TYPES)


def _segments(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, _SEGMENT)
    for c in ("anchor", "hash", "doc", "text"):
        values = batch.column(c).to_numpy()
        out[c] = values.view(np.uint64) if c in ("anchor", "hash") else values
    place = batch.column("place").to_numpy()
    out["start"], out["count"], out["lead"] = place >> 32, (place >> 16) & 0xFFFF, place & 0xFFFF
    return out


def candidates(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Covered runs of starts (doc, text, start, count), and requests (the same with anchor and
    lead): the earliest of each of an anchor's different segments. Spark deals and sorts the
    segments by anchor and content, so a task reads them as a stream and holds one of them."""
    spark = documents.sparkSession
    small_batches(spark, rows=20_000, mib=0.5)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, count = Hasher(), [], 0
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            held.append(segments_of(hasher, raw, offsets, batch.column(0).to_numpy(), batch.column(1).to_numpy(), least))
            count += len(held[-1])
            if count > FLUSH_SEGMENTS:
                first, later = thinned(np.concatenate(held))
                held, count = [], 0
                yield from _records(COVER, later)
                yield from _records(SEGMENT, first)
        if count:
            first, later = thinned(np.concatenate(held))
            yield from _records(COVER, later)
            yield from _records(SEGMENT, first)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = np.zeros(0, _SEGMENT), False  # the segment that the next rows may equal, and whether it was requested
        for batch in batches_of(batches, 4 << 20):
            new = batch.column(0).to_numpy() == SEGMENT
            yield batch.filter(pa.array(~new))
            if not new.any():
                continue
            first, later = earliest(np.concatenate([last, _segments(batch.filter(pa.array(new)))]))
            yield from _records(COVER, later)
            same = np.zeros(len(first) + 1, bool)
            same[1:-1] = first["anchor"][1:] == first["anchor"][:-1]
            wanted = same[1:] | same[:-1]
            if len(first) == 1:
                told = told and len(last) == 1
            else:
                wanted[0] &= not told
                told = bool(same[-2])
            yield from _records(REQUEST, first[wanted])
            last = first[-1:].copy()

    folder = new_folder(spark, "segments")
    dealt = documents.mapInArrow(scan, FOUND).repartition("anchor").sortWithinPartitions("anchor", "hash", "doc", "text", "place")
    dealt.mapInArrow(gather, FOUND).drop("hash").write.partitionBy("kind").parquet(folder)
    out = spark.read.schema("anchor long, doc long, text long, place long, kind int").parquet(folder)
    part = lambda name, shift: F.shiftright("place", shift).bitwiseAND(0xFFFF if shift < 32 else 0x7FFFFFFF).cast("int").alias(name)
    runs = ["doc", "text", part("start", 32), part("count", 16)]
    return out.where(F.col("kind") == COVER).select(*runs), out.where(F.col("kind") == REQUEST).select(*runs, "anchor", part("lead", 0))


def interval_classes(text: np.ndarray, least: int) -> np.ndarray:
    """For every place of ``text`` (values from 1; 0 ends a segment) a class: places share one
    exactly if they start the same string of ``least`` values."""
    n, first = len(text), 16

    def packed(width: int) -> np.ndarray:
        padded = np.concatenate([text, np.zeros(width, np.uint8)])
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = (out << np.uint64(8)) | padded[i : i + n]
        return out

    def ranks(major: np.ndarray, minor: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        key = major * np.int64(n + 1)
        key[: n - shift] += minor[shift:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        change = np.zeros(n, np.int64)
        change[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = change
        return rank, order

    _, r = np.unique(packed(8), return_inverse=True)
    r = r.astype(np.int64)
    start, length = None, 8
    while 2 * length <= least:
        r, order = ranks(r, r, length)
        length *= 2
        if length == first:
            start = r
    if length < least:
        _, order = ranks(r, r, least - length)
    # the transform, its counting map and the known boundaries
    before = text[order - 1]  # the value before the first place is the last one, a 0
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    common = np.full(n + 1, -1, np.int32)  # common prefix of a place and the one before it; -1: not known
    common[0] = common[n] = 0
    ordered = start[order]
    common[1:n][ordered[1:] != ordered[:-1]] = 0  # shorter than ``first``
    low = np.flatnonzero(common[:n] == 0)
    high = np.concatenate([low[1:], [n]])  # one past the end
    for length in range(first, least):
        sizes = high - low
        at = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        if not len(at):
            break
        key = np.repeat(np.arange(len(low)), sizes) * 256 + before[at]
        key, where, count = np.unique(key, return_index=True, return_counts=True)
        real = (key & 255) != 0  # no string runs across a segment's end
        left = step[at[where[real]]]
        right = left + count[real]
        fresh = common[right] < 0
        left, right = left[fresh], right[fresh]
        common[right] = length
        low, high = left, right
    joined = np.cumsum(common[:n] >= 0)
    out = np.empty(n, np.int64)
    out[order] = joined
    return out


def covered_starts(segments: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text, start) of all starts that repeat an earlier one. segments: (doc, text, start,
    count, content)."""
    joined = np.frombuffer(b"\0".join(bytes(s[4]).translate(_PLUS_ONE) for s in segments) + b"\0", np.uint8)
    sizes = np.array([len(s[4]) + 1 for s in segments])
    counts = np.array([s[3] for s in segments])
    begins = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(segments)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    cls = interval_classes(joined, least)[begins[which] + inner]
    doc = np.array([s[0] for s in segments], np.int64)[which]
    text = np.array([s[1] for s in segments], np.int64)[which]
    start = np.array([s[2] for s in segments], np.int64)[which] + inner
    order = np.lexsort((start, text, doc, cls))
    cls, doc, text, start = cls[order], doc[order], text[order], start[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], cls[1:] != cls[:-1]]), np.arange(len(cls)), 0))
    later = (doc != doc[head]) | (text != text[head]) | (start != start[head])
    return doc[later], text[later], start[later]


_PLUS_ONE = bytes((i + 1) & 255 for i in range(256))  # UTF-8 has no byte 255, so 0 stays free


def _runs(doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((start, text, doc))
    doc, text, start = doc[order], text[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first, [len(doc)]])[1:] - 1
    return doc[first], text[first], start[first], start[last] - start[first] + 1


def settle_segments(documents: DataFrame, requests: DataFrame, least: int) -> DataFrame:
    """Covered runs of starts (doc, text, start, count) among an anchor's different segments."""
    spark = documents.sparkSession
    hot = requests.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ANCHOR).select("anchor", F.lit(True).alias("hot"))
    hot = stored(hot, "hot-anchors")
    asked = requests.join(checked_broadcast(hot), "anchor", "left").groupBy("doc", "text").agg(
        F.collect_list(F.struct("start", "count", "anchor", "lead", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked")
    )
    asked = stored(asked, "asked")
    piece = "key long, doc long, text long, start int, count int, content binary"
    names = [f.split()[0] for f in piece.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            out, covered = [], []
            for doc, text, body, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = body.encode("utf-8")
                for w in wanted:
                    start, count = w["start"], w["count"]
                    if not w["hot"]:
                        out.append((w["anchor"], doc, text, start, count, data[start : start + count - 1 + least]))
                        continue
                    # a hot anchor is split into stripes of starts, told apart by the bytes that all of a stripe share
                    anchor = start + w["lead"]
                    for q in range((anchor - start - count + 1) // STRIPE, (anchor - start) // STRIPE + 1):
                        a, b = max(start, anchor - STRIPE * q - STRIPE + 1), min(start + count, anchor - STRIPE * q + 1)
                        if a >= b:
                            continue
                        shared = data[anchor - STRIPE * q : anchor - STRIPE * q - STRIPE + 1 + least]
                        key = hash_bytes(shared, w["anchor"] + q)
                        content = data[a : b - 1 + least]
                        mine = (key, content)
                        if mine in seen and seen[mine] <= (doc, text, a):
                            if seen[mine] < (doc, text, a):
                                covered.append((None, doc, text, a, b - a, None))
                            continue
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[mine] = (doc, text, a)
                        out.append((key, doc, text, a, b - a, content))
            rows = out + covered
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None

        def settled() -> pa.RecordBatch:
            doc, text, start, count = _runs(*covered_starts(held, least))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc", "text", "start", "count"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != key and size >= CHUNK_BYTES:
                    yield settled()
                    held, size = [], 0
                key = row[0]
                held.append(row[1:])
                size += len(row[5])
        if held:
            yield settled()

    small_batches(spark, rows=1000, mib=2)
    # the requests grow with the input, so they are joined by shuffle at every size
    texts = documents.join(asked.withColumnsRenamed({"doc": "_i", "text": "_h"}).hint("merge"), ["_i", "_h"]).select("_i", "_h", "text", "asked")
    pieces = stored(texts.mapInArrow(cut, piece), "pieces")
    alone = pieces.where("key is null").select("doc", "text", "start", "count")
    together = pieces.where("key is not null")
    crowded = together.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_STRIPE).select("key")
    crowded = checked_broadcast(stored(crowded, "crowded-keys"))
    apart = repeated_windows(together.join(crowded, "key", "left_semi"), least)
    together = together.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    return alone.union(apart).union(together.mapInArrow(transformed, "doc long, text long, start int, count int"))


def repeated_windows(pieces: DataFrame, least: int) -> DataFrame:
    """Covered starts (doc, text, start, count) among ``pieces``: each piece falls into its
    windows of ``least`` bytes, and of equal windows all but the earliest are covered. No group
    is held in a task: the earliest is a partial aggregate, and only it is joined back."""
    windows = pieces.select("doc", "text", "start", "content", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("at")).select(
        F.unhex(F.md5(F.substring("content", F.col("at") + 1, F.lit(least)))).alias("window"), F.struct("doc", "text", (F.col("start") + F.col("at")).alias("start")).alias("place")
    )
    firsts = windows.groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("window", "first")
    firsts = stored(firsts, "first-windows")
    return windows.join(checked_broadcast(firsts), "window").where("place <> first").select("place.*", F.lit(1).alias("count"))


def hash_bytes(data: bytes, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=(seed & (2**64 - 1)).to_bytes(8, "little")).digest(), "little", signed=True)


def remove_repeats(documents: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, by_character: bool = False) -> DataFrame:
    """One row per row of ``documents``: doc_id, spans (array of begin, end: maximal removed
    runs of bytes), kept (the remaining bytes) and the columns named in ``keep``. With
    ``by_character`` only characters whose bytes are all covered go.

    A byte goes if a string of ``least`` bytes that covers it also starts earlier: in a smaller
    doc_id, or in the same document at an earlier byte. All is judged on the input. Null texts
    are empty; texts under ``least`` bytes stay whole. A null id is the smallest. Equal rows are
    one document: equal strings at equal places are one occurrence, so they get equal results.
    Rows that repeat an id (or a null) with another text are documents of their own, in order
    of the hash of common.row_key. Other columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    if least <= GRAM:
        raise ValueError(f"least must be over {GRAM}")
    rows = documents.select(*row_key(doc_id, text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    long_enough = rows.where(F.octet_length("text") >= least)
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, []

        def united(doc: tuple, held: list) -> tuple:
            s = np.concatenate(held)
            end = np.maximum.accumulate(s[:, 1])
            new = np.ones(len(s), bool)
            new[1:] = s[1:, 0] > end[:-1]
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(s)]]) - 1
            return *doc, np.stack([s[first, 0], end[last]], axis=1).astype("<i8").tobytes()

        def found(done: list) -> pa.RecordBatch:
            columns = [pa.array([d[n] for d in done], t) for n, t in enumerate([pa.int64(), pa.int64(), pa.binary()])]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "text", "runs"])

        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start = batch.column(2).to_numpy().astype(np.int64)
            spans = np.stack([start, start + batch.column(3).to_numpy() - 1 + least], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1])])) if len(docs) else []
            done = []
            for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=True):
                if (docs[a], texts[a]) != doc and held:
                    done.append(united(doc, held))
                    held = []
                doc = int(docs[a]), int(texts[a])
                held.append(spans[a:b])
            yield found(done)
        if held:
            yield found([united(doc, held)])

    def found_runs() -> DataFrame:
        covers, requests = candidates(long_enough, least)
        covers = covers.union(settle_segments(long_enough, requests, least))
        small_batches(spark, rows=50_000, mib=4)
        return covers.repartition("doc", "text").sortWithinPartitions("doc", "text", "start").mapInArrow(merged, "_i long, _h long, runs binary")

    runs = stored_alone(spark, "runs", found_runs)
    carried = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])]
    whole = documents.select(
        *row_key(doc_id, text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *carried
    )
    marked = whole.join(checked_broadcast(runs), ["_i", "_h"], "left").drop("_h")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for data, packed in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                pairs = [] if packed is None else np.frombuffer(packed, "<i8").reshape(-1, 2).tolist()
                if by_character:
                    pairs = [(a, b) for a, b in ((_next_character(data, a), _last_character(data, b)) for a, b in pairs) if a < b]
                pairs = [(a, min(b, len(data))) for a, b in pairs if a < len(data)]
                edges = [0, *[x for p in pairs for x in p], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"begin": a, "end": b} for a, b in pairs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), *batch.columns[2:-1]],
                names=["id", "spans", "kept", *batch.schema.names[2:-1]],
            )

    small_batches(spark, rows=1000, mib=2)
    schema = marked.schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields[2:-1])
    out = marked.mapInArrow(removed, "id long, spans array<struct<begin: bigint, end: bigint>>, kept binary" + (f", {fields}" if fields else ""))
    return out.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "spans", "kept", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])]
    )


def _next_character(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _last_character(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at
