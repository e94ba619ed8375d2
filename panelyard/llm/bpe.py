"""Byte-level BPE by monoid tree reduction.

A long text is cut into segments; segments are scanned by the pattern in parallel and their
matches are joined pairwise up a tree, then encoded in the task that joins them.
Two facts make a join exact without encoding everything again:

* Splitting. A match of the pattern depends on the text from its start to at most two
  characters past its end. So in a left part all matches ending two or more characters before
  its end stand, and in a right part all matches stand from the first boundary that the scan
  of the whole also reaches. The window between is scanned again, and grows until such a
  boundary is met.
* Merging. A token sequence is the encoding of its bytes exactly if every two neighbours are
  the encoding of their own bytes (a first merge across some boundary would also happen among
  those two neighbours alone). So a match is encoded by halves; at the seam a window of tokens
  is encoded again and grows until the pairs at both its edges are stable.

Decoding maps the ids of a row to byte strings and concatenates them in one flat join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm.common import small_batches, stored

SEGMENT_CHARS = 1 << 15
CACHED_MATCHES = 400_000
LOOKAHEAD = 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Encodes matches of a pattern by halves. One per Python worker; its caches are bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED_MATCHES):
        self.ranks = ranks
        self.cached = cached
        self.scan = regex.compile(pattern)
        self.parts: dict[bytes, tuple] = {}
        self.pairs: dict[tuple, bool] = {}
        self.matches: dict[str, bytes] = {}

    def merge(self, data: bytes) -> tuple:
        """Plain lowest-rank-first merging, for short windows; the tokens as byte strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def stable(self, a: bytes, b: bytes) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.cached:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == (a, b)
        return known

    def join_tokens(self, left: list, right: list) -> list:
        """The encoding of two encoded neighbours."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join(left[-i:] + right[:j]))
            left_ok = i >= len(left) or self.stable(left[-i - 1], window[0])
            right_ok = j >= len(right) or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[: max(len(left) - i, 0)] + list(window) + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    def halves(self, data: bytes) -> list:
        if len(data) <= 2:
            return list(self.merge(data))
        known = self.parts.get(data) if len(data) <= 16 else None
        if known is not None:
            return list(known)
        mid = len(data) // 2
        out = self.join_tokens(self.halves(data[:mid]), self.halves(data[mid:]))
        if len(data) <= 16:
            if len(self.parts) > self.cached:
                self.parts.clear()
            self.parts[data] = tuple(out)
        return out

    def encode_match(self, match: str) -> bytes:
        """The ids of one match, little-endian. A match that is a token as a whole is that
        token."""
        data = match.encode("utf-8")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.halves(data)]
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(data) <= 64:
            if len(self.matches) > self.cached:
                self.matches.clear()
            self.matches[match] = out
        return out

    def encode_matches(self, matches: list) -> bytes:
        known, one = self.matches, self.encode_match
        return b"".join([known.get(m) or one(m) for m in matches])

    def join_matches(self, left: list, right: list) -> list:
        """The matches of two scanned neighbours put together."""
        stable, cut = len(left), 0
        while stable and cut < LOOKAHEAD:
            stable -= 1
            cut += len(left[stable])
        tail = "".join(left[stable:])
        taken = 1
        while True:
            taken = min(taken, len(right))
            window = tail + "".join(right[:taken])
            ends = {len(tail) + e: n + 1 for n, e in enumerate(accumulate(map(len, right[:taken])))}
            ends[len(tail)] = 0
            last = taken == len(right)
            again, at = [], 0
            for m in self.scan.findall(window):
                if not last and at + len(m) > len(window) - LOOKAHEAD:
                    break
                again.append(m)
                at += len(m)
                if at in ends:
                    return left[:stable] + again + right[ends[at] :]
            if last:  # the window reached the end of the right part
                return left[:stable] + again
            taken *= 2

    def reduce(self, segments: list) -> list:
        """Matches of neighbouring segments, joined up a balanced tree."""
        level = segments
        while len(level) > 1:
            level = [self.join_matches(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(path: str, pattern: str, cached: int = CACHED_MATCHES) -> Encoder:
    key = (path, pattern, cached)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(path), pattern, cached)
    return _ENCODERS[key]


def encode(documents: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", carry_text: bool = False, cached: int = CACHED_MATCHES) -> DataFrame:
    """One row per row of ``documents``: doc_id, ids (binary, unsigned 32-bit little-endian) and,
    with ``carry_text``, the encoded text.

    Null texts are empty and have no ids; repeated rows are encoded each; other columns are
    ignored. Texts over SEGMENT_CHARS characters are cut, their segments scanned by different
    tasks and joined again in one task per text (a text is one value and fits a task). A worker
    keeps at most about ``cached`` encoded matches, for as long as it lives.
    """
    small_batches(documents.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks_path, pattern, cached)
        for batch in batches:
            ids = [encoder.encode_matches(encoder.scan.findall(t)) for t in batch.column(1).to_pylist()]
            more = {"text": batch.column(1)} if carry_text else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), **more})

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks_path, pattern, cached)
        for batch in batches:
            cut = [encoder.scan.findall(t) for t in batch.column("part").to_pylist()]
            lengths = pa.array([[len(m) for m in c] for c in cut], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lengths], names=[*batch.schema.names, "lengths"])

    def joined(table: pa.Table) -> pa.Table:
        encoder = worker_encoder(ranks_path, pattern, cached)
        table = table.sort_by("n")
        segments, parts = [], table.column("part").to_pylist()
        for part, lengths in zip(parts, table.column("lengths").to_pylist(), strict=True):
            ends = list(accumulate(lengths, initial=0))
            segments.append([part[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        ids = encoder.encode_matches(encoder.reduce(segments))
        more = {"text": pa.array(["".join(parts)], pa.string())} if carry_text else {}
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([ids], pa.binary()), **more})

    schema = "doc_id long, ids binary" + (", text string" if carry_text else "")

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"))
    short = rows.where(F.char_length("text") <= SEGMENT_CHARS).mapInArrow(direct, schema)
    # repeated rows stay apart by a number given once, before anything is shuffled
    long = stored(rows.where(F.char_length("text") > SEGMENT_CHARS).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = long.select(
        "doc_id", "row", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / SEGMENT_CHARS).cast("int")),
            lambda n: F.substring(F.col("text"), n * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS)),
        )).alias("n", "part"),
    )
    spread = parts.repartition("doc_id", "row", "n").mapInArrow(scanned, "doc_id long, row long, n int, part string, lengths array<int>")
    return short.union(spread.groupBy("row").applyInArrow(joined, schema))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded bytes in ``out`` (null ids give null)."""
    small_batches(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ranks = read_ranks(ranks_path)
        tokens = np.empty(max(ranks.values()) + 1, object)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if v is None else b"".join(tokens[np.frombuffer(v, "<u4")].tolist()) for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(bytes_of, schema)
