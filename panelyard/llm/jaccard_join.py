"""N-gram Jaccard self-join of texts: size-banded tiles, bitmap signatures, exact check.

A text's set holds its distinct word shingles, as 64-bit hashes. Two sets x and y with
similarity t or more differ in at most d = (|x| + |y|) (1 - t) / (1 + t) shingles. Sets are put
into bands of size; within a band the hash range is cut into m = d + 1 + e parts. Two linked
sets agree on 1 + e parts at least, and as both leave out their e weakest parts by one and the
same order, they agree on a part that neither left out. So (band, part, its content) is a tile
in which every linked pair meets, while texts that only share a common passage rarely do.

Within tiles links are found without listing all pairs: equal sets are one entry; every entry
is first compared with its tile's pivot (the one that meets most others in all its tiles: near
copies share more parts with their original than with each other), and linked entries become
components; entries of different components that still share a tile are compared in blocks of
it. In a tile of several blocks the entries of its largest component, which need no comparison
with each other, have blocks of their own and are copied only to those of the rest. Bitmaps
bound an overlap from above (each bit set on one side only is a shingle the other side lacks);
what passes is settled by intersecting the sorted
arrays. A pair that meets in several tiles is left to the largest of them, as far as the rows
name their largest tiles, so near copies that share most tiles do not give their pairs (or their
rows) once per tile. A block with up to eight passing pairs a row gives these. Any other is bounded
anew, with components grown by them, and then gives a forest of its likeliest pairs; the arrays
of what still has many passing pairs are brought together and joined in one task up to a
spanning set of links. Blocks with the same open rows are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import NULL_ID, batches_of, checked_broadcast, components, is_small, joined_components, mix, new_folder, random_words, small_batches, stored, stored_alone, text_buffer

BLOCK = 256
WIDEST_BITS = 32_768
BITS = 4  # of a bitmap per shingle, at least: with fewer, most pairs some way below the threshold pass too
PAIRS_PER_ROW = 8  # a block with more passing pairs per row than this gives a forest of them first
LARGEST_TILES = 8  # of a row, named so that a pair is compared in one of them only
BAND_GROWTH = 1.5
FLUSH_KEYS = 500_000

_BYTES = random_words(256, 11) | np.uint64(1)
_PLACES = random_words(4096, 12) | np.uint64(1)
_WORDS = random_words(64, 13) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a buffer, and for each text where its words begin."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = solid[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    values = _BYTES[_LOWER[raw]] * (_PLACES[place & 4095] + (place >> 12).astype(np.uint64))
    values[~solid] = 0
    return mix(np.add.reduceat(values, starts)), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(raw, offsets)
    sums = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j in range(width):
        sums += words[j : j + len(sums)] * _WORDS[j % 64]
    sums = mix(sums)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(sums[a : b - width + 1])
        elif b > a:
            few = (words[a:b] * _WORDS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([few], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Size bands and their tiles for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]

    def _edge(self, k: int) -> int:
        while len(self.edges) <= k:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_GROWTH)))
        return self.edges[k]

    def tiles(self, n: int) -> list[tuple[int, int, int]]:
        """(band, d + 1, e) of every band in which a set of ``n`` meets its partners."""
        k = 0
        while self._edge(k + 1) <= n:
            k += 1
        out = []
        while k >= 0:
            largest = self._edge(k + 1) - 1
            partner = largest * 100 // self.percent
            if partner < n:
                break
            needed = (largest + partner) * (100 - self.percent) // (100 + self.percent) + 1
            out.append((k, needed, needed // 4))
            k -= 1
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        spread = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        high = shingles >> np.uint64(33)
        out = []
        for band, needed, extra in self.tiles(len(shingles)):
            parts = needed + extra
            part = (high * np.uint64(parts)) >> np.uint64(31)
            ends = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            size = np.diff(ends)
            kept = np.argsort(size * parts + np.arange(parts))[extra:] if extra else np.arange(parts)
            content = spread[ends[1:]] - spread[ends[:-1]]
            key = content[kept] * _WORDS[0] + kept.astype(np.uint64) * _WORDS[1] + size[kept].astype(np.uint64) + _WORDS[2 + band % 60]
            out.append(mix(key))
        return np.concatenate(out)


def bitmap(shingles: np.ndarray) -> bytes:
    width = 1 << max(6, int(BITS * len(shingles) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0) if len(bits) > width else bits


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def overlap_bound(na: int, a: bytes, nb: int, b: bytes) -> int:
    """At least the overlap of two sets, from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = _folded(x, width), _folded(y, width)
    return min(na - int(_POP[x & ~y].sum()), nb - int(_POP[y & ~x].sum()))


def enough(overlap: int, na: int, nb: int, percent: int) -> bool:
    return 100 * overlap >= percent * (na + nb - overlap)


SIGNED = "kind int, id long, key long, blob binary"
_SIGNED_TYPES = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("blob", pa.binary())])
TEXT, MEMBER, ENTRY = 0, 1, 2  # a text: its size as key, and its digest; a member of a shared tile; a tile entry yet to be dealt


def _rows(kind: int, ids: np.ndarray, keys: np.ndarray, blobs: list | None = None) -> pa.RecordBatch:
    packed = pa.nulls(len(ids), pa.binary()) if blobs is None else pa.array(blobs, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.array(keys.view(np.int64)), packed], schema=_SIGNED_TYPES)


def _in_parts(kind: int, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), 100_000):
        yield _rows(kind, ids[at : at + 100_000], keys[at : at + 100_000])


def _runs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys sorted, with marks: first of its key, and key held more than once."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    last = np.ones(len(keys), bool)
    last[:-1] = first[1:]
    return keys, ids, first, ~(first & last)


def signed(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Texts (id, n, digest of the set) and tile members (key, id) of all tiles with two
    members or more.

    A task passes on one entry per key: the further ones it has seen are members of a shared
    tile already, so a hot tile costs the shuffle one entry per task. Spark deals and sorts the
    entries by key, so the task that finds the shared ones reads a stream and holds one entry.
    """
    spark = documents.sparkSession
    small_batches(spark, rows=20_000, mib=0.5)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, owners, count, seen = Bands(percent), [], [], 0, set()

        def flushed() -> Iterator[pa.RecordBatch]:
            keys, ids, first, shared = _runs(np.concatenate(held), np.concatenate(owners))
            yield from _in_parts(MEMBER, ids[shared], keys[shared])
            yield from _in_parts(ENTRY, ids[first], keys[first])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            ns, blobs = [], []
            for i, s in zip(ids.tolist(), shingle_sets(*text_buffer(batch.column(1)), width), strict=True):
                ns.append(len(s))
                if not len(s):
                    blobs.append(None)
                    continue
                digest = np.array([mix(s ^ c).sum(dtype=np.uint64) for c in _WORDS[8:10]]).tobytes()
                blobs.append(digest)
                if digest in seen:  # an equal set of this task stands for it
                    continue
                if len(seen) < 500_000:
                    seen.add(digest)
                keys = bands.keys(s)
                held.append(keys)
                owners.append(np.full(len(keys), i, np.int64))
                count += len(keys)
            yield _rows(TEXT, ids, np.array(ns, np.int64), blobs)
            if count > FLUSH_KEYS:
                yield from flushed()
                held, owners, count = [], [], 0
        if held:
            yield from flushed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_id, told = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the entry read last, and whether it was passed on
        for batch in batches_of(batches, 4 << 20):
            entry = batch.column("kind").to_numpy() == ENTRY
            yield batch.filter(pa.array(~entry))
            if not entry.any():
                continue
            keys = np.concatenate([last_key, batch.column("key").to_numpy()[entry]])
            ids = np.concatenate([last_id, batch.column("id").to_numpy()[entry]])
            same = np.zeros(len(keys) + 1, bool)
            same[1:-1] = keys[1:] == keys[:-1]
            shared = same[1:] | same[:-1]
            after = bool(shared[-1])
            if told:
                shared[0] = False
            told = after or (told and len(keys) == 1)
            yield from _in_parts(MEMBER, ids[shared], keys[shared])
            last_key, last_id = keys[-1:].copy(), ids[-1:].copy()

    # members found by a task, and texts, are dealt by row: their keys may be hot
    place = F.when(F.col("kind") == ENTRY, F.col("key")).otherwise(F.xxhash64("id", "key"))
    folder = new_folder(spark, "signed")
    dealt = documents.mapInArrow(sign, SIGNED).repartition(place).sortWithinPartitions("key", "id")
    dealt.mapInArrow(gather, SIGNED).write.partitionBy("kind").parquet(folder)
    out = spark.read.schema("id long, key long, blob binary, kind int").parquet(folder)
    texts = out.where(F.col("kind") == TEXT).select("id", F.col("key").cast("int").alias("n"), F.col("blob").alias("digest"))
    return texts, out.where(F.col("kind") == MEMBER).select("key", "id")


def _arrays(width: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(*text_buffer(batch.column(1)), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "n", "bits", "shingles"],
            )

    return made


def _passing_pairs(test, *columns: str):
    """Pairs (a, b) for which ``test`` holds, given the columns of both ends."""
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(f"{c}_{s}").to_pylist() for s in ("a", "b") for c in columns]
            mask = pa.array([test(*r) for r in zip(*ends, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return passed


def _near(percent: int):
    return _passing_pairs(lambda na, x, nb, y: enough(min(na, nb), na, nb, percent) and enough(overlap_bound(na, x, nb, y), na, nb, percent), "n", "bits")


def _settle(percent: int):
    return _passing_pairs(lambda x, y: _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent), "shingles")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return enough(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)


def _bounds(rows: list) -> np.ndarray:
    """At least the overlap of every two of the rows, all at once: common bits are a product
    of bit matrices."""
    width = min(8 * min(len(r["bits"]) for r in rows), WIDEST_BITS)
    packed = np.stack([_folded(np.frombuffer(r["bits"], np.uint8), width // 8) for r in rows])
    common = np.zeros((len(rows), len(rows)), np.int64)
    for at in range(0, width // 8, 512):  # 4,096 bits at a time: a matrix of all may take 64 MB
        bits = np.unpackbits(packed[:, at : at + 512], axis=1).astype(np.float32)
        common += np.rint(bits @ bits.T).astype(np.int64)
    missing = np.diagonal(common)[:, None] - common  # bits of a row that the other lacks
    n = np.array([r["n"] for r in rows], np.int64)
    return np.minimum(n[:, None] - missing, (n[:, None] - missing).T)


def _met_before(rows: list) -> np.ndarray:
    """Which pairs of rows meet in a larger tile that both name: they are compared there."""
    named = [r.get("before") or [] for r in rows]
    tiles, at = np.unique(np.array([t for named_by in named for t in named_by], np.int64), return_inverse=True)
    names = np.zeros((len(rows), len(tiles)), np.float32)
    names[np.repeat(np.arange(len(rows)), [len(x) for x in named]), at] = 1
    return names @ names.T > 0


def _passing(rows: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all overlaps, and which pairs of different components pass size and bitmap and
    are not left to a larger tile: in a block, or across two."""
    n, block = np.array([r["n"] for r in rows], np.int64), np.array([r["block"] for r in rows])
    component = np.array([r["component"] for r in rows])
    bound = _bounds(rows)
    passes = (100 * bound >= percent * (n[:, None] + n[None, :] - bound)) & (component[:, None] != component[None, :]) & ~_met_before(rows)
    if (block != block[0]).any():
        passes &= block[:, None] != block[None, :]
    return bound, np.triu(passes)


CANDIDATES = "a long, b long, key long, i int, j int, component long, block int, before array<long>"
_CANDIDATE_TYPES = pa.schema([*[(c, pa.int64()) for c in ("a", "b", "key")], ("i", pa.int32()), ("j", pa.int32()), ("component", pa.int64()), ("block", pa.int32()), ("before", pa.list_(pa.int64()))])


def _in_order(bound: np.ndarray, passes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Passing pairs, those with the largest bounds first."""
    x, y = np.nonzero(passes)
    order = np.argsort(-bound[x, y], kind="stable")
    yield from zip(x[order].tolist(), y[order].tolist(), strict=True)


def _join(rows: list, pairs: Iterator[tuple[int, int]], linked) -> list[tuple[int, int]]:
    """Those of ``pairs`` that join the components of ``rows``; ``linked`` is asked only about
    pairs whose ends are not joined already."""
    group = np.unique([r["component"] for r in rows], return_inverse=True)[1].tolist()
    out = []
    for p, q in pairs:
        a, b = group[p], group[q]
        if a != b and linked(p, q):
            group = [a if g == b else g for g in group]
            ends = rows[p]["id"], rows[q]["id"]
            out.append((min(ends), max(ends)))
    return out


def _candidates(percent: int, forest: bool):
    """What is left to compare of each block or pair of blocks, in a bounded number of rows per
    row: its passing pairs if they are few (with ``forest``, no more than rows), else the rows
    with a passing partner (``b`` is null) and, with ``forest``, the likeliest pairs that would
    join all their components."""
    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, key, i, j in zip(*[batch.column(c).to_pylist() for c in ("rows", "key", "i", "j")], strict=True):
                if len(rows) < 2:
                    continue
                bound, passes = _passing(rows, percent)
                x, y = np.nonzero(passes)
                live = np.union1d(x, y).tolist()
                if len(x) <= len(live) * (1 if forest else PAIRS_PER_ROW):
                    ends = ((rows[p]["id"], rows[q]["id"]) for p, q in zip(x.tolist(), y.tolist(), strict=True))
                    out += [(min(e), max(e), *[None] * 6) for e in ends]
                else:
                    once = {rows[p]["id"]: rows[p] for p in live}  # an id may have several texts
                    out += [(r["id"], None, key, i, j, r["component"], r["block"], r.get("before")) for r in once.values()]
                    if forest:
                        out += [(*ends, *[None] * 6) for ends in _join(rows, _in_order(bound, passes), lambda p, q: True)]
            columns = zip(*out, strict=True) if out else [[]] * len(_CANDIDATE_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CANDIDATE_TYPES.types, strict=True)], schema=_CANDIDATE_TYPES)

    return left


def _spanning(percent: int):
    """Links of a block or pair of blocks that join its components: pairs in falling order of
    their bounds, each compared exactly unless its ends are joined already."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for rows in batch.column("rows").to_pylist():
                sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]

                def linked(p: int, q: int, sets: list = sets) -> bool:
                    return _linked(sets[p], sets[q], percent)

                links += _join(rows, _in_order(*_passing(rows, percent)), linked)
            yield pa.RecordBatch.from_arrays([pa.array([e[n] for e in links], pa.int64()) for n in (0, 1)], names=["a", "b"])

    return joined


def similar_groups(documents: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id (the smallest id
    reachable by links of ``percent`` / 100 similarity or more, itself included).

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r after lower-casing A-Z; a text of
    fewer than ``width`` words has its whole sequence as one shingle. Null, empty and blank
    texts have an empty set and link with nothing. Rows that repeat an id are one node: it
    links as any of its texts does. A null id counts as one id below all others and is
    returned as null. Other columns are ignored.
    """
    rows = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    return stored_alone(documents.sparkSession, "similar-groups", lambda: _similar_groups(rows, width, percent))


def _similar_groups(rows: DataFrame, width: int, percent: int) -> DataFrame:
    spark = rows.sparkSession
    texts, members = signed(rows, width, percent)
    sets = texts.where("n > 0")
    reps = sets.groupBy("n", "digest").agg(F.min("id").alias("rep"), F.max("id").alias("other")).where("rep <> other")
    stands_for = stored(sets.join(reps.drop("other"), ["n", "digest"]).where("id <> rep").select("id", "rep").distinct(), "equal-sets")
    members = members.join(checked_broadcast(stands_for), "id", "left").select("key", F.coalesce("rep", "id").alias("id")).distinct()
    # tiles that hold one set only are done; of tiles with the same members one is enough
    content = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"content_{seed}") for seed in (1, 2)]
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("held"), *content).where("held > 1")
    several = several.groupBy("held", "content_1", "content_2").agg(F.min("key").alias("key")).select("key", "held")
    members = stored(members.join(several, "key"), "members")
    wanted = stored(members.select("id").distinct(), "wanted")
    small_batches(spark, rows=1000, mib=1)
    arrays = rows.join(checked_broadcast(wanted), "id", "left_semi").distinct().mapInArrow(_arrays(width), "id long, n int, bits binary, shingles binary")
    arrays = stored(arrays.where("n > 0"), "arrays")

    def met(pairs: DataFrame, *columns: str) -> DataFrame:
        """Stored pairs with ``columns`` of both ends; few pairs are brought to the arrays, so
        that only arrays of their ends are dealt."""
        few = is_small(pairs)
        mark = F.broadcast if few else lambda df: df
        a, b = (arrays.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in ("a", "b"))
        return mark(pairs).join(a, "a").join(b.join(mark(pairs.select("b")), "b", "left_semi") if few else b, "b")

    def verified(pairs: DataFrame) -> DataFrame:
        joined = met(pairs, "shingles")
        small_batches(spark, rows=500, mib=4)
        return stored(joined.mapInArrow(_settle(percent), "a long, b long"), "verified")

    def unlike(crowded: DataFrame) -> DataFrame:
        """Of blocks (or pairs of blocks) with the same open rows and the same larger tiles, one."""
        block, first = ["key", "i", "j"], F.col("block") == F.col("i")
        content = [F.bit_xor(F.xxhash64("id", "component", first, "before", F.lit(seed))).alias(f"content_{seed}") for seed in (1, 2)]
        kept = crowded.groupBy(*block).agg(F.count(F.lit(1)).alias("size"), *content)
        kept = kept.groupBy("size", "content_1", "content_2").agg(F.min(F.struct(*block)).alias("b")).select("b.*")
        return stored(crowded.join(kept, block, "left_semi"), "crowded")

    # every entry with the pivots of its tiles
    reach = members.groupBy("id").agg(F.sum("held").alias("reach"))
    placed = stored(members.join(reach, "id"), "reaching")
    pivots = placed.groupBy("key").agg(F.min(F.struct((-F.col("reach")).alias("r"), F.xxhash64("id").alias("h"), "id"))["id"].alias("pivot"))
    pairs = placed.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    bounded = met(stored(pairs.distinct(), "pairs"), "n", "bits")
    small_batches(spark, rows=1000, mib=4)
    links = verified(stored(bounded.mapInArrow(_near(percent), "a long, b long"), "near-pairs"))
    groups = stored(components(links.union(stands_for.select(F.col("id").alias("a"), F.col("rep").alias("b")))), "groups")

    # what is still open, in blocks
    placed = members.join(checked_broadcast(groups.withColumnRenamed("node", "id")), "id", "left")
    placed = stored(placed.select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    tiles = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    tiles = tiles.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("core")).where("core.n < size")
    tiles = stored(tiles, "open-tiles")
    cut = placed.join(tiles, "key").withColumn("tile", F.struct((-F.col("size")).alias("size"), F.col("key").alias("tile")))
    largest = cut.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("tile")), 1, LARGEST_TILES).alias("largest"))
    entries = stored(arrays.select("id", "n", "bits").join(largest, "id"), "entries")
    apart = (F.col("size") > BLOCK) & (F.col("core.n") >= BLOCK)  # the largest component has blocks of its own
    in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    cut = cut.withColumn("of_rest", in_blocks(F.col("size") - F.when(apart, F.col("core.n")).otherwise(0)))
    cut = cut.withColumn("of_core", F.when(apart, in_blocks(F.col("core.n"))).otherwise(0)).withColumn("in_core", apart & (F.col("component") == F.col("core.component")))
    spread = F.xxhash64("id")
    cut = cut.withColumn("block", F.when(F.col("in_core"), F.col("of_rest") + F.pmod(spread, F.col("of_core"))).otherwise(F.pmod(spread, F.col("of_rest"))).cast("int"))
    cut = cut.withColumn("others", F.when(F.col("in_core"), F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_core")))
    before = F.transform(F.filter("largest", lambda t: t < F.col("tile")), lambda t: t["tile"]).alias("before")
    cut = cut.join(entries, "id").select("key", "id", "component", "block", "n", "bits", before, F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    cut = cut.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    for forest in (False, True):
        packed = cut.groupBy("key", "i", "j").agg(F.collect_list(F.struct("id", "n", "bits", "component", "block", "before")).alias("rows"))
        small_batches(spark, rows=1000, mib=4)
        left = stored(packed.mapInArrow(_candidates(percent, forest), CANDIDATES), "candidates")
        groups = joined_components(groups, verified(stored(left.where("b is not null and a <> b").select("a", "b").distinct(), "pairs")))
        crowded = unlike(left.where("b is null").withColumnRenamed("a", "id").drop("b"))
        if crowded.isEmpty():
            break
        grown = crowded.drop("component").join(checked_broadcast(groups.withColumnRenamed("node", "id")), "id", "left")
        grown = grown.withColumn("component", F.coalesce("component", "id"))
        cut = grown.join(arrays.select("id", "n", "bits"), "id")
    else:
        packed = grown.join(arrays, "id").groupBy("key", "i", "j").agg(
            F.collect_list(F.struct("id", "n", "bits", "shingles", "component", "block", "before")).alias("rows")
        )
        small_batches(spark, rows=100, mib=4)
        groups = joined_components(groups, stored(packed.select("rows").mapInArrow(_spanning(percent), "a long, b long").distinct(), "links"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = texts.select("id", "n").join(checked_broadcast(groups.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(real("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("component").alias("component_id"))
