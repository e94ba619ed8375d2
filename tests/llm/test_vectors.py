"""Vector codes and centroid clustering against brute force, with odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from panelyard.llm import centroids, vector_codes
from panelyard.llm.integer_vectors import squared, squared_tile

COLUMNS = "vec_id long, embedding array<double>, label string, x int, cluster string, codes int"  # the last three clash


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(i, v, label, 1, "c", 2) for i, v, label in rows], columns)


@pytest.fixture(scope="module")
def vectors():
    """Groups of close vectors, copies, ties, nulls, short and broken vectors, null ids."""
    rng = random.Random(11)
    rows = []
    for i in range(260):
        centre = [(i % 7) * 0.2 - 0.5] * 64
        rows.append((i, [c + rng.gauss(0, 0.1) for c in centre], f"l{i % 5}" if i % 9 else None))
    same = [0.25] * 64
    rows += [(1000 + i, same, "hot") for i in range(120)] + [(3, rows[3][1], "l3"), (3, rows[4][1], "l3")]
    rows += [(None, rows[5][1], "l0"), (None, [0.0] * 64, None), (2000, [0.0] * 64, "zero"), (2001, [-3.5] * 64, "far"), (-7, [900.0] * 64, "far")]
    rows += [(2002, None, "n"), (2003, [], "n"), (2004, [1.0] * 63 + [None], "n"), (2005, [1.0] * 63 + [math.nan], "n"), (2006, [math.inf] * 64, "n")]
    rows += [(2007, [1.0] * 32, "n"), (2008, [1.0] * 65, "n")]
    return rows


def usable(rows, scale):
    good = [(i, v, label) for i, v, label in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, tuple(math.floor(scale * x) for x in v), label) for i, v, label in good]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def rounds_of(points, entries, rounds):
    """Entries after ``rounds``, and the last assignment (entry, distance)."""
    def assigned():
        return [min((distance(p, e), n) for n, e in enumerate(entries)) for p in points]

    for _ in range(rounds):
        found = assigned()
        new = []
        for n, e in enumerate(entries):
            mine = [p for p, (_, m) in zip(points, found, strict=True) if m == n]
            new.append(tuple(sum(c) // len(mine) for c in zip(*mine, strict=True)) if mine else e)
        entries = new
    return entries, assigned()


def little_endian(v):
    return np.array(v, np.int32).tobytes()


def digest(*vectors):
    return hashlib.sha256(",".join(str(x) for v in vectors for x in v).encode()).hexdigest()


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 6), (1, 2)])
def test_centroids(spark, vectors, k, rounds):
    kept = usable(vectors, 64)
    order = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), little_endian(r[1])))
    entries, found = rounds_of([v for _, v, _ in kept], [v for _, v, _ in order[:k]], rounds)
    total = Counter()
    for d, c in found:
        total[c] += d
    expected = Counter((i, c, d, total[c], sum(total.values()), digest(entries[c])) for (i, _, _), (d, c) in zip(kept, found, strict=True))
    got = centroids.cluster(frame(spark, vectors).repartition(5), k=k, rounds=rounds)
    assert Counter(tuple(r)[:6] for r in got.collect()) == expected
    assert all(r["centroid"] == list(entries[r["cluster"]]) for r in got.collect())


def test_bounds_skip_and_hold():
    """Loosened bounds never pass a true distance, and most evaluations are saved once the
    centroids settle."""
    rng = np.random.default_rng(4)
    x = (rng.integers(0, 12, (3000, 1)) * 40 + rng.normal(0, 3, (3000, 8))).astype(np.int32)
    history = x[:12].astype(np.int64)[None]
    state, counts = centroids.Bounds.first(x, history[0]), []
    for _ in range(8):
        new = np.stack([x[state.cluster == c].sum(axis=0) // max((state.cluster == c).sum(), 1) if (state.cluster == c).any() else history[-1][c] for c in range(12)])
        history = np.concatenate([history, new[None]])
        upper, lower = state.loosened(history)
        true = np.sqrt(np.stack([squared(x, c[None, :]) for c in new], axis=1).astype(float))
        assert (lower <= true + 1e-6).all()
        assert (upper + 1e-6 >= true[np.arange(len(x)), state.cluster]).all()
        counts.append(state.advance(history))
        assert (state.cluster == np.round(true**2).argmin(axis=1)).all()
    assert counts[-1] < 0.2 * 12 * len(x)


@pytest.mark.parametrize("entries,rounds", [(256, 4), (9, 3)])
def test_vector_codes(spark, vectors, entries, rounds):
    kept = usable(vectors, 1024)
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, little_endian(r[1])))
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        cut = lambda v, p=p: v[16 * p : 16 * p + 16]
        book, found = rounds_of([cut(v) for _, v, _ in kept], [cut(v) for _, v, _ in order[:entries]], rounds)
        books += book
        for n, (d, c) in enumerate(found):
            codes[n] += f"{c:02x}"
            errors[n] += d
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    expected = Counter((i, code, e, by_label[label]) for (i, _, label), code, e in zip(kept, codes, errors, strict=True))
    rows, found = vector_codes.compress(frame(spark, vectors).repartition(5), entries=entries, rounds=rounds)
    assert Counter((r["vec_id"], r["codes"].hex(), r["error"], r["label_error"]) for r in vector_codes.with_label_error(rows).collect()) == expected
    assert vector_codes.codebooks_sha256(found) == digest(*books)
    sources = {(i, v) for i, v, _ in kept}
    for r in vector_codes.decompress(rows, found).collect():
        assert r["error"] in {distance(v, r["decoded"]) for i, v in sources if i == r["vec_id"]}


def test_pivots_prune():
    """The nearest entry is found exactly with fewer evaluations than all pairs; ties go down."""
    rng = np.random.default_rng(2)
    rows = (rng.integers(0, 30, (2500, 1)) * 100 + rng.integers(-20, 20, (2500, 16))).astype(np.int32)
    entries = np.concatenate([rows[:100], rows[:20]]).astype(np.int64)  # the last twenty tie with the first
    pivots = vector_codes.choose_pivots(entries, 6)
    gaps = vector_codes.to_pivots(rows, pivots).astype(np.float32).astype(float)
    codes, best, evaluated = vector_codes.nearest(rows, gaps, entries, vector_codes.to_pivots(entries, pivots))
    every = np.stack([squared(rows, e[None, :]) for e in entries], axis=1)
    assert (codes == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < 0.5 * every.size


def test_tiles_are_exact():
    rng = np.random.default_rng(7)
    for most in (5, 1 << 20, 1 << 26):
        rows, entries = (rng.integers(-most, most, (n, 16), endpoint=True).astype(np.int32) for n in (40, 9))
        assert squared_tile(rows, entries).tolist() == [[distance(r, e) for e in entries.tolist()] for r in rows.tolist()]


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, "a"), (None, [], None), (2, [math.nan] * 64, "b")]):
        made, books = vector_codes.compress(frame(spark, rows))
        assert books.size == 0
        assert vector_codes.with_label_error(made).columns == ["vec_id", "label", "codes", "error", "label_error"]
        assert vector_codes.with_label_error(made).count() == 0
        assert vector_codes.decompress(made, books).count() == 0
        assert centroids.cluster(frame(spark, rows)).count() == 0


def test_too_large_components(spark):
    with pytest.raises(Exception, match="no exact 64-bit distance"):
        centroids.cluster(frame(spark, [(1, [1e30] * 64, "a")]))


def test_rare_labels_are_joined(spark):
    """Labels below a thousandth of the rows take the other join."""
    rows = [(i, [float(i % 3), 0.0, 1.0, 2.0], "hot" if i % 2 else f"l{i}") for i in range(2400)]
    made, _ = vector_codes.compress(frame(spark, rows, COLUMNS), entries=2, rounds=1)
    got = vector_codes.with_label_error(made).collect()
    by_label = Counter()
    for r in got:
        by_label[r["label"]] += r["error"]
    assert len(got) == 2400 and all(by_label[r["label"]] == r["label_error"] for r in got)
