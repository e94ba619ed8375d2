"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from panelyard.llm import bpe, chat, common, decontamination, embedding_dedup, jaccard_join, license_scan, sharding, suffix_dedup, toxicity, warc
from panelyard.llm.queries import tokenizer

DOCS = "doc_id long, text string, _i int, start string, component string"  # the last three clash with names used inside


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], DOCS)


def words(rng, n, vocabulary=400):
    return [f"{'aeiou'[k % 5]}w{k}" for k in (rng.randrange(vocabulary) for _ in range(n))]


@pytest.fixture(scope="module")
def corpus():
    """Near copies, exact copies, shared passages, repeated lines, odd characters, nulls."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "One"), (5, "É é ñandú  x"), (6, "a" * 700), (7, "ab" * 400), (None, "null id " + passage)]
    base = words(rng, 150)
    for k in range(12):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = f"edit{k}"
        rows.append((100 + k, " ".join(near)))
    for k in range(10):
        own = " ".join(words(rng, 40 + 7 * k, 5000))
        rows.append((200 + k, f"{own}\n{passage if k % 3 == 0 else ''}\nÜber {own[:130]}"))
    rows += [(300, rows[20][1]), (301, rows[20][1]), (301, rows[20][1])]
    long = " ".join(words(rng, 9000, 3000))
    return [*rows, (400, long), (401, long[1000:30000])]


def linked_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, corpus, width, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    key = lambda i: -(1 << 63) if i is None else i
    sets = [(key(i), shingles(t)) for i, t in corpus]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = linked_components(links, {i for i, _ in sets})
    expected = Counter((i, len(shingles(t)), None if root[key(i)] == key(None) else root[key(i)]) for i, t in corpus)
    found = jaccard_join.similar_groups(docs_frame(spark, corpus), width, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == expected


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.similar_groups(docs_frame(spark, [])).count() == 0


def test_jaccard_many_near_copies(spark):
    """Chains of near copies around the threshold, more than one block of them."""
    rng = random.Random(8)
    base = words(rng, 60, 10_000)
    rows = []
    for k in range(320):
        t = list(base)
        for _ in range(1 + k % 3):
            t[rng.randrange(60)] = f"e{k}"
        rows.append((k, " ".join(t)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(57)} for _, t in rows]
    links = [(a, b) for a in range(320) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = linked_components(links, range(320))
    found = jaccard_join.similar_groups(docs_frame(spark, rows), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == root


def test_jaccard_core_and_rest_of_a_tile(spark, monkeypatch):
    """A tile of several blocks: a group that meets its pivot, texts near one of its members only,
    and texts far from all. Links are found in few stored steps, and only the result stays."""
    rng = random.Random(9)
    base = words(rng, 80, 10_000)
    rows = []
    for k in range(640):
        t = list(base)
        for at in rng.sample(range(80), 1 if k < 420 else 2 if k < 540 else 3):
            t[at] = f"e{k}x{at}"
        rows.append((k, " ".join(t)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(77)} for _, t in rows]
    links = [(a, b) for a in range(640) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 88 * len(sets[a] | sets[b])]
    root = linked_components(links, range(640))
    assert len(set(root.values())) > 100
    names = []
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: (names.append(name), f(df, name))[1])
    folder = f"{common.shared_folder(spark).removeprefix('file:')}/llm"
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = jaccard_join.similar_groups(docs_frame(spark, rows), 4, 88).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == root
    assert len(names) <= 30
    assert [name.rpartition("-")[0] for name in set(os.listdir(folder)) - there] == ["similar-groups"]


def test_jaccard_far_copies_pass_seldom():
    """A block of texts that share most shingles with one original, but too few with each other:
    almost none of them is left to compare."""
    rng = np.random.Generator(np.random.PCG64(4))
    sets = []
    for _ in range(120):
        base = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 250, dtype=np.uint64)
        base[rng.choice(250, 18, replace=False)] = rng.integers(0, 1 << 64, 18, dtype=np.uint64)
        sets.append(np.sort(base))
    rows = [{"id": i, "n": 250, "bits": jaccard_join.bitmap(s), "component": i, "block": 0} for i, s in enumerate(sets)]
    block = pa.RecordBatch.from_pylist([{"rows": rows, "key": 1, "i": 0, "j": 0}])
    assert sum(b.num_rows for b in jaccard_join._candidates(85, True)([block])) < 30


def test_jaccard_pairs_of_many_tiles_are_given_once():
    """Rows that meet in twenty tiles with equal neighbours, all pairs passing: a tile gives only
    pairs whose ends name no larger tile in common."""
    shingles = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 64, 100, dtype=np.uint64)
    tiles = list(range(20))

    def block(tile, members):
        named = {i: [t for t in tiles[:8] if t < tile and (i != 9 or t >= 5)] for i in members}  # row 9 is in no tile before the fifth
        rows = [{"id": i, "n": 100, "bits": jaccard_join.bitmap(shingles), "component": i, "block": 0, "before": named[i]} for i in members]
        return pa.RecordBatch.from_pylist([{"rows": rows, "key": tile, "i": 0, "j": 0}])

    blocks = [block(t, range(9) if t < 5 else range(10)) for t in tiles]
    for forest in (True, False):
        found = [r for b in jaccard_join._candidates(85, forest)(iter(blocks)) for r in b.to_pylist()]
        assert {r["key"] for r in found if r["b"] is None} <= {0, 5} and len(found) <= 60
        linked = {x for r in found if r["b"] is not None for x in (r["a"], r["b"])} | {r["a"] for r in found if r["b"] is None}
        assert linked == set(range(10))
    rows = block(5, range(10)).column("rows").to_pylist()[0]
    assert {tuple(p) for p in np.argwhere(jaccard_join._passing(rows, 85)[1]).tolist()} == {(i, 9) for i in range(9)}


def test_jaccard_blank_texts_of_repeated_ids(spark):
    """Ids with a blank text besides others that meet, but are not similar enough."""
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t) for i in (1, 2) for t in ("", None, f"{shared} " + " ".join(f"v{i}x{j}" for j in range(12)))]
    found = jaccard_join.similar_groups(docs_frame(spark, rows), 4, 85).collect()
    assert all(r["component_id"] == r["doc_id"] for r in found) and len(found) == 6


def removed_by_brute_force(rows, least):
    first = {}
    texts = {(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows}
    for i, b in sorted(texts):
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = {}
    for i, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < (i, s):
                gone[s : s + least] = [True] * least
        out[i, b] = gone
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", hot)
    rows = corpus[:-2] + [(400, corpus[-2][1][:6000]), (401, corpus[-2][1][1000:5000])]
    gone = removed_by_brute_force(rows, 100)
    found = suffix_dedup.remove_repeats(docs_frame(spark, rows), 100).collect()
    expected = Counter()
    for i, t in rows:
        b = (t or "").encode()
        g = gone[-(1 << 63) if i is None else i, b]
        runs = sum(x and not y for x, y in zip(g, [False, *g], strict=False))
        expected[i, bytes(c for c, x in zip(b, g, strict=True) if not x), sum(g), runs] += 1
    assert Counter((r["doc_id"], bytes(r["kept"]), sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"])) for r in found) == expected


def test_suffix_dedup_by_character_keeps_utf8(spark):
    shared = "ñandú über " * 12
    rows = [(1, "x" + shared + "á"), (2, "é" + shared + "ö")]
    for r in suffix_dedup.remove_repeats(docs_frame(spark, rows), 100, by_character=True).collect():
        bytes(r["kept"]).decode("utf-8")
    assert suffix_dedup.remove_repeats(docs_frame(spark, []), 100).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_suffix_dedup_rows_that_share_an_id(spark, key):
    """Each loses what repeats in its own text, also at the place where another text has it."""
    rng = random.Random(12)
    shared, alone, first, second = (" ".join(words(rng, 30, 100_000)).encode()[:150].decode() for _ in range(4))
    rows = [(key, first + shared), (key, second + shared), (key, alone * 2), (key, alone * 2), (key, "short"), (9, shared)]
    found = suffix_dedup.remove_repeats(docs_frame(spark, rows), 100).collect()
    kept = Counter((r["doc_id"], bytes(r["kept"]).decode()) for r in found)
    whole = [h for h in (first, second) if kept[key, h + shared]]
    assert len(found) == len(rows) and len(whole) == 1  # the first of them keeps the passage
    other = second if whole[0] == first else first
    assert kept == Counter([(key, whole[0] + shared), (key, other), (key, alone), (key, alone), (key, "short"), (9, "")])


def test_suffix_dedup_bounds_a_transform(spark, monkeypatch):
    """A shared passage with other bytes before it in every document: no task gets the pieces of
    all of them, and the result is that of brute force."""
    rng = random.Random(14)
    passage = " ".join(words(rng, 40, 100_000))
    rows = [(k, f"{rng.randrange(10**12):012d}{passage}{rng.randrange(10**12):012d}") for k in range(60)]
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_STRIPE", 5, raising=False)
    monkeypatch.setattr(suffix_dedup, "BUCKET_SEGMENTS", 3, raising=False)
    whole = suffix_dedup.covered_starts

    def bounded(held, least):
        assert len(held) <= 5
        return whole(held, least)

    monkeypatch.setattr(suffix_dedup, "covered_starts", bounded)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1)
    gone = removed_by_brute_force(rows, 100)
    for r in suffix_dedup.remove_repeats(docs_frame(spark, rows), 100).collect():
        text = rows[r["doc_id"]][1].encode()
        assert bytes(r["kept"]) == bytes(c for c, x in zip(text, gone[r["doc_id"], text], strict=True) if not x)


def test_interval_classes():
    rng = random.Random(3)
    text = bytes(rng.choice(b"\1\2\3") for _ in range(700)) + b"\0"
    text += text[:300] + b"\0"
    cls = suffix_dedup.interval_classes(np.frombuffer(text, np.uint8), 100)
    seen = {}
    for i in range(len(text) - 100):
        if 0 not in text[i : i + 100]:
            assert seen.setdefault(text[i : i + 100], cls[i]) == cls[i]
    assert len(set(seen.values())) == len(seen)


def test_bpe_equals_the_library(spark, corpus, monkeypatch):
    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = ["'l", "it'll 're  \n\n x", " \t\n", "a" * 3000, "'" * 50 + "s", "日本語テキスト" * 40, "0123 " * 99, "  x", "é" * 9, "\U0001f600" * 9, "<|endoftext|>", " " * 300 + "x"]
    rows = corpus[:-2] + [(500 + n, t) for n, t in enumerate(odd)] + [(600, corpus[-1][1][:9000])]
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 37)  # many segments and joins
    got = bpe.decode(bpe.encode(docs_frame(spark, rows), path, pattern), path).collect()
    found = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got)
    assert found == Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)


def test_bpe_caches_are_bounded():
    path, pattern = tokenizer()
    ranks = bpe.read_ranks(path)
    encoder, free = bpe.Encoder(ranks, pattern, 50), bpe.Encoder(ranks, pattern)
    matches = [f" unseen{i}word" for i in range(400)]
    assert encoder.encode_matches(matches) == free.encode_matches(matches)
    assert max(len(c) for c in (encoder.parts, encoder.pairs, encoder.matches)) <= 51 < len(free.matches)


def test_pipeline_takes_one_python_worker_a_task(spark):
    """Encoding and decoding in one task would hold two workers, with the caches of both."""
    import corpus_pipeline

    rows = [(1, "One text, two"), (2, None), (3, "x y " * 20_000)]
    made = corpus_pipeline.tokenize(spark, docs_frame(spark, rows), "")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan
    got = {r["doc_id"]: r for r in made.collect()}
    assert len(got) == 3 and got[1]["round_trip"] and got[3]["round_trip"] and got[3]["n_tokens"] > 0


def test_bpe_joins_at_every_place():
    path, pattern = tokenizer()
    encoder = bpe.Encoder(bpe.read_ranks(path), pattern)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("'sltrevmd  \n\tabcXYZ.,!éß12日") for _ in range(40))
        cut = rng.randrange(41)
        whole = encoder.scan.findall(text)
        assert encoder.join_matches(encoder.scan.findall(text[:cut]), encoder.scan.findall(text[cut:])) == whole


def test_decontamination(spark, corpus):
    sep = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: sep.findall(ascii_lower(t or ""))
    rng = random.Random(6)
    long = split(corpus[-2][1])
    items = [(1, " ".join(long[500:530])), (2, "One"), (3, None), (4, ""), (12, " ".join(long[505:518]).upper()), (5, " ".join(words(rng, 20))), (None, "É ñandú é"), (1, " ".join(long[500:530]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for s in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[s : s + 10])].add("null" if i is None else str(i))
    expected = Counter()
    for i, t in corpus:
        w, hit, ids = split(t), set(), set()
        for x, owners in windows.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    ids |= owners
        expected[i, len(w), len(hit), ",".join(sorted(ids)), bool(hit)] += 1
    found = decontamination.decontaminate(docs_frame(spark, corpus), bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in found) == expected
    none = decontamination.decontaminate(docs_frame(spark, corpus), bench.limit(0)).where("contaminated").count()
    assert none == 0 and decontamination.decontaminate(docs_frame(spark, []), bench).count() == 0


def test_decontamination_proximity(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    moved = "alpha beta gamma x delta epsilon zeta eta theta iota kappa"
    docs = docs_frame(spark, [(1, text), (2, moved), (3, "alpha kappa")])
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = {r["doc_id"]: (r["contaminated"], r["n_near"] > 0) for r in decontamination.decontaminate(docs, bench, slop=2).collect()}
    assert rows[1][0] and rows[2] == (False, True) and rows[3] == (False, False)


def test_license_scan(spark):
    rows = [
        (1, "x\nReleased under the MIT License.", "a/LICENSE"), (2, "nothing", "a/b/c.txt"), (3, "Licensed under the Apache License, Version 2.0.\ncode", "a/b/d.txt"),
        (4, None, "a/b/e/f.txt"), (5, "plain", "z/q.txt"), (6, "Licensed under CC BY-NC 4.0.", "a/b/COPYING"), (6, "Licensed under CC BY-NC 4.0.", "a/b/COPYING"), (7, "licensed drivers only", None),
    ]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
    got = {(r["doc_id"], r["license"], r["inherited_from"]) for r in found}
    assert len(found) == len(rows)
    assert got == {(1, "MIT", None), (2, "CC-BY-NC-4.0", "a/b"), (3, "Apache-2.0", None), (4, "CC-BY-NC-4.0", "a/b"), (5, None, None), (6, "CC-BY-NC-4.0", None), (7, None, None)}


@pytest.mark.parametrize("small", [True, False])
def test_license_scan_weighs_words_outside_templates(spark, small, monkeypatch):
    """Words that the corpus holds often weigh little, however many lines there are."""
    monkeypatch.setattr(license_scan, "is_small", lambda df: small, raising=False)
    header = "Licensed under the Apache License, Version 2.0 Copyright 2024"
    for n in (10, 2000):
        rows = [(k, header if k % 2 else f"Copyright 2024 own{k}", f"d{k}/x.txt") for k in range(n)]
        found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
        assert {(r["doc_id"] % 2, r["own_license"]) for r in found} == {(0, None), (1, "Apache-2.0")}


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(6000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    graded = toxicity.grade(docs, train).join(held.select("doc_id", F_col("toxic").alias("truth")), "doc_id").collect()
    wrong = [r for r in graded if r["toxic"] != (r["truth"] == 1)]
    assert len(graded) > 300 and len(wrong) <= 0.02 * len(graded)
    assert all(0 <= r["severity"] <= 3 for r in graded)


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_toxicity_odd_rows(spark, corpus):
    docs = docs_frame(spark, corpus)
    one_sided = spark.createDataFrame([(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert {(r["severity"], r["toxic"]) for r in toxicity.grade(docs, one_sided).collect()} == {(0.0, False)}
    assert toxicity.grade(docs_frame(spark, []), one_sided).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 600)
    at = np.flatnonzero(grades)
    w, thresholds = toxicity.fit(at, np.zeros(len(at), np.int64), grades[at].astype(float), grades, 2)
    model = toxicity.Model({"bad": 0, "unused": 1}, w, thresholds)
    scores = model.scores(["", "bad", "bad bad", "bad bad bad"])
    assert list(np.sort(scores)) == list(scores) and np.all(np.diff(thresholds) > 0) and scores[3] > 2


def test_flow_moves_the_least():
    rng = random.Random(2)
    for _ in range(40):
        old, new = rng.randrange(1, 6), rng.randrange(1, 9)
        supply = [rng.randrange(0, 1000) for _ in range(old)]
        even = -(-sum(supply) // new)
        flow = sharding.minimum_cost_transfers(supply, [even] * new)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= even for c in zip(*flow, strict=True))
        moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
        assert moved == sum(max(0, s - (even if i < new else 0)) for i, s in enumerate(supply))


def test_resharding(spark, corpus, tmp_path):
    spark.createDataFrame([(i, t, n, 0) for n, (i, t) in enumerate(corpus * 20)], "doc_id long, text string, _file int, shard int").repartition(7).write.parquet(f"{tmp_path}/t")
    for stretch in (1024, 3):
        sharding.STRETCH_ROWS = stretch
        rows, manifest = sharding.reshard(spark, f"{tmp_path}/t")
        got = rows.select("row.doc_id", "row.text", "row._file", "shard", "slot").collect()
        assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, t, n) for n, (i, t) in enumerate(corpus * 20))
        size, slots = Counter(), defaultdict(list)
        for r in got:
            size[r["shard"]] += len((r["text"] or "").encode()) + 1
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) == set(range(8))
        assert max(size.values()) - min(size.values()) <= 1.5 * (len(corpus[-2][1]) + 1)
        assert sum(m["rows"] for m in manifest.collect()) == len(got)
    sharding.STRETCH_ROWS = 1024
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e")
    assert sharding.reshard(spark, f"{tmp_path}/e")[0].count() == 0


def test_resharding_files_of_one_name(spark, tmp_path):
    """Two folders of a table hold a file of the same name: every row comes back once."""
    table = tmp_path / "a table"
    for k in (1, 2):
        spark.createDataFrame([(1000 * k + i, f"text {k} {i} " * (i % 9)) for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(f"{table}/k={k}")
        next((table / f"k={k}").glob("part-*.parquet")).rename(table / f"k={k}" / "part-0.parquet")
    for crc in table.glob("k=*/.*.crc"):
        crc.unlink()
    rows, manifest = sharding.reshard(spark, str(table))
    got = rows.select("row.doc_id", "row.k", "shard", "slot").collect()
    assert sorted((r[0], r[1]) for r in got) == [(1000 * k + i, k) for k in (1, 2) for i in range(300)]
    assert len({(r["shard"], r["slot"]) for r in got}) == 600
    assert sum(m["rows"] for m in manifest.collect()) == 600


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(n, (centres[n % 6] + rng.normal(size=16) * 0.08 * (n % 3)).tolist(), n % 2) for n in range(150)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (204, rows[0][1], 0), (205, rows[0][1], 0), (205, rows[0][1], 0), (206, [1.0, None], 0), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (None, rows[0][1], 0), (209, [], 1)]
    frame = spark.createDataFrame([(i, v, c, "x") for i, v, c in rows], "vec_id long, embedding array<double>, label int, rep string")
    usable = lambda i, v, c: i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(n, i, np.array(v), c) for n, (i, v, c) in enumerate(rows) if usable(i, v, c)]
    links = [(m, n) for m, i, u, c in good for n, j, v, d in good if m != n and c == d and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98]
    degree = Counter(m for m, _ in links)
    root = linked_components(links, range(len(rows)))
    smallest = defaultdict(lambda: 1 << 60)
    for n, (i, _, _) in enumerate(rows):
        smallest[root[n]] = min(smallest[root[n]], 1 << 60 if i is None else i)
    expected = Counter((i, degree[n], None if i is None else smallest[root[n]]) for n, (i, _, _) in enumerate(rows))
    for block in (512, 7):
        found = embedding_dedup.near_duplicates(frame, block_rows=block).collect()
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == expected
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "u1", "<p>WARC/1.1\r\n\r\nñ</p>"), (2, None, None), (3, "u3\r\nX: y", ""), (4, "u4", "<p>WARC/1.1\r\n\r\nñ</p>"), (5, "u5", "z" * 9000), (4, "u4", "<p>WARC/1.1\r\n\r\nñ</p>"), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    stored = warc.numbered(pages)
    warc.write_archives(stored, warc.resolve(stored), f"{tmp_path}/w", records_per_file=2)
    records = warc.read_archives(spark, f"{tmp_path}/w")
    import base64

    expected, answered = Counter(), set()
    for i, _, h in rows:  # every row is a record; repeated rows revisit the first of them
        b = (h or "").encode()
        same = max((j for j, _, g in rows if (g or "").encode() == b and j is not None), default=None)
        response = i == same and b not in answered
        answered |= {b} if response else set()
        expected[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else same] += 1
    assert Counter(tuple(r) for r in warc.joined_revisits(records).collect()) == expected
    assert sorted(str(r["target_uri"]) for r in records.collect()) == sorted(str((u or "")).replace("\r\n", " ") for _, u, _ in rows)
    empty = warc.numbered(pages.limit(0))
    assert warc.resolve(empty).count() == 0
    assert {bytes(r["payload"]).decode() for r in records.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "plain"), (1, 1, "assistant", "answer"), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "back\\slash <s> \\<\\s>"), (3, None, None, None),
        (4, 1, "assis\ntant", "role with newline"), (4, 0, "user", "tie b"), (4, 0, "user", "tie a"), (4, 0, "user", "tie a"), (None, 0, "system", "x\n\n</s>"), (5, 0, "assistant", ""), (6, 0, "\\", "\\"),
    ]
    made = chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")).collect()
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["recovered"]] for r in made} == {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    assert {r["conv_id"]: r["level"] for r in made}[1] == 0 and {r["conv_id"]: r["level"] for r in made}[2] == 1


def test_chat_escapes_every_control_string(spark):
    rows = [(n, 0, "user", f"a {mark} b") for n, mark in enumerate(chat.CONTROL)] + [(20, 0, "[INST]", "in the role"), (21, 0, "user", "[INST plain <s")]
    for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert [tuple(t) for t in r["recovered"]] == [rows[[x[0] for x in rows].index(r["conv_id"])][2:]]
        inside = r["formatted"].removeprefix("<s>").removesuffix("</s>")
        assert not any(mark in inside for mark in chat.CONTROL) and r["level"] == (0 if r["conv_id"] == 21 else 1)
