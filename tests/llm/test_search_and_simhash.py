"""Lexical search, whitening and SimHash dedup against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from concourse.llm import lexical_search, simhash_dedup, whitening

WORDS = [f"w{i}" for i in range(40)] + ["Straße", "漢字", "ÑANDÚ", "x2"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# ---- lexical search


def searched(items, docs, k):
    """Plain scores in Python's integers."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // max(1, n_terms)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, q in Counter(cut(text)).items() if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def search_rows(spark, items, docs, k=5):
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, rank int")
    return sorted(map(tuple, lexical_search.search(asked, table, k).collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOC_TILE", 7)
    monkeypatch.setattr(lexical_search, "ITEM_TILE", 3)
    monkeypatch.setattr(lexical_search, "TERM_TILE", 11)
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 400)
    monkeypatch.setattr(lexical_search, "PIECE", 100)
    docs = [(i, prose(i % 30, 3 + 5 * (i % 13))) for i in range(60)]  # copies make ties
    docs += [(100, None), (101, ""), (102, " \t,;"), (103, "W1 w1\x00w1-w2_W3"), (103, "w1"), (None, "w1 w2 w3"), (104, "w5 " * 3000)]
    items = [(i, prose(100 + i, 1 + 3 * i)) for i in range(14)] + [(50, None), (51, ""), (52, "nowhere"), (53, "w1 w1 w1 W1"), (54, "漢字 ñandú ÑANDÚ")]
    assert search_rows(spark, items, docs) == searched(items, docs, 5)


def test_search_of_empty_tables_and_repeated_items(spark):
    assert search_rows(spark, [], [(1, "a")]) == []
    assert search_rows(spark, [(1, "a")], []) == []
    assert search_rows(spark, [(1, "w1"), (1, "w1"), (None, "w1")], [(1, "w1"), (2, "w2 w3"), (3, "w3")]) == searched([(1, "w1")], [(1, "w1"), (2, "w2 w3"), (3, "w3")], 5)


def test_parts_of_a_tile_stay_exact():
    # one term so often that its weight alone passes what a float64 sum may hold
    weights = np.array([20_000, 3, 0, 7])
    tiles = lexical_search.item_tiles([{0: 1_000_000, 1: 5, 2: 9}, {3: 1}], weights)
    assert all(np.bincount(row, value).max() <= lexical_search.EXACT for _, _, parts in tiles for _, row, _, value in parts) and len(tiles[0][2]) > 1
    doc, ids, impacts = np.array([0, 0, 1]), np.array([0, 1, 3]), np.array([999_999, 12, 8])
    scores = lexical_search.tile_scores(tiles[0], 4, doc, ids, impacts, 2)
    assert scores.tolist() == [[20_000 * 1_000_000 * 999_999 + 3 * 5 * 12, 0], [0, 56]]


def test_best_of_a_tile_takes_the_leftmost_of_equal_scores():
    keep, low = lexical_search.best_of_tile(np.array([[5, 7, 5, 5, 0], [0, 0, 0, 3, 0], [1, 1, 1, 1, 1]]), 3)
    assert [np.flatnonzero(k).tolist() for k in keep] == [[0, 1, 2], [3], [0, 1, 2]] and low.tolist() == [5, 0, 1]
    assert lexical_search.best_of_tile(np.array([[2, 0]]), 3)[0].tolist() == [[True, False]]


# ---- whitening


def test_whitening_equals_plain_linear_algebra(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 64)  # several blocks and tasks
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    r = np.random.default_rng(5)
    base = r.normal(size=(90, 6)) * [5, 4, 3, 2, 1, 0.5]
    rows = [(i, v.tolist(), "k", 1) for i, v in enumerate(base)]
    rows += [(200 + i, base[3].tolist(), "k", 1) for i in range(40)] + [(None, base[4].tolist(), "k", 1)]
    rows += [(300, None, "k", 1), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0], "k", 1), (302, [float("nan")] * 6, "k", 1), (303, [float("inf")] * 6, "k", 1), (304, [], "k", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, index string, n int")
    found = whitening.whiten(table).collect()
    x = np.floor(256 * base).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for row in found:
        by.setdefault(row["vec_id"], {}).setdefault(row["component"], []).append(row)
    assert set(by) == set(range(90)) | {200 + i for i in range(40)} | {None} and len(found) == 131 * 4
    signs = {}
    for vec_id, parts in by.items():
        one = x[4 if vec_id is None else 3 if vec_id >= 200 else vec_id]
        for c, (row,) in parts.items():
            expected = (one - sums / n) @ axes[:, c - 1] / math.sqrt(values[c - 1])
            signs.setdefault(c, np.sign(expected * row["whitened"]))
            assert row["n"] == n and row["deviation"] == int(((n * one - sums) ** 2).sum())
            assert abs(signs[c] * row["whitened"] - expected) < 1e-9 and abs(row["explained"] - values[c - 1] / values.sum()) < 1e-9 and 0 <= row["identity_error"] < 1e-9


def test_whitening_of_few_or_flat_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # two lengths are whitened apart; a flat dimension is no component
    rows = [(1, [0.0, 1.0, 3.0]), (2, [1.0, 1.0, 3.0]), (3, [0.0, 2.0, 3.0]), (4, [1.0, 0.0]), (5, [0.0, 0.0])]
    got = sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 6)) for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (5, 1)] and got[-1][2] == got[-2][2] == 1.0


# ---- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """The smallest id reachable over links of three bits or fewer."""
    top = {i: i for i, _ in fps}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, f in fps:
        for j, g in fps:
            if i < j and (f ^ g).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i, _ in fps}


def test_fingerprints_equal_the_definition(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "PIECE", 40)
    for text in (None, "", " \n\t", "One", "one TWO", "a b c", "ÄÖ ä é", "a b c\x0bd\x1ce f", prose(1, 500), "x" * 500, "ab " * 300):
        assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)


def test_every_ball_of_three_bits_is_linked(spark):
    r = random.Random(2)
    fps = {0, 2**64 - 1, 2**63}
    for _ in range(30):
        one = r.getrandbits(64)
        for _ in range(6):  # chains and clusters
            fps.add(one)
            for b in r.sample(range(64), r.randint(1, 5)):
                one ^= 1 << b
    for pair in ((0, 1, 2), (0, 1, 40), (0, 33, 63), (31, 32, 33), (10,), (5, 60)):  # each split of the bits over the halves, from even and odd
        for base in (0x0123456789ABCDEF, 0x0123456789ABCDEE):
            base ^= r.getrandbits(40) << 20
            fps |= {base, base ^ sum(1 << b for b in pair)}
    fps = sorted(fps)
    signed = lambda f: f - (f >> 63 << 64)
    links = simhash_dedup.ball_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), shares=3).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 and a != b for a, b in links)
    number = {signed(f): i for i, f in enumerate(fps)}
    joined = components([(i, f) for i, f in enumerate(fps)])
    top = {i: i for i in range(len(fps))}
    for _ in range(len(fps)):
        before = dict(top)
        for a, b in links:
            low = min(top[number[a]], top[number[b]])
            top[number[a]] = top[number[b]] = low
        if top == before:
            break
    assert top == joined


def test_simhash_of_documents_equals_brute_force(spark):
    long = prose(9, 4000)
    texts = [None, "", " ", "one", "One", prose(1, 300), prose(1, 300), prose(1, 299), prose(1, 300) + " extra", prose(2, 50), prose(3, 50), long, long + " w1", long.replace("w3 w4", "w4 w3", 1)]
    texts += [prose(1, 300).replace(" ", "\t", 3).upper() for _ in range(20)]
    rows = [(7 + i, t, i) for i, t in enumerate(texts)]
    found = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int"), shares=2).collect()
    fps = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    expected = components(fps)
    assert sorted(map(tuple, found)) == [(i, f"{f:016x}", expected[i]) for i, f in fps]
    assert len({r["component_id"] for r in found}) < len(found)


def test_simhash_of_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d"), (5, "q r s t u"), (None, "a b c d"), (3, "q r s t u"), (None, "alone and only here")]
    found = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == sorted([(5, 5), (5, 3), (None, 5), (3, 3), (None, None)], key=str)
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
