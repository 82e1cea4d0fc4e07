"""Periodic runs, near vectors and whitening: against brute force, and on the cases their docstrings define."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from treeledger.llm import components, near_vectors, queries, repetition, whitening

# --- runs


def brute_runs(words, least=12):
    """Sorted (start, period, length): every lag's stretches of matches, the smallest lag of each stretch of words."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
    return sorted((start, q, length) for (start, length), q in found.items())


def _odd_words(draw):
    kinds, count = draw.choice([1, 2, 2, 3, 5, 30]), draw.choice([0, 1, 5, 11, 12, 13, 30, 80, 200, 400])
    form = draw.random()
    if form < 0.4:
        return [draw.randrange(kinds) for _ in range(count)]
    if form < 0.7:
        words = []
        while len(words) < count:
            part = [draw.randrange(kinds) for _ in range(draw.randrange(1, 40))]
            words += part * draw.randrange(1, 6) + [draw.randrange(kinds) for _ in range(draw.randrange(8))]
        return words[:count]
    words, other = [0, 1], [0]
    while len(words) < count:  # Fibonacci and Thue-Morse words: as many squares, and as few, as can be
        words, other = (words + other, words) if form < 0.85 else (words + [1 - w for w in words], other)
    return words[:count]


def test_runs_equal_brute_force():
    draw = random.Random(3)
    for _ in range(150):
        texts = [_odd_words(draw) for _ in range(draw.randrange(1, 7))]
        texts += texts[:1]
        lengths = np.array([len(t) for t in texts])
        found = repetition.word_runs(np.array([w for t in texts for w in t], np.int64), lengths).tolist()
        for i, text in enumerate(texts):
            assert [(s, q, n) for d, s, n, q in found if d == i] == brute_runs(text)


def test_one_word_a_hundred_thousand_times():
    assert repetition.word_runs(np.zeros(100_000, np.int64), np.array([100_000])).tolist() == [[0, 0, 100_000, 1]]
    part = np.random.default_rng(1).integers(0, 900, 20_000)
    assert repetition.word_runs(np.tile(part, 3), np.array([60_000])).tolist() == [[0, 0, 60_000, 20_000]]


def test_runs_of_odd_documents(spark):
    loop = "a b c " * 7 + "é " * 30 + "z"
    texts = [None, "", " \n\t ", loop, loop, "one two", "x " * 40_000]
    rows = [(i if i != 4 else 3, t, "x", 1) for i, t in enumerate(texts)] + [(None, loop, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found_ string, runs int")
    assert repetition.find_runs(docs.limit(0)).count() == 0
    result = repetition.find_runs(docs)
    assert result.columns == [*docs.columns, "found"]
    got = sorted(((r.doc_id is None, r.doc_id, r.found) for r in result.collect()), key=str)
    plain = [found for _, i, found in got if i in (0, 1, 2)]
    assert all((f.n_words, f.runs, bytes(f.collapsed)) == (0, [], b"") for f in plain)
    for _, i, found in got:
        if i in (3, 4, None):
            assert found.n_words == 52 and [tuple(r) for r in found.runs] == [(0, 21, 3), (21, 30, 1)]
            assert bytes(found.collapsed).decode() == "a b c é z"
    (long,) = [found for _, i, found in got if i == 6]
    assert [tuple(r) for r in long.runs] == [(0, 40_000, 1)] and bytes(long.collapsed) == b"x"


def test_the_run_query_equals_brute_force(spark, tmp_path):
    draw, rows = random.Random(8), []
    for i in range(320):
        count = draw.choice([0, 1, 12, 40, 90, 150])
        rows.append((i, " ".join(f"w{draw.randrange(draw.choice([2, 9, 500]))}" for _ in range(count))))
    rows += [(1000, None), (None, "a b " * 12), (7, "a b " * 12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def expected(doc_id, text):
        words = (text or "").split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
        gone = {i for s, q, length in runs for i in range(s + q, s + length)}
        rest = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(((-length, s, q) for s, q, length in runs), default=None)
        shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        return (doc_id, len(runs), *shown, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, rest)))

    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*row)) for row in rows)
    assert sum(r[1] > 0 for r in got) > 10


# --- components


def brute_components(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in parent}


def test_components_with_a_hub_and_a_chain(spark):
    draw = random.Random(2)
    edges = [(5, i) for i in range(100, 3100)] + [(i, i + 1) for i in range(5000, 5060)] + [(9, 9)]
    edges += [(draw.randrange(7000, 9000), draw.randrange(7000, 9000)) for _ in range(900)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_heavy_join_keeps_every_row_with_a_partner(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    sizes = rows.groupBy("k").count().where("k <> 3")
    got = components.heavy_join(rows, sizes, "k", "count", 3000)
    assert got.count() == 2999 and {tuple(r) for r in got.where("k = 1").select("count").distinct().collect()} == {(2000,)}


# --- near vectors


def clustered(draw, count, dim, groups, group_size, spread):
    base = draw.normal(size=(count, dim))
    for g in range(groups):
        centre = draw.normal(size=dim)
        noise = draw.normal(size=(group_size, dim)) * spread * np.linalg.norm(centre) / math.sqrt(dim)
        base[g * group_size : (g + 1) * group_size] = centre + noise
    return base * draw.uniform(0.1, 9, size=(count, 1))


def brute_links(vectors, threshold=0.9):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = units @ units.T
    np.fill_diagonal(cosine, -1)
    return cosine >= threshold, np.abs(cosine - threshold).min()


@pytest.mark.parametrize("spread, list_rows", [(0.2, 64), (0.33, 100), (0.02, 2000)])
def test_links_and_groups_equal_brute_force(spark, spread, list_rows):
    draw = np.random.default_rng(int(spread * 100))
    vectors = clustered(draw, 1200, 24, 12, 50, spread)
    vectors[700:800] = vectors[0]  # equal vectors
    rows = [(i + 10, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id - 10: r for r in near_vectors.near_vectors(table, list_rows=list_rows).collect()}
    assert len(got) == 1200
    links, margin = brute_links(vectors)
    assert margin > 1e-12
    found = sum(r.n_links for r in got.values())
    assert found >= 0.97 * links.sum() and all(r.n_links <= links[i].sum() for i, r in got.items())
    if spread != 0.33:  # far from the threshold nothing is lost
        assert found == links.sum()
        names = brute_components(zip(*map(list, np.nonzero(links)), strict=True))
        for i, r in got.items():
            assert r.component_id - 10 == names.get(i, i) and r.kept == (r.component_id == r.vec_id)


def test_a_hot_group_of_near_copies_is_counted_in_its_core(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(900, 32))
    vectors[:400] = draw.normal(size=32) + draw.normal(size=(400, 32)) * 0.05
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    model = near_vectors.Quantiser(units, 4, math.sqrt(0.2))
    own, distance, _ = model.place(units, 0.0)
    assert len(set(own[:400])) == 1 and distance[:400].max() < math.sqrt(0.2) / 2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_vectors.near_vectors(table).collect()}
    assert all(got[i].n_links >= 399 and got[i].component_id == 0 for i in range(400))


def test_odd_vectors_link_with_nothing(spark):
    good, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, good, "x"), (2, [2.0, 4.0, 6.0], "x"), (3, good, None), (4, None, "x"), (5, [], "x"), (6, [0.0, 0.0, 0.0], "x"),
        (7, [1.0, None, 3.0], "x"), (8, [nan, 1.0, 1.0], "x"), (9, [inf, 1.0, 1.0], "x"), (10, [1.0, 2.0], "x"),
        (None, good, "x"), (11, [3.0, -1.0, 0.0], "x"), (11, [1e300, 2e300, 3e300], "x"), (11, None, "x"),
        (12, [3.0, -1.0, 0.0], "x"), (12, [3.0, -1.0, 0.0], "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    assert near_vectors.near_vectors(table.limit(0)).count() == 0
    assert near_vectors.near_vectors(table.where("vec_id in (4, 5, 6)")).count() == 3
    result = near_vectors.near_vectors(table)
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((tuple(r) for r in result.collect()), key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)]
    # Two of 11's rows are linked with others, so 1, 2, 3, 11 and 12 are one group.
    joined = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)]
    joined += [(11, 3, 1, False), (11, 2, 1, False), (11, 0, 1, False), (12, 2, 1, False), (12, 2, 1, False)]
    assert got == sorted([*alone, *joined, (None, 0, None, True)], key=str)


# --- whitening


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40])
@pytest.mark.parametrize("form", ["plain", "flat", "equal", "diagonal", "same", "nothing"])
def test_eigenvectors(size, form):
    draw = np.random.default_rng(size)
    rows = draw.normal(size=(2 * size, size))
    if form == "flat":
        rows[:, : max(1, size // 2)] = 0
    matrix = rows.T @ rows * 1000
    if form == "equal":
        turn, values = np.linalg.qr(draw.normal(size=(size, size)))[0], np.ones(size)
        values[:3] = 5
        matrix = turn @ np.diag(values) @ turn.T
        matrix = (matrix + matrix.T) / 2
    matrix = {"diagonal": np.diag(np.arange(1.0, size + 1)), "same": np.eye(size), "nothing": np.zeros((size, size))}.get(
        form, matrix
    )
    values, vectors = whitening.eigenvectors(matrix, 8)
    expected = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    scale = max(1.0, np.abs(expected).max())
    assert len(values) == min(8, size) and np.abs(values - expected).max() <= 1e-13 * scale
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-13 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() <= 1e-13


def test_whitening_equals_numpy(spark):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(700, 20)) @ draw.normal(size=(20, 20)) + 3
    vectors[100:300] = vectors[0]
    nan = float("nan")
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    bad = [None, [], [1.0] * 19, [nan] + [1.0] * 19, [None] + [1.0] * 19, [float("inf")] * 20, [1e300] * 20]
    table = spark.createDataFrame(
        rows + [(1000 + i, v, "x") for i, v in enumerate(bad)], "vec_id long, embedding array<double>, component string"
    )
    got = whitening.whiten(table).collect()
    x = np.floor(1024 * vectors).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    spread = np.cov((x - total / n).T, bias=True)
    values, axes = np.linalg.eigh(spread)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    white = (x - total / n) @ axes / np.sqrt(values)
    deviation = [sum(int(d) ** 2 for d in row * n - total) for row in x]
    assert len(got) == 8 * n
    sign = {}
    for r in got:
        expected = white[r.vec_id, r.component - 1]
        if abs(expected) > 1e-3:
            assert sign.setdefault(r.component, np.sign(expected * r.whitened)) == np.sign(expected * r.whitened)
        assert abs(abs(r.whitened) - abs(expected)) < 1e-8
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / np.trace(spread)) < 1e-10
        assert r.identity_error < 1e-9


def test_whitening_of_tables_without_spread(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(table).count() == 0 and whitening.whiten(table.limit(0)).count() == 0
    more = table.union(spark.createDataFrame([(3, [5.0, 2.0])], table.schema))
    rows = whitening.whiten(more).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    large = spark.createDataFrame([(i, [float(i % 2) * 2**39, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    deviations = {r.vec_id: int(r.deviation) for r in whitening.whiten(large).collect()}
    x = [(int(1024 * (i % 2) * 2**39) + 100_000, 1024 * i + 100_000) for i in range(4)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert deviations == {i: sum((4 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}


def test_deviation_beyond_64_bits_is_null_in_the_query(spark, tmp_path):
    table = spark.createDataFrame([(i, [float(i % 2) * 2**39, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.deviation for r in queries.op13_whitening(spark, str(tmp_path)).collect()} == {None}
