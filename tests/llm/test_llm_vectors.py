"""The vector operators against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from sievemark.llm import centroid_clusters, vector_codes
from sievemark.llm.centroid_clusters import Clustering, Nearest, cluster_report
from sievemark.llm.queries import QUERIES
from sievemark.llm.vector_codes import CellMemo, Codes, code_report, compress_vectors, decoded

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, point string, far int, code string, n int"


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(point, entries):
    return min((gap(point, e), k) for k, e in enumerate(entries))


def mean_rounds(points, entries, rounds):
    entries = [list(e) for e in entries]
    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(nearest(p, entries)[1], []).append(p)
        for k, some in groups.items():
            entries[k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    return entries


def scaled(vector, scale):
    return [math.floor(scale * x) for x in vector]


def good(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def plain_clusters(rows, spec):
    points = [(i, scaled(v, spec.scale)) for i, v, *_ in rows if good(v) and len(v) == spec.dimensions]
    named = [(hashlib.sha256(f"{spec.seed}:{i}".encode()).hexdigest() if i is not None else "~", p) for i, p in points]
    entries = mean_rounds([p for _, p in points], [p for _, p in sorted(named)[: spec.clusters]], spec.rounds)
    placed = [(i, *reversed(nearest(p, entries))) for i, p in points]
    inertia = {c: sum(d for _, k, d in placed if k == c) for _, c, _ in placed}
    digest = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in placed]


def plain_codes(rows, spec):
    points = [(i, label, scaled(v, spec.scale)) for i, v, label, *_ in rows if good(v)]
    points = [p for p in points if p[2] and len(p[2]) % spec.parts == 0]
    points.sort(key=lambda p: (p[0] is None, p[0], p[2]))
    if not points:
        return []
    points = [p for p in points if len(p[2]) == len(points[0][2])]
    wide = len(points[0][2]) // spec.parts
    cut = [[p[2][k * wide : (k + 1) * wide] for p in points] for k in range(spec.parts)]
    books = [mean_rounds(part, part[: spec.entries], spec.rounds) for part in cut]
    flat = ",".join(str(x) for b in books for e in b for x in e)
    digest = hashlib.sha256(flat.encode()).hexdigest()
    found = []
    for n, (i, label, _) in enumerate(points):
        near = [nearest(cut[k][n], books[k]) for k in range(spec.parts)]
        found.append((i, label, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near)))
    sums = {}
    for _, label, _, error in found:
        sums[label] = sums.get(label, 0) + error
    return [(i, code, error, sums[label], digest) for i, label, code, error in found]


def vectors(n, length, seed=5):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 0.3) for _ in range(length)] for _ in range(5)]
    rows = []
    for i in range(n):
        centre = centres[i % 5]
        rows.append((i * 7 + 1, [c + draw.gauss(0, 0.05) for c in centre], i % 3 if i % 4 else None))
    return rows


def awkward(length):
    rows = vectors(60, length)
    same = rows[3][1]
    rows += [(500 + i, same, 1) for i in range(25)]  # ties and repeated vectors
    rows += [(1, rows[5][1], 0), (1, rows[5][1], 0)]  # repeated ids and rows
    rows += [(600, None, 1), (601, [], 1), (602, [0.1] * (length - 1) + [None], 1), (603, [0.5] * (length + 8), 1)]
    rows += [(604, [float("nan")] * length, 1), (605, [0.1] * (length - 1) + [float("inf")], 1), (606, [0.2] * 3, 2)]
    rows += [(None, [0.25] * length, 2), (607, [-0.0] * length, None), (608, [-1e-30] * length, 2)]
    return [(*r, 1, "x", 2, "y", 3) for r in rows]


def table_of(spark, rows):
    """The rows with 32-bit components, and as Spark holds them."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df, [tuple(r) for r in df.collect()]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clusters_equal_a_plain_version(spark):
    df, rows = table_of(spark, awkward(16))
    for spec in (Clustering(16, rounds=4), Clustering(16, clusters=3, pivots=6, rounds=2), Clustering(16, clusters=200)):
        assert as_rows(cluster_report(df.repartition(5), spec=spec)) == sorted(plain_clusters(rows, spec), key=str)


def test_clusters_of_large_components_and_empty_tables(spark):
    draw = random.Random(2)
    rows = [(i, [draw.choice([1e4, 2e4]) * draw.random(), *[draw.random()] * 3], 0, 1, "", 1, "", 1) for i in range(40)]
    rows.append((77, [1.5e6, -2.5e5, 0.0, 1.0], 0, 1, "", 1, "", 1))
    df, rows = table_of(spark, rows)
    spec = Clustering(4, clusters=4, rounds=3)
    assert as_rows(cluster_report(df, spec=spec)) == sorted(plain_clusters(rows, spec), key=str)
    far = spark.createDataFrame([(1, [3e38], 0, 1, "", 1, "", 1)], SCHEMA)
    with pytest.raises(Exception, match="64-bit"):
        cluster_report(far, spec=Clustering(1)).collect()
    none = cluster_report(df.limit(0), spec=spec)
    assert none.collect() == []
    assert none.dtypes == cluster_report(df, spec=spec).dtypes


def test_bounds_never_exceed_distances():
    draw = random.Random(9)
    for size in (3, 400, 10**6, 10**9):
        points = [[draw.randint(-size, size) for _ in range(6)] for _ in range(120)]
        nearest_ = Nearest(points[:6], points[4:12])
        grid = centroid_clusters.np.array(points, object)
        low = nearest_.bounds(centroid_clusters.roots(grid, nearest_.pivots))
        for p, row in zip(points, low, strict=True):
            for c, bound in zip(points[4:12], row, strict=True):
                assert bound == 0 or bound**2 <= gap(p, c) * (1 - 1e-15)
        assert nearest_.pairs


def test_pruning_skips_centroids_that_lie_apart():
    draw = random.Random(3)
    centres = [[draw.randint(-5000, 5000) for _ in range(8)] for _ in range(8)]
    points = [[x + draw.randint(-50, 50) for x in centres[i % 8]] for i in range(800)]
    found = Nearest(centres, centres)
    grid = centroid_clusters.np.array(points, centroid_clusters.np.int64)
    cluster, distance = found.of(grid, centroid_clusters.roots(grid, found.pivots))
    assert [(d, c) for c, d in zip(cluster, distance, strict=True)] == [nearest(p, centres) for p in points]
    assert found.measured < 0.2 * found.asked


def test_codes_equal_a_plain_version(spark):
    df, rows = table_of(spark, awkward(16))
    for spec in (Codes(rounds=3), Codes(parts=4, entries=5, rounds=2, cell=64), Codes(parts=16, entries=200, rounds=1)):
        assert as_rows(code_report(df.repartition(5), spec=spec)) == sorted(plain_codes(rows, spec), key=str)


def test_codes_of_large_components_and_empty_tables(spark):
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-3e4, 3e4) for _ in range(8)], i % 2, 1, "", 1, "", 1) for i in range(50)]
    df, rows = table_of(spark, rows)
    spec = Codes(parts=2, entries=6, rounds=2)
    assert as_rows(code_report(df, spec=spec)) == sorted(plain_codes(rows, spec), key=str)
    none = code_report(df.limit(0), spec=spec)
    assert none.collect() == []
    assert none.dtypes == code_report(df, spec=spec).dtypes
    with pytest.raises(ValueError, match="256"):
        compress_vectors(df, spec=Codes(entries=300))


def test_a_memo_forgets_and_shared_hashes_keep_cells_apart(monkeypatch):
    draw = random.Random(6)
    points = [[draw.randint(-2000, 2000) for _ in range(4)] for _ in range(500)]
    book = points[:9]
    grid = vector_codes.np.array(points)
    expected = [nearest(p, book) for p in points]
    monkeypatch.setattr(vector_codes, "CELLS", 10)
    monkeypatch.setattr(vector_codes, "mixed", lambda cells: cells[:, 0].astype(vector_codes.np.uint64) % 3)
    memo = CellMemo(book, 100)
    for _ in range(2):
        entry, distance = memo.nearest(grid)
        assert list(zip(distance.tolist(), entry.tolist(), strict=True)) == expected
    assert memo.measured < 2 * 9 * len(points)


def test_codes_decode_to_their_entries(spark):
    df, rows = table_of(spark, [(*r, 1, "x", 2, "y", 3) for r in vectors(80, 16)])
    spec = Codes(parts=4, entries=8, rounds=2)
    codes, books = compress_vectors(df, spec=spec)
    points = {i: scaled(v, spec.scale) for i, v, *_ in rows}
    for r in decoded(codes, books).collect():
        assert gap(r.point, points[r.id]) == r.error


def test_labels_beyond_the_hot_ones(spark):
    rows = [(i, i, 1) for i in range(1500)] + [(2000 + i, None, 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, error bigint")
    got = {r.id: r.label_error for r in vector_codes.with_label_error(df).collect()}
    assert len(got) == 3000
    assert all(e == (1 if i < 1500 else 3000) for i, e in got.items())


def test_queries_read_whole_tables(spark):
    from conftest import DATA

    held = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [tuple(r) for r in held.select("vec_id", "embedding", "label").collect()]
    assert as_rows(QUERIES["op13_centroid_clusters"](spark, DATA)) == sorted(plain_clusters(rows, Clustering()), key=str)
    assert as_rows(QUERIES["op11_vector_codes"](spark, DATA)) == sorted(plain_codes(rows, Codes()), key=str)
