"""Gallery search against all pairs."""

import numpy as np
import pytest
from conftest import SMALL

from attestry.operators.gallery import GalleryIndex
from attestry.sources.tables import read_table

MIDDLE = SMALL.replace("0.001", "0.01")


def brute(rows, queries, k):
    def similarity(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return round(min(1.0, max(0.0, float(a @ b / np.sqrt((a @ a) * (b @ b))))), 4)

    usable = [(i, v) for i, v in rows if v and None not in v and any(v)]
    found = {}
    for q, v in queries:
        if v and None not in v and any(v):
            scored = sorted((-similarity(v, w), i) for i, w in usable if i != q and len(w) == len(v))
            found[q] = [(i, -s) for s, i in scored[:k]]
    return {q: f for q, f in found.items() if f}


def answers(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
    return found


def test_exact_and_recall_of_probing(spark):
    vectors = read_table(spark, MIDDLE, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    asked = vectors.filter("vec_id % 100 = 0")
    index = GalleryIndex(vectors)
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 5)
    assert answers(index.search(asked, 5)) == want
    probed = answers(index.search(asked, 5, probes=18, exact=False))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in probed[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("cells", [1, 3, None])
def test_hot_cell_ties_and_odd_vectors(spark, cells):
    rng = np.random.default_rng(5)
    # a third of the rows are one vector
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, None, 2.0]), (304, [1.0, 2.0]), (400, [-1.0, -2.0, -3.0]), (500, [2.0, 1.0])]
    gallery = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = GalleryIndex(gallery, cells=cells, block_rows=20).search(gallery.filter("vec_id % 50 = 0"), 7, probes=1)
    assert answers(found) == brute(rows, [r for r in rows if r[0] % 50 == 0], 7)


def test_empty_gallery(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert GalleryIndex(nothing).search(nothing, 3).count() == 0


def test_clusters_are_pruned(spark):
    """Cells far from a query are ruled out, so their rows are never measured."""
    rng = np.random.default_rng(1)
    centres = np.eye(16)
    rows = [(i, (centres[i % 16] + rng.normal(scale=0.01, size=16)).tolist()) for i in range(1600)]
    gallery = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = GalleryIndex(gallery, cells=64)
    asked = gallery.filter("vec_id % 100 = 0")
    from attestry.operators.gallery import unit_vectors

    visits = index._visits(unit_vectors(asked.withColumnRenamed("vec_id", "query_id"), "query_id", "embedding"))
    kept = visits.filter("bound >= 0.99").groupBy().sum("size").first()[0]
    assert kept <= 16 * 1600 / 8
    assert answers(index.search(asked, 5)) == brute(rows, [r for r in rows if r[0] % 100 == 0], 5)


def test_rows_that_can_be_nearest():
    """Of many rows a task hands on little more than k, and all that can be among them."""
    from attestry.operators.gallery import nearest_rows

    similar = np.array([0.5, 0.9, 0.00001, 0.9, -1.0, 0.90004, 0.9] + [0.1] * 1000)
    assert nearest_rows(similar, [1], 3).tolist() == [3, 5, 6]
    assert nearest_rows(similar, [], 3).tolist() == [1, 3, 5]
    assert len(nearest_rows(similar, [], 7)) == 7
    # a value at the border of two roundings stays in question on both sides
    assert nearest_rows(np.array([0.2, 0.20005, 0.20005 - 1e-12, 0.1]), [], 1).tolist() == [0, 1, 2]
