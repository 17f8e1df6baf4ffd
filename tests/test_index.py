import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.functions import vectors as V
from lexivane.operators import ivf
from lexivane.operators import search as S


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>, cluster_id int")


def test_products(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0], None)], "a array<float>, b array<float>, n array<float>")
    got = row.select(V.dot(F.col("a"), F.col("b")), V.dot_constant(F.col("a"), [3.0, 4.0, 5.0]), V.dot(F.col("a"), F.col("n")), V.squared_distance(F.col("a"), F.col("b")), V.norm(F.col("b"))).first()
    assert list(got)[:2] == [11.0, 11.0] and got[2] is None and got[3] == 8.0 and got[4] == pytest.approx(50**0.5)


def test_long_constant_runs_over_the_array(spark):
    q = [0.5] * 200
    row = spark.createDataFrame([([1.0] * 200,)], "v array<float>")
    assert row.select(V.dot_constant(F.col("v"), q)).first()[0] == 100.0


def test_normalized(spark):
    row = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(V.normalized(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in row] == [[0.6, 0.8], [0.0, 0.0]]


def test_bytes_round_trip(spark):
    row = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(V.from_bytes(V.to_bytes(F.col("v"))).alias("v")).collect()
    assert [r["v"] for r in row] == [[1.5, -2.0], None]


def test_search_edges(spark):
    docs = vectors(spark, [(1, [1.0, 0.0], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [1.0, 0.0], 1), (5, [0.5], 1), (6, [-1.0, 0.0], 1)])
    got = [(r["id"], r["similarity"]) for r in S.search(docs, [1.0, 0.0], -1).collect()]
    assert got == [(1, 1.0), (4, 1.0), (5, 0.5), (2, 0.0), (6, -1.0)]
    assert [r["id"] for r in S.top(S.scored(docs, [1.0, 0.0], missing=None), 2).collect()] == [1, 4]


def test_probing_all_clusters_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    docs = vectors(spark, [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)])
    centroids = spark.createDataFrame([(c, [float(v) for v in x[c::3].mean(0)]) for c in range(3)], "cluster_id int, centroid array<float>")
    q = [1.0, 0.0, 0.0, 0.0]
    exact = [r["id"] for r in S.search(docs, q, 10).collect()]
    assert [r["id"] for r in S.search(docs, q, 10, centroids, 3).collect()] == exact
    near = S.probed(q, centroids, 1)
    assert all(r["id"] % 3 == near[0] for r in S.search(docs, q, 10, centroids, 1).collect())


@pytest.mark.parametrize(("n", "k"), [(1, 2), (10, 5), (132, 45), (500, 89), (2000, 178), (10000, 400)])
def test_choose_k(n, k):
    assert ivf.choose_k(n) == k


def test_both_assignments_agree(spark):
    rng = np.random.default_rng(1)
    docs = vectors(spark, [(k, [float(v) for v in rng.normal(size=3)], -1) for k in range(40)] + [(99, None, -1)])
    centroids = spark.createDataFrame([(c, [float(v) for v in rng.normal(size=3)]) for c in range(5)] + [(9, [float(v) for v in rng.normal(size=3)])], "cluster_id int, centroid array<float>")
    a = {r["id"]: r["cluster_id"] for r in ivf.assigned(docs, centroids).collect()}
    b = {r["id"]: r["cluster_id"] for r in ivf.assigned_by_join(docs, centroids).collect()}
    assert a == b and 99 not in a


def test_ties_go_to_the_smaller_cluster(spark):
    docs = vectors(spark, [(1, [0.0, 0.0], -1)])
    centroids = spark.createDataFrame([(7, [1.0, 0.0]), (3, [-1.0, 0.0])], "cluster_id int, centroid array<float>")
    assert ivf.assigned(docs, centroids).first()["cluster_id"] == 3


def test_training(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, size=(20, 2)) for c in ([0, 0], [5, 5], [0, 5])])
    docs = vectors(spark, [(k, [float(v) for v in r], -1) for k, r in enumerate(x)] + [(100, None, -1)])
    centroids, assignment = ivf.trained(docs, k=3)
    got = {r["id"]: r["cluster_id"] for r in assignment.collect()}
    assert len(got) == 60 and all(len({got[k] for k in range(g, g + 20)}) == 1 for g in (0, 20, 40))
    near = {r["id"]: r["cluster_id"] for r in ivf.assigned(docs, centroids).collect()}
    assert near == got
    assert ivf.changed(assignment, assignment).first()["changed"] == 0


def test_training_on_nothing(spark):
    centroids, assignment = ivf.trained(vectors(spark, [(1, None, -1)]))
    assert centroids.count() == 0 and assignment.count() == 0


def test_lists_and_means(spark):
    docs = vectors(spark, [(1, [1.0, 3.0], 0), (2, [3.0, 5.0], 0), (3, [9.0, 9.0], 1)])
    m = {r["cluster_id"]: (r["centroid"], r["n"]) for r in ivf.means(docs, docs.select("id", "cluster_id")).collect()}
    assert m == {0: ([2.0, 4.0], 2), 1: ([9.0, 9.0], 1)}
    assert {r["cluster_id"]: r["ids"] for r in ivf.inverted_lists(docs).collect()} == {0: [1, 2], 1: [3]}


def test_index_file_round_trip():
    data = ivf.to_file([[1.0, 2.0], [3.0, 4.0]], [0, 1, 5, 0])
    centroids, assignments, lists = ivf.from_file(data)
    assert centroids == [[1.0, 2.0], [3.0, 4.0]] and assignments == [0, 1, 5, 0] and lists == {0: [0, 3], 1: [1]}
    for n in (5, 20, len(data) - 1):
        with pytest.raises(ValueError):
            ivf.from_file(data[:n])
