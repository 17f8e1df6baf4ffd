import random
from itertools import combinations

import numpy as np
import pytest

from lexivane.llm import mixture, multi_index, neardup, site_lines
from lexivane.llm.components import components
from lexivane.llm.words import shingles, words

CLASH = "sig string, rep_id long, key string, v string, rank int"


def story(rng, n=60):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def stories():
    """Originals with edited, inserted and exact copies; short, empty, null, very long and Chinese texts."""
    rng, rows = random.Random(5), []
    for k in range(40):
        w = story(rng)
        for c in range(rng.choice([1, 2, 3])):
            v = [x if rng.random() > 0.08 else "new" + str(rng.randrange(999)) for x in w] if c else w
            if c == 2:
                v = v[:20] + story(rng, 5) + v[20:]
            rows.append((k * 10 + c, f"t{k}", " ".join(v)))
    rows += [(1000, "t0", rows[0][2]), (1001, None, ""), (1002, None, None), (1003, "x", "too short"), (1004, None, rows[0][2] * 60), (1005, "标题", "渡枫沧" * 40), (1006, "标题", "渡枫沧" * 40), (1007, "标题", "渡枫沧" * 39 + "新闻")]
    return rows


def test_words_and_shingles():
    assert words("Ab_c 中文 1.5") == ["ab", "c", "中", "文", "1", "5"] and words(None) == []
    h = np.arange(1, 7, dtype=np.uint64)
    assert len(shingles(h, 5)) == 2 and len(shingles(h[:4], 5)) == 0 and shingles(h, 2)[0] != shingles(h[::-1].copy(), 2)[-1]


def test_near_duplicates_like_brute_force(spark, stories):
    docs = spark.createDataFrame([(*r, "s", 1, "k", "v", 2) for r in stories] + [(None, "n", "word " * 30, None, None, None, None, None)], "id long, title string, content string, " + CLASH)
    members, links = neardup.near_duplicates(docs)
    counts = {i: neardup.pair_counts(t, c) for i, t, c in stories if len(words(c)) >= 20}
    wanted = {(a, b) for a, b in combinations(sorted(counts), 2) if neardup.overlap(counts[a], counts[b]) >= 0.55}
    got = [tuple(r) for r in neardup.duplicate_pairs(members, links).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted
    classes = {r["id"]: r["class_id"] for r in neardup.duplicate_classes(members, links).collect()}
    assert set(classes) == set(counts) and all(classes[a] == classes[b] for a, b in wanted)
    assert all(classes[i] == i or any(i in p for p in wanted) for i in classes)


@pytest.mark.parametrize("hot", [2000, 8])
def test_versions_of_a_story_in_a_third_of_the_rows(spark, hot):
    """Each version has edits of its own; whatever they share is in a third of the rows. Keys that are split give the same pairs."""
    rng, rows = random.Random(9), []
    told = story(rng, 100)
    for k in range(240):
        w = story(rng, 100) if k % 3 else [f"edit{k}x{j}" if j in range(k % 7, 100, 17) else x for j, x in enumerate(told)]
        rows.append((k, None, " ".join(w)))
    _, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, title string, content string"), hot=hot)
    got = [(r["id_a"], r["id_b"]) for r in links.collect()]
    counts = [neardup.pair_counts(t, c) for _, t, c in rows]
    wanted = {(a, b) for a, b in combinations(range(240), 2) if neardup.overlap(counts[a], counts[b]) >= 0.55}
    assert len(wanted) == 80 * 79 // 2 and len(got) == len(set(got)) and set(got) == wanted


def test_alike_by_repeated_pairs_alone(spark):
    """Two texts share little but one pair, which is most of each."""
    rng = random.Random(3)
    rows = [(k, None, " ".join(["spam"] * 200 + story(rng, 90))) for k in range(6)] + [(k, None, " ".join(story(rng, 290))) for k in range(10, 40)]
    _, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, title string, content string"))
    assert {(r["id_a"], r["id_b"]) for r in links.collect()} == set(combinations(range(6), 2))


@pytest.mark.parametrize(("copies", "edited"), [(100, 0.1), (400, 0.06)])
def test_recall_of_one_story_with_many_copies(spark, copies, edited):
    """Each copy has edits of its own, among a few thousand other texts that share a notice."""
    rng = random.Random(copies)
    told, notice, rows = story(rng, 120), story(rng, 15), []
    for k in range(3000):
        w = [x if rng.random() > edited else f"e{rng.randrange(10**6)}" for x in told] if k < copies else story(rng, 80) + notice
        rows.append((k, None, " ".join(w)))
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, title string, content string"), hot=300)
    found = {(r["id_a"], r["id_b"]) for r in links.select("id_a", "id_b").collect()}
    counts = [neardup.pair_counts(t, c) for _, t, c in rows[:copies]]
    asked = [tuple(sorted(rng.sample(range(copies), 2))) for _ in range(4000)]
    wanted = {p for p in asked if neardup.overlap(counts[p[0]], counts[p[1]]) >= 0.55}
    assert len(wanted) > 1000 and len(wanted & found) >= 0.99 * len(wanted) and all(b < copies for _, b in found)
    classes = {r["id"]: r["class_id"] for r in neardup.duplicate_classes(members, links).collect()}
    assert sum(c == 0 for c in classes.values()) >= 0.99 * copies


def test_recall_at_the_least_similarity(spark):
    """Pairs that share between 55 and 60 percent."""
    rng, rows, wanted = random.Random(77), [], set()
    while len(wanted) < 400:
        w = story(rng, 150)
        v = [x if rng.random() > 0.235 else f"n{rng.randrange(10**6)}" for x in w]
        if 0.55 <= neardup.overlap(neardup.pair_counts(None, " ".join(w)), neardup.pair_counts(None, " ".join(v))) < 0.6:
            k = len(rows)
            rows += [(k, None, " ".join(w)), (k + 1, None, " ".join(v))]
            wanted.add((k, k + 1))
    _, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, title string, content string"))
    found = {(r["id_a"], r["id_b"]) for r in links.collect()}
    assert found <= wanted and len(found) >= 0.98 * len(wanted)


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "id long, title string, content string"))
    assert members.count() == 0 and links.count() == 0 and neardup.duplicate_classes(members, links).count() == 0


def test_sign_bits_tell_the_angle():
    rng = np.random.default_rng(1)
    shared, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (550, 450, 450))
    flat = np.concatenate([shared, one, shared, two])
    bits = neardup.sign_bits(flat, np.array([0, 1000]), 16).view(np.uint64)
    assert abs(int(np.bitwise_count(bits[0] ^ bits[1]).sum()) / 1024 - np.arccos(0.55) / np.pi) < 0.05
    assert (neardup.sign_bits(flat, np.array([0, 1000]), 2) == bits[:, :2].view(np.int64)).all()


def test_masks_cover():
    """Four positions of which at most two differ agree under one of the masks."""
    for differ in combinations(range(4), 2):
        assert any(not set(m) & set(differ) for m in neardup.MASKS)


def test_few_pairs_of_a_large_group_meet():
    """Rows whose symbols agree by chance in one of 25 places; a few pairs agree in one more than twice the number of blocks."""
    rng = np.random.default_rng(8)
    sketch = rng.integers(0, 25, (4000, 48), dtype=np.uint16)
    for k in range(0, 100, 2):
        same = rng.permutation(48)[:17]
        sketch[k, same] = sketch[k + 1, same]
    unit, lead, bits = np.zeros(4000, np.int64), np.full(4000, 3, np.int8), rng.integers(0, 1 << 63, (8, 4000), dtype=np.uint64)
    met = {tuple(sorted(p)) for a, b in neardup._meeting(unit, lead, sketch, bits, 512, 2000) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert {(k, k + 1) for k in range(0, 100, 2)} <= met and len(met) < 0.02 * 4000 * 3999 / 2
    small = [p for a, b in neardup._meeting(unit, lead, sketch, bits, 512, 4000) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(small) == len(set(small)) == 4000 * 3999 // 2


def test_covering_of_six():
    for differ in combinations(range(6), 3):
        assert any(not set(m) & set(differ) for m in neardup.MASKS)


@pytest.mark.parametrize("hot", [2000, 20])
def test_parts_of_a_large_group_meet(spark, hot):
    rng = random.Random(19)
    told = story(rng, 90)
    rows = [(k, None, " ".join(f"edit{k}x{j}" if j in range(k % 7, 90, 17) else x for j, x in enumerate(told))) for k in range(150)]
    _, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, title string, content string"), hot=hot, part=40)
    assert [tuple(r) for r in links.select("id_a", "id_b").orderBy("id_a", "id_b").collect()] == list(combinations(range(150), 2))


def test_components(spark):
    rng, edges = random.Random(2), []
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 100)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(60)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: top(x) for x in parent}


@pytest.fixture(scope="module")
def points():
    """Groups of alike vectors, among them one of a third of all; loose, repeated, scaled and unusable vectors."""
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for size in (90, 30, 20, 12, 8, 6, 5, 4, 3):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + rng.normal(size=64) * 0.02
            rows.append((k, [float(x) for x in v * rng.choice([1.0, 8.0, 0.25])]))
            k += 1
    rows += [(k + j, [float(x) for x in rng.normal(size=64)]) for j in range(40)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, [1.0] * 63), (504, [0.0] * 64), (505, [float("nan")] + [1.0] * 63), (506, [float("inf")] + [1.0] * 63), (507, [])]
    return rows


def usable(rows):
    out = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in out])
    return np.array([i for i, _ in out]), x


def test_clusters_like_brute_force(spark, points):
    ids, x = usable(points)
    alike = x @ x.T >= 0.82
    wanted = {int(i): int(ids[row].min()) for i, row in zip(ids, alike, strict=True) if row.sum() >= 5}
    docs = spark.createDataFrame([(*r, "c", 0) for r in points] + [(None, [1.0] * 64, "c", 0)], "id long, embedding array<float>, cluster string, component int")
    # A sample smaller than the table leaves groups for later rounds.
    clusters = mixture.mixture_clusters(docs, sample_rows=60)
    assert dict(tuple(r) for r in mixture.cluster_rows(clusters, 5).select("id", "rep_id").collect()) == wanted
    assert clusters.count() == len(ids)
    top = {r["rep_id"]: r for r in mixture.cluster_summary(clusters, 3).collect()}
    assert top[0]["size"] == 92 and len(top[0]["typical"]) == 3 and sum(r["size"] for r in top.values()) == len(ids)


@pytest.mark.parametrize(("copies", "sample_rows", "task_rows"), [(0, 8000, 20_000), (0, 60, 20_000), (0, 60, 40), (500, 60, 40)])
def test_clusters_have_the_moments_of_all_rows(spark, points, copies, sample_rows, task_rows):
    """A start from few rows, components too large for a task and one that most rows are in change neither clusters nor densities (F4)."""
    if copies:
        noise = np.random.default_rng(6).normal(size=(copies, 64)) * 0.02
        points = [(1000 + k, [float(c) for c in np.array(points[0][1]) / np.linalg.norm(points[0][1]) + v]) for k, v in enumerate(noise)] + points[-12:]
    ids, x = usable(points)
    alike = x @ x.T >= 0.82
    docs = spark.createDataFrame(points, "id long, embedding array<float>")
    got = mixture.mixture_clusters(docs, sample_rows=sample_rows, task_rows=task_rows).toPandas().set_index("id").loc[ids]
    assert len(got) == len(ids) and (np.equal.outer(got["cluster"].to_numpy(), got["cluster"].to_numpy()) == alike).all()
    z = (x - x.mean(0)) / x.std(0)
    z = z @ np.linalg.svd(z.T @ z / len(z))[2][:32].T
    for own in alike:
        mean, var = z[own].mean(0), z[own].var(0) + 0.02
        wanted = np.log(own.mean()) - 0.5 * (np.log(2 * np.pi * var) + (z[own] - mean) ** 2 / var).sum(1)
        assert np.allclose(got["density"].to_numpy()[own], wanted, rtol=1e-5)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    assert mixture.mixture_clusters(empty).count() == 0


def test_p4_found_searches_no_fewer_cells_than_the_operator(spark, monkeypatch):
    import inspect

    from lexivane.llm import queries

    usual, asked, whole = {k: p.default for k, p in inspect.signature(multi_index.most_similar).parameters.items()}, [], multi_index.most_similar
    monkeypatch.setattr(multi_index, "most_similar", lambda *args, **limits: asked.append(limits) or whole(*args, **limits))
    assert queries.p4_found(spark, "/root/testdata/sf0.001").count() > 0
    assert len(asked) == 2 and all(x.get(k, usual[k]) >= usual[k] for x in asked for k in ("nearest", "most_cells", "enough", "reach"))


@pytest.mark.parametrize("block", [4096, 16])
def test_most_similar_like_brute_force(spark, points, block):
    ids, x = usable(points)
    cosine = np.round(x @ x.T, 6)
    np.fill_diagonal(cosine, -9)
    wanted = {}
    for k, i in enumerate(ids):
        near = np.flatnonzero(cosine[k] >= 0.82)
        if len(near) >= 5:
            wanted[int(i)] = [int(ids[j]) for j in near[np.lexsort((ids[near], -cosine[k][near]))][:5]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in points], "id long, embedding array<float>, v string, rank int")
    # Blocks smaller than the largest group divide its cell.
    near = multi_index.with_enough(multi_index.most_similar(docs, "id", "embedding", 5, least=0.82, block=block), 5)
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["near_id"])
    assert got == wanted


def test_recall_without_a_bound(spark, points):
    ids, x = usable(points)
    cosine = np.round(x @ x.T, 6)
    np.fill_diagonal(cosine, -9)
    docs = spark.createDataFrame(points, "id long, embedding array<float>")
    got = {}
    for r in multi_index.most_similar(docs, "id", "embedding", 10, every=5).collect():
        got.setdefault(r["id"], set()).add(r["near_id"])
    asked = [k for k, i in enumerate(ids) if i % 5 == 0]
    hits = sum(len(got.get(int(ids[k]), set()) & {int(ids[j]) for j in np.lexsort((ids, -cosine[k]))[:10]}) for k in asked)
    assert set(got) <= {int(ids[k]) for k in asked} and hits >= 0.9 * 10 * len(asked)
    assert multi_index.most_similar(docs.where("id = 502"), "id", "embedding").count() == 0


def test_repeated_lines(spark):
    notice, rows = "All rights reserved 2024", []
    for k in range(60):
        lines = [f"Unique story number {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}", notice.replace("2024", str(2000 + k)) if k % 2 else "another line of text here " + "xyz"[k % 3] * 9 + chr(97 + k % 26) * 7, "short"]
        rows.append((k, ["https://www.Site.example:80/a", "http://m.site.example/b", "site.example/c"][k % 3], "\n".join(lines)))
    rows += [(100 + k, "http://other.example/", f"Different words {chr(97 + k)} only\n\n  ") for k in range(20)]
    rows += [(200, None, notice), (201, "", notice), (202, "http://other.example/", None), (203, "http://site.example/", ""), (204, "http://other.example/", notice)]
    docs = spark.createDataFrame([(*r, "k", 1, 2.0) for r in rows], "id long, url string, content string, key string, n_site int, ratio double")
    lines = site_lines.repeated_lines(docs)
    (line,) = [r for r in lines.collect() if r["n_rows"] == 30]
    assert line["site"] == "site.example" and line["n_site"] == 61
    cases = {tuple(r) for r in site_lines.line_cases(docs, lines).select("id", "line_no").collect()}
    assert {(k, 1) for k in range(1, 60, 2)} <= cases and not any(i >= 100 for i, _ in cases)
    clean = {r["id"]: (r["content"], r["removed"]) for r in site_lines.without_lines(docs, lines).collect()}
    assert clean[1] == ("Unique story number bk\nshort", 1) and clean[202] == (None, 0) and clean[203] == ("", 0) and clean[204] == (notice, 0)
    assert site_lines.repeated_lines(docs.where("id < 0")).count() == 0


def test_sites(spark):
    urls = ["HTTP://WWW.A.example:8080/x?y", "//m.a.example/", "a.example", "http://user@a.example/", "", None, "   "]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    from pyspark.sql import functions as F

    assert [r["s"] for r in rows.select(site_lines.site_of(F.col("u")).alias("s")).collect()] == ["a.example"] * 4 + [None] * 3
