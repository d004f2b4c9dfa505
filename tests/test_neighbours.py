import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import iterative, neighbours as N
from millrace.plans import balls, partial
from millrace.plans.neighbours import nearest


def brute(q, s, k, skip_same=False):
    out = {}
    for qi, qv in q:
        d = sorted((float(np.linalg.norm(np.array(qv) - np.array(sv))), si) for si, sv in s if not (skip_same and si == qi))
        out[qi] = [(round(a, 6), b) for a, b in d[:k]]
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    pts = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(200)]
    pts += [(200 + i, [0.5, 0.5, 0.5]) for i in range(100)]  # a third are copies
    return pts, spark.createDataFrame(pts, "id long, v array<double>").cache()


@pytest.mark.parametrize("block,pivots", [(2000, 256), (17, 5)])
def test_nearest_matches_brute_force(cloud, block, pivots):
    pts, df = cloud
    got = {r["id"]: [(round(n["dist"], 6), n["id"]) for n in r["neighbours"]] for r in
           nearest(df, df, 4, "id", "id", exclude_same=True, block=block, pivots=pivots).collect()}
    assert got == brute(pts, pts, 4, True)


def test_nearest_other_table_and_few_points(cloud, spark):
    pts, df = cloud
    got = {r["id"]: [(round(n["dist"], 6), n["pid"] if "pid" in n else n["id"]) for n in r["neighbours"]] for r in
           nearest(df.filter("id < 20"), df.filter("id < 3").withColumnRenamed("id", "pid"), 5, "id", "pid").collect()}
    assert got == brute(pts[:20], pts[:3], 5)


def imputed(rows, k):
    """Brute force over (id, values...): mean of the k nearest donors under the distance of shared columns."""
    d, out = len(rows[0]) - 1, {}
    for r in rows:
        mine = list(r[1:])
        for j in range(d):
            if r[1 + j] is not None:
                continue
            cand = []
            for s in rows:
                both = [i for i in range(1, d + 1) if r[i] is not None and s[i] is not None]
                if s[1 + j] is not None and both:
                    cand.append((np.sqrt(d / len(both) * sum((r[i] - s[i]) ** 2 for i in both)), s[0], s[1 + j]))
            have = [s[1 + j] for s in rows if s[1 + j] is not None]
            mine[j] = np.mean([c[2] for c in sorted(cand)[:k]]) if cand else (np.mean(have) if have else None)
        out[r[0]] = mine
    return out


def test_knn_impute_patterns(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(40, 3))
    rows = [[i, *map(float, r)] for i, r in enumerate(data)]
    for i in range(0, 40, 4):
        rows[i][1] = None
    for i in range(0, 40, 5):
        rows[i][2] = None
    df = spark.createDataFrame([tuple(r) for r in rows], "id long, a double, b double, c double")
    got = {r["id"]: [r["a"], r["b"], r["c"]] for r in N.knn_impute(df, ["a", "b", "c"], "id", 3).collect()}
    want = imputed(rows, 3)
    assert len(got) == 40 and all(got[i] == pytest.approx(want[i]) for i in want)


@pytest.mark.parametrize("block,pivots", [(1000, 256), (13, 6)])
def test_knn_impute_any_pattern(spark, block, pivots):
    """Nearly every pattern of five columns, copies, clusters, empty rows, rows that share nothing, -0.0."""
    rng = np.random.default_rng(21)
    data = rng.normal(size=(240, 5)) + 8.0 * rng.integers(0, 3, size=(240, 1))
    rows = [(i, *[None if rng.random() < 0.35 else float(x) for x in r]) for i, r in enumerate(data)]
    rows += [(240 + i, 0.0, None, 1.0, None, 2.0) for i in range(60)]
    rows += [(300, -0.0, None, 1.0, None, 2.0), (301, None, None, None, None, None), (302, None, None, None, None, 3.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, x3 double, e double").withColumn("n", F.lit("kept"))
    cols = ["a", "b", "c", "x3", "e"]
    got = {r["id"]: [r[c] for c in cols] for r in N.knn_impute(df, cols, "id", 4, block, pivots).collect()}
    want = imputed(rows, 4)
    assert len(got) == len(rows) and all(got[i] == pytest.approx(want[i]) for i in want)


def test_donors_of_a_large_cell_are_compared_in_stretches():
    """Few donors of a cell are compared, and only those at most ``t`` away are given; they are the nearest."""
    rng = np.random.default_rng(3)
    q, s = rng.random((2_000, 3)), rng.random((9_000, 3))
    q[:, 2], s[::3, 1], q[::2, 1] = np.nan, np.nan, np.nan
    s[:, 0] = s[:, 0].round(3)
    open_ended, near = np.full(len(q), np.inf), np.full(len(q), 0.01)
    both = [q[1::2, :2], s[np.flatnonzero(np.arange(len(s)) % 3)][:, :2]]
    assert partial._stretches(*both, open_ended[1::2], 5)[2].mean() < 0.1 * len(both[1])
    assert partial._stretches(q[:, :1], s[:, :1], open_ended, 5)[2].mean() < 0.02 * len(s)
    donors = pd.DataFrame({"v": list(s), "ids": [[2 * i, 2 * i + 1] for i in range(len(s))]})
    for t in (open_ended, near):
        got = partial._compare(pd.DataFrame({"vk": np.arange(len(q)).astype(str), "v": list(q), "t": t}), donors, 3, 5)
        best = {key: rows.sort_values(["dist", "id"]).head(5) for key, rows in got.groupby(["vk", "c"])}
        for i in range(0, len(q), 97):
            for c in np.flatnonzero(np.isnan(q[i])):
                gap = q[i] - s
                shared = (~np.isnan(gap)).sum(1)
                dist = np.sqrt(3 / np.maximum(shared, 1) * np.nansum(gap * gap, axis=1))
                want = sorted((dist[j], k, s[j, c]) for j in np.flatnonzero((shared > 0) & ~np.isnan(s[:, c]) & (dist <= t[i])) for k in (2 * j, 2 * j + 1))[:5]
                rows = best.get((str(i), c))
                assert ([] if rows is None else list(zip(rows["dist"], rows["id"], rows["x"]))) == want
        assert got["dist"].max() <= t.max() * (1 + 1e-9)


def test_knn_impute_jobs_do_not_grow_with_patterns(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 6))

    def jobs(share: float) -> int:
        rows = [(i, *[None if j == i % 2 and share == 0 or rng.random() < share else float(x) for j, x in enumerate(r)]) for i, r in enumerate(data)]
        df = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{j} double" for j in range(6)))
        group = f"impute-{share}"
        spark.sparkContext.setJobGroup(group, group)
        N.knn_impute(df, [f"c{j}" for j in range(6)], "id", 3).collect()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    few, many = jobs(0.0), jobs(0.4)  # 2 patterns, about 60
    assert 0 < many <= few + 5  # adaptive execution may run a stage or two as jobs of their own


def test_knn_impute_without_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "id long, a double, b double")
    assert [tuple(r) for r in N.knn_impute(df, ["a", "b"], "id").orderBy("id").collect()] == [(1, None, 2.0), (2, None, 2.0)]
    assert N.knn_impute(df.limit(0), ["a", "b"], "id").count() == 0


def test_nearest_with_empty_blocks(cloud):
    pts, df = cloud
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in nearest(df.filter("id < 24"), df.filter("id < 24"), 2, "id", "id", exclude_same=True, block=2, pivots=2).collect()}
    assert got == {i: [b for _, b in v] for i, v in brute(pts[:24], pts[:24], 2, True).items()}


def test_nearest_takes_both_zeros_for_one(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [5.0, 1.0])], "id long, v array<double>")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in nearest(df, df, 2, "id", "id", exclude_same=True).collect()}
    assert got == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


def clusters(xs, eps, m):
    """Brute-force density clusters: labels by smallest core row, -1 for noise, and the core flags."""
    n = len(xs)
    near = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= m
    label, c = np.full(n, -1), 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                j = todo.pop()
                for k in np.nonzero(near[j] & core & (label < 0))[0]:
                    label[k] = c
                    todo.append(k)
            c += 1
    for i in range(n):
        if not core[i]:
            own = [label[k] for k in np.nonzero(near[i] & core)[0]]
            label[i] = min(own) if own else -1
    return label.tolist(), core.tolist()


@pytest.mark.parametrize("block,reps,balls", [(2000, 16, None), (7, 1, None), (2000, 16, True)])
def test_dbscan_brute_force(spark, block, reps, balls):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(0, 0.4, (60, 2)), rng.normal(4, 0.4, (60, 2)), rng.uniform(-3, 7, (40, 2)), np.full((50, 2), 2.0)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, a double, b double")
    got = iterative.dbscan(df, ["a", "b"], "id", 0.5, 5, block=block, representatives=reps, balls=balls).orderBy("id").collect()
    assert ([r["cluster"] for r in got], [r["core"] for r in got]) == clusters(xy, 0.5, 5)


@pytest.mark.parametrize("block,reps", [(2000, 16), (40, 1)])
def test_dbscan_eight_columns(spark, block, reps):
    """Clusters, a chain, copies and noise in eight columns; nulls are left out."""
    rng = np.random.default_rng(6)
    chain = np.zeros((40, 8))
    chain[:, 0] = 12 + 0.6 * np.arange(40)
    xs = np.concatenate([rng.normal(0, 0.35, (80, 8)), rng.normal(4, 0.35, (80, 8)), chain, rng.uniform(-3, 7, (40, 8)), np.full((60, 8), 2.0)])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(xs)] + [(999, None), (998, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = iterative.dbscan(df, "v", "id", 1.0, 4, block=block, representatives=reps).orderBy("id").collect()
    label, core = clusters(xs, 1.0, 4)
    assert len(set(label)) > 3 and -1 in label and (np.array(label) >= 0).sum() > sum(core)
    assert ([r["cluster"] for r in got], [r["core"] for r in got]) == (label, core)


def test_dbscan_few_points_meet_all(spark, monkeypatch):
    """In a dense cloud only points without enough rows in their own block, or outside the largest component, meet all points."""
    rng = np.random.default_rng(8)
    xs = np.concatenate([rng.normal(0, 0.5, (600, 5)), rng.uniform(-9, 9, (20, 5))])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(xs)], "id long, v array<double>")
    asked, whole = [], iterative.within

    def counted(left, *args):
        asked.append(left.count())
        return whole(left, *args)

    monkeypatch.setattr(iterative, "within", counted)
    got = iterative.dbscan(df, "v", "id", 1.2, 4, block=200).orderBy("id").collect()
    assert ([r["cluster"] for r in got], [r["core"] for r in got]) == clusters(xs, 1.2, 4)
    assert 0 < sum(asked) < 200


def test_near_decides_the_limit_from_differences():
    rng = np.random.default_rng(9)
    q = np.concatenate([rng.integers(0, 4, (200, 3)) / 10.0, rng.normal(1e4, 1e-3, (50, 3)), [[np.inf, 0.0, 0.0]]])
    for eps in (0.1, 0.1 * math.sqrt(2), 0.3):
        with np.errstate(invalid="ignore"):
            want = ((q[:, None, :] - q[None, :, :]) ** 2).sum(2) <= eps * eps
        assert (balls.near(q, q, eps) == want).all()


def test_isolation_forest_flags_the_far_row(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(999, 30.0, -30.0)]
    out = iterative.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], "id", trees=30, sample=64)
    top = out.orderBy(F.desc("score")).first()
    assert top["id"] == 999 and top["is_outlier"] == 1
    assert out.filter("is_outlier = 1").count() == 15  # the rows above the 95 % quantile of 301


def test_jaccard_links_brute_force(spark):
    names = ["red ring", "blue ring", "ring red", "reds ring", "green widget", "widget", "ab"]
    df = spark.createDataFrame([(x,) for x in names], "a string")
    sh = lambda s: {s[i:i + 3] for i in range(max(len(s) - 2, 1))}
    want = {(x, y) for x in names for y in names if len(sh(x) & sh(y)) / len(sh(x) | sh(y)) >= 0.4}
    got = {tuple(r)[:2] for r in iterative.jaccard_links(df, df.withColumnRenamed("a", "b"), "a", "b", 0.4).collect()}
    assert got == want


@pytest.mark.parametrize("threshold,list_names", [(0.3, 1000), (0.5, 20), (0.8, 7), (1.0, 20)])
def test_jaccard_links_frequent_token(spark, threshold, list_names):
    """One token in a third of the names, its list cut into parts; every pair comes once. Empty and null names."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcde"), size=rng.integers(1, 4)))
    names = sorted({("xyz" if i % 3 == 0 else "") + word() + word() for i in range(240)} | {"", "xyz"})
    a = spark.createDataFrame([(x,) for x in names] + [(None,)], "a string")
    b = spark.createDataFrame([(x,) for x in names[::2]] * 2, "b string")
    sh = lambda s: {s[i:i + 3] for i in range(max(len(s) - 2, 1))}
    want = sorted((x, y) for x in names for y in names[::2] if len(sh(x) & sh(y)) / len(sh(x) | sh(y)) >= threshold)
    got = sorted(tuple(r)[:2] for r in iterative.jaccard_links(a, b, "a", "b", threshold, list_names=list_names).collect())
    assert got == want and len(want) >= len(names) // 2


def test_walks_follow_edges(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4)]
    both = set(e) | {(b, a) for a, b in e}
    out = iterative.random_walks(spark.createDataFrame(e, "src long, dst long"), length=12, walks=3).collect()
    assert len(out) == 12 and all(len(r["path"]) == 12 and all(p in both for p in zip(r["path"], r["path"][1:])) for r in out)


def test_chained_impute_recovers_a_plane(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        a, b = map(float, rng.normal(size=2))
        c = 2 * a - b + 1
        rows.append((i, None if i % 7 == 0 else a, b, None if i % 5 == 0 and i % 7 else c, a, c))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, ta double, tc double")
    bad = iterative.chained_impute(df, ["a", "b", "c"]).filter("abs(a - ta) > 1e-3 or abs(c - tc) > 1e-3").count()
    assert bad == 0


def test_weak_bounds_do_not_spread_the_points(spark, monkeypatch):
    """Where the bounds rule out nothing, points are not written once per cell; the answer stays that of brute force."""
    from millrace.plans import neighbours as P
    rng, written, real = np.random.default_rng(8), [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: (lambda x: written.append(x.count()) or x)(real(df)))
    for dims in (40, 1):
        pts = [(i, [float(x) for x in rng.normal(size=dims)]) for i in range(300)]
        df = spark.createDataFrame(pts, "id long, v array<double>")
        written.clear()
        got = {r["id"]: [(round(n["dist"], 6), n["id"]) for n in r["neighbours"]] for r in nearest(df, df, 3, "id", "id", exclude_same=True, block=10, pivots=64).collect()}
        assert got == brute(pts, pts, 3, True)
        assert len(written) == (4 if dims == 40 else 5)   # the fifth has a row per point and cell that it goes to


def shuffled_rows(spark, work) -> int:
    """Rows that ``work`` writes to shuffles, by its own stages (Spark forgets the oldest ones)."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()

    def stages() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = max(stages(), default=-1)
    work()
    return sum(n for i, n in stages().items() if i > before)


def test_neighbours_in_the_plane_send_each_point_a_few_times(spark):
    """Cells of several blocks do not send their points once per block, and few points go to other cells."""
    rng, per_point = np.random.default_rng(11), []
    for n in (400, 1_600):
        df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((n, 2)))], "id long, v array<double>").cache()
        df.count()
        per_point.append(shuffled_rows(spark, lambda: nearest(df, df, 20, "id", "id", exclude_same=True, block=40, pivots=4).count()) / n)
    assert per_point[1] < 1.5 * per_point[0] and per_point[1] < 30


def test_outlier_factor_brute_force(spark):
    """Copies, ties on a grid and a far row; keys are strings."""
    rng = np.random.default_rng(12)
    xs = np.concatenate([rng.integers(0, 12, (150, 2)) / 4.0, rng.normal(9, 0.3, (60, 2)), np.full((30, 2), 5.0), [[40.0, -40.0]]])
    keys = [f"k{i:03d}" for i in rng.permutation(len(xs))]
    hits = {q: d for q, d in brute(list(zip(keys, xs)), list(zip(keys, xs)), 7, True).items()}
    kd = {q: d[-1][0] for q, d in hits.items()}
    lrd = {q: 1 / (np.mean([max(d, kd[i]) for d, i in h]) + 1e-10) for q, h in hits.items()}
    want = {q: np.mean([lrd[i] for _, i in h]) / lrd[q] for q, h in hits.items()}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in zip(keys, xs)], "k string, a double, b double")
    got = {r["k"]: r for r in N.local_outlier_factor(df, ["a", "b"], "k", 7).collect()}
    assert got.keys() == want.keys() and all(got[q]["lof"] == pytest.approx(want[q], rel=1e-4) for q in want)
    assert got[keys[-1]]["is_outlier"] == 1


def test_outlier_factor_of_rows_that_come_twice(spark):
    """A neighbour whose row comes twice weighs twice in both means, as often as it is found."""
    rng, k = np.random.default_rng(16), 4
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    rows += rows[:40:5]
    times = {i: sum(r[0] == i for r in rows) for i in range(40)}
    hits = {}
    for i, a, b in rows:
        found = sorted((math.hypot(a - c, b - d), j) for j, c, d in rows)[:k + 1]
        hits[i] = [(d, j) for d, j in found if j != i][:k]
    weigh = lambda h, value: sum(times[j] * value(d, j) for d, j in h) / sum(times[j] for _, j in h)
    lrd = {i: 1 / (weigh(h, lambda d, j: max(d, hits[j][-1][0])) + 1e-10) for i, h in hits.items()}
    want = {i: weigh(h, lambda d, j: lrd[j]) / lrd[i] for i, h in hits.items()}
    got = N.local_outlier_factor(spark.createDataFrame(rows, "k long, a double, b double"), ["a", "b"], "k", k).collect()
    assert {r["k"]: r["lof"] for r in got} == pytest.approx(want, rel=1e-9) and len(got) == 40


@pytest.mark.parametrize("dims", [1, 2, 6])
def test_parts_without_points_and_queries_far_off(spark, dims):
    """Parts of one or two points, many of them empty, and many queries in the cell of one point."""
    rng = np.random.default_rng(13)
    s = [(i, [float(x) for x in r]) for i, r in enumerate(np.concatenate([rng.normal(size=(60, dims)), 1e6 + rng.normal(size=(5, dims))]))]
    q = [(f"q{i}", [float(x) for x in r]) for i, r in enumerate(np.concatenate([rng.normal(size=(20, dims)), 900 + rng.normal(size=(60, dims)), 1e6 + rng.normal(size=(10, dims))]))]
    left, right = spark.createDataFrame(q, "qid string, v array<double>"), spark.createDataFrame(s, "id long, v array<double>")
    got = {r["qid"]: [n["id"] for n in r["neighbours"]] for r in nearest(left, right, 3, "qid", "id", block=2, pivots=40).collect()}
    exact = {a: [j for _, j in sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in s)[:3]] for a, v in q}
    assert got == exact


def test_vectors_of_many_columns_are_not_sent_once_per_block(spark):
    """Where all blocks meet all blocks, what is shuffled grows with the points and not with the blocks; groups of copies included."""
    rng, per_point = np.random.default_rng(14), []
    for n in (400, 1_600):
        pts = [(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(n, 40)))] + [(n + i, [0.25] * 40) for i in range(20)]
        df = spark.createDataFrame(pts, "id long, v array<double>").cache()
        df.count()
        got = {}
        per_point.append(shuffled_rows(spark, lambda: got.update({r["id"]: [(round(m["dist"], 6), m["id"]) for m in r["neighbours"]] for r in nearest(
            df, df, 5, "id", "id", exclude_same=True, block=40, pivots=64).collect()})) / n)
        some = dict(pts[:20] + pts[-3:])
        assert {i: got[i] for i in some} == {i: v for i, v in brute(list(some.items()), pts, 5, True).items()}
    assert per_point[1] < 1.5 * per_point[0] and per_point[1] < 30


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_closest_where_the_product_cannot_tell(shift, monkeypatch):
    """Far from the origin, and with two far clusters, whose product hides small distances; many ties; ids of text."""
    from millrace.plans import neighbours as P
    rng = np.random.default_rng(15)
    s = np.concatenate([rng.integers(0, 9, (300, 2)) / 8.0, 1e12 + rng.integers(0, 9, (300, 2))]) + shift
    q, ids = s[::7], np.array([f"k{i:03d}" for i in rng.permutation(1_200)], dtype=object)
    first = np.arange(0, 1_201, 2)
    ids = np.concatenate([sorted(ids[i:i + 2]) for i in first[:-1]]).astype(object)
    monkeypatch.setattr(P, "PAIRS", 5_000)
    for tight in (False, True):
        best = P.Closest(q, 5, np.full(len(q), np.inf))
        for i in range(0, 600, 150):
            best.offer(s[i:i + 150], first[:151], ids[2 * i:2 * i + 300], tight)
        got = [list(zip(best.dist[best.row == i], best.ids[best.row == i])) for i in range(len(q))]
        dist = np.sqrt(((q[:, None] - s[None]) ** 2).sum(2))
        assert got == [sorted((d[j // 2], ids[j]) for j in range(1_200))[:5] for d in dist]
