"""Model fits from sums over all rows, against plain code."""

import numpy as np
import pytest
from conftest import at  # noqa: F401  (puts the repository on the path)
from pyspark.sql import functions as F

from tillwise.operators import kmeans, logistic, silhouette, statistics


def points_frame(spark, x, **columns):
    names = list(columns)
    rows = [(row.tolist(), *[columns[n][i].item() for n in names]) for i, row in enumerate(x)]
    kinds = "".join(f", {n} {'int' if columns[n].dtype.kind == 'i' else 'double'}" for n in names)
    return spark.createDataFrame(rows, f"x array<double>{kinds}").cache()


def clouds(seed=0, n=600, k=4, d=5, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (k, d))
    of = rng.integers(0, k, n)
    return centres[of] + rng.normal(0, spread, (n, d)), of


def lloyd(x, centres):
    for _ in range(500):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(new - centres).max() == 0:
            break
        centres = new
    return ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def plain_silhouettes(x, of):
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        mine = of == of[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        inside = away[i, mine].sum() / (mine.sum() - 1)
        outside = min(away[i, of == c].mean() for c in set(of.tolist()) - {of[i]})
        most = max(inside, outside)
        out.append((outside - inside) / most if most else 0.0)
    return np.array(out)


@pytest.mark.parametrize("tasks", [3, statistics.FEW_TASKS + 1])
def test_sums_are_the_same_with_few_and_many_tasks(spark, tasks):
    x, _ = clouds(1)
    df = points_frame(spark, x).repartition(5)
    got = statistics.summed(df, lambda b: np.concatenate([[len(b["x"])], b["x"].sum(0)]), tasks)
    assert np.allclose(got, [len(x), *x.sum(0)])
    assert statistics.summed(df.where("false"), lambda b: b["x"].sum(0), tasks) is None


def test_joint_starts_end_in_the_best_of_plain_fits(spark):
    x, _ = clouds(2, spread=1.5)
    fits = kmeans.fit_kmeans(points_frame(spark, x), [2, 3, 4, 5], 7, 8)
    rng = np.random.default_rng(3)
    for k, fit in fits.items():
        plain = min(lloyd(x, kmeans.first_centres(x, k, rng)) for _ in range(10))
        assert len(fit.clusterCenters()) == k
        assert lloyd(x, fit.centres) <= fit.summary.trainingCost + 1e-6
        assert fit.summary.trainingCost <= plain * 1.02
    own = points_frame(spark, x).select("x", fits[4].nearest(F.col("x")).alias("c")).collect()
    away = ((x[:, None] - fits[4].centres[None]) ** 2).sum(2)
    assert [r.c for r in own] == away.argmin(1).tolist()


def test_starts_share_their_passes(spark, monkeypatch):
    calls = []
    plain = statistics.summed
    monkeypatch.setattr(kmeans, "summed", lambda *a: calls.append(1) or plain(*a))
    x, _ = clouds(4, spread=1.5)
    fits = kmeans.fit_kmeans(points_frame(spark, x), [3, 4], 7, 8)
    assert len(calls) <= 60 and all(f.summary.numIter <= len(calls) for f in fits.values())


def test_passes_get_points_in_batches(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(1000, 3))
    monkeypatch.setattr(kmeans, "PACKED", 300)
    sizes = kmeans.packed(points_frame(spark, x), 4).map(lambda b: b["x"].shape).collect()
    assert sum(n for n, _ in sizes) == 1000 and {d for _, d in sizes} == {3} and max(sizes)[0] == 100
    batches, plain = [], kmeans.summed
    monkeypatch.setattr(kmeans, "summed", lambda p, *a: batches.append(p.count()) or plain(p, *a))
    monkeypatch.setattr(kmeans, "PACKED", 1 << 18)
    kmeans.fit_kmeans(points_frame(spark, x), [3], 7, 8)
    assert 0 < max(batches) <= 8


@pytest.mark.parametrize("tasks", [8, 1000])
def test_sums_of_batches_pass_over_empty_parts(spark, tasks):
    batches = spark.sparkContext.parallelize([{"x": np.full((n, 2), n)} for n in (1, 2, 3)], 8)
    got = statistics.summed(batches, lambda b: b["x"].sum(0), tasks)
    assert got.tolist() == [14.0, 14.0]


def test_fewer_distinct_points_than_centres(spark):
    x = np.array([[0.0, 0.0]] * 20 + [[1.0, 1.0]] * 5)
    fit = kmeans.fit_kmeans(points_frame(spark, x), [4], 7, 8)[4]
    assert sorted(map(tuple, fit.centres.tolist())) == [(0.0, 0.0), (1.0, 1.0)]
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(points_frame(spark, x).where("false"), [2], 7, 8)


def test_newton_comes_to_the_optimum_in_ten_passes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (800, 4))
    x = np.concatenate([x, x[:, :1] + 1e-3 * rng.normal(0, 1, (800, 1)), np.zeros((800, 1))], 1)
    y = (x[:, 0] * 2 - x[:, 1] + rng.logistic(0, 1, 800) > 1).astype(float)
    weight = np.where(y == 1, 400 / y.sum(), 400 / (800 - y.sum()))
    fit = logistic.fit_logistic(points_frame(spark, x, label=y, weight=weight), 6, 800, 2000, 8)
    beta = fit.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + fit.intercept)))
    assert np.abs(x.T @ (weight * (p - y)) + beta).max() < 1e-5 and abs((weight * (p - y)).sum()) < 1e-5
    assert fit.passes <= 10 and fit.slope <= logistic.FLAT
    got = points_frame(spark, x).select(fit.probability(F.col("x"))).collect()
    assert np.allclose([r[0] for r in got], p)


def test_newton_on_classes_that_a_plane_parts(spark):
    x = np.concatenate([np.linspace(-3, -1, 50), np.linspace(1, 3, 50)])[:, None]
    y = np.repeat([0.0, 1.0], 50)
    fit = logistic.fit_logistic(points_frame(spark, x, label=y, weight=np.ones(100)), 1, 100, 2000, 8)
    assert fit.coefficients[0] > 1 and fit.passes < 20


def score(df, k, **more):
    return silhouette.silhouette(df, F.col("x"), F.col("of"), k, tasks=8, **more)


def test_silhouettes_are_exact_below_the_limit(spark):
    x, of = clouds(6, n=300)
    of[:1] = 4  # one alone in its segment
    assert abs(score(points_frame(spark, x, of=of.astype(np.int32)), 6) - plain_silhouettes(x, of).mean()) < 1e-9


def test_silhouettes_of_equal_points_and_single_segments(spark):
    x = np.zeros((10, 2))
    of = (np.arange(10) % 2).astype(np.int32)
    assert score(points_frame(spark, x, of=of), 2) == 0.0
    assert score(points_frame(spark, x, of=0 * of), 2) is None
    assert score(points_frame(spark, x, of=of).where("false"), 2) is None


def test_silhouettes_are_exact_for_any_number_of_rows(spark):
    """Nothing but a caller's word makes them estimates."""
    x, of = clouds(10, n=20_500, k=3, d=2, spread=2.0)
    x[:40] += np.random.default_rng(1).normal(0, 60, (40, 2))
    members = np.eye(3)[of]
    means = np.empty((len(x), 3))
    for k in range(0, len(x), 100):
        means[k : k + 100] = np.sqrt(sum((x[k : k + 100, None, c] - x[:, c]) ** 2 for c in (0, 1))) @ members
    at, sizes = np.arange(len(x)), members.sum(0)
    inside = means[at, of] / (sizes[of] - 1)
    means /= sizes
    means[at, of] = np.inf
    outside = means.min(1)
    expected = ((outside - inside) / np.maximum(inside, outside)).mean()
    assert abs(score(points_frame(spark, x, of=of.astype(np.int32)), 3) - expected) < 1e-9


def test_a_task_holds_a_bounded_part_of_the_points(spark, monkeypatch):
    x, of = clouds(11, n=900, k=4, spread=2.0)
    monkeypatch.setattr(silhouette, "HELD", 50)
    monkeypatch.setattr(silhouette, "TASKS", 4)
    monkeypatch.setattr(silhouette, "DISTANCES_PER_TASK", 900)
    df = points_frame(spark, x, of=of.astype(np.int32)).coalesce(1)
    parts, tasks = silhouette._parts(df.select("x", F.array("of").alias("of")), len(x))
    sizes = parts.map(lambda b: len(b["x"])).collect()
    assert tasks == 18 and sum(sizes) == 900 and max(sizes) <= 60
    assert abs(score(df, 4) - plain_silhouettes(x, of).mean()) < 1e-9


def test_equal_points_are_no_distance_apart(spark):
    """Two segments at one place, far from the mean: no rounding makes one seem nearer."""
    x = np.repeat(np.array([[1000.1, -333.3, 7.7], [1000.1, -333.3, 7.7], [-2000.7, 0.1, 5.3]]), 40, axis=0)
    of = np.repeat(np.arange(3), 40)
    assert abs(score(points_frame(spark, x, of=of.astype(np.int32)), 3) - 1 / 3) < 1e-12


@pytest.mark.parametrize("seed", range(4))
def test_sampled_silhouettes_keep_their_bound(spark, monkeypatch, seed):
    """Skewed segments with far points; the sample is a small part of the rows."""
    rng = np.random.default_rng(seed)
    x, of = clouds(seed, n=4000, k=3, spread=1.0)
    x[:20] += rng.normal(0, 60, (20, 5))
    df = points_frame(spark, x, of=of.astype(np.int32))
    drawn = []
    plain = silhouette._sampled
    monkeypatch.setattr(silhouette, "_sampled", lambda *a: drawn.append(plain(*a)) or drawn[-1])
    monkeypatch.setattr(silhouette, "draws", lambda *a: 120.0)
    got = score(df, 3, exact_rows=100, seed=seed)
    assert len(drawn[0][0]) < 1500
    assert abs(got - plain_silhouettes(x, of).mean()) < 0.05


@pytest.mark.parametrize("exact_rows", [10_000, 100])
def test_groupings_share_their_distances(spark, monkeypatch, exact_rows):
    """Each grouping has the silhouette it has alone; a table in one part is spread over tasks by its distances."""
    x, of = clouds(8, n=1500, k=4, spread=1.0)
    other = (np.arange(len(x)) % 7).astype(np.int32)
    other[0] = 7  # one alone in its segment
    df = points_frame(spark, x, of=of.astype(np.int32), other=other, one=0 * other).coalesce(1)
    monkeypatch.setattr(silhouette, "draws", lambda *a: 120.0)
    monkeypatch.setattr(silhouette, "DISTANCES_PER_TASK", 100_000)
    passes, plain = [], silhouette.summed
    monkeypatch.setattr(silhouette, "summed", lambda df, f, tasks: passes.append(tasks) or plain(df, f, tasks))
    got = silhouette.silhouettes(df, F.col("x"), F.array("of", "other", "one"), [4, 8, 1], exact_rows=exact_rows)
    allowed = 1e-9 if exact_rows > len(x) else 0.05
    assert abs(got[0] - plain_silhouettes(x, of).mean()) < allowed
    assert abs(got[1] - plain_silhouettes(x, other).mean()) < allowed
    assert got[2] is None
    assert len(passes) <= 3 and 2 <= passes[-1] <= 23


def test_nearest_centres_of_several_fits(spark):
    x, _ = clouds(9, n=300)
    df = points_frame(spark, x)
    fits = list(kmeans.fit_kmeans(df, [2, 5], 1, 8).values())
    alone = F.array(*[fit.nearest(F.col("x")) for fit in fits])
    placed = kmeans.with_nearest(df, fits)
    assert sorted(map(str, placed.collect())) == sorted(map(str, df.select("x", alone.alias("of")).collect()))


def test_the_draws_follow_from_the_bound():
    t = silhouette.draws(10**9, 8, 0.2, 0.01)
    error = 0.2 / 2.2
    assert 2 * 10**9 * 8 * np.exp(-t * error**2 / 3) <= 0.01 * (1 + 1e-9)
    assert abs(2 * error / (1 - error) - 0.2) < 1e-12 and 3 * t < 50_000
