import numpy as np
import pytest
from pyspark.sql import functions as F

from facets.operators import features, layout


def test_pulls_have_the_wanted_perplexity():
    rng = np.random.default_rng(1)
    weights = layout.pull_weights(np.sort(rng.random((50, 40)) * rng.random((50, 1)), axis=1), 12)
    assert np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(np.exp(-(weights * np.log(weights)).sum(axis=1)), 12, rtol=1e-6)
    assert (np.diff(weights, axis=1) <= 1e-12).all()
    assert np.allclose(layout.pull_weights(np.zeros((2, 4)), 12), 0.25)


def test_field_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    at = rng.normal(size=(600, 2)) * 8
    spots = spark.createDataFrame([tuple(map(float, p)) for p in at], "x double, y double")
    apart = at[:, None] - at[None]
    q = 1 / (1 + (apart ** 2).sum(axis=2))
    want = (q[:, :, None] ** 2 * apart).sum(axis=1) / ((q.sum() - 600) / 600)
    error = []
    for size in (256, 1024):
        frame = layout._frame(spots, size)
        counts = layout._counts(spots.repartition(5), frame)
        assert counts.sum() == pytest.approx(600, abs=1e-2)
        cells, shares = frame.corners(at)
        got = (frame.field(counts)[cells] * shares[:, :, None]).sum(axis=1)
        error.append(np.abs(got - want).max() / np.abs(want).max())
    # Bilinear on both sides: a quarter of the cell makes about a sixteenth of the error.
    assert error[0] < 0.03 and error[1] < error[0] / 8


@pytest.fixture(scope="module")
def ring(spark):
    """Twelve groups of 25 rows in 20 dimensions, more than two components can keep apart."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 20)) * 4
    rows = [(int(i), (centres[i % 12] + rng.normal(size=20)).tolist(), 7) for i in range(300)]
    return spark.createDataFrame(rows, "id long, vec array<double>, block int")


def test_map_keeps_groups_together(spark, ring, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_ROWS", 70)
    found = layout.neighbor_map(ring, "id", "vec", 12, rounds=5, steps=30).toPandas()
    again = layout.neighbor_map(ring.repartition(5), "id", "vec", 12, rounds=5, steps=30).toPandas()
    found, again = found.sort_values("id"), again.sort_values("id")
    assert np.allclose(found, again, atol=1e-3)
    at = found[["map_x", "map_y"]].to_numpy()
    group = found["id"].to_numpy() % 12
    far = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    assert (group[np.argsort(far, axis=1)[:, :5]] == group[:, None]).mean() > 0.97
    spots = ring.join(spark.createDataFrame(found), "id")
    kept = layout.neighborhood_kept(spots, "id", "vec").first()[0]
    assert kept > layout.neighborhood_kept(features.map2d(ring, "vec"), "id", "vec").first()[0]


def test_copies_nulls_and_few_rows(spark):
    rows = [(i, [float(i % 6), float(i % 6) ** 2, 1.0]) for i in range(60)] + [(90, None)]
    df = spark.createDataFrame(rows, "map_x long, vec array<double>").withColumn("y", F.lit("q"))
    found = {r[0]: tuple(r)[1:] for r in layout.neighbor_map(
        df, "map_x", "vec", 3, rounds=3, steps=4).collect()}
    assert len(found) == 61 and found.pop(90) == (None, None)
    assert all(found[i] == found[i % 6] for i in found)
    assert len(set(found.values())) == 6 and np.isfinite(list(found.values())).all()
    for n, distinct in ((0, 0), (1, 1), (2, 2)):
        few = layout.neighbor_map(df.where(F.col("map_x") < n), "map_x", "vec").collect()
        assert len(few) == n and len({r[1:] for r in map(tuple, few)}) == distinct
    line = spark.createDataFrame([(i, [float(i)]) for i in range(8)], "id long, vec array<double>")
    assert np.isfinite(layout.neighbor_map(line, "id", "vec", 2, rounds=2).toPandas()).all(None)


def test_blocks_travel_as_single_rows(spark, ring, monkeypatch):
    written = []

    def cut(df):
        out = layout_cut(df)
        written.append((out.columns, out.count()))
        return out

    layout_cut = layout.cut
    monkeypatch.setattr(layout, "BLOCK_ROWS", 100)
    monkeypatch.setattr(layout, "cut", cut)
    assert layout.neighbor_map(ring, "id", "vec", 12, rounds=3, steps=2).count() == 300
    # Three blocks: what rounds send and write is counted in blocks and pairs of blocks, not in rows.
    assert [n for c, n in written if "x" in c][-3:] == [3, 3, 3]
    assert all(n <= 9 for c, n in written if "places" in c or "near" in c)
