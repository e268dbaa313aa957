"""Statistics of pairs, folded by blocks, against all pairs at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from fathomline.operators import pairs
from fathomline.operators.models import great_circle


@pytest.fixture(scope="module")
def places():
    """Two regions, a spot that half of one shares, rows without a place, and an id that occurs twice."""
    rng = np.random.default_rng(5)
    rows = [(k, float(rng.uniform(0, 0.4)), float(rng.uniform(50, 50.3)), float(rng.normal()), k % 3) for k in range(120)]
    rows += [(200 + k, 179.9 if k % 2 else -179.95, 10.0 + (0.01 * k if k % 4 else 0.0), float(k % 7), k % 3) for k in range(80)]
    rows += [(900, None, 3.0, 1.0, 0), (901, 2.0, math.nan, 1.0, 1), (7, 0.2, 50.1, 2.0, 1)]
    return rows


def brute(rows):
    at = [r for r in rows if r[1] is not None and not math.isnan(r[2])]
    km = great_circle(np.array([r[1:3] for r in at]), np.array([r[1:3] for r in at]))
    return [(km[i, j], at[i], at[j]) for i in range(len(at)) for j in range(i + 1, len(at)) if at[i][0] != at[j][0]]


@pytest.fixture(scope="module")
def frame(spark, places):
    return spark.createDataFrame(places, "id bigint, lon double, lat double, y double, label int").repartition(5)


def test_distances_of_blocks(frame, places, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    got, km = pairs.distances(frame, 9.0).first(), np.array([p[0] for p in brute(places)])
    n = len(places)
    assert got["pairs"] == n * (n - 1) // 2 - 1
    assert (got["min_km"], got["max_km"], got["mean_km"]) == pytest.approx((km.min(), km.max(), km.mean()), abs=1e-9)
    assert got["near"] == (km <= 9.0).sum()


@pytest.mark.parametrize("bins,few", [(8, 3), (1 << 12, 1 << 10)])
def test_order_of_distances(frame, places, monkeypatch, bins, few):
    monkeypatch.setattr(pairs, "BLOCK", 64)
    got, km = pairs.distance_order(frame, bins, few).first(), np.sort([p[0] for p in brute(places)])
    gap = np.diff(km)
    at = int(gap.argmax())
    assert got["n"] == len(km)
    assert tuple(got)[1:] == pytest.approx((km[0], km[len(km) // 2], km[-1], gap[at], km[at], km[at + 1]), abs=1e-9)


def test_order_of_few_distances(spark):
    told = lambda *rows: tuple(pairs.distance_order(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id bigint, lon double, lat double")).first() or ())
    assert told((1.0, 2.0)) == ()
    one = told((0.0, 0.0), (1.0, 0.0))
    assert one[0] == 1 and one[4:] == (None, None, None) and one[1] == pytest.approx(111.195, abs=1e-3)
    assert told((4.0, 4.0), (4.0, 4.0), (4.0, 4.0)) == (3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("last", [12.0, 40.0])
def test_lag_sums_of_blocks(frame, places, monkeypatch, last):
    monkeypatch.setattr(pairs, "BLOCK", 64)
    edges = [0.0, 1.0, 5.0, last]
    want: dict[tuple, list[float]] = {}
    for km, p, q in brute(places):
        k = int(np.digitize(km, edges)) - 1
        if 0 <= k < 3:
            for label in {None, p[4], q[4]}:
                sums = want.setdefault((label, k), [0, 0.0, 0.0])
                for c, v in enumerate((1, km, 0.5 * (p[3] - q[3]) ** 2)):
                    sums[c] += v
    got: dict[tuple, list[float]] = {}
    for r in pairs.lag_sums(frame, edges, "label").collect():
        sums = got.setdefault((None if r["whole"] else r["label"], r["k"]), [0, 0.0, 0.0])
        for c, v in enumerate((r["n"], r["km"], r["half"])):
            sums[c] += v
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-9)


@pytest.mark.parametrize(("x0", "far"), [(0.0, 300.0), (0.4, 300.0), (0.4, 30.0), (0.0002, 300.0), (120.0, 20000.0)])
def test_lags_of_two_blocks_part_by_part(x0, far):
    """Few rows tell what all pairs add up to, with labels, values and places that are missing or shared."""
    rng, edges = np.random.default_rng(5), [far * k / 5 for k in range(6)]

    def block(n: int, west: float, side: int) -> pd.DataFrame:
        at = pd.DataFrame({"side": side, "id": np.arange(n) + int(west * 1e4), "lon": west + rng.random(n) * 0.2, "lat": 10 + rng.random(n) * 0.2, "y": rng.normal(5000, 900, n)})
        at["label"] = (at["lat"] > 10.1).astype(float)
        at.loc[rng.random(n) < 0.1, "y"], at.loc[rng.random(n) < 0.1, "label"] = np.nan, np.nan
        at.loc[n - 3 :, ["lon", "lat"]] = at.loc[0, ["lon", "lat"]].to_numpy()
        return at

    met = pairs.Met(block(700, 0.0, 0) if x0 == 0 else pd.concat([block(700, 0.0, 0), block(600, x0, 1)]), None)
    la, lb = (s["label"].fillna(2).astype(int).to_numpy() for s in (met.a, met.b))
    one = pairs.Parts(met.a, la)
    two = one if met.own else pairs.Parts(met.b, lb)
    got, rows = np.zeros((3, 3, 7, 4)), 0
    for k, p, q, n, km, m, half in pairs._lags(met, one, two, edges):
        np.add.at(got, (np.minimum(p, q), np.maximum(p, q), k), np.stack([np.ones(len(k)) if n is None else n, km, m, half], axis=1))
        rows += len(k)
    want, seen = np.zeros((3, 3, 7, 4)), 0
    for straight, i, j in met.chunks(ends=True):
        km, half = pairs.kilometres(straight), 0.5 * (met.a["y"].to_numpy()[i] - met.b["y"].to_numpy()[j]) ** 2
        told, seen = ~np.isnan(half), seen + len(km)
        np.add.at(want, (np.minimum(la[i], lb[j]), np.maximum(la[i], lb[j]), np.searchsorted(edges, km, "right")), np.stack([np.ones(len(km)), km, told, np.where(told, half, 0.0)], axis=1))
    assert np.allclose(got[:, :, 1:6], want[:, :, 1:6], rtol=1e-11, atol=1e-9)
    assert (got[:, :, 1:6, ::2] == want[:, :, 1:6, ::2]).all()
    assert far < 300 or met.repeated or rows < seen / 2
