"""Columns filled from each other, against the same turns written out in plain arrays."""

import hashlib
import math

import numpy as np
import pytest

from seriesframe.operators import chained, impute


def uniform(*parts):
    text = "|".join("\\N" if p is None else str(p) for p in parts)
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296


def normal(*parts):
    return math.sqrt(-2 * math.log(uniform(*parts, "r"))) * math.cos(2 * math.pi * uniform(*parts, "a"))


@pytest.fixture(scope="module")
def holes():
    """Three columns that depend on each other and on x, with holes in all of them; a group without name."""
    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 150), (None, 90)):
        x = rng.normal(size=n)
        u = 2 + x + rng.normal(size=n) * 0.5
        v = u - 3 * x + rng.normal(size=n) * 0.5
        w = 0.5 * v + rng.normal(size=n) * 0.2
        for k in range(n):
            rows.append((g, k, float(x[k]), *[None if rng.random() < 0.25 else float(c[k]) for c in (u, v, w)]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, id long, x double, u double, v double, w double").repartition(3)


def plain(rows, m, rounds, draw, seed=1):
    """{(group, id, copy): [u, v, w]} by least squares with numpy."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        x = np.array([r[2] for r in own])
        data = np.array([[np.nan if c is None else c for c in r[3:]] for r in own])
        hole = np.isnan(data)
        for copy in range(1, m + 1):
            now = np.where(hole, np.nanmean(data, axis=0), data)
            for turn in range(rounds):
                for j, y in enumerate("uvw"):
                    tag = f"{seed}/{turn}/{y}"
                    z = np.column_stack([now[:, [c for c in range(3) if c != j]], x])
                    seen = ~hole[:, j]
                    mean = z[seen].mean(axis=0)
                    c = z[seen] - mean
                    level, n = now[seen, j].mean(), int(seen.sum())
                    b = np.linalg.lstsq(c, now[seen, j] - level, rcond=None)[0]
                    rss = ((now[seen, j] - level - c @ b) ** 2).sum()
                    free = n - 1 - 3
                    sd = math.sqrt(rss / free)
                    if draw:
                        part = 2 / (9 * free)
                        chi = free * (1 - part + normal(g, copy, tag, "v") * math.sqrt(part)) ** 3
                        sd *= math.sqrt(free / chi)
                        factor = np.linalg.cholesky(np.linalg.inv(c.T @ c))
                        b = b + sd * factor @ np.array([normal(g, copy, tag, f"b{i}") for i in range(3)])
                        level += normal(g, copy, tag, "c") * sd / math.sqrt(n)
                    for k in np.flatnonzero(~seen):
                        noise = sd * normal(g, copy, own[k][1], tag) if draw else 0.0
                        now[k, j] = level + (z[k] - mean) @ b + noise
            out |= {(g, own[k][1], copy): now[k] for k in range(len(own))}
    return out


@pytest.mark.parametrize(("method", "draw"), [("predict", False), ("norm", True)])
def test_turns_equal_plain_ones(spark, holes, method, draw):
    df = frame(spark, holes)
    out = chained.impute_chained(df, ["g"], ["u", "v", "w"], ["x"], "id", m=2, rounds=2, method=method).collect()
    want = plain(holes, 2, 2, draw)
    assert len(out) == len(want) == 2 * len(holes)
    for r in out:
        assert [r.u, r.v, r.w] == pytest.approx(list(want[r.g, r.id, r.m]), rel=1e-8)


def test_matched_values_are_observed_ones_and_reruns_agree(spark, holes):
    df = frame(spark, holes)
    run = lambda: sorted(map(str, chained.impute_chained(df, ["g"], ["u", "v"], ["x"], "id", m=2, rounds=2, method="pmm").collect()))
    out = chained.impute_chained(df, ["g"], ["u", "v"], ["x"], "id", m=2, rounds=2, method="pmm").collect()
    assert run() == sorted(map(str, out)) and len(out) == 2 * len(holes)
    before = {(r[0], r[1]): r for r in holes}
    for at, name in ((3, "u"), (4, "v")):
        seen = {g: {r[at] for r in holes if r[0] == g} - {None} for g in ("a", None)}
        for r in out:
            old = before[r.g, r.id][at]
            assert r[name] == old if old is not None else r[name] in seen[r.g]
    spread = [abs(a.u - b.u) for a in out for b in out if (a.g, a.id) == (b.g, b.id) and a.m < b.m and before[a.g, a.id][3] is None]
    assert max(spread) > 0


def test_slopes_survive_and_copies_differ(spark, holes):
    done = chained.impute_chained(frame(spark, holes), ["g"], ["u", "v", "w"], ["x"], "id", m=3, rounds=2)
    pooled = {r.g: r for r in impute.pool_estimates(done, ["g"], "u", "x").collect()}
    for g in ("a", None):
        assert pooled[g].estimate == pytest.approx(1.0, abs=0.25) and pooled[g].between_var > 0 and pooled[g].m_copies == 3


def test_groups_without_values_and_empty_tables(spark, holes):
    rows = [*holes, ("void", 0, 1.0, None, None, 3.0), ("void", 1, None, None, 2.0, 3.0), ("line", 0, 1.0, 1.0, 2.0, 3.0), ("line", 1, 2.0, None, 4.0, 5.0)]
    for method in chained.METHODS:
        out = chained.impute_chained(frame(spark, rows), ["g"], ["u", "v"], ["x", "w"], "id", m=1, rounds=1, method=method).collect()
        assert len(out) == len(rows)
        got = {(r.g, r.id): r for r in out}
        assert got["void", 0].u is None and got["void", 0].v == 2.0 and got["line", 1].u == 1.0
    assert chained.impute_chained(frame(spark, holes).limit(0), ["g"], ["u", "v"], ["x"], "id").collect() == []
    with pytest.raises(ValueError):
        chained.impute_chained(frame(spark, holes), ["g"], ["u"], ["x"], "id", method="mean")
