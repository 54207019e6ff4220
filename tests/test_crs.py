"""Conversions: published control points, there and back, grids and refusals."""

import pytest
from pyspark.sql import functions as F

from strataframe.functions import crs


def dms(d, m, s):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


def moved(spark, rows, a, b):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double")
    return [tuple(r) for r in crs.convert(df, a, b).collect()]


def test_published_grid_coordinates(spark):
    """Buninyong and Flinders Peak, of the technical manual of the datum."""
    rows = [(dms(143, 55, 35.38390), dms(-37, 39, 10.15610), 745), (dms(144, 25, 29.52440), dms(-37, 57, 3.72030), 350)]
    got = moved(spark, rows, crs.system(4283), crs.system(28355))
    assert got[0] == pytest.approx((228854.052, 5828259.038, 745), abs=1e-3)
    assert got[1] == pytest.approx((273741.297, 5796489.777, 350), abs=1e-3)
    back = moved(spark, got, crs.system(28355), crs.system(4283))
    assert all(g == pytest.approx(w, abs=1e-10) for g, w in zip(back, rows))


def test_published_change_of_frame(spark):
    """Alice Springs in both frames, of the same manual."""
    was, now = (-4052051.7643, 4212836.2017, -2545106.0245), (-4052052.7379, 4212835.9897, -2545104.5898)
    df = spark.createDataFrame([was], "__gx double, __gy double, __gz double")
    h = crs.SHIFTS[0][4]
    there = crs._shifted(df, h, True)
    assert tuple(there.first()) == pytest.approx(now, abs=1e-4)
    assert tuple(crs._shifted(there, h, False).first()) == pytest.approx(was, abs=1e-8)
    a = crs.System("GDA94").ellipsoid()
    geo = crs._geodetic(df, a).withColumn("__h", F.lit(603.3466))
    assert tuple(crs.geocentric(geo, a).select("__gx", "__gy", "__gz").first()) == pytest.approx(was, abs=2e-2)


@pytest.mark.parametrize(("a", "b"), [(20355, 7855), (20256, 28356), (4326, 32756), (28350, 28351), (4202, 7844), (32610, 4326)])
def test_there_and_back(spark, a, b):
    east = {20355: 147, 20256: 153, 4326: 153, 28350: 117, 4202: 134, 32610: -123}[a]
    lat = 45 if a == 32610 else -25
    rows = moved(spark, [(east + i * 0.7, lat - i, 100 * i) for i in range(-3, 4)], crs.System(crs.system(a).datum), crs.system(a))
    back = moved(spark, moved(spark, rows, crs.system(a), crs.system(b)), crs.system(b), crs.system(a))
    assert all(g == pytest.approx(w, abs=2e-3 if crs.system(a).meridian else 2e-8) for g, w in zip(back, rows))


def test_plans(spark):
    p = crs.plan(crs.system(20255), crs.system(7855))
    assert p.steps == ["EPSG:15979 AGD66 to GDA94 (12)", "EPSG:8048 GDA94 to GDA2020 (1)"] and p.accuracy == 3.0 and not p.identity
    assert crs.plan(crs.system(28355), crs.system(28355)).identity
    with pytest.raises(ValueError, match="isn't registered"):
        crs.system(1234)
    with pytest.raises(ValueError, match="leads from"):
        crs.plan(crs.system(28355), crs.System("MARS"))


def test_site_grids_and_missing_numbers(spark):
    mga = crs.system(28355)
    site = crs.SiteGrid(mga, (500_000.0, 7_000_000.0), (1000.0, 2000.0), turn=30.0, scale=1.0003)
    inner = crs.SiteGrid(site, (1000.0, 2000.0), turn=-30.0, scale=1 / 1.0003)
    assert crs.plan(mga, site).flat and crs.plan(site, inner).flat
    got = moved(spark, [(500_100.0, 7_000_000.0, 5.0)], mga, site)[0]
    assert got == pytest.approx((1000 + 100.03 * 3**0.5 / 2, 2000 + 50.015, 5.0))
    assert moved(spark, [(500_100.0, 7_000_000.0, 5.0)], mga, inner)[0] == pytest.approx((100.0, 0.0, 5.0), abs=1e-6)
    assert moved(spark, moved(spark, [got], site, crs.system(7855)), crs.system(7855), site)[0] == pytest.approx(got, abs=1e-6)
    df = spark.createDataFrame([(1.0, None, 2.0), (float("nan"), 1.0, 2.0)], "x double, y double, z double")
    assert [tuple(r) for r in crs.convert(df, mga, crs.system(4283)).collect()] == [(None, None, 2.0)] * 2
