"""Relocated pairs, written formats, splines and boundaries on small inputs worked out by hand."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.operators import outlines as O, series as S, vertical as V
from tidewater.operators.relocate import relocate_pairs
from tidewater.sources import writers as W


@pytest.fixture(scope="module")
def strip(spark):
    """Ten quads in a row, 10 wide; depths fall from 0 at the left to 10 at the right."""
    nodes = [(i + 11 * j, 10.0 * i, 10.0 * j, float(i)) for j in (0, 1) for i in range(11)]
    elems = [(i, p, n) for i in range(10) for p, n in enumerate((i, i + 1, i + 12, i + 11))]
    return spark.createDataFrame(elems, "elem_id long, pos int, node_id long"), spark.createDataFrame(nodes, "node_id long, x double, y double, depth double")


def moved(spark, strip, rows, **options):
    pairs = spark.createDataFrame(rows, "pair_id long, xs double, ys double, xn double, yn double")
    return {r["pair_id"]: r for r in relocate_pairs(pairs, *strip, 25.0, **options).collect()}


def test_pairs_go_to_two_elements_that_are_deep_enough(spark, strip):
    got = moved(spark, strip, [(1, 45.0, 5.0, 45.0, 5.0), (2, 5.0, 5.0, 5.0, 5.0), (3, 45.0, 5.0, 75.0, 5.0), (4, 5.0, 5.0, 75.0, 5.0), (5, 150.0, 5.0, 150.0, 5.0)], rings=(1, 2), least=3.0, mean=3.5, random_from=99.0)
    # By rings of one: elements 3 to 5; without the start, 4, only 3 and 5. The deeper is the sink.
    assert (got[1]["status"], got[1]["source_elem"], got[1]["sink_elem"], got[1]["rings_used"], got[1]["snapped"]) == ("relocated", 3, 5, 1, False)
    # Elements 0 to 2 are too shallow: the two deepest of two rings.
    assert (got[2]["status"], got[2]["severity"], got[2]["source_elem"], got[2]["sink_elem"], got[2]["rings_used"]) == ("failed", "soft", 1, 2, 2)
    assert (got[3]["status"], got[3]["source_elem"], got[3]["xs"], got[3]["xn"]) == ("separated", None, 45.0, 75.0)
    # One end stays, the other goes to the deepest of its last rings, which will not do.
    assert (got[4]["status"], got[4]["source_elem"], got[4]["sink_elem"], got[4]["xs"]) == ("failed", 2, 7, 25.0)
    # Outside of the mesh: from the nearest element, 9.
    assert (got[5]["status"], got[5]["snapped"], {got[5]["source_elem"], got[5]["sink_elem"]}) == ("relocated", True, {8, 9})


def test_a_pair_keeps_its_element_where_one_end_may_stay(spark, strip):
    got = moved(spark, strip, [(1, 45.0, 5.0, 45.0, 5.0)], rings=(1, 2), least=3.0, mean=3.5, random_from=99.0, move_both=False)[1]
    assert 4 in (got["source_elem"], got["sink_elem"]) and got["source_elem"] != got["sink_elem"]
    far = moved(spark, strip, [(1, 5.0, 5.0, 5.0, 5.0)], rings=(3, 6), least=3.0, mean=3.5, within=20.0)[1]
    assert far["status"] == "failed"


def test_wrong_requests_and_forcings_are_errors(spark, strip):
    stations = spark.createDataFrame([(0, 1.0, 2.0, 0.0, "a", "default", 'An "old" one')], "pos long, x double, y double, z double, station_id string, subloc string, name string")
    lines = [r["raw"] for r in W.write_station_in(stations, None, "f").orderBy("line_no").collect()]
    assert lines[0].startswith("1 1 1 1 1 1 1 1 1 !elev,") and lines[1] == "1" and lines[2] == '1 1.00 2.00 0.00 ! a default "An ""old"" one"'
    with pytest.raises(ValueError):
        W.write_station_in(stations, ["depth"], "f")
    with pytest.raises(ValueError):
        W.write_th_lines(stations, stations, dated=False)
    strings = spark.createDataFrame([("ocean", 0, 7), ("ocean", 1, 8)], "name string, seq long, node_id long")
    force = lambda name, n: spark.createDataFrame([(name, "M2", [0.5] * n, [1.0])], "name string, constituent string, amplitude array<double>, phase array<double>")
    assert O.boundary_forcing(strings, force("ocean", 2)).count() == 2
    for bad in (force("river", 1), force("ocean", 3)):
        with pytest.raises(PySparkException):
            O.boundary_forcing(strings, bad).collect()


def test_a_whole_boundary_without_segments_is_islands(spark, strip):
    none = spark.createDataFrame([], "ord int, x0 double, y0 double, x1 double, y1 double")
    got = O.boundary_strings(*strip, none, 25.0).orderBy("seq").collect()
    assert {r["kind"] for r in got} == {"island"} and [r["node_id"] for r in got] == [*range(11), *range(21, 10, -1), 0]


def test_spline_is_that_of_a_dense_solve():
    rng = np.random.default_rng(1)
    x, y = np.arange(12.0), rng.normal(size=12)
    at = np.linspace(0, 11, 89)
    # Unknowns: the four coefficients of each of 11 pieces.
    a, b, n = np.zeros((44, 44)), np.zeros(44), 0
    power = lambda t, k: [np.prod(np.arange(p, p - k, -1)) * t ** (p - k) if p >= k else 0.0 for p in range(4)]
    for i in range(11):
        for t, v in ((0.0, y[i]), (1.0, y[i + 1])):
            a[n, 4 * i : 4 * i + 4], b[n], n = power(t, 0), v, n + 1
        for k in (1, 2) if i < 10 else ():
            a[n, 4 * i : 4 * i + 4], a[n, 4 * i + 4 : 4 * i + 8] = power(1.0, k), [-v for v in power(0.0, k)]
            n += 1
    for i in (0, 9):
        a[n, 4 * i + 3], a[n, 4 * i + 7] = 1, -1
        n += 1
    c = np.linalg.solve(a, b).reshape(11, 4)
    i = np.minimum(at.astype(int), 10)
    want = sum(c[i, p] * (at - i) ** p for p in range(4))
    assert np.allclose(S.spline_values(x, y, at), want)


def test_projection_and_back(spark):
    row = spark.range(1).select(*V.utm(F.lit(-121.5), F.lit(38.0))).first()
    back = spark.range(1).select(*V.utm_to_ll(F.lit(row[0]), F.lit(row[1]))).first()
    assert back[0] == pytest.approx(-121.5, abs=1e-9) and back[1] == pytest.approx(38.0, abs=1e-9)
