"""Line formats, casts and mesh refinement on small tables with answers worked out by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater.functions import columns
from tidewater.operators import casts, mesh, refine
from tidewater.sources import lines

MESH = """two cells
2 6
1 0.0 0.0 1.0
2 10.0 0.0 2.0
3 10.0 10.0 3.0
4 0.0 10.0 4.0
5 20.0 0.0 5.0
6 20.0 10.0 6.0
1 4 1 2 3 4
2 4 2 5 6 3
1 = Number of open boundaries
2 = Total number of open boundary nodes
2 = Number of nodes for open boundary 1
1
4
2 = Number of land boundaries
4 = Total number of land boundary nodes
2 0 = Number of nodes for land boundary 1
1
2
2 0 = Number of nodes for land boundary 2
5
6
"""


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def text(spark, content):
    return lines.lines_of(spark.createDataFrame([("f", content)], "file string, content string"))


def square(spark, corners):
    node = spark.createDataFrame([(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(corners)], "node_id long, x double, y double, depth double")
    return node, spark.createDataFrame([(0, i, i) for i in range(len(corners))], "elem_id long, pos int, node_id long")


def test_gr3_blocks(spark):
    node, elem, strings = lines.read_gr3(text(spark, MESH))
    assert rows(node, "node_id")[4] == ("f", 5, 20.0, 0.0, 5.0)
    assert [r[3] for r in rows(elem, "elem_id", "pos")] == [1, 2, 3, 4, 2, 5, 6, 3]
    assert rows(strings.drop("file"), F.desc("kind"), "string_no", "seq") == [("open", 1, 1, 1), ("open", 1, 2, 4), ("land", 1, 1, 1), ("land", 1, 2, 2), ("land", 2, 1, 5), ("land", 2, 2, 6)]


def test_gr3_written_and_read_without_strings(spark):
    node, elem = square(spark, [(0, 0), (10, 0), (10, 10), (0, 10)])
    none = spark.createDataFrame([], "kind string, string_no int, seq long, node_id long")
    got = lines.read_gr3(lines.write_gr3(node, elem, none, "m"))
    assert [g.count() for g in got] == [4, 4, 0]


def test_cruise_drops_rows_up_to_a_bad_one(spark):
    body = "2024-01-01,10:00,7.0,1,30\n2024-01-01,10:01,7.0,2,none\n2024-01-01,10:02,7.0,3,31\n2024-01-01,10:03,7.0,2,32\n2024-01-01,11:00,8.0,1,5\n"
    got = rows(lines.read_cruise(text(spark, body)), "station", "depth")
    assert [(r[1], r[3], r[4]) for r in got] == [("7", 2.0, 32.0), ("7", 3.0, 31.0), ("8", 1.0, 5.0)]
    assert got[0][2] == got[1][2] == 1_704_103_320_000_000


def test_links_have_each_key_once(spark):
    head = "subloc,station_id,variable,selector\n"
    body = '# links\n\n' + head + 'top,ANH,elev,"a, ""b"" # c" # a comment\n,ANH,elev,\n'
    assert rows(lines.read_obs_links(text(spark, body)), F.col("subloc").desc()) == [("f", "anh", "top", "elev", None, 'a, "b" # c', None), ("f", "anh", None, "elev", None, None, None)]
    for bad in (head + "top,ANH,elev,x\ntop,anh,elev,y\n", "subloc,station_id\ntop,a\n"):
        with pytest.raises(PySparkException):
            lines.read_obs_links(text(spark, bad)).collect()
    assert lines.read_station_sublocs(text(spark, "")).count() == 0
    assert rows(lines.read_station_sublocs(text(spark, "station_id,z,subloc\nA,1.5,top\nA,x,low\n")), "subloc") == [("f", "A", "low", None), ("f", "A", "top", 1.5)]


def test_flux_times_are_made_anew(spark):
    got = rows(lines.read_flux(text(spark, "0.0104 1 2\n0.0208 3 nan\n0.0999 5 6\n"), ["A", "b"], 0), "row_no", "name")
    assert [r[2] for r in got][::2] == [0, 899_000_000, 1_798_000_000]
    assert [r[4] for r in got] == [1.0, 2.0, 3.0, None, 5.0, 6.0]
    with pytest.raises(ValueError):
        lines.read_flux(text(spark, ""), ["A", "a"], 0)


def test_source_sink_without_sinks(spark):
    got = rows(lines.read_source_sink(text(spark, "2 ! total # of elems with sources\n5 ! delta_src_1\n9 ! x\n")), "elem")
    assert got == [("f", "source", 5, "delta_src_1", "delta"), ("f", "source", 9, "x", "unknown")]


def test_empty_files_have_no_rows(spark):
    for read in (lines.read_vgrid, lines.read_cruise, lines.read_source_sink, lines.read_station_db):
        assert read(text(spark, "")).count() == 0
    assert [g.count() for g in lines.read_gr3(text(spark, ""))] == [0, 0, 0]


def test_quadrature_is_exact_for_areas_and_linear_depths(spark):
    node, elem = square(spark, [(0, 0), (9, 1), (12, 9), (1, 7)])
    node = node.withColumn("depth", F.col("x") * 2 + F.col("y"))
    points = refine.quadrature_points(spark, elem, node).withColumn("dem", F.col("x") * 2 + F.col("y"))
    area = mesh.elem_geometry(elem, node).first()["area"]
    assert points.agg(F.sum("w")).first()[0] == pytest.approx(area)
    assert points.agg(F.max(F.abs(F.col("z") - F.col("dem")))).first()[0] < 1e-9
    assert refine.dem_misfit(points).first()["misfit"] == pytest.approx(0, abs=1e-12)


def test_concave_quad_is_cut_inside(spark):
    node, elem = square(spark, [(0, 0), (10, 0), (2, 2), (0, 10)])  # the third corner is bent in
    got = rows(refine.split_quads(elem, node, 0.0), "half", "pos")
    assert {r[1] for r in got} == {0}
    assert [r[4] for r in got] == [0, 1, 2, 0, 2, 3]


def test_levels_beyond_a_cast_go_on_straight(spark):
    cast = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0), (2, 3.0, 7.0)], "k int, z double, value double")
    at = spark.createDataFrame([(1, -1.0), (1, 1.0), (1, 4.0), (2, 9.0)], "k int, z double")
    assert [r[2] for r in rows(casts.cast_to_levels(cast, at, ["k"]), "k", "z")] == [-1.0, 3.0, 9.0, 7.0]


def test_daily_blocks_take_the_next_row(spark):
    own = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 2.0)], "k string, t long, value double")
    got = rows(casts.daily_blocks(own, ["k"], 240, 10), "hour")
    assert [r[4] for r in got][:3] == [1.0, None, None] and len(got) == 24


def test_unknown_colours_are_errors(spark):
    pixels = spark.createDataFrame([(1, 2, 3)], "r long, g long, b long")
    classes = spark.createDataFrame([(9, 9, 9, 1)], "r long, g long, b long, class int")
    with pytest.raises(PySparkException):
        casts.color_to_class(pixels, classes).collect()


def test_patches_tell_missing_nodes(spark):
    node = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "node_id long, depth double")
    region = spark.createDataFrame([(1, "a"), (2, "b")], "node_id long, region string")
    given = spark.createDataFrame([(9, 1.0)], "node_id long, value double")
    assert rows(casts.patch_init(node, region, {"a": F.lit(1), "b": given}, F.col("depth")), "node_id") == [(1, 1.0, False), (2, None, True), (3, 7.0, False)]


def test_seconds_of_texts(spark):
    df = spark.createDataFrame([("2 days",), ("1.5d",), ("90 s",), ("7sec",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(columns.seconds(F.col("v"))).collect()] == [172800.0, 129600.0, 90.0, 7.0, None, None]
