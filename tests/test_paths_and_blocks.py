"""Paths, floods, smoothing in blocks, level counts, piled-up levels and touching boundaries against plain walks."""

import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewater import spool
from tidewater.operators import graph, mesh, outlines, paths, refine, series, spatial, tables, vertical
from tidewater.operators.blocks import blocks

NODE = "node_id long, x double, y double, depth double"
WIDE, HIGH = 9, 7


@pytest.fixture(scope="module")
def grid(spark):
    """Quads of 10 by 10 with uneven depths: elements, nodes, edges, neighbours."""
    r = random.Random(4)
    nodes = [(i + WIDE * j, 10.0 * i, 10.0 * j, float(r.randrange(0, 90)) / 10) for j in range(HIGH) for i in range(WIDE)]
    quads = [(i + WIDE * j, p, n) for j in range(HIGH - 1) for i in range(WIDE - 1) for p, n in enumerate((i + WIDE * j, i + 1 + WIDE * j, i + 1 + WIDE * (j + 1), i + WIDE * (j + 1)))]
    elem, node = spark.createDataFrame(quads, "elem_id long, pos int, node_id long"), spark.createDataFrame(nodes, NODE)
    edges = mesh.build_edges(elem)
    return elem, node, edges, mesh.neighbors(edges)


def near_of(nbrs):
    out = defaultdict(set)
    for r in nbrs.collect():
        out[r["node_id"]].add(r["nbr"])
    return out


# --- paths -----------------------------------------------------------------------------------------------------------


def dijkstra(at, near, start):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        x, n = heapq.heappop(heap)
        for m in near[n]:
            y = x + float(np.sqrt(sum((a - b) ** 2 for a, b in zip(at[n], at[m]))))
            if x <= best[n] and y < best.get(m, np.inf):
                best[m] = y
                heapq.heappush(heap, (y, m))
    return best


@pytest.mark.parametrize("size, shore", [(1000, False), (7, False), (1, False), (7, True)])
def test_paths_are_least(spark, grid, size, shore):
    _, node, edges, _ = grid
    lone = spark.createDataFrame([(900, 500.0, 500.0, 0.0)], NODE)
    node = node.unionByName(lone)
    at = {r["node_id"]: (r["x"], r["y"], r["depth"]) for r in node.collect()}
    near = near_of(mesh.neighbors(edges.where("etype = 1") if shore else edges))
    pairs = [(0, 0, 62), (1, 5, 5), (2, 62, 8), (3, 0, 900), (4, 31, 31), (5, 27, 35)]
    got = defaultdict(list)
    for r in paths.shortest_paths(spark.createDataFrame(pairs, "pair long, start long, stop long"), edges, node, shore, size).orderBy("pair", "seq").collect():
        got[r["pair"]].append(r)
    for pair, start, stop in pairs:
        best = dijkstra(at, near, start)
        if stop not in best:
            assert pair not in got
            continue
        way = [r["node_id"] for r in got[pair]]
        assert way[0] == start and way[-1] == stop and [r["seq"] for r in got[pair]] == list(range(len(way)))
        assert all(b in near[a] for a, b in zip(way, way[1:]))
        assert [r["length"] for r in got[pair]] == pytest.approx([best[n] for n in way], abs=1e-9)


def test_lengths_of_all_nodes(spark, grid):
    _, node, edges, nbrs = grid
    at, near = {r["node_id"]: (r["x"], r["y"], r["depth"]) for r in node.collect()}, near_of(nbrs)
    seeds = spark.createDataFrame([(3, 3), (4, 40)], "seed long, node_id long")
    got = {(r["seed"], r["node_id"]): r["length"] for r in paths.shortest_lengths(seeds, edges, node, size=9).collect()}
    want = {(s, n): x for s, i in ((3, 3), (4, 40)) for n, x in dijkstra(at, near, i).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_rounds_write_labels_of_gates_only(spark, grid, monkeypatch):
    _, node, edges, nbrs = grid
    of = blocks(node, 32)
    block, near = {r["node_id"]: r["block"] for r in of.collect()}, near_of(nbrs)
    gates = {a for a in near for b in near[a] if block[a] != block[b]}
    assert 0 < len(gates) < WIDE * HIGH / 2
    written = []

    def noted(df):
        out = spool.spool(df)
        if {"pair", "node_id", "length"} <= set(out.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(paths, "spool", noted)
    seeds = spark.createDataFrame([(0, 0), (1, 30)], "pair long, node_id long")
    assert paths.least_labels(seeds, paths.edge_steps(edges, node), of).count() == 2 * WIDE * HIGH
    assert max(written) <= 2 * (2 * len(gates) + 1)


def test_coinciding_nodes_do_not_go_in_circles(spark):
    node = spark.createDataFrame([(i, 0.0 if i < 4 else 1.0, 0.0, 0.0) for i in range(6)], NODE)
    edges = spark.createDataFrame([(a, b, 0) for a, b in ((0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (4, 5))], "a long, b long, etype int")
    got = paths.shortest_paths(spark.createDataFrame([(0, 0, 5)], "pair long, start long, stop long"), edges, node, size=2).orderBy("seq").collect()
    assert [(r["node_id"], r["length"]) for r in got] == [(0, 0.0), (3, 0.0), (4, 1.0), (5, 1.0)]


# --- smoothing -------------------------------------------------------------------------------------------------------


def test_blocks_hold_every_node_once(spark, grid):
    got = [tuple(r) for r in blocks(grid[1], 10).collect()]
    assert sorted(n for n, _ in got) == list(range(WIDE * HIGH)) and len({b for _, b in got}) > 3
    assert len({b for _, b in [tuple(r) for r in blocks(grid[1].select("node_id"), 10).collect()]}) > 3
    assert blocks(grid[1].where("false")).count() == 0


@pytest.mark.parametrize("size, rings, rounds", [(1000, 30, 12), (10, 3, 12), (5, 1, 4), (10, 5, 13), (10, 3, 0)])
def test_smoothing_in_blocks_is_the_same_round_by_round(spark, grid, size, rings, rounds):
    _, node, _, nbrs = grid
    value = node.select("node_id", F.col("depth").alias("value")).unionByName(spark.createDataFrame([(99, 5.0)], "node_id long, value double"))
    vel = spark.createDataFrame([(3, 0.5), (20, -1.0)], "node_id long, value double")
    near, v = near_of(nbrs), {r["node_id"]: r["value"] for r in value.collect()}
    for _ in range(rounds):
        v = {n: x + (0.3 * (np.mean([v[m] for m in near[n]]) - x) if near[n] else 0) + {3: 0.5, 20: -1.0}.get(n, 0) for n, x in v.items()}
    at = node.unionByName(spark.createDataFrame([(99, 1e3, 1e3, 5.0)], NODE))
    got = {r["node_id"]: r["value"] for r in graph.laplace_smooth(value, nbrs, 0.3, 1.0, rounds, vel, at, size, rings).collect()}
    assert got.keys() == v.keys() and all(got[n] == pytest.approx(v[n], abs=1e-9) for n in v)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_few_rounds_lay_out_no_blocks(spark, grid, monkeypatch, rounds):
    _, node, _, nbrs = grid
    value = node.select("node_id", F.col("depth").alias("value")).unionByName(spark.createDataFrame([(99, 5.0), (98, None)], "node_id long, value double"))
    near, v = near_of(nbrs), {r["node_id"]: r["value"] for r in value.collect()}
    for _ in range(rounds):
        v = {n: x + 0.3 * (np.mean([v[m] for m in near[n]]) - x) if near[n] else x for n, x in v.items()}
    got = {r["node_id"]: r["value"] for r in graph.laplace_rounds(value, nbrs.unionByName(nbrs), 0.3, rounds).collect()}
    assert got.keys() == v.keys() and got.pop(98) is None and all(got[n] == pytest.approx(v[n], abs=1e-9) for n in got)
    monkeypatch.setattr(refine, "in_blocks", None)
    monkeypatch.setattr(graph, "blocks", None)
    levels = spark.createDataFrame([(n, k, float(k * (n + 2))) for n in range(9) for k in range(3)], "node_id long, k int, z double")
    assert refine.bottom_thickness(levels, nbrs, 1.0).count() == 9


@pytest.mark.parametrize("size, rings", [(1000, 30), (10, 2)])
def test_interfaces_in_blocks(spark, grid, size, rings):
    _, node, _, nbrs = grid
    rows = [(n, k, -float(n % 5) * k - k) for n in range(WIDE * HIGH) if n != 11 for k in range(2 + n % 4)]
    level = spark.createDataFrame(rows, "node_id long, k int, h double")
    bed = {r["node_id"]: -r["depth"] for r in node.collect()}
    near, h = near_of(nbrs), {(n, k): x for n, k, x in rows}
    for _ in range(5):
        h = {(n, k): x + 0.1 * (k + 1) * (np.mean([h.get((m, k), bed[m]) for m in near[n]]) - x) for (n, k), x in h.items()}
    done = graph.interface_smooth(level, nbrs, (F.col("k") + 1) * 0.1, node.select("node_id", (-F.col("depth")).alias("depth")), 5, node, size, rings)
    got = {(r["node_id"], r["k"]): r["h"] for r in done.collect()}
    assert got.keys() == h.keys() and all(got[x] == pytest.approx(h[x], abs=1e-9) for x in h)


@pytest.mark.parametrize("size, rings", [(1000, 30), (10, 2)])
def test_layers_in_blocks(spark, grid, size, rings):
    _, node, _, nbrs = grid
    layer = {n: n % 3 for n in range(WIDE * HIGH)}
    near, base = near_of(nbrs), {r["node_id"]: r["depth"] for r in node.collect()}
    v = dict(base)
    for _ in range(7):
        v = {n: x + 0.4 * (np.mean([base[m] if layer[m] < layer[n] else v[m] for m in near[n]]) - x) for n, x in v.items()}
    layers = spark.createDataFrame(list(layer.items()), "node_id long, nlayer int")
    got = {r["node_id"]: r["value"] for r in refine.laplace_layered(node.select("node_id", F.col("depth").alias("value")), layers, nbrs, 0.4, 7, node, size, rings).collect()}
    assert all(got[n] == pytest.approx(v[n], abs=1e-9) for n in v)


# --- level counts ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("up, down, jump, like, sweeps", [(0.3, 0.8, 1, 3.0, 6), (0.7, 0.7, 1, 0.75, 6), (0.2, 0.2, 1, 99.0, 3), (0.1, 0.9, 0, 2.0, 6), (0.3, 0.3, 2, 5.0, 1)])
def test_hysteresis_is_one_walk_through_all_nodes(spark, grid, up, down, jump, like, sweeps):
    _, node, _, nbrs = grid
    r = random.Random(8)
    want = {n: 2 + r.randrange(0, 40) / 10 for n in range(WIDE * HIGH)}
    deep, near = {x["node_id"]: x["depth"] for x in node.collect()}, near_of(nbrs)
    now = {n: int(np.rint(w)) for n, w in want.items()}
    for _ in range(sweeps):
        before = dict(now)
        for n in sorted(want, key=lambda n: (n % 2, n)):
            off = want[n] - now[n]
            to = now[n] + (off > up) - (off < -down)
            if all(abs(to - now[m]) <= jump or abs(deep[n] - deep[m]) > like for m in near[n]):
                now[n] = to
        if now == before:
            break
    wanted = spark.createDataFrame(list(want.items()), "node_id long, wanted double")
    got = refine.hysteretic_levels(wanted, node.select("node_id", "depth"), nbrs, up, down, jump, like, sweeps)
    assert {x["node_id"]: x["n"] for x in got.collect()} == now


# --- piled-up levels -------------------------------------------------------------------------------------------------


def straightened(s, depth, least):
    """One column, level by level."""
    s = [v for i, v in enumerate(s) if i == 0 or abs(v - s[i - 1]) > 1e-10]
    if len(s) <= 2:
        return [0.0, 1.0]
    if abs(s[-1] - 1) <= 1e-10:
        s[-1] = 1.0
    for side in (1, -1):
        s = s[::side]
        while depth > 0 and least > 0 and len(s) >= 3 and depth * abs(s[1] - s[0]) + 1e-15 < least:
            goal = s[0] + side * least / max(depth, 1e-12)
            if side * (s[2] - goal) > 1e-10:
                s[1] = goal
                break
            del s[1]
        s = s[::side]
    flat = [0.0, *[float(np.rint(v * 1e6) / 1e6) for v in s[1:-1]], 1.0]
    kept = [v for i, v in enumerate(flat) if i in (0, len(flat) - 1) or flat[i - 1] < v < 1]
    return kept if len(kept) < len(flat) else s


def test_columns_are_straightened(spark):
    r = random.Random(6)
    columns = {0: [0.0, 1.0], 1: [0.0, 0.0, 1.0], 2: [0.5], 3: [0.0, 0.5, 0.5 + 2e-7, 1.0], 4: [0.0, 1e-9, 0.3, 1 - 1e-9, 1.0], 5: [0.0, 0.2, 0.9999999, 1.0]}
    for i in range(6, 300):
        columns[i] = [0.0, *sorted(r.choice([0.01, 0.02, 0.1, 0.5, 0.9, 0.98, 0.99, r.random()]) for _ in range(r.randrange(0, 9))), r.choice([1.0, 1 - 1e-11])]
    about = {i: (r.choice([-1.0, 0.0, 0.4, 5.0, 50.0]), r.choice([0.0, 0.5, 2.0])) for i in columns}
    sigma = spark.createDataFrame([(i, k, v) for i, c in columns.items() for k, v in enumerate(c)], "node_id long, k int, sigma double")
    depth = spark.createDataFrame([(i, *a) for i, a in about.items()], "node_id long, depth double, least double")
    got = {x["node_id"]: x for x in vertical.sigma_pileup_fix(sigma, depth, F.col("least")).collect()}
    for i, c in columns.items():
        want = straightened(list(c), *about[i])
        assert got[i]["levels"] == pytest.approx(want, abs=1e-12), (c, about[i])
        assert (got[i]["n_before"], got[i]["n_after"]) == (len(c), len(want))
        written = [f"{v:.6f}" for v in want]
        assert len(set(written)) == len(written)


# --- floods ----------------------------------------------------------------------------------------------------------


def test_flood_against_a_walk(spark, grid):
    elem, node, edges, _ = grid
    h0 = {n: 3.0 + n % 3 for n in range(WIDE * HIGH)}
    surface = spark.createDataFrame(list(h0.items()), "node_id long, h0 double")
    deep = {r["node_id"]: r["depth"] for r in node.collect()}
    listed = [tuple(r) for r in edges.select("a", "b", "el", "er").collect()]
    for wet in (0.0, 2.5):
        sides = defaultdict(list)
        for a, b, el, er in listed:
            for e in (el, er):
                sides[e].append((deep[a] + deep[b]) / 2 > (h0[a] + h0[b]) / 2 - wet)
        able = {e for e, x in sides.items() if e >= 0 and all(x)}
        if not able:
            continue
        seen = [min(able)]
        for e in seen:
            seen += {o for a, b, *pair in listed for o in pair if e in pair and o in able} - set(seen)
        elems, outline = refine.flood_fill(edges, node, spark.createDataFrame([(min(able),)], "elem_id long"), surface, 1.0, wet)
        assert sorted((r["elem_id"], r["stage"]) for r in elems.collect()) == sorted((e, 1) for e in seen)
        want = {(a, b, "deep" if min(deep[a] - h0[a], deep[b] - h0[b]) >= 1 else "shore") for a, b, el, er in listed if (el in seen) != (er in seen)}
        for stage in (1, 2):
            assert {tuple(r) for r in outline.where(F.col("stage") == stage).select("a", "b", "label").collect()} == want
        dry = next(e for e in sides if e >= 0 and e not in able)
        with pytest.raises(PySparkException):
            refine.flood_fill(edges, node, spark.createDataFrame([(dry,)], "elem_id long"), surface, 1.0, wet)[0].collect()


# --- boundaries ------------------------------------------------------------------------------------------------------


def walked(strings):
    own = defaultdict(list)
    for r in strings.orderBy("kind", "string_no", "seq").collect():
        own[(r["kind"], r["string_no"])].append(r["node_id"])
    return dict(own)


@pytest.fixture(scope="module")
def bowtie(spark):
    """Two quads that meet in node 4; the second is given clockwise."""
    at = {0: (0, 0), 1: (10, 0), 3: (0, 10), 4: (10, 10), 5: (20, 10), 7: (10, 20), 8: (20, 20)}
    node = spark.createDataFrame([(n, float(x), float(y), 1.0) for n, (x, y) in at.items()], NODE)
    elem = spark.createDataFrame([(e, p, n) for e, r in enumerate(((0, 1, 4, 3), (4, 7, 8, 5))) for p, n in enumerate(r)], "elem_id long, pos int, node_id long")
    return elem, node


SEGMENT = "ord int, x0 double, y0 double, x1 double, y1 double"


def test_quads_that_meet_in_a_node_keep_their_boundary(spark, bowtie):
    elem, node = bowtie
    got = walked(outlines.boundary_strings(elem, node, spark.createDataFrame([], SEGMENT), 10.0))
    assert got == {("island", 0): [0, 1, 4, 3, 0], ("island", 1): [4, 5, 8, 7, 4]}
    open_ = spark.createDataFrame([(0, 10.0, 10.0, 20.0, 20.0), (1, 0.0, 0.0, 10.0, 10.0)], SEGMENT)
    got = walked(outlines.boundary_strings(elem, node, open_, 10.0))
    assert got == {("open", 0): [4, 5, 8], ("land", 0): [8, 7, 4], ("open", 1): [0, 1, 4], ("land", 1): [4, 3, 0]}
    apart = spark.createDataFrame([(0, 0.0, 0.0, 20.0, 20.0)], SEGMENT)
    with pytest.raises(PySparkException):
        outlines.boundary_strings(elem, node, apart, 10.0).collect()


def test_every_boundary_edge_is_in_one_string(spark):
    r = random.Random(12)
    side = 14
    node = spark.createDataFrame([(i + side * j, float(i), float(j), 0.0) for j in range(side) for i in range(side)], NODE)
    cells = [i + side * j for j in range(side - 1) for i in range(side - 1) if r.random() < 0.6]
    turned = lambda ring: ring[::-1] if r.random() < 0.5 else ring
    elem = spark.createDataFrame([(c, p, n) for c in cells for p, n in enumerate(turned([c, c + 1, c + side + 1, c + side]))], "elem_id long, pos int, node_id long")
    got = walked(outlines.boundary_strings(elem, node, spark.createDataFrame([], SEGMENT), 1.0))
    along = Counter(tuple(sorted(e)) for s in got.values() for e in zip(s, s[1:]))
    want = {(r["a"], r["b"]) for r in mesh.build_edges(elem).where("etype = 1").collect()}
    assert set(along) == want and set(along.values()) == {1}
    assert all(s[0] == s[-1] for s in got.values())


# --- cells of several sizes ------------------------------------------------------------------------------------------


def test_a_large_shape_stands_in_four_cells_at_most(spark):
    shapes = spark.createDataFrame([(0, -1e6, 1e6, -1e6, 1e6), (1, 0.0, 0.0, 0.0, 0.0), (2, 0.3, 7.9, 2.0, 2.5), (3, 5.0, 13.0, 5.0, 6.0)], "id int, xmin double, xmax double, ymin double, ymax double")
    assert {r["id"]: r["count"] for r in spatial.on_levels(shapes, 0.01).groupBy("id").count().collect()}.keys() == {0, 1, 2, 3}
    assert max(r["count"] for r in spatial.on_levels(shapes, 0.01).groupBy("id").count().collect()) <= 4


@pytest.mark.parametrize("cell", [0.5, 10.0, 1000.0])
def test_shapes_of_all_sizes_meet_their_points_and_lines(spark, grid, cell):
    elem, node, _, _ = grid
    r = random.Random(9)
    rings = [[(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0)], [(3.1, 3.2), (40.3, 5.1), (33.3, 44.4), (7.7, 29.9)], [(20.05, 20.05), (20.15, 20.05), (20.1, 20.2)]]
    polygons = spark.createDataFrame([(i, ring) for i, ring in enumerate(rings)], "poly_id int, ring array<struct<x:double,y:double>>")
    at = [(i, r.uniform(-20, 90), r.uniform(-20, 70)) for i in range(200)] + [(200, 20.1, 20.1)]
    points = spark.createDataFrame(at, "point_id long, x double, y double")

    def inside(x, y, ring):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    got = {(p["point_id"], p["poly_id"]) for p in spatial.points_in_polygon(points, polygons, cell).collect()}
    assert got == {(i, j) for i, x, y in at for j, ring in enumerate(rings) if inside(x, y, ring)}
    found = {p["point_id"]: p["elem_id"] for p in spatial.find_elem(points, elem, node, cell).collect()}
    assert found == {i: int(x // 10) + WIDE * int(y // 10) for i, x, y in at if 0 <= x < 10 * (WIDE - 1) and 0 <= y < 10 * (HIGH - 1)}
    segs = [(i, 0, *(r.uniform(-10, 85) for _ in range(4))) for i in range(30)] + [(30, 0, 35.0, -5.0, 35.0, 70.0), (31, 0, -5.0, 33.0, 90.0, 33.0), (32, 0, 44.0, 44.0, 44.5, 44.5)]
    lines = spark.createDataFrame(segs, "line_id int, seg int, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for i, _, x0, y0, x1, y1 in segs:
        for e in range(WIDE * (HIGH - 1)):
            x, y = 10.0 * (e % WIDE), 10.0 * (e // WIDE)
            sides = [np.sign((x1 - x0) * (b - y0) - (y1 - y0) * (a - x0)) for a in (x, x + 10) for b in (y, y + 10)]
            if e % WIDE < WIDE - 1 and min(sides) < 0 < max(sides) and x <= max(x0, x1) and x + 10 >= min(x0, x1) and y <= max(y0, y1) and y + 10 >= min(y0, y1):
                want.add((i, e))
    assert {(h["line_id"], h["elem_id"]) for h in spatial.line_elements(lines, elem, node, cell).collect()} == want


@pytest.mark.parametrize("cell, k", [(0.01, 3), (5.0, 1), (5.0, 7), (1e6, 2), (5.0, 500)])
def test_nearest_sites_of_clusters_and_lone_points(spark, cell, k):
    r = random.Random(10)
    sites = [(i, r.gauss(0, 0.05), r.gauss(0, 0.05)) for i in range(60)] + [(100 + i, r.uniform(-300, 300), r.uniform(-300, 300)) for i in range(60)] + [(300, 7.0, 7.0), (301, 7.0, 7.0)]
    points = [(i, r.uniform(-400, 400), r.uniform(-400, 400)) for i in range(60)] + [(100, 0.0, 0.0), (101, 7.0, 7.0), (102, 5000.0, -9000.0)]
    got = defaultdict(list)
    df = spatial.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(sites, "site_id long, x double, y double"), k, cell)
    for n in df.orderBy("point_id", "rank").collect():
        got[n["point_id"]].append(n["site_id"])
    for i, x, y in points:
        assert got[i] == [s for _, s in sorted(((x - a) ** 2 + (y - b) ** 2, s) for s, a, b in sites)[:k]]
    none = spark.createDataFrame([], "site_id long, x double, y double")
    assert spatial.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), none, k, cell).count() == 0


def test_places_between_tiles(spark):
    r = random.Random(13)
    val = {(1, i, j): None if (i, j) == (5, 5) else r.random() for i in range(11) for j in range(9) if (i, j) != (2, 2)} | {(2, i, j): r.random() for i in range(4) for j in range(4)}
    pixels = spark.createDataFrame([(*k, v) for k, v in val.items()], "raster_id int, row long, col long, val double")
    meta = {1: (0, 1.0, 20.0, 0.5, -1.5, 11, 9), 2: (1, 0.0, 0.0, 5.0, 6.0, 4, 4)}
    metas = spark.createDataFrame([(i, *m) for i, m in meta.items()], "raster_id int, prio int, x0 double, y0 double, dx double, dy double, rows long, cols long")
    points = [(i, r.uniform(-1, 21), r.uniform(-1, 25)) for i in range(300)] + [(300 + 5 * i + j, 1.25 + 0.5 * j, 19.25 - 1.5 * i) for i in range(5) for j in range(5)]
    want = {}
    for i, x, y in points:
        for raster, (_, x0, y0, dx, dy, *_) in meta.items():
            fx, fy = (x - x0) / dx - 0.5, (y - y0) / dy - 0.5
            c, q = int(np.floor(fx)), int(np.floor(fy))
            four = [(val.get((raster, q + b, c + a)), (fx - c if a else 1 - fx + c) * (fy - q if b else 1 - fy + q)) for a in (0, 1) for b in (0, 1)]
            if i not in want and all(v is not None for v, _ in four):
                want[i] = sum(v * w for v, w in four)
    for size in (4, 64):
        got = {p["point_id"]: p["value"] for p in spatial.dem_sample(spark.createDataFrame(points, "point_id long, x double, y double"), spatial.raster_tiles(pixels, size), metas, 2.0, size).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


# --- series in spans and chunks --------------------------------------------------------------------------------------


def test_medians_do_not_depend_on_spans_and_chunks(spark):
    r = random.Random(15)
    rows = [(k, t, r.choice([1.0, 1.1, 1.2, 9.0, None, 500.0]) if r.random() < 0.9 else float("nan")) for k in ("a", "b") for t in sorted(r.sample(range(2000), 150))]
    rows = [(k, t, None if v != v else v) for k, t, v in rows]
    df = spark.createDataFrame(rows, "k string, t long, value double")

    def median(values):
        v = sorted(x for x in values if x is not None)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None

    want = {}
    for k in ("a", "b"):
        own = [(t, v if v is not None and 0 <= v <= 100 else None) for key, t, v in rows if key == k]
        v = [x for _, x in own]
        dist = [None if x is None else abs(x - median(v[max(0, i - 3) : i + 4])) for i, x in enumerate(v)]
        for i, (t, x) in enumerate(own):
            s = median(dist[max(0, i - 3) : i + 4])
            want[(k, t)] = None if s and dist[i] is not None and dist[i] > 2 * s else x
    for span, chunk in ((10**9, 4096), (50, 6), (7, 11)):
        got = {(x["k"], x["t"]): x["value"] for x in vertical.rolling_outliers(df, ["k"], 0.0, 100.0, 2.0, 3, span, chunk).collect()}
        assert got == want


def test_rows_before_are_found_over_empty_spans(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 3, 100, 101, 4000)] + [("b", 5)], "k string, t long")
    got = {(x["k"], x["t"]): x["p"] and x["p"]["v"] for x in series.row_before(df, ["k"], F.col("t"), "p", span=10).collect()}
    assert got == {("a", 0): None, ("a", 1): 0, ("a", 3): 1, ("a", 100): 3, ("a", 101): 100, ("a", 4000): 101, ("b", 5): None}


def test_labels_take_rows_at_their_own_time(spark):
    day = 86_400_000_000
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 40 * day, 2.0), ("a", 40 * day + 1, 3.0), ("b", 5, None)], "k string, t long, value double")
    got = {(x["k"], x["t"]): x["value"] for x in series.resample_ffill(df, ["k"], 20 * day).collect()}
    assert got == {("a", 0): 1.0, ("a", 20 * day): 1.0, ("a", 40 * day): 2.0, ("b", 0): None}
    asks = spark.createDataFrame([("a", 0, "x"), ("a", 10, "y"), ("a", 10, "z"), (None, 3, "n"), ("c", 1, "w")], "k string, t long, extra string")
    right = spark.createDataFrame([("a", 0, 1.0), ("a", 20, 3.0)], "k string, t long, value double")
    told = {x["extra"]: (x["r_t"], x["r_value"]) for x in series.as_of(asks, right, ["k"], "nearest").collect()}
    assert told == {"x": (0, 1.0), "y": (0, 1.0), "z": (0, 1.0), "w": (None, None)}
    assert {x["extra"]: x["r_value"] for x in series.bracket_interp(asks, right, ["k"]).collect()} == {"x": 1.0, "y": 2.0, "z": 2.0, "w": None}


def test_histories_are_laid_out_at_all_times(spark):
    first = spark.createDataFrame([("a", "x", 0, 1.0), ("a", "x", 50, 2.0), ("b", "y", 7, None)], "site string, variable string, t long, value double")
    second = spark.createDataFrame([("c", "x", 7, 3.0), ("c", "x", 8, 4.0)], "site string, variable string, t long, value double")
    sites = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "site string")
    got = {(r["site"], r["variable"], r["t"]): r["value"] for r in tables.concat_sources(first, second, sites).collect()}
    want = {(s, v, t): tables.AMBIENT for s in "abcd" for v in "xy" for t in (0, 7, 50)} | {("a", "x", 0): 1.0, ("a", "x", 50): 2.0, ("c", "x", 7): 3.0}
    assert got == want
    names = spark.createDataFrame([("a",), ("e",)], "site string")
    told = tables.on_all_times(first.drop("variable"), names, first, span=10)
    assert sorted(map(tuple, told.collect()), key=repr) == sorted([("a", 0, 1.0), ("a", 50, 2.0), ("a", 7, None), ("e", 0, None), ("e", 7, None), ("e", 50, None)], key=repr)
    assert tables.concat_sources(first.where("false"), second, sites).count() == 0


def test_a_run_can_drop_all_it_has_spooled(spark, tmp_path):
    kept = spool.spool(spark.range(3))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert folder.startswith(spool.run_dir(spark)) and spool.spool(kept).count() == 3
    spool.drop_spool(kept)
    with pytest.raises(PySparkException):
        spark.read.parquet(folder).count()
    other = spool.spool(spark.range(2)).inputFiles()[0]
    spool.drop_run(spark)
    with pytest.raises(PySparkException):
        spark.read.parquet(other).count()
