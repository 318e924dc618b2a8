"""Cases of the findings of round 3: repeated ids, ties left to rounding, corners on cell borders, dense grids."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from trekframe.operators import joins as J
from trekframe.operators import playback as PB
from trekframe.operators import routes as R
from trekframe.operators import story as ST
from trekframe.operators import zones as Z
from trekframe.plans import registry


def both(spark, name, folder, **tables):
    """Rows of the query and of its SQL over small tables."""
    con = duckdb.connect()
    for t, rows in tables.items():
        path = str(folder / f"{t}.parquet")
        spark.createDataFrame(rows[1], rows[0]).coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    got, want = registry.queries()[name](spark, str(folder)).toArrow(), con.execute(registry.oracle_sql()[name]).to_arrow_table()
    rows = lambda t: sorted(zip(*(t[c].to_pylist() for c in sorted(want.column_names))))
    return rows(got), rows(want)


LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_shipdate timestamp"


def test_moves_of_one_id_do_not_cut_each_other(spark, tmp_path):
    day = lambda n: dt.datetime(1997, 1, n)
    line = [(1, 1, 5, 1, 48.0, 0.0, day(1)), (1, 6, 5, 1, 24.0, 0.0, day(2)), (1, 6, 5, 1, 24.0, 0.0, day(2)), (2, 5, 5, 1, 6.0, 0.0, day(1))]
    got, want = both(spark, "a10_around_stays", tmp_path, lineitem=(LINE, line))
    assert got == want and len(got) == 1


def test_corner_on_a_cell_border(spark):
    """A vertical edge, and a corner with an edge either way, on half degrees: where cells of the decimals would end."""
    square = [(1, 0, i, y, x) for i, (y, x) in enumerate([(0.2, 0.5), (0.2, 2.5), (2.2, 2.5), (2.2, 0.5)])]
    spike = [(2, 0, i, y, x) for i, (y, x) in enumerate([(10.0, 10.0), (10.5, 10.5), (11.0, 11.0), (10.5, 11.5), (10.0, 11.0), (9.5, 10.5)])]
    edges = Z.ring_edges(spark.createDataFrame(square + spike, "zone long, ring long, seq long, lat double, lng double"))
    spots = [(i, y0 + 0.1 * i + 0.005, x0 + 0.1 * j + 0.0151) for y0, x0 in ((-0.3, 0.0), (9.2, 9.8)) for i in range(28) for j in range(30)]
    spots = [(n, y, x) for n, (_, y, x) in enumerate(spots)]
    got = {r.id: r.zone for r in Z.zone_of_point(spark.createDataFrame(spots, "id long, lat double, lng double"), Z.zone_index(edges), "id").collect()}

    def odd(y, x, ring):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (_, _, _, y1, x1), (_, _, _, y2, x2) in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    assert got == {n: 1 if odd(y, x, square) else 2 if odd(y, x, spike) else None for n, y, x in spots}


def test_turns_straight_back_are_of_one_sign(spark):
    """Headings half a turn apart, to either side by what rounding leaves."""
    rows = spark.createDataFrame([(209.870835441113, 29.870834685238), (29.870834685238, 209.870835441113), (10.0, 190.0 - 1e-9), (190.0, 10.0 + 1e-9), (350.0, 20.0), (20.0, 350.0)], "a double, b double")
    assert [round(r[0], 3) for r in rows.select(PB.turn("a", "b")).collect()] == [-180.0, -180.0, -180.0, -180.0, 30.0, -30.0]


def test_middles_of_windows_do_not_hang_on_rounding(spark):
    """The middle of an odd number of microseconds is half of one: it goes up, in a movement after however many others."""
    shifts = [0.1 * i for i in range(60)]
    e = spark.createDataFrame([(1, i, "MOVE", i, i + 1, 5.0, 5.0 * i) for i in range(60)], "trip long, id long, kind string, start_ms long, end_ms long, seconds double, story_start double")
    w = spark.createDataFrame([(1, i, i, 5.0 * i + 1, 5.0 * i + 1 + 1.000001 + s) for i, s in enumerate(shifts)], "trip long, id long, media long, shown_from double, shown_to double")
    us, want = lambda x: round(x * 1e6), []
    before = 0
    for i, s in enumerate(shifts):
        a, b = us(5.0 * i + 1), us(5.0 * i + 1 + 1.000001 + s)
        want.append((a + b + 1) // 2 + before)
        before += b - a
    assert [us(r.shown_from) for r in ST.with_holds(e, w)[1].orderBy("id").collect()] == want


def test_heading_at_a_point_is_that_of_the_whole_track(spark):
    """Places and headings from four samples round a point equal those from all samples of its route; the plan has no row for each sample."""
    spots = {1: [(0, 0), (0, 0.004), (0.003, 0.004), (0, 0.004), (0, 0.02)], 2: [(40, 1), (40.5, 1.5), (41, 1)], 3: [(5, 5), (5, 5.00002)], 4: [(5, 5), (5, 5.00001)], 5: [(5, 5), (5, 5.000004)], 6: [(1, 1), (1, 1.0004492)]}
    paths = spark.createDataFrame([(1, m, i, None, float(y), float(x)) for m, way in spots.items() for i, (y, x) in enumerate(way)], "trip long, move long, seq long, ts_ms long, lat double, lng double")
    route = R.legs(paths)
    total = {r.move: r.total for r in route.select("move", "total").distinct().collect()}
    modes = spark.createDataFrame([(1, m, ["WALK", "CAR", "AIRPLANE"][m % 3]) for m in spots], "trip long, move long, mode string")
    points = spark.createDataFrame([(1, m, k, total[m] * k / 40, min(total[m], total[m] * k / 40 + 200)) for m in spots for k in range(41)], "trip long, move long, k long, at double, lead double")
    p = PB.positions(points, route, "at").withColumnsRenamed({"lat": "h_lat", "lng": "h_lng"})
    want = PB.positions(PB.heading_at(p, PB.heading_samples(modes, route), "at"), route, "lead")
    want = {(r.move, r.k): (r.h_lat, r.h_lng, r.lat, r.lng, r.heading) for r in want.collect()}
    got = {(r.move, r.k): (r.h_lat, r.h_lng, r.l_lat, r.l_lng, r.heading) for r in PB._headed(points.join(modes, ["trip", "move"]), route, ["k"]).collect()}
    assert set(got) == set(want) and len(want) == 41 * len(spots)
    for key, (*place, heading) in want.items():
        assert got[key][:4] == pytest.approx(tuple(place), abs=1e-9) and abs((got[key][4] - heading + 180) % 360 - 180) < 1e-4, (key, got[key], want[key])


def test_places_at_one_spot_meet_a_point_once(spark):
    places = spark.createDataFrame([(f"p{i:03}", 40.0 + i % 3, 7.0, (i * 7) % 300) for i in range(300)], "place string, p_lat double, p_lng double, ord long")
    assert sorted((r.p_lat, r.ord, r.place) for r in J.first_of_spot(places).collect()) == [(40.0, 0, "p000"), (41.0, 1, "p043"), (42.0, 2, "p086")]
    points = spark.createDataFrame([(1, 40.1, 7.0), (2, 41.9, 7.1), (3, 45.0, 7.0)], "id long, lat double, lng double")
    assert sorted((r.id, r.place) for r in J.nearest_place(points, places, 60_000, "id").collect()) == [(1, "p000"), (2, "p086"), (3, None)]
