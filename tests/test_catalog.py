import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import astro, names
from orrery.functions.sky import Wcs
from orrery.operators import catalog, pixels, placement

OBJECT = "id long, kind string, source string, ra double, dec double, mag double, major_arcmin double, minor_arcmin double, position_angle_deg double, name string, common_name string, aliases array<string>, parents array<long>"


@pytest.fixture(scope="module")
def objects(spark):
    rows = [
        (1, "galaxy", "a", 10.0, 20.0, 8.0, 60.0, 30.0, 35.0, "NGC 0001", "First", ["M 1"], [2]), (2, "nebula", "b", 10.2, 20.1, None, 6.0, 3.0, None, "IC 7", "", [], [99]),
        (3, "star", "b", 200.0, -40.0, 5.0, None, None, None, "Star", "", [], []),
    ]
    return spark.createDataFrame(rows, OBJECT)


def test_catalogue_round_trip(spark, objects, tmp_path):
    path = str(tmp_path / "c")
    catalog.write(objects, path, lists=["aliases"])
    assert {r["id"] for r in catalog.by_name(spark, path, "m001").collect()} == {1}
    assert [r["key"] for r in catalog.complete(spark, path, "n", 5).collect()] == ["NGC1"]
    near = {r["id"] for r in catalog.in_cap(spark, path, 10.0, 20.0, 1.0).collect()}
    assert {1, 2} <= near and 3 not in near
    tiles, keys = (spark.read.parquet(f"{path}/{t}") for t in ("tiles", "names"))
    assert catalog.index_violations(objects, tiles, keys).count() == 0
    assert {r["rule"] for r in catalog.index_violations(objects.where("id > 1"), tiles, keys).collect()} == {"tile-without-object", "name-without-object"}
    assert tuple(catalog.audit(objects, "aliases", "aliases", "parents").first()) == (1, 1, 1)


def test_details_and_curation(spark, objects):
    records = spark.createDataFrame([(1, "r1", "x", "mag", "8", None), (1, "r1", "x", "size", "60", "arcmin"), (1, "r2", "y", "mag", "9", None)], "id long, record_id string, source string, property string, value string, unit string")
    d = catalog.details(records).first()["source_records"]
    assert [(r["record_id"], len(r["properties"])) for r in d] == [("r1", 2), ("r2", 1)]
    ids = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"])], "id string, alternate_ids array<string>")
    got = {r["record_id"]: r["id"] for r in catalog.attach(spark.createDataFrame([("a",), ("x",), ("y",), ("z",)], "record_id string"), ids).collect()}
    assert got == {"a": "a", "x": "a", "y": None, "z": None}
    overlay = spark.createDataFrame([(1, False, "New"), (3, True, None), (7, False, "Added")], "id long, remove boolean, name string")
    assert {r["id"]: r["name"] for r in catalog.curate(objects.select("id", "name"), overlay, ["name"]).collect()} == {1: "New", 2: "IC 7", 7: "Added"}
    bodies = spark.createDataFrame([("comet", "C", 1.0, 1.2, 10.0), ("asteroid", "", 2.0, 1.1, 200.0)], "kind string, name string, q_or_a double, eccentricity double, inclination_deg double")
    assert {r["rule"] for r in catalog.body_violations(bodies).collect()} == {"empty_name", "open_asteroid", "bad_angle"}


def test_curation_documents(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[[object]]\nid = "x"\nname = "N"\nmag = 3.5\n[[object]]\nid = "y"\n')
    got = {r["id"]: r["fields"] for r in catalog.read_curation(spark, str(tmp_path)).collect()}
    assert got == {"x": {"name": "N", "mag": "3.5"}, "y": {}}


def test_identifiers_sorted(spark):
    rows = spark.createDataFrame([(2, 5, 1.0, 2.0, 3.0)] * 2 + [(1, 9, 1.0, 2.0, 3.0)], "namespace int, value long, ra double, dec double, mag double")
    out = catalog.identifier_rows(rows)
    assert [(r["namespace"], r["value"]) for r in out.collect()] == [(1, 9), (2, 5)]
    o = spark.createDataFrame([(0, 1), (1, 3), (2, 2)], "o long, k int")
    assert catalog.unsorted_keys(o, ["k"], "o").first()["out_of_order"] == 1


def test_placement(objects):
    wcs = Wcs(10.0, 20.0, 500.0, 500.0, (-1e-3, 0.0, 0.0, -1e-3))
    p = {r["id"]: r for r in placement.objects_in_footprint(objects, wcs, 1000, 1000).collect()}
    assert set(p) == {1, 2} and abs(p[1]["x"] - 500) < 1e-6 and abs(p[1]["semi_major_px"] - 500) < 1 and p[2]["angle_deg"] is None
    assert abs((p[1]["angle_deg"] - (-125.0) + 180) % 360 - 180) < 0.1  # north up (down in y), east left, 35 degrees east of north


def test_bodies(spark):
    jd = 2460500.5
    rows = [("asteroid", "A", jd, 2.5, 0.1, 5.0, 80.0, 70.0, 200.0, 5.0, 0.15), ("comet", "C", jd - 30, 1.2, 1.0, 40.0, 50.0, 10.0, 0.0, 8.0, 4.0), ("comet", "H", jd + 10, 0.9, 1.3, 60.0, 150.0, 20.0, 0.0, 8.0, 4.0), ("comet", "E", jd - 50, 0.8, 0.97, 20.0, 10.0, 30.0, 0.0, 8.0, 4.0)]
    b = spark.createDataFrame(rows, "kind string, name string, epoch_jd double, q_or_a double, eccentricity double, inclination_deg double, node_deg double, arg_perihelion_deg double, mean_anomaly_deg double, h_mag double, slope double")
    placed = {r["name"]: r for r in placement.body_places(b, jd).collect()}
    assert all(0 <= r["ra"] < 360 and -90 <= r["dec"] <= 90 and 0.1 < r["distance"] < 4 and r["mag"] == r["mag"] for r in placed.values())
    c = placed["C"]
    wcs = Wcs.simple(c["ra"], c["dec"], 500.0, 500.0, 5.0)
    seen = placement.bodies_in_footprint(b, jd, wcs, 1000, 1000).collect()
    assert [r["name"] for r in seen] == ["C"] and 1 < seen[0]["motion_arcsec_h"] < 1000 and 0 <= seen[0]["direction_deg"] < 360


def test_comet_planes_meet_the_orbit_equation(spark):
    df = spark.createDataFrame([(1.1, e, d) for e in (0.0, 0.5, 0.97, 1.0, 1.2, 2.5) for d in (-40.0, 5.0, 120.0)], "q double, e double, d double")
    x, y = astro.comet_plane(F.col("q"), F.col("e"), F.col("d"))
    for r in df.withColumn("x", x).withColumn("y", y).collect():
        radius = math.hypot(r["x"], r["y"])
        assert abs(radius - (r["q"] * (1 + r["e"]) - r["e"] * r["x"])) < 1e-7  # r = p - e x, p = q (1 + e)
    h = 1e-3
    near = spark.createDataFrame([(1.1, e, 30.0 + s * h) for e in (0.5, 1.0, 1.2) for s in (-1, 1)], "q double, e double, d double").withColumn("x", x).withColumn("y", y).collect()
    for a, b in zip(near[::2], near[1::2]):
        area = ((a["x"] + b["x"]) / 2 * (b["y"] - a["y"]) - (a["y"] + b["y"]) / 2 * (b["x"] - a["x"])) / (2 * h)
        assert math.isclose(area, astro.GAUSS * math.sqrt(a["q"] * (1 + a["e"])), rel_tol=1e-5)  # equal areas


def test_orientation():
    out = placement.sky_orientation(200, 100, Wcs.simple(10.0, 20.0, 100.0, 50.0, 2.0, 90.0))
    assert out["wcs"].cd[0] < 0 and out["wcs"].cd[3] < 0 and out["width"] * out["height"] <= 4 * 20000
    w = Wcs.simple(10.0, 20.0, 100.0, 50.0, 2.0, 90.0)
    p = out["transform"] @ [30.0, 70.0, 1.0]
    assert np.allclose(out["wcs"].world(*p), w.world(30.0, 70.0), atol=1e-9)
    with pytest.raises(ValueError):
        placement.sky_orientation(5, 5, Wcs(0, 0, 0, 0, (1, 0, 0, 1), (2, (), (), (), ())))


def test_trail_alignment():
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (200, 300))
    y, x = np.mgrid[0:200, 0:300]
    a += 8 * np.exp(-((y - (60 + 0.2 * x)) ** 2) / 2)
    path = np.column_stack([np.linspace(5, 295, 30), 66 + 0.2 * np.linspace(5, 295, 30)])
    got = placement.align_trail(a, path)
    assert got and abs(abs(got["start_offset"]) - 6) < 1.5 and got["continuity"] > 0.9
    assert placement.align_trail(rng.normal(0, 1, (200, 300)), path) is None


def test_text_forms(spark):
    df = spark.createDataFrame([("sh2-012; Sh 2-12,ced 0055|X  y",)], "t string").select(names.catalog_aliases(F.col("t")).alias("a")).first()
    assert df["a"] == ["Sh2-12", "Ced 55", "X y"]
    b = spark.createDataFrame([(" 21Alp And",), (" 33    Psc",), ("       Psc",)], "t string").select(names.bright_star_names(F.col("t")).alias("n"))
    assert [r["n"] for r in b.collect()] == [["21 And", "Alp And", "Alpha And", "α And"], ["33 Psc"], []]
    fields = ["", "", "", "M", "2.0", "", "10.1", "V", "", "331.96", ""]
    v = spark.createDataFrame([(fields,)], "f array<string>").select(names.variable_detail(F.col("f")).alias("d")).first()["d"]
    assert v == "M; range=2.000-10.100V; period=331.96d"
    w = spark.range(1).select(names.double_star_detail(F.lit("AB"), F.lit("1.5"), F.lit("90"), F.lit("7.25")).alias("d"), names.hms(F.lit(187.5)).alias("h"), names.dms(F.lit(-0.5)).alias("m")).first()
    assert w["d"] == "AB; sep=1.5arcsec; pa=90deg; mag2=7.25" and w["h"] == "12h30m00.0s" and w["m"] == "-00°30'00\""
    j = spark.createDataFrame([('{"a": 3}',), ('{"z": 1}',), ("[]",)], "t string").select(names.checked_json(F.col("t"), {"a": "int", "b": "double"}, {"b": 0.5}).alias("j")).collect()
    assert (j[0]["j"]["a"], j[0]["j"]["b"], j[1]["j"], j[2]["j"]) == (3, 0.5, None, None)


def test_protected_regions_and_stretch(spark):
    df = spark.createDataFrame([(0, y, x, 0.0) for y in range(9) for x in range(9)], "f long, y int, x int, v double")
    e = {(r["x"], r["y"]) for r in pixels.protected(df, (4, 4, 3, 1, 0)).where("protected").collect()}
    assert (7, 4) in e and (4, 6) not in e
    p = {(r["x"], r["y"]) for r in pixels.protected(df, polygon=[(1, 1), (5, 1), (5, 5), (1, 5)], padding=1.0).where("protected").collect()}
    assert (3, 3) in p and (6, 3) in p and (7, 3) not in p
    rng = np.random.default_rng(3)
    im = spark.createDataFrame([(0, y, x, c, float(v)) for (y, x, c), v in np.ndenumerate(np.clip(rng.normal(0.1, 0.01, (12, 12, 3)), 0, 1))], "f long, y int, x int, c int, v double")
    for strategy in ("linked", "unlinked", "luminance"):
        m = pixels.stretch(im, strategy).agg(F.median("v").alias("m"), F.count("*").alias("n")).first()
        assert m["n"] == 432 and abs(m["m"] - 0.2) < 0.05
