import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import astro, curves
from orrery.functions.sky import TileGrid, Wcs, bearing, separation
from orrery.operators import admission, fold, kernels, matching, merge, orbits, pixels, solver, solving, spatial


def pixel_rows(spark, a, f=0):
    return spark.createDataFrame([(f, y, x, None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(a)], "f long, y int, x int, v double")


def as_array(df, column="v"):
    r = df.collect()
    out = np.full((max(p["y"] for p in r) + 1, max(p["x"] for p in r) + 1), np.nan)
    for p in r:
        out[p["y"], p["x"]] = np.nan if p[column] is None else p[column]
    return out


def sphere(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(0, 12, n)))]
    return spark.createDataFrame(rows, "id long, ra double, dec double, mag double")


# --- sky


def test_separation_and_bearing(spark):
    df = spark.range(1).select(separation(0.0, 0.0, 90.0, 0.0).alias("a"), separation(0.0, 60.0, 1.0, 60.0).alias("b"), bearing(0.0, 0.0, 1.0, 0.0).alias("c"))
    r = df.first()
    assert math.isclose(r["a"], 90.0) and abs(r["b"] - 0.5) < 1e-3 and math.isclose(r["c"], 90.0)


@pytest.mark.parametrize("radius", [0.5, 5.0, 40.0])
def test_tile_join_equals_brute_force(spark, radius):
    s = sphere(spark, 900)
    c = spark.createDataFrame([(0, 10.0, 20.0), (1, 359.9, -3.0), (2, 45.0, 85.0), (3, 200.0, -89.5), (4, 10.0, 80.0)], "sid long, ra0 double, dec0 double")
    got = {(r["sid"], r["id"]) for r in spatial.cone_join(c, s, radius).collect()}
    u = lambda a, d: (math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d)))
    want = {(p["sid"], q["id"]) for p in c.collect() for q in s.collect() if sum(x * y for x, y in zip(u(p["ra0"], p["dec0"]), u(q["ra"], q["dec"]))) >= math.cos(math.radians(radius))}
    assert got == want
    grid = TileGrid(45)
    for p in c.collect():
        cover = set(grid.cover_literal(p["ra0"], p["dec0"], radius))
        tiles = spatial.with_tile(s.join(c.where(f"sid = {p['sid']}"), F.lit(True))).where(separation("ra", "dec", "ra0", "dec0") <= radius).select("tile").distinct().collect()
        assert {t["tile"] for t in tiles} <= cover


def test_regions(spark):
    rows = [(1, "a", 0.0, 0.0, 8.0, 30.0, "Near", ""), (2, "a", 359.5, 0.0, None, None, "Wrapped", "w"), (3, "a", 20.0, 20.0, 8.0, 30.0, "Far", "")]
    o = spark.createDataFrame(rows, "id long, kind string, ra double, dec double, mag double, major_arcmin double, name string, common_name string")
    square = spatial.Polygon(((359.0, -1.0), (1.0, -1.0), (1.0, 1.0), (359.0, 1.0)))
    for region in (spatial.Cone(0.0, 0.0, 1.0), square):
        assert {r["name"] for r in spatial.region_query(o, region).collect()} == {"Near", "Wrapped"}
    assert [r["name"] for r in spatial.region_query(o, square, max_mag=9.0).collect()] == ["Near"]
    assert [r["name"] for r in spatial.region_query(o, spatial.Cone(20.2, 20.0, 0.05)).collect()] == ["Far"]  # by its extent
    assert spatial.region_query(o, spatial.Cone(20.2, 20.0, 0.05), extents=False).count() == 0
    for corners in (((0.0, 0.0), (1.0, 0.0)), ((0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0))):
        with pytest.raises(ValueError):
            spatial.Polygon(corners)


def test_tile_sink(spark, tmp_path):
    s = sphere(spark, 500)
    spatial.write_tiles(s, str(tmp_path / "t"))
    cone = spatial.Cone(30.0, 40.0, 15.0)
    got = {r["id"] for r in spatial.read_tiles(spark, str(tmp_path / "t"), cone, 9.0).collect()}
    want = {r["id"] for r in s.where("mag <= 9").where(separation(F.col("ra"), F.col("dec"), 30.0, 40.0) <= 15.0).collect()}
    assert got == want and got


def test_wcs_round_trip(spark):
    sip = (2, (1e-6, 2e-6, -1e-6), (0.0, 1e-6, 1e-6), (0.0,) * 6, (0.0,) * 6)
    for wcs in (Wcs.simple(83.63, 22.01, 100.0, 200.0, 1.5, 30.0), Wcs(83.63, 22.01, 100.0, 200.0, (-4e-4, 0, 0, 4e-4), sip)):
        df = spark.createDataFrame([(100.0, 200.0), (400.0, 10.0)], "x double, y double")
        ra, dec = wcs.to_world(F.col("x"), F.col("y"))
        df = df.withColumn("ra", ra).withColumn("dec", dec)
        u, v = wcs.to_pixel(F.col("ra"), F.col("dec"))
        for r in df.withColumn("u", u).withColumn("v", v).collect():
            assert np.allclose(wcs.world(r["x"], r["y"]), (r["ra"], r["dec"]))
            assert wcs.sip is not None or np.allclose((r["u"], r["v"]), (r["x"], r["y"]), atol=1e-6)
    assert Wcs.simple(0, 0, 0, 0, 2.0).cards()["CRPIX1"] == 1.0
    away = spark.range(1).select(Wcs.simple(0.0, 0.0, 0, 0, 1.0).to_pixel(F.lit(180.0), F.lit(0.0))[0].alias("x")).first()
    assert away["x"] is None


# --- dates and orbits


def test_dates(spark):
    df = spark.createDataFrame([("2000-01-01T12:00:00Z",), ("1970-01-02",), ("x",)], "t string").select(astro.iso_to_unix(F.col("t")).alias("u"))
    assert [r["u"] for r in df.collect()] == [946728000.0, 86400.0, None]
    jd = spark.range(1).select(astro.julian_date(F.lit(2000), F.lit(1), F.lit(1.5)).alias("j"), astro.sample_times(F.lit(0.0), F.lit(2.5), 1.0).alias("s")).first()
    assert jd["j"] == 2451545.0 and np.allclose(jd["s"], [0, 2.5 / 3, 5 / 3, 2.5])
    i = spark.range(1).select(astro.exposure_interval(F.lit(None).cast("double"), F.lit(100.0), F.lit(None).cast("double"), F.lit(10.0)).alias("i")).first()["i"]
    assert (i["start"], i["end"]) == (95.0, 105.0)


def test_sgp4_published_case():
    e = {k: np.array([v]) for k, v in {"inclination": 34.2682, "node": 348.7242, "eccentricity": 0.1859667, "perigee": 331.7664, "anomaly": 19.3264, "motion": 10.82419157, "bstar": 0.28098e-4}.items()}
    got = orbits.sgp4(e, np.array([[0.0, 360.0]]))[0]
    assert np.allclose(got, [[7022.46529, -1400.08297, 0.03996], [-7154.03120, -3783.17683, -3536.19412]], atol=1e-4)


def test_tracks(spark):
    e = spark.createDataFrame([(1, 0.0, 51.6, 10.0, 0.001, 20.0, 30.0, 15.5, 1e-5), (2, -1e9, 51.6, 10.0, 0.001, 20.0, 30.0, 15.5, 1e-5), (3, 0.0, 5.0, 0.0, 0.001, 0.0, 0.0, 1.0, 0.0)], "norad_id int, epoch double, inclination double, node double, eccentricity double, perigee double, anomaly double, motion double, bstar double")
    s = orbits.samples(e.where("norad_id <> 2"), [0.0, 60.0, 120.0], (10.0, 20.0, 100.0)).collect()
    assert {r["norad_id"] for r in s} == {1} and all(400 < r["range_km"] < 14000 and -90 <= r["elevation_deg"] <= 90 for r in s)
    r = next(x for x in s if x["i"] == 1)
    wcs = Wcs.simple(r["ra"], r["dec"], 500.0, 500.0, 20.0)
    t = orbits.tracks_in_footprint(e, 30.0, 90.0, (10.0, 20.0, 100.0), wcs, 1000, 1000, min_elevation=-91.0).collect()
    assert [x["norad_id"] for x in t] == [1] and t[0]["length"] > 10


# --- folds


def test_fold_matches_stream_state(spark):
    from orrery.streaming.stacking import integrate

    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.normal(10, 1, 60)]
    values[30], values[40] = 500.0, None
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], "k long, seq long, v double")
    r = fold.delta_sigma(df, ["k"], "seq").first()
    state = (0, 0.0, 0.0, 0)
    for v in values:
        state = integrate(state, v)
    assert (r["n"], r["rejected"]) == (state[0], state[3]) and math.isclose(r["mean"], state[1]) and state[3] >= 1


def test_stream_resumes(spark, tmp_path):
    from orrery.streaming import stacking

    rng = np.random.default_rng(4)
    rows = [(k, s + 1, float(rng.normal(5, 1))) for k in (1, 2) for s in range(16)]
    order = rng.permutation(len(rows))
    src = tmp_path / "in"
    got = {}

    def sink(batch, _):
        got.update({r["k"]: r.asDict() for r in batch.collect()})

    for part in np.array_split(order, 3):
        spark.createDataFrame([rows[i] for i in part] + [rows[part[0]]], "k long, seq long, v double").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("k long, seq long, v double").parquet(str(src))
        stacking.start(stream, sink, str(tmp_path / "check")).awaitTermination(120)
    want = {r["k"]: r for r in fold.delta_sigma(spark.createDataFrame(rows, "k long, seq long, v double"), ["k"], "seq").collect()}
    for k, r in got.items():
        assert (r["n"], r["rejected"], r["waiting"], r["next"]) == (want[k]["n"], want[k]["rejected"], 0, 17) and math.isclose(r["mean"], want[k]["mean"]) and math.isclose(r["variance"], want[k]["variance"])


def test_stream_windows_equal_batch(spark, tmp_path):
    from orrery.streaming.windows import tumbling

    e = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:00:00", "a" if i % 2 else "b", float(i)) for i in range(40)], "event_id long, s string, event_type string, value double").withColumn("ts", F.to_timestamp("s"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = tumbling(stream, "2 hours").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, tumbling(e, "2 hours").collect()))


def test_admission(spark):
    base = {"channels": 1, "expected_channels": 1, "matches": 9, "rms": 1.0, "scale": 1.0, "rotation": 179.0, "overlap": 0.9, "gain": 1.0, "surviving": 0.9}
    cases = [{}, {"channels": 3}, {"matches": None}, {"rms": 3.0, "scale": 2.0}, {"rotation": 45.0}, {"overlap": 0.1}, {"gain": 9.0}, {"surviving": 0.2}]
    df = spark.createDataFrame([{**base, **c, "i": i} for i, c in enumerate(cases)], "i int, channels int, expected_channels int, matches int, rms double, scale double, rotation double, overlap double, gain double, surviving double")
    got = [r["c"] for r in df.select("i", admission.reason()["code"].alias("c")).orderBy("i").collect()]
    assert got == [None, "channels", "registration", "rms", "rotation", "overlap", "gain", "surviving"]


def test_eviction_keeps_newest_and_guarded(spark):
    s = spark.createDataFrame([(i, float(i), 10, "p") for i in range(6)], "id long, t double, bytes long, provider string")
    gone = {r["id"] for r in fold.eviction(s, 25, keep=0).collect() if r["evict"]}
    assert gone == {1, 2, 3, 4} and {r["id"] for r in fold.eviction(s, 5).collect() if r["evict"]} == {0, 1, 2, 3, 4}


# --- pixels and kernels


def test_components_and_stats(spark):
    a = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [3, 0, 0, 1]], float)
    df = pixel_rows(spark, np.where(a > 0, a, np.nan)).where("v is not null")
    got = as_array(pixels.components(df), "component")
    assert got[0, 0] == got[0, 1] == got[1, 2] == 0 and got[3, 0] == 1 and got[3, 3] == 2
    assert pixels.components(df, eight=False).select("component").distinct().count() == 4
    want = kernels.label_mask(a > 0)
    assert np.array_equal(np.where(a > 0, got + 1, 0), want)
    s = {r["component"]: r for r in pixels.component_stats(pixels.components(df).join(df, ["f", "y", "x"])).collect()}
    assert s[0]["area"] == 3 and math.isclose(s[0]["cx"], 1.0) and s[1]["flux"] == 3.0


def test_detect_finds_planted_stars(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(100, 1, (64, 64))
    y, x = np.mgrid[0:64, 0:64]
    for cy, cx, flux in ((20.3, 30.6, 300), (45.0, 12.0, 150)):
        a += flux * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 1.3**2))
    r = pixels.detect(pixel_rows(spark, a)).orderBy("rank").collect()
    assert len(r) == 2 and abs(r[0]["x"] - 30.6) < 0.2 and abs(r[0]["y"] - 20.3) < 0.2 and abs(r[1]["x"] - 12) < 0.2


def test_smoothing(spark):
    a = np.random.default_rng(6).random((6, 7))
    g = as_array(pixels.gaussian(pixel_rows(spark, a), 1.0, 5))
    taps = np.array(pixels.gaussian_kernel(1.0, 5))
    p = np.pad(a, 2, mode="reflect")
    want = sum(taps[i] * taps[j] * p[i : i + 6, j : j + 7] for i in range(5) for j in range(5))
    assert np.allclose(g, want)
    r = pixels.structure_removal(pixel_rows(spark, a), 2)
    assert np.allclose(as_array(r) + as_array(r, "residual"), a)
    assert sum(pixels.kernel_q8(pixels.gaussian_kernel(1.7, 11))) == 256


def test_debayer_constant_colours(spark):
    y, x = np.mgrid[0:6, 0:8]
    a = np.where((y % 2 == 0) & (x % 2 == 0), 4000.0, np.where((y % 2 == 1) & (x % 2 == 1), 1000.0, 2000.0))
    d = pixels.debayer(pixel_rows(spark, a))
    assert {tuple(r) for r in d.select("r", "g", "b").collect()} == {(4000.0, 2000.0, 1000.0)}
    assert {r[0] for r in d.select(pixels.luma("bayer")).collect()} == {2250.0}


def test_normalization_gain(spark):
    ref = np.linspace(20, 275, 256).reshape(16, 16)
    src = pixel_rows(spark, 2 * ref + 8, 1)
    r = pixels.global_normalization(src, pixel_rows(spark, ref)).first()
    assert math.isclose(r["gain"], 0.5, rel_tol=1e-9) and math.isclose(r["offset"], -4.0, rel_tol=1e-6)


def test_master_rejects_outlier(spark):
    frames = spark.createDataFrame([(f, 0, 0, 10.0 + 0.1 * (f % 3) if f else 900.0) for f in range(8)], "f long, y int, x int, v double")
    r = pixels.master(frames).first()
    assert r["rejected"] == 1 and 9.9 < r["v"] < 10.3
    assert {x["f"]: x["rejected"] for x in pixels.master_tallies(frames, None).collect()}[0] == 1


def test_canny_step():
    a = np.zeros((12, 12), np.uint8)
    a[:, 6:] = 200
    e = kernels.canny(a, 50, 100)
    assert set(np.nonzero(e)[1]) <= {5, 6} and (e.max(1) == 255).all() and not kernels.canny(np.zeros((5, 5)), 1, 2).any()


def test_contours_and_hull():
    m = np.zeros((10, 12), bool)
    m[2:6, 3:9] = True
    m[8, 1] = True
    c = kernels.contours(m)
    assert len(c) == 2 and len(c[0]) == 4
    s = kernels.contour_measures(c[0])
    assert (s["area"], s["perimeter"], s["width"], s["height"], s["cx"], s["cy"]) == (15.0, 16.0, 6.0, 4.0, 5.5, 3.5)
    assert {tuple(p) for p in kernels.convex_hull(np.argwhere(m[:7])).tolist()} == {(2, 3), (2, 8), (5, 3), (5, 8)}


def test_largest_rectangle():
    rng = np.random.default_rng(7)
    for _ in range(20):
        m = rng.random((7, 8)) < 0.7
        best = max((h * w for y in range(7) for x in range(8) for h in range(1, 8 - y) for w in range(1, 9 - x) if m[y : y + h, x : x + w].all()), default=0)
        y, x, h, w = kernels.largest_rectangle(m)
        assert h * w == best and m[y : y + h, x : x + w].all()


def test_domain_transform_keeps_edges():
    a = np.zeros((8, 40))
    a[:, 20:] = 100
    noisy = a + np.random.default_rng(8).normal(0, 1, a.shape)
    out = kernels.domain_transform(a, noisy, 10, 1)
    assert np.abs(out - a).mean() < 0.5 * np.abs(noisy - a).mean() and np.allclose(kernels.domain_transform(a, np.full_like(a, 3.0), 10, 1), 3.0)


def test_deconvolution_sharpens_and_keeps_flux():
    y, x = np.mgrid[0:41, 0:41]
    a = 10 + 100 * np.exp(-((y - 20) ** 2 + (x - 20) ** 2) / (2 * 2.0**2))
    out = kernels.deconvolve(a, 3.0)
    assert out.max() > a.max() and math.isclose(out.sum(), a.sum(), rel_tol=1e-3) and np.array_equal(kernels.deconvolve(a, 3.0, amount=0), a)
    a[3, 4] = np.nan
    assert np.isnan(kernels.deconvolve(a, 3.0)[3, 4])


def test_background_removes_gradient():
    y, x = np.mgrid[0:90, 0:120]
    plane = 100 + 0.3 * x + 0.2 * y
    a = plane + np.random.default_rng(9).normal(0, 0.5, plane.shape)
    a[40:44, 50:54] += 500
    for degree in (2, None):
        model = kernels.background(a, degree=degree)
        assert np.abs(model - plane).max() < 1.5
    flat = kernels.correct_background(a, model)
    assert np.ptp(np.median(flat, 0)) < 3


def test_registration_and_resampling():
    rng = np.random.default_rng(10)
    ref = rng.uniform(0, 500, (40, 2))
    t = np.array([[math.cos(0.02), -math.sin(0.02), 7.0], [math.sin(0.02), math.cos(0.02), -4.0]])
    src = kernels.apply_transform(kernels.invert(t), ref) + rng.normal(0, 0.05, ref.shape)
    got = kernels.register(src[5:], ref)
    assert got["matches"] >= 30 and np.allclose(got["transform"], t, atol=0.2)
    image = rng.random((20, 20))
    shift = np.array([[1.0, 0, 0.5], [0, 1.0, 0]])
    out = kernels.resample(image, shift)
    assert np.allclose(out[:, :19], (image[:, :-1] + image[:, 1:]) / 2) and np.isnan(out[:, 19]).all()
    assert np.array_equal(kernels.resample(image, shift, (5, 6), (3, 4)), out[3:8, 4:10])
    assert np.allclose(kernels.compose(t, kernels.invert(t)), np.eye(2, 3))


def test_per_frame(spark):
    a = np.arange(12.0).reshape(3, 4)
    rows = kernels.to_arrays(pixel_rows(spark, a))
    assert np.array_equal(as_array(kernels.to_rows(kernels.per_frame(rows, lambda m: m * 2))), a * 2)


def test_residual_flat():
    crop = np.full((30, 30), 100.0)
    crop[10:20, 10:20] *= 0.8
    patch = kernels.residual_flat([(crop + k, (5, 5)) for k in range(6)], (40, 40))
    assert patch[20, 20] < 0.85 and patch[2, 2] == 1.0 and patch.min() >= 0.5


def test_curves(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 11)], "x double")
    for b in (-2.0, -1.0, 0.0, 1.0, 3.0):
        v = [r[0] for r in df.select(curves.ghs(F.col("x"), 4.0, b, 0.3, 0.1, 0.9)).collect()]
        assert abs(v[0]) < 1e-9 and abs(v[-1] - 1) < 1e-9 and all(p <= q + 1e-12 for p, q in zip(v, v[1:]))
    c = spark.range(1).select(curves.auto_mtf(F.lit(0.1), F.lit(0.01)).alias("c")).first()["c"]
    v = spark.range(1).select(curves.mtf_curve(F.lit(0.1), c["shadows"], c["midtone"], c["highlights"]).alias("v")).first()["v"]
    assert math.isclose(v, 0.2, rel_tol=1e-6) and not c["identity"]


def test_identity(spark):
    o = spark.createDataFrame([(1, "a", "NGC 001"), (2, "b", "ngc1"), (3, "b", "M 5"), (4, "c", "NGC 1")], "id long, source string, name string")
    got = {r["id"]: (r["status"], r["target"]) for r in merge.resolve(o.where("source = 'a'"), o.where("source <> 'a'"), ["name"]).collect()}
    assert got == {1: ("ambiguous", None)}
    assert merge.missing(o.select("name"), o.where("id > 2").select("name"), "name").first()["missing"] == "NGC 001,ngc1"
    links = spark.createDataFrame([(1, [2, 9])], "id long, parents array<long>").union(spark.createDataFrame([(2, [])], "id long, parents array<long>"))
    assert [r["parent"] for r in merge.unresolved_parents(links, "id", "parents").collect()] == [9]


def test_fallback_rows_gives_the_operator_both_sides(spark, tmp_path, monkeypatch):
    from orrery.plans import matches

    spark.createDataFrame([(i, "en") for i in range(6)], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (4, 1), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, whole = [], merge.fallback
    monkeypatch.setattr(merge, "fallback", lambda a, b, key: seen.append((a.count(), b.count())) or whole(a, b, key))
    got = matches.fallback_rows(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang"] and {r["doc_id"] for r in got.collect()} == {0, 2, 3, 5}
    assert seen == [(2, 6)]


# --- solving


def synthetic_sky(seed=7, n=120):
    rng = np.random.default_rng(seed)
    wcs = Wcs.simple(150.0, 35.0, 800.0, 600.0, 2.5, 20.0)
    xy = rng.uniform((0, 0), (1600, 1200), (n, 2))
    sky = np.array([wcs.world(*p) for p in xy])
    mag = 5 + 8 * np.arange(n) / n
    field = np.column_stack([rng.uniform(147, 153, 200), rng.uniform(32, 38, 200)])
    ra, dec = np.concatenate([sky[:, 0], field[:, 0]]), np.concatenate([sky[:, 1], field[:, 1]])
    return wcs, xy, ra, dec, np.concatenate([mag, rng.uniform(9, 13, 200)])


def test_hinted_solve(spark):
    wcs, xy, ra, dec, mag = synthetic_sky()
    out = solver.solve(xy, ra, dec, mag, (150.2, 35.1), (2.5, 0.2), (1600, 1200))
    assert out["matches"] >= 20 and out["rms_px"] < 0.5
    assert np.allclose(out["wcs"].world(800, 600), wcs.world(800, 600), atol=1e-3) and abs(out["wcs"].scale - 2.5) < 1e-3
    stars = spark.createDataFrame([(1, float(x), float(y), float(1e6 * 10 ** (-0.4 * m))) for (x, y), m in zip(xy, mag)], "frame long, x double, y double, flux double")
    window = spark.createDataFrame([(1, float(a), float(d), float(m)) for a, d, m in zip(ra, dec, mag)], "frame long, ra double, dec double, mag double")
    hints = spark.createDataFrame([(1, 150.2, 35.1, 2.5, 0.2, 1600, 1200)], "frame long, ra0 double, dec0 double, scale double, scale_tolerance double, width int, height int")
    r = solver.solve_frames(stars, window, hints).first()
    assert r["matches"] >= 20 and abs(r["scale"] - 2.5) < 1e-3 and abs(r["rotation"] - 20) < 0.1


def test_hinted_solve_of_a_hint_off_centre():
    wcs, xy, ra, dec, mag = synthetic_sky()
    rng = np.random.default_rng(3)
    far = np.column_stack([rng.uniform(147, 153, 600), rng.uniform(32, 38, 600)])
    far = far[np.hypot((far[:, 0] - 150) * math.cos(math.radians(35)), far[:, 1] - 35) > 1]
    ra, dec, mag = np.concatenate([ra, far[:, 0]]), np.concatenate([dec, far[:, 1]]), np.concatenate([mag, rng.uniform(1, 4, len(far))])
    out = solver.solve(xy, ra, dec, mag, (151.2, 34.1), (2.5, 0.2), (1600, 1200))
    assert out is not None and out["matches"] >= 20 and np.allclose(out["wcs"].world(800, 600), wcs.world(800, 600), atol=1e-3)
    empty = np.flatnonzero(np.hypot((ra - 150) * math.cos(math.radians(35)), dec - 35) > 1)
    assert solver.solve(xy, ra[empty], dec[empty], mag[empty], (151.2, 34.1), (2.5, 0.2), (1600, 1200)) is None


def test_solve_fields_equals_solve_frames(spark):
    wcs, _, ra, dec, mag = synthetic_sky()
    (a, b), (c, d) = np.array(wcs.inverse()).reshape(2, 2)
    window = [(float(r), float(e), float(m)) for r, e, m in zip(ra, dec, mag)] + [(200.0, -80.0, 1.0), (150.0, None, 2.0)]
    hints = [(k, 150.0 + k / 10, 35.0 - k / 20, 2.5, 0.2, 1600, 1200) for k in range(3)] + [(7, 20.0, -60.0, 2.5, 0.2, 1600, 1200)]
    hints = spark.createDataFrame(hints, "frame long, ra0 double, dec0 double, scale double, scale_tolerance double, width int, height int")

    def detect(plane, mag):
        xy = plane @ np.array([[a, c], [b, d]]) + [800.0, 600.0]
        inside = ((xy >= 0) & (xy <= [1600, 1200])).all(1)
        return np.column_stack([xy, 10 ** (-0.4 * mag)])[inside]

    got = {r["frame"]: r for r in solver.solve_fields(hints, spark.createDataFrame(window, "ra double, dec double, mag double"), 4.0, detect).collect()}
    assert set(got) == {0, 1, 2}
    for k in got:
        ra0, dec0 = 150.0 + k / 10, 35.0 - k / 20
        near = [w for w in window if w[1] is not None and np.degrees(np.arccos(min(1, solver.unit(w[0], w[1]) @ solver.unit(ra0, dec0)))) <= 4]
        r, e, m = np.array(near).T
        stars = spark.createDataFrame([(k, *map(float, s)) for s in detect(solver.project(r, e, ra0, dec0), m)], "frame long, x double, y double, flux double")
        want = solver.solve_frames(stars, spark.createDataFrame([(k, *w) for w in near], "frame long, ra double, dec double, mag double"), hints).first()
        assert got[k]["matches"] == want["matches"] >= 20 and abs(got[k]["scale"] - want["scale"]) < 1e-6 and abs(got[k]["ra"] - want["ra"]) < 1e-6


def test_hinted_solve_never_shuffles_windows(spark, tmp_path):
    import __spark_entry__ as driver

    k = np.arange(3_000_000)
    k = k[(np.abs(k * 137508 % 360000 - 180000) < 5000) & (np.abs(k * 61803 % 180001 - 90000) < 5000)][:400].tolist()
    spark.createDataFrame([(i, float(n % 97 * 100)) for n, i in enumerate(k)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    j = np.arange(9_000_000)
    j = j[(np.abs(j * 222461 % 360000 - 180000) < 3000) & (np.abs(j * 75025 % 180001 - 90000) < 3000)][:150].tolist()
    spark.createDataFrame([(i,) for i in j], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert len(k) == 400 and len(j) == 150

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    got = driver.queries()["hinted_solve"](spark, str(tmp_path)).collect()
    assert len(got) == 150 and all(r["scale"] == 90 and r["matches"] > 380 for r in got)
    assert 0 < shuffled() - before < 200_000  # 60,000 pairs of frame and star


def test_sip_fit():
    rng = np.random.default_rng(11)
    wcs = Wcs.simple(150.0, 35.0, 800.0, 600.0, 2.5)
    xy = rng.uniform((0, 0), (1600, 1200), (200, 2))
    u = xy - [800, 600]
    bent = u + 2e-6 * np.column_stack([u[:, 0] ** 2 - u[:, 0] * u[:, 1], u[:, 1] ** 2])
    plane = bent @ np.array([[wcs.cd[0], wcs.cd[2]], [wcs.cd[1], wcs.cd[3]]]) + rng.normal(0, 1e-6, u.shape)
    new = solver.fit_sip(xy, plane, wcs, 2, (1600, 1200))
    assert new is not None and new.sip[0] == 2
    err = [np.hypot((new.world(*p)[0] - s[0]) * math.cos(math.radians(35)), new.world(*p)[1] - s[1]) for p, s in zip(xy, np.column_stack(solver.unproject(plane, 150.0, 35.0)))]
    assert np.median(err) * 3600 < 0.05
    assert solver.fit_sip(xy[:5], plane[:5], wcs, 2, (1600, 1200)) is None


def test_position_dedup_of_whole_tables(spark, tmp_path):
    import __spark_entry__ as driver

    spark.range(1, 61).selectExpr("id as c_custkey", "0.0D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(41, 141).selectExpr("id as p_partkey", "'t' as p_type", "1.0D as p_retailprice", "1 as p_size", "'n' as p_name", "'b' as p_brand").write.parquet(f"{tmp_path}/part.parquet")

    def place(k):
        ra, dec = np.radians(k * 137508 % 360000 / 1000), np.radians(k * 61803 % 180001 / 1000 - 90)
        return np.array([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)])

    new, old = np.arange(41, 141), np.arange(1, 61)
    far = np.degrees(np.arccos(np.clip(place(new).T @ place(old), -1, 1))).min(1) > 3
    got = {r["id"] for r in driver.queries()["position_dedup_all"](spark, str(tmp_path)).collect()}
    assert got == set(new[far].tolist()) and 0 < len(got) < 100 and {i % 2 for i in got} == {0, 1}


def test_blind_solve(spark):
    rng = np.random.default_rng(12)
    ra, dec, mag = rng.uniform(140, 160, 900), rng.uniform(25, 45, 900), rng.uniform(3, 9, 900)
    catalog = spark.createDataFrame([(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(ra, dec, mag))], "id long, ra double, dec double, mag double")
    index = solver.blind_index(catalog, [(1.5, 9.2), (0.75, 9.2)]).cache()
    wcs = Wcs.simple(150.0, 35.0, 500.0, 400.0, 18.0, 33.0)
    plane = solver.project(ra, dec, 150.0, 35.0)
    m = np.array([[wcs.cd[0], wcs.cd[1]], [wcs.cd[2], wcs.cd[3]]])
    xy = plane @ np.linalg.inv(m).T + [500, 400]
    inside = np.flatnonzero((xy > 0).all(1) & (xy[:, 0] < 1000) & (xy[:, 1] < 800))
    inside = inside[np.argsort(mag[inside])]

    def near(a, d, r):
        p = solver.project(ra, dec, a, d)
        k = np.flatnonzero(np.hypot(p[:, 0], p[:, 1]) <= r)
        k = k[np.argsort(mag[k])]
        return ra[k], dec[k], mag[k]

    out = solver.solve_blind(xy[inside], index, near, (1000, 800), quads=1001)
    assert out is not None and np.allclose(out["wcs"].world(500, 400), (150.0, 35.0), atol=0.01) and abs(out["wcs"].scale - 18) < 0.05


def test_blind_solve_uses_all_quads_by_default(spark):
    rng = np.random.default_rng(12)
    ra, dec, mag = rng.uniform(140, 160, 900), rng.uniform(25, 45, 900), rng.uniform(3, 9, 900)
    catalog = spark.createDataFrame([(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(ra, dec, mag))], "id long, ra double, dec double, mag double")
    index = solver.blind_index(catalog, [(1.5, 9.2), (0.75, 9.2)]).cache()
    wcs = Wcs.simple(150.0, 35.0, 500.0, 400.0, 18.0, 33.0)
    plane = solver.project(ra, dec, 150.0, 35.0)
    m = np.array([[wcs.cd[0], wcs.cd[1]], [wcs.cd[2], wcs.cd[3]]])
    xy = plane @ np.linalg.inv(m).T + [500, 400]
    inside = np.flatnonzero((xy > 0).all(1) & (xy[:, 0] < 1000) & (xy[:, 1] < 800))
    inside = inside[np.argsort(mag[inside])]

    def near(a, d, r):
        p = solver.project(ra, dec, a, d)
        k = np.flatnonzero(np.hypot(p[:, 0], p[:, 1]) <= r)
        k = k[np.argsort(mag[k])]
        return ra[k], dec[k], mag[k]

    spurious = np.concatenate([[[130.0, 700.0], [880.0, 90.0]], xy[inside]])
    out = solver.solve_blind(spurious, index, near, (1000, 800))
    assert out is not None and np.allclose(out["wcs"].world(500, 400), (150.0, 35.0), atol=0.01)


def test_blind_votes_count_all_look_ups(spark):
    noise = spark.range(60_000).selectExpr("id % 300 * 4 as x", "id div 300 * 4 as y", "id % 2 as z", "0.005D as error", "0.0D as ra", "0.0D as dec", "1.0D as scale", "array(1.0D) as map", "0.0D as ra0", "0.0D as dec0")
    votes = [(x, 5001, 40, e, float(x)) for x, n in ((5001, 3), (5002, 7)) for e in [0.004, 0.002, 0.003] + [0.009] * (n - 3)]
    true = spark.createDataFrame(votes, "x long, y long, z long, error double, ra double").selectExpr("x", "y", "z", "error", "ra", "0.0D as dec", "1.0D as scale", "array(1.0D) as map", "0.0D as ra0", "0.0D as dec0")
    got = solver.ranked_bins(noise.unionAll(true), 4)
    assert len(got) == 300
    assert [(r["x"], r["n"], r["score"], r["lead"]["ra"], r["lead"]["error"]) for r in got[:2]] == [(5002, 7, 10, 5002.0, 0.002), (5001, 3, 10, 5002.0, 0.002)]


def test_components_equal_a_flood_fill(spark):
    rng = np.random.default_rng(8)
    masks = [rng.random((20, 31)) < p for p in (0.3, 0.5, 0.7)]
    rows = [(k, int(y), int(x)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "f long, y int, x int")
    for eight in (True, False):
        near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
        want = {}
        for k, m in enumerate(masks):
            n = 0
            for start in zip(*(v.tolist() for v in np.nonzero(m))):
                if (k, *start) in want:
                    continue
                todo = [start]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] and (k, y, x) not in want:
                        want[k, y, x] = n
                        todo += [(y + a, x + b) for a, b in near]
                n += 1
        assert {(r["f"], r["y"], r["x"]): r["component"] for r in pixels.components(df, eight).collect()} == want


def test_ranks_need_no_single_task(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 37) % 101 END AS t")
    got = [r["id"] for r in matching.by_time(df.selectExpr("id", "t * 86400 AS t", "CAST(0 AS BIGINT) AS ref"), "t", "ref").orderBy("order").collect()]
    key = lambda i: (2**62 if i % 7 == 0 else (i * 37) % 101 * 86400, i)
    assert got == sorted(range(500), key=key)
    nothing = matching.by_time(df.selectExpr("id", "t", "CAST(NULL AS BIGINT) AS ref"), "t", "ref").orderBy("order")
    assert [r["id"] for r in nothing.collect()] == list(range(500))


def test_region_query_reaches_the_scan(spark, tmp_path):
    objects = spark.range(4000).selectExpr("id", "'g' AS kind", "CAST((id * 137508) % 360000 AS DOUBLE) / 1000 AS ra", "CAST((id * 61803) % 180001 AS DOUBLE) / 1000 - 90 AS dec", "CAST(id % 15 AS DOUBLE) AS mag", "CAST(id % 400 AS DOUBLE) AS major_arcmin", "'n' AS name", "'' AS common_name")
    spatial.with_tile(objects).repartitionByRange(8, "tile").sortWithinPartitions("tile").write.parquet(str(tmp_path / "o"))
    laid = spark.read.parquet(str(tmp_path / "o"))
    for region in (spatial.Cone(359.0, 10.0, 4.0), spatial.Cone(120.0, 88.0, 5.0), spatial.Polygon(((340.0, -20.0), (20.0, -20.0), (20.0, 20.0), (340.0, 20.0)))):
        for extents in (True, False):
            pruned = spatial.region_query(laid, region, extents=extents)
            assert {r["id"] for r in pruned.collect()} == {r["id"] for r in spatial.region_query(objects, region, extents=extents).collect()}
            assert "tile" in pruned._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("ReadSchema")[0]


def test_rank_robust_solve():
    rng = np.random.default_rng(21)
    wcs, xy, ra, dec, mag = synthetic_sky()
    mixed = rng.permutation(np.concatenate([xy, rng.uniform((0, 0), (1600, 1200), (80, 2))]))
    for mirrored in (False, True):
        stars = mixed * [-1, 1] + [1600, 0] if mirrored else mixed
        out = solver.solve_rank_robust(stars, ra, dec, mag, (150.2, 35.1), (2.5, 0.05), (1600, 1200))
        assert out is not None and out["matches"] >= 20 and out["rms_px"] < 0.5
        assert np.allclose(out["wcs"].world(800, 600), wcs.world(800, 600), atol=1e-3) and abs(out["wcs"].scale - 2.5) < 1e-3
    assert solver.solve(mixed, ra, dec, mag, (150.2, 35.1), (2.5, 0.05), (1600, 1200)) is not None
    noise = rng.uniform((0, 0), (1600, 1200), (60, 2))
    assert solver.solve_rank_robust(noise, ra, dec, mag, (150.2, 35.1), (2.5, 0.05), (1600, 1200)) is None
    assert solver.solve_rank_robust(mixed[:10], ra, dec, mag, (150.2, 35.1), (2.5, 0.05), (1600, 1200)) is None
    assert solver.solve_rank_robust(mixed, ra, dec, mag, (150.2, 35.1), (2.5, 0.05), (1600, 1200), budget=10) is None


def test_mapping_regions():
    rng = np.random.default_rng(4)
    image = rng.normal(10, 2, (40, 50))
    t, after = np.array([[1.0, 0.02, 3.0], [-0.02, 1.0, -2.0]]), np.array([[-1.0, 0.0, 49.0], [0.0, 1.0, 0.0]])
    m = kernels.Mapping(t, (40, 50), 2.0, -1.0)
    whole = kernels.resample(image, kernels.invert(t), (40, 50)) * 2 - 1
    assert np.allclose(m.extract(image, (5, 7, 10, 20)), whole[5:15, 7:27], equal_nan=True)
    assert np.allclose(m.extract(image, (5, 7, 10, 20), after), whole[:, ::-1][5:15, 7:27], equal_nan=True)
    local = kernels.Mapping(t, (40, 50), np.full((40, 50), 2.0), np.full((40, 50), -1.0))
    assert np.allclose(local.extract(image, (5, 7, 10, 20)), whole[5:15, 7:27], equal_nan=True)
    assert np.allclose(local.extract(image, None, after), whole[:, ::-1], equal_nan=True)
    for bad in (dict(transform=t, shape=(0, 50)), dict(transform=np.zeros((2, 3)), shape=(40, 50)), dict(transform=t, shape=(40, 50), gain=np.ones((2, 2)))):
        with pytest.raises(ValueError):
            kernels.Mapping(**bad)
    with pytest.raises(ValueError):
        m.extract(image, (35, 0, 10, 10))


def test_pattern_index_that_breaks_a_rule(spark, tmp_path):
    p = spark.sql("SELECT 1L AS pattern_id, 0.5D AS max_edge_deg, array(named_struct('x', 1D, 'y', 2D)) AS points")
    solving.write_index(p, spark.sql("SELECT 7L AS key, 1L AS pattern_id UNION ALL SELECT 7L, 2L"), str(tmp_path / "i"))
    with pytest.raises(ValueError, match="missing-pattern 1"):
        solving.open_index(spark, str(tmp_path / "i"))
    assert solving.open_index(spark, str(tmp_path / "i"), False)[1].count() == 2


def test_master_inputs_with_an_exposure_override(spark):
    from orrery.operators import masters, matching

    sig = "named_struct('camera', 'c', 'width', 10L, 'exposure', {e})"
    rows = [(1, "a", "30D"), (2, "b", "CAST(NULL AS DOUBLE)"), (3, "c", "31D"), (4, "a", "30D")]
    f = spark.sql(" UNION ALL ".join(f"SELECT 1 AS set, {o} AS ord, '{p}' AS path, false AS is_master, false AS calibrated, 'dark' AS role, {sig.format(e=e)} AS m" for o, p, e in rows))
    rules = matching.Rules(["camera", "width", "exposure"])
    got = lambda df: {r["ord"]: r["reason"] for r in df.collect()}
    assert got(masters.inputs(f, "dark", rules)) == {1: None, 2: "missing-exposure", 3: "exposure", 4: "duplicate"}
    judged = masters.inputs(f, "dark", rules, exposure=30.0)
    assert got(judged) == {1: None, 2: None, 3: None, 4: "duplicate"}
    assert masters.builds(judged).first()["ready"] and not masters.builds(masters.inputs(f, "dark", rules)).first()["ready"]
    assert set(got(masters.inputs(f, "bias", rules)).values()) == {"role", "duplicate"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inlier_census_deals_both_sides(spark):
    points = spark.range(60).selectExpr("id", "CAST(id * 37 % 100 AS DOUBLE) AS x", "CAST(id * 61 % 89 AS DOUBLE) AS y")
    c, s = points.where("id < 30"), points.where("id >= 30").select((F.col("x") + 3.0).alias("x"), "y")
    found = spatial.inlier_census(c, s, 8.0)
    assert "BroadcastExchange" not in plan_of(found)
    want = {p["id"] for p in c.collect() if any((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 <= 64 for q in s.collect())}
    assert {r["id"] for r in found.collect()} == want and 0 < len(want) < 30


def test_resolve_makes_no_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b", "c"][rng.integers(4)], *[[None, "", *(f"n{k}" for k in range(40))][rng.integers(42)] for _ in range(2)]) for i in range(60)]
    o = spark.createDataFrame(rows, "id long, source string, name string, alias string")
    crowd = spark.range(60_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source", "'one' AS name")
    assert merge.resolve(crowd, crowd, ["name"]).where("status = 'ambiguous'").count() == 60_000  # 1.8 billion pairs by a plain join
    got = {r["id"]: (r["status"], r["target"]) for r in merge.resolve(o, o, ["name", "alias"]).collect()}
    assert len({s for s, _ in got.values()}) == 3
    for i, source, *names in rows:
        hits = {j for j, other, *n in rows if source and other and source != other and {x for x in names if x} & {x for x in n if x}}
        assert got[i] == (("merged", min(hits)) if len(hits) == 1 else ("ambiguous" if hits else "added", None))


def test_tally_of_one_crowded_name(spark):
    many = spark.range(120_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source", "'one' AS name")
    assert merge.tally(merge.resolve(many, many, ["name"])).first().asDict() == {"added": 0, "merged": 0, "ambiguous": 120_000}


SIGNATURE = "named_struct('role', {role}, 'camera', {camera}, 'width', {width}, 'exposure', {exposure}, 'temp', {temp})"


def test_match_counts_of_many_equal_frames(spark):
    same = SIGNATURE.format(role="'dark'", camera="'c'", width="10L", exposure="30D", temp="1D")
    rules = matching.Rules(["camera", "width", "exposure", "temp"])
    r, c = (spark.range(50_000).selectExpr(f"id AS {i}", f"{same} AS {s}") for i, s in (("rid", "r"), ("id", "c")))
    found = matching.match_counts(r, c, rules)  # 2.5 billion pairs
    assert found.agg(F.count("*"), F.min("n"), F.max("n"), F.max("first_id")).first()[:] == (50_000, 50_000, 50_000, 0)


def test_sensor_pairs_equal_the_rule_on_all_pairs(spark):
    odd = SIGNATURE.format(role="'flat'", camera="element_at(array('A', ' a', 'b', NULL), CAST(id % 4 + 1 AS INT))", width="element_at(array(10L, 20L, NULL), CAST(id DIV 4 % 3 + 1 AS INT))", exposure="id % 5 + 0D", temp="id % 7 + 0D")
    rules = matching.Rules(["camera", "width", "exposure", "temp"])
    r, c = (spark.range(60).selectExpr(f"id AS {i}", f"{odd} AS {s}") for i, s in (("rid", "r"), ("id", "c")))
    want = r.crossJoin(c).where(rules.sensor_matches(F.col("r"), F.col("c")))
    got = matching.sensor_pairs(r, c, rules)
    assert sorted(map(tuple, got.select("rid", "id").collect())) == sorted(map(tuple, want.select("rid", "id").collect()))
    close = rules.exposure(F.col("r"), F.col("c")) & rules.temperature(F.col("r"), F.col("c"))
    n = want.where(close).groupBy("rid", F.col("c.role").alias("role")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, matching.match_counts(r, c, rules).collect()))


def test_mismatches_make_their_texts_once_a_frame(spark):
    sig = "named_struct('camera', 'c', 'width', 10L, 'filt', {f}, 'focal', {d}, 'rotation', {r})"
    none = {"f": "CAST(NULL AS STRING)", "d": "CAST(NULL AS DOUBLE)", "r": "CAST(NULL AS DOUBLE)"}
    rules = matching.Rules(["camera", "width", "filt", "focal", "rotation"])
    r = spark.sql(f"SELECT 1L AS rid, {sig.format(f="'F1'", d='500D', r='359D')} AS r UNION ALL SELECT 2L, {sig.format(**none)}")
    c = spark.sql(f"SELECT 7L AS id, {sig.format(f="' f1'", d='501D', r='1D')} AS c UNION ALL SELECT 8L, {sig.format(f="'g'", d='502D', r='2D')} UNION ALL SELECT 9L, {sig.format(**none)}")
    found = matching.mismatches(r, c, rules)
    both = "filter light=F1 master=g; focal length light=500.0 master=502.0; rotation light=359.0 master=2.0"
    lacks = "filter light=F1, master did not record one; focal length light=500.0, master did not record one"
    assert {(x["rid"], x["id"]): x["reason"] for x in found.collect()} == {(1, 7): "", (1, 8): both, (1, 9): lacks, (2, 7): "", (2, 8): "", (2, 9): ""}
    assert "lambda" not in plan_of(found)


def _plan_of_equal_frames(spark, kind, n):
    sig = "named_struct('role', '{k}', 'camera', 'c', 'width', 10L, 'filt', 'f', 'focal', 500D, 'rotation', 1D, 'exposure', 30D, 'temp', 1D, 'captured', {t})"
    rules = matching.Rules(["camera", "width", "filt", "focal", "rotation", "exposure", "temp", "captured"])
    r = spark.range(300).selectExpr("id AS rid", f"{sig.format(k=kind, t='1000L')} AS r")
    c = spark.range(n).selectExpr("id", f"{sig.format(k=kind, t='1000L + id')} AS c")
    return matching.plan(r, c, kind, 3, rules).collect()


def test_plan_of_many_equal_darks(spark):
    got = _plan_of_equal_frames(spark, "dark", 2000)  # all sets of all anchors would be eight billion tests a reference
    assert len(got) == 300 and {(x["n_sensor"], x["n_matched"], x["n_selected"], x["ready"]) for x in got} == {(2000, 2000, 2000, True)}
    assert {x["selected"] for x in got} == {",".join(map(str, range(2000)))}


def test_plan_of_many_equal_flats(spark):
    got = _plan_of_equal_frames(spark, "flat", 1500)
    assert len(got) == 300 and {(x["n_matched"], x["n_optics"], x["selected"]) for x in got} == {(1500, 0, ",".join(map(str, range(1500))))}


def test_nearest_neighbours_of_crowded_points(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(50, 0.3, (300, 2)), rng.uniform(0, 400, (300, 2)), np.tile([[10.0, 10.0]], (40, 1)), np.round(rng.uniform(200, 210, (100, 2)))])
    rows = [(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    found = spatial.nearest_neighbours(spark.createDataFrame(rows, "g int, id long, x double, y double"), ["g"], 3, 64.0)
    assert plan_of(found).count("Window ") > 2  # more than one width
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["near"], round(r["distance"], 9))
    for i in range(len(p)):
        d = sorted((float(np.hypot(*(p[i] - p[j]))), j) for j in range(i % 2, len(p), 2) if j != i)
        assert got.get(i, {}) == {n + 1: (j, round(v, 9)) for n, (v, j) in enumerate(d[:3]) if v <= 64.0}
    heap = spark.range(30_000).selectExpr("0 AS g", "id", "1D AS x", "1D AS y")  # 900 million pairs in one place
    assert spatial.nearest_neighbours(heap, ["g"], 3, 64.0).agg(F.count("*"), F.max("near"), F.max("distance")).first()[:] == (90_000, 3, 0.0)


def test_cone_topk_tries_bright_stars_first(spark):
    s = sphere(spark, 4000, 4).withColumn("mag", F.when(F.col("id") % 500 == 3, None).otherwise(F.round("mag", 1)))
    c = spark.range(40).selectExpr("id AS sid", "CAST(id * 9 AS DOUBLE) AS ra0", "CAST(id * 4 - 80 AS DOUBLE) AS dec0").union(spark.sql("SELECT 99L, 0D, 90D"))
    found = spatial.cone_topk(c, s, 35.0, 3)
    assert plan_of(found).count("Union") >= 1  # more than one cut
    from pyspark.sql.window import Window

    near = c.crossJoin(s).where(separation("ra", "dec", "ra0", "dec0") <= 35.0)
    want = near.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("mag", "id"))).where("rank <= 3")
    pick = lambda df: sorted(tuple(r) for r in df.select("sid", "id", "rank").collect())
    assert pick(found) == pick(want) and len(pick(want)) == 123



def test_triangle_counts_equal_the_pairs_at_the_tolerances_edge(spark):
    rng = np.random.default_rng(9)
    shapes = [(0.5, 0.25), (0.501, 0.25), (0.502, 0.25), (np.nextafter(0.502, 1), 0.25), (np.nextafter(0.502, 0), 0.25), (0.5 + 1e-10, 0.248), (0.5, np.nextafter(0.248, 0)), (0.9, 0.7), (float("nan"), 0.25)]
    pick = lambda: [(int(g), i, *shapes[k]) for g in range(40) for i, k in enumerate(rng.integers(0, len(shapes), 3))] + [(40 + g, 0, *rng.uniform(0.12, 0.2, 2).tolist()) for g in range(40)]
    a, b = (spark.createDataFrame([(g, i, float(x), float(y)) for g, i, x, y in pick()], "grp long, i int, ratio_ba double, ratio_ca double") for _ in range(2))
    plain = a.crossJoin(b.select(*[F.col(c).alias("r_" + c) for c in b.columns])).where("abs(ratio_ba - r_ratio_ba) <= 0.002 and abs(ratio_ca - r_ratio_ca) <= 0.002")
    want = sorted(map(tuple, plain.groupBy("grp", "r_grp").count().collect()))
    assert sorted(map(tuple, solving.triangle_counts(a, b, "grp", 0.002).collect())) == want and len(want) > 1000


def test_triangle_counts_of_many_equal_groups(spark):
    many = spark.range(3000).selectExpr("id AS grp", "explode(sequence(0, 9)) AS i").selectExpr("grp", "i", "0.5e0 + i * 1e-12 AS ratio_ba", "0.3e0 AS ratio_ca")
    got = solving.triangle_counts(many, many, "grp", 0.002).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (9_000_000, 100, 100)  # 900 million pairs of triangles by a plain join


def test_triangle_counts_take_little_space(spark, tmp_path):
    shapes = spark.range(4000).selectExpr("id AS grp", "0.5e0 + (id % 2) * 0.2e0 AS ratio_ba", "0.3e0 AS ratio_ca")
    solving.triangle_counts(shapes, shapes, "grp", 0.002).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 8_000_000 and out.where("l_grp % 2 <> r_grp % 2 or n <> 1").isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 8_000_000 * 0.2


def test_quad_counts_equal_the_lookup(spark):
    rng = np.random.default_rng(8)
    points = [(g, i, float(x), float(y), float(i)) for g in range(30) for i, (x, y) in enumerate(rng.uniform(0, 9, (5, 2)) if g % 3 else [(0, 0), (4, 1), (2, 5), (6, 6), (1, 7)])]
    q = solving.quads(solving.top_points(spark.createDataFrame(points, "grp long, id long, x double, y double, mag double"), "grp", 5), "grp", 5)
    want = sorted(map(tuple, solving.quad_lookup(q, q).groupBy("i_grp", "n_grp").count().collect()))
    assert sorted(map(tuple, solving.quad_counts(q, q, "grp").collect())) == want and len(want) >= 100


def test_quad_counts_of_many_equal_groups(spark):
    many = spark.range(3000).selectExpr("id AS grp", "explode(sequence(0, 9)) AS quad").selectExpr("grp", "quad", "array(0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0) AS desc").withColumn("key", solving.descriptor_key(F.col("desc")))
    got = solving.quad_counts(many, many, "grp").agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (9_000_000, 100, 100)  # 900 million rows by a plain join


def test_greedy_pairs_of_many_points():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 40, (300, 2)) / 4, rng.integers(0, 40, (200, 2)) / 4
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    taken = {}
    for i in range(len(a)):
        j = int(d[i].argmin())
        if d[i, j] <= 0.25 and d[i, j] < d[taken.get(j, i), j] + (j not in taken):
            taken[j] = i
    i, j = kernels.greedy_pairs(a, b, 0.25)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted((v, k) for k, v in taken.items())
    many = rng.uniform(0, 1000, (60_000, 2))
    i, j = kernels.greedy_pairs(many + 1e-6, many, 0.01)  # 29 GB of distances between all pairs
    assert len(i) > 59_900 and (i == j).all()


def test_nearest_rows_of_noisy_and_equal_points():
    rng = np.random.default_rng(5)
    b = np.concatenate([rng.uniform(0, 30, (700, 2)), rng.normal(9, 1e-3, (200, 2)), np.full((5, 2), 4.0), [[np.nan, 1.0]]])
    a = np.concatenate([b[:400] + 1e-12, b[400:] + rng.normal(0, 1e-3, (506, 2)), rng.uniform(-2, 32, (90, 2)), [[np.inf, 3.0]]])
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    d = np.where(d <= 0.5, d, np.inf)
    j, near = kernels._nearest(a, b, 0.5)
    assert np.array_equal(near, d.min(1)) and np.array_equal(j[np.isfinite(near)], d.argmin(1)[np.isfinite(near)])
    finite = np.isfinite(a).all(1)
    j, near = kernels._nearest(a[finite], b[:-1], 0.5)
    assert np.array_equal(near, d[finite].min(1)) and np.array_equal(j[np.isfinite(near)], d[finite].argmin(1)[np.isfinite(near)])
