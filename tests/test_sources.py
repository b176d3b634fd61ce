import math

import numpy as np
import pytest

from orrery.functions import names
from orrery.sources import catalogs, elements, fits, manifests, xisf
from pyspark.sql import functions as F


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def fixed(**fields):
    """A line with texts at 1-based columns, as _column=text."""
    out = [" "] * 220
    for k, v in fields.items():
        at = int(k[1:]) - 1
        out[at : at + len(v)] = v
    return "".join(out)


def test_fits_round_trip(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "a.fits").write_bytes(fits.encode(a, [("OBJECT", "it's"), ("EXPTIME", 30.0), ("GAIN", 5), ("IMAGETYP", "Dark Frame"), ("DATE-OBS", "2024-01-02T03:04:05")]))
    (tmp_path / "bad.fits").write_bytes(b"no image")
    df = fits.metadata(fits.read(spark, str(tmp_path)))
    r = df.first()
    assert df.count() == 1 and (r["width"], r["height"], r["channels"]) == (4, 3, 1) and r["data"] == a.ravel().tolist()
    assert (r["exposure"], r["gain"], r["role"]) == (30.0, 5, "dark") and r["captured"] == 1704164645.0
    assert fits.read(spark, str(tmp_path), pixels=False).first()["data"] is None
    images = spark.createDataFrame([("x", 4, 3, 1, a.ravel().tolist())], "name string, width int, height int, channels int, data array<float>")
    fits.write(images, str(tmp_path / "out")).collect()
    assert fits.decode((tmp_path / "out" / "x.fits").read_bytes())["data"].tolist() == a.ravel().tolist()


@pytest.mark.parametrize("bitpix, kind", [(8, ">u1"), (16, ">i2"), (32, ">i4"), (-64, ">f8")])
def test_fits_sample_formats(bitpix, kind):
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in (("SIMPLE", "T"), ("BITPIX", bitpix), ("NAXIS", 2), ("NAXIS1", 2), ("NAXIS2", 1), ("BZERO", 10), ("BSCALE", 2))) + "END".ljust(80)
    data = head.ljust(2880).encode() + np.array([1, 3], kind).tobytes()
    assert fits.decode(data)["data"].tolist() == [12.0, 16.0]


def test_fits_values():
    assert fits.parse_value(" 'it''s  ' / note") == ("string", "it's") and fits.parse_value("1.5D2") == ("float", "150.0")
    assert fits.parse_value("T / yes") == ("bool", "true") and fits.parse_value("42") == ("int", "42")


@pytest.mark.parametrize("codec", [None, "zlib", "zlib+sh", "zstd+sh", "lz4", "lz4+sh"])
def test_xisf_round_trip(codec):
    a = np.random.default_rng(1).random((3, 5, 7)).astype(np.float32)
    data = xisf.encode(a, [("FILTER", "Ha")], codec)
    out = xisf.decode(data)
    assert (out["width"], out["height"], out["channels"], out["bounds"]) == (7, 5, 3, (0.0, 1.0)) and np.array_equal(out["data"], a.ravel())
    assert xisf.decode(data, image_id="image")["cards"] == [("FILTER", "Ha")]
    with pytest.raises(ValueError):
        xisf.decode(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(ValueError):
        xisf.decode(data, 4)


ISS = "1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927\n2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537"


def test_element_sets(spark):
    good, bad = elements.tle(spark.createDataFrame([("a", f"ISS (ZARYA)\n{ISS}\n1 broken\n"), ("b", ISS.replace("51.6416", "51.6417"))], "path string, value string"))
    r = good.collect()
    assert len(r) == 1 and (r[0]["norad_id"], r[0]["name"], r[0]["cospar_id"]) == (25544, "ISS (ZARYA)", "98067A")
    assert math.isclose(r[0]["eccentricity"], 0.0006703) and math.isclose(r[0]["bstar"], -1.1606e-5) and abs(r[0]["epoch"] - 1221913540.1) < 1
    assert {x["path"]: x["malformed"] for x in bad.collect()} == {"a": 1, "b": 1}
    omm = elements.omm(lines(spark, '[{"OBJECT_NAME":"X","OBJECT_ID":"1","EPOCH":"2024-01-01T00:00:00.000","NORAD_CAT_ID":7,"MEAN_MOTION":15.0},{"OBJECT_NAME":"no id"}]', '{"NORAD_CAT_ID":8,"EPOCH":"2024-01-01T00:00:00"}'))
    assert sorted(x["norad_id"] for x in omm.collect()) == [7, 8] and omm.where("norad_id = 7").first()["epoch"] == 1704067200.0


def test_catalogue_lines(spark):
    tycho = fixed(_1="0001", _6="00008", _12="1", _16="  2.31750494", _29="  2.23184345", _42="  -16.3", _50="   -9.0", _111="12.146", _124="12.146", _143="  1234")
    r = catalogs.tycho2(lines(spark, tycho, "short"), 2000.0).collect()
    assert len(r) == 1 and (r[0]["region"], r[0]["number"], r[0]["component"], r[0]["hip"]) == (1, 8, 1, 1234) and math.isclose(r[0]["ra"], 2.31750494)
    g = catalogs.gaia_csv(lines(spark, "ra,dec,pmra,pmdec,mag", "10,20,,,5", "359.9999999,0,3600000,0,6", "1,2,3,4,25"), 2017.0, 20.0).orderBy("mag").collect()
    assert [(round(x["ra"], 6), x["mag"]) for x in g] == [(10.0, 5.0), (1.0, 6.0)]
    f = [""] * 32
    f[0], f[1], f[2], f[3], f[5], f[9], f[23], f[28] = "NGC0224", "G", "00:42:44.35", "+41:16:08.6", "177.83", "3.44", "031", "Andromeda Galaxy"
    o = catalogs.openngc(lines(spark, ";".join(f), ";".join(["NGC0001", "Dup", *f[2:]]))).collect()
    assert len(o) == 1 and (o[0]["name"], o[0]["id"], o[0]["kind"], o[0]["aliases"]) == ("M 31", "openngc:NGC224", "galaxy", ["NGC 224"]) and abs(o[0]["ra"] - 10.6848) < 1e-3
    iau = catalogs.iau_names(lines(spark, "# head", f"{'Sirius':<18}Sirius  alf CMa A  06451-1643 -1.45 V 32349 48915 101.287155 -16.716116 2016-06-30 *")).collect()
    assert len(iau) == 1 and (iau[0]["name"], iau[0]["ra"], iau[0]["dec"]) == ("Sirius", 101.287155, -16.716116)
    comet = fixed(_15="1986", _20="02", _23=" 9.4589", _31=" 0.587104", _41=" 0.967277", _52="111.8657", _62=" 58.8601", _72="162.2422", _92=" 5.5", _97=" 8.0", _103="1P/Halley")
    c = catalogs.comets(lines(spark, comet)).first()
    assert (c["name"], c["q_or_a"], c["h_mag"]) == ("1P/Halley", 0.587104, 5.5) and abs(c["epoch_jd"] - 2446470.9589) < 1e-4
    ceres = fixed(_1="00001", _9=" 3.53", _15=" 0.15", _21="K239D", _27=" 60.07881", _38=" 73.42179", _49=" 80.25496", _60=" 10.58634", _71="0.0789126", _93="  2.7672543", _167="     1 Ceres".strip())
    a = catalogs.asteroids(lines(spark, ceres, ceres.replace("00001", "PLS2040")), 10.0).collect()
    assert len(a) == 1 and a[0]["name"] == "(1) Ceres" and a[0]["epoch_jd"] == 2460200.5
    n = spark.createDataFrame([("00001",), ("A0000",), ("a0012",), ("K07Tf8A",)], "p string").select(catalogs.unpack_number(F.col("p")).alias("n"))
    assert [x["n"] for x in n.collect()] == [1, 100000, 360012, None]
    s = catalogs.sbdb_comets(lines(spark, '["X","","1.5","0.9","10","20","30","2460000.5",null,null]', "junk")).collect()
    assert len(s) == 1 and s[0]["h_mag"] == 12.0
    v = catalogs.vizier_tsv(lines(spark, "#c", "name\tra", "----\t--", "A\t1.5"), [("name", "string"), ("ra", "double")], ["ra"]).collect()
    assert [tuple(x) for x in v] == [("A", 1.5)]
    cells = "".join(f"<td>{x}</td>" for x in ("2024a", "NGC 1", "00:30:00", "-10:00:00", "", "15.2*", "", "<b>Ia</b>", "", "", "", "2024/01/01"))
    t = catalogs.transients(spark.createDataFrame([(1, f"<table><tr><th>h</th></tr><tr>{cells}</tr></table>")], "page_id long, html string")).collect()
    assert [tuple(x) for x in t] == [("SN 2024a", 7.5, -10.0, 15.2, "type Ia, disc. 2024/01/01, in NGC 1")]
    bag = catalogs.property_bag(lines(spark, "1; ;x"), ["a", "b", "c"]).first()["properties"]
    assert bag == {"a": "1", "c": "x"}


def test_star_areas(spark, tmp_path):
    head = b"area".ljust(109, b" ") + bytes([5])
    body = bytes([255, 255, 255, 130, 66]) + bytes([0, 0, 128, 0, 0]) + bytes([255, 255, 255, 128, 216]) + bytes([1, 0, 0, 1, 0])
    (tmp_path / "x_0101.1476").write_bytes(head + body)
    r = catalogs.star_areas(spark, str(tmp_path), 10.0).collect()
    assert len(r) == 1 and r[0]["mag"] == 5.0 and abs(r[0]["ra"] - 180.0) < 1e-4 and abs(r[0]["dec"] - 2 * 65536 * 90 / (128 * 65536 - 1)) < 1e-9


def test_names(spark):
    cases = [("NGC 0224", "NGC224", "NGC0224"), ("Sh2-005", "SH25", "SH2-005"), ("M 000", "M0", "M000"), ("61 Cyg A-B", "61CYGAB", "61CYGA-B"), ("BD+05-1234", "BD51234", "BD+05-1234"), ("é 1", "É1", "É1")]
    df = spark.createDataFrame([(c[0],) for c in cases], "n string")
    got = df.select(names.object_key(F.col("n")).alias("o"), names.star_key(F.col("n")).alias("s")).collect()
    assert [(r["o"], r["s"]) for r in got] == [(c[1], c[2]) for c in cases]
    ids = spark.createDataFrame([(x,) for x in ("TYC 1-13-1", "hip 32349", "Gaia DR3 123", "HD 0", "TYC 1-13-9", "none")], "n string").select(names.parse_identifier(F.col("n")).alias("p"))
    ids = [r["s"] for r in ids.select(names.show_identifier(F.col("p.namespace"), F.col("p.value")).alias("s")).collect()]
    assert ids == ["TYC 1-13-1", "HIP 32349", "Gaia DR3 123", None, None, None]
    s = spark.createDataFrame([("12:30:00",), ("-00 30 30.6",), ("x",)], "n string").select(names.sexagesimal(F.col("n")).alias("v"))
    assert [r["v"] for r in s.collect()] == [12.5, -(0.5 + 30.6 / 3600), None]
    a = spark.createDataFrame([(" a  b, ;c|d",)], "n string").select(names.aliases(F.col("n")).alias("v")).first()["v"]
    assert a == ["a b", "c", "d"]


def test_manifests(spark):
    h = "0" * 64
    m = manifests.parse(lines(spark, f'{{"version":"1","files":[{{"name":"stars","key":"k","bytes":5,"sha256":"{h}"}},{{"name":"../x","key":"k","bytes":0,"sha256":"q"}}]}}', "junk"))
    assert m.count() == 2 and {r["rule"] for r in manifests.violations(m).collect()} == {"unsafe-name", "bad-size", "bad-hash"}
    have = spark.createDataFrame([("stars", h)], "name string, sha256 string")
    assert {r["name"]: r["action"] for r in manifests.plan(m, have, ["stars", "none"]).collect()} == {"stars": "use", "none": "missing"}
    e = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0)], "ord int, t double")
    assert manifests.nearest_entry(e, 15.0, 9.0).first()["ord"] == 3
