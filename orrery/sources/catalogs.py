"""Readers of upstream catalogue formats: rows of text to typed columns; rows that do not parse go.

Each takes a DataFrame of lines (``value``, as ``spark.read.text`` gives it), so gz files and folders are Spark's to read
and split. Column ranges, prefixes and codes are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.astro import julian_date, propagate
from ..functions.names import merge_key, sexagesimal


def _field(first: int, last: int, line: str = "value") -> Column:
    """Bytes ``first`` to ``last``, counted from 1, without blanks."""
    return F.trim(F.substring(F.col(line), first, last - first + 1))


def _number(first: int, last: int, kind: str = "double") -> Column:
    return _field(first, last).try_cast(kind)


def html_table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, cells array<string>): the rows of a page's tables, cells without their tags."""
    rows = pages.select(F.col(key), F.posexplode(F.split(F.col(html), "(?i)<tr")).alias("row_no", "row")).where("row_no > 0")
    cells = F.transform(F.split(F.regexp_replace("row", "(?is)^[^>]*>", ""), "(?i)</t[dh]>"), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return rows.select(key, "row_no", cells.alias("cells"))


def transients(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Transient objects of a table page: twelve cells at least, hours to degrees, a line of details."""
    r = html_table_rows(pages, key, html).where("size(cells) >= 12 and cells[0] <> ''")
    c = F.col("cells")
    ra, dec = sexagesimal(c[2]) * 15.0, sexagesimal(c[3])
    name = F.when(c[0].startswith("AT") | c[0].startswith("SN"), c[0]).otherwise(F.concat(F.lit("SN "), c[0]))
    details = F.array_compact(F.array(F.when((c[7] != "") & (c[7] != "unk"), F.concat(F.lit("type "), c[7])), F.when(c[11] != "", F.concat(F.lit("disc. "), c[11])), F.when((c[1] != "") & (c[1] != "none"), F.concat(F.lit("in "), c[1]))))
    out = r.select(name.alias("name"), ra.alias("ra"), dec.alias("dec"), F.regexp_replace(c[5], r"\*+$", "").try_cast("double").alias("mag"), F.array_join(details, ", ").alias("common_name"))
    return out.where("ra is not null and dec is not null")


def gaia_csv(lines: DataFrame, epoch: float, max_mag: float) -> DataFrame:
    """ra, dec, mag at ``epoch`` of rows ra,dec,pmra,pmdec,mag given for 2016.0."""
    f = F.split("value", ",")
    v = lambda i: F.get(f, F.lit(i)).try_cast("double")
    t = lines.select(v(0).alias("ra"), v(1).alias("dec"), F.coalesce(v(2), F.lit(0.0)).alias("pmra"), F.coalesce(v(3), F.lit(0.0)).alias("pmdec"), v(4).alias("mag")).where("ra is not null and dec is not null and mag <= " + repr(max_mag))
    ra, dec = propagate(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), epoch - 2016.0)
    return t.select(ra.alias("ra"), dec.alias("dec"), "mag")


def tycho2(lines: DataFrame, epoch: float) -> DataFrame:
    """The main catalogue's fixed columns: identifiers, position at ``epoch``, V magnitude or else B."""
    ra, dec = _number(16, 27), _number(29, 40)
    moved = propagate(ra, dec, F.coalesce(_number(42, 48), F.lit(0.0)), F.coalesce(_number(50, 56), F.lit(0.0)), epoch - 2000.0)
    mean = ra.isNotNull() & dec.isNotNull()
    out = lines.select(
        _number(1, 4, "int").alias("region"), _number(6, 10, "int").alias("number"), _number(12, 12, "int").alias("component"), F.when(mean, moved[0]).otherwise(_number(153, 164)).alias("ra"), F.when(mean, moved[1]).otherwise(_number(166, 177)).alias("dec"),
        F.coalesce(_number(124, 129), _number(111, 116)).alias("mag"), _number(143, 148, "int").alias("hip"),
    )
    return out.where("region is not null and number is not null and component is not null and ra is not null and dec is not null and mag is not null")


def tycho2_supplement(lines: DataFrame, epoch: float) -> DataFrame:
    """The supplement's columns: positions for 1991.25."""
    moved = propagate(_number(16, 27), _number(29, 40), F.coalesce(_number(42, 48), F.lit(0.0)), F.coalesce(_number(50, 56), F.lit(0.0)), epoch - 1991.25)
    out = lines.select(_number(1, 4, "int").alias("region"), _number(6, 10, "int").alias("number"), _number(12, 12, "int").alias("component"), moved[0].alias("ra"), moved[1].alias("dec"), F.coalesce(_number(97, 102), _number(84, 89)).alias("mag"), _number(116, 121, "int").alias("hip"))
    return out.where("ra is not null and dec is not null and mag is not null and region is not null")


#: OpenNGC types and what they are here; types not named are ``other``, the last group is left out.
OPENNGC_KINDS = {
    "galaxy": ["G", "GPair", "GTrpl", "GGroup"], "open-cluster": ["OCl"], "globular-cluster": ["GCl"], "planetary-nebula": ["PN"], "hii-region": ["HII"],
    "supernova-remnant": ["SNR"], "dark-nebula": ["DrkN"], "nebula": ["Neb", "EmN", "RfN"], "cluster-with-nebula": ["Cl+N"], "association": ["*Ass"],
}
OPENNGC_SKIP = ["*", "**", "Dup", "NonEx"]


def openngc(lines: DataFrame) -> DataFrame:
    """Rows of the semicolon-separated catalogue: id, kind, ra, dec, mag, sizes, name, common_name, aliases, properties."""
    f = F.split("value", ";")
    t = lines.select(f.alias("f")).where(F.size("f") >= 30)
    at = lambda i: F.get("f", F.lit(i))
    kind = F.lit("other")
    for shown, codes in OPENNGC_KINDS.items():
        kind = F.when(at(1).isin(codes), shown).otherwise(kind)
    raw = at(0)
    catalog = F.when(raw.startswith("NGC"), F.concat(F.lit("NGC "), F.regexp_replace(F.substring(raw, 4, 99), "^0+", ""))).when(raw.startswith("IC"), F.concat(F.lit("IC "), F.regexp_replace(F.substring(raw, 3, 99), "^0+", ""))).otherwise(raw)
    messier = F.regexp_replace(F.coalesce(at(23), F.lit("")), "^0+", "")
    name = F.when(messier != "", F.concat(F.lit("M "), messier)).otherwise(catalog)
    out = t.where(~at(1).isin(OPENNGC_SKIP)).select(
        F.concat(F.lit("openngc:"), merge_key(catalog)).alias("id"), kind.alias("kind"), (sexagesimal(at(2)) * 15.0).alias("ra"), sexagesimal(at(3)).alias("dec"), F.coalesce(at(9).try_cast("double"), at(8).try_cast("double")).alias("mag"),
        at(5).try_cast("double").alias("major_arcmin"), at(6).try_cast("double").alias("minor_arcmin"), at(7).try_cast("double").alias("position_angle_deg"), name.alias("name"), F.coalesce(F.trim(at(28)), F.lit("")).alias("common_name"),
        F.array_compact(F.array(F.when(catalog != name, catalog))).alias("aliases"),
    )
    return out.where("ra is not null and dec is not null")


def property_bag(lines: DataFrame, header: list[str], sep: str = ";") -> DataFrame:
    """The header-named fields of separated lines as a map, blanks left out."""
    f = F.split("value", f"[{sep}]")
    bag = F.map_from_arrays(F.array(*map(F.lit, header)), F.transform(F.sequence(F.lit(0), F.lit(len(header) - 1)), lambda i: F.coalesce(F.trim(F.get(f, i)), F.lit(""))))
    return lines.select("value", F.map_filter(bag, lambda _, v: v != "").alias("properties"))


def vizier_tsv(lines: DataFrame, columns: list[tuple[str, str]], required: list[str]) -> DataFrame:
    """Tab-separated catalogue exports: comments, headers and rulers fail the casts of the required columns and go."""
    f = F.split("value", "\t")
    out = lines.where(~F.col("value").startswith("#")).select(*[F.trim(F.get(f, F.lit(i))).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])
    return out.where(" and ".join(f"{c} is not null" for c in required))


def iau_names(lines: DataFrame) -> DataFrame:
    """Approved star names: the name's 18 bytes, then fields counted back from the date of approval."""
    tokens = F.split(F.trim("value"), r"\s+")
    date = F.coalesce(F.array_position(F.transform(tokens, lambda t: t.rlike(r"^....-..-..$")), True), F.lit(0)).cast("int")
    t = lines.where(~F.col("value").startswith("#") & (F.length("value") >= 40)).select(_field(1, 18).alias("name"), tokens.alias("t"), date.alias("d")).where("d > 6 and name <> ''")
    at = lambda back: F.get("t", F.col("d") - 1 - back).try_cast("double")
    return t.select("name", at(2).alias("ra"), at(1).alias("dec"), at(6).alias("mag"), F.concat(F.lit("iau-csn:"), F.col("name")).alias("id")).where("ra is not null and dec is not null")


BODY = ["kind", "name", "epoch_jd", "q_or_a", "eccentricity", "inclination_deg", "node_deg", "arg_perihelion_deg", "mean_anomaly_deg", "h_mag", "slope"]


def _bodies(df: DataFrame, **cols: Column) -> DataFrame:
    out = df.select(*[cols[c].alias(c) for c in BODY])
    return out.where("name <> '' and " + " and ".join(f"{c} is not null" for c in BODY[2:9]))


def comets(lines: DataFrame) -> DataFrame:
    """The fixed columns of comet elements."""
    day = julian_date(_number(15, 18, "int"), _number(20, 21, "int"), _number(23, 29))
    return _bodies(
        lines.where(F.length("value") >= 103), kind=F.lit("comet"), name=_field(103, 158), epoch_jd=day, q_or_a=_number(31, 39), eccentricity=_number(41, 49), inclination_deg=_number(72, 79), node_deg=_number(62, 69),
        arg_perihelion_deg=_number(52, 59), mean_anomaly_deg=F.lit(0.0), h_mag=F.coalesce(_number(92, 95), F.lit(12.0)), slope=F.coalesce(_number(97, 100), F.lit(4.0)),
    )


_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def unpack_number(packed: Column) -> Column:
    """A packed asteroid number: the first character counts in base 62, the rest is decimal."""
    head = F.call_function("instr", F.lit(_ALPHABET), F.substring(packed, 1, 1)) - 1
    tail = F.coalesce(F.substring(packed, 2, 4).try_cast("int"), F.lit(0))
    return F.when(packed.rlike(r"^[0-9A-Za-z][0-9]{0,4}$"), head * F.pow(F.lit(10), F.length(packed) - 1).cast("int") + tail)


def unpack_epoch(packed: Column) -> Column:
    """A packed date (century letter, year, month, day) as a Julian date."""
    code = lambda i: F.call_function("instr", F.lit("123456789ABCDEFGHIJKLMNOPQRSTUV"), F.substring(packed, i, 1))
    century = F.when(packed.startswith("I"), 1800).when(packed.startswith("J"), 1900).when(packed.startswith("K"), 2000)
    return F.when(packed.rlike(r"^[IJK][0-9]{2}[1-9A-V]{2}$"), julian_date(century + F.substring(packed, 2, 2).try_cast("int"), code(4), code(5)))


def asteroids(lines: DataFrame, max_h: float) -> DataFrame:
    """Numbered asteroids up to an absolute magnitude."""
    number = unpack_number(_field(1, 7))
    said = _field(167, 194)
    name = F.when(said.rlike(r"^\d+ "), F.regexp_replace(said, r"^(\d+) +", "($1) ")).when(said != "", said).otherwise(F.concat(F.lit("("), number.cast("string"), F.lit(")")))
    t = lines.where(F.length("value") >= 104).withColumn("n", number).where("n is not null").where(_number(9, 13) <= max_h)
    return _bodies(
        t, kind=F.lit("asteroid"), name=name, epoch_jd=unpack_epoch(_field(21, 25)), q_or_a=_number(93, 103), eccentricity=_number(71, 79), inclination_deg=_number(60, 68), node_deg=_number(49, 57), arg_perihelion_deg=_number(38, 46),
        mean_anomaly_deg=_number(27, 35), h_mag=_number(9, 13), slope=F.coalesce(_number(15, 19), F.lit(0.15)),
    )


def sbdb_comets(lines: DataFrame) -> DataFrame:
    """Comets as JSON rows (arrays of strings)."""
    r = lines.select(F.from_json("value", "array<string>").alias("r")).where("r is not null")
    v = lambda i: F.trim(F.get("r", F.lit(i))).try_cast("double")
    return _bodies(r, kind=F.lit("comet"), name=F.coalesce(F.trim(F.get("r", F.lit(0))), F.lit("")), epoch_jd=v(7), q_or_a=v(2), eccentricity=v(3), inclination_deg=v(4), node_deg=v(5), arg_perihelion_deg=v(6), mean_anomaly_deg=F.lit(0.0), h_mag=F.coalesce(v(8), F.lit(12.0)), slope=F.coalesce(v(9), F.lit(4.0)))


def star_areas(spark: SparkSession, path: str, max_mag: float) -> DataFrame:
    """ra, dec, mag of binary sky-area files: a header of 110 bytes, records of five, and section records (three bytes 255)
    that carry the declination's high byte and the magnitude of the rows after them."""
    import numpy as np
    import pyarrow as pa

    def decode(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data is None or len(data) < 110 or data[109] != 5:
                    raise ValueError("not a sky-area file of five-byte records")
                r = np.frombuffer(data, np.uint8, (len(data) - 110) // 5 * 5, 110).reshape(-1, 5).astype(np.int64)
                head = (r[:, :3] == 255).all(1)
                section = np.cumsum(head) - 1
                at = np.flatnonzero(head)
                high = np.concatenate([r[at, 3] - 128, [0]])[section]
                mag = np.concatenate([(r[at, 4] - 16) / 10.0, [0.0]])[section]
                ra = (r[:, 0] + r[:, 1] * 256 + r[:, 2] * 65536) * 360.0 / (2**24 - 1)
                dec = (r[:, 3] + r[:, 4] * 256 + high * 65536) * 90.0 / (128 * 65536 - 1)
                keep = ~head & (mag <= max_mag)
                yield pa.RecordBatch.from_pydict({"ra": ra[keep], "dec": dec[keep], "mag": mag[keep]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.1476").load(path).select("content").mapInArrow(decode, "ra double, dec double, mag double")
