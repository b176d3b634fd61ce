"""The object catalogue as tables: tiles by extent, names, details, curation, identifiers, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import object_key
from ..functions.sky import TileGrid

GRID = TileGrid(45)


def tile_rows(objects: DataFrame, grid: TileGrid = GRID) -> DataFrame:
    """(tile, id): every tile that an object's extent (or its place alone) may touch."""
    reach = F.greatest(F.coalesce(F.col("major_arcmin"), F.lit(0.0)) / 120.0, F.lit(1e-9))
    return objects.select("id", F.explode(grid.cover(F.col("ra"), F.col("dec"), reach)).alias("tile")).select("tile", "id")


def name_rows(objects: DataFrame, columns: list[str], lists: list[str] = []) -> DataFrame:
    """(key, id): the distinct keys of all non-blank designations."""
    plain = F.array_compact(F.array(*[F.when(F.trim(c) != "", F.col(c)) for c in columns]))
    every = F.concat(plain, *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists]) if lists else plain
    keys = F.filter(F.array_distinct(F.transform(every, object_key)), lambda k: k != "")
    return objects.select(F.explode(keys).alias("key"), "id")


def write(objects: DataFrame, path: str, columns: list[str] = ["name", "common_name"], lists: list[str] = []) -> None:
    """The sink: objects in spatial order, their tiles and their names as tables of their own, and one row of meta data."""
    grid = GRID
    placed = objects.withColumn("tile", grid.tile(F.col("ra"), F.col("dec")))
    placed.repartitionByRange("tile", "id").sortWithinPartitions("tile", "id").write.parquet(f"{path}/objects")
    tile_rows(objects).repartitionByRange("tile").sortWithinPartitions("tile", "id").write.parquet(f"{path}/tiles")
    name_rows(objects, columns, lists).repartitionByRange("key").sortWithinPartitions("key", "id").write.parquet(f"{path}/names")
    objects.agg(F.count("*").alias("objects"), F.lit(1).alias("schema_version"), F.lit(grid.bands).alias("bands")).coalesce(1).write.parquet(f"{path}/meta")


def in_cap(spark, path: str, ra: float, dec: float, radius: float) -> DataFrame:
    """Objects whose tiles meet a cap, each once: the tile list prunes the tile table, ids meet the objects."""
    tiles = spark.read.parquet(f"{path}/tiles").where(F.col("tile").isin(GRID.cover_literal(ra, dec, radius))).select("id").distinct()
    return spark.read.parquet(f"{path}/objects").join(tiles, "id", "left_semi")


def by_name(spark, path: str, name: str) -> DataFrame:
    keys = spark.read.parquet(f"{path}/names").where(F.col("key") == object_key(F.lit(name))).select("id").distinct()
    return spark.read.parquet(f"{path}/objects").join(keys, "id", "left_semi")


def complete(spark, path: str, prefix: str, limit: int) -> DataFrame:
    """(key, id) in key order that begin with a prefix."""
    return spark.read.parquet(f"{path}/names").where(F.col("key").startswith(object_key(F.lit(prefix)))).orderBy("key", "id").limit(limit)


def index_violations(objects: DataFrame, tiles: DataFrame, names: DataFrame) -> DataFrame:
    """rule, n: tile or name rows without an object, objects without a row of either."""
    ids = objects.select("id")
    parts = [
        ("tile-without-object", tiles.join(ids, "id", "left_anti")), ("name-without-object", names.join(ids, "id", "left_anti")),
        ("object-without-tile", ids.join(tiles.select("id"), "id", "left_anti")), ("object-without-name", ids.join(names.select("id"), "id", "left_anti")),
    ]
    out = None
    for rule, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n").where("n > 0")
        out = one if out is None else out.union(one)
    return out


def audit(objects: DataFrame, aliases: str, alternates: str, parents: str) -> DataFrame:
    """One row: aliases, alternate ids, and parent links that name no object."""
    counts = objects.agg(F.sum(F.size(aliases)).alias("aliases"), F.sum(F.size(alternates)).alias("alternate_ids"))
    e = objects.select(F.explode(parents).alias("id")).join(objects.select("id"), "id", "left_anti").agg(F.count("*").alias("unresolved_parents"))
    return counts.crossJoin(e)  # one row each


def details(records: DataFrame) -> DataFrame:
    """Source records (id, record_id, source, property, value, unit) folded to one row an object."""
    r = records.groupBy("id", "record_id", "source").agg(F.array_sort(F.collect_list(F.struct("property", "value", "unit"))).alias("properties"))
    return r.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("record_id", "source", "properties"))).alias("source_records"))


def attach(records: DataFrame, objects: DataFrame, record_id: str = "record_id", alternates: str = "alternate_ids") -> DataFrame:
    """Source records to objects: by exact primary id, else by a unique alternate id: record_id, id (null if neither)."""
    exact = objects.select(F.col("id"), F.col("id").alias("pid"))
    other = objects.select("id", F.explode(alternates).alias("alt")).groupBy("alt").agg(F.count_distinct("id").alias("n"), F.min("id").alias("aid")).where("n = 1")
    j = records.join(exact, F.col(record_id) == F.col("pid"), "left").join(other, F.col(record_id) == F.col("alt"), "left")
    return j.select(record_id, F.coalesce("id", "aid").alias("id"))


def curate(objects: DataFrame, overlay: DataFrame, columns: list[str]) -> DataFrame:
    """An overlay (id, columns, remove boolean) over the catalogue: set values win, rows marked go, new ids are added."""
    o = overlay.select(F.col("id").alias("oid"), F.col("remove"), *[F.col(c).alias("o_" + c) for c in columns])
    j = objects.join(o, F.col("id") == F.col("oid"), "full").where(~F.coalesce(F.col("remove"), F.lit(False)))
    return j.select(F.coalesce("id", "oid").alias("id"), *[F.coalesce(F.col("o_" + c), F.col(c)).alias(c) for c in columns])


def read_curation(spark, path: str) -> DataFrame:
    """Curation documents (TOML, an array ``object`` of tables with an id) as rows: path, id, fields map<string,string>."""
    import tomllib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = {"path": [], "id": [], "fields": []}
            for where, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for o in tomllib.loads(bytes(text).decode()).get("object", []):
                    rows["path"].append(where)
                    rows["id"].append(str(o["id"]))
                    rows["fields"].append([(k, str(v)) for k, v in o.items() if k != "id"])
            if rows["id"]:
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("path", pa.string()), ("id", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.toml").load(path).select("path", "content").mapInArrow(run, "path string, id string, fields map<string,string>")


def source_manifest(objects: DataFrame) -> DataFrame:
    """One row a source: objects, kinds as a JSON document."""
    k = objects.groupBy("source", "kind").agg(F.count("*").alias("n"))
    return k.groupBy("source").agg(F.sum("n").alias("objects"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("kinds"))


def identifier_rows(rows: DataFrame) -> DataFrame:
    """The identifier sidecar: exact records once, in key order."""
    return rows.dropDuplicates(["namespace", "value", "ra", "dec", "mag"]).repartitionByRange("namespace", "value").sortWithinPartitions("namespace", "value")


def unsorted_keys(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row: how many rows of an ordered table have a smaller key than the row before them."""
    from pyspark.sql.window import Window

    k = F.struct(*key)
    w = Window.partitionBy(F.floor(F.col(order) / 1_000_000)).orderBy(order)
    return rows.withColumn("k", k).withColumn("p", F.lag("k").over(w)).agg(F.count_if(F.col("p") > F.col("k")).alias("out_of_order"))


def body_violations(bodies: DataFrame) -> DataFrame:
    bad = [
        ("empty_name", F.coalesce(F.trim("name"), F.lit("")) == ""), ("bad_shape", F.coalesce((F.col("eccentricity") < 0) | (F.col("q_or_a") <= 0), F.lit(True))),
        ("open_asteroid", (F.col("kind") == "asteroid") & (F.col("eccentricity") >= 1)), ("bad_angle", ~F.coalesce(F.col("inclination_deg").between(0, 180), F.lit(False))),
    ]
    return bodies.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad]))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def write_bodies(bodies: DataFrame, path: str) -> None:
    """The sink of minor bodies, brightest first, so that a reader with a magnitude limit skips the rest."""
    bodies.repartitionByRange("h_mag", "name").sortWithinPartitions("h_mag", "name").write.parquet(path)


def read_bodies(spark, path: str, max_h: float | None = None) -> DataFrame:
    """Saved minor bodies, those up to an absolute magnitude if one is given (unknown ones are kept)."""
    b = spark.read.parquet(path)
    return b if max_h is None else b.where(F.col("h_mag").isNull() | (F.col("h_mag") <= max_h))
