"""Readers of geometry files into entities (id, wkb, env, npoints, dim, ts), and writers of links."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..plans.config import file_kind

#: Fixed value: the predicate of geometries in N-Triples when none is given.
GEOMETRY_PREDICATE = "<http://strdf.di.uoa.gr/ontology#hasGeometry>"
DATE_PATTERN = "yyyy-MM-dd HH:mm:ss"
_SHAPE = "struct<wkb:binary,env:struct<minx:double,miny:double,maxx:double,maxy:double>,npoints:int,dim:int>"


def parsed(wkt: Column | str) -> Column:
    """WKB, envelope, points and dimension of WKT; all null for what is no valid geometry or is a collection."""

    @F.pandas_udf(_SHAPE)
    def run(text):
        import pandas as pd

        from ..functions import geometry as G

        rows = []
        for t in text:
            g = G.from_wkt(t) if t else None
            if g is None or not g[1] or g[0] == "GEOMETRYCOLLECTION" or not G.coordinates(g) or not G.is_valid(g):
                rows.append((None, None, None, None))
                continue
            e = dict(zip(("minx", "miny", "maxx", "maxy"), G.envelope(g), strict=True))
            rows.append((G.to_wkb(g), e, len(G.coordinates(g)), G.dimension(g)))
        return pd.DataFrame(rows, columns=["wkb", "env", "npoints", "dim"])

    return run(wkt)


def entities(rows: DataFrame, date_pattern: str | None = None) -> DataFrame:
    """Entities from rows (id, wkt, date); unparsable, empty or invalid geometries and collections are dropped."""
    date = F.try_to_timestamp(F.col("date"), F.lit(date_pattern or DATE_PATTERN)) if "date" in rows.columns else F.lit(None).cast("timestamp")
    shaped = rows.where("id is not null and wkt is not null").select(F.col("id").cast("string").alias("id"), parsed("wkt").alias("g"), date.alias("ts"))
    return shaped.where("g.wkb is not null").select("id", "g.wkb", "g.env", "g.npoints", "g.dim", "ts")


def read_delimited(spark: SparkSession, path: str, id_at: int, geometry_at: int, sep: str = "\t", header: bool = False, date_at: int | None = None, date_pattern: str | None = None) -> DataFrame:
    """CSV or TSV by column positions; quoted fields may hold the delimiter."""
    raw = spark.read.option("sep", sep).option("header", header).option("quote", '"').csv(path)
    names = raw.columns
    if len(names) <= max(id_at, geometry_at):
        raise ValueError(f"{path}: {len(names)} columns, wanted numbers {id_at} and {geometry_at}")
    date = F.col(f"`{names[date_at]}`") if date_at is not None else F.lit(None).cast("string")
    return entities(raw.select(F.col(f"`{names[id_at]}`").alias("id"), F.col(f"`{names[geometry_at]}`").alias("wkt"), date.alias("date")), date_pattern)


def read_ntriples(spark: SparkSession, path: str, predicate: str = GEOMETRY_PREDICATE) -> DataFrame:
    """Geometries of N-Triples: subjects by one predicate; a datatype or CRS around the WKT is left out."""
    bare = predicate.strip("<>")
    parts = F.split(F.col("value"), " ", 3)
    literal = F.regexp_extract(parts[2], r'"([^"]*)"', 1)
    wkt = F.trim(F.regexp_replace(literal, r"^<[^>]*>\s*", ""))
    rows = spark.read.text(path).where(F.regexp_replace(parts[1], "[<>]", "") == bare)
    return entities(rows.select(F.regexp_replace(parts[0], "[<>]", "").alias("id"), wkt.alias("wkt")).where("wkt != '' and not wkt like '%EMPTY'"))


def _geojson_wkt(g: Column) -> Column:
    """WKT text of a GeoJSON geometry kept as a JSON string."""
    kind, coordinates = F.get_json_object(g, "$.type"), F.get_json_object(g, "$.coordinates")
    number = r"(-?[0-9.eE+-]+)"
    pairs = F.regexp_replace(coordinates, rf"\[\s*{number}\s*,\s*{number}\s*(?:,[^\[\]]*)?\]", "$1 $2")
    body = F.translate(pairs, "[]", "()")
    return F.concat(F.upper(kind), F.lit(" "), F.when(kind == "Point", F.concat(F.lit("("), body, F.lit(")"))).otherwise(body))


def read_geojson(spark: SparkSession, path: str, id_field: str, date_field: str | None = None, date_pattern: str | None = None) -> DataFrame:
    """Features of GeoJSON files: one feature a line, alone or as a line of a collection, or whole collections.

    Lines are read apart, so a large file is split. Only where some feature goes over several lines is each file one text.
    """
    schema = "struct<type:string,features:array<string>,geometry:string>"
    line = F.regexp_replace(F.trim("value"), r",$", "")
    lines = spark.read.text(path).select(line.alias("value"), F.from_json(line, schema).alias("j"))
    whole = (F.col("j.type") == "Feature") & F.col("j.geometry").isNotNull() | F.col("j.features").isNotNull()
    if not lines.where(F.contains("value", F.lit('"coordinates"')) & ~F.coalesce(whole, F.lit(False))).isEmpty():
        lines = spark.read.text(path, wholetext=True).select("value", F.from_json("value", schema).alias("j"))
    many = lines.where("j.features is not null").select(F.explode("j.features").alias("f"))
    single = lines.where("j.type = 'Feature' and j.features is null").select(F.col("value").alias("f"))
    many = many.unionByName(single)
    feature = F.from_json("f", "struct<id:string,geometry:string,properties:map<string,string>>")
    rows = many.select(feature.alias("f"))
    own = F.coalesce(F.col("f.properties")[id_field], F.when(F.lit(id_field) == "id", F.col("f.id")))
    date = F.col("f.properties")[date_field] if date_field else F.lit(None).cast("string")
    return entities(rows.select(own.alias("id"), _geojson_wkt(F.col("f.geometry")).alias("wkt"), date.alias("date")), date_pattern)


def read_shapefile(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """ESRI shapefiles: geometries of .shp joined by place with the attributes of the .dbf beside it."""
    files = spark.read.format("binaryFile").load(path if re.search(r"\.shp$", path, re.I) is None else re.sub(r"\.shp$", ".*", path, flags=re.I))
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    by_kind = lambda ext: files.where(F.lower("path").endswith(ext)).select(stem.alias("stem"), F.col("content").alias(ext[1:]))

    @F.pandas_udf("array<struct<id:string,wkt:string>>")
    def rows(shp, dbf):
        import pandas as pd

        from . import shapefile

        return pd.Series([shapefile.records(bytes(s), bytes(d), id_field) for s, d in zip(shp, dbf, strict=True)])

    both = by_kind(".shp").join(by_kind(".dbf"), "stem")
    return entities(both.select(F.explode(rows("shp", "dbf")).alias("r")).select("r.id", "r.wkt"))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the regular files of a directory, hidden ones left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(place)
    return [n for s in listed if s.isFile() and not (n := s.getPath().getName()).startswith(("_", "."))]


def read_dataset(spark: SparkSession, path: str, id_field: str, geometry_field: str, date_field: str | None = None, date_pattern: str | None = None, file_type: str | None = None) -> DataFrame:
    """A dataset by its files' extension or `file_type`; a directory stands for all its files, a glob for those it matches."""
    kind = file_kind(path, file_type)
    if kind is None:  # a directory: all its files, each by its own kind
        kinds = sorted({file_kind(f) or "" for f in files_of(spark, path)} - {"dbf", "shx", "prj", "cpg"})
        parts = [read_dataset(spark, f"{path.rstrip('/')}/*.{k}", id_field, geometry_field, date_field, date_pattern, k) for k in kinds if k]
        if not parts:
            raise ValueError(f"{path}: no file with a known extension")
        return reduce(DataFrame.unionByName, parts)
    if kind in ("csv", "tsv"):
        at = int(date_field) if date_field else None
        return read_delimited(spark, path, int(id_field), int(geometry_field), "," if kind == "csv" else "\t", date_at=at, date_pattern=date_pattern)
    if kind == "nt":
        return read_ntriples(spark, path, geometry_field or GEOMETRY_PREDICATE)
    if kind == "geojson":
        return read_geojson(spark, path, id_field, date_field, date_pattern)
    if kind == "shp":
        return read_shapefile(spark, path, id_field)
    raise ValueError(f"no reader for {kind!r}; there are csv, tsv, nt, geojson and shp")


#: Relation names and their GeoSPARQL properties.
PROPERTIES = {n: f"http://www.opengis.net/ont/geosparql#sf{c}" for n, c in zip(M.NAMES, ("Contains", "CoveredBy", "Covers", "Crosses", "Equals", "Intersects", "Overlaps", "Touches", "Within"), strict=True)}


def triples(links: DataFrame) -> DataFrame:
    """A line of N-Triples for each relation that holds (source_id, target_id and the nine booleans)."""
    each = F.array(*[F.struct(F.col(n).alias("holds"), F.lit(p).alias("p")) for n, p in PROPERTIES.items()])
    return links.select("source_id", "target_id", F.explode(F.filter(each, lambda r: r["holds"])).alias("r")).select(F.format_string("<%s> <%s> <%s> .", "source_id", "r.p", "target_id").alias("value"))


def write_rdf(links: DataFrame, path: str) -> None:
    triples(links).write.mode("overwrite").text(path)


def write_ntriples(pairs: DataFrame, path: str, predicate: str = "http://www.opengis.net/ont/geosparql#belongsToAdministrativeUnit") -> None:
    pairs.select(F.format_string("<%s> <%s> <%s> .", "source_id", F.lit(predicate), "target_id").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(pairs: DataFrame, path: str) -> None:
    pairs.select(F.col("source_id").alias("id1"), F.col("target_id").alias("id2")).write.mode("overwrite").option("header", True).csv(path)


def write_matches(pairs: DataFrame, path: str) -> None:
    pairs.select("source_id", "target_id", F.lit(1.0).alias("score")).coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)
