"""Scored CSV, GeoJSON layers, boundaries and Markdown folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremap.functions import documents as D
from scoremap.functions import geometry as G
from scoremap.sources.ranges import RANGE_BYTES, csv_records, feature_texts


def read_scored_csv(spark: SparkSession, path: str, srid: int = G.STATE_PLANE, id_col: str | None = None, multi_line: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``segment_id, score, geometry, wkt`` of a headered CSV with a quoted WKT column.

    Several tasks read a large file. With ``multi_line`` quoted values may hold line breaks;
    then the file is read twice, in ranges of ``range_bytes``, and all files need the
    same header.

    Columns are found by the header. NaN and empty scores are null; a geometry that
    does not parse is null and keeps its text in ``wkt``. Without an id column the
    id is a digest of the row, as row order means nothing over many files.
    """
    if multi_line:
        records = csv_records(spark, path, range_bytes).where("value <> ''")
        header = spark.read.option("header", True).option("escape", '"').csv(path).schema
        cells = F.from_csv("value", ", ".join(f"`{c}` string" for c in header.names), {"escape": '"', "multiLine": "true"})
        first = F.concat_ws("\x1f", *[F.coalesce(cells[c], F.lit("")) for c in header.names])
        raw = records.where(first != "\x1f".join(header.names)).select(cells.alias("c")).select("c.*")
    else:
        raw = spark.read.option("header", True).option("escape", '"').csv(path)
    ident = F.col(id_col) if id_col else F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in raw.columns]), 256)
    score = F.expr("try_cast(score as double)")
    return raw.select(ident.alias("segment_id"), F.when(~F.isnan(score), score).alias("score"), G.wkt_to_geom(F.col("geometry"), srid).alias("geometry"), F.col("geometry").alias("wkt"))


_FEATURE_FIELDS = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_geojson(spark: SparkSession, path: str, lines: bool = False, srid: int = G.WGS84, range_bytes: int | None = None) -> DataFrame:
    """``properties map<string,string>, geometry``, one row per feature.

    ``lines``: one feature per line, which Spark can split; otherwise each file is a
    FeatureCollection, read whole by one task, or with ``range_bytes`` in ranges of so
    many bytes by many tasks.
    """
    if lines:
        features = spark.read.schema(_FEATURE_FIELDS).json(path)
    elif range_bytes:
        found = feature_texts(spark, path, range_bytes).select(F.from_json("value", _FEATURE_FIELDS).alias("f"))
        features = found.where("f.type = 'Feature'").select("f.*")
    else:
        whole = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
        features = whole.select(F.explode("features").alias("f")).select("f.*")
    g = F.col("geometry")
    return features.select("properties", G.geojson_to_geom(g["type"], g["coordinates"], srid).alias("geometry"))


def _broken(spark: SparkSession, path: str, lines: bool) -> bool:
    """Whether no record under ``path`` is JSON with what a layer needs."""
    need = "type" if lines else "features"
    found = spark.read.schema(f"{need} string").option("multiLine", not lines).json(path)
    return not found.isEmpty() and found.where(F.col(need).isNotNull()).isEmpty()


def read_layers(spark: SparkSession, paths: dict[str, str], lines: bool = False, srid: int = G.WGS84) -> dict[str, DataFrame | None]:
    """A frame per layer; None for one that cannot be loaded, be it that there is no such
    path or that nothing there is JSON with features, so that the others show."""

    def load(path: str) -> DataFrame | None:
        try:
            layer = read_geojson(spark, path, lines, srid)
            return None if _broken(spark, path, lines) else layer
        except AnalysisException:  # no such path, or none that can be read
            return None

    return {name: load(path) for name, path in paths.items()}


def read_boundaries(spark: SparkSession, path: str, name: str = "BoroName", lines: bool = False) -> DataFrame:
    """``boundary_id, boro_name, attrs, geometry`` in the plane's coordinates."""
    rows = read_geojson(spark, path, lines)
    attrs = F.map_filter("properties", lambda k, _: k != name)
    ident = F.sha2(F.concat(F.to_json("properties"), F.coalesce(G.geom_to_geojson(F.col("geometry")), F.lit(""))), 256)
    return rows.select(ident.alias("boundary_id"), F.col("properties")[name].alias("boro_name"), attrs.alias("attrs"), G.project(F.col("geometry")).alias("geometry"))


def read_docs(spark: SparkSession, root: str, glob: str = "[^_]*.md") -> DataFrame:
    """``id, title, author, tags, description, pub_date_text, img_url, draft_text,
    body`` of every Markdown file below ``root`` whose name does not begin with '_'."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    text = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), D.frontmatter(F.col("value")).alias("front"))
    front = F.col("front")
    return text.select(
        D.doc_id(F.col("path")).alias("id"),
        *[D.scalar(front, k).alias(n) for k, n in (("title", "title"), ("author", "author"))],
        D.block_list(front, "tags").alias("tags"),
        D.scalar(front, "description").alias("description"),
        D.scalar(front, "pubDate").alias("pub_date_text"),
        D.scalar(front, "imgUrl").alias("img_url"),
        D.scalar(front, "draft").alias("draft_text"),
        D.body(F.col("text")).alias("body"),
    )
