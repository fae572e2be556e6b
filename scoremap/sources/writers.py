"""GeoJSON features, layer bundles and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.functions import documents as D
from scoremap.functions import geometry as G
from scoremap.functions import scores as S


def feature(geometry: Column, **props: Column) -> Column:
    """The GeoJSON text of one feature; null properties are written as null."""
    properties = F.to_json(F.struct(*[c.alias(n) for n, c in props.items()]), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(G.geom_to_geojson(geometry), F.lit("null")), F.lit("}"))


def write_features(df: DataFrame, path: str, geometry: str = "geometry", props: list[str] | None = None) -> None:
    """One feature per line, any number of files."""
    names = [c for c in df.columns if c != geometry] if props is None else props
    df.select(feature(F.col(geometry), **{n: F.col(n) for n in names}).alias("value")).write.text(path)


def write_layers(layers: DataFrame, path: str) -> None:
    """``layer, feature`` partitioned by layer, so that a selection of layers reads
    only its own files; the palette as a table beside them."""
    layers.write.partitionBy("layer").parquet(f"{path}/features")
    spark = layers.sparkSession
    spark.range(1).select(F.posexplode(S.palette()).alias("bin", "c")).select("bin", "c.*").write.parquet(f"{path}/palette")


def feed_items(docs: DataFrame) -> DataFrame:
    return docs.select("title", F.col("pub_date").alias("pubDate"), "description", D.link(F.col("id")).alias("link"))


def write_feed(docs: DataFrame, path: str) -> None:
    """Feed items as XML. Each part file is a channel of its own."""
    feed_items(docs).write.option("rootTag", "channel").option("rowTag", "item").xml(path)


def doc_pages(docs: DataFrame) -> DataFrame:
    """One record per document: its key and what a page needs."""
    return docs.select("id", F.struct("title", "description").alias("props"))
