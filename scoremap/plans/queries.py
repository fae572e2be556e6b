"""One registered query per operator: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremap.functions import documents as D
from scoremap.functions import geometry as G
from scoremap.functions import scores as S
from scoremap.operators import documents as docs_ops
from scoremap.operators import events as ev
from scoremap.operators import layers as L
from scoremap.operators import scoring as sc
from scoremap.operators import sketches as sk
from scoremap.operators.pick import pick, pick_top
from scoremap.operators.simplify import simplify
from scoremap.plans.inputs import boxes, lat, lon, sites_of, table
from scoremap.sources import literals as lit_tables
from scoremap.sources import readers
from scoremap.sources.writers import doc_pages as pages_of
from scoremap.sources.writers import feature, feed_items as items_of, write_features, write_feed, write_layers
from scoremap.streaming.selection import OUTPUT, rocksdb, selection_by_event_time, selection_stream

LINE = ["l_orderkey", "l_linenumber"]


def _place(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[")
        base = "file://" + tempfile.mkdtemp(prefix="scoremap-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.normalise(table(spark, sf_dir, "lineitem").select(*LINE, "l_extendedprice", "l_returnflag"), "l_extendedprice")


def map_layer(spark, sf_dir):
    """WKT -> geometry -> normalised score -> bin, colour, label and vertex count."""
    seg = boxes(table(spark, sf_dir, "supplier"), "s_suppkey")
    seg = seg.select("s_suppkey", "s_acctbal", G.wkt_to_geom(F.col("wkt")).alias("geometry"))
    score = F.col("score")
    styled = sc.normalise(seg, "s_acctbal").withColumn("bin", S.ramp_index(score)).withColumn("css", S.rgb_css(S.colour(F.col("bin"))))
    count = F.aggregate(F.flatten(F.col("geometry")["polys"]), F.lit(0), lambda n, r: n + F.size(r))
    return styled.select("s_suppkey", "score", "bin", "css", S.percent_label(score).alias("label"), count.cast("long").alias("n_vertices"))


def score_minmax(spark, sf_dir):
    return _scored(spark, sf_dir).select(*LINE, "score")


def score_ramp(spark, sf_dir):
    return sc.style(_scored(spark, sf_dir), bin=S.ramp_index).select(*LINE, "bin", S.rgb_css(S.colour(F.col("bin"))).alias("css"))


def score_ramp_scaled(spark, sf_dir):
    styled = sc.style(_scored(spark, sf_dir), line_bin=S.ramp_index_scaled, clamped=lambda s: S.ramp_index_scaled(s, clamp=True))
    return styled.select(*LINE, "line_bin", "clamped", S.rgb_css(S.colour(F.col("line_bin"))).alias("css"))


def score_label(spark, sf_dir):
    s = F.col("score")
    return _scored(spark, sf_dir).select(*LINE, S.percent_label(s).alias("label"), S.percent_label(s, zero_is_missing=True).alias("label_nonzero"))


def score_percentile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_extendedprice")
    return sc.percentile(lines, "l_returnflag", "l_extendedprice").select(*LINE, "l_returnflag", "percentile")


def score_percentile_bins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE, "l_extendedprice")
    return sc.percentile_bins(lines, "l_extendedprice").select(*LINE, "bin")


def score_sketches(spark, sf_dir):
    """Deciles per flag from stored sketches of days, merged over the months up to June;
    whether their exact ranks are within twice the stated error."""
    path = _place(spark, "sketches")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.month("l_shipdate").alias("month"), F.to_date("l_shipdate").alias("day"), "l_extendedprice")
    sk.write_sketches(sk.day_sketches(lines.select("l_returnflag", F.struct("month", "day").alias("d"), "l_extendedprice"), "l_returnflag", "d", "l_extendedprice").select("l_returnflag", "n", "sketch", "d.month"), path, "month")
    found = sk.merged(sk.read_sketches(spark, path).where("month <= 6"), "l_returnflag")
    shares = [i / 10 for i in range(1, 10)]
    cuts = found.select("l_returnflag", "n", F.posexplode(sk.quantiles(F.col("sketch"), shares)).alias("pos", "cut"))
    below = lines.where("month <= 6").join(cuts, "l_returnflag").groupBy("l_returnflag", "n", "pos").agg(F.count_if(F.col("l_extendedprice") <= F.col("cut")).alias("upto"))
    off = F.abs(F.col("upto") / F.col("n") - (F.col("pos") + 1) / 10)
    return below.select("l_returnflag", (F.col("pos") + 1).alias("decile"), "n", (off <= 2 * sk.rank_error()).alias("within"))


def score_default_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return docs.join(labels, "doc_id", "left").select("doc_id", S.default_score(F.col("quality")).alias("score"))


def borough_filter(spark, sf_dir):
    return L.keep_boroughs(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


def wkt_roundtrip(spark, sf_dir):
    seg = boxes(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", G.wkt_to_geom(F.col("wkt")).alias("g"))
    again = seg.select("s_suppkey", G.wkt_to_geom(G.geom_to_wkt(F.col("g"))).alias("geometry"))
    return L.vertices(again)


def geojson_roundtrip(spark, sf_dir):
    seg = boxes(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", G.wkt_to_geom(F.col("wkt")).alias("g"))
    text = seg.withColumn("j", G.geom_to_geojson(F.col("g")))
    back = F.from_json("j", "type string, coordinates string")
    return L.vertices(text.select("s_suppkey", G.geojson_to_geom(back["type"], back["coordinates"]).alias("geometry")))


def project_points(spark, sf_dir):
    x, y = G.project_xy(lon(F.col("c_custkey")), lat(F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def project_roundtrip(spark, sf_dir):
    """Planar and back as tagged geometries: the starting degrees return."""
    k = F.col("c_custkey")
    point = F.array(F.array(F.array(F.struct(lon(k).alias("x"), lat(k).alias("y")))))
    there = table(spark, sf_dir, "customer").select("c_custkey", G.project(G.geom(F.lit("Polygon"), F.lit(G.WGS84), point)).alias("g"))
    back = there.select("c_custkey", F.col("g")["srid"].alias("srid"), G.unproject(F.col("g")).alias("g"))
    v = F.get(F.get(F.get(F.col("g")["polys"], 0), 0), 0)
    return back.select("c_custkey", "srid", F.round(v["x"], 9).alias("lon"), F.round(v["y"], 9).alias("lat"))


def circle_vertices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", G.buffer_point(lon(F.col("s_suppkey")) * 1000, lat(F.col("s_suppkey")) * 1000, F.lit(400.0)).alias("geometry"))
    return L.vertices(s).select("s_suppkey", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def dome_planar(spark, sf_dir):
    sites = sites_of(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    # what a ring has once is rounded before it becomes vertices
    rings = L.described(L.dome_planar(sites)).select("ordinal", "description", "ring", F.round("radius", 6).alias("radius"), F.round("height", 6).alias("height"), "geometry")
    return L.vertices(rings).select("ordinal", "description", "ring", "radius", "height", "k", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


def dome_rings(spark, sf_dir):
    """All rings, the empty ones of the far half too."""
    sites = sites_of(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    rings = L.dome_planar(sites, keep_empty=True)
    return rings.select("ordinal", "ring", F.round("radius", 6).alias("radius"), F.round("height", 6).alias("height"), (F.size(F.col("geometry")["polys"]) == 0).alias("is_empty"))


def dome_geographic(spark, sf_dir):
    sites = sites_of(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    rings = L.dome_geographic(sites).select("ordinal", "level", "height", "opacity", "geometry")
    return L.vertices(rings).select("ordinal", "level", F.round("height", 6).alias("height"), F.round("opacity", 9).alias("opacity"), "k", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def geojson_features(spark, sf_dir):
    seg = boxes(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", "s_name", G.wkt_to_geom(F.col("wkt")).alias("g"))
    return seg.select("s_suppkey", feature(F.col("g"), id=F.col("s_suppkey"), name=F.col("s_name"), video=F.lit(None).cast("string")).alias("feature"))


def csv_layer(spark, sf_dir):
    """Scored segments written as CSV with WKT and read back."""
    path = _place(spark, "csv")
    boxes(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.col("wkt").alias("geometry")).write.option("header", True).option("escape", '"').csv(path)
    back = readers.read_scored_csv(spark, path, id_col="id")
    return L.vertices(back.select(F.col("segment_id").cast("long").alias("s_suppkey"), "score", "geometry"))


def csv_ranges(spark, sf_dir):
    """The same with line breaks inside of quotes, read by byte ranges."""
    path = _place(spark, "csv")
    rows = boxes(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit('\n"'), "s_suppkey", F.lit('"\n')).alias("note"), F.col("s_acctbal").alias("score"), F.regexp_replace("wkt", ", ", ",\n").alias("geometry"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    back = readers.read_scored_csv(spark, path, id_col="id", multi_line=True, range_bytes=8192)
    return L.vertices(back.select(F.col("segment_id").cast("long").alias("s_suppkey"), "score", "geometry"))


def geojson_collections(spark, sf_dir):
    """FeatureCollections of 500 features, read by byte ranges."""
    path = _place(spark, "collections")
    seg = boxes(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.floor(F.col("s_suppkey") / 500).alias("part"), feature(G.wkt_to_geom(F.col("wkt")), s_suppkey=F.col("s_suppkey"), s_name=F.col("s_name")).alias("f"))
    whole = seg.groupBy("part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ",\n"), F.lit("]}")).alias("value"))
    whole.repartition("part").write.partitionBy("part").text(path)
    back = readers.read_geojson(spark, f"{path}/part=*", srid=G.STATE_PLANE, range_bytes=16384)
    return L.vertices(back.select(F.col("properties")["s_suppkey"].cast("long").alias("s_suppkey"), F.col("properties")["s_name"].alias("s_name"), "geometry"))


def geojson_layer(spark, sf_dir):
    """Features written one per line and read back, beside a layer that is not there."""
    path = _place(spark, "geojson")
    seg = boxes(table(spark, sf_dir, "supplier"), "s_suppkey")
    write_features(seg.select("s_suppkey", "s_name", G.wkt_to_geom(F.col("wkt")).alias("geometry")), path)
    layers = readers.read_layers(spark, {"segments": path, "none": f"{path}-none"}, lines=True, srid=G.STATE_PLANE)
    back = L.assemble(**{k: v for k, v in layers.items() if v is not None})
    return L.vertices(back.select("layer", F.col("properties")["s_suppkey"].cast("long").alias("s_suppkey"), F.col("properties")["s_name"].alias("s_name"), "geometry"))


def boundary_layer(spark, sf_dir):
    """Boundaries in degrees written as features and read into the plane."""
    path = _place(spark, "boundaries")
    k = F.col("s_suppkey")
    corner = lambda a, b: F.struct((lon(k) + a).alias("x"), (lat(k) + b).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(0.001, 0.0), corner(0.001, 0.001), corner(0.0, 0.0))
    seg = table(spark, sf_dir, "supplier").select(F.concat(F.lit("B"), k % 5).alias("BoroName"), k.alias("n"), G.geom(F.lit("Polygon"), F.lit(G.WGS84), F.array(F.array(ring))).alias("geometry"))
    write_features(seg, path)
    back = readers.read_boundaries(spark, path, lines=True).select("boro_name", F.col("attrs")["n"].cast("long").alias("s_suppkey"), "geometry")
    return L.vertices(back).select("boro_name", "s_suppkey", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def layer_files(spark, sf_dir):
    """Layers written apart; reading one of them touches only its own files."""
    path = _place(spark, "layers")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("size "), F.col("p_size") % 4).alias("layer"), F.to_json(F.struct("p_partkey")).alias("feature"))
    write_layers(parts, path)
    return spark.read.parquet(f"{path}/features").where("layer in ('size 1', 'size 3')").select("layer", "feature")


def selected_layers(spark, sf_dir):
    """Layers on files, shown as a table of users' selections says: Spark prunes the files
    of layers that the table, filtered to active users, does not name."""
    path = _place(spark, "layers")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("size "), F.col("p_size") % 10).alias("layer"), F.to_json(F.struct("p_partkey")).alias("feature"))
    write_layers(parts, path)
    nations = table(spark, sf_dir, "nation")
    selections = nations.select(F.col("n_name").alias("user"), F.concat(F.lit("size "), F.col("n_nationkey") % 7 + 2).alias("layer"), (F.col("n_regionkey") == 1).alias("active"))
    return L.visible_to(spark.read.parquet(f"{path}/features"), selections.where("active"), "user").select("user", "layer", "feature")


def feed_files(spark, sf_dir):
    """Feed items written as XML and read back."""
    path = _place(spark, "feed")
    c = table(spark, sf_dir, "customer")
    write_feed(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(None).cast("timestamp").alias("pub_date"), F.col("c_mktsegment").alias("description")), path)
    return spark.read.option("rowTag", "item").schema("title string, description string, link string").xml(path)


def feed_dated(spark, sf_dir):
    """Feed items with dates written as XML and read back."""
    path = _place(spark, "feed")
    o = table(spark, sf_dir, "orders")
    write_feed(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("pub_date"), F.col("o_orderstatus").alias("description")), path)
    back = spark.read.option("rowTag", "item").schema("title string, pubDate timestamp, description string, link string").xml(path)
    return back.select("title", F.col("pubDate").cast("timestamp_ntz").alias("pub_date"), "description", "link")


def doc_ids(spark, sf_dir):
    """Ids of documents by the paths of their files."""
    k = F.col("doc_id")
    path = F.concat(F.lit("file:///srv/blog/"), "source", F.lit("/my%20post+"), k.cast("string"), F.lit("%C3%A9.md"))
    return table(spark, sf_dir, "documents").select("doc_id", D.doc_id(path).alias("id"))


def outline_markdown(spark, sf_dir):
    """Headings of Markdown bodies made from documents."""
    body = F.concat(F.lit("# "), "source", F.lit(" Part\n\n"), F.regexp_replace("text", "(?m)^#", "."), F.lit("\n### "), "lang", F.lit("  two ##\nend"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(D.outline_markdown(body)).alias("pos", "h"))
    return docs.select("doc_id", "pos", "h.depth", "h.text", "h.slug")


def percentile_bin_shares(spark, sf_dir):
    """Rows per approximate bin: each holds its share of the rows to within an error."""
    bins = score_percentile_bins(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"))
    total = bins.agg(F.sum("n")).scalar()
    return bins.select("bin", (F.abs(F.col("n") / total - 1 / 11) <= 0.005).alias("even"))


def markdown_docs(spark, sf_dir):
    """A Markdown file per nation, read and typed."""
    path = _place(spark, "docs")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    front = ["---", "title: '%s'", "author: nobody", "description: \"a: %s\"", "pubDate: 2023-02-14 23:49", "imgUrl: a.png", "tags:", "  - %s", "  - Land", "---", "## A heading", "Text."]
    text = F.format_string("\n".join(front), "n_name", "r_name", "r_name")
    n.select(F.col("n_nationkey").alias("doc"), text.alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    docs, _ = docs_ops.validated(docs_ops.typed(readers.read_docs(spark, path, glob="part-*")))
    return docs.select("title", "author", "description", F.array_join("tags", ",").alias("tags"), F.col("pub_date").cast("timestamp_ntz").alias("pub_date"), "draft")


def hover_labels(spark, sf_dir):
    layers = L.assemble(
        sidewalks=table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_discount").alias("score")),
        deployments=table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("name")),
        cbs=table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0.5).alias("score")),
    )
    return layers.select("layer", "id", "n", S.hover_label(F.col("layer"), F.col("name"), F.col("score")).alias("label"))


def visible_layers(spark, sf_dir):
    layers = L.assemble(
        sidewalks=table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")),
        cbs=table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")),
        deployments=table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
    )
    return L.visible(layers, ["sidewalks", "deployments"]).select("layer", "id", "score", "name")


def simplify_lines(spark, sf_dir):
    """A ring per order through points of its lines, simplified at 40 units."""
    pts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.struct((F.col("l_partkey") % 997).cast("double").alias("x"), (F.col("l_suppkey") % 89).cast("double").alias("y")).alias("v")).alias("p"))
    rings = pts.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"]).alias("r")).where(F.size("r") >= 3)
    closed = F.concat("r", F.array(F.get("r", 0)))
    g = rings.select("l_orderkey", G.geom(F.lit("Polygon"), F.lit(G.STATE_PLANE), F.array(F.array(closed))).alias("g"))
    after = g.withColumn("s", simplify(F.col("g"), 40.0))
    count = lambda c: F.size(F.get(F.get(F.col(c)["polys"], 0), 0))
    return after.select("l_orderkey", count("g").alias("n_before"), count("s").alias("n_after"))


def simplify_invariants(spark, sf_dir):
    """What holds for every simplified ring: it is closed, its vertices are some of the
    old ones, at least four (or all), and each old vertex is within the tolerance of it."""
    pts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.struct((F.col("l_partkey") % 997).cast("double").alias("x"), (F.col("l_suppkey") % 89).cast("double").alias("y")).alias("v")).alias("p"))
    rings = pts.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"]).alias("r")).where(F.size("r") >= 3)
    g = rings.select("l_orderkey", G.geom(F.lit("Polygon"), F.lit(G.STATE_PLANE), F.array(F.array(F.concat("r", F.array(F.get("r", 0)))))).alias("g"))
    ring = lambda c: F.get(F.get(c["polys"], 0), 0)
    both = g.select("l_orderkey", ring(F.col("g")).alias("old"), ring(simplify(F.col("g"), 40.0)).alias("new"))

    def off(v, k):
        """Distance of v from the k-th edge of the new ring."""
        a, b = F.get("new", k), F.get("new", k + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.try_divide((v["x"] - a["x"]) * dx + (v["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(a["x"] + t * dx - v["x"], a["y"] + t * dy - v["y"])

    # a vertex that stays is at no distance
    near = F.forall("old", lambda v: F.array_contains("new", v) | F.exists(F.sequence(F.lit(0), F.size("new") - 2), lambda k: off(v, k) <= 40.0 + 1e-9))
    return both.select(
        "l_orderkey", F.size("old").alias("n_before"), (F.get("new", 0) == F.element_at("new", -1)).alias("is_closed"), (F.size(F.array_except("new", "old")) == 0).alias("is_subset"),
        (F.size("new") >= 4).alias("is_ring"), near.alias("within"),
    )


def pick_points(spark, sf_dir):
    """Lines as points, suppliers' 16-gons of very different sizes as features."""
    points = table(spark, sf_dir, "lineitem").select(*LINE, (F.col("l_partkey") * 37 % 1000 + 0.25).cast("double").alias("x"), (F.col("l_suppkey") * 91 % 1000 + 0.25).cast("double").alias("y"))
    points = points.withColumn("point_id", F.struct(*LINE))
    k = F.col("s_suppkey")
    r = F.when(k % 50 == 0, F.lit(60.0)).otherwise((k % 5 + 1).cast("double"))
    disks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature_id"), G.buffer_point((k * 53 % 1000).cast("double"), (k * 71 % 1000).cast("double"), r, 4).alias("geometry"))
    return pick(points, disks, cell=8.0).select("point_id.*", F.col("feature_id").alias("s_suppkey"))


def pick_layers(spark, sf_dir):
    """Lines as points under three layers: wide areas that may not be picked, disks and,
    on top, disks that overlap them."""
    points = table(spark, sf_dir, "lineitem").select(F.struct(*LINE).alias("point_id"), (F.col("l_partkey") * 37 % 1000 + 0.25).cast("double").alias("x"), (F.col("l_suppkey") * 91 % 1000 + 0.25).cast("double").alias("y"))
    k, order = F.col("s_suppkey"), F.col("s_suppkey") % 3
    r = F.element_at(F.array(F.lit(90.0), F.lit(30.0), F.lit(12.0)), (order + 1).cast("int"))
    features = table(spark, sf_dir, "supplier").select(k.alias("feature_id"), order.alias("draw_order"), (order > 0).alias("pickable"), G.buffer_point((k * 53 % 1000).cast("double"), (k * 71 % 1000).cast("double"), r, 4).alias("geometry"))
    return pick_top(points, features, cell=16.0).select("point_id.*", "draw_order", F.col("feature_id").alias("s_suppkey"))


def pick_large(spark, sf_dir):
    """Orders as points in one region whose border has two edges for each customer."""
    k = F.col("c_custkey")
    vertex = lambda x, y: F.struct(y.cast("double").alias("y"), x.cast("double").alias("x"))
    border = table(spark, sf_dir, "customer").select(F.explode(F.array(vertex(k * 379 % 1000, k * 2), vertex(F.lit(0), k * 2 + 1))).alias("p"))
    ends = border.agg(F.array_sort(F.collect_list("p")).alias("p")).where("size(p) > 0")
    line = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    back = lambda y: F.struct(F.lit(-500.0).alias("x"), y.alias("y"))
    ring = F.concat(line, F.array(back(F.element_at("p", -1)["y"]), back(F.get("p", 0)["y"])), F.slice(line, F.lit(1), F.lit(1)))
    region = ends.select(F.lit(1).alias("feature_id"), G.geom(F.lit("Polygon"), F.lit(G.STATE_PLANE), F.array(F.array(ring))).alias("geometry"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") * 71 % 1600 - 600.5).cast("double").alias("x"), (F.col("o_custkey") * 2 + 0.5).cast("double").alias("y"))
    return pick(points, region, cell=64.0).select(F.col("point_id").alias("o_orderkey"), F.col("feature_id").alias("region"))


def _observations(spark, sf_dir):
    """Lines rate their part on an indicator each."""
    names = F.array(*[F.lit(n) for n, _ in lit_tables.SCALES])
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("segment_id"), F.get(names, (F.col("l_linenumber") * 5 % 24)).alias("indicator"), (F.col("l_quantity") % 5).cast("int").alias("code"))


def composite_score(spark, sf_dir):
    weights = spark.createDataFrame([(n, 1.0 + i % 4) for i, (n, _) in enumerate(lit_tables.SCALES) if i % 6], "indicator string, weight double")
    out = sc.composite_score(_observations(spark, sf_dir), weights, lit_tables.scales(spark))
    return out.withColumn("composite", F.round("composite", 9))


def scale_levels(spark, sf_dir):
    """How often each level of each scale was observed."""
    levels = lit_tables.scales(spark).select("indicator", F.explode(sc.parse_scale(F.col("scale"))).alias("s")).select("indicator", "s.code", "s.label")
    seen = _observations(spark, sf_dir).groupBy("indicator", "code").agg(F.count("*").alias("n"))
    return seen.join(F.broadcast(levels), ["indicator", "code"]).select("indicator", "code", "label", "n")


def weight_share(spark, sf_dir):
    weights = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long")).alias("weight"))
    return sc.weight_share(weights, "weight", 6)


def extreme_ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return sc.extreme_ratio(lines, "l_extendedprice", ["l_returnflag"])


def doc_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text"), "source").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), "id", "left")
    docs = docs.select("id", "source", F.when(F.col("quality") == 1, F.col("source")).alias("title"), F.when(F.col("toxic").isNotNull(), F.lit("x")).alias("author"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("draft"))
    return docs_ops.with_errors(docs, ["title", "author"]).select("id", "draft", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"))


def doc_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return o.select("o_orderkey", text.alias("pub_date_text")).select("o_orderkey", D.parse_pub_date(F.col("pub_date_text")).cast("timestamp_ntz").alias("pub_date"))


def _tagged_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.split("p_name", " "), F.array("p_type")).alias("tags"))


def tag_list(spark, sf_dir):
    return docs_ops.tagged(_tagged_parts(spark, sf_dir)).select("tag").distinct()


def tag_index(spark, sf_dir):
    return docs_ops.tag_counts(_tagged_parts(spark, sf_dir))


def tag_posts(spark, sf_dir):
    return docs_ops.tagged(_tagged_parts(spark, sf_dir))


def tag_page(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("tags"))
    return docs_ops.with_tag(brands, "Brand#12").select("id")


def recent_docs(spark, sf_dir):
    return docs_ops.recent(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), 6)


def reverse_docs(spark, sf_dir):
    return docs_ops.reverse(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"))


def _feed_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.lit(None).cast("timestamp").alias("pub_date"), F.col("lang").alias("description"))


def feed_items(spark, sf_dir):
    return items_of(_feed_docs(spark, sf_dir)).select("title", "description", "link")


def doc_pages(spark, sf_dir):
    return pages_of(_feed_docs(spark, sf_dir)).select("id", "props.title", "props.description")


def outline(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(D.outline_html(F.col("html"))).alias("pos", "h"))
    return pages.select("page_id", "pos", "h.depth", "h.text")


def embed_urls(spark, sf_dir):
    sites = lit_tables.sites(spark).select("ordinal", "start_s", "end_s")
    nations = table(spark, sf_dir, "nation").withColumn("ordinal", F.col("n_nationkey") % 4)
    return ev.looked_up(nations, sites, "ordinal").select("n_nationkey", S.embed_url(F.lower("n_name"), F.col("start_s"), F.col("end_s")).alias("url"))


def _clicks(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.when(F.col("value") >= 5, kind).alias("item"))


def selection_toggle(spark, sf_dir):
    out = ev.selection_toggle(_clicks(spark, sf_dir), "user_id", "item", ["ts", "event_id"])
    return out.select("event_id", "user_id", "item", "active", S.active_colour(F.col("item"), F.col("active")).alias("colour"))


def selection_changes(spark, sf_dir):
    return ev.selection_changes(_clicks(spark, sf_dir), "user_id", "item", ["ts", "event_id"]).select("event_id", "user_id", "item")


def _streamed(spark, sf_dir, answer):
    """What a stream over the events, run until it has read all, has written to its sink.

    The table's files stand in no order of time, so all of them are one micro-batch:
    clicks of a later one would come late and be dropped, or be applied too late."""
    place = _place(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # the path may be a file or a folder: a stream reads folders
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    clicks = events.select("event_id", "ts", "user_id", F.when(F.col("value") >= 5, F.col("event_type")).alias("item"))
    with rocksdb(spark):
        query = answer(clicks).writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{place}/out")


def selection_toggle_stream(spark, sf_dir):
    """The same machine over the events as a file stream."""
    return _streamed(spark, sf_dir, selection_stream)


def selection_event_time(spark, sf_dir):
    """The machine by event time: all clicks that the last watermark has passed."""
    return _streamed(spark, sf_dir, lambda clicks: selection_by_event_time(clicks, "2 days"))


def lookup_sites(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return ev.looked_up(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey")


def known_sites(spark, sf_dir):
    kinds = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return ev.known_keys(table(spark, sf_dir, "events").select("event_id", "event_type"), kinds, "event_type")


def line_ordinal(spark, sf_dir):
    return sc.ordinal(table(spark, sf_dir, "lineitem").select(*LINE), "l_orderkey", ["l_linenumber"])


ALL = [
    map_layer, score_minmax, score_ramp, score_ramp_scaled, score_label, score_percentile, score_percentile_bins, score_sketches, score_default_null, borough_filter, wkt_roundtrip, geojson_roundtrip, project_points, project_roundtrip,
    circle_vertices, dome_planar, dome_rings, dome_geographic, geojson_features, visible_layers, simplify_lines, simplify_invariants, pick_points, pick_layers, pick_large, composite_score, scale_levels, weight_share, extreme_ratio, doc_validate, doc_dates, tag_list,
    tag_index, tag_posts, tag_page, recent_docs, reverse_docs, feed_items, doc_pages, outline, embed_urls, selection_toggle, selection_changes, selection_toggle_stream, selection_event_time, lookup_sites, known_sites, line_ordinal,
    csv_layer, csv_ranges, geojson_layer, geojson_collections, boundary_layer, layer_files, selected_layers, feed_files, feed_dated, doc_ids, outline_markdown, percentile_bin_shares, markdown_docs, hover_labels,
]


def queries() -> dict:
    return {f.__name__: f for f in ALL}
