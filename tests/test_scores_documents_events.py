import collections
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scoremap.functions import documents as D
from scoremap.functions import scores as S
from scoremap.operators import documents as docs_ops
from scoremap.operators import events as ev
from scoremap.operators import prefix
from scoremap.operators import scoring as sc
from scoremap.plans.queries import queries
from scoremap.plans.oracle import oracle_sql
from scoremap.sources import literals, readers, writers
from scoremap.streaming.selection import step


def test_scores(spark):
    rows = [(0.0,), (0.43,), (0.44,), (0.999,), (1.0,), (float("nan"),), (None,)]
    s = F.col("s")
    got = spark.createDataFrame(rows, "s double").select(
        S.ramp_index(s).alias("bin"), S.ramp_index_scaled(s).alias("line"), S.rgb_css(S.colour(S.ramp_index_scaled(s))).alias("css"), S.percent_label(s).alias("a"), S.percent_label(s, True).alias("b"), S.default_score(s).alias("d")
    ).collect()
    assert [r["bin"] for r in got] == [0, 4, 4, 9, 10, None, None]
    assert got[1]["css"] is not None and got[2]["line"] == 11 and got[2]["css"] is None
    assert got[0]["a"] == "Score: 0.0%" and got[0]["b"] is None and got[5]["a"] is None
    assert got[5]["d"] == 0.0 and got[6]["d"] == 0.0


def test_normalise_equal_and_nan(spark):
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r["score"] for r in sc.normalise(same, "v").collect()] == [None, None]
    some = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert sorted(str(r["score"]) for r in sc.normalise(some, "v").collect()) == ["0.0", "1.0", "None", "None"]


@pytest.mark.parametrize("whole_key", [0, 1000])
def test_percentile_is_percent_rank(spark, whole_key):
    rows = [(k, float(v)) for k in "ab" for v in (3, 1, 1, 7, 7, 7, 100)] + [("c", 5.0), ("c", None)]
    got = {(r["k"], r["v"]): r["percentile"] for r in sc.percentile(spark.createDataFrame(rows, "k string, v double"), "k", "v", whole_key=whole_key).collect()}
    assert got[("a", 1.0)] == 0.0 and got[("a", 3.0)] == 2 / 6 and got[("b", 7.0)] == 0.5 and got[("b", 100.0)] == 1.0
    assert got[("c", 5.0)] == 0.0 and got[("c", None)] is None


def test_scales_and_weights(spark):
    levels = literals.scales(spark).select("indicator", F.explode(sc.parse_scale(F.col("scale"))).alias("s")).select("indicator", "s.*")
    assert levels.count() == 72 and levels.groupBy("indicator").agg(F.max("code").alias("m")).agg(F.min("m"), F.max("m")).first()[0:2] == (1, 4)
    assert levels.where("label = '5G, IoT'").count() == 1
    share = sc.weight_share(literals.weights(spark), "weight", 6).first()
    assert abs(share["top"] - 0.463) < 1e-12 and abs(share["share"] - 1) < 1e-12
    obs = spark.createDataFrame([(1, "Sidewalk width", 1), (1, "Slope gradient", 0), (1, "unknown", 1), (2, "Sidewalk width", 9)], "segment_id int, indicator string, code int")
    w = spark.createDataFrame([("Sidewalk width", 3.0), ("Slope gradient", 1.0)], "indicator string, weight double")
    got = {r["segment_id"]: tuple(r)[1:] for r in sc.composite_score(obs, w, literals.scales(spark)).collect()}
    assert got == {1: (0.75, 2, 1), 2: (None, 0, 1)}


def test_dates_and_outline(spark):
    got = spark.createDataFrame([("11/09/2022 14:25",), ("2023-02-14 23:49",), ("12/31/2022 12:05",), ("soon",), (None,)], "s string").select(D.parse_pub_date(F.col("s")).cast("string").alias("d")).collect()
    assert [r["d"] for r in got] == ["2022-11-09 14:25:00", "2023-02-14 23:49:00", "2022-12-31 12:05:00", None, None]
    row = spark.createDataFrame([("# One\ntext\n### Two words!\nno # heading\n",)], "t string").select(D.outline_markdown(F.col("t")).alias("o")).first()
    assert [(h["depth"], h["slug"], h["text"]) for h in row["o"]] == [(1, "one", "One"), (3, "two-words", "Two words!")]


DOC = """---
{head}
---
## A heading

Some text of our own.
"""


def test_markdown_folder(spark, tmp_path):
    good = 'title: "First: one"\nauthor: Ada\ndescription: d\npubDate: 11/09/2022 14:25\nimgUrl: a.png\ntags:\n  - Astro\n  - astro\n  - Web Dev'
    other = "tags:\n- CSS\nimgUrl: b.png\npubDate: 2023-02-14 23:49\ndraft: true\ndescription: 'e'\nauthor: 'Bob'\ntitle: Second"
    os.makedirs(tmp_path / "deep")
    for name, head in {"one.md": good, "deep/two words.md": other, "_hidden.md": good, "bad.md": "author: x", "date.md": good.replace("11/09/2022 14:25", "later")}.items():
        (tmp_path / name).write_text(DOC.format(head=head))
    docs = docs_ops.typed(readers.read_docs(spark, f"file://{tmp_path}"))
    ok, bad = docs_ops.validated(docs)
    got = {r["id"]: r for r in ok.collect()}
    assert set(got) == {"one", "two words"} and got["one"]["title"] == "First: one" and got["two words"]["author"] == "Bob" and got["two words"]["draft"] and not got["one"]["draft"]
    assert {r["id"]: r["errors"] for r in bad.collect()} == {"bad": ["title", "tags", "description", "pub_date", "img_url"], "date": ["pub_date"]}
    assert {(r["tag"], r["n_docs"]) for r in docs_ops.tag_counts(ok).collect()} == {("astro", 1), ("web dev", 1), ("css", 1)}
    assert [r["id"] for r in docs_ops.with_tag(ok, "ASTRO").collect()] == ["one"] and [r["id"] for r in docs_ops.recent(ok, 1).collect()] == ["two words"]
    with pytest.raises(Exception, match="bad document"):
        docs_ops.validated(docs, strict=True)[0].collect()
    writers.write_feed(ok, f"file://{tmp_path}/feed")
    items = spark.read.option("rowTag", "item").schema("title string, link string").xml(f"file://{tmp_path}/feed")
    assert {r["link"] for r in items.collect()} == {"/blog/one/", "/blog/two words/"}


def test_csv_geojson_layers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,score,geometry\n1,0.5,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n2,,"POLYGON EMPTY"\n3,NaN,\n4,x,"POLYGON ((0 0"\n')
    got = {r["segment_id"]: r for r in readers.read_scored_csv(spark, f"file://{tmp_path}/s.csv", id_col="id").collect()}
    assert got["1"]["score"] == 0.5 and [got[k]["score"] for k in "234"] == [None] * 3
    assert got["2"]["geometry"]["polys"] == [] and got["3"]["geometry"] is None and got["4"]["geometry"] is None
    frame = readers.read_scored_csv(spark, f"file://{tmp_path}/s.csv", id_col="id").select("segment_id", "score", "geometry")
    writers.write_features(frame.where("geometry is not null"), f"file://{tmp_path}/f")
    back = readers.read_geojson(spark, f"file://{tmp_path}/f", lines=True, srid=2263)
    assert {(r["properties"]["segment_id"], r["properties"]["score"], r["geometry"]["type"], len(r["geometry"]["polys"])) for r in back.collect()} == {("1", "0.5", "Polygon", 1), ("2", None, "Polygon", 0)}
    layers = readers.read_layers(spark, {"here": f"file://{tmp_path}/f", "gone": f"file://{tmp_path}/gone"}, lines=True)
    assert layers["gone"] is None and layers["here"].count() == 2
    (tmp_path / "bad.json").write_text('{"type": "FeatureColl')
    (tmp_path / "other.json").write_text('{"type": "Topology"}')
    (tmp_path / "fine.json").write_text('{"type": "FeatureCollection", "features": []}')
    whole = readers.read_layers(spark, {n: f"file://{tmp_path}/{n}.json" for n in ("bad", "other", "fine")})
    assert whole["bad"] is None and whole["other"] is None and whole["fine"].count() == 0
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"BoroName":"Queens","n":1},"geometry":{"type":"MultiPolygon","coordinates":[[[[-74,40.5],[-73.9,40.5],[-73.9,40.6],[-74,40.5]]]]}},{"type":"Feature","properties":{"BoroName":null},"geometry":null}]}')
    b = readers.read_boundaries(spark, f"file://{tmp_path}/c.json").collect()
    assert [r["boro_name"] for r in b] == ["Queens", None] and b[0]["geometry"]["srid"] == 2263 and b[0]["attrs"] == {"n": "1"} and b[1]["geometry"] is None
    layers = spark.createDataFrame([("a", "{}"), ("b", "{}")], "layer string, feature string")
    writers.write_layers(layers, f"file://{tmp_path}/layers")
    assert spark.read.parquet(f"file://{tmp_path}/layers/features").where("layer = 'a'").count() == 1 and spark.read.parquet(f"file://{tmp_path}/layers/palette").count() == 11


CASES = {"A A": "A -", "A B": "A B", "A A A": "A - A", "A x A": "A - A", "A B B A": "A B - A"}


@pytest.mark.parametrize("whole_key", [0, 100_000])
def test_selection_equals_state_machine(spark, whole_key):
    rows, want = [], {}
    for user, (clicks, active) in enumerate([("A", "A"), *CASES.items()]):
        state = None
        for i, (c, a) in enumerate(zip(clicks.split(), active.split())):
            item = None if c == "x" else c
            state = step(state, item)
            assert (state or "-") == a
            rows.append((user * 100 + i, i, user, item))
            want[user * 100 + i] = state
    got = ev.selection_toggle(spark.createDataFrame(rows, "event_id int, ts int, user_id int, item string"), "user_id", "item", ["ts", "event_id"], whole_key=whole_key)
    assert {r["event_id"]: r["active"] for r in got.collect()} == want


@pytest.mark.parametrize(("steps", "whole_key"), [(1, 0), (2, 0), (4, 0), (32, 0), (32, 10_000)])
def test_long_click_logs_equal_state_machine(spark, monkeypatch, steps, whole_key):
    """Users of very different activity, long runs, ties in time, null users and items,
    over few and many slices."""
    monkeypatch.setattr(prefix, "STEPS", steps)
    rng = random.Random(steps)
    rows = [(i, rng.choice([i // 3, 7]), rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "a", "a", "b", None]) if i % 50 > 20 else "a", "x") for i in range(700)]
    frame = spark.createDataFrame(rows, "event_id int, ts int, user_id int, item string, _slice string")
    state, last, active, changes = {}, {}, {}, set()
    for i, ts, user, item, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        active[i] = state[user] = step(state.get(user), item)
        if item != last.get(user):
            changes.add(i)
        last[user] = item
    got = ev.selection_toggle(frame.drop("_slice"), "user_id", "item", ["ts", "event_id"], whole_key=whole_key)
    assert got.columns == ["event_id", "ts", "user_id", "item", "active"] and {r["event_id"]: r["active"] for r in got.collect()} == active
    assert {r["event_id"] for r in ev.selection_changes(frame.drop("_slice"), "user_id", "item", ["ts", "event_id"], whole_key=whole_key).collect()} == changes
    none = frame.where("event_id < 0").drop("_slice")
    assert ev.selection_toggle(none, "user_id", "item", ["ts", "event_id"], whole_key=whole_key).isEmpty()


def test_slices_spread_in_spite_of_outliers(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(5000)] + [(1e18,), (None,)], "v double")
    sizes = {r["_slice"]: r["count"] for r in prefix.with_slices(frame, "v").groupBy("_slice").count().collect()}
    assert len(sizes) > 500 and max(sizes.values()) < 50
    ordered = [r["_slice"] for r in prefix.with_slices(frame, "v").where("v is not null").orderBy("v").collect()]
    assert ordered == sorted(ordered)


def test_hover_label(spark):
    rows = [("deployments", "Corner", None), ("deployments", "", 0.5), ("deployments", None, 0.5), ("sidewalks", "x", 0.5), ("sidewalks", "x", 0.0), ("sidewalks", "x", None), ("cbs", "x", 0.5)]
    got = spark.createDataFrame(rows, "l string, n string, s double").select(S.hover_label(F.col("l"), F.col("n"), F.col("s")).alias("h")).collect()
    assert [r["h"] for r in got] == ["Corner", None, None, "Score: 50.0%", None, None, None]


@pytest.mark.parametrize("name", sorted(queries()))
def test_every_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in oracle_sql():
        want = con.execute(oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == cols
        assert got == collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall())


@pytest.mark.parametrize("whole_key", [0, 10_000])
def test_ordinals_of_hot_keys(spark, whole_key):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, float(i // 5), -2.0]), i) for i in range(600)]
    got = sc.ordinal(spark.createDataFrame(rows, "k string, v double, i int"), "k", ["v", "i"], whole_key=whole_key)
    place = {}
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        place |= {r[2]: n for n, r in enumerate(mine)}
    assert {r["i"]: r["ordinal"] for r in got.collect()} == place and got.columns == ["k", "v", "i", "ordinal"]
