"""Files read by byte ranges give the same rows as files read whole, for any range size."""

import csv
import io
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoremap.sources import ranges, readers


def features(rng, n):
    odd = ["plain", 'quote " and \\ back', "{[}]", "line\nbreak", "é", "\\", '\\"', "", None]
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 0]]]
    return [{"type": "Feature", "properties": {"i": i, "name": rng.choice(odd)}, "geometry": rng.choice([{"type": "Polygon", "coordinates": square(i)}, {"type": "MultiPolygon", "coordinates": [square(i), square(-i)]}, None])} for i in range(n)]


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_features_by_ranges(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 64)
    rng = random.Random(3)
    for name, ascii_, indent in (("a", True, None), ("b", False, 1), ("c", False, None)):
        whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "bbox": [0, [1], 2], "notes": [{"type": "Other"}], "features": features(rng, 12)}
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, ensure_ascii=ascii_, indent=indent), encoding="utf-8")
    (tmp_path / "none.json").write_text('{"type": "FeatureCollection", "features": []}')
    (tmp_path / "empty.json").write_text("")
    key = lambda r: json.dumps([r["properties"], r["geometry"].asDict(True) if r["geometry"] else None], sort_keys=True)
    want = sorted(key(r) for r in readers.read_geojson(spark, f"file://{tmp_path}").collect())
    assert sorted(key(r) for r in readers.read_geojson(spark, f"file://{tmp_path}", range_bytes=size).collect()) == want and len(want) == 36


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_csv_records_by_ranges(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 48)
    rng = random.Random(5)
    rows = [[str(i), rng.choice(["1.5", "", "NaN", "0"]), rng.choice(["POLYGON ((0 0, 1 0,\n1 1, 0 0))", "POLYGON ((0 0, 2 0, 2 2, 0 0))", "", 'a "b"\r\nc', "x\n\n\ny"]), rng.choice(["ü", 'say ""', "\n"])] for i in range(40)]
    for name, end in (("a", "\n"), ("b", "\r\n")):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end)
        w.writerows([["id", "score", "geometry", "note"], *rows])
        text = out.getvalue()
        (tmp_path / f"{name}.csv").write_bytes((text if name == "a" else text.removesuffix(end)).encode())
    got = sorted((int(r["segment_id"]), r["score"], r["wkt"], str(r["geometry"])) for r in readers.read_scored_csv(spark, f"file://{tmp_path}", id_col="id", multi_line=True, range_bytes=size).collect())
    assert len(got) == 80 and [g[0] for g in got] == sorted(2 * list(range(40)))
    assert all(g[2] == (rows[g[0]][2] or None) for g in got)


def test_several_tasks_read_a_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,score,geometry\n" + "".join(f'{i},{i},"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n' for i in range(2000)))
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "8k")
    try:
        assert readers.read_scored_csv(spark, f"file://{tmp_path}/big.csv").rdd.getNumPartitions() > 4
    finally:
        spark.conf.set(key, old)
    assert ranges.csv_records(spark, f"file://{tmp_path}/big.csv", 8192).count() == 2001


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "{", "}", "[", '"', "\\\\", '\\"', "\\n"]), max_size=30), st.integers(0, 40))
def test_states_compose(parts, cut):
    """Scanning in two parts is scanning at once, in a text whose backslashes stand in strings."""
    text, inside = "", False
    for p in parts:
        if p == '"':
            inside = not inside
        text += p if inside or not p.startswith("\\") else "b"
    data = np.frombuffer(text.encode(), np.uint8)
    cut = min(cut, len(data))
    whole, end = ranges.strings(data, ranges.OUT, True)
    left, state = ranges.strings(data[:cut], ranges.OUT, True)
    right, last = ranges.strings(data[cut:], state, True)
    assert np.array_equal(np.append(left, right), whole) and last == end
    plain, state = [], ranges.OUT  # byte by byte
    for c in text:
        plain.append(state == ranges.OUT and c != '"')
        state = {ranges.OUT: ranges.IN if c == '"' else ranges.OUT, ranges.IN: ranges.OUT if c == '"' else ranges.ESCAPED if c == "\\" else ranges.IN, ranges.ESCAPED: ranges.IN}[state]
    assert whole.tolist() == plain and end == state
