"""Arrays of JSON files cut between their elements, against the json module."""

import json
import random

import pytest

from emberframe.sources import json_split, stations


def made(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.4:
        return r.choice([1, -2.5e3, None, True, "", '"', "\\", '\\"', "]}{[", '{"a": [', "é漢🚀", "\n\t\\\\", "x" * r.randint(0, 30)])
    if kind < 0.7:
        return [made(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {r.choice(["a", "STATION", 'k"]', "\\", "[{"]) + str(i): made(r, depth + 1) for i in range(r.randint(0, 4))}


@pytest.mark.parametrize(("split", "window"), [(60, 3), (400, 1000), (1 << 20, 1 << 20)])
def test_elements_are_those_of_the_json_module(spark, tmp_path, monkeypatch, split, window):
    monkeypatch.setattr(json_split, "WINDOW", window)
    r = random.Random(split)
    size = 8 if split == 60 else 40
    want = {}
    for k, indent in enumerate((None, 2) if split > 60 else (None,)):
        body = {"SUMMARY": [{"x": made(r)}], "NESTED": {"STATION": [{"not": "this"}]}, "STATION": [made(r) if r.random() < 0.2 else {"id": i, "v": made(r)} for i in range(size)], "UNITS": [[{"STATION": [1]}]], "last": made(r)}
        (tmp_path / f"{k}.json").write_text(json.dumps(body, indent=indent, ensure_ascii=k == 1), encoding="utf-8")
        want[f"{k}.json"] = [v for v in body["STATION"] if isinstance(v, dict)]
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "other.json").write_text('{"A": [{"b": 1}], "STATIONS": [{}]}')
    (tmp_path / "none.json").write_text('{"STATION": []}')
    got = {}
    for row in json_split.read_elements(spark, str(tmp_path), "STATION", split).orderBy("path", "at").collect():
        got.setdefault(row.path.rsplit("/")[-1], []).append(json.loads(row.value))
    assert got == want


def test_states_of_any_cut():
    text = json.dumps({"a": ['\\"', "\\\\", {"b": "]"}], "c\\": '"{'}).encode()
    depths = []
    whole = json_split.scan(text, json_split.OUTSIDE)
    for cut in range(len(text) + 1):
        a = json_split.scan(text[:cut], json_split.OUTSIDE)
        b = json_split.scan(text[cut:], a[2])
        depths.append(a[1].sum() + b[1].sum())
        assert [*a[0], *b[0]] == whole[0].tolist() and b[2] == whole[2] == json_split.OUTSIDE
    assert not any(depths)


def test_one_large_file_in_several_tasks(spark, tmp_path):
    """40 MB of stations in shares of 4 MB: every task reads a part."""
    path = tmp_path / "s.json"
    with open(path, "w") as f:
        f.write('{"STATION": [')
        for i in range(4000):
            f.write((", " if i else "") + json.dumps({"STID": f"S{i}", "TIMEZONE": "UTC", "OBSERVATIONS": {"date_time": ["20240101000000"] * 300, "air_temp_set_1": ["1.5"] * 300}}))
        f.write("]}")
    rows = stations.scan_stations(spark, str(path), 4 << 20)
    assert rows.rdd.getNumPartitions() >= 8
    per_task = [len(p) for p in rows.select("STID").rdd.glom().collect()]
    assert sum(per_task) == 4000 and max(per_task) < 1000
    assert stations.time_series(rows).count() == 4000 * 300
