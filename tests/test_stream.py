"""The incremental refresh as a stream: late scores arrive in files, a second run finds nothing to do."""

import json

from tallyfield.streaming.scores import goals_by_window, merge_scores, once_per_event, score_stream

SCHEMA = "season int, grp string, round int, home string, away string, home_score int, away_score int"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    keys = ("season", "grp", "round", "home", "away", "home_score", "away_score")
    (folder / name).write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows))


def refresh(spark, tmp_path, replace=False):
    stream = score_stream(spark, str(tmp_path / "in"), SCHEMA)
    merge_scores(stream, str(tmp_path / "table"), str(tmp_path / "state"), replace).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "table")).collect()
    return {(r["grp"], r["home"]): (r["home_score"], r["away_score"]) for r in rows}


def test_late_scores_fill_in(spark, tmp_path):
    land(tmp_path / "in", "1.json", [(2025, "g", 1, "Alpha", "Beta", None, None), (2025, "h", 1, "Delta", "Eta", 1, 0)])
    assert refresh(spark, tmp_path) == {("g", "Alpha"): (None, None), ("h", "Delta"): (1, 0)}
    land(tmp_path / "in", "2.json", [(2025, "g", 1, "Alpha", "Beta", 3, 2), (2025, "h", 1, "Delta", "Eta", 9, 9)])
    expected = {("g", "Alpha"): (3, 2), ("h", "Delta"): (1, 0)}
    assert refresh(spark, tmp_path) == expected
    assert refresh(spark, tmp_path) == expected


def test_groups_are_replaced_when_they_grew(spark, tmp_path):
    land(tmp_path / "in", "1.json", [(2025, "g", 1, "Alpha", "Beta", 1, 1)])
    refresh(spark, tmp_path, replace=True)
    land(tmp_path / "in", "2.json", [(2025, "g", 1, "Alpha", "Beta", 2, 1)])
    assert refresh(spark, tmp_path, replace=True) == {("g", "Alpha"): (1, 1)}


def test_windows_and_repeated_events(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    rows = [("a", "g", "2025-01-01T10:05:00", 1, 0), ("a", "g", "2025-01-01T10:05:00", 1, 0), ("b", "g", "2025-01-01T10:50:00", 2, 2)]
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("event", "grp", "at", "home_score", "away_score"), r, strict=True))) for r in rows))
    schema = "event string, grp string, at timestamp, home_score int, away_score int"
    once = once_per_event(spark.readStream.schema(schema).json(str(folder)), ["event"], "at")
    once.writeStream.format("memory").queryName("once_events").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    assert spark.table("once_events").count() == 2
    goals = goals_by_window(spark.readStream.schema(schema).json(str(folder)), "at")
    goals.writeStream.format("memory").outputMode("complete").queryName("goal_windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    assert [(r["goals"], r["results"]) for r in spark.table("goal_windows").collect()] == [(6, 3)]
