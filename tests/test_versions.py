"""Groups replaced in one step, parts published only where they changed, identities kept across loads."""

import itertools
import json
import os

import pytest

from pyspark.sql import functions as F
from tallyfield.operators import versions
from tallyfield.streaming.identities import identified
from tallyfield.streaming.scores import merge_scores, score_stream
from tests.test_stream import SCHEMA, land


def rows(spark, *data):
    return spark.createDataFrame(list(data), "season int, grp string, team string, points int")


def stored(spark, path):
    return {(r["season"], r["grp"], r["team"]): r["points"] for r in versions.read(spark, path).collect()}


def test_groups_are_replaced_whole_and_others_stay(spark, tmp_path):
    path = (tmp_path / "table").as_uri()
    assert versions.current(spark, path) is None and versions.read(spark, path) is None
    versions.replace_groups(rows(spark, (1, "g", "a", 3), (1, "g", "b", 1), (2, "h", "c", 0), (3, None, "d", 9)), path, ["season", "grp"])
    second = versions.replace_groups(rows(spark, (1, "g", "a", 4)), path, ["season", "grp"])
    assert second.number == 2
    assert {k: v for k, v in stored(spark, path).items() if k[1]} == {(1, "g", "a"): 4, (2, "h", "c"): 0}
    versions.replace_groups(rows(spark).limit(0), path, ["season", "grp"])
    assert stored(spark, path)[2, "h", "c"] == 0


@pytest.mark.parametrize("step", ["rows", "list", "version"])
def test_a_load_that_fails_half_way_leaves_the_old_rows(spark, tmp_path, monkeypatch, step):
    path = (tmp_path / "table").as_uri()
    versions.replace_groups(rows(spark, (1, "g", "a", 3), (2, "h", "c", 0)), path, ["season", "grp"])
    before = stored(spark, path)
    new = rows(spark, (1, "g", "a", 7), (2, "h", "c", 8))
    if step == "rows":
        new = new.withColumn("points", F.when(F.col("season") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("points")))
    elif step == "list":
        monkeypatch.setattr(versions, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    else:  # another load took the number first
        os.makedirs(tmp_path / "table/versions", exist_ok=True)
        (tmp_path / "table/versions/0000000002").write_text("")
    with pytest.raises(Exception):
        versions.replace_groups(new, path, ["season", "grp"])
    monkeypatch.undo()
    assert stored(spark, path) == before
    if step != "version":
        versions.replace_groups(rows(spark, (1, "g", "a", 5)), path, ["season", "grp"])
        assert stored(spark, path) == {(1, "g", "a"): 5, (2, "h", "c"): 0}
        assert versions.remove_unlisted(spark, path, keep=1) >= 1
        assert stored(spark, path) == {(1, "g", "a"): 5, (2, "h", "c"): 0}


def test_only_changed_parts_are_published_again(spark, tmp_path):
    path = (tmp_path / "parts").as_uri()
    documents = lambda *d: spark.createDataFrame(list(d), "season int, document string")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "parts/data") for f in fs if f.endswith(".parquet")}
    first, new = versions.republish(documents((1, "a"), (2, "b"), (3, "c")), path, ["season"])
    was = files()
    assert new and versions.republish(documents((3, "c"), (1, "a"), (2, "b")), path, ["season"]) == (first, False) and files() == was
    second, new = versions.republish(documents((1, "a"), (2, "B"), (4, "d")), path, ["season"])
    assert new and second.number == 2
    assert {r["season"]: r["document"] for r in versions.read(spark, path).collect()} == {1: "a", 2: "B", 4: "d"}
    assert {r["season"] for r in versions.groups_of(spark, path).where(F.col("load") == second.list_id).collect()} == {2, 4}
    now = files()
    assert all(now[f] == t for f, t in was.items()) and len(now) > len(was)
    versions.republish(documents((1, "a"), (2, "B")), path, ["season"])
    assert {r["season"] for r in versions.read(spark, path).collect()} == {1, 2}
    assert {r["season"] for r in versions.read(spark, path, second).collect()} == {1, 2, 4}


LOADS = {
    "1.json": [("Arucas CF", None, 1), ("Telde", "t.png", 2), ("C.D.", None, 3)],
    "2.json": [("Arucas", "a.png", 4), ("ARUCAS, C.F.", None, 5), ("Arucas B", None, 6), ("U.D.", None, 7), (None, "x", 8)],
    "3.json": [("Arucas", None, 9), ("Telde CD", "u.png", 10), ("Telde", None, 11)],
}


def loaded(spark, folder, order):
    """Names with their identities after each load, as a stream that is stopped and started again."""
    out = []
    (folder / "in").mkdir(parents=True)
    for name in order:
        (folder / "in" / name).write_text("\n".join(json.dumps(dict(zip(("name", "badge", "sequence"), r))) for r in LOADS[name]))
        stream = spark.readStream.schema("name string, badge string, sequence long").json(str(folder / "in"))
        found = []
        keep = lambda batch, _: found.extend(batch.collect())  # noqa: B023, E731
        identified(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
        out.append({r["name"]: (r["id"], r["canonical"], r["badge"]) for r in found})
    return out


@pytest.mark.parametrize("order", list(itertools.permutations(LOADS))[::2])
def test_identities_never_change(spark, tmp_path, order):
    loads = loaded(spark, tmp_path, order)
    ids = {}
    for load in loads:
        for name, (i, canonical, _) in load.items():
            assert ids.setdefault(name, (i, canonical)) == (i, canonical)
    one = lambda *names: {ids[n] for n in names}
    assert len(one("Arucas CF", "Arucas", "ARUCAS, C.F.")) == 1 == len(one("Telde", "Telde CD"))
    assert len({i for i, _ in ids.values()}) == 5 and len(one("C.D.", "U.D.")) == 2 and None not in ids
    first = next(n for load in order for n, _, _ in LOADS[load] if n and n.lower().startswith("arucas") and n != "Arucas B")
    assert ids["Arucas"][1] == first
    assert {b for load in loads[-1:] for n, (_, _, b) in load.items() if n == "Telde"} <= {"t.png", "u.png"}


@pytest.mark.parametrize("replace", [False, True])
@pytest.mark.parametrize("turn", [1, -1])
def test_a_score_beside_a_null_row_of_its_key_is_kept(spark, tmp_path, replace, turn):
    both = [(2025, "g", 1, "Alpha", "Beta", None, None), (2025, "g", 1, "Alpha", "Beta", 3, 2), (2025, "g", 1, "Alpha", "Beta", None, 9)][::turn]
    land(tmp_path / "in", "1.json", both)
    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(scratch))
    merge_scores(score_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "table"), str(tmp_path / "state"), replace).awaitTermination()
    assert [(r["home_score"], r["away_score"]) for r in spark.read.parquet(str(tmp_path / "table")).collect()] == [(3, 2)]
    assert set(os.listdir(scratch)) == before
