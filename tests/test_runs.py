"""Histories of batches and their folds, latency of batches, streams that are stopped and go on."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from deltaloom.plans.model import query
from deltaloom.streaming.keyed import KeyedView
from deltaloom.streaming.microbatch import Views
from deltaloom.streaming.runs import History, stopped_after
from tests.test_joins import brute
from tests.test_keyed import one_partition, random_changes, replay, run  # noqa: F401

CHANGES = "rel string, cells array<string>, op string, seq bigint"


@pytest.mark.parametrize("fold", [1, 3])
def test_folds_keep_every_row_once(spark, tmp_path, fold):
    """Whatever batches a fold takes, and if each batch runs twice, the second time with other rows."""
    history = History(str(tmp_path / "h"), "x int, y string", fold)
    assert history.read(spark).isEmpty() and history.batches(spark) == 0
    want = []
    for batch in range(7):
        for again in range(2):
            rows = [(10 * batch + k, "ab"[again]) for k in range(batch % 3)]
            found = history.write(spark.createDataFrame(rows, "x int, y string").coalesce(1), batch)
            assert sorted(map(tuple, found.collect())) == rows
            history.folded(spark, batch)
        want += [(*r, batch) for r in rows]
        assert history.batches(spark) == batch + 1
        assert sorted((r.x, r.y, r.batch) for r in history.read(spark).collect()) == want
    assert len([p for p in Path(history.path).iterdir() if p.name.startswith("v=")]) <= 2 * fold


def test_an_unfinished_fold_is_not_read(spark, tmp_path):
    history = History(str(tmp_path / "h"), "x int", 2, "x > 0")
    for batch in range(2):
        history.write(spark.createDataFrame([(batch,)], "x int"), batch)
    history.folded(spark, 1)
    assert [tuple(r) for r in history.read(spark).collect()] == [(1, 1)]
    (tmp_path / "h" / "part=2" / "_SUCCESS").unlink()
    assert sorted(tuple(r) for r in history.read(spark).collect()) == [(0, 0), (1, 1)]


def parts_of(changes, size):
    return [changes[k : k + size] for k in range(0, len(changes), size)]


def test_stopped_stream_goes_on(spark, tmp_path):
    """A stream stopped again and again ends with what one run gives; logs are folded every second batch."""
    q, changes = query("j", "R(x,y) S(y,z)", "x,z"), random_changes(random.Random(3), ["R", "S", "Other"], 100)
    for part in parts_of(changes, 20):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    views = Views(spark, [q], str(tmp_path / "views"), fold=2)

    def started():
        return views.start(spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))

    ended = [stopped_after(started(), 4.0)]
    while not ended[-1] and len(ended) < 3:
        ended.append(stopped_after(started(), 4.0))
    assert stopped_after(started(), 300)
    state, wrong = replay([c for c in changes if c[0] != "Other"])
    want = brute(state, q)
    assert {tuple(r) for r in views.results().collect()} == want
    log = views.output().collect()
    assert {t for t in {(r.x, r.z) for r in log} if sum(1 if r.op == "+" else -1 for r in log if (r.x, r.z) == t) == 1} == want
    assert sorted((r.rel, tuple(r.cells), r.op, r.seq) for r in views.violations().collect()) == sorted(wrong)
    assert {r.seq for r in views.refused().collect()} == {c[3] for c in changes if c[0] == "Other"}
    taken = {r.batch: (r.results, r.seconds) for r in views.latencies().collect()}
    assert sorted(taken) == list(range(5)) and all(s > 0 for _, s in taken.values())
    assert sum(n for n, _ in taken.values()) == len(log)


def test_keyed_log_is_folded(spark, tmp_path):
    """What any batch left is still told after folds."""
    q, changes = query("j", "R(x,y) S(y,z)", "x,z"), random_changes(random.Random(4), ["R", "S"], 50)
    view = KeyedView(spark, q, str(tmp_path / "view"), fold=2)
    run(spark, view, str(tmp_path / "in"), parts_of(changes, 10))
    for k in range(5):
        state, _ = replay(changes[: 10 * k + 10])
        assert {tuple(r) for r in view.results(0, k).collect()} == brute({r: state.get(r, set()) for r in "RS"}, q)
    names = {p.name for p in (tmp_path / "view" / "events").iterdir()}
    assert {"part=2", "part=4", "v=4"} <= names and not {"v=0", "v=1"} & names
    changed = {}
    for r in view.output().collect():
        changed[r.batch] = changed.get(r.batch, 0) + 1
    assert {r.batch: r.results for r in view.latencies().collect()} == {k: changed.get(k, 0) for k in range(5)}
