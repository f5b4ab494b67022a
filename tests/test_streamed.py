"""How the streaming queries' changes come to their streams."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from deltaloom import catalog

SCHEMA = "rel string, cells array<string>, op string, seq bigint"


class Seen:
    """Views that only keep what each batch brought."""

    def __init__(self, root: str):
        self.root, self.batches = root, []

    def start(self, changes):
        take = lambda rows, batch: self.batches.append((batch, sorted(r.seq for r in rows.collect())))
        return changes.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()


def test_changes_are_written_once(spark, tmp_path):
    """Every batch has its changes, also one without any, and of all files that a stream leaves none has a change again."""
    seqs = [1, 2, 1_003_999, 5_000_000, 7_999_999, 8_000_000, 90_000_000]
    changes = spark.createDataFrame([("R", [str(s)], "+", s) for s in seqs], SCHEMA)
    shared = Path(catalog.src.shared_dir(spark))
    before, most = set(shared.rglob("*.parquet")), spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    seen = catalog._streamed(Seen(str(tmp_path)), changes)
    assert seen.batches == [(0, seqs[:3]), (1, []), (2, seqs[3:5]), (3, seqs[5:])]
    files = [str(f) for f in set(shared.rglob("*.parquet")) - before]
    assert sum(spark.read.parquet(f).count() for f in files) == len(seqs)
    assert len({str(Path(f).parent) for f in files}) == len(catalog.BOUNDS)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == most


def test_changes_of_relations_are_not_kept_apart(spark):
    """The change logs go to the stream's folder as they are made."""
    shared = Path(catalog.src.shared_dir(spark))
    before = set(shared.glob("changes-*"))
    catalog._stream(spark, "/root/testdata/sf0.001").results().select(F.count(F.lit(1))).collect()
    assert set(shared.glob("changes-*")) == before


def test_change_logs_are_read_once_for_text(spark, tmp_path, monkeypatch):
    """The lines of all batches are made from the tables once; each batch is sorted from what was written."""
    plans, write = [], catalog._apart
    monkeypatch.setattr(catalog, "_apart", lambda rows, path: (plans.append(path), write(rows, path)))
    made = spark.createDataFrame([("+|CN|1|2", 1, 0), ("+|OC|3|1", 1_000_003, 0), ("-|OC|3|1", 5_000_003, 0)], "value string, seq bigint, place int")
    monkeypatch.setattr(catalog, "_update_lines", lambda *a: made)
    found = catalog._stream_from_text(spark, "").collect()
    assert sorted((r.batch, r.line) for r in found) == [(0, "+ 0 2, 3"), (2, "- 0 2, 3")] and len(plans) == 1
