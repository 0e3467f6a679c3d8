"""The labelling sink: runs that die between or inside batches neither lose nor repeat a row."""

from collections import Counter

import pytest

from cohortal.sources import labelling


class Killed(Exception):
    pass


def dies(monkeypatch, where, after=False):
    """The commit of batch `where` dies, before or after its mark is written."""
    real = labelling._commit

    def commit(spark, path, attempt, batch):
        if batch == where and not after:
            raise Killed
        real(spark, path, attempt, batch)
        if batch == where:
            raise Killed

    monkeypatch.setattr(labelling, "_commit", commit)


def evaluate_into(folder):
    """An evaluation that leaves a mark for each call, and fails on multiples of 10."""

    def evaluate(item):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{item}\n")
        if item % 10 == 0:
            raise ValueError("no value")
        return item * 2

    return evaluate


def calls(folder):
    return Counter(int(x) for x in open(f"{folder}/calls"))


def rows(df):
    return sorted((r["key"], r["status"], r["value"], r["attempt"]) for r in df.collect())


WANT = [(k, "worker_error" if k % 10 == 0 else "success", None if k % 10 == 0 else k * 2.0, 1) for k in range(40)]


@pytest.mark.parametrize("after", [False, True])
def test_a_table_goes_on_where_it_died(spark, tmp_path, monkeypatch, after):
    path, evaluate = f"file://{tmp_path}/sink", evaluate_into(tmp_path)
    manifest = spark.range(40).selectExpr("id AS key", "id AS item")
    with monkeypatch.context() as m:
        dies(m, 1, after)
        with pytest.raises(Killed):
            labelling.label_table(manifest, path, evaluate, ["key"], batches=3)
    left = labelling.dry_run(manifest, path, ["key"]).count()
    assert 0 < left < 40 and labelling.results(spark, path).count() == 40 - left
    assert rows(labelling.label_table(manifest, path, evaluate, ["key"], batches=3)) == WANT
    again = Counter(calls(tmp_path).values())
    assert (again[2] == 0) if after else (0 < again[2] < 30 and max(again) == 2)
    labelling.label_table(manifest, path, evaluate, ["key"], batches=3)
    assert Counter(calls(tmp_path).values()) == again


def test_retry_is_an_attempt_of_its_own(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    manifest = spark.createDataFrame([(k, k) for k in range(20)] + [(3, 3), (3, 99)], "key long, item long")
    labelling.label_table(manifest, path, evaluate_into(tmp_path), ["key"], batches=2)
    found = labelling.label_table(manifest, path, float, ["key"], attempt=2, batches=2, retry=True)
    assert rows(found.where("attempt = 2")) == [(0, "success", 0.0, 2), (10, "success", 10.0, 2)]
    assert found.where("key = 3").count() == 1 and found.count() == 22
    assert labelling.dry_run(manifest, path, ["key"], retry=True).count() == 0


@pytest.mark.parametrize("after", [False, True])
def test_a_stream_goes_on_where_it_died(spark, tmp_path, monkeypatch, after):
    path, evaluate = f"file://{tmp_path}/sink", evaluate_into(tmp_path)
    for k in range(4):
        spark.range(k * 10, k * 10 + 12 if k < 3 else 40).selectExpr("id AS key", "id AS item").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, item long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with monkeypatch.context() as m:
        dies(m, 2, after)
        with pytest.raises(Exception, match="Killed"):
            labelling.label_arrivals(stream, path, evaluate, ["key"]).awaitTermination()
    labelling.label_arrivals(stream, path, evaluate, ["key"]).awaitTermination()
    assert rows(labelling.results(spark, path)) == WANT
    assert max(calls(tmp_path).values()) == (1 if after else 2)


def test_an_empty_manifest(spark, tmp_path):
    none = spark.range(0).selectExpr("id AS key", "id AS item")
    assert labelling.label_table(none, f"file://{tmp_path}/sink", float, ["key"], batches=2).count() == 0
