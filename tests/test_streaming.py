
from beliefloom.streaming import live

from tests.test_ledger import a, r, records


def test_state_follows_the_log(spark, tmp_path):
    ev = [a("A", 0.5), a("B", 0.4), r("A", 0.5, 0.9), ("ann", "claim_status_changed", {"claim_id": "B", "status": "dead"}), r("B", 0.4, 0.2), r("A", 0.9, 0.7)]
    rows = [(*x, None) for x in records(spark, ev)]
    src = tmp_path / "in"
    for i, part in enumerate([[rows[0], rows[5]], [rows[2], rows[1], rows[5]], [rows[4]], [rows[3]]]):  # late and repeated
        spark.createDataFrame(part, live.RECORDS).coalesce(1).write.parquet(str(src / f"p{i}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(4):
        for f in sorted((src / f"p{i}").glob("*.parquet")):
            f.rename(flat / f"{i}-{f.name}")
    q = live.maintain(live.read_records(spark, str(flat)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    seen = {(x.claim_id, x.score) for x in live.current(spark, str(tmp_path / "out")).collect()}
    assert seen == {("A", 0.7)}
    live.compact(spark, str(tmp_path / "out"), 2)
    assert sorted(x.name for x in (tmp_path / "out" / "state").glob("batch=*")) == ["batch=2", "batch=3"]
    assert {(x.claim_id, x.score) for x in live.current(spark, str(tmp_path / "out")).collect()} == seen
    assert live.rates(live.read_records(spark, str(flat))).isStreaming
