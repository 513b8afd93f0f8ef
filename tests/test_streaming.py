import uuid

from ledgerlens.plans import enrich
from ledgerlens.session import work_dir
from ledgerlens.streaming.scorer import score_with_snapshot, start
from tests.fixtures import SCHEMA, contracts


def test_stream_scores_like_the_snapshot(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6 + 1000 * i, "end": 100 + i,
             "added": i % 9} for i in range(300)]
    df = contracts(spark, rows)
    snap = enrich.build_from_frame(df)
    base = f"{work_dir(spark)}/stream-test-{uuid.uuid4().hex[:8]}"
    df.limit(120).write.parquet(f"{base}/in/part1")
    q = start(snap, f"{base}/in/part1", SCHEMA, f"{base}/out", f"{base}/ckpt", available_now=True)
    q.awaitTermination(120)
    got = {r.contract_id: (r.signals, r.is_anomaly, round(r.anomaly_score, 9))
           for r in spark.read.parquet(f"{base}/out").collect()}
    want = {r.contract_id: (r.signals, r.is_anomaly, round(r.anomaly_score, 9))
            for r in snap.rows.collect() if r.contract_id in got}
    assert len(got) == 120 and got == want
    batch = score_with_snapshot(df, snap)
    assert batch.count() == 300
