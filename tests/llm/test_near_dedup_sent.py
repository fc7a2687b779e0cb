"""What near duplicates send between tasks."""

from __future__ import annotations

import random

from pacelake.llm import near_dedup


def sent_bytes(spark, work):
    """What `work` returns, and the bytes that its stages wrote for others to read."""
    context = spark.sparkContext
    context.setJobGroup("sent", "sent")
    try:
        out = work()
    finally:
        jobs = context.statusTracker().getJobIdsForGroup("sent")
        context._jsc.clearJobGroup()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = context._jsc.sc().statusStore()
    stages = {s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_confirm_sends_few_texts_that_are_in_no_pair(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(60))) for i in range(2000)]
    rows += [(i + 5000, f"{text} more") for i, text in rows[:10]] + [(5003, rows[3][1])]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(4).localCheckpoint()
    pairs = spark.createDataFrame([(i, i + 5000) for i in range(10)] + [(20, 21)], "a long, b long")
    got, sent = sent_bytes(spark, lambda: near_dedup.confirm(pairs, texts, 2, 80).distinct().collect())
    assert sorted((r.a, r.b) for r in got) == [(i, i + 5000) for i in range(10)]
    assert sent < sum(len(x) for _, x in rows) / 4


def test_wanted_texts_are_whole(spark, monkeypatch):
    rows = [(k * 7, f"t{k}") for k in range(-3000, 3000)] + [(7, "again"), (None, "no id")]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for bits in (near_dedup.MAP_BITS, 32768):
        monkeypatch.setattr(near_dedup, "MAP_BITS", bits)  # with the second, each bit of the map is set
        for ids in ([], [7], range(-21000, 21000)):
            got = near_dedup._wanted(texts, (spark.range(ids[0], ids[-1] + 1) if ids else spark.range(0))).collect()
            assert sorted((r.id, r.text) for r in got) == sorted(r for r in rows if r[0] is not None and r[0] in set(ids))
