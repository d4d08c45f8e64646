"""Versioned snapshots, idempotent appends, and the model seam."""

import hashlib
import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from outreach_spark.operators import state
from outreach_spark.operators.seam import map_batches
from outreach_spark.functions import emails as EM
from outreach_spark.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_snapshot_versions_and_replay(spark, scratch):
    root = os.path.join(scratch, "snap")
    df1 = spark.range(5).withColumnRenamed("id", "k")
    assert state.write_snapshot(df1, root) == 0
    assert state.write_snapshot(spark.range(7).withColumnRenamed("id", "k"), root) == 1
    assert state.read_latest(spark, root).count() == 7
    # a version that is committed is neither dropped nor overwritten without notice
    with pytest.raises(ValueError):
        state.write_snapshot(spark.range(2).withColumnRenamed("id", "k"), root, version=1)
    assert state.read_latest(spark, root).count() == 7
    assert state.committed_versions(spark, root) == [0, 1]


def test_append_rows_dedupes_on_key(spark, scratch):
    root = os.path.join(scratch, "logs")
    a = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 2)], "log_key string, v int")
    assert state.append_rows(a, root, "log_key").count() == 2
    b = spark.createDataFrame([("k2", 2), ("k3", 3)], "log_key string, v int")
    state.append_rows(b, root, "log_key")
    assert sorted(r.log_key for r in state.read_rows(spark, root).collect()) == ["k1", "k2", "k3"]


def test_appends_are_folded_and_replays_add_nothing(spark, scratch):
    root = os.path.join(scratch, "logs2")
    batch = lambda ids: spark.createDataFrame([(f"k{i}", f"text {i}") for i in ids], "log_key string, body string")
    for n in range(6):
        added = state.append_rows(batch(range(n * 10 - 5 * (n > 0), n * 10 + 10)), root, "log_key", every=3)
        assert added.count() == 10  # five are there already, but for the first batch
        assert state.append_rows(batch(range(n * 10 + 10)), root, "log_key", every=3).count() == 0
    got = [r.log_key for r in state.read_rows(spark, root).collect()]
    assert sorted(got) == sorted(f"k{i}" for i in range(60))
    assert len(state.committed_versions(spark, os.path.join(root, "rows"), "batch=")) <= 6


def test_append_of_one_key_keeps_one_whole_row(spark):
    rows = [("k", f"text {i}", i) for i in range(50)] * 2 + [(None, "no key", 1), (None, "no key", 2)]
    df = spark.createDataFrame(rows, "log_key string, body string, v int")
    once, twice = [sorted(map(tuple, state.append_new(None, df.repartition(n), "log_key").collect()), key=str) for n in (3, 7)]
    assert once == twice and len([r for r in once if r[0] == "k"]) == 1
    assert [r for r in once if r[0] == "k"][0] in [tuple(r) for r in rows]
    plan = state.append_new(df, df, "log_key")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_changed_keys_hold_the_newest_row_and_refuse_another_stream(spark, scratch):
    st = state.ChangedKeys(spark, os.path.join(scratch, "st"), ["id", "ch"], every=3)
    rows = lambda ids, v: spark.createDataFrame([(f"u{i}", "main", v) for i in ids], "id string, ch string, v int")
    assert st.read() is None
    want = {}
    for n in range(8):
        ids = range(100) if n == 0 else [n, 50]
        assert st.put(rows(ids, n), n, "me") and not st.put(rows(ids, 99), n, "me")  # a replay changes nothing
        want |= {f"u{i}": n for i in ids}
        assert {r.id: r.v for r in st.read().collect()} == want
    assert len(state.committed_versions(spark, f"{st.root}/delta", "batch=")) <= 6 and len(state.committed_versions(spark, f"{st.root}/base")) == 2
    with pytest.raises(ValueError, match="another stream checkpoint"):
        st.put(rows([1], 1), 9, "you")


def test_map_batches_seam(spark):
    rp = fx.inbound_replies(spark, SF_SMALL)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"msg_id": pdf["msg_id"]})
        out["label"] = pdf["model_output"].fillna("").str.lower().str.contains("interest").map({True: "interest", False: "other"})
        return out

    got = map_batches(rp, label, "msg_id string, label string")
    want = rp.select("msg_id", F.when(F.lower(F.coalesce("model_output", F.lit(""))).contains("interest"), "interest").otherwise("other").alias("label"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_input_is_asked_once(spark, scratch):
    from outreach_spark.operators.seam import call_once

    calls, broken = os.path.join(scratch, "calls"), os.path.join(scratch, "broken")
    os.makedirs(calls)
    root = os.path.join(scratch, "results")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        import uuid

        texts = [None if pd.isna(t) else t for t in pdf["text"]]
        if os.path.exists(broken) and "t7" in texts:
            raise RuntimeError("the model is away")
        with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
            f.writelines(f"{t!r}\n" for t in texts)
        return pd.DataFrame({"label": ["none" if t is None else t.upper() for t in texts]})

    def asked():
        return Counter(line.strip() for n in os.listdir(calls) for line in open(os.path.join(calls, n)))

    def portion(t):
        return int(hashlib.sha256(("null" if t is None else "=" + t).encode()).hexdigest()[:4], 16) % 16

    rows = spark.createDataFrame([(i, f"t{i % 20}" if i % 7 else None) for i in range(100)], "id int, text string")
    texts = [None, *(f"t{i}" for i in range(20))]
    open(broken, "w").close()
    with pytest.raises(Exception, match="the model is away"):
        call_once(rows, ["text"], label, "label string", "v1", root).count()
    assert {repr(t) for t in texts if portion(t) < portion("t7")} <= set(asked())  # committed before the failure
    os.rename(broken, broken + ".gone")
    got = call_once(rows, ["text"], label, "label string", "v1", root)  # the failed run is repeated
    assert all(r.label == ("none" if r.text is None else r.text.upper()) for r in got.collect()) and got.count() == 100
    assert set(asked()) == {repr(t) for t in texts}
    assert all(asked()[repr(t)] == 1 for t in texts if portion(t) != portion("t7"))  # only the portion under way is asked again
    before = asked()
    more = rows.unionByName(spark.createDataFrame([(100, "new"), (101, "")], "id int, text string"))
    assert call_once(more, ["text"], label, "label string", "v1", root).filter("id >= 100 and label is not null").count() == 2
    assert asked() - before == Counter(["'new'", "''"])
    call_once(rows.filter("id = 1"), ["text"], label, "label string", "v2", root).count()
    assert asked()["'t1'"] == before["'t1'"] + 1  # another version of the function asks anew


def test_a_clustered_history_is_not_shuffled(spark, scratch):
    hist = spark.range(5000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("email_key"), F.col("id"))
    path = os.path.join(scratch, "hist")
    state.write_clustered(hist, "hist_by_key", path, ["email_key"], 8)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        day = spark.range(100).select(F.concat(F.lit("u"), (F.col("id") * 60).cast("string")).alias("email_key"))
        for _ in range(2):
            table = state.read_clustered(spark, "hist_by_key", path, hist.schema, ["email_key"], 8)
            out = day.join(table.select("email_key"), "email_key", "left_anti")
            assert out.count() == sum(1 for i in range(100) if i * 60 >= 5000)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the day's rows only
            spark.sql("DROP TABLE hist_by_key")  # an external table: the folder stays, the next session declares it again
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_masked_email_never_shows_local_part(spark):
    from hypothesis import given, settings, strategies as st

    local = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789._", min_size=2, max_size=12)

    @settings(max_examples=25, deadline=None)
    @given(st.lists(local, min_size=1, max_size=5))
    def check(locals_):
        rows = [(f"{l}@d.org",) for l in locals_]
        got = [r[0] for r in spark.createDataFrame(rows, "e string").select(EM.mask_email("e")).collect()]
        for (e,), m in zip(rows, got):
            assert m == e[0] + "***@d.org"

    check()


def test_export_csv_round_trip(spark, scratch):
    from outreach_spark.operators import export
    from outreach_spark.plans.registry import RUN_DATE
    from outreach_spark.sources.scans import scan_seen_emails

    c = fx.contacts(spark, SF_SMALL).filter(F.col("channel") == "main")
    exp = export.export_contacts(c, RUN_DATE, "main")
    path = os.path.join(scratch, "export_main")
    export.write_export(exp, path)
    back = export.read_export(spark, path)
    assert back.count() == exp.count()
    assert sorted(r.email for r in scan_seen_emails(back).collect()) == sorted(r.email for r in scan_seen_emails(exp).collect())
    assert sorted(map(tuple, back.select("author_id", "open_detected", "date_collected").collect())) == \
        sorted(map(tuple, exp.select("author_id", "open_detected", "date_collected").collect()))


def test_cluster_settings_scale_with_volume():
    from outreach_spark.session import cluster_settings

    small, big = cluster_settings(1 << 30), cluster_settings(100 << 40)
    assert small["spark.sql.shuffle.partitions"] == "2000"
    assert big["spark.sql.shuffle.partitions"] == str((100 << 40) // (256 << 20))
    assert cluster_settings(10 << 40)["spark.sql.shuffle.partitions"] == str((10 << 40) // (256 << 20))
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
