"""Reports from changes, positions in hot groups, pages by number."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from outreach_spark.operators import incremental, positions, ranking
from outreach_spark.sources import fixtures as fx
from tests.conftest import SF_SMALL

SCHEMA = "id string, channel string, email_status string, contacted_at timestamp_ntz, genres array<string>, open_detected boolean, replied boolean, ab_variant string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_updated_reports_equal_full_ones_over_ten_versions(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)

    def contact():
        return (rng.choice(["main", "gmail"]), rng.choice(["sent", "pending", "bounced", "", None]), rng.choice([start + timedelta(hours=rng.randrange(300)), None]),
                rng.choice([None, [], ["a"], ["a", "b", " "], ["b"]]), rng.random() < 0.5, rng.choice([True, False, None]), rng.choice(["A", "B", None]))

    table = {f"u{i}": contact() for i in range(60)}
    frame = lambda t: spark.createDataFrame([(k, *v) for k, v in t.items()], SCHEMA)
    old = frame(table)
    reports = {n: rows_of(r.full(old)) for n, r in incremental.REPORTS.items()}
    schemas = {n: r.full(old).schema for n, r in incremental.REPORTS.items()}
    for version in range(10):
        for k in rng.sample(sorted(table), 8):
            if rng.random() < 0.3:
                del table[k]
            else:
                table[k] = contact()  # a correction of an old row
        table[f"n{version}"] = contact()
        new = frame(table)
        changes = incremental.snapshot_changes(old, new, ["id"], incremental.REPORT_COLUMNS)
        for n, r in incremental.REPORTS.items():
            reports[n] = rows_of(r.updated(spark.createDataFrame(reports[n], schemas[n]), changes))
            if version % 3 == 0 or version == 9:
                assert reports[n] == rows_of(r.full(new)), (version, n)
        old = new


def test_changes_name_what_happened(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), (None, 5)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), (None, 5), ("c", None)], "k string, v int")
    got = {r.k: (r.change, r.old and r.old.v, r.new and r.new.v) for r in incremental.snapshot_changes(old, new, ["k"], ["v"]).collect()}
    assert got == {"b": ("changed", 2, 3), "d": ("inserted", None, 4)}


def test_positions_in_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(f"m{i}", None if i % 3 == 0 else "hot" if i % 3 == 1 else f"a{i % 40}", start) for i, start in
            enumerate(datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(200)) for _ in range(6000))]
    df = spark.createDataFrame(rows, "msg_id string, author_id string, timestamp timestamp_ntz").repartition(6)
    got = {r.msg_id: r.seq for r in positions.message_positions(df).collect()}
    groups = {}
    for m, a, t in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(a, []).append(m)
    assert got == {m: n for ms in groups.values() for n, m in enumerate(ms)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = df.repartitionByRange(F.col("author_id").asc(), F.col("timestamp").asc(), F.col("msg_id").asc())
        sizes = [r.n for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 6000 / 4  # a third of the rows is one thread, a third has no author
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_threads_without_a_position_equal_a_loop(spark):
    msgs = fx.long_threads(spark, SF_SMALL)
    bare = msgs.drop("seq")
    placed = positions.with_positions(bare)
    got = {}
    for r in sorted(ranking.thread_text(placed).collect(), key=lambda r: r.chunk):
        got[r.author_id] = got.get(r.author_id, "") + r.thread_text
    want = {}
    for r in sorted(bare.collect(), key=lambda r: (r.timestamp, r.msg_id)):
        want[r.author_id] = want.get(r.author_id, "") + f"[{r.direction.upper()}] Subject: {r.subject or ''}\nBody: {r.body or ''}\n---\n"
    assert got == want


def test_pages_by_number_equal_the_sorted_table(spark, scratch):
    c = fx.contacts(spark, SF_SMALL)
    root = os.path.join(scratch, "pages")
    positions.write_pages(c, root, parts=20)
    for page, status, channel in [(1, None, "all"), (2, "sent", "all"), (7, None, "gmail"), (40, None, "all"), (75, None, "all"), (9999, None, "all"), (3, "sent", "main")]:
        got = positions.read_page(spark, root, page, status=status, channel=channel)
        want = ranking.contacts_page(c, page=page, status=status, channel=channel)
        assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], page
    assert len(positions.read_page(spark, root, 40).inputFiles()) <= 2
    with pytest.raises(ValueError):
        positions.read_page(spark, root, 1, channel="fax")
