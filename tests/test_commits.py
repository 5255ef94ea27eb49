"""Published ledgers under two writers, and streams whose work follows what a batch touches."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.schema import LEDGER
from ledgerloom.sources import sinks
from ledgerloom.streaming import jobs


def rows(spark, *days, user=1, category="Shopping", start=0):
    data = [
        (user, f"k{start + n:03d}", dt.date.fromisoformat(d), "shop", Decimal(a), "DEBIT", False, False, category, "default", None, f"h{start + n:03d}")
        for n, (d, a) in enumerate(days)
    ]
    return spark.createDataFrame(data, LEDGER)


def test_the_second_of_two_writers_fails_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.publish(rows(spark, ("2026-01-05", 1)), path)
    base = sinks.newest(spark, path)
    sinks.publish(rows(spark, ("2026-01-05", 1), ("2026-02-05", 2)), path, base)
    with pytest.raises(sinks.Overtaken):
        sinks.publish(rows(spark, ("2026-01-05", 1), ("2026-03-05", 3)), path, base)
    assert sorted(r.amount for r in sinks.read_published(spark, path).collect()) == [1, 2]
    assert sinks.newest(spark, path) == base + 1
    assert [r.amount for r in sinks.read_published(spark, path, base).collect()] == [1]


def test_an_overtaken_insert_starts_again_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    sinks.publish(rows(spark, ("2026-01-05", 1)), path)
    real, calls = sinks.publish, []

    def publish(ledger, path, *more):
        calls.append(more)
        if len(calls) == 1:  # another writer is quicker
            real(rows(spark, ("2026-02-05", 2), start=1), path, more[0], ["2026-02"])
        return real(ledger, path, *more)

    monkeypatch.setattr(sinks, "publish", publish)
    batch = rows(spark, ("2026-01-05", 1), ("2026-02-05", 2), ("2026-02-07", 3))
    after = sinks.publish_rows(batch, path)
    assert len(calls) == 2 and [c[0] for c in calls] == [0, 1]
    assert sorted((r.import_hash, r.amount) for r in after.collect()) == [("h000", 1), ("h001", 2), ("h002", 3)]


def test_an_insert_writes_only_the_months_it_touches(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.publish(rows(spark, ("2026-01-05", 1), ("2026-02-05", 2)), path)
    before = sinks.parts(spark, path)
    sinks.publish_rows(rows(spark, ("2026-02-06", 3), start=5), path)
    after = sinks.parts(spark, path)
    assert after["2026-01"] == before["2026-01"] and after["2026-02"] != before["2026-02"]
    again = sinks.publish_rows(rows(spark, ("2026-02-06", 3), start=5), path)
    assert sinks.parts(spark, path) == after and again.count() == 3


def test_an_empty_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert sinks.newest(spark, path) == -1 and sinks.read_published(spark, path).count() == 0
    assert sinks.publish_rows(rows(spark), path).count() == 0
    assert sinks.publish_rows(rows(spark, ("2026-02-06", 3)), path).count() == 1


def _slices(spark, tmp_path, *slices):
    for k, days in enumerate(slices):
        rows(spark, *days, start=100 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return lambda: spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


SLICES = ([("2026-06-01", 10)], [("2026-04-02", 20)], [("2025-04-27", 30)], [("2026-06-01", 75), ("2025-04-27", 70)], [("2026-06-09", 1)])


def test_state_has_two_versions_a_month_and_reads_no_other_month(spark, tmp_path, monkeypatch):
    stream = _slices(spark, tmp_path, *SLICES)
    budget = spark.createDataFrame([(1, "2025-04", "Shopping", 100.0), (1, "2026-06", "Shopping", 90.0)], "user_id BIGINT, month STRING, category_name STRING, recommended DOUBLE")
    read, real = [], jobs.read_state
    monkeypatch.setattr(jobs, "read_state", lambda s, p, months=None, before=None: read.append(months) or real(s, p, months, before))
    state, alerts = str(tmp_path / "state"), str(tmp_path / "alerts")
    jobs.write_alerts(stream(), budget, state, alerts, str(tmp_path / "c")).awaitTermination()
    assert all(m is not None and len(m) <= 2 for m in read)
    for month in ("2025-04", "2026-04", "2026-06"):
        assert len(sinks.versions(spark, f"{state}/month={month}")) <= 2
    found = sorted((r.month, r.level, r.batch) for r in spark.read.schema(jobs.ALERT).parquet(alerts).collect())
    assert [(m, x) for m, x, _ in found] == [("2025-04", "critical"), ("2025-04", "warning"), ("2026-06", "warning")]
    assert {r.month: r.spent for r in jobs.month_totals(spark, state).collect()} == {"2025-04": 100.0, "2026-04": 20.0, "2026-06": 86.0}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    for k, days in enumerate(SLICES):
        jobs._advance(rows(spark, *days), k, path, None, jobs.DEFAULTS)
        jobs._advance(rows(spark, *days), k, path, None, jobs.DEFAULTS)
    assert {r.month: r.spent for r in jobs.month_totals(spark, path).collect()} == {"2025-04": 100.0, "2026-04": 20.0, "2026-06": 86.0}


@pytest.mark.parametrize("dated", [True, False])
def test_ingest_looks_up_only_what_a_batch_touches(spark, tmp_path, monkeypatch, dated):
    stream = _slices(spark, tmp_path, *SLICES)
    looked, real = [], sinks.versions
    monkeypatch.setattr(sinks, "versions", lambda s, p: looked.append(p) or real(s, p))
    path = str(tmp_path / "ledger")
    twice = stream().unionByName(stream())
    jobs.ingest(twice, path, str(tmp_path / "c"), dt.date(2026, 6, 15), dated=dated).awaitTermination()
    stored = spark.read.schema(jobs._with_batch(rows(spark))).parquet(path)
    assert sorted(r.amount for r in stored.collect()) == [1, 10, 20, 30, 70, 75]
    if dated:  # a batch of one month lists folders of that month only
        assert all(f"key_month={m}" in p for p, m in zip(looked, [x.split("key_month=")[1][:7] for x in looked]))
        assert {x.split("key_month=")[1][:7] for x in looked} == {"2025-04", "2026-04", "2026-06"}


def test_recent_ingest_leaves_out_what_is_too_late(spark, tmp_path):
    stream = _slices(spark, tmp_path, *SLICES)
    path = str(tmp_path / "ledger")
    twice = stream().unionByName(stream())
    jobs.ingest_recent(twice, path, str(tmp_path / "c"), "500 days").awaitTermination()
    stored = spark.read.schema(jobs._with_batch(rows(spark))).parquet(path)
    assert sorted(r.amount for r in stored.collect()) == [1, 10, 20, 30, 70, 75]
    assert stored.where(F.col("import_hash").isNull()).count() == 0


def test_a_refresh_reads_only_the_accounts_that_changed(spark, tmp_path, monkeypatch):
    from ledgerloom.operators import spend
    from ledgerloom.plans import forecasts
    from ledgerloom.schema import category_dim

    as_of, category, path = dt.date(2026, 7, 15), category_dim(spark), str(tmp_path / "f")
    days = [(f"2026-0{m}-05", 100 + 10 * m) for m in range(1, 7)]
    whole = rows(spark, *days)
    for user in range(2, 8):
        whole = whole.unionByName(rows(spark, *[(d, a * user) for d, a in days], user=user, start=100 * user))
    seen, real = [], spend.monthly_spend
    monkeypatch.setattr(spend, "monthly_spend", lambda led, cat: seen.append({r.user_id for r in led.select("user_id").distinct().collect()}) or real(led, cat))
    assert forecasts.refresh_forecasts(whole, category, path, as_of).count() == 7
    assert forecasts.refresh_forecasts(whole, category, path, as_of).count() == 0
    more = whole.unionByName(rows(spark, ("2026-06-20", 500), user=3, start=900)).filter("user_id <> 5")
    assert sorted(r.user_id for r in forecasts.refresh_forecasts(more, category, path, as_of).collect()) == [3, 5]
    assert seen == [{1, 2, 3, 4, 5, 6, 7}, {3}]
    found = sorted((r.user_id, r.category_name, r.amount, r.method, r.months) for r in forecasts.stored_forecasts(spark, path).collect())
    other = str(tmp_path / "g")
    forecasts.refresh_forecasts(more, category, other, as_of)
    want = sorted((r.user_id, r.category_name, r.amount, r.method, r.months) for r in forecasts.stored_forecasts(spark, other).collect())
    assert found == want and {f[0] for f in found} == {1, 2, 3, 4, 6, 7}


def greedy(edges):
    """bank rows in order, each taking its best group that is not full."""
    by_row = {}
    for e in edges:
        by_row.setdefault((e["bank_order"], e["bank_key"]), []).append(e)
    used, out = {}, set()
    for key in sorted(by_row):
        for e in sorted(by_row[key], key=lambda e: (e["pref"], e["group_id"])):
            if used.get(e["group_id"], 0) < e["capacity"]:
                used[e["group_id"]] = used.get(e["group_id"], 0) + 1
                out.add((e["bank_key"], e["group_id"], used[e["group_id"]]))
                break
    return out


@pytest.mark.parametrize("limit", [200_000, 40, 0])
def test_merge_in_parts_is_the_greedy_choice(spark, monkeypatch, limit):
    """Swept parts, parts settled in rounds, and both at once."""
    import random

    from ledgerloom.operators import matching

    monkeypatch.setattr(matching, "PART_EDGES", limit)
    rng = random.Random(limit)
    day = lambda: dt.date(2026, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 2, 3, 5, 40, 41, 43, 90]))
    bank = [(rng.randrange(3), f"b{k:03d}", rng.randrange(90), day(), Decimal(rng.choice([10, 10, 11, 250, 255]))) for k in range(150)]
    mail = [
        (rng.randrange(3), f"m{k:03d}", day(), "shop", Decimal(rng.choice([10, 11, 250, 252, 260])), "DEBIT", False, False, "Shopping", "default", None, rng.choice(["email-", "email-fx-"]) + str(k))
        for k in range(90)
    ]
    left = spark.createDataFrame(bank, "user_id BIGINT, bank_key STRING, bank_order INT, txn_date DATE, amount DECIMAL(18,2)")
    edges, _ = matching.merge_candidates(left, spark.createDataFrame(mail, LEDGER))
    listed = [r.asDict(recursive=False) | {"pref": tuple(r.pref)} for r in edges.collect()]
    assert len(listed) > 100
    found = {(r.bank_key, r.group_id, r.place) for r in matching.one_to_one(edges).collect()}
    assert found == greedy(listed)


def test_merge_without_candidates(spark):
    from ledgerloom.operators import matching

    left = spark.createDataFrame([], "user_id BIGINT, bank_key STRING, bank_order INT, txn_date DATE, amount DECIMAL(18,2)")
    edges, _ = matching.merge_candidates(left, spark.createDataFrame([], LEDGER))
    assert matching.one_to_one(edges).collect() == []
