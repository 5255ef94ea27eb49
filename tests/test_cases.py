"""Small literal cases of the operators' rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.models import evaluation, naive_bayes, selection
from ledgerloom.operators import classify, cycles, forecast, insights, matching, receipts, recurring, spend
from ledgerloom.plans import budget as bd
from ledgerloom.plans import pipeline
from ledgerloom.plans import questions as qa
from ledgerloom.schema import CATEGORY, GOAL, LEDGER, PROFILE, category_dim
from ledgerloom.sources import sinks
from ledgerloom.sources import statements as st
from ledgerloom.streaming import jobs

D = dt.date
_id = iter(range(1, 10**9))


def row(date, description, amount, txn_type="DEBIT", category=None, salary=False, user=1, **more):
    key = f"t{next(_id):06d}"
    return (
        user, key, D.fromisoformat(date), description, _dec(amount), txn_type, salary, more.get("flagged", False), category,
        more.get("source", "default"), None, more.get("hash", "h-" + key),
    )


def _dec(x):
    from decimal import Decimal

    return Decimal(str(x)).quantize(Decimal("0.01"))


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), LEDGER)


def profile(spark, salary=10000, day=25, user=1):
    return spark.createDataFrame([(user, "A", _dec(salary), day)], PROFILE)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("1,200.50", 1200.5), ("(45.00)", -45.0), ("K 12", 12.0), ("ZMW 3.5", 3.5), ("-", None), ("nan", None), ("", None),
        ("abc", None), ("12d", None), ("-7", -7.0), ("1e3", 1000.0), (None, None),
    ],
)
def test_amounts(spark, raw, expected):
    assert one(spark, money.parse_amount(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("2026-01-05", D(2026, 1, 5)), ("2026/1/5", D(2026, 1, 5)), ("05/03/2026", D(2026, 3, 5)), ("5 Mar 2026", D(2026, 3, 5)),
        ("2026-01-05 10:00:00", D(2026, 1, 5)), ("not-a-date", None), ("2026-02-31", None), ("", None), ("5 MARCH 2026", D(2026, 3, 5)),
        ("05/13/2026", D(2026, 5, 13)),
    ],
)
def test_dates(spark, raw, expected):
    assert one(spark, dates.parse_date(F.lit(raw))) == expected


@pytest.mark.parametrize(
    "day,pay,expected", [(D(2026, 3, 1), 31, D(2026, 2, 28)), (D(2026, 4, 30), 31, D(2026, 4, 30)), (D(2026, 1, 3), 25, D(2025, 12, 25))]
)
def test_payday(spark, day, pay, expected):
    assert one(spark, dates.last_payday(F.lit(day), F.lit(pay))) == expected


def test_cycle_weeks(spark):
    weeks = [one(spark, dates.cycle_week(F.lit(d), F.lit(25))) for d in (D(2026, 3, 25), D(2026, 4, 2), D(2026, 4, 21), D(2026, 4, 24))]
    assert weeks == [1, 2, 4, 4]


@pytest.mark.parametrize(
    "words,code",
    [("Total $5", "USD"), ("K 50.00 (approx $2)", None), ("EUR 3", "EUR"), ("£9", "GBP"), ("R 120", "ZAR"), ("plain", None), ("ZMW 4 USD", None)],
)
def test_currency(spark, words, code):
    assert one(spark, text.currency(F.lit(words))) == code


def test_phone(spark):
    mask = lambda raw, w: one(spark, text.phone_mask(F.lit(raw), F.lit(w)))
    assert mask("+260 961 234 567", "mtn") == "096 ••• 4567"
    assert mask("0961234567", "airtel") is None
    assert mask("12345", "mtn") is None


# --- Statements ------------------------------------------------------------------------


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount,Type\n2026-01-05,\"Shop\nrite, A\",\"1,200.00\",Debit\n\n2026-01-06,Pay,100,CR\n")
    (tmp_path / "b.csv").write_bytes("Date,Narration,Debit,Credit\n2026-02-01,Café,450.00,\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("Date,Amount\n2026-01-01,5\n")
    (tmp_path / "d.csv").write_text("")
    raw = st.resolved(st.read_statements(spark, str(tmp_path)))
    rejects = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in st.file_rejects(raw).unionByName(st.empty_files(spark, str(tmp_path))).collect()}
    assert rejects == {"c.csv": "missing column(s): description", "d.csv": "empty file"}
    rows = st.clean_rows(raw.filter("pos > 1").withColumn("user_id", F.lit(1)), D(2026, 6, 15)).filter("reject_reason IS NULL")
    got = sorted((r["pos"], r["description"], r["txn_type"], r["value"]) for r in rows.collect())
    assert got == [(2, "Café", "DEBIT", 450.0), (2, "Shop\nrite, A", "DEBIT", 1200.0), (3, "Pay", "CREDIT", 100.0)]


def _import(spark, rows):
    present = F.array(*map(F.lit, ("date", "description", "amount")))
    df = spark.createDataFrame(rows, "user_id BIGINT, file STRING, pos BIGINT, date STRING, description STRING, amount STRING")
    none = F.lit(None).cast("string")
    return df.withColumns({"type": none, "debit": none, "credit": none, "present": present})


def test_reimport_is_a_no_op_and_equal_fares_stay(spark):
    rows = [(1, "f1", 2, "2026-03-01", "Bus fare", "-10"), (1, "f1", 3, "2026-03-01", "Bus fare", "-10"), (1, "f1", 4, "2062-01-01", "x", "-1")]
    empty = spark.createDataFrame([], "user_id BIGINT, import_hash STRING")
    first = pipeline.import_rows(_import(spark, rows), empty, D(2026, 6, 15))
    assert first.added.count() == 2
    again = pipeline.import_rows(_import(spark, [(1, "f2", *r[2:]) for r in rows]), first.added, D(2026, 6, 15))
    report = pipeline.import_report(again).first()
    assert (report["imported"], report["duplicates"], report["rejected"]) == (0, 2, 1)


def test_append_keeps_rows_without_key(spark):
    batch = ledger(spark, row("2026-01-01", "a", 1, hash=None), row("2026-01-01", "b", 2, hash="x"), row("2026-01-02", "c", 3, hash="x"))
    stored = ledger(spark, row("2025-01-01", "old", 1, hash="y"))
    assert sorted(r["description"] for r in sinks.new_rows(batch, stored).collect()) == ["a", "b"]


# --- Salary, cycles, recurring -----------------------------------------------------------


def _salary(spark, rows, salary=10000, day=25):
    out = cycles.detect_salary(ledger(spark, *rows), profile(spark, salary, day)).filter("is_salary").collect()
    return sorted((r["txn_date"].isoformat(), float(r["amount"])) for r in out)


def test_salary(spark):
    credit = lambda d, a, **k: row(d, "Pay", a, "CREDIT", **k)
    assert _salary(spark, [credit("2026-04-22", 10000), credit("2026-04-25", 10000)]) == [("2026-04-25", 10000.0)]
    assert _salary(spark, [credit("2026-05-01", 10000)], day=30) == [("2026-05-01", 10000.0)]
    assert _salary(spark, [credit("2026-04-10", 10000), credit("2026-04-25", 20000)]) == []
    raised = [credit("2026-04-25", 10000, salary=True), credit("2026-05-25", 10000, salary=True), credit("2026-06-25", 16000)]
    assert len(_salary(spark, raised, 16000)) == 3


def test_cycle_average(spark):
    rows = [row(f"2026-0{m}-26", "Shop", 300, category="Groceries") for m in (1, 2, 3)]
    got = cycles.cycle_profile(ledger(spark, *rows), category_dim(spark), profile(spark), D(2026, 5, 10)).first()
    assert (got["cycles"], got["week1"], got["total"], got["has_surge"]) == (3, 300.0, 300.0, True)


@pytest.mark.parametrize(
    "entries,found",
    [
        ([("2026-01-08", "NETFLIX.COM 8837", 189), ("2026-02-08", "NETFLIX.COM 9021", 189), ("2026-03-08", "NETFLIX.COM 1130", 189)], 189.0),
        ([("2026-01-08", "Spotify", 79), ("2026-02-08", "Spotify", 82), ("2026-03-08", "Spotify", 79)], 79.0),
        ([("2026-01-08", "Shop", 450), ("2026-02-08", "Shop", 1300), ("2026-03-08", "Shop", 780)], None),
        ([("2026-01-01", "Gym", 50), ("2026-01-08", "Gym", 50), ("2026-01-15", "Gym", 50)], None),
        ([("2026-01-08", "N", 189), ("2026-02-08", "N", 189)], None),
    ],
)
def test_recurring(spark, entries, found):
    got = recurring.recurring(ledger(spark, *[row(d, n, a) for d, n, a in entries])).collect()
    assert [r["monthly_amount"] for r in got] == ([] if found is None else [found])


def test_recurring_candidates_never_lose_a_group(spark):
    rng = random.Random(7)
    rows, groups = [], {}
    for g in range(120):
        n, gap = rng.randint(2, 9), rng.choice((1, 20, 24, 30, 38, 45))
        day, charges = D(2024, 1, 1), []
        for _ in range(n):
            charges.append((day, 100 * rng.choice((1, 1, 1, 1.1, 1.3))))
            day += dt.timedelta(days=max(0, gap + rng.randint(-3, 3)))
        groups[f"m{chr(97 + g % 26)}{chr(97 + g // 26)}"] = charges
        rows += [row(d.isoformat(), f"m{chr(97 + g % 26)}{chr(97 + g // 26)} 1", a) for d, a in charges]
    import statistics

    expected = set()
    for key, charges in groups.items():
        amounts, days = [round(a, 2) for _, a in charges], [d for d, _ in charges]
        if len(charges) < 3:
            continue
        middle = statistics.median(amounts)
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        if all(abs(a - middle) <= middle * 0.15 + 1e-9 for a in amounts) and 24 <= statistics.median(gaps) <= 38:
            expected.add(key)
    got = {r["key"] for r in recurring.recurring(ledger(spark, *rows)).collect()}
    assert got == expected and expected


# --- Forecasts ------------------------------------------------------------------------------


def _series(spark, values):
    return spark.createDataFrame([(1, "c", [float(v) for v in values])], "user_id BIGINT, category_name STRING, values ARRAY<DOUBLE>")


def test_selection(spark):
    got = forecast.select_methods(_series(spark, [1500, 300] * 3 + [1500])).first()
    assert got["method"] == "arima" and got["cv_error"] < 50
    got = forecast.select_methods(_series(spark, range(500, 1101, 100))).first()
    assert got["method"] == "linear" and got["cv_error"] < 50
    got = forecast.select_methods(_series(spark, [1000, 1100, 1050, 1080])).first()
    assert got["method"] == "mean" and got["cv_error"] is None


def test_croston(spark):
    got = _series(spark, [0, 0, 900] * 3).select(forecast.forecast_croston("values").alias("x")).first()["x"]
    assert abs(got - 300) <= 50


def _forecast(spark, rows, as_of):
    return {
        r["category_name"]: r
        for r in forecast.forecast(spend.monthly_spend(ledger(spark, *rows), category_dim(spark)), as_of).collect()
    }


def test_forecast_cases(spark):
    short = [row("2026-01-10", "x", 900, category="Groceries"), row("2026-02-10", "x", 1100, category="Groceries")]
    got = _forecast(spark, short, D(2026, 4, 1))["Groceries"]
    assert (got["method"], got["amount"]) == ("mean", 1000.0)
    rows = [row(f"2026-0{m}-10", "x", 900, category="Groceries") for m in range(1, 7)]
    rows += [row("2026-01-10", "y", 500, category="Entertainment"), row("2026-02-10", "y", 400, category="Entertainment")]
    got = _forecast(spark, rows, D(2026, 8, 1))
    assert set(got) == {"Groceries"} and got["Groceries"]["method"] == "constant"
    falling = [row(f"2026-0{m}-10", "x", a, category="Groceries") for m, a in enumerate((2000, 1500, 1000, 500, 100), 1)]
    assert _forecast(spark, falling, D(2026, 7, 1))["Groceries"]["amount"] >= 0


def test_gap_months_and_current_month(spark):
    rows = [row(d, "x", 1000, category="Groceries") for d in ("2026-01-10", "2026-04-10")]
    grid = spend.month_grid(spend.monthly_spend(ledger(spark, *rows), category_dim(spark)), D(2026, 6, 1)).orderBy("month").collect()
    assert [r["amount"] for r in grid] == [1000.0, 0.0, 0.0, 1000.0]


def test_one_account_alone_forecasts_the_same(spark):
    rng = random.Random(3)
    rows = [
        row(f"2025-{m:02d}-10", "x", rng.randint(100, 900), category=c, user=u)
        for u in (1, 2, 3) for m in range(1, 13) for c in ("Groceries", "Transport")
    ]
    whole = ledger(spark, *rows)
    spent = lambda df: spend.monthly_spend(df, category_dim(spark))
    pick = lambda df: sorted((r["category_name"], r["method"], r["amount"]) for r in df.filter("user_id = 2").collect())
    alone = forecast.forecast(spent(whole.filter("user_id = 2")), D(2026, 1, 5))
    assert pick(forecast.forecast(spent(whole.repartition(17)), D(2026, 1, 5))) == pick(alone)


# --- Budgets -----------------------------------------------------------------------------------


def _budget(spark, rows, salary, goals=(), as_of=D(2026, 6, 15)):
    data, dim = ledger(spark, *rows), category_dim(spark)
    funded = bd.goal_waterfall(spark.createDataFrame(list(goals), GOAL), spend.savings_pool(data), as_of)
    spent = spend.monthly_spend(data, dim)
    return bd.build_budget(
        profile(spark, salary), forecast.forecast(spent, as_of), spend.actual_spend(data, dim), bd.month_debits(data, "2026-06"),
        funded, dim, "2026-06",
    )


def test_trim_to_salary(spark):
    rows = [row(f"2026-0{m}-10", "x", 4000, category="Housing") for m in range(1, 6)]
    rows += [row(f"2026-0{m}-10", "y", 2000, category="Entertainment") for m in range(1, 6)]
    made = _budget(spark, rows, 5000)
    summary = made.summary.first()
    assert summary["overcommitted"] and summary["allocated_total"] <= 5000
    lines = {r["category_name"]: r["recommended"] for r in made.lines.collect()}
    assert lines == {"Housing": 4200.0, "Entertainment": 800.0}


@pytest.mark.parametrize("used,status", [(500, "ok"), (800, "warning"), (1100, "over"), (799.6, "warning")])
def test_alert_levels(spark, used, status):
    rows = [row(f"2026-0{m}-10", "x", 1000, category="Entertainment") for m in range(1, 6)] + [row("2026-06-02", "x", used, category="Entertainment")]
    assert _budget(spark, rows, 50000).lines.first()["status"] == status


def test_waterfall(spark):
    rows = [row("2026-01-01", "pay", 10000, "CREDIT"), row("2026-01-02", "x", 4000)]
    goals = [(1, 1, "a", _dec(5000), D(2026, 12, 1)), (1, 2, "b", _dec(5000), D(2027, 12, 1))]
    got = bd.goal_waterfall(spark.createDataFrame(goals, GOAL), spend.savings_pool(ledger(spark, *rows)), D(2026, 6, 1))
    assert [r["saved"] for r in got.orderBy("goal_id").collect()] == [5000.0, 1000.0]


def test_withdrawal_is_not_spending(spark):
    rows = [row("2026-06-01", "ATM", 500, category="Cash Withdrawal"), row("2026-06-02", "x", 200, category="Groceries")]
    assert spend.month_totals(ledger(spark, *rows)).first()["expenditure"] == 200.0


def test_insights(spark):
    dim = category_dim(spark)
    visits = lambda n: ledger(spark, *[row("2026-06-01", "Shop A 1", 10, category="Groceries") for _ in range(n)])
    assert insights.high_frequency(visits(5)).count() == 1 and insights.high_frequency(visits(4)).count() == 0
    spread = lambda *a: ledger(spark, *[row("2026-06-01", f"m{'abc'[i]}", x, category="Shopping") for i, x in enumerate(a)])
    assert insights.concentration(spread(300, 200, 100).filter("1=1"), dim).count() == 0
    assert insights.concentration(spread(400, 200), dim).count() == 1
    assert insights.concentration(spread(100, 100, 100), dim).count() == 0
    assert insights.concentration(spread(100), dim).count() == 0


# --- Receipts --------------------------------------------------------------------------------------


def _items(spark, body):
    df = spark.createDataFrame([("k", body)], "k STRING, text STRING")
    rows = receipts.receipt_items(df).orderBy("line_no").collect()
    total = receipts.receipt_totals(df, "k").collect()
    return [(r["name"], r["price"], r["quantity"]) for r in rows], (total[0]["total"] if total else None)


@pytest.mark.parametrize(
    "body,items,total",
    [
        ("Bread 25.00\nMilk 40.00\nSUBTOTAL 65.00\nVAT 10.40\nTOTAL 75.40\nCASH 100.00\nCHANGE 24.60", [("Bread", 25.0, 1), ("Milk", 40.0, 1)], 75.4),
        ("Eggs 2 x 12.50 25.00", [("Eggs", 25.0, 2)], None),
        ("Eggs 2x 12.50 25.00", [("Eggs", 25.0, 2)], None),
        ("Eggs 2 @ 12.50 25.00", [("Eggs", 25.0, 2)], None),
        ("Eggs 2 12.50 25.00", [("Eggs", 25.0, 2)], None),
        ("Bread 700g 9.99 25.00", [("Bread 700g 9 99", 25.0, 1)], None),
        ("Sofa Set 1,250.00", [("Sofa Set", 1250.0, 1)], None),
        ("Item 9999999.00", [], None),
        ("AMOUNT DUE K1,240.50", [], 1240.5),
        ("Ring 1 x 9.50 9.50", [("Ring 1 x", 9.5, 1)], None),
    ],
)
def test_receipt_text(spark, body, items, total):
    assert _items(spark, body) == (items, total)


def test_html(spark):
    page = "<html><head><title>T</title></head><style>p{}</style><table><tr><td>Trip&nbsp;fare</td><td>K 45.00</td></tr></table><p>Bye</p>"
    assert one(spark, receipts.html_to_text(F.lit(page))) == "Trip fare K 45.00\nBye"


# --- Matching -----------------------------------------------------------------------------------------


def test_one_to_one_equals_the_greedy_loop(spark):
    """Bank rows in order each take the nearest free receipt, many copies included."""
    rng = random.Random(11)
    receipts_, bank = [], []
    for i in range(160):
        converted = rng.random() < 0.3
        amount = rng.choice((10, 10, 10, 20, 20.01, 35.5, 100))
        receipts_.append(
            row(f"2026-03-{rng.randint(1, 20):02d}", "mail", amount, user=rng.choice((1, 1, 1, 2)), hash=f"email-{'fx-' if converted else ''}{i:03d}", source=rng.choice(("user", "rule")), category="Shopping")
        )
    for i in range(140):
        bank.append((rng.choice((1, 1, 1, 2)), f"b{i:03d}", i, D(2026, 3, rng.randint(1, 22)), "card", _dec(rng.choice((10, 10.01, 20, 20.5, 35.5, 101))), f"new-{i}", "Groceries", "rule", 1.0))
    data = ledger(spark, *receipts_)
    frame = spark.createDataFrame(
        bank,
        "user_id BIGINT, bank_key STRING, bank_order BIGINT, txn_date DATE, description STRING, amount DECIMAL(18,2), import_hash STRING, "
        "category_name STRING, category_source STRING, category_confidence DOUBLE",
    )
    merged, unmatched = matching.merge_receipts(frame, data)
    got = {r["bank_key"]: r["receipt_key"] for r in merged.collect()}

    free, expected = {r[1]: r for r in receipts_}, {}
    for user, key, _order, on, _d, amount, *_rest in bank:
        best = None
        for rk, rr in free.items():
            fx = rr[11].startswith("email-fx-")
            tolerance = round(float(amount) * 0.05 + 1e-9, 2) if fx else 0.01
            if rr[0] != user or abs((rr[2] - on).days) > 3 or abs(float(rr[4]) - float(amount)) > tolerance + 1e-9:
                continue
            pref = (abs((rr[2] - on).days), abs(rr[4] - amount), rr[2], rr[4], fx, rk)
            best = min(best, (pref, rk)) if best else (pref, rk)
        if best:
            expected[key] = best[1]
            del free[best[1]]
    assert got == expected and len(got) > 60
    assert unmatched.count() == len(bank) - len(got)
    assert all(r["category_name"] == "Shopping" for r in merged.filter("category_source = 'user'").collect())


def test_nearest_debit_brute_force(spark):
    rng = random.Random(5)
    debits = [row(f"2026-03-{rng.randint(1, 25):02d}", "d", rng.choice((5, 9.99, 10, 10.01, 10.4, 100, 104, 95.3))) for _ in range(120)]
    asks = [(1, f"r{i:03d}", D(2026, 3, rng.randint(1, 25)), _dec(rng.choice((5, 10, 100, 7))), rng.random() < 0.5) for i in range(80)]
    got = {
        r["receipt_key"]: r["txn_key"]
        for r in matching.nearest_debit(
            spark.createDataFrame(asks, "user_id BIGINT, receipt_key STRING, on DATE, amount DECIMAL(18,2), converted BOOLEAN"), ledger(spark, *debits)
        ).collect()
    }
    expected = {}
    for _u, key, on, amount, converted in asks:
        tolerance = round(float(amount) * 0.05, 2) if converted else 0.01
        near = [
            (abs((d[2] - on).days), abs(d[4] - amount), d[1])
            for d in debits
            if abs((d[2] - on).days) <= 3 and float(abs(d[4] - amount)) <= tolerance + 1e-9
        ]
        if near:
            expected[key] = min(near)[2]
    assert got == expected and expected


def test_find_receipt_status(spark):
    schema = "user_id BIGINT, message_key STRING, sent_on DATE, sender_name STRING, sender_addr STRING, body_text STRING, amount DECIMAL(18,2), converted BOOLEAN"
    mail = lambda key, amount, name="Uber": (1, key, D(2026, 3, 10), name, "a@b.c", "", None if amount is None else _dec(amount), False)
    def status(amount, *messages):
        debit = ledger(spark, row("2026-03-11", "UBER *TRIP", amount))
        return matching.find_receipts(debit, spark.createDataFrame(list(messages), schema)).first()["status"]

    assert status(50, mail("a", 50)) == "matched"
    assert status(55, mail("a", 50)) == "sole"
    assert status(12, mail("a", 50), mail("b", 30)) == "ambiguous"
    assert status(50, mail("a", None)) == "unreadable"
    assert status(50, mail("a", 50, "Netflix")) == "not_found"


def test_rates_stale(spark):
    rates = spark.createDataFrame([(D(2026, 1, 1), "ZMW", "USD", 0.04)], "as_of DATE, base STRING, code STRING, per_local DOUBLE")
    asks = spark.createDataFrame([(D(2026, 1, 1), "USD", 10.0), (D(2026, 1, 2), "USD", 10.0), (D(2025, 1, 2), "USD", 10.0)], "on DATE, currency STRING, amount DOUBLE")
    got = sorted((r["on"], r["local_amount"], r["rate"], r["stale"]) for r in matching.convert_receipts(asks, rates).collect() if r["converted"])
    assert got == [(D(2026, 1, 1), 250.0, 25.0, False), (D(2026, 1, 2), 250.0, 25.0, True)]


# --- Models ------------------------------------------------------------------------------------------------


def test_rules(spark):
    names = [one(spark, classify.rule_category(F.lit(d))) for d in ("Shoprite Manda Hill", "ATM WITHDRAWAL", "Airtel Money Transfer", "Zzz", "", "Chicken Inn")]
    assert names == ["Groceries", "Cash Withdrawal", "Transfers", None, None, "Dining Out"]


def test_rules_see_only_their_words(spark):
    """A text without its other words has the category that the patterns give the whole text."""
    rng, known = random.Random(5), sorted(classify._rule_words())
    others = ["foo", "123", "cash", "ca\u017fh", "Atm", "AGENT", "withdrawal", "pays", "x-1", "\u00e9", "bus.fare", "out"]
    rows = [" ".join(rng.choice(known if rng.random() < 0.5 else others) for _ in range(rng.randint(0, 6))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in [*rows, None]], "description STRING").withColumn("text", text.normalise("description"))
    plain = F.when(F.col("text") == "", None).when(F.coalesce("description", F.lit("")).rlike(classify.WITHDRAWAL), "Cash Withdrawal")
    for pattern, name in classify.RULES:
        plain = plain.when(F.col("text").rlike(pattern), name)
    got = classify.with_rule_category(df, "ruled").withColumns({"plain": plain, "column": classify.rule_category("description")})
    assert got.filter("not (ruled <=> plain) or not (column <=> plain)").count() == 0
    assert got.filter("plain is not null").count() > 1000


@pytest.mark.parametrize("name", ["ml_rule_category", "ml_rule_category_documents"])
def test_rules_normalise_a_text_once(spark, name):
    from ledgerloom import registry

    registry.load()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9") == 1


def _labelled(spark):
    words = {"Groceries": "shoprite spar market", "Transport": "taxi fuel bus", "Housing": "rent landlord deposit"}
    rows = [
        (f"{c}{i}", f"{w} {'abcdefgh'[i % 8]} place", 10.0 + i, i % 7, 1 + i % 28, c, "rule", 1)
        for c, ws in words.items() for i in range(12) for w in ws.split()
    ]
    return spark.createDataFrame(
        [(f"{r[0]}-{n}", *r[1:]) for n, r in enumerate(rows)],
        "row_id STRING, text STRING, amount DOUBLE, day_of_week INT, day_of_month INT, category_name STRING, category_source STRING, weight INT",
    )


def test_naive_bayes_and_selection(spark):
    frame = _labelled(spark)
    model = naive_bayes.fit(frame.withColumnRenamed("row_id", "doc_id"))
    said = model.predict(frame).select(F.col("category_name").alias("y"), F.col("predicted_category").alias("pred"))
    assert evaluation.macro_score(said) >= 0.85
    chosen, fitted = selection.train(frame, trees=8)
    assert chosen.f1 >= 0.85 and chosen.folds == 5 and fitted.predict(frame.limit(1)).first()["predicted_category"]
    assert selection.gate(frame.limit(5)).algorithm is None


# --- Questions -----------------------------------------------------------------------------------------------


def _parse(spark, *turns, items=None):
    data = spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(turns)], "conv_id BIGINT, turn BIGINT, user_id BIGINT, text STRING")
    merchants = spark.createDataFrame([(1, "shoprite manda hill"), (1, "uber trip")], "user_id BIGINT, term STRING")
    names = spark.createDataFrame([(1, t) for t in (items or ["none here"])], "user_id BIGINT, term STRING")
    slots = qa.extract_slots(data, profile(spark), category_dim(spark), D(2026, 11, 19), merchants, names)
    return qa.carry_context(slots).orderBy("turn").collect()


@pytest.mark.parametrize(
    "words,start,end",
    [
        ("how much did i spend", D(2026, 11, 1), D(2026, 11, 30)), ("last month", D(2026, 10, 1), D(2026, 10, 31)),
        ("last 3 months", D(2026, 8, 22), D(2026, 11, 19)), ("this cycle", D(2026, 10, 25), D(2026, 11, 19)),
        ("last cycle", D(2026, 9, 25), D(2026, 10, 24)), ("in december", D(2025, 12, 1), D(2025, 12, 31)),
        ("march 2025", D(2025, 3, 1), D(2025, 3, 31)), ("spent in may", D(2026, 5, 1), D(2026, 5, 31)),
        ("may i ask how much i spent", D(2026, 11, 1), D(2026, 11, 30)),
    ],
)
def test_periods(spark, words, start, end):
    got = _parse(spark, words)[0]["period"]
    assert (got["start"], got["end"]) == (start, end)


def test_slots_and_follow_ups(spark):
    got = _parse(spark, "how much at shoprite", "shoprite manda hill spending", "how much did i spend on bread?", items=["white bread"])
    assert [r["merchant"] for r in got][:2] == ["shoprite", "shoprite manda hill"]
    assert (got[2]["intent"], got[2]["receipt_item"]) == ("receipt", "bread")
    got = _parse(spark, "how much on transport", "and last month?", "tell me a joke", "what about groceries?", "how much do i have left")
    assert [(r["intent"], r["categories"]) for r in got] == [
        ("spend", ["Transport"]), ("spend", ["Transport"]), (None, []), ("spend", ["Groceries"]), ("left", []),
    ]
    assert got[3]["period"]["label"] == "last month"
    got = _parse(spark, "how much on groceries", "compare with last month")
    assert (got[1]["intent"], got[1]["categories"], got[1]["period"]["label"]) == ("compare", ["Groceries"], "this month")
    assert _parse(spark, "how much did I spend on groceries with cash")[0]["categories"] == ["Groceries"]
    assert _parse(spark, "can i afford 2.5k")[0]["amount"] == 2500.0


def test_added_category_is_unique(spark):
    new = spark.createDataFrame([("  pet care ", "ESSENTIAL"), ("GROCERIES", "ESSENTIAL"), ("x", "OTHER"), ("y" * 41, "ESSENTIAL")], CATEGORY)
    names = [r["category_name"] for r in sinks.add_categories(category_dim(spark), new).collect()]
    assert len(names) == 18 and "Pet Care" in names


# --- The import as a whole, and late stream rows ---------------------------------------------------------


def _stored(spark, tmp_path, *rows):
    path = str(tmp_path / "ledger")
    columns = ["user_id", "txn_key", "txn_date", "description", "amount", "txn_type", "is_salary", "is_subscription", "category_name", "category_source", "category_confidence", "import_hash"]
    sinks.publish(ledger(spark, *rows).select(*columns), path)
    return path


def test_import_merges_in_statement_order(spark, tmp_path):
    """Two bank rows compete for one receipt: the earlier file and line takes it, whatever their hashes."""
    receipt = row("2026-03-05", "mail", 120, hash="email-abc", source="user", category="Transport")
    path = _stored(spark, tmp_path, receipt)
    statement = [
        (1, "f2", 2, "2026-03-05", "Uber trip", "-120.00"),
        (1, "f1", 9, "2026-03-06", "Uber other", "-120.00"),
        (1, "f1", 3, "2026-03-07", "Uber first", "-120.00"),
        (1, "f1", 4, "2026-03-25", "Salary", "3000"),
        (1, "f1", 5, "bad", "Uber", "-1"),
    ]
    rows = _import(spark, statement)
    no_date = _import(spark, [(1, "f3", 2, "2026-03-05", "x", "-5")]).withColumn("present", F.array(F.lit("description"), F.lit("amount")))
    report = {r["file"]: r for r in pipeline.import_statements(rows.unionByName(no_date), path, profile(spark, 3000), D(2026, 6, 15)).collect()}
    counts = lambda f: tuple(report[f][c] for c in ("rows", "rejected", "credits", "imported", "merged", "salaries", "duplicates"))
    assert counts("f1") == (4, 1, 1, 2, 1, 1, 0) and counts("f2") == (1, 0, 0, 1, 0, 0, 0)
    assert report["f3"]["file_reason"] == "missing column(s): date" and report["f3"]["rows"] is None
    after = sinks.read_published(spark, path).collect()
    (held,) = [r for r in after if r["txn_key"] == receipt[1]]
    assert (held["description"], held["category_name"], held["category_source"]) == ("Uber first", "Transport", "user")
    assert len(after) == 4 and [r["description"] for r in after if r["is_salary"]] == ["Salary"]
    again = pipeline.import_statements(rows, path, profile(spark, 3000), D(2026, 6, 15))
    assert again.agg(F.sum("imported"), F.sum("merged"), F.sum("duplicates")).first()[:] == (0, 0, 4)
    assert sinks.read_published(spark, path).count() == 4


def test_a_failing_import_leaves_nothing_visible(spark, tmp_path):
    path = _stored(spark, tmp_path, row("2026-01-01", "old", 1, hash="y"))
    before = sinks.read_published(spark, path).collect()
    fails = F.udf(lambda x: 1 // 0, "string")
    broken = sinks.read_published(spark, path).withColumn("description", fails("description"))
    with pytest.raises(Exception):
        sinks.publish(broken.unionByName(sinks.read_published(spark, path)), path)
    assert sinks.read_published(spark, path).collect() == before
    sinks.publish(sinks.read_published(spark, path).filter("false"), path)
    assert sinks.read_published(spark, path).count() == 0


def test_late_stream_rows_count(spark, tmp_path):
    """Rows 60 and 400 days behind the newest are in the totals and raise alerts."""
    slices = [[("2026-06-01", 10)], [("2026-04-02", 20)], [("2025-04-27", 30)], [("2026-06-01", 5), ("2025-04-27", 70)]]
    for k, days in enumerate(slices):
        ledger(spark, *[row(d, "shop", a, category="Shopping") for d, a in days]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = ledger(spark, row("2026-06-01", "shop", 1)).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.write_totals(stream(), str(tmp_path / "daily"), str(tmp_path / "state")).awaitTermination()
    totals = {r["month"]: r["spent"] for r in jobs.month_totals(spark, str(tmp_path / "daily")).collect()}
    assert totals == {"2026-06": 15.0, "2026-04": 20.0, "2025-04": 100.0}
    budget = spark.createDataFrame([(1, "2025-04", "Shopping", 100.0), (1, "2026-06", "Shopping", 90.0)], "user_id BIGINT, month STRING, category_name STRING, recommended DOUBLE")
    jobs.write_alerts(stream(), budget, str(tmp_path / "d2"), str(tmp_path / "alerts"), str(tmp_path / "s2")).awaitTermination()
    found = spark.read.schema(jobs.ALERT).parquet(str(tmp_path / "alerts")).collect()
    assert sorted((r["month"], r["level"]) for r in found) == [("2025-04", "critical"), ("2025-04", "warning")]


def test_stop_words_and_category_phrases(spark):
    assert qa.pattern_words(r"\b(shops?|earn(ed)?)\b|\bpay\s*day\b") == {"shop", "shops", "earn", "earned", "pay", "day"}
    words = qa.stopwords()
    assert {"the", "spend", "month", "transactions", "budget"} <= set(words) and not {"shoprite", "blue", "anvil"} & set(words)
    asks = ["airtime and data", "airtime & data", "my grocery bill", "food in may", "goods", "dining outing", "rent, food", "data2"]
    rows = spark.createDataFrame([(a,) for a in asks], "words STRING")
    found = {r["words"]: (r["categories"], r["label"]) for r in qa.with_categories(rows, "words", category_dim(spark)).collect()}
    assert found["airtime and data"] == found["airtime & data"] == (["Airtime & Data"], "Airtime & Data")
    assert found["my grocery bill"] == (["Groceries"], "Groceries") and found["food in may"] == (["Groceries", "Dining Out"], "food")
    assert found["goods"] == ([], None) and found["dining outing"] == ([], None) and found["data2"] == (["Airtime & Data"], "Airtime & Data")


def test_refresh_declines_or_takes_the_seed(spark):
    """Too few labels: no model, rules only; with a seed: a model; a metric row either way."""
    few = ledger(spark, row("2026-03-01", "corner shop", 5, category="Groceries", source="user"), row("2026-03-02", "shoprite", 5, category="Uncategorised"))
    plain = pipeline.refresh(few, category_dim(spark), D(2026, 6, 15))
    assert plain.model is None and plain.chosen.reason == "only 3 labelled rows"
    assert plain.metric.select("algorithm", "sample_count", "notes").first()[:] == (None, 3, "only 3 labelled rows")
    assert {r["description"]: r["category_name"] for r in plain.ledger.collect()} == {"corner shop": "Groceries", "shoprite": "Groceries"}
    seed = spark.createDataFrame([(f"{w} {k}", 0.0, 0, 1, c, "seed") for k in range(12) for w, c in (("kfc", "Dining Out"), ("zesco", "Utilities"))], "text STRING, amount DOUBLE, day_of_week INT, day_of_month INT, category_name STRING, category_source STRING")
    taught = pipeline.refresh(few, category_dim(spark), D(2026, 6, 15), seed=seed)
    assert taught.model is not None and taught.metric.first()["sample_count"] == 27


def test_categories_with_many_parts(spark):
    """A category's name is found however many words, signs and digits it has."""
    names = ["Repairs, paint and garden of the house we let (2019-2024)", "Crédit à taux zéro d'été é è ê ë ô", "Fuel"]
    category = spark.createDataFrame([(n,) for n in names], "category_name string")
    rows = [(k, f"how much did i spend on {n.lower()} last month") for k, n in enumerate(names)] + [(9, "how much on let (2019"), (10, "")]
    found = qa.with_categories(spark.createDataFrame(rows, "id int, text string"), "text", category).collect()
    assert {r.id: r.categories for r in found} == {**{k: [n] for k, n in enumerate(names)}, 9: [], 10: []}
    none = qa.with_categories(spark.createDataFrame(rows, "id int, text string"), "text", category.limit(0)).collect()
    assert all(r.categories == [] for r in none)


def test_phrases_split_a_text_once(spark):
    """No lambda over the words, which would split the text again for each of them."""
    from ledgerloom.operators.ranges import phrases

    df = spark.createDataFrame([("a b c d",), ("a",), ("",), (None,)], "d STRING")
    got = df.select(phrases(F.col("d")).alias("p"))
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["p"] for r in got.collect()] == [["a b c", "b c d", "a b", "b c", "c d", "a", "b", "c", "d"], ["a"], [], None]


def test_questions_are_worked_out_once(spark):
    """The patterns of a question run once, however many parts read its slots, and its baseline is cut once."""
    profile = spark.createDataFrame([(1, 25)], "user_id BIGINT, salary_day INT")
    asked = spark.createDataFrame([(1, 0, 1, "Compare my groceries to last month"), (1, 1, 1, "fees for school and data")], "conv_id BIGINT, turn BIGINT, user_id BIGINT, text STRING")
    slots = qa.extract_slots(asked, profile, category_dim(spark), D(2001, 8, 20))
    assert "afford" not in slots._jdf.queryExecution().optimizedPlan().toString()
    got = {r["turn"]: (r["intent"], r["label"], r["period"]["label"]) for r in slots.collect()}
    assert got == {0: ("compare", "Groceries", "this month"), 1: (None, "Education", "this month")}
    period = qa.with_asked_period(asked.withColumn("salary_day", F.lit(25)), "text", D(2001, 8, 20), "salary_day")
    assert period._jdf.queryExecution().optimizedPlan().toString().count(qa.BASELINE) <= 4
