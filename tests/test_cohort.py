import datetime
import random

import pytest

from cohortlake.operators import cohort, dims, facts, profile, sketches

D = datetime.date.fromisoformat


@pytest.fixture
def made(spark):
    def build(users, features, usage, conversions):
        return (
            spark.createDataFrame([(u, s and D(s)) for u, s in users], "user_id int, signup_date date"),
            spark.createDataFrame([(k, n, D(d)) for k, n, d in features], "feature_id int, feature_name string, effective_from date"),
            spark.createDataFrame([(u, k, d and D(d)) for u, k, d in usage], "user_id int, feature_id int, first_used_date date"),
            spark.createDataFrame([(u, D(d), m) for u, d, m in conversions], "user_id int, conversion_date date, mrr int"))
    return build


def table(df):
    return {(r.feature_name, r.cohort): tuple(r)[2:] for r in df.collect()}


CASES = {
    "assignment": ([(1, "2024-01-10"), (2, "2024-01-10")], [(1, "x", "2024-01-01")], [(1, 1, "2024-01-11")], []),
    "rates": ([(1, "2024-01-10"), (2, "2024-01-10"), (3, "2024-01-10")], [(1, "x", "2024-01-01")], [], [(1, "2024-01-20", 99), (2, "2024-01-30", 299)]),
    "not available": ([(1, "2023-12-31"), (2, None)], [(1, "x", "2024-01-01")], [], []),
    "same names pool": ([(1, "2024-01-10")], [(1, "x", "2024-01-01"), (2, "x", "2024-02-01")], [(1, 2, "2024-03-01")], [(1, "2024-01-09", 5)]),
    "usage without a day": ([(1, "2024-01-10")], [(1, "x", "2024-01-01")], [(1, 1, None)], []),
    "empty": ([], [(1, "x", "2024-01-01")], [], []),
}


@pytest.mark.parametrize("case", CASES)
def test_rewrite_equals_the_grid(made, case):
    inputs = made(*CASES[case])
    assert table(cohort.impact(*inputs)) == table(cohort.impact_rewrite(*inputs))


def test_values(made):
    assert table(cohort.impact(*made(*CASES["rates"]))) == {("x", "available_not_used"): (3, 2, pytest.approx(2 / 3), 15.0, 199.0)}
    assert set(table(cohort.impact(*made(*CASES["assignment"])))) == {("x", "used_feature"), ("x", "available_not_used")}
    assert table(cohort.impact(*made(*CASES["not available"]))) == {("x", "not_available"): (2, 0, 0.0, None, None)}


def test_use_after_conversion_can_be_left_out(made):
    inputs = made([(1, "2024-01-10")], [(1, "x", "2024-01-01")], [(1, 1, "2024-02-01")], [(1, "2024-01-20", 5)])
    assert ("x", "used_feature") in table(cohort.impact(*inputs))
    assert ("x", "available_not_used") in table(cohort.impact(*inputs, require_before_conversion=True))


def test_pivot_and_lift(spark):
    impact = spark.createDataFrame([("x", "used_feature", 1.0), ("x", "available_not_used", 0.25), ("y", "used_feature", 0.5), ("y", "available_not_used", 0.0), ("z", "used_feature", 0.5)],
                                   "feature_name string, cohort string, conversion_rate double")
    assert {r.feature_name: r.not_available for r in cohort.pivot(impact).collect()} == dict.fromkeys("xyz")
    found = {r.feature_name: (r.lift_percent, r.lift_ratio) for r in cohort.lift(impact).collect()}
    assert found == {"x": (300.0, 4.0), "y": (float("inf"), float("inf"))}


def test_first_releases(spark):
    history = spark.createDataFrame([(1, "x", D("2024-01-01")), (1, "x", D("2024-06-01"))], "feature_id int, feature_name string, effective_from date")
    assert [r.effective_from for r in cohort.first_releases(history).collect()] == [D("2024-01-01")]


def test_usage_facts(spark):
    rows = [(1, 1, "2024-01-15"), (1, 1, "2024-01-16"), (1, 1, "2024-01-17"), (1, 1, "2024-01-17"), (2, 1, "2024-01-15"), (2, 1, "2024-01-15"), (3, 1, None)]
    events = spark.createDataFrame([(u, k, d and D(d)) for u, k, d in rows], "user_id int, feature_id int, event_date date")
    found = {r.user_id: r for r in facts.usage_facts(events, as_of=D("2024-02-01")).collect()}
    assert (found[1].total_usage_count, found[1].first_used_date, found[1].last_used_date, found[1].avg_daily_usage) == (4, D("2024-01-15"), D("2024-01-17"), pytest.approx(4 / 3))
    assert found[2].avg_daily_usage == 2.0 and found[3].avg_daily_usage is None and found[3].total_usage_count == 1
    early = facts.usage_facts(events, as_of=D("2024-01-15"), up_to_as_of=True).collect()
    assert {(r.user_id, r.total_usage_count) for r in early} == {(1, 1), (2, 2)}


def test_user_dim(spark):
    signups = spark.createDataFrame([(1, "a@b", "2024-01-15", "Small", "Tech"), (1, "a@b", "2024-01-15", "Small", "Tech"), (2, "c@d", "no date", "Large", "Finance")], "user_id int, email string, signup_date string, company_size string, industry string")
    conversions = spark.createDataFrame([(1, "2024-01-20", "pro", 99), (1, "2024-02-20", "enterprise", 299)], "user_id int, conversion_date string, plan string, mrr int")
    dim = dims.user_dim(signups, conversions)
    assert "email" not in dim.columns
    assert {(r.user_id, r.signup_date, r.current_plan) for r in dim.collect()} == {(1, D("2024-01-15"), "enterprise"), (2, None, "free")}


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "x string, y int")
    assert {tuple(r) for r in profile.counts_by(df, ["x", "y"]).collect()} == {("x", "a", 2), ("x", None, 1), ("y", "1", 1), ("y", "2", 2)}
    users = spark.createDataFrame([(1, D("2024-01-01")), (2, D("2024-01-01"))], "user_id int, signup_date date")
    none = spark.createDataFrame([], "user_id int, conversion_date date, mrr int")
    assert profile.with_without_feature(users, users.filter("user_id = 1"), none).first().asDict() == {
        "n_with": 1, "n_without": 1, "rate_with": 0.0, "rate_without": 0.0, "days_with": 0.0, "days_without": 0.0, "lift_points": 0.0}
    assert profile.mrr_summary(none, users).first().avg_mrr is None


@pytest.mark.parametrize("seed", range(3))
def test_use_before_conversion_equals_the_grid(made, seed):
    rng = random.Random(seed)
    day = lambda: f"2024-0{rng.randrange(1, 4)}-{rng.randrange(10, 29)}"
    users = [(u, rng.choice([day(), None])) for u in range(40)]
    features = [(k, f"f{k % 3}", day()) for k in range(5)]
    usage = [(u, k, rng.choice([day(), day(), None])) for u in range(40) for k in range(5) if rng.random() < 0.5]
    conversions = [(u, day(), rng.choice([5, None])) for u in range(40) if rng.random() < 0.6]
    inputs = made(users, features, usage, conversions)
    for before in (True, False):
        assert table(cohort.impact_rewrite(*inputs, require_before_conversion=before)) == table(cohort.impact(*inputs, require_before_conversion=before))


def test_grid_joins_by_slots(spark, made):
    users, features, _, _ = made([(u, None) for u in range(7)] + [(None, None)], [(k, "x", "2024-01-01") for k in range(5)], [], [])
    both = cohort.grid(users, features)
    assert both.count() == both.distinct().count() == 40
    assert not any(x in both._jdf.queryExecution().toString() for x in ("CartesianProduct", "NestedLoop"))
    assert cohort.grid(users.limit(0), features).count() == cohort.grid(users, features.limit(0)).count() == 0


def test_sketches_of_days_and_their_unions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3_000), k, D("2024-01-01") + datetime.timedelta(rng.randrange(20))) for k in (1, 2) for _ in range(6_000 * k)] + [(None, 1, D("2024-01-02")), (5, None, D("2024-01-02"))]
    events = spark.createDataFrame(rows, "user_id long, feature_id int, event_date date")
    whole = sketches.daily_users(events)
    parts = sketches.united(sketches.daily_users(events.filter("user_id % 2 = 0")), sketches.daily_users(events.filter("user_id % 2 = 1 OR user_id IS NULL")))
    for daily in (whole, parts):
        for first, last in ((1, 20), (3, 5), (7, 7)):
            found = {r.feature_id: (r.n_users, r.n_events) for r in sketches.users_between(daily, D(f"2024-01-{first:02d}"), D(f"2024-01-{last:02d}")).collect()}
            for k in (1, 2):
                own = [u for u, f, d in rows if f == k and first <= d.day <= last]
                exact = len(set(own) - {None})
                assert found[k][1] == len(own) and abs(found[k][0] - exact) <= sketches.error_bound() * exact
    assert sketches.users_between(sketches.daily_users(events.limit(0)), D("2024-01-01"), D("2024-01-02")).collect() == []
