"""Physical-plan shape checks for the scale-critical operators."""

import re

import pytest

import __spark_entry__ as se
from conftest import SF_SMALL


def plan_of(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_children(plan: str) -> list[str]:
    """The first operator under every ``Exchange SinglePartition`` that is
    not a row-wise Project / Filter."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        for child in lines[i + 1:]:
            op = re.sub(r"^[\s:+\-*()0-9]*", "", child)
            if not op.startswith(("Project", "Filter")):
                out.append(child)
                break
    return out


@pytest.mark.parametrize("name", ["revenue_concentration", "rfm_summary", "rfm_summary_inverted",
                                  "rfm_segments", "revenue_distribution", "mom_growth",
                                  "quantity_distribution", "days_to_second_stats"])
def test_no_single_partition_over_raw_rows(spark, name):
    """Anything funnelled into one partition is already aggregated."""
    for child in single_partition_children(plan_of(spark, name)):
        assert re.search(r"(Object)?HashAggregate", child), child


@pytest.mark.parametrize("name", ["revenue_concentration", "rfm_segments", "revenue_distribution"])
def test_ranking_labels_rows_in_place(spark, name):
    """One lazy plan: rows are compared with cut points from scalar
    subqueries; no range exchange, window or join of them."""
    plan = plan_of(spark, name)
    assert "Subquery" in plan and "Scan ExistingRDD" not in plan
    for step in ("rangepartitioning", "ntile", "Window", "percentile"):
        found = re.search(rf"\b{step}\b", plan)
        assert not found or name == "revenue_concentration" and step in ("rangepartitioning", "Window"), step


@pytest.mark.parametrize("name", ["revenue_concentration", "rfm_summary", "rfm_summary_inverted", "rfm_segments", "revenue_distribution"])
def test_ranking_runs_few_jobs(spark, plain, name):
    """None when the frame is built, under ten in all."""
    from basketry.plans.registry import run_entry
    sc, group = spark.sparkContext, f"jobs-{name}"
    run_entry(name, plain)             # opens the files
    sc.setJobGroup(group, "")
    try:
        df = run_entry(name, plain)
        assert not sc.statusTracker().getJobIdsForGroup(group)
        df.write.format("noop").mode("overwrite").save()
        assert 0 < len(sc.statusTracker().getJobIdsForGroup(group)) < 10
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_the_passes_read_one_exchange(spark, plain):
    """The per-customer sums are shuffled once for all passes."""
    from basketry.plans.registry import run_entry
    df = run_entry("rfm_summary", plain)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["funnel", "device_conversion", "traffic_conversion",
                                  "funnel_dropoff", "bounce_rate", "bounce_recovery",
                                  "uplift_vs_conversion", "uplift_vs_conversion_points",
                                  "funnel_customers"])
def test_flag_family_has_no_expand(spark, name):
    assert "Expand" not in plan_of(spark, name)


@pytest.mark.parametrize("name", ["days_to_second_stats", "days_to_second_purchase"])
def test_second_purchase_limits_before_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert "WindowGroupLimit" in plan
    assert "SortMergeJoin" not in plan         # no self-join


@pytest.mark.parametrize("name", ["top_products", "top_customers"])
def test_top_n_is_one_lazy_plan(spark, name):
    plan = plan_of(spark, name)
    assert "TakeOrderedAndProject" in plan and "Scan ExistingRDD" not in plan


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """The mapped tables written to Parquet and read back: no shuffle that
    the mapping did helps the plans."""
    from basketry.plans.tables import FIXTURE_AS_OF, Tables
    from basketry.schemas import RAW_SCHEMAS
    source = Tables.from_fixtures(spark, SF_SMALL)
    root = tmp_path_factory.mktemp("plain")
    paths = {n: f"{root}/{n}" for n in RAW_SCHEMAS}
    for n, path in paths.items():
        getattr(source, n).write.parquet(path)
    return Tables.read(spark, paths, as_of=FIXTURE_AS_OF)


@pytest.mark.parametrize("name", ["channel_performance", "objective_performance"])
def test_one_scan_and_one_exchange_of_campaign_facts(spark, plain, name):
    """Facts meet the campaigns where they are read, and are exchanged once,
    by (label, id), after partial sums."""
    from basketry.plans.registry import run_entry
    plan = run_entry(name, plain)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    by_id = [i for i in exchanges if re.search(r"hashpartitioning\((channel|objective)#\d+, (is_tx#\d+, id|transaction_id)#", lines[i])]
    assert "Expand" not in plan and plan.count("Scan parquet") == 2 and len(by_id) == 1
    assert "partial_" in lines[by_id[0] + 1]
    # the other exchange has a row a label
    assert len(exchanges) == 2 and "partial_" in lines[exchanges[0] + 1]


def test_session_identity_has_no_expand(spark, plain):
    from basketry.plans.registry import run_entry
    assert "Expand" not in run_entry("session_identity_check", plain)._jdf.queryExecution().executedPlan().toString()


def test_mart_views_are_live(spark, plain, tmp_path):
    """Registering runs nothing, and new rows of a table are seen."""
    import uuid

    from basketry.plans.marts import mart_views
    from basketry.plans.tables import Tables
    from basketry.sources import register_views
    name = f"tx_{uuid.uuid4().hex[:8]}"
    plain.transactions.write.option("path", str(tmp_path / "tx")).saveAsTable(name)
    try:
        t = Tables(customers=plain.customers, products=plain.products, campaigns=plain.campaigns, events=plain.events,
                   transactions=spark.table(name), as_of=plain.as_of)
        sc = spark.sparkContext
        sc.setJobGroup("live-views", "")
        register_views(mart_views(t))
        assert not sc.statusTracker().getJobIdsForGroup("live-views")
        sc.setLocalProperty("spark.jobGroup.id", None)
        def totals():
            return (spark.sql("select sum(frequency) from rfm_segments").first()[0], spark.sql("select sum(total_purchases) from customer_summary").first()[0],
                    spark.sql("select sum(total_purchases) from cohort_analysis").first()[0])
        before = totals()
        one = plain.sales.join(plain.cu, "customer_id", "left_semi").first()
        new = plain.transactions.where(f"transaction_id = {one.transaction_id}").selectExpr(
            "transaction_id + 1000000000 as transaction_id", *[c for c in plain.transactions.columns if c != "transaction_id"])
        new.write.insertInto(name)
        assert totals() == tuple(x + 1 for x in before)
    finally:
        spark.sql(f"drop table {name}")


def test_every_entry_over_plain_tables_equals_the_oracle(spark, plain):
    from basketry.plans.registry import ENTRIES, run_entry
    from oracle_check import duck, rows_of
    con, oracle = duck(SF_SMALL), se.oracle_sql()
    for name in ENTRIES:
        got = run_entry(name, plain)
        want = con.execute(oracle[name])
        assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall()), name


def test_results_come_in_the_declared_order(spark, plain):
    from basketry.plans.registry import ROW_ORDER, run_entry
    for name, order in ROW_ORDER.items():
        rows = run_entry(name, plain).collect()
        def key(r):
            return [(r[c.lstrip("-")] is None) == (c[0] == "-") for c in order[:1]]
        first = order[0].lstrip("-")
        values = [r[first] for r in rows if r[first] is not None]
        assert values == sorted(values, reverse=order[0][0] == "-"), name
        assert sorted(rows, key=key) == rows or all(r[first] is not None for r in rows), name


def test_funnel_dropoff_computes_funnel_once(spark):
    plan = plan_of(spark, "funnel_dropoff")
    assert plan.count("Scan parquet") == 1 and "Union" not in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = se.queries()["event_type_counts"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) <= {"event_id", "event_type", "props"}


def test_customer_joins_pre_aggregate(spark):
    """The fact is reduced to one row per customer before the dimension join."""
    plan = plan_of(spark, "loyalty_behavior")
    join_at = min(plan.find("BroadcastHashJoin") if "BroadcastHashJoin" in plan else 10**9,
                  plan.find("SortMergeJoin") if "SortMergeJoin" in plan else 10**9)
    agg_below = plan.find("HashAggregate", join_at)
    assert agg_below > join_at


def test_no_cross_join_anywhere(spark):
    """No registered query plans a cartesian product or nested-loop join."""
    from basketry.plans.registry import ENTRIES
    for name in ENTRIES:
        plan = plan_of(spark, name)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
