"""Registered queries against their SQL twins, plan shapes, and independence from partitioning."""

import pytest
from oracle_check import connect, difference

from rankloom.plans import catalog, views
from rankloom.plans.catalog import QUERIES
from rankloom.plans.sql import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    result = QUERIES[name](spark, SMALL).toArrow()
    assert difference(result, database.sql(ORACLES[name]).to_arrow_table()) == ""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["keyword_matrix", "keyword_queue", "page_opportunities"])
def test_reports_are_whole_by_default(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan


@pytest.mark.parametrize("name", ["first_wins_links", "keyword_terms_top10", "domain_examples_topn", "page_top10", "slug_overlap"])
def test_ranked_groups_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "row_number(), " in plan and "Partial" in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_product(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_branded_filter_reaches_the_stored_facts(spark, tmp_path):
    from rankloom.operators import keywords

    catalog.keyword_facts(spark, SMALL).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    plan = plan_of(keywords.keyword_overlap(facts))
    assert "PushedFilters: [IsNotNull(is_branded), IsNotNull(current_traffic)" in plan or "IsNotNull(is_branded)" in plan
    assert "current_position" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("operator", ["action_path", "queue_v2", "cohorts_b", "keyword_tasks"])
def test_results_do_not_depend_on_the_partitioning(spark, monkeypatch, operator):
    before = sorted(map(str, QUERIES[operator](spark, SMALL).collect()))
    whole = views.table

    def shuffled(session, folder, name):
        table = whole(session, folder, name)
        return table.repartition(7) if name in ("lineitem", "pages", "part") else table

    monkeypatch.setattr(views, "table", shuffled)
    assert sorted(map(str, QUERIES[operator](spark, SMALL).collect())) == before


def test_running_totals_end_at_the_total(spark):
    profile = {r.competitor_domain: r.domains for r in QUERIES["competitor_profile"](spark, SMALL).collect()}
    undated = {c: 0 for c in profile}
    for row in catalog.links_a(spark, SMALL).filter("first_seen = ''").groupBy("competitor_domain").count().collect():
        undated[row.competitor_domain] = row["count"]
    last = {}
    for row in QUERIES["cumulative_by_year"](spark, SMALL).orderBy("year").collect():
        last[row.competitor_domain] = row.cum_n_new
    assert {c: n + undated[c] for c, n in last.items()} == profile


def test_bands_sum_to_the_domains(spark):
    for row in QUERIES["competitor_profile"](spark, SMALL).collect():
        assert sum(row[f"dr_{b}"] for b in ("0_20", "20_40", "40_60", "60_80", "80_100")) == row.domains
