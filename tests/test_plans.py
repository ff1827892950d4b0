"""Physical-plan checks: the strategies the operators rely on at scale."""
from pyspark.sql import functions as F

from corpusmill.plans import catalog as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def full_plan(df):
    return df._jdf.queryExecution().toString()


def test_cap_per_group_uses_window_group_limit(spark, sf_small):
    p = full_plan(C.q_cap_per_group(spark, sf_small))
    assert "WindowGroupLimit" in p


def test_tail_uses_window_group_limit(spark, sf_small):
    assert "WindowGroupLimit" in full_plan(C.q_tail_n(spark, sf_small))


def test_cap_global_is_take_ordered(spark, sf_small):
    assert "TakeOrderedAndProject" in full_plan(C.q_cap_global(spark, sf_small))


def test_policy_join_is_not_forced(spark, sf_small):
    assert "Broadcast" not in C.policy.license_filter.__code__.co_names and "Join" in full_plan(C.q_license_filter(spark, sf_small))


def test_dedupe_limits_each_key_before_the_shuffle(spark, sf_small):
    p = full_plan(C.q_dedupe_first_wins(spark, sf_small))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_report_is_hash_aggregate_on_bigint(spark, sf_small):
    p = full_plan(C.q_collection_report(spark, sf_small))
    assert "HashAggregate" in p


def test_no_single_partition_window(spark, sf_small):
    for q in (C.q_progress_forward_fill, C.q_pack_sequences, C.q_cap_per_group, C.q_error_excerpt):
        p = full_plan(q(spark, sf_small))
        assert "SinglePartition" not in p, q.__name__


def test_scan_prunes_columns_and_pushes_filters(spark, sf_small):
    p = full_plan(C.q_select_sources(spark, sf_small))
    assert "PushedFilters: [IsNotNull(source), In(source" in p or "PushedFilters: [In(source" in p
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p


def test_alignment_has_no_join(spark, sf_small):
    p = full_plan(C.q_alignment_score(spark, sf_small))
    assert "Join" not in p and "CartesianProduct" not in p


def test_floor_below_is_scalar_subquery_without_action(spark, sf_small):
    df = C.q_seed_floor_below_small(spark, sf_small)   # building the plan runs no job
    p = full_plan(df)
    assert "Subquery" in p and "CartesianProduct" not in p


def test_text_functions_stay_in_codegen(spark, sf_small):
    df = C.q_dedupe_key(spark, sf_small)
    df.collect()                                   # the adaptive plan shows codegen once final
    p = plan(df)
    assert "WholeStageCodegen" in p or "*(" in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p


def test_caps_take_a_first_level_when_asked(spark, sf_small):
    from corpusmill.operators.combine import cap_total
    docs = C._ord_docs(spark, sf_small)
    two = cap_total(docs, 50, fanout=4)
    assert "SPARK_PARTITION_ID" in full_plan(two).upper() and "WindowGroupLimit" in full_plan(two)
    assert sorted(r.doc_id for r in two.collect()) == sorted(r.doc_id for r in cap_total(docs, 50).collect())


def exchanges(spark, df):
    """Shuffles of the plan when nothing is broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(df.select("*")).count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_page_caps_need_no_shuffle(spark, sf_small):
    for q in (C.q_crawl_paragraphs, C.q_cap_per_text):
        assert exchanges(spark, q(spark, sf_small)) == 0, q.__name__


def test_report_has_one_scan_and_no_join(spark, sf_small):
    p = plan(C.q_collection_report(spark, sf_small))
    assert "Join" not in p and p.count("FileScan") == 1


def test_html_parse_runs_once_per_page(spark, sf_small):
    for q in (C.q_html_main_text, C.q_crawl_paragraphs, C.q_html_passages, C.q_html_errors_split):
        p = plan(q(spark, sf_small))
        assert p.count("ArrowEvalPython") + p.count("MapInArrow") == 1, q.__name__


def test_filter_is_pushed_into_every_union_branch(spark, sf_small):
    df = C.q_union_sources(spark, sf_small).where(F.col("doc_id") > 7)
    below_union = df._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1]
    assert below_union.count("Filter") >= 4          # one per language branch
    assert below_union.count("> 7)") >= 4


def test_latest_progress_sorts_no_lines(spark, sf_small):
    """Hash aggregates only; the winning lines alone are sorted (one per run)."""
    p = full_plan(C.q_progress_latest(spark, sf_small))
    assert "SortAggregate" not in p and "HashAggregate" in p
