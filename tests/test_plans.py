"""The plans are the ones intended."""

import re

import pytest

from chatlake.operators import chats as CH, conversations as CV, lookups as L, quality as Q, retrieval as RT, sendlog as SL
from chatlake.plans import recovery as RV
from chatlake.sources.readers import scan_messages
from checks.inputs import Inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def test_filters_and_columns_reach_the_scan(inputs):
    text = plan(L.created_after(inputs.messages, "2024-01-15").select("message_id"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(created_at", text)
    assert re.search(r"ReadSchema: struct<message_id:bigint,created_at:timestamp>", text)


def test_top_k_never_sorts_everything(inputs):
    text = plan(L.topk_newest(inputs.message, 5))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_gap_detection_aggregates_numbers_by_hash(inputs):
    for df in (CV.gap_boundaries(inputs.direct), CV.conversation_messages(inputs.direct),
               CV.detector_comparison(inputs.direct, inputs.cuts)):
        text = plan(df)
        assert "SortAggregate" not in text and "partial_count" in text
    # Only the first messages of conversations meet a user id, behind a join.
    text = plan(CV.conversations(inputs.direct))
    sorted_steps = [x for x in re.findall(r"\(\d+\) SortAggregate.*?Functions \[\d+\]: (.*?)\n", text, re.S)]
    assert sorted_steps and all("user_id" in x and "count" not in x for x in sorted_steps)


def test_reports_decode_once(inputs):
    for df in (RV.refresh_report(inputs.message), Q.completeness_report(inputs.message, scan_messages(inputs.message), inputs.messages)):
        assert len(re.findall(r"\(\d+\) ArrowEvalPython", plan(df))) == 1


def test_no_cross_join_anywhere(inputs):
    for df in (CV.conversation_messages(inputs.direct), CH.best_chat_for_name(inputs.chats, inputs.chat_messages, inputs.chat_users),
               SL.rate_limit_audit(inputs.send_log), RT.cosine_topk(inputs.table("embeddings"), [0.1] * 64, 5),
               CH.chat_users_stats(inputs.chat_handle_join, inputs.users, inputs.chats)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_n_limits_each_group_before_the_shuffle(inputs):
    text = plan(L.newest_per_user(inputs.messages, 5))
    assert text.count("WindowGroupLimit") >= 2


def test_context_at_its_default_size_limits_groups_before_the_shuffle(inputs):
    from chatlake.operators.context import MAX_CONTEXT, last_n_context

    assert MAX_CONTEXT == 2000
    assert plan(last_n_context(inputs.messages, inputs.chat_messages)).count("WindowGroupLimit") >= 2


def test_bucketed_histories_need_no_shuffle(spark, inputs):
    from chatlake.plans.lake import bucket_messages
    from chatlake.session import scratch_path

    lake = bucket_messages(inputs.lake, scratch_path(spark, "buckets"), 4, prefix="plan_test")
    joined = CH.in_chats(lake.messages, lake.chat_messages)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert sorted(joined.collect()) == sorted(CH.in_chats(inputs.messages, inputs.chat_messages).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in ("plan_test_messages", "plan_test_chat_messages"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_message_texts_are_not_shuffled_to_choose_context(inputs):
    from chatlake.operators.context import last_n_context

    df = last_n_context(inputs.messages, inputs.chat_messages, 5)
    assert set(df.columns) >= {"chat_id", "position", "contents"}
    narrow = df.select("chat_id", "message_id", "position")
    assert "contents" not in plan(narrow)
