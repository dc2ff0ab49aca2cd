import random
from collections import defaultdict
from datetime import timedelta

import pandas as pd
import pytest
from chat_times import EPOCH
from pyspark.sql import functions as F

from chatlake.operators import conversations as CV
from chatlake.plans import conversations as PC
from chatlake.plans.conversations import boundaries_from_answers, detect_conversations


def split(times, cuts, least=2):
    """Reference by hand: (first, last, size) of each stretch."""
    found, start = [], 0
    for end in sorted({min(c, len(times) - 1) for c in cuts if c >= 0} | {len(times) - 1}):
        if end >= start and end - start + 1 >= least:
            found.append((times[start][1], times[end][1], end - start + 1, start))
        start = max(start, end + 1)
    return found


@pytest.fixture(scope="module")
def busy(spark):
    """A chat with a third of the rows, pauses around the limit, equal instants."""
    rng = random.Random(3)
    rows, clock = [], defaultdict(int)
    for i in range(1500):
        c = 0 if i % 3 == 0 else rng.randrange(1, 40)
        clock[c] += rng.choice([0, 1, 30, 3600, 47 * 3600, 48 * 3600 - 1, 48 * 3600, 48 * 3600 + 1, 100 * 3600])
        rows.append((c, i, f"u{i % 3}", i % 2 == 0, EPOCH + timedelta(seconds=clock[c]), f"m{i}"))
    df = spark.createDataFrame(
        rows, "chat_id bigint, message_id bigint, user_id string, is_from_me boolean, created_at timestamp, contents string")
    chats = defaultdict(list)
    for c, m, *_rest in rows:
        chats[c].append((_rest[2], m))
    return {c: sorted(ms) for c, ms in chats.items()}, df.repartition(8)


def gaps(times, hours=48):
    return [i - 1 for i in range(1, len(times)) if times[i][0] - times[i - 1][0] >= timedelta(hours=hours)]


def shape(found):
    return {(r["chat_id"], r["start_message_id"], r["end_message_id"], r["message_count"], r["start_index"]) for r in found.collect()}


@pytest.mark.parametrize("hours", [48, 1, 0.5])
def test_gaps_match_neighbour_scan(busy, hours):
    chats, df = busy
    want = {(c, i) for c, ms in chats.items() for i in gaps(ms, hours)}
    assert {(r["chat_id"], r["after_message_index"]) for r in CV.gap_boundaries(df, hours).collect()} == want


def test_conversations_match_neighbour_scan(busy):
    chats, df = busy
    want = {(c, *s) for c, ms in chats.items() for s in split(ms, gaps(ms))}
    assert shape(CV.conversations(df)) == want


def test_supplied_boundaries(spark, busy):
    chats, df = busy
    rng = random.Random(5)
    cuts = [(c, rng.randrange(-2, len(ms) + 3)) for c, ms in chats.items() for _ in range(len(ms) // 2)]
    table = spark.createDataFrame(cuts, "chat_id bigint, after_message_index bigint")
    want = {(c, *s) for c, ms in chats.items() for s in split(ms, [i for k, i in cuts if k == c])}
    assert shape(CV.conversations_from_boundaries(df, table)) == want


def test_nested_messages(busy):
    chats, df = busy
    got = defaultdict(list)
    for r in CV.conversation_messages(df).orderBy("sequence_number").collect():
        got[r["conversation_id"]].append((r["sequence_number"], r["message_id"]))
    want = {f"{c}:{first}": [(n + 1, m) for n, (_, m) in enumerate(ms[start:start + size])]
            for c, ms in chats.items() for first, last, size, start in split(ms, gaps(ms))}
    assert got == want


def test_three_day_pause(chat):
    hours = [0, 1, 2, 3, 4 / 60 + 3, 75 + 4 / 60, 76, 77]
    df = chat([(1, i + 1, h) for i, h in enumerate(hours)])
    boundary = CV.gap_boundaries(df).first()
    assert (boundary["after_message_index"], boundary["reason"], boundary["confidence"]) == (4, "Time gap of 72 hours", 0.7)
    assert [r["message_count"] for r in CV.conversations(df).orderBy("start_time").collect()] == [5, 3]


@pytest.mark.parametrize("hours, cuts", [(48, 1), (48 - 1e-6, 0), (48 + 1e-6, 1)])
def test_gap_edge(chat, hours, cuts):
    assert CV.gap_boundaries(chat([(1, 1, 5), (1, 2, 5 + hours)])).count() == cuts


def test_half_hours_round_to_even(chat):
    df = chat([(1, 1, 0), (1, 2, 48.5), (1, 3, 98)])
    assert [r["reason"] for r in CV.gap_boundaries(df).orderBy("after_message_index").collect()] == [
        "Time gap of 48 hours", "Time gap of 50 hours"]


def test_times_before_1970_share_no_cell_by_accident(spark, chat):
    df = chat([(1, 1, -600_000), (1, 2, -600_000 + 48), (1, 3, -600_000 + 95)])
    assert [r["after_message_index"] for r in CV.gap_boundaries(df).collect()] == [0]


def test_minimum_size(spark, chat):
    df = chat([(1, i, i) for i in range(5)])
    cuts = spark.createDataFrame([(1, 1)], "chat_id bigint, after_message_index bigint")
    found = CV.conversations_from_boundaries(df, cuts, min_messages=3).collect()
    assert [(r["start_message_id"], r["message_count"]) for r in found] == [(2, 3)]


def test_detector_without_boundaries_keeps_chats_whole(spark, chat):
    df = chat([(1, 1, 0), (1, 2, 500), (2, 3, 0)])
    none = spark.createDataFrame([], "chat_id bigint, after_message_index bigint")
    found = detect_conversations(df, detector=lambda m: none).collect()
    assert [(r["chat_id"], r["message_count"]) for r in found] == [(1, 2)]


def test_duration(chat):
    found = CV.conversation_metrics(CV.conversations(chat([(1, 1, 0), (1, 2, 4 / 60)])))
    assert found.first()["duration_minutes"] == 4.0


@pytest.mark.parametrize("n, want", [
    (500, [(0, 200), (170, 200), (340, 160)]), (200, [(0, 200)]), (201, [(0, 200), (170, 31)]), (1, [(0, 1)]), (370, [(0, 200), (170, 200)])])
def test_chunks(chat, n, want):
    df = chat([(1, i, i / 60) for i in range(n)])
    rows = CV.overlapping_chunks(CV.message_index(df), CV.chat_sizes(df))
    got = rows.groupBy("chunk_start").agg(F.count("*").alias("n"), F.min("message_index").alias("a")).orderBy("chunk_start").collect()
    assert [(r["chunk_start"], r["n"]) for r in got] == want and all(r["a"] == r["chunk_start"] for r in got)
    ranges = CV.chunk_ranges(df).orderBy("chunk").collect()
    assert [(r["chunk_start"], r["rows"]) for r in ranges] == want


def test_boundary_prompt_and_offset(spark, chat):
    df = chat([(1, i, i) for i in range(5)])
    prompts = CV.boundary_prompts(df, 3, 1, template="<{messages}>").orderBy("chunk").collect()
    assert [(p["chunk_start"], p["rows"]) for p in prompts] == [(0, 3), (2, 3)]
    assert prompts[1]["prompt"].startswith("<[0] 2024-01-01 02:00:00 - Me: hi\n[1] ")
    answers = spark.createDataFrame([(1, 2, 'ok [{"after_message_index": 1, "reason": "x"}]')],
                                    "chat_id bigint, chunk_start bigint, answer string")
    assert [r["after_message_index"] for r in boundaries_from_answers(answers).collect()] == [3]


FOUND = "chat_id bigint, chunk bigint, after_message_index bigint, reason string, confidence double"


def test_neighbours_that_disagree_are_reconciled(spark):
    # Chunks of 200 with 30 in common: 170 to 199 is seen by chunks 0 and 1, 340 to 369 by 1 and 2.
    rows = [
        (1, 0, 175, "a", 0.6), (1, 1, 176, "b", 0.9),  # one message apart: more confidence
        (1, 0, 190, "c", 0.7), (1, 1, 190, "d", 0.7),  # a tie: further from the edge of its chunk
        (1, 0, 196, "e", 0.5), (1, 1, 199, "f", 0.5),  # too far apart
        (1, 1, 350, "g", 0.4), (1, 1, 352, "h", 0.8), (1, 2, 351, "i", 0.6),  # one partner each, the better one
        (1, 2, 400, "j", 0.1), (2, 0, 175, "k", 0.2), (2, 2, 176, "l", 0.9),  # no neighbours
        (2, 0, 20, "m", 0.3), (2, 0, 20, "n", 0.4), (2, 0, 21, "o", 0.4),  # one chunk may place two side by side
    ]
    found = CV.reconciled_boundaries(spark.createDataFrame(rows, FOUND)).collect()
    assert sorted(tuple(r) for r in found) == [
        (1, 176, "b", 0.9), (1, 190, "d", 0.7), (1, 196, "e", 0.5), (1, 199, "f", 0.5), (1, 350, "g", 0.4), (1, 352, "h", 0.8),
        (1, 400, "j", 0.1), (2, 20, "n", 0.4), (2, 21, "o", 0.4), (2, 175, "k", 0.2), (2, 176, "l", 0.9)]


def test_answers_of_overlapping_chunks(spark):
    answer = lambda i, c: f'[{{"after_message_index": {i}, "reason": "r", "confidence": {c}}}]'
    rows = [(1, 0, answer(180, 0.8)), (1, 170, answer(11, 0.9)), (1, 340, "none")]
    found = PC.reconciled_answers(spark.createDataFrame(rows, "chat_id bigint, chunk_start bigint, answer string")).collect()
    assert [tuple(r)[:2] for r in found] == [(1, 181)]


def test_a_function_of_one_chunk_sees_bounded_chunks(spark, chat):
    # One chat with a third of the rows and more.
    df = chat([(1, i, i * 60 if i % 50 else i * 60 + 59) for i in range(700)] + [(c, 1000 + c, 0) for c in range(2, 300)])

    def detect(chunk):
        assert len(chunk) <= 200 and chunk["chunk_position"].is_monotonic_increasing
        at = [i for i in range(len(chunk)) if (chunk["message_id"][i] + 1) % 100 == 0]
        return pd.DataFrame({"after_message_index": [*at, len(chunk) + 5], "reason": "every hundred", "confidence": 0.5})

    found = CV.chunk_boundaries(df, detect)
    assert sorted((r[0], r[1]) for r in found.collect()) == [(1, i) for i in range(99, 699, 100)]
    whole = detect_conversations(df, lambda m: CV.chunk_boundaries(m, detect)).where("chat_id = 1")
    assert whole.count() == 7


def test_a_detector_is_shown_each_chunk_once(spark, chat):
    df = chat([(c, 100 * c + i, i * 10) for c in range(1, 8) for i in range(20 * c)])
    shown = spark.sparkContext.accumulator(0)

    def detect(chunk):
        shown.add(1)
        return pd.DataFrame({"after_message_index": [0], "reason": "first", "confidence": 0.5})

    chunks = CV.chunk_ranges(df, 40, 10).count()
    found = CV.chunk_boundaries(df, detect, 40, 10).collect()
    assert shown.value == chunks > 7 and {r["chat_id"] for r in found} == set(range(1, 8))
