import json
import math

import pytest
from pyspark.sql import functions as F

from loadpulse import schemas
from loadpulse.operators import parse


def record(**fields):
    base = dict(job_id="j", workload_id="w", operation="read", success=True,
                connection_start=1.0, connection_end=2.0,
                transaction_start=1.25, transaction_end=1.5)
    base.update(fields)
    return {k: v for k, v in base.items() if v != "absent"}


def jobs(df):
    return sorted(r.job_id for r in df.collect())


def test_every_record_of_an_array_is_a_row_with_the_message_time(make_messages):
    text = json.dumps([record(job_id="a"), record(job_id="b")])
    rows = parse.parse_messages(make_messages((3, text))).collect()
    assert sorted(r.job_id for r in rows) == ["a", "b"]
    assert {r.publish_time.second for r in rows} == {3}
    assert rows[0].transaction_end - rows[0].transaction_start == 0.25


@pytest.mark.parametrize("text", [
    json.dumps(record()), "", "   ", '[{"job_id": "a"', "not json", None, "null", "7",
    '[{"job_id": "a"}] and more', '[{"job_id": "a"}][{"job_id": "b"}]', "[1],[2]", "[1]]x[2]", '[],"b":[]',
])
def test_unreadable_messages_give_no_records_and_one_reject(make_messages, text):
    messages = make_messages((0, text))
    assert parse.parse_messages(messages).count() == 0
    rejects = parse.quarantine(messages).collect()
    assert [(r.rejected, r.payload) for r in rejects] == [("message", text)]


def test_an_empty_array_gives_neither(make_messages):
    messages = make_messages((0, "[]"), (1, " [ ] \n"))
    assert parse.parse_messages(messages).count() == 0
    assert parse.quarantine(messages).count() == 0


def test_white_space_around_an_array_is_fine(make_messages):
    assert parse.parse_messages(make_messages((0, "\n\t " + json.dumps([record()]) + " \r\n"))).count() == 1


def test_absent_success_is_a_failure_and_absent_numbers_are_zero(make_messages):
    text = json.dumps([record(success="absent", transaction_start="absent", workload_id="absent")])
    row = parse.parse_messages(make_messages((0, text))).first()
    assert row.success is False
    assert row.transaction_start == 0.0
    assert row.workload_id is None


def test_a_bad_field_costs_only_its_own_record(make_messages):
    text = json.dumps([record(job_id="a"), record(job_id="b", transaction_end="soon"),
                       record(job_id="c", success=7), record(job_id="d")])
    messages = make_messages((0, text))
    assert jobs(parse.parse_messages(messages)) == ["a", "d"]
    rejects = parse.quarantine(messages).collect()
    assert {r.rejected for r in rejects} == {"record"}
    assert sorted(json.loads(r.payload)["job_id"] for r in rejects) == ["b", "c"]


def test_an_element_that_is_no_object_costs_only_itself(make_messages):
    good = json.dumps(record())
    messages = make_messages((0, f"[{good},5]"), (1, f'["x",{good}]'), (2, f"[{good},[1],{good}]"),
                             (3, f"[[{good}]]"))
    assert parse.parse_messages(messages).count() == 4
    rejects = parse.quarantine(messages).collect()
    assert sorted(r.payload for r in rejects if r.publish_time.second < 3) == ["5", "[1]", "x"]
    assert [r.rejected for r in rejects] == ["record"] * 4


def test_text_behind_an_array_rejects_the_whole(make_messages):
    good = json.dumps([record()])
    for text in (good + good, good + " x ]", good + "," + good, good + ",[]"):
        messages = make_messages((0, text))
        assert parse.parse_messages(messages).count() == 0
        assert [r.payload for r in parse.quarantine(messages).collect()] == [text]


def test_records_without_job_or_operation_and_null_records_are_rejected(make_messages):
    text = json.dumps([record(job_id="absent"), record(operation="absent"), None, record()])
    messages = make_messages((0, text))
    assert parse.parse_messages(messages).count() == 1
    assert parse.quarantine(messages).count() == 3


def test_numbers_in_quotes_are_numbers(make_messages):
    text = json.dumps([record(transaction_end="1.75", success="TRUE")])
    row = parse.parse_messages(make_messages((0, text))).first()
    assert (row.transaction_end, row.success) == (1.75, True)


def test_records_and_rejects_add_up(make_messages):
    good = json.dumps([record(), record(success="absent")])
    messages = make_messages((0, good), (1, "x"), (2, json.dumps([record(success=1), record()])))
    assert parse.parse_messages(messages).count() == 3
    assert parse.quarantine(messages).count() == 2


GOOD_OBJECT = json.dumps(dict(connection_start=0, transaction_start=1, transaction_end=2,
                              connection_end=4, success=True, database_type="d",
                              transaction_type="read", load_id=1))
BAD_OBJECTS = ['{"connection_start": "x"}', "nothing", "", None, "{}", GOOD_OBJECT + GOOD_OBJECT,
               GOOD_OBJECT + " junk", f"[{GOOD_OBJECT}]", f"{GOOD_OBJECT},{GOOD_OBJECT}",
               GOOD_OBJECT.replace(', "load_id": 1', "")]


def test_lenient_objects_leave_out_what_is_not_one_whole_object(make_messages):
    messages = make_messages((0, GOOD_OBJECT), *enumerate(BAD_OBJECTS, 1))
    lenient = parse.parse_objects(messages, strict=False).collect()
    assert [(r.connection_end, r.transaction_type) for r in lenient] == [(4, "read")]
    rejects = [r.data for r in parse.quarantine_objects(messages).collect()]
    assert sorted(rejects, key=str) == sorted(BAD_OBJECTS, key=str)


@pytest.mark.parametrize("text", BAD_OBJECTS)
def test_strict_objects_fail_the_job(make_messages, text):
    assert parse.parse_objects(make_messages((0, GOOD_OBJECT))).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        parse.parse_objects(make_messages((0, text))).collect()


def test_keys_split_at_the_first_dash(spark):
    keyed = spark.createDataFrame([("read-a-b-c",), ("write-x",)], "key string")
    rows = parse.decompose_key(keyed).collect()
    assert [(r.query_action, r.job_id) for r in rows] == [("read", "a-b-c"), ("write", "x")]


# --- batching ------------------------------------------------------------------

def unpacked(messages):
    items = F.from_json("data", f"array<{schemas.TRANSACTION.simpleString()}>")
    return messages.select("publish_time", F.size(items).alias("n"), F.inline(items))


def content(df):
    return sorted(tuple(r) for r in df.select(*schemas.TRANSACTION.fieldNames()).collect())


def test_one_message_per_interval(make_records):
    records = make_records((0.1, "a", "read", True, 1.0, 2.0), (0.4, "b", "read", True, 1.0, 2.0),
                           (0.6, "a", "write", False, 1.0, 2.0), (5.0, "a", "read", True, 3.0, 4.0))
    messages = parse.batch_messages(records)
    assert messages.count() == 3  # an interval without records has no message
    assert content(unpacked(messages)) == content(records)
    parsed = parse.parse_messages(messages)
    assert content(parsed) == content(records)


def test_publishers_have_messages_of_their_own(make_records):
    records = make_records((0.1, "a", "read", True, 1.0, 2.0), (0.2, "b", "read", True, 1.0, 2.0))
    records = records.withColumn("workload_id", F.col("job_id"))
    assert parse.batch_messages(records).count() == 2


@pytest.mark.parametrize("parts", [1, 4])
def test_messages_do_not_depend_on_how_many_records_there_are(make_records, parts):
    one = make_records((0.1, "a", "read", True, 1.0, 2.0))
    for copies in (10_000, 10_001):
        records = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("i")
        messages = parse.batch_messages(records, parts=parts)
        assert messages.count() == parts
        assert unpacked(messages).count() == copies


def test_latency_of_a_transaction_that_never_began(spark):
    from loadpulse.functions import with_timing_fallback
    rows = spark.createDataFrame(
        [(1.0, 2.0, None, None), (None, None, 5.0, 6.0)],
        "connection_start double, connection_end double, transaction_start double, "
        "transaction_end double")
    got = [tuple(r) for r in with_timing_fallback(rows).collect()]
    assert got == [(1.0, 2.0, 2.0, 2.0), (5.0, 6.0, 5.0, 6.0)]


def test_nan_text_is_a_number(make_messages):
    text = json.dumps([record(transaction_end="NaN")])
    row = parse.parse_messages(make_messages((0, text))).first()
    assert math.isnan(row.transaction_end)


RECORD = '{"job_id":"a","operation":"read"}'
FORGED = [f"[{RECORD}],[{RECORD}]] [{RECORD}]", f"[{RECORD}],[]] junk", f"[{RECORD}],null] {RECORD}",
          f'[{RECORD}],["x"]] junk', f"[{RECORD}],[{RECORD}]"]


@pytest.mark.parametrize("text", FORGED)
def test_a_text_that_brings_the_readers_own_brackets_is_rejected_whole(make_messages, text):
    messages = make_messages((0, text))
    assert parse.parse_messages(messages).count() == 0
    assert [r.payload for r in parse.quarantine(messages).collect()] == [text]
    split = parse.split_messages(messages).collect()
    assert [(r.outcome, r.payload, r.record) for r in split] == [("message", text, None)]


def test_an_object_that_brings_the_readers_own_brackets_is_rejected(make_messages):
    good = json.dumps(dict(connection_start=1, transaction_start=1, transaction_end=2, connection_end=2,
                           success=True, database_type="d", transaction_type="read", load_id=1))
    texts = [f"{good},{good}] {good}", f"{good},{{}}] x", f"{good},{good}", f"[{good}]"]
    messages = make_messages(*enumerate(texts), (9, good))
    assert parse.parse_objects(messages, strict=False).count() == 1
    assert sorted(r.data for r in parse.quarantine_objects(messages).collect()) == sorted(texts)


def test_a_split_is_what_both_readings_give(make_messages):
    messages = make_messages(
        (0, f"[{RECORD}]"), (1, f"[{RECORD},7,null,{{}}]"), (2, "nothing"), (3, "[]"), (4, None), (5, FORGED[0]))
    split = parse.split_messages(messages)
    assert sorted(map(str, parse.accepted_records(split).collect())) == sorted(
        map(str, parse.parse_messages(messages).collect()))
    assert sorted(map(str, parse.rejected_payloads(split).select("publish_time", "payload", "rejected").collect())) \
        == sorted(map(str, parse.quarantine(messages).select("publish_time", "payload", "rejected").collect()))


def test_texts_are_read_once(spark, make_messages, folder):
    make_messages((0, "[]")).write.parquet(folder("m"))
    messages = spark.read.parquet(folder("m"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert plan(parse.parse_objects(messages)).count("from_json(") == 1
    assert plan(parse.quarantine_objects(messages)).count("from_json(") == 1
    # By type, and for doubtful messages as texts, whose elements are read by field.
    split = plan(parse.split_messages(messages))
    assert split.count("from_json(") == 3 and split.count("FileScan") == 1
