import datetime as dt

from conftest import rows

from pulsewatch.operators import normalize

MESSAGE = "timestamp timestamp, seq long, value string"
RECEIVED = dt.datetime(2020, 1, 1, 12, 0, 0, 250000)


def messages(make, *texts):
    return make(MESSAGE, [(RECEIVED, i, t) for i, t in enumerate(texts)])


def test_one_row_per_field_with_the_messages_own_time(make):
    df = normalize.metrics(
        messages(
            make,
            '{"fields":{"free":2048,"load":0.75,"idle":0},"name":"disk",'
            '"tags":{"host":"node-4"},"timestamp":1577836861}',
        )
    )
    when = dt.datetime(2020, 1, 1, 0, 1, 1)
    assert rows(df, "ts", "resource", "name", "metric", "value") == [
        (when, "node-4", "disk", "disk.free", 2048.0),
        (when, "node-4", "disk", "disk.idle", 0.0),
        (when, "node-4", "disk", "disk.load", 0.75),
    ]


def test_missing_parts(make):
    df = normalize.metrics(
        messages(
            make,
            '{"fields":{"a":1},"name":"n","tags":{"host":"h"}}',
            '{"fields":{"a":1},"name":"n","tags":{"dc":"d1"}}',
            '{"fields":{"a":1},"name":"n"}',
            '{"fields":null,"name":"n","tags":{"host":"h"}}',
            '{"fields":{"a":1},"tags":{"host":"h"}}',
            "not json",
            None,
        )
    )
    assert rows(df, "seq", "ts", "dc", "resource", "metric", "value") == [
        (0, RECEIVED, None, "h", "n.a", 1.0),
        (1, RECEIVED, "d1", None, "n.a", 1.0),
        (2, RECEIVED, None, None, "n.a", 1.0),
    ]


def test_numbers_survive_beside_text_and_a_null_stays(make):
    df = normalize.metrics(
        messages(
            make,
            '{"name":"n","tags":{"host":"h"},"fields":'
            '{"a":"text","b":2,"c":null,"d":true,"e":"12f","f":"1.5D","g":"NaN","h":"-1e3"}}',
        )
    )
    found = {m: v for m, v in rows(df, "metric", "value")}
    assert set(found) == {"n.b", "n.c", "n.g", "n.h"}
    assert found["n.b"] == 2.0 and found["n.c"] is None and found["n.h"] == -1000.0
    assert found["n.g"] != found["n.g"]


def test_single_quotes_and_separator(make):
    df = normalize.metrics(
        messages(make, "{'name':'cpu','tags':{'host':'h'},'fields':{'idle':3}}"), sep="_"
    )
    assert rows(df, "metric", "value") == [("cpu_idle", 3.0)]


def test_rejected_are_exactly_those_without_a_name(make):
    df = messages(make, '{"name":"n","fields":{"a":1}}', "junk", '{"fields":{"a":1}}', None)
    assert rows(normalize.rejected(df), "seq") == [(1,), (2,), (3,)]


def test_flat_messages_take_the_time_of_receipt(make):
    df = normalize.flat_metrics(
        messages(
            make,
            '{"nodegroup":"east","resource":"db-7","metric":"iops","value":410,"timestamp":5}',
            '{"nodegroup":"east","resource":"db-7","metric":"lag"}',
            "junk",
        )
    )
    assert rows(df, "ts", "dc", "resource", "metric", "value") == [
        (RECEIVED, "east", "db-7", "iops", 410.0),
        (RECEIVED, "east", "db-7", "lag", None),
    ]


def test_log_readings_that_are_no_numbers_are_null(make):
    df = normalize.logs(
        messages(
            make,
            '{"nodegroup":"west","metric":12.5,"resource":"gw","event":"queue.depth","log":"x"}',
            '{"nodegroup":"west","metric":"high","resource":"gw","event":"queue.depth","log":""}',
        )
    )
    assert rows(df, "seq", "event", "metric", "log") == [
        (0, "queue.depth", 12.5, "x"),
        (1, "queue.depth", None, ""),
    ]


def test_rule_and_alarm_messages(make):
    rules = normalize.rules(
        messages(make, '{"id":"1","resource":"r","metric":"m","op":">","value":50}', '{"op":">"}')
    )
    assert rows(rules, "rule_id", "resource", "metric", "op", "threshold") == [("1", "r", "m", ">", 50.0)]
    alarms = normalize.alarms(
        messages(
            make,
            '{"alarmType":"simple","ruleId":"r1","detect":true,"occurCount":1,'
            '"occurTimestamp":"2018-01-01T00:00:00.125Z","payload":"{}"}',
            '{"ruleId":"r1"}',
        )
    )
    assert rows(alarms, "alarm_type", "rule_id", "detect", "occur_count", "occur_timestamp") == [
        ("simple", "r1", True, 1, dt.datetime(2018, 1, 1, 0, 0, 0, 125000))
    ]


def test_each_message_is_parsed_once(make):
    plan = normalize.metrics(messages(make, "{}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
