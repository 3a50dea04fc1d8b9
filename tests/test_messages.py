import json

import pytest

from coverlane.operators import messages

SINGLE = json.dumps({"NombreCompleto": "INSURER A", "IdFactura": 101, "IdAseguradora": "7", "PersonaPrimerNombre": " ANA "})
BODIES = {
    SINGLE.encode(): ("single", "ack"),
    b'{"NombreCompleto":null}': ("single", "ack"),
    b'{"Clientes":[]}': ("batch", "ack"),
    b' {"Clientes":[{"NombreCompleto":"X"},7,null]}': ("batch", "ack"),
    b'{"Clientes":"[1]"}': ("unrecognized", "ack"),
    b'{"Clientes":{"a":1}}': ("unrecognized", "ack"),
    b'{"other":1}': ("unrecognized", "ack"),
    b"{}": ("unrecognized", "ack"),
    b"[]": ("unrecognized", "ack"),
    b'["NombreCompleto"]': ("single", "ack"),
    b'["Clientes"]': ("rejected", "dead_letter"),
    b'"x NombreCompleto y"': ("single", "ack"),
    b'"Clientes"': ("rejected", "dead_letter"),
    b'"text"': ("unrecognized", "ack"),
    b"7": ("rejected", "dead_letter"),
    b"true": ("rejected", "dead_letter"),
    b"null": ("rejected", "dead_letter"),
    b"": ("bad_json", "ack"),
    b"   ": ("bad_json", "ack"),
    b'{"a":1} junk': ("bad_json", "ack"),
    b'{"a":1}{"b":2}': ("bad_json", "ack"),
    b"{'a':1}": ("bad_json", "ack"),
    b"{broken": ("bad_json", "ack"),
    b'1],"y":[2': ("bad_json", "ack"),
    b'{"NombreCompleto":"A"}],"x":[{}': ("bad_json", "ack"),
    b'{"Clientes":[1],"b":[2],"c":"],"}': ("batch", "ack"),
    b'1,"z":2': ("bad_json", "ack"),
    b'{"NombreCompleto":"a","NombreCompleto":"b"}': ("single", "ack"),
    b'\xff\xfe{"a":1}': ("rejected", "dead_letter"),
    '{"NombreCompleto":"PEÑA"}'.encode("latin-1"): ("rejected", "dead_letter"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    inbox = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(BODIES)], "delivery_tag long, body binary")
    return messages.parse(inbox)


def test_routes(parsed):
    got = {r["delivery_tag"]: (r["route"], r["disposition"]) for r in parsed.collect()}
    assert [got[i] for i in range(len(BODIES))] == list(BODIES.values())


def test_flatten_keeps_order_and_headers_out(spark):
    body = json.dumps({"Clientes": [{"NombreCompleto": "A", "NumDocIdentidad": "001"}, {"NombreCompleto": ""}, "no object"], "Origen": "x"})
    inbox = spark.createDataFrame([(1, body), (2, SINGLE)], "delivery_tag long, body string")
    clients = messages.flatten(messages.parse(inbox))
    got = {(r["delivery_tag"], r["pos"]): r["fields"] for r in clients.collect()}
    assert got[(1, 0)] == {"NombreCompleto": "A", "NumDocIdentidad": "001"}
    assert got[(1, 1)] == {"NombreCompleto": ""} and got[(1, 2)] is None
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    typed = {(r["delivery_tag"], r["pos"]): r for r in messages.typed(clients).collect()}
    assert typed[(2, 0)]["invoice_id"] == 101 and typed[(2, 0)]["insurer_id"] == 7
    assert typed[(2, 0)]["full_name"] == "ANA" and typed[(1, 0)]["full_name"] is None
    assert messages.named(messages.typed(clients)).count() == 2


def test_last_duplicate_wins(spark):
    inbox = spark.createDataFrame([(1, '{"NombreCompleto":"a","NombreCompleto":"b"}')], "delivery_tag long, body string")
    assert messages.flatten(messages.parse(inbox)).first()["fields"] == {"NombreCompleto": "b"}


def test_tasks_and_attempts(spark):
    bodies = ['{"url":"u","use_selenium":true,"selectors":{"a":"h1"}}', '{"url":""}', '{"url":null}', "{}", "nope"]
    inbox = spark.createDataFrame([(b, i % 3) for i, b in enumerate(bodies)], "body string, attempt int")
    from pyspark.sql import functions as F

    got = [(r["disposition"], r["rendered"], r["selectors"]) for r in messages.read_tasks(inbox, F.col("attempt"), 3).collect()]
    assert [g[0] for g in got] == ["ack", "retry", "dead_letter", "retry", "drop"]
    assert got[0][1:] == (True, {"a": "h1"}) and got[1][2] == {}
    assert [r["disposition"] for r in messages.read_tasks(inbox).collect()] == ["ack", "retry", "retry", "retry", "drop"]
