"""Webhook operators: native HMAC, verification rules, label state over events."""

import json

from pyspark.sql import functions as F

from issuelens.functions.crypto import hmac_sha256_hex
from issuelens.operators import events as E
from tests.bruteforce import hmac_hex, label_history


def test_hmac_matches_python(spark):
    bodies = ['{"a":1}', "", "ünïcødé ✓", "x" * 5000]
    for secret in ["topsecret", "k" * 100, "ß-key"]:
        df = spark.createDataFrame([(b,) for b in bodies], "b string")
        got = [r[0] for r in df.select(hmac_sha256_hex(F.col("b"), secret)).collect()]
        assert got == [hmac_hex(secret, b.encode()) for b in bodies]


def test_verify_rules(spark):
    body = '{"action":"opened"}'
    good = "sha256=" + hmac_hex("s3", body.encode())
    cases = [(1, good), (2, None), (3, ""), (4, "nodelimiter"), (5, "other=" + good.split("=")[1]),
             (6, "sha256=deadbeef"), (7, good + "=tail")]
    df = spark.createDataFrame([(i, s, body) for i, s in cases], "delivery_id long, signature string, raw string")
    got = {r.delivery_id: (r.verified, r.reject_reason) for r in E.verify(df, "s3").collect()}
    assert got[1] == (True, None)
    assert got[2] == (False, "Missing signature") and got[3] == (False, "Missing signature")
    assert got[4] == (False, "Invalid signature")
    assert got[5] == (True, None)  # any prefix before '=' is accepted
    assert got[6] == (False, "Invalid signature")
    assert got[7] == (True, None)  # only the text between the first and second '=' is compared
    nosecret = E.verify(df, None).select("verified").collect()
    assert all(r.verified for r in nosecret)


def _payload(action, number, body, comments, comment_id=None):
    p = {"action": action, "issue": {"number": number, "title": f"Issue {number}", "body": body,
                                     "comments": comments, "labels": [{"name": "bug"}]},
         "repository": {"full_name": "o/r"}}
    if comment_id is not None:
        p["comment"] = {"id": comment_id}
    return json.dumps(p)


def test_label_history_against_simulation(spark):
    # One hot issue with many events (a third of all rows) and a few others.
    events = []
    did = 0
    for i in range(240):
        number = 7 if i % 3 == 0 else i % 11
        did += 1
        words = (i * 37) % 1200
        if i % 5 == 0:
            events.append((did, i, "issue_comment", _payload("created", number, "w " * words, 2, did)))
        else:
            events.append((did, i, "issues", _payload("edited", number, "w " * words, 2)))
    rows = [(d, t, ev, None, raw) for d, t, ev, raw in events]
    df = spark.createDataFrame(rows, "delivery_id long, t long, event string, signature string, raw string") \
        .withColumn("ts", F.timestamp_seconds(F.col("t") * 60)).drop("t")
    tri = E.triage(df, secret=None)
    pred = {r.delivery_id: (r.number, r.route, r.predicted) for r in tri.collect()}
    sim = label_history([(pred[d][0], d, pred[d][1], pred[d][2]) for d, *_ in events])
    got = {r.delivery_id: r.complexity_labels for r in E.label_history(tri).collect()}
    assert got == sim


def test_relabel_expression(spark):
    df = spark.createDataFrame([(["bug", "complexity:simple", "x", "complexity:complex"], "complexity:moderate", True),
                                (["bug", "complexity:moderate"], "complexity:moderate", False),
                                (["bug"], "complexity:simple", False)],
                               "labels array<string>, new string, replace boolean")
    got = [r[0] for r in df.select(E.relabel(F.col("labels"), F.col("new"), F.col("replace"))).collect()]
    assert got == [["bug", "x", "complexity:moderate"], ["bug", "complexity:moderate"], ["bug", "complexity:simple"]]
