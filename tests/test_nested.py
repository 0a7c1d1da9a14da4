"""Redaction of JSON texts."""

import json
import re
import time

from pyspark.sql import functions as F

from inkwell.operators import governance
from inkwell.operators.governance import redact_json, redact_metadata


def test_redact_json(spark):
    """Any depth, other types, broken texts, no double, too deep, lone surrogates, null."""
    good = {"a@b.com": "é a@b.com", "x": {"y": {"z": ["ip 10.0.0.1", {"w": "13812345678"}, ["a@b.com"], 5, None, True, 1.5, 2**70]}}}
    deep = "[" * 100_000 + '"a@b.com"' + "]" * 100_000
    texts = [json.dumps(good), "mail a@b.com {", '{"n": 1e999, "m": "a@b.com"}', deep, '{"s": "\\ud800 a@b.com"}', "", None, '"a@b.com"', "null", "[NaN]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", redact_json()(F.col("t")).alias("t"))
    got = {r["i"]: r["t"] for r in df.collect()}
    want = {"a@b.com": "é [EMAIL]", "x": {"y": {"z": ["ip [IP_ADDRESS]", {"w": "[PHONE]"}, ["a@b.com"], 5, None, True, 1.5, 2**70]}}}
    assert json.loads(got[0]) == want == redact_metadata(good) and "é" in got[0]
    assert got[1] == "mail [EMAIL] {" and got[2] == '{"n": 1e999, "m": "[EMAIL]"}' and got[3] == deep.replace("a@b.com", "[EMAIL]")
    assert json.loads(got[4]) == {"s": "\ud800 [EMAIL]"}
    assert [got[i] for i in range(5, 10)] == ["", None, '"[EMAIL]"', "null", "[NaN]"]
    assert df.filter("false").count() == 0


def test_formats_beside_escapes(spark):
    for text in ("555\n1234567", "138\t\"x\"10.0.0.1", "\n10.0.0.1\n", "a\u0001b@c.de", "+86\t139 12345678", "555\u00a05551234", "nothing 123 \n"):
        for ascii_only in (True, False):
            j = json.dumps({"k": text}, ensure_ascii=ascii_only)
            got = spark.createDataFrame([(j,)], "t string").select(redact_json()("t").alias("t")).first()["t"]
            assert json.loads(got) == redact_metadata({"k": text}), text


def test_formats_are_sought_only_where_they_can_occur(spark):
    """Results as those of all formats one after the other; a long word without an @ costs its length, not its square."""
    texts = ["a@b.co 1.2.3.4", "x 555-123-4567 +86 139 12345678", "٣٣٣ ٤٤٤ ٥٥٥٥ 13812345678", "\ud800 1.1.1.1", "no 12 at @ all", "110101199003071234", ""]
    for text in texts:
        want = text
        for _, p, to in governance.PII_PATTERNS:
            want = re.sub(p, to, want)
        assert redact_metadata(text) == want
    long = json.dumps({"k": "a" * 300_000, "m": "1.2.3.4"})
    began = time.perf_counter()
    got = spark.createDataFrame([(long,)] * 4, "t string").select(redact_json()("t").alias("t")).collect()
    assert json.loads(got[0]["t"]) == {"k": "a" * 300_000, "m": "[IP_ADDRESS]"}
    assert time.perf_counter() - began < 30
