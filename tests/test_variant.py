"""Structure-aware redaction and counts against a plain walk of the parsed value."""

import json
import random

from pyspark.sql import functions as F

from rostrum.functions import variant

HEADERS = ("authorization", "proxy-authorization", "x-api-key")


def plain(value, secrets):
    if isinstance(value, str):
        for secret in secrets:
            value = value.replace(secret, "<REDACTED>")
        return value
    if isinstance(value, list):
        return [plain(v, secrets) for v in value]
    if isinstance(value, dict):
        return {k: "<REDACTED>" if k.lower() in HEADERS else plain(v, secrets) for k, v in value.items()}
    return value


def nested(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 3:
        return [rng.choice(["s3cret-key", "a s3cret-key b", 'q"u\\o', "", "é"]), rng.randrange(1000), rng.choice([None, True])][kind]
    if kind == 3:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    names = rng.sample(["a", "b", "Authorization", "X-Api-Key", "proxy-authorization", "c d", "headers"], rng.randrange(1, 5))
    return {name: nested(rng, depth - 1) for name in names}


def test_headers_go_at_any_depth_whatever_they_hold(spark):
    rng = random.Random(7)
    values = [nested(rng, 5) for _ in range(300)]
    values += [{"h": {"Authorization": {"deep": [{"x": {"y": 1}}], "t": "s3cret-key"}}}, {"a": [{"X-API-KEY": [1, [2, {"z": {}}]]}]}, {"authorization": "Bearer x", "n": {"authorization": "Bearer xy"}}]
    df = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False), "k") for k, v in enumerate(values)], "id long, text string, key string").repartition(3)
    got = {r.id: r.safe for r in variant.redacted_json(df, "text", ["s3cret-key"], "safe").collect()}
    for k, v in enumerate(values):
        assert json.loads(got[k]) == plain(v, ["s3cret-key"]), (v, got[k])


def test_texts_that_are_no_json_are_redacted_as_text(spark):
    df = spark.createDataFrame([(1, 'x {"Authorization": "Bearer s3cret-key"}'), (2, None), (3, "s3cret-key"), (4, "{}")], "id long, text string")
    got = {r.id: r.safe for r in variant.redacted_json(df, "text", ["s3cret-key"], "safe").collect()}
    assert got == {1: 'x {"Authorization": "<REDACTED>"}', 2: None, 3: "<REDACTED>", 4: "{}"}
    assert variant.redacted_json(df.limit(0), "text", [], "safe").count() == 0


def test_missing_and_zero_counts_differ(spark):
    usage = lambda **u: json.dumps({"response": {"usage": u}})
    rows = [
        usage(prompt_tokens=0, completion_tokens=5), usage(), usage(prompt_tokens="7", completion_tokens=1.5), usage(prompt_tokens=-1, completion_tokens=None), "no json", None, json.dumps({"response": None}),
        json.dumps({"response": {"usage": {"prompt_tokens_details": {}}}, "raw_response": {"usage": {"prompt_tokens_details": {"cached_tokens": 4}}}}),
        json.dumps({"response": {"usage": {"prompt_tokens_details": {"cached_tokens": 0}}}, "raw_response": {"usage": {"prompt_tokens_details": {"cached_tokens": 4}}}}),
        usage(prompt_tokens=2**40, completion_tokens=2**70),
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = {r.id: tuple(r)[1:] for r in df.select("id", *(c.alias(n) for n, c in variant.usage_counts(F.try_parse_json("text")).items())).collect()}
    none = (None, None, None)
    assert got == {0: (0, None, 5), 1: none, 2: none, 3: none, 4: none, 5: none, 6: none, 7: (None, 4, None), 8: (None, 0, None), 9: (2**40, None, None)}
