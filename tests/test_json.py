"""Strict reading, canonical text and limits of JSON against Python's own reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siemspark.functions.text import canonical_json, strict_json
from siemspark.operators import parse as P


class Spelled(str):
    """A number as it is written."""


def escaped(text):
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def canonical(v):
    if isinstance(v, Spelled):
        return str(v)
    if isinstance(v, str):
        return escaped(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{escaped(k)}:{canonical(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    return {None: "null", True: "true", False: "false"}[v]


def plain(text):
    return canonical(json.loads(text, parse_int=Spelled, parse_float=Spelled))


def column(spark, texts, *make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *[m(F.col("x")) for m in make]).orderBy("i").collect()]


GOOD = [
    "1.50", " -0 ", "1e2", "1E+400", "1e-400", "-0.0", "12345678901234567890123456789012345678901234567890", "0.10000000000000000000001",
    '{"b":1.50,"a":[1e2,-0,{"z":1E400,"y":null}]}', '{"1.5":"2.50","2":"1,2.0"}', '["1.50", "a\\"1.50", "\\\\", 1.50]', '"1.50"',
    '{"a":"x\\u0001y\\u0002z1.5","n":2.50}', '["\\u00011.5", 1.5]', '"\\u000b\\u001f\\u0041\\/\\u00e9\\u007f"', '["\\\\u000B", "\\u000B", 0.0]',
    '{"é":1.0,"z":2.0,"日本":[true,false,null]}', "[]", "{}", "[ [ ] , { } , 1.0 ]", '{"a":1,"a":2.50}', "true", '"' + "x1.5 " * 3000 + '"',
    "[" + ",".join(["1.50", '"s"'] * 2000) + "]", '["' + "\\\\n" * 5000 + '", 1.0]', '{"k":"end-of-text-5c1f","v":1.0}', "\n[1.0]\t",
]
BAD = ["", " ", "{", "01", "1.", ".5", "+1", "-", "1e", "1.5.2", "{1:2}", "{1.5 :2}", "tr1ue", "[1,]", "[1.0] x", "1,2", '1,"end-of-text-5c1f"] [',
       '1],[2', '1}', '{"a":1} {"b":2}', '"a', "[1.0", '"a"\\', "1.0 1.0", 'end-of-text-5c1f', '"end-of-text-5c1f" x', "[-]", "nul1.0"]


def test_canonical_text_keeps_numbers_as_written(spark):
    got = column(spark, GOOD, canonical_json, lambda t: F.sha2(canonical_json(t, strict_json(t)), 256).alias("h"))
    assert [g[0] for g in got] == [plain(t) for t in GOOD]
    import hashlib
    assert [g[1] for g in got] == [hashlib.sha256(plain(t).encode()).hexdigest() for t in GOOD]


def test_broken_json_is_null(spark):
    assert column(spark, BAD, strict_json) == [(None,)] * len(BAD)
    parts = ["{1:2}", "{1.5 :2}", "01", "tr1ue", "[1.0", "1e", "-"]
    assert column(spark, parts, canonical_json) == [(None,)] * len(parts)
    assert [r[0] for r in column(spark, GOOD, lambda t: strict_json(t).isNotNull().alias("ok"))] == [True] * len(GOOD)


def random_json(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.4:
        return rnd.choice(["null", "true", "1.50", "-0", "1e5", "0", "-12.340", '"a"', '"1.5"', '"\\u0001"', '"x\\"y"', '"é,:[{"', "7"])
    space = rnd.choice(["", " ", "\n"])
    items = [random_json(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    if kind < 0.7:
        return "[" + f",{space}".join(items) + "]"
    return "{" + ",".join(f'"{rnd.choice(["b", "a", "1", "é"])}"{space}:{x}' for x in items) + "}"


def test_canonical_text_of_random_values(spark):
    rnd = random.Random(5)
    texts = [random_json(rnd, 4) for _ in range(600)]
    assert column(spark, texts, canonical_json) == [(plain(t),) for t in texts]


def limit_code(text):
    """A walk over the value: 0 fine, 1 over a limit, 2 unreadable."""
    depth = deepest = 0
    inside = skip = False
    for c in text:
        if inside:
            skip, inside = (not skip and c == "\\"), inside and (skip or c != '"')
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif c in "]}":
            depth -= 1
    if deepest >= P.READER_DEPTH:
        return 2
    try:
        value = json.loads(text, parse_int=lambda _: 0, parse_float=lambda _: 0)
    except ValueError:
        return 2
    fields, todo = 0, [(value, 0)]
    while todo:
        node, level = todo.pop()
        if level > P.MAX_DEPTH or isinstance(node, str) and len(node.encode()) > P.MAX_STRING_BYTES:
            return 1
        if isinstance(node, (dict, list)):
            fields += len(node) if isinstance(node, dict) else 0
            if len(node) > P.MAX_COLLECTION or fields > P.MAX_FIELDS:
                return 1
            if isinstance(node, dict) and any(len(k.encode()) > P.MAX_STRING_BYTES for k in node):
                return 1
            todo += [(x, level + 1) for x in (node.values() if isinstance(node, dict) else node)]
    return 0


def nest(n, core, *kinds):
    for i in range(n):
        core = f"[{core}]" if kinds[i % len(kinds)] == "[" else f'{{"k{i}":{core}}}'
    return core


def members(n, repeat=False):
    return "{" + ",".join(f'"k{0 if repeat else i}":1' for i in range(n)) + "}"


SHAPES = [
    *[nest(n, core, "[") for n in (63, 64, 65, 66, 127, 128, 129) for core in ("", "1", "[]", '"[["')], nest(64, "1", "[", "{"), nest(65, "{}", "{", "["),
    nest(65, '"x"', "{"), "[" * 64 + "]" * 64 + " ", '["' + "[" * 500 + '"]', '["' + "," * 9000 + '"]', "[" + "1," * 4095 + "1]", "[" + "1," * 4096 + "1]",
    "[[" + "[]," * 4095 + "[]],[" + "1," * 4095 + "1]]", "[" + "[[1,2],3]," * 4096 + "1]", members(4096), members(4097), members(5000, repeat=True),
    "[" + members(4096) + "," + members(4096) + "]", "[" + members(4096) + "," + members(4095) + ',{"a":1,"b":2}]', nest(10, members(4097), "["),
    '["' + "y" * 262_144 + '"]', '["' + "y" * 262_145 + '"]', '["' + "\\u0041" * 262_144 + '"]', '["' + "é" * 131_073 + '"]',
    "[" + "1" * 300 + "]", "[" * 200, '{"a":' * 70 + "1" + "}" * 69,
]


def test_tokens_that_spark_does_not_read_are_no_json(spark):
    """Keys above 50,000 characters and numbers above 1,000 digits."""
    texts = ['{"' + "k" * 50_001 + '":1}', "[" + "1" * 1_001 + "]"]
    assert column(spark, texts, strict_json) == [(None,), (None,)]


def test_limits_equal_a_walk(spark):
    got = column(spark, SHAPES, lambda t: P.json_limit_code(t, strict_json(t)))
    for text, (code,) in zip(SHAPES, got, strict=True):
        assert code == limit_code(text), text[:80]
    assert column(spark, [None], P.json_limit_code) == [(None,)]


def test_limits_of_random_values_at_low_bounds(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_DEPTH", 3)
    monkeypatch.setattr(P, "MAX_COLLECTION", 2)
    monkeypatch.setattr(P, "MAX_FIELDS", 3)
    monkeypatch.setattr(P, "MAX_STRING_BYTES", 5)
    monkeypatch.setattr(P, "READER_DEPTH", 6)
    rnd = random.Random(9)
    texts = [random_json(rnd, rnd.randrange(7)) for _ in range(800)]
    texts = [t for t in texts if len(t) > 6]
    got = column(spark, texts, lambda t: P.json_limit_code(t, strict_json(t)))
    for text, (code,) in zip(texts, got, strict=True):
        assert code == limit_code(text), text


@pytest.mark.parametrize("query", ["parse_outcomes", "normalize", "parse_json_events"])
def test_parse_plans_stay_in_the_jvm(spark, data_dir, query):
    from siemspark.plans.catalog import QUERIES

    plan = QUERIES[query](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
