import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glasspool.llm import chat

INNER = T.StructType([T.StructField("unit", T.StringType(), False), T.StructField("factor", T.DoubleType(), True)])
SCHEMA = T.StructType([
    T.StructField("text", T.StringType(), False), T.StructField("count", T.IntegerType(), True), T.StructField("big", T.LongType(), True),
    T.StructField("share", T.DoubleType(), True), T.StructField("on", T.BooleanType(), True), T.StructField("inner", INNER, True),
    T.StructField("tags", T.ArrayType(T.StringType(), False), True), T.StructField("many", T.ArrayType(INNER, True), True),
    T.StructField("named", T.MapType(T.StringType(), T.LongType(), False), True), T.StructField("odd key", T.LongType(), True),
])
LONG = "word " * 400_000

CASES = [
    {"text": "x"}, {"text": ""}, {}, {"text": None}, {"text": 5}, {"text": True}, {"text": {"x": 1}}, {"text": ["x"]}, {"text": "5", "more": 1},
    {"text": "x", "count": 1}, {"text": "x", "count": "1"}, {"text": "x", "count": 1.0}, {"text": "x", "count": 1.5}, {"text": "x", "count": None},
    {"text": "x", "count": 2**31}, {"text": "x", "count": -(2**31)}, {"text": "x", "big": 2**31}, {"text": "x", "big": 2**63}, {"text": "x", "big": -(2**63)},
    {"text": "x", "share": 1}, {"text": "x", "share": 0.25}, {"text": "x", "share": 1e300}, {"text": "x", "share": "0.5"}, {"text": "x", "share": False},
    {"text": "x", "on": True}, {"text": "x", "on": 1}, {"text": "x", "on": "true"}, {"on": False, "text": "é😀 \"q\" \\ \n\t"},
    {"text": "x", "inner": {"unit": "m"}}, {"text": "x", "inner": {}}, {"text": "x", "inner": {"unit": None}}, {"text": "x", "inner": {"factor": 1}},
    {"text": "x", "inner": {"unit": "m", "factor": None}}, {"text": "x", "inner": {"unit": "m", "other": 1}}, {"text": "x", "inner": "m"}, {"text": "x", "inner": []},
    {"text": "x", "inner": None}, {"text": "x", "tags": []}, {"text": "x", "tags": ["b", "a"]}, {"text": "x", "tags": ["b", None]}, {"text": "x", "tags": ["b", 1]},
    {"text": "x", "tags": "b"}, {"text": "x", "tags": {}}, {"text": "x", "many": [{"unit": "m"}, None]}, {"text": "x", "many": [{"factor": 1}]},
    {"text": "x", "many": [{"unit": "m", "z": 1}]}, {"text": "x", "many": [[]]}, {"text": "x", "named": {"b": 1, "a": 2}}, {"text": "x", "named": {"a": None}},
    {"text": "x", "named": {"a": "1"}}, {"text": "x", "named": {}}, {"text": "x", "odd key": 3}, {"text": LONG},
    [], [{"text": "x"}], "x", 5, None, True,
]
TEXTS = [
    None, "", " ", "{", '{"text":"x"} junk', '{"text":"x"}{"text":"y"}', '{"text":"x","text":"y"}', '{"text":"x"}]', '{"text":"x"},1', '{"text":"x"},"m"] junk',
    "{'text':'x'}", '{"text":"x",}', '{"text":NaN}', '{"text":"x","share":NaN}', '{"text":"x","count":01}', '  {"text" :\n"x" }  ', '{"text":"x"}//', "nonsense",
    '{"text":"x","inner":{"unit":"a","unit":"b"}}', '{"text":"x","share":1e2}', '{"text":"x","count":1e2}', '{"text":"x","share":0.10}', '{"\\u0074ext":"x"}',
]


class Repeated(ValueError):
    pass


def pairs(items):
    if len({k for k, _ in items}) < len(items):
        raise Repeated
    return dict(items)


def refuse(text):
    raise ValueError(text)


def fits(value, kind, nullable):
    """A validator of its own: by Python's types of the parsed value."""
    if value is None:
        return nullable
    if isinstance(kind, T.StructType):
        return (
            isinstance(value, dict) and set(value) <= set(kind.names)
            and all(fits(value[f.name], f.dataType, f.nullable) if f.name in value else f.nullable for f in kind.fields)
        )
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(fits(x, kind.elementType, kind.containsNull) for x in value)
    if isinstance(kind, T.MapType):
        return isinstance(value, dict) and all(fits(x, kind.valueType, kind.valueContainsNull) for x in value.values())
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.IntegralType):
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        return type(value) is int and -(2**bits) <= value < 2**bits
    return type(value) in (int, float)


def without_nulls(value, kind):
    if isinstance(value, dict) and isinstance(kind, T.StructType):
        return {k: without_nulls(x, kind[k].dataType) for k, x in value.items() if x is not None}
    if isinstance(value, list) and isinstance(kind, T.ArrayType):
        return [without_nulls(x, kind.elementType) for x in value]
    return value


def expected(text):
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    except (ValueError, TypeError):
        return False, None
    return (True, without_nulls(value, SCHEMA)) if value is not None and fits(value, SCHEMA, False) else (False, None)


def test_arguments_against_a_validator(spark):
    texts = [json.dumps(c) for c in CASES] + [json.dumps(c, ensure_ascii=False) for c in CASES] + TEXTS
    table = spark.createDataFrame([(i, "tool", t) for i, t in enumerate(texts)] + [(-1, "other", '{"text":"x"}'), (-2, None, '{"text":"x"}')], "i int, name string, arguments string")
    valid, canonical = chat.checked_arguments(F.col("name"), F.col("arguments"), {"tool": SCHEMA})
    found = {r[0]: (r[1], r[2]) for r in table.select("i", valid, canonical).collect()}
    assert found.pop(-1) == found.pop(-2) == (False, None)
    for i, text in enumerate(texts):
        good, value = expected(text)
        assert found[i][0] == good, (text or "")[:100]
        if good:
            assert json.loads(found[i][1]) == value, (text or "")[:100]
            # nothing but the canonical form of that value: keys in order, no white space
            assert list(json.loads(found[i][1])) == sorted(value) and '": ' not in found[i][1].replace("\\n", "")[:50]
        else:
            assert found[i][1] is None


def test_a_tool_without_fields(spark):
    table = spark.createDataFrame([("{}",), ('{"a":1}',), ("null",), (None,)], "arguments string")
    valid, canonical = chat.checked_arguments(F.lit("t"), F.col("arguments"), {"t": T.StructType([])})
    assert [tuple(r) for r in table.select(valid, canonical).collect()] == [(True, "{}"), (False, None), (False, None), (False, None)]


def graph(spark, edges, extra=()):
    ids = {a for a, _ in edges} | set(extra)
    rows = [(i, [b for a, b in edges if a == i] + [None]) for i in sorted(ids)]
    return spark.createDataFrame(rows, "call_id string, depends_on array<string>")


def test_a_chain_of_a_thousand_takes_few_rounds(spark, workspace, monkeypatch):
    calls = graph(spark, [(f"c{k:04}", f"c{k - 1:04}") for k in range(1, 1000)], ["c0000"])
    stored = []
    monkeypatch.setattr(type(workspace), "store", lambda self, *a, keep=type(workspace).store, **k: stored.append(1) or keep(self, *a, **k))
    found = {r["call_id"]: r["level"] for r in chat.levels(calls, workspace).collect()}
    assert found == {f"c{k:04}": k for k in range(1000)}
    assert len(stored) < 25


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_against_brute_force(spark, workspace, seed):
    import random

    draw = random.Random(seed)
    names = [f"n{k:02}" for k in range(60)]
    edges = [(names[k], names[draw.randrange(k)]) for k in range(1, 50) for _ in range(draw.choice([0, 1, 1, 1, 2, 3]))]
    # cycles, what hangs on them, an unknown call, a call on itself, and repeated rows
    edges += [("n50", "n51"), ("n51", "n52"), ("n52", "n50"), ("n53", "n50"), ("n54", "lost"), ("n55", "n54"), ("n56", "n56"), ("n57", "n01"), ("n57", "n53"), ("n58", "n57")]
    needs = {n: {b for a, b in edges if a == n} for n in names}
    level, changed = {}, True
    while changed:
        changed = False
        for n in names:
            if n not in level and all(b in level for b in needs[n]):
                level[n], changed = max([level[b] + 1 for b in needs[n]], default=0), True
    calls = graph(spark, edges, names)
    found = chat.levels(calls.unionByName(calls.limit(7)), workspace).collect()
    assert {r["call_id"]: r["level"] for r in found} == level and len(found) == len(level)
