"""Scalar functions against literals and plain Python."""

from __future__ import annotations

import base64
import json
from urllib.parse import quote, unquote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovex.functions import codecs, numbers, times
from trovex.functions import text as T
from trovex.operators import index, ranking, rules

MANY = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, f, kind="string"):
    """f of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_trigrams(spark):
    got = column(spark, ["abcab", "ab", "a", "", "你好", "ABC", None, "aaaa"], T.trigrams)
    assert got[:6] == [["abc", "bca", "cab"], ["ab"], ["a"], [], [], ["abc"]]
    assert not got[6]
    assert got[7] == ["aaa"]


def test_continuity_never_goes_back(spark):
    def walk(t: str, q: str) -> float:
        at = run = best = 0
        for c in t.lower():
            if at < len(q) and c == q[at]:
                run, at = run + 1, at + 1
                best = max(best, run)
            else:
                run = 0
        return best / len(q.encode())

    texts = ["visual studio code", "vxiysual", "", "code visual", "vvisual"]
    for q in ("visual", "vsc", "é"):
        assert column(spark, texts, lambda c, q=q: T.continuity(c, F.lit(q))) == pytest.approx([walk(t, q) for t in texts])


def test_text_score(spark):
    df = spark.createDataFrame([("Visual Studio Code", "Code Editor", 50)], "t string, s string, raw int")
    score = lambda q: df.select(T.text_score(F.col("t"), F.col("s"), F.lit(q), F.col("raw"))).first()[0]
    assert score("visual studio code") == 100
    assert score("visual") == 100  # 80 + 30 + 5
    assert score("vsc") == pytest.approx(40 + 30 / 3 + 5)
    assert score("") == 0
    assert score("zzz") == pytest.approx(5)


def test_frequency_and_recency(spark):
    got = column(spark, [0, 1, 10, 100, 1000], ranking.frequency_score, "long")
    assert got == pytest.approx([0, 15.051499783199059, 52.06963425791125, 100, 100])
    df = spark.sql("select explode(array(interval 1 second, interval 10 minute, interval 5 hour, interval 3 day, interval 10 day, interval 40 day)) as gone")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    assert [r[0] for r in df.select(times.recency_score(now - F.col("gone"), now)).collect()] == [100, 80, 60, 40, 20, 10]


def test_position_score(spark):
    assert column(spark, ["bolt", "a bolt", "éa bolt", "none", None], lambda c: T.position_score(c, F.lit("BOLT"))) == [100, 78, 76, None, None]


def test_match_tiers(spark):
    df = spark.createDataFrame([("微信", "weixin", "wx")], "t string, full string, short string")
    tier = lambda q: df.select(T.match_tier(F.col("t"), F.col("full"), F.col("short"), F.lit(q))).first()[0]
    assert [tier(q) for q in ("微信", "微", "信", "wei", "wx", "xin", "x", "zz", "")] == [1000, 800, 600, 500, 400, 300, 300, 0, 0]


def test_html_and_header(spark):
    assert column(spark, ["<a href='x'>&\"</a>"], T.html_escaped) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"]
    assert column(spark, ['attachment; filename="my-plugin.ilp"', "inline"], T.attachment_name) == ["my-plugin.ilp", None]


@MANY
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00")), min_size=1, max_size=8))
def test_codecs_round_trip(spark, texts):
    assert column(spark, texts, codecs.to_base64) == [base64.b64encode(t.encode()).decode() for t in texts]
    assert column(spark, texts, lambda c: codecs.from_base64(codecs.to_base64(c))) == texts
    assert column(spark, texts, codecs.url_encoded) == [quote(t, safe="-._~") for t in texts]
    assert column(spark, texts, lambda c: codecs.url_decoded(codecs.url_encoded(c))) == texts


def test_bad_codes_are_null(spark):
    assert column(spark, ["a", "a===", "////", "aGk=", "%%"], codecs.from_base64) == [None, None, None, "hi", None]
    assert column(spark, ["%zz", "a+b", "a%20b"], codecs.url_decoded) == [None, unquote("a+b"), "a b"]
    assert column(spark, ['{"a": 1}', "{", None], codecs.json_status) == ["ok", "error", "error"]
    assert json.loads(column(spark, ['{"b": [1, 2], "a": null}'], codecs.json_minified)[0]) == {"b": [1, 2], "a": None}


def test_calculator(spark):
    literal = {"1+2*3": 7, "10/4": 2.5, "7": 7, "8-3-2": 3, "2*3/4": 1.5, "(1+2)*3": None, "-5+3": None, "1/0": None, "2 * 3": 6}
    assert {k: numbers.literal_value(k) for k in literal} == literal
    exact = {"1+2*3": 7, "(1+2)*3": 9, "-5+3": -2, "1/0": None, "2*(3-(4-1))": 0, "-(2+3)*2": -10, "1 2": None, "(1": None, "": None, "2--1": 3, "*2": None}
    assert {k: numbers.exact_value(k) for k in exact} == exact


@MANY
@given(st.recursive(st.integers(1, 99).map(str), lambda x: st.tuples(x, st.sampled_from("+-*/"), x).map("".join) | x.map("({})".format) | x.map("-{}".format), max_leaves=8))
def test_exact_value_is_python(expr):
    try:
        want = float(eval(expr))  # noqa: S307  an expression of digits and operators made here
    except ZeroDivisionError:
        want = None
    got = numbers.exact_value(expr)
    assert got is None if want is None else got == pytest.approx(want)


def test_number_formats(spark):
    assert column(spark, [3.0, 2.5, 1 / 3, 100.0], numbers.plain_number, "double") == ["3", "2.5", "0.333333", "100"]
    assert column(spark, [0.0, 0.0005, 12.0, 1.25, 2_000_000.0], numbers.converter_number, "double") == ["0.000000e0", "5.000000e-4", "12", "1.25", "2.000000e6"]


def test_number_formats_round_exact_values(spark):
    """0.00165 is a little less than it reads, 0.00125 a little more, 0.03125 is a tie; DuckDB's printf is the measure."""
    import duckdb

    some = [0.00105, 0.00125, 0.00165, 0.0100015, 0.03125, -0.00165, 0.0, 1e300, float("inf"), None]
    assert column(spark, [0.0100015, 0.5000025, None], numbers.plain_number, "double") == ["0.010001", "0.500003", None]
    assert column(spark, some[:6], numbers.converter_number, "double") == ["0.001", "0.0013", "0.0016", "0.01", "0.0312", "-0.0016"]
    want = [duckdb.sql(f"SELECT printf('%.6e', CAST('{x}' AS DOUBLE))").fetchall()[0][0] for x in some[:-1]]
    assert column(spark, some, lambda x: numbers.printed(x, "%.6e"), "double") == [*want, None]


def test_bases(spark):
    assert column(spark, ["0xFF", "0b1011", "0o17", "12", "0x8000000000000000"], numbers.base_value) == [255, 11, 15, None, None]
    assert column(spark, [255], lambda c: numbers.based(c)["octal"], "long") == ["0o377"]


def test_units(spark):
    rows = numbers.conversions(spark.createDataFrame([("10 km to miles",), ("100 C to F",), ("1 kg to km",), ("x",)], "text string")).collect()
    assert {r.text: round(r.result, 6) for r in rows} == {"10 km to miles": 6.21371, "100 C to F": 212.0}
    rows = numbers.inline_conversions(spark.createDataFrame([("5km",), ("1.2.3m",), ("3 zz",)], "text string")).collect()
    assert {(r.from_unit, r.to_unit): round(r.result, 6) for r in rows} == {("km", "m"): 5000.0, ("km", "mi"): 3.106855}


def test_rules(spark):
    assert column(spark, ["com.example.my-plugin", "invalid", "com.", ""], rules.valid_id) == [True, False, False, False]
    assert column(spark, ["network:x", "clipboard:read", "invalid:permission"], rules.valid_permission) == [True, True, False]
    assert column(spark, ["C:\\a.exe", "C:\\Windows\\a", "C:\\a.EXE", "C:\\a.cmd"], rules.path_priority) == [100, 70, 50, 80]


def test_permissions(spark):
    grants = spark.createDataFrame([("p", "read", "/home/user"), ("p", "network", "api.example.com"), ("q", "network", "*")], "plugin_id string, kind string, arg string")
    asked = [(1, "p", "read", "/home/user/file.txt"), (2, "p", "write", "/home/user"), (3, "p", "read", "/etc/passwd"), (4, "p", "network", "api.example.com"), (5, "p", "network", "evil.com"), (6, "q", "network", "evil.com"), (7, "r", "read", "/"), (8, "p", "read", "/home/username")]
    rows = rules.allowed(spark.createDataFrame(asked, "request_id int, plugin_id string, kind string, arg string"), grants).collect()
    assert {r.request_id for r in rows if r.allowed} == {1, 2, 4, 6}
    assert len(rows) == len(asked)


def test_conditions(spark):
    df = spark.createDataFrame([({"greeting": "Hello, World!"},), ({},)], "v map<string,string>")
    holds = lambda spec: [r[0] for r in df.select(rules.condition(spec, F.col("v"))).collect()]
    has = {"type": "VariableContains", "name": "greeting", "substring": "World"}
    assert holds(has) == [True, False]
    assert holds({"type": "Not", "condition": has}) == [False, True]
    assert holds({"type": "And", "conditions": [has, {"type": "VariableEquals", "name": "greeting", "value": "x"}]}) == [False, False]
    assert holds({"type": "TimeRange", "start": "a", "end": "b"}) == [True, True]
    assert holds({"type": "Or", "conditions": []}) == [False, False]


@MANY
@given(st.lists(st.text(alphabet="abAB c", max_size=8), min_size=1, max_size=12), st.text(alphabet="ab c", min_size=3, max_size=5))
def test_index_search(spark, names, query):
    files = spark.createDataFrame(list(enumerate(names)), "file_id int, name string")
    posts = index.postings(files)
    candidates = {r.file_id for r in index.search_and(posts, query).collect()}
    exact = {i for i, n in enumerate(names) if query in n.lower()}
    assert exact <= candidates
    assert {r.file_id for r in index.search_exact(files, posts, query).collect()} == exact
    half = files.where("file_id % 2 = 0")
    merged = index.with_delta(index.postings(half), index.postings(files.where("file_id % 2 = 1")))
    assert {tuple(r) for r in merged.collect()} == {(r.gram, r.file_id) for r in posts.collect()}


def test_units_agree_with_the_sizes_of_units():
    """Factors against each unit's size in its base unit, so that a wrong entry shows though query and SQL share the table."""
    sizes = {
        "m": 1, "km": 1000, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "miles": 1609.344, "ft": 0.3048, "feet": 0.3048, "in": 0.0254, "inch": 0.0254,
        "kg": 1, "g": 0.001, "mg": 1e-6, "lb": 0.45359237, "lbs": 0.45359237, "oz": 0.028349523, "sqm": 1, "sqft": 0.09290304,
        "l": 1, "liter": 1, "gal": 3.785411784, "gallon": 3.785411784, "ml": 0.001, "floz": 0.0295735296, "kmh": 1, "mph": 1.609344,
        "b": 1, "kb": 2**10, "mb": 2**20, "gb": 2**30, "tb": 2**40, "s": 1, "sec": 1, "min": 60, "h": 3600, "hour": 3600, "day": 86400,
    }
    kelvin = {"c": (1, 273.15), "celsius": (1, 273.15), "f": (5 / 9, 273.15 - 160 / 9), "fahrenheit": (5 / 9, 273.15 - 160 / 9), "k": (1, 0), "kelvin": (1, 0)}
    for source, target, factor, shift in numbers.UNITS + numbers.INLINE:
        if source in kelvin:
            (a, b), (c, d) = kelvin[source], kelvin[target]
            assert (factor, shift) == pytest.approx((a / c, (b - d) / c), abs=1e-9)
        elif (source, target) in (("ms", "kmh"), ("kmh", "ms")):
            assert factor == pytest.approx(3.6 if source == "ms" else 1 / 3.6)
        else:
            assert shift == 0 and factor == pytest.approx(sizes[source] / sizes[target], rel=1e-5), (source, target)


@MANY
@given(st.lists(st.text("0123456789.+-*/() \t", max_size=12), min_size=1, max_size=20))
def test_literal_columns_are_literal_values(spark, texts):
    want = [numbers.literal_value(x) if x and not set(x) - set("0123456789.+-*/() \t") else None for x in texts]
    assert column(spark, texts, numbers.literal_column) == want
