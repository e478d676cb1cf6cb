from hypothesis import given
from hypothesis import strategies as st

from runlens.functions.toon import encode, encode_json, loads, number, toon_table

CASES = [
    ({}, ""), ([], "[]"), ({"a": None, "b": True}, "a: null\nb: true"), ({"a": {}}, "a:"), ({"a": []}, "a: []"),
    ({"x": [1, "a,b", "c"]}, 'x[3]: 1,"a,b",c'),
    ({"r": [{"i": 1, "n": "x"}, {"n": "y z", "i": 2}]}, "r[2]{i,n}:\n  1,x\n  2,y z"),
    ({"r": [{"a": {"b": 1, "c": 2}}, {"a": {"b": 3, "c": 4}}]}, "r[2]{a{b,c}}:\n  1,2\n  3,4"),
    ({"a": {"v": 1}, "b": {"v": 2}}, "[2:]{v}:\n  a: 1\n  b: 2"),
    ({"k": [{"a": 1}, 2, [3]]}, "k[3]:\n  - a: 1\n  - 2\n  - [1]: 3"),
    ({"q k": "- x", "t": "true", "e": "", "n": "01.5"}, '"q k": "- x"\nt: "true"\ne: ""\nn: "01.5"'),
    ("a\tb\x01", '"a\\tb\\u0001"'),
]


def test_cases():
    for value, want in CASES:
        assert encode(value) == want


def test_options():
    assert encode({"a": [1, 2]}, delimiter="|") == "a[2|]: 1|2"
    assert encode({"a": ["x: y", "[z]"]}, list_scalars=True) == 'a[2]:\n  - "x: y"\n  - [z]'


def test_numbers():
    for text, want in [("-0", "0"), ("1.50", "1.5"), ("1e3", "1000"), ("1e400", "1e+400"), ("12345678901234567890123", "12345678901234567890123"), ("1e-7", "1e-7"), ("0.000001", "0.000001"), ("1.25E+21", "1.25e+21")]:
        assert number(text) == want


@given(st.integers(-(10**30), 10**30))
def test_integers_are_exact(n):
    assert number(str(n)) == str(n)


def test_columns(spark):
    rows = spark.createDataFrame([(1, '{"b":1e400,"a":1.50}'), (2, "{"), (3, None)], "i int, j string").select("i", encode_json("j").alias("t"))
    assert {r.i: r.t for r in rows.collect()} == {1: "b: 1e+400\na: 1.5", 2: None, 3: None}


def test_table_is_what_the_encoder_writes(spark):
    words = ["x", "", "a,b", "true", "5", " lead", 'q"', "tab\t", "-d", "plain text", None]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    got = toon_table(rows, "t", ["i", "w"], ["i"]).first()["toon"]
    assert got == encode({"t": [{"i": i, "w": w} for i, w in enumerate(words)]})


def test_duplicate_keys_and_bad_json():
    assert encode(loads('{"a":1,"b":2,"a":3}')) == "a: 3\nb: 2"
