import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rippletrace.functions import canon

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(max_size=8),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=12,
)


def test_forms():
    assert canon.plain({"b": 1, "a": [1, 2.5, None, True, "é"]}) == '{"a":[1,2.5,null,true,"é"],"b":1}'
    assert canon.strict({"é": "é"}) == '{"é":"é"}'
    for bad in (1.5, {"x": [0.1]}, {1: 2}, {"é": 1, "é": 2}):
        with pytest.raises(ValueError):
            canon.strict(bad)
    assert canon.params_hash(None) == canon.params_hash({})
    assert canon.params_hash({"a": None}) != canon.params_hash({})
    assert canon.strict([{"a": 1}, "b", 2, None, True, [1]], array_as_set=True) == '[null,true,2,"b",{"a":1},[1]]'
    assert canon.file_hash("a.json", b'{ "b":1,"a":2 }') == canon.file_hash("a.json", b'{"a":2,"b":1}')
    assert canon.file_hash("a.csv", b"x ") != canon.file_hash("a.csv", b"x")


@given(VALUES)
def test_key_order_never_matters(value):
    try:
        text = canon.strict(value)
    except ValueError:
        return
    assert canon.strict(json.loads(text)) == text


def test_columns_match_python(spark):
    from pyspark.sql import functions as F

    texts = ['{"b":1,"a":{"z":[3,1],"y":"é"}}', '{"n":123456789012345678901234567890}', "{}", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        canon.canonical_a("t").alias("a"), canon.params_hash_of(F.col("t")).alias("h")
    )
    for text, row in zip(texts, rows.collect(), strict=True):
        assert row["a"] == (None if text is None else canon.strict(json.loads(text)))
        assert row["h"] == canon.params_hash(json.loads(text) if text else None)
    d = spark.createDataFrame([("AB" * 32,), ("x",)], "d string").select(canon.normalised_digest(F.col("d")).alias("n")).collect()
    assert d[0]["n"] == "ab" * 32 and d[1]["n"] == canon.sha256("x")
