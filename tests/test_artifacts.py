import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rippletrace import api
from rippletrace.functions import ids
from rippletrace.operators import changes as C
from rippletrace.operators import lineage as L
from rippletrace.sources import artifacts as A

from .test_diff import SPEC, changed, registry


def test_versioned_artifacts(spark):
    docs = A.documents(spark, {"old": {"table": "t", "bindings": {}, "more": 1}, "new": {"schema_version": "0.7", "table": "t", "bindings": {}}, "kept": {"schema_version": "0.7", "table": "t", "bindings": {}, "x": 1}})
    got = {r["pair_id"]: r for r in A.versioned(docs, "bindings").collect()}
    assert got["old"]["schema_version"] == "0.7" and got["old"]["extra"] == ["more"] and len(got["old"]["warnings"]) == 2
    assert got["kept"]["extra"] == ["x"] and got["kept"]["warnings"] == ["unknown fields kept: x"]
    assert got["new"]["warnings"] == []
    for text, how in (({"schema_version": "0.5"}, "preserve"), ({"schema_version": "0.7", "x": 1}, "reject"), ({"x": 1}, "reject")):
        with pytest.raises(PySparkException):
            A.versioned(A.documents(spark, {"p": text}), "bindings", how).collect()


def test_scan_and_params(spark, tmp_path):
    for p in ("one", "two"):
        (tmp_path / p).mkdir()
        (tmp_path / p / "spec.json").write_text(json.dumps(SPEC))
    docs = A.scan(spark, str(tmp_path / "*/spec.json"))
    assert {r["pair_id"] for r in docs.collect()} == {"one", "two"}
    e = A.elements(docs.select("pair_id", "text"))
    assert e.count() == 12 and e.filter("id = 'd:AGE'").first()["inputs"] == ["s:A", "s:B"]
    assert api.validate(spark, changed(AGE={"params": {"x": 0.5}}))["errors"][0]["code"] == "INVALID_STRUCTURE"
    assert api.validate(spark, changed(AGE={"params": {"x": "y" * 60_000}}))["errors"][0]["code"] == "PARAMS_TOO_LARGE"
    assert api.validate(spark, changed(AGE={"params": {"x": "y" * 20_000}}))["warnings"][0]["code"] == "PARAMS_LARGE"
    with pytest.raises(api.ArtifactError, match="AGE"):
        api.diff(spark, SPEC, changed(AGE={"params": {"x": 0.5}}))
    sets = {r["kind"]: r["ids"] for r in C.id_sets(e.filter("pair_id = 'one'")).collect()}
    assert sets["source"] == ["s:A", "s:B"] and C.lookup(e, e.filter("id = 'd:SEX'")).count() == 2


def test_registry_rules_and_history(spark):
    bad = registry(age="a", Sex="b")
    bad["transforms"].append(bad["transforms"][0] | {"history": [{"timestamp": "yesterday"}]})
    found = {(r["id"], r["message"].split()[0]) for r in api.verify_registry(spark, bad)}
    assert ("t:Sex", "transform") in found and ("t:age", "transform") in found and ("t:age", "timestamps") in found
    assert api.verify_registry(spark, registry(age="a")) == []
    t = spark.createDataFrame([("p", "t:a", ["x"]), ("p", "t:b", None)], "pair_id string, id string, history array<string>")
    entry = spark.createDataFrame([("p", "t:a", "y")], "pair_id string, id string, snapshot string")
    assert {r["id"]: r["history"] for r in api.with_history(t, entry).collect()} == {"t:a": ["x", "y"], "t:b": None}


def test_ids(spark):
    rows = spark.createDataFrame([("v:t.c.d", None), ("s:x", "own"), ("c:y", None), ("q", None)], "id string, given string")
    got = rows.select(ids.kind_of(F.col("id")), ids.table_of(F.col("id"), F.col("given")), ids.column_of(F.col("id"))).collect()
    assert [tuple(r) for r in got] == [("derived", "t", "c.d"), ("source", "own", None), ("constraint", None, None), ("unknown", None, None)]
    paths = spark.createDataFrame([("a\\b.json",), ("../x",), ("/x",), ("C:\\x",)], "p string")
    assert [r[0] for r in paths.select(ids.unsafe_path(F.col("p"))).collect()] == [False, True, True, True]
    assert paths.limit(1).select(ids.safe_path(F.col("p"))).first()[0] == "a/b.json"
    with pytest.raises(PySparkException):
        paths.select(ids.safe_path(F.col("p"))).collect()


def test_lineage_rules(spark):
    nodes = [("p", "s:1", "step", ["t:a"], ["t:b"], None, None), ("p", "s:1", "step", ["t:a"], ["t:b"], None, None), ("p", "t:a", "table", None, None, None, ["s:1"]), ("p", "t:b", "table", None, None, None, []), ("p", "x:9", "table", None, None, None, None)]
    edges = [("p", "t:a", "s:1", "consumes"), ("p", "s:1", "t:b", "produces"), ("p", "s:1", "t:b", "produces"), ("p", "t:a", "t:b", "produces"), ("p", "s:1", "t:z", "produces")]
    n = spark.createDataFrame(nodes, "pair_id string, id string, kind string, inputs array<string>, outputs array<string>, producer string, consumers array<string>")
    e = spark.createDataFrame(edges, "pair_id string, src string, dst string, kind string")
    v = spark.createDataFrame([("p", 2)], "pair_id string, schema_version int")
    found = L.violations(n, e, v)
    assert {r["name"] for r in found.collect()} == {"schema version", "duplicate node", "wrong prefix", "duplicate edge", "unknown edge end", "edge between wrong kinds", "outputs differ from edges", "producer differs from edges"}
    assert L.first_violation(found).first()["name"] == "schema version"


def test_column_sections(spark):
    cols = lambda rows: spark.createDataFrame([("p", *r) for r in rows], "pair_id string, table string, column string, type string")
    changes = C.column_changes(cols([("t", "a", "int"), ("t", "b", "int")]), cols([("t", "b", "string"), ("t", "c", "int")]))
    r = C.column_sections(changes).first()
    assert (r["added"], r["removed"], r["type_changed"]) == (["c"], ["a"], ["b: int -> string"])
    assert {x["change_type"] for x in C.by_type(C.spec_changes(A.elements(A.documents(spark, {"p": SPEC})), A.elements(A.documents(spark, {"p": changed(SEX={"name": "S2"})})))).collect()} == {"DERIVED_RENAMED"}
