import json

import pytest

from rippletrace import api
from rippletrace.cli import main

SPEC = {
    "spec_version": "1",
    "study_id": "x",
    "source_table": "raw",
    "sources": [{"id": "s:A", "name": "A", "type": "string"}, {"id": "s:B", "name": "B", "type": "string"}],
    "derived": [
        {"id": "d:AGE", "name": "AGE", "type": "int", "transform_ref": "t:age", "inputs": ["s:B", "s:A"], "params": {"unit": "y"}},
        {"id": "d:GRP", "name": "GRP", "type": "string", "transform_ref": "t:grp", "inputs": ["d:AGE"]},
        {"id": "d:SEX", "name": "SEX", "type": "string", "transform_ref": "t:sex", "inputs": ["s:A"]},
    ],
    "constraints": [{"id": "c:ADULT", "name": "ADULT", "inputs": ["d:AGE"], "expression": "AGE >= 18"}],
}


def registry(**digests):
    return {
        "registry_version": "1",
        "transforms": [
            {"id": f"t:{k}", "version": "1", "kind": "builtin", "signature": {"inputs": [], "output": "x"}, "params_schema_hash": None,
             "impl_fingerprint": {"algo": "sha256", "source": "code", "ref": k, "digest": v * 64}}
            for k, v in digests.items()
        ],
    }


ALL = {"age": "a", "grp": "b", "sex": "c"}


def changed(**edits):
    spec = json.loads(json.dumps(SPEC))
    for d in spec["derived"]:
        d.update(edits.get(d["id"][2:], {}))
    return spec


def test_rename_has_no_impact(spark):
    out = api.diff(spark, SPEC, changed(AGE={"name": "AGE2"}))
    assert [e["change_type"] for e in out["events"]] == ["DERIVED_RENAMED"]
    assert out["impacted_ids"] == [] and out["unaffected_ids"] == ["d:AGE", "d:GRP", "d:SEX"]


def test_params_change_runs_downstream(spark):
    out = api.diff(spark, SPEC, changed(AGE={"params": {"unit": "m"}}))
    assert out["reasons"] == {"d:AGE": "DIRECT_CHANGE", "d:GRP": "TRANSITIVE_DEPENDENCY"}
    assert out["paths"]["d:GRP"] == ["d:AGE", "d:GRP"] and out["unaffected_ids"] == ["d:SEX"]


def test_ref_change_hides_params_change_and_order_of_inputs_is_no_change(spark):
    out = api.diff(spark, SPEC, changed(AGE={"transform_ref": "t:new", "params": {}, "inputs": ["s:A", "s:B"]}))
    assert [e["change_type"] for e in out["events"]] == ["DERIVED_TRANSFORM_REF_CHANGED"]


def test_removed_source_and_removed_variable(spark):
    v2 = json.loads(json.dumps(SPEC))
    v2["sources"] = v2["sources"][:1]
    v2["derived"][0]["inputs"] = ["s:A"]
    out = api.diff(spark, SPEC, v2)
    # lacking an input goes before a direct change
    assert out["reasons"]["d:AGE"] == "MISSING_INPUT" and out["missing_inputs"]["d:AGE"] == ["s:B"]
    v2 = json.loads(json.dumps(SPEC))
    v2["derived"].pop(1)
    out = api.diff(spark, SPEC, v2)
    assert [e["change_type"] for e in out["events"]] == ["DERIVED_REMOVED"]
    assert "d:GRP" in out["unaffected_ids"]  # a removed variable is not impacted itself


def test_inputs_with_a_constraint_count_as_missing(spark):
    out = api.diff(spark, SPEC, changed(SEX={"inputs": ["s:A", "c:ADULT"]}))
    assert out["reasons"] == {"d:SEX": "DIRECT_CHANGE_MISSING_INPUT"}


def test_registry_changes(spark):
    out = api.diff(spark, SPEC, SPEC, registry(**ALL), registry(**ALL | {"age": "f"}))
    assert out["reasons"] == {"d:AGE": "TRANSFORM_IMPL_CHANGED", "d:GRP": "TRANSITIVE_DEPENDENCY"} and not out["validation_failed"]
    out = api.diff(spark, SPEC, SPEC, registry(**ALL), registry(age="a", grp="b"))
    assert out["reasons"]["d:SEX"] == "MISSING_TRANSFORM_REF" and out["validation_failed"]
    assert api.R.core_report(out)["run_status"] == "non_executable"
    # lacking on both sides: impacted and unaffected at once
    both = api.diff(spark, SPEC, SPEC, registry(age="a", grp="b"), registry(age="a", grp="b"))
    assert "d:SEX" in both["impacted_ids"] and "d:SEX" in both["unaffected_ids"]


def test_bindings_override(spark):
    bound = {"table": "raw", "bindings": {"a1": "s:A", "a2": "s:A"}}
    out = api.diff(spark, SPEC, SPEC, to_bindings=bound)
    assert out["reasons"] == {"d:AGE": "AMBIGUOUS_BINDING", "d:SEX": "AMBIGUOUS_BINDING", "d:GRP": "TRANSITIVE_DEPENDENCY"}
    assert out["missing_bindings"] == {"d:AGE": ["s:B"]} and out["validation_failed"]


def test_dangling_and_cyclic_graphs_are_refused(spark):
    with pytest.raises(api.ArtifactError, match="s:Z"):
        api.diff(spark, SPEC, changed(SEX={"inputs": ["s:Z"]}))
    with pytest.raises(api.ArtifactError, match="cycle"):
        api.diff(spark, SPEC, changed(AGE={"inputs": ["d:GRP"]}))
    with pytest.raises(api.ArtifactError, match="UNKNOWN_FIELD"):
        api.diff(spark, SPEC, SPEC | {"extra": 1})


def test_all_details_and_doctor(spark, tmp_path):
    v2 = changed(AGE={"params": {"unit": "m"}})
    report = api.diff_all_details(spark, SPEC, v2)
    w = report["details"]["witnesses"]
    assert w["d:GRP"]["root_cause_ids"] == ["d:AGE"] and w["d:GRP"]["distance"] == 1 and w["d:GRP"]["predecessor"] == "d:AGE"
    assert w["d:AGE"]["triggering_event_ids"] == [report["details"]["event_index"][0]["event_id"]] == w["d:GRP"]["triggering_event_ids"]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(report))
    assert api.doctor(spark, path, SPEC, v2)["ok"]
    report["details"]["witnesses"]["d:GRP"]["distance"] = 5
    report["impacted"] = []
    report["verifier_contract_version"] = "9"
    path.write_text(json.dumps(report))
    found = api.doctor(spark, path, SPEC, v2)
    assert found["summary"]["failed_clause_ids"] == ["header_contract", "witness_invariants"]
    assert api.doctor(spark, tmp_path / "none.json", SPEC, v2)["summary"]["failed_clause_ids"] == ["report_read"]
    cut = api.diff_all_details(spark, SPEC, SPEC, to_bindings={"table": "raw", "bindings": {}}, caps={"max_root_causes_per_node": 1})
    assert cut["details"]["omissions"][0]["omitted_count"] == 1


def test_validate(spark):
    bad = changed(SEX={"inputs": ["s:Z"], "transform_ref": "sex"}, GRP={"inputs": ["d:AGE", "d:AGE"]})
    bad["sources"].append(bad["sources"][0])
    found = api.validate(spark, bad, registry(age="a"), {"table": "raw", "bindings": {"a": "s:A", "b": "s:A", "q": "s:B"}}, {"table": "raw", "columns": [{"name": "a", "type": "x"}]})
    codes = [e["code"] for e in found["errors"]]
    assert codes == sorted(codes) and set(codes) == {"DUPLICATE_ID", "INVALID_STRUCTURE", "MISSING_INPUT", "MISSING_TRANSFORM_REF"}
    assert {w["code"] for w in found["warnings"]} == {"AMBIGUOUS_BINDING", "INVALID_RAW_COLUMN", "MISSING_BINDING"}
    assert api.validate(spark, SPEC)["ok"] and not api.validate(spark, '{"sources": ')["ok"]


def test_command_line(spark, tmp_path, capsys):
    for n, s in (("a", SPEC), ("b", changed(AGE={"type": "decimal"}))):
        (tmp_path / n).write_text(json.dumps(s))
    args = ["diff", "--from-spec", str(tmp_path / "a"), "--to-spec"]
    assert main([*args, str(tmp_path / "a")], spark) == 0
    assert main([*args, str(tmp_path / "b"), "--output-dir", str(tmp_path / "out")], spark) == 1
    report = json.loads((tmp_path / "out/impact.json").read_text())
    assert report["impact_details"]["d:GRP"]["path"] == [{"src": "d:AGE", "dst": "d:GRP", "kind": "unknown"}]
    assert "d:GRP" in (tmp_path / "out/impact.md").read_text()
    assert main([*args, str(tmp_path / "missing")], spark) == 1
    assert main(["verify", "spec", str(tmp_path / "a")], spark) == 0
    capsys.readouterr()
