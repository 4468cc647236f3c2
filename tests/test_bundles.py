import hashlib
import json
from pathlib import Path

from rippletrace import api
from rippletrace.functions import canon, render
from rippletrace.operators import run_diff as RD
from rippletrace.operators.verify import bundle_violations, change_chain, first_violations, legacy_graph_edges, legacy_graph_nodes, run_fingerprints
from rippletrace.sources import bundles as S


def bundle(root: Path, name: str, literal: str = "HIGH", tamper=None, expr="e1") -> None:
    """A small sound bundle with two steps; ``tamper`` may edit its parts before hashes are taken or files after."""
    d = root / name
    specs = [{"op": "identity", "params": {}}, {"op": "compute", "params": {"assignments": [{"target": "label", "expr": {"type": "lit", "value": literal}}]}}]
    tids = [canon.sha256(canon.strict(s)) for s in specs]
    wiring = [(["raw"], ["mid"]), (["mid"], ["out"])]
    steps = [
        {"kind": "op", "op": s["op"], "inputs": i, "outputs": o, "params": s["params"], "transform_id": t, "transform_class_id": s["op"],
         "step_id": canon.sha256(canon.strict({"transform_id": t, "inputs": i, "outputs": o}))}
        for s, t, (i, o) in zip(specs, tids, wiring, strict=True)
    ]
    graph = {
        "schema_version": 1,
        "producer": {"name": "x", "version": "1"},
        "nodes": [{"id": f"s:{s['step_id']}", "kind": "step", "op": s["op"], "transform_class_id": s["op"], "transform_id": s["transform_id"], "inputs": [f"t:{i}" for i in s["inputs"]], "outputs": [f"t:{o}" for o in s["outputs"]], "payload_sha256": s["transform_id"]} for s in steps]
        + [{"id": "t:raw", "kind": "table", "producer": None, "consumers": [f"s:{steps[0]['step_id']}"]}, {"id": "t:mid", "kind": "table", "producer": f"s:{steps[0]['step_id']}", "consumers": [f"s:{steps[1]['step_id']}"]}, {"id": "t:out", "kind": "table", "producer": f"s:{steps[1]['step_id']}", "consumers": []}],
        "edges": [{"src": f"t:{s['inputs'][0]}", "dst": f"s:{s['step_id']}", "kind": "consumes"} for s in steps] + [{"src": f"s:{s['step_id']}", "dst": f"t:{s['outputs'][0]}", "kind": "produces"} for s in steps],
    }
    stat = {"unique_count": 1, "null_count": 0, "row_count": 3, "top_values": [{"value": literal, "count": 3}]}
    parts = {
        "artifacts/plan.ir.json": {"steps": steps, "tables": [], "table_facts": {"mid": {"sorted_by": ["id"]}}},
        "artifacts/registry.candidate.json": {"registry_version": "1", "transforms": [{"transform_id": t, "kind": s["op"], "version": "0.1", "spec": s} for t, s in zip(tids, specs, strict=True)], "index": {"0": tids[0], "1": tids[1]}},
        "artifacts/graph.json": graph,
        "artifacts/runtime.evidence.json": {"run_id": f"run-{name}", "created_at": "2026-01-01", "step_evidence": [{"row_counts": {"mid": 5, "out": 2}}, {"row_counts": {"out": 3}, "columns": {"out": ["label", "id"]}}], "tables": {"out": {"columns": {"label": stat}}}},
        "artifacts/schema.evidence.json": {"tables": {"out": {"label": "string", "id": "int"}}},
        "artifacts/vars.graph.json": {
            "nodes": [{"id": "v:raw.id", "origin": "source", "payload_sha256": "p0"}, {"id": "v:out.label", "origin": "derived", "expr_sha256": expr, "payload_sha256": "p", "producing_step_id": steps[1]["step_id"], "transform_id": tids[1]}, {"id": "v:out.copy", "origin": "derived", "payload_sha256": "q", "producing_step_id": "z", "transform_id": "zz"}],
            "edges": [{"src": "v:raw.id", "dst": "v:out.label"}, {"src": "v:out.label", "dst": "v:out.copy", "kind": "flow"}],
        },
    }
    if tamper:
        tamper("parts", parts, d)
    for path, value in parts.items():
        (d / path).parent.mkdir(parents=True, exist_ok=True)
        (d / path).write_text(json.dumps(value))
    (d / "outputs").mkdir(exist_ok=True)
    (d / "outputs/out.csv").write_bytes(b"label\nHIGH\n")
    (d / "schema.lock.json").write_text(json.dumps({"datasources": {"lb": {"kind": "csv", "columns": {"id": "int"}}}}))
    report = {
        "report_schema_version": "0.3",
        "status": "ok",
        "inputs": [],
        "artifacts": [{"name": p.split("/")[-1], "path": p.replace("/", "\\"), "sha256": canon.sha256(canon.plain(v))} for p, v in parts.items()],
        "outputs": [{"name": "out", "path": "outputs/out.csv", "sha256": hashlib.sha256(b"label\nHIGH\n").hexdigest()}],
        "run_id": "r", "created_at": "2026-02-02",
    }
    # the lineage graph must be listed under exactly its path
    for a in report["artifacts"]:
        if a["name"] == "graph.json":
            a["path"] = "artifacts/graph.json"
    if tamper:
        tamper("report", report, d)
    (d / "report.json").write_text(json.dumps(report))
    if tamper:
        tamper("files", None, d)


def first(spark, root):
    return {r["bundle"]: r["code"] for r in first_violations(bundle_violations(S.files(spark, str(root)))).collect()}


def test_sound_and_tampered_bundles(spark, tmp_path):
    root = tmp_path / "bundles"

    def edit(stage, path, change):
        def run(when, value, d):
            if when == stage:
                change(value if path is None else value[path]) if stage != "files" else change(d)

        return run

    bundle(root, "good")
    bundle(root, "plan", tamper=edit("files", None, lambda d: (d / "artifacts/plan.ir.json").write_text('{"steps": []}')))
    bundle(root, "index", tamper=edit("parts", "artifacts/registry.candidate.json", lambda r: r["index"].pop("1")))
    bundle(root, "wiring", tamper=edit("parts", "artifacts/plan.ir.json", lambda p: p["steps"][0].update(step_id="0" * 64)))
    bundle(root, "gone", tamper=edit("files", None, lambda d: (d / "outputs/out.csv").unlink()))
    bundle(root, "unlisted", tamper=edit("parts", "artifacts/registry.candidate.json", lambda r: r["transforms"].pop()))
    bundle(root, "float", tamper=edit("parts", "artifacts/registry.candidate.json", lambda r: r["transforms"][0].update(spec={"op": "x", "params": {"v": 0.5}})))
    bundle(root, "thin", tamper=edit("report", None, lambda r: r.update(bundle_mode="thin")))
    assert first(spark, root) == {
        "plan": "HASH_MISMATCH",
        "index": "REGISTRY_INDEX_INCOMPLETE",
        "wiring": "STEP_ID_CONFLICT",
        "gone": "FILE_NOT_FOUND",
        "unlisted": "TRANSFORM_NOT_FOUND",
        "float": "INVALID_STRUCTURE",
        "thin": "INVALID_STRUCTURE",
    }
    out = api.ingest_bundles(spark, str(root))
    assert [r["bundle"] for r in out["runs"].collect()] == ["good"] and out["registry"].count() == 2 and out["graphs"].count() == 1
    files = S.files(spark, str(root)).filter("bundle = 'good'")
    assert {r["kind"] for r in legacy_graph_nodes(files).collect()} == {"step", "table", "artifact"} and legacy_graph_edges(files).count() == 4
    facts = {r["id"]: (r["row_count"], r["columns"], r["sorted_by"]) for r in legacy_graph_nodes(files).filter("kind = 'table'").collect()}
    assert facts == {"raw": (None, None, None), "mid": (5, None, '["id"]'), "out": (3, ["label", "id"], None)}


def test_fingerprint_ignores_provenance(spark, tmp_path):
    bundle(tmp_path / "b", "one")
    bundle(tmp_path / "b", "two", tamper=lambda s, v, d: v.update(run_id="other", created_at="x") if s == "report" else None)
    bundle(tmp_path / "b", "three", literal="LOW")
    got = {r["bundle"]: r["fingerprint"] for r in run_fingerprints(S.files(spark, str(tmp_path / "b"))).collect()}
    assert got["one"] == got["two"] != got["three"]


def test_run_diff_and_graph_diff(spark, tmp_path):
    bundle(tmp_path / "a", "run", "HIGH")
    bundle(tmp_path / "b", "run", "LOW", expr="e2")
    a, b = S.files(spark, str(tmp_path / "a")), S.files(spark, str(tmp_path / "b"))
    pairs = lambda f: f.select("bundle").distinct().selectExpr("bundle", "bundle AS pair_id")
    out = RD.run_diff(a, b, pairs(a), pairs(b))
    assert {r["var_id"]: r["reason"] for r in out["impact"].collect()} == {"v:out.label": "DIRECT_CHANGE", "v:out.copy": "TRANSITIVE_DEPENDENCY"}
    e = out["value_evidence"].first()
    assert (e["var_id"], e["kind"], e["summary"]) == ("v:out.label", "column_constant", '"HIGH" -> "LOW"')
    texts = {(r["old_text"], r["new_text"]) for r in out["events"].filter("change_type = 'DERIVED_TRANSFORM_REF_CHANGED'").collect()}
    assert texts == {('label = "HIGH"', 'label = "LOW"')}
    assert {(r["src"], r["kind"]) for r in out["edge_kinds"].collect()} == {("v:raw.id", "derivation"), ("v:out.label", "flow")}
    assert out["schema_evidence"].isEmpty() and out["schema_lock"].isEmpty() and out["refusals"].isEmpty()
    g = api.graph_diff_bundles(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert g["class_pairs"].first()["classification"] == "param_value_change"
    assert [r["type"] for r in g["events"].collect()] == ["step_replaced_same_class"]  # the added and removed step are covered
    assert g["hashes"].first()["hash_a"] != g["hashes"].first()["hash_b"]
    assert api.load_graphs(spark, str(tmp_path / "a"))["violations"].isEmpty()


def test_refused_runs_stop(spark, tmp_path):
    bundle(tmp_path / "a", "run")
    bundle(tmp_path / "b", "run", "LOW", tamper=lambda s, v, d: v.update(status="refused", primary_error={"code": "E", "message": "m"}) if s == "report" else None)
    a, b = S.files(spark, str(tmp_path / "a")), S.files(spark, str(tmp_path / "b"))
    pairs = lambda f: f.select("bundle").distinct().selectExpr("bundle", "bundle AS pair_id")
    out = RD.run_diff(a, b, pairs(a), pairs(b))
    assert out["refusals"].first()["code"] == "E" and out["events"].isEmpty() and out["impact"].isEmpty()


def test_change_chain(spark):
    one = {"change_id": "chg:1", "parent_change_id": None, "parent_hash": "", "x": 1}
    one["content_hash"] = "sha256:" + canon.sha256(canon.plain(one))
    two = {"change_id": "chg:2", "parent_change_id": "chg:1", "parent_hash": one["content_hash"], "x": 2}
    two["content_hash"] = canon.sha256(canon.plain(two))
    bad = {"change_id": "chg:3", "parent_change_id": "chg:9", "parent_hash": "", "content_hash": "0"}
    rows = spark.createDataFrame([("w", json.dumps(c)) for c in (one, two, bad)], "ws_id string, text string")
    got = {r["change_id"]: (r["content_hash_ok"], r["parent_exists"], r["parent_hash_ok"]) for r in change_chain(rows).collect()}
    assert got == {"chg:1": (True, False, None), "chg:2": (True, True, True), "chg:3": (False, False, None)}


def test_rendering():
    col, lit = (lambda n: {"type": "col", "name": n}), (lambda v: {"type": "lit", "value": v})
    op = lambda o, a, b: {"type": "binop", "op": o, "left": a, "right": b}
    assert render.expression(op("*", op("+", col("a"), lit(1)), lit("x"))) == '(a + 1) * "x"'
    assert render.expression(op("-", col("a"), op("-", col("b"), lit(2.5)))) == "a - (b - 2.5)"
    assert render.expression({"type": "odd"}) == "<expr:odd>"
    assert render.expression(None) == "<expr:null>" and render.expression({}) == "<expr>"
    assert render.expression({"kind": "func", "fn": "up", "args": [{"type": "ident", "id": "a"}, 2.0]}) == "up(a, 2.0)"
    assert render.expression({"type": "if", "args": [op("==", col("a"), lit(None)), lit(True), None]}) == "if(a == null, true, <expr:null>)"
    assert render.expression({"type": "binary", "operator": "or", "left": col("a"), "right": op("or", col("b"), col("c"))}) == "a or (b or c)"
    assert render.expression({"type": "map_lookup", "name": "m", "key": lit("k")}) == 'm["k"]'
    assert render.expression({"type": "index", "base": op("+", col("a"), col("b")), "index": col("i")}) == "(a + b)[i]"
    assert render.expression({"type": "callable", "op": "f", "args": [col("x")]}) == "f(x)"
    two = {"assignments": [{"target": "z", "expr": lit(1)}, {"col": "a", "expr": col("q")}], "mode": "update"}
    assert render.step("compute", two) == "compute a = q, z = 1 (update!)"
    assert render.step("compute", {}) == "(incomplete spec: assignments)" and render.step("aggregate", {"var": ["v"]}) == "(incomplete spec: class, stats)"
    assert render.step("aggregate", {"class": ["g"], "var": ["v"], "stats": ["mean"]}) == "aggregate class(g) var(v) stats(mean)"
    assert render.step("sort", {"by": [{"col": "a", "desc": True}, "b"], "nodupkey": True}) == "sort by a desc, b nodupkey(true)"
    assert render.step("rename", {"mappings": [{"from": "a", "to": "b"}]}) == "rename(a -> b)" and render.step("save", {}) == "(unrenderable op: save)"
    assert render.step("select", {"drop": ["a"]}) == "select drop(a)" and render.step("drop", {"columns": ["a", "b"]}) == "drop(a, b)"
    assert render.target("x", True, "compute", json.dumps({"op": "compute", "params": two}), "b") == "(no assignment for target=b)"
    assert render.target("x", False, None, None, "b") == "(transform not found: x)"
    assert [render.formatted(v) for v in (None, True, 3, 1.50, 2.0)] == ["null", "true", "3", "1.5", "2"]


def test_own_registry_and_locks(spark, tmp_path):
    """A bundle's registry file decides what implementations are; locks of either shape tell contract from provenance."""

    def edit(digest, lock, skip=()):
        def run(stage, value, d):
            if stage == "files":
                used = json.loads((d / "artifacts/plan.ir.json").read_text())["steps"]
                named = [*(s["transform_id"] for s in used), "zz", "pass_through"]
                entries = [{"id": f"t:{t}", "version": "1", "kind": "k", "impl_fingerprint": {"algo": "sha256", "source": "s", "ref": t, "digest": digest}} for t in named if t not in skip]
                (d / "transform_registry.json").write_text(json.dumps({"registry_version": "1", "transforms": entries}))
                (d / "schema.lock.json").write_text(json.dumps(lock))

        return run

    listed = lambda by, kind: {"created_by": by, "datasources": [{"name": "lb", "kind": "csv", "columns": [{"name": "id", "type": kind}], "rules": {"b": 1, "a": 2}}]}
    mapped = {"created_by": "z", "datasources": {"lb": {"rules": {"a": 2, "b": 1}, "columns": {"id": "int"}, "kind": "csv"}}}
    locks = {"impl": (listed("x", "int"), listed("y", "int")), "lack": (listed("x", "int"), listed("x", "text")), "shape": (listed("x", "int"), mapped)}
    for name, (one, two) in locks.items():
        bundle(tmp_path / "bundles+" / "bundles", name, tamper=edit("a" * 64, one))
        bundle(tmp_path / "b", name, tamper=edit("b" * 64 if name == "impl" else "a" * 64, two, ("zz",) if name == "lack" else ()))
    a, b = S.files(spark, str(tmp_path / "bundles+" / "bundles")), S.files(spark, str(tmp_path / "b"))
    pairs = lambda f: f.select("bundle").distinct().selectExpr("bundle", "bundle AS pair_id")
    out = RD.run_diff(a, b, pairs(a), pairs(b))
    events = {(r["pair_id"], r["change_type"]) for r in out["events"].collect()}
    assert events == {("impl", "TRANSFORM_IMPL_CHANGED"), ("lack", "TRANSFORM_REMOVED")}
    assert {(r["pair_id"], r["version"], r["element_id"]) for r in out["missing_transforms"].collect()} == {("lack", 2, "v:out.copy")}
    changed = {r["pair_id"]: (r["contract_changed"], r["provenance_changed"]) for r in out["schema_lock_hashes"].collect()}
    assert changed == {"impl": (False, True), "lack": (True, True), "shape": (False, True)}


def test_evidence_by_side(spark):
    from rippletrace.operators.evidence import STATS, value_evidence

    stat = "named_struct('unique_count', 1L, 'null_count', 0L, 'row_count', 1L, 'min', '{0}', 'max', '{0}', 'constant_value', null, 'top_values', array('{0}'), 'top_counts', array(1L))"
    rows = lambda v, t: spark.sql(f"SELECT 'p' AS pair_id, '{t}' AS `table`, 'c' AS `column`, CAST({stat.format(v)} AS {STATS}) AS stats")
    ddl = "pair_id string, var_id string, old_table string, old_column string, `table` string, `column` string"
    changed = [("p", "moved", "t1", "c", "t2", "c"), ("p", "gone", "t9", "c", "t2", "c"), ("p", "part", "t1", "x", "t2", "c"), ("q", "none", "t1", "c", "t2", "c"), ("r", "bare", "t1", "c", "t2", "c"), ("p", "lost", None, None, "t2", "c")]
    told = lambda t: spark.createDataFrame([("p", [t]), ("r", None)], "pair_id string, tables array<string>")
    out = value_evidence(spark.createDataFrame(changed, ddl), rows("A", "t1"), rows("B", "t2"), None, told("t1"), told("t2"))
    got = {r["var_id"]: (r["summary"], r["failure_reason"], r["attempted"], r["old"] and r["old"]["min"]) for r in out.collect()}
    both = ["tables", "outputs"]
    assert got == {
        "moved": ('"A" -> "B"', None, None, "A"),
        "gone": (None, "table_not_found", both, None),
        "part": (None, "column_not_found", both, None),
        "none": (None, "runtime_evidence_missing", [], None),
        "bare": (None, "tables_section_missing", both, None),
        "lost": (None, "table_not_found", both, None),
    }
