"""Run bundles and JSON artifacts projected from the star-schema tables, as SQL that Spark and DuckDB share.

Every supplier has a bundle on each side: a plan of two steps, its registry, graphs,
evidence, schemas, a lock and a report. Some of side 1 are damaged, some runs of side 2
refused; literals, types and locks change by modulo. Every nation has a specification.
"""

from __future__ import annotations

_NAME = {1: "s_name", 2: "CASE WHEN s_suppkey % 3 = 0 THEN concat(s_name, ' v2') ELSE s_name END"}
_KIND = {1: "'string'", 2: "CASE WHEN k % 4 = 0 THEN 'text' ELSE 'string' END"}
_LOCK = {1: "'int'", 2: "CASE WHEN k % 5 = 0 THEN 'text' ELSE 'int' END"}


def bundle_views(side: int) -> dict[str, str]:
    """The views of one side by name, in order of dependence."""
    first = "true" if side == 1 else "false"
    named = {
        f"b{side}_spec": f"""
            SELECT s_suppkey AS k, label, '{{"op":"identity","params":{{}}}}' AS spec_a,
                   concat('{{"op":"compute","params":{{"assignments":[{{"expr":{{"type":"lit","value":"', label, '"}},"target":"label"}}]}}}}') AS spec_b
            FROM (SELECT s_suppkey, {_NAME[side]} AS label FROM supplier) x""",
        f"b{side}_id": f"SELECT k, label, spec_a, spec_b, sha256(spec_a) AS ta, sha256(spec_b) AS tb FROM b{side}_spec",
        f"b{side}_wire": f"""
            SELECT *, concat('{{"inputs":["a_raw"],"outputs":["mid"],"transform_id":"', ta, '"}}') AS wire_a,
                   concat('{{"inputs":["mid"],"outputs":["out"],"transform_id":"', tb, '"}}') AS wire_b FROM b{side}_id""",
        f"b{side}_step": f"""
            SELECT *, CASE WHEN {first} AND k % 7 = 4 THEN repeat('0', 64) ELSE sha256(wire_a) END AS sa, sha256(wire_b) AS sb FROM b{side}_wire""",
        f"b{side}_text": f"""
            SELECT *,
              concat('{{"steps":[{{"inputs":["a_raw"],"kind":"op","op":"identity","outputs":["mid"],"params":{{}},"step_id":"', sa, '","transform_class_id":"ca","transform_id":"', ta,
                '"}},{{"inputs":["mid"],"kind":"op","op":"compute","outputs":["out"],"params":{{}},"step_id":"', sb, '","transform_class_id":"cb","transform_id":"', tb,
                '"}}],"table_facts":{{"mid":{{"sorted_by":["id"]}}}},"tables":["a_raw","mid","out"]}}') AS plan,
              concat('{{"index":{{"0":"', ta, CASE WHEN {first} AND k % 7 = 3 THEN '"}}' ELSE concat('","1":"', tb, '"}}') END, ',"registry_version":"1","transforms":[{{"kind":"identity","spec":',
                spec_a, ',"transform_id":"', ta, '","version":"0.2"}},{{"kind":"compute","spec":', spec_b, ',"transform_id":"', tb, '"}}]}}') AS registry,
              concat('{{"edges":[{{"dst":"s:', sa, '","kind":"consumes","src":"t:a_raw"}},{{"dst":"t:mid","kind":"produces","src":"s:', sa, '"}},{{"dst":"s:', sb, '","kind":"consumes","src":"t:mid"}},{{"dst":"t:out","kind":"produces","src":"s:', sb,
                '"}}],"nodes":[{{"id":"s:', sa, '","inputs":["t:a_raw"],"kind":"step","op":"identity","outputs":["t:mid"],"payload_sha256":"', ta, '","transform_class_id":"ca","transform_id":"', ta,
                '"}},{{"id":"s:', sb, '","inputs":["t:mid"],"kind":"step","op":"compute","outputs":["t:out"],"payload_sha256":"', tb, '","transform_class_id":"cb","transform_id":"', tb,
                '"}},{{"consumers":["s:', sa, '"],"id":"t:a_raw","kind":"table"}},{{"consumers":["s:', sb, '"],"id":"t:mid","kind":"table","producer":"s:', sa, '"}},{{"consumers":[],"id":"t:out","kind":"table","producer":"s:', sb,
                '"}}],"schema_version":1}}') AS graph,
              concat('{{"edges":[{{"dst":"v:out.label","src":"v:a_raw.id"}}],"nodes":[{{"id":"v:a_raw.id","origin":"source","payload_sha256":"p0"}},{{"expr_sha256":"e","id":"v:out.label","origin":"derived","payload_sha256":"p","producing_step_id":"', sb,
                '","transform_id":"', tb, '"}}]}}') AS vars,
              concat('{{"created_at":"c{side}","run_id":"r', CAST(k AS STRING), '","step_evidence":[{{"row_counts":{{"mid":', CAST(k % 9 AS STRING), '}}}},{{"columns":{{"out":["id","label"]}},"row_counts":{{"mid":', CAST(k % 5 AS STRING),
                ',"out":3}}}}],"tables":{{"out":{{"columns":{{"label":{{"null_count":0,"row_count":3,"top_values":[{{"count":3,"value":"', label, '"}}],"unique_count":1}}}}}}}}}}') AS evidence,
              concat('{{"tables":{{"out":{{"id":"int","label":"', {_KIND[side]}, '"', CASE WHEN {first} THEN '' ELSE ',"more":"int"' END, '}}}}}}') AS shape,
              concat('{{"created_by":"side{side}","datasources":[{{"columns":[{{"name":"id","type":"', {_LOCK[side]}, '"}}],"kind":"csv","name":"lb"}}]}}') AS locked,
              concat('label', chr(10), label, chr(10)) AS made
            FROM b{side}_step""",
        f"b{side}_hash": f"""
            SELECT *, sha256(plan) AS h_plan, sha256(registry) AS h_registry, sha256(graph) AS h_graph, sha256(evidence) AS h_evidence, sha256(shape) AS h_shape, sha256(made) AS h_made FROM b{side}_text""",
        f"b{side}_report": f"""
            SELECT *, concat('{{"artifacts":[{{"name":"plan.ir.json","path":"artifacts/plan.ir.json","sha256":"', h_plan, '"}},{{"name":"registry.candidate.json","path":"artifacts/registry.candidate.json","sha256":"', h_registry,
                '"}},{{"name":"graph.json","path":"artifacts/graph.json","sha256":"', h_graph, '"}},{{"name":"runtime.evidence.json","path":"artifacts/runtime.evidence.json","sha256":"', h_evidence,
                '"}},{{"name":"schema.evidence.json","path":"artifacts/schema.evidence.json","sha256":"', h_shape, '"}}],"created_at":"t{side}","inputs":[],"outputs":[{{"name":"out","path":"outputs/out.csv","sha256":"', CASE WHEN {first} AND k % 7 = 1 THEN repeat('f', 64) ELSE h_made END, '"}}],',
                CASE WHEN NOT {first} AND k % 11 = 0 THEN concat('"primary_error":{{"code":"E', CAST(k % 2 AS STRING), '","message":"refused"}},') ELSE '' END,
                '"report_schema_version":"0.3","run_id":"x","status":"', CASE WHEN NOT {first} AND k % 11 = 0 THEN 'refused' ELSE 'ok' END, '"}}') AS report
            FROM b{side}_hash""",
    }
    files = {
        "artifacts/plan.ir.json": "plan", "artifacts/registry.candidate.json": "registry", "artifacts/graph.json": "graph", "artifacts/vars.graph.json": "vars",
        "artifacts/runtime.evidence.json": "evidence", "artifacts/schema.evidence.json": "shape", "schema.lock.json": "locked", "outputs/out.csv": "made", "report.json": "report",
    }
    each = " UNION ALL ".join(
        f"SELECT concat('b', CAST(k AS STRING)) AS bundle, '{path}' AS path, {column} AS content FROM b{side}_report" + (f" WHERE NOT ({first} AND k % 7 = 2)" if column == "made" else "")
        for path, column in files.items()
    )
    return named | {f"b{side}_files": each}


#: Specifications of nations as JSON: customers are derived from the region and the nation's suppliers.
SPEC_VIEWS = {
    "spec_rows": """
        SELECT c_nationkey AS n, concat('d:C', CAST(c_custkey AS STRING)) AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'int' ELSE 'string' END AS type,
               concat('t:', lower(c_mktsegment)) AS transform_ref, concat('s:R', CAST(n_regionkey AS STRING)) AS i1, concat('s:K', CAST(c_custkey % 13 AS STRING)) AS i2
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "spec_items": """
        SELECT n, id, concat('{"id":"', id, '","name":"', name, '","type":"', type, '","transform_ref":"', transform_ref, '","inputs":["', i1, '","', i2, '"]}') AS item FROM spec_rows""",
}
