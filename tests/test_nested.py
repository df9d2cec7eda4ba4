"""Problem 3 against a plain recursive walk."""

import json

from cascadelens.operators import nested


def walk(doc):
    try:
        doc = json.loads(doc)
    except (TypeError, ValueError):
        return []
    conf = doc.get("configurations") if isinstance(doc, dict) else None
    if isinstance(conf, str):
        try:
            conf = json.loads(conf)
        except ValueError:
            return []
    out = []
    listed = lambda x: x if isinstance(x, list) else [x] if isinstance(x, dict) else []

    def visit(node, path):
        if not isinstance(node, dict):
            return
        out.extend((path, i) for i in range(len(listed(node.get("cpe_match")))))
        for i, child in enumerate(listed(node.get("children"))):
            visit(child, f"{path}.{i}")

    if isinstance(conf, dict):
        for i, node in enumerate(listed(conf.get("nodes"))):
            visit(node, str(i))
    return out


DEEP = {"cpe_match": [{"cpe23Uri": "deep"}]}
for _ in range(60):
    DEEP = {"children": [DEEP]}
MATCH = {"vulnerable": False, "cpe23Uri": "cpe:2.3:a:x:y:1:*:*:*:*:*:*:*"}
DOCS = [
    {"configurations": {"nodes": [{"operator": "OR", "cpe_match": [MATCH, MATCH]}, {"children": [{"cpe_match": [MATCH]}, None, {"cpe_match": MATCH}]}]}},
    {"configurations": json.dumps({"nodes": {"cpe_match": [MATCH, None, "text"], "children": {"cpe_match": [MATCH]}}})},
    {"configurations": {"nodes": [DEEP]}},
    {"configurations": {"nodes": [{"cpe_match": None, "children": None}]}},
    {"configurations": None},
    {"configurations": "not json"},
    {"other": {"nodes": [{"cpe_match": [MATCH]}]}},
    [1, 2],
]


def test_matches_like_a_walk(spark):
    docs = [json.dumps(d) for d in DOCS] + [None, "", "{", '{"configurations": {"nodes": [{"cpe_match": [NaN]}]}}', json.dumps(DOCS[0])]
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "raw_id bigint, doc string, element string")
    got = sorted(tuple(r) for r in nested.configuration_matches(df, "raw_id", "doc", with_values=False).collect())
    want = sorted((i, p, k) for i, d in enumerate(docs) for p, k in walk(d) if "NaN" not in (d or ""))
    assert got == want
    full = nested.configuration_matches(df, "raw_id", "doc").where("raw_id = 0 and node_path = '0'").collect()
    assert [r["cpe23uri"] for r in full] == [MATCH["cpe23Uri"]] * 2 and not full[0]["vulnerable"]


def test_nodes_link_to_their_parents(spark):
    df = spark.createDataFrame([(0, json.dumps(DOCS[0]))], "raw_id bigint, doc string")
    got = {r["node_path"]: (r["parent_path"], r["depth"], r["operator"]) for r in nested.configuration_nodes(df, "raw_id", "doc").collect()}
    assert got == {"0": (None, 0, "OR"), "1": (None, 0, None), "1.0": ("1", 1, None), "1.1": ("1", 1, None), "1.2": ("1", 1, None)}


def test_tables_of_the_schema_graph():
    edges = [("r", "a", "many"), ("a", "b", "object"), ("b", "c", "object"), ("c", "b", "object"), ("a", "d", "object"), ("r", "d", "object"), ("d", "e", "value"), ("r", "f", "object")]
    assert nested.table_elements(edges, "r") == {"a": "repeated", "b": "recursive", "c": "recursive", "d": "shared"}


def test_empty(spark):
    df = spark.createDataFrame([], "raw_id bigint, doc string")
    assert nested.configuration_matches(df, "raw_id", "doc").count() == 0
    assert nested.configuration_nodes(df, "raw_id", "doc").count() == 0
