import json
import random

import numpy as np
import pytest

from tessella.llm import ann
from tessella.llm.chat import canonical, fits, link_tool_calls, parsed

TURNS = "conv_id long, turn long, role string, text string, row string, call string, valid int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TURNS)


def call(i, name, **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_links_order_and_validation(spark):
    schema = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}, "additionalProperties": False}
    rows = [
        (1, 0, "system", json.dumps({"tools": [{"name": "find", "parameters": schema}]})),
        (1, 1, "user", "find ü"),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "early"})),
        (1, 3, "assistant", json.dumps({"content": None, "tool_calls": [call("a", "find", q="ü", n=2), call("b", "find", n=0), call("c", "other", z=1)]})),
        (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": [2]}})),
        (1, 5, "tool", json.dumps({"tool_call_id": "nobody", "content": ""})),
        (1, 6, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": "another conversation"})),
        (2, 1, "assistant", '{"tool_calls": [{"id": "s", "name": "find", "arguments": "{\\"q\\": 1}"}]}'),
        (None, 0, "assistant", json.dumps({"tool_calls": [call("a", "find", q="x")]})),
        (3, None, None, None), (3, 1, "user", "{broken"), (3, 1, "user", "{broken"), (3, 2, "user", ""),
    ]
    got = sorted(link_tool_calls(turns(spark, rows)).collect(), key=lambda r: (r.conv_id or 0, r.order_turn or 0, r.order_step, r.turn or 0))
    assert len(got) == len(rows)
    one = [r for r in got if r.conv_id == 1]
    assert [r.turn for r in one] == [0, 1, 3, 2, 4, 5, 6]  # the early result comes after its call
    assert [(r.n_calls, r.n_linked, r.n_invalid) for r in one if r.turn == 3] == [(3, 2, 1)]
    assert {r.turn: r.answers_call for r in one} == {0: None, 1: None, 2: True, 3: None, 4: True, 5: False, 6: False}
    assert one[4].message == '{"content":{"a":[2],"z":1},"role":"tool","tool_call_id":"a"}'
    two = [r for r in got if r.conv_id == 2]
    assert [r.answers_call for r in two] == [False, None] and two[1].n_invalid == 0 and two[1].n_linked == 0
    assert [r.n_linked for r in got if r.conv_id is None] == [0]
    assert [r.message for r in got if r.conv_id == 3] == ['{"content":null,"role":null}', '{"content":"{broken","role":"user"}', '{"content":"{broken","role":"user"}', '{"content":"","role":"user"}']
    assert link_tool_calls(turns(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("value", "schema", "good"),
    [
        (1, {"type": "integer"}, True), (1.0, {"type": "integer"}, True), (1.5, {"type": "integer"}, False), (True, {"type": "integer"}, False), (True, {"type": "boolean"}, True),
        (None, {"type": ["string", "null"]}, True), ("a", {"enum": ["a", 1]}, True), ("b", {"enum": ["a", 1]}, False), ([1, "x"], {"items": {"type": "number"}}, False),
        ({"a": {"b": 1}}, {"properties": {"a": {"required": ["b"]}}}, True), ({"x": 1}, {"additionalProperties": False}, False), (5, {"maximum": 4}, False), ("abc", {"maxLength": 2}, False), (1, True, True), (1, False, False),
    ],
)
def test_schemas(value, schema, good):
    assert fits(value, schema) is good


NESTED = {"$defs": {"place": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number", "exclusiveMaximum": 90}, "in": {"$ref": "#/$defs/place"}}}, "a/b": {"$anchor": "odd", "multipleOf": 0.1}}}


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({**NESTED, "$ref": "#/$defs/place"}, [{"lat": 1}, {"lat": 1, "in": {"lat": 2}}], [{}, {"lat": 90}, {"lat": 1, "in": {"lat": "x"}}]),
        ({**NESTED, "items": {"$ref": "#/$defs/a~1b"}}, [[0.3, 1]], [[0.35]]), ({**NESTED, "$ref": "#odd"}, [0.7, "x"], [0.75]),
        ({"anyOf": [{"type": "string"}, {"type": "null"}]}, ["a", None], [1]), ({"oneOf": [{"minimum": 2}, {"maximum": 3}]}, [1, 4], [2]), ({"allOf": [{"minimum": 2}, {"maximum": 3}]}, [2], [1, 4]), ({"not": {"type": "string"}}, [1], ["a"]),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, [{"a": 1, "b": 1}, {"c": 1}], [{"a": 1}, {}]),
        ({"pattern": "^[a-z$]+$"}, ["ab$", 1], ["ab\n", "A"]), ({"pattern": r"^(?<y>\d{4})$"}, ["2024"], ["२०२४"]), ({"exclusiveMinimum": 1}, [1.1], [1]), ({"minimum": 1, "exclusiveMinimum": True}, [2], [1]), ({"multipleOf": 3}, [9, 10**400 * 3], [10]),
        ({"minItems": 1, "maxItems": 2}, [[1]], [[], [1, 2, 3]]), ({"uniqueItems": True}, [[1, True, "1"]], [[1, 1.0], [{"a": 1}, {"a": 1.0}]]), ({"const": 1}, [1.0], [True]), ({"contains": {"type": "integer"}, "maxContains": 1}, [["a", 1]], [["a"], [1, 2]]),
        ({"prefixItems": [{"type": "string"}], "items": False}, [["a"], []], [[1], ["a", 1]]), ({"items": [{"type": "string"}], "additionalItems": False}, [["a"]], [["a", 1]]),
        ({"patternProperties": {"^x-": {"type": "string"}}, "additionalProperties": False}, [{"x-a": "b"}], [{"x-a": 1}, {"y": "b"}]), ({"propertyNames": {"maxLength": 1}}, [{"a": 1}], [{"ab": 1}]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 1}]),
        ({"dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]), ({"dependencies": {"a": {"required": ["b"]}}}, [{}], [{"a": 1}]),
        ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, [{"a": 1}], [{"b": 1}]), ({"prefixItems": [True], "unevaluatedItems": False}, [[1]], [[1, 2]]),
    ],
)
def test_combined_schemas(schema, good, bad):
    assert [fits(v, schema) for v in good] == [True] * len(good) and [fits(v, schema) for v in bad] == [False] * len(bad)


def test_references_that_lead_nowhere_are_not_valid(spark):
    loop, away = {"$ref": "#"}, {"properties": {"q": {"$ref": "https://ex.org/s.json"}}}
    nested = {**NESTED, "properties": {"q": {"anyOf": [{"$ref": "#/$defs/place"}, {"type": "null"}]}}}
    rows = []
    for k, (schema, value) in enumerate([(nested, {"lat": 1}), (nested, None), (nested, {"lat": 95}), (nested, "x"), (away, 1), (loop, 1), ({"properties": {"q": {"pattern": "("}}}, "x"), ({"properties": {"q": {"multipleOf": 0}}}, 1)]):
        rows += [(k, 0, "system", json.dumps({"tools": [{"name": "find", "parameters": schema}]})), (k, 1, "assistant", json.dumps({"tool_calls": [call("a", "find", q=value)]}))]
    got = {r.conv_id: r.n_invalid for r in link_tool_calls(turns(spark, rows)).where("turn = 1").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}


def test_canonical_round_trip():
    value = {"b": [1, {"z": None, "a": "ü\n"}], "a": 1.5}
    assert canonical(json.loads(canonical(value))) == canonical(value) == '{"a":1.5,"b":[1,{"a":"ü\\n","z":null}]}'
    assert parsed("assistant", '{"tool_calls": [{"id": 1}]}')[1] == [] and parsed("user", "{" * 100_000)[1] == []


def plain_links(rows):
    """link_tool_calls said plainly, for texts made by talk(): walk up from each result, stop at a circle."""
    def content(role, text):
        if not isinstance(text, str) or not text.startswith("{"):
            return {}
        v = json.loads(text)
        return v if role == "tool" and "tool_call_id" in v or role != "tool" else {}

    calls, results, tools = {}, {}, {}
    ordered = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][3] or ""))
    for i in ordered:
        conv, turn, role, text = rows[i]
        v = content(role, text)
        if role == "tool" and "tool_call_id" in v:
            results.setdefault((conv, v["tool_call_id"]), i)
        for c in v.get("tool_calls", ()):
            calls.setdefault((conv, c["id"]), i)
        for t in v.get("tools", ()):
            tools.setdefault((conv, t["name"]), t["parameters"])
    up = {r: calls[k] for k, r in results.items() if k in calls}
    out = []
    for i, (conv, turn, role, text) in enumerate(rows):
        way, at = [i], i
        while at in up and up[at] not in way:
            at = up[at]
            way.append(at)
        if at in up:
            way = [i]  # in or into a circle
        top = max(rows[j][1] for j in way)
        step = max(k for k, j in enumerate(way) if rows[j][1] == top)
        v = content(role, text)
        own = v.get("tool_calls", ())
        bad = sum(not fits(c["arguments"], tools.get((conv, c["name"]), {})) for c in own)
        linked = sum(up.get(results.get((conv, k))) == i for k in {c["id"] for c in own} if (conv, k) in results)
        out.append((conv, turn, top, step, len(own), linked, bad, (i in up) if role == "tool" and "tool_call_id" in v else None))
    return out


def talk(r, convs):
    """Random conversations: calls, answers that may come early or call tools themselves, unknown and repeated identifiers."""
    rows = []
    for conv in range(convs):
        for turn in range(r.randrange(1, 12)):
            some = lambda: [call(f"c{r.randrange(8)}", r.choice("fg"), n=r.randrange(3), conv=conv, turn=turn, x=r.random()) for _ in range(r.randrange(3))]  # noqa: E731, B023
            kind = r.random()
            if kind < 0.3:
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": some()})))
            elif kind < 0.6:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{r.randrange(8)}", "content": turn, "tool_calls": some() if r.random() < 0.6 else []})))
            elif kind < 0.7:
                rows.append((conv, turn, "system", json.dumps({"tools": [{"name": r.choice("fg"), "parameters": {"properties": {"n": {"maximum": r.randrange(2)}}}}]})))
            else:
                rows.append((conv, turn, "user", f"plain {turn}"))
    return rows


def test_links_equal_a_plain_walk(spark):
    rows = talk(random.Random(8), 150)
    got = [(r.conv_id, r.turn, r.order_turn, r.order_step, r.n_calls, r.n_linked, r.n_invalid, r.answers_call) for r in link_tool_calls(turns(spark, rows)).collect()]
    want = plain_links(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(w[3] for w in want) >= 2 and sum(w[7] or False for w in want) > 50 and sum(w[6] for w in want) > 20


def test_valid_json_that_is_hard_to_write(spark):
    """Half pairs, numbers beyond doubles, huge whole numbers, repeated keys, deep nesting and control characters."""
    long_number = "1" + "0" * 400
    rows = [
        (1, 0, "system", '{"tools": [{"name": "f", "parameters": {"properties": {"n": {"type": "integer", "minimum": 1}}}}]}'),
        (1, 1, "assistant", '{"tool_calls": [{"id": "\\ud800", "name": "f", "arguments": {"n": 1e999}}, {"id": "b", "name": "f", "arguments": {"n": %s}}, {"id": "c", "name": "f", "arguments": {"n": -1e999}}, {"id": "d", "name": "f", "arguments": {"n": 1e-999}}]}' % long_number),
        (1, 2, "tool", '{"tool_call_id": "\\ud800", "content": "half \\udc00", "content": [1e999, -2.5e-400, "\\u001b"]}'),
        (2, 0, "assistant", '{"tool_calls": [], "content": ' + "[" * 5_000 + "]" * 5_000 + "}"),
        (2, 1, "assistant", '{"tool_calls": [], "content": 1e99999999999999999999999}'),
        (2, 2, "user", "bell \x07 escape \x1b tab \t quote \" \x7f \u2028"), (2, 3, "user", '{"tool_calls": NaN}'), (2, 4, "user", "\u00a0{}"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_tool_calls(turns(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert (got[1, 1].n_calls, got[1, 1].n_linked, got[1, 1].n_invalid) == (4, 1, 2) and got[1, 2].answers_call
    assert "1e999" in got[1, 1].message.lower() and long_number in got[1, 1].message and "Infinity" not in got[1, 1].message and "\\ud800" in got[1, 1].message
    assert got[1, 2].message == '{"content":[1e999,-2.5e-400,"\\u001b"],"role":"tool","tool_call_id":"\\ud800"}'
    for k, text in ((2, rows[5][3]), (3, rows[6][3]), (4, rows[7][3])):
        assert got[2, k].message == json.dumps({"content": text, "role": "user"}, ensure_ascii=False, separators=(",", ":"))
    for r in got.values():
        assert json.loads(r.message)["role"] == r.role


def exact(rows, k=20, every=20):
    known = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in known:
        if q % every == 0:
            scored = sorted(((-float((v * w).sum()), i) for i, w in known if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def found_by(frame, k=20):
    out: dict = {}
    for g in ann.nearest_neighbours(frame, k).orderBy("query_id", "rank").collect():
        assert g["rank"] == len(out.setdefault(g.query_id, [])) + 1
        out[g.query_id].append((g.vec_id, g.score))
    return out


def recall(found, truth):
    return np.mean([len({i for i, _ in found.get(q, ())} & {i for i, _ in truth[q]}) / max(len(truth[q]), 1) for q in truth])


@pytest.mark.parametrize(("dim", "n", "k", "scale"), [(32, 3_000, 20, 1.0), (2, 400, 20, 1.0), (64, 600, 20, 1e20), (64, 600, 20, 1e-25), (8, 1_500, 100, 1.0), (16, 900, 200, 1.0), (1, 300, 5, 1e-38), (300, 500, 20, 1e30)])
def test_recall_and_exact_scores(spark, dim, n, k, scale):
    r = np.random.default_rng(3)
    x = (r.normal(size=(n, dim)) * scale).astype(np.float32)
    x[100:160] = x[100]  # equal vectors tie
    rows = [(int(i), v.tolist()) for i, v in enumerate(x) if v.any()]
    truth, found = exact(rows, k), found_by(vectors(spark, rows), k)
    assert found.keys() == truth.keys() and all(len(v) == k for v in found.values())
    assert recall(found, truth) >= 0.9
    for q, near in found.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        known = x[q].astype(np.float64)
        want = [(known * x[i].astype(np.float64)).sum() for i, _ in near]
        assert np.allclose([s for _, s in near], want, rtol=1e-12, atol=1e-12 * scale * scale)


def test_clusters_hot_copies_and_one_giant(spark, monkeypatch):
    """Few cells are probed where rows cluster; a third of equal rows is split over shards; giants meet every query."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 500)
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 24))
    x = (centres[r.integers(0, 40, 6_000)] + 0.15 * r.normal(size=(6_000, 24))).astype(np.float64)
    x[r.random(6_000) < 0.35] = x[7]
    x[[11, 2_011]] *= 1e12
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    truth, found = exact(rows), found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert recall(found, truth) >= 0.9
    giants = [q for q in truth if truth[q][0][0] in (11, 2_011)]
    assert giants and all(found[q][0] == truth[q][0] for q in giants)
    hot = 7 if 7 % 20 == 0 else next(q for q in truth if (x[q] == x[7]).all())
    assert [i for i, _ in found[hot]] == [i for i, _ in truth[hot]]
    index = ann.fit(x, 77, 20)
    assert index.probes <= 40


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [0.5, None]), (2, [0.5, 0.5]), (3, [0.5, -0.5]), (None, [1.0, 1.0]), (4, [2.0]), (2, [0.5, 0.5]), (5, []), (6, [0.25, 0.0, 9.0]), (100, [0.0, 1.0, 1.0])]
    got = found_by(vectors(spark, rows))
    assert got[0] == [(4, 2.0), (2, 0.5), (3, 0.5), (6, 0.25), (100, 0.0)] and got[100] == [(6, 9.0), (2, 0.5), (0, 0.0), (4, 0.0), (3, -0.5)] and got.keys() == {0, 100}
    assert ann.nearest_neighbours(vectors(spark, [])).count() == 0
    assert ann.nearest_neighbours(vectors(spark, rows[1:5])).count() == 0
    assert found_by(vectors(spark, rows[:1])) == {}
