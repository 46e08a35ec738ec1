import json

from marginalia.operators import nested


def call(i, result=None, follow=None, **more):
    c = {"id": f"c{i}", "function": {"name": "q", "arguments": json.dumps({"a": i})}}
    if result is not None:
        c["result"] = result
    if follow is not None:
        c["followUps"] = follow
    return c | more


def ex(t):
    return {"text": t, "sourceMap": {"path": "p", "startLine": 1, "endLine": 2, "completeSpan": True}}


def found(spark, bodies):
    rows = [(i, b if b is None or isinstance(b, str) else json.dumps(b), k) for k, (i, b) in enumerate(bodies)]
    df = spark.createDataFrame(rows, "record_id long, body string, received_at long")
    n = nested.flatten(df).where("kind <> 'turn'").select("record_id", "turn", "kind", "parent_no", "item_no")
    return sorted(map(tuple, n.collect()))


def test_reading_order_and_parents(spark):
    body = {"turns": [{"turn": 3, "question": "q", "toolCalls": [call(1, {"excerpts": [ex("a"), ex("b")]}, [call(2, {"pages": [{"page": 1, "excerpts": [ex("c")]}, {"page": 2, "excerpts": ex("d")}]}, [call(3)])]), call(4)], "originalsRequested": ["x", {"artifactId": "y"}]}]}
    assert found(spark, [(7, body)]) == sorted([
        (7, 3, "tool_call", 0, 1), (7, 3, "excerpt", 1, 1), (7, 3, "excerpt", 1, 2), (7, 3, "tool_call", 1, 2), (7, 3, "excerpt", 2, 1), (7, 3, "excerpt", 2, 2),
        (7, 3, "tool_call", 2, 3), (7, 3, "tool_call", 0, 4), (7, 3, "original", 0, 1), (7, 3, "original", 0, 2)])


def test_shapes_of_writers(spark):
    one = {"question": "q", "toolCalls": call(1), "originalsRequested": {"artifactId": "a"}}
    text = {"question": "q", "toolCalls": json.dumps([call(1), call(2)]), "originalsRequested": 3}
    bodies = [(1, {"turns": {"2": one}}), (2, {"run": {"result": {"turns": [text]}}}), (3, {"turns": [{"question": "q", "toolCalls": None}, {"question": "q", "toolCalls": 4}]}), (4, json.dumps({"turns": [one]})[:-4]), (5, None), (6, ""), (8, "[1, 2]"), (9, '{"turns": NaN}')]
    assert found(spark, bodies) == sorted([(1, 2, "tool_call", 0, 1), (1, 2, "original", 0, 1), (2, 1, "tool_call", 0, 1), (2, 1, "tool_call", 0, 2)])


def test_deliveries_count_once(spark):
    b = {"turns": [{"turn": 1, "question": "q", "toolCalls": [call(1)]}]}
    again = {"turns": [dict(reversed(list(b["turns"][0].items())))]}
    assert found(spark, [(1, json.dumps(b)[:-3]), (1, b), (1, again), (1, b)]) == [(1, 1, "tool_call", 0, 1)]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "record_id long, body string, received_at long, kind string")
    assert nested.flatten(df).count() == 0
    deep = '{"turns": [{"question": "q", "toolCalls": ' + "[" * 5000 + "]" * 5000 + "}]}"
    assert found(spark, [(1, deep)]) == []


def test_subtype_tables_keep_links(spark):
    b = {"turns": [{"turn": 1, "question": "q", "toolCalls": [call(1, {"excerpts": [ex("a")]})], "originalsRequested": [{"artifactId": "y", "width": 5}]}]}
    n = nested.flatten(spark.createDataFrame([(1, json.dumps(b))], "record_id long, body string"))
    c, e, o = nested.calls_table(n).first(), nested.excerpts_table(n).first(), nested.originals_table(n).first()
    assert (c["call_no"], c["shape"], json.loads(c["arguments"])) == (1, "call:excerpt_result", {"a": 1})
    assert (e["call_no"], e["text"], e["start_line"], e["complete_span"]) == (1, "a", 1, True) and (o["artifact_id"], o["width"]) == ("y", 5)


def test_sessions_in_wide_listed_and_quoted_envelopes(spark):
    s = {"turns": [{"turn": 1, "question": "q", "toolCalls": [call(1)]}]}
    quoted = json.dumps(s)
    for _ in range(7):
        quoted = json.dumps(quoted)
    bodies = [(1, {f"k{i}": "v" for i in range(500)} | {"run": s}), (2, [[], {"run": [s]}]), (3, quoted), (4, {"meta": [{"turns": 3}], "run": {"result": s}}), (5, {"run": {"log": quoted}}), (6, {"turns": 3})]
    assert found(spark, bodies) == [(i, 1, "tool_call", 0, 1) for i in (1, 2, 3, 4, 5)]


def test_turn_fields_and_variants_are_kept(spark):
    t = {"turn": 1, "question": "q", "gold": ["g"], "summary": "s", "autoOriginal": True, "thresholdExceeded": False, "compactedAfter": 3, "note": 5}
    calls = [call(1, {"images": [{"width": 9, "height": 8, "region": {"x": 0}}, {"width": 7, "height": 6}]}), call(2, {"pages": [{"moreMatches": {"count": 3, "lines": [5, 2]}}]}), call(3, error={"code": "denied", "details": [{"message": "m"}]}), call(4, [ex("a")] * 80 + [{"pages": []}])]
    df = spark.createDataFrame([(1, json.dumps({"turns": [t | {"toolCalls": calls}]}))], "record_id long, body string")
    n = nested.flatten(df, every=True)
    assert nested.turns_table(n).first()[4:] == (None, '["g"]', "s", "true", "false", "3", '{"note": 5}')
    assert [r[2:] for r in nested.images_table(n).orderBy("image_no").collect()] == [(1, 1, "object", None, 9, 8, '{"x": 0}', None), (1, 2, "object", None, 7, 6, None, None)]
    assert nested.more_matches_table(n).first()[2:] == (2, 1, 3, "[5, 2]", None) and nested.errors_table(n).first()[2:] == (3, 1, "object", "denied", '[{"message": "m"}]', None)
    assert [r["shape"] for r in nested.calls_table(n).where("call_no = 4").collect()] == ["call:list<mixed>"] and nested.flatten(df).where("kind in ('image', 'error', 'more_matches')").count() == 0


def test_states_come_from_children():
    assert nested.shape({"turns": 5}) == "object" and nested.shape({"turns": []}) == "session"
    assert nested.shape([1] * 64 + ["a"]) == "list<mixed>" and nested.shape([ex("a"), None]) == "list<excerpt>"
    assert nested.shape({"x": {"y": {"turns": [{"question": "q"}]}}}) == "envelope"


def test_a_writer_with_other_keys_is_routed_by_structure(spark):
    piece = {"words": "a", "where": {"path": "p", "startLine": 1}}
    inner = {"tool": "open", "gave": {"found": [piece, piece]}}
    outer = {"tool": "look", "gave": {"sheets": [{"found": [piece]}, {"found": [piece]}]}, "then": [inner]}
    body = {"log": {"steps": [{"turn": 4, "ask": "q", "used": [outer], "wanted": [{"artifactId": "x", "width": 3}]}, {"turn": 5, "used": inner}]}}
    assert found(spark, [(1, body)]) == sorted([
        (1, 4, "tool_call", 0, 1), (1, 4, "excerpt", 1, 1), (1, 4, "excerpt", 1, 2), (1, 4, "tool_call", 1, 2), (1, 4, "excerpt", 2, 1), (1, 4, "excerpt", 2, 2),
        (1, 4, "original", 0, 1), (1, 5, "tool_call", 0, 1), (1, 5, "excerpt", 1, 1), (1, 5, "excerpt", 1, 2)])
