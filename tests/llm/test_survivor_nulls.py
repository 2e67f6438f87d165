from __future__ import annotations

from graphloom.llm import survivors as sv
NODE = "id string, scope string, kind string, content_hash string, attrs string, updated_at long, deleted_at long, hlc long, site_id string, field string, value string, n string"


def test_fusion_keeps_null_scopes_and_kinds(spark):
    data = []
    for scope, kind in ((None, "note"), ("s", None), (None, None), ("s", "note"), ("", "note")):
        data += [(f"{scope}{kind}{i}", scope, kind, "h", '{"k": "v"}', 1, None, 1, f"site{i}", "clash", "clash", "clash") for i in range(2)]
    got = {tuple(r)[:5] for r in sv.fused(spark.createDataFrame(data, NODE), rounds=2).collect()}
    assert got == {(s, k, "h", "k", '"v"') for s, k in ((None, "note"), ("s", None), (None, None), ("s", "note"), ("", "note"))}
