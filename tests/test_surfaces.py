from __future__ import annotations

import numpy as np
import pytest

from graphloom.operators import caching, embedding, fusion
from graphloom.tools import CodeIndex, Store


def test_pieces():
    w = embedding.WordPieces(["[UNK]", "[CLS]", "[SEP]", "un", "##able", "##a", "é", "cafe", "!"])
    assert w.encode("Unable café! zz") == [1, 3, 4, 7, 8, 0, 2]
    assert w.word("x" * 101) == [0] and w.encode("", 8) == [1, 2]
    with pytest.raises(ValueError, match="lacks"):
        embedding.WordPieces(["a"])
    u = embedding.UnigramPieces({"<unk>": 0.0, "▁": -4.0, "▁he": -2.0, "llo": -2.0, "l": -3.0, "▁hello": -3.0})
    assert u.encode("hello") == [5] and u.encode("hel?") == [2, 4, 0]


def test_pooling_and_checks(spark):
    h, m = np.array([[[3.0, 4.0], [9.0, 9.0]], [[0.0, 0.0], [0.0, 0.0]]]), np.array([[1, 0], [1, 1]])
    assert embedding.pooled(h, m).tolist() == [[0.6, 0.8], [0.0, 0.0]] == embedding.pooled(h, m, "cls").tolist()
    e = embedding.Embedding("m", 2)
    e.check(e.fingerprint())
    with pytest.raises(ValueError, match="another model"):
        e.check("x")
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    model = lambda ids, mask: np.stack([ids, np.ones_like(ids)], 2).astype(float)
    got = {r["id"]: r["vector"] for r in embedding.embedded(df, "id", "t", lambda t: [len(t)], model, e).collect()}
    assert got[1] == pytest.approx([11 / np.hypot(11, 1), 1 / np.hypot(11, 1)]) and len(got[2]) == 2


def test_caches(spark):
    now = [0.0]
    c = caching.ResultCache(lambda: now[0], ttl=60, size=2)
    key = caching.result_key(" Two  WORDS ", ["b", "a"], {"u": "x"}, {})
    assert key == caching.result_key("two words", ["a", "b"], {"u": "x"}, {})
    assert c.get(key, 1, lambda: ([1], False)) == [1] == c.get(key, 1, lambda: ([2], False))
    assert c.get(key, 2, lambda: ([3], True)) == [3] and c.get(key, 2, lambda: ([4], False)) == [4]
    now[0] = 61
    assert c.get(key, 2, lambda: ([5], False)) == [5] and (c.hits, c.misses) == (1, 4)
    r = caching.RowCache(most=1)
    r.rows = {"a": 1, "b": 2}
    r.refresh(spark.createDataFrame([(5, "a")], "seq long, entity_id string"))
    assert r.rows == {"b": 2} and r.seq == 5
    r.refresh(spark.createDataFrame([(6, "x"), (7, "y")], "seq long, entity_id string"))
    assert r.rows == {}
    s = caching.with_settings(fusion.Settings(), {"k": "30", "tau": "x", "seeds": "4", "amplitude": "-1", "odd": "1"})
    assert (s.k, s.tau, s.seeds, s.amplitude) == (30.0, 90.0, 4, 0.25)


def test_tools(spark, small):
    store = Store(spark, small)
    assert store.ready(limit=5).count() <= 5 and store.prime().count() > 0
    assert store.recall("").count() == 0
    links = spark.createDataFrame([("a", "parent", "b"), ("c", "relates", "d")], "src string, type string, dst string")
    assert store.link(links, "s").count() == 2
    files = spark.createDataFrame([("src/a.ts", "export function runIt() {\n  return 1;\n}\n"), ("src/b.ts", "import { runIt } from './a';\nfunction other() {\n  runIt();\n}\n"), ("c.bin", None)], "path string, text string")
    i = CodeIndex(files)
    assert [r["path"] for r in i.symbol("runIt").collect()] == ["src/a.ts"]
    assert {(r["path"], r["line"], r["kind"]) for r in i.callers("runIt").collect()} == {("src/b.ts", 1, "import"), ("src/b.ts", 3, "call")}
    assert {(r["line"], r["asof_name"]) for r in i.grep("runIt").where("path = 'src/b.ts'").collect()} == {(1, None), (3, "other")}
    assert [r["path"] for r in i.map().collect()] == ["src/a.ts"] and [r["id"] for r in i.search("runIt").collect()] != []
