from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from graphloom.llm import pii
from graphloom.llm.pii_model import N_TAGS, Model, decode, emissions, gradients, symbols
from graphloom.llm.pii_training import label


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(Model.load(pii.WEIGHTS))


def test_gradients():
    m = Model.fresh(5, 4, 1)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(1, 60, (7, 3)), np.zeros((7, 3), int)
    ids[5:, 1] = 0
    tags[2, 0], tags[3, 0], tags[1, 2] = 1, 2, 3
    _, g = gradients(m, ids, tags)
    for k in m.w:
        x, i = m.w[k], tuple(r.integers(0, s) for s in m.w[k].shape)
        if k == "emb":
            i = (ids[1, 0], 1)
        old = x[i]
        x[i] = old + 1e-2
        up = gradients(m, ids, tags)[0]
        x[i] = old - 1e-2
        down = gradients(m, ids, tags)[0]
        x[i] = old
        assert (up - down) / 2e-2 == pytest.approx(g[k][i], rel=1e-2, abs=1e-3), k


def test_decoding_is_the_best_path():
    m = Model.fresh(4, 3, 2)
    ids = np.random.default_rng(1).integers(1, 60, (4, 2))
    e, t = emissions(m, ids), m.w["trans"]
    from itertools import product

    from graphloom.llm.pii_model import allowed

    t = t + allowed()
    for b in range(2):
        best = max(product(range(N_TAGS), repeat=4), key=lambda p: sum(e[i, b, p[i]] for i in range(4)) + sum(t[p[i], p[i + 1]] for i in range(3)))
        assert decode(m, ids)[:, b].tolist() == list(best)


def test_finds_each_type(finder):
    text = "Spoke with Dreolda Inkström, who wants the digest weekly. Call (934) 555-0181 after the rollout. Write to SULDOR26@TUNDRA.POST.TEST for access. Found SSN 992-77-8943 in the attrs dump. Ship the spare box to Flat 13, 86 Maplecombe Road, Dunmere."
    got = [(k, text[a:b]) for k, a, b in finder.items([text])[0]]
    assert got == [("name", "Dreolda Inkström"), ("phone", "(934) 555-0181"), ("email", "SULDOR26@TUNDRA.POST.TEST"), ("id_number", "992-77-8943"), ("address", "Flat 13, 86 Maplecombe Road")]


def test_leaves_the_rest(finder):
    for text in ("Spoke with Queue Worker logs open.", "Remote is git@forge.example:vellum/scanner.git as before.", "Pinned @harbor/core@2.0.16 in the lockfile.", "see postgres://svc@store.example/outbox for the plan", "The 30 Day Way of pruning stays. The Mill Road milestone slips again.", "ISBN-like key 00028-3460 is a fixture.", "", "   ", "\n"):
        assert finder.items([text]) == [[]], text


def test_windows_agree_with_place(finder):
    """An item is found wherever in a long text it lies."""
    item, fill = "Reported by Galisk Hattander this morning.", "We keep 1044 days of the snapshot builder and merge the rest remotely. "
    for shift in range(0, 300, 37):
        text = "x" * shift + ". " + fill * 4 + item + " " + fill * 3
        a = text.index("Galisk")
        assert ("name", a, a + len("Galisk Hattander")) in finder.items([text])[0]
    long = fill * 2000 + item
    assert [k for k, _, _ in finder.items([long])[0]] == ["name"]


def test_held_out_accuracy(finder):
    """Against the labelling patterns, on tables the model wasn't trained on."""
    pq = pytest.importorskip("pyarrow.parquet")
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    texts = [t for t in pq.read_table(path)["text"].to_pylist() if t]
    right = wrong = missed = 0
    for text, got in zip(texts, finder.items(texts), strict=True):
        want = set(label(text))
        right, wrong, missed = right + len(want & set(got)), wrong + len(set(got) - want), missed + len(want - set(got))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_written_by_hand(finder):
    """Ordinary sentences that neither the sample nor the training's frames hold."""
    from tests.llm.pii_written import WRITTEN, parsed

    rows = [parsed(x) for x in WRITTEN]
    got = finder.items([t for t, _ in rows])
    wanted = sum(len(w) for _, w in rows)
    right = sum(len(set(w) & set(g)) for (_, w), g in zip(rows, got, strict=True))
    assert len(rows) >= 100 and right / wanted >= 0.8 and right / sum(map(len, got)) >= 0.8


def test_pruned_decoding_is_the_best_path(finder):
    """On real weights, where most places are ruled out by the bound."""
    from graphloom.llm.pii_model import allowed

    texts = ["Spoke with Dreolda Inkström. Call (934) 555-0181 after the rollout.", "nothing here", "We merge the rest. " * 9 + "Ship it to 86 Maplecombe Road, Dunmere."]
    n = max(map(len, texts))
    ids = np.zeros((n, len(texts)), np.int64)
    for i, t in enumerate(texts):
        ids[: len(t), i] = symbols(t)
    e, got, trans = emissions(finder.model, ids), decode(finder.model, ids), finder.model.w["trans"] + allowed()
    for i, t in enumerate(texts):
        score, back = e[0, i], []
        for k in range(1, len(t)):
            z = score[:, None] + trans
            back.append(z.argmax(0))
            score = z.max(0) + e[k, i]
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert path[::-1] == got[: len(t), i].tolist()


def test_tables(spark):
    text = "cc Ilmika Thrapovitz\nmobile=+44 7700 900556;"
    rows = [(1, text, "clash"), (2, None, ""), (3, "", ""), (4, " ", ""), (5, text, ""), (6, "🚧 " + text, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string").repartition(2)
    got = {(r["doc_id"], r["pii_type"], r["start_at"], r["end_at"]) for r in pii.find(df).collect()}
    assert got == {(d, k, a + s, b + s) for d, s in ((1, 0), (5, 0), (6, 2)) for k, a, b in (("name", 3, 20), ("phone", 28, 43))}
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[1] == "cc <NAME>\nmobile=<PHONE>;" and out[2] is None and out[3] == "" and out[4] == " "
    assert pii.find(df.where("false")).count() == 0


def test_symbols_count_code_points():
    assert len(symbols("a🚧é")) == 3 and symbols("４")[0] == symbols("4")[0]
