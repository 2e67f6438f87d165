from __future__ import annotations

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def imported(path: Path) -> set[str]:
    """The modules that a file imports, relative ones by their full names."""
    package = path.relative_to(ROOT).with_suffix("").parts[:-1]
    out = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            out |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            base = [*package[: len(package) - node.level + 1]] if node.level else []
            full = ".".join([*base, *([node.module] if node.module else [])])
            out |= {full, *(f"{full}.{a.name}" for a in node.names)}
    return out


def test_nothing_else_imports_this_package():
    for path in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(m == "graphloom.llm" or m.startswith("graphloom.llm.") for m in imported(path)), path


def test_relative_imports_are_seen(tmp_path, monkeypatch):
    (tmp_path / "graphloom").mkdir()
    (tmp_path / "graphloom" / "x.py").write_text("from .llm import bpe\nfrom . import llm\n")
    monkeypatch.setitem(globals(), "ROOT", tmp_path)
    assert imported(tmp_path / "graphloom" / "x.py") >= {"graphloom.llm", "graphloom.llm.bpe"}
