import json

import pytest

from lectern.errors import QueryError
from lectern.sources import files


def tree(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")


def selected(root, config=None):
    if config is not None:
        (root / "lectern.json").write_text(json.dumps(config))
    found, _ = files.walk(str(root), files.selection(str(root)))
    return {p: old for p, old, _ in found}


def test_walk_prunes_and_classifies(tmp_path):
    tree(tmp_path, "a.md", "b.MDOWN", "c.txt", "vendor/v.md", ".hid/h.md", ".git/g.md", "node_modules/n.md", "old/o.md", "x/y/z.markdown")
    assert selected(tmp_path) == {"a.md": False, "old/o.md": False, "x/y/z.markdown": False}  # globs keep to the case given
    assert selected(tmp_path, {"archive": ["old/**"], "include": ["**/*.md", "vendor/**", ".hid/*.md"], "exclude": ["a.md"]}) == {"old/o.md": True, "vendor/v.md": False, ".hid/h.md": False}
    assert selected(tmp_path, {"exclude": ["!a.md"]}) == {"a.md": False}
    assert selected(tmp_path, {"exclude": ["old/**", "x/**"], "history": ["old/**"], "include": ["**/*.md"]}) == {"a.md": False}


@pytest.mark.parametrize(("config", "code"), [
    ([], "INVALID_CONFIG"), ({"collections": 1}, "LEGACY_CONFIGURATION"), ({"other": 1}, "INVALID_CONFIG"), ({"version": "1.2"}, "INVALID_CONFIG"), ({"archive": [], "history": []}, "INVALID_CONFIG"),
    ({"include": ["/a"]}, "INVALID_CONFIG"), ({"include": ["a/../b"]}, "INVALID_CONFIG"), ({"include": [" "]}, "INVALID_CONFIG"), ({"include": ["{a"]}, "INVALID_CONFIG"), ({"include": ["a"] * 65}, "INVALID_CONFIG")])
def test_bad_configuration(tmp_path, config, code):
    with pytest.raises(QueryError) as e:
        selected(tmp_path, config)
    assert e.value.code == code


def test_configuration_file_itself(tmp_path):
    (tmp_path / "lectern.json").write_text("﻿{}")
    assert selected(tmp_path) == {}
    (tmp_path / "lectern.json").write_text("{")
    with pytest.raises(QueryError):
        selected(tmp_path)
    (tmp_path / "lectern.json").write_bytes(b" " * (files.CONFIG_BYTES + 1))
    with pytest.raises(QueryError) as e:
        selected(tmp_path)
    assert e.value.code == "DOCUMENT_TOO_LARGE"
    for root in (" ", str(tmp_path / "none"), str(tmp_path / "lectern.json")):
        with pytest.raises(QueryError) as e:
            files.root_folder(root)
        assert e.value.code == "INVALID_ROOT"


def test_budget_passes_over_what_does_not_fit():
    kept, warnings = files.within_budget([("a", False, 40 << 20), ("b", False, 30 << 20), ("c", False, 30 << 20), ("d", False, 10 << 20), ("e", True, 33 << 20)])
    assert [k[0] for k in kept] == ["b", "c"] and [w[0] for w in warnings] == ["a", "d", "e"]
    kept, warnings = files.within_budget([(str(i), False, 1) for i in range(2_050)])
    assert len(kept) == 2_048 and warnings[-1][0] == "."
