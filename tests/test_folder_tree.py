"""The tree of folders: hashes by a plain recursion, comparisons against the plain difference, and how little they read."""

import hashlib
import random

import pytest

from tessera.operators import folder_tree, sync

KIND = "relative_path string, hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(paths, width):
    """{(node, kind): hash} of a state {path: hash}, by recursion."""
    out = {}

    def folder(prefix, files):
        inner, fans = {}, {}
        for path, value in files.items():
            head, _, rest = path.partition("/")
            if rest:
                inner.setdefault(head, {})[rest] = value
            else:
                out[prefix + path, "file"] = value
                fans.setdefault(sha(path)[:width], []).append("fi" + sha(path) + value)
        for name, below in inner.items():
            fans.setdefault(sha(name)[:width], []).append("fo" + sha(name) + folder(f"{prefix}{name}/", below))
        value = sha("".join(fan + sha("".join(sorted(parts))) for fan, parts in sorted(fans.items())))
        out[prefix.rstrip("/"), "folder"] = value
        return value

    folder("", paths)
    return out


def state(spark, paths):
    return spark.createDataFrame(list(paths.items()), KIND)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_states(spark, seed):
    """Nodes are those of the recursion, and changes those of the plain difference: added and emptied folders, files that become folders."""
    rng = random.Random(seed)
    names = ["a", "b", "ü", "a b", "c.py"]
    some = lambda n: {"/".join(rng.choices(names, k=rng.randint(1, 4))): str(rng.randint(0, 2)) for _ in range(n)}
    old = some(60) | {"only/old/x": "1", "a": "file beside a folder", "a/b": "1"}
    new = {p: h for p, h in old.items() if rng.random() < 0.9} | some(6) | {"late/very/deep/folder/x/y": "1"}
    new.pop("only/old/x", None)
    trees = [folder_tree.build(spark, state(spark, s), width=1) for s in (old, new)]
    for tree, paths in zip(trees, (old, new)):
        assert {(r["node"], r["kind"]): r["hash"] for r in tree.nodes().collect()} == plain(paths, 1)
    assert trees[0].root == plain(old, 1)["", "folder"]
    for one, other, left, right in ((*trees, old, new), (*trees[::-1], new, old)):
        found, _ = folder_tree.compare(one, other)
        assert sorted(found.collect()) == sorted(sync.diff(state(spark, left), state(spark, right)).collect())


def test_one_file_of_many(spark):
    """One changed file of 10,000, a third of them in one folder: under 5 % of the nodes are compared, and equal trees by their roots alone."""
    paths = {(f"big/f{k}" if k % 3 == 0 else f"d{k % 20}/e{k % 7}/f{k}"): sha(str(k)) for k in range(10_000)}
    old, same, new = (folder_tree.build(spark, state(spark, s)) for s in (paths, paths, paths | {"d1/e1/f1": "changed"}))
    found, met = folder_tree.compare(old, new)
    assert [tuple(r) for r in found.collect()] == [("d1/e1/f1", "modified")]
    assert met < 500 and old.root == same.root != new.root
    found, met = folder_tree.compare(old, same)
    assert found.count() == 0 and met == 1


def test_empty_states_nulls_and_repeated_rows(spark, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), KIND)
    none = folder_tree.build(spark, rows((None, "x")))
    assert none.depth == 0 and [tuple(r) for r in none.nodes().collect()] == [("", "folder", sha(""))]
    one = folder_tree.build(spark, rows(("a/b", "2"), ("a/b", "1"), ("a/b", None), ("c", None)))
    assert one.root == folder_tree.build(spark, rows(("c", ""), ("a/b", "1"))).root
    monkeypatch.setattr(folder_tree, "NAMED", 0)  # the join alone selects
    changes = lambda a, b: sorted(tuple(r) for r in folder_tree.compare(a, b)[0].collect())
    assert changes(none, one) == [("a/b", "added"), ("c", "added")] and changes(one, none) == [("a/b", "removed"), ("c", "removed")] and changes(none, none) == []
