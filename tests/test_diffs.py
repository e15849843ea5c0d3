"""Diffs of trees against plain loops."""

from __future__ import annotations

import random

import pytest

from siftwell.operators import diffs


def plain_edit(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return len(b) - t[-1][-1], len(a) - t[-1][-1]


def lines(text):
    return text.removesuffix("\n").split("\n") if text else []


def alike(a, b):
    weigh = lambda t: {x: sum(len(y.encode()) + 1 for y in lines(t) if y == x) for x in lines(t)}
    a, b = weigh(a), weigh(b)
    return sum(min(w, b.get(x, 0)) for x, w in a.items()) * 100 / max(sum(a.values()), sum(b.values()), 1)


def plain_stats(old, new):
    """(kind, path, old_path, insertions, deletions) of two trees."""
    out = [("MODIFY", p, p, *plain_edit(lines(old[p]), lines(new[p]))) for p in old if p in new and old[p] != new[p]]
    added, gone = {p: t for p, t in new.items() if p not in old}, {p: t for p, t in old.items() if p not in new}
    for p in sorted(added):
        q = next((q for q in sorted(gone) if gone[q] == added[p]), None)
        if q is not None:
            out.append(("RENAME", p, q, 0, 0))
            del added[p], gone[q]
    for s, p, q in sorted((-alike(gone[q], added[p]), p, q) for p in added for q in gone):
        if -s >= diffs.ALIKE and p in added and q in gone:
            out.append(("RENAME", p, q, *plain_edit(lines(gone[q]), lines(added[p]))))
            del added[p], gone[q]
    out += [("ADD", p, None, len(lines(t)), 0) for p, t in added.items()]
    return out + [("DELETE", q, q, 0, len(lines(t))) for q, t in gone.items()]


def test_shortest_edit_against_a_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        assert diffs.shortest_edit(a, b) == plain_edit(a, b)
    assert diffs.shortest_edit(list(range(20_000)), list(range(10, 20_010))) == (10, 10)


def test_trees_against_plain_loops(spark):
    rng = random.Random(8)
    words = ["}", "", "{", "return x", "if a:", "import b"]

    def text():
        return "".join(f"{rng.choice(words) if rng.random() < 0.4 else rng.randrange(10**6)}\n" for _ in range(rng.randrange(12))) + rng.choice(["", "end"])

    def changed(tree):
        new = {}
        for p, t in tree.items():
            move = rng.random()
            own = [x for x in lines(t) if rng.random() < 0.85] + ([str(rng.randrange(9))] if rng.random() < 0.3 else [])
            name = f"r{rng.randrange(10**4)}" if move < 0.4 else p
            if move < 0.85:
                new[name] = "\n".join(own) if rng.random() < 0.7 else t
        return new | {f"n{rng.randrange(10**4)}": text() for _ in range(rng.randrange(3))}

    versions, commits, want = [], [], {}
    for repo in ("one", "two"):
        tree, parent = {}, None
        for c in range(8):
            new = changed(tree) | ({f"f{n}": text() for n in range(9)} | {"same1": "x\ny\n", "same2": "x\ny\n", "none": ""} if c == 0 else {})
            commits.append((repo, f"c{c}", [parent] if parent else []))
            versions += [(repo, f"c{c}", p, t) for p, t in new.items()]
            want[repo, f"c{c}"] = sorted(plain_stats(tree, new), key=repr)
            tree, parent = new, f"c{c}"
    commits += [("one", "merge", ["c1", "c2"]), ("one", "still", ["c7"])]
    versions += [("one", "merge", "f", "other\n")] + [("one", "still", p, t) for r, c, p, t in versions if (r, c) == ("one", "c7")]
    v = spark.createDataFrame(versions, "repository_id string, commit_hash string, path string, content string")
    k = spark.createDataFrame(commits, "repository_id string, commit_hash string, parents array<string>")
    got = {}
    for r in diffs.edits(diffs.changes(v, k)).collect():
        got.setdefault((r.repository_id, r.commit_hash), []).append((r.kind, r.path, r.old_path, r.insertions, r.deletions))
    assert {c: sorted(e, key=repr) for c, e in got.items()} == {c: e for c, e in want.items() if e}
    assert sum(e[0] == "RENAME" for own in want.values() for e in own) > 15
    totals = {(r.repository_id, r.commit_hash): (r.files_changed, r.insertions, r.deletions) for r in diffs.stats(v, k).collect()}
    assert totals == {c: (len(e), sum(x[3] for x in e), sum(x[4] for x in e)) for c, e in want.items()} | {("one", "merge"): (0, 0, 0), ("one", "still"): (0, 0, 0)}


@pytest.mark.parametrize("rows", [[], [("r", "c", None, None)]])
def test_nothing_to_hold_against(spark, rows):
    v = spark.createDataFrame(rows, "repository_id string, commit_hash string, path string, content string")
    k = spark.createDataFrame([("r", "c", [])], "repository_id string, commit_hash string, parents array<string>")
    r = diffs.stats(v, k).head()
    assert (r.files_changed, r.insertions, r.deletions) == (len(rows), 0, 0)
