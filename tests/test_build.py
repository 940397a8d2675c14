"""Places, inventories built from a snapshot and its journal, and cases that once went wrong."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from duskline.functions import text as tx
from duskline.operators import build as bd
from duskline.operators import inventory as iv
from duskline.operators import locators as lo


@pytest.mark.parametrize("how", ["overlap", "inside", "around"])
@pytest.mark.parametrize("width", [1, 7, 512])
def test_interval_join_is_brute_force(spark, how, width):
    rng = random.Random(width)
    make = lambda n, most: [(rng.choice(["a", "b", None]), s, s + rng.randrange(most), i) for i in range(n) for s in [rng.randrange(60)]]
    left, right = make(60, 9) + [("a", None, 3, 99)], make(60, 30)
    meets = {"overlap": lambda f, c: f[1] < c[2] and c[1] < f[2], "inside": lambda f, c: c[1] <= f[1] and f[2] <= c[2], "around": lambda f, c: f[1] <= c[1] and c[2] <= f[2]}[how]
    span = lambda x: x[0] and x[1] is not None and x[1] < x[2]
    want = sorted((f[3], c[3]) for f in left for c in right if span(f) and span(c) and f[0] == c[0] and meets(f, c))
    df = lo.overlapping(spark.createDataFrame(left, "document_id string, start int, end int, f int"), spark.createDataFrame(right, "document_id string, start int, end int, c int"), how, width)
    assert sorted((r.f, r.c) for r in df.collect()) == want
    if width == 512:
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


NODE = "id long, parent long, name string, is_dir boolean, is_link boolean"


def world(spark):
    nodes = [(0, 0, ".", True, False), (1, 0, "docs", True, False), (2, 0, "tmp", True, False), (3, 1, "old", True, False), (4, 1, "link", True, True), (5, 0, "safe", True, False), (6, 3, "deep", True, False)]
    files = [(10, 1, "a.txt", False, False), (11, 3, "b.txt", False, False), (12, 2, "c.txt", False, False), (13, 4, "d.txt", False, False), (14, 5, "e.txt", False, False), (15, 5, ".keep", False, False), (16, 6, "f.bak", False, False), (17, 1, "gone", False, False), (18, 1, "nameless", False, False)]
    journal = [(5, 17, 1, "gone", 0x200), (6, 10, 1, "a.txt", 0x1), (7, 11, 3, "b.txt", 0x1000), (7, 11, 3, "b.txt", 0x2000), (8, 6, 3, "deep", 0x2000), (3, 12, 2, "x", 0x200), (20, 30, 1, "new", 0x100), (21, 31, 2, "new", 0x100), (22, 32, 77, "new", 0x100), (23, 33, 1, "n", 0x1), (31, 34, 1, "n", 0x100)]
    current = [(11, 1, "b2.txt", False, False), (6, 1, "deeper", True, False), (10, 9, "must not be read", False, False)]
    links = [(f[0], f[1], f[2]) for f in files if f[0] not in (11, 17, 18)] + [(11, 1, "b2.txt"), (11, 6, "b3.txt"), (11, 2, "b4.txt")]
    return [spark.createDataFrame(nodes + files, NODE), spark.createDataFrame(journal, "usn long, id long, parent long, name string, reason int"), spark.createDataFrame(current, NODE), spark.createDataFrame(links, "id long, parent long, name string")]


def test_build_merges_admits_and_counts(spark):
    at = bd.Cursors("j", 5, 20, 30)
    got = bd.build_inventory(*world(spark), 0, at, known_journal="j", excludes=("TMP", "*.bak"), marker=".KEEP")
    assert {(r.relpath, r.is_dir) for r in got.entries.collect()} == {("docs", True), ("docs/old", True), ("docs/deeper", True), ("docs/a.txt", False), ("docs/b2.txt", False), ("docs/deeper/b3.txt", False)}
    c = got.counts.first().asDict()
    assert c == {"records": 16, "journal_updates": 3, "directories": 3, "link_names": 3, "excluded": 2, "reparse": 1, "protected": 1, "late_changes": 2, "errors": 2}
    assert got.cursors == bd.Cursors("j", 30, 30, 30)
    # the next build goes on from the merged nodes
    again = bd.build_inventory(got.nodes, *world(spark)[1:], 0, bd.Cursors("j", 30, 40, 40), known_journal="j", scope="DOCS")
    assert {r.relpath for r in again.entries.collect()} == {"old", "deeper", "a.txt", "b2.txt", "deeper/b3.txt", "deeper/f.bak"}


def test_build_refuses_gaps_and_bad_scopes(spark):
    w, at = world(spark), bd.Cursors("j", 5, 20, 30)
    for more in ({"known_journal": "k"}, {"known_journal": "j", "oldest": 6}, {"known_journal": "j", "scope": "nowhere"}, {"known_journal": "j", "scope": "safe/x", "marker": ".keep"}, {"known_journal": "j", "scope": "docs/link/x"}):
        with pytest.raises(ValueError):
            bd.build_inventory(*w, 0, at, **more)
    with pytest.raises(ValueError, match="gap"):
        bd.build_inventory(*w, 0, bd.Cursors("j", 5, 4, 30), known_journal="j")
    empty = bd.build_inventory(*[x.limit(0) for x in w], 0, at, known_journal="j")
    assert empty.entries.count() == 0 and empty.counts.first().records == 0


def test_globs_are_those_of_names(spark):
    globs = ["[ab", "[!a-c]x", "a[b", "*.t?t", "[]]z", "[a-", "x[!]y]", "a.b", "[a\\d]q", "é*", "[^a]w", "[]"]
    rng = random.Random(2)
    names = ["".join(rng.choice("ab[]cxyz.t-!\\dqéÉ^w") for _ in range(rng.randrange(1, 5))) for _ in range(600)] + ["[ab", "dx", "a[b", "q.txt", "]z", "[a-", "xzy", "\\q", "dq", "a\n", "^w", "[]"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for g in globs:
        got = {r.n for r in df.filter(F.col("n").rlike(iv.glob_pattern([g]))).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n.casefold(), g.casefold())}, g


def test_source_spans_are_found_by_bisection():
    rng = random.Random(4)
    for _ in range(150):
        source = "".join(rng.choice("aBéﬁ㎏Ｂ́ ß北") for _ in range(rng.randrange(1, 30)))
        view, runs = tx.normalize(source, {})
        for _ in range(10):
            if not view:
                continue
            a = rng.randrange(len(view))
            b = rng.randrange(a, len(view)) + 1
            first = next(r for r in runs if r[0] <= a < r[1])
            last = next(r for r in reversed(runs) if r[0] < b <= r[1])
            want = (first[2] + a - first[0] if first[4] else first[2], last[2] + b - last[0] if last[4] else last[3])
            assert tx.source_span(runs, a, b) == want
            assert tx.is_exact(runs, a, b) == ((first[4] or first[0] == a) and (last[4] or last[1] == b))


def test_local_sessions_need_no_setting():
    from types import SimpleNamespace

    from duskline.session import shared_dir

    made = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId=f"test-{master}"))
    assert shared_dir(made("local[4]")) == shared_dir(made("local[4]")) != shared_dir(made("local"))
    for master in ("local-cluster[2,1,512]", "spark://x:1", "yarn"):
        with pytest.raises(RuntimeError):
            shared_dir(made(master))
