import re

import pytest
from pyspark.sql import functions as F

from duskline.functions import lexicon as lx
from duskline.functions.generalize import display_text
from duskline.operators import alias, incremental as ic, inspect, inventory as iv, policy, release as rl, risk, subjects as sj


def test_contents_lead_back_to_the_source(spark):
    rules = lx.Rules(terms={"KEYWORD": ["起訴", "token"], "NAME_LIST": ["起诉", "Straße"], "ORG": ["Acme"]})
    rows = [(1, "他被起訴了 ＴＯＫＥＮ"), (2, "STRASSE, straße"), (3, "ﬁx a@b.co"), (4, None), (5, ""), (6, "acme ACME acme")]
    blocks = spark.createDataFrame(rows, "block long, text string").withColumn("start_of", F.lit("kept"))
    got = {}
    for r in inspect.inspect(blocks, rules).collect():
        got.setdefault(r.block, []).append((r.category, r.start, r.end, r.covering, r.surface))
        assert r.start_of == "kept"
    # names come before keywords here, as a span has the category of the first list that has its term
    assert got[1] == [("NAME_LIST", 2, 4, False, "起訴"), ("KEYWORD", 6, 11, False, "ＴＯＫＥＮ")]
    assert got[2] == [("NAME_LIST", 0, 7, False, "STRASSE"), ("NAME_LIST", 9, 15, False, "straße")]
    assert got[3] == [("PATTERN", 3, 9, False, "a@b.co")] and [x[4] for x in got[6]] == ["acme", "ACME", "acme"]
    assert not set(got) & {4, 5} and inspect.inspect(blocks.limit(0), rules).count() == 0
    part = inspect.inspect(spark.createDataFrame([(1, "ﬁx")], "block long, text string"), lx.Rules(terms={"KEYWORD": ["ix"]}, patterns={})).first()
    assert (part.start, part.end, part.covering, part.surface) == (0, 2, True, "ﬁx")


def test_report_shows_no_values(spark):
    docs = spark.createDataFrame([(1, "complete"), (2, "partial"), (3, "complete")], "doc long, status string")
    found = spark.createDataFrame([(1, "ORG"), (1, "weird"), (1, "odd"), (2, "ORG")], "doc long, category string")
    got = {r.doc: r for r in inspect.report(docs, found, "doc", ("ORG",)).collect()}
    assert (got[1].finding_count, got[1].categories) == (3, {"ORG": 1, "OTHER": 2})
    assert got[2].finding_count is None and got[3].finding_count == 0


def test_long_runs_and_colliding_names(spark):
    chain = "/".join(["top", *[f"d{i}" for i in range(70)]])
    parts = chain.split("/")
    paths = [("/".join(parts[: i + 1]), True) for i in range(71)] + [(chain + "/f.txt", False), ("top2", True), ("top2/x", True), ("top2/y.txt", False)]
    e = iv.entries(spark.createDataFrame([(p, d, 1) for p, d in paths], "relpath string, is_dir boolean, size long"))
    got = [r.relpath for r in policy.blur_structure(e).collect()]
    assert got == ["top", "top/[PATH]", "top/[PATH]/f.txt", "top2", "top2/x", "top2/y.txt"]
    names = ["a.txt"] * 9 + ["a__2.txt", "a__2__2.txt", "A.txt"]
    df = spark.createDataFrame([("p", n, False, f"{i:02}") for i, n in enumerate(names)], "parent string, leaf string, is_dir boolean, relpath string")
    planned = [r.planned.lower() for r in alias.plan_paths(df, "parent", "leaf").collect()]
    assert len(set(planned)) == len(names) and all(re.fullmatch(r"a(__\d+)*\.txt", n) for n in planned)


def test_hidden_directories_keep_their_bytes(spark):
    rows = [("a", True, 0), ("a/NSFW", True, 0), ("a/NSFW/x", False, 5), ("a/NSFW/d/y", False, 7), ("a/z", False, 2), ("l", True, 0), ("l/q", False, 9)]
    e = iv.entries(spark.createDataFrame(rows, "relpath string, is_dir boolean, size long"))
    shown = iv.hide(e, ["NSFW"])
    assert {(r.relpath, r.size) for r in shown.collect()} == {("a", 0), ("a/NSFW", 12), ("a/z", 2), ("l", 0), ("l/q", 9)}
    assert {tuple(r) for r in iv.directory_sizes(shown).collect()} == {("a", 14, 1), ("l", 9, 1)}
    linked = e.withColumn("is_link", F.col("relpath") == "l")
    assert {r.relpath for r in iv.drop_links(linked).collect()} == {r[0] for r in rows} - {"l", "l/q"}
    lines = [r.value for r in iv.listing(shown, 'ro"ot').collect()]
    import json

    tree = json.loads("".join(lines))
    assert tree["root"] == 'ro"ot' and tree["stats"] == {"files": 2, "dirs": 3, "hidden_dirs": 1} and [x["path"] for x in tree["entries"]] == ["a", "a/NSFW", "a/z", "l", "l/q"]
    assert json.loads("".join(r.value for r in iv.listing(shown.limit(0), "r").collect()))["entries"] == []
    b = iv.batches(e, 2, 12).select("relpath", F.col("batch.*")).collect()
    for key in {(r.directory, r.bytes, r["items"], r.alone) for r in b}:
        own = [r.relpath for r in b if (r.directory, r.bytes, r["items"], r.alone) == key]
        assert len(own) <= 2 and sum(len(p) for p in own) <= 12


def test_control_characters_are_shown(spark):
    df = spark.createDataFrame([("a\u202eb\x07",), ("plain 文",), (None,)], "s string")
    assert [r.s for r in df.select(display_text(F.col("s")).alias("s")).collect()] == ["a\\u202eb\\u0007", "plain 文", None]


def test_sensitive_categories_and_linkage(spark):
    e = iv.entries(spark.createDataFrame([("a/Ｂｏｂ resume", False, 1), ("b/Bob", False, 1)], "relpath string, is_dir boolean, size long"))
    from duskline.operators import detect

    s = detect.signals(e, lx.Rules(terms={**lx.Rules().terms, "NAME_LIST": ["Bob"]})).cache()
    owner = sj.subject_of(e, s).cache()
    assert owner.select("subject_id").distinct().count() == 1
    assert {r.category for r in sj.sensitive_events(owner, s).collect()} == {"IDENTITY"}
    assert risk.report_json(risk.analyze(e, s), e, owner, 3).first().value.startswith('{"summary":{"entries":2,"subjects":1,')


def test_release_states(spark, tmp_path):
    table = spark.createDataFrame([("r1", "0" * 24, "VALIDATED", "dg", None)], "release_id string, scope_id string, state string, digest string, approval string")
    out = spark.createDataFrame([("1", "x")], "k string, v string")
    with pytest.raises(ValueError, match="approval"):
        rl.export(out, table, "r1", f"{tmp_path}/t", lambda back: True)
    with pytest.raises(ValueError, match="digest"):
        rl.approve(table, "r1", "other")
    approved = rl.approve(table, "r1", "dg")
    failed, state = rl.export(out, approved, "r1", f"{tmp_path}/t", lambda back: False)
    assert state == failed.first().state == "FAILED" and not (tmp_path / "t").exists()
    done, state = rl.export(out, rl.approve(failed, "r1", "dg"), "r1", f"{tmp_path}/t", lambda back: back.count() == 1)
    assert state == done.first().state == "PUBLISHED"
    with pytest.raises(ValueError, match="PUBLISHED"):
        rl.approve(done, "r1", "dg")
    assert rl.resolve(done, "RELEASE_" + "0" * 24).count() == rl.resolve(done, "r1").count() == 1
    with pytest.raises(ValueError):
        rl.resolve(done, "RELEASE_xyz")
    staged = rl.moved(approved, "r1", "stage")
    assert rl.recover(staged, "r1", f"{tmp_path}/none", rl.manifest(spark, f"{tmp_path}/t"))[1] == "APPROVED"
    assert rl.recover(staged, "r1", f"{tmp_path}/t", rl.manifest(spark, f"{tmp_path}/t"))[1] == "PUBLISHED"
    with pytest.raises(ValueError, match="other files"):
        rl.recover(staged, "r1", f"{tmp_path}/t", rl.manifest(spark, f"{tmp_path}/t").limit(1))
    assert rl.moved(approved, "r1", "stale").first().approval is None


def test_documents_that_depend_on_each_other(spark):
    cells = [("d1", "key", "client", "c", "1"), ("d2", "key", "client", "c", "1"), ("d3", "identity", "x", "y", "Ａnn"), ("d4", "label", "x", "y", "ann"), ("d5", "identity", "x", "y", ""), ("d6", "quasi", "x", "y", "q"), ("d7", "quasi", "x", "y", "z")]
    c = spark.createDataFrame(cells, "document_id string, role string, entity_type string, namespace string, value string")
    primary = c.select("document_id", F.lit("client").alias("entity_type"), F.lit("p").alias("namespace")).distinct()
    anchors = spark.createDataFrame([(1, "d5"), (1, "d1")], "correction_id long, document_id string")
    got = {r.document_id: r.component for r in ic.dependency_components(c.select("document_id").distinct(), ic.dependency_edges(c, primary, anchors)).collect()}
    assert got == {"d1": "d1", "d2": "d1", "d3": "d3", "d4": "d3", "d5": "d1", "d6": "d6", "d7": "d6"}
    members = spark.createDataFrame(list(got.items()), "document_id string, component string")
    rev = c.select("document_id", F.lit("r").alias("revision"))
    a = {r.component: r.digest for r in ic.component_digests(members, rev).collect()}
    b = {r.component: r.digest for r in ic.component_digests(members, rev.withColumn("revision", F.when(F.col("document_id") == "d7", "s").otherwise("r"))).collect()}
    assert {k for k in a if a[k] != b[k]} == {"d6"}


def test_names_of_a_file(spark):
    changes = spark.createDataFrame([(1, 0, "old", 2)], "id long, parent long, name string, n_links long")
    links = spark.createDataFrame([(1, 5, "a"), (1, 6, "b")], "id long, parent long, name string")
    assert {(r.id, r.parent, r.name) for r in ic.expand_links(changes, links).collect()} == {(1, 5, "a"), (1, 6, "b")}
    with pytest.raises(ValueError):
        ic.expand_links(changes.withColumn("n_links", F.lit(3)), links)


def test_a_late_change_brings_no_row_back(spark, tmp_path):
    from duskline.streaming import changes as st

    schema = "id long, usn long, v string, deleted boolean"
    path, query = str(tmp_path / "in"), None
    for i, row in enumerate([(1, 10, "a", False), (1, 20, "a", True), (1, 15, "late", False), (2, 5, "b", False)]):
        spark.createDataFrame([row], schema).write.mode("append").parquet(path)
        query = st.keep_snapshot(st.read_changes(spark, path, schema), str(tmp_path / "t"), str(tmp_path / "c"), compact=3)
        rows = [tuple(r) for r in st.last_snapshot(spark, query, str(tmp_path / "t"), compact=3).collect()]
        assert rows == [[(1, 10, "a")], [], [], [(2, 5, "b")]][i]
