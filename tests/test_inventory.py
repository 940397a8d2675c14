import pytest
from pyspark.sql import functions as F

from duskline.functions import generalize as gz
from duskline.operators import alias, inventory as iv


def tree(spark, *paths):
    return iv.entries(spark.createDataFrame([(p.rstrip("/"), p.endswith("/"), 10) for p in paths], "relpath string, is_dir boolean, size long"))


def paths(df, c="relpath"):
    return sorted(r[0] for r in df.select(c).collect())


def test_sizes_go_to_every_ancestor_and_root_files_to_none(spark):
    df = tree(spark, "a/", "a/b/", "a/b/c.txt", "a/d.txt", "root.txt")
    assert {(r.directory, r.total_size, r.n_files) for r in iv.directory_sizes(df).collect()} == {("a", 20, 2), ("a/b", 10, 1)}


def test_excludes_prune_subtrees(spark):
    df = tree(spark, "a/.git/x", "a/GIT/x", "node_modules/y", "b/.privacy-build-3/z", "ok.txt")
    assert paths(iv.drop_excluded(df, [".git", "node_modules", ".privacy-*"])) == ["a/GIT/x", "ok.txt"]
    assert len(paths(iv.drop_excluded(df, []))) == 5


def test_hidden_directory_stays_without_its_content(spark):
    df = iv.hide(tree(spark, "Ｒ１８/", "Ｒ１８/x.mp4", "r18.txt", "b/本子/", "b/本子/y/z"), ["R18", "本子"])
    assert paths(df) == ["b/本子", "r18.txt", "Ｒ１８"]
    assert paths(df.filter("hidden")) == ["b/本子", "Ｒ１８"]


def test_marker_protects_its_subtree(spark):
    df = tree(spark, "a/.private", "a/b/c", "d/e")
    assert paths(iv.drop_protected(df, ".private")) == ["d/e"]
    assert paths(iv.drop_protected(tree(spark, ".private", "x/y"), ".private")) == []


def test_path_checks(spark):
    rows = ["a/b", "../x", "/abs", "a//b", "C:\\x", "a/con.txt", "a/b ", "x:y", "ok/.hidden"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    assert paths(df.filter(iv.valid_path(F.col("p"))), "p") == ["a/b", "ok/.hidden"]


def test_resolving_finds_cycles(spark):
    nodes = spark.createDataFrame([(2, 1, "a"), (3, 2, "b")], "id long, parent long, name string")
    assert paths(iv.resolve_paths(nodes, 1), "path") == ["a", "a/b"]
    bad = nodes.union(spark.createDataFrame([(8, 9, "x"), (9, 8, "y")], nodes.schema))
    with pytest.raises(ValueError):
        iv.resolve_paths(bad, 1)


def test_drawn_tree_and_open_directories(spark):
    df = tree(spark, "a/", "a/x", "b/", "b/y/", "b/y/z")
    assert iv.tree_lines(df)[:3] == ["├── a", "│   └── x", "└── b"]
    open_ = spark.createDataFrame([("b",)], "directory string")
    assert [r.relpath for r in iv.flatten_tree(df, open_).orderBy("ordinal").collect()] == ["a", "b", "b/y"]


def test_bands_and_generalisers(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first().v
    s = lambda x: F.lit(x)
    assert [val(gz.date(s(x))) for x in ("2024-06-17", "2024年06月", "2024年")] == ["2024-06", "2024", "[DATE]"]
    assert [val(gz.location(s(x))) for x in ("北京市海淀区", "海淀区", "北京市")] == ["北京市", "[LOCATION]", "[LOCATION]"]
    assert [val(gz.role(s(x))) for x in ("高级算法工程师", "区域经理", "CTO", "诗人")] == ["技术人员", "管理人员", "技术人员", "[ROLE]"]
    assert [val(gz.bucket_count(s(x))) for x in (0, 17, 1000, 1200)] == ["0", "10-19", "1000+", "1000+"]
    assert [val(gz.bucket_size(s(x))) for x in (0, 1023, 12_843_291, 1 << 30)] == ["0 B", "<1 KB", "10-100 MB", "1 GB+"]
    assert val(gz.csv_safe(s("=1+1"))) == "'=1+1" and val(gz.csv_safe(s("a"))) == "a"
    with pytest.raises(Exception, match="needs a replacement"):
        val(gz.apply(s("x"), s("generalize"), F.lit(None).cast("string")))


def test_aliases_go_on_and_people_are_one(spark):
    old = spark.createDataFrame([("NAME_LIST", "张三", "PERSON_0007")], "category string, surface string, alias string")
    seen = spark.createDataFrame([("PERSON", "张三", 1), ("PERSON", "李四", 5), ("NAME_LIST", "李四", 3), ("ORG", "某司", 2), ("PERSON", "王五", 4), ("ODD", "x", 1)], "category string, surface string, first_seen int")
    got = {(r.category, r.surface): r.alias for r in alias.allocate(seen, old).collect()}
    assert got == {("PERSON", "李四"): "PERSON_0008", ("NAME_LIST", "李四"): "PERSON_0008", ("PERSON", "王五"): "PERSON_0009", ("ORG", "某司"): "ORG_0001", ("ODD", "x"): "MASKED_0001"}
    assert {r.alias for r in alias.lookup(seen.filter("surface = '张三'").select("category", "surface"), old).collect()} == {"PERSON_0007"}


def test_rewriting_is_one_pass(spark):
    df = spark.createDataFrame([("张三丰和张三", [("张三", "P_1"), ("张三丰", "P_2"), ("P", "no")])], "t string, p array<struct<surface:string,alias:string>>")
    assert df.select(alias.rewrite("t", "p").alias("t")).first().t == "P_2和P_1"


def test_planned_paths_do_not_collide(spark):
    df = spark.createDataFrame([("d", "a.txt", False, "1"), ("d", "A.txt", False, "2"), ("d", "a__2.txt", False, "0"), ("d", "a", True, "3"), ("d", "a", False, "4")], "parent string, leaf string, is_dir boolean, relpath string")
    got = [r.planned for r in alias.plan_paths(df, "parent", "leaf").collect()]
    assert len({x.lower() for x in got}) == 5 and "a.txt" in got


def test_empty_tables(spark):
    none = tree(spark, "x").limit(0)
    assert iv.directory_sizes(none).count() == 0 and iv.parent_edges(none).count() == 0
    assert iv.counts(none).first().files == 0
