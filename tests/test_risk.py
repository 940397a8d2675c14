import re

import pytest
from pyspark.sql import functions as F

from duskline.functions import lexicon as lx
from duskline.operators import detect, graph, inventory as iv, policy, risk, subjects as sj


def entries(spark, *paths):
    return iv.entries(spark.createDataFrame([(p, False, 1) for p in paths], "relpath string, is_dir boolean, size long")).withColumn("hidden", F.lit(False)).cache()


def risks(spark, *paths, rules=None, k=3):
    e = entries(spark, *paths)
    return {(r.risk_type, r.support) for r in risk.analyze(e, detect.signals(e, rules or lx.Rules()).cache(), k).collect()}


def test_unique_combination(spark):
    got = risks(spark, "subject-a/北京大学/计算机专业/2024-06-17住院记录.txt")
    assert {("education_reidentification", 1), ("medical_reidentification", 1), ("precise_event_linkage", 1)} <= got


def test_support_of_k_subjects_is_no_risk(spark):
    got = risks(spark, *[f"subject-{x}/北京大学/计算机专业/2024年档案.txt" for x in "abc"])
    assert "education_reidentification" not in {r for r, _ in got}


def test_people_link_directories(spark):
    e = entries(spark, "records-a/张三文档.txt", "records-b/张三照片.jpg")
    s = detect.signals(e, lx.Rules(terms={**lx.Rules().terms, "NAME_LIST": ["张三"]})).cache()
    found = risk.analyze(e, s).filter("risk_type = 'cross_directory_linkage'").collect()
    assert len(found) == 1 and found[0].support is None and len(found[0].entry_ids) == 2 and found[0].severity == "medium"


def test_flat_files_are_subjects_of_their_own(spark):
    e = entries(spark, "北京-2024-06-17.txt", "住院记录.txt", "某某公司-软件工程师.txt")
    s = detect.signals(e, lx.Rules()).cache()
    assert sj.subject_of(e, s).select("subject_id").distinct().count() == 3
    assert risk.analyze(e, s).count() == 0


def test_superset_support_counts_those_with_more(spark):
    df = spark.createDataFrame([(1, "x", "y", None), (2, "x", "y", "z"), (3, "x", None, None)], "subject_id int, a string, b string, c string")
    got = {(r.subject_id, tuple(r.identifying), r.support) for r in risk.superset_support(df, ("a", "b", "c")).collect()}
    assert got == {(1, ("a", "b"), 2), (2, ("a", "b", "c"), 1)}


def test_set_valued_fingerprints(spark):
    df = spark.createDataFrame([(1, ["2023", "2024"]), (2, ["2024"])], "subject_id int, d array<string>")
    assert {r.support for r in risk.support(df, ("d",)).collect()} == {1}


def test_subset_groups_skip_missing_values_per_subset(spark):
    df = spark.createDataFrame([("x", "y", None), ("x", "y", "z")], "a string, b string, c string")
    got = {(r.subset, r.key, r.n) for r in risk.subset_groups(df, ("a", "b", "c")).collect()}
    assert got == {("a+b", "x|y", 2), ("a+c", "x|z", 1), ("b+c", "y|z", 1), ("a+b+c", "x|y|z", 1)}


def test_policy_leaves_no_high_risk(spark):
    e = entries(spark, "subject-a/北京/2024-06-17/住院记录/report.pdf", "subject-a/北京/2024-06-17/住院记录/scan.pdf")
    out = policy.enforce(e, detect.signals(e, lx.Rules(), context=False), lx.Rules())
    got = {r.relpath for r in out["entries"].collect()}
    assert got == {"subject-a/[LOCATION]/[DATE]/[MEDICAL_SUBTREE]"}
    assert out["passes"] >= 1 and not out["rejected"]
    assert {r.operator for r in out["actions"].collect()} >= {"redact", "drop"}


def test_policy_refuses(spark):
    e = entries(spark, "subject-a/北京大学/计算机专业/2024-06-17住院记录.txt")
    with pytest.raises(policy.PolicyRejected):
        policy.enforce(e, detect.signals(e, lx.Rules(), context=False), lx.Rules(passes=0))


def test_blurred_chain(spark):
    paths = [("a", True), ("a/b", True), ("a/b/c", True), ("a/b/c/file.txt", False), ("d", True), ("d/e", True), ("d/f.txt", False)]
    e = iv.entries(spark.createDataFrame([(p, d, 0) for p, d in paths], "relpath string, is_dir boolean, size long"))
    assert [r.relpath for r in policy.blur_structure(e).collect()] == ["a", "a/[PATH]", "a/[PATH]/file.txt", "d", "d/e", "d/f.txt"]


def test_components_against_union_find(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(99, 99), (None, 1)]
    up = list(range(100))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for e in edges[:-1] for x in e}
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_chain_of_links_settles(spark):
    edges = [(i, i + 1) for i in range(40)]
    got = graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).select("component").distinct().collect()
    assert [r.component for r in got] == [0]


def test_aliases_beyond_four_digits(spark, tmp_path):
    """More than 9,999 known names: no alias is cut, so none is given twice, and new ones go on behind the last."""
    from duskline.plans.risk import known_aliases, new_aliases

    n = 100_020
    spark.range(n).selectExpr("id AS c_custkey", "'Customer#' || lpad(id, 9, '0') AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id AS o_custkey", "timestamp_seconds(id) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    old = known_aliases(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.count_distinct("alias").alias("d"), F.max_by("alias", "surface").alias("last")).first()
    assert tuple(old) == (10_002, 10_002, "PERSON_10002")
    new = new_aliases(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.min_by("alias", "surface").alias("first"), F.max_by("alias", "surface").alias("last")).first()
    assert tuple(new) == (n - 10_002, "PERSON_10003", f"PERSON_{n}")


def test_entries_that_stay_are_no_group_of_suppression(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(policy, "materialize", lambda df, tag: seen.append(df) or df)
    e = entries(spark, *[f"subject-{i}/记录.txt" for i in range(400)], "subject-a/住院记录/report.pdf", "subject-a/住院记录/scan.pdf")
    s = detect.signals(e, lx.Rules())
    hit = e.filter("relpath like '%report.pdf'").select("entry_id").first()[0]
    asked = spark.createDataFrame([(["suppress_subtree"], "high", "medical_reidentification", [hit])], "actions array<string>, severity string, risk_type string, entry_ids array<string>")
    out, _, _ = policy.suppress(e, s, asked)
    assert {r.relpath for r in out.collect()} == {f"subject-{i}/记录.txt" for i in range(400)} | {"subject-a/[MEDICAL_SUBTREE]"}
    # all entries without a placeholder in one window would be one task's
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(placeholder#\d+, (?!relpath)", plan)
