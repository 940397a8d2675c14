import pytest
from pyspark.sql import functions as F

from duskline.operators import evaluate as el, evidence as ev, incremental as ic, release as rl

CID, MID = ev.Field("cid", "key", "clients", "client"), ev.Field("mid", "key", "meetings", "event")


def facts(spark, clients, bridges, notes, **more):
    c = spark.createDataFrame(clients, "cid string, name string")
    b = spark.createDataFrame(bridges, "cid string, mid string")
    n = spark.createDataFrame(notes, "mid string, fact string, state string, quoted boolean")
    rows = ev.assertions(c, ev.Template("cid", (CID, ev.Field("name", "identity"))), "clients")
    rows = rows.unionByName(ev.assertions(b, ev.Template("cid", (CID, MID)), "bridges"))
    rows = rows.unionByName(ev.assertions(n, ev.Template("mid", (MID, ev.Field("fact", "sensitive", values=("secret", "other"))), state_field="state"), "notes"))
    return ev.evidence(rows, **more).cache()


def joins(df):
    return [r for r in ev.witnesses(df).collect() if r.rule == "numbered_join"]


BASE = ([("001", "甲")], [("001", "M01")], [("M01", "secret", None, False)])


def test_chain_across_files(spark):
    f = facts(spark, *BASE)
    got = joins(f)
    assert len(got) == 1 and len(got[0].chain) == 3
    alone = ev.witnesses(facts(spark, *BASE, by_document=True), by_document=True)
    assert ev.incremental_joins(ev.witnesses(f), alone).filter("rule = 'numbered_join'").count() == 1
    report = ev.graph_report(f, ev.witnesses(f), alone).first()
    assert (report.facts, report.numbered_joins, report.identity_mappings) == (3, 1, 1)


@pytest.mark.parametrize("bridges,notes,n", [
    ([("1", "M01")], BASE[2], 0), (BASE[1] * 3, BASE[2] * 2, 1), (BASE[1], [("M01", "secret", "negative", False)], 0), (BASE[1], [("M01", "secret", None, True)], 0),
    (BASE[1], [("M01", "unlisted", None, False)], 0), (BASE[1], [("M01", "secret", "Odd", False)], 0), (BASE[1], [("M01", "secret", None, False), ("M01", "secret", "negative", False)], 0),
])
def test_perturbed_chains(spark, bridges, notes, n):
    assert len(joins(facts(spark, BASE[0], bridges, notes))) == n


def test_copies_are_one_fact(spark):
    f = facts(spark, BASE[0], BASE[1] * 4, BASE[2])
    assert f.count() == 3 and f.filter("kind = 'relation'").first().n_assertions == 4


def test_empty_keys_fail_the_table(spark):
    with pytest.raises(Exception, match="a key is empty"):
        facts(spark, BASE[0], [("001", "")], BASE[2]).count()


def test_depth_is_no_cut_off(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", f"e{i}") for i in range(7)], "source string, target string, evidence_id string")
    starts = spark.createDataFrame([("n0",)], "source string")
    with pytest.raises(ValueError):
        ev.reach(edges, starts, 6)
    assert ev.reach(edges.filter("source != 'n6'"), starts, 6).count() == 7
    cycle = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2")], edges.schema)
    assert ev.reach(cycle, spark.createDataFrame([("a",)], "source string"), 6).count() == 2


def test_cuts_know_other_routes(spark):
    rows = [("A", None, "identity", "", "name", "id"), ("A", "X", "relation", "", None, "r1"), ("A", "B", "relation", "", None, "r2"), ("B", "X", "relation", "", None, "r3"), ("X", None, "sensitive", "f", "s", "sf")]
    f = spark.createDataFrame([(*r[:5], "positive", r[5], "t", "n", 1) for r in rows], "source string, target string, kind string, field_name string, value string, state string, evidence_id string, entity_type string, namespace string, n_assertions int")
    w = ev.witnesses(f)
    j = w.filter("rule = 'numbered_join'").first()
    assert list(j.chain) == ["id", "r1", "sf"]
    got = {r.cut: r.blocks for r in ev.cuts(w, f).filter("rule = 'numbered_join'").collect()}
    assert got == {"id": True, "r1": False, "sf": True}
    less = f.filter("evidence_id != 'r1'")
    got = {r.cut: r.blocks for r in ev.cuts(ev.witnesses(less), less).filter("rule = 'numbered_join'").collect()}
    assert got == {"id": True, "r2": True, "r3": True, "sf": True}


def test_quasi_profiles(spark):
    t = ev.Template("cid", (CID, ev.Field("city", "quasi"), ev.Field("job", "quasi")))
    rows = [("C1", "深圳", "工程师"), ("C1", "深圳", "工程师"), ("C2", "深圳", "工程师"), ("C3", "上海", "教师"), ("C4", "上海", ""), ("C5", "上海", "医生"), ("C5", "北京", "医生")]
    f = ev.evidence(ev.assertions(spark.createDataFrame(rows, "cid string, city string, job string"), t, "d")).cache()
    got = sorted((r.support, r.population) for r in ev.witnesses(f, ("city", "job")).collect())
    assert got == [(1, 3), (2, 3), (2, 3)]
    assert ev.witnesses(f, ("city", "job"), max_support=1).count() == 1


def test_candidates_are_proposed(spark):
    f = facts(spark, [("1", "张三"), ("2", "张三"), ("3", "李四")], [("1", "M")], BASE[2])
    got = ev.candidates(f).collect()
    assert len(got) == 1 and len(got[0].members) == 2


def test_line_records(spark):
    df = spark.createDataFrame([("id=1;v=a=b\r\n> id=2;v=\n",)], "text string")
    assert {tuple(r) for r in ev.line_records(df, ("id", "v")).collect()} == {("1", "a=b", False), ("2", "", True)}
    for bad in ("id=1;id=2;v=x", "id=1", "id=1;v=2;z=3"):
        with pytest.raises(Exception, match="name"):
            ev.line_records(spark.createDataFrame([(bad,)], "text string"), ("id", "v")).collect()


PLANS = (rl.Plan("cid", "key", required=True), rl.Plan("city", "quasi", "keep"), rl.Plan("job", "quasi", "keep"))


def test_unique_rows_are_suppressed(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "a", "x"), ("3", "b", "y")], "cid string, city string, job string")
    name, out = rl.plan(df, PLANS, ("city", "job"), 2, ["secret"], lambda c: F.concat(F.lit("A_"), F.sha2(c, 256)))
    assert name == "essential_only" and {r.city for r in out.collect()} == {""}


def test_a_smaller_subset_is_found(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "x", ""), ("b", "y", "")], "q1 string, q2 string, q3 string")
    assert {r.subset for r in rl.small_groups(df, ("q1", "q2", "q3"), 2).collect()} >= {"q1+q2"}


def test_values_outside_a_plan_are_refused(spark):
    df = spark.createDataFrame([("1", "a")], "cid string, city string")
    with pytest.raises(ValueError):
        rl.check_allowed(df, (rl.Plan("city", "quasi", "keep", approved=("z",)),))
    with pytest.raises(ValueError):
        rl.check_allowed(df, (rl.Plan("city", "quasi", "generalize", bands=(("z", "band"),)),))


def test_publishing_is_staged(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "cid string, city string")
    at = f"file://{tmp_path}/out"
    assert rl.publish(df, at, lambda b: False) == "NEEDS_REVIEW"
    assert rl.publish(df, at, lambda b: rl.same_rows(b, df)) == "PUBLISHED"
    with pytest.raises(ValueError):
        rl.publish(df, at, lambda b: True)
    assert rl.manifest(spark, at).filter("name like 'part-%'").count() >= 1


def test_diff_and_renames(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "9"), ("f", "9")], "k string, d string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "3"), ("g", "9")], "k string, d string")
    assert {(r.k, r.change) for r in ic.diff(old, new, "k", "d").collect()} == {("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added"), ("e", "removed"), ("f", "removed"), ("g", "added")}
    assert [tuple(r) for r in ic.renames(old, new, "k", "d").collect()] == [("c", "d")]


def test_decisions_and_undo(spark):
    log = [(1, "r", "a", False), (2, "r", "b", False), (3, "r", None, True), (1, "s", "a", False), (2, "s", None, True), (3, "s", None, True), (4, "s", "c", False), (5, "s", None, True), (1, "t", "x", False)]
    got = {r.row_id: r.state for r in ic.decisions(spark.createDataFrame(log, "seq int, row_id string, state string, undo boolean")).collect()}
    assert got == {"r": "a", "s": "pending", "t": "x"}


def test_journal_gaps_are_errors(spark):
    df = spark.createDataFrame([(5,)], "usn int")
    for args in ((0, 9, 3, "j", "j"), (4, 9, 3, "j", "k")):
        with pytest.raises(ValueError):
            ic.change_range(df, *args)


def test_rates_are_null_without_cases(spark):
    none = spark.createDataFrame([], "k int")
    r = el.set_score(none, none, ["k"]).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, None, None, None)
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    r = el.multiset_score(a, b, ["k"]).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 2)


def test_claims_need_one_identity(spark):
    known = spark.createDataFrame([("ann", "k1", "t1"), ("bob", "k2", "t1"), ("cy", "k3", "t3"), ("", "k4", "t4")], "identity string, key string, topic string")
    subjects = spark.createDataFrame([("k1", "t9"), ("s2", "t1"), ("s3", "t3"), ("s4", ""), ("k4", "t4")], "subject string, topic string")
    assert {tuple(r) for r in el.background_claims(known, subjects).collect()} == {("k1", "ann"), ("s3", "cy")}


def test_claims_meet_no_pairs(spark):
    """Subjects and identities that share one topic are not joined with each other: 4,000 of each would be 16 million rows."""
    n = 4000
    known = spark.range(n).selectExpr("'i' || id AS identity", "'k' || id AS key", "CASE WHEN id = 7 THEN 'own' ELSE 'all' END AS topic")
    subjects = spark.range(n).selectExpr("CASE WHEN id < 20 THEN 'k' || id ELSE 's' || id END AS subject", "CASE WHEN id % 10 = 1 THEN 'own' WHEN id % 10 = 2 THEN '' ELSE 'all' END AS topic")
    claims = el.background_claims(known, subjects)
    want = {(f"s{i}", "i7") for i in range(20, n) if i % 10 == 1} | {("k2", "i2"), ("k12", "i12")}
    assert {tuple(r) for r in claims.collect()} == want
    most = 0
    todo = [claims._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            todo.append(plan.plan())
        if plan.metrics().contains("numOutputRows") and "Join" in plan.nodeName():
            most = max(most, plan.metrics().apply("numOutputRows").value())
        kids = plan.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert most <= 2 * n


def test_replies_must_match_the_batch(spark):
    batch, reply = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "NONE")], "id int, verdict string")
    assert {tuple(r) for r in el.merge_verdicts(batch, reply).collect()} == {(1, "NONE"), (2, None)}
    for bad in ([(9, "x")], [(1, "x"), (1, "y")]):
        with pytest.raises(ValueError):
            el.merge_verdicts(batch, spark.createDataFrame(bad, reply.schema))


def test_stream_equals_batch(spark, tmp_path):
    from duskline.streaming import changes as st

    rows = [(1, 1, "a", False), (2, 2, "b", False), (1, 3, "c", False), (2, 4, "b", True), (3, 5, "d", False)]
    df = spark.createDataFrame(rows, "id int, usn int, v string, deleted boolean")
    for i in range(2):
        df.filter(F.col("usn") % 2 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = st.read_changes(spark, f"{tmp_path}/in/*", df.schema, 1)
    q = st.keep_snapshot(stream, f"{tmp_path}/t", f"{tmp_path}/c")
    got = {tuple(r) for r in st.last_snapshot(spark, q, f"{tmp_path}/t").select("id", "usn", "v").collect()}
    assert (1, 3, "c") in got and (3, 5, "d") in got


def test_late_changes_reach_the_end_of_the_log(spark, sf_dir, tmp_path):
    from duskline.plans.incremental import late_changes_to_end

    events = [(r.event_id, r.user_id) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    allowed = {r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect() if r.c_custkey % 2 == 0}
    events += [(max(events)[0] + 5000, min(allowed))]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k,) for k in allowed], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = sorted((e, u) for e, u in events if e >= 100 and u in allowed)
    assert sorted(map(tuple, late_changes_to_end(spark, str(tmp_path)).collect())) == want and want[-1] == events[-1]
    spark.createDataFrame([], "event_id long, user_id long").write.parquet(f"{tmp_path}/none/events.parquet")
    spark.createDataFrame([(2,)], "c_custkey long").write.parquet(f"{tmp_path}/none/customer.parquet")
    assert late_changes_to_end(spark, f"{tmp_path}/none").count() == 0


@pytest.fixture()
def written(monkeypatch):
    """(tag, rows) of every table that the operators of this module write."""
    rows, write = [], ev.materialize

    def counted(df, tag):
        out = write(df, tag)
        rows.append((tag, out.count()))
        return out

    monkeypatch.setattr(ev, "materialize", counted)
    return rows


def test_cuts_of_a_star_walk_no_other_ray(spark, written):
    n = 200
    f = facts(spark, [("c", "name")], [("c", f"m{i}") for i in range(n)], [(f"m{i}", "secret", None, False) for i in range(n)])
    got = ev.cuts(ev.witnesses(f), f).groupBy("rule").agg(F.count("*").alias("n"), F.count_if("blocks").alias("b")).collect()
    assert {tuple(r) for r in got} == {("identity_mapping", 1, 1), ("numbered_join", 3 * n, 3 * n)}
    assert max(rows for _, rows in written) <= 3 * n


def test_written_facts_know_what_is_denied(spark, written):
    notes = [("M01", "secret", s, q) for s, q in ((None, False), ("negative", False))] + [("M02", "secret", None, True), ("M02", "other", "Odd", False), ("M02", "other", None, False)]
    world = ([("001", "甲")], [("001", "M01"), ("001", "M02"), ("001", "M02")], notes)
    plain, kept = facts(spark, *world), facts(spark, *world, written=True)
    rows = lambda df: sorted(map(str, df.select(plain.columns).collect()))
    assert rows(plain) == rows(kept) and rows(ev.active(plain)) == rows(ev.active(kept))
    assert ev.conflicts(kept).first() == ev.conflicts(plain).first() == (1,)
    key = lambda df: sorted((r.rule, r.subject, r.endpoint, tuple(r.chain)) for r in df.collect())
    assert key(ev.witnesses(plain)) == key(ev.witnesses(kept)) and len(joins(kept)) == 1


def test_only_rules_asked_for_are_worked_out(spark, sf_dir, written):
    from duskline.plans import evidence as plan

    assert plan.quasi_combinations(spark, sf_dir).count() and [t for t, _ in written] == ["facts"]
    facts_ = written.pop()[1]
    assert plan.facts_by_state(spark, sf_dir).count() == 4 and plan.conflicting_facts(spark, sf_dir).first().conflicts and [t for t, _ in written] == ["facts"] * 2
    written.clear()
    assert plan.numbered_joins(spark, sf_dir).count()
    assert sum(n for _, n in written) < 2 * facts_  # claims once, and each walked edge once
