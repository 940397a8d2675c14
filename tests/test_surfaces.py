"""A caller's detectors and attackers, splits, and corrections replayed as joins."""

import random

import pytest
from pyspark.sql import functions as F

from duskline.functions import lexicon as lx
from duskline.operators import detect, evaluate, incremental, inventory


def test_callers_detectors_run_in_signals_and_are_scored(spark):
    paths = spark.createDataFrame([("secret-7/zebra.txt", False, 1), ("secret-7/plain.txt", False, 1), ("alice@x.org/zebra", False, 1)], "relpath string, is_dir boolean, size long")
    seen = []

    def zebras(strings):
        return strings.filter("text like 'zebra%'").select("text", F.lit("ANIMAL").alias("category"), F.lit("zebra").alias("surface"))

    def model(strings):
        seen.append({r.text for r in strings.collect()})
        return strings.select("text", F.lit("OTHER").alias("category"), F.substring("text", 1, 3).alias("surface"))

    entries = inventory.entries(paths)
    got = detect.signals(entries, lx.Rules(), context=False, detectors=[detect.Detector("late one", model, "late"), detect.Detector("zoo", zebras)])
    rows = got.join(entries.select("entry_id", "relpath"), "entry_id").select("relpath", "category", "surface", "source")
    assert seen == [{"secret-7", "plain.txt"}] or "secret-7" not in seen[0]
    assert {(r.relpath, r.surface) for r in rows.filter("source = 'zoo'").collect()} == {("secret-7/zebra.txt", "zebra"), ("alice@x.org/zebra", "zebra")}
    assert {r.surface for r in rows.filter("source = 'late one'").collect()} == {t[:3] for t in seen[0]}
    gold = spark.createDataFrame([("secret-7/zebra.txt", "ANIMAL", "zebra"), ("nowhere", "ANIMAL", "zebra")], "relpath string, category string, surface string")
    score = evaluate.set_score(gold, rows.filter("source = 'zoo'"), ["relpath", "category", "surface"]).first()
    assert (score.tp, score.fp, score.fn) == (1, 1, 1)
    for bad in (lambda s: s, lambda s: s.select("text", F.lit("A").alias("category"), F.lit("not there").alias("surface"))):
        with pytest.raises(Exception, match="returned|not there"):
            detect.signals(entries, lx.Rules(), detectors=[detect.Detector("bad", bad)]).collect()
    with pytest.raises(ValueError):
        detect.Detector("x", zebras, "never")


def test_attackers_and_splits(spark):
    cases = spark.createDataFrame([("a", "holdout"), ("b", "holdout"), ("c", "development")], "case_id string, split string")
    chosen = evaluate.selected_split(cases, "holdout")
    gold = spark.createDataFrame([("a", "x"), ("b", "y")], "case_id string, claim string")
    guess = lambda c: c.select("case_id", F.explode(F.array(F.lit("x"), F.lit("x"), F.lit("z"), F.lit(None))).alias("claim")).filter("case_id = 'a'")
    got = {r.case_id: (r.status, r.correct, r.claims) for r in evaluate.attack(chosen, guess, gold).collect()}
    assert got == {"a": ("completed", 1, 2), "b": ("completed", 0, 0)}

    def down(_):
        raise RuntimeError

    assert {r.status for r in evaluate.attack(chosen, down, gold).collect()} == {"failed"}
    with pytest.raises(Exception, match="not given"):
        evaluate.attack(chosen, lambda c: spark.createDataFrame([("q", "x")], "case_id string, claim string"), gold).collect()
    for rows, split in (([("a", "holdout"), ("a", "development")], "holdout"), ([("a", None)], "holdout"), ([("a", "holdout")], "all")):
        with pytest.raises(ValueError):
            evaluate.selected_split(spark.createDataFrame(rows, "case_id string, split string"), split)


def one_by_one(base, events):
    """Corrections applied one after the other to every occurrence."""
    now, gone = dict(base), set()
    for n, e in enumerate(events):
        if e["kind"] == "confirm":
            now = {o: min(e["entities"]) if x in e["entities"] else x for o, x in now.items()}
            gone -= set(e["entities"])
        elif e["kind"] == "split":
            for o in e["occurrences"]:
                own = f"SPLIT_{o}"
                now[o] = own if own not in e["used"] else f"{own}_{n}"
                e["used"].add(now[o])
        elif e["kind"] == "reject":
            gone |= set(e["entities"])
    return {o: x for o, x in now.items() if x not in gone}


def test_a_thousand_corrections_are_two_joins(spark):
    rng = random.Random(9)
    base = {f"o{i}": f"e{i % 40:02d}" for i in range(200)}
    live, used, events, now = set(base.values()), set(), [], dict(base)
    for n in range(1000):
        kind = rng.choice(["confirm", "split", "reject", "reject_assertion"])
        e = {"kind": kind, "version": n}
        if kind == "confirm":
            e["entities"] = rng.sample(sorted(live), min(len(live), rng.randrange(1, 4)))
        elif kind == "split":
            e |= {"occurrences": rng.sample(sorted(base), 2), "used": used}
        elif kind == "reject":
            e["entities"] = [rng.choice(sorted(live))] if rng.random() < 0.2 else [f"none{n}"]
        else:
            e["assertions"] = [f"a{n}"]
        events.append(e)
        if kind == "confirm":
            live -= set(e["entities"]) - {min(e["entities"])}
        elif kind == "split":
            for o in e["occurrences"]:
                own = f"SPLIT_{o}"
                live.add(own if own not in used else f"{own}_{n}")
                used.add(own if own not in used else f"{own}_{n}")
    used.clear()
    want = one_by_one(now, [{**e, "used": used} if e["kind"] == "split" else e for e in events])
    df = spark.createDataFrame([(o, x, 1) for o, x in base.items()], "occurrence_id string, entity_id string, extra int")
    plain = [{k: v for k, v in e.items() if k != "used"} for e in events]
    got = incremental.replay(df, plain)
    assert {r.occurrence_id: r.entity_id for r in got.collect()} == want and got.columns == df.columns
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    facts = spark.createDataFrame([("a3",), ("z",)], "evidence_id string")
    assert {r[0] for r in incremental.reject_assertions(facts, [{"kind": "reject_assertion", "assertions": ["a3"]}]).collect()} == {"z"}
    for bad in ([{"kind": "confirm", "entities": ["a", "b"]}, {"kind": "reject", "entities": ["b"]}], [{"kind": "split", "occurrences": []}], [{"kind": "reject", "entities": ["a"], "version": 4}], [{"kind": "x", "entities": ["a"]}]):
        with pytest.raises(ValueError):
            incremental.replay(df, bad)
