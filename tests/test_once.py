"""What makes the rows of a costly step is worked out once."""

from pyspark.sql import functions as F

from duskline.operators import evidence as ev
from duskline.operators import graph


def counted(spark, df):
    """df, and a count of the rows that were made for whatever reads it."""
    n = spark.sparkContext.accumulator(0)

    def through(frames):
        for pdf in frames:
            n.add(len(pdf))
            yield pdf

    return df.mapInPandas(through, df.schema), n


def test_components_read_their_edges_once(spark):
    edges, n = counted(spark, spark.createDataFrame([(1, 2), (3, 2), (2, 2), (4, 4), (None, 5), (7, 6)], "src int, dst int"))
    assert sorted(tuple(r) for r in graph.connected_components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (6, 6), (7, 6)]
    assert n.value == 6


def test_facts_keep_their_part_under_the_same_ids(spark):
    schema = "document_id string, source string, target string, kind string, field_name string, value string, state string, entity_type string, namespace string, component string"
    rows = spark.createDataFrame([(f"d{i}{g}", f"p{g}", t, k, "f", v, "positive", "t", "n", f"c{g}") for g in "ab" for i, (t, k, v) in enumerate([(None, "identity", "x"), (f"e{g}", "relation", None)])]
                                 + [(f"s{g}", f"e{g}", None, "sensitive", "flag", "y", "positive", "t", "n", f"c{g}") for g in "ab"], schema)
    plain = ev.witnesses(ev.evidence(rows.drop("component")))
    parted = ev.witnesses(ev.evidence(rows, written=True, part=("component",)), part=("component",))
    assert {r.component for r in parted.collect()} == {"ca", "cb"}
    assert all(r.component == "c" + r.subject[1:] for r in parted.select("component", "subject").collect())
    assert sorted(map(tuple, parted.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert plain.filter(F.col("rule") == "numbered_join").count() == 2


def test_plain_characters_are_normalised_in_runs(monkeypatch):
    from duskline.functions import text as tx

    n = tx.Normalizer({"學": "学"})
    assert n("éX") == ("éx", [(0, 1, 0, 2, False), (1, 2, 2, 3, True)])
    asked, known = [], tx.unicodedata.normalize
    monkeypatch.setattr(tx.unicodedata, "normalize", lambda form, x: asked.append(x) or known(form, x))
    view, runs = n("Ａb學 " * 1000 + "ﬁé")
    assert view == "ab学 " * 1000 + "fié" and runs == [(0, 4000, 0, 4000, True), (4000, 4002, 4000, 4001, False), (4002, 4003, 4001, 4003, False)]
    assert asked == ["ﬁ", "é"]


def test_words_of_names_are_looked_at_once(monkeypatch):
    from duskline.functions import text as tx

    finder, asked = tx.LatinNames(frozenset({"wei", "min"}), frozenset({"wang", "li"})), []
    known = tx.LatinNames.mark
    monkeypatch.setattr(tx.LatinNames, "mark", lambda self, word: asked.append(word) or known(self, word))
    assert finder.find("Wang Wei, wangwei; the li the " * 50) == ["Wang Wei", "wangwei"]
    assert len(asked) == 5
