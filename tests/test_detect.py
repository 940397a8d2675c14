import pytest
from pyspark.sql import functions as F

from duskline.functions import lexicon as lx
from duskline.functions import script
from duskline.functions.text import edited, latin_names, normalize, source_span, syllables
from duskline.operators import detect
from duskline.operators import inventory as iv


def found(spark, names, rules=None, column=None):
    rules = rules or lx.Rules()
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select("name", F.explode(column(rules) if column else detect.ordinary("name", rules)).alias("f")).select("name", "f.category", "f.surface").collect()
    out = {n: set() for n in names}
    for r in rows:
        out[r.name].add((r.category, r.surface))
    return out


def test_numbers_and_addresses(spark):
    got = found(spark, ["联系13812345678.txt", "phone13812345678backup.txt", "编号110101199003078823.pdf", "QQ123456789.txt"])
    assert ("PATTERN", "13812345678") in got["联系13812345678.txt"]
    assert ("PATTERN", "13812345678") in got["phone13812345678backup.txt"]
    assert ("PATTERN", "110101199003078823") in got["编号110101199003078823.pdf"]
    assert not got["QQ123456789.txt"]
    assert ("PATTERN", "123456789") in found(spark, ["QQ123456789.txt"], lx.Rules(paranoid=True))["QQ123456789.txt"]


def test_organisations_and_names(spark):
    got = found(spark, ["Acme Inc contract.pdf", "软件工程师-招聘需求.docx", "张三-论文", "John Smith resume.docx", "New Folder", "Hello World.txt", "方法-总结", "任务管理器", "高清电影", "王者荣耀攻略"])
    assert ("ORG", "Acme Inc") in got["Acme Inc contract.pdf"]
    assert ("PROFESSION", "工程师") in got["软件工程师-招聘需求.docx"]
    assert {("PERSON", "张三"), ("KEYWORD", "论文")} <= got["张三-论文"]
    assert {("PERSON", "John Smith"), ("IDENTITY", "resume")} <= got["John Smith resume.docx"]
    for n in ("New Folder", "Hello World.txt", "方法-总结", "任务管理器", "高清电影", "王者荣耀攻略"):
        assert not {f for f in got[n] if f[0] == "PERSON"}


def test_words_inside_other_words_are_not_found(spark):
    got = found(spark, ["LICENSE-MIT", "cache", "cookie.json", "ＣＯＯＫＩＥ.json", "visage.png", "COO_salary.csv", "visa-2026.pdf", "ＣＯＯ_任命.txt", "裏番合集.txt"])
    for n in ("LICENSE-MIT", "cache", "cookie.json", "ＣＯＯＫＩＥ.json", "visage.png"):
        assert not got[n]
    assert {("PROFESSION", "COO"), ("IDENTITY", "salary")} <= got["COO_salary.csv"]
    assert ("IDENTITY", "visa") in got["visa-2026.pdf"]
    assert ("PROFESSION", "ＣＯＯ") in got["ＣＯＯ_任命.txt"]
    assert ("KEYWORD", "裏番") in got["裏番合集.txt"]


def test_precedence_of_categories(spark):
    rules = lx.Rules(terms={"KEYWORD": ["甲乙"], "NAME_LIST": ["甲乙", "丙丁"], "ORG": ["丙丁"]})
    got = found(spark, ["甲乙", "丙丁"], rules, lambda r: detect.terms("name", r))
    assert got == {"甲乙": {("KEYWORD", "甲乙")}, "丙丁": {("ORG", "丙丁")}}


def test_dates_and_places(spark):
    got = found(spark, ["2024-06-17住院", "2024年06月", "2024年", "2024年6月17日2023年", "北京市海淀区", "上海"], column=lambda r: F.concat(detect.dates("name"), detect.locations("name")))
    assert got["2024-06-17住院"] == {("DATE_DAY", "2024-06-17")}
    assert got["2024年06月"] == {("DATE_MONTH", "2024年06月")}
    assert got["2024年"] == {("DATE_YEAR", "2024年")}
    assert got["2024年6月17日2023年"] == {("DATE_DAY", "2024年6月17"), ("DATE_YEAR", "2023年")}
    assert got["北京市海淀区"] == {("LOCATION_DISTRICT", "北京市海淀区")}
    assert got["上海"] == {("LOCATION_CITY", "上海")}


def test_distinct_components_are_joined_back(spark):
    e = spark.createDataFrame([("a", ["x", "张三"]), ("b", ["张三", "张三"]), ("c", [None, "plain"])], "entry_id string, parts array<string>")
    got = {(r.entry_id, r.component_index, r.category) for r in detect.signals(e, lx.Rules()).collect()}
    assert got == {("a", 1, "PERSON"), ("b", 0, "PERSON"), ("b", 1, "PERSON")}


def test_late_stage_uses_the_cache_and_stops_after_failures(spark):
    cache = spark.createDataFrame([("m", "a", "NONE"), ("other", "b", "PERSON")], "namespace string, name string, label string")
    work = spark.createDataFrame([("a",), ("b",)], "name string")

    def classify(names):
        return ["ASKED" for _ in names]

    got = {(r.name, r.label) for r in detect.late_stage(work, "name", cache, "m", classify).collect()}
    assert got == {("a", "NONE"), ("b", "ASKED")}

    def down(names):
        raise RuntimeError("down")

    assert {r.name for r in detect.late_stage(work, "name", cache, "m", down).collect()} == {"a"}


def test_unknown_rules_are_errors():
    assert lx.Rules.load({"terms": {"NAME_LIST": ["x"]}, "k": 5}).k == 5
    assert {"R18", "y"} <= set(lx.Rules.load({"terms": {"KEYWORD": ["y"]}}).terms["KEYWORD"])
    with pytest.raises(ValueError):
        lx.Rules.load({"nonsense": 1})


def test_normalisation_maps_back(spark):
    simple = script.to_simplified()
    text, runs = normalize("Ａb學ﬁx", simple)
    assert text == "ab学fix"
    assert source_span(runs, 0, 2) == (0, 2)
    assert source_span(runs, 3, 4) == (3, 4)
    assert normalize("", simple) == ("", [])
    assert normalize("Straße", simple)[0] == "strasse"


def test_edits_do_not_cascade():
    assert edited("abcabc", [(0, 2, "X"), (1, 3, "Y"), (3, 4, "abc")]) == "Xcabcbc"


def test_latin_names(spark):
    names = latin_names(["Ma Li"])
    found = names.find
    assert found("LICENSE-Li-Si.txt") == ["Li-Si"]
    assert "ZhangSan" in found("license-ZhangSan.txt")
    assert "zhangsan" in found("LICENSE-zhangsan.txt")
    assert found("cache license machine") == [] and found("Liu Go") == [] and found("MaLi") == [] and found("li ne") == ["li ne"]
    assert found("OuyangFeng") == ["OuyangFeng"] and found("San Zhang") == ["San Zhang"] and found("Zhang Xiao Ming wrote") == ["Zhang Xiao Ming"]
    assert found("lime") == found("Li_Me") == []
    assert names.count("xiaoming") == 2 and names.count("qwrt") == 0
    assert {"zhang", "xiong", "lve", "er", "zhuang"} <= syllables() and not {"go", "ro", "sho", "tiang"} & syllables()


def test_latin_names_are_found_in_a_scan(spark):
    got = found(spark, ["report-ZhangSan.txt", "notes li si.md", "plain words", "Ｂｏｂ 報告"])
    assert got["report-ZhangSan.txt"] == set()  # as a column alone, detectors know no names in Latin script
    e = spark.createDataFrame([("a", ["report-ZhangSan.txt"]), ("b", ["notes li si.md", "plain words"])], "entry_id string, parts array<string>")
    rows = {(r.entry_id, r.category, r.surface, r.normalized) for r in detect.signals(e, lx.Rules()).collect()}
    assert rows == {("a", "PERSON", "ZhangSan", "zhangsan"), ("b", "PERSON", "li si", "li si")}
    assert not detect.signals(e, lx.Rules(latin_names=False)).collect()


def test_values_are_compared_folded(spark):
    e = spark.createDataFrame([("a", ["Ｂｏｂ"]), ("b", ["Bob"])], "entry_id string, parts array<string>")
    rows = detect.signals(e, lx.Rules(terms={"NAME_LIST": ["Bob"]})).collect()
    assert {r.normalized for r in rows} == {"bob"} and len(rows) == 2


def test_all_documents_are_normalized(spark, tmp_path):
    """Each place of the view leads to the source it was made from, in texts that are not ASCII too."""
    import unicodedata

    from duskline.functions.text import source_span
    from duskline.plans.detection import normalize_documents

    simple = script.to_simplified()
    view = lambda t: "".join(simple.get(c, c) for c in unicodedata.normalize("NFKC", t).casefold())
    texts = ["Plain ASCII", "Straße ÉTÉ", "cafe\u0301 ＡＢ１", "ﬁle Ⅳ", "北京大學", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in normalize_documents(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and got[6].view is None and got[6].runs is None
    for i, t in enumerate(texts[:-1]):
        assert got[i].view == view(t)
        runs = [tuple(r) for r in got[i].runs]
        assert [p for r in runs for p in range(r[2], r[3])] == list(range(len(t)))
        for k, c in enumerate(got[i].view):
            a, b = source_span(runs, k, k + 1)
            assert c in view(t[a:b])


def test_components_are_dealt_to_all_tasks_and_looked_at_once(spark):
    e = iv.entries(spark.range(2000).select(F.concat(F.lit("a/报告-"), F.col("id").cast("string"), F.lit("-zhang wei.txt")).alias("relpath")), is_dir=None, size=None)
    parts = e.select(F.explode("parts").alias("part"))
    found = detect.findings(parts, "part", detect.ordinary("part", lx.Rules()), lx.Rules(), short=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line]
    assert found.filter("source = 'latin_names'").count() == 2000
    looked = detect.findings(parts, "part", detect.terms("part", lx.Rules()), short=True)
    assert "REPARTITION_BY_NUM" in looked._jdf.queryExecution().executedPlan().toString()


def test_terms_are_those_of_the_plain_alternation(spark):
    rules = lx.Rules(terms={**lx.Rules().terms, "ORG": ["學A", "𠮷野", "ßA", "[x"], "NAME_LIST": ["学生会长", "İz", "k"]})
    known = lx.term_categories(rules)
    plain = "|".join(lx.term_pattern(t, c) for t, c in sorted(known.items(), key=lambda x: (-len(x[0]), x[0])))
    every = sorted(known)
    texts = [" ".join(every), "".join(every), "".join(reversed(every)).swapcase(), " ".join(every).upper(), "学生会 学 ſalary \u212a aCEO ceo.CTO ＣＥＯ İZ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(*[F.regexp_extract_all("t", F.lit("(?iu)" + p), F.lit(0)).alias(n) for n, p in (("a", plain), ("b", lx.alternation(known)))]).collect()
    assert all(r.a == r.b and r.a for r in got)
    # a place in a text meets few alternatives: without their runs all are tried, one after the other
    assert lx.alternation(known).count("(?=") > 10
