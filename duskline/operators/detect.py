"""Detectors of sensitive text: each distinct string is looked at once, and findings are joined back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import find_latin_names, folded, latin_names
from ..session import spread

#: Java reads \d, \w and \b as ASCII unless told otherwise.
UNICODE = "(?U)"


def _all(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def _tagged(surfaces: Column, category: Column | str, source: str) -> Column:
    """Findings of one category from an array of surfaces."""
    return F.transform(surfaces, lambda s: F.struct((category(s) if callable(category) else F.lit(category)).alias("category"), s.alias("surface"), F.lit(source).alias("source")))


def terms(text: str, rules: lx.Rules) -> Column:
    """Keywords, listed names and organisations, professions and identity terms, longest first, in one pass."""
    known = lx.term_categories(rules)
    if not known:
        return F.array().cast("array<struct<category:string,surface:string,source:string>>")
    # letters that Java's case folding takes for others, as the pattern does
    fold = lambda x: F.lower(F.translate(x, "\u0130\u017f\u212a", "isk"))
    by_fold: dict[str, str] = {}
    for t in sorted(known, key=lambda t: lx.TERM_ORDER.index(known[t])):
        by_fold.setdefault(t.translate(str.maketrans("\u0130\u017f\u212a", "isk")).lower(), known[t])
    table = F.create_map(*[F.lit(x) for pair in by_fold.items() for x in pair])

    def category(s: Column) -> Column:
        return F.element_at(table, fold(s))

    return _tagged(_all(text, "(?iu)" + lx.alternation(known)), category, "terms")


def patterns(text: str, rules: lx.Rules) -> Column:
    """Mobile numbers, identity cards, emails; in paranoid mode account and card numbers too."""
    every = {**rules.patterns, **(lx.PARANOID_PATTERNS if rules.paranoid else {})}
    return F.concat(*[_tagged(_all(text, UNICODE + p), "PATTERN", "patterns") for p in every.values()])


def organisations(text: str, rules: lx.Rules) -> Column:
    suffix = "|".join(sorted(rules.organisation_ends, key=len, reverse=True))
    found = [_tagged(_all(text, UNICODE + lx.ENGLISH_ORG), "ORG", "organisations")]
    if suffix:
        found.insert(0, _tagged(_all(text, f"[一-鿿]{{2,15}}?(?:{suffix})"), "ORG", "organisations"))
    return F.concat(*found)


def english_names(text: str) -> Column:
    """Pairs of capitalised words of which one is a listed given name and the other a listed family name."""
    given, family = F.array(*map(F.lit, lx.GIVEN_NAMES)), F.array(*map(F.lit, lx.FAMILY_NAMES))

    def pair(s: Column) -> Column:
        a, b = (F.lower(F.regexp_extract(s, "^([A-Za-z]+).([A-Za-z]+)$", i)) for i in (1, 2))
        has = F.array_contains
        return (has(given, a) & has(family, b)) | (has(family, a) & has(given, b))

    return _tagged(F.filter(_all(text, UNICODE + lx.NAME_PAIR), pair), "PERSON", "english_names")


def surnames(text: str) -> Column:
    """A surname with one or two characters, no Chinese character on either side, no common word."""
    body = f"(?:(?:{'|'.join(lx.COMPOUND_SURNAMES)})[一-鿿]{{1,2}}|[{lx.SINGLE_SURNAMES}][一-鿿]{{1,2}})"
    found = _all(text, f"(?<![一-鿿]){body}(?![一-鿿])")
    name = lambda s: ~s.isin(*lx.NOT_NAMES) & ~F.substring(s, 2, 9).rlike(f"[{lx.NAME_STOPS}]")
    return _tagged(F.filter(found, name), "PERSON", "surnames")


def dates(text: str) -> Column:
    """Days, then months, then years, none inside a longer one: what was found is blanked before the next look.

    What is put in its place starts with a digit and ends without one, as a date does for what stands beside it.
    """
    left, found = F.col(text), []
    for category, pattern in lx.DATE_PATTERNS.items():
        found.append(_tagged(F.regexp_extract_all(left, F.lit(UNICODE + pattern), F.lit(0)), category, "dates"))
        left = F.regexp_replace(left, UNICODE + pattern, "0")
    return F.concat(*found)


def locations(text: str) -> Column:
    """Administrative places with their rank, and municipalities outside of them."""

    def rank(s: Column) -> Column:
        return F.when(s.rlike("(?:区|區|县|縣|自治州)$"), "LOCATION_DISTRICT").when(s.endswith("市"), "LOCATION_CITY").otherwise("LOCATION_PROVINCE")

    admin = _tagged(_all(text, lx.ADMIN_PLACE), rank, "locations")
    rest = F.regexp_replace(F.col(text), lx.ADMIN_PLACE, "")
    return F.concat(admin, _tagged(F.regexp_extract_all(rest, F.lit(lx.MUNICIPALITY), F.lit(0)), "LOCATION_CITY", "locations"))


def context_terms(text: str) -> Column:
    out = []
    for category, words in lx.CONTEXT_TERMS.items():
        alt = "|".join(sorted(lx.expand_terms(words), key=lambda t: (-len(t), t)))
        out.append(_tagged(_all(text, "(?iu)" + alt), category, "context"))
    return F.concat(*out)


def ordinary(text: str, rules: lx.Rules) -> Column:
    """All findings that name or mask something by themselves, but names in Latin script, which findings adds."""
    return F.concat(terms(text, rules), patterns(text, rules), organisations(text, rules), english_names(text), surnames(text))


def contextual(text: str) -> Column:
    """Findings that only matter together: dates, places, terms of domains."""
    return F.concat(dates(text), locations(text), context_terms(text))


def findings(strings: DataFrame, column: str, found: Column, names: lx.Rules | None = None, short: bool = False) -> DataFrame:
    """Rows (string, category, surface, source) of each distinct string of the column. With names, names in Latin script
    are looked for too, by a Python function that only strings which may hold one reach. Short strings, many in few bytes,
    are dealt to all tasks before they are looked at."""
    distinct = strings.filter(F.col(column).isNotNull()).select(column).distinct()
    distinct = spread(distinct, column) if short else distinct
    out = distinct.select(column, F.explode(F.array_distinct(found)).alias("f")).select(column, "f.*")
    if names is None or not names.latin_names:
        return out
    # no filter, which would be pushed below the distinct and look at every string as often as it stands
    able = F.when(F.col(column).rlike(latin_names(names.no_names).possible()), F.col(column))
    named = distinct.select(column, F.explode(find_latin_names(able, names.no_names)).alias("surface"))
    named = named.select(column, F.lit("PERSON").alias("category"), "surface", F.lit("latin_names").alias("source"))
    # a surface that is a term or a name already is not found again
    return out.unionByName(named).groupBy(column, "category", "surface").agg(F.max("source").alias("source"))


@dataclass(frozen=True)
class Detector:
    """A caller's detector: find takes distinct strings (text) and returns rows (text, category, surface) of them.

    An early one gets every string, a late one those in which neither the rules nor an early one found anything, which is
    the place of costly models. A name is one detector's, and the source of what it finds.
    """

    name: str
    find: Callable[[DataFrame], DataFrame]
    stage: str = "early"

    def __post_init__(self):
        if self.stage not in ("early", "late") or not self.name:
            raise ValueError("a detector needs a name, and is early or late")


def run_detectors(strings: DataFrame, column: str, found: DataFrame, detectors: list[Detector]) -> DataFrame:
    """found (column, category, surface, source) with what detectors add. A finding that is there already is not added;
    columns beyond the three, null ones and surfaces that are not in their string are an error of the detector."""
    if len({d.name for d in detectors}) != len(detectors):
        raise ValueError("two detectors have one name")
    distinct = strings.filter(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    for stage in ("early", "late"):
        own = [d for d in detectors if d.stage == stage]
        given = distinct if stage == "early" else distinct.join(found.select(F.col(column).alias("text")).distinct(), "text", "left_anti")
        for d in own:
            rows = d.find(given)
            if set(rows.columns) != {"text", "category", "surface"}:
                raise ValueError(f"{d.name} returned {rows.columns}")
            bad = F.lit(False)
            for c in ("text", "category", "surface"):
                bad = bad | F.col(c).isNull()
            bad = bad | ~F.coalesce(F.contains("text", "surface"), F.lit(False)) | (F.col("surface") == "")
            # a filter, so that no query can leave the check out
            rows = rows.filter(F.when(bad, F.raise_error(F.lit(f"{d.name} found what is not there")).cast("boolean")).otherwise(True)).distinct()
            rows = rows.join(distinct, "text", "left_semi").withColumnRenamed("text", column)
            new = rows.join(found.select(column, "category", "surface"), [column, "category", "surface"], "left_anti")
            found = found.unionByName(new.withColumn("source", F.lit(d.name)))
    return found


def signals(entries: DataFrame, rules: lx.Rules, context: bool = True, detectors: list[Detector] | None = None) -> DataFrame:
    """Rows (entry_id, component_index, category, surface, normalized, source) for entries (entry_id, parts).

    Path components repeat over entries, so detectors run on the distinct ones and a join brings their
    findings back: one long component in a million paths is looked at once. detectors are the caller's own.
    """
    exploded = entries.select("entry_id", F.posexplode("parts").alias("component_index", "part"))
    found = F.concat(ordinary("part", rules), contextual("part")) if context else ordinary("part", rules)
    once = findings(exploded, "part", found, rules, short=True)
    if detectors:
        once = run_detectors(exploded, "part", once, detectors)
    once = once.withColumn("normalized", folded("surface"))
    return exploded.join(once, "part").select("entry_id", "component_index", "category", "surface", "normalized", "source")


def unmatched(strings: DataFrame, column: str, found: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct strings without any finding, for a late and costly stage; `most` bounds how many it is given."""
    left = strings.select(column).distinct().join(found.select(column).distinct(), column, "left_anti")
    return left.orderBy(column).limit(most) if most else left


def late_stage(work: DataFrame, column: str, cache: DataFrame, namespace: str, classify, batch: int = 20) -> DataFrame:
    """Verdicts (namespace, name, label): from the cache where it has them, else of `classify`.

    classify takes a list of at most `batch` names and returns their labels in order; two batches in a row
    that fail end a task's work, and what was not asked stays without a verdict. No model comes with
    the package: a caller brings one.
    """
    known = cache.filter(F.col("namespace") == namespace).select(F.col("name"), "label")
    names = work.select(F.col(column).alias("name")).distinct()
    miss = names.join(known, "name", "left_anti")

    def ask(frames):
        failed = 0
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                if failed >= 2:
                    return
                try:
                    labels, failed = classify(part["name"].tolist()), 0
                except Exception:  # a model that is down must not take the scan with it
                    failed += 1
                    continue
                yield part.assign(label=labels)

    fresh = miss.mapInPandas(ask, "name string, label string")
    both = names.join(known, "name").select("name", "label").unionByName(fresh)
    return both.select(F.lit(namespace).alias("namespace"), "name", "label")
