"""Assertions from record tables, deduplicated evidence, and re-identification witnesses over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_with_map
from ..session import materialize

MAX_DEPTH = 6


@dataclass(frozen=True)
class Field:
    """One column of a record table: role is key, identity, sensitive, quasi or label."""

    name: str
    role: str
    namespace: str = ""
    entity_type: str = ""
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """How a table's rows make assertions about the entity of its primary key. view says what of a document is read:
    docx_table (that of number table) or docx_paragraphs; without one, a CSV file's rows or a text's lines."""

    primary: str
    fields: tuple[Field, ...]
    state_field: str | None = None
    default_state: str = "positive"
    states: tuple[str, ...] = field(default=("positive", "negative", "quoted", "unknown"))
    view: str | None = None
    table: int | None = None

    def __post_init__(self):
        if self.view not in (None, "docx_table", "docx_paragraphs") or (self.view == "docx_table") != (self.table is not None):
            raise ValueError("unknown view, or a table number where it does not belong")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("a field is named twice")
        keys = [f for f in self.fields if f.role == "key"]
        if self.primary not in [f.name for f in keys]:
            raise ValueError("the primary field is no key")
        if any(f.role not in ("key", "identity", "sensitive", "quasi", "label") for f in self.fields):
            raise ValueError("unknown role")
        if any(not f.namespace or not f.entity_type for f in keys):
            raise ValueError("a key needs a namespace and an entity type")


def digest(*parts: Column) -> Column:
    """132 bits of SHA-256 over the parts, as 22 characters: ids move through every join, and longer ones tell no more apart."""
    return F.substring(F.base64(F.unhex(F.sha2(F.concat_ws("\x1f", *parts), 256))), 1, 22)


def entity_key(entity_type: Column, namespace: Column, value: Column) -> Column:
    """Entities are equal just if type, namespace and value are: no folding, leading zeros count. The first two characters
    are those of the type and namespace, so that a walk can leave out kinds that nothing leads on from."""
    return F.concat(F.substring(digest(entity_type, namespace), 1, 2), digest(entity_type, namespace, value))


def entity_id(f: Field, value: Column) -> Column:
    return entity_key(F.lit(f.entity_type), F.lit(f.namespace), value)


def _lead(c: str) -> Column:
    """The part of an id that says its kind. Ids made otherwise have some first characters as well, which part them as safely."""
    return F.substring(c, 1, 2)


def assertions(records: DataFrame, template: Template, document_id: str | Column) -> DataFrame:
    """Rows (document_id, source, target, kind, field_name, value, state, entity_type, namespace) of a table whose
    columns are strings. document_id is one for the table, or a column of it.

    A column quoted (boolean), if there is one, marks rows that repeat what others said. The state is the
    default, else that of the state field, unknown if it is spelled otherwise, and quoted for such rows; a
    value outside a field's list is unknown. An empty key is an error of the whole table; empty values of
    other fields assert nothing.
    """
    missing = {f.name for f in template.fields} - set(records.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    state = F.lit(template.default_state)
    if template.state_field:
        given = F.lower(F.trim(template.state_field))
        state = F.when(F.coalesce(given, F.lit("")) == "", state).when(given.isin(*template.states), given).otherwise("unknown")
    if "quoted" in records.columns:
        state = F.when(F.col("quoted"), "quoted").otherwise(state)
    keys = {f.name: f for f in template.fields if f.role == "key"}
    bad = F.lit(False)
    for k in keys:
        bad = bad | (F.coalesce(F.col(k), F.lit("")) == "")
    own = keys[template.primary]
    # a filter, so that no query can leave the check out
    records = records.filter(F.when(bad, F.raise_error(F.lit("a key is empty")).cast("boolean")).otherwise(True))
    source = entity_id(own, F.col(own.name))
    none = F.lit(None).cast("string")
    made = []
    for f in template.fields:
        if f.name == template.primary:
            continue
        value = F.col(f.name)
        listed = F.when(value.isin(*f.values), state).otherwise("unknown") if f.values else state
        kind = "relation" if f.role == "key" else f.role
        made.append(F.struct(
            (entity_id(f, value) if f.role == "key" else none).alias("target"), F.lit(kind).alias("kind"), F.lit(f.name).alias("field_name"),
            (none if f.role == "key" else value).alias("value"), listed.alias("state"), (F.coalesce(value, F.lit("")) == "").alias("empty")))
    doc = F.lit(document_id) if isinstance(document_id, str) else document_id
    rows = records.select(doc.alias("document_id"), source.alias("source"), F.explode(F.array(*made)).alias("a")).select("document_id", "source", "a.*").filter(~F.col("empty"))
    return rows.select("document_id", "source", "target", "kind", "field_name", "value", "state", F.lit(own.entity_type).alias("entity_type"), F.lit(own.namespace).alias("namespace"))


def line_records(text: DataFrame, fields: tuple[str, ...], column: str = "text") -> DataFrame:
    """Rows of `name=value;name=value` lines, a leading `>` marking a quoted one. Lines with a name twice, an
    unknown or a missing one are an error that says which."""
    line = text.select(F.explode(F.split(F.col(column), r"\r\n|\r|\n")).alias("line")).filter(F.trim("line") != "")
    body = F.regexp_replace("line", r"^\s*>\s*", "")
    pairs = F.transform(F.split(body, ";"), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    names = F.transform("pairs", lambda p: p["k"])
    want = F.array(*map(F.lit, fields))
    why = (
        F.when(F.size(names) != F.size(F.array_distinct(names)), "a name stands twice: ").when(F.size(F.array_except(names, want)) > 0, "unknown name: ")
        .when(F.size(F.array_except(want, names)) > 0, "missing name: ")
    )
    rows = line.select("line", F.col("line").rlike(r"^\s*>").alias("quoted"), pairs.alias("pairs"))
    ok = rows.withColumn("m", F.when(why.isNotNull(), F.raise_error(F.concat(why, F.lit("in a record line"))).cast("map<string,string>")).otherwise(F.map_from_entries("pairs")))
    return ok.select(*[F.col("m")[f].alias(f) for f in fields], "quoted")


def evidence(rows: DataFrame, rejected: DataFrame | None = None, by_document: bool = False, written: bool = False, part: tuple[str, ...] = ()) -> DataFrame:
    """Distinct facts (evidence_id, source, target, kind, field_name, value, state, entity_type, namespace,
    n_assertions): copies of a fact are one, and what a relation's or an identity's column is called does not
    matter. rejected (source) leaves entities out. by_document keeps documents apart.

    written keeps the counted claims as a table that is read wherever the facts are, and adds denied: whether a negative fact
    says otherwise, of all facts, so that what is active need not be joined. Whoever leaves out negative facts afterwards drops it.
    part are columns that facts keep beside the others; all rows of an entity must have the same there.
    """
    doc = ["document_id"] if by_document else []
    if rejected is not None:
        gone = rejected.select(F.col("source").alias("_e")).distinct()
        rows = rows.join(gone, rows["source"] == gone["_e"], "left_anti").join(gone, F.col("target") == gone["_e"], "left_anti")
    name = F.when(F.col("kind").isin("relation", "identity"), "").otherwise(F.col("field_name"))
    known = ("positive", "negative", "quoted", "unknown")
    # the states of a claim meet in one row; a state beside these is a group of its own
    odd = F.when(F.col("state").isin(*known), None).otherwise(F.coalesce("state", F.lit("\x00")))
    claim = [*doc, "source", "target", "kind", "field_name", "value"]
    n = [F.count_if(F.col("state") == s).alias(f"_{s}") for s in known]
    claims = rows.withColumn("field_name", name).withColumn("_odd", odd).groupBy(*part, *claim, "entity_type", "namespace", "_odd").agg(*n, F.count("*").alias("_all"))
    if written:
        claims = materialize(claims, "facts")
    each = [F.struct(F.lit(s).alias("state"), F.col(f"_{s}").alias("n")) for s in known]
    single = F.array(F.struct(F.nullif(F.col("_odd"), F.lit("\x00")).alias("state"), F.col("_all").alias("n")))
    stated = F.explode(F.when(F.col("_odd").isNull() & (sum(F.col(f"_{s}") for s in known) > 0), F.filter(F.array(*each), lambda x: x["n"] > 0)).otherwise(single))
    facts = claims.select(*part, *claim, "entity_type", "namespace", (F.col("_negative") > 0).alias("denied"), stated.alias("_s"))
    facts = facts.select(*part, *claim, F.col("_s.state").alias("state"), F.col("_s.n").alias("n_assertions"), "entity_type", "namespace", *(["denied"] if written else []))
    return facts.withColumn("evidence_id", digest(*[F.coalesce(F.col(c), F.lit("\x00")) for c in [*claim, "state"]]))


def _marked(facts: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether facts say themselves which of them are denied, in the documents that keys part."""
    return "denied" in facts.columns and ("document_id" in facts.columns) == ("document_id" in keys)


def active(facts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positive facts that no negative one denies; a missing target equals a missing target."""
    if _marked(facts, keys):
        return facts.filter("state = 'positive' and not denied")
    on = [*keys, "source", "target", "kind", "field_name", "value"]
    no = facts.filter("state = 'negative'").select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return facts.filter("state = 'positive'").join(no, same, "left_anti")


def conflicts(facts: DataFrame) -> DataFrame:
    """One row: how many facts are both asserted and denied."""
    if _marked(facts, ()):
        return facts.agg(F.count_if((F.col("state") == "positive") & F.col("denied")).alias("conflicts"))
    g = facts.groupBy("source", "target", "kind", "field_name", "value").agg(F.max((F.col("state") == "positive").cast("int")).alias("p"), F.max((F.col("state") == "negative").cast("int")).alias("n"))
    return g.agg(F.count_if((F.col("p") == 1) & (F.col("n") == 1)).alias("conflicts"))


def state_counts(facts: DataFrame) -> DataFrame:
    """Facts by state, zero where there is none."""
    spark = facts.sparkSession
    every = spark.createDataFrame([(s,) for s in ("positive", "negative", "quoted", "unknown")], "state string")
    return every.join(facts.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def reach(edges: DataFrame, starts: DataFrame, most: int = MAX_DEPTH, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (start, node, chain): every node that directed edges (source, target, evidence_id) lead to within
    `most` steps, by a shortest chain, of equal ones the least by ids. A node beyond the last step is an error:
    the limit is no cut-off. keys keep separate graphs apart (documents, or a removed edge).

    Only nodes of kinds that edges start from are walked on. Each round's nodes are written once and none is copied into a sum.
    """
    k = list(keys)
    first = materialize(starts.select(*k, F.col("source").alias("start")).distinct(), "reach")
    done = level = first.select(*k, "start", F.col("start").alias("node"), F.array().cast("array<string>").alias("chain"))
    e = edges.select(*k, F.col("source").alias("node"), F.col("target").alias("_to"), "evidence_id")
    leads = materialize(e.select(*k, _lead("node").alias("_lead")).distinct(), "leads")
    for depth in range(most + 1):
        front = level.withColumn("_lead", _lead("node")).join(leads, [*k, "_lead"], "left_semi")
        if front.isEmpty():
            return done
        if depth == 0:  # a start is its own node: the edges meet it where they are grouped
            nxt = front.select(*k, "start").join(e.withColumnRenamed("node", "start"), [*k, "start"]).filter("_to != start")
            level = nxt.groupBy(*k, "start", F.col("_to").alias("node")).agg(F.array(F.min("evidence_id")).alias("chain"))
        else:
            nxt = front.join(e, [*k, "node"]).select(*k, "start", F.col("_to").alias("node"), F.concat("chain", F.array("evidence_id")).alias("chain"))
            level = nxt.groupBy(*k, "start", "node").agg(F.min("chain").alias("chain")).join(done.select(*k, "start", "node"), [*k, "start", "node"], "left_anti")
        level = materialize(level, "reach")
        if level.isEmpty():
            return done
        if depth == most:
            raise ValueError(f"a node lies more than {most} steps away")
        done = done.unionByName(level)
    return done


RULES = ("identity_mapping", "numbered_join", "quasi_combination")


def witnesses(facts: DataFrame, quasi: tuple[str, ...] = (), max_support: int = 2, by_document: bool = False, most: int = MAX_DEPTH, rules: tuple[str, ...] = RULES, part: tuple[str, ...] = ()) -> DataFrame:
    """Rows (rule, subject, endpoint, chain, support, population) over active facts.

    identity_mapping: an entity has a name. numbered_join: a named entity leads by keys to a sensitive fact.
    quasi_combination: no more than max_support entities of a type and namespace share an entity's values of
    the quasi fields; an entity with a missing or a second value of one does not count, in the population
    either. by_document looks at each document alone, part at each part of the facts (evidence), and both are kept. rules: those
    asked for; no other is worked out.
    """
    if quasi and (len(quasi) < 2 or len(quasi) > 8 or len(set(quasi)) != len(quasi)):
        raise ValueError("two to eight distinct quasi fields are needed")
    if not rules or not set(rules) <= set(RULES):
        raise ValueError(f"rules are some of {RULES}")
    k = [*(["document_id"] if by_document else []), *part]
    facts = active(facts, tuple(k)) if _marked(facts, tuple(k)) else materialize(active(facts, tuple(k)), "facts")
    none = F.lit(None).cast("long")
    names = facts.filter("kind = 'identity'").select(*k, "source", F.col("evidence_id").alias("name_id"))
    out = names.select(*k, F.lit("identity_mapping").alias("rule"), F.col("source").alias("subject"), F.col("name_id").alias("endpoint"), F.array("name_id").alias("chain"), none.alias("support"), none.alias("population"))
    if "identity_mapping" not in rules:
        out = out.filter(F.lit(False))
    if "numbered_join" in rules:
        paths = reach(facts.filter("kind = 'relation'"), names, most, tuple(k))
        # facts of kinds that no path ends at are left where they are
        ends = materialize(paths.select(*k, _lead("node").alias("_lead")).distinct(), "leads")
        secret = facts.filter("kind = 'sensitive'").select(*k, F.col("source").alias("node"), F.col("evidence_id").alias("fact_id"), _lead("source").alias("_lead")).join(ends, [*k, "_lead"], "left_semi").drop("_lead")
        joined = names.withColumnRenamed("source", "start").join(paths, [*k, "start"]).join(secret, [*k, "node"])
        out = out.unionByName(joined.select(*k, F.lit("numbered_join").alias("rule"), F.col("start").alias("subject"), F.col("fact_id").alias("endpoint"), F.concat(F.array("name_id"), "chain", F.array("fact_id")).alias("chain"), none.alias("support"), none.alias("population")))
    if quasi and "quasi_combination" in rules:
        q = facts.filter(F.col("kind") == "quasi").filter(F.col("field_name").isin(*quasi))
        per = q.groupBy(*k, "source", "entity_type", "namespace", "field_name").agg(F.count_distinct("value").alias("d"), F.min("value").alias("v"), F.min("evidence_id").alias("e"))
        good = per.filter("d = 1").groupBy(*k, "source", "entity_type", "namespace").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("v", "e")))).alias("m")).filter(F.size("m") == len(quasi))
        sig = good.select("*", F.to_json(F.array(*[F.col("m")[f]["v"] for f in quasi])).alias("sig"), F.array(*[F.col("m")[f]["e"] for f in quasi]).alias("chain"))
        n = sig.groupBy(*k, "entity_type", "namespace", "sig").agg(F.count("*").alias("support"))
        pop = n.groupBy(*k, "entity_type", "namespace").agg(F.sum("support").alias("population"))
        rare = sig.join(n.filter(F.col("support") <= max_support), [*k, "entity_type", "namespace", "sig"]).join(pop, [*k, "entity_type", "namespace"])
        out = out.unionByName(rare.select(*k, F.lit("quasi_combination").alias("rule"), F.col("source").alias("subject"), F.element_at("chain", -1).alias("endpoint"), "chain", "support", "population"))
    return out


def cuts(found: DataFrame, facts: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """Rows (rule, subject, endpoint, cut, blocks) for each fact in a witness's chain: whether the witness falls
    without it. The first and last always block. An edge between does if the end is out of reach then: where every node from
    the edge on has one edge alone that leads to it, it is; the other removed edges are looked at together, each as a
    graph of its own."""
    facts = active(facts) if _marked(facts, ()) else materialize(active(facts), "facts")
    edges = facts.filter("kind = 'relation'").select("source", "target", "evidence_id")
    steps = found.select("rule", "subject", "endpoint", F.size("chain").alias("n"), F.posexplode("chain").alias("i", "cut"))
    several = edges.groupBy("target").agg(F.count("*").alias("n")).filter("n > 1").select("target")
    beside = materialize(edges.join(several, "target", "left_semi").select(F.col("evidence_id").alias("cut")), "beside")
    if beside.isEmpty():
        return steps.select("rule", "subject", "endpoint", "cut", F.lit(True).alias("blocks"))
    between = steps.filter((F.col("rule") == "numbered_join") & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1))
    last = between.join(beside, "cut", "left_semi").groupBy("rule", "subject", "endpoint").agg(F.max("i").alias("last"))
    open_ = materialize(between.join(materialize(last, "cuts"), ["rule", "subject", "endpoint"]).filter(F.col("i") <= F.col("last")).select("rule", "subject", "endpoint", "cut"), "cuts")
    starts = open_.select(F.col("cut").alias("removed"), F.col("subject").alias("source")).distinct()
    level = materialize(starts.select("removed", "source", F.col("source").alias("node")), "cutreach")
    done = level
    leads = materialize(edges.select(_lead("source").alias("_lead")).distinct(), "leads")
    for _ in range(most + 1):
        front = level.withColumn("_lead", _lead("node")).join(leads, "_lead", "left_semi").drop("_lead")
        nxt = front.join(edges.withColumnRenamed("source", "node"), "node").filter("evidence_id != removed").select("removed", "source", F.col("target").alias("node")).distinct()
        level = materialize(nxt.join(done, ["removed", "source", "node"], "left_anti"), "cutreach")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    ends = facts.select(F.col("evidence_id").alias("endpoint"), F.col("source").alias("node"))
    wanted = open_.join(ends, "endpoint").select(F.col("cut"), "subject", "endpoint", "node").distinct()
    still = wanted.join(done.select(F.col("removed").alias("cut"), F.col("source").alias("subject"), "node"), ["cut", "subject", "node"], "left_semi").select(F.lit("numbered_join").alias("rule"), "subject", "endpoint", "cut", F.lit(True).alias("_still")).distinct()
    return steps.join(materialize(still, "cuts"), ["rule", "subject", "endpoint", "cut"], "left").select("rule", "subject", "endpoint", "cut", F.col("_still").isNull().alias("blocks"))


def incremental_joins(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Witnesses that no document shows by itself."""
    return found.join(baseline.select("rule", "subject", "endpoint").distinct(), ["rule", "subject", "endpoint"], "left_anti")


def candidates(facts: DataFrame) -> DataFrame:
    """Rows (entity_type, namespace, label, members): entities of one kind with the same name in the normalised view, full-width
    letters, case and script aside. They are only proposed, never merged."""
    named = facts.filter(F.col("kind").isin("identity", "label") & (F.col("state") == "positive")).select("entity_type", "namespace", "source", "value").distinct()
    label = normalize_with_map(F.col("value"))["text"]
    groups = named.withColumn("label", label).groupBy("entity_type", "namespace", "label").agg(F.array_sort(F.collect_set("source")).alias("members"))
    return groups.filter(F.size("members") > 1)


def graph_report(facts: DataFrame, found: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row of counts: facts, assertions, witnesses by rule, joins that need several documents."""
    n = lambda r: F.count_if(F.col("rule") == r)
    w = found.agg(n("identity_mapping").alias("identity_mappings"), n("numbered_join").alias("numbered_joins"), n("quasi_combination").alias("quasi_combinations"))
    f = facts.agg(F.count("*").alias("facts"), F.coalesce(F.sum("n_assertions"), F.lit(0)).alias("assertions"))
    i = incremental_joins(found, baseline).agg(F.count("*").alias("incremental"))
    one = F.lit(1).alias("_k")
    return f.withColumn("_k", one).join(w.withColumn("_k", one), "_k").join(i.withColumn("_k", one), "_k").drop("_k")
