"""Rules over the contents of documents: every place of a term or a pattern in a block, as a span of the source."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import script
from ..functions.lexicon import Rules
from ..functions.text import Normalizer, is_exact, source_span

#: Of a term in several lists the first of these categories counts; it differs from that of path components.
ORDER = ("ORG", "NAME_LIST", "KEYWORD", "PROFESSION", "IDENTITY")
FOUND = "array<struct<category:string,start:int,end:int,covering:boolean,surface:string>>"


def content_findings(rules: Rules):
    """A column function of a block's text: its findings by (start, end, category), offsets in code points.

    Terms are looked for in the normalised view, the longest first, patterns in the text as it is and in the view.
    What is found in the view leads back to the span of the source that it was made from; covering says that
    this span holds more than was found, because a character became several. A span has each category once.
    Null and empty texts have no findings.
    """
    normalize, category = Normalizer(script.to_simplified()), {}
    for c in ORDER:
        for term in filter(None, rules.terms.get(c, [])):
            category.setdefault(normalize(term)[0], c)
    terms = re.compile("|".join(map(re.escape, sorted(category, key=len, reverse=True)))) if category else None
    patterns = [re.compile(p) for p in rules.patterns.values()]

    def one(text: str) -> list[tuple]:
        view, runs = normalize(text)
        spans = set()
        for p in patterns:
            spans |= {("PATTERN", *m.span(), False) for m in p.finditer(text)}
        hits = [(category[m[0]], *m.span()) for m in terms.finditer(view)] if terms else []
        for p in patterns:
            hits += [("PATTERN", *m.span()) for m in p.finditer(view)]
        known = {x[:3] for x in spans}
        for c, a, b in hits:
            if a < b and (c, *source_span(runs, a, b)) not in known:
                known.add((c, *source_span(runs, a, b)))
                spans.add((c, *source_span(runs, a, b), not is_exact(runs, a, b)))
        return [(c, a, b, covering, text[a:b]) for c, a, b, covering in sorted(spans, key=lambda x: (x[1], x[2], x[0])) if a < b]

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        names = ("category", "start", "end", "covering", "surface")
        return texts.map(lambda t: [dict(zip(names, x, strict=True)) for x in one(t)] if t else [])

    return find


def inspect(blocks: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """Rows of blocks, other columns kept, for each finding of their text: category, start, end, covering, surface."""
    keep = [c for c in blocks.columns if c != text]
    return blocks.select(*keep, F.explode(content_findings(rules)(F.col(text))).alias("_f")).select(*keep, "_f.*")


def report(documents: DataFrame, found: DataFrame, key: str, known: tuple[str, ...]) -> DataFrame:
    """Rows (key, status, finding_count, categories) for each row of documents (key, status), without a value, path or
    digest: a category that is not known is OTHER; the count is null where inspection was not complete."""
    label = F.when(F.col("category").isin(*known), F.col("category")).otherwise("OTHER")
    n = found.groupBy(key, label.alias("category")).agg(F.count("*").alias("n"))
    per = n.groupBy(key).agg(F.sum("n").alias("_n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    done = F.col("status") == "complete"
    return documents.join(per, key, "left").select(key, "status", F.when(done, F.coalesce("_n", F.lit(0))).alias("finding_count"), "categories")
