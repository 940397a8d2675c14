"""Rows packed into batches in their order, each as full as it can be: next-fit, worked out slice by slice at once.

Where a batch that begins at a row ends depends on the rows behind it alone. So each slice of the order tells, for every row
that a batch may begin at in its head, where the first batch behind the slice begins; these maps are put together by
doubling, and then each slice packs its own rows from where it is entered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .inventory import number_rows

#: Rows of the order that one task packs.
SLICE = 50_000
#: What stands around the entries of a batch as a model is sent them.
HEAD, TAIL = '{"scope":"relative_to_selected_root","partial_tree":true,"entries":[', "]}"


def entry_json(path: Column, is_dir: Column, number: Column) -> Column:
    """An entry as a model is sent it."""
    return F.to_json(F.struct(path.alias("path"), F.when(is_dir, "directory").otherwise("file").alias("kind"), F.concat(F.lit("E"), number.cast("string")).alias("id")))


def successors(size: np.ndarray, parent: pa.Array, items: int, budget: int) -> np.ndarray:
    """For a batch that begins at each row, where the next one begins: behind the last row that fits or, where the row
    that does not fit has its siblings in the batch's end, at the first of these, unless they are the whole batch."""
    n = len(size)
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(n)
    out = np.minimum(np.searchsorted(total, total[:-1] + budget, side="right") - 1, np.minimum(at + items, n))
    fresh = np.ones(n, bool)
    fresh[1:] = ~pc.equal(parent[1:], parent[:-1]).to_numpy(zero_copy_only=False) if n > 1 else True
    run = np.maximum.accumulate(np.where(fresh, at, 0))
    cut = out < n
    siblings = run[out[cut]]
    out[cut] = np.where(siblings > at[cut], siblings, out[cut])
    return out


def pack(df: DataFrame, order: list[str], size: Column, parent: Column, most_items: int, most_bytes: int, slice_rows: int = SLICE) -> DataFrame:
    """df with batch, the number in the order of the first row of the row's batch, counted from 0 among rows that fit.

    Batches are those of going through the rows one by one: a row that does not fit into the open batch closes
    it, but its siblings at the end of the batch (rows of the same parent) go with it, if anything stands before them. A batch has at most
    most_items rows and most_bytes bytes. A row that is larger than most_bytes by itself, or has a null size, is in no batch (null). Order must tell
    rows apart, else equal ones come in any turn. One task holds slice_rows + most_items rows, whatever the directory;
    the columns of df must not be _p, _size, _parent, _slice, _entry or batch. An empty table stays empty.
    """
    if not 1 <= most_items <= slice_rows:
        raise ValueError("a batch must be at most a slice")
    columns = df.columns
    sized = df.withColumn("_size", size.cast("long")).withColumn("_parent", F.coalesce(parent, F.lit("")))
    fits = F.coalesce(F.col("_size") <= most_bytes, F.lit(False))
    numbered = materialize(number_rows(sized.filter(fits), *order, kind="long").withColumn("_p", F.col("ordinal") - 1).drop("ordinal"), "order")
    own = F.expr(f"_p DIV {slice_rows}L")
    # the head of each slice is seen by the slice before it too
    ahead = (F.col("_p") >= slice_rows) & (F.col("_p") % slice_rows < most_items)
    seen = numbered.withColumn("_slice", F.explode(F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own))))

    def maps(t: pa.Table) -> pa.Table:
        t = t.sort_by("_p")
        first = t.column("_slice")[0].as_py() * slice_rows
        after = successors(t.column("_size").to_numpy(), t.column("_parent").combine_chunks(), most_items, most_bytes)
        entry = np.arange(min(most_items if first else 1, slice_rows, len(after)))
        at = entry.copy()
        while len(go := np.flatnonzero(at < min(slice_rows, len(after)))):
            at[go] = after[at[go]]
        return pa.table({"entry": entry + first, "exit": at + first})

    ways = materialize(seen.select("_slice", "_p", "_size", "_parent").groupBy("_slice").applyInArrow(maps, "entry long, exit long"), "ways")
    # rows that a batch begins at in each slice's head: those that the first row leads to, twice as far each time
    entered = materialize(ways.filter("entry = 0").select("entry"), "entered")
    while True:
        more = entered.unionByName(entered.join(ways, "entry").join(ways.select(F.col("entry").alias("exit")), "exit", "left_semi").select(F.col("exit").alias("entry"))).distinct()
        more = materialize(more, "entered")
        if more.count() == entered.count():
            break
        further = materialize(ways.join(ways.select(F.col("entry").alias("exit"), F.col("exit").alias("_to")), "exit", "left").select("entry", F.coalesce("_to", "exit").alias("exit")), "ways")
        discard(entered)
        discard(ways)
        entered, ways = more, further
    starts = entered.select(F.expr(f"entry DIV {slice_rows}L").alias("_slice"), F.col("entry").alias("_entry"))

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by("_p")
        first = t.column("_slice")[0].as_py() * slice_rows
        after = successors(t.column("_size").to_numpy(), t.column("_parent").combine_chunks(), most_items, most_bytes)
        at, begun = t.column("_entry")[0].as_py() - first, []
        low = at
        while at < min(slice_rows, len(after)):
            begun.append(at)
            at = int(after[at])
        batch = np.repeat(begun, np.diff([*begun, at])) + first
        return t.slice(low, at - low).select(columns).append_column("batch", pa.array(batch, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", batch long"
    done = seen.join(starts, "_slice").groupBy("_slice").applyInArrow(packed, schema)
    return done.unionByName(sized.filter(~fits).select(*columns, F.lit(None).cast("long").alias("batch")))


def pack_entries(entries: DataFrame, most_items: int, most_bytes: int, slice_rows: int = SLICE) -> DataFrame:
    """entries (relpath, is_dir) in path order, with number, entry (its JSON) and batch: what a model is sent is HEAD, the entries of a
    batch in order of number with commas between, and TAIL, of at most most_bytes bytes in UTF-8."""
    numbered = number_rows(entries, "relpath", kind="long").withColumnRenamed("ordinal", "number")
    rows = numbered.withColumn("entry", entry_json(F.col("relpath"), F.col("is_dir"), F.col("number")))
    room = most_bytes - len(HEAD) - len(TAIL) + 1  # each entry brings a comma, the last one none
    return pack(rows, ["number"], F.octet_length("entry") + 1, F.regexp_replace("relpath", "/?[^/]*$", ""), most_items, room, slice_rows)
