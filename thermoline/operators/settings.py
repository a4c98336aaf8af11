"""Nested settings as JSON: read with faults allowed, merged level by level, rebuilt.

A document is flattened to one row for each path to a value that is no object; settings
override one another by path, and a value that is unset is another thing than one set to null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoline.operators.dealing import dealt

#: Levels of objects that are merged; an object below is one value.
DEPTH = 4


def leaves(df: DataFrame, key: str | list[str], text: str, depth: int = DEPTH) -> DataFrame:
    """Rows (key, path, value) of documents in JSON: the names down to each value, and the value as JSON. An empty object is a value; a damaged or missing document has no rows."""
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    for _ in range(depth):
        inside = F.try_variant_get("v", "$", "map<string,variant>")
        entries = F.transform(F.map_entries(inside), lambda e: F.struct(F.concat("path", F.array(e["key"])).alias("path"), e["value"].alias("v")))
        # A value that is no object, or an empty one, stays as it is.
        rows = rows.select(*keys, F.inline(F.when(F.schema_of_variant("v").startswith("OBJECT<") & (F.size(inside) > 0), entries).otherwise(F.array(F.struct("path", "v")))))
    return rows.select(*keys, "path", F.to_json("v").alias("value"))


def merged(rows: DataFrame, key: str) -> DataFrame:
    """Leaves (key, over, path, value) of both documents, those with `over` over the others: objects merge, and any other value takes the place of all below its path.

    An empty object overrides what is no object only. In order of their paths, those that begin with
    another follow it at once, and no leaf of a document lies below another of it; so all that a leaf
    has to do with is the nearest leaf of the other document before it, at it, or behind it.
    """
    w = Window.partitionBy(key).orderBy("path")
    behind = w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    before = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = lambda path, above: F.slice(path, F.lit(1), F.size(above)) == above
    path, over = F.col("path"), F.col("over")
    # What is at the same path is behind it too, but may come first only where it is the nearest.
    rows = rows.withColumn("next", F.first(F.when(~over, F.struct("path", "value")), ignorenulls=True).over(behind))
    beneath = below(F.col("next.path"), path) & ((F.size("next.path") > F.size("path")) | (F.col("next.value") == "{}"))
    rows = rows.where(~(over & (F.col("value") == "{}") & F.coalesce(beneath, F.lit(False)))).drop("next")
    rows = rows.withColumns({"above": F.last(F.when(over, path), ignorenulls=True).over(before), "next": F.first(F.when(over, path), ignorenulls=True).over(behind)})
    gone = F.coalesce(below(path, F.col("above")), F.lit(False)) | F.coalesce(below(F.col("next"), path), F.lit(False))
    return rows.where(over | ~gone).select(key, "path", "value")


def rebuilt(rows: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """One row (key, json) for each document, names in order; level by level from the deepest."""
    for n in range(depth, 0, -1):
        deep = F.size("path") == n
        name = F.to_json(F.array(F.element_at("path", -1)))
        entry = F.when(deep, F.struct(F.element_at("path", -1).alias("name"), F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.col("value")).alias("text")))
        rows = rows.withColumns({"entry": entry, "own": F.when(~deep, F.col("value")), "at": F.when(deep, F.expr(f"slice(path, 1, {n - 1})")).otherwise(F.col("path"))})
        joined = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["text"]), ","), F.lit("}"))
        rows = rows.groupBy(key, F.col("at").alias("path")).agg(F.coalesce(F.max("own"), joined).alias("value"))
    return rows.select(key, F.col("value").alias("json"))


def merged_documents(df: DataFrame, key: str, base: str, over: str, depth: int = DEPTH) -> DataFrame:
    """One row (key, json) of each row whose document `base` can be read, with `over` merged into it; a damaged or missing `over` changes nothing.

    Rows are dealt by key while they are documents; their leaves stay where they are, and nothing of them is shuffled or stored.
    """
    both = dealt(df, key, width=10).select(key, F.inline(F.array(*(F.struct(F.lit(n == 1).alias("over"), F.col(c).alias("text")) for n, c in enumerate((base, over))))))
    return rebuilt(merged(leaves(both, [key, "over"], "text", depth), key), key, depth)
