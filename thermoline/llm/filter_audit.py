"""What each of five filters removes, alone and behind the others, in every order.

Words are exploded and aggregated by document and word, then by document, for totals and
distinct words; the other flags are joined to them. A document's failed filters are a
number from 0 to 31, and one aggregate of 32 conditional counts a part holds all that any
order of the filters can ask for.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoline.llm.workspace import stored

FILTERS = "ABCDE"
# The limits of the filters.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 100, 80, 10, "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Text that a task of the word aggregate takes, and parts that rows alike in id and text are dealt over.
TASK_BYTES, SALTS = 32 << 20, 64
_KEY = ["id", "no_id", "digest"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A document's key is its id and its text; of the text, 128 bits of a cryptographic digest stand for it."""
    text, i = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("no_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    return rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def word_counts(keyed: DataFrame, tasks: int) -> DataFrame:
    """Words in all rows of a key, and different words of its text.

    Texts are dealt once, by key and salt; both aggregates over their words then need no further
    shuffle. Rows alike in id and text are dealt by the partition that they are read in.
    """
    dealt = keyed.select(*_KEY, (F.spark_partition_id() % SALTS).alias("salt"), "text").repartition(tasks, *_KEY, "salt")
    words = dealt.select(*_KEY, "salt", F.explode_outer(F.split("text", SPACE)).alias("word")).where("word != ''")
    by_word = words.groupBy(*_KEY, "salt", "word").agg(F.count(F.lit(1)).alias("n"))
    by_doc = by_word.groupBy(*_KEY, "salt").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))
    return by_doc.groupBy(*_KEY).agg(F.sum("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows of (part, failed, good, toxic, copies): so many documents of one id and text fail the filters of the number `failed`, A counting 1 and E 16."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col, part_col)
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    looks = keyed.withColumns({"c": 100 * upper > UPPER_PERCENT * F.length("text"), "d": F.col("text").rlike(SIGNS), "bytes": F.octet_length("text").cast("long")})
    facts = stored(looks.groupBy(*_KEY, "part", "c", "d", "bytes").agg(F.count(F.lit(1)).alias("copies")), "facts")
    total = facts.agg(F.coalesce(F.sum(F.col("bytes") * F.col("copies")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    first = facts.where("NOT no_id").groupBy("digest").agg(F.min("id").alias("id")).withColumn("no_id", F.lit(False)).withColumn("first", F.lit(True))
    # A table of its own, so that Spark can split an id that many rows hold.
    known = stored(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "labels").withColumn("no_id", F.lit(False))
    rows = facts.join(word_counts(keyed, tasks), _KEY, "left").join(first, _KEY, "left").withColumn("all_copies", F.sum("copies").over(Window.partitionBy(*_KEY)))
    words, different = F.expr("coalesce(n_words, 0) DIV all_copies"), F.coalesce("n_distinct", F.lit(0))
    flags = {"A": words < MIN_WORDS, "B": 100 * different < DISTINCT_PERCENT * words, "C": F.col("c"), "D": F.col("d"), "E": ~F.col("no_id") & F.col("first").isNull()}
    failed = sum((flag.cast("int") * (1 << FILTERS.index(name)) for name, flag in flags.items()), F.lit(0))
    rows = rows.select("id", "no_id", "part", failed.alias("failed"), "copies").join(known, ["id", "no_id"], "left")
    return rows.select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "copies")


def counts_by_part(rows: DataFrame) -> DataFrame:
    """One row a part: three arrays of 32 counts, of all documents, good and toxic ones, by failed filters."""
    table = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [F.sum(F.when((F.col("failed") == m) & which, F.col("copies")).otherwise(0)).alias(f"{name}_{m}") for name, which in table.items() for m in range(1 << len(FILTERS))]
    return rows.groupBy("part").agg(*columns).select("part", *(F.array(*(f"{name}_{m}" for m in range(1 << len(FILTERS)))).alias(name) for name in table))


def _summed(counts: str, which: str) -> Column:
    """The counts of all numbers m of failed filters for which `which` holds."""
    return F.expr(f"aggregate(sequence(0, {(1 << len(FILTERS)) - 1}), 0L, (s, m) -> s + IF({which}, {counts}[m], 0L))")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step.

    A null text is empty, and an empty one fails A alone; a null part is the empty string; a null
    id has no label and no smaller id, so it doesn't fail E, nor does a text fail by it. Each repeated row is a
    document of its own and fails E only by a smaller id, not by an equal one. An id with several
    labels is good or toxic if any says so. An empty table gives no rows; only the named columns
    are looked at, and `quality` and `toxic` of the labels. A text is split by one task at once, so memory is that of
    the longest text's words. No key is a single task's: ids, copies of a text and parts are
    aggregated before they are shuffled, and joins are by id and text together.
    """
    got = counts_by_part(failures(docs, labels, id_col, text_col, part_col))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = got.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda c: f"shiftleft(1, instr('{FILTERS}', {c}) - 1)"
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("bit", F.expr(place("letter")))
    steps = steps.withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (s, k) -> s + IF(k < step, {place('substring(filter_order, k, 1)')}, 0))"))
    here = "(m & bit) != 0 AND (m & before) = 0"
    out = steps.select(
        "part", "filter_order", "step", "letter", _summed("every", "(m & (bit | before)) = 0").alias("kept"), _summed("every", here).alias("removed"), _summed("every", "(m & bit) != 0 AND (m & before) != 0").alias("redundant"),
        F.expr("every[bit]").alias("unique_fails"), _summed("good", here).alias("good_lost"), _summed("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(known.toxic, false) AS toxic,
         (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text))::INT
         + 8 * regexp_matches(text, '{SIGNS}')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS failed
  FROM texts LEFT JOIN known USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM orders, unnest(range(1, 6)) AS t(k)),
counts AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM flags GROUP BY ALL),
found AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (failed & (bit | before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failed & bit != 0 AND failed & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failed & bit != 0 AND failed & before != 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (failed & bit != 0 AND failed & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(t) FILTER (failed & bit != 0 AND failed & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
"""


def oracle_sql() -> str:
    return _SQL
