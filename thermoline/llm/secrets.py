"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Patterns give candidate spans with their places. Each candidate's value is hashed, and the
hashes are counted over the whole corpus by distinct repositories and owners: a value that
many owners hold, or very many repositories of few owners, is a copied example, one that few
hold and that looks random is a live-looking credential. How many are many grows with the
logarithm of the number of owners. Base spans are always reported; spans of the wider
patterns are added where their value is live-looking and meets no span of an earlier pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline.llm.workspace import stored


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    base: bool
    #: Group that is the value; least characters of the value.
    group: int = 0
    least: int = 1
    #: A string without which the pattern can't match.
    needs: str | None = None


#: The base patterns of the contract, in its order. A run of hex digits or of an
#: access key is matched from its first place to its end, so the least length can be in the pattern.
BASE = (
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Pattern("access", r"AKIA[A-Z0-9]{14,}", True, needs="AKIA"),
    Pattern("hex", r"[0-9a-f]{16,}", True),
)
#: Prefixed tokens of well-known services, signed web tokens, private keys, and long mixed strings.
WIDER = (
    Pattern("issued", r"(?:gh[pousr]_|glpat-|sk_live_|rk_live_|xox[abprs]-|npm_|SG\.)[A-Za-z0-9._-]{16,}", False),
    Pattern("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False, needs="eyJ"),
    Pattern("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", False, needs="PRIVATE KEY-----"),
    Pattern("mixed", r"[A-Za-z0-9+/_]{24,}", False),
)
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|0000|1234567|test"
#: From so many owners on, or the logarithm to base 2 of their number where it is more, a value is a copied example;
#: so it is from REPOS_PER_OWNER times as many repositories on.
COPIED_OWNERS, REPOS_PER_OWNER = 3, 2

SPAN = "struct<start:long,stop:long,rank:int,value:string,plausible:boolean>"


def _spans(text: Column, pattern: Pattern, rank: int) -> Column:
    """All spans of a pattern, in characters: the lengths of the gaps between matches and of the matches, summed."""
    found = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group)) if pattern.group else found
    pieces = F.arrays_zip(found.alias("whole"), F.split(text, pattern.regex, -1).alias("gap"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))

    def add(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + F.length(piece["gap"])
        stop = start + F.coalesce(F.length(piece["whole"]), F.lit(0))
        return F.struct(stop.alias("at"), F.concat(so_far["starts"], F.array(start)).alias("starts"))

    def span(x: Column) -> Column:
        start, got = x["start"], x["value"]
        stop = start + F.length(x["whole"])
        classes = sum((got.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
        varied = F.size(F.array_distinct(F.split(got, ""))) >= 8
        plausible = ~got.rlike(PLACEHOLDER) & varied & (F.lit(pattern.kind != "mixed") | (classes == 3))
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(rank).alias("rank"), F.md5(got).alias("value"), plausible.alias("plausible"))

    long_enough = lambda x: F.length(x["value"]) >= pattern.least
    starts = F.aggregate(pieces, first, add, lambda x: x["starts"])
    placed = F.arrays_zip(found.alias("whole"), value.alias("value"), F.slice(starts, 1, F.size(found)).alias("start"))
    spans = F.filter(F.transform(F.filter(placed, long_enough), span), lambda x: F.lit(pattern.base) | x["plausible"]).cast(f"array<{SPAN}>")
    none = F.array().cast(f"array<{SPAN}>")
    here = text.rlike(pattern.regex)
    if pattern.needs:
        here = text.contains(pattern.needs) & here
    return F.when(here, spans).otherwise(none)


def candidates(docs: DataFrame, owner_col: str, repo_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`, with a row number of its own and all candidate spans in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = [_spans(F.col("text"), p, rank) for rank, p in enumerate((*BASE, *WIDER))]
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), named(owner_col).alias("owner"), named(repo_col).alias("repo"), text.alias("text"))
    return rows.select("doc_id", "owner", "repo", F.monotonically_increasing_id().alias("row"), F.array_sort(F.concat(*spans)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """How many owners, and repositories of theirs, hold each value; summed per owner before it is shuffled by value."""
    held = found.select("owner", "repo", F.explode("spans.value").alias("value")).distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def many_owners(found: DataFrame, least: int = COPIED_OWNERS) -> int:
    """From how many owners on a value is a copied example."""
    owners = found.select("owner").distinct().count()
    return max(least, owners.bit_length() - 1)


def secret_spans(docs: DataFrame, owner_col: str = "source", repo_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row for each row of `docs` with its spans and what the corpus says of their values.

    A repository is a value of `repo_col` within one of `owner_col`; the source and the language
    stand in for them where a corpus says no more of its documents. Null texts are empty;
    null owners and repositories count as one unnamed; repeated rows are reported each; an
    empty table gives no rows; spans that begin together are in the order of the patterns;
    columns of other names don't matter. The text is read once, a long one takes memory for its
    candidates alone; only candidates are shuffled, and a value that millions of rows hold is
    joined as a stored table, which Spark can split.
    """
    found = stored(candidates(docs, owner_col, repo_col, id_col, text_col), "candidates")
    many = many_owners(found, copied_owners)
    each = found.select("row", F.posexplode("spans").alias("nth", "span")).select("row", "nth", F.col("span.value").alias("value"))
    judged = each.join(stored(ownership(found), "ownership").hint("merge"), "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "n_owners", "n_repos"))).alias("held"))
    rows = found.join(judged, "row", "left")
    base = len(BASE)
    copied = lambda h: (h["n_owners"] >= many) | (h["n_repos"] >= REPOS_PER_OWNER * many)
    rows = rows.withColumn("all", F.when(F.col("held").isNull(), F.array().cast(f"array<struct<span:{SPAN},copied:boolean,live:boolean>>")).otherwise(F.zip_with("spans", "held", lambda s, h: F.struct(s.alias("span"), copied(h).alias("copied"), (~copied(h) & s["plausible"]).alias("live")))))
    rows = rows.withColumn("based", F.filter("all", lambda x: x["span"]["rank"] < base))
    stronger = lambda y, x: (y["span"]["rank"] < base) | (y["live"] & (y["span"]["rank"] < x["span"]["rank"]))
    clear = lambda x: ~F.exists("all", lambda y: stronger(y, x) & (y["span"]["start"] < x["span"]["stop"]) & (x["span"]["start"] < y["span"]["stop"]))
    rows = rows.withColumn("reported", F.filter("all", lambda x: (x["span"]["rank"] < base) | (x["live"] & clear(x))))
    kinds = F.array(*(F.lit(p.kind) for p in (*BASE, *WIDER)))
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["span"]["rank"]), x["span"]["start"].cast("string"), x["span"]["stop"].cast("string"))))
    count = lambda k: F.size(F.filter("based", lambda x: x["span"]["rank"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{p.kind}") for k, p in enumerate(BASE)),
        F.sha2(said("based").cast("binary"), 256).alias("base_sha256"),
        said("reported").alias("spans"),
        F.size(F.filter("reported", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("reported", lambda x: x["copied"])).cast("long").alias("n_copied"),
        said(F.filter("reported", lambda x: x["live"])).alias("live_spans"),
    )
