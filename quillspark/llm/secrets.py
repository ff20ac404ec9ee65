"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in each text by patterns. Their hashes are then counted over the whole corpus by distinct
repositories and owners: a value that many owners have is a copied example; one that few have looks live. Counting is
over distinct (hash, owner, repository), so a value that a third of all documents hold costs its distinct owners only.

Defined results: a null or empty text has no candidates; a null owner or repository counts as one of its own; repeated rows
each get the same result and count once as a repository; an empty table gives an empty result; offsets are code points.
Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stored

#: Kinds in order: pattern, the group whose length counts, and the least length. Later ones are the method's own.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
    "github": (r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    "pem": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 20),
}
BASE = ("assign", "access", "hex")
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 20
MOST_FREQUENT = 10_000  # values that hold more than this part of all candidates; there are fewer than that many of them


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """Sums of the numbers up to each of them: each pass adds what lies twice as far back, so n numbers take about log n passes over the array."""
    widths = lambda xs: F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda w: w < F.size(xs))
    added = lambda sums, w: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - w), F.lit(0)))
    return let(numbers, lambda xs: F.aggregate(widths(xs), xs, added))


def located(text: Column, kind: str, rank: int) -> Column:
    """array<struct<start, rank, end, value>> of the matches of a kind that are long enough."""
    pattern, group, least = KINDS[kind]
    if kind == "hex":  # the same matches: a run of the class is taken whole, and is long enough or not
        pattern = r"([0-9a-f]{24,})"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # split() and regexp_extract_all() make the same matches, so pieces and matches alternate
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def spans(found: Column) -> Column:
        ends = running(F.transform(found, lambda x: F.length(x["piece"]) + F.length(x["whole"])))
        each = let(ends, lambda at: F.transform(found, lambda x, i: F.struct((F.get(at, i) - F.length(x["whole"])).alias("start"), F.lit(rank).alias("rank"), F.get(at, i).alias("end"), x["value"].alias("value"))))
        return F.filter(each, lambda x: F.length(x["value"]) >= least)

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(zipped, spans)).otherwise(empty)


def named(spans: Column) -> Column:
    label = F.element_at(F.array(*map(F.lit, KINDS)), spans["rank"] + 1)
    return F.concat_ws(":", label, spans["start"], spans["end"])


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """row_id, doc_id, owner, repository, spans: one row for each document; spans by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("\0")).alias("repository"), text.alias("text"))
    for rank, kind in enumerate(KINDS):
        rows = rows.withColumn(kind, located(F.col("text"), kind, rank))
    spans = F.array_sort(F.concat(*map(F.col, KINDS)))
    hashed = F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"], F.sha2(x["value"], 256).alias("hash")))
    return rows.select("doc_id", "owner", "repository", hashed.alias("spans")).withColumn("row_id", F.monotonically_increasing_id())


def ownership(found: DataFrame, owners: int = SHARED_OWNERS, repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """hash, n_owners, n_repositories, n_candidates, copied."""
    each = found.select("owner", "repository", F.explode("spans.hash").alias("hash")).groupBy("hash", "owner", "repository").agg(F.count("*").alias("times"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("times").alias("held"), F.sum("times").alias("times"))
    out = by_owner.groupBy("hash").agg(F.count("held").alias("n_owners"), F.sum("held").alias("n_repositories"), F.sum("times").alias("n_candidates"))
    return out.withColumn("copied", (F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories))


def judged(each: DataFrame, verdicts: DataFrame, most: int = MOST_FREQUENT) -> DataFrame:
    """each (row_id, hash) with the copied of its hash. Values that hold more than one in ``most`` of all candidates are fewer than ``most``
    whatever the data, and are broadcast; so no key of the shuffled join holds more rows than that part."""
    total = verdicts.agg(F.sum("n_candidates")).head()[0] or 0
    frequent = F.col("n_candidates") * most > total
    flagged = each.join(F.broadcast(verdicts.where(frequent).select("hash", "copied")), "hash", "left")
    rest = flagged.where("copied is null").drop("copied").join(verdicts.where(~frequent).select("hash", "copied"), "hash")
    return flagged.where("copied is not null").unionByName(rest)


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """A row for each row of docs: counts, the digest of the base, all spans, and how many candidates are copied or look live."""
    found = stored(candidates(docs, owner, repository))
    with_spans = found.where(F.size("spans") > 0)
    each = with_spans.select("row_id", F.explode(F.array_distinct("spans.hash")).alias("hash"))
    verdict = judged(each, stored(ownership(with_spans))).groupBy("row_id").agg(F.sum(F.col("copied").cast("long")).alias("n_copied"), F.sum((~F.col("copied")).cast("long")).alias("n_live"))
    held = with_spans.join(verdict, "row_id", "left").unionByName(found.where(F.size("spans") == 0).withColumns({"n_copied": F.lit(0).cast("long"), "n_live": F.lit(0).cast("long")}))
    count = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return held.select(
        "doc_id", *(count(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE)),
        F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", named), ",").alias("spans"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )


def op5_secret_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)
