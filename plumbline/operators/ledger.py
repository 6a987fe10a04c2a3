"""Facts by content, gap clusters, and hash-chained ledgers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship

GENESIS = "0" * 64


def fact_id(*columns: str) -> Column:
    """A fact's id is the hash of its content; nulls and empty strings are told apart from each other."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(F.lit("fact:"), F.sha2(F.concat_ws("|", *parts), 256))


def mint(facts: DataFrame) -> DataFrame:
    """Facts (kind, component, source_logical_id, payload) with ids, each content once."""
    return minted(facts).dropDuplicates(["fact_id"])


def minted(facts: DataFrame) -> DataFrame:
    """Facts with ids, of contents that are known to differ."""
    cols = ("kind", "component", "source_logical_id", "payload")
    return facts.select(fact_id(*cols).alias("fact_id"), *cols)


def by_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).orderBy("fact_id")


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """New facts that the store doesn't have."""
    return new.dropDuplicates(["fact_id"]).join(store.select("fact_id"), "fact_id", "left_anti")


def blobs(bodies: DataFrame) -> DataFrame:
    """Bodies (strategy, body) by digest, each once a strategy."""
    return bodies.select("strategy", F.sha2("body", 256).alias("digest"), "body").dropDuplicates(["strategy", "digest"])


def blob_stats(b: DataFrame) -> DataFrame:
    return b.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0).cast("long")).alias("bytes"))


def clusters(gaps: DataFrame, representatives: int = 3) -> DataFrame:
    """Gaps (signature, diag_code, rule_path, occurrence_count, first_seen_commit, fixture, fixture_size,
    proven) by signature; the smallest proven fixtures represent each."""
    fix = F.slice(F.array_sort(F.collect_set(F.when(F.col("proven"), F.struct("fixture_size", "fixture")))), 1, representatives)
    g = gaps.groupBy("signature").agg(F.sum("occurrence_count").alias("occurrences"), F.min("diag_code").alias("diag_code"), F.min("rule_path").alias("rule_path"), F.min("first_seen_commit").alias("first_seen_commit"), fix.alias("f"))
    return g.select("signature", "occurrences", "diag_code", "rule_path", "first_seen_commit", F.array_join(F.transform("f", lambda x: x["fixture"]), ",").alias("fixtures"))


def gap_signature(*columns: str) -> Column:
    return F.sha2(F.concat_ws(";", *(F.coalesce(F.col(c), F.lit("")) for c in columns)), 256)


def accretion_index(runs: DataFrame) -> DataFrame:
    """Runs (extracted, unrecognised, signatures): the share extracted (1 of nothing), and distinct gaps."""
    sums = runs.agg(F.sum("extracted").alias("e"), F.sum("unrecognised").alias("u"))
    kinds = runs.select(F.explode("signatures").alias("s")).agg(F.count_distinct("s").alias("signatures"))
    return sums.crossJoin(kinds).select(F.coalesce(F.try_divide("e", F.col("e") + F.col("u")), F.lit(1.0)).alias("index"), "signatures")  # one row by one


def chain(entries: DataFrame, by: str) -> DataFrame:
    """Entries (seq, body) as hash chains, one a ledger: parent_entry_id is the id of the entry before,
    entry_id the hash of parent and body, so that a change of one entry changes all behind it. An entry
    that repeats the one before it is none (appending what is at the tip changes nothing). A chain is made in its own
    order and so by one fold: a ledger goes to one task, its bodies as digests."""
    slim = entries.select(F.col(by).alias("ledger"), "seq", "body")
    before = F.lag("body").over(Window.partitionBy("ledger").orderBy("seq"))
    slim = slim.withColumn("tip", before).where(F.col("tip").isNull() | (F.col("tip") != F.col("body"))).drop("tip")
    ship(entries.sparkSession)

    def fold(batches):
        import hashlib

        last, ledger = GENESIS, None
        for p in batches:
            out = []
            for k, body in zip(p["ledger"], p["body"]):
                if k != ledger:
                    last, ledger = GENESIS, k
                parent, last = last, hashlib.sha256((last + body).encode()).hexdigest()
                out.append((parent, last))
            yield p.assign(parent_entry_id=[a for a, _ in out], entry_id=[b for _, b in out])

    types = dict(entries.dtypes)
    rows = slim.repartition("ledger").sortWithinPartitions("ledger", "seq").mapInPandas(fold, f"ledger {types[by]}, seq {types['seq']}, body string, parent_entry_id string, entry_id string")
    return rows.withColumnRenamed("ledger", by)


def append_entries(ledger: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """A ledger (seq, body, ...) and new entries (seq, body) behind it, as one chain."""
    return chain(ledger.select(by, "seq", "body").unionByName(new.select(by, "seq", "body")), by)


def put_blobs(bodies: DataFrame, uri: str) -> None:
    """Store bodies (strategy, body) that the folder doesn't hold yet, by strategy and digest."""
    spark = bodies.sparkSession
    b = blobs(bodies)
    try:
        b = b.join(spark.read.parquet(uri).select("strategy", "digest"), ["strategy", "digest"], "left_anti")
    except AnalysisException:  # nothing stored yet
        pass
    b.write.mode("append").partitionBy("strategy").parquet(uri)


def get_blobs(wanted: DataFrame, uri: str) -> DataFrame:
    """(strategy, digest, body) of digests (strategy, digest); body is null for those not stored."""
    return wanted.join(wanted.sparkSession.read.parquet(uri), ["strategy", "digest"], "left").select("strategy", "digest", "body")


def put_facts(facts: DataFrame, uri: str) -> None:
    """A repository of minted facts in a folder, each once, by kind."""
    spark = facts.sparkSession
    new = facts.dropDuplicates(["fact_id"])
    try:
        new = append(spark.read.parquet(uri), new)
    except AnalysisException:
        pass
    new.write.mode("append").partitionBy("kind").parquet(uri)


def get_facts(spark, uri: str, kind: str | None = None) -> DataFrame:
    """Stored facts; those of one kind are read from its folder alone."""
    f = spark.read.parquet(uri)
    return f if kind is None else f.where(F.col("kind") == kind)


def verify(entries: DataFrame, by: str) -> DataFrame:
    """(ledger, seq, problem): entries whose parent isn't the one before, or whose id isn't the hash of
    parent and body. No rows: the chain holds."""
    w = Window.partitionBy(by).orderBy("seq")
    e = entries.withColumn("before", F.lag("entry_id", 1, GENESIS).over(w))
    p = F.when(F.col("parent_entry_id") != F.col("before"), "ParentMismatch").when(F.col("entry_id") != F.sha2(F.concat("parent_entry_id", "body"), 256), "IdMismatch")
    return e.select(by, "seq", p.alias("problem")).where("problem is not null")


def tripwire(values: DataFrame, by: str) -> DataFrame:
    """Rows (seq, value) that fall below the best value before them."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return values.withColumn("best", F.max("value").over(w)).where("value < best")
