"""Duplicate marking of whole documents, and the value audit's costly part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.functions import validate
from letterloom.functions.audit import holds_block
from letterloom.functions.text import audit_norm, dup_norm
from letterloom.operators.python_functions import longest_block_share, similarity
from letterloom.operators.relations import join_to_one
from letterloom.shared import written


def preference(name: str = "filename") -> Column:
    """Order of a group's members: no bracket in the name, then shorter, then by name."""
    return F.struct(F.contains(F.col(name), F.lit("(")), F.length(name), F.col(name))


def primary(df: DataFrame, key: str, name: str = "filename") -> DataFrame:
    """key, primary, n: each group's preferred member, by a minimum that is combined before the shuffle."""
    return df.groupBy(key).agg(F.min_by(name, preference(name)).alias("primary"), F.count(F.lit(1)).alias("n"))


def by_hash(df: DataFrame, key: str = "text_sha256", name: str = "filename") -> DataFrame:
    """name, duplicate_of: members of a group with one content hash (not empty) point to its primary."""
    some = df.where((F.col(key).isNotNull()) & (F.col(key) != "")).select(name, key)
    some = written(some, "hashes")  # used twice, and the hashes of whole texts are costly
    shared = primary(some, key, name).where("n > 1")
    return some.join(shared, key).where(F.col(name) != F.col("primary")).select(name, F.col("primary").alias("duplicate_of"))


def by_number(df: DataFrame, least: float = 0.95) -> DataFrame:
    """filename, duplicate_of: same document number and nearly the same text as the group's primary.

    df: filename, doc_number, text_norm. Numbers of six characters and texts of 200 at least; equal texts are
    decided without the costly comparison, which sees one pair per further member. Most numbers have one document:
    they are told by a count of numbers alone, so only texts under a shared number are grouped and joined.
    """
    df = df.withColumn("number", dup_norm("doc_number")).where((F.length("number") >= 6) & (F.length("text_norm") >= 200)).select("filename", "number", "text_norm")
    sizes = written(df.groupBy("number").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared-numbers")
    df = written(join_to_one(df, sizes.select("number"), "number", sizes=sizes), "shared")  # used twice
    first = df.groupBy("number").agg(F.min_by(F.struct("filename", "text_norm"), preference()).alias("p"))
    pairs = join_to_one(df, first, "number", sizes=sizes).where("filename <> p.filename")
    differs = F.col("text_norm") != F.col("p.text_norm")  # equal texts give the function nulls
    pairs = pairs.withColumn("_ratio", similarity(F.when(differs, F.col("p.text_norm")), F.when(differs, F.col("text_norm")), least))
    return pairs.where(~differs | (F.col("_ratio") >= least)).select("filename", F.col("p.filename").alias("duplicate_of"))


def flatten(pointers: DataFrame) -> DataFrame:
    """Pointers to their roots. The two criteria give chains of two at most, so one further look-up is enough."""
    up = pointers.select(F.col("filename").alias("duplicate_of"), F.col("duplicate_of").alias("root"))
    return pointers.join(up, "duplicate_of", "left").select("filename", F.coalesce("root", "duplicate_of").alias("duplicate_of"))


def mark(df: DataFrame) -> DataFrame:
    """filename, duplicate_of of all copies in ``df`` (filename, doc_number, text); markers it has are not read."""
    df = df.select("filename", "doc_number", dup_norm("text").alias("text_norm"))
    numbered = written(by_number(df), "numbered")  # used twice, and its comparisons are costly
    hashed = df.select("filename", validate.content_hash(F.col("text_norm")).alias("text_sha256"))  # before the join, which then moves no texts
    rest = hashed.join(numbered.select("filename"), "filename", "left_anti")
    return flatten(written(numbered.unionByName(by_hash(rest)), "pointers"))


def text_choice(pdf_norm: Column, excerpt_norm: Column) -> Column:
    """The text layer if it has 200 characters, else the excerpt."""
    return F.when(F.length(pdf_norm) >= 200, pdf_norm).otherwise(F.coalesce(excerpt_norm, F.lit("")))


def summary(df: DataFrame, marked: DataFrame) -> DataFrame:
    copies = F.count("duplicate_of")
    return df.select("filename").join(marked, "filename", "left").agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - copies).alias("unique"), copies.alias("copies"))


def similar_values(cells: DataFrame, least: float = 0.85) -> DataFrame:
    """Decide the cells that substring tests left open: ``similar`` where the text holds a block of that share of the value.

    Searches for windows of the value decide values under 200 characters. From there on difflib leaves frequent
    characters out of account, so its block may be shorter, but not longer: only such cells that hold a block reach it.
    """
    marked = cells.withColumn("_value", F.when(F.col("verdict").isNull(), audit_norm("machine"))).withColumn("_holds", F.when(F.col("_value").isNotNull(), holds_block("text_norm", "_value", least)))
    left = F.col("_holds") & (F.length("_value") >= 200)  # all others give the function nulls
    marked = marked.withColumn("_share", longest_block_share(F.when(left, F.col("text_norm")), F.when(left, F.col("_value"))))
    similar = F.when(left, F.col("_share") >= least).otherwise(F.col("_holds"))
    return marked.withColumn("verdict", F.coalesce("verdict", F.when(similar, "similar").otherwise("not_found"))).drop("_value", "_holds", "_share")


def readings_best(df: DataFrame) -> DataFrame:
    """Per page the surest of the readings (filename, page_no, variant, pos, text, conf) at least 95 % as long as the longest; the first wins ties."""
    longest = F.max(F.length("text")).over(Window.partitionBy("filename", "page_no"))
    near = df.withColumn("_longest", longest).where(F.length("text") >= F.col("_longest") * 0.95)
    return near.groupBy("filename", "page_no").agg(F.max_by("variant", F.struct("conf", -F.col("pos"))).alias("variant"))
