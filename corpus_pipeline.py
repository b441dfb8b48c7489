"""A corpus pipeline of five stages over documents: language, near-dedup, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row of docs. run() writes a stage's rows as Parquet into
the shared folder and reads them back for the next one, so a lost executor repeats part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import bpe, langid, mixing, secrets, simhash
from tidewire.llm.common import SPACE, WORD, documents, sieve, staged, unstage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or a prediction that is hardly sure."""
    model = langid.fit(docs)
    named = langid.predict(docs, model, names=("__lang", "__score"))
    return named.where((F.col("__lang") != "und") & (F.col("__score") >= langid.LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingle sets of similarity 0.8 or more), one document stays: the one of least doc_id.

    A row without a doc_id stays only if no row of its group has one. Of rows equal in doc_id and text one stays. Rows without words
    have no copies and stay. Other columns may hold anything.
    """
    groups = simhash.near_copies(docs)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    # a table, so that both sides of the join are read as they are and the rows of a large component can be split over tasks
    first = staged(groups.groupBy("component").agg(F.count("*").alias("held"), F.min(row).alias("stays")).where("held > 1"), "first")
    named = groups.join(first, "component").select("doc_id", "h1", "h2", (row == F.col("stays")).alias("stays"))
    turned = named.groupBy("doc_id", "h1", "h2").agg(F.first("stays").alias("stays"), F.count("*").alias("held"))
    aside = staged(turned.where("not stays or held > 1").select(F.col("doc_id").alias("__id"), F.col("h1").alias("__a"), F.col("h2").alias("__b"), "stays"), "aside")
    unstage(groups, first)
    h1, h2 = simhash.text_key("text")
    keyed = docs.withColumns({"__h1": h1, "__h2": h2})
    may = sieve(aside, "__a")  # most rows have no copy: they stay where they are, only the others go through the join
    alone, asked = keyed.where(~may(F.col("__h1"))), keyed.where(may(F.col("__h1")))
    same = (F.col("__h1") == F.col("__a")) & (F.col("__h2") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = asked.join(aside, same, "left_anti")
    one = asked.join(aside.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "__h1", "__h2"])
    return alone.unionByName(kept).unionByName(one).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark; every row stays, repeated ones and those without text or doc_id too."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass that takes a document, its text cut where the source's target ends.

    A null or empty text has no words and gives no row. Rows equal in doc_id, source and text are taken as often as one document
    that all of them make; where the target ends among them, their other columns are those of one of them. n_chars, if there, is counted again where a text is cut.
    """
    # the names with underscores can't clash with columns of docs
    h1, h2 = simhash.text_key("text")
    keyed = docs.withColumns({"__h1": h1, "__h2": h2})
    mix = mixing.mix(keyed, keep=["__h1", "__h2"])
    taken = sum((F.col(f"taken_{t + 1}") for t in range(mixing.PASSES)), F.lit(0))
    place = mix.bucket_of(F.col("__h1")).alias("__bucket")
    tally = mix.documents.where("size > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__from"), F.col("__h1").alias("__a"), F.col("__h2").alias("__b"), place, F.col("size").alias("__size"), taken.alias("__taken"))
    tally = staged(tally, "taken")
    runs = staged(_runs(tally), "runs")
    keyed = keyed.withColumn("__bucket", place).where(F.col("text").rlike(WORD))
    here = lambda of: F.col(of).eqNullSafe(F.col("__run")) & F.col("__bucket").between(F.col("__low"), F.col("__high"))
    # a bucket whose rows are all taken in whole passes needs no row's own count, so its texts aren't shuffled
    whole = keyed.join(runs.where("__passes > 0"), here("source")).withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__passes")))).select(*docs.columns)
    cut = runs.where("__passes is null")
    return whole.unionByName(_cut(docs, keyed.join(cut, here("source"), "left_semi"), tally.join(cut, here("__from"), "left_semi")))


def _runs(tally: DataFrame) -> DataFrame:
    """__run (a source), __low, __high (buckets), __passes: how often the mix takes every row there, null where rows or words of them differ.

    A source's target ends in one bucket, so it has a few runs, whatever its size.
    """
    even = F.when(F.col("__taken") % F.col("__size") == 0, (F.col("__taken") / F.col("__size")).cast("int")).otherwise(-1)
    per = tally.groupBy(F.col("__from").alias("__run"), "__bucket").agg(F.min(even).alias("least"), F.max(even).alias("most"))
    per = per.select("__run", "__bucket", F.when((F.col("least") == F.col("most")) & (F.col("least") >= 0), F.col("least")).alias("__passes"))
    line = Window.partitionBy("__run").orderBy("__bucket")
    per = per.withColumn("island", F.row_number().over(line) - F.row_number().over(Window.partitionBy("__run", "__passes").orderBy("__bucket")))
    return per.groupBy("__run", "__passes", "island").agg(F.min("__bucket").alias("__low"), F.max("__bucket").alias("__high")).drop("island")


def _cut(docs: DataFrame, keyed: DataFrame, tally: DataFrame) -> DataFrame:
    """The rows of keyed, each for every pass that takes it, its text cut at what tally says of the row."""
    sizes = tally.groupBy("__id", "__from", "__a", "__b").agg(F.first("__size").alias("__size"), F.sum("__taken").alias("__taken"), F.count("*").alias("__held")).where("__taken > 0")
    sizes = staged(sizes, "sizes")
    same = (F.col("__h1") == F.col("__a")) & (F.col("__h2") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__from"))
    single, repeated = sizes.where("__held = 1"), sizes.where("__held > 1")
    one = keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "source", "__h1", "__h2"])
    rows = keyed.join(single, same).unionByName(one.join(repeated, same))
    rows = rows.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__taken") / F.col("__size")).cast("int") - 1)))
    words = F.least(F.col("__taken") - F.col("__turn") * F.col("__size"), F.col("__size")).cast("int")
    cut = F.array_join(F.slice(F.filter(F.split("text", SPACE), lambda w: w != ""), F.lit(1), F.greatest(words, F.lit(1))), " ")
    rows = rows.withColumn("__short", words < F.col("__size")).withColumn("text", F.when(F.col("__short"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__short"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row. A null text has no ids; repeated rows and null doc_ids stay."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", redact_secrets), ("mixing", mix_sources), ("tokens", tokens)]

#: SQL can't express trained classifiers, fingerprints of sampled keys and ranked merges; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        after = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        docs = before = after
    return docs
