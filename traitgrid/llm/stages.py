"""The stages of the corpus pipeline that decide on documents (``doc_id, text, lang, source, n_chars``).

Each takes ``(spark, docs, sf_dir)`` and returns documents of the same columns; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitgrid.llm import mixing, packing, quality, simhash, substring
from traitgrid.llm.common import stored
from traitgrid.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Targets of the mixture: token shares of each marginal to this power.
POWER = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps. Rows ride along with their ledger line, nothing is shuffled; the ledger
    is a table in the shared folder, where rejected rows stay with their failure bits.

    A null or empty text fails (too few words); a null id, lang or source is carried; repeated rows are judged
    alike; an empty table gives none."""
    return quality.verdicts(quality.stored_ledger(docs, COLUMNS), "standard-v1").filter("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, apart: bool = True) -> DataFrame:
    """One row of each group stays: the one with the smallest id (of several texts under
    that id, the smallest hashes). Rows without an id come after all others; with
    ``apart`` they are groups of their own, so one of them stays beside a named row."""
    found = stored(simhash.chosen(docs.select("doc_id", "text"), shingle=3, max_bits=2, apart=apart), "pipeline-chosen")
    n = F.count_if("chosen").alias("n")
    named = stored(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("i")).agg(n, F.count(F.lit(1)).alias("m")), "pipeline-named")
    # fewer documents go than stay: texts are held against those that go, in a table of its true size
    gone = stored(named.filter("n = 0").select("i"), "pipeline-gone")
    kept = docs.join(gone, F.col("doc_id") == F.col("i"), "left_anti").select(*COLUMNS)
    # what is left of ids with several rows, and rows without an id, go by id and text
    several = found.join(named.filter("n > 0 and m > 1"), F.col("doc_id") == F.col("i"), "left_semi").union(found.filter("doc_id is null"))
    keys = stored(several.groupBy(F.col("doc_id").alias("i"), "h", "g").agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("m")), "pipeline-several")
    if keys.isEmpty():
        return kept
    h, g = simhash.text_hashes()
    on = F.col("doc_id").eqNullSafe(F.col("i")) & (h == F.col("h")) & (g == F.col("g"))
    rows = kept.join(keys, on, "left").filter("chosen is null or chosen")
    again = rows.filter("m > 1").groupBy("i", "h", "g").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return rows.filter("m is null or m = 1").select(*COLUMNS).union(again)


def near_dedup_of_all_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group, with or without an id."""
    return near_dedup_stage(spark, docs, sf_dir, apart=False)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 13 words taken out of all but the document with the smallest
    id. Rows without an id come after all others (before them, if few numbers are free
    there), by a hash of their text."""
    docs = docs.select(*COLUMNS)
    if docs.filter("doc_id is null").isEmpty():
        return substring.remove_repeated(docs)
    kind = docs.schema["doc_id"].dataType
    ids = F.col("doc_id").cast("long")
    least, most = docs.agg(F.coalesce(F.min(ids), F.lit(0)), F.coalesce(F.max(ids), F.lit(0))).first()
    above, below = (1 << 63) - 1 - most, least + (1 << 63)
    after = above >= min(below, 1 << 61)
    step = F.pmod(F.xxhash64("text"), F.lit(min(above if after else below, 1 << 62)))
    number = F.lit(most) + 1 + step if after else F.lit(least) - 1 - step
    numbered = docs.withColumn("unnamed", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce(ids, number))
    out = substring.remove_repeated(numbered)
    return out.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id")).cast(kind)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities raked to the target marginals.

    A null lang or source is a value of its own, a document without words has no tokens and takes part with
    its cell's probability; repeated rows have the same id and text and so the same draw; an empty table gives none."""
    return mixing.mixture(docs, POWER, carry=COLUMNS).filter("sampled").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row a piece. A null or empty text is the end token alone; repeated rows are
    packed each; ties go by order of size; an empty table gives none."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
