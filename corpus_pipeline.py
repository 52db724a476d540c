"""From raw documents to packed sequences: the stages in order.

Each stage takes what its predecessor kept. All but the last return the columns of
documents: toxic documents go; one document of each near-duplicate class stays;
passages of ``PASSAGE_WORDS`` words that occur more than once stay where they occur
first; documents are repeated or cut as the mix of sources takes them; the last
stage packs token sequences.

Defined results: a null text is empty; empty texts are not toxic, are copies of each other,
lose nothing, are not taken by the mix (it takes words) and so are not packed; rows without an
id take part in all stages and stand for a class only where no row with an id does; repeated
rows are copies; an empty table gives no rows in any stage; further columns of the input come
through all stages but the last as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postquill.llm import mixing, neardup, packing, suffixes, toxicity
from postquill.session import materialise, table

#: Passages of over 50 words, whatever their length in bytes.
PASSAGE_WORDS = 51


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with further columns of these names called otherwise, and how to call them again."""
    other = {c: f"__of_input_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(other), {v: k for k, v in other.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The model learns from the labelled ones
    among them; without any labels of both kinds nothing goes."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, tuple(docs.columns))
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, whether or not its rows have ids; repeated rows count once."""
    return neardup.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which nothing is left goes; lengths are counted anew."""
    rows, names = _aside(docs, "n_removed", "slice", "cols", "sizes", "blob")
    cut = suffixes.remove_repeats(rows, PASSAGE_WORDS, keep_first=True, digest=False, unit="word")
    cut = cut.where((F.col("n_removed") == 0) | (F.trim("text") != "")).drop("n_removed")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).withColumnsRenamed(names).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as it is taken whole; of the rest its first words."""
    own = ("size", "source_size", "target", "taken")
    rows, names = _aside(docs, *own)
    mixed = mixing.mix(rows, keep=tuple(rows.columns), cut=False)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    takes = F.concat(F.array_repeat(F.lit(-1).cast("long"), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    taken = mixed.withColumn("__take", F.explode(takes))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), 1, F.greatest(F.col("__take"), F.lit(0)).cast("int")), "")
    taken = taken.withColumn("text", F.when(F.col("__take") < 0, F.col("text")).otherwise(first))
    return taken.withColumn("n_chars", F.char_length("text").cast("long")).drop(*own).withColumnsRenamed(names).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, as ``packing.pack`` gives them."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", drop_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Stages 1 to 3 and 5 have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
