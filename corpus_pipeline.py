"""The corpus pipeline: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents, whatever these are called, with every row that they keep as it was
(but for the masked text). All take null and empty texts, null and repeated ids, texts of any length and empty tables,
which give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import copies, langid, packing, pii, quality
from patchlens.llm.common import cut, discard, read, shared_dir, small_batches
from patchlens.llm.graph import hottest, near
from patchlens.llm.queries import PIECES, WORDS, vocabulary

#: Near-duplicates: words of a shingle, the least Jaccard similarity of a link (4/5), differing bits of candidates at
#: most. Two texts of equal size with similarity 0.8 share 0.889 of their shingles, an angle of 27 degrees, so 28 of 192
#: bits differ on average, with a deviation of 5; unrelated texts differ in 96 with a deviation of 7.
SHINGLE, LEAST, REACH = 5, (4, 5), 52

#: Nats a byte by which a learned language must explain a text's letters better than bytes drawn evenly. Texts of the
#: learned languages come to 2 or more, other scripts and noise to 1.3 or less.
LEAST_FIT = 1.5


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the whole row beside them: no column can clash with an operator's own."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those that no learned language explains.

    Languages are learned from the rows of docs that name one; where none does, every row is rejected.
    """
    counts = langid.word_counts(docs.select("doc_id", "text", "lang"))
    model = langid.fit([tuple(r) for r in counts], langid.public_pieces(vocabulary(PIECES)))
    found = langid.identify(carried(docs), model, ["_row"])
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("fit") >= LEAST_FIT)).select("_row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the classifier holds for bad.

    Without labels of both kinds every text has the same score: all stay, unless all labels are bad.
    """
    network = quality.fit(*quality.sample(docs, read(spark, sf_dir, "labels")))
    return quality.score(carried(docs), network, ["_row"]).filter("score >= 0.5").select("_row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row of the smallest doc_id (null comes last), of rows that are equal in all columns one.

    Rows that share a doc_id, or have none, but not their other columns are told apart by 128 bits of the whole row.
    Null and empty texts and those without words are one group. An empty table gives no rows.
    """
    small_batches(spark)
    row = [F.col(f"`{c}`") for c in docs.columns]
    whole = [x for c in row for x in (c, c.isNull())]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*whole).alias("row"), F.xxhash64(F.lit("row"), *reversed(whole)).alias("more"))
    rows = docs.select(key.alias("key"), "text", F.struct(*row).alias("_row"))
    kept = cut(copies.firsts(rows.select("key", "text"), SHINGLE, LEAST, REACH).distinct())
    rows = rows.select("key", "_row")
    # whole rows are shuffled only where too many go to name them
    keys = cut(rows.groupBy("key").agg(F.count("*").alias("n")))
    gone = cut(keys.join(kept, "key", "left_anti").select("key"))
    # of the keys of most rows, which are equal, one row goes on
    hot = [(r["key"],) for r in hottest(keys, "n")]
    if hot:
        many = F.broadcast(spark.createDataFrame(hot, keys.select("key").schema))
        rows = rows.join(many, "key", "left_anti").unionByName(rows.join(many, "key", "left_semi").dropDuplicates(["key"]))
    few = near(gone)
    out = rows.join(few, "key", "left_anti") if few is not gone else rows.join(kept, "key", "left_semi")
    equal = cut(keys.filter("n > 1").select("key"))
    if equal.take(1):
        out = out.join(near(equal), "key", "left_anti").unionByName(out.join(near(equal), "key", "left_semi").dropDuplicates(["key"]))
    return out.select("_row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows. A null text becomes an empty one."""
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return pii.masked(pii.scan(carried(docs))).select(row.alias("_row")).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document; its text is left where it is.

    Null and empty texts are one token, the end. Rows of equal length are placed in no certain order among them; repeated
    rows are packed each, and rows without a doc_id keep none.
    """
    small_batches(spark)
    return packing.pack(docs, packing.Tokenizer(vocabulary(WORDS)))


STAGES = [("language", language), ("quality", good), ("near-duplicates", distinct), ("personal data", private), ("packing", packed)]

#: A convolutional network decides, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a table goes once the next is written."""
    shared_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            discard(spark, f"{folder}/{i - 1}")
    return docs
