"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, packing, simhash
from tidemark.llm.common import drop_tables, fresh, materialize, noted, table
from tidemark.llm.queries import tokenizer_path, toxic_scores


#: Intermediate tables of the stage called last, by application.
_scratch: dict[str, list[str]] = {}


def keeping(*names: str):
    """A stage whose operator adds columns of these names: the documents' own columns so named stand aside meanwhile.

    A stage's result reads its intermediate tables until it is written. When the
    next stage is called on documents that don't read them, which is to say on
    the written result, they go.
    """

    def wrap(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            app, read = spark.sparkContext.applicationId, docs.inputFiles()
            old = _scratch.pop(app, [])
            done = [p for p in old if not any(p.split(":", 1)[-1].lstrip("/") in f for f in read)]
            if len(done) == len(old):
                drop_tables(spark, done)
            aside = {c: f"_own_{c}" for c in docs.columns if c in names}
            with noted() as own:
                out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
            _scratch[app] = own if len(done) == len(old) else [*old, *own]
            return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*(docs.columns if names else out.columns))

        return run_stage

    return wrap


@keeping("score")
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic (0.5 or more) after deobfuscation go."""
    scored = toxic_scores(spark, docs, sf_dir)
    return scored.filter(F.col("score") < 0.5).select(*docs.columns)


@keeping("n_lines", "n_removed")
def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five or more sources go from all documents but their first; no document goes."""
    out = lines.drop_shared_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.col("n_removed") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@keeping()
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document of the least id stays.

    Rows of one id and text are one document, of which the row stays whose other
    columns come first as JSON. Of a group without any id one document stays.
    """
    found = simhash.near_copies(docs.select("doc_id", "text"))
    head_id, head_hash, row_hash = fresh(docs.columns, "_head_id", "_head_hash", "_row_hash")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    heads = found.groupBy("root").agg(first).select(F.col("first.id").alias(head_id), F.col("first.hash").alias(head_hash))
    rows = docs.withColumn(row_hash, F.xxhash64("text"))
    kept = rows.join(heads, F.col("doc_id").eqNullSafe(F.col(head_id)) & (F.col(row_hash) == F.col(head_hash)), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    (whole,) = fresh(docs.columns, "_whole")
    first = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*others)) if others else F.lit(0)).alias(whole)
    return kept.groupBy("doc_id", row_hash).agg(first).select(f"{whole}.*")


@keeping("size", "source_size", "target", "copies")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each copy that the mix takes of it, or not at all."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    mixed = mixing.mix(docs, "doc_id", keep=rest).filter(F.col("copies") > 0)
    (copy,) = fresh(mixed.columns, "_copy")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


@keeping()
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, ids included, with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path(), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't tell the learned scores, the fingerprints and the packing; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; a stage's intermediate tables go when the next one begins, its result when the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        with noted() as written:
            docs = materialize(out, f"pipeline-{k}")
        drop_tables(spark, last)
        last = written
    return STAGES[-1][1](spark, docs, sf_dir)
