"""Document pipeline: toxicity, exact dedup, near dedup, decontamination, then the mix of sources.

Each stage works on all rows its predecessor kept and returns the columns of documents, whatever they are;
the last one returns the mix (doc_id, source, block, slot, pos).

Of all stages: null and empty texts are documents like others, texts of any length are read whole, extra columns pass through, and
an empty table gives an empty result. Rows without doc_id stay in stages 2 to 4, which name rows by it.
"""

from embertide.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from embertide.llm.common import materialize


def toxic_stage(spark, docs, sf_dir):
    """Documents that the model scores below 0.5. Backoff counts come from the stage's own input.

    Each row stands for itself, repeated ones too; without labels of both kinds nothing goes.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def exact_stage(spark, docs, sf_dir):
    """The document of least doc_id of each exact text; null counts as empty, so one document without words stays. Rows that repeat a
    doc_id stand or fall together.
    """
    return exact_dedup.drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    """The document of least doc_id of each near-duplicate component; texts without words are like none and stay, rows that repeat a
    doc_id are one document.
    """
    return near_dedup.drop_near(docs)


def benchmark_stage(spark, docs, sf_dir):
    """Documents that hold no benchmark item; of rows that repeat a doc_id all go if one holds an item. An empty benchmark drops none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark, docs, sf_dir):
    """The place of each remaining document in the mix: every row once, ties by source name, then doc_id; a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mix_stage),
]
#: The scores, links and template windows of three stages have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
