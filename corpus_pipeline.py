"""Pipeline of the training-data operators over `documents`: toxicity, near duplicates, benchmark leaks, mixing, token files.

Each stage takes what its predecessor kept, as Parquet read again, and returns
the columns of documents; the last writes the token files and returns what is
read back from them. Null, empty and repeated rows pass through each stage as
its operator's docstring says; an empty table passes all stages.
"""

from loomgraph.llm import decontaminate, mixing, near_join, token_files, toxicity
from loomgraph.llm.common import drop_stage, small_batches, stage, table
from loomgraph.llm.queries import tokenizer_path

#: SQL can express neither the learned scores, nor the latent retrieval, nor the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark, docs, sf_dir):
    """Documents that the model trained on `labels` predicts toxic go.

    Null, empty and hitless texts have the base score and stay where that is low; repeated rows are judged alike; null ids
    and all columns are kept; without labels of both kinds nothing is learned.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one of the smallest id (null first), once if its row is repeated.

    Null, empty and blank texts are in no group and all stay; texts of under five words are compared whole.
    """
    small_batches(spark)
    return near_join.keep_one(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold an item of `benchmark` go; null and empty texts and items hold and are nothing; whole texts are searched."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them; at a source's cut, one in part. Texts without words stay once; null is a source of its own."""
    return mixing.mixed_rows(docs)


def write_tokens(spark, docs, sf_dir):
    """Arrow files of fixed-size lists; a row for each document in them. Null and empty texts are their end id; repeats stand beside each other."""
    small_batches(spark)
    return token_files.read(token_files.write(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        before, docs = docs, f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
            if k:
                drop_stage(before)
    return docs
