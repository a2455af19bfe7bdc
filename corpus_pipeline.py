"""A training corpus from raw documents: five stages, each over all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, minhash, mixing, secretscan
from tessera.llm.queries import ASSIGN, ORACLES
from tessera.sources.tables import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null text, or text without a letter. Where no row is labelled, that is looked up alone."""
    model = langid.train(docs)
    if not model[0]:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    out = langid.predict(docs, model, docs.columns, ("__lang", "__score"))
    return out.where(F.col("__lang") != langid.UND).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least doc_id stays; of repeated rows (doc_id and text) one."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    # the number of copies has no bound, so they are never broadcast
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns).dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by [SECRET]; n_chars follows."""
    out = secretscan.redact(docs)
    return out.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: how many of its words the mix takes, repeats counted."""
    return mixing.taken(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", scan_secrets),
    ("mixing sources", mix_sources),
]

def _over(name: str, rows: str) -> str:
    """An operator's SQL over other rows than the table `documents`."""
    return re.sub(r"\bdocuments\b", rows, ORACLES[name])


#: What run() returns. Language ID takes part by what it rejects, which is text without a letter. A secret becomes one
#: word; spans that only the network finds hold no white space, and so change no number of words either.
ORACLE_SQL = rf"""
with d1 as (select * from documents where regexp_matches(text, '\p{{L}}')),
g as ({_over("op8_minhash_dedup", "d1")}),
d2 as (select distinct on (doc_id, text) * from d1 where not exists (select 1 from g where g.doc_id = d1.doc_id and not g.kept)),
l as ({_over("op9_decontamination", "d2")}),
d3 as (select * from d2 where not exists (select 1 from l where l.doc_id = d2.doc_id)),
cut as (select doc_id, source, regexp_split_to_array(text, '{ASSIGN}') as rest, regexp_extract_all(text, '{ASSIGN}') as hit, regexp_extract_all(text, '{ASSIGN}', 1) as val from d3),
d4 as (
  select doc_id, source, array_to_string([rest[i] || case when i > len(hit) then '' when length(val[i]) >= 6 then '[SECRET]' else hit[i] end for i in range(1, len(hit) + 2)], '') as text from cut)
select * from ({_over("op6_mixing", "d4")})"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
