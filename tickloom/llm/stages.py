"""What the pipeline does with the operators' results: filters, rewrites and repeats of documents."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import unused
from tickloom.llm.jaccard import JaccardSpec, jaccard_rows
from tickloom.llm.mixing import mix_sources, word_count
from tickloom.llm.packing import placed_pieces, sequences
from tickloom.llm.secrets import redact_secrets
from tickloom.llm.toxicity import learn_lexicon, score_toxicity
from tickloom.session import stage

_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score below ``least``. Null and empty texts stay; repeated rows share their fate; columns keep their names."""
    key = unused(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    lexicon = learn_lexicon(docs.select("doc_id", "text"), labels)
    # only keys come back from the scoring; rows never pass through Python
    toxic = stage(score_toxicity(keyed.select(key, "text"), lexicon).where(F.col("score") >= least).select(key).distinct())
    return keyed.join(toxic.hint("merge"), key, "left_anti").select(*docs.columns)  # the same plan at every size


def one_of_each_group(docs: DataFrame, spec: JaccardSpec) -> DataFrame:
    """One row of each group of linked texts: one with the smallest doc_id; rows without an id come last.

    Groups are told apart by their texts: rows with equal ids or none and unlinked texts are in groups of their own. Texts without words
    are in no group and all stay. Of rows with that smallest id, the one with the smallest hash of id and text stays; rows that agree in both
    are one, whatever their other columns. The join runs on that hash alone, and texts are moved only where the rows to keep are picked.
    """
    names = docs.columns
    key = unused(names, "row_key")
    blank = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    keyed = docs.where(~blank).withColumn(key, F.xxhash64("doc_id", "text"))
    groups = jaccard_rows(keyed.select(F.col(key).alias("doc_id"), "text"), spec).select(F.col("doc_id").alias("k"), "grp").distinct()
    ids = keyed.groupBy(F.col(key).alias("k")).agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count("*").alias("times"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "times")).alias("first")
    keep = stage(groups.join(ids.hint("merge"), "k").groupBy("grp").agg(first).select(F.col("first.k").alias(key), "first.times"))
    kept = keyed.join(keep.select(key).hint("merge"), key, "left_semi")  # the same plan at every size
    many = keep.where("times > 1").select(key)
    parts = [docs.where(blank)]
    if many.limit(1).count():
        row = F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")
        parts.append(kept.join(many, key, "left_semi").groupBy(key).agg(row).select("row.*"))
        kept = kept.join(many, key, "left_anti")
    for p in parts:
        kept = kept.select(*names).unionByName(p)
    return kept


def without_secrets(docs: DataFrame) -> DataFrame:
    """Every row, with its secret spans replaced; n_chars follows the text. Nulls, empty texts, repeated rows and other columns stay as they are."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def first_words(text: str, n: int) -> str:
    """``text`` up to the end of its ``n``-th word."""
    for i, m in enumerate(_WORD.finditer(text), 1):
        if i == n:
            return text[:m.end()]
    return text


def balanced_mix(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them whole, and once more, cut after the last word taken, for the rest.

    Documents that the mix takes nothing of go, with those without words. Ids repeat with their rows. Rows that agree in id, source and text
    are taken together. n_chars follows the text where it is cut. A null source is a source; other columns keep their names and values.
    """
    names = docs.columns
    at, own, whole_times, left, copy = names.index("text"), *(unused(names, n) for n in ("mix_key", "mix_whole", "mix_rest", "mix_copy"))
    key = F.xxhash64("doc_id", "source", "text")
    taken = mix_sources(docs.select(key.alias("doc_id"), "text", "source")).where("taken > 0")
    per = stage(taken.groupBy(F.col("doc_id").alias(own)).agg(F.sum(F.expr("taken div size")).alias(whole_times), F.max(F.expr("taken % size")).alias(left), F.count("*").alias("times")))
    keyed = docs.withColumn(own, key)
    many = per.where("times > 1").select(own)
    if many.limit(1).count():
        keyed = keyed.join(many, own, "left_anti").unionByName(keyed.join(many, own, "left_semi").dropDuplicates([own]))
    whole = keyed.join(per.where(F.col(whole_times) > 0).select(own, whole_times).hint("merge"), own)  # the same plan at every size
    whole = whole.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(whole_times)))).select(*names)
    rest = keyed.join(per.where(F.col(left) > 0).select(own, left), own).select(*names, left)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [first_words(t, n) for t, n in zip(batch.column(at).to_pylist(), batch.column(left).to_pylist())]
            yield batch.drop_columns(left).set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    rest = rest.mapInArrow(cut, docs.schema)
    if "n_chars" in names:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)
    return whole.unionByName(rest)


def packed(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all rows in sequences of at most 2048 ids: the columns of op7. The sequences with their ids stay at ``path``.

    A null or empty text is its end id alone; repeated rows are packed each; other columns are left out; an empty table gives no rows.
    """
    return placed_pieces(sequences(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), path))
