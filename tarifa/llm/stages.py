"""The operators as stages of a pipeline over documents: each returns the rows it keeps, with the columns of documents.

What operators decide is applied row by row: a stage gives them a row's key in place of its doc_id. Keys are 64 bits of id and text, so two
different rows share one with a chance of one in 2**64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm import exact, jaccard, mixing, packing, rules
from tarifa.llm.shared import BROADCAST_ROWS, forget, join_small, seen, stored


#: The key of a row within a stage: 64 bits of its id and text. Ids may be null, repeated or shared; rows with one id and one text are repeats.
ROW = "_row"


def _row():
    return F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text").alias(ROW)


def _by_row(docs: DataFrame) -> DataFrame:
    """What an operator is given: its doc_id is the row's key, so that it decides by that."""
    return docs.select(_row().alias("doc_id"), "text")


def _whole(docs: DataFrame, *more) -> DataFrame:
    """Each row of docs as one column `doc`, so that its own columns' names meet no others."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *more)


def _join(rows: DataFrame, keys: DataFrame, how: str, n: int) -> DataFrame:
    """rows joined by key; the n keys are broadcast up to BROADCAST_ROWS, and shuffled beyond."""
    return rows.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, ROW, how)


def _one_a_group(docs: DataFrame, found: DataFrame, best) -> DataFrame:
    """docs but for all rows of each group except the best; found: (ROW, group) of all rows of groups; best: an aggregate of struct(doc_id, ROW)s."""
    members = found.groupBy("group", ROW).agg(F.count("*").alias("times"))
    members = stored(members.join(docs.select(_row(), "doc_id").distinct(), ROW), "stage-members")
    stays = stored(members.groupBy("group").agg(best.alias("stays")).select("group", F.col(f"stays.{ROW}").alias("stays")), "stage-stays")
    judged = join_small(members, stays, ["group"])
    judged = judged.withColumn("goes", F.col(ROW) != F.col("stays")).where("goes or times > 1").select(ROW, "goes")
    judged = stored(judged, "stage-judged", gone=F.count_if("goes"), again=F.count_if(~F.col("goes")))
    gone, again, n = judged.where("goes").select(ROW), judged.where("not goes").select(ROW), seen(judged)
    kept = _join(_whole(docs, _row()), gone, "left_anti", n["gone"])
    if n["again"]:
        once = _join(kept, again, "left_semi", n["again"]).groupBy(ROW).agg(F.any_value("doc").alias("doc"))  # repeats: any will do, whatever their columns' types
        kept = _join(kept, again, "left_anti", n["again"]).select("doc").unionByName(once.select("doc"))
    return kept.select("doc.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Documents that the line rules keep, without the lines that fail; n_chars, where docs has it, follows the text.

    Every row is judged by its own text, whatever its id; repeated rows are judged alike, so ties don't arise. Null and empty texts have no
    words and go. A very long text is judged whole, line by line. An empty table stays empty; all columns come through, whatever their names.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever names are
    at_text, at_size = docs.columns.index("text"), docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def clean(batches):
        forget()
        for batch in batches:
            found = [rules.cleaned(x.as_py()) for x in pc.fill_null(batch.column(at_text), "").cast(pa.binary())]
            kept = [i for i, (row, _) in enumerate(found) if row[-1]]
            batch = batch.take(pa.array(kept, pa.int64()))
            columns = batch.columns
            text = columns[at_text] = rules.strings([found[i][1] for i in kept], batch.column(at_text).type)
            if at_size is not None:
                lost = pa.array([found[i][0][7] > 0 for i in kept], pa.bool_())
                columns[at_size] = pc.if_else(lost, pc.utf8_length(text).cast(columns[at_size].type), columns[at_size])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, A-Z lower-cased: one with the largest id, a null one being less than any.

    Ids may be null, repeated or shared; of repeated rows one stays. Ties (one id on texts that differ in case only) go by the row's key.
    Null and empty texts are equal. Texts are compared whole. An empty table stays empty; all columns come through, whatever their names.
    """
    found = exact.exact_duplicates(_by_row(docs)).where("group_size > 1").select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group"))
    return _one_a_group(docs, found, F.max(F.struct("doc_id", ROW)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: one with the least id, a null one only where no other is.

    Rows of one text are near copies whatever their ids; of repeated rows one stays; ties go by the row's key. Null and empty texts and texts
    without words link with nothing, and their rows all stay. Texts are compared whole. An empty table stays empty; all columns come
    through, whatever their names.
    """
    found = jaccard.jaccard_components(_by_row(docs)).where("n_shingles > 0").select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    found = stored(found, "stage-components")
    several = stored(found.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "stage-groups")
    return _one_a_group(docs, join_small(found, several, ["group"]), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)))


def mixture(docs: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it, row by row, whatever its id.

    Null and empty texts and texts without words, which the mix takes for no words, go. Repeated rows are taken each as its own hash says; a null
    source is a source; ties don't arise. A very long text counts with all its words. An empty table stays empty; all columns come
    through, whatever their names.
    """
    return mixing.repeated(docs)


def packed(docs: DataFrame) -> DataFrame:
    """Where each piece of each document stands, and its ids: the packed sequences.

    Null and empty texts are one piece of the end id; very long texts are cut into pieces; repeated rows are packed each; a null id stays null; ties in
    length go by id and piece. An empty table gives an empty result; other columns are not read.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)
