"""Substring dedup: passages that occurred before are removed, with their original offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import choose, stage

#: What ends a unit. A clause ends at a mark and white space or at a line end: a passage that begins and ends inside
#: lines still has most of its clauses in common with its other occurrences.
ENDS = {"clause": r"[.!?,;:][\x20\x09-\x0D]|\n", "line": r"\n", "paragraph": r"\n\n"}
#: A clause of fewer words goes with the next one of its line, which saves a third of all units.
SHORT = 4
#: Words of a passage. Shorter runs of repeated units are the stock phrases of any two texts and stay.
PASSAGE = 16


def units(docs: DataFrame, unit: str = "clause", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, start, length, words, digest of each unit; a text's units make up the whole of it, if it has a word.

    A unit includes what ends it. Units without a word go with the next one,
    clauses of fewer than SHORT words with the next one of their line. row
    tells the rows of docs apart. start and length count code points of the
    original text, from 0. The digest is that of the unit with A-Z in lower
    case, ASCII white space at its ends cut and runs of it made one blank.
    """
    end, least = ENDS[unit], SHORT if unit == "clause" else 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        ends = re.compile(end)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                of, starts, lengths, counts, digests = [], [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    start = at = 0
                    held: list[bytes] = []
                    for to in (*(m.end() for m in ends.finditer(t)), len(t)):
                        w = t[at:to].encode().lower().split()  # of bytes, so by ASCII
                        at = to
                        held += w
                        if held and (len(w) >= least or t[to - 1] == "\n" or to == len(t)):
                            of.append(i)
                            starts.append(start)
                            lengths.append(to - start)
                            counts.append(len(held))
                            digests.append(xxhash.xxh3_128_digest(b" ".join(held)))
                            start, held = to, []
                    if of and of[-1] == i:
                        lengths[-1] = len(t) - starts[-1]  # white space at the end
                of = pa.array(of, pa.int64())
                numbers = [pa.array(x, pa.int32()) for x in (starts, lengths, counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(of), part.column(1).take(of), *numbers, pa.array(digests, pa.binary())], ["doc_id", "row", "start", "length", "words", "digest"]
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row long, start int, length int, words int, digest binary")


def _cut(docs: DataFrame, unit: str, passage: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, row, start, length, keep of each unit to remove."""
    every = stage(units(docs, unit, doc_id, text).withColumn("none", F.col("doc_id").isNull()), "units")
    # Nothing is the order of repeated rows but their own number, so that is what ties fall to.
    again = choose(every, "digest", ("none", "doc_id", "start", "row"), largest=False, every=False).where(~F.col("first")).drop("digest", "none", "size", "first")
    # Neighbouring repeated units are one passage. Only repeated units are sorted, by document.
    by = Window.partitionBy("row").orderBy("start")
    apart = F.coalesce(F.lag(F.col("start") + F.col("length")).over(by) != F.col("start"), F.lit(True))
    runs = again.withColumn("_apart", apart).withColumn("_run", F.sum(F.col("_apart").cast("long")).over(by))
    whole = Window.partitionBy("row", "_run")
    return runs.withColumn("_words", F.sum("words").over(whole)).where(F.col("_words") >= passage)


def removed(docs: DataFrame, unit: str = "clause", passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit to remove: doc_id, start, length, keep_doc_id, keep_start.

    Of equal units over all documents the earliest stays, by doc_id, then by
    place in the document; null ids come last. Neighbouring units of a
    document that occurred before form a run; runs of at least `passage` words
    go, however short their units are. Of repeated rows one keeps its units.
    Null text counts as empty and has no units; documents without repeated
    passages give no rows, nor does an empty table. Other columns are ignored.

    Units are staged once. Frequent digests are settled against a broadcast of
    their winners; for others the earliest is aggregated and joined back.
    """
    start = F.col("start").cast("long").alias("start")
    keep = (F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").cast("long").alias("keep_start"))
    return _cut(docs, unit, passage, doc_id, text).select("doc_id", start, F.col("length").cast("long").alias("length"), *keep)


def clean(docs: DataFrame, unit: str = "clause", passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their repeated passages; the column removed lists the spans cut, in the original's offsets.

    What is left is the text without these spans: a unit includes what ends
    it. Rows are told apart by a number of their own, so repeated rows and ids
    are handled; an earlier number ranks first here. All columns stay; a
    column named removed is replaced.
    """
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    cuts = _cut(numbered, unit, passage, "_row", text).groupBy(F.col("doc_id").alias("_row")).agg(F.array_sort(F.collect_list(span)).alias("removed"))
    t, none = F.col(text), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    marked = numbered.drop("removed").join(cuts, "_row", "left").withColumn("removed", F.coalesce("removed", none))
    end = F.array(F.struct(F.length(t).cast("long").alias("start"), F.lit(0).cast("long").alias("length")))
    every = F.concat("removed", end)
    # What lies between the end of a span and the start of the next one.
    kept = F.transform(
        every,
        lambda x, i: F.substring(
            t,
            (F.when(i > 0, F.get(every, i - 1)["start"] + F.get(every, i - 1)["length"]).otherwise(0) + 1).cast("int"),
            (x["start"] - F.when(i > 0, F.get(every, i - 1)["start"] + F.get(every, i - 1)["length"]).otherwise(0)).cast("int"),
        ),
    )
    return marked.withColumn(text, F.when(F.size("removed") == 0, t).otherwise(F.array_join(kept, ""))).drop("_row")
