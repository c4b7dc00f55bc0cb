"""Document fingerprints: digests of a canonical form, and groups of equal documents."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_parts

#: Documents that one range of the order of doc_id holds, about.
RANGE_ROWS = 4096


def canonical(text: str | None) -> bytes:
    """NFKC form, case folded, each run of white space one space, none at the ends; UTF-8. Null is empty."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def packed(form: bytes) -> bytes:
    """A form without loss in fewer bytes; equal if and only if the forms are."""
    return zlib.compress(form)


def likeness(a: bytes, b: bytes) -> float:
    """1.0 if two canonical forms have the same digest and the same bytes, else 0.0."""
    return float(digest(a) == digest(b) and a == b)


def form_groups(docs: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """fingerprint, apart, group_id (smallest doc_id with a canonical form), n_copies for each form, and the digests
    that several forms share: only for these apart is the packed form, else it is empty.

    Rows are grouped by their digest and by their bytes, packed without loss. Minima and counts are combined before the
    shuffle, so one group with a third of all rows is no hot task. Digests that collide come to the driver.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = [canonical(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(x) for x in form], pa.string()), pa.array([packed(x) for x in form], pa.binary())], ["doc_id", "fingerprint", "form"])

    rows = docs.select("doc_id", "text").mapInArrow(forms, "doc_id long, fingerprint string, form binary")
    each = rows.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    # Written, as it is read twice.
    light = materialise(each.select("fingerprint", F.lit(b"").alias("apart"), "group_id", "n_copies"))
    mixed = frozenset(r["fingerprint"] for r in light.groupBy("fingerprint").count().where("count > 1").collect())
    if mixed:
        shared = F.col("fingerprint").isin(*sorted(mixed))
        light = light.where(~shared).unionByName(each.where(shared).withColumnRenamed("form", "apart"))
    return light, mixed


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id (smallest doc_id with this canonical form), n_copies for every row of docs."""
    return fingerprints(docs).select("doc_id", "fingerprint", "group_id", "n_copies")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text for every row: the text of the next row in order of (doc_id, text), nulls first; after
    the last row the first. Null texts are empty.

    The order is cut into ranges of doc_id at quantiles; each range also gets the rows that open the next range, so a
    task needs nothing of other tasks. Only the ranges' first ids (one a range) come to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    if not n:
        return rows.withColumn("next_text", F.col("text"))
    ranges = max(1, min(n // RANGE_ROWS, 4096), min(n, shuffle_parts(spark)))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    at = F.coalesce(F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at)
    first = rows.groupBy(at.alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))).alias("h")).orderBy("part").collect()
    # One row a range, at most 4096: bounded, so broadcast.
    heads = spark.createDataFrame([(r["h"]["doc_id"], first[i - 1]["part"]) for i, r in enumerate(first)], "head_id long, lender int")
    rows = rows.join(F.broadcast(heads), rows.doc_id.eqNullSafe(heads.head_id), "left")
    own = F.struct(at.cast("int").alias("part"), F.lit(0).alias("borrowed"))
    lent = F.struct(F.col("lender").alias("part"), F.lit(1).alias("borrowed"))
    links = F.when(F.col("lender").isNull(), F.array(own)).otherwise(F.array(own, lent))
    placed = rows.select("doc_id", "text", F.explode(links).alias("p")).select("doc_id", "text", "p.part", "p.borrowed")
    placed = placed.repartition(len(first), "part").sortWithinPartitions("part", "borrowed", F.col("doc_id").asc_nulls_first(), "text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, part) of the last own row

        def out(rows_):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.string()), pa.array([r[2] for r in rows_], pa.string())], ["doc_id", "text", "next_text"])

        for b in batches:
            done, size = [], 0
            for doc_id, text, part, borrowed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and part == held[2]:
                    done.append((held[0], held[1], text))
                    size += len(held[1])
                    held = None
                if not borrowed:
                    held = (doc_id, text, part)
                if size > 4 << 20:
                    yield out(done)
                    done, size = [], 0
            if done:
                yield out(done)
        if held is not None:  # never the case: every range borrows a row
            raise AssertionError("a range ended without the next range's first row")

    return placed.mapInArrow(follow, "doc_id long, text string, next_text string")


def edit(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digests of every document and of its edited text, the likeness to the edited text and the next document, and the
    group of documents with equal canonical bytes.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id (the
    group's smallest doc_id), n_copies (its rows). A null text is empty; empty texts have the digest of no bytes. With one row the next document is the document itself. Repeated
    rows follow each other; ties of an id are in order of the text. An empty table gives an empty result; a very long text
    is digested whole. Other columns are ignored, whatever their names.
    """

    groups, mixed = form_groups(docs)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text, following in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                changed = edit(text, following)
                own, new = canonical(text), canonical(changed)
                for c, v in zip(cols, (len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, canonical(following)), packed(own) if digest(own) in mixed else b""), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "apart"])

    rows = with_next(docs).mapInArrow(prints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, apart binary")
    return rows.join(groups, ["fingerprint", "apart"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "n_copies")
