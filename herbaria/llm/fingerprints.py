"""Document fingerprints: one-permutation MinHash with packed low-order bits.

The five-word shingles of a text are hashed once; the hash names a bin and each
bin keeps its minimum. Empty bins are filled by optimal densification. Of every
bin the lowest bits are packed. Two fingerprints agree in a bin by chance with
probability 2^-bits, and the likeness is corrected for that bias.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.llm.common import RollingHash, cut, mix64, norm_words, shingle_hashes, small_batches
from herbaria.llm.minhash import one_permutation

BINS, BITS, SHINGLE = 512, 4, 5
_HASH = RollingHash(5)


def fingerprint(text: str | None, bins: int = BINS, bits: int = BITS, n_words: int = SHINGLE) -> bytes:
    """Packed fingerprint of one text; a text without words has the empty fingerprint."""
    h = shingle_hashes(_HASH, *norm_words(text), n_words)
    if not len(h):
        return b""
    values = one_permutation(h, np.zeros(len(h), np.int64), 1, bins)[0]
    # Mixed with the bin, so that unequal values agree by chance in each bin on its own.
    low = (mix64(values + np.arange(bins, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint8)
    return np.packbits((low[:, None] >> shifts & 1).reshape(-1)).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated Jaccard similarity, corrected for chance agreement, in 0 to 1; two empty ones are alike."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    x, y = (np.packbits(np.unpackbits(np.frombuffer(f, np.uint8)).reshape(-1, bits), axis=1) for f in (a, b))
    chance = 0.5 ** bits
    return float(np.clip(((x == y).mean() - chance) / (1 - chance), 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) is replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = ("doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, first_text string, last_text string, n_rows long")


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, and compare with the next document.

    The next document follows in descending id, nulls last; after the last comes
    the first (a single document follows itself). Rows with equal ids stand in
    the order of a hash of their texts. Null texts are empty. Repeated rows come
    back each; an empty table gives no rows; other columns are ignored.

    Texts are range-partitioned and sorted once; a task streams its sorted part
    and needs one text at a time besides the next. Where parts meet, the first
    and last text of each part go to a table of at most one row per task, which
    is chained again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    parts = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = _OUT.format(id=id_type.simpleString())
    done = cut(parts.mapInArrow(_chain, schema), "fingerprints")
    # One row per task that had rows: its first and last text, in the order of the documents.
    ends = done.filter("n_rows is not null").select("doc_id", "first_text", "last_text")
    ring = ends.coalesce(1).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.xxhash64("last_text"))
    last = ring.mapInArrow(_close_ring, schema)
    return (done.filter("n_rows is null").unionByName(last)
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))


def _row(doc_id, text: str, own: bytes, following: str, next_own: bytes) -> dict:
    changed = edited(text, following)
    other = fingerprint(changed)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
            "fingerprint": base64.b64encode(own).decode(), "edited_fingerprint": base64.b64encode(other).decode(),
            "near_edited": likeness(own, other), "near_next": likeness(own, next_own),
            "first_text": None, "last_text": None, "n_rows": None}


def _batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
             ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
             ("first_text", pa.string()), ("last_text", pa.string()), ("n_rows", pa.int64())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted part but its last, then one row with the part's first and last text."""
    held, first, count, kind = None, None, 0, None
    for batch in batches:
        kind, out = batch.column(0).type, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = fingerprint(text)
            if held is None:
                first = text
            else:
                out.append(_row(*held, text, own))
            held, count = (doc_id, text, own), count + 1
        yield _batch(out, kind)
    if held is not None:
        yield _batch([{"doc_id": held[0], "first_text": first, "last_text": held[1], "n_rows": count}], kind)


def _close_ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the last text of each part to the first text of the next part, the last part to the first."""
    start, held = None, None
    for batch in batches:
        kind, out = batch.column(0).type, []
        for row in batch.to_pylist():
            if held is None:
                start = row["first_text"]
            else:
                out.append(_row(*held, fingerprint(held[1]), row["first_text"], fingerprint(row["first_text"])))
            held = (row["doc_id"], row["last_text"])
        yield _batch(out, kind)
    if held is not None:
        yield _batch([_row(*held, fingerprint(held[1]), start, fingerprint(start))], kind)
