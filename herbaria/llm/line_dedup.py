"""Line dedup: fuzzy lines by MinHash, exact verification, distributed union-find.

A line is stripped of ASCII white space at its ends; blank lines are never duplicates.
Equal lines form one class. The character shingles of each class give a
one-permutation MinHash signature whose bands are hashed to buckets (high
recall: few rows to a band, many bands). Classes that share a bucket are
verified by the exact Jaccard similarity of their shingle sets; links go to
union-find; of every component the first line (smallest document id, then
position) stays and all others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herbaria.llm.common import Forest, cut, drop_cut, mix64, pairs_of_runs, small_batches, with_row_key
from herbaria.llm.components import connected_components
from herbaria.llm.minhash import EMPTY, one_permutation

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 10, 4, 0.8
#: Classes of one bucket that are compared in one group; larger buckets are compared block by block.
BLOCK_ROWS = 256
#: Rows of an Arrow batch of single lines.
LINE_ROWS = 2000
#: Rows of an Arrow batch of bucket numbers, and postings of one task that finds those that are shared.
KEY_ROWS, PART_POSTINGS = 50_000, 4_000_000
#: Bits of a line's shingle bitmap, and code points whose shingles are spread at once.
BITMAP, CHUNK_CHARS = 2048, 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
SPACE = " \t\n\x0b\x0c\r"


def line_shingles(lines: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-character shingles of every line, repeats included, and the line of each.

    Only the lower bytes of eight characters enter, read as one number: equal
    shingles have equal hashes, and candidates are verified later. Longer shingles
    take the hash of every eight characters in them. A line shorter than ``n``
    characters has one shingle, the whole line.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    low = np.append(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint8)[::4], np.zeros(8, np.uint8))
    eight = np.ndarray(len(low) - 8, np.uint64, low, 0, (1,))
    counts = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(lines)), counts)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    h = eight[at] if n >= 8 else eight[at] & np.uint64(256 ** n - 1)
    for k in [*range(8, n - 8, 8), n - 8] if n > 8 else []:
        h = mix64(h, 5) ^ eight[at + k]
    short = np.flatnonzero((sizes < n) & (sizes > 0))
    alone = np.array([hash_short(lines[i]) for i in short], np.uint64)
    return mix64(np.concatenate((h, alone)), 17), np.concatenate((owner, short))


def hash_short(line: str) -> int:
    """Hash of a line that is shorter than a shingle."""
    h = len(line)
    for c in line:
        h = (h * int(_M) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> np.ndarray:
    """Bucket of every band, shape (lines, bands)."""
    h, owner = line_shingles(lines, n)
    sig = one_permutation(h, owner, len(lines), bands * rows).reshape(len(lines), bands, rows)
    key = np.zeros((len(lines), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * _M + sig[:, :, r], 3 + r)
    return key.view(np.int64)


def bitmaps(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of every line's shingles as rows of words, and the number of its shingles, repeats included.

    The bit depends on the shingle alone, so bits set in one of two bitmaps only
    are at most the shingles in one of the two sets only. A line shorter than
    ``n`` characters has no bit set and the number 0: nothing can be told from it.
    """
    counts = np.maximum(np.fromiter(map(len, lines), np.int64, len(lines)) - n + 1, 0)
    bits = np.zeros((len(lines), BITMAP // 64), np.uint64)
    ends = np.cumsum(counts + n)
    start = 0
    while start < len(lines):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_CHARS, "right")))
        part = lines[start:stop]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        # The lower byte of each code point; eight neighbours are read as one number.
        low = np.append(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint8)[::4], np.zeros(8, np.uint8))
        grams = np.ndarray(len(low) - 8, np.uint64, low, 0, (1,)) & np.uint64(256 ** min(n, 8) - 1)
        slot = (grams * _M >> np.uint64(64 - BITMAP.bit_length() + 1)).astype(np.int32)
        slot += np.repeat(np.arange(len(part), dtype=np.int32) * BITMAP, sizes)
        inside = np.ones(len(slot), bool)  # starts of shingles that do not cross a line's end
        line_ends = np.cumsum(sizes)
        for k in range(1, n):
            at = line_ends - k
            inside[at[at >= 0]] = False
        flags = np.zeros(len(part) * BITMAP, bool)
        flags[slot[inside]] = True
        bits[start:stop] = np.packbits(flags).view(np.uint64).reshape(len(part), -1)
        start = stop
    bits[counts == 0] = 0
    return bits, counts


def may_match(bits: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """False for pairs whose Jaccard similarity is surely below ``similarity``.

    With d shingles in one set only and a + b in both together, similarity is
    (a + b - d) / (a + b + d); d is at least the differing bits, a + b at most the counts.
    """
    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
    known = (counts[x] > 0) & (counts[y] > 0)
    return ~known | (apart * (1 + similarity) <= (counts[x] + counts[y]) * (1 - similarity) + 1e-6)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Position and stripped text of every line that is not blank."""
    stripped = (line.strip(SPACE) for line in (text or "").split("\n"))
    return [(i, line) for i, line in enumerate(stripped) if line]


def _hashes(lines: list[str]) -> np.ndarray:
    """128-bit hashes of lines as two columns of longs."""
    if not lines:
        return np.empty((0, 2), np.int64)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8")) for x in lines]), np.int64).reshape(-1, 2)


def line_places(docs: DataFrame, id_type: T.DataType, signature: tuple[int, int, int] | None) -> DataFrame:
    """(row_key, doc_id, pos, h1, h2) of every line that is not blank, and ``keys``, its buckets, if a signature is given."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(t) for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            lines = [line for f in found for _, line in f]
            h = _hashes(lines)
            columns = [batch.column("row_key").take(pa.array(rows)), batch.column("doc_id").take(pa.array(rows)),
                       pa.array([i for f in found for i, _ in f], pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])]
            names = ["row_key", "doc_id", "pos", "h1", "h2"]
            if signature:
                keys = band_keys(lines, *signature) if lines else np.empty((0, signature[0]), np.int64)
                offsets = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * signature[0])
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))))
                names.append("keys")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"row_key long, doc_id {id_type.simpleString()}, pos int, h1 long, h2 long" + (", keys array<long>" if signature else "")
    return docs.select("row_key", "doc_id", "text").mapInArrow(places, schema)


def _wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, keys, line) of wanted lines (row_key, pos, cid, keys); a document's list is bounded by its lines."""
    lists = wanted.groupBy("row_key").agg(F.collect_list(F.struct("pos", "cid", "keys")).alias("wanted"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, want in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                lines = text.split("\n")
                out += [{"cid": w["cid"], "keys": w["keys"], "line": lines[w["pos"]].strip(SPACE)} for w in want]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("cid", pa.int64()), ("keys", pa.list_(pa.int32())), ("line", pa.string())]))

    return (docs.select("row_key", "text").join(lists.hint("shuffle_hash"), "row_key")
            .mapInArrow(pick, "cid long, keys array<int>, line string"))


def _short(key):
    """31 bits of a bucket number: enough to tell in which band two lines met first."""
    return key.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _pack_postings(parts: int):
    """Postings (key, cid) of a batch of classes, packed by the part of the key's hash: (part, sure, packed).

    Millions of small rows would cost more than the work on them. A key that
    stands twice in a batch is shared for sure: its classes are dealt evenly, with
    sure true, and one of them stands for the key, so a key that a third of all classes
    have sends one posting a batch to its part.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy()
            cids = np.repeat(batch.column("cid").to_numpy(), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(keys, kind="stable")
            keys, cids = keys[order], cids[order]
            again = np.append(False, keys[1:] == keys[:-1])
            shared = again | np.append(again[1:], False)
            head = ~again
            # a posting that is sure already still stands for its key, marked by a negative class
            yield _packed(keys[head], np.where(shared[head], -1 - cids[head], cids[head]), parts, False)
            if shared.any():
                yield _packed(keys[shared], cids[shared], parts, True)

    return pack


def _packed(keys: np.ndarray, cids: np.ndarray, parts: int, sure: bool) -> pa.RecordBatch:
    by = cids if sure else keys
    part = (mix64(by.view(np.uint64), 41) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    pairs = np.stack((keys[order], cids[order]), axis=1)
    found = np.flatnonzero(np.diff(ends, prepend=0))
    blobs = [pairs[(ends[p - 1] if p else 0): ends[p]].tobytes() for p in found]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([sure] * len(found)), pa.array(blobs, pa.binary())],
                                      names=["part", "sure", "packed"])


def _unpack_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, key) of postings whose key another posting has too; a task holds those of its parts that are not sure."""
    held = []
    for batch in batches:
        sure = batch.column("sure").to_pylist()
        for s, blob in zip(sure, batch.column("packed").to_pylist()):
            if s:
                pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["cid", "key"])
            else:
                held.append(blob)
    pairs = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
    keys, cids = pairs[:, 0], pairs[:, 1]
    order = np.argsort(keys, kind="stable")
    keys, cids = keys[order], cids[order]
    same = keys[1:] == keys[:-1]
    shared = (np.append(False, same) | np.append(same, False)) & (cids >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(cids[shared]), pa.array(keys[shared])], names=["cid", "key"])


def _shared_postings(classes: DataFrame) -> DataFrame:
    """(cid, key) of the buckets of ``classes`` (cid, keys) that hold two classes or more."""
    spark = classes.sparkSession
    small_batches(spark, KEY_ROWS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * BANDS // PART_POSTINGS))
    packed = classes.select("cid", "keys").mapInArrow(_pack_postings(parts), "part int, sure boolean, packed binary")
    found = cut(packed.repartition(parts, "part").mapInArrow(_unpack_shared, "cid long, key long"), "shared")
    small_batches(spark)
    return found


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Cut a stream sorted by ``keys`` into batches of whole groups, with the end of each row's group.

    Holds one Arrow batch and the group that runs over its end; large groups were
    split into blocks before.
    """
    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)

    def ready(batch: pa.RecordBatch, new: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        heads = np.append(np.flatnonzero(new), len(batch))
        return batch, np.repeat(heads[1:], np.diff(heads))

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        ends = numbers(batch.take(pa.array([0, len(batch) - 1])))
        if (ends[0] == ends[1]).all() and (len(held) == 1 or (numbers(held[0].slice(0, 1))[0] == ends[0]).all()):
            continue  # still inside one group
        whole = joined()
        k = numbers(whole)
        new = np.append(True, (k[1:] != k[:-1]).any(axis=1))
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield ready(whole.slice(0, last), new[:last])
        held = [whole.slice(last)]
    if held:
        whole = joined()
        k = numbers(whole)
        yield ready(whole, np.append(True, (k[1:] != k[:-1]).any(axis=1)))


def line_links(classes: DataFrame, docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """Verified links (a, b) among line classes (cid, row_key, pos, keys).

    A pair is verified in the first bucket it shares, unless that bucket has
    already joined both or the bitmaps rule it out; every bucket's pairs are
    covered, block by block where a bucket is large.
    """
    shared = _shared_postings(classes)
    sizes = shared.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    met = cut(shared.join(sizes.hint("shuffle_hash"), "key"), "met")
    needed = met.select("cid").distinct().hint("shuffle_hash").join(classes.select(
        "cid", "row_key", "pos", F.transform("keys", _short).alias("keys")), "cid")
    texts = cut(_wanted_lines(docs, needed), "texts")
    group = ["key", "i", "j"]
    dealt = (met.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cid", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
             .join(texts, "cid").repartition(*group).sortWithinPartitions(*group))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ends in _runs(batches, group):
            keys = batch.column("keys").flatten().to_numpy().reshape(len(batch), -1)
            key = (batch.column("key").to_numpy() & 0x7FFFFFFF).astype(np.int32)
            mine, cid = batch.column("mine").to_numpy(), batch.column("cid").to_numpy()
            across = batch.column("i").to_numpy() != batch.column("j").to_numpy()
            first_met = []
            for x, y in pairs_of_runs(ends):
                ok = ~across[x] | (mine[x] != mine[y])
                x, y = x[ok], y[ok]
                shared = keys[x] == keys[y]
                first = key[x] == keys[x, shared.argmax(axis=1)]
                if first.any():
                    first_met.append((x[first], y[first]))
            # most lines of a bucket have met in another one already: only the rest are looked at
            needed = np.unique(np.concatenate([np.empty(0, np.int64), *[z for xy in first_met for z in xy]]))
            at = np.zeros(len(batch), np.int64)
            at[needed] = np.arange(len(needed))
            lines_ = batch.column("line").take(pa.array(needed)).to_pylist()
            bits, counts = bitmaps(lines_, n)
            sets: dict[int, set[str]] = {}
            forest, out = Forest(len(batch)), []

            def shingles(i: int) -> set[str]:
                if i not in sets:
                    sets[i] = {lines_[i][k:k + n] for k in range(max(1, len(lines_[i]) - n + 1))}
                return sets[i]

            for x, y in first_met:
                near = may_match(bits, counts, at[x], at[y], similarity)
                for p, q in zip(x[near].tolist(), y[near].tolist()):
                    if forest.root(p) == forest.root(q):
                        continue
                    a, b = shingles(int(at[p])), shingles(int(at[q]))
                    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                        continue
                    both = len(a & b)
                    if both >= similarity * (len(a) + len(b) - both):
                        forest.join(p, q)
                        out.append((p, q))
            ab = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(cid[ab[:, 0]]), pa.array(cid[ab[:, 1]])], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def duplicate_lines(keyed: DataFrame, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE,
                    similarity: float = SIMILARITY) -> DataFrame:
    """Lines that go, per document: (row_key, gone array<int>) for documents (row_key, doc_id, text)."""
    small_batches(keyed.sparkSession)
    id_type = keyed.schema["doc_id"].dataType
    signed = line_places(keyed, id_type, (bands, rows, n))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "pos", "keys")).alias("f")
    classes = cut(signed.groupBy("h1", "h2").agg(first, F.count("*").alias("times")).select(
        "h1", "h2", "times", F.col("f.none"), F.col("f.doc_id"), F.col("f.row_key"), F.col("f.pos"), F.col("f.keys")), "line_classes")
    classes = classes.withColumn("cid", F.monotonically_increasing_id())
    found = line_links(classes, keyed, n, similarity)
    small_batches(keyed.sparkSession, LINE_ROWS)  # rows are lines here, not documents
    links = cut(found, "line_links")
    small_batches(keyed.sparkSession)
    comp = cut(connected_components(links, "a", "b"), "line_components")
    order = F.struct("none", "doc_id", "row_key", "pos")
    narrow = classes.select("cid", "h1", "h2", "times", "none", "doc_id", "row_key", "pos")
    nodes = comp.withColumnRenamed("node", "cid").hint("shuffle_hash")
    members = narrow.join(nodes, "cid")
    heads = members.groupBy("component").agg(F.min(order).alias("head"))
    fuzzy = members.join(heads, "component").select("h1", "h2", "head")
    exact = (narrow.filter("times > 1").join(nodes.select("cid").hint("shuffle_hash"), "cid", "left_anti")
             .select("h1", "h2", order.alias("head")))
    decided = cut(fuzzy.unionByName(exact).select("h1", "h2", F.col("head.row_key").alias("head_row"), F.col("head.pos").alias("head_pos")),
                  "decided")
    drop_cut(classes)
    gone = (line_places(keyed, id_type, None).select("row_key", "pos", "h1", "h2").join(decided.hint("shuffle_hash"), ["h1", "h2"])
            .filter("row_key <> head_row or pos <> head_pos"))
    return cut(gone.groupBy("row_key").agg(F.collect_set("pos").alias("gone")), "gone_lines")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Keep one line of each component of similar lines in the whole corpus.

    ``text_col`` keeps the lines that stay, joined by newlines; appends n_lines
    and n_removed. Blank lines stay. A null text stays null with no lines; a
    document may end up empty, it is not dropped. Null ids come after all ids;
    equal ids and repeated rows are told apart by their place in the table. Other
    columns pass through (columns of the new names are replaced); an empty table
    stays empty.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = with_row_key(docs, "row_key")
    gone = duplicate_lines(keyed.select("row_key", F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **settings)
    joined = keyed.join(gone.hint("shuffle_hash"), "row_key", "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    # Marked lines are taken out by their position; a null text stays null.
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i))
    return joined.select(
        *[(F.when(F.col("gone").isNull(), F.col(f"`{c}`")).otherwise(F.array_join(left, "\n")) if c == text_col else F.col(f"`{c}`")).alias(c)
          for c in docs.columns],
        F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
