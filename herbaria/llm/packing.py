"""Packing documents into fixed windows by lexical retrieval.

Every text becomes token ids of the tokenizers library and an end id. A document
longer than a window fills windows of its own first; what is left of it, and every
shorter document, is dealt to shards in the order of min-hashes of its tokens, so
that texts with much in common share a shard, and shards are of one size. A task
holds one block of a shard at a time, builds its BM25 inverted index with the
document counts of the whole corpus, and fills windows: a seed document asks the
index for its unused neighbours, which follow it in order of score; the first that
does not fit is cut, and its rest seeds the next window. Every window but the last
of a task is full; that one is split into sequences of powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herbaria.llm.common import cut, mix64, small_batches, with_row_key

WINDOW = 2048
#: Ids of one shard (the work of one task) and of one index block in it; no result is cut by them.
SHARD_IDS = 6_000_000
BLOCK_IDS, BLOCK_DOCS = 1_500_000, 2048
#: Words whose ids a worker keeps, and bytes of text it encodes at a time; results do not depend on them.
CACHE_WORDS, TEXT_BYTES = 2_000_000, 16 << 20
K1, B = 1.2, 0.75
HASHES = 4


def id_type(vocab_path: str, end_id: int) -> str:
    """Little-endian type of all ids, as narrow as can be, as ids are written and shuffled."""
    from tokenizers import Tokenizer

    return "<u2" if max(end_id, *Tokenizer.from_file(vocab_path).get_vocab().values()) < 1 << 16 else "<u4"


class WordTokens:
    """Ids of texts by a vocabulary whose words never reach over white space.

    The file drops white space, so a text's ids are those of its words in a row.
    The words of many texts are numbered at once; words not met before are encoded
    by the tokenizers library, the ids of all others are copied from a table.
    """

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        # words of ASCII letters need no more than lower case: the same model without the rest
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        for encoder in (self.encoder, self.plain):
            encoder.no_truncation()
            encoder.no_padding()
        vocab = self.encoder.get_vocab()
        self.kind, self.ends = kind, np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.starts, self.sizes = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, self.kind)

    def learn(self, words: list[str]) -> None:
        """Encode new words and append them to the table in their order."""
        groups: tuple[list[int], ...] = ([], [], [], [], [])  # ASCII letters, with a stop; letters, with a stop; others
        for i, w in enumerate(words):
            stop = w[-1:] in ".,;:!?" and len(w) > 1
            kind = 4 if not (w[:-1] if stop else w).isalpha() else 2 * (not w.isascii()) + stop
            groups[kind].append(i)
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for kind, at in enumerate(groups):
            ids, n = self._encoded([words[i] for i in at], kind)
            starts[at], sizes[at] = len(self.ids) + np.cumsum(n) - n, n
            self.ids = np.concatenate((self.ids, ids))
        self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))

    def _encoded(self, words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one kind in a row, and the number of ids of each.

        Words of letters, or of letters and a stop, are encoded as one text. They
        make at least one and two words of the model each, so if the ends of words
        among the ids are as many as that, every word's ids lie between them.
        """
        if words and kind < 4:
            parts = 1 + kind % 2
            texts = words if kind > 1 else [w.lower() for w in words] if parts == 1 else [f"{w[:-1].lower()} {w[-1]}" for w in words]
            encoder = self.encoder if kind > 1 else self.plain
            ids = np.array(encoder.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == parts * len(words):
                return ids, np.diff(ends[parts - 1:: parts], prepend=0)
        found = [e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], self.kind), np.array([len(ids) for ids in found], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more entry: the end)."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        numbered = words.values.dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self.forget()
        at = pc.index_in(numbered.dictionary, value_set=self.known)
        fresh = numbered.dictionary.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = len(self.known) + np.arange(len(fresh))
        self.learn(fresh.to_pylist())
        self.known = pa.concat_arrays([self.known, fresh])
        at = at[numbered.indices.to_numpy()]
        sizes = self.sizes[at]
        place = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(self.starts[at] - place[:-1], sizes) + np.arange(place[-1])]
        return ids, place[words.offsets.to_numpy()]


_loaded: dict[str, WordTokens] = {}


def _tokens(name: str, kind: str) -> WordTokens:
    if name + kind not in _loaded:
        _loaded[name + kind] = WordTokens(SparkFiles.get(name), kind)
    return _loaded[name + kind]


def check_vocabulary(vocab_path: str) -> None:
    """Raise if words cannot be encoded one by one: white space must be dropped, letters only lower-cased."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [step["type"] for step in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    if normal != ["NFC", "Replace", "Lowercase"] or not drops or spec["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError("the vocabulary must lower-case words and drop white space, so that words can be encoded one by one")


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Arrow binary values of the slices of ``values`` between consecutive ``starts``."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _slices(column: pa.Array, kind: str) -> list[np.ndarray]:
    """The ids of each row of a binary column, without copies."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return [data[a:b].view(kind) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def tokenize(df: DataFrame, vocab_path: str, end_id: int, window: int, text_col: str = "text") -> DataFrame:
    """Replace ``text_col`` by whole, ids and pack_key.

    whole holds the ids (packed, see ``id_type``) of the first windows of a document
    that it fills alone, ids the others, pack_key their place in the shard order:
    four min-hashes in one number, so that alike documents sort near. Each task adds
    a last row with is_count true: its ids are the numbers of the task's documents
    that hold each id (packed 64-bit), pack_key the number of its documents.
    """
    check_vocabulary(vocab_path)
    sc, name = df.sparkSession.sparkContext, vocab_path.rsplit("/", 1)[-1]
    if not any(f.rsplit("/", 1)[-1] == name for f in sc.listFiles):
        sc.addFile(vocab_path)
    small_batches(df.sparkSession)
    kept = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != text_col]  # null in the row of counts
    schema = T.StructType([*kept, T.StructField("whole", T.BinaryType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("pack_key", T.LongType()), T.StructField("is_count", T.BooleanType())])
    kind = id_type(vocab_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(name, kind)
        n_ids = max(len(tokens.ends), end_id + 1)
        hashes = [(mix64(np.arange(n_ids, dtype=np.uint64), seed + 1) >> np.uint64(49)).astype(np.uint16) for seed in range(HASHES)]
        counts, seen, docs = np.zeros(n_ids, np.int64), np.zeros(n_ids, bool), 0
        held: list[pa.RecordBatch] = []

        def encoded() -> Iterator[pa.RecordBatch]:
            nonlocal docs
            for batch in held:
                raw, begin = tokens.encode(batch.column(text_col))
                n = len(batch)
                ids = np.insert(raw, begin[1:], end_id) if n else raw
                begin = begin + np.arange(n + 1)
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    if b - a > 500:  # distinct ids by marking them, or by sorting few
                        seen[ids[a:b]] = True
                        counts[seen] += 1
                        seen[ids[a:b]] = False
                    else:
                        counts[np.unique(ids[a:b])] += 1
                docs += n
                sizes = np.diff(begin)
                rest = np.repeat(begin[1:] - sizes % window, sizes) <= np.arange(len(ids))
                tails, tail_begin = ids[rest], np.concatenate(([0], np.cumsum(sizes % window)))
                keys, some = np.zeros(n, np.int64), np.flatnonzero(sizes % window)
                for h in hashes if len(some) else []:
                    keys[some] = keys[some] << 15 | np.minimum.reduceat(h[tails], tail_begin[some]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name) for f in kept], _binary(ids[~rest], begin - tail_begin), _binary(tails, tail_begin),
                     pa.array(keys), pa.array(np.zeros(n, bool))], names=schema.names)

        size, types = 0, None
        for batch in batches:
            types = batch.schema
            held.append(batch)
            size += batch.column(text_col).nbytes
            if size >= TEXT_BYTES:
                held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]]
                yield from encoded()
                held, size = [], 0
        if size:
            held = pa.Table.from_batches(held).combine_chunks().to_batches()
            yield from encoded()
        if docs:
            nulls = [pa.nulls(1, types.field(f.name).type) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*nulls, pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([docs]), pa.array([True])], names=schema.names)

    return df.mapInArrow(run, schema)


def term_counts(tokens: DataFrame) -> DataFrame:
    """(term, docs): documents that hold each id, summed over the tasks that encoded them.

    The row of term -1 holds the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(0, np.int64), 0
        for batch in batches:
            for packed, n in zip(batch.column("ids").to_pylist(), batch.column("pack_key").to_pylist()):
                more = np.frombuffer(packed, np.int64)
                counts, docs = more + counts if len(counts) else more.copy(), docs + n
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(counts[found], docs))], names=["term", "docs"])

    per_task = tokens.filter("is_count").select("ids", "pack_key").mapInArrow(run, "term long, docs long")
    return per_task.groupBy("term").agg(F.sum("docs").alias("docs"))


class Block:
    """Inverted index of some documents: for each term the documents that hold it and their BM25 weight."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.n = len(ids)
        lengths = np.array([len(x) for x in ids])
        of = np.repeat(np.arange(self.n, dtype=np.int64), lengths)
        pairs, tf = np.unique(of * len(idf) + np.concatenate(ids), return_counts=True)
        doc, term = np.divmod(pairs, len(idf))
        counted = idf[term] > 0
        doc, term, tf = doc[counted], term[counted], tf[counted].astype(np.float64)
        ends = np.searchsorted(doc, np.arange(self.n + 1))
        self.terms = [term[a:b] for a, b in zip(ends[:-1], ends[1:])]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(idf)))))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for all terms of document ``seed``."""
        first, n = self.start[self.terms[seed]], self.start[self.terms[seed] + 1] - self.start[self.terms[seed]]
        if not len(n):
            return np.zeros(self.n)
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill_windows(lengths: np.ndarray, scores, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length); all are full but the last.

    ``scores(seed)`` scores all documents. Ties go to the earlier document, and
    documents that share no term with the seed follow in their order.
    """
    start = np.zeros(len(lengths), np.int64)
    open_ = start < lengths
    left, seed, next_doc = int(open_.sum()), -1, 0
    while left:
        if seed < 0:
            while not open_[next_doc]:
                next_doc += 1
            seed = next_doc
        space, pieces, doc, found = window, [], seed, None
        while True:
            take = min(space, int(lengths[doc] - start[doc]))
            pieces.append((doc, int(start[doc]), take))
            start[doc] += take
            space -= take
            seed = doc if start[doc] < lengths[doc] else -1
            if seed < 0:
                open_[doc] = False
                left -= 1
            if not space or not left:
                break
            if found is None:
                found = scores(pieces[0][0])
            doc = int(np.where(open_, found, -1.0).argmax())
        yield pieces


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a window in sequences whose lengths are powers of two, longest first."""
    left = sum(n for _, _, n in pieces)
    while left:
        space, out = 1 << left.bit_length() - 1, []
        left -= space
        while space:
            doc, start, n = pieces.pop(0)
            if n > space:
                pieces.insert(0, (doc, start + space, n - space))
            out.append((doc, start, min(n, space)))
            space -= min(n, space)
        yield out


def pack(df: DataFrame, vocab_path: str, end_id: int, doc_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    One row per piece: ``doc_col``, start and length in its document, ids (packed
    little-endian 32-bit), doc_tokens, sequence_id, offset in the sequence. Each id
    lies in one piece. Sequences hold ``window`` ids or a power of two. A null or
    empty text holds the end id alone; repeated rows and ids are documents of their
    own; very long texts fill windows of their own; equal scores go to the earlier
    document; an empty table gives no rows; other columns are left out, so clashing
    names do no harm.
    """
    kind = id_type(vocab_path, end_id)
    width = np.dtype(kind).itemsize
    kept = df.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    tokens = cut(tokenize(with_row_key(kept, "row_key"), vocab_path, end_id, window), "packing-ids")
    counts = {r["term"]: r["docs"] for r in term_counts(tokens).collect()}  # at most one row per vocabulary entry
    docs = counts.pop(-1, 0)
    alone = (F.octet_length("whole") / width).cast("long")
    tokens = tokens.filter("not is_count").withColumns({"alone": alone, "doc_tokens": alone + (F.octet_length("ids") / width).cast("long")})
    all_ids = tokens.agg(F.sum(F.col("doc_tokens") - F.col("alone"))).first()[0] or 0
    idf = np.zeros(max(counts, default=0) + 1)
    found = np.array(list(counts), np.int64), np.array(list(counts.values()), np.float64)
    if docs:
        idf[found[0]] = np.maximum(0, np.log((docs - found[1] + 0.5) / (found[1] + 0.5)))  # in half of all documents: no weight
    mean_length = max(1, all_ids) / max(docs, 1)
    shards = max(1, -(-all_ids // SHARD_IDS))
    doc_field = T.StructField(doc_col, tokens.schema["doc"].dataType)
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([doc_field, T.StructField("ids", T.BinaryType()), *longs])

    def windows_of_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that a document fills alone; their sequences are numbered apart from the others."""
        next_id = 1 << 62 | TaskContext.get().partitionId() << 32
        for batch in batches:
            part = np.cumsum(batch.column("alone").to_numpy()) // BLOCK_IDS  # a few very long documents at a time
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
                if not len(rows):
                    continue
                some = batch.slice(int(rows[0]), len(rows))
                values = np.concatenate(_slices(some.column("whole"), kind)).astype("<u4")
                each = some.column("alone").to_numpy() // window
                n, owner = int(each.sum()), np.repeat(np.arange(len(each)), each)
                start = (np.arange(n) - np.repeat(np.cumsum(each) - each, each)) * window
                numbers = [start, np.full(n, window), some.column("doc_tokens").to_numpy()[owner], next_id + np.arange(n), np.zeros(n, np.int64)]
                next_id += n
                yield pa.RecordBatch.from_arrays([some.column("doc").take(pa.array(owner)), _binary(values, np.arange(n + 1) * window),
                                                  *[pa.array(c, pa.int64()) for c in numbers]], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, doc_type, held = TaskContext.get().partitionId() << 32, None, 0
        rows: list[tuple[object, np.ndarray, int, int, int]] = []  # document, its ids, how many are packed, ids before them, in all

        def emit(windows: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal next_id
            pieces, numbers = [], []
            for window_pieces in windows:
                offset = 0
                for d, start, n in window_pieces:
                    _, ids, packed, before, doc_tokens = rows[d]
                    pieces.append(ids[packed + start: packed + start + n])
                    numbers.append((before + packed + start, n, doc_tokens, next_id, offset))
                    offset += n
                next_id += 1
            table = np.array(numbers, np.int64).reshape(len(numbers), len(longs))
            docs_of = [rows[d][0] for window_pieces in windows for d, _, _ in window_pieces]
            values = np.concatenate(pieces).astype("<u4") if pieces else np.empty(0, "<u4")
            begin = np.concatenate(([0], np.cumsum(table[:, 1])))
            return pa.RecordBatch.from_arrays([pa.array(docs_of, doc_type), _binary(values, begin), *[pa.array(c) for c in table.T]], names=schema.names)

        def fill(last: bool) -> pa.RecordBatch:
            nonlocal rows
            block = Block([r[1] for r in rows], idf, mean_length)
            done = list(fill_windows(np.array([len(r[1]) - r[2] for r in rows]), block.scores, window))
            tail = done.pop() if sum(n for _, _, n in done[-1]) < window else []
            batch = emit(done + (list(_powers(list(tail))) if last else []))
            ends: dict[int, int] = {}
            for d, start, _ in tail:  # the open window's documents go on in the next block
                ends[d] = min(start, ends.get(d, start))
            rows = [] if last else [(*rows[d][:2], rows[d][2] + start, *rows[d][3:]) for d, start in ends.items()]
            return batch

        for batch in batches:
            doc_type = batch.schema.field("doc").type
            for doc, ids, before, doc_tokens in zip(batch.column("doc").to_pylist(), _slices(batch.column("ids"), kind),
                                                    batch.column("alone").to_pylist(), batch.column("doc_tokens").to_pylist()):
                rows.append((doc, ids, 0, before, doc_tokens))
                held += len(ids)
                if held >= BLOCK_IDS or len(rows) >= BLOCK_DOCS:
                    yield fill(False)
                    held = 0
        if rows:
            yield fill(True)

    long = tokens.filter("alone > 0").select("doc", "whole", "alone", "doc_tokens").mapInArrow(windows_of_one, schema)
    left = tokens.filter("doc_tokens > alone").select("doc", "ids", "alone", "doc_tokens", "pack_key", "row_key")
    dealt = left.repartitionByRange(shards, "pack_key", "row_key").sortWithinPartitions("pack_key", "row_key")
    return long.unionByName(dealt.select("doc", "ids", "alone", "doc_tokens").mapInArrow(run, schema))
