"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut at special tokens, then into words by the byte-level pattern. Each
word is merged on its own: an array holds the part boundaries and beside each
the rank of the pair that starts there. The smallest rank is found by a scan,
the boundary inside that pair deleted and the neighbouring ranks refreshed,
until no adjacent pair has a rank. Words of one length are merged side by side, as
rows of one array. Words repeat, so a worker keeps merged words
in two caches of bounded size (the older is dropped; results do not depend on it).

Whole batches of texts are cut at single blanks and their pieces, a blank and what
follows it, numbered at once; ids are copied from a table of the pieces met so far,
and only new pieces are cut into words and merged. A text where a blank stands
beside other white space, or with a special token, is cut into words as a whole,
as white space is joined across such pieces. Decoding copies bytes from a table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herbaria.llm.common import ARROW_ROWS, small_batches

#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = (1 << 31) - 1
CACHE_WORDS = 250_000
#: Pieces whose ids a worker keeps, and bytes of text encoded at a time; results do not depend on them.
CACHE_PIECES, TEXT_BYTES = 400_000, 4 << 20
#: Fixed value: the white space of the word pattern.
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A scan costs the square of the length, so longer words take their minima from a heap; those
#: of up to ROW_WORD bytes are merged in rows.
LONG_WORD, ROW_WORD = 200, 40
_M = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """Byte of each stand-in character: printable Latin-1 is itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairEncoder:
    """One vocabulary file of the tokenizers library, ready to encode and decode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.byte_id = [0] * 256
        for ch, b in alphabet.items():
            self.byte_id[b] = vocab[ch]
        self.pairs: dict[int, int] = {}  # left id and right id in one integer -> rank
        self.made: list[int] = []  # rank -> id of the merged part
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.byte_ids, self.made_ids = np.array(self.byte_id, np.int32), np.array(self.made, np.int32)
        self._pair_table()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}  # filled up to CACHE_WORDS, then becomes the old one
        self.old: dict[str, bytes] = {}

    def _pair_table(self) -> None:
        """Ranks of pairs in a hash table of arrays: open addressing, at most ``reach`` steps."""
        keys = np.fromiter(self.pairs, np.uint64, len(self.pairs))
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros((1 << self.bits) + 64, np.uint64)
        self.ranks = np.full(len(self.keys), NO_RANK, np.int32)
        at = (keys * _M >> np.uint64(64 - self.bits)).astype(np.int64)
        left, self.reach = np.arange(len(keys)), 0
        ranks = np.fromiter(self.pairs.values(), np.int32, len(keys))
        while len(left):
            free = self.ranks[at[left]] == NO_RANK
            slot, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot], self.ranks[slot] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] += 1
            self.reach += 1

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NO_RANK`` for pairs that never merge."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = (key * _M >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
        for step in range(1, self.reach):
            miss = np.flatnonzero(out == NO_RANK)
            miss = miss[self.ranks[at[miss] + step - 1] != NO_RANK]  # an empty slot ends the search
            out[miss] = np.where(self.keys[at[miss] + step] == key[miss], self.ranks[at[miss] + step], NO_RANK)
        return out

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of one length, each merged as ``merge`` does, side by side."""
        n, size = len(words), len(words[0])
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].reshape(n, size)
        sizes, live = np.full(n, size), np.arange(n)
        now = parts
        ranks = self.rank_of(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(n, size - 1)
        while size > 1:
            low = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(low)), low]
            going = rank < NO_RANK
            if not going.all():
                done = live[~going]
                parts[done, :size], sizes[done] = now[~going], size
                live, now, ranks, low, rank = live[going], now[going], ranks[going], low[going], rank[going]
            if not len(live):
                break
            row, place = np.arange(len(live)), np.arange(size - 1)
            now[row, low] = self.made_ids[rank]
            now = np.take_along_axis(now, place + (place > low[:, None]), 1)  # the boundary inside the pair goes
            size -= 1
            if size == 1:
                parts[live, 0], sizes[live] = now[:, 0], 1
                break
            place = np.arange(size - 1)
            ranks = np.take_along_axis(ranks, place + (place >= low[:, None]), 1)
            has_right, has_left = np.flatnonzero(low < size - 1), np.flatnonzero(low > 0)
            at = low[has_right]
            ranks[has_right, at] = self.rank_of(now[has_right, at], now[has_right, at + 1])
            at = low[has_left]
            ranks[has_left, at - 1] = self.rank_of(now[has_left, at - 1], now[has_left, at])
        return [p[:k].tobytes() for p, k in zip(parts, sizes.tolist())]

    def learn(self, words: set[str]) -> None:
        """Merge words that no cache holds, those of one length together."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w in self.cache:
                continue
            if ids := self.old.get(w):
                self.cache[w] = ids
                continue
            raw = w.encode("utf-8")
            if 1 < len(raw) <= ROW_WORD:
                by_size.setdefault(len(raw), []).append((w, raw))
        for rows in by_size.values():
            for a in range(0, len(rows), 1 << 16):
                self.cache.update(zip([w for w, _ in rows[a:a + (1 << 16)]], self.merge_rows([raw for _, raw in rows[a:a + (1 << 16)]])))
        if len(self.cache) >= CACHE_WORDS:
            self.old, self.cache = self.cache, {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one short word: contiguous parts and ranks, scan, delete, refresh."""
        rank_of, made = self.pairs.get, self.made
        byte_id = self.byte_id
        parts = [byte_id[b] for b in word]  # part i ends where part i + 1 begins
        ranks = [rank_of(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = part = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(part << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | part, NO_RANK)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges in the same order for a long word, minima from a heap."""
        parts = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(x: int, y: int) -> None:
            pair = parts[x] << 32 | parts[y]
            if pair in self.pairs:
                heapq.heappush(heap, (self.pairs[pair], x, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] << 32 | parts[j] != pair:
                continue
            parts[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p, a in zip(parts, alive) if a]

    def _word(self, word: str) -> bytes:
        if ids := self.old.get(word):
            self.cache[word] = ids
            return ids
        raw = word.encode("utf-8")
        ids = array("i", self.merge(raw) if len(raw) <= LONG_WORD else self.merge_long(raw)).tobytes()
        if len(raw) <= LONG_WORD:
            if len(self.cache) >= CACHE_WORDS:
                self.old, self.cache = self.cache, {}
            self.cache[word] = ids
        return ids

    def encode_words(self, text: str) -> bytes:
        """Token ids of a text without special tokens."""
        get, word_ids = self.cache.get, self._word
        return b"".join([get(w) or word_ids(w) for w in self.words.findall(text)])

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as packed 32-bit integers."""
        get, out = self.cache.get, []
        word_ids = self._word
        pieces = self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]
        for piece in pieces:
            if piece in self.special:
                out.append(array("i", [self.special[piece]]).tobytes())
            else:
                out += [get(w) or word_ids(w) for w in self.words.findall(piece)]
                get = self.cache.get
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, special tokens included; unknown ids and nulls give nothing."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


class Pieces:
    """Ids of the pieces of texts met so far, and the bytes of every id."""

    def __init__(self, encoder: BytePairEncoder) -> None:
        self.encoder = encoder
        special = "".join(f"|{regex.escape(x)}" for x in encoder.special)
        self.whole = f"[{WHITE}] | [{WHITE}]{special}"  # texts that are not cut into pieces
        self.byte_sizes = np.zeros(max(encoder.bytes_of) + 1, np.int64)
        for i, b in encoder.bytes_of.items():
            self.byte_sizes[i] = len(b)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.bytes = np.frombuffer(b"".join(encoder.bytes_of.get(i, b"") for i in range(len(self.byte_sizes))), np.uint8)
        self.forget()

    def forget(self, digests: bool = False) -> None:
        self.known, self.starts, self.sizes = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.digits = np.empty(0, np.int32), [] if digests else None

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, each after a blank, and append them to the table in their order."""
        found = [self.encoder.words.findall(" " + p) for p in pieces]
        self.encoder.learn(set().union(*found))
        get, one = self.encoder.cache.get, self.encoder._word
        packed = [b"".join([get(w) or one(w) for w in words]) for words in found]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(packed), np.int32)))
        if self.digits is not None:
            self.digits += [",".join(map(str, memoryview(p).cast("i").tolist())).encode() for p in packed]

    def _numbers(self, values: pa.Array) -> np.ndarray:
        """Number in the table of each piece."""
        coded = values.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = len(self.known) + np.arange(len(fresh))
        self._learn(fresh.to_pylist())
        self.known = pa.concat_arrays([self.known, fresh])
        return at[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, digests: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, where each text's begin (one more: the end), and digests of the ids if asked for."""
        if len(self.known) > CACHE_PIECES or digests and self.digits is None:
            self.forget(digests)
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        begin = cut.offsets.to_numpy()
        values = cut.values.slice(begin[0], begin[-1] - begin[0])
        begin = begin - begin[0]
        at = self._numbers(values)
        # the first piece of a text has no blank before it; a text that is not cut is one piece
        heads = [packed for packed in map(self._head, texts.to_pylist() if whole.any() else values.take(pa.array(begin[:-1])).to_pylist(), whole)]
        head_sizes = np.fromiter(map(len, heads), np.int64, len(heads)) // 4
        sizes, starts = self.sizes[at], self.starts[at]
        sizes[begin[:-1]] = head_sizes
        starts[begin[:-1]] = len(self.ids) + np.cumsum(head_sizes) - head_sizes
        pool = np.concatenate((self.ids, np.frombuffer(b"".join(heads), np.int32)))
        place = np.concatenate(([0], np.cumsum(sizes)))
        ids = pool[np.repeat(starts - place[:-1], sizes) + np.arange(place[-1])]
        hashed = []
        if digests:
            for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                first = ",".join(map(str, memoryview(heads[i]).cast("i").tolist())).encode()
                parts = [self.digits[k] for k in at[a + 1:b].tolist()]
                hashed.append(hashlib.sha256(b",".join([first, *parts] if first else parts)).hexdigest())
        return ids, place[begin], hashed

    def _head(self, text: str, whole: bool) -> bytes:
        return self.encoder.encode(text) if whole else self.encoder.encode_words(text.split(" ", 1)[0])

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts in a row, and where each text's begin; unknown ids give nothing."""
        known = (ids >= 0) & (ids < len(self.byte_sizes))
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.byte_sizes[ids], 0)
        place = np.concatenate(([0], np.cumsum(sizes)))
        return self.bytes[np.repeat(self.byte_starts[ids] - place[:-1], sizes) + np.arange(place[-1])].tobytes(), place[begin]


_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(BytePairEncoder(SparkFiles.get(path.rsplit("/", 1)[-1])))
    return _loaded[path]


def _share(df: DataFrame, path: str) -> None:
    """Send the vocabulary file to every executor (a fixed file, not data)."""
    sc = df.sparkSession.sparkContext
    if not any(f.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1] for f in sc.listFiles):
        sc.addFile(path)


def _per_text(df: DataFrame, made: list[tuple[list[T.StructField], Callable]]) -> DataFrame:
    """Append the columns of ``made``, each by its ``fn(record batch so far) -> arrays``, in one Python worker.

    Columns of the same names are replaced. Batches are put together up to
    ``TEXT_BYTES``, so that pieces repeat in them.
    """
    small_batches(df.sparkSession)
    fields = [f for fs, _ in made for f in fs]
    df = df.drop(*[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])

    def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= TEXT_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches):
            for fs, fn in made:
                batch = pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], names=[*batch.schema.names, *[f.name for f in fs]])
            for at in range(0, len(batch), ARROW_ROWS):
                yield batch.slice(at, ARROW_ROWS)

    return df.mapInArrow(run, schema)


def _encoding(vocab_path: str, text_col: str, ids_col: str) -> tuple[list[T.StructField], Callable]:

    def ids(batch: pa.RecordBatch) -> list[pa.Array]:
        values, begin, _ = _pieces(vocab_path).encode(batch.column(text_col))
        return [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, pa.int32()))]

    return [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], ids


def _decoding(vocab_path: str, ids_col: str, text_col: str) -> tuple[list[T.StructField], Callable]:

    def texts(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(ids_col)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
        begin = np.concatenate(([0], np.cumsum(sizes)))
        raw, at = _pieces(vocab_path).decode(pc.list_flatten(lists).fill_null(-1).to_numpy(), begin)
        found = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
        try:
            found.validate(full=True)
        except pa.ArrowInvalid:  # ids that cut a character apart
            found = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
        return [found]

    return [T.StructField(text_col, T.StringType())], texts


def bpe_encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Append the token ids of each whole text; null and empty texts get an empty array.

    Other columns and repeated rows pass through; an empty table stays empty; a
    column named like ``ids_col`` is replaced.
    """
    _share(df, vocab_path)
    return _per_text(df, [_encoding(vocab_path, text_col, ids_col)])


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Append the text of each id array; a null array gives the empty text."""
    _share(df, vocab_path)
    return _per_text(df, [_decoding(vocab_path, ids_col, text_col)])


def bpe_round_trip(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "token_ids",
                   decoded_col: str = "decoded") -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` of its ids in one Python worker a task, which loads one vocabulary."""
    _share(df, vocab_path)
    return _per_text(df, [_encoding(vocab_path, text_col, ids_col), _decoding(vocab_path, ids_col, decoded_col)])


def bpe_digests(df: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256 of the texts encoded and decoded again.

    The digests are those of ``with_digests(bpe_round_trip(df))``, made where the ids
    are, so that neither ids nor texts leave the worker. The decimal ids of a piece are
    written once and joined.
    """
    _share(df, vocab_path)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def digests(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces = _pieces(vocab_path)
        ids, begin, hashed = pieces.encode(batch.column(text_col), True)
        raw, at = pieces.decode(ids, begin)
        view = memoryview(raw)
        texts = [hashlib.sha256(_clean(view[a:b])).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return [pa.array(np.diff(begin), pa.int64()), pa.array(hashed, pa.string()), pa.array(texts, pa.string())]

    return _per_text(df, [(fields, digests)])


def _clean(raw: memoryview) -> bytes | memoryview:
    """Bytes as text: where they are no UTF-8, replacement characters stand."""
    try:
        str(raw, "utf-8")
        return raw
    except UnicodeDecodeError:
        return bytes(raw).decode("utf-8", "replace").encode("utf-8")


def with_digests(df: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256."""
    return df.withColumns({
        "n_tokens": F.size(ids_col).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ","), 256),
        "decoded_sha256": F.sha2(F.col(text_col), 256)})
