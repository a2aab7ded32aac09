"""Token ids in fixed-width bit packing, with block offsets for random access.

A shard is little-endian: magic, then eleven unsigned 64-bit words (bits, ids a block, documents,
ids, blocks, the ends of the five sections, and the shard's number within its range of ids), then document ids (int64),
null flags (uint8), lengths (uint64), block offsets (uint64, from the data's start), and blocks.
A block holds its ids in ``bits`` bits each, lowest bit first, and ends on a byte. A file is
shards, each followed by one line feed (written by Spark's text writer, so to any file system).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.llm.bytesets import hash_pieces, lowered, slices, text_column, word_starts
from gossamer.session import bounded_batches, materialize, scratch, table, trimmed

MAGIC = b"GTOKBIN1"
HEAD = len(MAGIC) + 11 * 8
BLOCK_IDS = 4096
#: A shard is closed when it holds this many ids; a longer document is a shard of its own.
SHARD_IDS = 1_000_000
#: Shards of a file at most: a file is read as one row, so it has to stay small.
FILE_SHARDS = 64
#: Words whose ids a worker remembers; beyond it the memory is emptied.
MEMO_WORDS = 800_000


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (each below 2**bits, at most 32 bits) as a bit string, lowest bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    wide = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = wide
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def write_shard(doc_ids: list[int | None], lengths: list[int] | np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS, seq: int = 0) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[: len(blocks)].astype("<u8")
    n = len(doc_ids)
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u8").tobytes(), offsets.tobytes(), b"".join(blocks),
    ]
    ends = HEAD + np.cumsum([len(p) for p in parts])
    head = np.array([bits, block, n, len(ids), len(blocks), *ends, seq], "<u8").tobytes()
    return b"".join([MAGIC, head, *parts])


class Shard:
    """A shard in a buffer; ``ids(start, n)`` unpacks only the blocks that it needs."""

    def __init__(self, raw: bytes, at: int = 0):
        view = memoryview(raw)[at:]
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("no shard starts here")
        self.bits, self.block, n, self.n_ids, n_blocks, e_ids, e_null, e_len, e_off, self.end, self.seq = (int(x) for x in np.frombuffer(view, "<u8", 11, len(MAGIC)))
        self.doc_ids = np.frombuffer(view, "<i8", n, HEAD)
        self.nulls = np.frombuffer(view, np.uint8, n, e_ids)
        self.lengths = np.frombuffer(view, "<u8", n, e_null).astype(np.int64)
        self.offsets = np.frombuffer(view, "<u8", n_blocks, e_len).astype(np.int64)
        self.data = view[e_off : self.end]

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            size = min(self.block, self.n_ids - k * self.block)
            stop = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else len(self.data)
            parts.append(unpack(self.data[int(self.offsets[k]) : stop], size, self.bits))
        return np.concatenate(parts)[start - first * self.block :][:n]


def shards(raw: bytes) -> Iterator[Shard]:
    at = 0
    while at < len(raw):
        s = Shard(raw, at)
        yield s
        at += s.end + 1


class WordEncoder:
    """Encodes whole texts by a tokenizer that drops white space, one word at a time.

    Such a tokenizer never joins characters across ASCII white space, so the ids of a text are
    those of its words in turn; words recur, so most are looked up. ASCII letters may be lowered
    first because the tokenizer does so itself, and marks behind a letter or digit may be cut off
    because they start a piece of their own: save where a special token could appear or vanish by
    it. A word of unaccented and Latin-1 letters is one piece that normalising leaves alone once it
    is lowered; such words skip the normaliser and the splitting pattern.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memo: dict[bytes, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Start anew: place 0 holds the end id of ``encode_column``."""
        self.places: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.length[0] = 1
        self.used, self.known = 1, 1

    def _add(self, hashes: list[int], words: list[bytes]) -> None:
        """Encode new words and keep their ids behind each other."""
        self.memo.clear()
        self._encode_words(set(words))
        flat = [self.memo[w] for w in words]
        new = np.frombuffer(b"".join(flat), "<u4")
        n = len(words)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(new), "<u4")])
        if self.known + n > len(self.start):
            more = np.zeros(self.known + n, np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        lengths = np.array([len(f) // 4 for f in flat], np.int64)
        self.ids[self.used : self.used + len(new)] = new
        self.start[self.known : self.known + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.known : self.known + n] = lengths
        self.places.update(zip(hashes, range(self.known, self.known + n)))
        self.used, self.known = self.used + len(new), self.known + n
        self.memo.clear()

    def encode_column(self, col: pa.Array, end_id: int, memo_words: int = MEMO_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each text) of slices of a string column, each text with the end id.

        The same words as in ``encode``, found for a whole slice at once and told apart by 64-bit
        hashes; a word is spelled out only when it is new.
        """
        data, offsets = text_column(col)
        for lo, hi in slices(offsets, 1 << 20):
            off = offsets[lo : hi + 1]
            raw = data[off[0] : off[-1]].tobytes()
            if b"<|" in raw:
                coded = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1] - off[0], off[1:] - off[0])], end_id)
                yield np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], np.int64)
                continue
            hashes, starts, ends, at = word_pieces(data, off)
            u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            if self.known > memo_words:
                self.forget()
            keys = u.tolist()
            fresh = [i for i, k in enumerate(keys) if k not in self.places]
            if fresh:
                low = raw.lower()
                self._add([keys[i] for i in fresh], [low[starts[first[i]] : ends[first[i]]] for i in fresh])
            place = np.fromiter(map(self.places.__getitem__, keys), np.int64, len(keys))[inverse]
            n = hi - lo
            pieces = np.zeros(len(place) + n, np.int64)  # place 0 ends a text
            last = at[1:] + np.arange(n)
            keep = np.ones(len(pieces), bool)
            keep[last] = False
            pieces[keep] = place
            self.ids[0] = end_id
            size = self.length[pieces]
            total = np.cumsum(size)
            ids = self.ids[np.repeat(self.start[pieces] - (total - size), size) + np.arange(int(total[-1]))]
            yield ids, np.diff(np.concatenate([[0], total[last]]))

    def _learn(self, tokenizer, keys: list[bytes], words: list[str]) -> None:
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            e = tokenizer.encode(words[i : i + 20_000], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            ends = 4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part)), "right")
            at = 0
            for k, end in zip(part, ends.tolist()):
                self.memo[k] = raw[at:end]
                at = end

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Little-endian uint32 ids of each text, each with the end id."""
        split = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            split.append((raw if b"<|" in raw else _TAIL.sub(rb"\1 \2", raw.lower())).split())
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        self._encode_words(set().union(*split) - self.memo.keys() if split else set())
        end = np.array([end_id], "<u4").tobytes()
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) + end for words in split]

    def _encode_words(self, fresh: set[bytes]) -> None:
        plain: tuple[list, list] = ([], [])
        other: tuple[list, list] = ([], [])
        for w in fresh:
            text = w.decode("utf-8", "replace")
            low = text.lower()
            to = plain if _LETTERS.fullmatch(low) else other
            to[0].append(w)
            to[1].append(low if to is plain else text)
        self._learn(self.letters, *plain)
        self._learn(self.tokenizer, *other)


#: A run of ASCII marks (no apostrophe) that ends a word behind an ASCII letter or digit.
_TAIL = re.compile(rb"([a-z0-9])([!-&(-/:-@\[-`{-~]+)(?=[\s]|\Z)")

_ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARK[39] = False


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of consecutive rows with _TAIL cut off, and the rows' offsets."""
    a = lowered(data[offsets[0] : offsets[-1]])
    off = offsets - offsets[0]
    n = len(a)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64)
    solid, begins = word_starts(a, off)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | begins[1:]
    i = np.arange(n)
    core = np.maximum.accumulate(np.where(_MARK[a] & ~begins, -1, i))
    end = np.nonzero(stops)[0]
    c = core[end]
    cut = (c < end) & _ALNUM[a[c]] & solid[c]
    begins[c[cut] + 1] = True
    starts = np.nonzero(begins)[0]
    stops[c[cut]] = True
    ends = np.nonzero(stops)[0] + 1
    return hash_pieces(a, solid, starts), starts, ends, np.searchsorted(starts, off)


_LETTERS = re.compile("[a-zà-öø-ÿ]+")

_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS, memo_words: int = MEMO_WORDS) -> None:
    """Encode whole texts and write shards in ascending document order.

    Null texts are empty, null document ids come first, rows of one id follow each other in the
    order of their texts. Texts are dealt by ranges of ids, so no task holds more than its range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits = bits_for(max(enc.vocab_size, end_id + 1))
        ids: list[int | None] = []
        chunks: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            data = write_shard(ids, np.concatenate(lengths), np.concatenate(chunks), bits, seq=seq)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["shard"])

        for b in batches:
            at = 0
            doc_ids = b.column(0).to_pylist()
            for coded, n in enc.encode_column(b.column(1), end_id, memo_words):
                ids += doc_ids[at : at + len(n)]
                chunks.append(coded.astype("<u2") if bits <= 16 else coded)
                lengths.append(n)
                held += len(coded)
                at += len(n)
                if held >= shard_ids:
                    yield flush()
                    ids, chunks, lengths, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush()

    dealt.mapInArrow(trimmed(run), "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SHARDS).text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: its place, its length, and a checksum of its ids."""
    schema = pa.schema([("shard_null", pa.bool_()), ("shard_first", pa.int64()), ("shard_seq", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                for s in shards(raw.as_py()):
                    ids = s.ids(0, s.n_ids)
                    view = memoryview(ids.tobytes())
                    ends = np.cumsum(s.lengths)
                    starts = ends - s.lengths
                    n = len(s.doc_ids)
                    crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(starts, ends)]
                    doc = pa.array(s.doc_ids, mask=s.nulls.astype(bool))
                    first = [None if n == 0 or s.nulls[0] else int(s.doc_ids[0])] * n
                    # rows of one id are in one range, so the number orders shards that begin with one id
                    cols = [pa.array([bool(n and s.nulls[0])] * n, pa.bool_()), pa.array(first, pa.int64()), pa.array([s.seq] * n, pa.int64()), doc, pa.array(starts), pa.array(s.lengths), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([ids[a:e].tolist() for a, e in zip(starts, ends)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "shard_null boolean, shard_first bigint, shard_seq bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(trimmed(run), ddl)


def with_starts(read: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before. Only one row a shard meets in one task."""
    key = ["shard_null", "shard_first", "shard_seq"]
    order = Window.orderBy(F.col("shard_null").desc(), F.col("shard_first"), F.col("shard_seq")).rowsBetween(Window.unboundedPreceding, -1)
    name = F.concat_ws(":", F.col("shard_null").cast("string"), F.coalesce(F.col("shard_first"), F.lit(0)).cast("string"), F.col("shard_seq").cast("string"))
    base = read.groupBy(*key).agg(F.sum("n_tokens").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0))).select(name.alias("shard"), "base")
    return read.withColumn("shard", name).join(base, "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("shard", "base", "local_start", *key)


def tokenize_to_files(docs: DataFrame, tokenizer: str, end_id: int, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and describe them as read back.

    ``memo_words`` trades a worker's memory (about 200 bytes a word) for time, nothing else.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, memo_words=memo_words)
    return with_starts(materialize(read_tokens(spark, path), "token-rows"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize_to_files(docs, default_tokenizer(), 2).select("doc_id", "start", "n_tokens", "ids_crc32")
