"""Token ids in Parquet files, for selective reading.

Documents are range-partitioned by id, tokenised in that order, and written by Spark as one file per
range: doc_id, n_tokens, offset (ids before it in its file), shard (the file's place) and ids, a list
column. Ids are dictionary-encoded; doc_id, n_tokens and offset are delta-encoded (they ascend or are
small); row groups and pages have set sizes and carry page indexes, so a reader of a few documents opens
a few pages and a reader of metadata opens no ids. A global start is a file's base, from its summed
token counts, plus the offset.

A chunk of non-space characters with the blank before it always yields the same ids, so chunks go through
the tokenizer once per worker and are remembered up to a bound; the ids of a batch of texts are then gathered
by the places of their chunks. Texts that hold the string of a special token go through it whole: the
tokenizer gives it its special id, as it does when called plainly.

Null texts are empty (the end id alone). Repeated rows and ids each keep their own entry, side by side;
null ids come first. Columns besides id and text are not stored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, new_path, query, read, stored

END_ID = 0
REMEMBERED = 1_000_000

#: Parquet settings: row groups, pages, page index rows, encodings per column.
FILE_OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#offset": "false",
}

#: White space as the tokenizer's pattern means it (Unicode's property, which has no \x1c-\x1f).
_W = "\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+").findall

#: Signs after a letter or digit are always cut off from it, so they can be looked up by themselves.
_SIGNS = ".,;:!?#$%&*|"


def _byte_letters() -> np.ndarray:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 characters as they are,
    other bytes from U+0100 on. The line end stays, to divide words."""
    letters = np.arange(256, dtype="<u4")
    other = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b and b != 0xAD)]
    letters[other] = np.arange(0x100, 0x100 + len(other))
    letters[10] = 10
    return letters


class _Places(dict):
    """Chunk to place; chunks that are asked for the first time get the next places."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at


class Encoder:
    """Ids of whole texts, chunk by chunk: each chunk has a place, and the ids of all places are one array."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.special = list({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        # the same model over single words that are cut and written in byte letters already
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters = _byte_letters()
        size = self.tokenizer.get_vocab_size()
        # in a byte-level vocabulary each character of a token stands for one byte
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.places, self.ids, self.n_ids = _Places(), np.empty(1 << 20, "<u4"), 0
        self.start, self.length = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)
        self.n_known = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append ids to the array; the starts of its parts."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        starts = self.n_ids + np.cumsum(lengths) - lengths
        self.n_ids += len(ids)
        return starts

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of ``chunks`` in one array, and where each begins and how many it has."""
        easy, hard = [], []
        for i, c in enumerate(chunks):
            body = c[1:] if c[0] == " " else c
            word = body.isalpha() and (body.isascii() or max(body) < "\u0370")  # one word of the tokenizer's pattern
            (easy if word else hard).append(i)
        parts, lengths = [], np.empty(len(chunks), np.int64)
        for a in range(0, len(easy), 20_000):
            mine = easy[a:a + 20_000]
            raw = np.frombuffer("\n".join([chunks[i] for i in mine]).encode(), np.uint8)
            written = self.letters[raw].tobytes().decode("utf-32-le")
            ids = np.array(self.words.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(raw == 10), len(raw)) - np.arange(len(mine))
            lengths[mine] = np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1, prepend=0)
            parts.append(ids)
        for i in hard:
            parts.append(self._whole(chunks[i]))
            lengths[i] = len(parts[-1])
        order = np.array(easy + hard)
        begin = np.empty_like(lengths)
        begin[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(parts), begin, lengths

    def _learn(self) -> None:
        new, self.places.new = self.places.new, []
        place = _Places()  # of pieces: chunks, or chunks without their last signs and those signs
        one, two = [], []
        for c in new:
            body = c.rstrip(_SIGNS)
            if len(body) < len(c) and body and body[-1].isalnum():
                one.append(place[body])
                two.append(place[c[len(body):]])
            else:
                one.append(place[c])
                two.append(-1)
        ids, begin, lengths = self._encoded(place.new)
        both = np.array([one, two]).T.ravel()
        of_both = np.where(both >= 0, lengths[both], 0)
        total = of_both.reshape(-1, 2).sum(1)
        starts = self._keep(_gathered(ids, begin[both], of_both), total)
        while self.n_known + len(new) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        here = slice(self.n_known, self.n_known + len(new))
        self.start[here], self.length[here] = starts, total
        self.n_known += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        if len(self.places) > REMEMBERED:
            self._forget()
        whole = {i: self._whole(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        chunks = [() if i in whole else _CHUNKS(t) for i, t in enumerate(texts)]
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(chunks)), np.int64, int(n.sum()))
        if self.places.new:
            self._learn()
        lengths = self.length[at]
        ids = _gathered(self.ids, self.start[at], lengths)
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(n)] if len(n) else np.empty(0, np.int64)
        counts = np.diff(ends, prepend=0)
        if whole:
            parts = np.split(ids, ends[:-1])
            for i, own in whole.items():
                parts[i], counts[i] = own, len(own)
            ids = np.concatenate(parts)
        return ids, counts


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """``docs`` (doc_id, text) as token files under ``path``; ``tokenizer`` is a file on every executor."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before, shard = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            found, n = enc.encode(batch.column(1).to_pylist())
            counts = n + 1
            ends = np.cumsum(counts)
            with_end = np.full(int(counts.sum()), end_id, "<u4")
            with_end[np.arange(len(found)) + np.repeat(np.arange(len(n)), n)] = found
            values = pa.Array.from_buffers(pa.int32(), len(with_end), [None, pa.py_buffer(with_end)])
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(counts), shard, np.int32)), pa.array(before + ends - counts), pa.array(counts), ids],
                names=["doc_id", "shard", "offset", "n_tokens", "ids"])
            before += int(counts.sum())

    text = F.coalesce("text", F.lit(""))
    arrow_rows(docs.sparkSession)
    ordered = docs.select("doc_id", text.alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encode, "doc_id long, shard int, offset long, n_tokens long, ids array<int>").write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The token table with each document's global ``start``; without ``ids`` only metadata is read."""
    files = spark.read.parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    # one row per file
    bases = stored(sums.select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_base")), "token-bases")
    out = files.join(bases, "shard")
    return out.select("doc_id", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids as they are in the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, raw = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).view("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    arrow_rows(tokens.sparkSession)
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op2_token_files")
def op2_token_files(spark, sf_dir):
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read_tokens(spark, path))
