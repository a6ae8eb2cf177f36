"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary file's merge pieces are applied as an agenda: of all adjacent symbols whose concatenation
is a piece, the best-scored is merged first (the leftmost of equals). With dropout, every candidate that
the agenda forms is skipped for good with probability ``dropout``, decided by a keyed hash of (seed,
document, begin, middle, end): the same seed gives the same segmentation on any cluster, another seed or
another place in the text gives another. Without dropout the ids equal the library's. Characters without
a piece, and the space symbol where a text contains it literally, become byte pieces, so that every
segmentation decodes to exactly its text.

No piece crosses from a letter to a space symbol, so texts fall into independent words and whole batches
of words run through the agenda together, one merge per word and step, as array operations. Texts are cut
at words into runs of bounded size; memory doesn't grow with a document. Words of more than ``LONG``
symbols use a heap.

Null and empty texts have no ids. Every row is encoded by itself; rows of one doc_id and text get equal
ids. Columns of the input are kept; ``ids``, ``n_tokens`` and ``lossless`` replace columns of that name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, query, read

DROPOUT = 0.1
SEED = 29
RUN = 400_000  # characters that go through the agenda together
LONG = 400

SPACE = 0x2581
_LITERAL = 0x110000  # stands for a space symbol that the text itself contains
_NEVER = np.int64(1) << 60
_U = np.uint64


def _mix(x):
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Pieces:
    """Vocabulary of a BPE model file: characters, merges and the bytes each id stands for."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = range(model.get_piece_size())
        normal = {model.id_to_piece(i): i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
        self.byte = np.zeros(256, np.int64)
        self.bytes_of = [b""] * len(ids)
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif piece in normal:
                self.bytes_of[i] = piece.replace("▁", " ").encode()
        # symbols: ids of pieces; characters that only occur inside pieces follow after the last id
        symbol = dict(normal)
        for piece in normal:
            for c in piece:
                symbol.setdefault(c, len(ids) + len(symbol))
        self.char = np.full(_LITERAL + 1, -1, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        low = np.flatnonzero(self.char[:128] < 0)
        self.char[low] = self.byte[low]
        order = sorted(normal, key=lambda p: (-model.get_score(normal[p]), normal[p]))
        self.width = max(symbol.values()) + 1
        self.rank = np.full(self.width, _NEVER, np.int64)
        self.merges: dict[int, int] = {}
        for place, piece in enumerate(order):
            self.rank[normal[piece]] = place
            for k in range(1, len(piece)):
                if piece[:k] in symbol and piece[k:] in symbol:
                    self.merges[symbol[piece[:k]] * self.width + symbol[piece[k:]]] = normal[piece]
        # open addressing, for lookups of whole arrays
        self.mask = (1 << (2 + max(1, len(self.merges)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int64)
        for key, value in self.merges.items():
            at = int(_mix(np.array([key], _U))[0]) & self.mask
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece ids of the concatenations, -1 where there is none."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -2)
        at = (_mix(key.view(_U)) & _U(self.mask)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")[1:]


_pieces: dict[str, Pieces] = {}


def pieces(file: str) -> Pieces:
    if file not in _pieces:
        _pieces[file] = Pieces(file)
    return _pieces[file]


def document_key(seed: int, doc_id) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest(), "little")


def _skipped(key, begin, middle, end, dropout: float):
    """Which candidate merges the keyed hash drops."""
    x = _mix(key ^ _mix(begin.astype(_U) * _U(0x9E3779B97F4A7C15) + middle.astype(_U)) ^ (end.astype(_U) * _U(0xD6E8FEB86659FD93)))
    return _mix(x) < _U(int(dropout * 2.0**64) if dropout < 1 else 2**64 - 1)


def _candidates(p: Pieces, left, right, key, begin, middle, end, dropout: float):
    """(rank, piece) of each pair; rank _NEVER where nothing merges or the hash skips it."""
    piece = p.merged(left, right)
    rank = np.where(piece >= 0, p.rank[piece], _NEVER)
    if dropout > 0:
        live = np.flatnonzero(piece >= 0)
        rank[live[_skipped(key[live], begin[live], middle[live], end[live], dropout)]] = _NEVER
    return rank, piece


def _by_heap(p: Pieces, sym: list[int], at: list[int], stop: int, key, dropout: float) -> list[tuple[int, int]]:
    """One word through the agenda, with a heap; [(place, symbol)] of what remains."""
    n = len(sym)
    ends = [*at[1:], stop]
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap: list = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if i < 0 or j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        piece = p.merges.get(sym[i] * p.width + sym[j])
        if piece is None:
            return
        one = lambda x: np.array([x], np.int64)
        if dropout > 0 and _skipped(np.array([key], _U), one(at[i]), one(at[j]), one(ends[j]), dropout)[0]:
            return
        heapq.heappush(heap, (int(p.rank[piece]), at[i], i, j, ends[i], ends[j], piece))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, _, i, j, end_i, end_j, piece = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or ends[i] != end_i or ends[j] != end_j:
            continue
        sym[i], ends[i], alive[j], after[i] = piece, end_j, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [(at[i], sym[i]) for i in range(n) if alive[i]]


def encode_run(p: Pieces, code: np.ndarray, key: np.ndarray, place: np.ndarray, fresh: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """A run of symbols: ``code`` points with their document's ``key``, ``place`` in the document, and
    ``fresh`` where a document begins. Returns indices into the run and the symbols that begin there."""
    n = len(code)
    sym = p.char[code]
    first = fresh | (sym < 0) | ((code == SPACE) & np.append(True, code[:-1] != SPACE))
    first |= np.append(False, sym[:-1] < 0)
    out = np.full(n, -1, np.int64)
    done = np.zeros(n, bool)
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, n))
    for s, k in zip(start[length > LONG].tolist(), length[length > LONG].tolist()):
        base = int(place[s])
        for at, symbol in _by_heap(p, sym[s:s + k].tolist(), list(range(base, base + k)), base + k, key[s], dropout):
            out[s + at - base], done[s + at - base] = symbol, True
    keep = np.repeat(length <= LONG, length)
    pos = np.flatnonzero(keep)
    word = np.cumsum(first)[pos]
    sym, key, at = sym[pos], key[pos], place[pos]
    end = at + 1
    pair = np.append(word[1:] == word[:-1], False)
    nxt = np.minimum(np.arange(len(pos)) + 1, max(len(pos) - 1, 0))
    rank, piece = _candidates(p, np.where(pair, sym, -1), sym[nxt], key, at, at[nxt], end[nxt], dropout)
    while len(pos):
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, head)
        length = np.diff(np.append(head, len(pos)))
        live = np.repeat(best < _NEVER, length)
        out[pos[~live]], done[pos[~live]] = sym[~live], True
        if not live.any():
            break
        is_best = (rank == np.repeat(best, length)) & live
        m = np.flatnonzero(is_best)
        m = m[np.append(True, word[m[1:]] != word[m[:-1]])]  # the leftmost of a word
        sym[m], end[m] = piece[m], end[m + 1]
        live[m + 1] = False
        # what remains, and where the merged symbols are now
        now = np.cumsum(live) - 1
        m = now[m]
        pos, word, sym, key, at, end, rank, piece = (x[live] for x in (pos, word, sym, key, at, end, rank, piece))
        redo = np.concatenate((m, m[m > 0] - 1))
        redo = redo[word[np.minimum(redo + 1, len(pos) - 1)] == word[redo]]
        redo = redo[redo + 1 < len(pos)]
        last = m[(m + 1 == len(pos)) | (word[np.minimum(m + 1, len(pos) - 1)] != word[m])]
        rank[last] = _NEVER
        rank[redo], piece[redo] = _candidates(p, sym[redo], sym[redo + 1], key[redo], at[redo], at[redo + 1], end[redo + 1], dropout)
    where = np.flatnonzero(done)
    return where, out[where]


def _runs(codes: list[np.ndarray], keys: list[int], run: int):
    """Cuts documents at words into runs: (code, key, place, fresh, document number)."""
    parts, size = [], 0
    for d, (code, key) in enumerate(zip(codes, keys)):
        a = 0
        while a < len(code):
            b = min(len(code), a + run - size)
            if b < len(code):
                cuts = np.flatnonzero((code[a + 1:b + 1] == SPACE) & (code[a:b] != SPACE))
                if len(cuts):
                    b = a + 1 + int(cuts[-1])
                elif not size:  # one word of more than a run
                    rest = np.flatnonzero((code[b + 1:] == SPACE) & (code[b:-1] != SPACE))
                    b = b + 1 + int(rest[0]) if len(rest) else len(code)
                else:
                    b = a
            if b > a:
                parts.append((d, key, a, code[a:b]))
                size += b - a
                a = b
            if a < len(code) or size >= run:
                yield parts
                parts, size = [], 0
    if parts:
        yield parts


def encode(p: Pieces, texts: list[str | None], keys: list[int], dropout: float = DROPOUT, run: int = RUN) -> list[np.ndarray]:
    codes = []
    for t in texts:
        if not t:
            codes.append(np.empty(0, np.int64))
            continue
        c = np.frombuffer(("▁" + t).encode("utf-32-le"), np.uint32).astype(np.int64)
        c[1:][c[1:] == SPACE] = _LITERAL
        c[c == 32] = SPACE
        codes.append(c)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for parts in _runs(codes, keys, run):
        sizes = np.array([len(c) for *_, c in parts])
        code = np.concatenate([c for *_, c in parts])
        first = np.cumsum(sizes) - sizes
        fresh = np.zeros(len(code), bool)
        fresh[first] = True
        key = np.repeat(np.array([k for _, k, _, _ in parts], _U), sizes)
        place = np.arange(len(code)) - np.repeat(first - np.array([a for _, _, a, _ in parts]), sizes)
        where, symbol = encode_run(p, code, key, place, fresh, dropout)
        ids, owner = _with_bytes(p, code, where, symbol, np.repeat(np.arange(len(parts)), sizes))
        cut = np.searchsorted(owner, np.arange(len(parts) + 1))
        for i, (d, *_) in enumerate(parts):
            found[d].append(ids[cut[i]:cut[i + 1]])
    return [np.concatenate(f).astype(np.int32) if f else np.empty(0, np.int32) for f in found]


def _with_bytes(p: Pieces, code, where, symbol, part):
    """Symbols without an id become the byte pieces of their characters."""
    odd = np.flatnonzero((symbol < 0) | (symbol >= len(p.bytes_of)))
    if not len(odd):
        return symbol, part[where]
    raw = [chr(c if c != _LITERAL else SPACE).encode() for c in code[where[odd]].tolist()]
    count = np.ones(len(symbol), np.int64)
    count[odd] = [len(r) for r in raw]
    ids = np.repeat(symbol, count)
    to = (np.cumsum(count) - count)[odd]
    for a, r in zip(to.tolist(), raw):
        ids[a:a + len(r)] = p.byte[np.frombuffer(r, np.uint8)]
    return ids, np.repeat(part[where], count)


def encoded(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ids, n_tokens and lossless (whether the ids decode to the text)."""
    own = ["ids", "n_tokens", "lossless"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    df = docs.select(F.col("doc_id").alias("id"), F.col(text).alias("body"), *[F.col(c).alias(f"in{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = encode(p, texts, [document_key(seed, d) for d in batch.column(0).to_pylist()], dropout)
            count = np.array([len(x) for x in found], np.int64)
            good = [p.decode(x.tolist()) == (t or "") for x, t in zip(found, texts)]
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], ids, pa.array(count), pa.array(good)], names=[*batch.schema.names[2:], *own])

    arrow_rows(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[2:])
    out = df.mapInArrow(run, f"{fields}{', ' if fields else ''}ids array<int>, n_tokens long, lossless boolean")
    return out.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(kept)], *own)


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """``tokens`` with ``text`` read from ``ids``, in place of a column of that name."""
    kept = [c for c in tokens.columns if c not in ("ids", "text")]
    df = tokens.select("ids", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            texts = pa.array([p.decode(x or []) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*batch.schema.names[1:], "text"])

    arrow_rows(tokens.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[1:])
    return df.mapInArrow(run, f"{fields}{', ' if fields else ''}text string")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_piece_dropout")
def op1_piece_dropout(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("n_chars", F.length("text"))
    return encoded(docs, model_file(), keep=["doc_id", "n_chars"])
