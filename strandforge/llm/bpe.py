"""Byte-level BPE encoding and decoding, pre-tokenised without regular expressions.

Texts become arrays of code points, code points classes (letter, number, white space, other; apostrophes and white space by what
follows). A table of transition functions over eight states says where a token begins. Functions compose associatively, so blocks of
the text are composed side by side, block totals are chained, and a second pass gives the state before every character.
The slices found are numbered by hash; only slices that the worker's cache doesn't have are merged, all of a batch at once. A slice's
tokens keep their byte offsets, decoding gathers tokens' bytes, and a text whose decoded bytes differ from its own is encoded
again slice by slice.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import in_slices, ragged, read, slice_hashes

#: The pattern that the table below stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slices that a worker's cache holds at most, and bytes from which a slice is merged by a heap.
CACHE, LONG = 400_000, 48
#: Bytes of text that a step of numpy work takes (one text at least); the arrays take some hundred times as many.
SLICE = 1 << 18

L, N, O, SPACE, LAST_WHITE, WHITE, SHORT, LONGER = range(8)  # symbols; the last two: an apostrophe before one or two letters of a contraction
FRESH, IN_L, IN_N, IN_O, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)  # states


def _table() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state]: the next state; begins[symbol, state]: whether a token begins here. Symbols from 8 on are the same at a
    text's start, 16 is no symbol."""
    step, begins = np.zeros((17, 8), np.uint8), np.ones((17, 8), bool)
    for s in range(8):
        for symbol, run in ((L, IN_L), (N, IN_N), (O, IN_O), (SHORT, IN_O), (LONGER, IN_O)):
            step[symbol, s] = run
            begins[symbol, s] = s not in (run, AFTER_SPACE)
        for symbol, left in ((SHORT, ONE_LEFT), (LONGER, TWO_LEFT)):
            if begins[symbol, s]:
                step[symbol, s] = left
        step[SPACE, s], step[LAST_WHITE, s], step[WHITE, s] = AFTER_SPACE, FRESH, IN_WHITE
    begins[WHITE, IN_WHITE] = False
    step[L, TWO_LEFT], begins[L, TWO_LEFT] = ONE_LEFT, False
    step[L, ONE_LEFT], begins[L, ONE_LEFT] = FRESH, False
    step[8:16] = step[:8, FRESH : FRESH + 1]
    step[16] = np.arange(8)
    return step.ravel(), begins.ravel()


STEP, BEGINS = _table()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point: 0 letter, 1 number, 2 other, 3 white space. Read off the tokenizer library's own tables, by
    encoding all code points under the pattern of one class, which skips the rest."""
    if not _classes:
        import tiktoken

        of = np.full(0x110000, 2, np.uint8)
        one = {bytes([b]): b for b in range(256)}
        for pattern, kind in ((r"\p{L}", 0), (r"\p{N}", 1), (r"\s", 3)):
            enc = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=one, special_tokens={})
            for at in range(0, 0x110000, 1 << 14):
                part = "".join(chr(c) for c in range(at, at + (1 << 14)) if not 0xD800 <= c < 0xE000)
                for c in bytes(enc.encode_ordinary(part)).decode():
                    of[ord(c)] = kind
        _classes.append(of)
    return _classes[0]


def states(symbols: np.ndarray, width: int = 128) -> np.ndarray:
    """The state before each symbol, by composing transition functions."""
    rows = -(-len(symbols) // width)
    block = np.full(rows * width, 16, np.intp)
    block[: len(symbols)] = symbols
    block = np.ascontiguousarray(block.reshape(rows, width).T) * 8
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in block:
        whole = STEP[column[:, None] + whole]
    first, state = np.empty(rows, np.uint8), FRESH
    for r, f in enumerate(whole.tolist()):
        first[r] = state
        state = f[state]
    before = np.empty((width, rows), np.uint8)
    for column, out in zip(block, before):
        out[:] = first
        first = STEP[column + first]
    return before.T.ravel()[: len(symbols)]


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens begin, in code points. first marks the texts' first characters."""
    n = len(cp)
    symbol = classes()[cp].astype(np.intp)
    white = symbol == 3
    last = np.ones(n, bool)
    last[:-1] = first[1:]  # the last character of its text
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:]
    follows &= ~last
    symbol[white] = WHITE
    symbol[white & follows] = LAST_WHITE
    symbol[white & follows & (cp == 32)] = SPACE
    quote = np.flatnonzero((cp == 39) & ~last)
    if len(quote):
        a = cp[quote + 1]
        b = cp[np.minimum(quote + 2, n - 1)]
        b = np.where(last[quote + 1], 0, b)
        symbol[quote[np.isin(a, [115, 116, 109, 100])]] = SHORT  # s t m d
        symbol[quote[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]] = LONGER  # re ve ll
    symbol[first] += 8
    return np.flatnonzero(BEGINS[symbol * 8 + states(symbol)])


class Model:
    """The ranks of a vocabulary, and a cache of slices."""

    def __init__(self, ranks: bytes) -> None:
        pairs = (x.split() for x in ranks.splitlines() if x.strip())
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.length = np.array([len(t) for t in token])
        self.at, self.bytes = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(token), np.uint8)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)])
        get = self.rank.get
        joins = [(a << 32 | b, r) for t, r in self.rank.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        joins.sort()
        self.pair, self.joined = (np.array(x, np.int64) for x in zip(*joins))
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.begin, self.count = [np.zeros(0, np.int64)], [], []
        self.used = 0

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or a number above all ranks."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[at] == code, self.joined[at], 1 << 40)

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many slices, and how many each has. In each round each slice makes its first merge of least rank."""
        none, k = 1 << 40, len(start)
        out: list = [None] * k
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = self.merge_long(data[start[i] : start[i] + length[i]])
        left = np.flatnonzero(length <= LONG)
        tok, seg = self.byte[data[ragged(start[left], length[left])]], np.repeat(left, length[left])
        rank = np.full(len(tok), none)
        same = np.flatnonzero(seg[1:] == seg[:-1])
        rank[same] = self.joins(tok[same], tok[same + 1])
        done_tok, done_seg = [], []
        while len(tok):
            begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(begin, append=len(tok))
            best = np.minimum.reduceat(rank, begin)
            ended = np.repeat(best == none, size)
            if ended.any():
                done_tok.append(tok[ended])
                done_seg.append(seg[ended])
                tok, seg, rank = tok[~ended], seg[~ended], rank[~ended]
                if not len(tok):
                    break
                size, best = size[best != none], best[best != none]
            here = np.flatnonzero(rank == np.repeat(best, size))
            at = here[np.append(True, seg[here[1:]] != seg[here[:-1]])]
            tok[at] = rank[at]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            tok, seg, rank = tok[keep], seg[keep], rank[keep]
            at = at - np.arange(len(at))
            for x in (at, at[at > 0] - 1):
                inner = x + 1 < len(tok)
                inner[inner] = seg[x[inner] + 1] == seg[x[inner]]
                rank[x[~inner]] = none
                rank[x[inner]] = self.joins(tok[x[inner]], tok[x[inner] + 1])
        tok, seg = np.concatenate([*done_tok, np.zeros(0, np.int64)]), np.concatenate([*done_seg, np.zeros(0, np.int64)])
        order = np.argsort(seg, kind="stable")
        tok, count = tok[order], np.bincount(seg, minlength=k)
        if any(x is not None for x in out):
            begin = np.cumsum(count) - count
            parts = [tok[begin[i] : begin[i] + count[i]] if x is None else x for i, x in enumerate(out)]
            tok, count = np.concatenate(parts), np.array([len(x) for x in parts])
        return tok, count

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """The tokens of one slice: a heap of joins over a linked list, for slices of any length."""
        text, n = data.tobytes(), len(data)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get, heap = self.rank.get, []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := get(text[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to:
                continue
            alive[end[i]] = False
            end[i] = to
            if to < n:
                before[to] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([self.rank[text[i : end[i]]] for i in range(n) if alive[i]], np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of texts (UTF-8, one after another) and the number of each text's."""
        texts = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(texts, np.int64)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.zeros(len(cp) + 1, bool)
        first[np.searchsorted(lead, off)] = True
        start = lead[token_starts(cp, first[:-1])]
        end = np.append(start[1:], len(data))
        h, one, inverse = np.unique(slice_hashes(data, start, end), return_index=True, return_inverse=True)
        get = self.slot.get
        slot = np.array([get(x, -1) for x in h.tolist()])
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.slot) > CACHE:
                self.clear()
                new = np.arange(len(h))
            s = start[one[new]]
            ids, count = self.merge(data, s, end[one[new]] - s)
            slot[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update(zip(h[new].tolist(), slot[new].tolist()))
            self.begin.append(self.used + np.cumsum(count) - count)
            self.count.append(count)
            self.ids.append(ids)
            self.used += len(ids)
        for x in (self.ids, self.begin, self.count):
            x[:] = [np.concatenate(x)] if len(x) > 1 else x
        count = self.count[0][slot][inverse]
        ids = self.ids[0][ragged(self.begin[0][slot][inverse], count)]
        per = np.zeros(texts, np.int64)
        np.add.at(per, np.searchsorted(off, start, "right") - 1, count)
        return ids, per

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.at[ids], self.length[ids])]

    def exactly(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with every text's decoded bytes held against its own; one that differs goes through an empty cache."""
        ids, per = self.encode(data, off)
        if np.array_equal(self.decode(ids), data):
            return ids, per
        parts = []
        for i in range(len(off) - 1):
            self.clear()
            parts.append(self.encode(data[off[i] : off[i + 1]], off[i : i + 2] - off[i])[0])
        return np.concatenate(parts), np.array([len(x) for x in parts])


_models: dict[str, Model] = {}


def model(ranks: bytes) -> Model:
    """The vocabulary's model, one for each worker process."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _models:
        _models[key] = Model(ranks)
    return _models[key]


def ranks_of(spark: SparkSession, path: str):
    """The rank file, a few hundred kB, read where the query starts and broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, offsets (the first byte of each token) of each row of docs. Null text is empty and has no tokens; other columns
    aren't read; rows that repeat are encoded each."""
    from pyspark.sql import functions as F

    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ranks = ranks_of(docs.sparkSession, path)

    def of(batches):
        m = model(ranks.value)
        for rows, data, off in in_slices(batches, "text", SLICE):
            ids, per = m.exactly(data, off)
            at = np.append(0, np.cumsum(per)).astype(np.int32)
            begin = np.cumsum(m.length[ids]) - m.length[ids] - np.repeat(off[:-1], per)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (ids, begin)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *lists], ["doc_id", "ids", "offsets"])

    return raw.mapInArrow(of, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and content (bytes) of each row of encode(). Null ids are empty."""
    ranks = ranks_of(encoded.sparkSession, path)

    def of(batches):
        m = model(ranks.value)
        for rows in batches:
            content = [m.decode(np.array(x or [], np.int64)).tobytes() for x in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(content, pa.binary())], ["doc_id", "content"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(of, f"doc_id {kind}, content binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs, encoded and decoded where the row is."""
    from pyspark.sql import functions as F

    raw = docs.select("doc_id", F.col("text"))
    ranks = ranks_of(docs.sparkSession, path)

    def of(batches):
        m = model(ranks.value)
        for rows, data, off in in_slices(batches, "text", SLICE):
            ids, per = m.exactly(data, off)
            back, size = m.decode(ids).tobytes(), m.length[ids]
            to = np.append(0, np.cumsum(per))
            bytes_to = np.append(0, np.cumsum(size))[to].tolist()
            raw_ids = ids.astype("<u4").tobytes()
            to = to.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(per, pa.int64()),
                    pa.array([hashlib.sha256(raw_ids[4 * a : 4 * b]).hexdigest() for a, b in zip(to, to[1:])]),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(bytes_to, bytes_to[1:])]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return raw.mapInArrow(of, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
