"""Byte-level BPE by prefix dynamic programming, and back to bytes.

For each prefix of a piece there is exactly one token that can stand last: one that ends there, and that merging would
not have joined differently with the last token of the prefix before it. Storing that token per prefix makes appending
exact and cheap, and an edit only needs the prefixes after its first changed byte.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.frames import BoundedCache, field, ragged_take, run_sums, text_slices, texts_of

PAIR_ENTRIES = 1_000_000
FAR = 1 << 60


class Ranks:
    """A rank file: token bytes and their order of merging."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.token: dict[int, bytes] = {b: a for a, b in self.rank.items()}
        lengths: dict[bytes, set[int]] = {}
        for raw in self.rank:
            lengths.setdefault(raw[-3:], set()).add(len(raw))
        # of the tokens that end in these three bytes (or are shorter), the lengths, longest first
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self.pairs = BoundedCache(PAIR_ENTRIES)
        self.edge: dict[int, tuple | None] = {}

    def merged(self, piece: bytes, leave: int = 1) -> list[bytes]:
        """Parts by the definition: join the neighbouring pair of lowest rank, the leftmost first, down to `leave` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > leave:
            best, at = min((self.rank.get(a + b, FAR), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == FAR:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """Parts that stand at the token's left and right edge while it is merged, each with the rank that ends it.

        Smallest first; the token itself is never ended. None if merging never gives this token.
        """
        if token not in self.edge:
            raw = self.token[token]
            if len(raw) > 1:
                parts = self.merged(raw, 2)
                good = len(parts) == 2 and parts[0] in self.rank and parts[1] in self.rank
                inner = [self.edges(self.rank[p]) for p in parts] if good else [None]
                self.edge[token] = None if None in inner else tuple(
                    [*((p, min(r, token)) for p, r in inner[side][side]), (raw, FAR)] for side in (0, 1)
                )
            else:
                self.edge[token] = ([(raw, FAR)], [(raw, FAR)])
        return self.edge[token]

    def agree(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives back these two; left = -1 asks for `right` alone.

        It does unless two parts that meet at the border are joined before either is ended by its own side.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self._agree(left, right)
            self.pairs.put(key, known)
        return known

    def _agree(self, left: int, right: int) -> bool:
        ours, theirs = self.edges(left)[1] if left >= 0 else [], self.edges(right)
        if theirs is None:
            return False
        theirs, i, j = theirs[0], 0, 0
        while i < len(ours):
            (a, a_end), (b, b_end) = ours[i], theirs[j]
            joined = self.rank.get(a + b, FAR)
            if joined < a_end and joined <= b_end and joined < FAR:
                return False
            if a_end == b_end == FAR:
                break
            i, j = (i + 1, j) if a_end <= b_end else (i, j + 1)
        return True


class NumberTable:
    """Fixed whole numbers to numbers >= 0, looked up by the array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot, left = slots(keys, self.bits), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            self.keys[slot[free[first]]], self.values[slot[free[first]]] = keys[free[first]], values[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out, slot, open_ = np.full(len(keys), -1, np.int64), slots(keys, self.bits), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """A slot of a table of 2 ** bits entries for each key."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class ManyPieces:
    """The same table of last tokens, filled for many short pieces at once, one prefix length after another."""

    LONGEST = 64
    MEMO_BITS = 20

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        nodes: dict[bytes, int] = {b"": 0}
        keys, values, token_of = [], [], [-1]
        for raw, token in ranks.rank.items():
            for end in range(1, len(raw) + 1):
                if raw[:end] not in nodes:
                    nodes[raw[:end]] = len(token_of)
                    keys.append(nodes[raw[: end - 1]] * 256 + raw[end - 1])
                    values.append(len(token_of))
                    token_of.append(-1)
            token_of[nodes[raw]] = token
        self.child = NumberTable(np.array(keys, np.int64), np.array(values, np.int64))
        self.token_of = np.array(token_of, np.int64)
        self.sizes = np.zeros(max(ranks.token) + 1, np.int64)
        for token, raw in ranks.token.items():
            self.sizes[token] = len(raw)
        self.memo_key, self.memo = np.full(1 << self.MEMO_BITS, -1, np.int64), np.zeros(1 << self.MEMO_BITS, bool)

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks.agree for each pair, remembered in a table of fixed size."""
        keys = (left + 1) * (1 << 32) + right
        at = slots(keys, self.MEMO_BITS)
        out, miss = self.memo[at], np.flatnonzero(self.memo_key[at] != keys)
        if len(miss):
            unknown, back = np.unique(keys[miss], return_inverse=True)
            said = np.array([self.ranks.agree(k // (1 << 32) - 1, k % (1 << 32)) for k in unknown.tolist()], bool)
            place = slots(unknown, self.MEMO_BITS)
            self.memo_key[place], self.memo[place] = unknown, said
            out[miss] = said[back]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, joined, and their number per piece; no piece is empty or longer than LONGEST bytes."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        inside = np.arange(len(data)) - np.repeat(begin, sizes)
        room = np.repeat(sizes, sizes) - inside
        # every token that begins at each byte, by walking the tree of token bytes
        alive, state, found = np.arange(len(data)), np.zeros(len(data), np.int64), []
        for size in range(1, self.LONGEST + 1):
            state = self.child.get(state * 256 + data[alive + size - 1])
            alive, state = alive[state >= 0], state[state >= 0]
            token = self.token_of[state]
            found.append((alive[token >= 0], token[token >= 0]))
            alive, state = alive[room[alive] > size], state[room[alive] > size]
            if not len(alive):
                break
        start, token = (np.concatenate(x) for x in zip(*found, strict=True))
        end = inside[start] + self.sizes[token]
        order = np.argsort(end, kind="stable")
        start, token, cuts = start[order], token[order], np.searchsorted(end[order], np.arange(1, self.LONGEST + 2))
        last = np.full(len(data), -1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                s, t = start[a:b], token[a:b]
                good = self.agree(np.where(inside[s] > 0, last[s - 1], -1), t)
                last[s[good] + self.sizes[t[good]] - 1] = t[good]
        if (last < 0).any():
            raise ValueError(f"no token for byte {data[np.argmin(last)]}")
        # back from the last byte of each piece
        piece, at, taken = np.arange(len(pieces)), begin + sizes - 1, []
        while len(piece):
            token = last[at]
            taken.append((piece, token))
            at = at - self.sizes[token]
            piece, at = piece[at >= begin[piece]], at[at >= begin[piece]]
        owner, token = (np.concatenate(x) for x in zip(*taken[::-1], strict=True))
        order = np.argsort(owner, kind="stable")
        return token[order].astype("<u4"), np.bincount(owner, minlength=len(pieces))


class PrefixTable:
    """The last token of each prefix of one piece of text."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        begun, last = len(self.data), self.last
        whole = self.data = self.data + data
        known, lengths, agree = self.ranks.rank.get, self.ranks.lengths.get, self.ranks.agree
        for end in range(begun + 1, len(whole) + 1):
            for size in (*lengths(whole[max(0, end - 3) : end], ()), 2, 1):
                start = end - size
                token = known(whole[start:end]) if start >= 0 else None
                if token is not None and agree(last[start - 1] if start else -1, token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token for byte {whole[end - 1]}")

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Bytes start..end become `data`; only prefixes that reach beyond `start` are computed again."""
        rest = data + self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(rest)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.ranks.token[out[-1]])
        return out[::-1]


def encode_piece(ranks: Ranks, piece: bytes) -> list[int]:
    """Tokens of one match of the pattern: itself if it is a token, else by its prefixes."""
    whole = ranks.rank.get(piece)
    return [whole] if whole is not None else PrefixTable(ranks, piece).tokens()


class Codec:
    """Encoder and decoder of one worker, with a bounded memory of encoded pieces."""

    def __init__(self, path: str, pattern: str, entries: int):
        import regex

        self.ranks, self.pieces = Ranks(path), regex.compile(pattern).findall
        self.many = ManyPieces(self.ranks)
        self.cache = BoundedCache(entries)
        self.bytes = np.frombuffer(b"".join(self.ranks.token.get(t, b"") for t in range(len(self.many.sizes))), np.uint8)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces as little-endian unsigned 32-bit numbers."""
        out = list(map(self.cache.get, pieces))
        open_ = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            raw = pieces[i].encode("utf-8")
            if raw in self.ranks.rank or len(raw) > self.many.LONGEST:
                out[i] = np.array(encode_piece(self.ranks, raw), "<u4").tobytes()
            else:
                open_.append((i, raw))
        if open_:
            ids, sizes = self.many.encode([raw for _, raw in open_])
            data, at = ids.tobytes(), 0
            for (i, _), size in zip(open_, (sizes * 4).tolist(), strict=True):
                out[i] = data[at : at + size]
                at += size
                self.cache.put(pieces[i], out[i])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and their number per text. Distinct pieces are encoded once."""
        cut = list(map(self.pieces, texts.to_pylist()))
        coded = pc.dictionary_encode(pa.array(list(chain.from_iterable(cut)), pa.string()))
        ids = self.encode_pieces(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = run_sums(lengths[codes], np.fromiter(map(len, cut), np.int64, len(cut)))
        return ragged_take(np.frombuffer(b"".join(ids), "<u4"), lengths, codes), sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.bytes, self.many.sizes, ids).tobytes()


_WORKER: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, entries: int = 600_000) -> Codec:
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = Codec(path, pattern, entries)
    return _WORKER[path, pattern]


def _over_texts(docs: DataFrame, id_col: str, text_col: str, columns: list[tuple[str, T.DataType, pa.DataType]], path: str, pattern: str, make: Callable) -> DataFrame:
    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch, text_col, 2 << 20):
                ids, sizes = coder.encode(texts_of(part, text_col))
                made = zip(*(make(coder, x) for x in np.split(ids, np.cumsum(sizes)[:-1])), strict=True)
                arrays = [pa.array(list(values), kind) for values, (_, _, kind) in zip(made, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), *arrays], [id_col, *(c[0] for c in columns)])

    schema = T.StructType([field(docs, id_col), *(T.StructField(name, kind) for name, kind, _ in columns)])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of every whole text: each match of `pattern` on its own, no special tokens.

    Null text counts as empty and gives no ids. Null and repeated ids stay row by row; an empty table gives an empty
    result; other columns are ignored. A text is worked on whole, with the texts of its slice (2 MB, or one text).
    """
    columns = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]
    return _over_texts(docs, id_col, text_col, columns, path, pattern, lambda _, ids: (ids.astype(np.int32),))


def decode_documents(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data) with the bytes of each list of ids; null ids give no bytes. Bytes need not be valid UTF-8."""

    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            data = [coder.decode(np.array(ids or [], np.int64)) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(data, pa.binary())], [id_col, "data"])

    schema = T.StructType([field(rows, id_col), T.StructField("data", T.BinaryType())])
    return rows.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes its ids, and hashes both sides in one pass.

    Rows and special cases as in `encode_documents`; an empty text has the hashes of no bytes.
    """

    def make(coder: Codec, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    columns = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _over_texts(docs, id_col, text_col, columns, path, pattern, make)
