"""Token ids of a lower-casing BPE tokenizer with word ends, encoding each distinct piece once per worker."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from peakweave.llm.frames import ragged_take, run_sums

# Texts of these characters only are cut by CUT; lower-casing and normal forms change one character at a time there.
LETTERS = "À-ÖØ-öø-įı-ſ"
UNUSUAL = f"[^\t\n\r -~{LETTERS}]|<\\|"
# fixed value: what the tokenizer's own pattern cuts off besides runs of letters, for the lower-cased characters above
CUT = "('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-z0-9ß-öø-įı-ſ]+)"
BLOCK, LONGEST = 256, 64


class WordCodec:
    """One worker's tokenizer and its bounded memory of pieces: an Arrow array of them, and their ids end to end."""

    def __init__(self, path: str, entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        with open(path, encoding="utf-8") as source:
            vocab = json.load(source)["model"]["vocab"]
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Nothing is known but the empty piece: a text split at white space may begin and end with one."""
        self.known, self.ids, self.sizes = pa.array([""], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text by the library, end to end, and their number per text."""
        coded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *coded]), np.array([len(c) for c in coded], np.int64)

    def side_by_side(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, many in one call; the token that ends a word ends its piece."""
        blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)]
        ids, sizes = self.whole([" ".join(b) for b in blocks])
        parts = [[np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]]
        for block, data in zip(blocks, np.split(ids, np.cumsum(sizes)[:-1]) if blocks else (), strict=True):
            ends = np.flatnonzero(self.word_end[data]) + 1
            found = (data, np.diff(ends, prepend=0)) if len(ends) == len(block) else self.whole(block)
            parts[0].append(found[0])
            parts[1].append(found[1])
        return np.concatenate(parts[0]), np.concatenate(parts[1])

    def remember(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, fresh: np.ndarray) -> None:
        """Add the fresh pieces; when there are too many, only those of the present texts stay."""
        pick = fresh
        if len(self.known) + len(fresh) > self.entries:
            self.forget()
            pick = np.flatnonzero(pc.not_equal(pieces, "").to_numpy(zero_copy_only=False))
        pick = pick[pc.utf8_length(pieces).to_numpy(zero_copy_only=False)[pick] <= LONGEST][: self.entries]
        self.known = pa.concat_arrays([self.known, pieces.take(pa.array(pick))])
        self.ids, self.sizes = np.concatenate([self.ids, ragged_take(ids, sizes, pick)]), np.concatenate([self.sizes, sizes[pick]])

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, end to end, and their number per piece."""
        at = pc.index_in(pieces, value_set=self.known)
        fresh = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(fresh):
            return ragged_take(self.ids, self.sizes, at), self.sizes[at]
        ids, sizes = self.side_by_side(pieces.take(pa.array(fresh)).to_pylist())
        at[fresh] = len(self.sizes) + np.arange(len(fresh))
        every = np.concatenate([self.sizes, sizes])
        out = ragged_take(np.concatenate([self.ids, ids]), every, at), every[at]
        self.remember(pieces, *out, fresh)
        return out

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces' ids end to end, ids per piece, the piece numbers of all texts, pieces per text. A text of unusual characters is one piece, encoded whole."""
        unusual = pc.match_substring_regex(texts, UNUSUAL)
        usual = pc.utf8_lower(pc.if_else(unusual, "", texts))
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(usual, CUT, " \\1 "))
        coded = pc.dictionary_encode(parts.flatten())
        ids, sizes = self.pieces(coded.dictionary)
        codes, counts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = np.flatnonzero(unusual.to_numpy(zero_copy_only=False))
        if len(odd):
            at = (np.cumsum(counts) - counts)[odd]
            codes = np.insert(codes, at, len(sizes) + np.arange(len(odd)))
            counts[odd] += 1
            more, lengths = self.whole(texts.take(pa.array(odd)).to_pylist())
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, lengths])
        return ids, sizes, codes, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and their number per text."""
        ids, sizes, codes, counts = self.coded(texts)
        return ragged_take(ids, sizes, codes), run_sums(sizes[codes], counts)


_WORKER: dict[str, WordCodec] = {}


def word_codec(path: str, entries: int = 400_000) -> WordCodec:
    if path not in _WORKER:
        _WORKER[path] = WordCodec(path, entries)
    return _WORKER[path]
