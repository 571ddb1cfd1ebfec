"""Token counts by a two-tier look-up: a broadcast table of frequent chunks, then each worker's own memory."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.frames import OTHER_SPACE, BoundedCache, chunk_codes, field, run_sums, text_slices, texts_of

#: A text where a space follows white space and precedes white space or the end: its chunks are not independent.
ENTANGLED = f"[ {OTHER_SPACE}] ([ {OTHER_SPACE}]|$)|<\\|"

_WORKER: dict[str, tuple] = {}


def _worker(path: str, entries: int) -> tuple:
    """This worker's tokenizer and its cache of chunk lengths, kept between tasks."""
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _WORKER[path] = (Tokenizer.from_file(path), BoundedCache(entries))
    return _WORKER[path]


def library_counts(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def frequent_lengths(docs: DataFrame, text_col: str, path: str, sample_rows: int, sample_bytes: int, table_size: int) -> dict[str, int]:
    """Token counts of the most frequent chunks in a sample of at most `sample_rows` texts of at most `sample_bytes` bytes each; at most `table_size` entries.

    The sample only decides which chunks are looked up fast, never a count.
    """
    short = docs.select(text_col).where(F.octet_length(text_col) <= sample_bytes)
    texts = [r[0] for r in short.limit(sample_rows).toLocalIterator()]
    seen = Counter(chunk for text in texts for chunk in text.split(" ") if len(chunk) <= 32)
    top = [chunk for chunk, _ in seen.most_common(table_size)]
    tokenizer, _ = _worker(path, 1)
    return dict(zip(top, library_counts(tokenizer, [" " + c for c in top]), strict=True))


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *,
    sample_rows: int = 1000, sample_bytes: int = 40_000, table_size: int = 50_000, cache_entries: int = 400_000,
) -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every whole text, as the tokenizer file at `path` counts, without added tokens.

    Byte-level tokenizers never merge over a space that starts a word. So texts are cut before each single space, each
    distinct chunk is looked up in the broadcast table, then in the worker's cache, and only misses are encoded; counts
    are added up within the task, so no chunk is shuffled. Texts whose spaces run together, or that may hold a special
    token, go through the tokenizer whole.

    Null text counts as empty (0 bytes, 0 tokens); null and repeated ids are kept row by row; an empty table gives an
    empty result; other columns are ignored. Memory holds one slice of texts, one text at least, the table and the cache.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, path, sample_rows, sample_bytes, table_size))

    def count(texts: pa.Array) -> np.ndarray:
        tokenizer, cache = _worker(path, cache_entries)
        known = frequent.value
        entangled = pc.match_substring_regex(texts, ENTANGLED).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        if entangled.any():
            out[entangled] = library_counts(tokenizer, texts.filter(pa.array(entangled)).to_pylist())
        easy = np.flatnonzero(~entangled)
        if len(easy):
            chunks, codes, sizes = chunk_codes(texts.take(pa.array(easy)), any_space=False)
            lengths = [known.get(c) or cache.get(c) or -1 for c in chunks]  # with its space, a chunk has one token at least
            missing = [i for i, n in enumerate(lengths) if n < 0]
            for i, n in zip(missing, library_counts(tokenizer, [" " + chunks[i] for i in missing]), strict=True):
                lengths[i] = n
                if len(chunks[i]) <= 64:
                    cache.put(chunks[i], n)
            sums = run_sums(np.array(lengths, np.int64)[codes], sizes)
            # the first chunk of a text has no space before it
            starts = np.cumsum(sizes) - sizes
            heads = [chunks[c] for c in codes[starts]]
            distinct = list(dict.fromkeys(heads))
            bare = dict(zip(distinct, library_counts(tokenizer, distinct), strict=True))
            out[easy] = sums - np.array(lengths, np.int64)[codes[starts]] + np.array([bare[h] for h in heads], np.int64)
        return out

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                texts = texts_of(part, text_col)
                n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(id_col), n_bytes, pa.array(count(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([field(docs, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
