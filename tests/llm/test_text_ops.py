"""Operators on texts against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from peakweave.llm.byte_bpe import PrefixTable, codec, decode_documents, encode_documents, round_trip_digests  # noqa: E402
from peakweave.llm.components import connected_components  # noqa: E402
from peakweave.llm.exact import exact_duplicates  # noqa: E402
from peakweave.llm.near_text import CHUNK, CHUNKS, GUARANTEED, POSITIONS, WIDE, chunk_keys, close_pairs, near_duplicates, odd_buckets  # noqa: E402
from peakweave.llm.packing import hilbert_key, pack_documents  # noqa: E402
from peakweave.llm.quality import fit, fit_quality, line_features, marginals, score_quality  # noqa: E402
from peakweave.llm.queries import QUERIES  # noqa: E402
from peakweave.llm.secrets import find_secrets, joined, redact_secrets  # noqa: E402
from peakweave.llm.token_counts import token_counts  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: every operator must take columns of these names along, or leave them, without a clash
CLASHING = ["id", "n", "node", "key", "keys", "length", "digest", "mark", "live", "asks", "host", "x", "rep", "label", "component", "score", "place", "ids", "stretch", "base"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
ODD = [
    None, "", " ", "\n\n", "a", "A", "Word word WORD", "x " * 40_000, "token = 0123456789abcdef0", "two  spaces \n and\ttab ", "<|endoftext|> in text",
    "naïve été ÀÉ ſ ŉ", "日本語 テキスト", "😀 ok", "é", "a\x00b", "1234567 89", "It's we'll THEY'RE", "\xa0 nbsp  ", "a" * 5000, "_under_score__",
]


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", None, *["c"] * len(CLASHING)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def words(n, rng, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# exact duplicates


def test_exact_duplicates_equals_brute_force(spark):
    texts = [*ODD, *ODD[3:9], "same", "SAME", "Same", "ÀB", "àb", None] + ["p" * 300 + t for t in ("x", "y", "X")]
    got = {r.doc_id: tuple(r)[1:] for r in exact_duplicates(table(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").encode().lower()].append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_duplicates_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c"), (2, "d"), (3, "D")], "doc_id long, text string")
    got = Counter(tuple(r) for r in exact_duplicates(df).collect())
    assert got == Counter({(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, None, 1, True): 1, (2, 2, 1, True): 1, (2, 3, 2, False): 1, (3, 3, 2, True): 1})


def test_every_row_has_its_own_digest(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, "A"), (None, "z"), (3, "q"), (None, None), (3, "long " * 300), (3, "long " * 300 + "end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op4_exact_dedup"](spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha256((t or "").lower().encode()).hexdigest()
    alone = [(i, i, 1, True, sha(t)) for i, t in rows[3:]]
    assert got == Counter([(1, 2, 3, False, sha("a"))] * 2 + [(2, 2, 3, True, sha("a")), *alone])


# near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_brute(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    part = components(len(texts), links)
    return {i: (len(sets[i]), part[i], i == part[i]) for i in range(len(texts))}


def test_near_duplicates_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [t for t in ODD if t is None or len(t) < 2000]
    for _ in range(25):
        base = words(rng.choice([4, 12, 60, 200]), rng).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            edited = list(base)
            for _ in range(rng.randrange(1, 3 + len(base) // 20)):
                edited[rng.randrange(len(edited))] = f"w{rng.randrange(400)}"
            texts.append(rng.choice([" ".join(edited), "\n".join(edited).upper(), " ".join(base)]))
    passage = words(60, rng)
    texts += [words(15, rng) + " " + passage + " " + words(15, rng) for _ in range(30)]
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(table(spark, texts)).collect()}
    assert got == near_brute(texts)


def test_a_group_of_near_copies_and_a_crowded_passage_lose_no_link(spark, monkeypatch):
    from peakweave.llm import near_text

    monkeypatch.setattr(near_text, "BLOCK", 16)
    rng = random.Random(8)
    base = words(80, rng).split()
    texts = []
    for _ in range(80):
        edited = list(base)
        for _ in range(rng.randrange(4)):
            edited[rng.randrange(len(edited))] = f"w{rng.randrange(400)}"
        texts.append(" ".join(edited))
    passage = words(100, rng)
    texts += [words(rng.choice([20, 60]), rng) + " " + passage for _ in range(60)]
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(table(spark, texts)).collect()}
    assert got == near_brute(texts)


def test_near_duplicates_null_and_repeated_ids(spark):
    long = words(30, random.Random(1))
    df = spark.createDataFrame([(4, long), (4, long), (None, long), (4, "other text"), (None, "alone here"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == Counter({(4, 4, True): 3, (None, 4, False): 1, (None, None, True): 2})


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, GUARANTEED))
def test_signatures_within_the_threshold_share_a_key(seed, errors):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 16, POSITIONS)
    b = a.copy()
    b[rng.permutation(POSITIONS)[:errors]] ^= 1
    keys = chunk_keys(np.stack((a, b)))
    assert set(keys[0]) & set(keys[1])
    assert keys.shape[1] == CHUNKS * CHUNK


@pytest.mark.parametrize("errors", [0, GUARANTEED, GUARANTEED + 1, 30])
def test_pairs_within_the_guarantee_are_compared_whatever_the_longer_signature(errors):
    a = np.arange(POSITIONS, dtype=np.uint16)
    b = a.copy()
    b[[i * 7 % POSITIONS for i in range(errors)]] += 1000  # spread over all chunks
    symbols = np.array([a, b])
    shared = np.intersect1d(*chunk_keys(symbols))
    rows = [{"key": k, "group": k, "n": 100, "component": c, "node": c, "block": 0, "crossed": False, "symbols": symbols[c].tobytes(), "wide": bytes([17 * c]) * (WIDE // 2), "odd": bytes(256)}
            for k in shared.tolist() for c in (0, 1)]
    found = sum(len(close_pairs(pa.RecordBatch.from_pylist(rows[i : i + 2]), 75)[0]) for i in range(0, len(rows), 2))
    assert found == (errors <= GUARANTEED)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_sets_differ_in_at_least_as_many_members_as_odd_buckets(a, b):
    bits = [int.from_bytes(odd_buckets(np.array(sorted(x), np.uint64))) for x in (a, b)]
    assert (bits[0] ^ bits[1]).bit_count() <= len(a ^ b) and (bits[0] ^ bits[1]).bit_count() % 2 == len(a ^ b) % 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.integers(1, 60))
def test_runs_are_cut_between_groups_and_paired_within(sizes, most):
    from peakweave.llm.near_text import pairs_of_runs, run_ends, slices_by_pairs

    group = np.repeat(np.arange(len(sizes)) * 7 % 31, sizes)
    parts = slices_by_pairs(pa.RecordBatch.from_arrays([pa.array(group)], ["group"]), most)
    assert sum(p.num_rows for p in parts) == len(group)
    pairs, at = [], 0
    for p in parts:
        own = p.column("group").to_numpy()
        i, j = pairs_of_runs(run_ends(own))
        assert len(i) <= most or len(set(own)) == 1
        pairs += list(zip((i + at).tolist(), (j + at).tolist(), strict=True))
        at += len(own)
    assert sorted(pairs) == [(i, j) for i in range(len(group)) for j in range(i + 1, len(group)) if group[i] == group[j]]


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    want = components(301, links)
    assert {i: want[i] for i in got} == {i: min(k for k in got if got[k] == c) for i, c in got.items()}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert connected_components(df.limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return {p: tokenizers.Tokenizer.from_file(p) for p in (WORD_BPE, BYTE_BPE)}


def mixed_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "ß", "1", "23", ".", "'s", "'LL", "日本", "😀", "é", "\xa0", " the", "ing", "<|endoftext|>", "!!", "\r\n", "AAAA", "İ", "Σ", "_", "ª"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, tokenizer):
    texts = ODD + mixed_texts(600, 1)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(table(spark, texts), BYTE_BPE, sample_rows=50, table_size=100, cache_entries=64).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len((t or "").encode()), len(tokenizer[BYTE_BPE].encode(t or "", add_special_tokens=False).ids)), t


def test_byte_bpe_equals_the_library_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + mixed_texts(600, 2)
    df = table(spark, texts)
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    coded = encode_documents(df, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == want
    assert {r.doc_id: bytes(r.data).decode() for r in decode_documents(coded, RANKS, public_tokenizers.PATTERN).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect():
        raw = np.array(want[r.doc_id], "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.integers(0, 40), st.integers(0, 40))
def test_prefix_table_appends_and_edits_exactly(data, more, start, end):
    ranks = codec(RANKS, public_tokenizers.PATTERN).ranks
    merged = lambda raw: [ranks.rank[p] for p in ranks.merged(raw)]
    one = PrefixTable(ranks, data)
    assert one.tokens() == merged(data)
    one.append(more)
    assert one.tokens() == merged(data + more)
    start, end = sorted((min(start, len(data)), min(end, len(data))))
    one.replace(start, end, more)
    assert one.tokens() == merged(data[:start] + more + (data + more)[end:])


def test_pieces_in_bulk_equal_merging():
    coder, rng = codec(RANKS, public_tokenizers.PATTERN), random.Random(9)
    pieces = [bytes(rng.choice(b"abcdefghino rst\xc3\xa9") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    ids, sizes = coder.many.encode(pieces)
    want = [[coder.ranks.rank[p] for p in coder.ranks.merged(piece)] for piece in pieces]
    assert ids.tolist() == [t for w in want for t in w] and sizes.tolist() == list(map(len, want))


# packing


def check_packing(rows, texts, tokenizer, length=4096):
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        assert sum(n for _, n in parts) == len(want[i]) and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False))
    sizes = []
    for _, parts in sorted(sequences.items()):
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(n == length for n in sizes[:-1]) and 0 < sizes[-1] <= length


def test_packing_keeps_every_id_once(spark, tokenizer):
    rng = random.Random(4)
    texts = ODD + mixed_texts(200, 3) + [words(rng.randrange(1, 900), rng) for _ in range(60)] + ["same words again"] * 80
    check_packing(pack_documents(table(spark, texts), WORD_BPE, sample_rows=30).collect(), texts, tokenizer[WORD_BPE])


def test_packing_puts_alike_documents_together(spark):
    # two vocabularies, dealt in turn: neighbours along the curve should mostly share theirs
    rng = random.Random(6)
    sides = [[f"{c}{rng.randrange(900)}" for _ in range(12)] for c in "kq"]
    texts = [" ".join(rng.choices(sides[i % 2], k=120)) for i in range(200)]
    rows = sorted(pack_documents(table(spark, texts), WORD_BPE).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [r.doc_id % 2 for r in rows if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) < 40


def test_packing_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (3, "c"), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.length) for r in pack_documents(df, WORD_BPE).collect()) == [(-1, 1), (-1, 3), (3, 2), (3, 2)]


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


# quality


def sample_texts(rng, n):
    good = [f"{words(rng.randrange(5, 12), rng).capitalize()}." for _ in range(n)]
    junk = [" ".join(f"{w}{rng.choice(['***', '###', '&&&'])}" for w in words(8, rng).split()) for _ in range(n)]
    texts, labels = [], []
    for i in range(n):
        label = i % 3 > 0
        lines = rng.choices(good if label else junk, k=rng.randrange(1, 7))
        texts.append("\n".join([rng.choice(good), *lines]))
        labels.append(int(label))
    return texts, labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lines = np.array([1, 4, 3])
    scores, change = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    good, pair, log_z = marginals(scores, change, lines)
    at = 0
    for k, n in enumerate(lines):
        paths = {}
        for code in range(2**n):
            path = [(code >> i) & 1 for i in range(n)]
            paths[tuple(path)] = np.exp(sum(scores[at + i, s] for i, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(paths.values())
        assert np.isclose(log_z[k], np.log(z))
        for i in range(n):
            assert np.isclose(good[at + i], sum(p for path, p in paths.items() if path[i]) / z)
            if i < n - 1:
                assert np.isclose(pair[at + i, 1, 0], sum(p for path, p in paths.items() if path[i : i + 2] == (1, 0)) / z)
        at += n


def test_quality_on_held_out_rows(spark):
    texts, labels = sample_texts(random.Random(7), 900)
    df = table(spark, texts)
    marks = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)] + [(5, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.score for r in score_quality(df, fit_quality(df, marks)).collect()}
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scored[i] >= 0.7) == bool(labels[i]) for i in out) >= 0.97 * len(out)


def test_quality_edge_cases(spark):
    texts, labels = sample_texts(random.Random(7), 90)
    model = fit([t.encode() for t in texts], np.array(labels), rounds=30, passes=1)
    got = {r.doc_id: r.score for r in score_quality(table(spark, [*ODD, "\n" * 3000]), model).collect()}
    assert len(got) == len(ODD) + 1 and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    none = fit_quality(table(spark, texts), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.scores([b"x", b""]).tolist() == [0.5, 0.5]
    features, length, lines = line_features([b"", b"a\nb"])
    assert lines.tolist() == [1, 2] and length.tolist() == [0, 1, 1] and np.isfinite(features).all()


# secrets

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_texts():
    rng = random.Random(2)
    parts = ["password", "PassWd", "token", "Secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKL12", "x", "é😀", "deadbeef", "-", "\n", "short", "  "]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(18))) for _ in range(1500)]


def test_base_spans_equal_brute_force(spark):
    texts = secret_texts()
    got = {r.doc_id: r.spans for r in find_secrets(table(spark, texts)).select("doc_id", joined(F.col("base")).alias("spans")).collect()}
    assert got == {i: base_brute(t) for i, t in enumerate(texts)}


def test_ownership_separates_examples_from_live_secrets(spark):
    example, live = "Ex4mpleEx4mpleEx4mple", "L1veL1veL1veL1veL1veL"
    texts = [f"see {example} here", f"and {example}", f"{example}!", f"mine {live}", None]
    df = table(spark, texts)
    got = {r.doc_id: [s.value for s in r.more] for r in find_secrets(df).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [live], 4: []}
    wide = {r.doc_id: [s.value for s in r.more] for r in find_secrets(df, most_owners=3).collect()}
    assert wide[0] == [example]


def test_redaction_keeps_rows_and_columns(spark):
    texts = [*secret_texts()[:300], "mine L1veL1veL1veL1veL1veL end", "password=abcdefabcdefabcdef1 tail"]
    df = table(spark, texts)
    out = redact_secrets(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == len(texts) and got[0] is None
    assert got[300] == "mine [secret] end" and got[301] == "[secret] tail"
    assert all(got[i] == t for i, t in enumerate(texts[: len(ODD)]) if not base_brute(t))
    assert not any(base_brute(t) for t in got.values())


def owned(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string").repartition(3)


def test_ownership_judges_base_spans_and_keys_of_one_case(spark):
    example, live, upper, lower = "abcdef0123456789abcd", "0123456789abcdef0000", "QWERTYUIOP12ASDFGH", "zxcvbnmasdf12ghjkl"
    df = owned(spark, [(f"{i} token={example} {example}", f"s{i}", "en") for i in range(3)] + [(f"secret: {live}", "s0", "en"), (f"{upper} and {lower}", "s1", "de"), (f"{lower} here", "s2", "de")])
    got = {r.doc_id: r for r in find_secrets(df).collect()}
    assert [s.live for s in got[0].base] == [False] * 3 and len(got[0].base) == 3 and all(s.live for s in got[3].base)
    assert [s.value for s in got[4].more] == [upper] and got[5].more == []
    assert {r.doc_id: r.text for r in redact_secrets(df, keep_examples=True).collect()} == {
        **{i: f"{i} token={example} {example}" for i in range(3)}, 3: "[secret]", 4: f"[secret] and {lower}", 5: f"{lower} here"}
    assert redact_secrets(df).where("doc_id = 0").first().text == "0 [secret] [secret]"


def test_ownership_with_a_hot_source_copies_and_unknown_owners(spark):
    hot, mine, copied, unknown = "H0tH0tH0tH0tH0tH0tH0t", "M1neM1neM1neM1neM1ne", "C0pyC0pyC0pyC0pyC0py", "Unkn0wnUnkn0wnUnkn0wn"
    rows = [(f"{i} {hot}", "big", ("en", "de", "fr")[i % 3]) for i in range(300)] + [(f"{i} {mine}", "big", ("en", "de")[i % 2]) for i in range(4)]
    rows += [(f"a text with {copied}", f"s{i}", "en") for i in range(20)] + [(f"{i} {unknown}", None, "en") for i in range(20)]
    got = {s.value for r in find_secrets(owned(spark, rows)).collect() for s in r.more}
    assert got == {mine, copied}


# all


def test_empty_tables(spark):
    empty = table(spark, []).limit(0)
    pattern = public_tokenizers.PATTERN
    model = fit_quality(empty, spark.createDataFrame([], "doc_id long, quality int"))
    for df in (
        exact_duplicates(empty), near_duplicates(empty), token_counts(empty, BYTE_BPE), encode_documents(empty, RANKS, pattern), round_trip_digests(empty, RANKS, pattern),
        pack_documents(empty, WORD_BPE), score_quality(empty, model), find_secrets(empty), redact_secrets(empty),
    ):
        assert df.count() == 0


def test_large_slices_are_cut_between_rows():
    from peakweave.llm.frames import text_slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"])], ["text"])
    assert [s.num_rows for s in text_slices(batch, "text", 20)] == [2, 1, 2]
