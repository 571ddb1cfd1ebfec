"""Conversation repair, source mixing and periodic runs against brute force, and their edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakweave.llm.mixing import mix_sources, pivot, source_targets
from peakweave.llm.periodic import find_runs, periodic_runs
from peakweave.llm.repair import ACCEPTED, AFTER, EMPTY, FINE, GONE, Search, chain, repair_conversations, ways_through

CLASHING = "id string, position string, what string, digest string, first string, block string, rows string, part string, size string, target string, tree string, source_size string, n_runs string"
NOTHING = hashlib.sha256(b"").hexdigest()


# conversation repair


def cheapest(rows):
    """Dijkstra over (edits so far, row, state): cost, then edits, of the cheapest way; rows of (initial, kind, times)."""
    flat = [r for initial, kind, times in rows for r in [(initial, kind)] * times]
    heap, seen = [(0, "", 0, EMPTY)], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(flat) and state in ACCEPTED:
            return cost, edits
        if (i, state) in seen:
            continue
        seen.add((i, state))
        role = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 5, edits + "I", i, role))
        if i < len(flat):
            initial, kind = flat[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state))
            if kind != GONE:
                if initial in AFTER[state]:
                    heapq.heappush(heap, (cost + 5 * kind, edits + "K", i + 1, AFTER[state][initial]))
                heapq.heappush(heap, (cost + 1 + 5 * kind, edits + "R", i + 1, role))
    raise AssertionError


some_rows = st.lists(
    st.one_of(st.tuples(st.sampled_from("sua t"), st.sampled_from([0, 0, 0, 1]), st.just(1)), st.tuples(st.just(""), st.just(GONE), st.integers(1, 3))), max_size=12,
)


@settings(max_examples=300, deadline=None)
@given(some_rows)
def test_search_finds_the_cheapest_and_least_edits(rows):
    assert Search(rows, ACCEPTED, True).path(EMPTY) == cheapest(rows)


@settings(max_examples=300, deadline=None)
@given(some_rows, st.lists(st.integers(0, 12), max_size=4))
def test_blocks_chain_to_the_same_edits(rows, cuts):
    cuts = sorted({0, len(rows), *(min(c, len(rows)) for c in cuts)})
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for known in (False, True):  # whether the blocks know that they hold the beginning and the end
        blocks = [ways_through(p, known and k == 0, known and k == len(parts) - 1) for k, p in enumerate(parts)]
        cost, pieces = chain(blocks)
        assert (cost, "".join(e for _, e in pieces)) == cheapest(rows)


def test_long_block_ends_soon():
    rng = random.Random(5)
    rows = [(rng.choice("sua"), rng.choice([FINE, FINE, 1]), 1) for _ in range(128)]
    assert Search(rows, ACCEPTED, True).path(EMPTY) == cheapest(rows)
    ways = ways_through(rows, False, False)
    # nothing leads back to the beginning's states, and from a beginning every later state can be reached
    assert {(s, e) for s, e, *_ in ways} >= {(s, e) for s in range(4) for e in (2, 3)} and not any(e < s for s, e, *_ in ways if e < 2)


def literal(rows):
    """The whole operator, one conversation at a time, from rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, own in by.items():
        own.sort()
        faults, kinds, seen = Counter(), [], set()
        for _, _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kinds.append((role[:1], {"": 0, "truncated": 1}.get(fault, GONE), 1))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = [t for dated, t, *_ in own if dated]
        cost, audit = cheapest(kinds)
        state, lines, i = EMPTY, [], 0
        for e in audit:
            new = 3 if state == 2 else 2
            if e == "I":
                state = new
                lines.append({2: "user", 3: "assistant"}[new] + ":")
                continue
            role, text = own[i][2:]
            if e == "K":
                state = AFTER[state][role[:1]]
                lines.append(f"{role}:{text}")
            elif e == "R":
                state = new
                lines.append({2: "user", 3: "assistant"}[new] + ":" + text)
            i += 1
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("c") for c in CLASHING.replace(" string", "").split(", ")}).repartition(5)


def random_conversations(rng, n, long):
    rows = []
    for conv in [*range(n), None]:
        size = long if conv == 0 else rng.randrange(1, 14)
        for turn in range(size):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool", "User"])
            text = rng.choice([f"Text {rng.randrange(6)}.", f"Cut {rng.randrange(9)}", "", " \n", None, "Ok! ", "日本。", "Why?\t"])
            at = rng.choice([turn, turn, turn, turn + 2, None])
            rows += [(conv, at, role, text)] * rng.choice([1, 1, 1, 2, 3])
    return rows


@pytest.mark.parametrize("bits", [1, 3, 7])
def test_repair_equals_the_literal_version(spark, bits):
    rows = random_conversations(random.Random(bits), 25, 90)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(conversations(spark, rows), block_bits=bits).collect()}
    assert got == literal(rows)


def test_repair_after_damage(spark):
    rows = [r for r in random_conversations(random.Random(9), 120, 40) if r[0] is None or r[1] is not None]
    want = {conv: (0,) * 6 + ("", NOTHING) for conv, *_ in rows} | literal(harm(rows))
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(conversations(spark, rows), damage=True).collect()}
    assert got == want and any(w[-1] == NOTHING and not w[6] for w in want.values())


def test_repair_text_long_and_empty(spark):
    long = "x" * 300_000 + "."
    df = conversations(spark, [(1, 0, "user", long), (1, 5, "assistant", "Yes."), (2, 2**62, "user", "a."), (2, -(2**62), "user", "b.")])
    got = {r.conv_id: r for r in repair_conversations(df, with_text=True).collect()}
    assert got[1].repaired == f"user:{long}\nassistant:Yes." and got[1].gaps == 4 and got[1].audit == "KK"
    assert got[2].gaps == 2**63 - 1 and got[2].audit == "KR" and got[2].repaired == "user:b.\nassistant:a."
    assert repair_conversations(df.limit(0)).collect() == []


# mixing


def water(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above, as the rule says it."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: 2 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("c") for c in CLASHING.replace(" string", "").split(", ")}).repartition(7)


def mixed_rows(rng, n=3000):
    names = ["hot", "a", "B", "é", None, "", "z", "tiny"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else names[min(int(rng.expovariate(0.5)), 7)]
        words = 0 if rng.random() < 0.05 else int(rng.paretovariate(1.1))
        rows.append((i, rng.choice([None, "", "  "]) if not words else " ".join(["w"] * min(words, 3000)), source))
    return rows + [rows[5]] * 3000 + [(None, "a b c", "hot")] * 5 + [(7, "x y", "B")] * 2


def test_mix_meets_its_targets(spark):
    rows = mixed_rows(random.Random(3))
    got = mix_sources(documents(spark, rows)).withColumn("source", F.lit(None)).collect()
    size_of = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    target = water(dict(sizes))
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((i, size_of(t), sizes[s]) for i, t, s in rows)
    taken, wanted = defaultdict(int), {}
    for r in got:
        taken[r.source_size] += r.taken
        wanted[r.source_size] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert {round(v, 6) for v in wanted.values()} == {round(target[s], 6) for s in sizes}
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)
    # whole copies but for one document of a source, and none further than one copy from its share
    cut = Counter(r.source_size for r in got if r["size"] and r.taken % r["size"])
    assert max(cut.values(), default=0) <= 1
    assert all(abs(r.taken - r["size"] * r.target / max(r.source_size, 1)) < r["size"] + 1e-6 for r in got if r["size"])


def test_mix_reruns_agree_and_seeds_differ(spark):
    df = documents(spark, mixed_rows(random.Random(4), 2000))
    told = lambda d, **kw: sorted(((r.doc_id is None, r.doc_id or 0, r["size"], r.taken) for r in mix_sources(d, **kw).collect()))
    once = told(df)
    assert once == told(df.repartition(3)) == told(df.orderBy(F.desc("text")))
    assert once != told(df, seed=12)


def test_mix_keeps_expectations(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    runs = [mix_sources(df, seed=s, whole_copies=True).collect() for s in range(12)]
    for own in ("a", "b"):
        share = {r.target / r.source_size for r in runs[0] if (r.doc_id % 2 == 0) == (own == "a")}
        assert len(share) == 1
        mean = np.mean([[r.copies for r in run if (r.doc_id % 2 == 0) == (own == "a")] for run in runs])
        assert abs(mean - share.pop()) < 0.12


@settings(max_examples=200, deadline=None)
@given(st.floats(0.01, 0.99), st.integers(1, 5000), st.floats(0.01, 0.99), st.integers(1, 5000), st.floats(0, 0.999))
def test_pivot_keeps_words_and_settles_one(a, m, b, n, u):
    x, y = pivot(a, m, b, n, u)
    assert abs(x * m + y * n - a * m - b * n) < 1e-4 and min(x % 1, y % 1) == 0 and 0 <= min(x, y) and max(x, y) <= 1


def test_targets_of_many_sources_and_empty_tables(spark):
    sizes = {f"s{i:04d}": (i * 37) % 101 for i in range(700)} | {None: 11}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert mix_sources(documents(spark, [(1, "", "a"), (2, None, None)])).select("size", "target", "taken").distinct().collect() == [(0, 0.0, 0)]
    assert mix_sources(documents(spark, [(1, "a", "a")]).limit(0)).collect() == []


# periodic runs


def runs_of(w, least=6, times=4):
    """Every stretch of every period, by definition."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            b = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > b and i + p - b >= max(least, times * p):
                out.setdefault((b, i + p), p)  # the smallest period of a stretch comes first
            i += 1
    return sorted(((b, e, p) for (b, e), p in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n = rng.randrange(0, 200)
    w = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(rng.randrange(5)):
        if n:
            a = rng.randrange(n)
            b = rng.randrange(a, n) + 1
            q = max(1, (b - a) // rng.randrange(1, 12))
            base = [rng.randrange(2) for _ in range(q)] if rng.random() < 0.5 else w[a : a + q]
            w[a:b] = [base[i % q] for i in range(b - a)]
    return w


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False))
def test_find_runs_equals_the_definition(rng):
    docs = [some_words(rng) for _ in range(rng.randrange(1, 4))]
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    got = [tuple(r) for r in find_runs(np.array(sum(docs, []), np.int64), bounds).tolist()]
    assert got == [(b + int(o), e + int(o), p) for d, o in zip(docs, bounds, strict=False) for b, e, p in runs_of(d)]


def expected(doc, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    own = [(b, e - b, p) for b, e, p in runs_of(w)]
    gone = {i for s, length, p in own for i in range(s + p, s + length)}
    best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join("%d,%d,%d\n" % r for r in own)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs_of_texts(spark, plant):
    rng = random.Random(8)
    texts = [None, "", " ", "\n\t", "a", "a " * 7, "x y " * 2000, "one\xa0word", "ab ab\x1cab", "é é é é é é", " ".join("abcdef")]
    texts += [rng.choice([" ", "\n", " \t "]).join(f"w{c}" for c in some_words(rng)) for _ in range(80)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "b " * 9, "s")] * 3 + [(None, "q " * 20, "s")] * 2
    got = periodic_runs(documents(spark, rows), plant=plant).drop("n_words").collect()
    assert Counter(map(tuple, got)) == Counter(expected(i, t, plant) for i, t, _ in rows)


def test_long_text_and_empty_table(spark):
    base = [f"w{i % 997}x{i % 89}" for i in range(40_000)]
    text = " ".join(base + base[:15_000] + base[15_000 - 1000 : 15_000] * 9 + ["tail"] * 50)
    df = documents(spark, [(1, text, "s"), (2, "short", "s")])
    got = {r.doc_id: r for r in periodic_runs(df, with_text=True).collect()}
    assert [(r.length, r.period) for r in got[1].runs] == [(10_000, 1000), (50, 1)] and len(got[1].collapsed.split()) == 55_000 + 1
    assert got[2].n_runs == 0 and got[2].collapsed == "short" and got[2].start is None
    assert periodic_runs(df.limit(0)).collect() == []
