"""Operators on vectors, urls and web pages against brute force; the pipeline; registration."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from peakweave.llm import near_vectors as nv  # noqa: E402
from peakweave.llm.html_extract import extract_text, main_text  # noqa: E402
from peakweave.llm.queries import QUERIES, SQL, URL_RULES  # noqa: E402
from peakweave.llm.url_filter import host_reputation, judged_urls  # noqa: E402
from tests.llm.test_text_ops import CLASHING, components, near_brute, words  # noqa: E402

EXTRA = ", ".join(f"{c} string" for c in CLASHING if c not in ("label", "host"))


def vectors(spark, rows):
    tail = ["c"] * len(EXTRA.split(", "))
    return spark.createDataFrame([(*r, *tail) for r in rows], f"vec_id long, embedding array<float>, label int, {EXTRA}").repartition(4)


def vector_brute(rows):
    usable = {}
    for i, (_, x, label) in enumerate(rows):
        if label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            usable[i] = np.array(x, np.float32).astype(float)
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(i, j) for i in usable for j in usable if j < i and rows[i][2] == rows[j][2] and len(usable[i]) == len(usable[j]) and cosine(usable[i], usable[j]) >= 0.93]
    degree, part = Counter(x for link in links for x in link), components(len(rows), links)
    return {i: (degree[i], part[i], part[i] == i) for i in range(len(rows))}


def test_near_vectors_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 16)
    monkeypatch.setattr(nv.math, "isqrt", lambda n: 16 * 9)  # nine cells
    rng = np.random.default_rng(3)
    data = [[0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e-3] * 8, [1e3] * 8]
    for _ in range(30):
        base = rng.normal(size=8)
        data += [(base + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.35])).tolist() for _ in range(rng.integers(1, 9))]
    data += [data[20]] * 20 + [(-np.array(data[21])).tolist()]
    rows = [(i, x, None if i == 30 else int(i % 2)) for i, x in enumerate(data)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nv.near_vectors(vectors(spark, rows)).collect()}
    assert got == vector_brute(rows)


def test_near_vectors_null_and_repeated_ids_and_empty_table(spark):
    rows = [(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in nv.near_vectors(vectors(spark, rows)).collect())
    assert got == Counter({(3, 2, 3, True): 2, (None, 2, 3, False): 1, (None, 0, None, True): 1})
    assert nv.near_vectors(vectors(spark, rows).limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.0, 1.5))
def test_caps_and_forest_agree_with_products(seed, spread):
    rng = np.random.default_rng(seed)
    a, b = (nv.unit(rng.normal(size=6) + spread * rng.normal(size=(9, 6))) for _ in range(2))
    mask = nv.linked(a, b, 0.93)
    assert (mask == (a @ b.T >= 0.93)).all()
    edges = nv.forest(mask)
    full = [(r, 9 + c) for r, c in zip(*np.nonzero(mask), strict=True)]
    assert components(18, [(r, 9 + c) for r, c in edges]) == components(18, full) and len(edges) < 18


# urls


def urls(spark, values):
    tail = ["c"] * len(EXTRA.split(", "))
    return spark.createDataFrame([(i, u, *tail) for i, u in enumerate(values)], f"page_id long, url string, {EXTRA}").repartition(3)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:end], rest[end:]
    return host.translate({c: c + 32 for c in range(65, 91)}), path.split("?")[0].split("#")[0]


def test_rules_and_parts_equal_brute_force(spark):
    values = [
        None, "", "no scheme", "http://", "HTTP://ExAmple.ORG/es/x", "https://a.example.org/en/1?q#f", "http://example.org/en/2", "http://notexample.org", "http://x.org?a=/es/", "x://b.com/de/#/fr/",
        "http://b.com/fr/a://c", "ftp://É.com/DE/", "a\nb://c.net/x\ny?z", "http://com/de/", "http://" + "l" * 9000 + ".org/" + "p" * 90000,
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged_urls(urls(spark, values), URL_RULES).collect()}
    assert len(got) == len(values)
    for i, url in enumerate(values):
        host, path = url_parts(url)
        fits = [(h + p, said) for said, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i][:2] == (host, path)
        assert got[i][2] == (max(fits, key=lambda f: len(f[0]))[0] if fits else None)
        if fits:
            assert got[i][3] == max(fits, key=lambda f: len(f[0]))[1]


def test_reputation_shrinks_towards_domain_and_suffix(spark):
    rows = [("a.bad.com", True)] * 40 + [("b.bad.com", True)] * 30 + [("a.good.com", False)] * 60 + [("c.bad.com", None)] + [("d.good.com", None)] + [("x.other.net", None), (None, None)]
    got = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["a.bad.com"].mean > got["c.bad.com"].mean > 0.5 > got["d.good.com"].mean > got["a.good.com"].mean
    assert 0.3 < got["x.other.net"].mean < 0.8 and got["x.other.net"].deviation > got["a.bad.com"].deviation
    assert got[""].labelled == 0
    nothing = host_reputation(spark.createDataFrame([("a.b", None)], "host string, bad boolean")).collect()
    assert nothing[0].mean == 0.5
    assert host_reputation(spark.createDataFrame([], "host string, bad boolean")).count() == 0


def test_unruled_pages_follow_their_host(spark):
    values = [f"http://bad.com/de/{i}" for i in range(30)] + ["http://bad.com/en/1"] + [f"http://fine.com/fr/{i}" for i in range(30)] + ["http://fine.com/en/1", "http://new.net/"]
    got = {r.page_id: r.verdict for r in judged_urls(urls(spark, values), URL_RULES).collect()}
    assert got[30] == "block" and got[61] == "allow" and got[62] == "allow"
    assert judged_urls(urls(spark, []).limit(0), URL_RULES).count() == 0


# pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain <3 text &amp; more", "plain <3 text & more"),
        ("<article><h1>A &eacute;</h1><p>one <b>two</b>three<p>four &nbsp; five<ul><li>a<li>b</ul></article>tail", "A é one twothree four five a b"),
        ("<header>H</header><nav>N</nav><main><p>x</p><aside>S</aside><form>F</form></main><footer>F</footer>", "x"),
        ("<body class='single comments-open'><div id=cookie-notice>C</div><article>text<div role=banner>AD</div> more</article></body>", "text more"),
        ("<p title=\"a'>b\">q <a href='x>y'>r</a> < s <", "q r < s <"), ("<article>a<p>b<div>c</b></article></article>d", "a b c"),
        ("<article><script>if (a<b) '</article>'</script><p title='a>b'>y</p><!-- <p>z</p> --><style>p{}</style></article>", "y"),
        ("<article><p>cut off &amp", "cut off &"), ("<div hidden>h</div><div aria-hidden='true'>i</div><p style='display: none'>j</p><p>k</p>", "k"),
        ("<p>a</p></div></p><p>b<br>c<hr/>d", "a b c d"),
    ],
)
def test_main_text(page, text):
    assert main_text(page, None) == text


@pytest.mark.parametrize("inside", ["<div class='search-results-summary'>own text</div>", "<section id='related-work'>own text</section>", "<p class='header'>own text</p>", "<span class='skip-link-note'>own text</span>"])
def test_class_words_of_one_page_take_nothing(spark, inside):
    rng = random.Random(21)
    rows = [(i, f"http://one.net/{i}", f"<body><div class=ad>{words(4, rng)}</div><article><p>{words(30, rng)}</p></article></body>") for i in range(20)]
    rows.append((99, "http://one.net/own", f"<body><div class=ad>x y</div><article><p>first</p>{inside}<p>last</p></article></body>"))
    got = extracted(spark, rows)
    assert got[99] == "first own text last" and main_text(f"<article>{inside}</article>", None) == "own text"
    # the advert's place is the same on all pages, so it goes, though no two have the same text
    assert all(got[i] == re.search("<p>(.*)</p>", html)[1] for i, _, html in rows[:20])


def test_comments_go_where_the_site_has_them_in_one_place(spark):
    rng = random.Random(22)
    page = "<html><body><article><h1>{}</h1><p>{}</p><div class='user-comments c{}' id=comments-{}><p>{}</p><p>{}</p></div></article></body></html>"
    rows = [(i, f"http://talk.net/{i}", page.format(words(3, rng), words(30, rng), i, i, words(5, rng), words(6, rng))) for i in range(12)]
    got = extracted(spark, rows)
    assert all(got[i] == " ".join(re.findall("<(?:h1|p)>(.*?)</", html)[:2]) for i, _, html in rows)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<p>x " + '<a "' * 250_000, "<div>" * 20_000 + "</span>" * 20_000, "<p>" + "<b>" * 20_000 + "<hr>" * 20_000, "<div class=ad>" * 20_000, "<script>" * 100_000, "<!-- " * 200_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page, frozenset())
    assert time.perf_counter() - began < 2


def deduced(pages):
    """Text of each page of one host, by occurrence vectors written out: pages are lists of (element path, text or None), an element's start having no text."""
    vector = defaultdict(lambda: [0] * len(pages))
    for k, page in enumerate(pages):
        for token in page:
            vector[token][k] += 1
    classes = defaultdict(list)
    for token, counts in vector.items():
        if sum(c > 0 for c in counts) >= 8:
            classes[tuple(counts)].append(token)
    template = set()
    for counts, tokens in classes.items():
        texts = [t for t in tokens if t[1] is not None]
        on = [k for k, c in enumerate(counts) if c]
        nested = all([k for k, c in enumerate(vector[path, None]) if c] == on for path, _ in texts)
        said = sum(len(text) * sum(counts) for _, text in texts)
        every = sum(len(text) for k in on for _, text in pages[k] if text is not None)
        if len(tokens) > 1 and texts and nested and said <= 0.9 * every:
            template.update(texts)
    return [" ".join(text for path, text in page if text is not None and (path, text) not in template) for page in pages]


def test_templates_equal_a_deduction_written_out(spark):
    rng = random.Random(23)
    common = [words(4, rng) for _ in range(4)]
    pages_of, rows = [], []
    for i in range(40):
        tokens, html, parts = [("html", None), ("html/body", None)], "", []

        def put(name, text, tokens=tokens, parts=parts):
            tokens.extend([(f"html/body/{name}", None), (f"html/body/{name}", text)])
            parts.append(f"<{name}>{text}</{name}>")

        put("h1", words(5, rng))
        put("p", common[0])
        put("h2", common[1] if i % 4 else words(3, rng))
        if i % 2:
            put("h3", common[2])
        if i < 5:
            put("h4", common[3])
        put("div", words(30, rng))
        put("dl", common[0] if i % 3 else common[1])
        html = "<html><body>" + "".join(parts) + "</body></html>"
        pages_of.append(tokens)
        rows.append((i, f"http://small.net/{i}", html))
    got = extracted(spark, rows)
    want = deduced(pages_of)
    assert [got[i] for i in range(40)] == want
    assert any(common[2] in text for text in (h for *_, h in rows)) and not any(common[2] in t for t in want) and any(common[3] in t for t in want)


def pages(spark, rows):
    tail = ["c"] * len(EXTRA.split(", "))
    return spark.createDataFrame([(*r, *tail) for r in rows], f"page_id long, url string, html string, {EXTRA}").repartition(3)


def test_template_text_goes_where_no_article_is_marked(spark):
    rng = random.Random(1)
    body = [words(rng.randrange(5, 30), rng) for _ in range(12)]
    rows = [(i, f"http://t.net/{i}", f"<div><p>Same line</p><div>{b}</div><p>Bye</p></div>") for i, b in enumerate(body)]
    rows += [(20, "http://few.net/1", "<p>Same line</p><p>u</p>"), (21, "http://few.net/2", "<p>Same line</p><p>v</p>"), (22, None, None), (22, "x", ""), (None, None, "<p>w" + " long" * 50_000)]
    got = Counter((r.page_id, r.text) for r in extract_text(pages(spark, rows)).collect())
    want = Counter({**{(i, b): 1 for i, b in enumerate(body)}, (20, "Same line u"): 1, (21, "Same line v"): 1, (22, ""): 2, (None, "w" + " long" * 50_000): 1})
    assert got == want
    assert extract_text(pages(spark, []).limit(0)).count() == 0


def extracted(spark, rows):
    return {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()}


def test_template_inside_articles_goes_and_teaser_cards_do_not_replace_the_text(spark):
    rng = random.Random(4)
    body = [words(rng.randrange(60, 90), rng) for _ in range(20)]
    rows = [(i, f"http://a.net/{i}", f"<article><p>{b}</p>{'<div class=cta-box><p>Get our paper</p><p>Now</p></div>' if i % 2 else ''}<p>end{i}</p></article>") for i, b in enumerate(body)]
    rows += [(100 + i, f"http://cards.net/{i}", f"<article>Card {i}</article><div><p>{b}</p></div><article>Card b{i}</article>") for i, b in enumerate(body)]
    got = extracted(spark, rows)
    assert all(got[i] == f"{b} end{i}" and got[100 + i] == f"Card {i} {b} Card b{i}" for i, b in enumerate(body))


def test_classes_of_part_of_the_pages_with_attributes_that_vary(spark):
    rng = random.Random(5)
    body = [words(rng.randrange(20, 40), rng) for _ in range(30)]
    page = "<html lang=l{0}><body class='postid-{0}'><p>Top line</p><div class=note-x>{2}</div><div id=t{0}><p>{1}</p></div></body></html>"
    rows = [(i, f"http://v.net/{i}", page.format(i, b, "Seasonal" if i % 3 else "Other")) for i, b in enumerate(body)]
    part = "<html lang=l{0}><body class='postid-{0}'><p>Top line</p>{2}<div><p>{1}</p></div></body></html>"
    rows += [(100 + i, f"http://w.net/{i}", part.format(i, b, "<div class=note-x>Seasonal</div>" if i % 3 else "")) for i, b in enumerate(body)]
    rows += [(200, "http://w.net/null", None), (201, "http://w.net/empty", ""), *((300 + i, f"http://h{i}.small.org/", part.format(i, b, "")) for i, b in enumerate(body))]
    got = extracted(spark, rows)
    assert all(got[i] == f"{'Seasonal' if i % 3 else 'Other'} {b}" for i, b in enumerate(body))  # a slot with two values is no template
    assert all(got[100 + i] == b and got[300 + i] == b for i, b in enumerate(body)) and got[200] == got[201] == ""


def test_copies_are_not_template(spark):
    rng = random.Random(6)
    copied, near, title = words(80, rng), words(40, rng), words(5, rng)
    rows = [(i, f"http://c.net/{i}", f"<article><h1>T</h1><p>{copied}</p></article>") for i in range(12)]
    rows += [(100 + i, f"http://n.net/{i}", f"<article><h1>{title if i < 15 else i}</h1><p>{near if i < 15 else words(20, rng)}</p><p>own {i}</p></article>") for i in range(30)]
    got = extracted(spark, rows)
    assert all(got[i] == f"T {copied}" for i in range(12)) and all(got[100 + i] == f"{title} {near} own {i}" for i in range(15))


def test_a_host_of_thousands_of_uniform_pages(spark):
    rows = [(i, f"http://hot.net/{i}", f"<html><body><p>Same line</p><div>number {i} of the pages</div><p>Bye</p></body></html>") for i in range(3000)]
    assert extracted(spark, rows) == {i: f"number {i} of the pages" for i in range(3000)}


# pipeline and registration


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(12)
    good = [" ".join(words(12, rng, 5000) for _ in range(6)).capitalize() + "." for _ in range(60)]
    junk = [" ".join(f"{w}{rng.choice(['***', '###'])}" for w in words(40, rng).split()) for _ in range(40)]
    near = good[0].split()
    near[3] = "changed"
    texts = [*good, *junk, good[5].upper(), " ".join(near), good[7] + " password=abcdef123456abcdef", None, ""]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns
            kept[name] = {r.doc_id: r.text for r in at.collect()}
    first = kept["quality classifier"]
    assert sum(i in first for i in range(60)) >= 59 and not any(60 <= i < 100 for i in first)
    second = kept["exact dedup"]
    assert 5 not in second and 100 in second
    third = kept["MinHash near-dedup"]
    order = sorted(second)
    want = near_brute([second[i] for i in order])
    assert set(third) == {order[k] for k, (_, _, keep) in want.items() if keep}
    assert not any("abcdef123456" in (t or "") for t in kept["secret scans"].values()) and set(kept["secret scans"]) == set(third)
    assert {r.doc_id for r in at.collect()} == set(third)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


@pytest.mark.parametrize("stored", [False, True])
def test_stages_choose_rows_not_ids(spark, tmp_path, stored):
    rng = random.Random(13)
    a, b = (words(40, rng) for _ in range(2))
    near = a.split()
    near[-1] = "other"
    rows = [(1, a), (1, a), (2, a.upper()), (None, b), (None, b), (None, "own text"), (3, b), (4, None), (4, "x y"), (4, "x y"), (5, " ".join(near)), (1, " ".join(near))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    if stored:
        docs.write.parquet(f"{tmp_path}/docs.parquet")
        docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
    told = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    second = corpus_pipeline.drop_copies(spark, docs, "")
    assert second.columns == docs.columns
    assert told(second) == Counter([(2, a.upper()), (3, b), (None, "own text"), (4, None), (4, "x y"), (5, " ".join(near))])
    third = told(corpus_pipeline.drop_near_copies(spark, docs, ""))
    # of the component of a and its near copies one row of id 1 stays, of the two rows (4, x y) one, of b the named one
    assert sum(third.values()) == 5 and sum(n for (i, _), n in third.items() if i == 1) == 1
    assert third - Counter([(1, a), (1, " ".join(near))]) == Counter([(3, b), (None, "own text"), (4, None), (4, "x y")])


def test_quality_stage_judges_each_row_by_its_text(spark, tmp_path):
    rng = random.Random(14)
    good = [" ".join(words(12, rng, 5000) for _ in range(6)).capitalize() + "." for _ in range(40)]
    junk = [" ".join(f"{w}{rng.choice(['***', '###'])}" for w in words(40, rng).split()) for _ in range(40)]
    rows = [*enumerate(good + junk), (None, good[0]), (None, junk[0]), (3, junk[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect())
    assert kept[None, good[0]] == kept[3, good[3]] == 1 and not kept[None, junk[0]] and not kept[3, junk[1]]


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(SQL) <= set(QUERIES) <= set(entry.queries())
