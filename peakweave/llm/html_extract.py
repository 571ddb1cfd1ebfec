"""Main text of web pages: templates deduced from tokens that occur alike across a host's pages, and the slots between them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.frames import field, text_slices, texts_of
from peakweave.llm.url_filter import host_of
from peakweave.session import materialize

# fixed values: names of elements and words of class names, as pages use them
RAW = "script|style|noscript|template|textarea|title|iframe|xmp"
LEFT_OUT = frozenset("head nav header footer aside form button select datalist dialog menu svg canvas object audio video map script style noscript template textarea title iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header footer masthead comment comments commentlist reply replies "
    "respond disqus share sharing social related recommended pagination pager toolbar search skip".split()
)
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN = ("article", "main")

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[A-Za-z]+")
QUOTE_OR_END = re.compile("[\"'>]")
RAW_END = {name: re.compile(rf"(?i)</{name}\s*>") for name in RAW.split("|")}
#: Characters of a quoted value, and of a tag that is looked into.
LONGEST_VALUE, LONGEST_TAG = 4000, 4000
#: In place of the element of a text: the token marks an element that its names call something else than article text.
MARKED = -1


def token_of(text: str, seed: int) -> int:
    """63 bits, so that tokens are not mixed up on hosts of many million blocks."""
    return xxhash.xxh64_intdigest(text, seed) >> 1


def tags(page: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, name) of each tag, the name in lower case, with a slash in front for end tags; comments, declarations and raw elements have no name.

    A tag ends at the first `>` outside of quotes; a quote that does not close soon is none. Behind the last `>` nothing is looked for, so
    each part of a page is read a fixed number of times.
    """
    last, at = page.rfind(">"), page.find("<")
    while 0 <= at < last or at >= 0 and page.startswith("<!--", at):
        if page.startswith("<!--", at):
            end = page.find("-->", at)
            end = len(page) if end < 0 else end + 3
            yield at, end, ""
        else:
            name = NAME.match(page, at)
            if not name and page[at + 1 : at + 2] not in ("!", "?"):
                at = page.find("<", at + 1)
                continue
            end, look = -1, at
            while found := QUOTE_OR_END.search(page, look):
                if found.group() == ">":
                    end = found.end()
                    break
                look = page.find(found.group(), found.end(), found.end() + LONGEST_VALUE) + 1
                if not look:
                    break
            end = end if end > 0 else page.find(">", at) + 1
            named = "" if not name else ("/" if page[at + 1] == "/" else "") + name.group(1).lower()
            if named in RAW_END and (closing := RAW_END[named].search(page, end)):
                yield at, closing.end(), ""
                end = closing.end()
            elif named in RAW_END:
                yield at, len(page), ""
                end = len(page)
            else:
                yield at, end, named
        at = page.find("<", end)


def unseen(name: str, tag: str) -> bool:
    """Whether an element holds no article text by its name or role, or is not shown."""
    if name in LEFT_OUT:
        return True
    if " " not in tag and "\n" not in tag or name in ("html", "body", *MAIN):
        return False
    for key, value in ATTRIBUTE.findall(tag[:LONGEST_TAG]):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in NOT_CONTENT_ROLES or key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def telling_words(name: str, tag: str) -> str:
    """Words of an element's class and id that name something else than article text. They decide nothing alone."""
    if "=" not in tag or name in ("html", "body", *MAIN):
        return ""
    found = {w for key, value in ATTRIBUTE.findall(tag[:LONGEST_TAG]) if key.lower() in ("class", "id") for w in WORD.findall(value.lower()) if w in NOT_CONTENT}
    return " ".join(sorted(found))


class Block:
    """A run of text between block borders: its text, the token of the element it lies in, and whether that is in an article."""

    __slots__ = ("element", "in_main", "text")

    def __init__(self, text: str, element: int, in_main: bool):
        self.text, self.element, self.in_main = text, element, in_main


class Mark:
    """An element whose class or id names something else than article text."""

    __slots__ = ("token",)

    def __init__(self, token: int):
        self.token = token


def kind_of(tag: str) -> str:
    """Words of a start tag's class that no number makes a page's own, in order; other attributes vary too often to tell kinds apart."""
    if "=" not in tag or len(tag) > LONGEST_TAG:
        return ""
    return " ".join(sorted({w for key, value in ATTRIBUTE.findall(tag) if key.lower() == "class" for w in value.strip("\"'").split() if not any(c.isdigit() for c in w)}))


#: Elements that a paragraph outside of them is not closed from.
SCOPE = frozenset("article aside td th li div section blockquote form main body button".split())


def read_page(page: str, template: frozenset[int] = frozenset()) -> Iterator[int | Mark | Block]:
    """Tokens of a page in order: numbers for each block element that starts, marks, and the blocks of text. Elements whose mark is in the template are left out.

    An element's path is made of names only, so that attributes of `html` or `body` do not tell pages apart. An element with a
    class is a token of its path and another of path and class. A mark is a token of path and telling words.
    What lies in elements that are never article text by name or role, or that are not shown, is left out. End tags close what is open
    inside, one that nothing is open for does nothing; a block element ends an open paragraph, a list item the one before it.
    """
    # name, path, element, left out, in an article, depth of the paragraph that a block element would end
    stack: list[tuple[str, int, int, bool, bool, int]] = [("", 0, 0, False, False, 0)]
    is_open: dict[str, int] = {}
    buffer: list[str] = []

    def flush() -> Iterator[Block]:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                yield Block(text, stack[-1][2], stack[-1][4])

    def close(depth: int) -> None:
        for frame in stack[depth:]:
            is_open[frame[0]] -= 1
        del stack[depth:]

    at = 0
    for begin, end, named in tags(page):
        if begin > at and not stack[-1][3]:
            buffer.append(page[at:begin])
        at = end
        if not named:
            continue
        name = named.lstrip("/")
        block = name not in INLINE
        if block:
            yield from flush()
        if named[0] == "/":
            if is_open.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
            continue
        if name in ENDS_PARAGRAPH and stack[-1][5]:
            close(stack[-1][5])
        if name in SAME_LEVEL:
            ends, within = SAME_LEVEL[name]
            ends = ends.split()
            if any(is_open.get(e) for e in ends):
                depth = len(stack) - 1
                while depth and stack[depth][0] not in within:
                    if stack[depth][0] in ends:
                        close(depth)
                        break
                    depth -= 1
        if name in VOID:
            continue
        tag = page[begin:end]
        _, path, element, out, main, paragraph = stack[-1]
        out = out or unseen(name, tag)
        if not out:
            if block:
                path = element = token_of(name, path)
                yield path
                if kind := kind_of(tag):
                    element = token_of(kind, path ^ 2)
                    yield element
            if words := telling_words(name, tag):
                mark = Mark(token_of(f"{name} {words}", path ^ 3))
                out = mark.token in template
                yield mark
        if tag.endswith("/>") and not block:
            continue
        paragraph = len(stack) if name == "p" else 0 if name in SCOPE else paragraph
        stack.append((name, path, element, out, main or name in MAIN, paragraph))
        is_open[name] = is_open.get(name, 0) + 1
    if at < len(page) and not stack[-1][3]:
        buffer.append(page[at:])
    yield from flush()


def text_token(block: Block) -> int:
    return token_of(block.text, block.element ^ 1)


def main_text(page: str, template: frozenset[int] | None) -> str:
    """The slots of a page: its blocks that the template of its site does not hold, and that lie in none of its marked elements.

    For a page of a site of which nothing is known (None), article marks stand in: if they hold half of the text or more, only what
    lies in them is the text. Its class words decide nothing, as nothing shows that the site uses them so.
    """
    blocks = [b for b in read_page(page, template or frozenset()) if isinstance(b, Block)]
    if template is not None:
        return " ".join(b.text for b in blocks if text_token(b) not in template)
    marked = sum(len(b.text) for b in blocks if b.in_main)
    if marked and 2 * marked >= sum(len(b.text) for b in blocks):
        blocks = [b for b in blocks if b.in_main]
    return " ".join(b.text for b in blocks)


def classes_of(tokens: DataFrame, least_pages: int, least_share: float, body_share: float) -> DataFrame:
    """(site, template) of (site, token, element, pages, one, two, size, chars), summed by site and token.

    Tokens with equal sums occur equally often on every page of the site: an equivalence class. A class is template if it has
    two tokens or more, on at least `least_pages` pages and `least_share` of all; if it nests, that is, each of its texts is on
    all pages that have the text's element, so that no page has another text in that place; and if its texts
    are not nearly all that its pages say, as those of copies are. Marked elements that as many pages have in the same place are template with all they hold.
    A site of which enough pages are known has a row, if only an empty one.
    """
    tokens = tokens.where(F.col("pages") >= least_pages)
    pages = tokens.where("token = 0").select("site", F.col("pages").alias("all_pages"))
    often = materialize(tokens.where("token != 0").join(pages, "site").where(F.col("pages") >= least_share * F.col("all_pages")), "html-often")
    marks = often.where(F.col("element") == MARKED).select("site", "token")
    often = often.where(F.col("element").isNull() | (F.col("element") != MARKED))
    elements = often.where("element is null").select("site", F.col("token").alias("element"), F.col("pages").alias("element_pages"))
    texts = often.where("element is not null").join(elements, ["site", "element"], "left")
    nests = F.coalesce(F.col("pages") == F.col("element_pages"), F.col("element") == 0) & ((F.col("element") != 0) | (F.col("pages") == F.col("all_pages")))
    parts = texts.select("site", "pages", "one", "two", "size", "chars", F.col("token").alias("text"), nests.alias("nests")).unionByName(
        often.where("element is null").select("site", "pages", "one", "two", "size", "chars", F.lit(None).cast("long").alias("text"), F.lit(True).alias("nests"))
    )
    classes = parts.groupBy("site", "pages", "one", "two").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("nests").alias("nested"), F.sum("size").alias("size"), F.max("chars").alias("chars"), F.collect_list("text").alias("texts")
    )
    valid = classes.where((F.col("n") > 1) & F.col("nested") & (F.size("texts") > 0) & (F.col("size") <= body_share * F.col("chars")))
    held = valid.select("site", F.explode("texts").alias("token")).unionByName(marks).unionByName(pages.select("site", F.lit(None).cast("long").alias("token")))
    return held.groupBy("site").agg(F.collect_list("token").alias("template"))


SUMS = ("pages", "one", "two", "size", "chars")


def templates(pages: DataFrame, least_pages: int, least_share: float, body_share: float) -> DataFrame:
    """(host, template): the texts of each host's template, as tokens.

    A token is a block element with its path, or a block's text with its element. Its occurrence vector, how often each page of
    the host has it, is kept as two sums of page hashes times counts, which are compared but never multiplied. Counts
    are added within each batch first, and are partly added again before the shuffle, so a host with a third of all pages
    is only ever met as sums. A site is a host; hosts of fewer than `least_pages` pages with tokens take the template of their
    domain, the last two labels, over all its hosts. A token on `least_share` of the pages bounds a template: it has no
    more tokens than 1 / `least_share` pages have.
    """

    def count(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                seen: dict[tuple[str, int, int | None], list[int]] = {}
                for host, key, page in zip(part.column("host").to_pylist(), part.column("key").to_pylist(), texts_of(part, "html").to_pylist(), strict=True):
                    counts: dict[tuple[int, int | None], list[int]] = {}
                    chars = 0
                    for token in read_page(page):
                        if isinstance(token, Block):
                            chars += len(token.text)
                            had = counts.setdefault((text_token(token) or 1, token.element), [0, 0])
                            had[1] += len(token.text)
                        elif isinstance(token, Mark):
                            had = counts.setdefault((token.token or 1, MARKED), [0, 0])
                        else:
                            had = counts.setdefault((token or 1, None), [0, 0])
                        had[0] += 1
                    if counts:
                        counts[0, None] = [1, 0]  # the page itself; one without tokens says nothing of its host
                    one, two = key & 0xFFFFFF, (key >> 24) & 0xFFFFFF
                    for token, (n, size) in counts.items():
                        sums = seen.setdefault((host, *token), [0, 0, 0, 0, 0])
                        for i, more in enumerate((1, n * one, n * two, size, chars)):
                            sums[i] += more
                rows = [(*k, *v) for k, v in seen.items()]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns[1:])], ["host", "token", "element", *SUMS])

    counted = pages.mapInArrow(count, "host string, token long, element long, " + ", ".join(f"{c} long" for c in SUMS))
    tokens = materialize(counted.groupBy("host", "token", "element").agg(*(F.sum(c).alias(c) for c in SUMS)), "html-tokens")
    by_host = classes_of(tokens.withColumnRenamed("host", "site"), least_pages, least_share, body_share).withColumnRenamed("site", "host")
    domain = F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), ".")
    small = materialize(tokens.where(f"token = 0 and pages < {least_pages}").select("host", domain.alias("site")), "html-small-hosts")
    shared = tokens.withColumn("site", domain).join(small.select("site").distinct(), "site", "left_semi")
    shared = shared.groupBy("site", "token", "element").agg(*(F.sum(c).alias(c) for c in SUMS))
    by_domain = small.join(classes_of(shared, least_pages, least_share, body_share), "site").select("host", "template")
    return materialize(by_host.unionByName(by_domain), "html-templates")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_pages: int = 8, least_share: float = 0.01, body_share: float = 0.9) -> DataFrame:
    """(id_col, url_col, text) of every page: its article, without menus, headers, footers, sidebars, notices and the like.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by one space in page
    order. Elements that are something else by name (`nav`, `header`, `footer`, `aside`, `form`, `script` ...) or role, or that are not shown, are left
    out. Of the rest the template of the page's host, or of its domain if the host has fewer than `least_pages` pages, is taken
    out: texts of its equivalence classes, and elements that a class or id calls an advert, comments or the like and that are in the same place on
    `least_pages` pages and `least_share` of all. The slots left are the text. Class words alone decide nothing. Where a domain has
    too few pages to know a template, `article` and `main` decide if they hold half of the text.

    Null html counts as empty, and pages without text give an empty string. A null url is the empty host. Null and
    repeated ids stay row by row; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    keyed = rows.select("host", "html", (F.xxhash64(F.col(id_col), F.col(url_col)).bitwiseAND(F.lit((1 << 48) - 1))).alias("key"))
    known = templates(keyed, least_pages, least_share, body_share)

    def extract(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                sets = [None if t is None else frozenset(t) for t in part.column("template").to_pylist()]
                texts = [main_text(page, template) for page, template in zip(texts_of(part, "html").to_pylist(), sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    schema = T.StructType([field(pages, id_col), field(pages, url_col), T.StructField("text", T.StringType())])
    return rows.join(known, "host", "left").select(id_col, url_col, "html", "template").mapInArrow(extract, schema)
