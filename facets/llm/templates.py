"""Main text of web pages by deducing each host's template.

A token is a structural tag in its place (its chain of enclosing elements), or the words of a block
of text in its place. Tokens that occur equally often on every page of a host have the same
occurrence vector; they form an equivalence class. Vectors are compared by a sum of hashes over
pages, which is added up before the shuffle, so a host with a third of all pages is no larger a
group than any other. Classes that most pages of the host hold and that have several tokens are
valid; nested by their enclosing tokens they are the template. What stands between its tokens are
slots. Where the template has an article, the slots inside it are the text, words that repeat
included. Elsewhere, blocks whose words belong to the template are left out, and so is what menus,
adverts and the like hold; the other slots are the text.

Hosts with too few pages to compare use the tags of all pages together. For words, equal pages of a
host count once, so that a page with many copies is not taken for a template.

Defined cases: a null html is an empty one, with empty text; a null url is the host ``''``; equal
rows each keep their row; unclosed elements end where their parent ends, unclosed comments and
scripts at the end of the page, and a tag that never closes is text. A page is read in time that
grows in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.session import attach, cut, ship_package

LEAST_PAGES = 3
LEAST_SHARE = 0.5
LEAST_TOKENS = 2
EVERYWHERE = "*"

# Elements that shape a run of text and do not end it.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd
    label mark q s samp small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("""area base br col embed hr img input link meta param source track
    wbr""".split())
MAIN = frozenset({"article", "main"})
# Elements, and class and id names made of these words, that are not article text.
ASIDE = frozenset("""aside button canvas dialog footer form head iframe input menu nav noscript
    object option script select style svg template textarea title""".split())
ASIDE_NAMES = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment
    comments consent cookie cookies footer header masthead menu modal nav navbar navigation
    newsletter notice notices pagination popup promo related share sharing sidebar social sponsor
    sponsored subscribe toolbar widget""".split())
PLACE_NAMES = frozenset("""area bar block bottom box container inner left list main outer page right
    section site top wrap wrapper""".split())
# What an opening tag ends, up to the given enclosing elements.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<name>/?[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^<>]*+>", re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_NAME_WORD = re.compile(r"[a-z]+|[0-9]+")


def _names_aside(name: str) -> bool:
    """Whether a class or id names something beside the text, and nothing else."""
    words = {w for w in _NAME_WORD.findall(name) if w.isalpha()}
    return bool(words & ASIDE_NAMES) and words <= ASIDE_NAMES | PLACE_NAMES


class Element:
    """An open structural element: its key names the chain of elements from the root."""

    __slots__ = ("name", "label", "key", "parent", "role", "inside", "below")

    def __init__(self, name: str, attrs: str, parent: Element | None, roots):
        names = [v.strip("\"'").lower() for v in _NAMED.findall(attrs)] if attrs else []
        self.name = name
        self.label = ".".join([name, *names])
        self.parent = parent.key if parent else 0
        self.key = xxhash.xxh64_intdigest(f"{self.parent} {self.label}") >> 1
        self.inside = bool(parent) and (parent.inside or parent.name in MAIN)
        self.below = bool(parent) and parent.below or self.key in roots
        aside = (name in ASIDE or (name == "header" and not self.inside)
                 or any(map(_names_aside, " ".join(names).split())))
        if parent and parent.role == "aside" or aside:
            self.role = "aside"
        else:
            self.role = "main" if name in MAIN else "open"


def walk(page: str, roots=frozenset()):
    """Events of a page: each structural element that opens, and each run of text (str) with its
    chain of open elements; None where a block ends."""
    stack: list[Element] = []
    held: Counter[str] = Counter()  # names of open elements, so that none is looked for in vain
    at = 0

    def close_to(n: int):
        held.subtract(e.name for e in stack[n:])
        del stack[n:]

    for tag in _TAG.finditer(page):
        if tag.start() > at:
            yield page[at:tag.start()], stack
        at = tag.end()
        if tag["raw"]:
            yield None, stack
            continue
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        bare = name.lstrip("/")
        if bare in INLINE:
            continue
        yield None, stack
        if name[0] == "/":
            if held[bare] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == bare:
                        close_to(k)
                        break
            continue
        # An open paragraph ends at the next block; list items and cells end each other.
        if stack and stack[-1].name == "p" and bare not in VOID:
            close_to(len(stack) - 1)
        ended, within = _ENDS.get(bare, ((), ()))
        if any(held[e] > 0 for e in ended):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in within:
                    break
                if stack[k].name in ended:
                    close_to(k)
        element = Element(bare, tag["attrs"], stack[-1] if stack else None, roots)
        yield element, stack
        if bare not in VOID and not tag["attrs"].endswith("/"):
            stack.append(element)
            held[bare] += 1
    if at < len(page):
        yield page[at:], stack


def blocks(page: str, roots=frozenset()):
    """Elements of a page as they open, and its blocks of text outside of menus and the like:
    (element that holds it or None, words)."""
    held: list[str] = []
    holder = None
    for event, stack in walk(page, roots):
        if isinstance(event, str):
            top = stack[-1] if stack else None
            if top is None or top.role != "aside":
                holder = top
                held.append(event)
            continue
        words = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if words:
            yield holder, words
        if event is not None:
            yield event, None
    words = " ".join(html.unescape("".join(held)).split())
    if words:
        yield holder, words


def text_key(holder: Element | None, words: str) -> int:
    """The token that a block's words are in their place."""
    return xxhash.xxh64_intdigest(f"{holder.key if holder else 0} # {words}") >> 1


def page_tokens(page: str) -> dict[int, tuple[Element, int]]:
    """Structural tokens of a page and how often each occurs."""
    found: dict[int, tuple[Element, int]] = {}
    for event, _ in walk(page):
        if isinstance(event, Element):
            found[event.key] = (event, found[event.key][1] + 1 if event.key in found else 1)
    return found


def word_tokens(page: str) -> Counter:
    """(key, whether it is words) of the blocks outside of articles and of the elements that hold
    blocks, with how often each occurs."""
    found: Counter = Counter()
    opened: Counter = Counter()
    holders = set()
    for element, words in blocks(page):
        if words is None:
            opened[element.key] += 1
        elif element is None or not (element.inside or element.role == "main"):
            found[text_key(element, words), True] += 1
            if element is not None:
                holders.add(element.key)
    for key in holders:
        found[key, False] = opened[key]
    return found


def main_text(page: str, roots: set[int], repeated=frozenset()) -> str:
    """Blocks of text in the slots below the template's roots, one a line.

    A page that holds no root is read without them, but for the template's own words.
    """
    found: list[tuple[bool, str]] = []
    seen = False
    for element, words in blocks(page, roots):
        if words is None:
            seen = seen or (element.key in roots and element.role != "aside")
        else:
            below = element is not None and element.below
            if below or not repeated or text_key(element, words) not in repeated:
                found.append((below, words))
    return "\n".join(words for below, words in found if below or not seen)


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit(""))
                        .alias("html"), host.alias("host"))


def token_classes(pages: DataFrame, least_pages: int = LEAST_PAGES,
                  least_share: float = LEAST_SHARE,
                  least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(host, tokens): valid classes of every host, a token as (key, parent, label, role)."""
    ship_package(pages.sparkSession)
    rows = _pages(pages).select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")

    def kernel(batches):
        for batch in batches:
            row, key, parent, label, role, n = [], [], [], [], [], []
            for k, page in enumerate(batch.column(2).to_pylist()):
                for element, count in page_tokens(page).values():
                    row.append(k)
                    key.append(element.key)
                    parent.append(element.parent)
                    label.append(element.label)
                    role.append(element.role)
                    n.append(count)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(key, pa.int64()),
                 pa.array(parent, pa.int64()), pa.array(label, pa.string()),
                 pa.array(role, pa.string()), pa.array(n, pa.int64())],
                ["host", "page", "key", "parent", "label", "role", "n"])

    tokens = rows.mapInArrow(kernel, "host string, page long, key long, parent long, label string, "
                                     "role string, n long")
    # One place of the occurrence vector: page and count in one hash, summed in two halves.
    place = F.xxhash64("page", "n")
    half = F.lit((1 << 31) - 1)
    by_host = tokens.withColumn("host", F.explode(F.array("host", F.lit(EVERYWHERE))))
    vectors = by_host.groupBy("host", "key").agg(
        F.min("parent").alias("parent"), F.min("label").alias("label"), F.min("role").alias("role"),
        F.count("*").alias("support"), F.sum(place.bitwiseAND(half)).alias("low"),
        F.sum(F.shiftrightunsigned(place, 33)).alias("high"))
    sizes = _pages(pages).select(F.explode(F.array("host", F.lit(EVERYWHERE))).alias("host")) \
        .groupBy("host").agg(F.count("*").alias("pages"))
    common = (vectors.join(sizes, "host")
              .where((F.col("pages") >= least_pages)
                     & (F.col("support") >= least_share * F.col("pages"))))
    # At most 1 / least_share times the tokens of a page are as common as that.
    return (common.groupBy("host", "low", "high", "support").agg(F.collect_list(
        F.struct("key", "parent", "label", "role")).alias("tokens"))
        .where(F.size("tokens") >= least_tokens).select("host", "tokens"))


def nested(classes: list[list[dict]]) -> list[dict]:
    """Classes of one host as a template: each with the class that encloses it, or None."""
    ordered = sorted(classes, key=lambda c: min(t["key"] for t in c))
    owner = {t["key"]: k for k, c in enumerate(ordered) for t in c}
    up = {t["key"]: t["parent"] for c in ordered for t in c}
    out = []
    for k, c in enumerate(ordered):
        outer = set()
        for t in c:
            at = t["parent"]
            while owner.get(at) == k:
                at = up[at]
            if at in owner:
                outer.add(owner[at])
        out.append({"tokens": c, "parent": min(outer) if outer else None})
    return out


def slot_roots(template: list[dict]) -> list[int]:
    """Keys of the template's outermost article elements; slots below them are the text."""
    tokens = {t["key"]: t for c in template for t in c["tokens"]}
    roots = {k for k, t in tokens.items() if t["role"] == "main"}
    return sorted(k for k in roots if tokens[k]["parent"] not in roots)


def host_roots(pages: DataFrame) -> DataFrame:
    """(host, roots) of every host with a template; ``*`` stands for all pages."""
    classes = token_classes(pages).groupBy("host").agg(F.collect_list("tokens").alias("classes"))

    def kernel(batches):
        for batch in batches:
            roots = [slot_roots(nested(c)) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(roots, pa.list_(pa.int64()))], ["host", "roots"])

    return classes.mapInArrow(kernel, "host string, roots array<long>")


def host_words(pages: DataFrame, least_pages: int = LEAST_PAGES,
               least_share: float = LEAST_SHARE,
               least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(host, repeated): keys of the words that belong to each host's template."""
    ship_package(pages.sparkSession)
    rows = _pages(pages).select("host", F.xxhash64("html").alias("page"), "html")

    def kernel(batches):
        for batch in batches:
            row, key, words, n = [], [], [], []
            for k, page in enumerate(batch.column(2).to_pylist()):
                for (token, is_words), count in word_tokens(page).items():
                    row.append(k)
                    key.append(token)
                    words.append(is_words)
                    n.append(count)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(key, pa.int64()),
                 pa.array(words, pa.bool_()), pa.array(n, pa.int64())],
                ["host", "page", "key", "words", "n"])

    # Equal pages count once.
    tokens = rows.mapInArrow(kernel, "host string, page long, key long, words boolean, n long") \
        .distinct()
    place = F.xxhash64("page", "n")
    half = F.lit((1 << 31) - 1)
    vectors = tokens.groupBy("host", "key").agg(
        F.max("words").alias("words"), F.count("*").alias("support"),
        F.sum(place.bitwiseAND(half)).alias("low"),
        F.sum(F.shiftrightunsigned(place, 33)).alias("high"))
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    common = (vectors.where(F.col("support") >= least_pages * least_share).join(sizes, "host")
              .where((F.col("pages") >= least_pages)
                     & (F.col("support") >= least_share * F.col("pages"))))
    classes = common.groupBy("host", "low", "high", "support").agg(
        F.collect_list(F.struct("key", "words")).alias("tokens"))
    held = F.transform(F.filter("tokens", lambda t: t["words"]), lambda t: t["key"])
    return (classes.where(F.size("tokens") >= least_tokens)
            .groupBy("host").agg(F.flatten(F.collect_list(held)).alias("repeated")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page; pages stay where they are unless hosts are many."""
    templates = cut(host_roots(pages).join(host_words(pages), "host", "full").select(
        "host", "roots", "repeated"))
    shared = templates.where(F.col("host") == EVERYWHERE).select("roots").first()
    everywhere = list(shared[0]) if shared else []
    none = F.array().cast("array<long>")
    rows = attach(_pages(pages), templates, "host", "left").select(
        "page_id", "url", "html", F.coalesce("roots", F.array(*[
            F.lit(r) for r in everywhere]).cast("array<long>")).alias("roots"),
        F.coalesce("repeated", none).alias("repeated"))

    def kernel(batches):
        for batch in batches:
            text = [main_text(page, set(roots), set(repeated)) for page, roots, repeated in zip(
                *(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string())],
                ["page_id", "url", "text"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(kernel, f"page_id {types['page_id']}, url {types['url']}, text string")
