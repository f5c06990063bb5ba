"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a page's tokens: tags, text slots, and groups that are optional or
repeated. Every page is an expression of its own, with repeats already folded; pages of a host are aligned with the
wrapper so far, one after the other: where tags agree the groups inside are aligned, a run that only one side has
becomes optional, and neighbours that agree with one place become a repeated group. A slot keeps its text only while
all pages agree on it, so that template text is told apart from what varies.

Pages of one partition and host are folded first; the wrappers that come out, a few for each host and partition, are
folded in two rounds, so that no group grows with the pages of a host. The finished wrapper says where the article
stands: at its article or main element, or, where pages have none, at the densest place with all that varies between
pages beside it. Slots beside that place whose text never varies are template text; inside the article nothing is
template text, however often it is repeated. With that, each page is read whole. Tags and roles tell furniture (menus,
forms) from the rest. A class name or id, read whole, is a hint only: outside the article it says where not to look, and inside
it an element goes for it only if the wrapper shows that element on several different pages of the host, or if the host
has too few pages to show anything. Other attributes say nothing, and headings are never hints. Neighbours of one tag without class names are
one repeated group, so without an article element nothing tells such neighbours apart.

Wrappers are bounded: elements nested deeper than DEPTH count as parts of the one at that depth, and more than MOST_PARTS
parts of an element become repeated groups, one for each key or, if these are too many, for each tag and one for all tags
that aren't HTML's. No part is dropped, and neither hints nor template text depend on these groups: the pages that have
them are counted exactly, beside the wrappers.

Defined cases: a null or empty page has the empty text; very long and deeply nested pages are read whole, in time linear
in their length; a tag that never ends is text; repeated rows have equal texts; a host with one page gets its wrapper
from that page; a null url is the host without a name; an empty table gives no rows; other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import small, stored, table
from tramline.llm.urlfilter import host

#: Bytes that the hosts' rules may have to be sent to every executor; above, they are joined by host.
BROADCAST_BYTES = 8 << 20
#: Distinct pages that a slot beside the article must stand on, with one text, to be template text.
TEMPLATE_PAGES = 3
#: Levels of elements, and parts of one element, that a wrapper tells apart.
DEPTH, MOST_PARTS = 150, 48
#: Pages of a host, told apart by their longest block, that a wrapper keeps as a sample.
SAMPLE = 32

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form script style noscript template iframe svg button select menu dialog head object canvas textarea input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes first, if it stands open in the same container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class names and ids for page furniture. Only a name that has no other words, but for those of BESIDE, is a hint.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar side aside widget related recommended "
    "recommendations cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup comment comments disqus respond reply replies share sharing social login search pagination pager toolbar skip copyright".split()
)
BESIDE = frozenset("site page top bottom left right list area box block bar section wrap wrapper container posts links link buttons button icons item items form global main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag without quotes.
SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
#: Where a tag's attributes end, or a value in quotes begins.
STOP = re.compile(r">|=\s*(?:\"[^\"]*\"|'[^']*')")
#: Elements that a wrapper tells apart where there are too many others.
KNOWN = FURNITURE | HEADINGS | ENDS_P | frozenset("li dt dd tr td th tbody thead tfoot caption summary details figcaption body html title".split())
#: The key of the group of all elements with other tags than these.
OTHER = "*"
RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
#: One attribute after the other: name, and value in any quotes.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z]+")


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") of a page, in one pass."""
    at = start = 0
    quoted = True  # until a tag with quotes never ends
    last = source.rfind(">")
    simple = SIMPLE.match
    while (at := source.find("<", at)) >= 0:
        if m := simple(source, at):
            closing, tag, attributes = m.groups()
            kind, tag, end = "close" if closing else "open", tag.lower(), m.end()
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            kind, tag, attributes = "", "", ""
        elif at > last:  # only a comment that never ends is left
            at = source.find("<!--", at)
            if at < 0:
                break
            continue
        elif source.startswith(("!", "?"), at + 1):
            kind, tag, attributes, end = "", "", "", source.find(">", at) + 1
        else:
            closing = source.startswith("/", at + 1)
            name = NAME.match(source, at + 1 + closing)
            if not name:
                at += 1
                continue
            kind, tag, end = "close" if closing else "open", name[0].lower(), source.find(">", name.end()) + 1
            stop = next((m for m in STOP.finditer(source, name.end()) if m[0] == ">"), None) if quoted else None
            if quoted:
                quoted, end = stop is not None, stop.end() if stop else end
            attributes = source[name.end() : end - 1]
        if at > start:
            yield "text", source[start:at], ""
        if kind == "open" and tag in RAW:
            close = RAW_END[tag].search(source, end)
            end = close and source.find(">", close.end()) + 1 or len(source)
        elif kind:
            yield kind, tag, attributes
        at = start = end
    if start < len(source):
        yield "text", source[start:], ""


class Node:
    """An element of a page. kind is 1 for furniture, 2 for a hint of it, else 0.

    Inside furniture or furniture itself, an element is gone; inside either, it is hidden from the search for the article.
    """

    __slots__ = ("key", "children", "kind", "gone", "hidden", "parent", "depth")

    def __init__(self, key: str, kind: int = 0, parent: Node | None = None) -> None:
        self.key, self.kind, self.parent = key, kind, parent
        self.depth = parent.depth + 1 if parent else 0
        self.gone = kind == 1 or parent is not None and parent.gone
        self.hidden = kind > 0 or parent is not None and parent.hidden
        self.children: list[Node] = []

    def path(self) -> list[Node]:
        """The elements below the page's root that this one is inside, and itself."""
        out, node = [], self
        while node.parent:
            out.append(node)
            node = node.parent
        return out[::-1]


def furniture(tag: str, attributes: str) -> tuple[str, int]:
    """The name by which an element is aligned, and 1 if its tag or role makes it furniture, 2 if its class or id hints at that."""
    kind, key, seen = int(tag in FURNITURE), tag, set()
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in seen or name not in ("class", "id", "role"):
            continue
        seen.add(name)
        if name == "role":
            kind = 1 if value.strip() in ROLES else kind
            continue
        found = [[w for w in SPLIT.split(x) if w] for x in value.split()]
        if name == "class" and any(found) and kind < 2:
            key = f"{tag}.{next(filter(None, found))[0]}"
        hints = [x for x in found if not NAMES.isdisjoint(x) and NAMES.union(BESIDE).issuperset(x)]
        if hints and not kind and tag not in HEADINGS and tag not in ("html", "body", "main") and (tag != "article" or "comment" in hints[0]):
            kind, key = 2, f"{tag}.{'-'.join(hints[0])}"
    return key, kind


class Page:
    """The elements of a page and its blocks of text: (element, text)."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[Node, str]] = []
        self.root = Node("#")
        self.stack: list[tuple[str, Node]] = [("#", self.root)]
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        #: Keys of the elements that a class or id hints at.
        self.hints: set[str] = set()
        for kind, what, attributes in tokens(source):
            if kind == "text":
                self.text.append(what)
            elif kind == "open":
                self._open(what, attributes)
            else:
                self._close(what)
        self._flush()

    def _flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", html.unescape("".join(self.text))).strip()
            self.text = []
            if text:
                self.blocks.append((self.stack[-1][1], text))

    def _pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def _open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.text.append(" ")
            return
        self._flush()
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        while closes and self.stack[-1][0] in closes:
            self._pop()
        key, kind = furniture(tag, attributes)
        kind = 1 if tag == "header" and not self.open["article"] else kind
        parent = self.stack[-1][1]
        if parent.depth >= DEPTH and (parent.gone or not kind):
            node = parent
        else:
            node = Node(key, kind, parent)
            parent.children.append(node)
            if kind == 2:
                self.hints.add(key)
        if tag not in VOID:
            self.stack.append((tag, node))
            self.open[tag] += 1

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            return
        self._flush()
        if self.open[tag]:
            while self._pop() != tag:
                pass


# An expression is [key, mark, kind, pages, length, text, parts, whole]: mark is "" (once), "?" (optional), "+" (repeated)
# or "*" (both); pages are the least hashes of the pages that have it, so that copies of an article are one page; length
# is that of all text directly inside; text is that text's hash while all pages agree, else ""; whole is the same for all
# text inside, that of parts included.


def expression(node: Node, own: dict[int, list[str]], page: int = 0) -> list:
    parts: list[list] = []
    for child in node.children:
        part = expression(child, own, page)
        if parts and parts[-1][0] == part[0]:
            both = [parts[-1][7], part[7]]
            parts[-1] = repeat(parts[-1], part)
            parts[-1][7] = _hex(both)
        else:
            parts.append(part)
    texts = own.get(id(node), ())
    return [node.key, "", node.kind, [page], sum(map(len, texts)), _hex(texts) if texts else "", bounded(parts), _hex([*texts, *(x[7] for x in parts)])]


def bounded(parts: list[list]) -> list[list]:
    """parts, or, if they are too many, one repeated group for each key in them, then for each tag, furniture apart."""
    for name in (str, _tag, lambda key: _tag(key) if _tag(key) in KNOWN else OTHER):
        if len(parts) <= MOST_PARTS:
            break
        groups: dict[tuple[str, int], list] = {}
        for part in parts:
            named = [name(part[0]), *part[1:]]
            group = named[0], part[2]
            groups[group] = repeat(groups[group], named) if group in groups else named
        parts = list(groups.values())
    return parts


def _tag(key: str) -> str:
    return key.partition(".")[0]


def _hex(texts: Iterable[str]) -> str:
    return format(hash_of(texts), "x")


def hash_of(texts: Iterable[str]) -> int:
    return zlib.crc32("\n".join(texts).encode())


def _pages(a: list[int], b: list[int]) -> list[int]:
    if len(b) == 1 and (b[0] in a or len(a) == SAMPLE and b[0] > a[-1]):
        return a
    return sorted({*a, *b})[:SAMPLE]


def repeat(a: list, b: list) -> list:
    """Two neighbours as one repeated group, whose slots hold differing text."""
    out = align(a, b)
    out[1] = "*" if "?" in out[1] or "*" in out[1] else "+"
    out[5] = out[7] = ""
    return out


def _mark(a: str, b: str) -> str:
    optional, repeated = any(x in "?*" and x for x in (a, b)), any(x in "+*" and x for x in (a, b))
    return {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, repeated]


def _optional(part: list) -> list:
    return [part[0], _mark(part[1], "?"), *part[2:]]


def align(a: list, b: list) -> list:
    """The least expression that both are words of, for two expressions with one key."""
    ours, theirs = a[6], b[6]
    parts: list[list] = []
    for op, i, j, k, m in SequenceMatcher(None, [x[0] for x in ours], [x[0] for x in theirs], autojunk=False).get_opcodes():
        if op == "equal":
            parts += [align(x, y) for x, y in zip(ours[i:j], theirs[k:m], strict=True)]
        else:
            parts += map(_optional, ours[i:j] + theirs[k:m])
    folded: list[list] = []
    for part in parts:
        if folded and folded[-1][0] == part[0]:
            folded[-1] = repeat(folded[-1], part)
        else:
            folded.append(part)
    return [a[0], _mark(a[1], b[1]), max(a[2], b[2]) if 0 in (a[2], b[2]) else min(a[2], b[2]), _pages(a[3], b[3]), a[4] + b[4], a[5] if a[5] == b[5] else "", bounded(folded), a[7] if a[7] == b[7] else ""]


def own_texts(page: Page) -> dict[int, list[str]]:
    own: dict[int, list[str]] = {}
    for node, text in page.blocks:
        own.setdefault(id(node), []).append(text)
    return own


def page_hash(page: Page) -> int:
    return hash_of([max((text for node, text in page.blocks if not node.hidden), key=len, default="")])


def expression_of(page: Page) -> list:
    return expression(page.root, own_texts(page), page_hash(page))


def page_expression(source: str) -> list:
    return expression_of(Page(source))


def _length(x: list) -> int:
    """Text inside, without page furniture."""
    return 0 if x[2] else x[4] + sum(map(_length, x[6]))


def _own(x: list, pages: int) -> bool:
    """Whether a neighbour of the densest place is the article's: a heading, or text that varies between pages."""
    if x[2]:
        return False
    if _length(x) and x[0].partition(".")[0] in HEADINGS:
        return True
    return pages > 1 and x[4] > 0 and not x[5] or any(_own(y, pages) for y in x[6])


def article_of(wrapper: list) -> list[str]:
    """Path of keys to the element that holds the article.

    That is the article or main element with most of the text, or else the narrowest element with most of the text
    beside which there is neither a heading nor text that varies between pages.
    """
    for wanted in ("article", "main"):
        found = _find(wrapper, wanted, [])
        if found:
            return max(found, key=lambda x: x[0])[1]
    at, path = wrapper, []
    while True:
        inside = sorted(((x for x in at[6] if not x[2] and x[0].partition(".")[0] not in HEADINGS and x[0] != "p")), key=_length, reverse=True)
        if not inside or _length(inside[0]) < 0.6 * max(1, _length(at)) or inside[0][1] in ("+", "*"):
            return path
        beside = [x for x in at[6] if x is not inside[0] and x[0].partition(".")[0] != "head"]
        if at[4] > 0 and (not at[5] or len(wrapper[3]) == 1) or any(_own(x, len(wrapper[3])) for x in beside):
            return path
        at = inside[0]
        path.append(at[0])


def _find(x: list, wanted: str, path: list[str]) -> list[tuple[int, list[str]]]:
    """Length and path of the wanted elements with text, not inside furniture, the outer before the inner."""
    found = []
    for part in x[6]:
        if part[2]:
            continue
        if part[0].partition(".")[0] == wanted and _length(part):
            found.append((_length(part), [*path, part[0]]))
        found += _find(part, wanted, [*path, part[0]])
    return found


def rules_of(wrapper: list) -> str:
    """Rules of a page that has no host to count on."""
    return json.dumps([article_of(wrapper), [], None], ensure_ascii=False)


def _is(key: str, wanted: str) -> bool:
    """Whether an element's key is a wrapper's, which may be of a group by tag."""
    return wanted in (key, _tag(key)) or wanted == OTHER and _tag(key) not in KNOWN


def beside(page: Page, article: list[str]) -> dict[str, list[tuple[str, int]]]:
    """Hash of all text, and its length, of every part of the article's place, by key."""
    own, places = own_texts(page), [page.root]
    for wanted in article:
        places = [child for node in places for child in node.children if _is(child.key, wanted)]
    found: dict[str, list[tuple[str, int]]] = {}
    for node in places:
        for child in node.children:
            part = expression(child, own)
            found.setdefault(child.key, []).append((part[7] if not child.kind else "", _length(part)))
    return found


def extract(source: str, rules: str | None) -> str:
    """The article's blocks, one to a line. A page without the host's article is its own wrapper's only page."""
    if not source:
        return ""
    page = Page(source)
    blocks = [(node, text) for node, text in page.blocks if not node.gone]
    paths: dict[int, list[Node]] = {}
    for node, _ in blocks:
        if id(node) not in paths:
            paths[id(node)] = node.path()
    for found in (rules, None):
        article, template, hints = json.loads(found or rules_of(page_expression(source)))
        n, fixed = len(article), set(template)

        def stays(path: list[Node]) -> bool:
            if len(path) < n or not all(_is(x.key, wanted) for x, wanted in zip(path, article, strict=False)):
                return False
            return not (path[n:] and path[n].key in fixed) and not any(x.kind == 2 and (hints is None or x.key in hints) and (k >= n or x.key != article[k]) for k, x in enumerate(path))

        inside = {k: stays(path) for k, path in paths.items()}
        texts = [text for node, text in blocks if inside[id(node)]]
        if texts:
            return "\n".join(texts)
    # A hint on what holds the whole page is none.
    return "\n".join(text for _, text in blocks)


FOLDED = "host string, part int, wrapper string, hint string, pages array<long>"


def _fold_batches(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """A wrapper for each host of the partition; and for each host and hint the pages that have it, as many as count."""
    part = TaskContext.get().partitionId()
    wrappers: dict[str, list] = {}
    hints: dict[tuple[str, str], set[int]] = {}
    for batch in batches:
        for name, source in zip(batch["host"], batch["html"], strict=True):
            page = Page(source or "")
            found = expression_of(page)
            wrappers[name] = align(wrappers[name], found) if name in wrappers else found
            for key in page.hints:
                pages = hints.setdefault((name, key), set())
                if len(pages) < TEMPLATE_PAGES:
                    pages.update(found[3])
        if len(wrappers) > 5000 or len(hints) > 50_000:
            yield _frame(wrappers, hints, part)
            wrappers, hints = {}, {}
    yield _frame(wrappers, hints, part)


def _frame(wrappers: dict[str, list], hints: dict[tuple[str, str], set[int]], part: int) -> pd.DataFrame:
    rows = [(k, part, json.dumps(v, ensure_ascii=False), None, None) for k, v in wrappers.items()]
    rows += [(k, part, None, key, sorted(pages)) for (k, key), pages in hints.items()]
    return pd.DataFrame(rows, columns=["host", "part", "wrapper", "hint", "pages"])


def _fold_group(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in sorted(rows["wrapper"]):
        found = json.loads(text)
        wrapper = found if wrapper is None else align(wrapper, found)
    return pd.DataFrame([(rows["host"].iloc[0], int(rows["part"].iloc[0]), json.dumps(wrapper, ensure_ascii=False))], columns=["host", "part", "wrapper"])


def infer(folded: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host of folded partitions."""
    schema = "host string, part int, wrapper string"
    first = folded.filter("wrapper IS NOT NULL").select("host", "part", "wrapper")
    parts = first.agg(F.coalesce(F.max("part"), F.lit(0)).alias("n")).first()["n"] + 1
    groups = max(1, int(parts**0.5))
    some = first.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("host", "part").applyInPandas(_fold_group, schema)
    return some.groupBy("host").applyInPandas(_fold_group, schema).select("host", "wrapper")


def _articles(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for batch in batches:
        wrappers = list(map(json.loads, batch["wrapper"]))
        paths = list(map(article_of, wrappers))
        named = [any(_tag(x) in ("article", "main") for x in path) for path in paths]
        several = [len(w[3]) >= TEMPLATE_PAGES for w in wrappers]
        yield pd.DataFrame({"host": batch["host"], "article": [json.dumps(x, ensure_ascii=False) for x in paths], "named": named, "several": several})


def _parts_beside(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """A row for each page, without a key, and one for each key beside its article; whole is empty unless the key stands there once."""
    for batch in batches:
        rows = []
        for name, source, article in zip(batch["host"], batch["html"], batch["article"], strict=True):
            page = Page(source or "")
            number = page_hash(page)
            rows.append((name, None, "", 0, number))
            rows += [(name, key, parts[0][0] if len(parts) == 1 else "", parts[0][1], number) for key, parts in beside(page, json.loads(article)).items() if _tag(key) not in HEADINGS]
        yield pd.DataFrame(rows, columns=["host", "key", "whole", "length", "page"])


def templates(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """host and keys of the parts beside the article, where no element names it, that have one text on most of several distinct pages."""
    there = pages.join(small(articles, 200), "host").select("host", "html", "article").mapInPandas(_parts_beside, "host string, key string, whole string, length int, page long")
    seen = there.groupBy("host", "key").agg(F.count_distinct("page").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"), F.max("length").alias("length"))
    seen = stored(seen, "beside")
    every = seen.filter("key IS NULL").select("host", F.col("n").alias("all"))
    often = seen.filter("key IS NOT NULL AND least = most AND least <> '' AND length > 0").join(every, "host").filter((F.col("n") >= TEMPLATE_PAGES) & (2 * F.col("n") > F.col("all")))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template"))


def rules(pages: DataFrame) -> DataFrame:
    """host and rules, as JSON: path of the article, keys of template text beside it, keys of hints that count (null: all do)."""
    folded = stored(pages.select("host", "html").mapInPandas(_fold_batches, FOLDED), "wrappers")
    articles = stored(infer(folded).mapInPandas(_articles, "host string, article string, named boolean, several boolean"), "articles")
    seen = folded.filter("hint IS NOT NULL").select("host", "hint", F.explode("pages").alias("page")).groupBy("host", "hint").agg(F.count_distinct("page").alias("n"))
    hints = seen.filter(F.col("n") >= TEMPLATE_PAGES).groupBy("host").agg(F.sort_array(F.collect_list("hint")).alias("hints"))
    found = articles.join(hints, "host", "left")
    unnamed = articles.filter("several AND NOT named")
    none = F.array().cast("array<string>")
    found = found.withColumn("template", none) if unnamed.isEmpty() else found.join(templates(pages, unnamed), "host", "left")
    listed = lambda c: F.to_json(F.coalesce(c, none))
    hinted = F.when(F.col("several"), listed("hints")).otherwise("null")
    return found.select("host", F.concat(F.lit("["), "article", F.lit(", "), listed("template"), F.lit(", "), hinted, F.lit("]")).alias("rules"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for batch in batches:
        texts = [extract(s or "", r) for s, r in zip(batch["html"], batch["rules"], strict=True)]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    found = stored(rules(own), "rules")
    size = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("rules")), F.lit(0)).alias("n")).first()["n"]
    # Beyond that, Spark splits the pages of a large host among tasks (adaptive skew joins).
    joined = own.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    return joined.select("page_id", "url", "html", "rules").mapInPandas(_texts, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
