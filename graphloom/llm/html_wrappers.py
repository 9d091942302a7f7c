"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of block elements. The trees of a host's pages are aligned one after another, child by child: elements
that one side lacks become optional, those that repeat what stands before them become repeated groups, texts that
differ become slots, texts that never differ stay part of the template. Each partition merges its own pages by host
before anything is shuffled, then partial wrappers are merged by host and salt, then by host. In the wrapper the
containers are chosen: the nodes that hold the article. Each page is aligned with its host's wrapper in the same way,
and its text is what stands in the blocks that meet a container.

Elements that HTML has for something else than text (nav, footer, form, script) never count. A class, id or role that
names boilerplate is a feature of a wrapper node and no veto: it counts against the node inside a container or beside
one, but not where the varying text of the host stands under such names.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, written

# HTML elements by how they count here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title select".split())
DROPPED = RAW | frozenset("nav header footer aside form button menu dialog head fieldset".split())
# Words of class, id or role that name what isn't article text.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline-share comment comments consent contentinfo cookie cookies disclaimer discussion disqus donate feedback footer header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup popular promo promoted promotion promos recommendations recommended related reply replies respond responses search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription teaser toolbar trending widget".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt figure figcaption address details summary".split())
MAIN = ("article", "main")
LEAST_PAGES = 5  # of a host before texts that never differ count as template
APART = 3  # neighbours of one label that keep a place of their own; further ones are one repeated node
HELD_HOSTS = 2000  # hosts whose wrappers a task holds before it hands them on
WRAPPER_MB = 64  # of wrappers that are broadcast

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


def _hidden(attributes: str) -> bool:
    """Whether there is a hidden attribute, aria-hidden is true or the style says display: none."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _boilerplate(token: str) -> bool:
    """Whether all words of a class, id or role are BOILERPLATE: cookie-notice is, has-sidebar and search-result aren't."""
    words = _WORDS.findall(token)
    return bool(words) and all(w.lower() in BOILERPLATE for w in words)


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's class, id and role for its label, digits unified, with a ! before names of boilerplate; whether it is hidden."""
    if not attributes.strip(" /"):
        return "", False
    values = [next(v for v in m.groups()[1:] if v is not None) if any(m.groups()[1:]) else "" for m in _NAMES.finditer(attributes)]
    names = [("!" if _boilerplate(token) else "") + re.sub(r"\d+", "0", token) for v in values for token in v.split()]
    hidden = tag not in ("html", "body") and bool(_MAY_HIDE.search(attributes)) and _hidden(attributes)
    return "".join("." + n for n in names), hidden


def events(html: str):
    """('open', tag, label, dropped), ('close', tag), ('text', raw), ('break',): what a page is made of; raw elements are skipped."""
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            yield "text", html[at:]
            return
        if m.start() > at:
            yield "text", html[at : m.start()]
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not slash:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I).search(html, at)
                at = close.end() if close else end if tag in ("script", "style", "textarea", "title") else at
            yield ("break",)
        elif tag in VOID:
            if tag in ("br", "hr"):
                yield ("break",)
        elif slash:
            yield "close", tag
        else:
            name, hidden = _named(tag, attributes)
            yield "open", tag, tag + name, hidden or tag in DROPPED


class _Walk:
    """The open elements while a page's events pass: tags, labels, and how many of them are dropped."""

    def __init__(self):
        self.tags, self.labels, self.drops, self.dropped, self.blocks = [], [], [], 0, []
        self.at: dict[str, list[int]] = {}  # by tag, where it is open
        self.block_at: list[int] = []

    def open(self, tag: str, label: str, dropped: bool) -> None:
        if tag not in INLINE and "p" in self.tags[-6:]:
            self._pop_to(len(self.tags) - 1 - self.tags[::-1].index("p"))
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and tag in self.tags[-6:] and not {"ul", "ol", "dl", "table"} & set(self.tags[len(self.tags) - self.tags[::-1].index(tag) :]):
            self._pop_to(len(self.tags) - 1 - self.tags[::-1].index(tag))
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.block_at.append(len(self.tags))
        self.tags.append(tag)
        self.labels.append(label)
        self.drops.append(dropped)
        self.dropped += dropped
        if tag not in INLINE:
            self.blocks.append(label)

    def _pop_to(self, size: int) -> None:
        while len(self.tags) > size:
            self.dropped -= self.drops.pop()
            self.labels.pop()
            tag = self.tags.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                self.block_at.pop()

    def close(self, tag: str) -> None:
        """Closes the innermost element of a tag and all in it; an inline one only up to the innermost block."""
        open_ = self.at.get(tag)
        if open_ and not (tag in INLINE and self.block_at and self.block_at[-1] > open_[-1]):
            self._pop_to(open_[-1])


class Block:
    """A block element of a page: its label, and its texts and blocks in page order; blocks without text are left out."""

    __slots__ = ("content", "label")

    def __init__(self, label: str):
        self.label, self.content = label, []

    @property
    def blocks(self) -> list[Block]:
        return [c for c in self.content if isinstance(c, Block)]


class _Tree(_Walk):
    """A walk that keeps a Block for each open block; it joins its parent when text turns up below it."""

    def __init__(self):
        super().__init__()
        self.path, self.joined = [Block("")], 0

    def open(self, tag: str, label: str, dropped: bool) -> None:
        super().open(tag, label, dropped)
        if tag not in INLINE:
            self.path.append(Block(label))

    def _pop_to(self, size: int) -> None:
        super()._pop_to(size)
        del self.path[len(self.blocks) + 1 :]
        self.joined = min(self.joined, len(self.blocks))

    def text(self, text: str) -> None:
        depth = len(self.blocks)
        while self.joined < depth:
            self.path[self.joined].content.append(self.path[self.joined + 1])
            self.joined += 1
        self.path[depth].content.append(text)

    def space(self) -> None:
        """A border between blocks, in the innermost block that has text."""
        self.path[self.joined].content.append(" ")


def page_tree(html: str) -> Block:
    """The block elements of a page that hold text, without those that never count."""
    tree = _Tree()
    for e in events(html):
        if e[0] == "text":
            if not tree.dropped:
                if e[1].isspace():
                    tree.space()
                else:
                    tree.text(entities.unescape(e[1]))  # a reference doesn't go on past its text node
            continue
        if e[0] == "break" or e[1] not in INLINE:
            tree.space()
        if e[0] == "open":
            tree.open(*e[1:])
        elif e[0] == "close":
            tree.close(e[1])
        if e[0] != "break" and e[1] not in INLINE:
            tree.space()
    return tree.path[0]


# A wrapper node: [label, optional, repeated, pages, slot, characters, children]; slot: "" no text, a hash of the only text, "*" texts differ.
LABEL, OPTIONAL, REPEATED, PAGES, SLOT, CHARACTERS, CHILDREN = range(7)


def _hash(text: str) -> str:
    return f"{zlib.crc32(text.encode()):08x}" if text else ""


def _walked(walk: Iterator):
    """What a walk returns that yields the walks whose results it needs: as deep as a page is, without recursion."""
    stack, value = [walk], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(inner)
            value = None
    return value


def wrapper_of(block: Block) -> list:
    """The wrapper of one page."""
    return _walked(_wrapper(block))


def _wrapper(block: Block):
    text = " ".join("".join(c for c in block.content if isinstance(c, str)).split())
    children: list[list] = []
    for b in block.blocks:
        c = yield _wrapper(b)
        if len(children) > APART and all(x[LABEL] == c[LABEL] for x in children[-APART - 1 :]):
            children[-1] = yield _together(children[-1], c)
        else:
            children.append(c)
    return [block.label, False, False, 1, _hash(text), len(text), children]


def align(known: list[str], new: list[str]) -> list[int | None]:
    """For each new label the place among the known ones that it meets: in order, or again what stands up to three places before."""
    out: list[int | None] = [None] * len(new)
    for i, k, n in SequenceMatcher(None, known, new, autojunk=False).get_matching_blocks():
        out[k : k + n] = range(i, i + n)
    last = None
    for k, label in enumerate(new):
        if out[k] is None and last is not None:
            out[k] = next((i for i in range(last, max(-1, last - 3), -1) if known[i] == label), None)
        last = last if out[k] is None else out[k]
    return out


def _together(a: list, b: list):
    """A walk to what a and b of one page are as a repeated node."""
    slot = "*" if "*" in (a[SLOT], b[SLOT]) else _hash(a[SLOT] + b[SLOT])
    children = [list(c) for c in a[CHILDREN]]
    for c, i in zip(b[CHILDREN], align([c[LABEL] for c in children], [c[LABEL] for c in b[CHILDREN]]), strict=True):
        if i is None:
            children.append([c[LABEL], True, *c[REPEATED:]])
        else:
            children[i] = yield _together(children[i], c)
    return [a[LABEL], a[OPTIONAL] or b[OPTIONAL], True, max(a[PAGES], b[PAGES]), slot, a[CHARACTERS] + b[CHARACTERS], children]


def merge(a: list, b: list) -> list:
    """The wrapper of what a and b match; both have one label."""
    return _walked(_merged(a, b))


def _merged(a: list, b: list):
    children, placed = list(a[CHILDREN]), align([c[LABEL] for c in a[CHILDREN]], [c[LABEL] for c in b[CHILDREN]])
    met: dict[int, list] = {}
    extra: list[tuple[int, list]] = []  # optional ones, with the place before which they stand
    last = -1
    for c, i in zip(b[CHILDREN], placed, strict=True):
        if i is None:
            extra.append((last + 1, [c[LABEL], True, *c[REPEATED:]]))
        else:
            met[i] = (yield _together(met[i], c)) if i in met else c
            last = i
    for i, c in enumerate(children):
        children[i] = (yield _merged(c, met[i])) if i in met else [c[LABEL], True, *c[REPEATED:]]
    for place, c in reversed(extra):
        children.insert(place, c)
    slot = a[SLOT] if a[SLOT] == b[SLOT] else "*"
    return [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[PAGES] + b[PAGES], slot, a[CHARACTERS] + b[CHARACTERS], children]


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags, for reading."""
    return _walked(_expression(node))


def _expression(node: list):
    parts = []
    for c in node[CHILDREN]:
        parts.append((yield _expression(c)))
    inner = ("#text " if node[SLOT] else "") + " ".join(parts)
    body = f"<{node[LABEL]}>{inner}</>" if node[LABEL] else inner
    return f"({body})" + ("*" if node[OPTIONAL] and node[REPEATED] else "+" if node[REPEATED] else "?") if node[OPTIONAL] or node[REPEATED] else body


def dumped(wrapper: list) -> str:
    """The wrapper as JSON: its nodes before their children, each with how many of these follow."""
    rows, stack = [], [wrapper]
    while stack:
        node = stack.pop()
        rows.append([*node[:CHILDREN], len(node[CHILDREN])])
        stack.extend(reversed(node[CHILDREN]))
    return json.dumps(rows)


def loaded(text: str) -> list:
    rows = json.loads(text)
    wrapper = [*rows[0][:CHILDREN], []]
    open_ = [(wrapper, rows[0][CHILDREN])]
    for *own, n in rows[1:]:
        while len(open_[-1][0][CHILDREN]) == open_[-1][1]:
            open_.pop()
        node = [*own, []]
        open_[-1][0][CHILDREN].append(node)
        open_.append((node, n))
    return wrapper


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _aside(label: str, inside_main: bool) -> bool:
    """Whether the names of an element speak against it; those of html and body never do, those of article and main only inside another one."""
    tag = _tag(label)
    return ".!" in label and tag not in ("html", "body") and (tag not in MAIN or inside_main)


class Guide:
    """What a wrapper says of its nodes: kept holds the ids of the containers, furniture those of template texts round them."""

    def __init__(self, wrapper: list):
        self.wrapper, self.kept, self.furniture, self.lifted = wrapper, set(), set(), set()
        self.pages = wrapper[PAGES]
        self.plain: dict[int, int] = {}  # varying characters by node, without those under names of boilerplate
        self.all: dict[int, int] = {}
        _walked(self._weigh(wrapper, False, False))
        trusted = self.pages == 1 or 10 * self.plain[id(wrapper)] >= self.all[id(wrapper)]  # one page alone can't speak against a name
        self.weight = self.plain if trusted else self.all
        for tag in MAIN:
            found = self._tagged(wrapper, tag, not trusted)
            if found:
                for node, above in found:
                    self.kept.add(id(node))
                    while above:
                        node, above = above
                        self.lifted.add(id(node))
                self.lifted |= self.kept
                return
        self._descend()

    def _weigh(self, node: list, aside: bool, inside: bool):
        aside = aside or _aside(node[LABEL], inside)
        inside = inside or _tag(node[LABEL]) in MAIN
        own = node[CHARACTERS] if node[SLOT] == "*" or self.pages == 1 else 0
        plain, every = 0 if aside else own, own
        for c in node[CHILDREN]:
            yield self._weigh(c, aside, inside)
            plain, every = plain + self.plain[id(c)], every + self.all[id(c)]
        self.plain[id(node)], self.all[id(node)] = plain, every

    def _tagged(self, wrapper: list, tag: str, lifted: bool) -> list[tuple]:
        """The outermost nodes of a tag that hold text, each with a chain of its ancestors; not those under names of boilerplate, unless these are lifted."""
        found, stack = [], [(wrapper, ())]
        while stack:
            node, above = stack.pop()
            if _aside(node[LABEL], False) and not lifted:
                continue
            if _tag(node[LABEL]) == tag:
                found.append((node, above))
            else:
                stack.extend((c, (node, above)) for c in node[CHILDREN])
        return found

    def _descend(self) -> None:
        """Without article or main: down to the node that holds nearly all varying text."""
        node, path, weight = self.wrapper, [self.wrapper], self.weight
        while node[CHILDREN]:
            best = max(node[CHILDREN], key=lambda c: weight[id(c)])
            if _tag(best[LABEL]) in PARAGRAPHS or best[REPEATED] or not weight[id(best)] or 10 * weight[id(best)] < 8 * weight[id(node)]:
                break
            node = best
            path.append(node)
        self.kept.add(id(node))
        if weight is self.all:
            self.lifted.update(map(id, path))
        for above in path[:-1]:
            self.kept.update(id(c) for c in above[CHILDREN] if _tag(c[LABEL]) == "h1" and weight[id(c)])
        if _tag(node[LABEL]) in ("", "html", "body") and self.pages >= LEAST_PAGES:
            varying = [i for i, c in enumerate(node[CHILDREN]) if weight[id(c)]]
            if varying:
                outside = node[CHILDREN][: varying[0]] + node[CHILDREN][varying[-1] + 1 :]
                self.furniture.update(id(c) for c in outside if c[PAGES] == self.pages and not c[REPEATED] and _tag(c[LABEL]) not in PARAGRAPHS)


def _gather(block: Block, node: list | None, guide: Guide, keep: bool, inside: bool, out: list[str], lost: list[int]):
    """A walk that adds the texts of a block that meets a wrapper node: what is in a container and not under a name of boilerplate.

    A block without a node is one that the wrapper has no place for. Its article and main are containers of their own; what else it
    holds is counted in lost.
    """
    if node is not None and id(node) in guide.furniture:
        return
    if _aside(block.label, inside) and not (node is not None and id(node) in guide.lifted):
        return
    keep = keep or (id(node) in guide.kept if node is not None else _tag(block.label) in MAIN)
    inside = inside or keep and _tag(block.label) in MAIN
    blocks, known = block.blocks, node[CHILDREN] if node is not None else []
    places = iter(align([c[LABEL] for c in known], [b.label for b in blocks]))
    for c in block.content:
        if isinstance(c, Block):
            i = next(places)
            out.append(" ")
            yield _gather(c, None if i is None else known[i], guide, keep, inside, out, lost)
            out.append(" ")
        elif keep:
            out.append(c)
        elif node is None:
            lost[0] += len(c.strip())


def extract(html: str, guide: Guide | None = None) -> str:
    """The main text of a page by its host's wrapper; by the wrapper of the page alone, where there is none, and where more text stands in
    blocks that the wrapper has no place for than in its containers."""
    page = page_tree(html)
    for g in (guide, None):
        own = g is None
        g = g or Guide(wrapper_of(page))
        out, lost = [], [0]
        _walked(_gather(page, g.wrapper, g, False, False, out, lost))
        text = " ".join("".join(out).split())
        if own or not page.content or text and lost[0] <= len(text):
            return text
    return ""


def host(url) -> object:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(host, wrapper): the merged tree of all pages of each host, as JSON; from pages (host, html)."""

    def first(batches):
        held: dict[str, list] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(map(dumped, held.values()), pa.string())], names=["host", "wrapper"])
            held.clear()
            return out

        for batch in pieces(batches, "html"):
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                new = wrapper_of(page_tree(html or ""))
                held[name] = merge(held[name], new) if name in held else new
            if len(held) > HELD_HOSTS:
                yield rows()
        yield rows()

    found = pages.select("host", "html").mapInArrow(first, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int"))
    for keys in (["host", "salt"], ["host"]):
        in_order = found.select("host", "salt", "wrapper").repartition(*keys).sortWithinPartitions(*keys, "wrapper")
        found = in_order.mapInArrow(lambda batches, keys=keys: _by_group(batches, keys), "host string, salt int, wrapper string")
    return found.select("host", "wrapper")


def _by_group(batches, keys: list[str]):
    """Merges the wrappers of each key; a key's rows follow each other in a task, and one wrapper is held at a time."""
    last, tree = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([last[-1] if len(keys) > 1 else 0], pa.int32()), pa.array([dumped(tree)], pa.string())], names=["host", "salt", "wrapper"])
    for batch in batches:
        for *key, value in zip(*(batch.column(c).to_pylist() for c in (*keys, "wrapper")), strict=True):
            if key == last:
                tree = merge(tree, loaded(value))
            else:
                if last is not None:
                    yield row()
                last, tree = key, loaded(value)
    if last is not None:
        yield row()


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null html counts as empty and has the text ''. Rows without a url, or with one that names no host, share a wrapper.
    Each row is extracted on its own, so repeated rows give repeated results; other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    found = written(wrappers(rows).withColumnRenamed("wrapper", "json"))
    size = found.agg(F.coalesce(F.sum(F.length("json") + 64), F.lit(0))).first()[0]

    def texts(batches):
        guides: dict[str | None, Guide | None] = {None: None}
        for batch in pieces(batches, "html"):
            out = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("json").to_pylist(), strict=True):
                if wrapper not in guides:
                    if len(guides) > HELD_HOSTS:
                        guides = {None: None}
                    guides[wrapper] = Guide(loaded(wrapper))
                out.append(extract(page or "", guides[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= WRAPPER_MB << 20:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(16)).cast("int")).join(found.withColumn("salt", salts), ["host", "salt"], "left")
    return joined.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "json").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
