"""HTML extraction by wrapper induction.

A page becomes a tree of block elements, in which runs of like siblings are one repeated node. The trees of a few
pages of its host are aligned with it by simple tree matching. A node whose text is the same in the aligned pages is
template, a node whose text varies is a slot. Slots are content unless their element plays another part: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are told by their element
names and classes, because their text may vary as well. A repeated node is template where all its texts are the same.
A marked article is evidence, not a source of its own: its prose is template only where every mate has the same, and it
decides alone only for pages that have too few mates to be aligned with.
A page that is mostly the same as another (a copy) says nothing about the template and is passed over.

A host offers the outlines of a few pages: of its layouts in turn, and of each layout pages whose longest text differs, so
that a group of copies, whatever its size, takes one place while there are others. They travel as outlines with hashed texts. They meet the pages by a sort-merge join on the
host, whose large partitions Spark splits, so a host with a third of all pages is no single task. Where a host has more to offer than that, its pages
are told apart by layout first and get the outlines of their own layout as well, so no layout goes without mates, however many a host has.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import whole, written

MATES = 3
POOL = 8  # outlines that a host, and each layout of a host with more, offers to its pages: each takes the first `MATES` that are no copies of it, its own layout first
AGREE = 2  # so many mates must have a node's text for it to be template
COPY_SHARE = 0.5  # a mate that has more of a page's text than this is a copy of it

# Element names of HTML, and the words that mark an element's part in its class, id or role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = set("head script style noscript template nav header footer aside form button select textarea option input iframe object svg canvas dialog menu title".split())
PARTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus reply replies form login search pagination pager toolbar skip alert contentinfo complementary".split())
STATES = set("has have no not non with without is in on show hide hidden open closed after before below above under over for".split())
CLOSED_BY_BLOCK = {"p"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
LISTS = {"ul", "ol", "dl", "table", "tbody", "thead", "article", "section", "div", "body", "html"}
SPACES = re.compile(r"\s+")


def names_part(token: str) -> bool:
    """Whether a class names a part itself (sidebar, page-footer), not a state or a relation (has-sidebar, header-fixed)."""
    if token in PARTS:
        return True
    found = [x for x in re.split("[-_]+", token) if x]
    return len(found) > 1 and found[-1] in PARTS and not set(found) & STATES


class Block:
    __slots__ = ("tag", "sign", "items", "skip", "article", "may_hold")

    def __init__(self, tag: str, sign: str, skip: bool, article: bool):
        self.tag, self.sign, self.skip, self.article = tag, sign, skip, article
        self.items: list = []  # texts and blocks in page order
        self.may_hold = True  # skipped by its class alone, or as a form: it may still be what holds the page's text


class Page(HTMLParser):
    """A forgiving reader: unknown end tags are passed over, open paragraphs end where a block begins."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Block("", "", False, False)
        self.open = [self.root]
        self.text: list[str] = []
        self.inline_skip: list[str] = []
        self.feed(html)
        self.close()
        self._flush()
        self._settle()

    def _flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if text:
            self.open[-1].items.append(text)

    def _settle(self) -> None:
        """Skipping: a block that holds most of the page's text, while no article stands elsewhere, is no part beside it."""
        order = [self.root]
        for block in order:
            order += [x for x in block.items if isinstance(x, Block) and (x.may_hold or not x.skip)]
        size, articles = {}, {}
        for block in reversed(order):
            size[id(block)] = sum(len(x) if isinstance(x, str) else size.get(id(x), 0) for x in block.items)
            own = sum(len(x) for x in block.items if isinstance(x, str)) if block.article else 0
            articles[id(block)] = own + sum(articles.get(id(x), 0) for x in block.items if isinstance(x, Block))
        for block in order:
            if block.skip and 2 * size[id(block)] > size[id(self.root)] and articles[id(block)] == articles[id(self.root)]:
                block.skip = False
        pending = [self.root]
        while pending:
            block = pending.pop()
            for x in block.items:
                if isinstance(x, Block):
                    x.skip = x.skip or block.skip
                    pending.append(x)

    def handle_data(self, data: str) -> None:
        if not self.inline_skip:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:  # <![CDATA[ ... ]]> outside of scripts: not text
        pass

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("br", "hr"):
            self.text.append(" ")
        if tag in VOID:
            return
        given = dict(attrs)
        hidden = "hidden" in given or given.get("aria-hidden") == "true"
        whole_page = tag in ("html", "body", "main") or (tag == "article" and not self.open[-1].article)
        marked = not whole_page and any(names_part(x) for k in ("class", "id", "role") for x in (given.get(k) or "").lower().split())
        part = marked or hidden
        if tag in INLINE:
            if part or self.inline_skip:
                self.inline_skip.append(tag)
            return
        self._flush()
        self.inline_skip.clear()
        while len(self.open) > 1 and self.open[-1].tag in CLOSED_BY_BLOCK:
            self.open.pop()
        if tag in CLOSES:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in CLOSES[tag]:
                    del self.open[k:]
                    break
                if self.open[k].tag in LISTS:
                    break
        up = self.open[-1]
        is_article = (tag in ("article", "main") or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody") and not part
        own_header = tag == "header" and (up.article and not part)
        unseen = hidden or (tag in SKIPPED and tag != "form" and not own_header)
        block = Block(tag, f"{tag}.{given.get('class') or ''}", unseen or marked or tag == "form", up.article or is_article)
        block.may_hold = not unseen
        up.items.append(block)
        self.open.append(block)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            if tag in self.inline_skip:
                while self.inline_skip and self.inline_skip.pop() != tag:
                    pass
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._flush()
                self.inline_skip.clear()
                del self.open[k:]
                return


def hashed(text: str) -> int:
    return xxhash.xxh32_intdigest(text)


def outline(block: Block) -> list:
    """[sign, hashed texts, children], like neighbours folded into one repeated node; skipped blocks left out."""
    order = [block]
    for one in order:
        order += [x for x in one.items if isinstance(x, Block) and not x.skip]
    made: dict[int, list] = {}
    for one in reversed(order):
        children: list[list] = []
        for item in one.items:
            if isinstance(item, Block) and not item.skip:
                node = made.pop(id(item))
                if children and children[-1][0] == node[0] and not children[-1][2] and not node[2]:
                    children[-1][1] += node[1]
                else:
                    children.append(node)
        texts = [hashed(x) for x in one.items if isinstance(x, str)]
        made[id(one)] = [one.sign, texts, children]
    return made[id(block)]


def packed(root: list) -> str:
    """An outline as flat JSON: depth, sign and texts of its nodes in page order, however deep it is."""
    lines, pending = [], [(0, root)]
    while pending:
        depth, (sign, texts, children) = pending.pop()
        lines.append((depth, sign, texts))
        pending += [(depth + 1, c) for c in reversed(children)]
    return json.dumps(lines, separators=(",", ":"))


def unpacked(line: str) -> list:
    path: list[list] = []
    for depth, sign, texts in json.loads(line):
        node = [sign, texts, []]
        del path[depth:]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


def matched(a: list, b: list, cache: dict) -> int:
    """Simple tree matching: the most pairs of nodes that keep order and ancestry; 0 where the roots differ."""
    pending = [(a, b)] if a[0] == b[0] else []
    while pending:
        x, y = pending[-1]
        key = (id(x), id(y))
        below = [] if key in cache else [(c, d) for c in x[2] for d in y[2] if c[0] == d[0] and (id(c), id(d)) not in cache]
        pending += below
        if below:
            continue
        pending.pop()
        if key in cache:
            continue
        above = [0] * (len(y[2]) + 1)
        table = [above]
        for c in x[2]:
            row = [0]
            for j, d in enumerate(y[2]):
                row.append(max(above[j + 1], row[j], above[j] + (cache[(id(c), id(d))][0] if c[0] == d[0] else 0)))
            table.append(above := row)
        cache[key] = (above[-1] + 1, table)
    return cache[(id(a), id(b))][0] if a[0] == b[0] else 0


def shared_texts(a: list, b: list, cache: dict, out: set) -> None:
    """Hashes of the texts that aligned nodes have in common."""
    pending = [(a, b)] if matched(a, b, cache) else []
    while pending:
        x, y = pending.pop()
        if len(x[1]) == 1 or len(y[1]) == 1 or set(x[1]) == set(y[1]):  # not a repeated node, or one that doesn't vary
            out.update(set(x[1]) & set(y[1]))
        table = cache[(id(x), id(y))][1]
        i, j = len(x[2]), len(y[2])
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pending.append((x[2][i], y[2][j]))


def layout(node: list) -> int:
    """A hash of the signs of the upper levels, without numbers: alike for pages of one kind."""
    signs, level = set(), [node]
    for depth in range(4):
        signs |= {f"{depth} " + re.sub("[0-9]+", "", n[0]) for n in level}
        level = [c for n in level for c in n[2]]
    return hashed("\n".join(sorted(signs)))


def content(root: Block) -> list[tuple[str, bool]]:
    """The texts of all blocks that aren't skipped, and whether each is prose of a marked article."""
    texts, path = [], [(root, iter(root.items))]
    while path:
        block, items = path[-1]
        item = next(items, None)
        if item is None:
            path.pop()
        elif isinstance(item, Block):
            if not item.skip:
                path.append((item, iter(item.items)))
        elif not block.skip:
            texts.append((item, block.article and block.tag in PROSE))
    return texts


def extract(html: str, mates: list[list]) -> str:
    """The main text of a page, given the outlines of pages of its host."""
    root = Page(html).root
    texts = content(root)
    own, counts, used = outline(root), {}, 0
    size = sum(len(t) for t, _ in texts)
    kind = layout(own)
    for mate in sorted(mates, key=lambda m: layout(m) != kind):
        if used == MATES:
            break
        common: set[int] = set()
        shared_texts(own, mate, {}, common)
        if sum(len(t) for t, _ in texts if hashed(t) in common) <= COPY_SHARE * size:
            used += 1
            for h in common:
                counts[h] = counts.get(h, 0) + 1
    if used < AGREE:  # nothing to align with: an article with most of the text decides alone
        marked = [t for t, prose in texts if prose]
        return " ".join(marked if 2 * sum(map(len, marked)) > size else [t for t, _ in texts])
    # prose of a marked article is template only where every mate agrees
    return " ".join(t for t, prose in texts if counts.get(hashed(t), 0) < (max(used, AGREE + 1) if prose else AGREE))


def host(url: str) -> Column:
    """The host in lower case, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, page_id="page_id", url="url", html="html") -> DataFrame:
    """(page_id, url, text) for every row and whole html.

    Null and empty html give an empty text; a null url, or one without a host, has no mates. Repeated rows are
    extracted each; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"), whole(html).alias("html"))

    def outlined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, h, page in zip(batch["host"], batch["h"], batch["html"]):
                root = Page(page).root
                tree = outline(root)
                longest = max((t for t, _ in content(root)), key=len, default="")
                found.append((name, h, layout(tree), hashed(longest), packed(tree)))
            rows = pd.DataFrame(found, columns=["host", "h", "layout", "story", "outline"])
            # what cannot be among the first of its host is dropped at once: later copies and stories of later hashes
            rows = rows.sort_values(["story", "h", "outline"]).drop_duplicates(["host", "layout", "story", "outline"])
            rows = rows[rows.groupby(["host", "layout", "story"]).cumcount() < POOL]
            yield rows[rows.groupby(["host", "layout"])["story"].rank(method="dense") <= POOL]

    known = rows.where("host is not null and html <> ''").select("host", F.xxhash64("page_id", "html").alias("h"), "html")
    outlines = known.mapInPandas(outlined, "host string, h long, layout long, story long, outline string").repartition("host")
    copies = Window.partitionBy("host", "layout", "story", "outline").orderBy("h")
    stories = Window.partitionBy("host", "layout", "story").orderBy("h", "outline")
    layouts = Window.partitionBy("host", "layout").orderBy("copy", "story", "h", "outline")
    offered = Window.partitionBy("host").orderBy("turn", "layout")
    chosen = outlines.withColumn("same", F.row_number().over(copies)).where("same = 1").withColumn("copy", F.row_number().over(stories))
    chosen = chosen.withColumn("turn", F.row_number().over(layouts)).where(F.col("turn") <= POOL)
    chosen = chosen.withColumn("k", F.row_number().over(offered)).select("host", "layout", "turn", "k", "h", "outline")
    chosen = written(chosen, "page-mates")
    mates = chosen.where(F.col("k") <= POOL + 1).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "h", "outline"))).alias("mates"))
    rows = rows.withColumn("h", F.xxhash64("page_id", "html"))
    kind = pages.schema[page_id].dataType.simpleString()

    def others(mates: str) -> Column:
        found = F.transform(F.filter(mates, lambda m: m["h"] != F.col("h")), lambda m: m["outline"])
        return F.coalesce(F.slice(found, 1, POOL), F.array().cast("array<string>"))

    def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(layout=[layout(outline(Page(page).root)) for page in batch["html"]])

    crowded = chosen.where(F.col("k") > POOL + 1).select("host").distinct()  # hosts that have more to offer than their pages are given
    if crowded.isEmpty():
        asked = rows.join(mates.hint("merge"), "host", "left").select("page_id", "url", "html", others("mates").alias("mates"))
    else:
        asked = rows.join(crowded, "host", "left_anti").join(mates.hint("merge"), "host", "left").select("page_id", "url", "html", others("mates").alias("mates"))
        told = rows.join(crowded, "host", "left_semi").select("page_id", "url", "host", "h", "html")
        told = told.mapInPandas(laid_out, f"page_id {kind}, url string, host string, h long, html string, layout long")
        own = chosen.join(crowded, "host", "left_semi").groupBy("host", "layout").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "outline"))).alias("own"))
        told = told.join(own.hint("merge"), ["host", "layout"], "left").join(mates.hint("merge"), "host", "left")
        asked = asked.unionByName(told.select("page_id", "url", "html", F.array_distinct(F.concat(others("own"), others("mates"))).alias("mates")))

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = functools.lru_cache(maxsize=2_000)(unpacked)
        for batch in batches:
            texts = [extract(page, [read(x) for x in lines]) for page, lines in zip(batch["html"], batch["mates"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    return asked.mapInPandas(extracted, f"page_id {kind}, url string, text string")
