"""Main text of web pages by consensus of each host's pages on where it stands.

First every page names the container that holds its text: the deepest one with all of its article, or, on a page without one, with most of the
page's prose outside of boilerplate. It is named by a generalised path, the tags and classes from the body down with digits masked. The paths are counted
per host in Spark, and then each page is read again: its text is what stands in its host's most frequent path that holds all of the page's article (on a page
without one, all of its prose), or in the page's own container if that does. If no container does, its text is all prose outside of boilerplate.

Boilerplate (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) is told by tags and by words in classes, ids and roles.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import free_name, table, written
from tallyloom.llm.url_filter import host_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: What stands in these is never text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object select option audio video canvas head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center dd div fieldset main section td".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog button".split())
#: Whole words of classes, ids and roles that mark boilerplate.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|newsletters?|subscribe|subscription|signup|sidebars?|side|menus?"
    r"|nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|topbar|comments?|disqus|repl(?:y|ies)|responses?|share|sharing|social|related|recommend(?:ed|ations?)?|widgets?|popups?|modal|overlay"
    r"|login|search|searchbox|pagination|pager|copyright|legal|complementary|contentinfo|tracking)(?:$|[\s_-])",
    re.I,
)
#: Within an article other words say what a part is about; only these, and roles, still mark boilerplate there.
WITHIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsored|cookies?|consent|gdpr|notices?|newsletters?|subscribe|sidebars?|navbar|breadcrumbs?|comments?|disqus|share|sharing|pagination)(?:$|[\s_-])", re.I
)
#: A container is a page's, and its article and main elements are its article, if they have this part of the page's prose.
MOST = 0.6
#: Characters from which on a path is shortened.
LONGEST = 400


class Block:
    __slots__ = ("parts", "linked", "boilerplate", "node", "article")

    def __init__(self, boilerplate: bool, node: int, article: bool = False) -> None:
        self.parts: list[str] = []
        self.linked, self.boilerplate, self.node, self.article = 0, boilerplate, node, article

    def text(self) -> str:
        whole = "".join(self.parts)
        return " ".join((entities.unescape(whole) if "&" in whole else whole).split())


def _step(tag: str, attributes: str, article: bool) -> tuple[str, bool]:
    """The generalised name of an element, and whether its tag, class, id or role marks boilerplate."""
    if not attributes or "=" not in attributes:
        return tag, tag in BOILERPLATE_TAGS
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    name = tag + "".join("." + c for c in sorted(set(found.get("class", "").lower().split())))
    if "id" in found:
        name += "#" + found["id"].lower()
    marked = tag in BOILERPLATE_TAGS or tag not in ("body", "html", "article", "main") and any((BOILERPLATE if k == "role" or not article else WITHIN).search(v) for k, v in found.items())
    return re.sub(r"\d+", "0", name), marked


class Page:
    """The blocks of text of a page in order, and its containers: each one's path, depth and the one around it (-1: none), which comes before it."""

    def __init__(self, page: str) -> None:
        self.path: list[str] = []
        self.depth: list[int] = []
        self.above: list[int] = []
        self.blocks = self._read(page)

    def _container(self, above: int, name: str) -> int:
        """A new container. Paths that would get long name what is far up by a digest, so that deep nesting costs no more than its depth."""
        up = self.path[above] if above >= 0 else ""
        if len(up) > LONGEST:
            up = "#" + hashlib.blake2b(up.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        self.path.append(f"{up}/{name}")
        self.depth.append(self.depth[above] + 1 if above >= 0 else 0)
        self.above.append(above)
        return len(self.path) - 1

    def under(self, weights: list[float]) -> defaultdict[str, float]:
        """The sum of the blocks' weights under each path."""
        sums = [0.0] * len(self.path)
        for block, weight in zip(self.blocks, weights, strict=True):
            if block.node >= 0:
                sums[block.node] += weight
        found: defaultdict[str, float] = defaultdict(float)
        for node in range(len(sums) - 1, -1, -1):
            if self.above[node] >= 0:
                sums[self.above[node]] += sums[node]
            found[self.path[node]] += sums[node]
        return found

    def inside(self, path: str) -> list[bool]:
        """Whether each block stands under path."""
        within: list[bool] = []
        for name, above in zip(self.path, self.above, strict=True):
            within.append(name == path or (above >= 0 and within[above]))
        return [b.node >= 0 and within[b.node] for b in self.blocks]

    def _read(self, page: str) -> list[Block]:
        return _blocks(page, self._container)


def _blocks(page: str, container: Callable[[int, str], int]) -> list[Block]:
    """The blocks of text of a page in order, each with its container and whether it stands in boilerplate."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, boilerplate, container, in an article
    now, links, at, size = Block(False, -1), 0, 0, len(page)
    opened: Counter[str] = Counter()

    def close() -> None:
        nonlocal now
        if now.parts:
            found.append(now)
        now = Block(*stack[-1][1:4]) if stack else Block(False, -1)

    while at < size:
        token = TOKEN.search(page, at)
        stop = token.start() if token else size
        if stop > at:
            now.parts.append(page[at:stop])
            if links:
                now.linked += stop - at
        if not token:
            break
        at = token.end()
        end, tag, attributes = token[1] or token[4], token[2] or token[5], token[3] or token[6]
        if tag is None or page[at - 1] != ">":
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            now.parts.append(" ")
        elif tag in RAW and not end:
            if attributes and attributes.endswith("/"):
                continue
            last = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "head" and not last:
                last = re.compile(r"(?=<body\b)", re.I).search(page, at)
            at = last.end() if last else size
            if tag in ("title", "textarea", "head"):
                close()
        elif tag in BLOCKS:
            if end:
                while opened[tag]:  # those within end with it
                    last_tag = stack.pop()[0]
                    opened[last_tag] -= 1
                    if last_tag == tag:
                        break
                links = 0
                close()
            elif tag in EMPTY:
                close()
            else:
                while stack and stack[-1][0] == "p" or stack and tag == stack[-1][0] and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                    opened[stack.pop()[0]] -= 1  # their end tags may be left out
                _, under, node, article = stack[-1] if stack else ("", False, -1, False)
                name, marked = _step(tag, attributes or "", article)
                if tag == "header" and not opened["article"] and not opened["main"]:
                    marked = True
                node = container(node, name) if tag in CONTAINERS else node
                stack.append((tag, under or marked, node, article or tag in ("article", "main")))
                opened[tag] += 1
                close()
    close()
    return found


def _weight(block: Block) -> float:
    return max(0, len(block.text()) - 2 * block.linked)


def needed(page: Page) -> tuple[list[bool], list[float], bool]:
    """Which blocks a page's text must have, each block's prose, and whether they are those of an article: what stands in article and main elements if most prose does, else all prose. Nothing of boilerplate."""
    prose = [0.0 if b.boilerplate else _weight(b) for b in page.blocks]
    total, inside = sum(prose), sum(w for b, w in zip(page.blocks, prose, strict=True) if b.article)
    if total and inside >= MOST * total:
        return [b.article and not b.boilerplate and bool(b.text()) for b in page.blocks], prose, True
    return [w > 0 for w in prose], prose, False


def covering(page: Page, paths: list[str]) -> list[str]:
    """Those of paths under which all blocks stand that the page's text must have."""
    must = needed(page)[0]
    held = page.under(must)
    return [p for p in paths if p and any(must) and held.get(p, 0) == sum(must)]


def own_path(page: Page) -> tuple[str, float]:
    """The path of the deepest container with all of a page's article, or, without one, with most of its prose; and its share of the prose. Of several as deep, the one with most."""
    must, prose, article = needed(page)
    total, held = sum(prose), page.under(prose)
    depth = dict(zip(page.path, page.depth, strict=True))
    able = covering(page, list(held)) if article else [p for p, x in held.items() if total and x >= MOST * total]
    best = max(able, key=lambda p: (depth[p], held[p], p), default="")
    return best, held[best] / total if best else 0.0


def text_at(page: Page, paths: list[str]) -> str:
    """The text under the first of paths that the page has prose in; all prose outside of boilerplate, if in none."""
    for path in paths:
        if path and (texts := [t for b, within in zip(page.blocks, page.inside(path), strict=True) if within and not b.boilerplate and (t := b.text())]):
            return "\n".join(texts)
    return "\n".join(t for b in page.blocks if not b.boilerplate and (t := b.text()))


def votes(pages: DataFrame, html: str = "html", host: str = "_host") -> DataFrame:
    """host, path and how many of its pages named the path: n."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [own_path(Page(page or ""))[0] for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string())], names=["host", "path"])

    named = pages.select(F.coalesce(F.col(host), F.lit("")), html).mapInArrow(name, "host string, path string")
    return named.where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))


#: Hosts up to which their paths are broadcast; with more, they are joined by a shuffle, where adaptive execution splits hot hosts.
BROADCAST_HOSTS = 20_000
#: Paths of a host that are tried, the most frequent first; a page that none of them holds is read by its own path.
RANKED = 5


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """pages with the main text of each page in out; a column of that name is replaced.

    Null and empty pages, and those without prose, give an empty text. Pages without a url are one host. A host's RANKED most frequent paths are tried in
    turn, ties in order of the path; then the page's own. One that leaves out a part of the page's article is passed over, so that every page is read whole.
    """
    pages = pages.drop(out)
    host, listed, of = (free_name(pages, n) for n in ("_host", "_paths", "_of"))
    keyed = pages.withColumn(host, host_of(F.col(url)))
    best = Window.partitionBy("host").orderBy(F.desc("n"), "path")
    ranked = votes(keyed, html, host).withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= RANKED)
    ranked = written(ranked.groupBy(F.col("host").alias(of)).agg(F.sort_array(F.collect_list(F.struct("_nth", "path"))).getField("path").alias(listed)), "host-paths")
    small = ranked.count() <= BROADCAST_HOSTS
    joined = keyed.join(F.broadcast(ranked) if small else ranked, F.col(host) == F.col(of), "left").drop(host, of)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])
    columns, place = pages.columns, pages.columns.index(html)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column(place).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                found = Page(page or "")
                texts.append(text_at(found, covering(found, [*(paths or []), own_path(found)[0]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*columns, out])

    return joined.select(*pages.columns, listed).mapInArrow(read, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
