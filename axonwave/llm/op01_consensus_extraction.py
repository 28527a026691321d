"""HTML main-text extraction by consensus paths of hosts.

Each page's containers are scored (text they hold, less text in links, with a preference for
article and main elements), and the best one is named by its generalised path: tags and classes
from the root, digits and positions left out. Pages vote for paths by host in Spark, votes being combined before
the shuffle; the path with most votes wins. Pages are then parsed again and the text of
the containers at the host's winning path is taken; a page without such a container, or whose container there holds
little of what its own best one holds, uses its own.

Only (host, winning path) is joined to the pages: broadcast if its size allows, else a shuffled
join in which Spark splits hot hosts.

What counts as text: everything in the container but menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, known by tag, role, or a word of class or id; but a name alone does not drop the element that holds the
larger part of the page (spare()). Parsing and scoring are linear in a page's tags, whatever is left open and however deep. Character
references are decoded, white space (as str.split has it) in a block becomes one blank, blocks are joined by one blank.

Edge cases: null or empty html and pages without text give ""; a null url or one without a host
votes with the host ""; repeated pages vote as often as they occur; broken markup (open tags, open comments,
open quotes) is read to the end; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import small_side, table, written
from axonwave.llm.op07_url_reputation import url_parts

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body html".split())
DROP_TAG = frozenset("nav header footer aside form button script style noscript template textarea title iframe head select svg math object menu dialog input label".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of class and id that name what is not the article: those of parts that are never it, and those of layout, which themes also hang on its wrapper.
NEVER_WORD = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adbox|adsense|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"pagination|pager|paywall|breadcrumbs?|copyright)(?=$|[_-])",
    re.I,
)
#: Words of what readers have written.
READERS_WORD = re.compile(r"(?:^|[_-])(?:comments?|commentlist|respond|replies|disqus|reviews|feedback|discussions?|guestbook|reactions)(?=$|[_-])", re.I)
LAYOUT_WORD = re.compile(
    r"(?:^|[_-])(?:sidebar|side-bar|aside|nav|navbar|navigation|menu|header|masthead|topbar|footer|foot|share|sharing|social|related|recommended|widget|toolbar|form|login|search|skip|hidden)(?=$|[_-])",
    re.I,
)
#: A name that says whether a page has such a part, as no-sidebar or sidebar-layout, names none.
ABOUT = re.compile(r"^(?:\w+[_-]+)*(?:no|not|non|with|without|has|have|is|hide|show|under|below|above)[_-]|[_-](?:layout|offset|enabled|disabled|visible|open|page|template|off|on)$", re.I)
#: Reasons to drop an element, in rising strength.
KEEP, LAYOUT, NEVER, READERS, ALWAYS = range(5)
GOOD_WORD = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|body|text|main|prose)(?=$|[\s_-])", re.I)
LONG_TEXT = 400  #: characters that no advert or notice has
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first set is closed by a start tag of the second.
CLOSES = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}


def named(names: str) -> int:
    """What the words of class and id say of an element."""
    words = [w for w in names.split() if not ABOUT.search(w)]
    return READERS if any(map(READERS_WORD.search, words)) else NEVER if any(map(NEVER_WORD.search, words)) else LAYOUT if any(map(LAYOUT_WORD.search, words)) else KEEP


class Node:
    __slots__ = ("block", "children", "drop", "link", "parent", "step", "tag", "weight")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        names = " ".join(attrs.get(k) or "" for k in ("class", "id"))
        role = (attrs.get("role") or "").lower()
        if tag == "form":
            self.drop = LAYOUT
        elif tag in DROP_TAG or role in DROP_ROLE or "hidden" in attrs:
            self.drop = ALWAYS
        elif names and tag not in ("html", "body", "article", "main"):
            self.drop = named(names)
        else:
            self.drop = KEEP
        self.weight = 3.0 if tag == "article" or "articlebody" in (attrs.get("itemprop") or "").lower() else 2.0 if tag == "main" or role == "main" else 1.5 if GOOD_WORD.search(names) else 1.0
        classes = sorted(re.sub(r"\d+", "#", c) for c in (attrs.get("class") or "").split()) if attrs else ()
        self.step = ".".join([tag, *classes])
        self.link = tag == "a" or (parent is not None and parent.link)
        self.block = self if parent is None or tag in BLOCK or tag == "head" else parent.block  # the nearest element that is no inline one


def parse(page: str) -> Node:
    """A tree of Nodes and strings (decoded text); None marks a line break."""
    root = now = Node("html", {}, None)
    at, n, open_ = 0, len(page), Counter()
    unescape = _html.unescape

    def closed(last: Node) -> Node:
        """The element around last, which ends with all that is open in it."""
        up = now
        while up is not last.parent:
            open_[up.tag] -= 1
            up = up.parent
        return up

    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            text = page[at:cut]
            now.children.append(unescape(text) if "&" in text else text)
        if cut == n:
            break
        if page.startswith("<![CDATA[", cut):
            end = page.find("]]>", cut)
            now.children.append(page[cut + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        m = _TOKEN.match(page, cut)
        if m is None:
            now.children.append("<")
            at = cut + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "br":
                now.children.append(None)
            elif open_[tag] > 0 and tag != "body":
                up = now
                while up.tag != tag:
                    up = up.parent
                now = closed(up)
            continue
        attrs = {a[1].lower(): _html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(rest)} if rest.strip(" /\n\t") else {}
        if tag == "br":
            now.children.append(None)
            continue
        if tag == "html":
            continue
        while now is not root:
            # an open element, through open inline ones, may end here without a tag of its own
            if tag not in CLOSES.get(now.block.tag, ()):
                break
            now = closed(now.block)
        node = Node(tag, attrs, now)
        now.children.append(node)
        if tag in RAW and not (tag in ("svg", "math") and rest.endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in RAW and tag not in VOID and not (rest.endswith("/") and tag not in BLOCK and "href" not in attrs):
            now = node
            open_[tag] += 1
    spare(root)
    return root


def spare(root: Node) -> None:
    """Keeps an element that its names would drop, where it and not the rest of the page has the article.

    That is if it holds the larger part of the page's text outside links and headings: at least as much as what is not dropped, where it has an article,
    main or h1 element and the rest has none; else, where the rest has no article or main, twice as much and more than any advert. Where nothing else has text, names of
    layout drop nothing, others only what has no such element. What readers have written may be longer than the article and is kept in that case alone. What is dropped inside such an element stays so, unless the same holds again.
    """
    while True:
        kept, marked, sure, held, stack = 0, False, False, [], [(root, None, False)]
        text: dict[int, list] = {}
        while stack:
            node, inside, heading = stack.pop()
            if node.drop == ALWAYS:
                continue
            if inside is None and node.drop:
                inside = text[id(node)] = [0, False]
                held.append(node)
            if node.tag in ("article", "main", "h1"):
                if inside is None:
                    marked, sure = True, sure or node.tag != "h1"
                else:
                    inside[1] = True
            heading = heading or node.tag in HEADINGS
            for c in node.children:
                if isinstance(c, str):
                    size = 0 if heading or node.link or c.isspace() else len(c)
                    if inside is None:
                        kept += size
                    else:
                        inside[0] += size
                elif c is not None:
                    stack.append((c, inside, heading))
        again = False
        for node in held:
            size, has = text[id(node)]
            larger = has and not marked and size >= kept or not sure and size >= max(2 * kept, LONG_TEXT)
            alone = not kept and (node.drop == LAYOUT or has and not marked)
            if size and (alone or node.drop != READERS and larger):
                node.drop, again = KEEP, True
        if not again:
            return


def blocks(node: Node) -> list[str]:
    """The text blocks of a node without what is dropped."""
    out: list[str] = []
    run: list[str] = []

    def close():
        if run:
            if text := " ".join("".join(run).split()):
                out.append(text)
            run.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        top, i = stack.pop()
        if i == 0 and top.tag in BLOCK:
            close()
        children = top.children
        while i < len(children):
            c = children[i]
            i += 1
            if c is None:
                run.append(" ")
            elif isinstance(c, str):
                run.append(c)
            elif not c.drop:
                stack.append((top, i))
                stack.append((c, 0))
                break
            elif c.tag in BLOCK:
                close()
        else:
            if top.tag in BLOCK:
                close()
    close()
    return out


def containers(root: Node) -> list[tuple[float, Node]]:
    """(score, node) of every container that has a share in some text, in page order.

    A block's text counts in full for the nearest container, in part for those above, as far as the share matters; text in links counts against.
    """
    score: dict[int, float] = {}
    order: list[Node] = []
    above: dict[int, Node | None] = {}  # the container around each
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, box = stack.pop()
        if node.tag in CONTAINER:
            order.append(node)
            above[id(node)], box = box, node
        for c in reversed(node.children):
            if c is None:
                continue
            if isinstance(c, str):
                size = len(c) - c.count(" ") if not c.isspace() else 0
                if size:
                    up, share = box, 1.0
                    gain = -size if node.link else size
                    while up is not None and share > 0.2:
                        score[id(up)] = score.get(id(up), 0.0) + gain * share
                        share *= 0.9
                        up = above[id(up)]
            elif not c.drop:
                stack.append((c, box))
    return [(score[id(x)] * x.weight, x) for x in order if score.get(id(x), 0.0) > 0]


def at_path(root: Node, path: str) -> list[Node]:
    """The elements at a generalised path, in page order; only the path's own branches are entered."""
    out, stack = [], [(root, 0)]
    while stack:
        node, at = stack.pop()
        if not path.startswith(node.step, at):
            continue
        end = at + len(node.step)
        if end == len(path):
            out.append(node)
        elif path[end] == ">":
            stack += [(c, end + 1) for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return out


def widened(node: Node) -> Node:
    """node, or an ancestor that adds headings only."""
    while node.parent is not None and node.tag not in ("article", "main", "body"):
        for c in node.parent.children:
            if c is None or c is node:
                continue
            if isinstance(c, str):
                if not c.isspace():
                    return node
            elif not c.drop and not re.fullmatch("h[1-6]|hr", c.tag) and blocks(c):
                return node
        node = node.parent
    return node


def path_of(node: Node) -> str:
    steps = []
    while node is not None:
        steps.append(node.step)
        node = node.parent
    return ">".join(reversed(steps))


def best_container(root: Node) -> tuple[str, Node | None]:
    found = containers(root)
    if not found:
        return "", None
    best = widened(max(found, key=lambda x: x[0])[1])
    return path_of(best), best


def main_text(page: str | None, winning: str | None, least_share: float = 0.5) -> str:
    """The main text of a page, given its host's winning path."""
    if not page:
        return ""
    root = parse(page)
    own, best = best_container(root)
    if best is None:
        return ""
    at = lambda path: " ".join(t for x in at_path(root, path) for t in blocks(x))
    text = at(own)
    if winning and own != winning:
        voted = at(winning)
        if voted and len(voted) >= least_share * len(text):
            return voted
    return text


def page_votes(pages: DataFrame) -> DataFrame:
    """host, path: the generalised path of each page's best container."""

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            hosts, paths = [], []
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = best_container(parse(page.as_py() or ""))[0]
                if path:
                    hosts.append(h)
                    paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    return pages.select(url_parts(F.col("url"))[0].alias("host"), "html").mapInArrow(rows, "host string, path string")


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes, of: for each host the path with most votes (the first in order on ties)."""
    counts = page_votes(pages).groupBy("host", "path").agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct("path", "votes"), F.struct((-F.col("votes")).alias("v"), F.col("path")))
    return counts.groupBy("host").agg(best.alias("b"), F.sum("votes").alias("of")).select("host", "b.path", "b.votes", "of")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    won = written(winning_paths(pages).select("host", F.col("path").alias("_path")), "paths")
    joined = pages.select("page_id", "url", "html", url_parts(F.col("url"))[0].alias("host")).join(small_side(won), "host", "left").select("page_id", "url", "html", "_path")

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(p.as_py(), w) for p, w in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(rows, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
