"""Main text of web pages, with the host's recurring subtrees removed.

Pages are parsed up to three times.  The first pass hashes the element
subtrees that could be page furniture; Spark counts each hash's pages per host.
The second, over hosts where some recur, asks what a page has besides them: a
recurring subtree is a template if it stands beside many different texts, and
copied content if it doesn't.  The last drops furniture by element and name,
then the templates, and returns the blocks of what is left.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import table, written

#: A comment, a declaration, or a tag: a quote opens a value only after "=", and a tag whose value isn't closed ends at the next ">".
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Elements of the HTML standard by their role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body html dd dt li td th tr caption tbody thead tfoot legend summary figcaption".split())
#: Elements that never hold main text.
DROPPED = set("head script style noscript template nav footer aside form button select textarea input iframe object embed svg math canvas audio video dialog menu title noembed noframes xmp datalist".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id names of page furniture.
NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended widget toolbar pagination pager masthead skip outbrain taboola".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


#: An opening tag that ends an open element of these tags, looking up the stack no farther than the given ones.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: An end tag doesn't reach through these to find its start.
WALLS = set("article aside body div footer form header html main nav section table td th".split())


def parse(text: str) -> Node:
    """Element tree of a page, however broken: unclosed elements end with the element around them, stray end tags are ignored."""
    root = Node("#root", {})
    stack, pos, n = [root], 0, len(text)
    last = text.rfind(">")  # no tag begins after it, so none is sought in vain at each "<"

    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag

    def close(tags: set[str], walls: set[str]) -> None:
        k = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if k and not any(places[w][-1] > k for w in walls if places.get(w)):
            while len(stack) > k:
                places[stack.pop().tag].pop()

    while pos < n:
        m = TOKEN.search(text, pos) if pos <= last or text.find("<!--", pos) >= 0 else None
        if not m:
            stack[-1].kids.append(html.unescape(text[pos:]))
            break
        if m.start() > pos:
            stack[-1].kids.append(html.unescape(text[pos : m.start()]))
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            # a block's end tag ends inline elements and blocks left open inside it
            close({tag}, WALLS - {tag} if tag not in WALLS else {"html"} - {tag})
            continue
        if tag in CLOSES_P:
            close({"p"}, WALLS)
        if tag in ENDS:
            close(*ENDS[tag])
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTR.findall(m[3] or m[6] or "")}
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(text, pos)
            node.kids.append(text[pos : end.start() if end else n])
            pos = end.end() if end else n
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def named(node: Node, by_words: bool = True) -> bool:
    """Furniture by role, visibility, or (if asked) a word of its class or id."""
    a = node.attrs
    if not a:
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    return by_words and any(w in NAMES for w in re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))


def subtree_hashes(root: Node) -> dict[int, int]:
    """64-bit hash of every element's subtree (tag, class, id, text), by id() of the node."""
    order = list(_walk(root))
    out: dict[int, int] = {}
    for x in reversed(order):
        h = hashlib.blake2b(f"{x.tag}\x00{x.attrs.get('class', '')}\x00{x.attrs.get('id', '')}".encode("utf-8", "surrogatepass"), digest_size=8)
        for k in x.kids:
            if isinstance(k, Node):
                h.update(b"\x01" + out[id(k)].to_bytes(8, "little", signed=True))
            elif s := " ".join(k.split()):
                h.update(b"\x02" + s.encode("utf-8", "surrogatepass"))
        out[id(x)] = int.from_bytes(h.digest(), "little", signed=True)
    return out


def _holds(x: Node, tag: str) -> bool:
    return x.tag == tag or tag == "main" and x.attrs.get("role", "").lower() == "main"


def _sizes(root: Node) -> dict[int, int]:
    """Characters of each node's text, without links and elements that never hold main text, by id()."""
    out: dict[int, int] = {}
    for x in reversed(list(_walk(root))):
        out[id(x)] = 0 if x.tag in DROPPED or x.tag == "a" else sum(out[id(k)] if isinstance(k, Node) else len(k.strip()) for k in x.kids)
    return out


def _tops(root: Node, tag: str) -> list[Node]:
    """Outermost elements of a kind."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if _holds(x, tag):
            out.append(x)
        else:
            todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))
    return out


def _above(root: Node, nodes: list[Node]) -> set[int]:
    """The nodes and their ancestors."""
    up = {id(k): x for x in _walk(root) for k in x.kids if isinstance(k, Node)}
    out: set[int] = set()
    for x in nodes:
        while x is not None and id(x) not in out:
            out.add(id(x))
            x = up.get(id(x))
    return out


def trimmed(root: Node) -> Node:
    """Removes furniture by element and name; page headers go, headers inside an article stay.

    Words of names don't concern the main element, an article with half of the
    page's text, and what is around them.
    """
    size = _sizes(root)
    spare = _above(root, _tops(root, "main") + [x for x in _tops(root, "article") if 2 * size[id(x)] >= size[id(root)]])
    todo = [(root, False)]
    while todo:
        x, article = todo.pop()
        article = article or x.tag == "article"
        x.kids = [k for k in x.kids if not isinstance(k, Node) or k.tag not in DROPPED and not (k.tag == "header" and not article) and (k.tag in ("html", "body") or not named(k, id(k) not in spare))]
        todo.extend((k, article) for k in x.kids if isinstance(k, Node))
    return root


def holder(root: Node) -> str:
    """The elements that hold the main text: articles with half of the text of main (or else of the page), or else main, or none."""
    size = _sizes(root)
    total = lambda nodes: sum(size[id(x)] for x in nodes)
    articles, mains = _tops(root, "article"), _tops(root, "main")
    if articles and 2 * total(articles) >= (total(mains) if mains else size[id(root)]):
        return "article"
    return "main" if mains else ""


#: Elements that structure a text and recur in different ones (a heading, a cell): inside an article they go with the box around them, never alone.
PARTS = set("h1 h2 h3 h4 h5 h6 hgroup header li dt dd tr td th thead tbody tfoot caption figcaption legend summary".split())
#: Least share of a page's text that recurs nowhere, for the page to say what is a template; a page with less is a copy.
OWN = 0.25


def _removable(root: Node) -> list[Node]:
    """Nodes that removal may concern: inside the articles or the main element, whose surroundings are never printed, or else anywhere."""
    tag = holder(root)
    holders = _tops(root, tag) if tag else []
    if not tag:
        return [x for x in _walk(root) if x.kids and x.tag in BLOCK and x.tag not in ("html", "body")]
    # the only holder of a page stays; of several, one may recur like any box
    return [x for h in holders for x in _walk(h) if x.kids and x.tag in BLOCK and x.tag not in PARTS and (x is not h or len(holders) > 1)]


def candidates(text: str) -> list[int]:
    """Hashes of the subtrees that removal may concern, each once."""
    root = trimmed(parse(text))
    hashes = subtree_hashes(root)
    return sorted({hashes[id(x)] for x in _removable(root)})


def votes(text: str, recurring: set[int]) -> tuple[list[int], int]:
    """Recurring subtrees of a page and a hash of its own text; none if too little of the text is its own."""
    mine = sorted(recurring.intersection(candidates(text)))
    if not mine:
        return [], 0
    own = main_text(text, recurring)
    if not own or len(own) < OWN * len(main_text(text, set())):
        return [], 0
    return mine, int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(text: str, templates: set[int]) -> str:
    """Blocks of the main text, joined by line ends."""
    root = trimmed(parse(text))
    kind = holder(root)
    if templates:
        hashes = subtree_hashes(root)
        gone = {id(x) for x in _removable(root) if hashes[id(x)] in templates}
        for x in list(_walk(root)):
            x.kids = [k for k in x.kids if not isinstance(k, Node) or id(k) not in gone]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if s := " ".join("".join(line).split()):
            blocks.append(s)
        line.clear()

    # with a holder, text outside of it is no main text
    todo: list = [(root, not kind)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if inside:
                line.append(x)
        else:
            if x.tag == "br":
                line.append(" ")
            inside = inside or _holds(x, kind)
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append((None, inside))
            todo.extend((k, inside) for k in reversed(x.kids))
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host of an address, without user, port or www; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)), F.lit(""))


def candidates_udf():
    """Arrow UDF: page to the hashes of candidates()."""

    @F.arrow_udf("array<bigint>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([candidates(x.as_py() or "") for x in part], pa.list_(pa.int64()))

    return run


def main_text_udf():
    """Arrow UDF: page and its host's templates to main_text()."""

    @F.arrow_udf("string")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, recurring in parts:
            yield pa.array([main_text(p.as_py() or "", set(t.as_py() or ())) for p, t in zip(pages, recurring)], pa.string())

    return run


def votes_udf():
    """Arrow UDF: page and its host's recurring subtrees to votes()."""

    @F.arrow_udf("struct<hashes:array<bigint>,own:bigint>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, recurring in parts:
            rows = [votes(p.as_py() or "", set(r.as_py() or ())) for p, r in zip(pages, recurring)]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int64())], names=["hashes", "own"])

    return run


#: Rows of (host, array) that are broadcast at most, and hashes in them.
BROADCAST_ROWS, BROADCAST_HASHES = 50_000, 500_000


def recurring(pages: DataFrame, least_pages: int = 5, least_share: float = 0.3) -> DataFrame:
    """host, templates: hashes of subtrees on at least ``least_pages`` pages and ``least_share`` of the host's pages."""
    at = pages.select(host_of(F.col("url")).alias("host"), candidates_udf()("html").alias("hashes"))
    # one row with a null hash per page counts the pages in the same aggregation
    counts = at.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    pages_of = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    often = counts.where(F.col("hash").isNotNull() & (F.col("n") >= least_pages)).join(pages_of, "host").where(F.col("n") >= least_share * F.col("pages"))
    # at that share, a host has at most 1 / least_share times as many templates as a page has subtrees
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))


def templates(pages: DataFrame, found: DataFrame, least_pages: int = 5) -> DataFrame:
    """host, templates: those of the recurring subtrees that stand beside at least ``least_pages`` different texts."""
    asked = _beside(pages.select("url", "html"), found).where("__templates is not null")
    seen = asked.select(F.col("__host").alias("host"), votes_udf()("html", "__templates").alias("v")).select("host", F.explode("v.hashes").alias("hash"), "v.own")
    real = seen.groupBy("host", "hash").agg(F.countDistinct("own").alias("n")).where(F.col("n") >= least_pages)
    return real.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))


def _beside(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with __host and __templates, null where the host has none."""
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("templates")), F.lit(0)).alias("h")).first()
    small = size["n"] <= BROADCAST_ROWS and size["h"] <= BROADCAST_HASHES
    side = found.select(F.col("host").alias("__host"), F.col("templates").alias("__templates"))
    return pages.withColumn("__host", host_of(F.col("url"))).join(F.broadcast(side) if small else side, "__host", "left")


def extract_main_text(pages: DataFrame, least_pages: int = 5, least_share: float = 0.3) -> DataFrame:
    """Adds text and n_chars to every page (columns url and html).

    Null pages, and pages without main text, get an empty text and 0.  Without
    a host, pages count as one host.  Repeated pages repeat, and each counts.
    Existing columns of those names are replaced.
    """
    found = written(recurring(pages, least_pages, least_share), "recurring")
    df = _beside(pages, written(templates(pages, found, least_pages), "templates"))
    df = df.withColumn("text", main_text_udf()("html", "__templates")).drop("__host", "__templates")
    return df.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
