"""Main text of web pages: a tree-structured graphical model over DOM nodes, whose content marginals come from sum-product messages."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import col, tidy

#: States of a node: links and controls; the article; what holds the article among other things; prose that isn't the article's.
CHROME, CONTENT, FRAME, ASIDE = range(4)

# Elements of HTML by what they are.
TAGS = {
    "page": "html body", "article": "article", "main": "main", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form fieldset button select option label legend datalist output", "box": "div section center details hgroup search",
    "para": "p pre blockquote address figure figcaption summary", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl dir", "item": "li dt dd",
    "table": "table caption thead tbody tfoot tr td th", "rule": "hr",
}
#: Words of class, id and role that tell what a node is for.
HINTS = {
    "hidden": "hidden",
    "comment": "comment comments discussion disqus replies reply respond",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "notice": "notice cookie cookies consent gdpr popup modal overlay paywall alert dialog newsletter subscribe subscription signup disclaimer",
    "side": "sidebar side rail widget complementary related recommended recommendations popular trending share sharing social follow",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs",
    "form": "form login signin search register",
    "foot": "footer foot copyright colophon contentinfo legal",
    "head": "header masthead topbar logo branding banner",
    "content": "content article post entry story main",
}
KIND = {tag: kind for kind, tags in TAGS.items() for tag in tags.split()}
HINT = {word: (rank, hint) for rank, (hint, words) in enumerate(HINTS.items()) for word in words.split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = set("head svg math template object canvas audio video select datalist".split())
#: Elements whose start ends an open one of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which such an end doesn't reach.
BARS = set("ul ol dl table select body html article main section aside nav div td th".split())

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>|<[!?/][^>]*+>?|(<[a-zA-Z].*+)|([^<]++|<)""", re.S)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hint(tag: str, attrs: str) -> str:
    """What class, id and role say that a node is for; words after has, with and no tell of something else."""
    best = (len(HINTS), "")
    for value in NAMED.findall(attrs):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in WORD.findall(name)]
            for before, w in zip(["", *words], words):
                if before not in ("has", "with", "no", "without"):
                    best = min(best, HINT.get(w, best))
    if HIDDEN.search(attrs):
        best = min(best, HINT["hidden"])
    return "" if KIND.get(tag) == "heading" and best[1] == "head" else best[1]


class Tree:
    """Nodes of a page, parents first: parent, kind (element, hint), cell (of a run of text, else None). runs: (node, block, text).

    A run is text of one block under the same node. Elements that begin a block are nodes, and so are others with a hint."""

    def __init__(self, page: str):
        self.parent, self.kind, self.cell, self.runs = [-1], [("page", "")], [None], []
        self.block, self.texts = 0, []  # of the run that is being read
        stack: list[tuple[str, int]] = []  # open elements, with the node that each makes or stands in
        self.open = Counter()  # how many of each name are open, and of all UNSEEN ones under "\0"
        at = 0
        while at < len(page):
            m = TOKEN.match(page, at)
            at = m.end()
            closing, name, attrs, _, text = m.groups()
            if text is not None:
                if not self.open["\0"]:
                    self.texts.append((text, self.open["a"] > 0))
                continue
            if name is None:
                continue
            name = name.lower()
            if not closing:
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                    at = end.start() if end else len(page)
                    stack.append((name, stack[-1][1] if stack else 0))
                    self.open[name] += 1
                    continue
                if name in VOID:
                    if name == "br":
                        self.texts.append((" ", False))
                    elif name == "hr":
                        self._end(stack)
                    continue
                said, blocky = hint(name, attrs) if attrs.strip() else "", name in KIND
                if blocky:
                    self._end(stack)
                    if name not in ("button", "label", "option"):
                        self._close(stack, {"p"}, {"button", "table", "td", "th"})
                    if name in ENDS:
                        self._close(stack, ENDS[name], BARS)
                elif said and said != "content":
                    self._end(stack, whole=False)
                above = stack[-1][1] if stack else 0
                if blocky or said and said != "content":
                    self.parent.append(above)
                    self.kind.append((KIND.get(name, "span"), said if KIND.get(name) != "page" else ""))
                    self.cell.append(None)
                    above = len(self.parent) - 1
                stack.append((name, above))
                self._count(name, 1)
            elif self.open[name]:
                if name in KIND:
                    self._end(stack)
                while stack:
                    open_, own = stack[-1]
                    if own != (stack[-2][1] if len(stack) > 1 else 0):
                        self._end(stack, whole=open_ in KIND)
                    stack.pop()
                    self._count(open_, -1)
                    if open_ == name:
                        break
        self._end(stack)

    def _count(self, name: str, n: int) -> None:
        self.open[name] += n
        if name in UNSEEN:
            self.open["\0"] += n

    def _close(self, stack: list, names: set, bars: set) -> None:
        """Close the innermost open element of `names` and what it holds, unless one of `bars` is nearer."""
        if not any(self.open[x] for x in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                for gone, _ in stack[i:]:
                    self._count(gone, -1)
                del stack[i:]
                return
            if stack[i][0] in bars:
                return

    def _end(self, stack: list, whole: bool = True) -> None:
        """End of a run, and of its block if `whole`."""
        if self.texts:
            text = "".join(entities.unescape(t) for t, _ in self.texts)
            n = len(text.strip())
            if n:
                links = sum(len(t) for t, linked in self.texts if linked) / max(1, sum(len(t) for t, _ in self.texts))
                size = (n > 12) + (n > 40) + (n > 120) + (n > 400)
                self.parent.append(stack[-1][1] if stack else 0)
                self.kind.append(("text", ""))
                self.cell.append((size, (links > 0.1) + (links > 0.6), text.rstrip()[-1] in ".!?:;\"»”…"))
            if n or text:
                self.runs.append((len(self.parent) - 1 if n else -1, self.block, text))
            self.texts = []
        if whole:
            self.block += 1


def labelled(tree: Tree) -> list[int] | None:
    """The states of the nodes of a page that marks its article: one outermost article or main element. None for other pages."""
    marked = [i for i, (tag, _) in enumerate(tree.kind) if tag in ("article", "main")]
    inside = set(marked)
    outer = [i for i in marked if not any(j in inside for j in _above(tree, i))]
    if len(outer) != 1:
        return None
    frame = {*_above(tree, outer[0])}
    state: list[int] = []
    for i, (tag, said) in enumerate(tree.kind):
        over = state[tree.parent[i]] if i else FRAME
        if i == outer[0]:
            state.append(CONTENT)
        elif i in frame:
            state.append(FRAME)
        elif over in (CHROME, ASIDE):
            state.append(over)
        elif _role(tag, said) in ("chrome", "aside"):
            state.append(CHROME if _role(tag, said) == "chrome" else ASIDE)
        else:
            state.append(CONTENT if over == CONTENT else ASIDE)
    return state


def _above(tree: Tree, i: int) -> list[int]:
    out = []
    while tree.parent[i] >= 0:
        i = tree.parent[i]
        out.append(i)
    return out


def _role(tag: str, said: str) -> str:
    """The prior that a kind of node has."""
    if said in ("nav", "form", "hidden") or not said and tag in ("nav", "form"):
        return "chrome"
    if said not in ("", "content") or tag in ("header", "footer", "aside"):
        return "aside"
    if tag in ("article", "main") or said == "content":
        return tag if tag == "article" else "main"
    return {"page": "page", "box": "box", "table": "box", "text": "text", "span": "text", "heading": "heading"}.get(tag, "block")


#: What is held of a node under each state before any page is seen: chances of chrome, content, frame, aside under a frame, and under content.
PRIOR = {
    "chrome": ((0.80, 0.01, 0.01, 0.18), (0.90, 0.04, 0, 0.06)), "aside": ((0.12, 0.01, 0.02, 0.85), (0.06, 0.04, 0, 0.90)),
    "article": ((0.001, 0.98, 0.009, 0.01), (0.002, 0.99, 0, 0.008)), "main": ((0.01, 0.90, 0.06, 0.03), (0.002, 0.99, 0, 0.008)), "page": ((0.001, 0.049, 0.949, 0.001), (0.001, 0.998, 0, 0.001)),
    "box": ((0.10, 0.20, 0.65, 0.05), (0.0001, 0.9998, 0, 0.0001)), "block": ((0.25, 0.55, 0.05, 0.15), (0.0001, 0.9998, 0, 0.0001)),
    "heading": ((0.15, 0.75, 0.05, 0.05), (0.0001, 0.9998, 0, 0.0001)), "text": ((0.45, 0.45, 0, 0.10), (0.0001, 0.9998, 0, 0.0001)),
}
UNDER_CHROME, UNDER_ASIDE = (0.95, 0.0005, 0, 0.0495), (0.03, 0.0005, 0, 0.9695)
#: Nodes that a prior weighs; the share of a text's evidence that goes to either state, so that no single text outweighs where it stands.
WEIGHT, DOUBT = 10, 0.3
CELLS = [(size, links, ended) for size in range(5) for links in range(3) for ended in (False, True)]


class Model:
    """Potentials. edges[kind][state above][state]; texts[cell][state]."""

    def __init__(self, edges: dict, texts: dict):
        self.counts, self.edges = edges, {}
        total = {s: sum(n for (_, of), n in texts.items() if of == s) for s in (CHROME, CONTENT)}
        self.texts = {}
        for c in CELLS:
            held = (0.75 if c[1] == 2 else 0.125, 1 / 3)  # before any text is seen: three of four of chrome's are links
            chrome, content = ((texts.get((c, s), 0) + max(1.0, total[s] / 1000) * h / 10) / (total[s] + max(1.0, total[s] / 1000)) for s, h in zip((CHROME, CONTENT), held))
            chrome, content = (x + DOUBT * (chrome + content) / 2 for x in (chrome, content))
            # prose reads alike wherever it stands, so texts never tell content from aside: nodes above do
            self.texts[c] = (chrome, content, 0.0, content)

    def edge(self, kind: tuple) -> tuple:
        if kind not in self.edges:
            frame, content = PRIOR[_role(*kind)]
            rows = []
            for above, prior in ((CHROME, UNDER_CHROME), (CONTENT, content), (FRAME, frame), (ASIDE, UNDER_ASIDE)):
                seen = [self.counts.get((kind, above, s), 0) for s in range(4)]
                rows.append(tuple((n + WEIGHT * p) / (sum(seen) + WEIGHT) for n, p in zip(seen, prior)))
            self.edges[kind] = tuple(rows)
        return self.edges[kind]

    def marginals(self, tree: Tree) -> list[float]:
        """The chance of each node to be content: messages from the leaves up, then from the root down."""
        n, states = len(tree.parent), range(4)
        edges = [self.edge(k) for k in tree.kind]
        belief = [list(self.texts[c]) if c else [1.0] * 4 for c in tree.cell]
        sent: list = [None] * n
        for i in range(n - 1, 0, -1):
            b, e = belief[i], edges[i]
            message = [sum(r[s] * b[s] for s in states) for r in e]
            whole = sum(message)
            sent[i] = message = [x / whole for x in message]
            above = belief[tree.parent[i]]
            for s in states:
                above[s] *= message[s]
            if (whole := sum(above)) < 1e-100:
                for s in states:
                    above[s] /= whole
        belief[0] = [b * (s == FRAME) for s, b in enumerate(belief[0])]  # the page itself
        for i in range(n):
            b = belief[i]
            if i:
                over, e, up = belief[tree.parent[i]], edges[i], sent[i]
                rest = [over[s] / up[s] if up[s] else 0.0 for s in states]
                down = [sum(rest[a] * e[a][s] for a in states) for s in states]
                b = [x * y for x, y in zip(b, down)]
            whole = sum(b)
            belief[i] = [x / whole for x in b] if whole else [0.25] * 4
        return [b[CONTENT] for b in belief]


def main_text(page: str, model: Model) -> tuple[str, float]:
    """The blocks of content, and how sure the least sure run's label is."""
    tree = Tree(page)
    chance = model.marginals(tree)
    blocks: dict[int, list[str]] = {}
    sure = 1.0
    for node, block, text in tree.runs:
        if node >= 0:
            sure = min(sure, max(chance[node], 1 - chance[node]))
        if node < 0 or chance[node] >= 0.5:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(b for b in joined if b), sure


def fit_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 2000) -> Model:
    """The model learned from labelled pages, those that mark their article: counts of states along edges and of texts, added to priors.

    It is fitted on the first max_pages rows by a hash of id, page and where they stand; null pages are left out, and so are pages
    that mark no article or several. Without any labelled page the priors stand alone."""
    rows = pages.select(col(html_col).alias("html"), F.xxhash64(col(id_col), col(html_col), F.monotonically_increasing_id()).alias("h")).where("html is not null")
    last = rows.select("h").orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    if last is None:
        return Model({}, {})

    def run(batches):
        edges, texts = Counter(), Counter()
        for b in batches:
            for page in b.column(0):
                tree = Tree(page.as_py())
                state = labelled(tree)
                for i, s in enumerate(state or ()):
                    if i:
                        edges[tree.kind[i], state[tree.parent[i]], s] += 1
                    if tree.cell[i]:
                        texts[tree.cell[i], s] += 1
        rows = [(*k, a, s, None, None, None, n) for (k, a, s), n in edges.items()] + [(None, None, None, s, *c, n) for (c, s), n in texts.items()]
        if rows:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["tag", "said", "above", "state", "size", "links", "ended", "n"]
    drawn = rows.where(F.col("h") <= last).select("html").mapInArrow(tidy(run), "tag string, said string, above int, state int, size int, links int, ended boolean, n long")
    edges, texts = {}, {}
    for r in drawn.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).collect():  # kinds, states and cells: closed sets
        if r.tag is None:
            texts[(r["size"], r.links, r.ended), r.state] = r.n
        else:
            edges[(r.tag, r.said), r.above, r.state] = r.n
    return Model(edges, texts)


def extract_pages(pages: DataFrame, model: Model, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text (the article's blocks, one a line), n_chars (code points) and sure (the chance of the least sure run's label).

    One row for each row of pages; other columns are not read. A null or empty page, one without text and one without content have an
    empty text. Repeated rows are read each. Whole pages are read, of any size and depth; broken markup is closed as browsers do in the usual cases."""
    fields = [T.StructField(f"c{i}", pages.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("sure", T.DoubleType())]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches):
        for b in batches:
            found = [main_text(x.as_py() or "", model) for x in b.column(len(keep))]
            made = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow.types[i]) for i in range(len(keep))), *made], schema=arrow)

    rows = pages.select(*(col(c).alias(f"c{i}") for i, c in enumerate(keep)), col(html_col).alias("html"))
    return rows.mapInArrow(tidy(run), T.StructType(fields)).toDF(*keep, "text", "n_chars", "sure")
