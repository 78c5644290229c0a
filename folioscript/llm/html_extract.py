"""Main-text extraction from HTML by a minimum cut.

A page is cut into blocks, the runs of text between block-level tags. A logistic
classifier over tag path, class and id words, length and link density gives each
block the cost of being called boilerplate or content. Those costs are the
capacities from the source and to the sink; neighbouring blocks, and blocks next
to one another under the same parent, are joined by smoothness edges that weaken
with their distance in the tree. The minimum cut is the labelling of least total
cost: what stays on the source's side is the text. Blocks whose own cost exceeds
all their edges are labelled first (no cut can differ there); a maximum flow
separates each group of the rest.

Pages that hold one <article> label their own blocks. The weights are learned from at
most FIT_PAGES of them (lowest hash first) of up to FIT_CHARS characters. The machine
sees each page with its names, its marks of boilerplate and its tags shown and
hidden in turn, so that the text itself learns to speak where a page has no telling
names; a block below a mark of boilerplate is boilerplate whatever its text. The
strength of the edges is the one of STRENGTHS with the fewest wrong blocks on such
pages. Without labelled pages PRIOR is used.

A class or id counts as a mark where all its words are marks or PLAIN words; inside
an article, other compounds ("related-work") are names like any other. A form that
wraps the page (around an article, main or h1, or around most of the text) is no mark.
Where the cut leaves nothing, the blocks without mark and with few links are the text.

Each page is a row of its own, so there is no shuffle. Markup is read in one
linear pass; comments, scripts, styles, form controls and embedded objects go with
their content (raw text or subtree), references are decoded, white space inside a block becomes one
space, and blocks are joined by line ends in page order.

Defined cases: null and empty html give the empty text; text without any tag is
one block; unclosed and crossing tags are closed by the next end that fits; raw
text elements without an end run to the end of the page, form controls and embedded
objects without one hold nothing; repeated pages give
equal rows; null ids and URLs are carried.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.llm.common import table, travels

travels(__name__)

# Elements of HTML by their treatment.
RAW = frozenset("script style textarea title xmp noframes".split())  # their content is no markup
APART = frozenset("noscript template svg math iframe object canvas audio video select button datalist".split())  # go with their subtree
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
                    "tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}
ALIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
SCOPES = frozenset("ul ol dl table".split())
TEXTUAL = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption dd".split())

# Words of class, id and role that speak for boilerplate; those with * also as the start of a word.
NOISE = ("ad ads adv advert* adsense adslot sponsor* promo* banner* menu* nav navbar* navigation* breadcrumb* sidebar* side rail footer* foot "
         "masthead* topbar toolbar* cookie* consent* gdpr notice* notification* alert* popup* modal* overlay* newsletter* subscri* signup login* "
         "signin comment* disqus* respond reply replies share sharing social* related* recommend* widget* pagination* pager copyright* "
         "disclaimer* complementary contentinfo search* form skip sitemap outbrain taboola teaser*").split()
NOISE_WORDS = frozenset(w.rstrip("*") for w in NOISE)
NOISE_STARTS = tuple(w[:-1] for w in NOISE if w.endswith("*"))
# Words that may stand beside those in a name without changing its sense.
PLAIN = frozenset(("area article articles bar block body bottom box break button buttons by col column container content entry global google head header "
                   "icon icons in info inline inner item items js left link links list main media mid module more news outer page panel post posts "
                   "primary reader readers right secondary section site slot stories story text thread title top ui unit us user users video "
                   "wrap wrapper").split())
BODY_WORDS = frozenset("article content main post entry story articlebody postbody maincontent".split())
HIDING = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|</?[a-zA-Z][^>]*>?", re.S | re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
EMPTY = re.compile(r"(?:^|[\s\"'])/$")
NAMING = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

NEXT, SIBLING = 1.0, 0.5  # smoothness: blocks in sequence, blocks in sequence under the same parent
FIT_PAGES, FIT_CHARS, RIDGE = 300, 60_000, 1.0
STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0)
MARKED, TEXTUAL_TAG, NOISY = 1, 2, 7  # columns of ``features``


class Model(NamedTuple):
    """Weights of the features (positive speaks for content) and the strength of the edges."""
    weights: tuple[float, ...]
    strength: float


PRIOR = Model((0.2, 2.5, 0.8, -0.6, 2.0, 0.9, -3.5, -12.0), 1.0)


RAW_GAP = "#"  # stands for an element that is left out


class Element:
    __slots__ = ("apart", "article", "body", "depth", "form", "link", "noisy", "parent", "tag", "wraps")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.apart = tag in APART or bool(parent and parent.apart)
        self.article = bool(parent and parent.article)
        self.noisy = bool(parent and parent.noisy)
        self.body = bool(parent and parent.body)
        self.link = tag == "a" or bool(parent and parent.link)
        self.wraps = False
        self.form = parent.form if parent else None
        if tag == "form" and self.form is None:
            self.form = self
        elif tag in ("article", "main", "h1") and self.form:
            self.form.wraps = True
        if tag in ("html", "body") or parent is None:
            return
        names: list[set[str]] = []
        if attrs:
            for m in NAMING.finditer(attrs):
                names += ({w.lower() for w in WORD.findall(name)} for name in (m[1] or m[2] or m[3] or "").split())
            self.noisy = self.noisy or bool(HIDING.search(attrs))
        words = set().union(*names)
        about = bool(words & {"article", "entry", "post", "story"})
        heading = tag == "header" or "header" in words
        self.noisy = (self.noisy or tag in ("nav", "footer", "aside", "dialog", "menu", "search", "fieldset")
                      or heading and not (about or self.article)
                      or any(self.speaks_noise(n) for n in names))
        self.article = self.article or tag in ("article", "main") or "main" in words and "role" in attrs
        self.body = self.body or bool(words & BODY_WORDS)

    def speaks_noise(self, name: set[str]) -> bool:
        """Whether the words of one class, id or role mark boilerplate."""
        marks = {w for w in name if w in NOISE_WORDS or w.startswith(NOISE_STARTS)}
        if self.tag == "form":  # what it holds decides
            marks.discard("form")
        if not marks or not name.isdisjoint({"with", "has", "no"}):
            return False
        return not (self.article or self.body) or name - marks <= PLAIN


class Block:
    __slots__ = ("chars", "element", "linked", "text")

    def __init__(self, text: str, linked: int, chars: int, element: Element):
        self.text, self.linked, self.chars, self.element = text, linked, chars, element


def read_tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether an end tag, attributes) of all markup; no tag for comments, raw text and elements
    apart that are empty or have no end, which are read as empty."""
    out, at, open_, foreign = [], 0, {}, 0
    while m := TOKEN.search(page, at):
        tag, at = (m["tag"] or "").lower(), m.end()
        end, attrs = bool(m["end"]), m["attrs"] or ""
        if tag in RAW:
            if not end and not (foreign and EMPTY.search(attrs)):
                closing = RAW_END[tag].search(page, at)
                at = closing.end() if closing else len(page)
            tag = RAW_GAP
        elif tag in APART:
            if not end:
                if EMPTY.search(attrs):
                    tag = RAW_GAP
                else:
                    open_.setdefault(tag, []).append(len(out))
                    foreign += tag in FOREIGN
            elif open_.get(tag):
                open_[tag].pop()
                foreign -= tag in FOREIGN
            else:
                tag = RAW_GAP
        out.append((m.start(), at, tag, end, attrs))
    for rest in open_.values():
        for i in rest:
            out[i] = (*out[i][:2], RAW_GAP, False, "")
    return out


def read_blocks(page: str) -> list[Block]:
    """Text blocks of a page, in order."""
    root = Element("", "", None)
    here, out, parts, linked, chars = root, [], [], 0, 0

    def close() -> None:
        nonlocal parts, linked, chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                holder = here
                while holder.tag not in BLOCKS and holder.parent:
                    holder = holder.parent
                out.append(Block(text, linked, chars, holder))
            parts, linked, chars = [], 0, 0

    def say(raw: str) -> None:
        nonlocal linked, chars
        if here.apart:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        n = len(text.strip())
        chars += n
        if here.link:
            linked += n

    def leave(until: set | frozenset, scope: frozenset) -> None:
        """Close the innermost open element of the given tags, if no scope stands before it."""
        nonlocal here
        at = here
        while at.parent and at.tag not in until:
            if at.tag in scope:
                return
            at = at.parent
        if at.parent:
            here = at.parent

    at = 0
    for start, end, tag, closing, attrs in read_tags(page):
        if start > at:
            say(page[at:start])
        at = end
        if not tag:
            continue
        if tag == RAW_GAP or tag in APART:
            if parts:
                parts.append(" ")
            if tag == RAW_GAP:
                continue
        if here.apart:
            inside = here
        elif tag in BLOCKS:
            close()
        elif tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
        if closing:
            if tag in ("html", "body"):
                continue
            apart = here.apart
            leave({tag}, frozenset() if tag in BLOCKS or tag in APART else BLOCKS)
            if apart and not here.apart and tag in BLOCKS:  # a block ends around an element apart
                here, outer = inside, here
                close()
                here = outer
        elif tag not in VOID:
            if tag in CLOSES_P:
                leave({"p"}, BLOCKS - {"p"} | APART)
            if tag in ALIKE:
                leave(ALIKE[tag], SCOPES | APART)
            if not attrs.endswith("/") or tag in BLOCKS or tag == "a" or tag in APART:
                here = Element(tag, attrs, here)
    if at < len(page):
        say(page[at:])
    close()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: constant, marked as article, tag of running text, tiny, words, sentences, share of linked text,
    marked as boilerplate."""
    of_form: dict[int, list[int]] = {}
    for b in blocks:
        if b.element.form and not b.element.noisy:
            held = of_form.setdefault(id(b.element.form), [0, 0])
            held[0] += b.chars - b.linked
            held[1] += b.text.count(" ") >= 8
    free = sum(b.chars - b.linked for b in blocks if not b.element.noisy)
    out = np.zeros((len(blocks), 8))
    for row, b in zip(out, blocks, strict=True):
        e, words = b.element, b.text.count(" ") + 1
        noisy = e.noisy
        if not noisy and e.form and not e.form.wraps:
            chars, texts = of_form[id(e.form)]
            noisy = 2 * chars <= free or texts < 3
        marked = 1.0 if e.article else 0.5 if e.body else 0.0
        row[:] = (1, marked, e.tag in TEXTUAL, words < 4, min(words, 40) / 40, min(3, sum(map(b.text.count, ".!?"))) / 3,
                  (b.linked / b.chars if b.chars else 0.0) * (1 - marked / 2), noisy)
    return out


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a, n = a.parent, n + 1
    return n


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, capacity) between neighbours in the page and under the same parent."""
    edges, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            edges.append((j - 1, j, NEXT / (1 + distance(blocks[j - 1].element, b.element))))
        parent = id(b.element.parent or b.element)
        i = last.get(parent)
        if i is not None:
            edges.append((i, j, SIBLING))
        last[parent] = j
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a score is lost where its sign is not followed, an edge where its ends differ."""
    near: list[dict[int, float]] = [{} for _ in scores]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    score, label = list(scores), [None] * len(scores)
    slack = [sum(n.values()) for n in near]
    ready = deque(i for i in range(len(score)) if abs(score[i]) >= slack[i])
    while ready:  # such a block keeps its sign in a minimum cut; its edges become part of its neighbours' scores
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = score[i] > 0
        for j, c in near[i].items():
            if label[j] is None:
                score[j] += c if label[i] else -c
                slack[j] -= c
                if abs(score[j]) >= slack[j] - 1e-12:
                    ready.append(j)
    for start in range(len(score)):
        if label[start] is not None:
            continue
        group, seen = [start], {start}
        for i in group:  # grows by the undecided neighbours
            fresh = [j for j in near[i] if label[j] is None and j not in seen]
            seen.update(fresh)
            group += fresh
        side = source_side({i: score[i] for i in group}, {i: {j: c for j, c in near[i].items() if j in seen} for i in group})
        for i in group:
            label[i] = i in side
    return label


def source_side(score: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source's side after a maximum flow by shortest augmenting paths."""
    source, sink, eps = -1, -2, 1e-9
    room: dict[int, dict[int, float]] = {i: dict(n) for i, n in near.items()}
    room[source] = {i: s for i, s in score.items() if s > 0}
    room[sink] = {}
    for i, s in score.items():
        if s > 0:
            room[i][source] = 0.0
        else:
            room[i][sink], room[sink][i] = -s, 0.0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > eps and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return set(came)
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        flow = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= flow
            room[j][i] = room[j].get(i, 0.0) + flow


def labels(x: np.ndarray, blocks: list[Block], model: Model) -> list[bool]:
    """Whether each block, described by ``x``, is content."""
    edges = [(i, j, c * model.strength) for i, j, c in smoothness(blocks)]
    return min_cut((x @ np.array(model.weights)).tolist(), edges)


def main_text(page: str | None, model: Model = PRIOR) -> str:
    blocks = read_blocks(page or "")
    x = features(blocks)
    keep = labels(x, blocks, model)
    if not any(keep):
        keep = [not noisy and b.linked * 2 < b.chars for b, noisy in zip(blocks, x[:, NOISY], strict=True)]
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def hide(x: np.ndarray, names: bool, marks: bool, tags: bool) -> np.ndarray:
    """The features without the article's name, the marks of boilerplate or the tags of running text."""
    out = x.copy()
    out[:, [c for c, h in ((MARKED, names), (NOISY, marks), (TEXTUAL_TAG, tags)) if h]] = 0
    return out


def learn(pages: list[str]) -> Model:
    """The classifier of pages that hold one <article>; PRIOR where they show no content or no boilerplate."""
    known = []
    for page in pages:
        blocks = read_blocks(page)
        x = features(blocks)
        known.append((blocks, x, np.array([b.element.article for b in blocks], bool) & (x[:, NOISY] == 0)))
    if not known:
        return PRIOR
    x, y = np.concatenate([k[1] for k in known]), np.concatenate([k[2] for k in known])
    if y.all() or not y.any():
        return PRIOR
    views = [hide(x, *h) for h in itertools.product((False, True), repeat=3)]
    for marked in (0.0, 1.0):
        below = x.copy()
        below[:, NOISY], below[:, MARKED] = 1, marked
        views.append(below)
    w = logistic(np.concatenate(views), np.concatenate([y] * 8 + [np.zeros(len(y), bool)] * 2).astype(float))

    def wrong(strength: float) -> int:
        model = Model(w, strength)
        return sum(int((np.array(labels(v, blocks, model), bool) != truth).sum())
                   for blocks, own, truth in known for v in (own, hide(own, True, True, True)))

    return Model(w, min(STRENGTHS, key=lambda s: (wrong(s), s)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(np.round(w, 6).tolist())


def fit(pages: DataFrame, html: str = "html", key: str = "page_id") -> Model:
    """``learn`` on a bounded sample of the pages that label themselves. The sample's bound is found on hashes alone, so
    that no task hands more than those to the next; then only the chosen pages are fetched, repeated rows once."""
    h = F.col(html)
    known = pages.filter(h.contains("<article") & (F.length(h) <= FIT_CHARS)).select(h.alias("html"), F.xxhash64(h, F.col(key)).alias("draw"))
    last = known.select("draw").orderBy("draw").limit(FIT_PAGES).agg(F.max("draw")).first()[0]
    if last is None:
        return PRIOR
    chosen = known.filter(F.col("draw") <= last).groupBy("draw").agg(F.min("html").alias("html")).collect()
    return learn([r.html for r in sorted(chosen) if r.html.count("<article") == 1])


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """The key columns, ``text`` and ``n_chars`` (code points) of every page; the model is learned from the pages where none is given."""
    model = model or fit(pages, html, keys[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, model) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                                             [*keys, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
