"""The main text of web pages by minimum-cut labelling.

A page is cut into blocks of text, at block elements only. Each block gets a cost for either label: what a logistic classifier,
trained here, says about it, bounded, plus what landmarks and names around it say. The cost becomes a capacity to one of two
terminals. Blocks that follow each other, and blocks close in the document tree, are joined by smoothness edges, weaker the
further apart they are and weak across the border of a zone. The minimum cut between the terminals separates content from
boilerplate. Landmark and classifier against each other weigh less than a block's edges inside its zone, so neighbours decide.

A zone begins at a landmark (`article`, `nav`, a role) and at a container whose name can only mean comments, adverts, notices,
sidebars or navigation. Inside the latter an `article` is a comment or teaser, no landmark. Other names (search, related, header,
share) are weak signs. Ids of headings, names of inline elements and state classes (has-sidebar) are none. Scripts, form controls
and what is hidden is not text.

The classifier sees length, links, punctuation, tag and place of a block. Its labels come from pages with landmarks in a bounded
sample; no page needs labels of its own. Time and memory are linear in a page's length but for the flow among undecided blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.llm.folds import fit_in_one_task, smallest_hashes
from packhouse.llm.words import slices

# Elements and names as HTML and common usage have them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set("head script style title template noscript iframe svg math object canvas audio video textarea select button".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
            "thead tr ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (set(a.split()), set(b.split())) for k, (a, b) in CLOSES.items()}
CONTENT = set("article main".split())
BOILERPLATE = set("nav footer header aside menu dialog".split())
CONTENT_NAMES = set("article content post entry story articlebody maincontent bodytext".split())
COMMENT_NAMES = set("comment comments commentlist disqus respond replies".split())
STRONG_NAMES = COMMENT_NAMES | set(
    "ad ads advert adverts advertisement advertisements advertising sponsored sponsor promo cookie cookies consent gdpr notice "
    "notices notification notifications popup modal overlay sidebar sidenav navbar navigation nav menu breadcrumb breadcrumbs "
    "pagination footer newsletter".split())
WEAK_NAMES = set("banner alert widget header masthead share sharing social related recommended subscribe signup login search "
                 "toolbar tags".split())
#: Parts that say where or how large a container is, not what.
NEUTRAL = set("area bar block body bottom box center column container group inner item left list outer panel primary region right "
              "secondary section site slot small large text thread top unit user reader wrap wrapper page global".split())
STATES = set("has with no is js not without show hide".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar comment".split())
SCOPES = set("button td th li article section body".split())

HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

#: What a landmark, the classifier at its surest, and a name say; a form says half a landmark, as some wrap whole pages.
LANDMARK, CLASSIFIER, STRONG = 2.0, 1.5, 2.5
#: Of a weak name that is on a list as a whole, and of one with a part that is.
NAME, NAME_PART = 0.5, 0.25
ADJACENT, PROXIMITY, ACROSS = 2.0, 1.0, 0.1
SAMPLE, SAMPLE_BLOCKS, ROUNDS, RATE, DECAY = 2000, 100, 400, 0.5, 1e-3

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PARTS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """`near` has the numbers of the block element, its parent and grandparent; `steps` is the way in the tree from the block
    before; `prior` and `named` are what landmark and name say, 0 for nothing; `zone` names the zone."""

    text: str
    linked: int
    tag: str
    near: tuple[int, int, int] = (0, 0, 0)
    steps: int = 0
    prior: float = 0.0
    named: float = 0.0
    zone: int = 0


class _Open:
    """An open element, with what holds inside it."""

    __slots__ = ("tag", "near", "block", "depth", "place", "prior", "named", "zone", "dropped", "linked")

    def __init__(self, tag: str, near: tuple[int, int, int], block: str, depth: int, place: int, prior: float, named: float,
                 zone: int, dropped: bool, linked: bool) -> None:
        # `block` and `depth` are of the innermost block element; `place` is where the `p` is that a block element would close.
        self.tag, self.near, self.block, self.depth, self.place = tag, near, block, depth, place
        self.prior, self.named, self.zone, self.dropped, self.linked = prior, named, zone, dropped, linked


def _attributes(inside: str) -> dict[str, str]:
    """Lower-case names and values of a tag, each value read whole; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(inside):
        out.setdefault(name.lower(), "".join(values).lower())
    return out


def _sign(name: str) -> float:
    """-STRONG for a name that can only mean boilerplate; NAME or -NAME for one that is on a list as a whole, or in all its parts;
    NAME_PART where some parts are; 0 where parts speak for both, or none does, or the name is a state."""
    parts = [x for x in _PARTS.split(name) if x]
    if not parts or parts[0] in STATES:
        return 0.0
    told = [x for x in parts if x not in NEUTRAL and not x[0].isdigit()]
    if "".join(parts) in STRONG_NAMES or told and STRONG_NAMES.issuperset(told) or not COMMENT_NAMES.isdisjoint(parts):
        return -STRONG
    for names, sign in ((CONTENT_NAMES, 1), (STRONG_NAMES | WEAK_NAMES, -1)):
        if "".join(parts) in names or told and names.issuperset(told):
            return sign * NAME
    some = (not CONTENT_NAMES.isdisjoint(parts)) - (not (STRONG_NAMES | WEAK_NAMES).isdisjoint(parts))
    return some * NAME_PART


def _named(tag: str, attributes: dict[str, str]) -> float:
    """The strongest sign among class names and id; 0 where the strongest oppose each other."""
    # The id of a heading is made from its words.
    names = attributes.get("class", "").split() + ([] if tag in HEADINGS else attributes.get("id", "").split())
    signs = [_sign(x) for x in names] or [0.0]
    if tag in HEADINGS:
        signs = [max(-NAME, x) for x in signs]
    high, low = max(0.0, *signs), min(0.0, *signs)
    return 0.0 if high == -low else max(high, low, key=abs)


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "")
    return ("hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
            or "visibility:hidden" in style)


def _signs(tag: str, attributes: dict[str, str], above: _Open) -> tuple[float, float, bool]:
    """What landmark and name say inside a block element, and whether it begins a zone."""
    if above.named == -STRONG and tag != "main":
        return above.prior, above.named, False
    sign = 0.0 if tag in ("body", "html") else _named(tag, attributes) if attributes else 0.0
    if sign == -STRONG:
        return 0.0, sign, True
    role = attributes.get("role", "")
    if role in BOILERPLATE_ROLES:
        return -1.0, 0.0, True
    if tag == "main" or role == "main":
        return 1.0, 0.0, above.prior <= 0
    # A teaser in a sidebar is no article, but a form may wrap the page.
    if (tag in CONTENT or role == "article") and above.prior > -1:
        return 1.0, 0.0, above.prior <= 0
    own, named, begins = above.prior, above.named, False
    if tag in BOILERPLATE and not (tag == "header" and (own > 0 or named > 0)):
        own, named, begins = -1.0, 0.0, own > -1
    elif (tag == "form" or role == "form") and own > -0.5:
        own, named, begins = -0.5, 0.0, True
    if abs(sign) < (NAME if tag in HEADINGS else abs(named)):
        sign = 0.0
    if sign:
        return (own if own * sign > 0 else 0.0), sign, begins
    return own, named, begins


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order. Character references are decoded and white space is one space."""
    out: list[Block] = []
    root = (0, 0, 0)
    stack = [_Open("", root, "", 0, 0, 0.0, 0.0, 0, False, False)]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked, number, at, lowest, depth_before = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, lowest, depth_before
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                steps = top.depth + depth_before - 2 * min(lowest, top.depth)
                out.append(Block(text, linked, top.block, top.near, steps, top.prior, top.named, top.zone))
                lowest = depth_before = top.depth
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.dropped:
            text = html.unescape(text)
            pieces.append(text)
            if top.linked:
                linked += len(text.strip())

    def close(place: int) -> None:
        nonlocal lowest
        if any(e.tag in BLOCK for e in stack[place:]):
            flush()
        open_tags.subtract(e.tag for e in stack[place:])
        del stack[place:]
        lowest = min(lowest, stack[-1].depth)

    def close_tag(ends: set[str], stops: set[str]) -> None:
        """Close the innermost open element of `ends`, unless one of `stops` is further in."""
        if any(open_tags[e] for e in ends):
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag in ends:
                    return close(place)
                if stack[place].tag in stops:
                    return None

    while True:
        found = _TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            close_tag({tag}, set())
            continue
        if tag == "br":
            say(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK and stack[-1].place:
            close(stack[-1].place)
        if tag in CLOSES:
            close_tag(*CLOSES[tag])
        top = stack[-1]
        inside = found[3] or ""
        attributes = _attributes(inside) if inside else {}
        dropped = top.dropped or tag in DROPPED or bool(attributes) and _hidden(attributes)
        prior, named, zone, near, block, depth = top.prior, top.named, top.zone, top.near, top.block, top.depth
        if tag in BLOCK:
            flush()
            number += 1
            prior, named, begins = _signs(tag, attributes, top)
            zone = number if begins else zone
            near, block, depth = (number, near[0], near[1]), tag, depth + 1
        elif inside.endswith("/") and tag not in RAW and tag != "a":
            continue
        place = len(stack) if tag == "p" else 0 if tag in SCOPES else top.place
        stack.append(_Open(tag, near, block, depth, place, prior, named, zone, dropped, top.linked or tag == "a"))
        open_tags[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row per block, without any landmark."""
    rows = []
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        ends = sum(b.text.count(c) for c in ".!?,;:")
        rows.append((1.0, np.log1p(words) / 5, min(1.0, b.linked / len(b.text)), min(1.0, ends / words), b.text[-1] in ".!?",
                     b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "td", "th"), b.tag == "div",
                     i / len(page)))
    return np.array(rows, float).reshape(-1, 10)


def fit_classifier(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by gradient descent, both classes with equal total weight; zeros unless both occur."""
    w = np.zeros(10)
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(ROUNDS):
        w -= RATE * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) + DECAY * w)
    return w


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks that landmarks or unambiguous names label, evenly chosen if they are many."""
    found = blocks(page)
    sign = np.array([b.prior if abs(b.prior) == 1 else -1.0 if b.named == -STRONG else 0.0 for b in found])
    known = np.flatnonzero(sign)
    if len(known) > SAMPLE_BLOCKS:
        known = known[np.linspace(0, len(known) - 1, SAMPLE_BLOCKS).astype(int)]
    return features(found)[known], (sign[known] > 0).astype(float)


def _fit(sample: pa.Table) -> dict[str, np.ndarray]:
    rows = sorted(zip(sample["doc_id"].to_pylist(), sample["blocks"].to_pylist()))
    parts = [np.frombuffer(r, float).reshape(-1, 11) for _, r in rows if r]
    if not parts:
        return {"weights": np.zeros(10)}
    x = np.concatenate(parts)
    return {"weights": fit_classifier(x[:, :10], x[:, 10])}


def fit_blocks(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the block classifier from at most `sample` pages with an id, chosen by a hash of it; of pages with one id,
    the least html counts. Pages are parsed where they lie. The one task that fits gets at most SAMPLE_BLOCKS rows of 88
    bytes a page."""
    rows = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("html").cast("string").alias("text"))
    chosen = smallest_hashes(rows.select("doc_id").filter("doc_id is not null").distinct(), sample)
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=1):
            found = [np.column_stack(_labelled(t or "")).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["doc_id", "blocks"])

    return fit_in_one_task(one.mapInArrow(run, "doc_id long, blocks binary"), _fit)["weights"]


def costs(page: list[Block], weights: np.ndarray) -> np.ndarray:
    """Per block, how much more it costs to call it boilerplate than content."""
    logit = np.clip(features(page) @ weights, -CLASSIFIER, CLASSIFIER)
    return logit + np.array([LANDMARK * b.prior + b.named for b in page])


def edges(page: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness: each block with the one before, and with the last one under the same parent and grandparent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, int], int] = {}
    for j, b in enumerate(page):
        near = {j - 1: ADJACENT / (1 + b.steps)} if j else {}
        for up in (1, 2):
            if b.near[up]:
                i = last.get((up, b.near[up]))
                if i is not None:
                    other = page[i].near
                    steps = 0 if other[0] == b.near[0] else 2 if other[1] == b.near[1] else 4
                    near[i] = near.get(i, 0.0) + PROXIMITY / (1 + steps)
                last[up, b.near[up]] = j
        for i, weight in near.items():
            out[i, j] = weight * (1.0 if page[i].zone == b.zone else ACROSS)
    return out


def minimum_cut(cost: np.ndarray, links: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; cost > 0 is a capacity from the source, < 0 one to the sink.

    A node whose own capacity exceeds that of all its links is on its own side in every minimum cut; it is settled first and
    its links become capacities of its neighbours. Maximum flow over the others decides the rest. Ties go to the sink.
    """
    n = len(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in links.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    own = [float(c) for c in cost]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(own[i]) > sum(w for j, w in near[i].items() if side[j] is None):
            side[i] = own[i] > 0
            for j, w in near[i].items():
                if side[j] is None:
                    own[j] += w if side[i] else -w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        kept = _with_source(rest, own, near, side)
        for i in rest:
            side[i] = i in kept
    return [bool(x) for x in side]


def _with_source(rest: list[int], own: list[float], near: list[dict[int, float]], side: list) -> set[int]:
    """Nodes that the source still reaches after maximum flow: blocking flows along shortest paths, level by level."""
    room: dict[int, dict[int, float]] = {i: {j: w for j, w in near[i].items() if side[j] is None} for i in rest}
    room[-1] = {i: own[i] for i in rest if own[i] > 0}
    room[-2] = {}
    for i in rest:
        if own[i] < 0:
            room[i][-2] = -own[i]
            room[-2][i] = 0.0
        room[i].setdefault(-1, 0.0)
    while True:
        level, queue = {-1: 0}, deque([-1])
        while queue:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if -2 not in level:
            return set(level) - {-1}
        ways = {i: [j for j in room[i] if level.get(j) == level[i] + 1] for i in level}
        path = [-1]
        while path:
            i = path[-1]
            if i == -2:
                steps = list(zip(path, path[1:]))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-9)
                del path[full + 1:]
                continue
            while ways[i] and room[i][ways[i][-1]] <= 1e-9:
                ways[i].pop()
            if ways[i]:
                path.append(ways[i][-1])
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def main_text(page: str, weights: np.ndarray) -> str:
    """Content blocks in page order, two line feeds between them."""
    found = blocks(page)
    if not found:
        return ""
    kept = minimum_cut(costs(found, weights), edges(found))
    return "\n\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points of text).

    The whole html is used; null and empty pages give an empty text. Other columns are ignored, repeated rows answered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=2):
            texts = [main_text(p or "", weights) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
