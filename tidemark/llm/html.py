"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded over the tree.

A page is parsed into block nodes.  Each has features of its subtree (text, link and tag
density, punctuation, label words of short blocks), its attribute tokens, its depth and its
siblings (how many, where among them, how many with the same tag and attributes).  Boosted trees give
each node the log-odds of belonging to the article.  Decoding maximises the total over
choices in which a dropped node drops its whole subtree, so no kept node stands below a
dropped one.  The trees are fitted on a bounded sample of pages (``SAMPLE`` rows, the smallest
page ids): their semantic article regions label their nodes, but for what their attributes
mark as comments, forms or adverts inside them, and the same texts are dealt into layouts
(tables among them) with headers, sidebars, notices, adverts, forms and comments, named and
unnamed, whose labels are known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages used to fit, trees, depth and learning rate.
SAMPLE, TREES, DEPTH, RATE, BINS = 256, 60, 4, 0.3, 32
#: Pages handled together, in characters.
CHUNK = 1 << 21

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>|<(?=/?[a-zA-Z])[^<]*\Z", re.S | re.I)
#: Elements dropped with all they hold, once they are closed; one that is never closed drops nothing.
DROPPED = frozenset("svg object select template noscript".split())
DROPS = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What closes which open element when it starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table tr td blockquote pre figure body".split()
TAG_ID = {t: i for i, t in enumerate(TAGS)}
#: Groups of attribute tokens; a token counts for each group whose stem starts it.
GROUPS = (
    ("article", "story", "entry", "post", "blog"), ("content", "body", "text", "main"), ("nav", "menu", "breadcrumb", "topbar"), ("head", "masthead", "logo"),
    ("foot", "copyright", "legal"), ("side", "widget", "related", "recommend", "popular"), ("ad", "ads", "advert", "sponsor", "promo", "banner"), ("cookie", "consent", "notice", "gdpr", "alert", "popup", "modal"),
    ("comment", "reply", "replies", "disqus", "respond", "discussion"), ("form", "subscribe", "newsletter", "signup", "search", "login"), ("share", "social", "follow", "tag", "meta", "author", "byline"),
)
#: Groups whose nodes inside an article region are no main text: notices, comments, forms, sharing.
NEVER = 1 << 6 | 1 << 7 | 1 << 8 | 1 << 9
#: Words that label boilerplate, looked for in blocks of at most SHORT characters.
CUES = (
    r"comments?|repl(?:y|ies)|says|wrote|posted by|ago|kommentare?|antworten|schrieb|vor \d+|commentaires?|répondre|a écrit|il y a|comentarios?|responder|dijo|hace \d+", r"cookies?|consent|accept(?:er)?|privacy|datenschutz|zustimmen|aceptar|einverstanden",
    r"newsletter|subscribe|sign ?up|log ?in|anmelden|abonnieren|abonnez|suscríbete|e-?mail|search|suche", r"share|tweet|teilen|partager|compartir|follow us|folgen", r"copyright|all rights|rechte vorbehalten|droits réservés|derechos reservados|impressum",
    r"related|read more|recommended|trending|popular|mehr zum thema|lire aussi|te puede|advertisement|sponsored|anzeige|publicité|publicidad|more from",
)
CUE, SHORT = re.compile("|".join(rf"\b({c})\b" for c in CUES)), 80
EXACT = frozenset(("ad", "ads", "side", "tag", "nav", "head", "foot", "form", "text"))


def groups_of(attributes: str) -> int:
    bits = 0
    for value in ATTRIBUTE.findall(attributes):
        for token in WORD.findall(value.lower()):
            for g, stems in enumerate(GROUPS):
                if any(token == s if s in EXACT and len(token) < 4 else token.startswith(s) for s in stems):
                    bits |= 1 << g
    return bits


def tokens(source: str) -> Iterator[re.Match[str]]:
    """The markup of a page; inside svg a raw-text tag may be self-closed and then holds nothing."""
    at, svg = 0, 0
    while m := TOKEN.search(source, at):
        at = m.end()
        if m[1] and svg and (end := source.find(">", m.start()) + 1) and source[end - 2] == "/":
            at = end
            continue
        if m[3] and m[3].lower() == "svg":
            svg = max(svg - 1, 0) if m[2] else svg + (not m[0].endswith("/>"))
        yield m


def visible(source: str) -> Iterator[tuple[int, int, re.Match[str] | None]]:
    """(start, end, tag) of the markup; a dropped element is one piece of markup without a tag.

    An element is matched with its end tag on the stack of open elements, so one left open ends with its parent.
    """
    if not DROPS.search(source):
        for m in TOKEN.finditer(source):
            yield m.start(), m.end(), m
        return
    found = list(tokens(source))
    stop: dict[int, int] = {}
    names: list[str] = []
    places: list[int] = []
    held: dict[str, int] = {}
    for k, m in enumerate(found):
        name = m[3] and m[3].lower()
        if not name or name in VOID:
            continue
        if not m[2]:
            if name != "svg" and not (held.get("svg") and m[0].endswith("/>")) or name == "svg" and not m[0].endswith("/>"):
                names.append(name)
                places.append(k)
                held[name] = held.get(name, 0) + 1
        elif held.get(name):
            while True:
                top, place = names.pop(), places.pop()
                held[top] -= 1
                if top == name:
                    break
            if name in DROPPED:
                stop[place] = k
    k = 0
    while k < len(found):
        m, last = found[k], found[stop.get(k, k)]
        name = m[3] and m[3].lower()
        yield m.start(), last.end(), None if name in DROPPED and not m[2] else m
        k = stop.get(k, k) + 1


class Page:
    """Block nodes in page order, and the pieces of text with the node that owns each block.

    Open tags are kept with the places of each name, so no step looks through all of them.
    """

    __slots__ = ("blocks", "cues", "depth", "flags", "kin", "link", "owner", "parent", "punct", "size", "tag", "words")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.flags, self.cues, self.kin = [len(TAGS)], [-1], [0], [0], [0], [0]
        self.size, self.link, self.words, self.punct = [0], [0], [0], [0]
        self.owner: list[int] = []
        self.blocks: list[str] = []
        open_tags, open_nodes, open_blocks, links = ["#"], [0], ["#"], 0
        places: dict[str, list[int]] = {}
        kinds: dict[str, int] = {}
        piece: list[str] = []
        linked, at = 0, 0

        def flush() -> None:
            nonlocal linked
            if piece:
                text = SPACE.sub(" ", entities.unescape("".join(piece))).strip()
                piece.clear()
                if text:
                    node = open_nodes[-1]
                    self.owner.append(node)
                    self.blocks.append(text)
                    self.size[node] += len(text)
                    self.link[node] += min(linked, len(text))
                    self.words[node] += text.count(" ") + 1
                    self.punct[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                    if len(text) <= SHORT:
                        for m in CUE.finditer(text.lower()):
                            self.cues[node] |= 1 << m.lastindex - 1
                        if "©" in text:
                            self.cues[node] |= 1 << 4
            linked = 0

        def pop() -> str:
            nonlocal links
            t = open_tags.pop()
            places[t].pop()
            if t == "a":
                links -= 1
            elif t not in INLINE:
                open_nodes.pop()
                open_blocks.pop()
            return t

        def last(names: set[str]) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=0)

        for start, end, m in visible(source):
            if start > at:
                text = source[at:start]
                piece.append(text)
                if links:
                    linked += len(text)
            at = end
            name = m and m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:  # an end tag closes up to its own start, and nothing if that is not open
                if places.get(name):
                    if name not in INLINE:
                        flush()
                    while open_tags[-1] != name:
                        if open_tags[-1] not in INLINE:
                            flush()
                        pop()
                    pop()
                elif name not in INLINE:
                    flush()
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    flush()
                continue
            if name in INLINE:
                places.setdefault(name, []).append(len(open_tags))
                open_tags.append(name)
                links += name == "a"
                continue
            flush()
            if name in CLOSE_P and open_blocks[-1] == "p":
                while pop() != "p":
                    pass
            if name in CLOSES and (k := last(CLOSES[name])) > last(SCOPE[name]):
                while len(open_tags) > k:
                    pop()
            parent = open_nodes[-1]
            self.tag.append(TAG_ID.get(name, len(TAGS)))
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.flags.append(groups_of(m[4]) if m[4] and "=" in m[4] else 0)
            self.kin.append(kinds.setdefault(name + " " + " ".join(ATTRIBUTE.findall(m[4])), len(kinds)))
            for field in (self.size, self.link, self.words, self.punct, self.cues):
                field.append(0)
            places.setdefault(name, []).append(len(open_tags))
            open_tags.append(name)
            open_nodes.append(len(self.tag) - 1)
            open_blocks.append(name)
        if at < len(source):
            piece.append(source[at:])
        flush()


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, depth) of all nodes of the pages, parents before children; roots have parent -1."""
    count = np.array([len(p.tag) for p in pages])
    base = np.repeat(np.cumsum(count) - count, count)
    get = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    tag, depth, flags, cues = get("tag"), get("depth"), get("flags"), get("cues")
    parent = get("parent")
    parent = np.where(parent < 0, -1, parent + base)
    own = np.stack([get("size"), get("link"), get("words"), get("punct"), np.ones(len(tag), np.int64), (tag == TAG_ID["p"]).astype(np.int64), (tag == TAG_ID["li"]).astype(np.int64)], axis=1).astype(float)
    total = own.copy()
    above, below = flags.copy(), cues.copy()
    tags_above = np.left_shift(np.int64(1), tag)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        level = order[cuts[d] : cuts[d + 1]]
        np.add.at(total, parent[level], total[level])
        np.bitwise_or.at(below, parent[level], below[level])
    for d in range(1, int(depth.max()) + 1):
        level = order[cuts[d] : cuts[d + 1]]
        above[level] |= above[parent[level]]
        tags_above[level] |= tags_above[parent[level]]
    up = np.maximum(parent, 0)
    siblings = np.bincount(up, minlength=len(tag))[up].astype(float)
    n = np.arange(len(tag))
    _, same, times = np.unique(up * (int(get("kin").max()) + 1) + get("kin"), return_inverse=True, return_counts=True)
    first = np.full(len(tag), len(tag))
    np.minimum.at(first, up, n)
    last = np.zeros(len(tag), np.int64)
    np.maximum.at(last, up, n)
    roots = np.cumsum(count) - count
    page_size = np.maximum(total[roots, 0], 1)[np.repeat(np.arange(len(pages)), count)]
    size = np.maximum(total[:, 0], 1)
    cols = [total[:, 0], own[:, 0], total[:, 1] / size, own[:, 1] / np.maximum(own[:, 0], 1), total[:, 2] / total[:, 4], total[:, 0] / total[:, 4], total[:, 3] / np.maximum(total[:, 2], 1), total[:, 5], total[:, 6] / total[:, 4],
            depth, siblings, (n - first[up]) / np.maximum(last[up] - first[up], 1), total[:, 0] / np.maximum(total[up, 0], 1), total[:, 0] / page_size, total[up, 0] / np.maximum(siblings, 1), total[up, 1] / np.maximum(total[up, 0], 1), times[same]]
    for bits, width in ((cues, len(CUES)), (below, len(CUES)), (flags, len(GROUPS)), (above, len(GROUPS)), (tags_above, len(TAGS))):
        cols += [(bits >> g) & 1 for g in range(width)]
    cols += [(tag == t) for t in range(len(TAGS))]
    return np.stack([np.asarray(c, np.float32) for c in cols], axis=1), parent, depth


class Boosted:
    """Gradient-boosted depth-wise trees for a yes-no target, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        qs = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], qs)) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        n_bins = BINS + 1
        self.trees, score = [], np.zeros(len(y))
        offset = binned + np.arange(x.shape[1]) * n_bins
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            leaf = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1, np.float32)
            sums: dict[int, np.ndarray] = {}
            for level in range(DEPTH):
                members = np.bincount(leaf, minlength=2**level)
                # of two sisters only the smaller is summed up; the other one is what is left of their parent
                for k in sorted(range(2**level), key=lambda k: members[k]):
                    here, sister, above = 2**level - 1 + k, 2**level - 1 + (k ^ 1), (2**level - 2 + k) // 2
                    if level and sister in sums:
                        sums[here] = sums[above] - sums[sister]
                    else:
                        rows = np.flatnonzero(leaf == k)
                        width = x.shape[1] * n_bins
                        flat = offset[rows].ravel()
                        sums[here] = np.stack([np.bincount(flat, np.repeat(v[rows], x.shape[1]), width).reshape(-1, n_bins) for v in (g, h)])
                for k in range(2**level):
                    if members[k] < 8:
                        continue
                    gs, hs = sums[2**level - 1 + k].cumsum(axis=2)
                    gt, ht = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    for j, e in enumerate(self.edges):
                        gain[j, len(e) :] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-3:
                        feature[2**level - 1 + k], cut[2**level - 1 + k] = j, self.edges[j][b]
                leaf = self._step(x, leaf, feature, cut, level)
            value = np.zeros(2**DEPTH)
            gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
            value = -RATE * gs / (hs + 1)
            score += value[leaf]
            self.trees.append((feature, cut, value.astype(np.float32)))
        return self

    @staticmethod
    def _step(x: np.ndarray, leaf: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        f = feature[2**level - 1 + leaf]
        right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[2**level - 1 + leaf])
        return 2 * leaf + right

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                leaf = self._step(x, leaf, feature, cut, level)
            out += value[leaf]
        return out


def decode(score: np.ndarray, size: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best total in which everything below a dropped node is dropped.

    A node's stake is its log-odds weighted by the root of its own text; nodes without text of their
    own have a small stake, so they follow their descendants unless they clearly are boilerplate.
    """
    gain = score * (0.3 + np.sqrt(size))
    drop = -gain
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    alive, dead = gain.copy(), drop.copy()
    for d in range(int(depth.max(initial=0)), 0, -1):
        level = order[cuts[d] : cuts[d + 1]]
        np.add.at(alive, parent[level], np.maximum(alive[level], dead[level]))
        np.add.at(dead, parent[level], dead[level])
    kept = alive > dead
    for d in range(1, int(depth.max(initial=0)) + 1):
        level = order[cuts[d] : cuts[d + 1]]
        kept[level] &= kept[parent[level]]
    return kept


def extract(pages: list[str], model: Boosted) -> list[str]:
    parsed = [Page(p) for p in pages]
    if not parsed:
        return []
    x, parent, depth = features(parsed)
    kept = decode(model.scores(x), x[:, 1].astype(float), parent, depth)
    out, base = [], 0
    for p in parsed:
        out.append(" ".join([b for b, o in zip(p.blocks, p.owner, strict=True) if kept[base + o]]))
        base += len(p.tag)
    return out


#: Where boilerplate stands in the dealt layouts: tags and attribute values.
BEFORE = (("header", "site-header"), ("div", "header masthead"), ("nav", "main-nav"), ("div", "nav menu topbar"), ("div", "ad"), ("div", "cookie-consent notice"), ("div", "alert notice"), ("form", "search"), ("aside", "sidebar"), ("div", "breadcrumbs"))
AFTER = (("aside", "sidebar widget"), ("div", "related posts"), ("section", "comments"), ("div", "comment-list"), ("div", "sponsor advert"), ("form", "newsletter subscribe"), ("div", "share social"), ("footer", "site-footer"), ("div", "footer legal"), ("div", "promo banner"))
WITHIN = (("div", "ad"), ("aside", "related"), ("div", "share-buttons"), ("form", "signup"), ("div", "newsletter"), ("nav", "toc"), ("div", "comments"))
AROUND = (("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry-content article-body"), ("section", "story"), ("article", "post"))


#: What stands in front of boilerplate of a kind, by language.
LABELS = {
    "comments": ("Comments ({n})", "{n} comments", "Kommentare ({n})", "{n} commentaires", "Comentarios ({n})", "Leave a reply"), "notice": ("We use cookies.", "Accept cookies", "Wir verwenden Cookies", "Accepter les cookies", "Aceptar cookies"),
    "offer": ("Subscribe to our newsletter", "Newsletter", "Sign up", "Jetzt anmelden", "Abonnez-vous", "Suscríbete"), "share": ("Share", "Share this", "Teilen", "Partager", "Compartir"), "rights": ("© {n} All rights reserved", "Copyright {n}", "Impressum"),
    "more": ("Related", "Read more", "Advertisement", "Anzeige", "Publicité", "Publicidad", "Mehr zum Thema", "Lire aussi", "Sponsored"),
}
STAMPS = ("{n} days ago", "{n} hours ago", "vor {n} Tagen", "il y a {n} heures", "hace {n} días", "says:", "wrote:", "2021-03-{n}")
ANSWERS = ("Reply", "Antworten", "Répondre", "Responder")


def layouts(texts: list[list[str]], seed: int) -> tuple[list[str], list[set[str]]]:
    """Pages dealt from known paragraphs into layouts, and the set of paragraphs that are main text."""
    rng = random.Random(seed)
    pages, mains = [], []
    element = lambda t, c, body: f'<{t}{f" class=\"{c}\"" if c else ""}>{body}</{t}>'
    unknown = lambda: "".join(rng.choice("bcdfghjklmnqvwxz") for _ in range(rng.randrange(2, 7)))
    label = lambda kind: rng.choice(LABELS[kind]).format(n=rng.randrange(2, 30))

    def short(n: int) -> str:
        return entities.escape(" ".join(rng.choices(rng.choice(rng.choice(texts)).split(), k=n)))

    def comments(c: str) -> str:
        """Reader comments under a heading or with authors and times, in containers that need not be named."""
        name, heading, signed = unknown() if rng.random() < 0.5 else "comment", rng.random() < 0.7, rng.random() < 0.7
        out = [element(rng.choice(("h2", "h3", "h4", "div", "p")), "", label("comments"))] if heading else []
        for _ in range(rng.randrange(2, 6)):
            said = element(rng.choice(("p", "p", "div")), "", short(rng.randrange(3, 40)))
            if signed or not heading:
                who = element(rng.choice(("div", "p", "header", "span")), "", element(rng.choice(("b", "strong", "span", "a")), "", short(1).title()) + " " + rng.choice(STAMPS).format(n=rng.randrange(1, 28)))
                said = who + said + (element("a", "", rng.choice(ANSWERS)) if rng.random() < 0.5 else "")
            out.append(element(rng.choice(("div", "li")) if rng.random() < 0.9 else "section", name, said))
        return element(rng.choice(("div", "section")), c, "".join(out))

    def junk(t: str, c: str) -> str:
        kind = "comments" if "comment" in c else "notice" if "notice" in c else "offer" if t == "form" or "newsletter" in c else "share" if "share" in c else "rights" if "foot" in c else "more"
        if rng.random() < 0.25:
            c = unknown()
        if kind == "comments":
            return comments(c)
        head = element(rng.choice(("h3", "h4", "p", "span", "div")), "", label(kind)) if rng.random() < 0.5 else ""
        if t == "form":
            return element(t, c, f"{head}<label>{short(2)}</label><input><button>{short(1)}</button>")
        if t == "nav" or rng.random() < 0.4:
            return element(t, c, head + "<ul>" + "".join(f'<li><a href="/{i}">{short(rng.randrange(1, 4))}</a></li>' for i in range(rng.randrange(3, 8))) + "</ul>")
        return element(t, c, head + (element("p", "", short(rng.randrange(3, 25))) if rng.random() < 0.5 else short(rng.randrange(3, 20))))

    for paragraphs in texts:
        for _ in range(4):
            title = " ".join(SPACE.sub(" ", paragraphs[0]).split(" ")[: rng.randrange(1, 11)])
            body = [element(rng.choice(("h1", "h1", "h2")), "", entities.escape(title))] if rng.random() < 0.8 else []
            body += [element(rng.choice(("p", "p", "p", "h2", "blockquote", "li")), "", entities.escape(t)) for t in paragraphs]
            main = len(body)
            style = rng.random()
            if style < 0.15:  # cells of a layout table
                body = [element("tr", "", element("td", rng.choice(("", unknown())), b)) for b in body]
            elif style < 0.35 and main > 2:  # parts in unnamed containers
                k = rng.randrange(1, main)
                body = [*body[:k], element(rng.choice(("div", "section")), rng.choice(("", unknown())), "".join(body[k:]))]
            if style >= 0.15 and rng.random() < 0.4:
                body.insert(rng.randrange(1, len(body) + 1), junk(*rng.choice(WITHIN)))
            if style >= 0.15 and rng.random() < 0.35:
                body.append(comments(rng.choice(("comments", unknown(), unknown(), ""))))
            top = "".join(junk(*rng.choice(BEFORE)) for _ in range(rng.randrange(0, 4)))
            end = "".join(junk(*rng.choice(AFTER)) for _ in range(rng.randrange(0, 4)))
            tag, name = rng.choice(AROUND) if style >= 0.15 else ("table", rng.choice(("", unknown())))
            middle = top + element(tag, name, "".join(body)) + end
            if rng.random() < 0.4:
                middle = element("div", rng.choice(("wrapper", "container", "page", "")), middle)
            pages.append(f"<html><body>{middle}</body></html>")
            mains.append({SPACE.sub(" ", t).strip() for t in [*paragraphs, title]})
    return pages, mains


def fitted(samples: list[str], seed: int = 7) -> Boosted:
    """Trees fitted on sample pages labelled by their article regions, and on layouts dealt from their texts."""
    parsed, labels, texts = [], [], []
    for source in samples:
        page = Page(source)
        inside = [False] * len(page.tag)
        for i in range(1, len(page.tag)):
            inside[i] = (inside[page.parent[i]] or page.tag[i] < 2) and not page.flags[i] & NEVER
        if any(inside):
            parsed.append(page)
            labels.append(_up(page, inside))
            own = [b for b, o in zip(page.blocks, page.owner, strict=True) if inside[o] and len(b) > 20]
            if own:
                texts.append(own[:12])
    texts = texts or [["Some plain prose stands here, to have any text at all.", "And a second paragraph, a little longer than the first one was."]]
    pages, mains = layouts(texts, seed)
    for source, main in zip(pages, mains, strict=True):
        page = Page(source)
        found = [False] * len(page.tag)
        for b, o in zip(page.blocks, page.owner, strict=True):
            found[o] |= b in main
        parsed.append(page)
        labels.append(_up(page, found))
    x, _, _ = features(parsed)
    return Boosted().fit(x, np.array([v for own in labels for v in own], float), 1 + np.log1p(x[:, 1]))


def _up(page: Page, inside: list[bool]) -> list[bool]:
    """A node that holds main text is not boilerplate."""
    out = list(inside)
    for i in range(len(out) - 1, 0, -1):
        if out[i]:
            out[page.parent[i]] = True
    return out


def main_text(pages: DataFrame, html: str = "html", ident: str = "page_id", carry: tuple[str, ...] = ("page_id", "url"), sample: int = SAMPLE) -> DataFrame:
    """One row a page: carry columns, text, n_chars (code points).

    Null and empty pages have empty texts.  Blocks come in page order, joined by a space; character
    references are decoded and white space inside a block is one space.  Fitting reads ``sample``
    pages (the smallest identifiers); every page is then extracted whole.
    """
    first = [r[0] for r in pages.where(F.col(html).isNotNull()).select(ident).orderBy(ident).limit(sample).collect()]
    rows = pages.where(F.col(ident).isin(first)).orderBy(ident, html).limit(sample).select(html).collect() if first else []
    model = fitted([r[0] for r in rows if r[0]])
    src = pages.select(*carry, pages[html].alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carry).schema) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, part, size = [], [], 0
            for v in batch.column(len(carry)):
                part.append(v.as_py() or "")
                size += len(part[-1])
                if size > CHUNK:
                    out += extract(part, model)
                    part, size = [], 0
            out += extract(part, model)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(carry))], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[*carry, "text", "n_chars"])

    return src.mapInArrow(run, schema)
