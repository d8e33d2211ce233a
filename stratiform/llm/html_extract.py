"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a variable with two states, content or not; log-linear
potentials score an element's own features (tag, words in class and id, text length, link share, place) and
the states of parent and child. Messages pass from the leaves to the root and
back, which gives each element's exact marginal; text whose element is content with a probability above one half is kept.
Weights maximise the likelihood of labelled pages, by gradient ascent with the same messages.

Elements that are never shown as text (head, script, style, form controls, pictures, films and what stands in for them) are
left out by the parser, until their end tag or their parent's end; one that has no end tag in the rest of the page
hides nothing but itself, and a block element ends a picture or an option outside of a list. Formulas and xmp are kept. A null or
empty page, and one without any content, gives the empty text. Broken mark-up is closed where a browser would
close it; a cut-off page ends where it ends, and a quote that is never closed ends at the next > . Pages of any length are parsed whole, a repeated
row is extracted each time, a probability of exactly one half doesn't keep, and an empty table gives an empty result. Other
columns, whatever their names, may be kept.
"""

from __future__ import annotations

import html as _html
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, give_back, named, slices, unused

# Kinds of HTML elements and common class words.
RAW = {"script", "style", "textarea", "title"}
# Not shown, nor is what is inside: until their end tag or their parent's end.
QUIET = {"noscript", "iframe", "template", "svg", "object", "canvas", "audio", "video", "select", "annotation", "annotation-xml"}
MATH = {"math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mpadded", "mphantom", "menclose", "merror", "mtable", "mtr", "mtd", "mspace"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "center"} | MATH
HIDDEN = {"head", "button", "option", "datalist", "dialog"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
BLOCK = CLOSES_P - {"details"} | {"body", "li", "dd", "dt"}  # what ends a picture (svg)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "option": {"select"}}
INLINE_STOP = {"p", "div", "article", "section", "td", "li", "body"}
P_STOP = {"article", "div", "section", "td", "li", "blockquote", "body", "table", "form", "aside"}
CLASS_WORDS = {
    "main": "article content post entry story main body text page-content post-content article-body entry-content main-content maintext prose",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip topbar",
    "head": "header masthead head top site-header banner-top logo branding",
    "foot": "footer foot bottom copyright legal site-footer colophon",
    "side": "sidebar side aside widget widgets related recommended more popular trending rail secondary",
    "note": "cookie cookies consent gdpr notice alert banner popup modal overlay newsletter subscribe privacy paywall",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense banner-ad teaser",
    "form": "form login signin signup search contact",
    "comment": "comment comments commentlist respond responses reply replies discussion disqus reviews",
    "share": "share sharing social tags meta byline author date follow",
}
WORD_OF = {w: k for k, ws in CLASS_WORDS.items() for w in ws.split()}
TAGS = ["html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "dl", "dd", "dt", "table", "tr", "td", "th", "tbody", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "address", "hr", "details"]
FEATURES = ["bias", "tag:other", *(f"tag:{t}" for t in TAGS), *(f"class:{k}" for k in CLASS_WORDS), "text0", "text1", "text2", "text3", "links", "all_links", "stop", "copyright", "leaf", "under_main", "first_half", "passes", "parts"]
AT = {f: i for i, f in enumerate(FEATURES)}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|$)|<([a-zA-Z][^\s>/]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9-]+")


class Page:
    """Block elements in page order: tag, parent, class words, and the text runs with their element."""

    def __init__(self, source: str):
        self.tags, self.parent, self.words, self.runs = ["#"], [-1], [()], []
        self.link_chars: dict[int, int] = {}
        stack: list[tuple[str, int]] = [("#", 0)]
        places: dict[str, list[int]] = {}  # where in the stack each tag is open, so that no look-up walks it
        run: list[str] = []
        hidden = links = quiet = 0
        ends: dict[str, int] = {}  # the next end tag of a QUIET element or xmp, len(source) if there is none

        def end_run():
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.runs.append((stack[-1][1], text))
                run.clear()

        def add_text(raw: str):
            if hidden:
                return
            t = _html.unescape(raw)
            run.append(t)
            if links:
                self.link_chars[stack[-1][1]] = self.link_chars.get(stack[-1][1], 0) + len(t.strip())

        def close_to(depth: int):
            nonlocal hidden, links, quiet
            while len(stack) > depth:
                tag = stack[-1][0]
                if not quiet and tag not in INLINE:
                    end_run()
                hidden -= tag in HIDDEN or tag in QUIET
                quiet -= tag in QUIET
                links -= tag == "a"
                stack.pop()
                places[tag].pop()

        def push(tag: str, node: int):
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))

        def last(names: set[str]) -> int:
            return max((at[-1] for t in names if (at := places.get(t))), default=0)

        def find(names: set[str], stop: set[str]) -> int:
            """The innermost open element of these names, 0 if there is none or one of `stop` is inside of it."""
            i = last(names)
            return i if i and i >= last(stop) else 0

        def next_end(tag: str) -> int:
            if ends.get(tag, -1) < at:
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(source, at)
                ends[tag] = m.start() if m else n
            return ends[tag]

        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                add_text(source[at:])
                break
            if m.start() > at:
                add_text(source[at : m.start()])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag == "p" and not quiet and not find({"p"}, set()):
                    end_run()
                if tag == "br":
                    run.append(" ")
                elif i := find({tag}, set() if tag not in INLINE else INLINE_STOP):
                    close_to(i)
            elif m[2]:
                tag, attrs = m[2].lower(), m[3] or ""
                if tag in RAW:
                    if not attrs.rstrip().endswith("/"):
                        end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|$)", re.I).search(source, at)
                        at = end.end() if end else n
                    continue
                if tag == "xmp" and (end := next_end(tag)) < n:
                    if not quiet and not hidden:
                        end_run()
                        self.tags.append("pre")
                        self.parent.append(stack[-1][1])
                        self.words.append(())
                        push(tag, len(self.tags) - 1)
                        run.append(source[at:end])
                        close_to(len(stack) - 1)
                    at = source.find(">", end) + 1 or n
                    continue
                if tag in BLOCK and (i := find({"option"}, {"select", "datalist"})):
                    close_to(i)
                if quiet and tag in BLOCK and (i := find({"svg"}, QUIET - {"svg"})):
                    close_to(i)
                if tag == "body" and (i := find({"head"}, set())):
                    close_to(i)
                if quiet or tag in QUIET:
                    if tag not in VOID and not attrs.rstrip().endswith("/") and (tag not in QUIET or next_end(tag) < n):
                        push(tag, stack[-1][1])
                        hidden += tag in HIDDEN or tag in QUIET
                        links += tag == "a"
                        quiet += tag in QUIET
                    continue
                if tag in VOID:
                    run.append(" ")
                    if tag == "hr":
                        end_run()
                    continue
                if tag in CLOSES_P and (i := find({"p"}, P_STOP)):
                    close_to(i)
                if tag in SAME and (i := find(SAME[tag], STOP.get(tag, set()))):
                    close_to(i)
                if tag in INLINE:
                    push(tag, stack[-1][1])
                    links += tag == "a"
                else:
                    end_run()
                    node = len(self.tags)
                    self.tags.append(tag)
                    self.parent.append(stack[-1][1])
                    self.words.append(tuple(w for a in _ATTR.finditer(attrs) for w in _SPLIT.split(a[2].strip("\"'").lower()) if w))
                    push(tag, node)
                    hidden += tag in HIDDEN
                    if attrs.rstrip().endswith("/"):
                        close_to(len(stack) - 1)
        close_to(1)
        end_run()

    def features(self) -> np.ndarray:
        n = len(self.tags)
        x = np.zeros((n, len(FEATURES)))
        x[:, AT["bias"]] = 1
        own, links = np.zeros(n), np.zeros(n)
        stops, marks = np.zeros(n), np.zeros(n)
        for node, text in self.runs:
            own[node] += len(text)
            stops[node] += sum(text.count(c) for c in ".!?")
            marks[node] += "©" in text or "copyright" in text.lower() or "all rights" in text.lower()
        for node, c in self.link_chars.items():
            links[node] += c
        total, total_links = own.copy(), links.copy()
        kids = np.zeros(n)
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += total[i]
            total_links[self.parent[i]] += total_links[i]
            kids[self.parent[i]] += 1
        main = np.zeros(n, bool)
        for i in range(1, n):
            x[i, AT.get(f"tag:{self.tags[i]}", AT["tag:other"])] = 1
            for w in self.words[i]:
                for part in {w, *w.split("-")}:
                    if part in WORD_OF:
                        x[i, AT[f"class:{WORD_OF[part]}"]] = 1
            main[i] = main[self.parent[i]] or self.tags[i] in ("article", "main") or bool(x[i, AT["class:main"]])
        size = np.digitize(total, [1, 40, 200])
        for k in range(4):
            x[:, AT[f"text{k}"]] = size == k
        share = total_links / np.maximum(1, total)
        x[:, AT["links"]], x[:, AT["all_links"]] = np.minimum(1, share), share > 0.8
        x[:, AT["stop"]], x[:, AT["copyright"]] = stops > 0, marks > 0
        x[:, AT["leaf"]], x[:, AT["under_main"]] = kids == 0, main
        x[:, AT["first_half"]] = np.arange(n) < n / 2
        # layout: no text of its own, one part or several
        x[:, AT["passes"]], x[:, AT["parts"]] = (kids == 1) & (own == 0), (kids > 1) & (own == 0)
        # a box around one other says nothing else, so that any number of them hands the states on
        silent = (x[:, AT["passes"]] > 0) & np.isin(self.tags, ["div", "section"]) & (x[:, [AT[f"class:{k}"] for k in CLASS_WORDS]].sum(1) == 0)
        x[silent] = 0
        x[silent, AT["passes"]] = 1
        return x


class Forest:
    """Many pages' trees as one: parents, and the elements of each depth."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0, *(len(p.tags) for p in pages)])
        self.starts = starts
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts, strict=False)]) if pages else np.zeros(0, int)
        depth = np.zeros(len(self.parent), int)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product in log space: element marginals [n, 2] and edge marginals [n, parent, child]."""
        n = len(self.parent)
        lse = lambda a, ax: np.logaddexp.reduce(a, axis=ax)
        below = unary.copy()  # own potential and all messages from children
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            up[level] = lse(pair[None] + below[level][:, None, :], 2)
            np.add.at(below, self.parent[level], up[level])
        down = np.zeros((n, 2))
        edge = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = below[p] + down[p] - up[level]
            down[level] = lse(rest[:, :, None] + pair[None], 1)
            e = rest[:, :, None] + pair[None] + below[level][:, None, :]
            e -= lse(e.reshape(len(level), 4), 1)[:, None, None]
            edge[level] = np.exp(e)
        node = below + down
        node -= lse(node, 1)[:, None]
        return np.exp(node), edge


class ContentModel:
    def fit(self, pages: list[tuple[str, list[int]]], rounds: int = 200, rate: float = 0.1, l2: float = 0.05) -> ContentModel:
        """pages: source, and for each element of Page(source) whether it is content."""
        trees = [Page(s) for s, _ in pages]
        forest, x = Forest(trees), np.concatenate([t.features() for t in trees])
        y = np.concatenate([np.array(g) for _, g in pages])
        root = forest.parent < 0
        onehot = np.eye(2)[y]
        kids = np.flatnonzero(~root)
        gold_pair = np.zeros((2, 2))
        np.add.at(gold_pair, (y[forest.parent[kids]], y[kids]), 1)
        self.weights, self.pair = np.zeros(x.shape[1]), np.zeros((2, 2))
        theta = [self.weights, self.pair]
        m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        for step in range(1, rounds + 1):
            node, edge = forest.marginals(self._unary(x), self.pair)
            for i, g in enumerate((x.T @ (onehot[:, 1] - node[:, 1]), gold_pair - edge.sum(0))):
                g = g - l2 * theta[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                theta[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def _unary(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(x)), x @ self.weights], 1)

    def extract(self, sources: list[str | None]) -> list[str]:
        trees = [Page(s or "") for s in sources]
        if not trees:
            return []
        forest = Forest(trees)
        node, _ = forest.marginals(self._unary(np.concatenate([t.features() for t in trees])), self.pair)
        out = []
        for t, s in zip(trees, forest.starts, strict=False):
            out.append("\n".join(text for at, text in t.runs if node[s + at, 1] > 0.5))
        return out


def labelled_pages(n: int = 240, seed: int = 11, wide: bool = False) -> list[tuple[str, list[int]]]:
    """The labelled pages that the model learns from, drawn from page plans with a fixed seed.

    The article is marked with data-c="1" while the page is written, and what disturbs it with data-c="0";
    an element's label is that of the nearest mark above it. Wide pages also have elements of layout in many levels, articles in
    the body itself, loose text, article heads, lists and headings of other kinds.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvwz") for _ in range(r.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice(["."] * 4 + [""])
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    rarely = lambda p: wide and r.random() < p

    def wrapped(inner: str, p: float = 0.3, mark: str = "") -> str:
        """The inner mark-up, now and then in elements of layout that say nothing about it; they are marked as what they hold."""
        if rarely(p):
            for _ in range(r.choice([1, 1, 2, 2, 3, 4, 8, 20])):
                tag = r.choice(["div", "div", "div", "section"])
                attr = r.choice(["", "", f' class="{r.choice(["wrapper", "container", "row", "col", "inner", "block", "box", "group", "module", word()])}"', f' id="{word()}"'])
                inner = f"<{tag}{attr}{mark}>{inner}</{tag}>"
        return inner

    def boxed(parts: list[str], p: float) -> str:
        """The parts in elements of layout, marked as noise if nothing else is in them."""
        return wrapped("".join(parts), p, ' data-c="0"' * all(x.startswith("<") and 'data-c="0"' in x.split(">", 1)[0] for x in parts))

    def noise(kind: str) -> str:
        return wrapped(plain_noise(kind), 0.2, ' data-c="0"')

    def other() -> str:
        """A piece of an article that only wide pages have."""
        h = r.choice(["h2", "h3", "h4"])
        return r.choice([f"<{h}>{say(2, 7)}</{h}><p>{say(10, 60)}</p>", f"<{(u := r.choice(['ol', 'ol', 'ul']))}>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(r.randint(1, 4))) + f"</{u}>", f"{say(10, 60)}<br><br>{say(10, 60)}", f"<div>{say(10, 60)}</div>", f"<table><tr><th>{say(1, 2)}</th></tr><tr><td>{say(1, 4)}</td></tr></table>", f"<dl><dt>{say(1, 3)}</dt><dd>{say(3, 12)}</dd></dl>", f"<details><summary>{say(1, 4)}</summary><p>{say(8, 30)}</p></details>", noise("foot")])

    def plain_noise(kind: str) -> str:
        c = r.choice(CLASS_WORDS[kind].split())
        box = lambda inner, tag="div": f'<{tag} {r.choice(["class", "id"])}="{c}" data-c="0">{inner}</{tag}>'
        plain = lambda inner, tag: f'<{tag} data-c="0">{inner}</{tag}>'
        p = lambda a=4, b=20: f"<p>{say(a, b)}</p>"
        return {
            "nav": lambda: r.choice([plain(links(3, 8), "nav"), box(links(3, 8)), box(links(2, 5), "nav")]),
            "head": lambda: r.choice([plain(f"<h1>{say(2, 4)}</h1>" + r.choice(["", links(2, 5), p(3, 8)]), "header"), box(r.choice([say(2, 5), links(2, 4)]))]),
            "foot": lambda: r.choice([plain(f"&copy; {word()} &middot; {say(4, 12)}", "footer"), plain(p() + links(1, 4), "footer"), box(f"Copyright {say(3, 12)}")]),
            "side": lambda: r.choice([plain(f"<h3>{say(1, 3)}</h3>" + r.choice([links(2, 6), p(8, 25)]), "aside"), box(f"<h3>{say(1, 3)}</h3>" + r.choice([links(2, 6), p(8, 25)]))]),
            "note": lambda: box(r.choice([p(6, 25), say(6, 20)])),
            "ad": lambda: box(r.choice([say(4, 14), p(4, 20), f'<a href="/x">{say(3, 8)}</a>'])),
            "form": lambda: f'<form data-c="0"><p>{say(2, 6)}</p><input name="q"></form>',
            "comment": lambda: r.choice([box(f"<h3>{say(1, 3)}</h3>" + "".join(f"<div><b>{word()}</b><p>{say(6, 40)}</p></div>" for _ in range(r.randint(1, 4)))), box("<ol>" + "".join(f"<li>{say(6, 40)}</li>" for _ in range(r.randint(1, 4))) + "</ol>", "section")]),
            "share": lambda: box(links(2, 4)),
        }[kind]()

    def body(least: int = 1) -> str:
        out = [f"<h1>{say(3, 9)}</h1>"] if r.random() < 0.85 else []
        if out and rarely(0.3):
            h = r.choice(["h2", "h3"])
            out[0] = r.choice([f"<header>{out[0]}</header>", f"<{h}>{say(3, 9)}</{h}>"])  # an article's own head is part of it
        for _ in range(r.randint(least, 9)):
            if rarely(0.2):
                out.append(other())
                continue
            out.append(r.choices([lambda: f"<p>{say(8, 90)}</p>", lambda: f"<p>{say(1, 6)}</p>", lambda: f"<p><b>{say(10, 60)}<br>", lambda: f"<h2>{say(2, 7)}</h2><p>{say(10, 60)}</p>", lambda: "<ul>" + "".join(f"<li>{say(3, 15)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{say(8, 40)}</p></blockquote>", lambda: f"<p>{say(8, 30)} <a href='/{word()}'>{word()}</a> {say(5, 20)}</p>", lambda: f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>", lambda: f"<pre>{say(4, 12)}</pre>", lambda: f"<figure><figcaption>{say(3, 10)}</figcaption></figure>", lambda: noise(r.choice(["ad", "side", "share", "note", "form"]))], [30, 6, 5, 6, 4, 3, 6, 2, 1, 1, 6])[0]())
        if rarely(0.2):
            at = r.randint(0, len(out))
            out = [boxed(out[:at], 0.7), boxed(out[at:], 0.7)]
        return "".join(boxed([x], 0.08) for x in out)

    pages = []
    for _ in range(n):
        cls = r.choice(CLASS_WORDS["main"].split())
        tag, attr = r.choice([("article", ""), ("article", ""), ("article", f' class="{cls}"'), ("main", ""), ("div", f' class="{cls}"'), ("div", f' id="{cls}"'), ("section", f' class="{cls}"')])
        core = f'<{tag}{attr} data-c="1">{wrapped(body(), 0.25)}</{tag}>'
        bare = rarely(0.15)  # the article stands in the body itself; a few lines alone can't be told from a notice
        if bare:
            core = body(4)
        elif r.random() < 0.3:
            core = f"<main>{core}{noise('comment') if r.random() < 0.5 else ''}</main>" if tag != "main" else core
        if not bare and r.random() < 0.3:
            core = f'<div class="{r.choice(["wrapper", "container", "row", "page", "site"])}">{core}</div>'
        before = "".join(noise(k) for k in r.sample(["nav", "head", "note", "ad", "side", "form"], r.randint(0, 4)))
        after = "".join(noise(k) for k in r.sample(["comment", "side", "ad", "share", "form", "nav"], r.randint(0, 3))) + (noise("foot") if r.random() < 0.85 else "")
        source = f"<!DOCTYPE html><html><head><title>{say(2, 5)}</title></head><body{' data-c="1"' * bare}>{before}{core}{after}" + r.choice(["</body></html>", ""])
        pages.append((source, marks(source)))
    return pages


def marks(source: str) -> list[int]:
    """Labels of the elements of a page with data-c marks."""
    page = Page(re.sub(r'(?:class|id)="[^"]*"', "", source).replace('data-c="', 'class="c'))
    out: list[int] = []
    for parent, words in zip(page.parent, page.words, strict=True):
        own = [w for w in words if w in ("c0", "c1")]
        above = out[parent] if parent >= 0 else 0
        out.append(int(own[0] == "c1") if own else above)
    return out


@cache
def train() -> ContentModel:
    pages = [(re.sub(r' data-c="[01]"', "", s), g) for s, g in [*labelled_pages(), *labelled_pages(360, 13, wide=True)]]
    return ContentModel().fit(pages)


def extract(pages: DataFrame, model: ContentModel, *, html: str = "html", keep: list[str]) -> DataFrame:
    """`keep` columns of every page, its main text, and the text's code points; one pass without a shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = pages.select(*named(*keep))
    at = unused(keep, "_html")

    def run(batches):
        for b in batches:
            for s in slices(b, at, 2 << 20):
                texts = shared.value.extract(s.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(s.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])
        give_back()

    return pages.select(*named(*keep), F.col(html).alias(at)).mapInArrow(run, ddl(kept, "text string", "n_chars long"))
