"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags. A bidirectional LSTM in numpy reads, for each
block, its tag path, its hashed words and a few counts, and labels every block as main text or not with the whole page
as context. It is trained on pages from a fixed generator that knows each block's label.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.nn import Adam, BiLstm, Parts, fitted, sigmoid

# --- blocks of a page ------------------------------------------------------------------------------------------------

#: Elements that neither hold text nor are closed; whose content is no text; that sit inside lines. What
#: stands in other elements (noscript, template, object, iframe, svg, math, textarea) is judged by the labeller like any
#: text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split()
)
#: What an opening tag closes, if it is open and no element of the second set is open inside it.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "noscript": (set(), set()), "template": (set(), set())}
#: Comments end where browsers end them: at once after `<!-->` and `<!--->`, else at `-->` or `--!>`.
MARKUP = re.compile(r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)|<[!?/]")
#: Attributes up to the tag's end: names, and values, which are quoted only if the quote comes right after the `=`. Elsewhere
#: a quote is a character like any other.
ATTRIBUTES = re.compile(r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?|=)*+>""")
NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PARTS = re.compile(r"[A-Za-z]+")
RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}

class Paths:
    """Places in the trees of pages: a number for each path of (tag, names in its class, id and role). A path is its
    parent's and one step more, so a deep tree takes no more room than its tags."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str, str], int] = {}
        self.steps: list[tuple[int, str, str]] = [(-1, "", "")]

    def child(self, parent: int, tag: str, names: str) -> int:
        step = (parent, tag, names)
        k = self.known.get(step)
        if k is None:
            k = self.known[step] = len(self.steps)
            self.steps.append(step)
        return k


class Stack:
    """Open elements. Knows where each tag was opened last, so that no look-up walks through the stack."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("", 0)]
        self.last: dict[str, list[int]] = {}
        self.links = 0

    def push(self, tag: str, place: int) -> None:
        self.last.setdefault(tag, []).append(len(self.open))
        self.links += tag == "a"
        self.open.append((tag, place))

    def depth(self, tags: Iterable[str]) -> int:
        """Where the innermost of these tags is open, 0 if none is."""
        return max((self.last[t][-1] for t in tags if self.last.get(t)), default=0)

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, _ = self.open.pop()
            self.last[tag].pop()
            self.links -= tag == "a"


def blocks(page: str, paths: Paths) -> list[tuple[int, str, int, int]]:
    """(path, text, characters inside links, number of links) of each leaf block. A page in which a quote is left open
    has its tags end at the next `>` from there on. Every step looks at a part of the page once."""
    out: list[tuple[int, str, int, int]] = []
    stack = Stack()
    parts: list[str] = []
    place = links = link_chars = 0
    at, end = 0, len(page)
    begun = broken = False  # whether the block has text; whether a quote was left open

    def flush() -> None:
        nonlocal parts, links, link_chars, begun
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((place, text, link_chars, links))
        parts, links, link_chars, begun = [], 0, 0, False

    def say(raw: str) -> None:
        nonlocal place, link_chars, begun
        if raw:
            if not raw.isspace():
                if not begun:
                    place, begun = stack.open[-1][1], True
                if stack.links:
                    link_chars += len(raw)
            parts.append(raw)

    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                say(html.escape(m.group()[9:].removesuffix("]]>")))
            elif not m.group().startswith("<!--"):
                at = page.find(">", at) + 1
                if not at:
                    say(page[m.start() :])
                    break
            continue
        whole = None if broken else ATTRIBUTES.match(page, at)
        broken = broken or whole is None
        close = whole.end() if whole else page.find(">", at) + 1
        if not close:
            say(page[m.start() :])
            break
        attrs, at = page[at : close - 1], close
        if tag not in INLINE:
            flush() if tag != "br" else parts.append(" ")
        if m[1]:
            if depth := stack.depth((tag,)):
                stack.cut(depth)
            continue
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = page.find(">", close.end()) + 1 if close else 0
            if not at:
                break
            continue
        if tag in VOID:
            continue
        shuts, within = CLOSES.get(tag, ({"p"}, {"td", "th", "li", "body", "article", "div", "section"}) if tag not in INLINE else (set(), set()))
        depth = stack.depth(shuts)
        if depth and depth > stack.depth(within):
            stack.cut(depth)
        names = " ".join(x.lower() for got in NAMES.findall(attrs) for x in PARTS.findall(" ".join(got))) if "=" in attrs else ""
        stack.push(tag, paths.child(stack.open[-1][1], tag, names))
        links += tag == "a"
    flush()
    return out


# --- features --------------------------------------------------------------------------------------------------------

TAGS, NAMED, WORDS, COUNTS = 48, 64, 24, 8
INPUTS, HIDDEN, SEED = 2 * TAGS + NAMED + WORDS + COUNTS, 16, 3


def slot(text: str, slots: int) -> int:
    """A stable hash (FNV-1a)."""
    h = 2166136261
    for c in text.encode("utf-8", "replace"):
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % slots


class Reader:
    """Features of pages' blocks; remembers paths and words up to a bound."""

    def __init__(self, most: int = 200_000) -> None:
        self.words, self.most = {}, most
        self.forget()

    def forget(self) -> None:
        self.paths, self.vectors = Paths(), {0: np.zeros(2 * TAGS + NAMED, np.uint8)}

    def blocks(self, page: str) -> list[tuple[int, str, int, int]]:
        """The blocks of a page. Their paths hold until the next call of `forget`."""
        return blocks(page, self.paths)

    def path(self, path: int) -> np.ndarray:
        """All tags and names on the way to a place, and its own tag once more: the parent's features and one step."""
        todo, steps = [], self.paths.steps
        while path not in self.vectors:
            todo.append(path)
            path = steps[path][0]
        v = self.vectors[path]
        for k in reversed(todo):
            _, tag, names = steps[k]
            v = v.copy()
            v[slot(tag, TAGS)] = 1
            v[TAGS : 2 * TAGS] = 0
            v[TAGS + slot(tag, TAGS)] = 1
            for name in names.split():
                v[2 * TAGS + slot(name, NAMED)] = 1
            self.vectors[k] = v
        return v

    def word(self, w: str) -> int:
        k = self.words.get(w)
        if k is None:
            if len(self.words) > self.most:
                self.words.clear()
            k = self.words[w] = slot(w, WORDS)
        return k

    def __call__(self, page: list[tuple[int, str, int, int]]) -> np.ndarray:
        out = np.zeros((len(page), INPUTS), np.float32)
        if not page:
            return out
        longest = max(len(b[1]) for b in page)
        ids, sizes, counts = [], [], []
        for k, (_, text, link_chars, links) in enumerate(page):
            words = text.lower().split()
            n = len(words) or 1
            ids += map(self.word, words)
            sizes.append(len(words))
            chars = len(text)
            marks = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(":")
            counts.append((chars, min(1.0, link_chars / chars), links, marks / (1 + n), chars / longest, k / len(page), n < 4, text[-1] in ".!?…"))
        at = np.repeat(np.arange(len(page)), sizes)
        hashed = np.bincount(at * WORDS + np.array(ids, np.int64), minlength=len(page) * WORDS).reshape(len(page), WORDS)
        counts = np.array(counts, np.float32)
        counts[:, 0] = np.log1p(counts[:, 0]) / 6
        counts[:, 2] = np.log1p(counts[:, 2])
        out[:, : 2 * TAGS + NAMED] = [self.path(b[0]) for b in page]
        out[:, 2 * TAGS + NAMED : -COUNTS] = hashed / np.sqrt(np.maximum(1, sizes))[:, None]
        out[:, -COUNTS:] = counts
        return out


# --- training pages --------------------------------------------------------------------------------------------------


class PageWriter:
    """Writes made-up pages whose blocks carry labels (1 for main text). Labels are marked by a private-use character
    at the start of each main block, which is taken off again before training."""

    MARK = ""
    # Names that sites give to parts of a page.
    PARTS = {
        "menu": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs links",
        "header": "header masthead banner top branding site logo",
        "footer": "footer bottom copyright colophon legal foot",
        "sidebar": "sidebar aside related widget rail recommended trending popular secondary",
        "notice": "notice cookie consent alert gdpr newsletter subscribe popup message modal",
        "advert": "ad ads advert sponsored promo advertisement banner sponsor adbox",
        "comments": "comments comment discussion replies respond disqus thread reply",
        "main": "content main article post entry body story text page single",
    }

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.pick = self.rng.choice

    def some(self, low: int, high: int) -> int:
        return self.rng.randint(low, high)

    def word(self) -> str:
        return "".join(self.rng.choices("aabcdeeefghiijklmnnoopqrrssttuuvwxyzéäñüßç", k=self.some(1, 10)))

    def sentence(self, low: int = 3, high: int = 20) -> str:
        words = [self.word() + (self.pick(["", "", "", "", ",", "$$$", "***", " |", "&amp;"]) if self.rng.random() < 0.2 else "") for _ in range(self.some(low, high))]
        return (" ".join(words).capitalize() if self.rng.random() < 0.8 else " ".join(words)) + self.pick([".", ".", ".", "!", "?", ""])

    def prose(self, most: int = 6) -> str:
        said = " ".join(self.sentence() for _ in range(self.some(1, most)))
        return f"{said} <{(t := self.pick(['b', 'i', 'em', 'a href=x', 'span']))}>{self.word()}</{t.split()[0]}> {self.sentence()}" if self.rng.random() < 0.2 else said

    def wrap(self, part: str, inner: str, tags=("div", "section")) -> str:
        tag = self.pick(tags)
        name = self.pick(self.PARTS[part].split())
        if self.rng.random() < 0.3:
            name += self.pick(["-", "_", " "]) + self.pick(["box", "wrapper", "inner", "list", "area", self.pick(self.PARTS[part].split())])
        how = self.rng.random()
        attr = f' class="{name}"' if how < 0.5 else f' id="{name}"' if how < 0.7 else f" class='{name}'" if how < 0.8 else f" class={name.split()[0]}" if how < 0.9 else ""
        if not attr and tag in ("div", "section"):
            attr = f' class="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.some(1, 4)))}</a>' for _ in range(self.some(low, high))]
        how = self.rng.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if how < 0.7 else self.pick([" | ", " ", " &middot; "]).join(items)

    def main_blocks(self) -> str:
        m, out = self.MARK, []
        if self.rng.random() < 0.85:
            out.append(f"<h1>{m}{self.sentence(1, 12)}</h1>")
        for _ in range(self.some(1, 14)):
            how = self.rng.random()
            if how < 0.55:
                out.append(f"<p>{m}{self.prose(9)}</p>")
            elif how < 0.68:
                out.append(f"<p>{m}{self.sentence(1, 3)}" + self.pick(["</p>", "", "<br>"]))
            elif how < 0.76:
                out.append(f"<p><b>{m}{self.sentence(1, 14)}<br>" + self.pick(["", f"{self.prose()}</b>"]))
            elif how < 0.82:
                out.append(f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{m}{self.sentence(1, 7)}</{h}>")
            elif how < 0.88:
                out.append("<ul>" + "".join(f"<li>{m}{self.sentence(2, 14)}</li>" for _ in range(self.some(1, 6))) + "</ul>")
            elif how < 0.92:
                out.append(f"<blockquote>{m}{self.prose(3)}</blockquote>")
            elif how < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{m}{self.word()}</td><td>{m}{self.sentence(1, 4)}</td></tr>" for _ in range(self.some(1, 4))) + "</table>")
            elif how < 0.965:
                out.append(f"<pre>{m}{self.prose(2)}</pre>")
            elif how < 0.975:
                out.append(f"<{(t := self.pick(['noscript', 'noscript', 'template']))}>{self.pick(['<p>', ''])}{m}{self.prose(3)}</{t}>")
            else:
                out.append(self.pick([self.advert(), self.wrap("sidebar", self.links(1, 4), ("div", "aside")), "<!-- cut -->", "<script>var t='</p>';</script>"]))
        return "".join(out)

    def advert(self) -> str:
        return self.wrap("advert", self.pick(["", "<p>"]) + self.sentence(2, 14) + self.pick(["", " " + self.sentence()]), ("div", "aside", "div"))

    def main(self) -> str:
        inner = self.main_blocks()
        how = self.rng.random()
        if how < 0.5:
            inner = self.pick(["<article>", '<article class="post">', '<article id="a1">']) + inner + "</article>"
        elif how < 0.65:
            inner = f"<main>{inner}</main>"
        else:
            inner = self.wrap("main", inner)
        return self.wrap("main", inner) if self.rng.random() < 0.25 else f"<main>{inner}</main>" if self.rng.random() < 0.15 else inner

    def before(self) -> str:
        out = []
        if self.rng.random() < 0.4:
            inner = self.pick([f"<a href=/>{self.word()}</a>", f"<h1>{self.word()}</h1>", f"<h2>{self.sentence(1, 4)}</h2>", f"<p>{self.sentence(2, 8)}</p>"]) + (self.links(2, 6) if self.rng.random() < 0.3 else "")
            out.append(f"<header>{inner}</header>" if self.rng.random() < 0.6 else self.wrap("header", inner))
        if self.rng.random() < 0.85:
            inner = self.links(2, 9)
            out.append(f"<nav>{inner}</nav>" if self.rng.random() < 0.65 else self.wrap("menu", inner, ("div", "ul", "div")))
        if self.rng.random() < 0.3:
            out.append(self.notice())
        if self.rng.random() < 0.5:
            out.append(self.pick(["", "<!-- ad 1 -->"]) + self.advert())
        if self.rng.random() < 0.2:
            out.append(self.form())
        if self.rng.random() < 0.1:
            out.append(f"<{(t := self.pick(['noscript', 'template']))}>{self.pick([self.sentence(3, 12), self.notice()])}</{t}>")
        if self.rng.random() < 0.3:
            self.rng.shuffle(out)
        return "".join(out)

    def notice(self) -> str:
        return self.wrap("notice", self.pick(["<p>", ""]) + self.prose(2) + self.pick(["", "<button>" + self.word() + "</button>", self.form()]), ("div", "section", "aside"))

    def form(self) -> str:
        return f'<form action="/q"><label>{self.sentence(1, 3)}</label><input name=q><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button></form>'

    def sidebar(self) -> str:
        inner = self.pick(["", f"<h3>{self.sentence(1, 3)}</h3>", f"<h2>{self.sentence(1, 3)}</h2>"]) + self.pick([self.links(2, 8), f"<p>{self.prose(2)}</p>", "<ul>" + "".join(f"<li>{self.sentence(2, 9)}</li>" for _ in range(3)) + "</ul>"])
        return f"<aside>{inner}</aside>" if self.rng.random() < 0.45 else self.wrap("sidebar", inner, ("div", "aside", "section"))

    def comments(self) -> str:
        one = lambda: self.pick(["<p>", '<div class="comment"><p>', "<li>"]) + self.prose(3) + "</p>"
        inner = f"<h{(k := self.pick('234'))}>{self.sentence(1, 3)}</h{k}>" + "".join(one() for _ in range(self.some(1, 5))) + (self.form() if self.rng.random() < 0.4 else "")
        return self.wrap("comments", inner, ("div", "section", "ol"))

    def after(self) -> str:
        out = [f() for f, p in ((self.comments, 0.3), (self.sidebar, 0.35), (self.advert, 0.3), (self.notice, 0.15), (self.form, 0.15)) if self.rng.random() < p]
        self.rng.shuffle(out)
        if self.rng.random() < 0.9:
            inner = self.pick([f"&copy; {self.word()}.example.com &middot; {self.sentence()}", f"<p>{self.sentence()}</p>", self.links(2, 6), f"&copy; 2024 {self.word()}", f"<p>{self.prose(2)}</p>{self.links(1, 4)}"])
            out.append(f"<footer>{inner}</footer>" if self.rng.random() < 0.75 else self.wrap("footer", inner))
        return "".join(out)

    def page(self) -> str:
        body = self.before() + (self.sidebar() if self.rng.random() < 0.2 else "") + self.main() + self.after()
        if self.rng.random() < 0.25:
            body = f'<div id="{self.pick(["wrap", "wrapper", "container", "root", "app"])}">{body}</div>'
        title = f"<title>{self.sentence(1, 9)}</title>" if self.rng.random() < 0.95 else ""
        head = f'<head><meta charset="utf-8">{title}<style>p{{margin:0}}</style><script>track(0);</script></head>' if self.rng.random() < 0.95 else title
        return f'<!DOCTYPE html><html lang="en">{head}<body>{body}</body></html>'


class Labeller:
    def __init__(self) -> None:
        self.net = BiLstm(SEED, INPUTS, HIDDEN, 1)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((max(map(len, pages)), len(pages), INPUTS), np.float32)
        mask = np.zeros((*x.shape[:2], 1), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text. Pages of like length go together; a batch is bounded by its padded size."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order, at = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])), 0
        while at < len(order):
            many = 1
            while at + many < len(order) and many < 256 and (many + 1) * len(pages[order[at + many]]) <= 20_000:
                many += 1
            own = order[at : at + many]
            x, mask = self.padded([pages[k] for k in own])
            s = self.net.forward(x, mask)[:, :, 0]
            for n, k in enumerate(own):
                out[k] = s[: len(pages[k]), n] > 0
            at += many
        return out


#: Pages that a task reads at once.
PAGES_AT_ONCE = 256
#: Generated pages, how often each is read, and pages in a training step.
PAGES, EPOCHS, BATCH = 2400, 4, 32


def train() -> Parts:
    """The labeller's parameters, trained on PAGES generated pages with fixed seeds."""
    model, writer, reader, adam = Labeller(), PageWriter(SEED + 1), Reader(), Adam(0.01)
    pages, labels = [], []
    for _ in range(PAGES):
        found = reader.blocks(writer.page())
        labels.append(np.array([t.startswith(writer.MARK) for _, t, _, _ in found], np.float32))
        pages.append(reader([(p, t.replace(writer.MARK, "") or "-", c, k) for p, t, c, k in found]))
    rounds, order = EPOCHS * PAGES // BATCH, np.random.default_rng(SEED)
    for n in range(rounds):
        if n % (PAGES // BATCH) == 0:
            deal = order.permutation(PAGES)
        adam.rate = 0.015 * (1 - n / rounds) + 0.0005
        own = deal[n * BATCH % PAGES :][:BATCH]
        x, mask = model.padded([pages[k] for k in own])
        y = np.zeros(x.shape[:2], np.float32)
        for k, page in enumerate(own):
            y[: len(labels[page]), k] = labels[page]
        p = sigmoid(model.net.forward(x, mask, keep=True)[:, :, 0])
        _, grads = model.net.backward(((p - y) * mask[:, :, 0] / mask.sum())[:, :, None].astype(np.float32))
        adam.step(model.net.parts(), grads)
    return model.net.parts()


def trained(spark) -> Labeller:
    model = Labeller()
    fitted(spark, "html", train, model.net.parts())
    return model


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds to the columns `keep` (page_id and url if not given): text (the main blocks in page order, joined by one
    space; character references decoded, white space inside a block turned into one space) and n_chars (its code
    points). A script, style or comment that is never closed takes the rest of the page, as in browsers; of other elements
    nothing is left out without the labeller. Null html is empty and gives an empty text, as does a page without main blocks. Pages are read whole, one by
    one, so repeated rows and ids do not matter; other columns are ignored; an empty table gives no rows."""
    keep = ["page_id", "url"] if keep is None else keep
    model, n = trained(pages.sparkSession), len(keep)
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n]) + ", text string, n_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for at in range(0, len(whole), PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                found = [reader.blocks(h.as_py() or "") for h in batch.column("__html")]
                fine = model.label([reader(f) for f in found])
                if len(reader.paths.steps) > reader.most:
                    reader.forget()
                texts = [" ".join(b[1] for b, ok in zip(f, own, strict=True) if ok) for f, own in zip(found, fine, strict=True)]
                cols = [*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(work, schema)
