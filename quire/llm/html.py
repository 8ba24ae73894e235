"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is described by hashed tokens of
its tag path, hashed words and a few measures; a bidirectional LSTM in numpy reads the whole
sequence, so that each block is judged with the page before and after it, and
labels it article or not. The labeller is trained by this module, on pages made up from a grammar of
layouts with known labels; the weights lie beside it.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import Words, mapped, text_passes

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 192, 32, 6, 16
#: Pages and passes of training, and its seed.
TRAIN_PAGES, EPOCHS, SEED = 1500, 14, 20240501
#: Labellers that are trained apart and judge together.
MEMBERS = 3
#: Share of pages without names, and of the others' readings in training that show wording.
BARE, WORDED = 0.06, 0.15
#: Share of made-up articles that are long, and of how many parts these are.
LONG, LONG_PARTS = 0.06, (40, 120, 300)

#: Elements whose content is no text, those without content, and those that part no block.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which a start tag ends nothing.
SCOPES = frozenset("article aside blockquote body div footer form header html main nav ol section table ul".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARKS = re.compile("['\">]")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
#: Blocks of a page that are described and read at once; pages of more are read in segments of so many.
SEGMENT = 4096


class TagPath:
    """The open elements at a place of a page, from the outermost: a list whose beginning is shared by all places inside."""

    __slots__ = ("_sum", "depth", "element", "up")

    def __init__(self, up: TagPath | None, element: str):
        self.up, self.element, self.depth = up, element, 1 + (up.depth if up else 0)
        self._sum: np.ndarray | None = None

    def elements(self) -> tuple[str, ...]:
        out, p = [], self
        while p:
            out.append(p.element)
            p = p.up
        return tuple(out[::-1])

    def vector(self) -> np.ndarray:
        """Hashed tokens of the elements' tags and names, the nearest three at full weight, those further out at 0.7.

        Sums are kept with the elements around, which other blocks share, not with the block's own.
        """
        bare, p = [], self.up
        while p and p._sum is None:
            bare.append(p)
            p = p.up
        run = p._sum if p else np.zeros(PATH_DIM, dtype=np.float32)
        for p in reversed(bare):
            run = p._sum = run + _element_vector(p.element)
        out, p = 0.7 * (run + _element_vector(self.element)), self
        for _ in range(3):
            if p:
                out += 0.3 * _element_vector(p.element)
                p = p.up
        return out


@functools.lru_cache(maxsize=4096)
def _element_vector(element: str) -> np.ndarray:
    v = np.zeros(PATH_DIM, dtype=np.float32)
    tag, *names = element.split(".")
    for token in (f"<{tag}", *(f".{n}" for n in names)):
        h = zlib.crc32(token.encode())
        v[h % PATH_DIM] += 1.5 if h >> 16 & 1 else -1.5
    return v


class _Open:
    """The stack of open elements, with the places of each kind in it, so that no step looks through the stack."""

    def __init__(self):
        self.kinds: list[str] = []
        self.paths: list[TagPath | None] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def last(self, kind: str) -> int:
        own = self.places.get(kind)
        return own[-1] if own else -1

    def cut(self, at: int) -> None:
        while len(self.kinds) > at:
            kind = self.kinds.pop()
            self.paths.pop()
            self.places[kind].pop()
            if kind in SCOPES:
                self.scopes.pop()

    def close(self, kind: str) -> None:
        at = self.last(kind)
        if at >= 0 and (kind not in INLINE or not self.scopes or self.scopes[-1] <= at):
            self.cut(at)

    def open(self, kind: str, element: str) -> None:
        if kind not in INLINE:
            ends = CLOSES.get(kind, ()) or (("p",) if kind != "html" else ())
            at = max(map(self.last, ends), default=-1)
            if at >= 0 and (not self.scopes or self.scopes[-1] <= at):
                self.cut(at)
        self.places.setdefault(kind, []).append(len(self.kinds))
        if kind in SCOPES:
            self.scopes.append(len(self.kinds))
        self.kinds.append(kind)
        self.paths.append(self.path() if kind in INLINE else TagPath(self.path(), element))

    def path(self) -> TagPath | None:
        return self.paths[-1] if self.paths else None


def _tag_end(page: str, at: int, doomed: set[int]) -> int:
    """Where a tag whose name ends at ``at`` ends, past the first ``>`` outside quotes; 0 if a quote before it never closes, or there is none.

    What follows a quote or ``>`` outside quotes depends on its place alone, so ``doomed`` keeps the places from which a
    walk failed: no place is walked over twice by walks that fail, and those that do not fail go on from their end.
    """
    seen = []
    while (m := _MARKS.search(page, at)) and m.start() not in doomed:
        if m[0] == ">":
            return m.end()
        seen.append(m.start())
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    doomed.update(seen)
    return 0


def _markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closes, tag, attributes) of each piece of markup, in one walk forward; tag is '' for what only goes: comments, declarations, RAW elements.

    A tag that the page's end cuts off goes with all after it. Where a quote in a tag never closes, the tag
    ends at the next ``>``. A RAW element without an end goes to the page's end if it is a script or style; of others only the tag goes.
    """
    at, doomed, endless = 0, set(), set()
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at + 2) + 1 or len(page)
            yield at, end, False, "", ""
        elif m := _TAG.match(page, at):
            end = _tag_end(page, m.end(), doomed) or page.find(">", m.end()) + 1
            if not end:
                yield at, len(page), False, "", ""
                return
            tag, attributes = m[2].lower(), page[m.end() : end - 1]
            raw = tag in RAW and not m[1] and not (tag in ("svg", "math") and attributes.endswith("/")) and tag not in endless
            if raw:
                stop = _ENDS[tag].search(page, end)
                if stop or tag in ("script", "style"):
                    end = stop.end() if stop else len(page)
                else:
                    endless.add(tag)
            yield at, end, bool(m[1]), "" if tag in RAW else tag, attributes
        else:
            at += 1
            continue
        at = end


def blocks_of(page: str) -> list[tuple[str, TagPath | None, float]]:
    """Leaf blocks in page order: text, tag path (elements are ``tag`` or ``tag.name.name``) and the share of text in links.

    Character references are decoded, white space becomes one blank. Markup that is cut off,
    never closed or wrongly nested is read as far as it goes, in time that grows with the page's size.
    """
    out: list[tuple[str, TagPath | None, float]] = []
    stack = _Open()
    text: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((whole, stack.path(), linked / max(total, 1)))
            text.clear()
        linked = total = 0

    def say(piece: str) -> None:
        nonlocal linked, total
        text.append(piece)
        total += len(piece)
        if stack.last("a") >= 0:
            linked += len(piece)

    at = 0
    for begin, end, closes, tag, attributes in _markup(page):
        if begin > at:
            say(page[at:begin])
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if closes:
            stack.close(tag)
        elif tag not in VOID and not attributes.endswith("/"):
            names = " ".join(x for t in _NAMES.findall(attributes) for x in t if x)
            stack.open(tag, ".".join([tag, *_PART.findall(names.lower())]) if names else tag)
    if at < len(page):
        say(page[at:])
    flush()
    return out


def describe(pages: list[list[tuple[str, TagPath | None, float]]], places: np.ndarray | None = None) -> list[np.ndarray]:
    """A matrix of block vectors for each page; ``places`` are the blocks' shares of the way through their page, where those given are not all of it."""
    flat = [b for p in pages for b in p]
    if not flat:
        return [np.zeros((0, PATH_DIM + WORD_DIM + MEASURES), dtype=np.float32) for _ in pages]
    w = Words([b[0].lower().encode("utf-8", "replace") for b in flat])
    n = np.diff(w.first)
    h = w.hashes()
    cell = w.of * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
    words = np.bincount(cell, weights=np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0), minlength=len(flat) * WORD_DIM).reshape(-1, WORD_DIM) * 0.4 / np.sqrt(np.maximum(n, 1))[:, None]
    size = np.array([len(b[0]) for b in flat])
    ends = np.array([b[0][-1] in ".!?…:;\"'”" for b in flat])
    at = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages]) if places is None else places
    measures = np.stack([np.log1p(size) / 5, np.log1p(n) / 4, ends, [b[2] for b in flat], at, np.array([b[1].depth if b[1] else 0 for b in flat]) / 8], axis=1)
    x = np.concatenate([np.stack([b[1].vector() if b[1] else np.zeros(PATH_DIM, dtype=np.float32) for b in flat]), words, measures], axis=1).astype(np.float32)
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output per block, to which the block's own vector also speaks directly."""

    def __init__(self, rng: np.random.Generator | None = None, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            d = PATH_DIM + WORD_DIM + MEASURES
            weights = {}
            for way in "fb":
                weights["x" + way] = rng.standard_normal((d, 4 * HIDDEN)) / np.sqrt(d)
                weights["h" + way] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
                weights["b" + way] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
            weights["o"] = rng.standard_normal(2 * HIDDEN) * 0.1
            weights["c"] = np.zeros(1)
            weights["s"] = np.zeros(d)
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (pages, steps, HIDDEN) of one direction; x is padded at the end, mask says where blocks are."""
        n, steps, _ = x.shape
        z_all = x @ self.w["x" + way] + self.w["b" + way]
        h = c = np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.zeros((n, steps, HIDDEN), dtype=np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = z_all[:, t] + h @ self.w["h" + way]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = (f * c + i * g) * m
            th = np.tanh(c_new)
            h_new = o * th * m
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out

    def logits(self, pages: list[np.ndarray], at_once: int = 64) -> list[np.ndarray]:
        """Logit of each block to be article; pages of like length are read together, padded to twice their blocks at most."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        k = 0
        while k < len(order):
            own = [i for i in order[k : k + at_once] if len(pages[i]) <= 2 * len(pages[order[k]])]
            k += len(own)
            x, mask = _padded([pages[i] for i in own])
            h = np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], axis=2)
            for i, row in zip(own, h @ self.w["o"] + x @ self.w["s"] + self.w["c"]):
                out[i] = row[: len(pages[i])]
        return out

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the blocks and its gradients, by backpropagation through both directions."""
        x, mask = _padded(pages)
        y = np.zeros(mask.shape, dtype=np.float32)
        for i, lab in enumerate(labels):
            y[i, : len(lab)] = lab
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(way, x, mask, kept[way]) for way in "fb"], axis=2)
        p = _sigmoid(h @ self.w["o"] + x @ self.w["s"] + self.w["c"])
        count = mask.sum()
        loss = float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / count)
        d_logit = (p - y) * mask / count
        grad = {"o": np.einsum("nt,nth->h", d_logit, h), "c": np.array([d_logit.sum()]), "s": np.einsum("nt,ntd->d", d_logit, x)}
        for way, d_h in zip("fb", np.split(d_logit[:, :, None] * self.w["o"], 2, axis=2)):
            d_z = np.zeros((*mask.shape, 4 * HIDDEN), dtype=np.float32)
            dh = dc = np.zeros((len(pages), HIDDEN), dtype=np.float32)
            grad["h" + way] = np.zeros_like(self.w["h" + way])
            for t, h0, c0, i, f, o, g, th, m in reversed(kept[way]):
                dh = (dh + d_h[:, t]) * m
                dc = (dc + dh * o * (1 - th * th)) * m
                z = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                d_z[:, t] = z
                grad["h" + way] += h0.T @ z
                dh, dc = z @ self.w["h" + way].T, dc * f
            grad["x" + way] = x.reshape(-1, x.shape[2]).T @ d_z.reshape(-1, 4 * HIDDEN)
            grad["b" + way] = d_z.sum(axis=(0, 1))
        return loss, grad


class Committee:
    """Labellers that were trained apart; what each is unsure of, their mean decides."""

    def __init__(self, weights: dict[str, np.ndarray]):
        members = sorted({k.partition(".")[0] for k in weights})
        self.members = [Labeller(weights={k.partition(".")[2]: v for k, v in weights.items() if k.partition(".")[0] == m}) for m in members]

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of each block to be article."""
        return [_sigmoid(np.mean(x, axis=0)) for x in zip(*(m.logits(pages) for m in self.members))]

    def long_page(self, blocks: list[tuple[str, TagPath | None, float]], segment: int = SEGMENT) -> np.ndarray:
        """The same chances for one page of any length, all members in one step at a time.

        Blocks are described segment by segment, on the way forth and again on the way back; of the way forth
        one number a block and member is kept, what its hidden state says.
        """
        n, m = len(blocks), len(self.members)
        stack = lambda k: np.stack([x.w[k] for x in self.members])
        straight, bias, out_of = stack("s").T, stack("c")[:, 0], stack("o")
        logits = np.empty((n, m), dtype=np.float32)
        cuts = [(a, min(a + segment, n)) for a in range(0, n, segment)]
        for way, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            into, over, start, say = np.concatenate([x.w["x" + way] for x in self.members], axis=1), stack("h" + way), stack("b" + way), out_of[:, side]
            h = c = np.zeros((m, HIDDEN), dtype=np.float32)
            for a, b in cuts if way == "f" else cuts[::-1]:
                x = describe([blocks[a:b]], np.arange(a, b) / n)[0]
                z_all = (x @ into).reshape(b - a, m, 4 * HIDDEN) + start
                held = np.empty((b - a, m, HIDDEN), dtype=np.float32)
                for t in range(b - a) if way == "f" else range(b - a - 1, -1, -1):
                    z = z_all[t] + (h[:, None, :] @ over)[:, 0]
                    gates = _sigmoid(z[:, : 3 * HIDDEN])
                    c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                    h = held[t] = gates[:, 2 * HIDDEN :] * np.tanh(c)
                said = (held * say).sum(axis=2)
                logits[a:b] = said + x @ straight + bias if way == "f" else logits[a:b] + said
        return _sigmoid(logits.mean(axis=1))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, pages[0].shape[1]), dtype=np.float32)
    mask = np.zeros((len(pages), steps), dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


# Words of made-up pages: what layouts call their parts, and what these say.
_CHROME = {
    "menu": ("nav header.nav div.menu div.navbar ul.nav div.navigation div.breadcrumb nav.breadcrumbs div.topnav div.portal div.portlet div.toc ul.tabs nav.pagination div.pager", "Home|About|Contact|News|Sports|Login|Register|Sitemap|Next|Previous|Archive|Blog|Shop|FAQ|Talk|Edit|History|Read|View source|Tools|Help|Recent changes|What links here"),
    "header": ("header div.header div.masthead div.site.header div.banner div.topbar", "Welcome to our site|Your daily source|Search|Sign in|Menu|Est. 1998"),
    "footer": ("footer div.footer div.site.footer div.copyright div.legal div.bottom", "All rights reserved.|Privacy policy|Terms of use|Imprint|Powered by this system|© 2024 Example Inc.|Copyright 2011 The Owner|Last modified on 3 May 2009|This page was last edited in June 2017."),
    "sidebar": ("aside div.sidebar div.widget div.related aside.sidebar div.recent.posts div.rail section.related div.most.read div.tags", "Related stories|Most read|Popular posts|Recent comments|Tags|Archive|You may also like"),
    "notice": ("div.notice div.cookie div.cookie.banner div.alert div.consent div.gdpr div.popup div.modal section.newsletter div.subscribe div.promo", "We use cookies to make this site better.|Accept all|Subscribe to our newsletter now!|Please enable scripts.|By going on you agree to our terms."),
    "advert": ("div.ad div.ads div.advert div.sponsored aside.ad div.banner.ad div.adsense section.sponsor div.promoted", "Advertisement|Buy now and save!|Sponsored content|Limited offer. Order today!"),
    "form": ("form form.search form.login div.form form.contact fieldset form.newsletter", "Your name|Your e-mail|Password|Send|Search this site|Submit"),
    "comments": ("div.comments section.comments div.comment ol.comment.list div.discussion div.disqus div.replies section.responses", "Reply|Report|Great article, thanks!|I do not agree with this at all.|3 comments|Leave a comment|First!"),
    "share": ("div.share div.social ul.share.buttons div.sharing div.meta.social", "Share|Tweet|Like|Print|E-mail this"),
}
_INNER = "article main div.content div.post div.article div.entry.content section.article div.story article.post div.main div.post.body main.content div.text div.body.text"
_SYLLABLES = "an ber che da el fi gor ha il jo ka len mi no or pre qua ri so ten un vel wa xi yo zu é ß ño çal th sh in ed re st".split()


def _open(spec: str) -> tuple[str, str]:
    tag, *names = spec.split(".")
    return (f'<{tag} class="{" ".join(names)}">' if names else f"<{tag}>"), f"</{tag}>"


def made_up_page(rng: random.Random, bare: bool | None = None) -> tuple[str, set[str]]:
    """A page from the grammar of layouts and the texts of its article's blocks.

    ``bare`` pages (a few, if it is not said) are cells or boxes without names, which only links and wording tell apart.
    """
    bare = rng.random() < BARE if bare is None else bare
    lexicon = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def prose(low: int, high: int) -> str:
        words = [rng.choice(lexicon) for _ in range(rng.randint(low, high))]
        noise = rng.random()
        if noise < 0.08:
            words = [w + rng.choice(("***", "###", "%%%", "$$$", "&&&")) for w in words]
        elif noise < 0.12:
            words = [w.upper() + "!!" for w in words]
        elif noise < 0.16:
            words = [w for w in words[: rng.choice((1, 1, 2))] for _ in range(rng.choice((len(words), 80)))]
        elif noise < 0.20:
            return " | ".join(words).capitalize()
        return (" ".join(words)).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))

    def chrome(kind: str) -> str:
        places, says = _CHROME[kind]
        said = says.split("|")
        if bare:
            items = [rng.choice(lexicon).capitalize() if kind != "footer" and rng.random() < 0.4 else rng.choice(said) for _ in range(rng.randint(1, 8))]
            if kind not in ("footer", "form", "notice"):
                items = [f'<a href="/x">{x}</a>' for x in items]
            return rng.choice(("<tr><td>{}</td></tr>", "<tr><td><font size=1>{}</font></td></tr>", "<div>{}</div>", "<p>{}</p>", "<center>{}</center>")).format(rng.choice((" | ", "<br>", " ", "<p>")).join(items))
        start, end = _open(rng.choice(places.split()))
        spoken = rng.choice((0.1, 0.5, 1.0))  # how much of it is prose that only its place tells from an article
        items = [prose(2, 40) if rng.random() < spoken else rng.choice(lexicon).capitalize() if rng.random() < 0.5 else rng.choice(said) for _ in range(rng.randint(1, 7 if kind in ("menu", "sidebar", "comments") else 3))]
        how = rng.random()
        if kind in ("menu", "share") or how < 0.3:
            body = "<ul>" + "".join(f'<li><a href="/x">{x}</a></li>' for x in items) + "</ul>"
        elif how < 0.6:
            body = "".join(f"<p>{x}</p>" for x in items)
        elif how < 0.8:
            body = "".join(f"<div>{x}</div>" for x in items)
        else:
            body = rng.choice(("", "&copy; ", f"{rng.choice(lexicon)}.example.com &middot; ")) + " ".join(items)
        return start + body + end

    told: set[str] = set()

    def say(low: int, high: int) -> str:
        x = prose(low, high)
        told.add(x)
        return entities.escape(x, quote=False)

    start, end = _open(rng.choice("tr td div font".split() if bare else _INNER.split()))
    parts = []
    if rng.random() < 0.85:
        parts.append(f"<h1>{say(2, 12)}</h1>")
    for _ in range(rng.choice(LONG_PARTS) if rng.random() < LONG else rng.choice((1, 2, 3, 5, 8, 14))):
        k = rng.random()
        if k < 0.72:
            x = say(1, 8) if rng.random() < 0.25 else say(8, 90)
            parts.append(rng.choice((f"<p>{x}</p>", f"<p>{x}</p>", f"<p>{x}", f"<p><b>{x}<br>", f"<p><a href='/y'>{x}</a></p>", f"<div>{x}</div>")))
        elif k < 0.8:
            parts.append(f"<h2>{say(2, 8)}</h2>")
        elif k < 0.88:
            parts.append("<ul>" + "".join(f"<li>{say(2, 12)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
        elif k < 0.92:
            parts.append(f"<blockquote><p>{say(6, 30)}</p></blockquote>")
        elif k < 0.95:
            parts.append(f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>")
        else:
            parts.append(chrome(rng.choice(("advert", "share", "sidebar", "notice"))))
    if rng.random() < 0.15:
        parts.append(chrome("comments"))
    article = start + "".join(parts) + end
    if not bare and rng.random() < 0.3:
        start, end = _open(rng.choice(("div", "main", "div.wrap", "div.container", "section", "div.page")))
        article = start + article + end
    before = [chrome(k) for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.45]
    after = [chrome(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    tail = rng.choice(("</body></html>", "</body></html>", ""))
    start, end = rng.choice((("<table>", "</table>"), ("<table><tr><td>", "</table>"), ("<div>", "</div>"), ("", ""))) if bare else ("", "")
    return "<html><head><title>t</title></head><body>" + start + "".join(before) + article + "".join(after) + end + tail, told


WEIGHTS = Path(__file__).with_name("html_weights.npz")


@functools.lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    """The labeller's weights as ``python -m quire.llm.html`` trained and wrote them, so that all processes and machines judge alike."""
    with np.load(WEIGHTS) as kept:
        return {k: kept[k] for k in kept.files}


def trained(members: int = MEMBERS) -> dict[str, np.ndarray]:
    """Weights of all labellers, each trained on made-up pages of its own; no page of any table is used."""
    return {f"{m}.{k}": v for m in range(members) for k, v in _trained(SEED + m).items()}


def _trained(seed: int) -> dict[str, np.ndarray]:
    """Weights of one labeller (some ten seconds)."""
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    pages, labels = [], []
    plain = [draw.random() < BARE for _ in range(TRAIN_PAGES)]
    for bare in plain:
        page, told = made_up_page(draw, bare)
        blocks = blocks_of(page)
        pages.append(blocks)
        labels.append(np.array([b[0] in told for b in blocks], dtype=np.float32))
    x = describe(pages)
    model, sizes = Labeller(rng), np.array([len(p) for p in x])
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    wordless = np.concatenate([np.ones(PATH_DIM), np.zeros(WORD_DIM), [0, 0, 0, 1, 0, 0]]).astype(np.float32)
    done, total = 0, EPOCHS * -(-len(x) // 32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        order = order[np.argsort(sizes[order], kind="stable")]  # batches of pages of like length need little padding
        for k in rng.permutation(-(-len(x) // 32)).tolist():
            own = order[32 * k : 32 * k + 32]
            # for most pages places and links alone must do, so that no wording outweighs them
            seen = [x[i] if rng.random() < WORDED else x[i] * wordless for i in own]
            _, grad = model.step(seen, [labels[i] for i in own])
            done += 1
            rate = 0.02 * (1 - done / (total + 1))
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g / max(1.0, size)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.w[name] = (model.w[name] - rate * (first[name] / (1 - 0.9**done)) / (np.sqrt(second[name] / (1 - 0.99**done)) + 1e-6)).astype(np.float32)
    return model.w


def main_texts(pages: list[str], model: Committee) -> list[str]:
    """Article blocks of each page, one to a line."""
    blocks = [blocks_of(p) for p in pages]
    short = iter(model.probabilities(describe([b for b in blocks if len(b) <= SEGMENT])))
    chances = [next(short) if len(b) <= SEGMENT else model.long_page(b) for b in blocks]
    return ["\n".join(b[0] for b, c in zip(page, p.tolist()) if c >= 0.5) for page, p in zip(blocks, chances)]


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df`` with ``text`` (main text, '' if none) and ``n_chars`` (its code points), row by row.

    A null or empty page has an empty text. Pages are read whole, in passes of about half a
    million characters; a longer page is read in segments of SEGMENT blocks, with some 250 bytes kept for each of its blocks.
    Rows are judged one by one, so ties and repeated rows give repeated results, and an empty table none. A kept column
    named ``text`` or ``n_chars`` gives way to the result. No shuffle; the weights (some 100 kB) are broadcast.
    """
    keep = tuple(c for c in keep if c not in (text, "n_chars"))
    found = df.sparkSession.sparkContext.broadcast(weights())
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches):
        model = Committee(found.value)
        for b in batches:
            for a, pages in text_passes(b, html):
                out = main_texts(pages, model)
                part = b.slice(a, len(pages))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*keep, text, "n_chars"])

    return mapped(df.select(*dict.fromkeys([*keep, html])), run, schema)


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **trained())
