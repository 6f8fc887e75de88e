"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks (runs of text between block tags) with the tags, classes and roles of their ancestors.
Ancestor and text features give each block a score for being main text; neighbouring blocks are tied by transition
weights; Viterbi decoding picks the main text. The field is trained (forward-backward gradients) on pages that
:func:`labelled_pages` makes with known labels: articles among menus, banners, notices, adverts, forms and comments.

Character references are decoded, white space inside a block becomes one space, kept blocks are joined in page order by
one line break; nothing else is dropped or capped.

A class, id or role tells a block's part of the page by whole words: "comment-list" is a place of comments, "commentary" and
"alert-levels" say nothing. Time and memory are linear in the size of a page at any depth.

Defined results: a null or empty html gives empty text; markup that is cut off or never closed is read as far as it
goes; what stands in noscript, object, canvas, audio and video is text like other text; text that no browser ever shows is no
block at all: scripts, styles, titles, comments, templates, iframes, blocks under hidden, display:none or visibility:hidden, what
form controls hold; the text of formulas and drawings belongs to its line; repeated rows repeat; null ids and urls are kept;
empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .common import prepare, table, with_text_columns

TRAINING_PAGES = 700
SEED = 11

# HTML's void elements, the elements whose text is not shown, and those that run inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title iframe select textarea datalist head".split())
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = frozenset("script style title textarea iframe".split())
_TRANSPARENT = frozenset("object canvas audio video".split())
# Elements of formulas and drawings whose text is not shown, and elements that end a formula or drawing around them.
_UNDRAWN = frozenset("annotation annotation-xml desc metadata defs".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
_P_SCOPE = ("template", "button", "table", "caption", "td", "th")
_BREAKS_OUT = _CLOSES_P | frozenset("body td th tr tbody thead tfoot".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP_AT = frozenset("ul ol dl table body html article section div nav".split())

# An attribute as the HTML tokenizer reads it: a quote counts only where a value begins; an unquoted value ends at white space or ">".
_ATTRIBUTE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(?=>)))?"""
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + r")*+[\s/]*+)(?:>|\Z)", re.S)
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TELLING = frozenset("class id role itemprop aria-label".split())

# Words in class, id and role that tell a block's part of the page. Those before the bar tell it in any company,
# those after it only where the other words of the name are such words, too, or say no more than place and shape.
CUES = {
    "advert": "adsense advert adverts advertisement advertisements advertising sponsored sponsor sponsors promo promos promoted | ad ads banner promotion commercial",
    "comment": "disqus userreview userreviews customerreview customerreviews readerreview readerreviews | comment comments commentlist reply replies respond discussion discussions",
    "side": "sidebar sidebars widget widgets recommended recommendations trending | aside related recommend popular complementary more",
    "notice": "cookie cookies gdpr consent paywall popup | notice notices notification alert alerts modal toast overlay disclaimer dialog",
    "menu": "navbar breadcrumb breadcrumbs pagination pager toolbar submenu | menu menus nav navigation toc tab tabs skip",
    "foot": "footer colophon copyright contentinfo | foot legal",
    "head": "masthead topbar | header head logo brand branding",
    "form": "newsletter signup login signin | form forms subscribe subscription search register registration",
    "social": "byline | social share sharing follow author tag tags meta date",
    "main": "| article articles content contents post posts entry entries main story stories body text prose",
}
# Words of place and shape.
_PLAIN = frozenset(
    "area bar block bottom box btn button buttons card cards center close col column columns container count desktop div fixed fluid frame global grid group heading holder icon inner "
    "inline item items label large layout left link links list message middle mini mobile module msg my new old outer page panel pop post primary region right row secondary section "
    "side sign site slot small sticky thread title top unit up user users reader readers customer customers view wide wrap wrapper zone".split()
)
_SURE = {w: c for c, both in CUES.items() for w in both.split("|")[0].split()}
_MAYBE = {w: c for c, both in CUES.items() for w in both.split("|")[1].split()}
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAGS = ("nav", "header", "footer", "aside", "article", "main", "section", "form", "ul", "ol", "table", "p", "blockquote", "pre", "figure", "button", "details", "dialog", "address", "noscript", "div")
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KNOWN = frozenset(_TAGS) | _HEADS | {"html", "body"}
NAMES = (
    "bias", *(f"tag_{t}" for t in _TAGS), "heading", "h1", *(f"cue_{c}" for c in CUES), *(f"near_{c}" for c in CUES), "bare_body", "bare_div", "words_0", "words_5", "words_15", "words_40", "words_100",
    "link_some", "link_most", "sentence", "commas", "rights", "early", "late", "boiler_in_article", "after_article",
)
_AT = {n: i for i, n in enumerate(NAMES)}
_SENTENCE = re.compile(r"[.!?…。»”\"')\]]\s*$")
_RIGHTS = re.compile(r"©|all rights|copyright|\bprivacy\b|cookies?\b", re.I)


class Block:
    """A run of text, which of the telling elements are around it, the cues of all of them and of the innermost, and how much of it is in links."""

    __slots__ = ("cues", "late_cues", "links", "tags", "text")

    def __init__(self, text: str, tags: frozenset, cues: frozenset, late_cues: frozenset, links: int) -> None:
        self.text, self.tags, self.cues, self.late_cues, self.links = text, tags, cues, late_cues, links


def cues_of_names(value: str) -> set[str]:
    """The cues in the value of a class, id or role."""
    out = set()
    for name in value.split():
        words = _WORD.findall(_HUMP.sub(" ", name).lower())
        words += [a + b for a, b in zip(words, words[1:], strict=False) if a + b in _SURE]
        out |= {_SURE[w] for w in words if w in _SURE}
        if all(w in _MAYBE or w in _PLAIN or w in _SURE or len(w) == 1 for w in words):
            out |= {_MAYBE[w] for w in words if w in _MAYBE}
    return out


@lru_cache(maxsize=20_000)
def _cues_of(attributes: str) -> frozenset:
    """What the attributes of one element say: cue names, and "unseen" if it is hidden."""
    out, seen = set(), set()
    for m in _ATTRIBUTES.finditer(attributes):
        name = m.group(1).lower()
        if name in seen:
            continue  # the first of equal names counts
        seen.add(name)
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            out.add("unseen")
        elif name in _TELLING:
            out |= cues_of_names(value)
    return frozenset(out)


class Open:
    """The open block elements. Each knows the telling elements and the cues of all around it, so a block only refers to them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.around: list[tuple[frozenset, frozenset, frozenset]] = [(frozenset(), frozenset(), frozenset())]
        self.at: dict[str, list[int]] = {}
        self.hidden = 0

    def push(self, name: str, cues: frozenset) -> None:
        tags, whole, _ = self.around[-1]
        telling = name if name in _KNOWN else "other"
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.around.append((tags if telling in tags else tags | {telling}, whole if cues <= whole else whole | cues, cues))
        self.hidden += name in HIDDEN

    def pop_to(self, k: int) -> None:
        while len(self.names) > k:
            name = self.names.pop()
            self.around.pop()
            self.at[name].pop()
            self.hidden -= name in HIDDEN

    def last(self, *names: str) -> int:
        """Where the innermost open element of these names stands, -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def blocks(page: str | None) -> list[Block]:
    """The shown leaf blocks of a page in order."""
    if not page:
        return []
    out: list[Block] = []
    opened = Open()
    names = opened.names
    anchors = 0
    foreign = ""  # the formula or drawing that is open: it runs inside the line
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            tags, whole, own = opened.around[-1]
            if text and "unseen" not in whole:
                out.append(Block(text, tags, whole, own, linked))
            parts.clear()
        linked = 0

    pop_to = opened.pop_to

    def leave_head() -> None:
        while names and names[-1] == "head":
            pop_to(len(names) - 1)

    at, length = 0, len(page)
    while at < length:
        m = _TOKEN.search(page, at)
        start = m.start() if m else length
        if names and names[-1] == "head" and page[at:start].strip(" \t\n\r\f"):
            leave_head()
        if start > at and not opened.hidden:
            piece = page[at:start]
            parts.append(piece)
            if anchors:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        if page[at - 1] != ">":
            break  # a tag that is cut off
        tag = tag.lower()
        closing, attributes = bool(m.group(1)), m.group(3)
        if not closing and tag not in _IN_HEAD:  # whatever isn't head content ends a head that was never closed
            leave_head()
        if foreign and tag not in RAW:
            if tag in _BREAKS_OUT:
                foreign = ""
            else:
                if closing and tag == foreign:
                    foreign = ""
                elif tag in _UNDRAWN and not closing and page[at - 2] != "/":
                    end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                    at = end.end() if end else length
                elif tag in ("text", "mtr", "mtd", "br"):
                    parts.append(" ")
                continue
        if tag in ("math", "svg"):
            if not closing and page[at - 2] != "/" and "unseen" not in _cues_of(attributes):
                foreign = tag
            elif not closing and page[at - 2] != "/":
                end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                at = end.end() if end else length
            continue
        if tag in INLINE or tag in _TRANSPARENT:
            if tag == "a":
                anchors = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        if closing:
            if (k := opened.last(tag)) >= 0:
                flush()
                pop_to(k)
            elif tag == "p":
                flush()
            if tag != "p":
                anchors = 0
            continue
        if tag == "noscript" and any(not x.isspace() for x in parts):
            continue  # it runs inside the line
        if tag in RAW:  # what isn't shown doesn't break the text around it
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if tag in VOID and tag != "hr":
            continue
        flush()
        if tag in _CLOSES_P and (k := opened.last("p")) > opened.last(*_P_SCOPE):
            pop_to(k)
        if tag in _SAME and (k := opened.last(*_SAME[tag])) > opened.last(*(("table",) if tag == "tr" else _STOP_AT)):
            pop_to(k)
        if tag == "body" and opened.at.get("head"):
            pop_to(opened.at["head"][0])
        if tag in VOID:
            continue
        opened.push(tag, _cues_of(attributes) if attributes.strip() else frozenset())
    flush()
    return out


def featurise(page: list[Block]) -> list[list[int]]:
    """The active features of each block."""
    out = []
    n = len(page)
    seen_article = False
    for i, b in enumerate(page):
        f = [0]
        tags = b.tags
        f += [_AT[f"tag_{t}"] for t in _TAGS if t in tags]
        if tags & _HEADS:
            f.append(_AT["heading"])
            if "h1" in tags:
                f.append(_AT["h1"])
        f += [_AT[f"cue_{c}"] for c in b.cues]
        f += [_AT[f"near_{c}"] for c in b.late_cues]
        rest = tags - {"html", "body"}
        if not rest:
            f.append(_AT["bare_body"])
        elif rest == {"div"} and not b.cues:
            f.append(_AT["bare_div"])
        words = b.text.count(" ") + 1
        f.append(_AT["words_0" if words < 5 else "words_5" if words < 15 else "words_15" if words < 40 else "words_40" if words < 100 else "words_100"])
        share = b.links / max(1, len(b.text))
        if share > 0.6:
            f.append(_AT["link_most"])
        elif share > 0.15:
            f.append(_AT["link_some"])
        if _SENTENCE.search(b.text):
            f.append(_AT["sentence"])
        if "," in b.text:
            f.append(_AT["commas"])
        if _RIGHTS.search(b.text):
            f.append(_AT["rights"])
        if i < 0.15 * n:
            f.append(_AT["early"])
        if i >= 0.85 * n:
            f.append(_AT["late"])
        inside = "article" in tags or "main" in tags
        if inside and (tags & {"nav", "aside", "form", "footer", "button", "dialog"} or b.cues & {"advert", "comment", "side", "notice", "form"}):
            f.append(_AT["boiler_in_article"])
        if seen_article and not inside:
            f.append(_AT["after_article"])
        seen_article |= inside
        out.append(f)
    return out


class Field:
    """weights (features, 2 labels) and transitions (2, 2); label 1 is main text."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray) -> None:
        self.weights, self.transitions = weights, transitions
        self.rows = weights.tolist()

    def decode(self, features: list[list[int]]) -> list[int]:
        """Viterbi's best labels; ties go to main text."""
        if not features:
            return []
        rows = self.rows
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a = b = 0.0
        back: list[tuple[int, int]] = []
        for i, f in enumerate(features):
            x = sum(rows[k][0] for k in f)
            y = sum(rows[k][1] for k in f)
            if i:
                from0 = 1 if b + t10 >= a + t00 else 0
                from1 = 1 if b + t11 >= a + t01 else 0
                a, b = x + (b + t10 if from0 else a + t00), y + (b + t11 if from1 else a + t01)
                back.append((from0, from1))
            else:
                a, b = x, y
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 250, rate: float = 0.1, ridge: float = 2e-4) -> Field:
    """Maximise the mean log likelihood of whole label sequences; all pages are stepped through side by side."""
    pages = [p for p in pages if p[0]]
    n, width = len(pages), max((len(f) for f, _ in pages), default=0)
    x = np.zeros((n, width, len(NAMES)), np.float32)
    y = np.zeros((n, width), np.int64)
    length = np.array([len(f) for f, _ in pages])
    for i, (f, labels) in enumerate(pages):
        for j, active in enumerate(f):
            x[i, j, active] = 1
        y[i, : len(labels)] = labels
    live = np.arange(width)[None] < length[:, None]
    w, t = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    onehot = np.eye(2)[y] * live[..., None]
    both = live[:, 1:] & live[:, :-1]
    pairs = np.einsum("ija,ijb->ab", onehot[:, :-1] * both[..., None], onehot[:, 1:])
    total = live.sum()
    for step in range(1, rounds + 1):
        unary = x.reshape(-1, len(NAMES)) @ w.astype(np.float32)
        unary = unary.reshape(n, width, 2).astype(float)
        forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        forward[:, 0] = unary[:, 0]
        for j in range(1, width):
            move = np.logaddexp.reduce(forward[:, j - 1, :, None] + t[None], axis=1) + unary[:, j]
            forward[:, j] = np.where(live[:, j, None], move, forward[:, j - 1])
        for j in range(width - 2, -1, -1):
            move = np.logaddexp.reduce(t[None] + (unary[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(live[:, j + 1, None], move, 0.0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + backward - z[:, None, None]) * live[..., None]
        joint = np.exp(forward[:, :-1, :, None] + t + (unary + backward)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        gw = np.tensordot(x, (onehot - single).astype(np.float32), axes=([0, 1], [0, 1])) / total - ridge * w
        gt = (pairs - joint.sum((0, 1))) / total - ridge * t
        for k, (g, p) in enumerate(((gw, w), (gt, t))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            p += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(w, t)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Made-up pages with their main blocks: (html, texts of the blocks that are main text)."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t th v w".split() for b in "a e i o u an er in on".split()]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 18) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "?", "!"])

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() if rng.random() < 0.7 else sentence().replace(" ", ", ", 1) for _ in range(rng.randint(low, high)))

    def attribute(*values: str, chance: float = 0.85) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(values)}"' if rng.random() < chance else ""

    def named() -> str:
        """Names that articles use in passing: a cue's word in the company of others, or only the beginning of a word."""
        if rng.random() > 0.1:
            return ""
        word = rng.choice(sorted(_MAYBE))
        return f' class="{rng.choice([f"{word}-{words(1, 1)}", f"{words(1, 1)}_{word}", word + words(1, 1)])}"'

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def boiler(kind: str) -> str:
        if kind == "menu":
            tag = rng.choice(["nav", "nav", "div"])
            return f"<{tag}{attribute('menu', 'main-nav', 'navbar', 'breadcrumb', chance=0.9 if tag == 'div' else 0.4)}>{links(3, 8)}</{tag}>"
        if kind == "header":
            return f"<header{attribute('site-header', 'masthead', 'top', chance=0.5)}>{rng.choice(['<div>', '<p>'])}{words(1, 5)}{rng.choice(['</div>', '</p>'])}{links(0, 4) if rng.random() < 0.5 else ''}</header>"
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "footer", "div"])
            text = rng.choice(["&copy; " + words(1, 3) + " &middot; " + sentence(), words(2, 8), sentence() + " All rights reserved.", links(2, 5)])
            return f"<{tag}{attribute('footer', 'site-footer', 'copyright', chance=1.0 if tag == 'div' else 0.4)}>{text if rng.random() < 0.5 else '<p>' + text + '</p>'}</{tag}>"
        if kind == "side":
            tag = rng.choice(["aside", "aside", "div", "section"])
            inside = rng.choice([f"<h3>{words(1, 3)}</h3>{links(2, 6)}", f"<p>{prose(1, 3)}</p>", f"<h2>{words(1, 4)}</h2><p>{sentence()}</p>"])
            return f"<{tag}{attribute('sidebar', 'widget', 'related', 'recommended', chance=1.0 if tag != 'aside' else 0.5)}>{inside}</{tag}>"
        if kind == "notice":
            if rng.random() < 0.1:
                return f"<noscript>{prose(1, 2)}</noscript>"
            tag = rng.choice(["div", "div", "section", "aside", "dialog", "p"])
            extra = f"<button>{words(1, 2)}</button>" if tag != "p" and rng.random() < 0.5 else ""
            text = prose(1, 3)
            text = f"<p>{text}</p>" if tag != "p" and rng.random() < 0.6 else text
            return f"<{tag}{attribute('cookie-banner', 'cookie-notice', 'notice', 'consent', 'alert', 'popup', chance=1.0)}>{text}{extra}</{tag}>"
        if kind == "advert":
            tag = rng.choice(["div", "div", "aside", "section", "p"])
            text = prose(1, 2)
            return f"<{tag}{attribute('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', chance=1.0)}>{text if tag == 'p' or rng.random() < 0.6 else '<p>' + text + '</p>'}</{tag}>"
        if kind == "form":
            rows = "".join(f"<label>{words(1, 3)}</label><input name={words(1, 1)}>" for _ in range(rng.randint(1, 3)))
            lead = rng.choice(["", f"<p>{sentence()}</p>", f"<h3>{words(1, 4)}</h3>"])
            return f"<form{attribute('signup', 'newsletter', 'search', 'login', chance=0.5)}>{lead}<div>{rows}</div><button>{words(1, 2)}</button></form>"
        if kind == "comments":
            tag = rng.choice(["section", "div", "div", "ol", "aside"])
            one = lambda: f"<div{attribute('comment', 'reply', 'comment-body')}><p>{prose(1, 4)}</p></div>" if rng.random() < 0.7 else f"<p>{prose(1, 3)}</p>"
            inner = rng.choice(["", f"<h2>{words(1, 3)}</h2>", f"<h3>{rng.randint(1, 40)} {words(1, 1)}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 5)))
            if tag == "ol":
                inner = "".join(f"<li>{prose(1, 3)}</li>" for _ in range(rng.randint(1, 4)))
            return f"<{tag}{attribute('comments', 'comment-list', 'discussion', 'replies', 'disqus', chance=1.0)}>{inner}</{tag}>"
        return f"<div{attribute('share', 'social', 'tags', 'byline', chance=1.0)}>{rng.choice([links(2, 4), words(2, 6)])}</div>"

    out = []
    for _ in range(count):
        main: list[str] = []

        def keep(text: str, main: list[str] = main) -> str:
            main.append(text)
            return text

        article = []
        if rng.random() < 0.9:
            title = keep(words(2, 12).capitalize() + rng.choice(["", "", "."]))
            head = f"<h1>{title}</h1>"
            article.append(f"<header>{head}</header>" if rng.random() < 0.1 else head)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            r = rng.random()
            if r < 0.72:
                text = keep(prose(1, 9) if rng.random() < 0.8 else sentence(1, 6))
                style = rng.random()
                article.append(f"<p{named()}>{text}</p>" if style < 0.7 else f"<p><b>{text}<br>" if style < 0.8 else f"<div{named()}>{text}</div>" if style < 0.87 else
                    f"<p>{text}" if style < 0.97 else f"<noscript><p>{text}</p></noscript>" if style < 0.98 else f"<section{named()}><p>{text}</p></section>")
            elif r < 0.82:
                article.append(f"<h{(k := rng.randint(2, 4))}>{keep(words(1, 7).capitalize())}</h{k}>")
            elif r < 0.9:
                article.append("<ul>" + "".join(f"<li>{keep(rng.choice([words(1, 8), sentence()]))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.95:
                article.append(f"<blockquote>{keep(prose(1, 3))}</blockquote>")
            else:
                article.append(f"<table><tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 4))}</td></tr></table>")
            if rng.random() < 0.08:
                article.append(boiler(rng.choice(["advert", "side", "social", "form", "notice", "notice"])))
        if rng.random() < 0.15:
            article.append(boiler("comments"))
        wrap = rng.random()
        inside = "\n".join(article) if rng.random() < 0.3 else "".join(article)
        if wrap < 0.6:
            inside = f"<article{attribute('post', 'entry', 'story', chance=0.3)}>{inside}</article>"
        elif wrap < 0.75:
            inside = f"<main><div>{inside}</div></main>"
        elif wrap < 0.95:
            inside = f"<div{attribute('content', 'article-body', 'post-content', 'entry', 'main', chance=1.0)}>{inside}</div>"
        before = [boiler(k) for k in ("menu", "header", "notice", "advert", "social") if rng.random() < 0.5]
        after = [boiler(k) for k in ("side", "form", "comments", "advert", "notice", "footer", "social", "menu") if rng.random() < 0.45]
        if rng.random() < 0.7:
            rng.shuffle(before)
        if rng.random() < 0.1:
            inside = f"<main>{inside}{after.pop() if after else ''}</main>"
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        page = f"{head}<body>{''.join(before)}<!-- {words(1, 3)} -->{inside}{''.join(after)}"
        out.append((page + ("</body></html>" if rng.random() < 0.85 else ""), main))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    data = []
    for page, main in labelled_pages(pages, seed):
        found = blocks(page)
        left = [" ".join(t.split()) for t in main]
        labels = []
        for b in found:
            hit = b.text in left
            if hit:
                left.remove(b.text)
            labels.append(int(hit))
        data.append((featurise(found), labels))
    return fit(data)


def extract(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, field.decode(featurise(found)), strict=True) if label)


def main_text(pages: DataFrame, field: Field | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every row."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(field or trained())  # a fixed number of weights

    def of(pages: list[str | None]) -> list[pa.Array]:
        texts = [extract(h, shared.value) for h in pages]
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    return with_text_columns(pages, keep, "html", [StructField("text", StringType()), StructField("n_chars", LongType())], lambda: of)


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
