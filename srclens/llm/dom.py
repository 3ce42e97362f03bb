"""Lenient HTML parsing into blocks, and the skeleton of a page's block elements.

A skeleton node stands for all elements with one path of tag and class; inline
elements belong to the block around them.  Nodes deeper than ``DEPTH`` count as
their ancestor at that depth, so nothing is lost and recursion is bounded.
"""

from __future__ import annotations

import html
import re

#: Far below the interpreter's limit of recursion.
DEPTH = 250
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?/][^a-zA-Z][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*>?|<([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^<]*\Z""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "html head body article main section div header footer nav aside form fieldset address p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr details summary dialog menu center hgroup search title noscript".split()
)
#: Elements whose start closes an open one of these kinds, up to the named scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"title", "noscript", "html", "head", "body"}
DROP = frozenset("script style noscript template nav aside footer form button select option input textarea iframe object embed svg canvas dialog menu head title search noembed noframes audio video map".split())
#: Words of class and id that mark what is not the article, where they are all that a name says.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations trending comments comment commentlist disqus respond replies reactions pagination pager widget toolbar login search skip tags hidden copyright".split()
)
#: Those of them whose text varies from page to page like an article's, so that no alignment tells them from it.
VARYING = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended recommendations trending comments comment commentlist disqus respond replies reactions hidden".split())
#: Elements that hold furniture of a page, for which induction is asked first.
FURNITURE = frozenset("nav aside footer header menu dialog search".split())
#: What is known of an element from its own markup: nothing, that it is furniture if its text stands still, that it is no article.
OPEN, NAMED, OUT = 0, 1, 2
#: Words that say nothing beside those: what a box looks like or where it stands.
PLACES = frozenset("area bar bottom box button buttons col column container fixed form global group header icon icons inner item items left link links list mobile module outer page panel primary right row secondary section site sticky top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
WHITE = re.compile(r"\s+")


class Page:
    """sig, parent: the skeleton in order of first appearance; a named element's sig ends in '.!'.  blocks: (node, noise, text) in page order, noise as OPEN, NAMED or OUT."""

    __slots__ = ("blocks", "parent", "sig")

    def __init__(self):
        self.sig, self.parent, self.blocks = ["html"], [-1], []

    def skeleton(self) -> str:
        return "\n".join(f"{p} {s}" for p, s in zip(self.parent, self.sig, strict=True))


def words_of(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def names_noise(value: str) -> int:
    """What the names in a class or id say outright, and nothing else beside it: ad-box says OUT, site-footer NAMED, alert-text nothing."""
    out = OPEN
    for name in value.split():
        words = set(words_of(name))
        if words & NOISE and words <= NOISE | PLACES:
            out = max(out, OUT if words & VARYING else NAMED)
    return out


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[str, int]:
    """Signature of a block element, and what its own markup says of it."""
    noise, cls = NAMED if tag in FURNITURE and (tag != "header" or not in_article) else OUT if tag in DROP else OPEN, ""
    if attrs and ("=" in attrs or "hidden" in attrs):
        a = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
        cls = " ".join(words_of(a.get("class", "")))
        if tag not in ("html", "body", "article", "main"):
            noise = max(noise, names_noise(a.get("class", "")), names_noise(a.get("id", "")))
        if a.get("role", "") in ROLES:
            noise = max(noise, NAMED)
        if a.get("aria-hidden") == "true" or "hidden" in a or "display:none" in a.get("style", "").replace(" ", ""):
            noise = OUT
    return (f"{tag}.{cls}" if cls else tag) + (".!" if noise == NAMED else ""), noise


def parse(source: str) -> Page:
    page = Page()
    index: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, int, bool, int]] = [("html", 0, OPEN, False, 0)]  # tag, node, noise, in article, depth
    held: list[str] = []
    blocks, sigs, parents = page.blocks, page.sig, page.parent

    def flush() -> None:
        if held:
            text = WHITE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((stack[-1][1], stack[-1][2], text))

    def pop(n: int) -> None:
        if any(t[0] in BLOCK or t[2] != stack[n - 1][2] for t in stack[n:]):
            flush()
        del stack[n:]

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        close, tag = m[1], m[2] or m[4]
        if close:
            close = close.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == close:
                    pop(i)
                    break
            continue
        if not tag:
            continue
        tag, attrs = tag.lower(), (m[3] if m[2] else m[5]) or ""
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            n = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = n.end() if n else end
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in ("td", "th", "li", "div", "article", "section", "table", "blockquote"):
                    break
        if tag in CLOSES:
            kinds, scope = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in kinds:
                    pop(i)
                    break
                if stack[i][0] in scope:
                    break
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        _, node, noise, inside, depth = stack[-1]
        if tag in ("html", "body") and any(t[0] == tag for t in stack[1:]):
            continue
        sig, own = _kind(tag, attrs, inside)
        own = max(own, noise)
        if tag in BLOCK:
            flush()
            if depth < DEPTH:
                key = (node, sig)
                if key not in index:
                    index[key] = len(sigs)
                    sigs.append(sig)
                    parents.append(node)
                node = index[key]
        elif own > noise:
            own = OUT  # it has no node of its own to be judged by
            flush()
        stack.append((tag, node, own, inside or tag in ("article", "main"), depth + (tag in BLOCK)))
        if attrs.endswith("/") and tag in ("svg", "math", "path"):
            stack.pop()
    flush()
    return page
