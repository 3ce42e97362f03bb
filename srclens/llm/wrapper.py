"""Wrapper induction for the pages of a host: simple tree matching over skeletons.

Equal skeletons are one, with each node's number of pages and characters and the
texts that may be template.  The most frequent skeleton starts the wrapper; each
later one is matched with it (the largest order-keeping match of trees with
equal root tags) and what has no match is inserted.  The statistics meet in the
wrapper; each skeleton gets its own slot by them, so layouts of one host don't
lose their article to each other.  A wrapper is a skeleton with statistics
itself, so wrappers of parts of a host are matched into one in the same way.
"""

from __future__ import annotations

import pickle
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

CONTAINER = frozenset("html body article main section div td center table tbody tr blockquote".split())

#: A text is template where it stands on this share of the pages that have its node, and on several distinct ones.
CONSTANT, SEVERAL = 0.9, 3


class Node:
    __slots__ = ("chars", "children", "every", "pages", "sig", "tag", "texts")

    def __init__(self, sig: str):
        self.sig, self.tag = sig, sig.split(".")[0]
        self.children: list[Node] = []
        self.pages, self.chars, self.every = 0, 0, 0
        self.texts: Counter[int] = Counter()

    def add(self, pages: int, chars: int, every: int, texts: Iterable[tuple[int, int]]) -> None:
        """every: the texts of all pages; texts: (hash, pages) of those that may be template."""
        self.pages, self.chars, self.every = self.pages + pages, self.chars + chars, self.every + every
        for h, n in texts:
            self.texts[h] += n

    def template(self) -> list[int]:
        """Hashes of the texts that are no content: those of nearly every page that has the node, wherever among its siblings."""
        return sorted(h for h, n in self.texts.items() if n >= max(SEVERAL, CONSTANT * self.pages))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def tree(skeleton: str) -> list[Node]:
    """The nodes of a skeleton in its order; the first is the root."""
    nodes: list[Node] = []
    for line in skeleton.split("\n"):
        parent, sig = line.split(" ", 1)
        nodes.append(Node(sig))
        if int(parent) >= 0:
            nodes[int(parent)].children.append(nodes[-1])
    return nodes


def match(a: Node, b: Node, memo: dict) -> int:
    """Size of the largest match of two trees; equal classes count a little more than equal tags alone."""
    if a.tag != b.tag:
        return 0
    if (id(a), id(b)) not in memo:
        m, n = len(a.children), len(b.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(a.children[i], b.children[j], memo))
        memo[id(a), id(b)] = (4 + (a.sig == b.sig) + best[m][n], best)
    return memo[id(a), id(b)][0]


def merge(wrapper: Node, other: Node, into: dict[int, Node], memo: dict) -> None:
    """Maps each node of other to its node of the wrapper, inserting what has none after its left neighbour."""
    into[id(other)] = wrapper
    match(wrapper, other, memo)
    best = memo[id(wrapper), id(other)][1]
    i, j, steps = len(wrapper.children), len(other.children), []
    while j:
        if i and best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
            steps.append((i, j, False))
        else:
            i, j = i - 1, j - 1
            steps.append((i, j, True))
    before = list(wrapper.children)
    for i, j, met in steps:  # from right to left
        child = other.children[j]
        if met:
            merge(before[i], child, into, memo)
        else:
            wrapper.children.insert(i, child)
            for n in child.walk():
                into[id(n)] = n


def slot_of(skeleton: str, nodes: list[Node]) -> set[int]:
    """The nodes of a skeleton at and below its slot, by the wrapper's statistics of the nodes it has.

    The slot is as deep as one container holds most of the text, and no deeper
    than the article element.  It must hold most of the text of all pages and of
    an average page, so neither a frequent layout nor one long page decides alone.
    """
    parents = [int(line.split(" ", 1)[0]) for line in skeleton.split("\n")]
    children: list[list[int]] = [[] for _ in parents]
    total, mean = [n.chars for n in nodes], [n.chars / max(1, n.pages) for n in nodes]
    own = [int(n.chars > 0) for n in nodes]
    tags = [line.split(" ", 1)[1].split(".")[0] for line in skeleton.split("\n")]
    for k in range(len(parents) - 1, 0, -1):
        total[parents[k]] += total[k]
        mean[parents[k]] += mean[k]
        children[parents[k]].insert(0, k)
    slot = 0

    def most(k: int) -> bool:
        return total[k] > 0 and total[k] >= 0.8 * total[slot] and mean[k] >= 0.8 * mean[slot]

    while tags[slot] not in ("article", "main") or any(tags[k] == "article" and most(k) for k in children[slot]):
        inner = [k for k in children[slot] if tags[k] in CONTAINER and most(k)]
        if not inner or any(tags[k] in ("h1", "h2") and own[k] for k in children[slot]):
            break
        slot = inner[0]
    below = {slot}
    for k in range(slot + 1, len(parents)):
        if parents[k] in below:
            below.add(k)
    return below


class Wrapper:
    """A wrapper of skeletons of a host, or of such wrappers.  ``add`` takes them, the most frequent first.

    What is held is the wrapper alone; the skeletons wait in a file of the
    worker, each with the wrapper's nodes that its own ones are.
    """

    def __init__(self):
        self.root: Node | None = None
        self.nodes: list[Node] = []
        self.number: dict[int, int] = {}
        self.waiting = tempfile.TemporaryFile()
        self.weight = 0

    def add(self, name: int, skeleton: str, stats: dict[int, tuple], weight: int = 0) -> None:
        """stats: per node of the skeleton what ``Node.add`` takes."""
        nodes = tree(skeleton)
        into: dict[int, Node] = {}
        if self.root is None:
            self.root = nodes[0]
            into = {id(n): n for n in nodes}
        else:
            merge(self.root, nodes[0], into, {})
        of = array("q")
        for k, n in enumerate(nodes):
            met = into[id(n)]
            if id(met) not in self.number:
                self.number[id(met)] = len(self.nodes)
                self.nodes.append(met)
            of.append(self.number[id(met)])
            if k in stats:
                met.add(*stats[k])
        self.weight += weight
        pickle.dump((name, skeleton, of), self.waiting)

    def added(self) -> Iterator[tuple[int, str, array]]:
        """(name, skeleton, the number of the wrapper's node for each of its own) of all that was added."""
        end = self.waiting.tell()
        self.waiting.seek(0)
        while self.waiting.tell() < end:
            yield pickle.load(self.waiting)
        self.waiting.close()

    def skeleton(self) -> tuple[str, list[int]]:
        """The wrapper as a skeleton, and the place in it of each of its nodes by number."""
        lines: list[str] = []
        place: dict[int, int] = {}

        def visit(n: Node, parent: int) -> None:
            place[id(n)] = len(lines)
            lines.append(f"{parent} {n.sig}")
            for c in n.children:
                visit(c, place[id(n)])

        visit(self.root, -1)
        return "\n".join(lines), [place[id(n)] for n in self.nodes]


class Held:
    """What ``slot_of`` asks of a node."""

    __slots__ = ("chars", "pages")

    def __init__(self, pages: int, chars: int):
        self.pages, self.chars = pages, chars


def verdict(skeleton: str, of: list[int], pages: list[int], chars: list[int], own: list[bool], known: list[list[int]]) -> tuple[set[int], list[tuple[int, int]], list[int]]:
    """(the nodes of the slot, (node, hash) of the template texts, the nodes whose names decide) of a skeleton whose nodes are those numbered of in lists of the host's statistics.

    own: whether a node has texts that are no template; known: its template
    texts.  Names decide in named nodes where induction sees no template.
    """
    slot = slot_of(skeleton, [Held(pages[i], chars[i]) for i in of])
    named: list[bool] = []
    for line in skeleton.split("\n"):
        parent, sig = line.split(" ", 1)
        named.append(sig.endswith(".!") or (int(parent) >= 0 and named[int(parent)]))
    # where all of a slot is the same on all pages, that is its content
    varies = any(own[of[k]] for k in slot if not named[k])
    drop = [(k, h) for k, i in enumerate(of) for h in known[i] if varies or k not in slot]
    judged = {k for k, _ in drop}
    return slot, drop, [k for k, i in enumerate(of) if named[k] and (own[i] or k not in judged)]
