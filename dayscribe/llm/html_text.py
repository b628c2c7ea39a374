"""Main text of web pages by wrapper induction.

A page is a tree of containers (div, article, nav ...), each with its own text blocks. Trees of one host's pages are
aligned by simple tree matching and merged, nodes of either tree kept, into the host's wrapper. Over the pages, the
wrapper's nodes then say what is template and what is a slot: a block that most pages hold at the same node is
constant, and of the nodes whose text varies those that hold the most of it are the content. What the markup calls
itself (nav, class="ad", article ...) tips the scales between slots of like mass, and decides alone where a host
has too few pages to compare.

Trees are merged in an order that depends on their contents only, and all else is counted, so neither the order of
pages nor their partitions change the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, spread_join, staged

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are nodes of the wrapper; the text of others belongs to the container around them.
CONTAINERS = frozenset("article aside body center details dialog div fieldset footer form header html main menu nav section".split())
#: Elements that end a run of inline text.
BLOCK = CONTAINERS | frozenset(
    "address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 head hr legend li ol optgroup option p pre summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never read.
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas button select textarea input".split())
#: Elements that name themselves as something other than content; a form may wrap a whole page.
ASIDE, FORMS = frozenset("nav footer aside menu dialog".split()), frozenset(("form",))
#: Class, id or role tokens that name a region as something other than content; whole ones, as related-work and with-sidebar don't.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related "
    "recommended comment comments disqus reply replies respond pagination pager toolbar masthead skip complementary contentinfo".split()
)
#: Tokens that name an article element as a reader's comment.
REMARK = frozenset("comment reply".split())
REMARKS = frozenset("comments comment replies respond disqus related recommended".split())
#: Elements that hold text: within an article of a host with a wrapper a name drops one only if it is an advert's, or if the
#: wrapper shows that most of its text is constant.
PROSE = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 p pre table tbody td tfoot th thead tr".split())
ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Tokens of regions that are left out however much of the page they hold; others may name the wrapper of an article.
NEVER = REMARKS | ADVERT
#: Sections are anchors as headings are: an id names one only if it is one of these.
ANCHORED = frozenset("comments respond disqus".split())
#: Elements that a page has one of, or that are alike whatever they are called: matched by tag alone.
PLAIN = frozenset("html body main article".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
#: Pages of a host from which its wrapper counts; the share of a node's pages that a block must be on to be constant.
LEAST_PAGES, SHARE = 5, 0.9
#: Nodes of a host's wrapper; pages, or different trees, of a host that a task takes with one copy of it.
NODES, GROUP = 1 << 15, 1024
#: What a constant character weighs against a varying one, and a name against mass.
CONSTANT, NAMED = 0.25, 4.0
#: A slot beside the content that holds less than this share of it isn't content.
MINOR = 0.1


class Node:
    __slots__ = ("tag", "names", "parts")

    def __init__(self, tag: str, names=frozenset()):
        self.tag, self.names, self.parts = tag, names, []


#: Tags whose quotes never end that are looked through to the end of a page; from there on a tag ends at the first >.
UNQUOTED = 32


def _tags(html: str):
    """(text before, end tag or not, tag, attributes, place after, whether a tag is there) of each piece of markup in order, in time
    that grows with the page's length, whatever is broken in it."""
    import re

    opening = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
    name = re.compile(r"[a-zA-Z][^\s/>]*")
    quoted = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
    at, n, broken = 0, len(html), 0
    while at < n:
        m = opening.search(html, at)
        stop = html.find(">", m.end()) if m else -1
        if m and m[0] == "<!--":
            end = html.find("-->", m.end())
            at = yield html[at : m.start()], None, "", "", n if end < 0 else end + 3
            continue
        if stop < 0:  # no tag ends any more
            yield html[at:], None, "", "", n
            return
        if m[0][1] in "!?":
            at = yield html[at : m.start()], None, "", "", stop + 1
            continue
        end_tag = m[0][1] == "/"
        tag = name.match(html, m.end() - 1)
        found = quoted.match(html, tag.end()) if broken < UNQUOTED else None
        broken += found is None
        after = found.end() if found else html.find(">", tag.end()) + 1
        at = yield html[at : m.start()], end_tag, tag[0].lower(), html[tag.end() : after - 1], after


def parse(html: str) -> Node:
    """The tree of a page's elements and texts, whatever the markup; character references decoded."""
    import html as refs
    import re
    import sys

    # Trees are walked by recursion, and a broken page may nest as deep as it is long; Python's frames aren't on the C stack.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * html.count("<") + 10_000))
    name = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
    n = len(html)
    # Open elements, the places of each tag and of blocks among them.
    stack, places, blocks = [Node("#")], {}, []

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        if node.tag in BLOCK:
            blocks.append(len(stack))
        stack.append(node)

    def close(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        del stack[k:]

    pieces = _tags(html)
    piece = next(pieces, None)
    while piece:
        text, ends, tag, rest, at = piece
        if text:
            stack[-1].parts.append(refs.unescape(text) if "&" in text else text)
        if ends and places.get(tag):
            k = places[tag][-1]
            # An end tag of inline markup doesn't reach out of its block.
            if tag in BLOCK or not blocks or blocks[-1] <= k:
                close(k)
        elif ends is False:
            if tag in BLOCK:
                # A block ends an open paragraph with the inline markup in it, and a list item or cell its like.
                ended = CLOSES.get(tag, frozenset())
                for k in blocks[::-1] if ended else blocks[-1:]:
                    if stack[k].tag == "p" or stack[k].tag in ended:
                        close(k)
                        if not ended:
                            break
                    elif not (ended and stack[k].tag in ("tr", "td", "th", "li", "dd", "dt")):
                        break
            names = frozenset()
            if rest and "=" in rest:
                said = [(k.lower(), a or b or c) for k, a, b, c in name.findall(rest)]
                # An id names a region only if it is one of the known names: others name the page or the place.
                names = frozenset(
                    t for k, v in said for t in v.lower().split()
                    if k != "id" or t in BOILERPLATE and tag not in HEADINGS and (tag != "section" or t in ANCHORED)
                )
            node = Node(tag, names)
            stack[-1].parts.append(node)
            if tag in VOID or rest.endswith("/") and tag not in BLOCK:
                pass
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                stop = html.find(">", end.end()) if end else -1
                if tag not in ("script", "style"):
                    node.parts.append(html[at : end.start() if stop >= 0 else n])
                at = stop + 1 if stop >= 0 else n
            else:
                push(node)
        try:
            piece = pieces.send(at)
        except StopIteration:
            break
    return stack[0]


class Page:
    """A page as containers in page order (parent, label) and blocks in page order (container, text, characters
    outside links); a label is the tag and the names of a container, in order and without those that hold digits."""

    def __init__(self, html: str, names: bool = True):
        self.parent, self.label, self.blocks = [-1], ["#"], []
        run, linked, inner = [], 0, [set()]

        def flush(own):
            nonlocal linked
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                self.blocks.append((own, text, max(0, len(text) - linked)))
            linked = 0

        def walk(node, own, link, within):
            """within: inside an article, or a block of text: inline markup there is text whatever it is called."""
            nonlocal linked
            for p in node.parts:
                if not isinstance(p, str) and (p.tag in BLOCK or p.tag == "a") and p.tag not in CONTAINERS and p.tag not in HIDDEN:
                    inner[own].add(p.tag)
                if isinstance(p, str):
                    run.append(p)
                    linked += len(" ".join(p.split())) if link else 0
                elif p.tag == "br":
                    run.append(" ")
                elif p.tag in VOID and p.tag not in BLOCK:
                    continue
                elif p.tag in HIDDEN:
                    if p.tag in BLOCK:
                        flush(own)
                elif p.tag in CONTAINERS:
                    said = sorted(p.names & (REMARK | BOILERPLATE) if p.tag in PLAIN else p.names)
                    open_(p, own, [t for t in said if not any(c.isdigit() for c in t)], link, within or p.tag in ("article", "main"))
                elif p.names & BOILERPLATE and names and (p.tag in BLOCK or any(not isinstance(x, str) and x.tag in BLOCK for x in p.parts)):
                    # Other elements are containers only where they name themselves as something other than content.
                    open_(p, own, sorted(p.names & BOILERPLATE), link, within or p.tag in PROSE)
                elif p.tag in BLOCK:
                    flush(own)
                    walk(p, own, link, within or p.tag in PROSE)
                    flush(own)
                elif within or not (names and p.names & BOILERPLATE):
                    walk(p, own, link or p.tag == "a", within)

        def open_(p, own, said, link, within):
            flush(own)
            k = len(self.parent)
            self.parent.append(own)
            self.label.append(" ".join([p.tag, *said]))
            inner.append(set())
            walk(p, k, link, within)
            flush(k)

        walk(parse(html), 0, False, False)
        flush(0)
        self.node, self.tree = _shape(self.parent, self.label, inner)


# A tree is [label, children, nodes in it, digest]. Its nodes are numbered in order.


def _tree(label: str, children: list) -> list:
    import hashlib

    seen = hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=8)
    for c in children:
        seen.update(c[3])
    return [label, children, 1 + sum(c[2] for c in children), seen.digest()]


def _shape(parent: list[int], label: list[str], inner: list[set]) -> tuple[list[int], list]:
    """The tree of containers, equal neighbours with names as one node, and each container's node. Kinds of other
    elements in a container (inner) come as leaves before its containers: a menu isn't taken for a story."""
    own: list[list[int]] = [[] for _ in parent]
    trees: list = [None] * len(parent)
    kept: list = [None] * len(parent)
    for k in range(len(parent) - 1, -1, -1):
        children, same = [], []
        for c in reversed(own[k]):
            if children and " " in label[c] and children[-1][3] == trees[c][3]:
                same[-1].append(c)
            else:
                children.append(trees[c])
                same.append([c])
        trees[k], kept[k] = _tree(label[k], [_tree("-" + t, []) for t in sorted(inner[k])] + children), same
        if k:
            own[parent[k]].append(k)
    node = [0] * len(parent)
    for k in range(len(parent)):
        at = node[k] + 1 + len(inner[k])
        for same in kept[k]:
            for c in same:
                node[c] = at
            at += trees[same[0]][2]
    return node, trees[0]


def flat(tree: list) -> str:
    """A tree as lines of depth and label."""
    out, stack = [], [(0, tree)]
    while stack:
        depth, t = stack.pop()
        out.append(f"{depth} {t[0]}")
        stack += [(depth + 1, c) for c in reversed(t[1])]
    return "\n".join(out)


def unflat(text: str) -> tuple[list[int], list[str], list]:
    """Parents and labels in order, and the tree, of flat()."""
    parent, label, open_ = [], [], []
    for k, line in enumerate(text.split("\n")):
        depth, name = line.split(" ", 1)
        del open_[int(depth) :]
        parent.append(open_[-1] if open_ else -1)
        label.append(name)
        open_.append(k)
    children: list[list] = [[] for _ in parent]
    tree = None
    for k in range(len(parent) - 1, -1, -1):
        tree = _tree(label[k], children[k][::-1])
        if k:
            children[parent[k]].append(tree)
    return parent, label, tree


def match(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching: the size of the largest matching of two trees that keeps order, levels and labels, and
    its pairs as nested [x, y, pairs of children as (place in x, place in y, [x, y, ...])]."""
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * (a[2] + b[2]) + 10_000))
    known: dict = {}

    def size(x, y) -> int:
        if x[0] != y[0]:
            return 0
        if x[3] == y[3]:
            return x[2]
        key = (x[3], y[3])
        if key not in known:
            known[key] = 1 + grid(x, y)[0][-1][-1]
        return known[key]

    def grid(x, y):
        """Best sizes of all beginnings of the children that have to be compared. Equal ones at both ends are paired,
        which costs nothing, and those whose label the other side doesn't have can't be."""
        p, q = x[1], y[1]
        begin, end = 0, 0
        while begin < min(len(p), len(q)) and p[begin][3] == q[begin][3]:
            begin += 1
        while end < min(len(p), len(q)) - begin and p[-1 - end][3] == q[-1 - end][3]:
            end += 1
        whole = sum(c[2] for c in p[:begin]) + sum(c[2] for c in p[len(p) - end :])
        i, j = range(begin, len(p) - end), range(begin, len(q) - end)
        common = {p[k][0] for k in i} & {q[k][0] for k in j}
        i, j = [k for k in i if p[k][0] in common], [k for k in j if q[k][0] in common]
        best = [[whole] * (len(j) + 1)]
        for k in i:
            above, row = best[-1], [whole]
            for n, m in enumerate(j):
                w = size(p[k], q[m])
                row.append(max(above[n + 1], row[n], above[n] + w if w else 0))
            best.append(row)
        return best, i, j, begin, end

    def pairs(x, y):
        best, p, q, begin, end = grid(x, y)
        out = [(len(x[1]) - 1 - k, len(y[1]) - 1 - k) for k in range(end)]
        i, j = len(p), len(q)
        while i and j:
            w = size(x[1][p[i - 1]], y[1][q[j - 1]])
            if w and best[i][j] == best[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((p[i], q[j]))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        out += [(k, k) for k in range(begin - 1, -1, -1)]
        return [(i, j, pairs(x[1][i], y[1][j])) for i, j in reversed(out)]

    n = size(a, b)
    return n, pairs(a, b) if n else []


def merge(a: list, b: list) -> list:
    """One tree that holds the nodes of both: matched nodes once, others where they stand, those of a first."""

    def both(x, y, pairs):
        out, i, j = [], 0, 0
        for p, q, inner in [*pairs, (len(x[1]), len(y[1]), None)]:
            out += x[1][i:p] + y[1][j:q]
            if inner is not None:
                out.append(x[1][p] if x[1][p][3] == y[1][q][3] else both(x[1][p], y[1][q], inner))
            i, j = p + 1, q + 1
        return _tree(x[0], out)

    n, pairs = match(a, b)
    return both(a, b, pairs) if n else a


def aligned(page: list, wrapper: list) -> list[int]:
    """The wrapper's node for each node of a page's tree, -1 for none."""
    out = [-1] * page[2]
    n, pairs = match(page, wrapper)
    stack = [(page, wrapper, pairs, 0, 0)] if n else []
    while stack:
        x, y, inner, at, to = stack.pop()
        out[at] = to
        starts, ends = [at + 1], [to + 1]
        for c in x[1]:
            starts.append(starts[-1] + c[2])
        for c in y[1]:
            ends.append(ends[-1] + c[2])
        stack += [(x[1][i], y[1][j], more, starts[i], ends[j]) for i, j, more in inner]
    return out


def decide(parent: list[int], label: list[str], varying: list[float], constant: list[float], induced: bool, names: bool = True) -> tuple[list[bool], list[bool]]:
    """Of each container, whether it is read, and whether it is the content itself: the slot that holds most of the text.

    varying and constant: characters outside links of each container's own blocks, over all pages. Text that varies
    weighs more than text that doesn't, and names multiply a container's weight. From the root on, the heaviest
    child is followed while it holds half of the weight or more. Beside that path named containers go, and if the masses
    are those of a host (induced) also slots with little text. Article and main elements bound the content.
    """
    n = len(parent)
    tag, said = [x.split(" ")[0] for x in label], [frozenset(x.split(" ")[1:]) for x in label]
    remark = [names and tag[k] == "article" and bool(said[k] & REMARK) for k in range(n)]
    story = [names and tag[k] in ("article", "main") and not remark[k] for k in range(n)]
    never = [remark[k] or names and not story[k] and (tag[k] in ASIDE or bool(said[k] & NEVER)) for k in range(n)]
    named = [never[k] or names and not story[k] and tag[k] not in PLAIN and (tag[k] in FORMS or bool(said[k] & BOILERPLATE)) for k in range(n)]
    factor = [0.0 if never[k] else NAMED if story[k] else 1 / NAMED if named[k] else 1.0 for k in range(n)]
    mass = [varying[k] + CONSTANT * constant[k] for k in range(n)]
    weight, children = list(mass), [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        weight[k] *= factor[k]
        weight[parent[k]] += weight[k]
        mass[parent[k]] += 0 if never[k] else mass[k]
        children[parent[k]].append(k)
    at, path = 0, {0}
    while children[at] and not story[at]:
        best = max(children[at], key=lambda c: (weight[c], -c))
        if not weight[best] or 2 * weight[best] < weight[at] / (factor[at] if at else 1.0):
            break
        at = best
        path.add(at)

    def regions(opens) -> tuple[list[bool], list[bool]]:
        """What is read, and what of it lies in an article or main element; opens decides for what lies in none."""
        read, inside, region = [k == 0 for k in range(n)], [False] * n, [0] * n
        for k in range(1, n):
            up = parent[k]
            region[k], inside[k] = region[up], inside[up]
            if not read[up]:
                continue
            if inside[up] and induced and names and tag[k] in PROSE and not said[k] & ADVERT:
                read[k] = not named[k] or constant[k] <= varying[k]
            elif inside[up]:
                # What holds most of its region's text wraps the article, whatever its name.
                read[k] = not never[k] and not (named[k] and 2 * mass[k] <= mass[region[k]])
            elif story[k]:
                read[k], inside[k], region[k] = True, True, k
            else:
                read[k] = opens(k)
        return read, [a and b for a, b in zip(read, inside)]

    def opens(k: int) -> bool:
        if k in path:
            return True
        if named[k] or names and tag[k] == "header":
            return not never[k] and tag[k] != "header" and 2 * mass[k] > mass[0]
        return not (induced and parent[k] in path and parent[k] != at and mass[k] < MINOR * mass[at])

    read, inside = regions(opens)
    if not any(inside):
        # A wrapper may name what stands beside the article in it, as class="sidebar" does.
        again = regions(lambda k: tag[k] not in ASIDE and tag[k] not in FORMS and not said[k] & REMARKS and not remark[k])[1]
        if not any(again):
            core = [k in path for k in range(n)]
            for k in range(1, n):
                core[k] = core[k] or read[k] and core[parent[k]] and (parent[k] == at or parent[k] not in path)
            return read, core
        inside = again
    return inside, inside


class Wrapper:
    """A host's wrapper: its tree, and by node the mass and the constant blocks. stats: (node, mass, constant mass,
    hashes of constant blocks), nodes without text left out."""

    def __init__(self, tree: str, pages: int, stats: list, names: bool = True):
        self.parent, self.label, self.tree = unflat(tree)
        n = len(self.parent)
        varying, constant, hashes = [0.0] * n, [0.0] * n, [frozenset()] * n
        for node, mass, fixed, found in stats:
            if node >= 0:
                varying[node], constant[node], hashes[node] = float(mass - fixed), float(fixed), frozenset(found or ())
        self.induced = pages >= LEAST_PAGES
        self.keep, self.core = decide(self.parent, self.label, varying, constant, self.induced, names)
        core = self.core
        # Within the content itself constant blocks go if they are a small part of it: else the pages are copies of one text.
        own = [k for k in range(n) if core[k] and self.keep[k]]
        copies = sum(constant[k] for k in own) > CONSTANT * sum(varying[k] + constant[k] for k in own)
        self.constants = [frozenset() if not self.induced or core[k] and copies else hashes[k] for k in range(n)]
        self.known: dict = {}

    def of(self, tree: list) -> list[int]:
        if tree[3] not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            self.known[tree[3]] = aligned(tree, self.tree)
        return self.known[tree[3]]


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (x >> 63 << 64)


def extract(html: str | None, wrapper: Wrapper | None = None, names: bool = True) -> str:
    """The main text: blocks in page order, white space within one as one space, joined by an empty line.

    Without a wrapper that counts, and for a page that doesn't fit it, the page's own masses decide. names: whether
    containers' names count."""
    if not html:
        return ""
    page = Page(html, names)
    to = [wrapper.of(page.tree)[k] for k in page.node] if wrapper and wrapper.induced else []
    if not to or any(to[k] < 0 for k, _, _ in page.blocks):
        own = [0.0] * len(page.parent)
        for k, _, n in page.blocks:
            own[k] += n
        keep, _ = decide(page.parent, page.label, own, [0.0] * len(own), False, names)
        return "\n\n".join(text for k, text, _ in page.blocks if keep[k])
    kept, constants = wrapper.keep, wrapper.constants
    if not any(wrapper.core[to[k]] for k, _, _ in page.blocks):
        return extract(html, None, names)  # a page of another kind: it holds nothing where the host's content is
    return "\n\n".join(text for k, text, _ in page.blocks if kept[to[k]] and not (constants[to[k]] and _hash(text) in constants[to[k]]))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def _lined(names: bool):
    """Each page's host, tree, and distinct blocks: their node in the tree, hash, and characters outside links."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page, own = Page(html.as_py(), names), {}
                for k, text, n in page.blocks:
                    own[page.node[k], _hash(text)] = n
                rows.append((host, int.from_bytes(page.tree[3], "little", signed=True), flat(page.tree), [k for k, _ in own], [h for _, h in own], list(own.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "shape", "tree", "node", "hash", "mass"])

    return run


def _merged(table):
    """A host's trees merged into one, those of the most pages first; of equal ones the smaller digest. A tree that would make more than
    NODES of it is left out: nodes of it that the others lack are in no wrapper, and what stands there is decided by its own page."""
    import pyarrow as pa

    rows = sorted(zip(table.column("pages").to_pylist(), table.column("shape").to_pylist(), table.column("tree").to_pylist()), key=lambda r: (-r[0], r[1]))
    tree = None
    for _, _, text in rows:
        other = unflat(text)[2]
        if tree is None:
            tree = other
        elif tree[3] != other[3] and tree[2] + other[2] - match(tree, other)[0] <= NODES:
            tree = merge(tree, other)
    own = int.from_bytes(tree[3], "little", signed=True)
    return pa.table({"host": table.column("host")[:1], "shape": pa.array([own], pa.int64()), "tree": pa.array([flat(tree)]), "pages": pa.array([sum(r[0] for r in rows)], pa.int64())})


def _placed(shapes, whole):
    """Where each tree's nodes are in its host's wrapper."""
    import pyarrow as pa

    tree = unflat(whole.column("whole")[0].as_py())[2]
    to = [aligned(unflat(x)[2], tree) for x in shapes.column("tree").to_pylist()]
    return pa.table({"host": shapes.column("host"), "shape": shapes.column("shape"), "to": pa.array(to, pa.list_(pa.int32()))})


def _beside(rows: DataFrame, whole: DataFrame, count: str, f, kind: str) -> DataFrame:
    """f over groups of a host's rows, some GROUP of them, each beside its host's one row of whole, which has the number of its rows
    in column count: that row is copied once a group, not once a row. Rows of hosts without one are left out.

    Rows are numbered where they are read, and dealt into their host's groups by that number: copies too."""
    groups = whole.select("host", F.col(count).alias("_c"), F.ceil(F.col(count) / GROUP).cast("int").alias("_groups"))
    total = whole.agg(F.sum(count)).first()[0] or 0
    dealt = spread_join(rows.withColumn("_row", F.monotonically_increasing_id()), groups, "host", "_c", total)
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_row"), F.col("_groups")).cast("int")).drop("_row", "_groups")
    copies = whole.withColumn("_group", F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / GROUP).cast("int") - 1)))
    return dealt.groupBy("host", "_group").cogroup(copies.groupBy("host", "_group")).applyInArrow(f, kind)


def wrappers(pages: DataFrame, html: str = "html", url: str = "url", fan_in: int = 64, names: bool = True) -> DataFrame:
    """(host, tree, pages, stats): a wrapper a host, from all its pages.

    Equal trees are counted, and each different one merged once: first among those of its hash, then by host. Blocks
    are counted by host, node and hash; a block on SHARE of the pages that have its node, and on LEAST_PAGES at
    least, is constant. Pages without a host share no wrapper. No task holds more of a host than its different trees, and its wrapper."""
    rows = pages.select(_host(F.col(url)).alias("host"), clean_text(html).alias("html")).filter("host <> ''")
    rows = rows.mapInArrow(_lined(names), "host string, shape long, tree string, node array<int>, hash array<long>, mass array<int>")
    lined = staged(rows, "pages")
    shapes = staged(lined.groupBy("host", "shape").agg(F.first("tree").alias("tree"), F.count(F.lit(1)).alias("pages")), "shapes")
    kind = "host string, shape long, tree string, pages long"
    some = shapes.withColumn("slot", F.pmod("shape", F.lit(fan_in))).groupBy("host", "slot").applyInArrow(_merged, kind)
    whole = staged(some.groupBy("host").applyInArrow(_merged, kind).select("host", F.col("tree").alias("whole"), F.col("pages").alias("all")), "wrappers")
    several = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    placed = _beside(shapes.select("host", "shape", "tree"), whole.select("host", "whole").join(several, "host"), "n", _placed, "host string, shape long, to array<int>")
    placed = staged(placed, "placed")
    on = shapes.select("host", "shape", "pages").join(placed, ["host", "shape"]).select("host", "pages", F.explode(F.array_distinct("to")).alias("node"))
    on = on.groupBy("host", "node").agg(F.sum("pages").alias("on"))
    at = lambda x: F.element_at("to", x["node"] + 1)
    blocks = F.transform(F.arrays_zip("node", "hash", "mass"), lambda x: F.struct(at(x).alias("node"), x["hash"].alias("hash"), x["mass"].alias("mass")))
    each = lined.select("host", "shape", "node", "hash", "mass").join(placed, ["host", "shape"]).select("host", F.inline(F.array_distinct(blocks)))
    each = staged(each.groupBy("host", "node", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass")), "blocks")
    at = ["host", "node"]
    each = spread_join(each, each.groupBy(*at).agg(F.count(F.lit(1)).alias("c")).join(on, at), at, "c", each.count())
    fixed = F.col("n") >= F.greatest(F.lit(float(LEAST_PAGES)), F.lit(SHARE) * F.col("on"))
    stats = each.groupBy("host", "node").agg(
        F.sum("mass").alias("mass"), F.coalesce(F.sum(F.when(fixed, F.col("mass"))), F.lit(0)).alias("fixed"), F.array_sort(F.collect_list(F.when(fixed, F.col("hash")))).alias("constants")
    )
    stats = stats.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "mass", "fixed", "constants"))).alias("stats"))
    return whole.join(stats, "host", "left").select("host", F.col("whole").alias("tree"), F.col("all").alias("pages"), "stats")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id", broadcast_bytes: int = 32 << 20, names: bool = True) -> DataFrame:
    """One row for each row of pages: page_id, url, text (empty if none), n_chars.

    Null html is empty; pages without a host, a null url among them, are decided each by itself. Repeated rows each count as a page. An empty
    table gives none. Wrappers are broadcast up to broadcast_bytes in all; beyond, pages are dealt into groups of a host, each beside one copy. names: whether
    the names of containers count beside their masses."""
    spark = pages.sparkSession
    found = staged(wrappers(pages, html, url, names=names), "templates")
    size = found.agg(F.sum(F.length("tree") + 40 * F.size("stats") + 8 * F.aggregate("stats", F.lit(0), lambda n, x: n + F.size(x["constants"])))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(F.col(url)).alias("host"))
    shape = dict(pages.dtypes)
    out = f"page_id {shape[id_col]}, url {shape[url]}, text string, n_chars long"
    plain = lambda r: (r["tree"], r["pages"], [(x["node"], x["mass"], x["fixed"], x["constants"]) for x in r["stats"] or ()])

    def texts(pages, wrapper):
        import pyarrow as pa

        found = [extract(page.as_py(), w, names) for page, w in zip(pages.column("html"), wrapper)]
        return [pages.column("page_id"), pages.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]

    columns = ["page_id", "url", "text", "n_chars"]
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r.host: plain(r) for r in found.collect()})

        def run(batches):
            import pyarrow as pa

            known: dict = {}
            for batch in batches:
                of = []
                for host in batch.column("host").to_pylist():
                    if host not in known:
                        if len(known) >= 256:
                            known.clear()
                        mine = held.value.get(host)
                        known[host] = mine and Wrapper(*mine, names)
                    of.append(known[host])
                yield pa.RecordBatch.from_arrays(texts(batch, of), columns)

        return rows.mapInArrow(run, out)

    def group(pages, whole):
        import itertools

        import pyarrow as pa

        own = Wrapper(*plain(whole.to_pylist()[0]), names)
        return pa.Table.from_arrays(texts(pages, itertools.repeat(own)), columns)

    def alone(batches):
        import itertools

        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(texts(batch, itertools.repeat(None)), columns)

    # Every page with a host counts for its wrapper, so pages without one are those without a host.
    return _beside(rows.filter("host <> ''"), found, "pages", group, out).unionByName(rows.filter("host = ''").mapInArrow(alone, out))
