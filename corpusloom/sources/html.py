"""HTML as Markdown: a tree of elements with the end tags that HTML lets authors leave out, then a printer of its blocks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements without contents, those that are passed over with all they hold, and those whose text runs on in a line: fixed values.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style nav footer noscript head template".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br button output select option".split())
#: What an element that opens ends, if it is open, up to the elements that keep it in: fixed values.
CELL, LISTED = frozenset(("td", "th", "table", "caption")), frozenset(("ul", "ol", "menu"))
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), LISTED | CELL), "dt": (frozenset(("dt", "dd")), frozenset(("dl",)) | CELL), "dd": (frozenset(("dt", "dd")), frozenset(("dl",)) | CELL),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    **{t: (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))) for t in ("thead", "tbody", "tfoot")}, "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Deeper elements are taken as part of the one at this depth.
DEEPEST = 150
_BLANK = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open, self.lost = [self.root], 0

    def _end(self, tags: frozenset[str], keepers: frozenset[str]) -> None:
        """Ends the innermost open element of these tags, and all within, unless one that keeps it in stands between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                k = len(self.open)
                if not any(n.tag in tags for n in self.open[1:]) or tags == frozenset(("li",)):
                    return
                return self._end(tags, keepers)
            if self.open[k].tag in keepers:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "main", "article", "body"):  # menus and the like that were left open end here
            for k, n in enumerate(self.open):
                if n.tag in SKIPPED:
                    del self.open[k:]
                    break
        if tag in ("html", "body"):
            return
        if tag not in INLINE:
            self._end(frozenset(("p",)), CELL | LISTED | frozenset(("blockquote", "li", "div", "section", "article", "main", "button")))
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._end(frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), CELL | LISTED | frozenset(("div", "section", "article", "main", "blockquote")))
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in EMPTY:
            if len(self.open) > DEEPEST:
                self.lost += 1
            else:
                self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in EMPTY or tag in ("html", "body"):
            return
        if self.lost and not any(n.tag == tag for n in self.open[-3:]):
            self.lost -= 1
            return
        keepers = frozenset() if tag in ("table", *SKIPPED) else frozenset(("table",)) if tag in CELL or tag in ("tr", "thead", "tbody", "tfoot") else CELL
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in keepers:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _one_line(text: str) -> str:
    return " ".join(text.split())


class _Printer:
    def __init__(self, image: Callable[[str], str]):
        self.image = image

    def inline(self, nodes: list[Node | str]) -> str:
        """Text that runs on; `\\n` is a line break that the page asks for."""
        return "".join(_BLANK.sub(" ", n) if isinstance(n, str) else self._inline(n) for n in nodes)

    def _inline(self, n: Node) -> str:
        if n.tag in SKIPPED:
            return ""
        if n.tag == "br":
            return "\n"
        if n.tag == "img":
            return f" ![{_one_line(n.attrs.get('alt', ''))}]({self.image(n.attrs.get('src', ''))}) "
        inner = self.inline(n.children)
        if n.tag not in INLINE:  # a block within a line
            return f" {inner} "
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}.get(n.tag, "")
        text = inner.strip()
        if not text:
            return inner
        if n.tag in ("code", "kbd", "samp", "tt"):
            ticks = "`" * (max((len(x) for x in re.findall("`+", text)), default=0) + 1)
            pad = " " if text[0] == "`" or text[-1] == "`" else ""
            done = f"{ticks}{pad}{text}{pad}{ticks}"
        elif n.tag == "a" and n.attrs.get("href"):
            done = f"[{_one_line(text)}]({n.attrs['href']})"
        else:
            done = f"{mark}{text}{mark}"
        return inner[: len(inner) - len(inner.lstrip())] + done + inner[len(inner.rstrip()) :]

    @staticmethod
    def _paragraph(text: str) -> str:
        return "\n".join(line for line in (_one_line(x) for x in text.split("\n")) if line)

    def blocks(self, nodes: list[Node | str]) -> list[str]:
        out: list[str] = []
        line: list[Node | str] = []

        def flush():
            text = self._paragraph(self.inline(line))
            if text:
                out.append(text)
            line.clear()

        for n in nodes:
            if isinstance(n, str) or (n.tag in INLINE and not self._holds_block(n)):
                line.append(n)
            elif n.tag not in SKIPPED:
                flush()
                out += self._block(n)
        flush()
        return out

    def _holds_block(self, n: Node) -> bool:
        todo = list(n.children)
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                if c.tag not in INLINE and c.tag not in SKIPPED:
                    return True
                todo += c.children
        return False

    def _block(self, n: Node) -> list[str]:
        if re.fullmatch("h[1-6]", n.tag):
            text = _one_line(self.inline(n.children))
            return [f"{'#' * int(n.tag[1])} {text}"] if text else []
        if n.tag == "hr":
            return ["---"]
        if n.tag in LISTED:
            return self._list(n)
        if n.tag == "blockquote":
            text = "\n\n".join(self.blocks(n.children))
            return ["\n".join(f"> {x}".rstrip() for x in text.split("\n"))] if text else []
        if n.tag == "pre":
            return self._pre(n)
        if n.tag == "table":
            return self._table(n)
        if n.tag == "dt":
            return [self._paragraph(self.inline(n.children))] if self.inline(n.children).strip() else []
        if n.tag == "dd":
            text = "\n\n".join(self.blocks(n.children))
            return [":   " + text.replace("\n", "\n    ")] if text else []
        return self.blocks(n.children)

    def _list(self, n: Node) -> list[str]:
        number = int(n.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", n.attrs.get("start", "")) else 1
        out = []
        for c in n.children:
            if isinstance(c, str):
                if not c.strip():
                    continue
                c = Node("li", {}, [c])
            if c.tag in SKIPPED:
                continue
            parts, text = self._parts([c] if c.tag in LISTED else c.children), ""
            for listed, part in parts:
                text += part if not text else f"\n{part}" if listed else f"\n\n{part}"
            if not text:
                continue
            if c.tag in LISTED:  # a list that stands in a list without an item of its own
                out.append("  " + text.replace("\n", "\n  "))
                continue
            head = f"{number}. " if n.tag == "ol" else "- "
            number += 1
            out.append(head + re.sub(r"\n(?=[^\n])", "\n" + " " * len(head), text))
        return ["\n".join(out)] if out else []

    def _parts(self, nodes: list[Node | str]) -> list[tuple[bool, str]]:
        """The blocks of a list item; which are lists."""
        found: list[tuple[bool, str]] = []
        run: list[Node | str] = []
        for n in [*nodes, None]:
            if n is None or (isinstance(n, Node) and n.tag in LISTED):
                found += [(False, x) for x in self.blocks(run)]
                run = []
                if n is not None:
                    found += [(True, x) for x in self._list(n)]
            else:
                run.append(n)
        return found

    def _pre(self, n: Node) -> list[str]:
        def text(x: Node | str) -> str:
            return x if isinstance(x, str) else "\n" if x.tag == "br" else "".join(map(text, x.children))

        whole = text(n).removeprefix("\n").rstrip()
        if not whole.strip():
            return []
        inner = next((c for c in n.children if isinstance(c, Node) and c.tag == "code"), n)
        kinds = [k.removeprefix("language-") for k in inner.attrs.get("class", "").split() if k.startswith("language-")]
        fence = "`" * max(3, max((len(x) for x in re.findall("`+", whole)), default=0) + 1)
        return [f"{fence}{kinds[0] if kinds else ''}\n{whole}\n{fence}"]

    def _table(self, n: Node) -> list[str]:
        rows, captions, headed = [], [], []
        todo = deque(n.children)
        while todo:
            c = todo.popleft()
            if isinstance(c, str):
                continue
            if c.tag == "caption":
                captions += self.blocks(c.children)
            elif c.tag in ("thead", "tbody", "tfoot"):
                head = {"head": "1"} if c.tag == "thead" else {}
                todo.extendleft(Node("tr", head, r.children) if isinstance(r, Node) and r.tag == "tr" else r for r in reversed(c.children))
            elif c.tag == "tr":
                cells = [x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
                if cells:
                    row = []
                    for x in cells:
                        span = x.attrs.get("colspan", "")
                        row += [_one_line(self.inline(x.children)).replace("|", "\\|")] + [""] * ((min(int(span), 1000) - 1) if span.isdigit() and int(span) > 1 else 0)
                    rows.append(row)
                    headed.append("head" in c.attrs or all(x.tag == "th" for x in cells))
        if not rows:
            return captions
        wide = max(map(len, rows))
        if not headed[0]:  # Markdown has no table without a head
            rows.insert(0, [])
        rows = [r + [""] * (wide - len(r)) for r in rows]
        rows.insert(1, ["---"] * wide)
        return [*captions, "\n".join("| " + " | ".join(r) + " |" for r in rows)]


def html_text(source: str, image: Callable[[str], str] = str) -> str:
    """The Markdown of a page: headings, paragraphs, lists in lists, numbers, quotes, tables with a rule line, fenced code, emphasis, links
    and images. `image` gives the address that stands for an image's own."""
    tree = _Tree()
    tree.feed(source)
    tree.close()
    return "\n\n".join(_Printer(image).blocks(tree.root.children))
