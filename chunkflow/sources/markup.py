"""Trees of HTML, XHTML and FB2 documents, and their text as markdown (one document at a time)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import count
from textwrap import indent

from ..functions.text import CJK_LANGS, CYRILLIC_LANGS, LATIN_LANGS

VOID = {"br", "hr", "img", "image", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "empty-line"}
#: What an opening tag ends if it is still open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
ENDS |= {b: {"p"} for b in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "section", "article", "header", "footer", "main", "nav", "figure")}
#: Elements laid out as blocks (fixed list).
BLOCKS = set("p div section article header main figure body blockquote ul ol li table tr h1 h2 h3 h4 h5 h6 hr pre title subtitle epigraph poem stanza cite empty-line v text-author".split())
HEADS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### ", "title": "# ", "subtitle": "### "}
ENCODINGS = {"cp1251": "windows-1251", "win-1251": "windows-1251", "utf8": "utf-8"}


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)


class Builder(HTMLParser):
    """A lenient tree: open paragraphs end where a block begins, stray end tags are dropped."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        name = tag.rpartition(":")[2]
        while len(self.open) > 1 and self.open[-1].name in ENDS.get(name, ()):
            self.open.pop()
        node = Node(name, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if name not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if len(self.open) > depth or (self.open[-1].name == tag.rpartition(":")[2] and tag not in VOID):
            self.open.pop()

    def handle_endtag(self, tag):
        name = tag.rpartition(":")[2]
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def parse(markup: str) -> Node:
    """The tree of a document; script and style bodies are left out."""
    builder = Builder()
    builder.feed(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<(?:link|script|style)\b[^>]*/?>", "", markup))
    builder.close()
    return builder.root


def decode_xml(content: bytes) -> str:
    """Text of an XML document: byte-order mark, then declaration; if over 2 % comes out
    unreadable, the cleanest of four common encodings."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    said = re.search(rb"""(?i)encoding\s*=\s*["']([^"']+)["']""", content[:256].replace(b"\0", b""))
    name = said[1].decode("latin-1").strip().lower() if said else "utf-8"

    def read(encoding):
        try:
            text = content.decode(ENCODINGS.get(encoding, encoding), "replace")
        except LookupError:
            return None
        return text.count("�") / max(1, len(text)), text

    first = read(name) or read("utf-8")
    if first[0] <= 0.02:
        return first[1]
    others = [x for e in ("windows-1251", "iso-8859-1", "koi8-r", "utf-8") if e != name and (x := read(e))]
    return min([first, *others], key=lambda x: x[0])[1]


def _script(lang: str) -> str:
    return "cyrillic" if lang in CYRILLIC_LANGS else "cjk" if lang in CJK_LANGS else "latin" if lang in LATIN_LANGS else "other"


_LETTERS = {"cyrillic": re.compile("[Ѐ-ӿ]"), "latin": re.compile("[A-Za-z]"), "cjk": re.compile("[぀-ヿ㐀-鿿]")}


def _mostly(text: str, script: str) -> bool:
    n = {k: len(p.findall(text)) for k, p in _LETTERS.items()}
    total = sum(n.values())
    return total >= 8 and n.get(script, 0) / total > 0.7


class Part:
    """What an element gives to the one around it: its layout as a block, in a line, and pieces for some."""

    __slots__ = ("attrs", "block", "items", "kids", "line", "name", "rows", "text")

    def __init__(self, node: Node, kids: list[Part | str]):
        self.name, self.attrs, self.kids = node.name, node.attrs, kids
        self.block = self.line = self.items = ""
        own = [] if self.name != "tr" else [[k.inside for k in kids if isinstance(k, Part) and k.name in ("td", "th")]]
        self.rows = own + [row for k in kids if isinstance(k, Part) for row in k.rows]
        self.text = "".join(k if isinstance(k, str) else k.text for k in kids)

    @property
    def has_block(self) -> bool:
        return any(isinstance(k, Part) and k.name in BLOCKS for k in self.kids)

    @property
    def inside(self) -> str:
        """The contents as a line."""
        line = "".join(k if isinstance(k, str) else k.line for k in self.kids)
        return re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", line)).strip()

    @property
    def blocks(self) -> str:
        """The contents as blocks; loose text is a block."""
        return "".join(k.block if isinstance(k, Part) else _block(" ".join(k.split())) for k in self.kids)

    @property
    def laid_out(self) -> str:
        return self.blocks if self.has_block else _block(self.inside)


def _block(text: str) -> str:
    return text and f"{text}\n\n"


def _quote(p: Part) -> str:
    inner = p.laid_out.strip()
    return re.sub("(?m)^(.+)$|^$", lambda m: f"> {m[1]}" if m[1] else ">", inner) * bool(inner) + "\n\n"


def _list(p: Part) -> str:
    """An item a line; what else stands in a list comes as it is, a list in it two spaces in."""
    numbers, lines = count(1), []
    for k in (k for k in p.kids if isinstance(k, Part)):
        if k.name == "li":
            mark = f"{next(numbers)}. " if p.name == "ol" else "- "
            lines.append(mark + (k.blocks.strip() if k.has_block else k.inside).replace("\n", "\n  "))
        elif k.name in LISTS:
            lines += [indent(k.items.rstrip(), "  ", lambda _: True)] if k.items.rstrip() else []
        elif k.block.strip():
            lines.append(k.block.strip().replace("\n", "\n  "))
    return "\n".join(lines) + "\n"


def _table(p: Part) -> str:
    cells = [[re.sub(r"\s*\n\s*", " ", c.replace("|", "\\|")).strip() for c in row] for row in p.rows]
    cells[1:1] = [["---"] * len(cells[0])] if cells else []
    return "\n".join(f"| {' | '.join(row)} |" for row in cells) if cells else p.inside


#: How elements are laid out as blocks; others are what is in them.
AS_BLOCK: dict[str, Callable[[Part], str]] = {h: (lambda p, mark=mark: f"{mark}{p.inside}\n\n") for h, mark in HEADS.items()}
AS_BLOCK |= dict.fromkeys(("blockquote", "epigraph", "cite"), _quote) | {
    "p": lambda p: f"{p.inside}\n\n",
    "li": lambda p: f"- {p.inside}\n",
    "v": lambda p: f"{p.inside}\n",
    "text-author": lambda p: f"*{p.inside}*\n\n",
    "pre": lambda p: f"```\n{p.text.removesuffix(chr(10))}\n```\n\n",
    "table": lambda p: _table(p) + "\n\n",
    "hr": lambda p: "---\n\n",
    "br": lambda p: "\n",
    "empty-line": lambda p: "\n",
}
#: What stands around an element's contents in a line.
IN_LINE = {"em": "*", "i": "*", "emphasis": "*", "strong": "**", "b": "**", "code": "`"}
LISTS, PICTURES = ("ul", "ol"), ("img", "image")


class Markdown:
    """Writes a tree as markdown. href resolves references; langs = (source, target) drops
    blocks that are in the target language already, unless nothing would be left.

    Elements are finished from the leaves up, without recursion.
    """

    def __init__(self, href: Callable[[str], str] | None = None, image: Callable[[str], str | None] | None = None, langs: tuple[str, str] | None = None):
        self.href, self.image = href or (lambda x: x), image or (lambda _: None)
        self.langs = tuple(re.split("[-_]", x.strip().lower())[0] for x in langs) if langs else None

    def write(self, root: Node) -> str:
        out = re.sub(r"\n{3,}", "\n\n", self.finish(root).laid_out).strip() + ("\n" if root.children else "")
        if self.langs and not out.strip():
            return Markdown(self.href, self.image).write(root)
        return out

    def finish(self, root: Node) -> Part:
        """The part of the root, once all below it are finished."""
        done: list[Part | str] = []
        todo: list[tuple[Node | str, bool]] = [(root, False)]
        while todo:
            node, opened = todo.pop()
            if isinstance(node, str):
                done.append(node)
            elif not opened:
                todo.append((node, True))
                todo += [(c, False) for c in reversed(node.children)]
            else:
                first = len(done) - len(node.children)
                done[first:] = [self.rendered(Part(node, done[first:]))]
        return done[0]

    def rendered(self, p: Part) -> Part:
        if p.name in LISTS:
            p.items = _list(p)
        if self.foreign(p):
            return p
        p.line = self.in_line(p)
        if not self.translated(p):
            p.block = p.items + "\n" if p.name in LISTS else p.line + "\n\n" if p.name in PICTURES else AS_BLOCK.get(p.name, lambda p: p.laid_out)(p)
        return p

    def in_line(self, p: Part) -> str:
        if p.name in PICTURES:
            alt, src = p.attrs.get("alt") or p.attrs.get("title") or "", _first(p.attrs, "src", "l:href", "xlink:href", "href").removeprefix("#")
            full = self.href(src)
            return f"![{alt}]({self.image(full) or self.image(src) or full})"
        if p.name == "br":
            return "  \n"
        mark, inside = IN_LINE.get(p.name, ""), p.inside
        if p.name != "a":
            return mark + inside + mark
        href = _first(p.attrs, "href", "l:href", "xlink:href")
        if href and not re.match("(?i)https?:|mailto:|data:|#", href):
            href = self.href(href)
        return f"[{inside or href}]({href})" if href else inside

    def foreign(self, p: Part) -> bool:
        """Marked as in the target language, when that isn't the source's."""
        own = re.split("[-_]", _first(p.attrs, "lang", "xml:lang").strip().lower())[0]
        return bool(self.langs and own and own == self.langs[1] != self.langs[0])

    def translated(self, p: Part) -> bool:
        """A block without blocks whose letters are the target language's and not the source's."""
        scripts = [_script(x) for x in self.langs or ()]
        if len(set(scripts)) < 2 or "other" in scripts or p.has_block:
            return False
        return _mostly(p.text, scripts[1]) and not _mostly(p.text, scripts[0])


def _first(attrs: dict[str, str], *names: str) -> str:
    return next((attrs[n] for n in names if attrs.get(n)), "")
