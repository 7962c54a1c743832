"""Small trees out of XML and HTML, without recursion, so that depth is no risk."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

from pagecrest.functions.text import PY_WS

_RUN = re.compile(f"[{PY_WS}]+")
_DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*(?:\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]\s*)?>", re.S)
_ENTITY = re.compile(r"(<!\[CDATA\[.*?\]\]>)|&(?!(?:amp|lt|gt|quot|apos);|#\d+;|#x[0-9a-fA-F]+;)", re.S)


def normalize(text: str) -> str:
    return _RUN.sub(" ", text).strip(" ")


class Node:
    """Element with attributes and children, which are nodes or strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def local(self) -> str:
        return self.tag.rpartition(":")[2]

    def elements(self, *local: str) -> Iterator[Node]:
        """Child elements, of the given local names if any."""
        return (c for c in self.children if isinstance(c, Node) and (not local or c.local in local))

    def first(self, local: str) -> Node | None:
        return next(self.elements(local), None)

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)

    def attribute(self, local: str) -> str | None:
        """The first attribute with this local name, whatever its prefix."""
        return next((v for k, v in self.attrs.items() if k.rpartition(":")[2] == local), None)


def tidy_xml(text: str) -> str:
    """XML without its document type, entities beyond the five built-in ones as plain text: nothing
    that a document declares is expanded."""
    return _ENTITY.sub(lambda m: m[1] or "&amp;", _DOCTYPE.sub("", text, count=1))


class XmlTree:
    """Tree of a document; raises expat's error where it is not well formed."""

    def __init__(self):
        self.root: Node | None = None
        self.at: Node | None = None

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.at)
        if self.at is None:
            self.root = node
        else:
            self.at.children.append(node)
        self.at = node

    def end(self, tag: str) -> None:
        self.at = self.at.parent

    def data(self, text: str) -> None:
        if self.at is not None:
            self.at.children.append(text)


def run_expat(text: str, start: Callable, end: Callable, data: Callable) -> None:
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    text = re.sub(r"\A\s*<\?xml.*?\?>", "", tidy_xml(text), count=1, flags=re.S)
    parser.Parse(text.encode("utf-8", "surrogatepass"), True)


def parse_xml(text: str) -> Node:
    tree = XmlTree()
    run_expat(text, tree.start, tree.end, tree.data)
    if tree.root is None:
        raise expat.ExpatError("no root element")
    return tree.root


#: Fixed values of HTML: elements without content, and start tags that end an open element.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
TABLE_FRAME = {"table", "tbody", "thead", "tfoot", "tr"}
TABLE_TAGS = TABLE_FRAME | {"td", "th", "caption", "colgroup", "body", "html"}
IN_TABLE = TABLE_TAGS | {"col", "script", "style", "template", "form", "input"}
BOXES = CLOSES_P | HEADINGS | TABLE_TAGS | set("button object select template noscript iframe textarea title script style".split())
HEAD_ONLY = {"title", "meta", "link", "base", "style", "script", "head"}
_COMMENT = re.compile("<!--.*?-->", re.S)
_NAMELESS = re.compile("<(?!/?[A-Za-z])(?:[^<>]*(>))?")
SELF_CLOSING = re.compile(r"""<(title|script|style|textarea)(\s(?:[^<>"']|"[^"]*"|'[^']*')*)?/>""")


def expand_self_closing(html: str) -> str:
    """`<title/>` and its like as a pair of tags, as XHTML means them."""
    return SELF_CLOSING.sub(lambda m: f"<{m[1]}{m[2] or ''}></{m[1]}>", html)


def keep_references(html: str, known: Collection[str]) -> str:
    """HTML in which only references of known names that a semicolon ends are such, and all others plain
    text. HTML itself reads numbers, 2,231 names, `&amp` and the beginning of `&ampx;` too."""
    return re.sub(f"&(?!(?:{'|'.join(known)});)", "&amp;", html)


def drop_nameless(html: str) -> str:
    """HTML without comments and what else stands in angle brackets without a name, and any other `<`
    before no name as plain text. HTML itself reads `<3 >` as text and `<!-->` as a comment, which the
    parser takes for text; after a `<!--` that nothing ends, it shows the next tag."""
    closed = html.rfind("-->") + 3 if "-->" in html else 0
    return _NAMELESS.sub(lambda m: "" if m[1] else "&lt;", _COMMENT.sub("", html[:closed]) + html[closed:])


class HtmlTree(HTMLParser):
    """Tolerant tree of an HTML body: implied ends of paragraphs, items, rows and cells; tags that
    nothing closes stay open to their parent's end; what may not stand in a table goes before it. The
    end of an inline element inside a box that it was opened outside of leaves the box open. A node's
    parent is the element that was open around it."""

    RAW = ("script", "style", "textarea", "title")

    def __init__(self):
        # Whole stretches of text with their references read: by single events of references, the
        # parser does not tell whether a semicolon ended them, and gives up markup after "&#".
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.body = Node("body", {}, self.root)
        self.root.children.append(self.body)
        self.at, self.in_head, self.raw = self.body, False, None
        self.holders: dict[Node, Node] = {}  # of what went before a table

    def _close(self, tags: set[str], fence: set[str]) -> None:
        """Ends the innermost open element of `tags`, not looking past `fence`."""
        node, last = self.at, None
        while node is not self.body and node.tag not in fence:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list, empty: bool = False) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}
        given = {k: given[k] for k, _ in attrs}
        if tag == "html":
            return
        if tag == "body":
            self.in_head = False
            for k, v in given.items():
                self.body.attrs.setdefault(k, v)
            return
        if tag == "head":
            self.in_head = True
            return
        if self.in_head and tag not in HEAD_ONLY:
            self.in_head = False
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self.at = self.at.parent
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", {})
        if tag in ("td", "th"):
            if self.at.tag == "table":
                self._open("tbody", {})
            if self.at.tag in ("tbody", "thead", "tfoot"):
                self._open("tr", {})
        node = self._open("img" if tag == "image" and not self._inside("svg") else tag, given, self.at.tag in TABLE_FRAME and tag not in IN_TABLE)
        if tag in VOID or (empty and self._inside("svg", "math")):
            self.at = node.parent

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # In HTML the slash means nothing, but for foreign content.
        self.handle_starttag(tag, attrs, empty=True)

    def _inside(self, *tags: str) -> bool:
        node = self.at
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def _open(self, tag: str, attrs: dict[str, str], outside: bool = False) -> Node:
        node = Node(tag, attrs, self.at)
        if self.in_head:
            node.tag = "head"  # nothing in the head is content
        self._put(node, outside)
        self.at = node
        return node

    def _put(self, child: Node | str, outside: bool) -> None:
        """Adds a child to the open element, or before the table that this is a part of."""
        if not outside:
            self.at.children.append(child)
            return
        table = self.at
        while table.tag != "table" and table.parent is not None:
            table = table.parent
        holder = self.holders.get(table, table.parent) or self.body
        at = next((k for k, c in enumerate(holder.children) if c is table), len(holder.children))
        holder.children.insert(at, child)
        if isinstance(child, Node):
            self.holders[child] = holder

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
            while self.at is not self.body:
                self.at = self.at.parent
            return
        if tag == "p" and not self._inside("p"):
            self._open("p", {})
        node = self.at
        wanted = {"head"} if self.in_head else HEADINGS if tag in HEADINGS else {tag}
        while node is not self.body:
            if node.tag in wanted:
                self.at = node.parent
                return
            if node.tag in ("td", "th", "caption", "table") and tag not in TABLE_TAGS:
                return
            if tag not in BOXES and node.tag in BOXES:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        if not self.in_head or self.at.tag == "head":
            self._put(data, self.at.tag in TABLE_FRAME and bool(data.strip()))
        elif data.strip():
            self.in_head = False
            self.at.children.append(data)


def parse_html(html: str, known: Collection[str] | None = None) -> Node:
    """The body of a document. With `known`, only references of these names that a semicolon ends are read,
    and what stands in angle brackets without a name is left out."""
    tree = HtmlTree()
    tree.feed(expand_self_closing(html if known is None else drop_nameless(keep_references(html, known))))
    tree.close()
    return tree.body
