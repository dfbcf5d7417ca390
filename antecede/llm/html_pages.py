"""The block structure of a page: elements and runs of text, for wrappers to be inferred from.

Used inside tasks, a page at a time. The tree is what a browser would build as far as text is
concerned: end tags that are implied are put in, inline markup is part of its run of text, and what
is never shown or never part of an article is a leaf without content.
"""

import html
import re
from dataclasses import dataclass, field

# Element names and words of class names, by what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea xmp iframe noembed noframes".split()
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body caption html legend summary tbody td tfoot th thead tr".split())
#: Elements of which a new one ends one that is open, up to the element that holds them.
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
            "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {k: (set(a.split()), set(b.split())) for k, (a, b) in SIBLINGS.items()}
UNSHOWN = set(
    "audio button canvas datalist dialog embed head iframe input math menu nav noembed noframes noscript object "
    "option script search select style svg template textarea title video xmp footer aside".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BESIDE = set(
    "ad ads adslot alert advert advertisement adverts advertising aside banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disclaimer discussion disqus feedback footer gdpr login masthead menu menus modal "
    "nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted "
    "promotion recommendations recommended related replies respond responses search share sharing sidebar signup skip social "
    "sponsor sponsored sponsors subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
NOT_BESIDE = set("has layout no page with without".split())
CONTENT = set("article articlebody body content entry main post story text".split())
COMMENT_HEADINGS = re.compile(r"(\d+\s+)?(reader\s+)?(comments?|kommentare?|commentaires?|comentarios?)\b\W*\d*\W*", re.I)

#: Deeper elements are part of the one at this depth.
DEPTH = 60
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Text:
    """A run of text in a block, its references decoded; ``linked`` counts its characters in links."""

    text: str
    linked: int = 0


@dataclass(slots=True)
class Element:
    """``key`` tells elements apart: name, ``!`` beside the article or its rank as container, and classes."""

    name: str
    key: str
    rank: int = 0
    hidden: bool = False
    inner: bool = False
    children: list = field(default_factory=list)


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value)}


def _element(name: str, attributes: str, inside: bool) -> Element:
    """``inside``: within an article or main part, whose own header is not that of the page."""
    found = {}
    if attributes and not attributes.isspace():
        for k, v in _ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    classes = found.get("class", "")
    words = _words(f"{classes} {found.get('id', '')}") if found else set()
    role = found.get("role", "").lower()
    hidden = name in UNSHOWN or role in ROLES or "hidden" in found or bool(_UNSEEN.search(found.get("style", "")))
    hidden = hidden or bool(words & BESIDE) and not words & NOT_BESIDE and name != "body"
    if (name == "header" or "header" in words) and not inside and not words & CONTENT:
        hidden = True
    rank = 0
    if not hidden:
        prop = found.get("itemprop", "").lower()
        if name == "article" or prop == "articlebody" or role == "article":
            rank = 1
        elif name == "main" or role == "main":
            rank = 2
        elif name in ("div", "section", "td") and words & CONTENT and "header" not in words:
            rank = 3
    mark = "!" if hidden else str(rank or "")
    normal = re.sub(r"\d+", "0", " ".join(sorted(set(classes.split()))))[:80]
    return Element(name, f"{name}{mark}.{normal}" if normal else name + mark, rank, hidden, inside or rank in (1, 2))


def parse(page: str) -> Element:
    """The tree of a page. What is cut off inside a tag, a comment or a script ends the page."""
    root = Element("html", "html")
    stack, run, linked, link = [root], [], 0, 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(html.unescape("".join(run)).split())
        if text and not stack[-1].hidden:
            stack[-1].children.append(Text(text, min(linked, len(text))))
        run, linked = [], 0

    def close(names: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                flush()
                del stack[i:]
                return
            if stack[i].name in until:
                return

    while at < end:
        begin = page.find("<", at)
        if begin != at:
            piece = page[at:] if begin < 0 else page[at:begin]
            run.append(piece)
            linked += len(piece) if link else 0
            if begin < 0:
                break
        follows = page[begin + 1 : begin + 2]
        if follows == "!" or follows == "?":
            comment = page.startswith("<!--", begin)
            stop = page.find("-->" if comment else ">", begin + (2 if comment else 1))
            if stop < 0:
                break
            at = stop + (3 if comment else 1)
            continue
        if not (follows.isascii() and follows.isalpha()) and not re.match(r"</[a-zA-Z]", page[begin : begin + 3]):
            run.append("<")
            at = begin + 1
            continue
        tag = _TAG.match(page, begin)
        if tag is None:
            break
        at, closing, name = tag.end(), tag[1], tag[2].lower()
        if closing:
            if name == "a":
                link = max(0, link - 1)
            elif name in BLOCK or any(e.name == name for e in stack[1:]):
                flush()
                close({name}, set("td th table".split()) - {name} if name != "table" else set())
            continue
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            if stop is None:
                break
            closed = page.find(">", stop.end())
            at = end if closed < 0 else closed + 1
            continue
        if name in ("br", "hr"):
            run.append(" ")
        if name in CLOSES_P:
            close({"p"}, set("td th table button object".split()))
        if name in SIBLINGS:
            close(*SIBLINGS[name])
        if name == "a":
            link += 1
        if name in VOID or name == "html" or name == "body" and len(stack) == 1:
            continue
        if name == "head" or stack[-1].hidden and name not in BLOCK and name not in UNSHOWN:
            own = Element(name, name, hidden=name == "head")
            if name != "head":
                continue
        else:
            own = _element(name, tag[3], stack[-1].inner)
        if tag[3].endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK or own.hidden:
            flush()
            if name == "body" or stack[-1].name == "head":
                close({"head"}, set())
            if len(stack) <= DEPTH or own.hidden:
                if not stack[-1].hidden:
                    stack[-1].children.append(own)
                own.hidden = own.hidden or stack[-1].hidden
                stack.append(own)
    flush()
    _settle(root)
    return root


def _settle(element: Element) -> bool:
    """Leaves out forms, unless they hold a container of the article, and comments; whether one is inside."""
    holds = False
    for c in element.children:
        if isinstance(c, Element) and not c.hidden:
            own = _settle(c)
            holds |= own
            if c.name == "form" and not own or is_comment_section(c):
                c.hidden, c.children, c.key, c.rank = True, [], c.name + "!", 0
    return holds or element.rank > 0


def is_comment_section(element: Element) -> bool:
    """Whether a part of the page begins with a heading such as ``3 comments``."""
    first = next((c for c in element.children if isinstance(c, Element)), None)
    if first is None or first.name not in ("h2", "h3", "h4", "h5", "h6"):
        return False
    text = " ".join(c.text for c in first.children if isinstance(c, Text))
    return bool(COMMENT_HEADINGS.fullmatch(text))
