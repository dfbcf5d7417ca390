"""Wrappers: union-free regular expressions of a site's pages, and the article text they tell.

A wrapper is a sequence of items: elements with a sequence of their own, text slots, and groups. An
item may be optional or repeated; a text slot keeps what it says as long as all pages say the
same. A page is a wrapper of itself, and two wrappers are merged by aligning their sequences:
where they agree, items are merged in place; where they do not, neighbours alike become
repeated items, and what has no counterpart becomes optional. A sequence that grows beyond
``LIMIT`` items becomes one repeated group of optional items, so a wrapper's size is bounded by the
kinds of elements that the site has.

Used inside tasks: pages are folded into wrappers partition by partition, and wrappers of a host in
groups of a bounded number, over as many rounds as it takes.
"""

import json
import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.llm import words as W
from antecede.llm.html_pages import Element, Text, parse
from antecede.session import written

#: Items of a sequence, beyond which it becomes a repeated group.
LIMIT = 64
#: Neighbours as alike as this are taken for repetitions of one item.
ALIKE = 0.75
#: Text that is the same on all pages is the site's if there are so many pages and it is this part of
#: the text that differs, at most.
PAGES, SHARE = 8, 0.2
#: Without a marked article, the part that holds this share of the text is the article, and a list is
#: left out if this share of it is links.
HOLDS, LINKS = 0.7, 0.6
#: Wrappers of a host that are merged in one group, and items that a task holds before it hands them on.
GROUP, HELD = 32, 200_000
_HEADINGS = ("h1",)
_SECTIONS = ("article", "body", "center", "div", "form", "main", "section", "table", "tbody", "td", "tr")
_LISTS = ("dl", "div", "menu", "ol", "p", "section", "table", "ul")

# An item: k key ("#" a slot, "()" a group), n pages that have it, o optional, r repeated, c items inside;
# a slot: s characters, l of them in links, v the digest of its text or none where pages differ.
Item = dict


def digest(text: Text) -> str:
    return blake2b(text.text.encode("utf-8", "replace"), digest_size=6).hexdigest()


def items_of(element: Element) -> list[Item]:
    """The sequence of an element of a page, as a wrapper of that page."""
    out = []
    for c in element.children:
        if isinstance(c, Text):
            out.append({"k": "#", "n": 1, "o": 0, "r": 0, "c": [], "s": len(c.text), "l": c.linked, "v": digest(c)})
        else:
            out.append({"k": c.key, "n": 1, "o": 0, "r": 0, "c": [] if c.hidden else items_of(c)})
    return out


def _inside(item: Item, texts: bool) -> set:
    """The kinds of items in an item, and the texts that all pages have there."""
    kinds = {x["k"] for x in item["c"]}
    return kinds | {(x["v"],) for x in item["c"] if x.get("v")} if texts else kinds


def similarity(a: Item, b: Item, texts: bool = False) -> float:
    """0 for items of different kinds, else from one half to 1 by the kinds of items inside, and their ``texts``."""
    if a["k"] != b["k"]:
        return 0.0
    if texts and a.get("v") and a["v"] == b.get("v"):
        return 1.5
    one, two = _inside(a, texts), _inside(b, texts)
    return 0.5 + 0.5 * len(one & two) / len(one | two) if one or two else 1.0


def merge(a: Item, b: Item, again: bool = False) -> Item:
    """One item for both; ``again``: they are repetitions on the same pages."""
    out = {
        "k": a["k"],
        "n": max(a["n"], b["n"]) if again else a["n"] + b["n"],
        "o": a["o"] | b["o"],
        "r": 1 if again else a["r"] | b["r"],
        "c": _by_key(a["c"] + b["c"]) if a["k"] == "()" else merge_sequences(a["c"], b["c"], again),
    }
    if a["k"] == "#":
        out |= {"s": a["s"] + b["s"], "l": a["l"] + b["l"], "v": a["v"] if a["v"] == b["v"] and not again else None}
    return out


def _by_key(items: list[Item]) -> list[Item]:
    """The members of a group: one optional item for each kind."""
    found: dict[str, Item] = {}
    for x in items:
        for y in x["c"] if x["k"] == "()" else [x]:
            key = y["k"]
            found[key] = merge(found[key], y) if key in found else y
    if len(found) > LIMIT and any("." in k for k in found):  # by name alone, of which there are not that many
        return _by_key([x | {"k": x["k"].partition(".")[0] if "-" not in x["k"].partition(".")[0] else "x"} for x in found.values()])
    return [x | {"o": 1} for x in found.values()]


def _group(items: list[Item]) -> list[Item]:
    return [{"k": "()", "n": max(x["n"] for x in items), "o": 0, "r": 1, "c": _by_key(items)}]


def _folded(items: list[Item]) -> list[Item]:
    """Neighbours alike as one repeated item, and pairs of items that alternate as a repeated group."""
    out: list[Item] = []
    for x in items:
        if out and similarity(out[-1], x) >= ALIKE:
            out[-1] = merge(out[-1], x, again=True)
        else:
            out.append(x)
    i, again = 0, []
    while i < len(out):
        end = i + 2
        differ = end <= len(out) and out[i]["k"] != out[i + 1]["k"]
        while differ and end + 1 < len(out) and all(similarity(out[end + d], out[i + d]) >= ALIKE for d in (0, 1)):
            end += 2
        if end > i + 2:
            again += _group(out[i:end])
            i = end
        else:
            again.append(out[i])
            i += 1
    return again


def _aligned(a: list[Item], b: list[Item]) -> Iterator[tuple[Item | None, Item | None]]:
    """Pairs of items in the order of both, so that matched ones are as alike as can be; None has no counterpart."""
    alike = [[similarity(x, y, texts=True) for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            both = alike[i][j] + best[i + 1][j + 1] if alike[i][j] else -1.0
            best[i][j] = max(both, best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and alike[i][j] and best[i][j] == alike[i][j] + best[i + 1][j + 1]:
            yield a[i], b[j]
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i][j] == best[i + 1][j]):
            yield a[i], None
            i += 1
        else:
            yield None, b[j]
            j += 1


def merge_sequences(a: list[Item], b: list[Item], again: bool = False) -> list[Item]:
    if [x["k"] for x in a] == [x["k"] for x in b]:
        return [merge(x, y, again) for x, y in zip(a, b)]
    a, b = _folded(a), _folded(b)
    if [x["k"] for x in a] == [x["k"] for x in b]:
        return [merge(x, y, again) for x, y in zip(a, b)]
    if max(len(a), len(b)) > LIMIT:
        return _group(a + b)
    out = [merge(x, y, again) if x and y else (x or y) | {"o": 1} for x, y in _aligned(a, b)]
    return out if len(out) <= LIMIT else _group(out)


def wrapper_of(page: Element) -> Item:
    return {"k": "html", "n": 1, "o": 0, "r": 0, "c": items_of(page)}


def pack(wrapper: Item) -> bytes:
    return zlib.compress(json.dumps(wrapper, separators=(",", ":")).encode(), 1)


def unpack(data: bytes) -> Item:
    return json.loads(zlib.decompress(data))


def _size(item: Item) -> int:
    return 1 + sum(map(_size, item["c"]))


def judge(wrapper: Item) -> Item:
    """Marks in a wrapper what is the site's own text (``t``) and what the article is made of (``m``).

    ``m`` counts where a page has no element that is marked as its article: it is the innermost part with most of the
    text that differs from page to page, without lists of links, and the first headings around it.
    """
    def weigh(item: Item, once: bool) -> None:
        """w: characters outside links that are not on all pages; u: those that are; e: all; h: in links."""
        once = once and not item["r"]
        if item["k"] == "#":
            fixed = once and item["v"] is not None and item["n"] >= PAGES
            own = item["s"] - item["l"]
            item |= {"w": 0 if fixed else own, "u": own if fixed else 0, "e": item["s"], "h": item["l"]}
        else:
            for c in item["c"]:
                weigh(c, once)
            item |= {x: sum(c[x] for c in item["c"]) for x in "wueh"}

    def mark(item: Item, name: str) -> None:
        links = item["k"].split(".")[0] in _LISTS and item["h"] >= LINKS * max(item["e"], 1)
        if not links:
            item[name] = 1
            for c in item["c"]:
                mark(c, name)

    def site(item: Item, varying: int) -> None:
        if item["k"] == "#" and item["u"] and item["u"] <= SHARE * varying:
            item["t"] = 1
        for c in item["c"]:
            site(c, varying)

    weigh(wrapper, True)
    site(wrapper, wrapper["w"])
    part = wrapper
    while part["c"]:
        most = max(part["c"], key=lambda c: c["w"])
        if most["k"] != "()" and most["k"].rstrip("123").split(".")[0].rstrip("123") not in _SECTIONS or most["w"] < HOLDS * part["w"]:
            break
        part = most

    def headings(item: Item) -> None:
        for c in item["c"]:
            if c["k"].split(".")[0] in _HEADINGS and c["w"]:
                mark(c, "m")
            headings(c)

    headings(wrapper)
    part["m"] = 1
    for c in part["c"]:
        mark(c, "m")
    return wrapper


def _placed(children: list, items: list[Item]) -> list[Item | None]:
    """The wrapper's item that each child of a page's element is, in the order of both."""
    keys = [c.key if isinstance(c, Element) else "#" for c in children]
    if keys == [x["k"] for x in items]:
        return list(items)
    def seen(c: Element | Text) -> Item:
        if isinstance(c, Text):
            return {"k": "#", "v": digest(c) if texts else None, "c": []}
        inside = [{"k": y.key} if isinstance(y, Element) else {"k": "#", "v": digest(y) if texts else None} for y in c.children]
        return {"k": c.key, "c": inside}

    # Texts tell items of one kind apart.
    texts = len({x["k"] for x in items}) < len(items)
    own = [seen(c) for c in children]
    members = [{m["k"]: m for m in x["c"]} if x["k"] == "()" else {x["k"]: x} for x in items]

    def alike(i: int, j: int) -> float:
        found = members[j].get(keys[i])
        return similarity(own[i], found, texts) if found else 0.0

    n, m = len(keys), len(items)
    # best: of the first i children with the first j items; last: where child i is item j.
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    last = [[-1.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score = alike(i - 1, j - 1)
            if score:
                before = max(best[i - 1][j - 1], last[i - 1][j] if items[j - 1]["r"] else -1.0)
                last[i][j] = before + score
            best[i][j] = max(best[i - 1][j], best[i][j - 1], last[i][j])
    out: list[Item | None] = [None] * n
    i, j, held = n, m, False
    while i and j:
        if held or best[i][j] == last[i][j]:
            out[i - 1] = members[j - 1][keys[i - 1]]
            score = alike(i - 1, j - 1)
            held = bool(items[j - 1]["r"]) and last[i - 1][j] + score == last[i][j]
            i, j = i - 1, j if held else j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def article(page: Element, wrapper: Item) -> str:
    """The text of a page's article by a judged wrapper of its site: blocks in page order, a space between.

    If the page has an element marked as its article (else as its main part, else by its class), the
    text inside such elements counts, else what the wrapper takes for the article. Text that the site has
    on all pages does not count, nor do elements beside the article.
    """
    def ranks(element: Element) -> Iterator[int]:
        for c in element.children:
            if isinstance(c, Element) and not c.hidden:
                if c.rank:
                    yield c.rank
                yield from ranks(c)

    wanted = min(ranks(page), default=0)
    blocks: list[str] = []

    def walk(element: Element, items: list[Item], inside: bool) -> None:
        for c, item in zip(element.children, _placed(element.children, items)):
            if isinstance(c, Text):
                shown = inside if wanted or item is None else "m" in item
                if shown and not (item and "t" in item):
                    blocks.append(c.text)
            elif not c.hidden:
                own = c.rank == wanted if wanted else item is not None and "m" in item
                walk(c, item["c"] if item else [], own or inside and (bool(wanted) or item is None))

    walk(page, wrapper["c"], False)
    return " ".join(blocks)


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper) of each host of a partition, from (host, html)."""
    held: dict[str, Item] = {}
    sizes = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([pack(w) for w in held.values()], pa.binary())],
            names=["host", "wrapper"],
        )

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = wrapper_of(parse(page.as_py() or ""))
            if host in held:
                held[host] = merge(held[host], own)
            else:
                held[host] = own
                sizes += _size(own)
            if sizes > HELD:
                yield flush()
                held, sizes = {}, 0
    if held:
        yield flush()


def _merge_group(rows: pa.Table) -> pa.Table:
    data = sorted(rows.column("wrapper").to_pylist())
    return pa.table({"host": rows.column("host")[:1], "wrapper": pa.array([pack(reduce(merge, map(unpack, data)))], pa.binary())})


def host_of(url: str):
    """The host of a url, in lower case; null if it has none."""
    found = F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper for each host, from all its pages.

    Tasks fold the pages they have, and the wrappers of a host, one for each task, are merged in groups of
    about ``GROUP`` until one is left, so a host with a third of all pages is no more than that to any
    task. The order of merging may show where pages of a host have little in common.
    """
    hosted = pages.select(host_of(url).alias("host"), F.col(f"`{page}`").cast("string").alias("html")).filter("host is not null")
    now = written(hosted.mapInArrow(_fold_pages, "host string, wrapper binary"), "wrappers")
    while not (counts := now.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")).isEmpty():
        groups = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / GROUP))
        parts = now.join(counts, "host").withColumn("part", groups).groupBy("host", "part")
        single = now.join(counts, "host", "left_anti")
        now = written(single.unionByName(parts.applyInArrow(_merge_group, "host string, wrapper binary")), "wrappers")
    return now


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the text of the article of every page, by the wrapper of its host.

    Blocks of text in page order with one space between, white space inside a block being one space and
    character references decoded; without menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments
    of readers, and the site's own text. ``n_chars`` counts code points. Whole pages are read, however long.

    A null or empty page has an empty text, and so has one without an article. A page whose url has no host is
    read by itself. Repeated rows, and rows with null keys, have a row each; other columns play no part;
    an empty table gives an empty table.
    """
    source = pages.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"),
        host_of(url).alias("host"), F.col(f"`{page}`").cast("string").alias("html"),
    )
    found = infer_wrappers(pages, url, page).withColumnRenamed("host", "_host")
    rows = source.join(found, F.col("host") == F.col("_host"), "left").select("key", "url", "html", "wrapper")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "url")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[bytes, Item] = {}
        for batch in batches:
            for part in W.runs(batch, "html"):
                texts = []
                for x, packed in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    tree = parse(x or "")
                    if packed is None:
                        own = judge(wrapper_of(tree))
                    elif (own := judged.get(packed)) is None:
                        if len(judged) >= 256:
                            judged.clear()
                        own = judged[packed] = judge(unpack(packed))
                    texts.append(article(tree, own))
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "url", "text", "n_chars"])

    out = rows.mapInArrow(work, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"key": key, "url": url})
