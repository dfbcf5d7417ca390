import hashlib
import html
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import merkle, queries, whitening, wrappers
from antecede.llm.html_pages import parse

SMALL = "/root/testdata/sf0.001"

# Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(digests):
    """The root and, for each leaf, its siblings with their side, as the contract puts it."""
    ways = [[] for _ in digests]
    holds = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, held = [], []
        for i in range(0, len(digests), 2):
            run = digests[i : i + 2]
            if len(run) == 2:
                for leaf in holds[i]:
                    ways[leaf].append(("R", run[1]))
                for leaf in holds[i + 1]:
                    ways[leaf].append(("L", run[0]))
            else:
                for leaf in holds[i]:
                    ways[leaf].append(("", ""))
            up.append(sha(*run))
            held.append(sum(holds[i : i + 2], []))
        digests, holds = up, held
    return digests[0], ways


def plain_manifest(rows):
    """Sorted rows of the result."""
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append((plain_leaf(row), row))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[lang] = own, *plain_tree([d for d, _ in own])
    root, over = plain_tree([trees[lang][1] for lang in langs])
    out = []
    for lang, above in zip(langs, over):
        own, subroot, ways = trees[lang]
        for (leaf, row), way in zip(own, ways):
            way = way + above
            now = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                now = plain_leaf((*row[:3], row[3] + 1, row[4]))
            folded = now
            for side, digest in way:
                folded = sha(digest, folded) if side == "L" else sha(folded, digest)
            out.append((row[0], leaf, subroot, root, sha(*[d for _, d in way]), folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumns({"pos": F.lit(1), "_place": F.lit("x"), "total": F.lit(2)})
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.verify(df, tampered=tampered, changes={"n_chars": F.try_add("n_chars", F.lit(1))})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_equals_plain_trees(spark, monkeypatch, bits):
    """Groups of 1 to 41 leaves, so that runs of one node occur on every level; nulls, ties and repeated rows."""
    monkeypatch.setattr(merkle, "BITS", bits)
    rng = random.Random(bits)
    sizes = {None: 3, "": 1, "de": 1, "en": 41, "é": 8, "z": 5}
    rows = [(rng.randrange(400), "s", lang, rng.choice([None, 5, 70]), "t" * rng.randrange(4)) for lang, n in sizes.items() for _ in range(n)]
    rows += [(None, None, "en", None, None), (7, "a:b", "en", 2, ""), (7, "a:b", "en", 2, ""), (7, "a", "en", 2, "😀" * 50_000)]
    got = manifest_rows(spark, rows)
    assert got == plain_manifest(rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_one_leaf_and_of_none(spark):
    one = [(0, "s", "en", 3, "abc")]
    assert manifest_rows(spark, one) == plain_manifest(one)
    assert manifest_rows(spark, []) == []


def test_versions_share_all_nodes_but_their_own(spark, monkeypatch):
    """A version's tree, put together of copied and shared nodes, is the tree of the changed leaves."""
    monkeypatch.setattr(merkle, "BITS", 2)
    rows = [(i, "s", "en" if i % 3 else "fr", i, "t") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    made = merkle.manifest(df, tampered=F.col("doc_id").isin(5, 6, 58), changes={"n_chars": F.lit(0).cast("long")})
    copies = {}
    for r in made.copied_nodes().collect():
        copies.setdefault((r.tree, r.pos), {})[r.level] = r.digest
    assert len(copies) == 3
    for key in (5, 6, 58):
        lang = "en" if key % 3 else "fr"
        order = [i for i in range(60) if ("en" if i % 3 else "fr") == lang]
        leaves = [plain_leaf((*rows[i][:3], 0 if i == key else i, "t")) for i in order]
        own, now, level = copies["=" + lang, order.index(key)], leaves, 0
        at = order.index(key)
        while len(now) > 1:
            assert own[level] == now[at >> level]
            now, level = [sha(*now[i : i + 2]) for i in range(0, len(now), 2)], level + 1
        other = plain_tree([plain_leaf(rows[i]) for i in range(60) if i not in order])[0]
        assert own[level] == now[0]
        assert own[level + 1] == (sha(now[0], other) if lang == "en" else sha(other, now[0]))
        assert len(own) == level + 2


# Whitening


def plain_whitening(rows, k=16):
    kept = [(key, v) for key, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([np.floor(np.array(v, np.float64) * 64) + 1_000_000 for _, v in kept]).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (n * distinct - sums) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return kept, n, deviation, ((n * x - sums) / n) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def whitened(spark, rows, kind="array<float>", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumns({"x": F.lit(1), "component": F.lit(2)})
    out = whitening.whiten(df, **more).collect()
    assert not out or out[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    return out


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 20)) * np.linspace(0.2, 3, 20)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # copies count once
    odd = [(None, rows[3][1]), (5, None), (6, []), (7, [float("nan")] + rows[0][1][1:]), (8, [None] + rows[0][1][1:])]
    odd += [(9, [float("inf")] + rows[0][1][1:]), (10, [0.5, 0.5])]
    got = whitened(spark, rows + odd)
    kept, n, deviation, y, explained = plain_whitening(rows + odd[:1])
    own = {}
    for r in got:
        own.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n} == {300}
    signs = np.sign([own[0][c].whitened * y[0][c - 1] for c in range(1, 17)])
    for i, (key, _) in enumerate(kept):
        mine = own[key]
        assert mine[1].deviation == deviation[i] and sorted(mine) == list(range(1, 17))
        assert np.allclose([mine[c].whitened for c in range(1, 17)] * signs, y[i], atol=1e-9)
        assert np.allclose([mine[c].explained for c in range(1, 17)], explained, rtol=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_finds_repeated_and_missing_directions(spark):
    """Four equal eigenvalues, one dimension without spread and one that repeats another."""
    rows = [(2 * i + s, [(1 - 2 * s) * 4.0 * (d == i) for d in range(4)] + [0.25, 0.0]) for i in range(4) for s in (0, 1)]
    rows = [(k, v[:-1] + [v[0]]) for k, v in rows]
    got = whitened(spark, rows, "array<double>")
    shares = {r.component: r.explained for r in got}
    assert sorted(shares) == [1, 2, 3, 4] and np.allclose([shares[c] for c in (1, 2, 3, 4)], [0.4, 0.2, 0.2, 0.2])
    y = np.array([[next(r.whitened for r in got if (r.vec_id, r.component) == (k, c)) for c in shares] for k, _ in rows])
    assert np.allclose(y.T @ y / len(y), np.eye(4), atol=1e-9) and got[0].identity_error < 1e-9


def test_whitening_with_nothing_to_scale(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []
    two = whitened(spark, [(1, [0.5, 0.5]), (2, [0.25, 0.5])])
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_deviations_are_exact():
    x = np.array([[1 << 40, 5], [0, 7]], np.int64)
    n, sums = 3, np.array([1 << 40, 12])
    want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, n, sums) == [None if w >= 2**63 else w for w in want]


# Pages


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeßé & ü<") for _ in range(rng.randrange(2, 9))).strip() or "x" for _ in range(n))


def blocks(texts):
    return " ".join(x for x in (" ".join(t.split()) for t in texts) if x)


def paragraphs(rng):
    return [words(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 9))]


def semantic_page(rng, i):
    title, body, e = words(rng, 5), paragraphs(rng), html.escape
    quote, items = words(rng, 8), [words(rng, 3) for _ in range(3)]
    page = f"""<!DOCTYPE html><html><head><title>{e(title)}</title><script>if (a < b) "<p>no</p>"</script></head><body class="has-sidebar">
<header><div>Site name</div><form><input name=q><p>Search</p></form></header><nav><a href=/>Home</a> <a href='/b'>{e(words(rng, 1))}</a></nav>
<!-- note: <p>hidden</p> --><div class="cookie-notice">We use cookies {i}</div><main><article><header><h1>{e(title)}</h1></header>
{"".join(f"<p>{e(t)}" + ("</p>" if rng.random() < 0.7 else "") for t in body)}
<div class="ad-slot">Buy {e(words(rng, 4))}</div><blockquote>{e(quote)}</blockquote><ul>{"".join(f"<li>{e(t)}" for t in items)}</ul>
<footer>Tags: {e(words(rng, 2))}</footer></article><section><h2>3 Comments</h2><p>{e(words(rng, 9))}</p></section></main>
<aside>{e(words(rng, 30))}</aside><footer>&copy; {i}</footer></body></html>"""
    return page, blocks([title, *body, quote, *items])


def plain_page(rng, i):
    """No element says what it is: parts are told by their place, by links and by what differs."""
    title, body, e = words(rng, 5), paragraphs(rng) + [words(rng, 60)], html.escape
    links = "".join(f"<div><a href=/{k}>{e(words(rng, 2))}</a></div>" for k in range(rng.randrange(4, 8)))
    more = f"<div>Weather today</div>" if rng.random() < 0.5 else ""
    page = f"""<html><body><div>Daily Example - news since 1900</div><div>{links}</div>{more}
<div><h1>{e(title)}</h1><div>{"".join(f"<p>{e(t)}</p>" for t in body)}</div></div>
<div>Read our terms of use before you write to us</div></body></html>"""
    return page, blocks([title, *body])


def classed_page(rng, i):
    title, body, e = words(rng, 5), paragraphs(rng), html.escape
    told = "Subscribe to the weekly letter of this site"
    page = f"""<body><div id="topbar">{e(words(rng, 4))}</div><div class="post-content p{i}"><h1>{e(title)}</h1><p>{told}</p>
<div>{e(words(rng, 90))[:0]}{"<br>".join(e(t) for t in body)}<p>{e(words(rng, 50))[:0]}</p></div>
<div class="share">Share this {i}</div></div><div class="comments"><div class="comment">{e(words(rng, 20))}</div></div><div class="footer">x {i}</div></body>"""
    return page, blocks([title, *body])


def site(kind, host, n, seed):
    rng = random.Random(seed)
    return [(f"https://{host}/{i}.html", *kind(rng, i)) for i in range(n)]


@pytest.fixture(scope="module")
def sites():
    return site(semantic_page, "a.example", 40, 1) + site(plain_page, "b.example", 40, 2) + site(classed_page, "c.example", 40, 3)


def extracted(spark, rows, parts=3):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, *_) in enumerate(rows)], "page_id long, url string, html string")
    out = wrappers.extract(df.withColumns({"wrapper": F.lit(1), "HOST": F.lit(2)}).repartition(parts, "page_id"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    return {r.page_id: r for r in out.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_articles_of_several_layouts(spark, sites, monkeypatch, parts):
    monkeypatch.setattr(wrappers, "GROUP", 2)
    got = extracted(spark, sites, parts)
    for i, (url, _, want) in enumerate(sites):
        assert (got[i].url, got[i].text) == (url, want)
        assert got[i].n_chars == len(want)


def test_odd_pages(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (None, None), ("", ""), ("not a url", "<p>just text"), ("http://x/1", "no markup &amp; &am"), ("http://x/2", "<article><p>cut of"),
        ("http://y/1", "<article>kept <a href='never closed"), ("http://y/2", "<script>var x = 1"), ("http://z/", "<div hidden>a</div><p>b &lt;i&gt; 1 < 2"),
        ("http://l/", f"<article><p>{long}</p></article>"), ("http://d/", "<div>" * 5000 + "deep" + "</div>" * 5000),
        ("http://u/", "<ul><li>one<li>two <b>t</b>hree</ul><table><tr><td>four<td>five</table>"), ("http://u/", "</p></div><br/>six&nbsp;&nbsp;seven"),
    ]
    got = extracted(spark, rows)
    want = ["", "", "just text", "no markup & &am", "cut of", "kept", "", "b <i> 1 < 2", long, "deep", "one two three four five", "six seven"]
    assert [got[i].text for i in range(len(rows))] == want
    assert extracted(spark, []) == {}
    again = spark.createDataFrame([(None, "http://x/", "<p>a"), (None, "http://x/", "<p>a")], "page_id long, url string, html string")
    assert [tuple(r) for r in wrappers.extract(again).collect()] == [(None, "http://x/", "a", 1)] * 2


def test_wrappers_have_optional_and_repeated_items_and_slots():
    pages = ["<div><h2>a</h2></div><p>x</p><p>y</p>", "<div><h2>b</h2></div><p>z</p>", "<div><h2>a</h2></div><hr><table><td>1</table><p>q</p><p>r</p><p>s</p>"]
    own = wrappers.wrapper_of(parse(pages[0]))
    for p in pages[1:]:
        own = wrappers.merge(own, wrappers.wrapper_of(parse(p)))
    kinds = [(x["k"], x["o"], x["r"], x["n"]) for x in own["c"]]
    assert kinds == [("div", 0, 0, 3), ("table", 1, 0, 1), ("p", 0, 1, 3)]
    assert own["c"][0]["c"][0]["c"][0]["v"] is None and wrappers.unpack(wrappers.pack(own)) == own
    same = wrappers.merge(wrappers.wrapper_of(parse(pages[0])), wrappers.wrapper_of(parse(pages[0])))
    assert same["c"][0]["c"][0]["c"][0]["v"] and same["c"][0]["n"] == 2


def test_wrappers_stay_small():
    """Pages of which no two have the same kinds of elements in one order."""
    rng, own = random.Random(5), None
    for i in range(150):
        kinds = rng.sample(["p", "h2", "h3", "ul", "ol", "table", "pre", "div", "dl", "section", "blockquote"], 8) * 8
        page = wrappers.wrapper_of(parse("".join(f'<{k} class="c{i}-{rng.choice("abcdefgh")}x">t</{k}>' for k in kinds)))
        own = page if own is None else wrappers.merge(own, page)
    assert wrappers._size(own) < 4 * wrappers.LIMIT and own["n"] == 150


def test_new_queries_are_registered():
    names = list(queries.all_queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in (11, 12, 13)] == [1, 1, 1]
    assert {"op11_merkle_manifest", "op13_html_extraction"} <= set(queries.all_sql())
