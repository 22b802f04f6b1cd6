"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at its block elements. A block is described by its words, the part of
them in links, the same of the blocks before and after it, whether it stands in an article element or in an
element for something else (menus, headers, footers, sidebars, forms), whether a class, id or role around it,
inside the article, names such a part, and whether it is a heading. A decision tree tells main text from the
rest. It is trained on the blocks of the labelled pages below.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What isn't text. An element that is never closed holds back nothing but itself, except where HTML says that the rest
# of the page is in it; a button or a selection ends before the next block element.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<closed>noscript|template|iframe|svg|math|object|video|audio|canvas)(?=[\s/>])[^>]*>(?:(?!<(?P=closed)[\s/>]).)*?</(?P=closed)\s*>"
    r"|<(?P<short>select|button)(?=[\s/>])[^>]*>(?:(?!<(?:article|aside|div|footer|h[1-6]|header|main|nav|ol|p|section|table|ul|(?P=short))[\s/>]).)*?</(?P=short)\s*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
OTHER = frozenset("aside dialog footer header menu nav".split())
#: Names that pages give to parts beside the text, and words that may stand with them in one name.
OTHER_NAMES = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus footer gdpr masthead menu meta nav navbar navigation newsletter notice popup promo promotion related replies reply respond response responses search share sharing sidebar social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
PLAIN_NAMES = frozenset("1 2 3 area article articles bar bars body bottom box button buttons container content description entry form group header icons inner item items left link links list main media message policy outer page panel post posts primary right row secondary section site slot text title top trail wrap wrapper".split())
#: Words that are enough in a name, whatever stands with them, and those that make a name a state of what is around the text.
TELLING_NAMES = frozenset("ads adsbygoogle advert advertisement advertising adverts breadcrumb breadcrumbs comment commentlist comments cookie cookies discussion disqus gdpr newsletter replies responses sponsored".split())
STATES = frozenset("closed count disabled enabled has no off on open with without".split())
#: Parts with readers' words or other pages' texts: an article inside one is no article of the page.
FOREIGN_NAMES = frozenset("comment commentlist comments discussion disqus related replies reply respond response responses".split())
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*["']?false)|\bstyle\s*=\s*(?:"[^"]*|'[^']*)display\s*:\s*none""", re.I)
#: A form outside an article with more words than so many for each control and one more isn't a part of a page but what is around it.
WORDS_A_CONTROL = 20
CONTROL = re.compile(r"<(?:textarea|select|button)\b", re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_other", "named_other", "heading")

#: Labelled pages in the shapes that pages have. m12 stands for twelve words of main text, o12 for twelve others.
LABELLED = (
    # an article element between a menu, an advert and a footer; paragraphs of any length
    "<nav><ul><li><a>o1</a><li><a>o1</a><li><a>o2</a></ul></nav><div class=ad>o9</div><article><h1>m12</h1><p>m120</p><p>m45</p><p>m2</p><p>m8</p><p>m1</p></article><footer>o14</footer>",
    "<nav><a>o1</a> <a>o1</a></nav><div class=ad>o25</div><article><h1>m6</h1><p>m1</p><p>m1</p><p>m30</p></article><footer>o40</footer>",
    "<header><a>o2</a><p>o8</p></header><nav><ul><li><a>o2</a><li><a>o3</a></ul></nav><main><h1>m7</h1><p>m60</p><h2>m4</h2><p>m90</p><ul><li>m6<li>m3<li>m12</ul></main><aside><h3>o2</h3><ul><li><a>o6</a><li><a>o7</a></ul><p>o30</p></aside><footer><p>o12</p><a>o2</a></footer>",
    # comments, sharing, related links, a form within or behind the article
    "<article><header><h1>m9</h1></header><p>m80</p><div class=share><a>o1</a> <a>o1</a></div><p>m55</p><figure><figcaption>m10</figcaption></figure><p>m70</p><div class=related-posts><h3>o2</h3><ul><li><a>o8</a><li><a>o9</a></ul></div><form><label>o5</label></form><section id=comments><h2>o2</h2><p>o40</p><p>o65</p><p>o7</p></section></article>",
    "<article><h1>m8</h1><p>m100</p><p>m40</p><footer>o9</footer></article><div class=comments><p>o50</p><div class=comment-body><p>o30</p><p>o90</p></div></div><div class=newsletter><h4>o4</h4><p>o16</p></div>",
    "<div role=navigation><a>o1</a><a>o2</a></div><article><h1>m10</h1><p>m33</p><blockquote>m25</blockquote><pre>m18</pre><table><tr><td>m1<td>m2<td>m1<tr><td>m3<td>m1</table><p>m20 <a>m5</a> m10</p><p><a>m3</a></p></article><div class=cookie-notice>o18</div>",
    # no article element: long texts and what stands beside them
    "<div class=top><a>o1</a><a>o2</a><a>o1</a></div><div><h1>m8</h1><p>m90</p><p>m60</p><p>m12</p><p>m75</p></div><div><a>o2</a> <a>o3</a> o4</div>",
    "<table><tr><td><a>o2</a><br><a>o2</a><br><a>o1</a><td><h2>m5</h2><p>m70</p><p>m40 <a>m4</a> m20</p><p>m9</p><p>m110</p><tr><td>o8</table>",
    "<div id=menu><ul><li><a>o2</a><li><a>o1</a><li><a>o3</a></ul></div><div id=content><h1>m6</h1><p>m45</p><h2>m3</h2><p>m130</p><ul><li>m14<li>m22<li>m9</ul><p>m38</p></div><div id=sidebar><h3>o3</h3><p>o45</p><a>o4</a></div><div id=footer><p>o15</p></div>",
    "<div><a>o3</a></div><div><a>o6</a></div><div><a>o12</a></div><div>m150 <a>m8</a></div><div>m60</div><div>m15</div><div>m42</div><div><a>o4</a></div><div>o3 <a>o2</a></div>",
    "<p>o3 <a>o1</a></p><p>o2 <a>o4</a></p><h1>m9</h1><p>m55</p><p>m7</p><p>m48</p><p>m66</p><p>o6</p><p><a>o2</a></p><p><a>o3</a></p><p><a>o2</a></p><p>o5</p>",
    "<article><h1>m5</h1><p>m30</p><p>m2</p></article>", "<main><h1>m3</h1><p>m12</p><p>m1</p></main>", "<article><p>m1</p></article>", "<p>o3</p><article><p>m9</p><p>m4</p></article>",
    "<nav><a>o2</a></nav><article><h1>m9</h1><p>m150</p><p>m3</p><p>m2</p><p>m110</p><p>m6</p><p>m1</p><p>m200</p><p>m4</p></article><footer>o11 <a>o2</a></footer>",
    "<ul><li><a>o1</a></ul><article><p>m14</p><p>m130</p><p>m1</p><h2>m2</h2><p>m3</p><p>m180</p></article><p>o9 <a>o3</a></p>",
    "<h1>m6</h1><p>m120</p><p>m5</p><p>m140</p><p>m9</p><p>m60</p><h2>m2</h2><p>m125</p><p>m11</p><p>m33</p>",
    "<article><h1>m3</h1><p>m6</p></article>", "<article><h1>m2</h1><p>m4</p><p>m140</p><p>m3</p></article>", "<article><p>m90</p><p>m5</p></article>", "<main><p>m5</p><p>m200</p><p>m1</p></main>",
    "<nav><a>o2</a></nav><article><h1>m2</h1><p>m1</p><p>m2</p></article>", "<article><h1>m1</h1><p>m2</p></article><div><a>o2</a></div>", "<div><a>o3</a></div><article><p>m3</p><p>m2</p></article><div><a>o2</a> o1</div>",
    "<div><a>o9</a></div><main><div>m2</div><div>m3</div><div>m80</div><div>m1</div></main><div><a>o9</a></div>", "<nav><a>o1</a></nav><article><p>m1</p><ul><li><a>m2</a></ul><p>m1</p></article><nav><a>o1</a></nav>",
    "<h1>m6</h1><p>m108</p><p>m10</p><p>m112</p><p>m9</p><p>m50</p><p>m106</p><p>m7</p>",
    # a line of its own between links and text
    "<ul><li><a>o2</a><li><a>o3</a></ul><p>o4</p><h1>m8</h1><p>m70</p><p>m31</p><p>o3</p><ul><li><a>o4</a><li><a>o4</a></ul>",
    "<div><a>o1</a> <a>o1</a></div><div>o6</div><div>m65</div><div>m5</div><div>m44</div><div>o4</div><div><a>o2</a></div>",
    "<div><a>o2</a></div><div>o2</div><h1>m11</h1><div>m4</div><div>m58</div><div>m77</div><div><a>o5</a></div><div>o7</div>",
    "<p>m25</p>", "<h1>m4</h1><p>m35</p><p>m20</p>", "<div>m90</div>",
    # lists of links and short lines: nothing is main text
    "<ul><li><a>o5</a><li><a>o6</a><li><a>o4</a><li><a>o8</a></ul><p>o4</p><p><a>o2</a> o2</p>",
    "<div><a>o1</a></div><div>o3</div><div><a>o2</a></div><div>o5 <a>o1</a></div><div>o2</div><div><a>o4</a></div>",
    "<h2>o2</h2><ul><li><a>o9</a> o2<li><a>o7</a> o3<li><a>o11</a> o2</ul><h2>o3</h2><ul><li><a>o6</a><li><a>o8</a></ul>",
    # teasers beside the text
    "<div><h1>m7</h1><p>m85</p><p>m95</p></div><div><p>o12 <a>o9</a></p><p>o8 <a>o10</a></p><p>o10 <a>o8</a></p></div><div>o9 <a>o2</a> <a>o3</a></div>",
)


def train(rows, depth: int = 9):
    """Decision tree of rows (features, then label) by Gini impurity: (feature, bound, at most, above), or the label of a leaf."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    gini = lambda part: (lambda n, p: n - (p * p + (n - p) * (n - p)) / n)(len(part), sum(r[-1] for r in part))
    best = None
    # what the elements say comes first among equals
    for f in (6, 7, 8, 0, 1, 2, 3, 4, 5, 9):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[f] <= a], [r for r in rows if r[f] > a]
            if best is None or gini(low) + gini(high) < best[0] - 1e-9:
                best = (gini(low) + gini(high), f, (a + b) / 2, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], train(best[3], depth - 1), train(best[4], depth - 1)


def labelled_rows() -> list[tuple]:
    """The features of each block of the labelled pages, then 1 for main text."""
    out = []
    for page in LABELLED:
        found = blocks(re.sub(r"\b([mo])(\d+)\b", lambda m: " ".join([m[1]] * int(m[2])), page))
        out += [(*x, int(b[0][0] == "m")) for x, b in zip(features(found), found)]
    return out


@cache
def _tree():
    return train(labelled_rows())


@cache
def part_named(name: str, article: bool = False) -> int:
    """Whether a name says that a part is beside the text (1), and 2 if articles inside are none of the page.

    One telling word is enough except for an article; else all words have to be known ones.
    """
    parts = [p for p in re.split(r"[-_:]+", name.lower()) if p]
    if not any(p in OTHER_NAMES or p in TELLING_NAMES for p in parts) or any(p in STATES for p in parts):
        return 0
    if all(p in OTHER_NAMES or p in PLAIN_NAMES for p in parts) or (not article and any(p in TELLING_NAMES for p in parts)):
        return 2 if any(p in FOREIGN_NAMES for p in parts) else 1
    return 0


def names_other(attrs: str, article: bool = False) -> int:
    """What an element's class, id and role say: as ``part_named``; hidden elements are beside the text."""
    found = [part_named(name, article) for names in NAMES.findall(attrs) for name in "".join(names).split() if len(name) < 80]
    return max([*found, 2 if HIDDEN.search(attrs) else 0])


def is_main(features) -> int:
    node = _tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def blocks(page: str) -> list[list]:
    """[text, words, words in links, in_article, in_other, named_other, heading] of each block of a page, in its order."""
    out: list[list] = []
    stack: list[tuple[str, int, int, int, int]] = []  # element, in_article, in_other, named_other, form
    opened: dict[str, int] = {}  # how many of each element are in the stack
    forms, of_form = [0], []  # controls of each form, the first is none; the form of each block
    now, linked, link, heading = [], [], 0, 0

    def end() -> None:
        nonlocal now, linked
        text = " ".join("".join(now).split())
        if text:
            _, article, other, named, form = stack[-1] if stack else ("", 0, 0, 0, 0)
            out.append([text, text.count(" ") + 1, len("".join(linked).split()), article, other, min(1, named), heading])
            of_form.append(form)
        now, linked = [], []

    def leave() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if "&" in piece:
                piece = entities.unescape(piece)
            now.append(piece)
            if link:
                linked += [piece, " "]
        at, name = m.end(), (m["name"] or "").lower()
        if m["raw"] or m["closed"] or m["short"]:
            now.append(" ")
            if stack and stack[-1][4] and CONTROL.match(m[0]):
                forms[stack[-1][4]] += 1
        if not name:
            continue
        if name == "input" and stack and stack[-1][4] and "hidden" not in m["attrs"].lower():
            forms[stack[-1][4]] += 1
        if name == "a":
            link = 0 if m["close"] else 1
        elif name == "br":
            now.append(" ")
        elif name in BLOCK:
            end()
            link = 0
            if m["close"]:
                if opened.get(name):
                    while stack[-1][0] != name:
                        leave()
                    leave()
            else:
                while stack and (stack[-1][0] == "p" or stack[-1][0] in HEADING or (stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th"))):
                    leave()
                if name not in VOID and not m["attrs"].endswith("/"):
                    above, form = stack[-1] if stack else ("", 0, 0, 0, 0), 0
                    # a header inside an article is a part of it
                    other = (name in OTHER and not (name == "header" and above[1])) or (name == "form" and above[1])
                    # what is named around an article says nothing of it, unless all inside is somebody else's
                    around = 0 if name in ARTICLE and above[3] < 2 else above[3]
                    named = max(around, names_other(m["attrs"], name in ARTICLE) if name not in ("html", "body", "main") else 0)
                    if name == "form":
                        forms.append(0)
                        form = len(forms) - 1
                    stack.append((name, int(above[1] or name in ARTICLE), int(above[2] or other), named, form or above[4]))
                    opened[name] = opened.get(name, 0) + 1
            heading = int(bool(stack) and stack[-1][0] in HEADING)
    rest = page[at:]
    now.append(entities.unescape(rest))
    if link:
        linked.append(rest)
    end()
    said = [0] * len(forms)
    for b, form in zip(out, of_form):
        said[form] += 0 if b[4] or b[5] else b[1]
    for b, form in zip(out, of_form):
        if form and said[form] <= WORDS_A_CONTROL * (1 + forms[form]):
            b[4] = 1
    return out


def features(found: list[list]) -> list[tuple]:
    """The features of a page's blocks, in the order of FEATURES."""
    wide = [(b[1], min(1.0, b[2] / b[1])) for b in found]
    around = [(0, 0.0), *wide, (0, 0.0)]
    return [(*wide[k], *around[k], *around[k + 2], *b[3:]) for k, b in enumerate(found)]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for x, b in zip(features(found), found) if is_main(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html; other columns are ignored).

    text joins the blocks of main text in the page's order; in a block character references are decoded and
    white space becomes one space. A page without main text, an empty one and a null one have empty text. A null
    id or url stays null, rows that repeat are extracted each, pages of any length are read whole, and no rows
    give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in some.column("html")]
                texts = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
