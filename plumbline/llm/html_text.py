"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks with their word counts, link densities and surroundings.  A decision tree
over a block and its two neighbours, trained on a small labelled table, says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import annotate

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text: raw ones up to their end tag, the others up to the end of what holds them.
RAW = "script|style|title|textarea|iframe"
SILENT = frozenset("noscript template object svg math select".split())
#: Elements a head may hold; any other tag ends it.
HEAD = frozenset("base link meta noscript template".split())
#: Elements, roles and words of class or id that stand for anything but the article.
APART = frozenset("nav aside footer form button dialog menu fieldset".split())
APART_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "dialog disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promotion related recommended replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: A word before or after one of these says what a page has or is, not what an element is.
NOT_BEFORE = frozenset("has no not with without".split())
NOT_LAST = frozenset("layout page site template theme".split())
#: A container named like something else that holds more than this share of a page's text is the page's.
MOST_OF_PAGE = 0.75
#: Named containers in each other that are told apart; text still deeper counts to these.
MOST_NAMED = 64
#: The rest of a tag.  Quotes enclose a value only right after its equals sign, and a tag ends before the next one begins,
#: so that no character is looked at again from another tag.
_REST = r"(?P<%s>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?|[^<>=])*+)"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})(?=[\s/>]){_REST % 'more'}>"
    rf"|<(?P<close>/?)(?P<tag>[a-z][^\s/<>]*){_REST % 'rest'}>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW.split("|")}
#: Where a raw element without an end tag ends: with the head, or else with the page.
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place")
#: Blocks labelled by hand: words, share of characters in links, apart (1: in an element that stands for something
#: else), article (1: in an article, -1: beside one, 0: the page has none), label.  Empty lines part pages.  The tree
#: sees the two marks as one, ``place``: 1 in the article, 0 on a page without one, -1 apart or beside.
LABELLED = """
1 1.0 1 -1 0
1 1.0 1 -1 0
2 1.0 1 -1 0
9 0.0 1 -1 0
8 0.0 0 1 1
60 0.0 0 1 1
3 0.0 0 1 1
120 0.1 0 1 1
12 0.0 1 -1 0

4 1.0 1 -1 0
11 0.0 0 1 1
1 0.0 0 1 1
35 0.05 0 1 1
14 0.3 0 1 1
22 0.0 1 1 0
40 0.0 1 1 0
70 0.0 0 1 1
2 1.0 0 1 1
25 0.2 1 -1 0

6 0.0 0 -1 0
18 0.0 0 -1 0
7 0.0 0 1 1
90 0.0 0 1 1
4 0.0 0 1 1
5 0.9 0 -1 0
30 0.0 0 -1 0

3 1.0 0 0 0
2 1.0 0 0 0
4 0.8 0 0 0
9 0.0 0 0 1
80 0.02 0 0 1
45 0.0 0 0 1
12 0.0 0 0 1
110 0.1 0 0 1
6 0.7 0 0 0
5 1.0 0 0 0
3 0.9 0 0 0

2 1.0 1 0 0
24 0.1 1 0 0
7 0.0 0 0 1
33 0.0 0 0 1
28 0.1 0 0 1
15 0.0 0 0 1
50 0.0 1 0 0
31 0.0 1 0 0
10 0.4 1 0 0

1 1.0 0 0 0
1 1.0 0 0 0
3 0.0 0 0 0
2 1.0 0 0 0
10 0.0 0 0 1
64 0.0 0 0 1
5 0.0 0 0 1
72 0.1 0 0 1
4 1.0 0 0 0
6 0.9 0 0 0

8 0.0 1 -1 0
55 0.0 1 -1 0
6 0.0 0 1 1
2 0.0 0 1 1
1 0.0 0 1 1
9 0.5 0 1 1
16 0.0 1 1 0
20 0.0 0 -1 0
13 0.0 1 -1 0

5 0.0 1 0 0
38 0.0 0 0 1
90 0.0 0 0 1
26 0.0 0 0 1
3 1.0 1 0 0
48 0.0 1 0 0

2 1.0 0 0 0
1 1.0 0 0 0
2 1.0 0 0 0
6 0.0 0 0 1
54 0.0 0 0 1
12 0.8 0 0 1
48 0.1 0 0 1
4 0.0 0 0 1
61 0.0 0 0 1
9 1.0 0 0 1
37 0.0 0 0 1
2 1.0 0 0 0
1 1.0 0 0 0
4 0.0 0 0 0

1 1.0 0 0 0
3 1.0 0 0 0
8 0.0 0 0 1
29 0.0 0 0 1
5 0.0 0 0 1
7 0.0 0 0 1
6 0.2 0 0 1
42 0.0 0 0 1
16 0.9 0 0 1
33 0.0 0 0 1
3 1.0 0 0 0
2 0.0 0 0 0
2 1.0 0 0 0
5 0.0 0 0 0

2 1.0 1 -1 0
7 0.0 0 1 1
44 0.1 0 1 1
11 1.0 0 1 1
58 0.0 0 1 1
2 0.0 0 1 1
14 0.9 0 1 1
12 0.8 0 1 1
17 1.0 0 1 1
9 0.7 0 1 1
3 1.0 1 -1 0
12 1.0 0 -1 0

4 0.0 0 0 0
1 1.0 0 0 0
2 1.0 0 0 0
9 0.0 0 0 1
71 0.0 0 0 1
20 0.7 0 0 1
66 0.0 0 0 1
18 1.0 0 0 1
25 0.1 0 0 1
8 1.0 0 0 0
7 1.0 0 0 0
9 0.9 0 0 0
6 0.0 0 0 0

3 0.0 1 -1 0
5 0.0 0 1 1
30 0.0 0 1 1
4 1.0 0 1 1
27 0.0 0 1 1
6 1.0 0 1 1
8 1.0 0 1 1
5 0.0 0 -1 0
2 1.0 0 -1 0

1 0.0 0 0 0
2 1.0 0 0 0
1 1.0 0 0 0
5 0.0 0 0 1
46 0.0 0 0 1
3 0.0 0 0 1
52 0.1 0 0 1
22 0.6 0 0 1
39 0.0 0 0 1
4 0.0 0 0 1
2 1.0 0 0 0
3 0.0 0 0 0
1 1.0 0 0 0
2 0.0 0 0 0

3 0.0 0 -1 0
52 0.0 0 1 1
5 0.0 0 1 1
64 0.0 0 1 1
10 1.0 0 1 1
12 1.0 0 1 1
9 1.0 0 1 1
14 1.0 0 1 1
11 0.9 0 1 1
2 0.0 0 -1 0
44 0.1 0 -1 0
5 0.0 0 -1 0
38 0.0 0 -1 0

2 0.0 0 -1 0
6 0.2 0 -1 0
41 0.0 0 1 1
8 1.0 0 1 1
7 1.0 0 1 1
13 0.9 0 1 1
57 0.0 0 1 1
4 0.0 0 -1 0
50 0.0 0 -1 0
1 0.0 0 -1 0
33 0.2 0 -1 0

60 0.0 0 1 1

3 0.0 0 1 1
12 1.0 0 1 1

5 1.0 0 1 1
2 0.0 0 1 1
3 1.0 0 1 1
1 1.0 0 1 1

3 0.0 0 0 1
52 0.0 0 0 1
2 0.0 0 0 1
41 0.1 0 0 1

80 0.0 0 0 1

2 1.0 0 0 0
3 0.0 0 0 1
36 0.0 0 0 1
4 0.0 0 0 1
64 0.0 0 0 1

12 1.0 0 0 0
6 0.0 0 0 1
58 0.0 0 0 1
47 0.1 0 0 1
18 1.0 0 0 0

20 0.9 0 0 0
15 1.0 0 0 0
9 0.0 0 0 1
70 0.0 0 0 1
14 1.0 0 0 0
11 1.0 0 0 0

3 0.0 0 1 1
2 0.0 0 1 1
1 0.0 0 1 1
3 0.0 0 1 1
2 0.5 0 1 1
4 0.0 0 1 1

1 0.0 0 1 1

4 0.0 0 1 1
2 0.0 0 1 1

2 1.0 0 1 1
1 1.0 0 1 1
3 1.0 0 1 1
2 1.0 0 1 1
1 0.0 0 1 1

2 1.0 0 0 0
3 1.0 0 0 0
60 0.0 0 0 1
44 0.0 0 0 1
1 1.0 0 0 0

4 1.0 0 0 0
1 1.0 0 0 0
2 1.0 0 0 0
38 0.0 0 0 1
13 1.0 0 0 1
51 0.1 0 0 1
2 1.0 0 0 0
"""


class _Open(NamedTuple):
    """An open element: whether it stands apart by itself, lies in an article, hides its text, and the containers
    named like something else that it lies in."""

    tag: str
    apart: bool = False
    article: bool = False
    silent: bool = False
    named: tuple[int, ...] = ()


def blocks(page: str) -> list[tuple]:
    """Text blocks in page order: text, words, links, apart, article."""
    found: list[tuple[str, int, float, bool, bool, tuple[int, ...]]] = []
    stack: list[_Open] = []
    n_open: Counter[str] = Counter()  # of the stack, by tag
    pieces: list[tuple[str, bool]] = []
    articles: list[tuple[int, ...]] = []  # the named containers around each article or main
    endless: set[str] = set()  # raw elements that have no end tag any more
    n_named = 0
    in_link = False
    top = _Open("")

    def finish() -> None:
        if not pieces:
            return
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        if text:
            linked = sum(len(p.strip()) for p, link in pieces if link)
            size = sum(len(p.strip()) for p, _ in pieces)
            found.append((text, len(text.split()), linked / max(1, size), top.apart, top.article, top.named))
        pieces.clear()

    at = 0
    while token := _TOKEN.search(page, at):
        if token.start() > at and not top.silent:
            pieces.append((page[at : token.start()], in_link))
        at = token.end()
        if token["tag"] is None:
            raw = (token["raw"] or "").lower()
            if not raw:
                continue
            finish()
            if page[at - 2] == "/":
                continue
            end = None if raw in endless else _RAW_END[raw].search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(raw)
            if raw in ("textarea", "iframe"):
                stack.append(top := top._replace(tag=raw, silent=True))
                n_open[raw] += 1
            else:
                end = _HEAD_END.search(page, at)
                at = end.start() if end else len(page)
            continue
        tag = token["tag"].lower()
        if top.tag == "head" and tag not in HEAD and not token["close"]:
            n_open[stack.pop().tag] -= 1
            top = stack[-1] if stack else _Open("")
        if tag == "a":
            in_link = not token["close"]
        if tag == "br" and not top.silent:
            pieces.append((" ", in_link))
        if tag in INLINE:
            continue
        finish()
        if token["close"]:
            while n_open[tag]:
                closed = stack.pop().tag
                n_open[closed] -= 1
                if closed == tag:
                    break
            top = stack[-1] if stack else _Open("")
        elif tag not in VOID and not token["rest"].endswith("/"):
            if tag in ("article", "main"):
                articles.append(top.named)
            article = top.article or tag in ("article", "main")
            apart, named = _stands_apart(tag, token["rest"], article)
            around = top.named
            if named:
                n_named += 1
                around = (*around, n_named) if len(around) < MOST_NAMED else around
            top = _Open(tag, top.apart or apart, article, top.silent or tag in SILENT or tag == "head", around)
            stack.append(top)
            n_open[tag] += 1
    if at < len(page) and not top.silent:
        pieces.append((page[at:], in_link))
    finish()
    # A named container is the page's own if it holds the first article, or, without one, most of the text.
    own = set(articles[0]) if articles else set()
    if not articles:
        held: Counter[int] = Counter()
        for b in found:
            if not b[3]:
                held.update(dict.fromkeys(b[5], b[1]))
        total = sum(b[1] for b in found if not b[3])
        own = {k for k, n in held.items() if n > MOST_OF_PAGE * total}
    beside = -1 if articles else 0
    return [(*b[:3], int(b[3] or not own.issuperset(b[5])), 1 if b[4] else beside) for b in found]


def _stands_apart(tag: str, rest: str, article: bool) -> tuple[bool, bool]:
    """Whether an element is something else by its tag, role or hiding, and whether by the words of its class or id.

    An article's own header holds its title; any other header is the site's.
    """
    if tag in APART or tag == "header" and not article:
        return True, False
    if "=" not in rest and "hidden" not in rest.lower():
        return False, False
    named = False
    for name, *values in _ATTRIBUTE.findall(rest):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or name == "role" and value.lower() in APART_ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            named = named or any(map(_names_apart, value.split()))
    return False, named


def _names_apart(token: str) -> bool:
    words = [w.lower() for w in _WORD.findall(token)]
    if not words or words[-1] in NOT_LAST:
        return False
    return any(w in APART_WORDS and not (i and words[i - 1] in NOT_BEFORE) for i, w in enumerate(words))


def features(rows: Iterable[tuple[int, float, int, int]]) -> list[tuple[float, ...]]:
    """Features of each block from words, links, apart, article of it and its neighbours; none beyond the ends."""
    rows = list(rows)
    padded = [(0, 0.0), *[r[:2] for r in rows], (0, 0.0)]
    return [
        tuple(map(float, (*padded[i + 1], *padded[i], *padded[i + 2], -1 if apart else article)))
        for i, (_, _, apart, article) in enumerate(rows)
    ]


def train(spark: SparkSession, labelled: str = LABELLED, depth: int = 6) -> list:
    """A decision tree over FEATURES as nested [feature, threshold, low side, high side]; leaves are 0 or 1.

    Equal features can carry different labels; a leaf takes the label of most of its rows.
    """
    rows = []
    for page in labelled.strip().split("\n\n"):
        table = [line.split() for line in page.split("\n")]
        known = [(int(w), float(k), int(a), int(r)) for w, k, a, r, _ in table]
        rows += [(float(line[4]), Vectors.dense(f)) for line, f in zip(table, features(known), strict=True)]
    frame = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=7).fit(frame)
    lines = [x.strip() for x in model.toDebugString.split("\n")[1:] if x.strip()]

    def read() -> list | int:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return int(float(line.split(":")[1]))
        number, threshold = re.match(r"If \(feature (\d+) <= ([-+.\dE]+)\)", line).groups()
        low = read()
        lines.pop(0)  # Else
        return [FEATURES[int(number)], float(threshold), low, read()]

    return read()


def verdict(tree: list | int, block: Column) -> Column:
    """The tree as one expression over a block's fields."""
    if isinstance(tree, int):
        return F.lit(bool(tree))
    name, threshold, low, high = tree
    return F.when(block[name] <= threshold, verdict(low, block)).otherwise(verdict(high, block))


def extract(pages: DataFrame, tree: list | int, *, html_text: str = "html") -> DataFrame:
    """Add ``text``: the blocks that ``tree`` takes for the article, in page order, joined by line ends.

    Character references are decoded and white space inside a block becomes one space.  Null, empty and textless
    pages have the empty text.  Other columns stay; one named ``text`` is replaced.
    """

    def make() -> Callable:
        def one(page: str | None) -> list[dict]:
            found = blocks(page) if page else []
            made = features(b[1:] for b in found)
            return [{"text": b[0], **dict(zip(FEATURES, f, strict=True))} for b, f in zip(found, made, strict=True)]

        return lambda column: [[one(p) for p in column.to_pylist()]]

    block = T.StructType([T.StructField("text", T.StringType(), False)] + [T.StructField(n, T.DoubleType(), False) for n in FEATURES])
    fields = T.StructType([T.StructField("_blocks", T.ArrayType(block, False), False)])
    flat = annotate(pages, [html_text], make, fields)
    kept = F.filter("_blocks", lambda b: verdict(tree, b))
    return flat.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).drop("_blocks")
