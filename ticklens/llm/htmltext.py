"""Main text of web pages by a maximum-scoring subsequence (operator 10).

A page is a sequence of words and tags. Words score positive or negative by the element they stand
in, tags score negative; the weights are log odds of standing inside the article, learned from
labelled pages: a bounded sample (``SAMPLE_PAGES``) of pages whose markup names its article. A linear
scan finds the contiguous region with the largest sum. Words outside the article that a page
itself names, and words of menus, headers, footers, sidebars, notices, adverts, forms and reader
comments (by element, role or class), score negative; where such a part lies inside the region it
is left out of the text. Inside a named article such parts score nothing, so that a long one does not
cut the article in two; there a class or id counts only if all its words name such a part or a box
("newsletter-box", not "side-effects"), and one of ``DOUBTFUL_WORDS`` ("meta", "related") only if at least half
of the part's words are links or controls. Scripts, styles, comments and the head are never words.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by one space. Nothing else is dropped or capped. Broken markup is read as far as it
goes: an unclosed tag is closed by the end of an enclosing one. Null and empty pages, and pages
without a positive region, have the empty text. Pages are read one by one, so repeated or null
page_ids and further columns, whatever their names, change nothing, a page of any length is read whole
(memory: a few times its size), and an empty table has an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import text_of

#: labelled pages that the weights are learned from, at most
SAMPLE_PAGES = 2_000
#: weights that reach the driver, at most
MAX_WEIGHTS = 1_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    # a self-closed drawing or formula is empty
    r"""|<(?:svg|math)(?=[\s/])(?:"[^"]*"|'[^']*'|[^>"'])*+(?<=/)>"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|title|object|select)(?=[\s/>])"""
    r"""(?:(?:"[^"]*"|'[^']*'|[^>"'])*+|[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*+|[^>]*)>"""
    r"""|<[!?/][^>]*(?:>|\Z)""", re.S | re.I)

# FIXED VALUES: elements by kind
BLOCKS = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p
    pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE_ELEMENTS = frozenset("""aside button dialog footer form head header input label legend menu nav option
    select""".split())
SIDE_ROLES = frozenset("""alert banner button complementary contentinfo dialog form menu menubar navigation search
    tablist toolbar""".split())
SIDE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|menu\w*|nav|navbar|navigation|"
    r"breadcrumb\w*|crumbs|pagination|pager|header|masthead|topbar|footer|bottombar|copyright|sidebar\w*|side|aside|"
    r"widget\w*|related|recommend\w*|share|sharing|social|toolbar|comment\w*|replies|reply|respond|disqus|"
    r"reactions|form|search\w*|skip\w*|tags|meta)(?:$|[-_\s])", re.I)
#: elements that hold the content, whatever their names
CONTENT = frozenset(["html", "body", "article", "main"])
# FIXED VALUES: words of a class or id that say nothing of what is in a box
BOX_WORDS = frozenset("""area articles bar block bottom box center col column container content entry fixed group
    header inline inner item items js left link links list main mini nav outer page panel post posts right row
    section site slot small sticky strip top unit wrap wrapper""".split())
# FIXED VALUES: words that name a side part as often as a part of the article
DOUBTFUL_WORDS = frozenset("ad form meta notice related reply respond search share side social tags".split())
CONTROLS = frozenset(["a", "button", "label", "option"])
_NAME_WORD = re.compile(r"[^\W_]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
_NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: an opened element of these is closed by the next one of its set
_SELF_CLOSING = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
                 "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
                 "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def _attributes(source: str) -> dict[str, str]:
    """Values by lower-case name; the first of a repeated name counts, one without a value is empty."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), "".join(values).strip())
    return found


def _role(attrs: dict[str, str]) -> str:
    return (attrs.get("role", "").lower().split() or [""])[0]


def _names_article(attrs: dict[str, str]) -> bool:
    return attrs.get("itemprop", "").lower().startswith("articlebody") or _role(attrs) in ("article", "main")


def _is_hidden(attrs: dict[str, str]) -> bool:
    return (attrs.get("hidden", "false").lower() != "false" or attrs.get("aria-hidden", "").lower() == "true"
            or bool(_NOT_DISPLAYED.search(attrs.get("style", ""))))


def _is_side(name: str, attrs: dict[str, str]) -> bool:
    return name in SIDE_ELEMENTS or name not in CONTENT and bool(attrs) and (
        _role(attrs) in SIDE_ROLES or _is_hidden(attrs))


def _named_side(name: str, attrs: dict[str, str], in_article: bool) -> bool | None:
    """Whether class or id name a side part; None where its content has to tell (in an article)."""
    if name in CONTENT or not attrs:
        return False
    names = [attrs[key] for key in ("class", "id") if SIDE_NAMES.search(attrs.get(key, ""))]
    if not in_article or not names:
        return bool(names)
    doubt = False
    for token in " ".join(names).lower().split():
        words = _NAME_WORD.findall(token)
        kinds = [bool(SIDE_NAMES.search(w)) for w in words]
        if any(kinds) and all(k or w in BOX_WORDS or w.isdigit() for k, w in zip(kinds, words)):
            if any(k and w not in DOUBTFUL_WORDS for k, w in zip(kinds, words)):
                return True
            doubt = True
    return None if doubt else False


class Page:
    """A page as parallel lists: text (None for a tag), element, and where it stands."""

    def __init__(self, source: str):
        self.text: list[str | None] = []
        self.element: list[str] = []       # innermost element of a text, name of a tag
        self.side: list[bool] = []         # inside a part that is no content
        self.inside: list[bool] = []       # inside an article that the page names
        # name, opens a side part, opens an article, and for a doubtful part where it begins with the
        # numbers of words and of words in links or controls before it
        stack: list[tuple[str, bool, bool, tuple[int, int, int] | None]] = []
        sides = articles = controls = words = linked = at = 0

        def put(text, element):
            nonlocal words, linked
            if text is not None:
                n = len(text.split())
                words += n
                linked += n if controls else 0
            self.text.append(text)
            self.element.append(element)
            self.side.append(sides > 0)
            self.inside.append(articles > 0)

        def pop():
            nonlocal sides, articles, controls
            name, side, article, doubt = stack.pop()
            sides -= side
            articles -= article
            controls -= name in CONTROLS
            if doubt and 2 * (linked - doubt[2]) >= words - doubt[1]:
                self.side[doubt[0]:] = [True] * (len(self.side) - doubt[0])

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                put(source[at:m.start()], stack[-1][0] if stack else "")
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                if any(n == name for n, *_ in stack):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                put(None, name)
                continue
            while stack and stack[-1][0] in _SELF_CLOSING and name in _SELF_CLOSING[stack[-1][0]]:
                pop()
            attrs = m["attrs"] or ""
            named = _attributes(attrs) if attrs else {}
            article = name in ("article", "main") or _names_article(named)
            if name in ("article", "main", "body") and sides and not articles:
                # the content can't lie inside an unclosed menu or head
                while sides:
                    pop()
            put(None, name)
            if name not in VOID and not attrs.endswith("/"):
                by_name = _named_side(name, named, articles > 0 and not sides)
                side = _is_side(name, named) or bool(by_name)
                doubt = (len(self.text), words, linked) if by_name is None and not side else None
                # a reader's comment is an article inside a part of its own
                stack.append((name, side, article and not sides, doubt))
                controls += name in CONTROLS
                sides += side
                articles += article and not (sides - side)
        if at < len(source):
            put(source[at:], stack[-1][0] if stack else "")
        while stack:
            pop()
        self.named = any(self.inside)


def evidence(page: Page) -> Counter:
    """(feature, inside) counts of a page that names its article: words by element, tags by name."""
    counts: Counter = Counter()
    for text, element, side, inside in zip(page.text, page.element, page.side, page.inside):
        content = inside and not side
        if text is None:
            counts[f"<{element}>", content] += 1
        else:
            counts[element, content] += len(text.split())
    return counts


def main_text(source: str, weights: dict[str, float]) -> str:
    """Text of the region with the largest sum of scores."""
    page = Page(source)
    best = total = 0.0
    region, start = (0, 0), 0
    for i, (text, element, side, inside) in enumerate(zip(page.text, page.element, page.side, page.inside)):
        if side and inside:
            score = 0.0                    # left out of the text, whatever its size
        elif text is None:
            score = min(-0.02, weights.get(f"<{element}>", -0.1)) if not inside else -0.02
        else:
            score = max(0.2, weights.get(element, 1.0)) if inside else weights.get(element, 0.5)
            if side:
                score = -1.0
            elif page.named and not inside:
                score = min(score, 0.0) - 1.0
            score *= len(text.split())
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    blocks: list[str] = []
    block: list[str] = []
    for i in range(*region):
        if page.text[i] is None:
            if page.element[i] in BLOCKS:
                blocks.append("".join(block))
                block = []
        elif not page.side[i]:
            block.append(page.text[i])
    blocks.append("".join(block))
    cleaned = (" ".join(entities.unescape(b).split()) for b in blocks)
    return " ".join(filter(None, cleaned))


def learned_weights(pages: DataFrame) -> dict[str, float]:
    """Log odds per feature, from a bounded sample of the pages that name their article."""
    sample = (pages.select("page_id", text_of("html").alias("html"))
              .where(F.lower("html").contains("<article")).select("page_id", F.xxhash64("page_id").alias("h"))
              .distinct().orderBy("h", "page_id").limit(SAMPLE_PAGES))
    # a page_id that is repeated gives one page, the smallest, so the pages are as bounded as the ids
    chosen = (pages.select("page_id", text_of("html").alias("html")).join(F.broadcast(sample.select("page_id")), "page_id")
              .groupBy("page_id").agg(F.min("html").alias("html")).select("html"))

    def count(frames):
        counts: Counter = Counter()
        for frame in frames:
            for source in frame["html"]:
                page = Page(source)
                if page.named:
                    counts.update(evidence(page))
        yield pd.DataFrame([(f, n if inside else 0, 0 if inside else n) for (f, inside), n in counts.items()],
                           columns=["feature", "inner", "outer"])

    rows = (chosen.mapInPandas(count, "feature string, inner long, outer long").groupBy("feature")
            .agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer"))
            .orderBy(F.desc(F.col("inner") + F.col("outer")), "feature").limit(MAX_WEIGHTS).collect())
    return {r["feature"]: max(-3.0, min(3.0, math.log((r["inner"] + 1) / (r["outer"] + 1)))) for r in rows}


def text_column(source: Column, weights: dict[str, float]) -> Column:
    """Main text of each page source."""

    @F.pandas_udf("string")
    def extract(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, weights) if s else "" for s in sources], dtype="object")

    return extract(source)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of ``pages``."""
    weights = learned_weights(pages)
    return (pages.select("page_id", "url", text_column(text_of("html"), weights).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
