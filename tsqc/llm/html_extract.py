"""HTML extraction: two-pass block rules.

A page is cut into blocks of text at block tags. First pass: blocks in elements for menus, forms and the like are bad, and so
are those in elements whose class or id names such a part, unless that element holds nearly all of the page's prose (a name
as has-sidebar says how the page is laid out); others are judged by length, stop-word density and link density, and short
ones stay open. Second pass: an open block takes the
label of its nearest decided neighbours (good only if all of them at the smaller distance, or both sides, agree; in an article good unless both sides are bad).

Defined results: a null or empty page, or one without good blocks, gives an empty text of 0 code points; repeated rows are
extracted each for itself; markup that never closes ends with the page; other columns pass through, and a clashing name gets a leading
underscore on the operator's column.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tsqc.llm.common import fresh, mapped

# Element names of HTML, marks of page furniture, and common words of four languages.
DROPPED = frozenset("script style noscript template svg iframe object canvas head title select option textarea button datalist audio video map math".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
READERS = frozenset("comment comments disqus replies reply".split())  # never the article, however long
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on one or our out she so that the their them there they this to up was we were what when which who will with would you your "
    "als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "à au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous y "
    "al algo como con de del desde el ella ellos en entre era es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero por porque que se sin sobre son su sus también un una y ya".split()
)

LONG = 140
STOPS_GOOD = 0.25
LINKS_BAD = 0.5
#: Share of the page's prose that no menu, notice or advert has, whatever its class is called.
MOST_PROSE = 0.8
WORD = re.compile(r"\w+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CLOSES = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select", "button", "head")}
SPACES = re.compile(r"\s+")


def _is_furniture(name: str, attrs: str, in_article: bool) -> bool:
    """By the element, its role or its being hidden."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    for key, *values in ATTRIBUTE.findall(attrs) if attrs else ():
        value = "".join(values).lower()
        key = key.lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
    return False


def _marks(name: str, attrs: str) -> set[str]:
    """Parts of its class and id names that stand for page furniture."""
    if name in ("html", "body", "article", "main"):
        return set()
    named = ("".join(values).lower() for key, *values in ATTRIBUTE.findall(attrs) if key.lower() in ("class", "id"))
    return {x for value in named for x in re.split(r"[\s_-]+", value) if x in MARKS}


Block = tuple[str, float, bool, bool]


def blocks(page: str) -> list[Block]:
    """(text, share of its characters in links, in furniture, in an article) in page order. Time is linear in the page."""
    out: list[Block] = []
    within: list[int] = []  # for each block, the innermost open element with marks
    marked: list[tuple[int, bool]] = []  # its parent of this kind, and whether it is the readers'
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements that matter, whether they are furniture, and whether they have marks
    opened: dict[str, int] = {}
    unclosed: set[str] = set()
    furniture = article = link = 0
    inner = -1
    at, n = 0, len(page)

    def end():
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, min(1.0, linked / len(text)), furniture > 0, article > 0))
                within.append(inner)
            parts.clear()
        linked = 0

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if text := m["text"]:
            parts.append(text)
            if link:
                linked += len(text.strip())
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, attrs = m["close"] or m["close2"] or "", m["attrs"] or m["attrs2"] or ""
        if name in DROPPED:
            if not closing and not attrs.endswith("/"):
                if name == "head":  # its content is dropped by its own elements; a missing end must not lose the page
                    continue
                if name in CLOSES:
                    end_at = None if name in unclosed else CLOSES[name].search(page, at)
                    if not end_at:
                        unclosed.add(name)  # nor is there an end further on
                    at = end_at.end() if end_at else (n if name in ("script", "style", "textarea") else at)
            parts.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name in INLINE and name != "span":
            if name in ("br", "img", "input", "wbr"):
                parts.append(" ")
            continue
        hard = not closing and _is_furniture(name, attrs, article > 0)
        marks = _marks(name, attrs) if attrs and not closing else set()
        if name == "span" and not (closing or hard or marks):
            continue
        end()
        link = 0
        if name in VOID:
            continue
        if closing:
            while opened.get(name):
                x, bad, has = stack.pop()
                opened[x] -= 1
                furniture -= bad
                article -= x in ("article", "main")
                inner = marked[inner][0] if has else inner
                if x == name:
                    break
        elif name != "p" and not attrs.endswith("/") or hard or marks:
            stack.append((name, hard, bool(marks)))
            opened[name] = opened.get(name, 0) + 1
            furniture += hard
            article += name in ("article", "main")
            if marks:
                marked.append((inner, bool(marks & READERS)))
                inner = len(marked) - 1
    end()
    return _without_marked(out, within, marked)


def _stops(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _without_marked(found: list[Block], within: list[int], marked: list[tuple[int, bool]]) -> list[Block]:
    """The blocks, where those in an element with marks are furniture too, unless it is what holds the page's prose."""
    if not marked:
        return found
    prose = [len(t) if not bad and len(t) >= LONG and links <= LINKS_BAD and _stops(t) >= STOPS_GOOD / 3 else 0 for t, links, bad, _ in found]
    readers = [False] * len(marked)
    for i, (parent, own) in enumerate(marked):
        readers[i] = own or parent >= 0 and readers[parent]
    articles = [i for i, x in enumerate(found) if x[3] and prose[i] and (within[i] < 0 or not readers[within[i]])]
    keep = [False] * len(marked)
    if not any(within[i] < 0 for i in articles):
        held = [0] * len(marked)
        total = 0
        for i in articles or range(len(found)):
            if within[i] < 0 or not readers[within[i]]:
                total += prose[i]
                if within[i] >= 0:
                    held[within[i]] += prose[i]
        for i in range(len(marked) - 1, -1, -1):
            if marked[i][0] >= 0:
                held[marked[i][0]] += held[i]
            keep[i] = total > 0 and held[i] >= MOST_PROSE * total
    bad = [False] * len(marked)
    for i, (parent, _) in enumerate(marked):
        bad[i] = not keep[i] or parent >= 0 and bad[parent]
    return [(t, links, f or w >= 0 and bad[w], a) for (t, links, f, a), w in zip(found, within)]


def classify(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    has_article = any(a and not f for _, _, f, a in found)
    label: list[bool | None] = []
    for text, links, furniture, article in found:
        stops = _stops(text)
        if furniture or links > LINKS_BAD or has_article and not article:
            label.append(False)
        elif len(text) >= LONG and (stops >= STOPS_GOOD or article):
            label.append(True)
        elif len(text) >= LONG and stops < STOPS_GOOD / 3:
            label.append(False)
        else:
            label.append(None)
    before: list[tuple[int, bool] | None] = []
    seen = None
    for i, x in enumerate(label):
        before.append(seen)
        if x is not None:
            seen = (i, x)
    out: list[bool] = [False] * len(label)
    seen = None
    for i in range(len(label) - 1, -1, -1):
        if label[i] is not None:
            out[i], seen = label[i], (i, label[i])
            continue
        near = [x for x in (before[i], seen) if x]
        if found[i][3]:  # inside an article the prose decides; only its own bad neighbours on both sides speak against a block
            inner = [x for x in near if found[x[0]][3]]
            out[i] = len(inner) < 2 or any(x for _, x in inner)
        elif near:
            nearest = min(abs(j - i) for j, _ in near)
            out[i] = all(x for j, x in near if abs(j - i) == nearest)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, good in zip(found, classify(found)) if good)


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """All columns of df but the page's source, with text and n_chars."""
    kept = [f for f in df.schema.fields if f.name != column]
    names = [fresh([f.name for f in kept], x) for x in ("text", "n_chars")]
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])
    n = len(kept)

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*b.schema.names[:n], *names])

    return df.select(*(f"`{f.name}`" for f in kept), f"`{column}`").transform(mapped, run, schema)
