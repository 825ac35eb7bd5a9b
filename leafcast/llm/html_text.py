"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass classifies each block by where it stands (menus, headers, footers, notices, adverts, forms and
comments by element, role, class and id), else by its length, link density and stop-word density. Short blocks stay ambiguous, and so do blocks of an article whose
density speaks against it. In the second pass these inherit from their nearest decided neighbours. Both passes see every page and every block, in an article or not.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, map_batches

#: Elements that begin and end blocks, elements whose content is no text, elements without content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video map select textarea button head title noframes noembed xmp".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that hold no main text.
ASIDE = frozenset("nav footer aside form menu dialog header search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset("article main".split())
#: Words of class and id names that mark a part as no main text, and those that clear it.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets "
    "related recommended share sharing social comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form "
    "pagination pager toolbar skip copyright legal".split()
)
NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")


def _stop_words() -> frozenset[str]:
    """Frequent function words of English, German, French and Spanish."""
    english = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after our just where most know"
    german = "der die das und ist von mit den auf für nicht ein eine im dem zu sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei"
    french = "le la les de des du un une et est que qui en dans pour pas sur au avec il ce se ne son plus par je sa mais on nous vous ou leur ont cette elle comme sont aux ces fait bien été même tout"
    spanish = "el la los las de del un una y que en es por con para se no su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está"
    return frozenset(" ".join((english, german, french, spanish)).split())


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass, for blocks whose place says nothing: lengths in code points, densities in words."""

    short: int = 70
    long: int = 200
    links: float = 0.33
    stop_low: float = 0.15
    stop_high: float = 0.30
    #: Ambiguous neighbours further off than this many blocks don't count.
    reach: int = 10
    stop_words: frozenset[str] = field(default_factory=_stop_words)


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    #: "main", "aside" or "" by the elements around it.
    place: str
    #: Elements around it that are aside by their names or as a form, down to the innermost article and within that.
    outer: tuple[int, ...] = ()
    inner: tuple[int, ...] = ()


def _marked(attributes: str) -> str:
    """"aside" where a role or style says so, "name" where only words of class or id do."""
    named = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if any(w.lower() in ASIDE_NAMES for w in NAME_WORD.findall(value)):
                named = "name"
        elif name == "role" and value.lower() in ASIDE_ROLES:
            return "aside"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "aside"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return "aside"
    return named


def settle(found: list[Block], rules: Rules) -> None:
    """Names and forms make a part aside unless it is a wrapper: the article, or what text there is, lies inside it.

    An article counts by how many marks it lies in, its own included. Those in the fewest are the page's if they hold a long block's length of text; a comment or teaser
    in a marked part beside them stays aside. Marks around the page's article are void. Text outside all marks that outweighs a marked article keeps the marks. A page
    without an article reads on from its least marked parts that hold so much text; their densities then decide.
    """
    marks = [len(b.outer) + len(b.inner) for b in found]
    article: dict[int, int] = {}
    other: dict[int, int] = {}
    for b, k in zip(found, marks, strict=True):
        if b.place != "aside" and not b.heading:
            held = article if b.place == "main" and not b.inner else other
            held[k] = held.get(k, 0) + len(b.text) - b.linked
    level = next((k for k in sorted(article) if article[k] >= rules.long), min(article, default=None))
    if level is None:
        level = next((k for k in sorted(other) if other[k] >= rules.long), 0)
        void = {m for b, k in zip(found, marks, strict=True) if b.place != "aside" and k <= level for m in b.outer + b.inner}
    else:
        if other.get(0, 0) >= max(rules.long, article[level]):
            level = 0
        void = {m for b, k in zip(found, marks, strict=True) if b.place == "main" and not b.inner and k <= level for m in b.outer}
    for b in found:
        if not void.issuperset(b.outer + b.inner):
            b.place = "aside"


def blocks(page: str, rules: Rules | None = None) -> list[Block]:
    """Blocks with text and their places, in page order. Unclosed and misnested elements end with the nearest open one of that name, or with the page."""
    out: list[Block] = []
    stack: list[tuple[str, str, tuple[int, ...], tuple[int, ...]]] = []  # open elements with their place and marks
    parts: list[str] = []
    state = {"linked": 0, "heading": False, "links": 0, "silent": 0, "breaks": 0}

    def flush() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, state["linked"], state["heading"], *(stack[-1][1:] if stack else ("",))))
        parts.clear()
        state.update(linked=0, heading=False, breaks=0)

    def say(raw: str) -> None:
        if raw and not state["silent"]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["links"]:
                state["linked"] += len(SPACE.sub(" ", text).strip())
            if not text.isspace():
                state["breaks"] = 0
                state["heading"] = state["heading"] or any(len(n) == 2 and n[0] == "h" and n[1] in "123456" for n, *_ in stack[-3:])

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCKS:
                flush()
            if depth is not None:
                for n, *_ in stack[depth:]:
                    state["silent"] -= n in SILENT
                    state["links"] -= n == "a"
                del stack[depth:]
            continue
        if name == "br":
            parts.append(" ")
            state["breaks"] += 1
            if state["breaks"] > 1:
                flush()
            continue
        if name in BLOCKS:
            flush()
            _close_implied(stack, name)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        _, place, outer, inner = stack[-1] if stack else ("", "", (), ())
        mark = _marked(m[3]) if name not in ("html", "body") else ""
        if name in ASIDE and name != "form" and not (name == "header" and place == "main") or mark == "aside":
            place = "aside"
        elif place != "aside":
            if mark or name == "form":
                inner = (*inner, at)
            if name in MAIN:
                place, outer, inner = "main", outer + inner, ()
        stack.append((name, place, outer, inner))
        state["silent"] += name in SILENT
        state["links"] += name == "a"
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            if name not in SILENT:
                say(page[at : close.start() if close else end])
            at = close.start() if close else end
    flush()
    settle(out, rules or Rules())
    return out


def _close_implied(stack: list[tuple], name: str) -> None:
    """A new paragraph, list item, row or cell ends an open one of its kind, where HTML lets the end tag be left out."""
    alike = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
    fences = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
    for i in range(len(stack) - 1, -1, -1):
        n = stack[i][0]
        if n == "p" and name in BLOCKS:
            del stack[i]
            return
        if n in alike.get(name, ()):
            del stack[i]
            return
        if n in fences.get(name, ()) or n in ("div", "article", "section", "main", "body", "table", "ul", "ol", "a"):
            return


def first_pass(block: Block, rules: Rules) -> str:
    """good, bad, near (to good), or short: the last two are ambiguous. An article's element is evidence for its blocks: links decide against it, but a low stop-word density
    or a small length leaves them near, as it may be a list, a table or another language."""
    if block.place == "aside":
        return "bad"
    words = block.text.split()
    density = sum(w.strip(string.punctuation).lower() in rules.stop_words for w in words) / len(words)
    links = block.linked / len(block.text)
    if block.place == "main":
        if links > rules.links and not block.heading:
            return "bad"
        return "good" if density >= rules.stop_low and len(block.text) >= rules.short and links <= rules.links else "near"
    if links > rules.links:
        return "bad"
    if "©" in block.text:
        return "bad"
    if len(block.text) < rules.short:
        return "bad" if links > 0 and density < rules.stop_low else "short"
    if density >= rules.stop_high:
        return "good" if len(block.text) > rules.long else "near"
    return "near" if density >= rules.stop_low else "bad"


def _neighbours(found: list[Block], decided: list[str], reach: int) -> list[str]:
    """Label of the nearest decided block before each one, within reach. Blocks of an article look at blocks of articles alone: menus around it say nothing on it."""
    out, last, inside = [], ("", -1), ("", -1)
    for i, (b, label) in enumerate(zip(found, decided, strict=True)):
        near = inside if b.place == "main" else last
        out.append(near[0] if i - near[1] <= reach else "")
        if label:
            last = (label, i)
            if b.place == "main":
                inside = last
    return out


def second_pass(found: list[Block], first: list[str], rules: Rules) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbours. Where these differ, a `near` block is good, a heading follows what comes after it, and any
    other short block is bad; without a decided neighbour `near` blocks are good, and headings are where an article holds them."""
    decided = [c if c in ("good", "bad") else "" for c in first]
    before = _neighbours(found, decided, rules.reach)
    after = _neighbours(found[::-1], decided[::-1], rules.reach)[::-1]
    out = []
    for i, b in enumerate(found):
        if decided[i]:
            out.append(decided[i] == "good")
        elif before[i] == after[i] and before[i]:
            out.append(before[i] == "good")
        elif b.heading:
            out.append(after[i] == "good" or not after[i] and b.place == "main")
        else:
            out.append(first[i] == "near")
    return out


def main_text(page: str | None, rules: Rules) -> str:
    found = blocks(page or "", rules)
    good = second_pass(found, [first_pass(b, rules) for b in found], rules)
    return "\n\n".join(b.text for b, ok in zip(found, good, strict=True) if ok)


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page (columns page_id, url, html).

    The whole page is read, whatever its length. Null and empty pages, and pages without main text, give an empty text; malformed markup ends with the page;
    repeated rows give repeated results. One pass, no shuffle; memory of a task: one page and its blocks at a time.
    """
    rules = rules or Rules()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, "html"):
            texts = [main_text(p.as_py(), rules) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select("page_id", "url", "html")
    return map_batches(picked, run, f"page_id {picked.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
