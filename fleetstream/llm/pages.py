"""Main text of web pages by a conditional random field over the leaf blocks of their element tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.llm.common import bounded_sample
from fleetstream.llm.crf import ChainCrf, Sequences

#: Fixed values of HTML: elements that run in a line of text, have no end tag, hold no page text, and end an open paragraph.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea select option button svg annotation iframe title head canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
MARKED = re.compile(r"(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
NAME = re.compile(r"[a-z]+")

#: Space of the hashed features; pages of the table the field is fitted on, at most.
SPACE, FIT_PAGES = 1 << 14, 400
SEMANTIC = ("article", "main")
#: Elements around a block, nearest ones, whose tags count; elements with names whose names count.
NEAR, NAMED = 12, 64


@dataclass(frozen=True)
class Around:
    """The block elements around a place, from the outside in, as far as they are looked at: each opening adds a bounded amount.

    ``near`` are the nearest tags, ``plain`` the nearest without article and
    main, ``tags`` all of them as a set, ``named`` the nearest sets of names
    from class, id and role.
    """

    near: tuple[str, ...] = ()
    plain: tuple[str, ...] = ()
    tags: frozenset[str] = frozenset()
    named: tuple[frozenset[str], ...] = ()
    mark: str = ""

    def inside(self, tag: str, names: frozenset[str], mark: str) -> Around:
        return Around(
            (*self.near, tag)[-NEAR:], self.plain if tag in SEMANTIC else (*self.plain, tag)[-NEAR:], self.tags if tag in self.tags else self.tags | {tag},
            (*self.named, names)[-NAMED:] if names else self.named, mark or self.mark,
        )


@dataclass
class Block:
    """A leaf block: its text, the elements around it, their names, and what share of the text is in links."""

    text: str
    around: Around
    names: frozenset[str]
    linked: int = 0

    @property
    def mark(self) -> str:
        return self.around.mark


@dataclass
class _Open:
    tag: str
    around: Around
    silent: bool
    inline: bool = field(default=False)


def _hidden(attributes: str) -> bool:
    """Whether an element is hidden: by the attribute of that name, by aria-hidden, or by its style; words in other values don't count."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for name, *values in ATTRIBUTE.findall(low):
        value = "".join(values).strip()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and NO_DISPLAY.search(value):
            return True
    return False


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks with visible text, in page order.

    Text between two borders of block elements is one block; inline elements do
    not break it, a line break is white space. References are decoded, white
    space becomes one space. Unclosed and stray tags are tolerated; comments,
    scripts, styles, forms' controls and hidden parts have no text.
    """
    out: list[Block] = []
    if not page:
        return out
    stack: list[_Open] = []
    parts: list[str] = []
    opened: Counter[str] = Counter()
    linked = at = 0
    end = len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                around = stack[-1].around if stack else Around()
                out.append(Block(text, around, frozenset().union(*around.named), min(linked, len(text))))
            parts.clear()
        linked = 0

    def shut(k: int) -> None:
        opened.subtract(o.tag for o in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1].silent):
            parts.append(text)
            if any(o.tag == "a" for o in stack[-4:]):
                linked += len(text)

    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                if tag not in INLINE and tag not in SILENT:
                    flush()
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            elif tag == "p" or tag not in INLINE and tag not in VOID:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag not in ("wbr", "img", "input"):
                flush()
            continue
        inline = tag in INLINE or tag in SILENT and tag != "head"
        if not inline:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[k].tag, ()):
                    shut(k)
                    break
                if not stack[k].inline:
                    break
        found = MARKED.findall(m[3]) if m[3] else []
        names = frozenset(w for kind, *v in found if kind.lower() != "data-label" for w in NAME.findall("".join(v).lower()))
        mark = next(("".join(v) for kind, *v in found if kind.lower() == "data-label"), "")
        silent = tag in SILENT or bool(stack and stack[-1].silent) or bool(m[3] and _hidden(m[3]))
        if m[3].rstrip().endswith("/") and tag not in BLOCKS and not inline and tag not in RAW:
            continue
        if tag in RAW:  # nothing inside is markup
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        around = stack[-1].around if stack else Around()
        stack.append(_Open(tag, around if inline else around.inside(tag, names, mark), silent, inline))
        opened[tag] += 1
    flush()
    return out


def _number(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % SPACE


_NUMBERS: dict[str, int] = {}


def features(blocks: list[Block], semantic: bool = True) -> list[list[int]]:
    """Hashed features of each block: ancestors, names of ancestors, and shape of the text. ``semantic``: whether article and main count."""
    out = []
    n = len(blocks)
    for k, b in enumerate(blocks):
        words = b.text.split(" ")
        path = b.around.near if semantic else b.around.plain
        names = {f"in:{t}" for t in path} | {f"name:{x}" for x in b.names if len(x) < 24}
        names.add(f"tag:{path[-1] if path else ''}")
        names.add(f"words:{min(len(words).bit_length(), 8)}")
        names.add(f"links:{round(4 * b.linked / len(b.text))}")
        names.add(f"ends:{b.text[-1] if b.text[-1] in '.!?:;,' else 'other'}")
        names.add(f"marks:{min(3, sum(b.text.count(c) for c in '.!?'))}")
        names.add(f"copy:{'©' in b.text}")
        names.add(f"place:{'first' if k == 0 else 'last' if k == n - 1 else 'mid'}")
        row = []
        for x in names:
            if x not in _NUMBERS:
                if len(_NUMBERS) > 100_000:
                    _NUMBERS.clear()
                _NUMBERS[x] = _number(x)
            row.append(_NUMBERS[x])
        out.append(sorted(set(row)))
    return out


#: Names of parts that are not main text, even inside an article or main element of a page that labels itself.
OTHER = frozenset("ad ads advert comment comments cookie menu newsletter notice promo related share sidebar social".split())

#: Labelled layouts. Braces stand for text: {t} a title, {p} a paragraph, {s} a short phrase, {l} a list of links. Marks: c content, x other.
LAYOUTS = [
    '<body><header data-label="x"><div class="logo">{s}</div><nav>{l}</nav></header><div class="content" data-label="c"><h1>{t}</h1><p>{p}</p><p>{p}</p><ul><li>{s}</li><li>{p}</li></ul><p>{p}</p></div><div class="sidebar" data-label="x"><h3>{s}</h3>{l}<p>{p}</p></div><footer data-label="x"><p>{s}</p></footer></body>',
    '<body><div id="nav" class="menu" data-label="x">{l}</div><div class="cookie-notice" data-label="x"><p>{p}</p></div><main data-label="c"><h1>{t}</h1><p>{p}</p><div class="ad advert" data-label="x">{p}</div><p>{p}</p><blockquote>{p}</blockquote></main><div class="comments" data-label="x"><h2>{s}</h2><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></div></body>',
    '<body><table><tr><td data-label="x">{l}</td><td data-label="c"><h1>{t}</h1><p>{p}</p><p>{p}</p></td></tr></table><div class="footer" data-label="x">© {s}</div></body>',
    '<body><article data-label="c"><header><h1>{t}</h1></header><p>{p}</p><h2>{t}</h2><p>{p}</p><aside class="related promo" data-label="x"><h4>{s}</h4>{l}</aside><p>{p}</p></article><section id="comments" class="reader-comments" data-label="x"><p>{p}</p><p>{s}</p></section><form data-label="x"><p>{s}</p><label>{s}</label></form></body>',
    '<body><div class="banner ad" data-label="x">{p}</div><div class="post entry" data-label="c"><h1>{t}</h1><p>{p}</p><p>{p}</p><pre>{p}</pre></div><div class="share social" data-label="x"><span>{s}</span></div><aside data-label="x"><p>{p}</p></aside><div class="newsletter subscribe notice" data-label="x"><p>{p}</p></div><footer data-label="x"><ul>{l}</ul><p>{s}</p></footer></body>',
    '<body><nav data-label="x"><ul>{l}</ul></nav><div class="ad" data-label="x">{p}</div><article data-label="c"><h1>{t}</h1><p>{p}</p><p>{p}</p><p>{p}</p></article><div class="consent gdpr" data-label="x">{s}</div><footer data-label="x">© {s} {p}</footer></body>',
]


def labelled_pages(rounds: int = 8) -> list[str]:
    """Pages from ``LAYOUTS`` with pseudorandom texts; ``data-label`` marks what their blocks are."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 10)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    fill = {
        "{t}": lambda: phrase(3, 12), "{s}": lambda: phrase(1, 6), "{p}": lambda: ". ".join(phrase(1, 14).capitalize() for _ in range(rng.integers(1, 6))) + ".",
        "{l}": lambda: "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(rng.integers(2, 7))),
    }
    return [re.sub(r"\{[tspl]\}", lambda m: fill[m[0]](), layout) for _ in range(rounds) for layout in LAYOUTS]


def _marked(blocks: list[Block]) -> list[int] | None:
    """1 for content by the marks of a labelled page, or by the article or main element of a page that has one with text."""
    if any(b.mark for b in blocks):
        return [int(b.mark == "c") for b in blocks]
    inside = [not b.around.tags.isdisjoint(SEMANTIC) and b.around.tags.isdisjoint(("nav", "aside", "footer", "form")) and not b.names & OTHER for b in blocks]
    return [int(x) for x in inside] if any(inside) else None


def train(pages: DataFrame, most: int = FIT_PAGES) -> ChainCrf:
    """A field fitted on the labelled layouts and on at most ``most`` pages of the table that label themselves by article or main elements.

    Each page counts twice, with these elements among the features and without,
    so that the rest of a page's shape is learned too.
    """
    ids = bounded_sample(pages.select(F.col("page_id").cast("long").alias("page_id")).dropna().distinct(), "page_id", most)
    html_of = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "page_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = leaf_blocks(page)
                if blocks and (gold := _marked(blocks)):
                    rows += [(i, gold, features(blocks, semantic)) for semantic in (True, False)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "gold", "features"])

    rows = html_of.select("page_id", "html").mapInArrow(describe, "page_id long, gold array<int>, features array<array<int>>").collect()
    sequences, gold = [], []
    for r in sorted(rows):
        sequences.append(r.features)
        gold += r.gold
    for page in labelled_pages():
        blocks = leaf_blocks(page)
        for semantic in (True, False):
            sequences.append(features(blocks, semantic))
            gold += _marked(blocks)
    return ChainCrf(SPACE).fit(Sequences.of(sequences), np.array(gold), penalty=0.3)


def main_text(pages: DataFrame, crf: ChainCrf) -> DataFrame:
    """(page_id, url, text, n_chars, blocks, content_blocks): the main text of each page, a row per row.

    text joins the blocks that Viterbi marks as content by one space; nothing
    else is dropped. Null and empty pages, and pages without text, give the
    empty string; long pages are read whole; repeated rows are treated alike;
    an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                blocks = [leaf_blocks(p) for p in part.column(2).to_pylist()]
                marks = crf.decode(Sequences.of([features(b) for b in blocks]))
                at, texts, content = 0, [], []
                for b in blocks:
                    mine = [x.text for x, m in zip(b, marks[at : at + len(b)], strict=True) if m]
                    at += len(b)
                    texts.append(" ".join(mine))
                    content.append(len(mine))
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int32()), pa.array(content, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "blocks", "content_blocks"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, blocks int, content_blocks int")
