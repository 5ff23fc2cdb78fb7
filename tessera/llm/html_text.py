"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the borders of block
elements. Each block is described by its ancestors' tags and class words, by its
own tag and by its text (length, share in links, closing mark, stock words). The
field labels the blocks of a page in order as main text or other; it is trained
on labelled pages (``labelled_pages``) and decoded by Viterbi.

Defined results for odd input: null and empty pages have an empty text; broken
markup closes at the next border (an unclosed script, style or comment hides
the rest of the page, as in browsers); nesting has no limit; very long pages are
read whole; repeated rows give their rows; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.crf import ChainModel, train

# HTML elements by their part in the page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html label legend li main menu nav noscript ol option p pre section select summary svg table tbody td template tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSES_SAME = frozenset("p li dd dt tr td th option".split())
# Class and id words by what they tell.
CLASS_CUES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar tabs pagination pager toc",
    "head": "header masthead banner branding logo sitename",
    "foot": "footer copyright legal colophon",
    "side": "sidebar side aside widget widgets rail related recommended more popular trending",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion promoted banner-ad adsense",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall",
    "talk": "comment comments reply replies disqus discussion respond reader reactions",
    "form": "form search newsletter subscribe signup login share social sharing follow",
    "main": "content article post entry story main body text article-body post-content entry-content",
}
_CLASS = {w: k for k, words in CLASS_CUES.items() for w in words.split()}
STOCK = {
    "sell": "buy shop sale offer discount deal sponsored advertisement ad subscribe newsletter",
    "tell": "cookies cookie consent accept privacy",
    "chat": "reply replied posted commented says comment comments upvote",
    "right": "© copyright rights reserved terms",
    "go": "home next previous login share follow search menu read more",
}
_STOCK = {w: k for k, words in STOCK.items() for w in words.split()}
# A quoted value may hold < and >, if what follows its end can follow a value; else the quote is a stray one and the tag ends at the next >.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*"|'[^']*')(?=[\s/>])|[^<>"']|"[^"<]*"|'[^'<]*')*+)[^<>]*>?""")
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[\s_]+")
_RAW_END = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in RAW}
LABELS = ["other", "main"]
LABEL_MARK = "\ue002"


def _class_words(attributes: str) -> tuple[str, ...]:
    """Cue classes of an element's class, id and role."""
    out = set()
    for m in _ATTR.finditer(attributes):
        for word in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()):
            cue = _CLASS.get(word)
            if cue:
                out.add(cue)
            else:
                out.update(_CLASS[w] for w in word.split("-") if w in _CLASS)
    return tuple(sorted(out))


def _held(stack: list) -> tuple:
    """The ancestors; of more than 64, those alike past the third count once, at their innermost place, so unclosed pages stay small."""
    return tuple(stack) if len(stack) <= 64 else (*stack[:3], *reversed(dict.fromkeys(reversed(stack[3:]))))


def leaf_blocks(page: str) -> list[tuple[str, float, tuple[tuple[str, tuple[str, ...]], ...]]]:
    """(text, share of its letters in links, ancestors from outside in) of each block that has text."""
    out, stack, runs, linked, in_link = [], [], [], 0, False

    def border():
        nonlocal linked, in_link
        if runs:
            text = " ".join(entities.unescape("".join(runs)).split())
            if text:
                out.append((text, min(1.0, linked / max(1, sum(map(len, runs)))), _held(stack)))
            runs.clear()
        linked, in_link = 0, False

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        mark = size if mark < 0 else mark
        if mark > at:
            runs.append(page[at:mark])
            linked += (mark - at) * in_link
        if mark == size:
            break
        if page.startswith("<!--", mark):
            stop = page.find("-->", mark + 4)
            at = size if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            stop = page.find(">", mark)
            at = size if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, mark)
        if not m:
            runs.append("<")
            at = mark + 1
            continue
        at, closing, name = m.end(), bool(m[1]), m[2].lower()
        if name in RAW:
            if not closing:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else size
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            runs.append(" ")
        elif name in BLOCKS:
            border()
            if closing:
                if any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
            elif name not in VOID:
                if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in CLOSES_SAME)):
                    stack.pop()
                stack.append((name, _class_words(m[3]) if m[3] else ()))
    border()
    return out


def block_features(text: str, linked: float, ancestors: tuple) -> tuple:
    words = text.split(" ", 64)
    n = len(words)
    out = {"bias", f"tag={ancestors[-1][0] if ancestors else ''}", f"links={int(linked * 3.99)}"}
    out.add("words=" + ("1" if n < 3 else "3" if n < 10 else "10" if n < 30 else "30"))
    out.add("mark" if text[-1] in ".!?…:”\"" else "nomark")
    for name, cues in ancestors:
        if name not in ("html", "body", "p", "div"):
            out.add("in=" + name)
        out.update("class=" + c for c in cues)
    told = [c for _, cues in ancestors for c in cues]
    if told:
        out.add("inmost=" + told[-1])
    names = [name for name, _ in ancestors]
    if set(told) - {"main"} or {"nav", "footer", "form", "aside", "button", "label", "select"} & set(names) or ("header" in names and not {"article", "main"} & set(names)):
        out.add("aside")
    if n < 30:
        out.update("stock=" + _STOCK[w] for w in {w.strip(".,:!?").lower() for w in words} if w in _STOCK)
    if len(ancestors) < 3:
        out.add("shallow")
    return tuple(sorted(out))


def labelled_pages(count: int, seed: int) -> list[list[tuple[str, str]]]:
    """The labelled pages: for each the parts of its markup in order, each with "main", "other" or "" (no text of its own)."""
    rng = random.Random(seed)
    pieces = "an er ti on re th es la de ou que ci ar ei ung lich tre men ado ie st or ha nd".split()

    def words(lo, hi):
        said = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        said[0] = said[0].capitalize()
        return " ".join(said)

    def text(lo, hi):
        return words(lo, hi) + rng.choice([".", ".", ".", "", "!", "?"])

    def one(*options):
        return rng.choice(options)

    def wrap(name, attributes, inner):
        closed = name != "article" or rng.random() < 0.9
        return [(f"<{name}{attributes}>", ""), *inner, *([(f"</{name}>", "")] if closed else [])]

    def links(lo, hi, tag="li"):
        return [(f'<{tag}><a href="/x">{words(1, 3)}</a></{tag}>', "other") for _ in range(rng.randint(lo, hi))]

    def menu():
        inner = wrap("ul", "", links(3, 8))
        return wrap("nav", one("", ' class="main-nav"'), inner) if rng.random() < 0.6 else wrap("div", one(' class="menu"', ' id="navbar"', ' class="breadcrumb"', ' role="navigation"'), inner)

    def header():
        inner = [(f"<{one('h1', 'p', 'div', 'h2')}>{words(1, 5)}", "other"), *(links(0, 3, "div"))]
        return wrap("header", one("", ' class="site-header"'), inner) if rng.random() < 0.7 else wrap("div", one(' class="header"', ' id="masthead"'), inner)

    def footer():
        inner = [(f"<p>{one('&copy; ', '© ', 'Copyright ', '')}{words(2, 12)} {one('All rights reserved', '&middot; ' + text(3, 20), '')}</p>", "other"), *links(0, 4)]
        bare = [(f"&copy; {words(1, 3)} &middot; {text(3, 25)}", "other")]
        return wrap(*one(("footer", ""), ("footer", ' class="footer"'), ("div", ' id="footer"')), one(inner, bare))

    def advert():
        inner = [(f"<p>{text(3, 30)}</p>", "other")] if rng.random() < 0.4 else [(text(3, 30), "other")]
        return wrap(*one(("div", ' class="ad"'), ("div", ' class="advert"'), ("aside", ' class="sponsored"'), ("div", ' id="ads"'), ("section", ' class="promo"'), ("div", ' class="ad-banner"')), inner)

    def sidebar():
        inner = [(f"<h3>{words(1, 3)}</h3>", "other"), *wrap("ul", "", links(2, 6)), (f"<p>{text(5, 40)}</p>", "other")]
        return wrap(*one(("aside", ""), ("aside", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="related"'), ("div", ' class="widget"')), inner)

    def notice():
        inner = [(f"<p>{one('We use cookies. ', '', 'Accept cookies: ')}{text(3, 30)}</p>", "other"), (f"<button>{words(1, 2)}</button>", "other")]
        return wrap("div", one(' class="cookie-notice"', ' id="consent"', ' class="notice"', ' class="popup"', ' role="alert"'), inner[: rng.randint(1, 2)])

    def form():
        inner = [(f"<label>{words(1, 4)}</label>", "other"), ('<input name="q">', ""), (f"<button>{words(1, 2)}</button>", "other")]
        if rng.random() < 0.5:
            inner.insert(0, (f"<p>{text(3, 20)}</p>", "other"))
        if rng.random() < 0.3:
            inner.append((f"<select><option>{words(1, 2)}</option><option>{words(1, 2)}</option></select>", "other"))
        return wrap("form", one("", ' class="newsletter"', ' id="search"'), inner)

    def comments():
        inner = [(f"<h3>{one('Comments', words(1, 3))}</h3>", "other")] if rng.random() < 0.6 else []
        for _ in range(rng.randint(1, 6)):
            body = [(f"<p>{text(4, 60)}</p>", "other")]
            if rng.random() < 0.4:
                body.insert(0, (f"<div>{words(1, 2)} {one('says', 'replied', 'posted')}:</div>", "other"))
            inner += wrap(*one(("div", ' class="comment"'), ("li", ""), ("article", ' class="comment"'), ("div", "")), body)
        return wrap(*one(("section", ' class="comments"'), ("div", ' id="comments"'), ("ol", ' class="comment-list"'), ("div", ' class="discussion"')), inner)

    def paragraph():
        r = rng.random()
        if r < 0.62:
            return [(f"<p>{text(2, 90)}</p>", "main")]
        if r < 0.70:
            return [(f"<p>{text(1, 3)}</p>", "main")]
        if r < 0.76:
            return [(f"<h2>{words(1, 7)}</h2>", "main")]
        if r < 0.83:
            return wrap(one("ul", "ol"), "", [(f"<li>{text(1, 20)}</li>", "main") for _ in range(rng.randint(2, 5))])
        if r < 0.88:
            return [(f"<blockquote>{text(4, 40)}</blockquote>", "main")]
        if r < 0.91:
            return [(f"<pre>{words(3, 20)}</pre>", "main")]
        if r < 0.95:
            return [(f'<p>{words(3, 20)} <a href="/y">{words(1, 3)}</a> {text(3, 30)}</p>', "main")]
        if r < 0.97:
            return wrap("figure", "", [('<img src="x">', ""), (f"<figcaption>{text(3, 12)}</figcaption>", "main")])
        return wrap("table", "", [(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>", "main") for _ in range(2)])

    def article():
        inner = [(f"<h1>{words(2, 12)}</h1>", "main")] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            inner += paragraph()
            if rng.random() < 0.06:
                inner += one(advert, form, notice, sidebar)()
        if rng.random() < 0.2:
            inner += comments()
        return wrap(
            *one(("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post-content"'), ("div", ""), ("section", "")),
            inner,
        )

    out = []
    for _ in range(count):
        before = [part for part in (header, menu, notice, advert, form) if rng.random() < 0.5]
        after = [part for part in (comments, sidebar, advert, form, notice, menu) if rng.random() < 0.35]
        rng.shuffle(before)
        rng.shuffle(after)
        out.append([x for part in [*before, article, *after, *([footer] if rng.random() < 0.85 else [])] for x in part()])
    return out


def labelled_blocks(parts: list[tuple[str, str]]) -> tuple[list[tuple], list[str]]:
    """Feature tuples and labels of a labelled page's blocks; labels ride along as marks in the text."""
    marked = "".join(p.replace(">", f">{LABEL_MARK}{'1' if label == 'main' else '0'}", 1) if label and p[0] == "<" else (f"{LABEL_MARK}0{p}" if label else p) for p, label in parts)
    features, labels, now = [], [], "other"
    for text, linked, ancestors in leaf_blocks(f"<html><body>{marked}</body></html>"):
        if LABEL_MARK in text:
            now = "main" if text[text.rindex(LABEL_MARK) + 1] == "1" else "other"
            text = re.sub(f"{LABEL_MARK}[01] ?", "", text)
        if text:
            features.append(block_features(text, linked, ancestors))
            labels.append(now)
    return features, labels


@functools.lru_cache(maxsize=2)
def trained(count: int = 500, seed: int = 11) -> ChainModel:
    """The field trained on ``count`` labelled pages."""
    return train([labelled_blocks(p) for p in labelled_pages(count, seed)], LABELS, epochs=60, decay=1e-4)


def main_texts(pages: list[str | None], model: ChainModel) -> list[str]:
    """The main text of each page: its main blocks in order, joined by two line feeds."""
    model.forget()
    blocks = [leaf_blocks(p) if p else [] for p in pages]
    numbers = np.array([model.number(block_features(*b)) for page in blocks for b in page], np.int64)
    labels = model.decode(numbers, np.array([len(b) for b in blocks], np.int64))
    out, at = [], 0
    for page in blocks:
        out.append("\n\n".join(b[0] for b, tag in zip(page, labels[at : at + len(page)]) if tag == 1))
        at += len(page)
    return out


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: ChainModel | None = None) -> DataFrame:
    """The kept columns, text and n_chars, one row per input row."""
    model = model or trained()
    picked = pages.select(*(F.col(c) for c in keep), F.col(html_col).alias("_html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = main_texts(part.column(len(keep)).to_pylist(), model)
                columns = [*(part.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    from pyspark.sql import types as T

    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return picked.mapInArrow(run, schema)


def op10_query(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
