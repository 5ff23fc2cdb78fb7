"""Analysis of text as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for ranking, and suffixes that stemming strips.
STOPWORDS = tuple("a an and are as at be by for from has he in is it its of on or that the to was were will with".split())
SUFFIXES = ("ingly", "edly", "ing", "ies", "ed", "es", "s", "ly")

TOKEN = r"([\p{L}\p{N}]+)"
STEM = "^(.{3,}?)(?:" + "|".join(SUFFIXES) + ")$"

# Sound classes of letters, function words of languages, ligatures.
SOUNDS = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit ein eine von zu den auf für sich".split(),
    "en": "the and of to in is that for with on was are this from it".split(),
    "es": "el la los de que y en un una por con para las del se".split(),
    "fr": "le la les de et un une des est que pour dans par sur pas".split(),
}
QUESTION_WORDS = tuple("who what when where why how which whose".split())
LIGATURES = {"æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "Æ": "AE", "Œ": "OE", "Ø": "O", "Đ": "D", "Ł": "L"}


def raw_tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, in order; none of a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1)


def stem(word: Column) -> Column:
    """The word without its longest listed suffix, if three characters remain."""
    return F.regexp_replace(word, STEM, "$1")


def analyzed_terms(text: Column, stopwords: bool = True, stemming: bool = True) -> Column:
    """Lower-case terms without stopwords, stemmed; positions count the terms that remain."""
    terms = F.transform(raw_tokens(text), F.lower)
    if stopwords:
        terms = F.filter(terms, lambda t: ~t.isin(*STOPWORDS))
    # Tokens hold no line ends, so only those that end as a suffix does can change.
    ends = sorted({s[-1] for s in SUFFIXES})
    return F.transform(terms, lambda t: F.when(F.substring(t, -1, 1).isin(*ends), stem(t)).otherwise(t)) if stemming else terms


def ngrams(term: Column, width: int) -> Column:
    """Character n-grams of the term between a start and an end mark; a short term is one gram."""
    if width < 2:
        raise ValueError("n-grams need a width of two or more")
    padded = F.concat(F.lit("\x02"), term, F.lit("\x03"))
    n = F.length(padded)
    return F.when(n <= width, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(padded, i, F.lit(width))))


def shingles(terms: Column, width: int = 3) -> Column:
    """Distinct runs of ``width`` terms, space-joined; fewer terms make one shingle, none make none."""
    n = F.size(terms)
    runs = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(terms, i, F.lit(width)), " "))
    return F.array_distinct(F.when(n == 0, F.array().cast("array<string>")).when(n < width, F.array(F.array_join(terms, " "))).otherwise(runs))


def shingle_hashes(terms: Column, width: int = 3) -> Column:
    """Hashes of the same shingles, each once, ascending; no string is built for a run."""
    n = F.size(terms)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(terms, i + k) for k in range(width))))
    few = F.array(F.xxhash64(F.array_join(terms, " ")))
    return F.sort_array(F.array_distinct(F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, few).otherwise(runs)))


@functools.cache
def _folding() -> tuple[str, str]:
    """All characters that folding changes and what they become, for ``translate``; combining marks become nothing."""
    kept, gone = [], []
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or char in LIGATURES:
            continue
        bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c)))
        if not bare:
            gone.append(char)
        elif bare != char and len(bare) == 1:
            kept.append((char, bare))
    return "".join(k for k, _ in kept) + "".join(gone), "".join(v for _, v in kept)


def fold(text: Column) -> Column:
    """Ligatures spelled out and all accents and other combining marks taken off."""
    spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), text)
    return F.translate(spelled, *_folding())


def split_identifier(token: Column) -> Column:
    """Parts of an identifier at case, digit and separator seams, lower-cased and distinct."""
    seams = F.regexp_replace(token, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    parts = F.split(F.regexp_replace(seams, r"[_\-./:\s]+", " "), " ")
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), F.lower))


def phonetic_code(name: Column) -> Column:
    """Four characters: the first letter and the sound classes; any letter without a class ends a run. Null without letters."""
    letters = F.regexp_replace(F.lower(name), r"[^\p{L}]", "")
    known = "".join(SOUNDS.values())
    classes = F.regexp_replace(F.translate(letters, known, "".join(d * len(of) for d, of in SOUNDS.items())), r"[^1-6]", "0")
    single = F.regexp_replace(classes, r"(.)\1+", "$1")
    rest = F.regexp_replace(F.substring(single, 2, 1 << 20), "0", "")
    return F.when(F.length(letters) > 0, F.rpad(F.concat(F.upper(F.substring(letters, 1, 1)), F.substring(rest, 1, 3)), 4, "0"))


def language_shares(text: Column) -> dict[str, Column]:
    """For each language the share of the text's words that are its function words."""
    words = F.transform(raw_tokens(text), F.lower)

    def share(listed: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*listed))) / F.greatest(F.size(words), F.lit(1))

    return {k: share(v) for k, v in FUNCTION_WORDS.items()}


def sniff_language(text: Column, margin: float = 0.1, least: int = 4) -> Column:
    """The language whose function words lead by the margin; null for short or unclear texts."""
    shares = language_shares(text)
    ranked = F.sort_array(F.array(*(F.struct(s.alias("share"), F.lit(k).alias("lang")) for k, s in shares.items())), asc=False)
    sure = (F.size(raw_tokens(text)) >= least) & (ranked[0]["share"] - ranked[1]["share"] >= margin)
    return F.when(sure, ranked[0]["lang"])


# What personal data looks like, and what stands for it.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1C-\x1F\x85\p{Z}"
CARD = r"(?<!\p{Nd})\p{Nd}(?:[ -]?\p{Nd}){12,18}(?!\p{Nd})"
EMAIL = rf"[{_WORD}.+-]+@[{_WORD}-]+\.[{_WORD}.]+"
PHONE = rf"(?<!\p{{Nd}})(?:\+?\p{{Nd}}[{_SPACE}-]?){{7,14}}\p{{Nd}}(?!\p{{Nd}})"


def scrub(text: Column) -> Column:
    """Cards, mail addresses and phone numbers masked, in that order: a card's digits would also pass for a phone's."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CARD, "[card]"), EMAIL, "[email]"), PHONE, "[phone]")


def escape_html(text: Column) -> Column:
    """Markup characters as character references."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), text)


MARK, MARK_OTHER = "\ue000", "\ue001"  # a private-use character that marks places, and what stands for one in a text


def token_pieces(text: Column) -> Column:
    """The text cut at its tokens: gap, token, gap, .. , gap."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(MARK_OTHER))
    return F.split(F.regexp_replace(safe, TOKEN, f"{MARK}$1{MARK}"), MARK)


def pieces_at(text: Column, terms: tuple[str, ...]) -> Column:
    """The text cut at the tokens whose term is one of the given: rest, token, rest, .. , rest."""
    wanted = lambda x, i: (i % 2 == 1) & ~F.lower(x).isin(*STOPWORDS) & stem(F.lower(x)).isin(*terms)
    marked = F.transform(token_pieces(text), lambda x, i: F.when(wanted(x, i), F.concat(F.lit(MARK), x, F.lit(MARK))).otherwise(x))
    return F.split(F.array_join(marked, ""), MARK)


def marked_text(pieces: Column, opening: str = "[", closing: str = "]") -> Column:
    """The text of ``pieces_at`` with its tokens in brackets."""
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(opening), x, F.lit(closing))).otherwise(x)), "")


def spans_of(pieces: Column) -> Column:
    """Start and end, in characters, of the tokens of ``pieces_at``."""
    upto = lambda n: F.aggregate(F.slice(pieces, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)))
    found = F.transform(places, lambda k: F.struct(upto(k).alias("start"), (upto(k) + F.length(F.get(pieces, k))).alias("end")))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int>>"))


def best_window(text: Column, spans: Column, width: int = 60) -> Column:
    """A struct of start and end: the first window of ``width`` characters from a span that holds most spans, widened to whole words."""
    size = F.length(text)
    inside = lambda a: F.size(F.filter(spans, lambda s: (s["start"] >= a["start"]) & (s["end"] <= a["start"] + width)))
    ranked = F.array_min(F.transform(spans, lambda a: F.struct((-inside(a)).alias("held"), a["start"].alias("at"))))
    start = F.when(F.size(spans) > 0, F.greatest(F.lit(0), F.least(ranked["at"], size - width))).otherwise(F.lit(0))
    end = F.least(size, start + width)
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"([\p{L}\p{N}]*)$", 1))
    after = F.length(F.regexp_extract(F.substring(text, end + 1, size), r"^([\p{L}\p{N}]*)", 1))
    return F.struct((start - before).alias("start"), (end + after).alias("end"))


def snippet_grade(snippet: Column, terms: tuple[str, ...], span: int = 12) -> tuple[Column, Column]:
    """coverage, the share of the terms that a snippet shows, and density, which falls as they lie further apart than ``span``."""
    found = analyzed_terms(snippet)
    places = F.filter(F.transform(found, lambda t, i: F.when(t.isin(*terms), i)), lambda i: i.isNotNull())
    coverage = F.bround(F.size(F.array_intersect(F.array_distinct(found), F.array(*map(F.lit, terms)))) / len(terms), 4)
    apart = F.greatest(F.array_max(places) - F.array_min(places), F.lit(1))
    density = F.when(F.size(places) == 0, 0.0).when(F.size(places) == 1, 1.0).otherwise(F.bround(F.least(F.lit(1.0), span / apart), 4))
    return coverage.alias("coverage"), density.alias("density")


def query_form(text: Column) -> Column:
    """One form for all spellings of a query: the first term of each word, fields kept, sorted; empty where no word has one."""
    first = lambda w: F.get(analyzed_terms(w), F.lit(0))
    after = lambda w: F.substring(w, F.instr(w, ":") + 1, F.length(w))
    named = lambda w: F.concat(F.lower(F.substring_index(w, ":", 1)), F.lit(":"), first(after(w)))
    pieces = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.when(F.contains(w, F.lit(":")), named(w)).otherwise(first(w)))
    return F.array_join(F.array_sort(F.filter(pieces, lambda p: p.isNotNull())), " ")
