"""Benchmark decontamination by pigeonhole edit matching.

Texts are reduced to lower-case words with single spaces. A test item of m
characters may differ by up to ``rate * m`` edits, its budget k, and is cut into
k + 1 pieces: a match with k edits leaves one piece untouched. An automaton
finds all exact piece hits in one pass over a text. A hit is checked from small
to large: of a part of j neighbouring pieces j - 1 edits are allowed, which by
the same argument some chain of parts from a piece up to the whole item meets.
Each check is Myers' bit-parallel distance; chance hits end at the first one. A
part that passes all checks is read once more with room for all alignments that
its other pieces can have, so the distance told is the least there is. Items so
short that their budget is nil must stand as whole words.

Items are shipped in blocks of bounded bytes, one pass over the documents for
each block, so a large benchmark costs passes and never memory.

Defined results for odd input: null and empty texts match nothing, nor do items
without a letter or digit (nulls too); of places of equal distance the first is
told; very long texts are read whole; repeated rows on either side each give
their rows; an empty table on either side gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, distance int, start long, stop long"


def reduced(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of the pattern to any part of the text, at most ``most``, and where that part ends."""
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) & full) ^ plus) | x
        hp = minus | (full & ~(plus | d0))
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        plus = ((hn << 1) & full) | (full & ~(hp | d0))
        minus = hp & d0
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """The items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.budgets, self.parts = [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            budget = int(rate * len(text))
            cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
            for leaf in range(budget + 1):
                pieces.setdefault(text[cuts[leaf] : cuts[leaf + 1]], []).append((n, leaf))
            chains: list[list[tuple[int, int, int]]] = [[] for _ in range(budget + 1)]

            def split(lo: int, hi: int) -> None:
                """Adds the part of leaves lo..hi to their chains, after the smaller parts in it."""
                if hi - lo > 1:
                    mid = (lo + hi) // 2
                    split(lo, mid)
                    split(mid, hi)
                    for leaf in range(lo, hi):
                        chains[leaf].append((cuts[lo], cuts[hi], hi - lo - 1))

            split(0, budget + 1)
            self.budgets.append(budget)
            self.parts.append((cuts, chains))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item number to (distance, start, stop) of its best match in the reduced text; the first of equals."""
        found: dict[int, tuple[int, int, int]] = {}
        read: dict[int, list[int]] = {}  # item to the origins whose surroundings have been read
        if self.empty or not text:
            return found
        for last, (size, places) in self.automaton.iter(text):
            start = last + 1 - size
            for n, leaf in places:
                seen, budget = found.get(n), self.budgets[n]
                if seen and seen[0] == 0:
                    continue
                cuts, chains = self.parts[n]
                item, origin = self.items[n][1], start - cuts[leaf]  # where the item would start without edits
                if not budget:
                    if (start == 0 or text[start - 1] == " ") and text[last + 1 : last + 2] in ("", " "):
                        found[n] = (0, start, last + 1)
                    continue
                if any(abs(origin - o) <= budget for o in read.get(n, ())):
                    continue
                for lo, hi, most in chains[leaf]:
                    begin = max(0, origin + lo - most)
                    if myers(item[lo:hi], text[begin : max(0, origin + hi + most)], most) is None:
                        break
                else:
                    # Alignments by other pieces of the same place start at most ``budget`` apart.
                    read.setdefault(n, []).append(origin)
                    begin = max(0, origin - 2 * budget)
                    distance, stop = myers(item, text[begin : origin + len(item) + 2 * budget], budget)
                    if not seen or distance < seen[0]:
                        stop += begin
                        # The best match's start: the same distance, read backwards from its end.
                        back = myers(item[::-1], text[max(0, stop - len(item) - distance) : stop][::-1], distance)
                        found[n] = (distance, stop - (back[1] if back else len(item)), stop)
        return found


def places_of(text: str, start: int, stop: int) -> tuple[int, int]:
    """Code points of the text whose words hold the reduced text's start to stop."""
    at, first, last = 0, None, 0
    for m in _WORD.finditer(text):
        size = len(m[0].lower())
        if first is None and at + size > start:
            first = m.start()
        if at < stop:
            last = m.end()
        else:
            break
        at += size + 1
    return first or 0, last


def blocks_of(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Lists of (item, text), each of about ``block_bytes`` at most unless one item is larger."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    count = max(1, -(-2 * int(total) // block_bytes)) if total > block_bytes else 1
    for block in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block) if count > 1 else rows
        yield [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]  # bounded by block_bytes


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.08,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """doc_id, item_id, distance, start, stop: each item that a document holds within its budget, at its best place."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    out = None
    for block in blocks_of(items, item_col, item_text_col, block_bytes):
        kept = [(i, r) for i, t in block if (r := reduced(t))]

        def run(batches, kept=kept):
            matcher = Matcher(kept, rate)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    whole = text.as_py()
                    for n, (distance, start, stop) in matcher.find(reduced(whole)).items():
                        rows.append((doc_id.as_py(), kept[n][0], distance, *places_of(whole, start, stop)))
                if rows:
                    columns = list(zip(*rows))
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "distance", "start", "stop"])

        found = texts.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def op5_query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
