"""Lexical retrieval packing into training sequences.

The documents are turned into token ids and written once, with counts over all
documents of how many hold each token. Two small hashes of a document's rarer
tokens (least hashes, so documents that share many tokens often share them) put
the documents in an order, in which they are dealt to shards of bounded tokens:
documents that are alike meet in a shard at any size of the corpus, and a large
group of copies spreads over as many shards as it fills. Each shard builds a BM25
inverted index over its token ids, weighted by the counts over all documents. A
window opens with the rest of the document cut last or else the first unused
document, the seed; the index returns unused neighbours of the seed, best first,
and they fill the window: those that fit go in whole, and the best of the rest is
cut to fill what is left. So every sequence but a shard's last is full.

Bounds (parameters): a seed asks by its ``query_terms`` weightiest terms;
``shard_tokens`` tokens share an index. Neighbours are not capped.

Defined results for odd input: null and empty texts consist of the end id
alone; repeated rows are packed once each; neighbours of equal weight go by
their place in the shard; further columns are ignored; a text longer than a
window is cut over several, and one longer than a shard is a shard by itself; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.tokens import default_path, word_tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75  # of BM25


class ShardIndex:
    """BM25 over the token ids of a shard's documents; ``idf`` is by token, over the whole corpus."""

    def __init__(self, texts: list[np.ndarray], query_terms: int, idf: np.ndarray, mean_length: float):
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        token = np.concatenate(texts).astype(np.int64) if n else np.zeros(0, np.int64)
        base = int(token.max(initial=0)) + 1
        keys, tf = np.unique(np.repeat(np.arange(n), lengths) * base + token, return_counts=True)
        doc, term = keys // base, keys % base
        here = np.bincount(term, minlength=base)
        norm = K1 * (1 - B + B * lengths[doc] / max(1.0, mean_length))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.ends = np.cumsum(here)
        self.begins = self.ends - here
        self.n, self.query_terms = n, query_terms
        self.own = np.searchsorted(doc, np.arange(n + 1))
        self.term, self.weight, self.here = term, weight, here

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share the seed's weightiest terms, best first, ties by place."""
        lo, hi = self.own[seed], self.own[seed + 1]
        terms, weights = self.term[lo:hi], self.weight[lo:hi]
        shared = self.here[terms] > 1
        terms, weights = terms[shared], weights[shared]
        if len(terms) > self.query_terms:
            terms = terms[np.argpartition(-weights, self.query_terms)[: self.query_terms]]
        spans = [slice(self.begins[t], self.ends[t]) for t in terms]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), minlength=self.n)
        score *= unused
        found = np.nonzero(score > 0)[0]
        return found[np.lexsort((found, -score[found]))]


def pack_shard(texts: list[np.ndarray], window: int, index: ShardIndex) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; texts hold their end ids."""
    sizes = np.array([len(t) for t in texts], np.int64)
    unused = np.ones(len(texts), bool)
    first, sequence, used, pieces = 0, 0, 0, []

    def place(doc: int, start: int) -> int:
        """Puts what fits of the document from ``start`` into the window; returns where its rest starts."""
        nonlocal used, sequence
        length = min(window - used, len(texts[doc]) - start)
        pieces.append((doc, start, length, sequence, used))
        used += length
        if used == window:
            used, sequence = 0, sequence + 1
        return start + length

    carried = None
    while True:
        if carried is None:
            while first < len(texts) and not unused[first]:
                first += 1
            if first == len(texts):
                return pieces
            carried = (first, 0)
            unused[first] = False
        seed, start = carried
        carried = None
        while start < len(texts[seed]):
            start = place(seed, start)
        if used == 0:
            continue
        opened, near = sequence, index.neighbours(seed, unused)
        for doc in near[sizes[near] <= window - used].tolist():
            if sizes[doc] <= window - used:
                unused[doc] = False
                place(doc, 0)
                if sequence > opened:
                    break
        if sequence == opened and used:
            rest = near[unused[near]]
            if len(rest):
                doc = int(rest[0])
                unused[doc] = False
                carried = (doc, place(doc, 0))
                if carried[1] == len(texts[doc]):
                    carried = None


def _id_bytes(path: str, end_id: int) -> int:
    """Bytes that hold any id of the vocabulary."""
    return 2 if max(word_tokens(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _token_hash(seed: int, tokens: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(tokens).astype(np.uint32)


def token_table(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, frequent: int) -> DataFrame:
    """(doc_id, ids, k1, k2, counts): a row for each document, and for each task one row of how many of its documents hold each token."""

    def run(batches):
        tokens = word_tokens(path)
        size = max(tokens.tokenizer.get_vocab_size(), end_id + 1)
        kind = f"<u{_id_bytes(path, end_id)}"
        one, two = _token_hash(1, size), _token_hash(2, size)
        counts, end = np.zeros(size, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns):
                ids = np.frombuffer(tokens.encode(text.as_py()) + end, "<u4")
                held = np.unique(ids)
                counts[held] += 1
                rare = held[np.searchsorted(held, frequent) :]
                rare = rare if len(rare) else held
                rows.append((doc_id.as_py(), ids.astype(kind).tobytes(), int(one[rare].min()), int(two[rare].min()), None))
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1024]), kinds)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, counts), kinds)], names=names)

    names = ["doc_id", "ids", "k1", "k2", "counts"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary, k1 long, k2 long, counts array<bigint>")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
    tokenizer_path: str | None = None,
    shard_tokens: int = 1 << 20,
    query_terms: int = 16,
    frequent: int = 4096,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Token ids follow the order in which the vocabulary's merges were found; those
    from ``frequent`` on are the rarer ones that decide which documents meet.
    """
    path = tokenizer_path or default_path()
    table = materialize(token_table(docs, id_col, text_col, path, end_id, frequent), "pack-tokens", "zstd")
    told = table.where("counts is not null").select(F.posexplode("counts").alias("token", "n")).where("n > 0")
    counts = told.groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary bounds it
    rows = table.where("ids is not null").select("doc_id", "ids", "k1", "k2")
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)), F.count(F.lit(1))).first()
    token, held = counts.column("token").to_numpy(), counts.column("n").to_numpy()
    idf = np.zeros(int(token.max(initial=0)) + 1)
    idf[token] = np.log1p((n - held + 0.5) / (held + 0.5))
    size = _id_bytes(path, end_id)
    mean = total / size / max(1, n)
    shards = max(1, -(-int(total) // size // shard_tokens))
    # The row number keeps repeated rows apart; the table is written, so it is fixed.
    dealt = rows.withColumn("tie", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    parts = max(-(-shards // 32), min(shards, 4 * docs.sparkSession.sparkContext.defaultParallelism))
    dealt = dealt.repartitionByRange(parts, "k1", "k2", "tie").sortWithinPartitions("k1", "k2", "tie").select("doc_id", "ids", F.spark_partition_id().alias("part"))
    kind = f"<u{size}"

    def packed(names, texts, first):
        pieces = pack_shard(texts, window, ShardIndex(texts, query_terms, idf, mean))
        at = np.array(pieces, np.int64).reshape(-1, 5)
        crc = [zlib.crc32(texts[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        sizes = np.array([len(t) for t in texts], np.int64)
        columns = [pa.array(names, pa.int64()).take(pa.array(at[:, 0])), at[:, 1], at[:, 2], pa.array(crc, pa.int64()), sizes[at[:, 0]], at[:, 3] + first, at[:, 4]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names_out), int(at[-1, 3]) + 1

    def run(batches):
        names, texts, held, first = [], [], 0, None
        for batch in batches:
            first = batch.column(2)[0].as_py() << 32 if first is None and batch.num_rows else first
            for doc_id, ids in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(ids.as_py(), kind)
                if names and held + len(ids) > shard_tokens:
                    out, used = packed(names, texts, first)
                    yield out
                    names, texts, held, first = [], [], 0, first + used
                names.append(doc_id.as_py())
                texts.append(ids)
                held += len(ids)
        if names:
            yield packed(names, texts, first)[0]

    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return dealt.mapInArrow(run, SCHEMA)


def op9_query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
