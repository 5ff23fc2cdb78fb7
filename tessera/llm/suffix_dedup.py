"""Removal of repeated substrings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``depth`` bytes over it also starts in a document of
a smaller id. The documents are cut into data shards of bounded bytes, and each
goes through these steps:

1. Every window of ``depth`` bytes has an anchor: the leftmost of its ``GRAM``-byte
   grams of least hash. Equal windows have equal anchors at equal places. Each
   shard tells its distinct anchor hashes, once each, and learns which of them a
   different text has as well. Hashes only leave out what can't repeat.
2. A shard writes its windows over shared anchors as strings aligned at the
   anchor, equal ones once with the least id, and builds the Burrows-Wheeler
   transform of the strings of each bucket of anchors.
3. In each bucket the shards' transforms are merged by interleave refinement
   (``bwt``). The common prefixes give the repeated intervals, and so for each
   string the windows that some lesser id holds as well.
4. Each shard turns these into spans of its texts.

Copies of a whole text (equal SHA-256) are removed whole; their first document
alone takes part in the steps above. An anchor that ``hot`` shards hold, with
``hot`` times OFTEN places at least, goes to the buckets window by window, so no
bucket gets more of it than a string a shard and window; one with fewer places
is a bounded number of strings and stays whole, for its windows are up to
depth - GRAM + 1 times as many. The buckets of step 1 are cut into as many parts
as their strings need (MERGED bytes each), so a task's share doesn't grow with
how much of the texts is repeated. A shard cuts its strings out some buckets at
a time.

Defined results for odd input: a null text is empty; texts shorter than
``depth`` bytes lose nothing; rows that share an id don't remove each other's
bytes; a null id counts as greater than all others; repeated rows give their
rows; a very long text is a shard's by itself and is read whole; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bwt import END, merged_repeats, transform
from tessera.llm.common import discard, materialize

GRAM = 24  # long enough that texts seldom share one by chance
CHUNK = 1 << 15  # windows whose anchors are looked for at a time
PLACE_BITS = 20
ROWS = 1 << 17  # strings whose transforms a task builds at a time
FLUSH = 1 << 22  # anchors that a task holds before it tells them
OFTEN = 32  # places of a hot anchor for each of the shards that make it one
MERGED = 24 << 20  # bytes of strings that are merged at a time, at most about: their number is told by places, so mostly fewer
SEVERAL = 0xFFFF  # more than one text of the shard
LAST = (1 << 63) - 1  # stands for a null id
SALTS = 16


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each starts and the last ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def anchored_runs(held: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last start of its windows; windows don't cross texts."""
    hashes, places, firsts, lasts = [], [], [], []
    ramp = np.arange(CHUNK + depth, dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    span = depth - GRAM + 1  # grams in a window
    for at in range(0, len(held) - depth + 1, CHUNK):
        windows = min(CHUNK, len(held) - depth + 1 - at)
        grams = windows + span - 1
        word = np.ndarray((grams + 16,), "<u8", held, at, (1,)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = word[8 : grams + 8] >> np.uint64(7)
        mixed ^= word[:grams]
        mixed += word[16:] << np.uint64(13)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        # Places in the low bits: of equal hashes the leftmost is least.
        least, width = (mixed & ~low) | ramp[:grams], 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        new = np.empty(windows, bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        # Texts begin new runs, and so do the windows that would cross a text's end.
        inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + windows + depth)] - at
        for cut in (inner, inner - depth + 1):
            new[cut[(cut >= 0) & (cut < windows)]] = True
        first = np.nonzero(new)[0]
        last = np.append(first[1:], windows) - 1
        kept = first + at + depth <= ends[np.searchsorted(ends, first + at, side="right")]
        first, last = first[kept], last[kept]
        place = (least[first] & low).astype(np.int64)
        hashes.append(mixed[place])
        places.append(place + at)
        firsts.append(first + at)
        lasts.append(last + at)
    if not hashes:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts)


def _runs_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start."""
    return np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)


def _bucketed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and remaining 32 bits of each hash."""
    return (hashes % np.uint64(buckets)).astype(np.int64), ((hashes // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shared_anchors(texts: DataFrame, depth: int, buckets: int, hot: int) -> DataFrame:
    """(shard, bucket, lows, hots, strings): for each shard the anchors that different texts have, and how many strings they come to at most; texts (shard, sha, text)."""
    windows = depth - GRAM + 1

    def told(keys, docs, shards, names):
        numbers: dict[bytes, int] = {}
        which = np.array([numbers.setdefault(n, len(numbers)) for n in names], np.int64)  # equal texts are one
        tags = np.frombuffer(b"".join(numbers), "V16")
        keys, docs, shards = np.concatenate(keys), np.concatenate(docs), np.array(shards, np.int64)
        for shard in np.unique(shards):
            mine = shards[docs] == shard
            key, text = keys[mine], which[docs[mine]]
            order = np.argsort(key)
            key, text = key[order], text[order]
            starts = _runs_of(key)
            if not len(starts):
                continue
            places = np.diff(np.append(starts, len(key)))
            one = np.minimum.reduceat(text, starts)
            text = np.where(one == np.maximum.reduceat(text, starts), one, SEVERAL)
            bucket, rest = _bucketed(key[starts], buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, rest, text, places = bucket[order], rest[order], text[order], np.minimum(places[order], 0xFFFF).astype("<u2")
            starts = _runs_of(bucket)
            rows = []
            for a, b in zip(starts, np.append(starts[1:], len(bucket))):
                used, local = np.unique(text[a:b], return_inverse=True)
                several = used[-1] == SEVERAL
                if several:
                    local[local == len(used) - 1] = SEVERAL
                rows.append((int(bucket[a]), int(shard), rest[a:b].tobytes(), local.astype("<u2").tobytes(), tags[used[: len(used) - several]].tobytes(), places[a:b].tobytes()))
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), kinds)], names=["bucket", "shard", "lows", "texts", "names", "places"])

    def emit(batches):
        keys, docs, shards, names, count = [], [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held, ends = flat(part.column(2))
                found, places, _, _ = anchored_runs(held, ends, depth)
                keys.append(found)
                docs.append(np.searchsorted(ends, places, side="right") - 1 + len(names))
                shards.extend(part.column(0).to_pylist())
                names.extend(x[:16] for x in part.column(1).to_pylist())
                count += len(found)
                if count >= FLUSH or len(names) > 60_000:
                    yield from told(keys, docs, shards, names)
                    keys, docs, shards, names, count = [], [], [], [], 0
        if names:
            yield from told(keys, docs, shards, names)

    def pick(key, table):
        lows, one, two, several, sizes = [], [], [], [], []
        places = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("places")])
        for low, text, name in zip(*(table.column(c) for c in ("lows", "texts", "names"))):
            text = np.frombuffer(text.as_py(), "<u2").astype(np.int64)
            tags = np.append(np.frombuffer(name.as_py(), "<u8"), [0, 0]).reshape(-1, 2)
            many = text == SEVERAL
            text[many] = len(tags) - 1
            lows.append(np.frombuffer(low.as_py(), "<u4"))
            one.append(tags[text, 0])
            two.append(tags[text, 1])
            several.append(many)
            sizes.append(len(text))
        low, several = np.concatenate(lows), np.concatenate(several)
        order = np.argsort(low, kind="stable")
        starts = _runs_of(low[order])
        differ = np.maximum.reduceat(several[order], starts)
        for tag in (np.concatenate(one)[order], np.concatenate(two)[order]):
            differ |= np.minimum.reduceat(tag, starts) != np.maximum.reduceat(tag, starts)
        counts = np.diff(np.append(starts, len(low)))
        shared, heat = np.empty(len(low), bool), np.empty(len(low), bool)
        many = (counts >= hot) & (np.add.reduceat(places[order], starts, dtype=np.int64) >= OFTEN * hot)
        shared[order], heat[order] = np.repeat(differ, counts), np.repeat(many, counts)
        out = []
        for k, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
            if shared[a:b].any():
                out.append((table.column("shard")[k].as_py(), int(key[0].as_py()), low[a:b][shared[a:b]].tobytes(), heat[a:b][shared[a:b]].tobytes(), int((places[a:b] * np.where(heat[a:b], windows, 1))[shared[a:b]].sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()])], names=["shard", "bucket", "lows", "hots", "strings"])

    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    rows = texts.select("shard", "sha", "text").mapInArrow(emit, "bucket long, shard long, lows binary, texts binary, names binary, places binary")
    return rows.groupBy("bucket").applyInArrow(pick, "shard long, bucket long, lows binary, hots binary, strings long")


def _row_hash(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([_hash_part(rows[a : a + CHUNK]) for a in range(0, len(rows), CHUNK)] or [np.zeros(0, np.uint64)])


def _hash_part(rows: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for word in padded.view("<u8").T:
        out = (out ^ word) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


#: An occurrence of a string in a shard: the text's number, the anchor's place in it, the columns of the first and last window, and the string's number.
OCCURRENCE = np.dtype([("text", "<u4"), ("place", "<u4"), ("first", "u1"), ("last", "u1"), ("string", "<u4"), ("later", "?")])


class Strings:
    """Aligned strings over places of a shard's bytes; their rows are cut out when they are asked for, so that few are held at a time."""

    def __init__(self, padded: np.ndarray, width: int):
        self.windows, self.column = np.lib.stride_tricks.sliding_window_view(padded, width), np.arange(width)

    def rows(self, places: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        rows = self.windows[places]
        for a in range(0, len(rows), CHUNK):
            part = slice(a, a + CHUNK)
            rows[part][(self.column < begin[part, None]) | (self.column >= stop[part, None])] = END
        return rows

    def hashes(self, places: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        parts = [slice(a, a + CHUNK) for a in range(0, len(places), CHUNK)]
        return np.concatenate([_row_hash(self.rows(places[p], begin[p], stop[p])) for p in parts] or [np.zeros(0, np.uint64)])

    def distinct(self, places, begin, stop, hashed, bucket) -> tuple[np.ndarray, np.ndarray]:
        """The order by bucket and hash, and where in it each distinct string starts. Equal strings that stay apart do no harm."""
        order = np.lexsort((hashed, bucket))
        new = np.ones(len(order), bool)
        near = order[1:], order[:-1]
        # Equal hashes are looked at byte by byte.
        alike = np.nonzero((hashed[near[0]] == hashed[near[1]]) & (bucket[near[0]] == bucket[near[1]]))[0]
        for a in range(0, len(alike), CHUNK):
            part = alike[a : a + CHUNK]
            one, two = (self.rows(places[x], begin[x], stop[x]) for x in (near[0][part], near[1][part]))
            new[part[(one == two).all(axis=1)] + 1] = False
        return order, np.nonzero(new)[0]


def shard_strings(held, ends, ids, shared, heat, depth: int, buckets: int, parts: int = 1):
    """A function that cuts out the rows of a slice of the shard's distinct strings, their buckets and least ids, their occurrences, and the hot ones.

    ``shared`` are the shared anchors, ascending, as bucket << 32 | rest, and ``heat`` whether each is hot.
    Each bucket is cut into ``parts`` by the rest, so equal anchors stay together; these are the buckets of the rows.
    Strings over hot anchors give way to their windows, once for each distinct
    string and not for each occurrence: (counts, early, windows) has the number
    of windows of each such string, the bits of those that a lesser id of this
    shard has in another string, and the windows' numbers among the rows. Their
    occurrences count on from the rows.
    """
    lead, width = depth - GRAM, 2 * depth - GRAM
    hashes, places, firsts, lasts = anchored_runs(held, ends, depth)
    bucket, rest = _bucketed(hashes, buckets)
    key = bucket.astype(np.uint64) << np.uint64(32) | rest
    at = np.minimum(np.searchsorted(shared, key), max(0, len(shared) - 1))
    hit = shared[at] == key if len(shared) else np.zeros(len(key), bool)
    places, firsts, lasts, hot = places[hit], firsts[hit], lasts[hit], heat[at[hit]]
    bucket = bucket[hit] * parts + rest[hit] % parts
    buckets *= parts
    del hashes, rest, key, at, hit
    cut = Strings(np.concatenate([np.full(lead, END, np.uint8), held, np.full(depth, END, np.uint8)]), width)
    begin, stop = (firsts - places + lead).astype(np.int16), (lasts - places + lead + depth).astype(np.int16)
    text = np.searchsorted(ends, places, side="right") - 1
    mine = ids[text]
    # Hot strings come last, by themselves.
    order, starts = cut.distinct(places, begin, stop, cut.hashes(places, begin, stop), bucket + np.where(hot, buckets, 0))
    least = np.minimum.reduceat(mine[order], starts) if len(starts) else np.zeros(0, np.int64)
    string = np.empty(len(order), np.int64)
    string[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    found = np.empty(len(places), OCCURRENCE)
    found["text"], found["place"] = text, places - ends[text]
    found["first"], found["last"] = begin, stop - depth
    found["later"] = mine > least[string]

    one = order[starts]
    cold = int((~hot[one]).sum())
    counts = (stop[one[cold:]] - depth - begin[one[cold:]] + 1).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    column = (begin[one[cold:]][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int16)
    spots = places[one[cold:]][owner].astype(np.int32)
    hashed = cut.hashes(spots, column, column + depth)
    into = (hashed % np.uint64(buckets)).astype(np.int32)
    by, heads = cut.distinct(spots, column, column + depth, hashed, into)
    lows = np.minimum.reduceat(least[cold:][owner[by]], heads) if len(heads) else np.zeros(0, np.int64)
    window = np.empty(len(by), np.int64)
    window[by] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(by))))
    bits = np.where(least[cold:][owner] > lows[window], np.uint64(1) << column.astype(np.uint64), np.uint64(0))
    early = np.bitwise_or.reduceat(bits, np.cumsum(counts) - counts) if len(counts) else np.zeros(0, np.uint64)

    keys = np.concatenate([bucket[one[:cold]], into[by[heads]]])
    sorted_rows = np.argsort(keys, kind="stable")
    number = np.empty(len(keys), np.int64)
    number[sorted_rows] = np.arange(len(keys))
    found["string"] = np.where(string < cold, number[np.minimum(string, max(0, cold - 1))] if len(number) else 0, string - cold + len(keys))
    picked = [np.concatenate([x, y[by[heads]]])[sorted_rows] for x, y in ((places[one[:cold]], spots), (begin[one[:cold]], column), (stop[one[:cold]], column + depth))]
    rows = lambda a, b: cut.rows(*(x[a:b] for x in picked))
    return rows, keys[sorted_rows], np.concatenate([least[:cold], lows])[sorted_rows], found, (counts, early, number[cold:][window])


def string_masks(masks: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The masks of a shard's strings, those over hot anchors after the others, from the masks of its rows."""
    counts, early, windows = hot
    if not len(counts):
        return masks
    return np.concatenate([masks, early | np.bitwise_or.reduceat(masks[windows], np.cumsum(counts) - counts)])


def shard_transforms(rows: DataFrame, depth: int, buckets: int, parts: int = 1) -> DataFrame:
    """(bucket, shard, strings, least, found): a row for each bucket of a shard's transforms, and one without a bucket for its occurrences."""

    names = ["bucket", "shard", "strings", "least", "found", "hot"]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        shard = key[0].as_py()
        kind = table.column("kind").to_numpy()
        told = table.filter(pa.array(kind == 1))
        if not told.num_rows:
            return
        texts = table.filter(pa.array(kind == 0))
        copies = table.filter(pa.array(kind == 2)).column("row").to_numpy()
        del table
        texts = texts.filter(pa.array(~np.isin(texts.column("row").to_numpy(), copies)))
        shared = [np.frombuffer(a.as_py(), "<u4").astype(np.uint64) | np.uint64(b.as_py() << 32) for a, b in zip(told.column("a"), told.column("bucket"))]
        heat = [np.frombuffer(b.as_py(), bool) for b in told.column("b")]
        shared, heat = np.concatenate(shared), np.concatenate(heat)
        shared, at = np.unique(shared, return_index=True)
        held, ends = flat(texts.column("text"))
        rows, bucket, least, found, hot = shard_strings(held, ends, texts.column("id").to_numpy(), shared, heat[at], depth, buckets, parts)
        numbers = texts.column("row").to_numpy()
        cuts = np.append(_runs_of(bucket), len(bucket))
        at = 0
        while at < len(cuts) - 1:  # whole buckets, some rows at a time
            end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + ROWS, side="right")) - 1)
            own = cuts[at : end + 1]
            built = transform(rows(own[0], own[-1]), np.repeat(np.arange(end - at), np.diff(own)))
            yield batch([(int(bucket[a]), shard, built[:, a - own[0] : b - own[0]].tobytes(), least[a:b].tobytes(), None, None) for a, b in zip(own[:-1], own[1:])])
            at = end
        if len(found):
            used, local = np.unique(found["text"], return_inverse=True)
            found["text"] = local
            packed = np.array([len(hot[0])], "<i8").tobytes() + hot[0].astype("<i8").tobytes() + hot[1].astype("<u8").tobytes() + hot[2].astype("<u4").tobytes()
            yield batch([(None, shard, numbers[used].tobytes(), None, found.tobytes(), packed)])

    return rows.groupBy("shard").applyInArrow(run, "bucket long, shard long, strings binary, least binary, found binary, hot binary")


def merged_buckets(transforms: DataFrame, depth: int) -> DataFrame:
    """(shard, bucket, masks): for each string of a shard's bucket the windows that a lesser id holds as well."""
    width = 2 * depth - GRAM

    def run(key, table):
        shards = [np.frombuffer(x.as_py(), np.uint8).reshape(width, -1) for x in table.column("strings")]
        least = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("least")])
        masks = merged_repeats(shards, least, depth)
        cuts = np.cumsum([s.shape[1] for s in shards])[:-1]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "masks": pa.array([m.tobytes() for m in np.split(masks, cuts)], pa.binary())})

    return transforms.groupBy("bucket").applyInArrow(run, "shard long, bucket long, masks binary")


def removed_spans(found: np.ndarray, masks: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and stop of each maximal removed run."""
    columns = np.arange(depth - GRAM + 1)
    spans = []

    def runs(text, start, stop):  # ascending: runs of windows follow one another in a text
        new = np.nonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > stop[:-1])]))[0] if len(text) else np.zeros(0, np.int64)
        return text[new], start[new], stop[np.append(new[1:], len(text)) - 1]

    for at in range(0, len(found), 1 << 15):
        part = found[at : at + (1 << 15)]
        gone = part["later"][:, None] | ((masks[part["string"]][:, None] >> columns.astype(np.uint64)) & np.uint64(1)).astype(bool)
        gone &= (columns >= part["first"][:, None]) & (columns <= part["last"][:, None])
        row, column = np.nonzero(gone)
        start = part["place"][row].astype(np.int64) - (depth - GRAM) + column
        spans.append(runs(part["text"][row].astype(np.int64), start, start + depth))
    return runs(*(np.concatenate(x) for x in zip(*spans))) if spans else tuple(np.zeros(0, np.int64) for _ in range(3))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, shard_bytes: int = 24 << 20, bucket_bytes: int = 32 << 20, hot: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (bytes, flat starts and stops), one row per input row.

    A shard holds about ``shard_bytes`` of text at most, a bucket the anchors of about ``bucket_bytes``.
    """
    if not GRAM <= depth <= GRAM + 63:
        raise ValueError(f"depth must lie between {GRAM} and {GRAM + 63}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    base = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("id"), text.alias("text"))
    base = base.withColumns({"sha": F.unhex(F.sha2("text", 256)), "n_bytes": F.octet_length("text").cast("long"), "row": F.monotonically_increasing_id()})
    base = materialize(base, "suffix-docs", "zstd")
    part = F.shiftrightunsigned("row", 33)
    sizes = base.groupBy(part.alias("part")).agg(F.sum("n_bytes").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cuts = max(1, -(-int(sizes[0]) // shard_bytes))
    buckets = max(16, -(-int(sizes[1]) // bucket_bytes))
    base = base.withColumn("shard", part * cuts + F.pmod("row", F.lit(cuts)))

    # A text's first row is looked up from a few rows, so that one of many copies doesn't make a hot key.
    several = base.where(F.col("n_bytes") >= depth).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("sha", "salt", "first")
    copies = base.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(several, ["sha", "salt"]).where(F.col("id") > F.col("first"))
    copies = materialize(copies.select("shard", "row"), "suffix-copies")

    none = F.lit(None)
    blank = {"row": none.cast("long"), "id": none.cast("long"), "bucket": none.cast("long"), "doc_id": none.cast("long"), "sha": none.cast("binary"), "text": none.cast("string"), **{c: none.cast("binary") for c in ("a", "b", "c")}}
    shaped = lambda df, kind, given: df.select("shard", F.lit(kind).alias("kind"), *((F.col(c) if c in given else v).alias(c) for c, v in blank.items()))

    shared = materialize(shared_anchors(base, depth, buckets, hot), "suffix-shared")
    told = shaped(shared.withColumnsRenamed({"lows": "a", "hots": "b"}), 1, {"bucket", "a", "b"})
    rows = shaped(base, 0, {"row", "id", "text"}).union(told).union(shaped(copies, 2, {"row"}))
    strings = shared.agg(F.coalesce(F.sum("strings"), F.lit(0))).first()[0]
    parts = max(1, -(-strings * (2 * depth - GRAM) // (MERGED * buckets)))
    built = materialize(shard_transforms(rows, depth, buckets, parts), "suffix-transforms", "zstd")
    discard(shared)
    masks = materialize(merged_buckets(built.where("bucket is not null").select("bucket", "shard", "strings", "least"), depth), "suffix-masks")
    found = materialize(built.where("bucket is null").select("shard", F.col("strings").alias("a"), F.col("found").alias("b"), F.col("hot").alias("c")), "suffix-found", "zstd")
    discard(built)

    def finish(key, table):
        kind = table.column("kind").to_numpy()
        texts = table.filter(pa.array(kind == 0)).select(["row", "doc_id", "sha", "text"]).combine_chunks()
        rows = texts.column("row").to_numpy()
        copy = np.isin(rows, table.filter(pa.array(kind == 2)).column("row").to_numpy())
        removed: dict[int, list[int]] = {}
        for told in table.filter(pa.array(kind == 1)).to_pylist():  # one row of occurrences
            masks = table.filter(pa.array(kind == 3)).sort_by("bucket").column("a")
            masks = np.concatenate([np.frombuffer(m.as_py(), "<u8") for m in masks])
            numbers, n = np.frombuffer(told["a"], "<i8"), int(np.frombuffer(told["c"][:8], "<i8")[0])
            hot = np.frombuffer(told["c"], "<i8", n, 8), np.frombuffer(told["c"], "<u8", n, 8 + 8 * n), np.frombuffer(told["c"], "<u4", -1, 8 + 16 * n)
            masks = string_masks(masks, hot)
            for text, start, stop in zip(*(x.tolist() for x in removed_spans(np.frombuffer(told["b"], OCCURRENCE), masks, depth))):
                removed.setdefault(int(numbers[text]), []).extend((start, stop))
        held, ends = flat(texts.column("text"))
        sizes = np.diff(ends)
        lost, spans, shas = np.where(copy, sizes, 0), [], [x.hex() for x in texts.column("sha").to_pylist()]
        for k, row in enumerate(rows.tolist()):
            cut = [0, int(sizes[k])] if copy[k] else removed.get(row, [])
            if cut:
                rest, at = hashlib.sha256(), int(ends[k])
                for a, b in zip(cut[::2], cut[1::2]):
                    rest.update(held[at : ends[k] + a])
                    at = int(ends[k]) + b
                rest.update(held[at : ends[k + 1]])
                shas[k], lost[k] = rest.hexdigest(), sum(cut[1::2]) - sum(cut[::2])
            spans.append(cut)
        counts = np.array([len(s) // 2 for s in spans], np.int64)
        columns = [texts.column("doc_id"), sizes, lost, counts, pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.int64()))]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = shaped(base, 0, {"row", "doc_id", "sha", "text"}).union(shaped(found, 1, {"a", "b", "c"})).union(shaped(copies, 2, {"row"}))
    rows = rows.union(shaped(masks.withColumnRenamed("masks", "a"), 3, {"bucket", "a"}))
    return rows.groupBy("shard").applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>")


def op7_query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
