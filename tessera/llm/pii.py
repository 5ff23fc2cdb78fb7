"""Personal data: base patterns and a linear-chain conditional random field.

Base spans (email, ip, card, phone) follow exact patterns. The field labels the
words of each line by their shapes, by cue words and by their neighbours, and
adds names after titles, local phone numbers, identity numbers, spelled-out
mail addresses and street addresses. It is trained on a small labelled table
(``labelled_lines``) and decoded by Viterbi in numpy batches.

Defined results for odd input: a null text is empty and has no spans; repeated
rows are scanned and returned once each; spans with one start go by the order of
kinds; a field's span gives way to a base span that it meets; a line is one
sequence whatever its length, and words are read whole; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.crf import ChainModel, train

BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", "name", "local_phone", "id_number", "spelled_email", "address"]
KINDS = (*BASE_KINDS, *LABELS[1:])

# Cue words by class.
CUES = {
    "title": "mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra",
    "asks_name": "name named nombre nom surname contact",
    "asks_phone": "phone tel telephone call mobile fax cell telefon teléfono",
    "asks_id": "ssn passport nif dni iban taxid id-no insurance",
    "street": "street st avenue ave road rd lane drive boulevard blvd rue calle straße strasse platz plaza avenida",
    "at": "at (at) [at]",
    "dot": "dot (dot) [dot]",
    "tld": "com org net edu de fr es",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
_PUNCT = "@.-+()/:,#_'[]|"


def word_features(word: str) -> tuple:
    """Feature names of one word: its collapsed shape, cue class and last mark."""
    core = word.rstrip(".,;:!?")
    cue = _CUE.get(word.lower()) or _CUE.get(core.lower())
    if core.isalpha() and not cue:
        shape = "x" if core.islower() else "X" if core.isupper() else "Xx" if core[0].isupper() and (len(core) == 1 or core[1:].islower()) else "xX"
        return ("bias", "shape=" + shape, "digits=0", "ends") if len(core) < len(word) else ("bias", "shape=" + shape, "digits=0")
    shape, before, run = [], "", 0
    for c in core:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c if c in _PUNCT else "o"
        run = run + 1 if k == before else 1
        if run == 1 or (k == "d" and run <= 5):
            shape.append(k)
        before = k
    digits = sum(c.isdigit() for c in core)
    out = ["bias", "shape=" + "".join(shape), f"digits={min(digits, 10)}"]
    if cue:
        out.append("cue=" + cue)
    if len(core) < len(word):
        out.append("ends")
    return tuple(out)


def labelled_lines(count: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """The labelled table: ``count`` lines of words with their labels, from templates and a seed."""
    rng = random.Random(seed)
    given = "Anna John Maria Peter Sofia Luis Claire Hans Emma José Paul Ines Omar Lena Carla Tom".split()
    family = "Smith Garcia Müller Dubois Lopez Keller Martin Rossi Novak Brown Weber Petit O'Neil Silva".split()
    pieces = "an er ti on re th es la de ou que ci ar ei ung lich tre men ado ie st or ha nd".split()

    def word():
        w = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        return w.capitalize() if rng.random() < 0.2 else w

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def plain(n):
        out = []
        for _ in range(n):
            w = word()
            r = rng.random()
            if r < 0.10:
                w += rng.choice([".", ",", ";", ":", "."])
            elif r < 0.105:
                out += [w.capitalize()] * rng.randint(2, 12)
            elif r < 0.11:
                out += [word().upper() + rng.choice(["", "!!", "."]) for _ in range(rng.randint(2, 8))] + ["AT!!"]
            elif r < 0.13:
                w = digits(rng.choice([1, 2, 3, 4, 4, 5, 6, 8, 16, 16]))
            elif r < 0.16:
                w = rng.choice(["2.0.", "|", "at", "dot", "com", "de", "es", "st", "road", "call", "&", "token", "=", f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}", f"{digits(3)}-{digits(3)}", f'"{digits(9)}ab{digits(5)}cd"'])
            elif r < 0.18:
                w += rng.choice(["###", "$$$", "%%%", "&&&", "***"])
            elif r < 0.19:
                w = f"+1 ({digits(3)}) 555-{digits(4)}"
            elif r < 0.195:
                w = f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}"
            out += w.split(" ")
        return out

    def marked():
        kind = rng.choice(LABELS[1:])
        end = rng.choice(["", "", ".", ","])
        if kind == "name":
            lead = [rng.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Madame", "Monsieur", "Señora", "Mr", "Dr"])] if rng.random() < 0.8 else [rng.choice(["Name:", "name:", "Nombre:", "Nom:", "Contact:"])]
            said = [rng.choice(given), rng.choice(family)] if rng.random() < 0.7 else [rng.choice(family)]
            if lead[0].endswith(":"):
                said = [rng.choice(given), rng.choice(family)]
        elif kind == "local_phone":
            lead = [rng.choice(["phone", "Phone:", "tel", "Tel:", "call", "mobile", "Fax:", "Telefon"])] if rng.random() < 0.7 else []
            said = rng.choice([[f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"]])
        elif kind == "id_number":
            lead = [rng.choice(["SSN", "ssn:", "passport", "DNI", "IBAN", "insurance"])] if rng.random() < 0.7 else []
            said = [f"{digits(3)}-{digits(2)}-{digits(4)}"] if rng.random() < 0.6 or not lead else [rng.choice([f"DE{digits(20)}", f"X{digits(7)}", f"{digits(8)}Z"])]
        elif kind == "spelled_email":
            lead = [rng.choice(["mail", "write", "contact"])] if rng.random() < 0.5 else []
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot")])
            said = [rng.choice(given).lower(), at, word().lower(), dot, rng.choice(["com", "org", "net", "de"])]
        else:
            lead = []
            said = [digits(rng.randint(1, 4)), rng.choice(family + ["Oak", "Main", "High"]), rng.choice(["Street", "St", "Avenue", "Road", "Lane", "Drive", "Blvd"])]
        said[-1] += end
        return lead + said, ["O"] * len(lead) + [kind] * len(said)

    out = []
    for _ in range(count):
        words = plain(rng.randint(0, 14))
        tags = ["O"] * len(words)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            said, said_tags = marked()
            rest = plain(rng.randint(0, 10))
            words += said + rest
            tags += said_tags + ["O"] * len(rest)
        if words:
            out.append((words, tags))
    return out


@functools.lru_cache(maxsize=2)
def trained(count: int = 1500, seed: int = 7) -> ChainModel:
    """The field trained on ``count`` lines of the labelled table."""
    lines = labelled_lines(count, seed)
    return train([([word_features(w) for w in words], tags) for words, tags in lines], LABELS, epochs=30)


_NUMBER = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")  # takes whole digit runs, so long ones cost no retries
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@functools.cache
def _email():
    import regex

    local = "[A-Za-z0-9._%+-]"
    return regex.compile(rf"(?:(?<!{local})|\G){local}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base patterns, leftmost and without overlap for each kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _email().finditer(text)]
    for m in _NUMBER.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_LOWER, _LOWER_END = word_features("word"), word_features("word.")


class _Numbers(dict):
    """Words (bytes) to the model's numbers; emptied when it is full, as every entry can be made anew."""

    def __init__(self, model: ChainModel, most: int = 1 << 19):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        core = text[:-1] if text[-1] in ".,;:!?" else text
        if core.isalpha() and core.islower() and core not in _CUE and text not in _CUE:
            found = self.model.number(_LOWER if core is text else _LOWER_END)  # most words
        else:
            found = self.model.number(word_features(text))
        self[word] = found
        return found


def plausible(rank: int, words: list[str], before: str) -> bool:
    """Whether a labelled run of words has the parts that its kind can't be without."""
    kind, cores = KINDS[rank], [w.rstrip(".,;:!?") for w in words]
    cues = [_CUE.get(w.lower()) for w in cores]
    digits = sum(c.isdigit() for w in cores for c in w)
    if kind == "name":
        lead = _CUE.get(before.lower()) or _CUE.get(before.rstrip(".,;:!?").lower())
        return lead in ("title", "asks_name") and len(words) <= 4 and all(w[:1].isupper() and not w.isupper() for w in cores)
    if kind == "local_phone":
        return 7 <= digits <= 11 and len(words) <= 3
    if kind == "id_number":
        return 7 <= digits <= 30 and len(words) <= 3
    if kind == "spelled_email":
        return 5 <= len(words) <= 9 and "at" in cues[1:-1] and "dot" in cues[2:-1] and cues.index("at") + 1 < len(cues) - 1 - cues[::-1].index("dot") and cores[-1].isalpha()
    return len(words) <= 6 and cores[0].isdigit() and cues[-1] == "street"


def field_spans(texts: list[str], model: ChainModel, numbers: _Numbers) -> dict[int, list[tuple[int, int, int]]]:
    """Text number to (start, rank, end) of the spans that the field adds; only texts that have some."""
    lines, owner, ids = [], [], []
    if model.forget():
        numbers.clear()
    for k, text in enumerate(texts):
        for line in text.encode().split(b"\n"):
            found = line.split()  # ASCII white space
            if found:
                owner.append(k)
                lines.append(len(found))
                ids.extend(map(numbers.__getitem__, found))
    lengths = np.array(lines, np.int64)
    labels = model.decode(np.array(ids, np.int64), lengths)
    counts = np.bincount(np.array(owner, np.int64), weights=lengths, minlength=len(texts)).astype(np.int64) if lines else np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    breaks = np.zeros(len(labels) + 1, bool)
    breaks[np.cumsum(lengths)] = True
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k in np.unique(np.searchsorted(ends, np.nonzero(labels)[0], side="right")):
        at = int(ends[k] - counts[k])
        spans, run, lead, before = [], [], "", ""

        def close():
            if run and plausible(run[0][1], [w for _, _, _, w in run], lead):
                spans.append((run[0][0], run[0][1], run[-1][2]))
            run.clear()

        for t, m in enumerate(_WORD.finditer(texts[k])):
            rank = len(BASE_KINDS) + int(labels[at + t]) - 1
            if run and (rank != run[0][1] or breaks[at + t]):
                close()
            if rank >= len(BASE_KINDS):
                lead = lead if run else "" if breaks[at + t] else before
                run.append((m.start(), rank, m.start() + len(m[0].rstrip(".,;:!?")), m[0]))
            before = m[0]
        close()
        out[int(k)] = [s for s in spans if s[2] > s[0]]
    return out


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: ChainModel | None = None) -> DataFrame:
    """doc_id, and spans array<struct<start, rank, stop>> by start then rank: base spans, and the field's that overlap none of them."""
    model = model or trained()

    def run(batches):
        numbers = _Numbers(model)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at in range(0, len(column), 256):
                texts = [x or "" for x in column.slice(at, 256).to_pylist()]
                added = field_spans(texts, model, numbers)
                rows = []
                for k, text in enumerate(texts):
                    base = base_spans(text)
                    extra = [s for s in added.get(k, ()) if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
                    rows.append([{"start": a, "rank": r, "stop": b} for a, r, b in sorted(base + extra)])
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(rows, shape)], names=["doc_id", "spans"])

    shape = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64())]))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<start:bigint,rank:int,stop:bigint>>"
    )


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    if not text:
        return text
    out, at = [], 0
    for start, rank, stop in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[rank].upper()}>"]
            at = stop
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, text_col: str = "text", model: ChainModel | None = None) -> DataFrame:
    """The same rows and columns with personal data in ``text_col`` masked."""
    model = model or trained()
    where = docs.columns.index(text_col)

    def run(batches):
        numbers = _Numbers(model)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(where).slice(at, 256).to_pylist()
                added = field_spans([t or "" for t in texts], model, numbers)
                for k, text in enumerate(texts):
                    out.append(masked(text, sorted([*base_spans(text or ""), *added.get(k, ())])))
            columns = [pa.array(out, pa.string()) if c == where else batch.column(c) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8_query(spark, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["stop"])), ",")
    count = lambda r: F.size(F.filter("spans", lambda s: s["rank"] == r)).cast("long").alias(f"n_{KINDS[r]}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select("doc_id", *(count(r) for r in range(len(BASE_KINDS))), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
