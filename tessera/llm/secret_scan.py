"""Secret scan with multipart credential linking.

Plain patterns find the base spans: assigned secrets, access identifiers and
long hexadecimal runs. Further patterns find weak parts of credentials, which
alone mean little: short or generic identifiers, mixed tokens, endpoints. An
interval join by scope (starts at most ``scope`` code points apart in one text)
links parts, and a weak part is reported only when complementary parts are
there: an identifier with a secret, a secret with an identifier, an endpoint
with both.

All of it is DataFrame code. Positions come from marking matches with a
private-use character that is first exchanged in the text for its neighbour,
one for one, so code points keep their places.

The join meets, for each text, scope-wide bucket and part, one row with the
first and last start; that decides exactly whether some start lies in reach, so
a text full of parts doesn't multiply rows.

Defined results for odd input: a null text is empty and has no spans; repeated
rows are scanned and returned once each, told apart by a row number that is
fixed when it is written; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize

MARK, OTHER = "\ue000", "\ue001"

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""

# kind, pattern, part of a credential, weak. The order is that of spans with one start.
KINDS = (
    ("assign", ASSIGN, "secret", False),
    ("access", r"AKIA[A-Z0-9]{12,}+", "id", False),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", "secret", False),
    (
        "weak_id",
        r"""(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]{4,11}+(?![A-Z0-9])|(?i:client|account|tenant|access|key)[_-]?(?i:id|name)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.@-]{4,}+)""",
        "id",
        True,
    ),
    (
        "weak_secret",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}",
        "secret",
        True,
    ),
    (
        "endpoint",
        r"""(?:(?<![a-z])https?://[^\x00-\x20"'<>]+|(?<![A-Za-z0-9_])(?i:host|endpoint|server|bucket|region)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.:/-]{4,}+)""",
        "endpoint",
        True,
    ),
)
BASE = tuple(k for k, _, _, weak in KINDS if not weak)


def _pieces(text: Column, pattern: str) -> Column:
    """Alternating rests and matches: length in code points, and the match's text; null without a match."""
    cut = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(
        F.size(cut) > 1,
        F.transform(cut, lambda x, i: F.struct(F.length(x).alias("size"), F.when(i % 2 == 1, x).alias("text"))),
    )


def find_parts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id), and the spans (row, kind, rank, part, weak, start, end)."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(OTHER))
    marked = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    found = [
        F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(part).alias("part"), F.lit(weak).alias("weak"), _pieces(F.col("_t"), pattern).alias("pieces"))
        for rank, (kind, pattern, part, weak) in enumerate(KINDS)
    ]
    rows = marked.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(F.array(*found), lambda x: x["pieces"].isNotNull()).alias("found")
    )
    rows = materialize(rows, "secret-parts")
    pieces = rows.select("row", F.explode("found").alias("f")).select("row", "f.kind", "f.rank", "f.part", "f.weak", F.posexplode("f.pieces").alias("pos", "piece"))
    end = F.sum("piece.size").over(Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    spans = pieces.withColumn("end", end).where(F.col("piece.text").isNotNull())
    spans = spans.where((F.col("kind") != "assign") | (F.length(F.regexp_extract("piece.text", ASSIGN, 2)) >= 8))
    spans = spans.select("row", "kind", "rank", "part", "weak", (F.col("end") - F.col("piece.size")).alias("start"), "end")
    return rows.select("row", "doc_id"), materialize(spans, "secret-spans")


def link_parts(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans that complementary parts stand by, with the columns of ``spans``."""
    bucket = F.floor(F.col("start") / scope)
    near = spans.groupBy("row", "part", bucket.alias("bucket")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = near.select(F.col("row").alias("n_row"), F.col("part").alias("n_part"), F.col("bucket").alias("n_bucket"), "first", "last")
    weak = spans.where("weak").withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket + d)))
    # One bucket's starts are all in reach of each other; of the bucket before, the last start is nearest, of the one after the first.
    reached = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope) | (F.col("n_bucket") == bucket)
    met = weak.join(near, (F.col("row") == F.col("n_row")) & (F.col("bucket") == F.col("n_bucket")) & (F.col("part") != F.col("n_part")) & reached)
    keys = ["row", "kind", "rank", "part", "weak", "start", "end"]
    has = lambda p: F.max((F.col("n_part") == p).cast("int"))
    flags = met.groupBy(*keys).agg(has("id").alias("_id"), has("secret").alias("_secret"))
    enough = (
        F.when(F.col("part") == "id", F.col("_secret") == 1)
        .when(F.col("part") == "secret", F.col("_id") == 1)
        .otherwise((F.col("_id") == 1) & (F.col("_secret") == 1))
    )
    return flags.where(enough).select(*keys)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """doc_id and spans array<struct<start, rank, kind, end>> sorted by start, one row per input row; base spans and linked parts."""
    rows, spans = find_parts(docs, id_col, text_col)
    every = spans.where("not weak").unionByName(link_parts(spans, scope))
    by_row = every.groupBy(F.col("row").alias("s_row")).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.join(by_row, F.col("row") == F.col("s_row"), "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
