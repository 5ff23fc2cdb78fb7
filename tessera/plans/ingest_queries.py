"""Queries over feeds, exports, versions of tables and what their fields hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators.sketches import hash64
from tessera.plans.catalog import register
from tessera.sources import feeds


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [feeds.Rule("body", ("html",), required=True), feeds.Rule("link", ("url",)), feeds.Rule("title", ("title", "url")), feeds.Rule("kind", constant="page")]


@register(
    "feed_adapt",
    """SELECT complaint, kind, count(*) AS pages, count(link) AS linked, sum(dropped)::BIGINT AS dropped FROM (SELECT CASE WHEN html IS NULL OR html = '' THEN 'required field body has no source' END AS complaint, 'page' AS kind, nullif(url, '') AS link, 1 AS dropped FROM pages) GROUP BY complaint, kind""",
)
def feed_adapt(spark, sf_dir):
    """Pages mapped to fields; rows that lack a required field keep a complaint."""
    shaped = feeds.adapt(_table(spark, sf_dir, "pages"), RULES)
    return shaped.groupBy("complaint", "kind").agg(F.count(F.lit(1)).alias("pages"), F.count("link").alias("linked"), F.sum("dropped").alias("dropped"))


_CLEAN = """a AS (SELECT page_id, html AS t0, regexp_replace(html, '<[^>]{1,200}>', ' ', 'g') AS t1 FROM pages WHERE html IS NOT NULL), b AS (SELECT *, regexp_replace(t1, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(t2, '[\\x{AD}\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g') AS t3 FROM b), d AS (SELECT *, trim(regexp_replace(t3, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g')) AS t4 FROM c)"""


@register("feed_clean", f"WITH {_CLEAN} SELECT page_id, md5(t4) AS digest, t1 <> t0 AS markup, t2 <> t1 AS control, t3 <> t2 AS invisibles, t4 <> t3 AS whitespace FROM d")
def feed_clean(spark, sf_dir):
    """Pages without markup, control characters and invisible ones, white space collapsed; and which stage changed each."""
    text, touched = feeds.cleaned(F.col("html"))
    return _table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.md5(text).alias("digest"), *(c.alias(k) for k, c in touched.items()))


@register(
    "bulk_admission",
    """WITH j AS (SELECT doc_id, md5(text) AS key, CASE WHEN text IS NULL THEN 'no key' WHEN n_chars < 100 THEN 'too short' END AS problem FROM documents), f AS (SELECT *, min(doc_id) FILTER (problem IS NULL) OVER (PARTITION BY key) AS first FROM j)
SELECT doc_id, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN first < doc_id THEN 'duplicate' ELSE 'admitted' END AS status, problem FROM f""",
)
def bulk_admission(spark, sf_dir):
    """Documents admitted once for each text; short ones are refused and claim nothing."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"), "n_chars")
    return feeds.admitted(docs, "key", "doc_id", F.when(F.col("n_chars") < 100, "too short")).select("doc_id", "status", "problem")


@register("export_pages", "SELECT page, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS cursor, sum(n_chars)::BIGINT AS chars FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS page FROM documents WHERE doc_id % 3 <> 0) GROUP BY page")
def export_pages(spark, sf_dir):
    """The live documents in pages of 200 by id: each page's rows, first id, cursor and characters."""
    live = _table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", "n_chars")
    paged = feeds.pages(live, "doc_id", 200)
    return paged.groupBy("page").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("cursor"), F.sum("n_chars").alias("chars"))


def table_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, change and field: rows of one side only, and each field in which rows of both differ (nulls are equal)."""
    fields = [c for c in left.columns if c != key]
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("the tables must have the same columns")
    a = left.select(key, F.struct(*fields).alias("a"))
    b = right.select(key, F.struct(*fields).alias("b"))
    differ = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    told = F.when(F.col("a").isNull(), F.array(F.struct(F.lit("only right").alias("change"), F.lit(None).cast("string").alias("field"))))
    told = told.when(F.col("b").isNull(), F.array(F.struct(F.lit("only left").alias("change"), F.lit(None).cast("string").alias("field"))))
    told = told.otherwise(F.transform(differ, lambda f: F.struct(F.lit("differs").alias("change"), f.alias("field"))))
    return a.join(b, key, "full").select(key, F.explode(told).alias("t")).select(key, "t.change", "t.field")


_VERSIONS = """l AS (SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey % 7 <> 0), r AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)"""


def _versions(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    brand = F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand"))
    size = F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return part.where("p_partkey % 7 <> 0"), part.where("p_partkey % 5 <> 0").withColumns({"p_brand": brand, "p_size": size})


@register(
    "index_diff",
    f"""WITH {_VERSIONS}, f AS (SELECT p_partkey, l.p_partkey IS NOT NULL AS hl, r.p_partkey IS NOT NULL AS hr, l.p_name IS DISTINCT FROM r.p_name AS dn, l.p_brand IS DISTINCT FROM r.p_brand AS db, l.p_size IS DISTINCT FROM r.p_size AS ds FROM l FULL JOIN r USING (p_partkey))
SELECT p_partkey, 'only left' AS change, NULL AS field FROM f WHERE NOT hr UNION ALL SELECT p_partkey, 'only right', NULL FROM f WHERE NOT hl
UNION ALL SELECT p_partkey, 'differs', 'p_name' FROM f WHERE hl AND hr AND dn UNION ALL SELECT p_partkey, 'differs', 'p_brand' FROM f WHERE hl AND hr AND db UNION ALL SELECT p_partkey, 'differs', 'p_size' FROM f WHERE hl AND hr AND ds""",
)
def index_diff(spark, sf_dir):
    """Two versions of a table, row for row and field for field."""
    return table_diff(*_versions(spark, sf_dir), "p_partkey")


@register(
    "anti_entropy",
    """WITH a AS (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 37 = 0 THEN p_size + 1 WHEN p_partkey % 41 = 0 THEN p_size - 1 ELSE p_size END AS v FROM part WHERE p_partkey % 50 <> 0)
SELECT id, CASE WHEN coalesce(a.v, 0) > coalesce(b.v, 0) THEN 'right' ELSE 'left' END AS behind, least(coalesce(a.v, 0), coalesce(b.v, 0)) AS old, greatest(coalesce(a.v, 0), coalesce(b.v, 0)) AS new FROM a FULL JOIN b USING (id) WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)""",
)
def anti_entropy(spark, sf_dir):
    """What two stores of versions must repair: only buckets whose digests differ are opened, and the newer version wins."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    moved = F.when(F.col("id") % 37 == 0, F.col("v") + 1).when(F.col("id") % 41 == 0, F.col("v") - 1).otherwise(F.col("v"))
    return repairs(part.where("id % 9 <> 0"), part.where("id % 50 <> 0").withColumn("v", moved))


def repairs(left: DataFrame, right: DataFrame, buckets: int = 1024) -> DataFrame:
    """id, behind (the side that must change), old and new of two stores (id, v); an absent row has version 0."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets))
    digest = lambda df, name: df.groupBy(bucket.alias("bucket")).agg(F.bit_xor(F.xxhash64("id", "v")).alias(name))
    both = digest(left, "x").join(digest(right, "y"), "bucket", "full")
    opened = F.broadcast(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("bucket"))  # ``buckets`` rows at most
    mine = lambda df, name: df.withColumn("bucket", bucket).join(opened, "bucket", "left_semi").select("id", F.col("v").alias(name))
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    found = mine(left, "a").join(mine(right, "b"), "id", "full").where(a != b)
    return found.select("id", F.when(a > b, "right").otherwise("left").alias("behind"), F.least(a, b).alias("old"), F.greatest(a, b).alias("new"))


_CENSUS = ("doc_id", "text", "lang", "source", "n_chars")


@register(
    "field_census",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS filled, count(*) AS n, count(DISTINCT {c}) AS d FROM documents" for c in _CENSUS)
    + ") SELECT field, round_even(filled / n, 4) AS fill_rate, d AS n_distinct, CASE WHEN d <= 1 THEN 'constant' WHEN d > filled * 0.8 THEN 'unbounded' WHEN d <= 20 THEN 'low' ELSE 'moderate' END AS cardinality FROM c",
)
def field_census(spark, sf_dir):
    """Each field's fill, distinct values and what they make it good for; long values are told apart by digest."""
    docs = _table(spark, sf_dir, "documents")
    longs = lambda c: F.sha2(F.col(c), 256) if dict(docs.dtypes)[c] == "string" else F.col(c).cast("string")
    rows = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), longs(c).alias("value")) for c in _CENSUS))).alias("r")).select("r.field", "r.value")
    counts = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("c"))  # equal values are summed before they move
    held = F.col("value").isNotNull()
    sums = counts.groupBy("field").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(held, F.col("c"))), F.lit(0)).alias("filled"), F.count(F.when(held, 1)).alias("n_distinct"))
    kind = F.when(F.col("n_distinct") <= 1, "constant").when(F.col("n_distinct") > F.col("filled") * 0.8, "unbounded").when(F.col("n_distinct") <= 20, "low").otherwise("moderate")
    return sums.select("field", F.bround(F.col("filled") / F.col("n"), 4).alias("fill_rate"), "n_distinct", kind.alias("cardinality"))


_SHAPED = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'about ' || strftime(o_orderdate, '%Y') END AS s, o_orderdate::DATE AS d FROM orders"""


@register(
    "date_shapes",
    f"""WITH s AS ({_SHAPED}), p AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'iso' WHEN o_orderkey % 6 = 1 THEN 'compact' WHEN o_orderkey % 6 = 2 THEN 'slashed' WHEN o_orderkey % 6 = 5 THEN 'unknown' WHEN day(d) <= 12 AND day(d) <> month(d) THEN 'ambiguous' ELSE 'slashed' END AS shape, date_diff('day', DATE '1970-01-01', d) AS days FROM s)
SELECT shape, count(*) AS n, (sum(days) FILTER (shape NOT IN ('ambiguous', 'unknown')))::BIGINT AS days FROM p GROUP BY shape""",
)
def date_shapes(spark, sf_dir):
    """Order dates written in several shapes and read back; those whose day and month could change places are told apart."""
    date = F.col("o_orderdate")
    shapes = ["yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy"]
    text = reduce(lambda c, kf: c.when(F.col("o_orderkey") % 6 == kf[0], F.date_format(date, kf[1])), enumerate(shapes[1:], 1), F.when(F.col("o_orderkey") % 6 == 0, F.date_format(date, shapes[0])))
    read = _table(spark, sf_dir, "orders").select(V.parse_date(text.otherwise(F.concat(F.lit("about "), F.date_format(date, "yyyy")))).alias("p"))
    return read.groupBy("p.shape").agg(F.count(F.lit(1)).alias("n"), F.sum("p.days").alias("days"))


@register(
    "unit_amounts",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size * [1, 1000, 1000000][p_partkey % 4 + 1] END::BIGINT AS items, CASE WHEN p_size % 2 = 0 OR p_partkey % 3 > 0 THEN (p_size / 2.0 * [1, 1024, 1048576][p_partkey % 3 + 1])::BIGINT END AS bytes, (p_size * [1, 1000, 60000, 3600000][p_partkey % 4 + 1])::BIGINT AS ms FROM part""",
)
def unit_amounts(spark, sf_dir):
    """Amounts written with units and read back; halves of a byte and unknown units are not read."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % by + 1).cast("int"))
    said = part.select(
        "p_partkey",
        F.concat(F.col("p_size").cast("string"), pick(["", "k", " M", "dozen"], 4)).alias("count"),
        F.concat((F.col("p_size") / 2.0).cast("string"), pick(["b", "KiB", " mib"], 3)).alias("bytes"),
        F.concat(F.col("p_size").cast("string"), pick(["ms", "s", "m", "h"], 4)).alias("ms"),
    )
    read = {"items": V.parse_quantity(F.col("count"), V.COUNTS), "bytes": V.parse_quantity(F.col("bytes"), V.BYTES), "ms": V.parse_quantity(F.col("ms"), V.DURATIONS_MS)}
    return said.select("p_partkey", *(c.alias(k) for k, c in read.items()))


_LUHN = "list_sum(list_transform(list_reverse(string_split({0}, '')), lambda c, i: CASE WHEN i % 2 = {1} AND c::INT * 2 > 9 THEN c::INT * 2 - 9 WHEN i % 2 = {1} THEN c::INT * 2 ELSE c::INT END))"


@register(
    "check_digits",
    f"WITH s AS (SELECT doc_id, doc_id || ((10 - {_LUHN.format('doc_id::VARCHAR', 1)} % 10) % 10)::INT::VARCHAR AS stamped FROM documents) SELECT doc_id, stamped, doc_id AS verified, {_LUHN.format('reverse(stamped)', 0)} % 10 = 0 AS reversed_passes FROM s",
)
def check_digits(spark, sf_dir):
    """Ids with their check digits, read back, and whether the digits in reverse would pass too."""
    stamped = _table(spark, sf_dir, "documents").select("doc_id", V.stamp(F.col("doc_id")).alias("stamped"))
    return stamped.select("doc_id", "stamped", V.verify(F.col("stamped")).alias("verified"), V.verify(F.reverse("stamped")).isNotNull().alias("reversed_passes"))


KEEP_DAYS = {"1-URGENT": 900, "2-HIGH": 1200, "3-MEDIUM": 1500, "4-NOT SPECIFIED": 1800, "5-LOW": 2100}


def expired(rows: DataFrame, kind: str, day: str, rules: dict[str, int], today: str, held) -> DataFrame:
    """The rows with age in days, covered (whether a rule names their kind) and expired: older than their rule keeps them and not under hold."""
    keep = reduce(lambda c, kv: c.when(F.col(kind) == kv[0], F.lit(kv[1])), rules.items(), F.when(F.lit(False), F.lit(0)))
    aged = rows.withColumns({"age": F.datediff(F.lit(today), F.col(day)), "_keep": keep})
    return aged.withColumns({"covered": F.col("_keep").isNotNull(), "expired": F.coalesce((F.col("age") > F.col("_keep")) & ~held, F.lit(False))}).drop("_keep")


@register(
    "retention_sweep",
    f"""WITH k(p, keep) AS (VALUES {", ".join(f"('{p}', {d})" for p, d in KEEP_DAYS.items())}), a AS (SELECT o_orderpriority AS p, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS age, keep, o_orderkey % 10 = 0 AS held FROM orders LEFT JOIN k ON p = o_orderpriority)
SELECT p AS priority, count(*) AS orders, count(*) FILTER (age > keep AND NOT held) AS expired, count(*) FILTER (age > keep AND held) AS held, count(*) FILTER (keep IS NULL) AS uncovered FROM a GROUP BY p""",
)
def retention_sweep(spark, sf_dir):
    """Orders older than their priority keeps them; those under hold stay, and kinds without a rule are told."""
    held = F.col("o_orderkey") % 10 == 0
    swept = expired(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", KEEP_DAYS, "1998-08-02", held)
    kept = reduce(lambda c, kv: c | ((F.col("o_orderpriority") == kv[0]) & (F.col("age") > kv[1])), KEEP_DAYS.items(), F.lit(False))
    return swept.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("orders"), F.count_if("expired").alias("expired"), F.count_if(kept & held).alias("held"), F.count_if(~F.col("covered")).alias("uncovered"))


@register("provenance", "SELECT source AS feed, count(*) AS documents, count(l.doc_id) AS corrected, round_even(count(l.doc_id) / count(*), 4) AS share FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def provenance(spark, sf_dir):
    """Documents by the feed they came from, and how many were touched since (here: labelled)."""
    touched = _table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("t", F.lit(1))
    met = _table(spark, sf_dir, "documents").select("doc_id", "source").join(touched, "doc_id", "left")
    counts = met.groupBy(F.col("source").alias("feed")).agg(F.count(F.lit(1)).alias("documents"), F.count("t").alias("corrected"))
    return counts.withColumn("share", F.bround(F.col("corrected") / F.col("documents"), 4))


MASKS = {"public": {"c_acctbal", "c_mktsegment"}, "sales": {"c_acctbal"}, "audit": set()}


def masked_columns(rows: DataFrame, roles: tuple[str, ...], masks: dict[str, set[str]] = MASKS) -> DataFrame:
    """The rows without the columns that any of the roles must not see; an unknown role, or none, is masked like the strictest."""
    strictest = max(masks.values(), key=len)
    gone = set().union(*(masks.get(r, strictest) for r in roles)) if roles else strictest
    return rows.drop(*gone)


@register(
    "field_masks",
    "SELECT unnest(['audit', 'sales', 'audit+sales', 'guest']) AS roles, unnest([(SELECT round_even(sum(c_acctbal), 2) FROM customer), NULL, NULL, NULL]) AS balance, unnest([(SELECT count(DISTINCT c_mktsegment) FROM customer), (SELECT count(DISTINCT c_mktsegment) FROM customer), (SELECT count(DISTINCT c_mktsegment) FROM customer), NULL]) AS segments",
)
def field_masks(spark, sf_dir):
    """What some roles can still sum up of the customers; a masked column is gone before anything is computed."""
    customers = _table(spark, sf_dir, "customer")
    out = None
    for roles in (("audit",), ("sales",), ("audit", "sales"), ("guest",)):
        seen = masked_columns(customers, roles)
        balance = F.bround(F.sum("c_acctbal"), 2) if "c_acctbal" in seen.columns else F.lit(None).cast("double")
        segments = F.count_distinct("c_mktsegment") if "c_mktsegment" in seen.columns else F.lit(None).cast("long")
        row = seen.agg(F.lit("+".join(roles)).alias("roles"), balance.alias("balance"), segments.alias("segments"))
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "hash_ring",
    """WITH n AS (SELECT unnest(['n0', 'n1', 'n2', 'n3', 'n4']) AS node), pt AS (SELECT node, ('0x' || sha256(node || '#' || r)[1:16])::UBIGINT AS p FROM n, (SELECT unnest(generate_series(0, 63)) AS r)), k AS (SELECT doc_id, ('0x' || sha256(doc_id::VARCHAR)[1:16])::UBIGINT AS h FROM documents),
o AS (SELECT doc_id, coalesce((SELECT arg_min(node, p) FROM pt WHERE p > h), (SELECT arg_min(node, p) FROM pt)) AS owner, coalesce((SELECT arg_min(node, p) FROM pt WHERE p > h AND node <> 'n4'), (SELECT arg_min(node, p) FROM pt WHERE node <> 'n4')) AS later FROM k)
SELECT owner, later, count(*) AS keys FROM o GROUP BY ALL""",
)
def hash_ring(spark, sf_dir):
    """The owners of keys on a ring of five nodes, and of four: only the lost node's keys move."""
    keys = _table(spark, sf_dir, "documents").select(hash64(F.col("doc_id").cast("string")).alias("h"))
    five = ("n0", "n1", "n2", "n3", "n4")
    return keys.select(ring_owner(F.col("h"), five).alias("owner"), ring_owner(F.col("h"), five[:4]).alias("later")).groupBy("owner", "later").agg(F.count(F.lit(1)).alias("keys"))


def ring_owner(point, nodes: tuple[str, ...], replicas: int = 64):
    """The node of the first of the ring's points past the given one; the points are a constant array."""
    import hashlib

    points = sorted((int.from_bytes(hashlib.sha256(f"{n}#{r}".encode()).digest()[:8], "big"), n) for n in nodes for r in range(replicas))
    ring = F.from_json(F.lit("[" + ",".join(f'{{"p":{p},"n":"{n}"}}' for p, n in points) + "]"), "array<struct<p:decimal(20,0),n:string>>")
    past = F.array_min(F.filter(ring, lambda x: x["p"] > point))
    return F.coalesce(past["n"], F.array_min(ring)["n"])
