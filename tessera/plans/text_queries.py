"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators.index import stored_index
from tessera.operators.suggest import suggestions, within_edits
from tessera.plans.catalog import register
from tessera.plans.oracles import INDEX, terms_sql


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


_RAW = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w))"


@register("analyze_terms", f"SELECT doc_id, array_to_string({terms_sql()}, ' ') AS terms, len({terms_sql()})::INT AS length FROM documents")
def analyze_terms(spark, sf_dir):
    terms = _docs(spark, sf_dir).select("doc_id", T.analyzed_terms(F.col("text")).alias("t"))
    return terms.select("doc_id", F.array_join("t", " ").alias("terms"), F.size("t").alias("length"))


@register("char_ngrams", "SELECT p_partkey, array_to_string(list_transform(generate_series(1, length(p_name)), lambda i: (chr(2) || p_name || chr(3))[i:i+2]), '|') AS grams FROM part")
def char_ngrams(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(T.ngrams(F.col("p_name"), 3), "|").alias("grams"))


def _vocabulary(spark, sf_dir):
    """term and df of the documents, from their stored index."""
    return stored_index(_docs(spark, sf_dir), {"text": F.col("text")}).term_stats().select("term", "df")


_CLASS = "CASE " + " ".join(f"WHEN contains('{of}', c) THEN '{d}'" for d, of in (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r"))) + " ELSE '0' END"


@register(
    "phonetic",
    f"""WITH {INDEX}, w AS (SELECT DISTINCT term, regexp_extract_all(lower(term), '\\p{{L}}') AS l FROM post), d AS (SELECT l, list_transform(l, lambda c: {_CLASS}) AS d FROM w WHERE len(l) > 0)
SELECT rpad((CASE l[1] WHEN 'ß' THEN 'SS' ELSE upper(l[1]) END || array_to_string(list_filter(d, lambda x, i: i > 1 AND x <> '0' AND x <> d[i - 1])[1:3], ''))[1:4], 4, '0') AS code, count(*) AS n_words FROM d GROUP BY code""",
)
def phonetic(spark, sf_dir):
    """Terms that sound alike."""
    coded = _vocabulary(spark, sf_dir).select(T.phonetic_code(F.col("term")).alias("code")).where("code is not null")
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n_words"))


def _share(lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS[lang])
    return f"len(list_filter({_RAW}, lambda w: w IN ({listed}))) / greatest(len({_RAW}), 1)"


@register(
    "language_sniff",
    f"""SELECT doc_id, CASE WHEN n >= 4 AND s[1].share - s[2].share >= 0.1 THEN s[1].lang END AS language FROM (SELECT doc_id, len({_RAW}) AS n,
list_sort([{", ".join(f"{{'share': {_share(k)}, 'lang': '{k}'}}" for k in T.FUNCTION_WORDS)}], 'DESC') AS s FROM documents)""",
)
def language_sniff(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.sniff_language(F.col("text")).alias("language"))


@register("edit_distance", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INT AS distance FROM n a JOIN n b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2")
def edit_distance(spark, sf_dir):
    """All pairs of names at most two edits apart."""
    names = _parts(spark, sf_dir).select(F.col("p_name").alias("a")).where("a is not null").distinct()
    return within_edits(names, names.select(F.col("a").alias("b")), 2).where("a < b")


@register(
    "text_profile",
    f"""SELECT doc_id, len({_RAW}) AS words, round_even(len(list_distinct({_RAW})) / greatest(len({_RAW}), 1), 4) AS unique_share,
round_even(len(list_filter({_RAW}, lambda w: regexp_full_match(w, '[0-9]+'))) / greatest(len({_RAW}), 1), 4) AS number_share,
round_even(len({_RAW}) / greatest(len(regexp_extract_all(text, '[.!?]+')), 1), 4) AS words_per_sentence FROM documents""",
)
def text_profile(spark, sf_dir):
    base = _docs(spark, sf_dir).select("doc_id", "text", F.transform(T.raw_tokens(F.col("text")), F.lower).alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("words"),
        F.bround(F.size(F.array_distinct("w")) / n, 4).alias("unique_share"),
        F.bround(F.size(F.filter("w", lambda x: x.rlike("^[0-9]+$"))) / n, 4).alias("number_share"),
        F.bround(F.size("w") / F.greatest(F.regexp_count("text", F.lit("[.!?]+")), F.lit(1)), 4).alias("words_per_sentence"),
    )


@register("scrub")
def scrub(spark, sf_dir):
    """Digests of scrubbed texts; the patterns look around them, which DuckDB's can't, so tests hold them against plain Python."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.scrub(F.col("text"))).alias("digest"))


_LIGATED = "w"
for _from, _to in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("ø", "o"), ("đ", "d"), ("ł", "l")):
    _LIGATED = f"replace({_LIGATED}, '{_from}', '{_to}')"


@register("fold_accents", f"SELECT strip_accents({_LIGATED}) AS folded, count(DISTINCT w) AS spellings FROM (SELECT unnest({_RAW}) AS w FROM documents) GROUP BY folded HAVING count(DISTINCT w) > 1")
def fold_accents(spark, sf_dir):
    """Words that fold to one spelling."""
    words = _docs(spark, sf_dir).select(F.explode(F.array_distinct(F.transform(T.raw_tokens(F.col("text")), F.lower))).alias("w")).distinct()
    return words.groupBy(T.fold(F.col("w")).alias("folded")).agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1")


@register("escape_html", "SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM documents")
def escape_html(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.escape_html(F.col("text"))).alias("digest"))


@register("split_identifiers")
def split_identifiers(spark, sf_dir):
    """Parts of brand and type names; the seams need lookarounds, which DuckDB's patterns lack."""
    names = _parts(spark, sf_dir).select("p_partkey", F.concat_ws("_", F.initcap("p_type"), "p_brand").alias("name"))
    return names.select("p_partkey", F.array_join(T.split_identifier(F.col("name")), " ").alias("parts"))


@register("autocomplete", f"WITH {INDEX} SELECT prefix, term, df FROM (SELECT term[1:3] AS prefix, term, df, row_number() OVER (PARTITION BY term[1:3] ORDER BY df DESC, term) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY term) WHERE length(term) >= 3) WHERE r <= 3")
def autocomplete(spark, sf_dir):
    """For each beginning of three characters the three most frequent terms, by a window over the vocabulary's stored counts."""
    ranked = _vocabulary(spark, sf_dir).where(F.length("term") >= 3).withColumn("prefix", F.substring("term", 1, 3))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("df"), "term"))).where("r <= 3")
    return ranked.select("prefix", "term", "df")


@register("bigrams", f"SELECT struct_extract(z, 1) || ' ' || struct_extract(z, 2) AS bigram, count(*) AS n FROM (SELECT unnest(list_zip(t[1:len(t)-1], t[2:])) AS z FROM (SELECT {terms_sql()} AS t FROM conversations)) GROUP BY 1 HAVING count(*) >= 2")
def bigrams(spark, sf_dir):
    """Neighbouring terms that were seen twice or more."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(T.analyzed_terms(F.col("text")).alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat_ws(" ", F.get("t", i), F.get("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    return turns.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


_TYPED = "(SELECT DISTINCT term[1:1] || term[3:] AS word FROM t WHERE length(term) >= 6 AND df >= 50)"
# DuckDB counts edits in bytes, so letters of two bytes are exchanged for marks of one.
_DISTANCE = "levenshtein(translate(word, 'äöüßéèêëàâáíîïóôúûùçñ', '!#$%&()*+,./:;<=>?@[]'), translate(term, 'äöüßéèêëàâáíîïóôúûùçñ', '!#$%&()*+,./:;<=>?@[]'))"
_GRAMS = "list_transform(generate_series(1, length({0})), lambda i: (chr(2) || {0} || chr(3))[i:i+2])"


@register(
    "suggest_terms",
    f"""WITH {INDEX}, t AS (SELECT term, count(*) AS df FROM post GROUP BY term), q AS (SELECT word FROM {_TYPED} WHERE word NOT IN (SELECT term FROM t)),
m AS (SELECT word, term, {_DISTANCE}::INT AS distance, df AS popularity FROM q JOIN t ON abs(length(word) - length(term)) <= 2 WHERE {_DISTANCE} <= 2 AND list_has_any({_GRAMS.format("word")}, {_GRAMS.format("term")}))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, popularity DESC, term)::INT AS rank FROM m) WHERE rank <= 3""",
)
def suggest_terms(spark, sf_dir):
    """What to offer for common words that lack their second letter: vocabulary with a common trigram, at most two edits away, popular first."""
    known = _vocabulary(spark, sf_dir)
    typed = known.where((F.length("term") >= 6) & (F.col("df") >= 50)).select(F.concat(F.substring("term", 1, 1), F.substring("term", 3, 1 << 20)).alias("word"))
    unknown = typed.distinct().hint("merge").join(known.select(F.col("term").alias("word")), "word", "left_anti")
    return suggestions(unknown, known.select("term", F.col("df").alias("popularity")))
