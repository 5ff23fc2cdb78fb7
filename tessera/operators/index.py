"""The inverted index as DataFrames, and its storage as Parquet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import STEM, STOPWORDS, TOKEN, analyzed_terms
from tessera.sources.shared import dropped, kept, state_of


@dataclass(frozen=True)
class Index:
    """Postings (field, term, doc_id, tf, length, positions), lengths (field, doc_id, length) and the stored rows.

    ``length`` stands with each posting, so ranking joins nothing by document.
    ``terms`` (field, term, df, total_tf) and ``fields`` (field, n_docs,
    average_length) are the statistics where they are stored with the index.
    ``tombstones`` (doc_id) are deleted rows: they still count in statistics,
    and no search returns them.
    """

    postings: DataFrame
    lengths: DataFrame
    stored: DataFrame
    tombstones: DataFrame | None = None
    terms: DataFrame | None = None
    fields: DataFrame | None = None

    def field_stats(self) -> DataFrame:
        """field, n_docs and average_length over all rows, those without the field included."""
        if self.fields is not None:
            return self.fields
        return self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("average_length"))

    def term_stats(self) -> DataFrame:
        """field, term, df and total_tf."""
        if self.terms is not None:
            return self.terms
        return self.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))

    def delete(self, ids: DataFrame) -> Index:
        """The index with more tombstones; ids has a doc_id column."""
        gone = ids.select("doc_id") if self.tombstones is None else self.tombstones.unionByName(ids.select("doc_id"))
        return replace(self, tombstones=gone.distinct())

    def compacted(self) -> Index:
        """The index rewritten without its tombstones."""
        if self.tombstones is None:
            return self
        live = lambda df: df.join(self.tombstones, "doc_id", "left_anti")
        return Index(live(self.postings), live(self.lengths), live(self.stored))

    def added(self, other: Index) -> Index:
        """One index of the documents of both, which must not share ids; statistics are counted anew."""
        gone = [i.tombstones for i in (self, other) if i.tombstones is not None]
        both = lambda name: getattr(self, name).unionByName(getattr(other, name), allowMissingColumns=True)
        return Index(both("postings"), both("lengths"), both("stored"), (gone[0] if len(gone) < 2 else gone[0].unionByName(gone[1])) if gone else None)

    def write(self, path: str, with_stored: bool = True) -> None:
        """Parquet folders below the path.

        Postings are dealt out by ranges of (field, term, doc_id), so a search
        reads the pages of its terms and a term that all documents hold spreads
        over tasks.
        """
        order = ["field", "term", "doc_id"]
        self.postings.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        back = Index(spark.read.parquet(f"{path}/postings"), self.lengths, self.stored)
        back.term_stats().repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
        self.lengths.write.parquet(f"{path}/lengths")
        replace(back, lengths=spark.read.parquet(f"{path}/lengths")).field_stats().write.parquet(f"{path}/fields")
        if with_stored:
            self.stored.write.parquet(f"{path}/stored")
        if self.tombstones is not None:
            self.tombstones.write.parquet(f"{path}/tombstones")


def _analysed(terms: DataFrame) -> DataFrame:
    """(doc_id, length, p) of rows (doc_id, terms): p has for each distinct term of the row its term, tf and positions.

    A row's terms are sorted and cut into runs in place, so nothing is shuffled or spilled.
    """
    # Each step is a column of its own: inside a lambda an expression is computed for every element.
    placed = terms.select("doc_id", F.size("terms").alias("length"), F.sort_array(F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))).alias("s"))
    parts = lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"])
    runs = placed.select("doc_id", "length", "s", F.filter(F.when(F.col("length") > 0, F.sequence(F.lit(0), F.col("length") - 1)), parts).alias("starts"))

    def posting(start: Column, k: Column) -> Column:
        last = F.coalesce(F.get("starts", k + 1), F.col("length")) - 1
        places = F.transform(F.sequence(start, last), lambda i: F.get("s", i)["pos"])
        return F.struct(F.get("s", start)["term"].alias("term"), (last - start + 1).alias("tf"), places.alias("positions"))

    return runs.select("doc_id", "length", F.transform("starts", posting).alias("p"))


def _exploded(rows: DataFrame) -> DataFrame:
    """(doc_id, length, term, tf, positions) of analysed rows. The array isn't carried past the explode: that would copy a whole text for each of its terms."""
    each = rows.select("doc_id", "length", F.explode_outer("p").alias("p"))  # outer: else a filter on the array's size follows, and computes it twice
    return each.where("p is not null").select("doc_id", "length", "p.term", "p.tf", "p.positions")


def _postings(rows: DataFrame) -> DataFrame:
    """The postings of analysed rows; those that share an id are one document, and only these are brought together."""
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"))
    if repeated.isEmpty():
        return _exploded(rows)
    mine = F.col("doc_id").eqNullSafe(F.col("_id"))
    shared = _exploded(rows.join(repeated, mine, "left_semi")).groupBy("doc_id", "term")
    whole = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    shared = shared.agg(F.max("length").alias("length"), F.sum("tf").cast("int").alias("tf"), whole).select("doc_id", "length", "term", "tf", "positions")
    return _exploded(rows.join(repeated, mine, "left_anti")).unionByName(shared)


def build_index(docs: DataFrame, text_fields: dict[str, Column], id_col: str = "doc_id", keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Index:
    """Inverts the named text fields. Each row's terms are counted in the row's own task: one row a document and term leaves it.

    ``keep`` may write the analysed rows of a field and return a scan of them, so
    that texts are analysed once for all that reads them.
    """
    postings, lengths = [], []
    for name, column in text_fields.items():
        rows = _analysed(docs.select(F.col(id_col).alias("doc_id"), analyzed_terms(column).alias("terms")))
        rows = keep(name, rows) if keep else rows
        lengths.append(rows.select(F.lit(name).alias("field"), "doc_id", "length"))
        postings.append(_postings(rows).select(F.lit(name).alias("field"), "term", "doc_id", "tf", "length", "positions"))
    both = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(both(frames[1:]))
    return Index(both(postings), both(lengths), docs)


def dealt_out(docs: DataFrame) -> DataFrame:
    """The rows dealt out over tasks where they lie in fewer than the session has: a table of one file would be analysed by one task."""
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartition(tasks) if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else docs


def document_terms(docs: DataFrame, text: Column, id_col: str = "doc_id", deal: bool = True) -> DataFrame:
    """(doc_id, terms): each row's distinct terms, found in the row's own task. Rows that share an id stay apart.

    Without ``deal`` rows stay where they are: those of a join are dealt out already, and asking for their number of tasks would run it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    listed = (dealt_out(rows) if deal else rows).select("doc_id", analyzed_terms(F.col("text")).alias("t"))
    return listed.select("doc_id", F.array_distinct("t").alias("terms"))


def distinct_postings(docs: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term) as an index of the rows holds them, without the index: only rows that share an id are brought together."""
    rows = document_terms(docs, text, id_col)
    each = lambda found: found.select("doc_id", F.explode_outer("terms").alias("term")).where("term is not null")
    repeated = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id")
    if repeated.isEmpty():
        return each(rows)
    mine = F.col("doc_id").eqNullSafe(F.col("_id"))
    return each(rows.join(repeated, mine, "left_anti")).unionByName(each(rows.join(repeated, mine, "left_semi")).distinct())


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, df) of (doc_id, term)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def open_index(spark: SparkSession, path: str, stored: DataFrame | None = None) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    try:
        gone = read("tombstones")
    except Exception as error:  # an index without deletions has no such folder
        if "PATH_NOT_FOUND" not in str(error):
            raise
        gone = None
    return Index(read("postings"), read("lengths"), read("stored") if stored is None else stored, gone, read("terms"), read("fields"))


def stored_index(docs: DataFrame, text_fields: dict[str, Column], id_col: str = "doc_id") -> Index:
    """The index of a table of files, built once for a state of the files and kept in the shared folder.

    The name holds the files' names, sizes and times, the fields and the
    analysis, so a table that changes gets an index of its own. A table without
    files is inverted on the spot.
    """
    state = state_of(docs)
    if state is None:
        return build_index(docs, text_fields, id_col)
    said = "|".join([state, id_col, *(f"{k}={v}" for k, v in text_fields.items()), TOKEN, STEM, *STOPWORDS])
    name = f"index-{hashlib.sha256(said.encode()).hexdigest()[:32]}"
    path = kept(docs.sparkSession, name, lambda at: _write_index(docs, text_fields, id_col, at))
    return open_index(docs.sparkSession, path, stored=docs)


def _write_index(docs: DataFrame, text_fields: dict[str, Column], id_col: str, path: str) -> None:
    """Writes the index of the rows, which are dealt out first."""
    spark = docs.sparkSession

    def keep(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{path}/rows/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/rows/{name}")

    build_index(dealt_out(docs), text_fields, id_col, keep).write(path, with_stored=False)
    dropped(spark, f"{path}/rows")
