"""Text index and BM25 search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.functions.text import tokens
from chronoweave.operators.lookup import top_k
from chronoweave.operators.ordered import is_small

# Fixed values of the ranking function.
BM25_K1 = 1.2
BM25_B = 0.75
# Scores are compared after rounding, so that the order in which a score's
# terms are added cannot decide between documents of equal score.
SCORE_DIGITS = 9
# A stored index keeps its postings in folders by a hash of the term.
TERM_BUCKET = "term_bucket"
TERM_BUCKETS = 64
# Up to so many query words are looked up by name in a stored index.
TERMS_BY_NAME = 1_000
# Words, and (document, query) pairs, that a task holds as arrays at once.
WORDS_AT_ONCE = 500_000
# Up to so many (query, word) pairs go to the tasks that score whole documents.
WEIGHTS_AT_HAND = 100_000


@dataclass
class TextIndex:
    postings: DataFrame  # kind, group_id, doc_uuid, term, tf, dl; stored ones have term_bucket
    terms: DataFrame  # term, df
    stats: DataFrame  # one row: n_docs, avgdl
    words: DataFrame | None = None  # kind, group_id, doc_uuid, _words: whole documents, when they are at hand


def _spans(sizes: np.ndarray) -> Iterator[slice]:
    """Rows in spans of about WORDS_AT_ONCE words; a longer document is a span of its own."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // WORDS_AT_ONCE)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(sizes)]):
        if hi > lo:
            yield slice(int(lo), int(hi))


def _in_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut into spans, with the number of words of each document."""
    for batch in batches:
        lengths = np.diff(batch.column("_words").offsets.to_numpy()).astype(np.int64)
        for span in _spans(lengths):
            yield batch.slice(span.start, span.stop - span.start), lengths[span]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole documents: (document, word) pairs counted per span of a batch."""
    for batch, lengths in _in_spans(batches):
        coded = batch.column("_words").flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        pair = np.repeat(np.arange(len(lengths)), lengths) * width + coded.indices.to_numpy()
        pairs, tf = np.unique(pair, return_counts=True)
        rows = pa.array(pairs // width)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c).take(rows) for c in ("kind", "group_id", "doc_uuid")],
                coded.dictionary.take(pa.array(pairs % width)),
                pa.array(tf.astype(np.int64)),
                pa.array(lengths).take(rows),
            ],
            names=["kind", "group_id", "doc_uuid", "term", "tf", "dl"],
        )


def _terms_of(weights: list) -> list[str]:
    return list(dict.fromkeys(w["term"] for w in weights))


def _best_of(weights: list, k: int) -> tuple[list, np.ndarray, Callable]:
    """(query ids, queries of each term, function to the k best of each query).

    `weights` has (query_id, term, idf, avgdl).  The function takes postings as
    (document, term, tf, dl), all those of a document at once, and gives
    (document, query, score); scores that rounding could make equal to the last
    one kept stay too.
    """
    query_ids = list(dict.fromkeys(w["query_id"] for w in weights))
    place = {q: i for i, q in enumerate(query_ids)}
    terms = _terms_of(weights)
    code = {t: i for i, t in enumerate(terms)}
    of_term = np.array([code[w["term"]] for w in weights])
    order = np.argsort(of_term, kind="stable")
    query = np.array([place[w["query_id"]] for w in weights])[order]
    idf = np.array([w["idf"] for w in weights])[order]
    n_of = np.bincount(of_term, minlength=len(terms))
    first = np.cumsum(n_of) - n_of
    avgdl = weights[0]["avgdl"]
    n_queries = len(query_ids)

    def best(rows: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = n_of[term]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[term], count)
        length = 1 - BM25_B + BM25_B * dl / avgdl
        share = idf[at] * np.repeat(tf, count) * (BM25_K1 + 1) / np.repeat(tf + BM25_K1 * length, count)
        pairs, which = np.unique(np.repeat(rows, count) * n_queries + query[at], return_inverse=True)
        score = np.bincount(which, weights=share, minlength=len(pairs))
        doc, asked = np.divmod(pairs, n_queries)
        order = np.lexsort((-score, asked))
        doc, asked, score = doc[order], asked[order], score[order]
        start = np.searchsorted(asked, np.arange(n_queries))
        size = np.bincount(asked, minlength=n_queries)
        last = score[np.where(size > 0, start + np.minimum(size, k) - 1, 0)]
        keep = score >= last[asked] - 10.0**-SCORE_DIGITS * 2
        return doc[keep], asked[keep], score[keep]

    return query_ids, n_of, best


def _score_words(weights: list, k: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of whole documents, per span the k best of each query."""
    query_ids, n_of, best = _best_of(weights, k)
    terms = _terms_of(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = pa.array(terms), pa.array(query_ids, id_type)
        for batch, lengths in _in_spans(batches):
            found = pc.index_in(batch.column("_words").flatten(), value_set=known)
            hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if not len(hit):
                continue
            row = np.repeat(np.arange(len(lengths)), lengths)[hit]
            pair = row * len(terms) + found.drop_null().to_numpy()
            pairs, tf = np.unique(pair, return_counts=True)
            rows, term = np.divmod(pairs, len(terms))
            for part in _spans(np.bincount(rows, weights=n_of[term], minlength=len(lengths)).astype(np.int64)):
                here = slice(*np.searchsorted(rows, [part.start, part.stop]))
                if here.start == here.stop:
                    continue
                doc, asked, score = best(rows[here], term[here], tf[here], lengths[rows[here]])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(asked)), batch.column("doc_uuid").take(pa.array(doc)), pa.array(score)],
                    names=["query_id", "uuid", "score"],
                )

    return run


def _score_postings(weights: list, k: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of postings (doc_uuid, term's place, tf, dl) that come document by document, per span the k best of each query.

    Postings are held until their (document, query) pairs are about
    WORDS_AT_ONCE; the last document waits for the rest of its own.
    """
    query_ids, n_of, best = _best_of(weights, k)

    def scored(held: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = held.column("doc_uuid").combine_chunks().dictionary_encode(null_encoding="encode")
        rows = coded.indices.to_numpy()
        columns = [held.column(c).to_numpy() for c in ("_term", "tf", "dl")]
        for part in _spans(np.bincount(rows, weights=n_of[columns[0]]).astype(np.int64)):
            here = slice(*np.searchsorted(rows, [part.start, part.stop]))
            doc, asked, score = best(rows[here], *[c[here] for c in columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids, id_type).take(pa.array(asked)), coded.dictionary.take(pa.array(doc)), pa.array(score)],
                names=["query_id", "uuid", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pairs = 0
        for batch in batches:
            held.append(batch)
            pairs += int(n_of[batch.column("_term").to_numpy()].sum())
            if pairs < WORDS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            ids = table.column("doc_uuid").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield from scored(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            pairs = int(n_of[table.column("_term").to_numpy()[cut:]].sum())
        if sum(len(b) for b in held):
            yield from scored(pa.Table.from_batches(held))

    return run


def term_bucket(term: Column) -> Column:
    """Folder of a term in a stored index."""
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def document_lengths(docs: DataFrame, id: str, text: Column, kind: str = "doc", group: str | None = None) -> DataFrame:
    """(kind, group_id, doc_uuid, dl): every document, those without a word included."""
    return docs.select(
        F.lit(kind).alias("kind"),
        (F.col(group) if group else F.lit(None).cast("string")).alias("group_id"),
        F.col(id).alias("doc_uuid"),
        F.coalesce(F.size(tokens(text)), F.lit(0)).cast("long").alias("dl"),
    )


def build_index(docs: DataFrame, id: str, text: Column, kind: str = "doc", group: str | None = None) -> TextIndex:
    """Postings, document frequencies and corpus statistics.

    All words of one document lie in one row, so its postings are complete
    without a shuffle: words are split on the JVM side and counted per Arrow
    batch with array operations.
    """
    words = docs.select(
        F.lit(kind).alias("kind"),
        (F.col(group) if group else F.lit(None).cast("string")).alias("group_id"),
        F.col(id).alias("doc_uuid"),
        tokens(text).alias("_words"),
    )
    id_type = words.schema["doc_uuid"].dataType.simpleString()
    schema = f"kind string, group_id string, doc_uuid {id_type}, term string, tf long, dl long"
    postings = words.mapInArrow(_count_words, schema)
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("_words")).alias("avgdl"))
    return TextIndex(postings, terms, stats, words)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each word once per query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _only_terms(postings: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Of stored postings, the folders and row groups of the wanted words.

    The words are named in the plan up to a stated number, and folders beyond
    it: at most TERM_BUCKETS of them.  Postings in memory are left as they are.
    """
    if TERM_BUCKET not in postings.columns or not small:
        return postings
    asked = wanted.select("term", term_bucket(F.col("term")).alias("b")).distinct()
    named = asked.limit(TERMS_BY_NAME + 1).collect()
    if len(named) <= TERMS_BY_NAME:
        in_folders = F.col(TERM_BUCKET).isin(sorted({r["b"] for r in named}))
        return postings.filter(in_folders & F.col("term").isin(sorted(r["term"] for r in named)))
    folders = [r["b"] for r in asked.select("b").distinct().collect()]
    return postings.filter(F.col(TERM_BUCKET).isin(sorted(folders)))


def bm25_search(
    index: TextIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None, in_place: bool = False
) -> DataFrame:
    """The k best documents per query as (query_id, uuid, score, rank).

    Statistics are those of the whole index; `allowed` (uuid) restricts the
    candidates only.  The query words are broadcast after a size check, so the
    postings of a frequent word are found where they are; they are brought
    together by document and scored there, k best per query and span, so no
    (query, document) pair is shuffled or held.  With more query words the
    shuffle is by (query, document).  Of a stored index only the folders of the query words
    are read.  With `in_place`, a task scores the whole documents of an index
    that has them at hand, and sends its k best per query only.
    """
    wanted = query_terms(queries)
    small = is_small(wanted)
    # frequencies are counted for the wanted words only
    asked = index.terms.join(_hinted(wanted.select("term").distinct(), small), "term", "left_semi")
    n, df, tf = F.col("n_docs"), F.col("df"), F.col("tf")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    length = 1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")
    weighted = (
        wanted.join(asked, "term")
        .crossJoin(F.broadcast(index.stats))  # one row
        .select("query_id", "term", idf.alias("idf"), "avgdl")
    )
    if small:
        weights = weighted.limit(WEIGHTS_AT_HAND + 1).collect()
        if 0 < len(weights) <= WEIGHTS_AT_HAND:
            # rows that share an id are one document: their sums need the postings
            if in_place and index.words is not None and allowed is None and not _ids_shared(index.words):
                return _best_documents(index.words, weights, queries, k)
            return _best_by_document(_only_terms(index.postings, wanted, small), weights, queries, k, allowed)
    scored = (
        _only_terms(index.postings, wanted, small)
        .join(_hinted(weighted, small), "term")
        .select("query_id", "doc_uuid", (F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * length)).alias("_s"))
        .groupBy("query_id", "doc_uuid")
        .agg(F.round(F.sum("_s"), SCORE_DIGITS).alias("score"))
        .withColumnRenamed("doc_uuid", "uuid")
    )
    if allowed is not None:  # after scoring: only documents with a query word meet the candidates
        scored = scored.join(allowed.select("uuid"), "uuid", "left_semi")
    return top_k(scored, k, [F.desc("score")], ["uuid"], ["query_id"])


def _ids_shared(words: DataFrame) -> bool:
    return not words.groupBy("doc_uuid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _best_by_document(postings: DataFrame, weights: list, queries: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """The k best documents from the postings of the weighted words, sorted by document in every task."""
    terms = [(t, i) for i, t in enumerate(_terms_of(weights))]
    places = F.broadcast(postings.sparkSession.createDataFrame(terms, "term string, _term long"))
    found = postings.join(places, "term").select("doc_uuid", "_term", "tf", "dl")
    if allowed is not None:
        found = found.join(allowed.select(F.col("uuid").alias("doc_uuid")), "doc_uuid", "left_semi")
    found = found.repartition("doc_uuid").sortWithinPartitions("doc_uuid")
    return _ranked(found, _score_postings, weights, queries, k)


def _best_documents(words: DataFrame, weights: list, queries: DataFrame, k: int) -> DataFrame:
    return _ranked(words, _score_words, weights, queries, k)


def _ranked(rows: DataFrame, scorer: Callable, weights: list, queries: DataFrame, k: int) -> DataFrame:
    id_field = queries.select("query_id").schema["query_id"]
    schema = T.StructType(
        [
            T.StructField("query_id", id_field.dataType),
            T.StructField("uuid", rows.schema["doc_uuid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    score = scorer(weights, k, to_arrow_type(id_field.dataType))
    found = rows.mapInArrow(score, schema).withColumn("score", F.round("score", SCORE_DIGITS))
    return top_k(found, k, [F.desc("score")], ["uuid"], ["query_id"])
