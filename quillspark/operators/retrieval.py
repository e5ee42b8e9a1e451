"""Hybrid search: gate, fusion, re-ranking, floor, near-duplicate suppression.

Every step is a DataFrame of hits keyed by (query_id, id), for any number of queries at once.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import citation, place
from ..functions.text import expand_synonyms
from .store import Store
from .tables import materialize

RRF_K, CANDIDATES, HEAD, RESULTS = 60, 30, 16, 4
THRESHOLD, FLOOR, SAME_RATIO = 0.5, 1.0, 0.98


def gate(nearest: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id) of the queries with any vector candidate within the threshold."""
    return nearest.where(F.col("distance") <= threshold).select("query_id").distinct()


def fuse(nearest: DataFrame, lexical: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Admitted hits with their RRF score and final order.

    nearest is (query_id, id, distance, rank), lexical (query_id, id, score, rank). Closed queries are dropped first, so
    their lexical side is never joined; ranks are those before admission. A null distance or score wasn't measured.
    """
    open_queries = gate(nearest, threshold)
    v = nearest.join(open_queries, "query_id", "left_semi").select("query_id", "id", "distance", F.col("rank").alias("vector_rank"))
    b = lexical.join(open_queries, "query_id", "left_semi").select("query_id", "id", F.col("score").alias("bm25"), F.col("rank").alias("bm25_rank"))
    share = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    hits = v.join(b, ["query_id", "id"], "full_outer").withColumn("rrf", share("vector_rank") + share("bm25_rank"))
    hits = hits.where((F.col("distance") <= threshold) | F.col("bm25").isNotNull())
    return hits.withColumn("position", F.row_number().over(_final_order()))


def _final_order():
    return Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.coalesce("distance", F.lit(99.0)), F.coalesce("bm25", F.lit(0.0)).desc(), "id")


def rerank(hits: DataFrame, score: Column, head: int = HEAD, floor: float | None = None, measured: Column | None = None) -> DataFrame:
    """Reorder the first ``head`` hits of each query by score; with a floor keep only measured scores at or above it.

    ``measured`` is false where the model failed: those queries keep their order, and no floor applies.
    """
    ok = F.lit(True) if measured is None else measured
    scored = hits.withColumn("rerank", F.when((F.col("position") <= head) & ok, score)).withColumn("_ok", ok)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_ok") & (F.col("position") <= head), 0).otherwise(1), F.col("rerank").desc_nulls_last(), "position")
    out = scored.withColumn("new_position", F.row_number().over(order))
    if floor is not None:
        out = out.where(~F.col("_ok") | (F.col("rerank") >= floor))
    return out.drop("position", "_ok").withColumnRenamed("new_position", "position")


def overlap_score(query_tokens: Column, tokens: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: log-odds of the query's distinct tokens that a text holds."""
    q = F.array_distinct(query_tokens)
    held = F.size(F.array_intersect(q, tokens))
    return F.ln((held + 0.5) / (F.size(q) - held + 0.5))


def alike(a: str, b: str, ratio: float = SAME_RATIO) -> bool:
    """Whether two bodies' matching ratio reaches ratio. Lengths and the letters in common bound it from above, so the matching itself,
    whose time is the product of the lengths, is left for bodies that may reach it."""
    if a == b:
        return True
    most = min(len(a), len(b))
    if 2 * most < ratio * (len(a) + len(b)) or 2 * (Counter(a) & Counter(b)).total() < ratio * (len(a) + len(b)):
        return False
    return difflib.SequenceMatcher(None, a, b).ratio() >= ratio


def without_near_duplicates(hits: DataFrame, n: int = RESULTS, ratio: float = SAME_RATIO) -> DataFrame:
    """Walk each query's hits in order, skip those too like one kept, stop at n. Needs (query_id, position, text).

    Sequential by nature; a group is one query's candidates, which earlier steps bound to 2 * CANDIDATES.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        kept, bodies = [], []
        for row, text in zip(pdf.index, pdf["text"], strict=True):
            if len(kept) == n:
                break
            body = " ".join((text or "").split())
            if not any(alike(body, other, ratio) for other in bodies):
                kept.append(row)
                bodies.append(body)
        return pdf.loc[kept]

    return hits.groupBy("query_id").applyInPandas(walk, hits.schema)


def search(
    queries: DataFrame,
    chunks: DataFrame,
    threshold: float = THRESHOLD,
    n: int = RESULTS,
    reranker: Callable[[Column, Column], Column] | None = None,
    floor: float | None = None,
) -> DataFrame:
    """Whole search for queries (query_id, text, embedding) over chunks (id, text, embedding). Known variants are spelled out for BM25."""
    from . import postings

    return found(queries, chunks.select("id", "embedding"), chunks.select("id", "text"), materialize(postings.blocks(chunks), "lexical-index"), None, threshold, n, reranker, floor)


def found(
    queries: DataFrame,
    vectors: DataFrame,
    texts: DataFrame,
    index: DataFrame,
    live: DataFrame | None,
    threshold: float = THRESHOLD,
    n: int = RESULTS,
    reranker: Callable[[Column, Column], Column] | None = None,
    floor: float | None = None,
) -> DataFrame:
    """The search over vectors (id, embedding), texts (id, text) and an index of theirs.

    A reranker that gives null for a hit has failed: that query's hits keep their order, no floor applies to them, and ``measured`` is false.
    """
    from . import postings, vector

    queries = queries.withColumn("text", expand_synonyms(F.col("text")))
    nearest = vector.nearest(queries, vectors, CANDIDATES)
    hits = fuse(nearest, postings.top(queries, index, CANDIDATES, live), threshold).join(texts.select("id", "text"), "id")
    if reranker is None:
        hits = hits.withColumn("measured", F.lit(False))
    else:
        asked = queries.select("query_id", F.col("text").alias("_q"))
        rows = hits.join(asked, "query_id").withColumn("_score", reranker(F.col("_q"), F.col("text")))
        ok = F.bool_and((F.col("position") > HEAD) | F.col("_score").isNotNull()).over(Window.partitionBy("query_id"))
        rows = materialize(rows.withColumn("measured", ok), "measured")  # so that a model is asked once
        hits = rerank(rows, F.col("_score"), floor=floor, measured=F.col("measured")).drop("_q", "_score")
    return without_near_duplicates(hits.where(F.trim("text") != ""), n)


def search_store(
    queries: DataFrame,
    store: Store,
    threshold: float = THRESHOLD,
    n: int = RESULTS,
    reranker: Callable[[Column, Column], Column] | None = None,
    floor: float | None = None,
) -> DataFrame:
    """The search over a store's current revision, with citations and the number of places of each text (n_places).

    The index is the one kept with the store, so a search on a known revision reads no text but that of its hits, and one after a
    commit indexes what the commit brought.
    """
    from . import postings

    now = store.manifest()
    index, live = postings.of_store(store, now)
    hits = materialize(found(queries, store.vectors(now), store.texts(now), index, live, threshold, n, reranker, floor), "hits")
    ids = hits.select("id").distinct()
    places = store.occurrences(now).join(ids.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
    return cited(hits, ids.withColumn("text", F.lit(None).cast("string")), places)


def cited(hits: DataFrame, chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """hits (query_id, position, id, ...) with the citation of the first place of each text, and how many places hold it (n_places)."""
    from .store import with_occurrences

    of = lambda key: F.get_json_object("first.metadata", f"$.{key}")
    first = place(F.col("first.source"), of("location_type"), of("location"), of("heading"), of("ocr") == "true")
    known = with_occurrences(chunks, occurrences).select(F.col("chunk_id").alias("id"), citation(first, F.col("n")).alias("citation"), F.col("n").alias("n_places"))
    return hits.join(known, "id", "left")


def evidence(**corpora: DataFrame) -> DataFrame:
    """Hits of several corpora, attachments or pasted texts as one table: kind says which, and number runs within a query."""
    out = None
    for order, (kind, hits) in enumerate(corpora.items()):
        part = hits.select("query_id", F.lit(kind).alias("kind"), F.lit(order).alias("_order"), "position", "text", "citation")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no corpus given")
    order = Window.partitionBy("query_id").orderBy("_order", "position")
    return out.withColumn("number", F.row_number().over(order)).drop("_order")
