"""An inverted index of bigrams in blocks, and exact top-k BM25 that leaves out the blocks that can't matter.

A task inverts ``PART`` documents at a time, so an index is made in one pass over the texts, without a shuffle. Its rows are blocks of at most
``BLOCK`` postings of one token, the ones of greatest impact first, with the greatest count and least length in the block: from these follows
the most that any of its documents can get from the token. A row with a null token lists the documents of a part and their lengths.

A search takes three steps. The first blocks of each query's strongest tokens give a few documents' scores in part; the k-th of these
is at most the k-th score of the result. Tokens whose greatest impacts together stay below it are then of no use to find documents by,
and neither is a block of another token that stays below it together with all other tokens of the query: it can hold no document
of the result. What is left gives the candidates, and only these meet the postings of the useless tokens. Scores of the
result are sums over all postings, so the result is the exact one.

Indexes outlive a call: ``of_store`` keeps one below a store for each immutable folder of texts, so a revision reads no text that an
earlier one has indexed, and ``of_table`` keeps one in the shared folder under a fingerprint of the files that it was made from.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bigram_text, bigrams, counted_bigrams, nfkc
from .lexical import K1, B, idf
from .store import Store
from .tables import materialize, shared_dir

#: Postings of a block, documents of a part, and characters after which a part ends early.
BLOCK, PART, CHARACTERS = 128, 2_000, 8_000_000
#: Strongest tokens of a query that give its lower bound.
STRONGEST = 12
#: What scores may differ by and still be taken for equal: results are rounded to nine places.
SLACK = 2e-9


def schema(kind: str) -> str:
    return f"token string, no int, ids array<{kind}>, tfs array<int>, lens array<int>, n long, max_tf int, min_len int"


def impact(tf: Column, size: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def _inverted(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The blocks of one part."""
    docs, codes, tfs, lens = [], [], [], []
    for at in range(0, len(texts), 500):
        starts, code, count = counted_bigrams(texts[at : at + 500])
        sums = np.concatenate(([0], np.cumsum(count)))
        docs.append(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) + at)
        codes.append(code)
        tfs.append(count)
        lens.append(np.diff(sums[starts]))
    doc, code, tf, size = np.concatenate(docs), np.concatenate(codes), np.concatenate(tfs).astype("i4"), np.concatenate(lens).astype("i4")
    own = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(1.0, size.mean())))
    order = np.lexsort((doc, -own, code))
    doc, code, tf = doc[order], code[order], tf[order]
    first = np.searchsorted(code, code)
    inside = np.arange(len(code)) - first
    begins = np.flatnonzero(inside % BLOCK == 0)
    offsets = np.append(begins, len(code)).astype("i4")
    lengths = size[doc]
    # The first row lists the part's documents; the rest are blocks.
    token = pa.array([None, *map(bigram_text, code[begins].tolist())], pa.string())
    whole = np.concatenate(([0, len(texts)], offsets[1:] + len(texts))).astype("i4")
    counts_at = np.concatenate(([0, 0], offsets[1:])).astype("i4")
    made = [
        token,
        pa.array(np.concatenate(([0], inside[begins] // BLOCK)).astype("i4")),
        pa.ListArray.from_arrays(pa.array(whole), pa.concat_arrays([ids, ids.take(pa.array(doc))])),
        pa.ListArray.from_arrays(pa.array(counts_at), pa.array(tf)),
        pa.ListArray.from_arrays(pa.array(whole), pa.array(np.concatenate((size, lengths)))),
        pa.array(np.concatenate(([len(texts)], np.diff(offsets))).astype("i8")),
        pa.array(np.concatenate(([0], np.maximum.reduceat(tf, begins) if len(begins) else [])).astype("i4")),
        pa.array(np.concatenate(([0], np.minimum.reduceat(lengths, begins) if len(begins) else [])).astype("i4")),
    ]
    yield pa.RecordBatch.from_arrays(made, ["token", "no", "ids", "tfs", "lens", "n", "max_tf", "min_len"])


def blocks(corpus: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """The index of a corpus; null texts have no tokens but count as documents."""
    rows = corpus.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, characters = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                ids.append(some.column("id"))
                texts += [x or "" for x in some.column("text").to_pylist()]
                characters += sum(map(len, texts[-some.num_rows :]))
                if len(texts) >= PART or characters >= CHARACTERS:
                    yield from _inverted(pa.concat_arrays(ids), texts)
                    ids, texts, characters = [], [], 0
        if texts:
            yield from _inverted(pa.concat_arrays(ids), texts)

    return rows.mapInArrow(run, schema(kind))


def documents(index: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(id, len) of the indexed documents, of those in live (id) if it is given."""
    rows = index.where("token is null").select(F.explode(F.arrays_zip("ids", "lens")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.lens").alias("len"))
    return rows if live is None else rows.join(live, "id", "left_semi")


def statistics(index: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """One row (n, average)."""
    if live is not None:
        return documents(index, live).agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("average"))
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = index.where("token is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(total).alias("total"))
    return sums.select("n", F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("n")), F.lit(1.0)).alias("average"))


def postings(index: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(token, id, tf, len)"""
    rows = index.where("token is not null").select("token", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
    rows = rows.select("token", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
    return rows if live is None else rows.join(live, "id", "left_semi")


def frequencies(index: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(token, df): from the blocks' sizes, unless some documents don't count any more."""
    if live is not None:
        return postings(index, live).groupBy("token").agg(F.count("*").alias("df"))
    return index.where("token is not null").groupBy("token").agg(F.sum("n").alias("df"))


def weights(queries: DataFrame, index: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(query_id, token, weight, average) of queries (query_id, text); repeated tokens add repeatedly."""
    asked = queries.select("query_id", F.explode(bigrams(nfkc(F.coalesce("text", F.lit(""))))).alias("token"))
    wanted = asked.groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    own = index.join(wanted.select("token").distinct(), "token", "left_semi")
    known = wanted.join(frequencies(own, live), "token")
    # The statistics are one row, so this join is with a constant.
    return known.crossJoin(statistics(index, live)).select("query_id", "token", (F.col("qtf") * idf(F.col("df"), F.col("n"))).alias("weight"), "average")


def _scored(index: DataFrame, wanted: DataFrame, live: DataFrame | None) -> DataFrame:
    """(query_id, token, id, part) of the index's postings for wanted (query_id, token, weight, average, ...)."""
    rows = index.select("token", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"), *[c for c in index.columns if c not in ("token", "no", "ids", "tfs", "lens", "n", "max_tf", "min_len")])
    rows = rows.withColumns({"id": F.col("p.ids"), "tf": F.col("p.tfs"), "len": F.col("p.lens")}).drop("p")
    if live is not None:
        rows = rows.join(live, "id", "left_semi")
    return rows.join(wanted, [c for c in ("query_id", "token") if c in rows.columns]).withColumn("part", F.col("weight") * impact(F.col("tf"), F.col("len"), F.col("average")))


def plan(queries: DataFrame, index: DataFrame, k: int, live: DataFrame | None = None) -> DataFrame:
    """Written (query_id, token, weight, average, most, others, essential, useless, bound) of each query's tokens.

    ``most`` is the most that a document gets from the token and ``others`` from all others; ``bound`` is a lower bound of the query's
    k-th score. The tokens that aren't ``essential`` give at most ``useless`` together, less than the bound.
    """
    wanted = materialize(weights(queries, index, live), "asked")
    best = F.max(impact(F.col("max_tf"), F.col("min_len"), F.col("average")) * F.col("weight"))
    most = index.select("token", "max_tf", "min_len").join(wanted, "token").groupBy("query_id", "token").agg(best.alias("most"))
    whole = Window.partitionBy("query_id")
    ranked = wanted.join(most, ["query_id", "token"])
    ranked = ranked.withColumn("others", F.sum("most").over(whole) - F.col("most")).withColumn("strength", F.row_number().over(whole.orderBy(F.desc("most"), "token")))
    ranked = materialize(ranked, "strengths")
    first = _scored(index.where("no = 0"), ranked.where(F.col("strength") <= STRONGEST), live).groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    kth = first.withColumn("place", F.row_number().over(whole.orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", (F.col("score") - SLACK - 1e-12 * F.col("score")).alias("bound"))
    weakest = whole.orderBy("most", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranked.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0))).withColumn("_sum", F.sum("most").over(weakest))
    out = out.withColumn("essential", F.col("_sum") >= F.col("bound"))
    useless = F.max(F.when(~F.col("essential"), F.col("_sum")).otherwise(0.0)).over(whole)
    return materialize(out.withColumn("useless", useless).drop("_sum", "strength"), "plan")


def kept_blocks(index: DataFrame, planned: DataFrame) -> DataFrame:
    """The index's blocks, once for each query, that may hold a document of the result that has an essential token."""
    useful = planned.where("essential").select("query_id", "token", F.col("weight").alias("_w"), F.col("average").alias("_a"), "others", "bound")
    rows = index.join(useful, "token")
    reach = impact(F.col("max_tf"), F.col("min_len"), F.col("_a")) * F.col("_w") + F.col("others")
    return rows.where(reach >= F.col("bound")).drop("_w", "_a", "others", "bound")


def top(queries: DataFrame, index: DataFrame, k: int = 30, live: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best documents per query (query_id, text), ties by id; zero scores don't count.

    ``live`` (id) leaves out the documents that don't count any more.
    """
    planned = plan(queries, index, k, live)
    wanted = planned.select("query_id", "token", "weight", "average")
    limits = planned.select("query_id", "bound", "useless").distinct()
    found = _scored(kept_blocks(index, planned), wanted, live).groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    able = materialize(found.join(limits, "query_id").where(F.col("score") + F.col("useless") >= F.col("bound")).select("query_id", "id", "score"), "candidates")
    rest = _scored(index, planned.where("not essential").select("query_id", "token", "weight", "average"), None)
    more = rest.join(able.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    summed = able.unionByName(more).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return summed.withColumn("score", F.round("score", 9)).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_store(store: Store, now: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(index, live) of a store's revision. A folder of texts is indexed when it is first asked for, and never again."""
    now = now or store.manifest()
    folders = [t["name"] for t in now["texts"]]
    made = [f for f in store._names("lexical") if store._fs.exists(store._at(f"lexical/{f}/_SUCCESS"))]
    for name in folders:
        if name not in made:
            staged = f"lexical/.{uuid.uuid4().hex}"
            blocks(store.spark.read.parquet(f"{store.path}/{name}")).write.parquet(f"{store.path}/{staged}")
            store._fs.rename(store._at(staged), store._at(f"lexical/{name}"))
    return store._read(schema("string"), [f"lexical/{f}" for f in folders]), store.live(now)


def fingerprint(df: DataFrame) -> str:
    """A digest of the files that a table is read from: their paths, lengths and times."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    files = sorted(df.inputFiles())
    seen = []
    for parent in sorted({f.rpartition("/")[0] for f in files}):
        path = jvm.org.apache.hadoop.fs.Path(parent)
        seen += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(conf).listStatus(path)]
    return hashlib.sha256("\n".join(files + seen).encode()).hexdigest()[:32]


def of_table(spark: SparkSession, table: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """The index of a table of files, kept in the shared folder as long as the files are the same ones."""
    path = f"{shared_dir(spark)}/lexical-{fingerprint(table)}-{id_col}-{text}"
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        staged = f"{path}-{uuid.uuid4().hex}"
        blocks(table, id_col, text).write.parquet(staged)
        if not system.rename(jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)):
            path = staged  # another job has made it meanwhile, or a part of it is left
    return spark.read.schema(schema(table.schema[id_col].dataType.simpleString())).parquet(path)
