import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import bpe, chunks, tokenfiles

from .conftest import ROWS

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
ALPHABET = ["a", "e", "a, ", "es. ", "é,", "th", " ", "\n", "é", "日", "本", "1", "'", "s", "ß", "́", " ", "🙂", "?", "!!", "ing", " the", "\t", "я", ".", "<|endoftext|>"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_same_ids_as_the_library(plain):
    tool = bpe.encoder(RANKS, P.PATTERN)
    for x in texts():
        assert tool.encode(x) == plain.encode_ordinary(x)
        assert tool.decode(tool.encode(x)) == x.encode()


def test_any_bytes_merge_as_by_rank(plain):
    rng, tool = random.Random(4), bpe.encoder(RANKS, P.PATTERN)
    for _ in range(3000):
        piece = bytes(rng.choice(b"aeinrst\xc3\xa9\xe6\x97\x00\xff") for _ in range(rng.randint(1, 40)))
        assert tool.encode_piece(piece) == (tool.merged(piece) if piece not in tool.ranks else [tool.ranks[piece]])


def test_one_long_run_takes_linear_time():
    tool = bpe.encoder(RANKS, P.PATTERN)
    assert tool.decode(tool.encode_piece(b"ab" * 100_000 + b"a")) == b"ab" * 100_000 + b"a"


def test_chunks_cut_where_no_token_crosses(plain):
    split = 0
    for x in texts():
        found = chunks.pieces(x)
        if found is not None:
            split += len(found) > 1
            assert "".join(map(chunks.source_text, found)) == x
            assert [i for c in found for i in plain.encode_ordinary(chunks.source_text(c))] == plain.encode_ordinary(x)
    assert split > 100


def test_a_full_cache_changes_nothing():
    cache = chunks.PieceCache(lambda xs: [x.upper() for x in xs], limit=3)
    assert "".join(cache.parts(["\0a", "b", "c"]) + cache.parts(["d", "b", "e", "f", "g"])) == "A B C D B E F G"


def test_round_trip_digest(docs, empty, plain):
    rows = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digest(docs, RANKS, P.PATTERN).collect())
    want = []
    for i, text, *_ in ROWS:
        ids = plain.encode_ordinary(text or "")
        want.append((i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows == sorted(want)
    assert bpe.round_trip_digest(empty, RANKS, P.PATTERN).count() == 0


def test_ids_and_back(clean_docs, plain):
    found = bpe.encode_ids(clean_docs, RANKS, P.PATTERN)
    back = {r.doc_id: (list(r.ids), r.lossless, bytes(r.decoded)) for r in bpe.decode_ids(found, RANKS, P.PATTERN).collect()}
    for i, text, *_ in ROWS:
        if i is not None:
            assert back[i] == (plain.encode_ordinary(text or ""), True, (text or "").encode())


def _expected(rows):
    from tokenizers import Tokenizer

    tool, at, out = Tokenizer.from_file(JSON), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write(docs, path, JSON, 2, docs_per_file=4)
    rows = sorted((tuple(r) for r in tokenfiles.checksums(tokenfiles.read(spark, path)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert rows == _expected([(r[0], r[1]) for r in ROWS])


def test_token_files_of_random_texts(spark, tmp_path):
    rows = list(enumerate(texts()[:600]))
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string"), path, JSON, 2, docs_per_file=50)
    assert sorted(tuple(r) for r in tokenfiles.checksums(tokenfiles.read(spark, path)).collect()) == _expected(rows)
    one = tokenfiles.read(spark, path).where(F.col("doc_id") == 77)
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)" in one._jdf.queryExecution().toString()
    # Files hold ranges in order, so most are skipped by their statistics.
    spans = sorted((r[1], r[2]) for r in spark.read.orc(f"{path}/ids").groupBy("place").agg(F.min("doc_id"), F.max("doc_id")).collect())
    assert len(spans) > 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_no_token_files(spark, empty, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write(empty, path, JSON, 2)
    assert tokenfiles.checksums(tokenfiles.read(spark, path)).count() == 0


def test_stripes_index_and_bloom_filters(spark, tmp_path):
    """A file has many stripes, read each for itself and by Spark's splits; a lookup skips stripes, and an absent id all rows by the Bloom filter."""
    from py4j.java_gateway import get_field
    from pyarrow import orc

    base = 10_000_000_000  # ids that only a Java long holds
    rng = np.random.default_rng(1)
    rows = [(base + 2 * i, " ".join(map(str, rng.integers(0, 10**9, 120)))) for i in range(6_000)]
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string"), path, JSON, 2, docs_per_file=6_000)
    files = [str(f) for f in (tmp_path / "tokens/ids").glob("*.orc")]
    stored = max((orc.ORCFile(f) for f in files), key=lambda f: f.nrows)
    assert stored.nstripes >= 4 and stored.nrows == 6_000
    spans = [stored.read_stripe(i, columns=["doc_id"]).column("doc_id").to_pylist() for i in range(stored.nstripes)]
    assert [x for s in spans for x in s] == [r[0] for r in rows]

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = max(files, key=lambda f: orc.ORCFile(f).nrows)
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{name}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    stripes = reader.getStripes()
    assert stripes.size() == stored.nstripes and reader.getRowIndexStride() == tokenfiles.STRIDE
    kinds = {str(s.getKind()) for s in reader.rows().readStripeFooter(stripes.get(1)).getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds

    def rows_read(doc_id):
        sarg = jvm.org.apache.hadoop.hive.ql.io.sarg
        kind = getattr(sarg, "PredicateLeaf$Type").LONG
        wanted = sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", kind, doc_id).end().build()
        columns = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 2)
        columns[0], columns[1] = None, "doc_id"
        found = reader.rows(reader.options().searchArgument(wanted, columns))
        batch, n = reader.getSchema().createRowBatch(), 0
        while found.nextBatch(batch):
            n += get_field(batch, "size")
        return n

    one = next(len(s) for s in spans if base + 6_000 in s)
    assert rows_read(base + 6_000) == min(one, tokenfiles.STRIDE) < 6_000
    assert sum(rows_read(base + 2 * i + 1) for i in range(3_000, 3_040)) < 40 * 0.1 * one

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        ids = spark.read.orc(f"{path}/ids")
        parts = ids.groupBy(F.spark_partition_id()).count().count()
        assert parts >= 3 and sorted(map(tuple, tokenfiles.checksums(tokenfiles.read(spark, path)).collect())) == _expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
