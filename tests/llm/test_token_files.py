import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import types as T
from tokenizers import Tokenizer

from webgauge.llm.queries import op7_token_files
from webgauge.llm.token_files import Encoder, checksums, new_folder, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("ids", T.StringType()), ("part", T.StringType()))])
PARTS = ["the", " ", "  ", "\n", "\r\n", "\t", "é", "Ñ", "ß", "12", "½", "²", "!!", "'s", "x'", " '", "_", "-", "\xa0", "\x85", "\x1c", "ª", "Α", "語", "​", "<|endoftext|>", "word", " a", "\U0001f600"]


def expected(docs):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_give_the_ids_of_whole_texts():
    rng, encoder = random.Random(3), Encoder(PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", "a" * 5000, " " * 9]
    for _ in range(2):  # the second time from the cache
        ids, counts = encoder.encode(texts)
        ends = np.cumsum(counts)
        whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [w.ids for w in whole]


def test_round_trip_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (None, "null id"), (9, "it's <|endoftext|> é語"), (1, "long " * 100_000), (7, "same"), (8, "same")]
    folder = new_folder(spark)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS).repartition(3)
    write_tokens(df, folder, PATH)
    got = sorted(map(tuple, checksums(read_tokens(spark, folder)).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_repeated_rows_and_ids(spark):
    folder = new_folder(spark)
    write_tokens(spark.createDataFrame([(4, "b c", "", ""), (4, "b c", "", ""), (4, "other", "", ""), (2, "x", "", "")], DOCS), folder, PATH)
    got = sorted(map(tuple, read_tokens(spark, folder).select("start", "n_tokens", "doc_id").collect()))
    assert [r[2] for r in got] == [2, 4, 4, 4]
    assert [r[0] for r in got] == np.concatenate([[0], np.cumsum([r[1] for r in got])[:-1]]).tolist()


def test_empty_table(spark):
    folder = new_folder(spark)
    write_tokens(spark.createDataFrame([], DOCS), folder, PATH)
    assert checksums(read_tokens(spark, folder)).count() == 0


def test_file_format(spark):
    import glob

    folder = new_folder(spark)
    write_tokens(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), folder, PATH)
    meta = pq.ParquetFile(glob.glob(f"{folder.removeprefix('file://')}/part-*.parquet")[0]).metadata
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    ids = columns["ids.list.element"]
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and "DELTA_BINARY_PACKED" in columns["part_start"].encodings
    assert ids.has_column_index and ids.has_offset_index


def test_selective_reads_leave_the_ids_alone(spark):
    folder = new_folder(spark)
    write_tokens(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), folder, PATH)
    plan = read_tokens(spark, folder).where("doc_id = 7").select("doc_id", "start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "tokens-" in line][0]
    assert "ids" not in scan.split("ReadSchema")[1] and "EqualTo(doc_id,7)" in scan


def test_query_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_token_files(spark, sf_dir).collect())) == expected(docs)
