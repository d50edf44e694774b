"""Columns of the user with the names of working columns pass through every operator unchanged."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import webgauge.llm
from webgauge.llm import chat, decontaminate, jaccard, lattice, mixing, quality, ranking, secrets, sharding, toxicity, whitening

WORKING = (
    "_v _before _tie _url _block _all _weights _key _source _n _copy _below _parts _rate _place _name _size _weight _bytes _shard _piece _first _part _row _in _found match secrets "
    "shard slot _kept_id _kept_hash _id _hash row set n copies class bucket p q side links other _text _doc _label _stats score label held_out "
    "predicted copy n_copies place rate vector keys bits x size component item rank segments turn_ before chunk role_ valid a.b MATCH2"
).split()
WORDS = [f"word{k}" for k in range(40)]


def docs(spark):
    text = lambda k: " ".join(WORDS[(k * 7 + j * (1 + k % 3)) % 40] for j in range(30))
    rows = [(k, text(k % 25), "en", f"s{k % 3}", 5) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "doc_id").sortWithinPartitions("doc_id")


def crowded(df):
    return df.select("*", *[F.concat(F.lit(f"{name}-"), F.col(df.columns[0]).cast("string")).alias(name) for name in WORKING])


def items(spark):
    return spark.createDataFrame([(1, " ".join(WORDS[:12])), (2, " ".join(WORDS[7:30]))], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 5 == 0) for k in range(40)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) as toxic")


PASSING = {
    "mixing": lambda s, d: mixing.mix_sources(d, epochs=2.0),
    "sharding": lambda s, d: sharding.shard_rows(d, 3, shard="my_shard", slot="my_slot"),
    "decontamination": lambda s, d: decontaminate.decontaminate(d, items(s)),
    "near_duplicates": lambda s, d: jaccard.drop_near_duplicates(d),
    "quality": lambda s, d: quality.keep_good(d, labels(s)),
    "secrets": lambda s, d: secrets.redact(secrets.find_secrets(d)).drop("secrets"),
    "matches": lambda s, d: decontaminate.find_matches(d, items(s), match="my_match").drop("my_match"),
}
NARROW = {
    "jaccard": lambda s, d: jaccard.similar_documents(d),
    "quality": lambda s, d: quality.score_documents(d, labels(s)),
    "toxicity": lambda s, d: toxicity.grade_documents(d, labels(s)),
    "ranking": lambda s, d: ranking.rank_documents(d, items(s)),
}


@pytest.mark.parametrize("name", PASSING)
def test_columns_pass_through(spark, name):
    plain, full = docs(spark), crowded(docs(spark))
    if name == "secrets":
        full = full.drop("secrets")
    found, out = PASSING[name](spark, plain), PASSING[name](spark, full)
    assert [c for c in out.columns if c in full.columns] == full.columns
    quoted = [f"`{c}`" for c in full.columns if c in WORKING]
    rows = out.select("doc_id", *quoted).collect()
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in full.columns if c in WORKING)
    # Which rows stay, and how often, depends on ids and texts alone; shards are dealt by stored place.
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in found.select("doc_id").collect())


@pytest.mark.parametrize("name", NARROW)
def test_columns_do_not_matter(spark, name):
    plain, full = (Counter(map(tuple, NARROW[name](spark, d).collect())) for d in (docs(spark), crowded(docs(spark))))
    assert plain == full


def test_vectors_and_turns(spark):
    vectors = spark.createDataFrame([(k, [float((k * j) % 7) for j in range(1, 9)]) for k in range(20)], "vec_id long, embedding array<float>")
    for run in (lattice.similar_vectors, lambda v: whitening.whiten_vectors(v).drop("whitened")):
        assert Counter(map(tuple, run(vectors).collect())) == Counter(map(tuple, run(crowded(vectors)).collect()))
    turns = spark.createDataFrame([(k // 3, k % 3, ("user", "assistant")[k % 2], "t") for k in range(20)], "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, chat.check_order(turns).collect())) == Counter(map(tuple, chat.check_order(crowded(turns)).collect()))


def test_string_ids(spark):
    named = docs(spark).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    kept = {r.doc_id for r in jaccard.drop_near_duplicates(named).collect()}
    judged = jaccard.similar_documents(named).collect()
    assert kept == {r.doc_id for r in judged if r.kept} and len(judged) == 40 and all(r.class_id <= r.doc_id for r in judged)


def test_every_working_name_is_tried():
    """Names of working columns that start with an underscore, as the modules write them."""
    import re

    used = set()
    for path in Path(webgauge.llm.__file__).parent.glob("*.py"):
        used |= set(re.findall(r'"(_[a-z]+)"', path.read_text()))
    assert used <= set(WORKING)


def test_pipeline(spark, monkeypatch, tmp_path):
    for name, df in (("documents", crowded(docs(spark))), ("benchmark", items(spark)), ("labels", labels(spark))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).drop("shard", "slot")
    mine = [c for c in rows.columns if c in WORKING]
    assert len(mine) == len(WORKING) - 2
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows.collect() for c in mine)
