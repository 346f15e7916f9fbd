"""What op10_media_columns writes beside its shards, and its reads of places one by one."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm import media

SCHEMA = "doc_id long, text string"


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_little_is_shuffled_for_a_member(spark):
    rng, n = random.Random(3), 20_000
    docs = spark.createDataFrame([(i, f"{i} {rng.random()}") for i in range(n)], SCHEMA)
    before = shuffled(spark)
    assert len(media.media_columns(docs).collect()) == n
    sent = sum(size for stage, size in shuffled(spark).items() if stage not in before)
    assert 0 < sent < 150 * n  # digests pass through the groups by digest, the deal to readers, and both sides of one join


def test_places_keep_their_columns_and_are_held_against_their_digest(spark):
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, "one"), (4, "x" * 500)], SCHEMA)
    places = media.canonical(media.write_media(docs)).withColumn("mine", F.lit(7))
    heads = media.read_headers(media.dealt(places)).orderBy("height").collect()
    assert [(r.mine, r.width, r.height, r.bit_depth, r.channels) for r in heads] == [(7, 64, 1, 8, 3)] * 2 + [(7, 64, 3, 8, 3)]
    looks = {bytes(r.digest): r for r in media.read_features(places).collect()}
    assert len(looks) == 3 and looks[hashlib.sha256(b"one".ljust(192)).digest()].payload_bytes == 192
    for r in looks.values():
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert hashlib.sha256(f.read(r.length)).digest() == bytes(r.media_sha256)
    with pytest.raises(Exception, match="the payload is not"):
        media.read_features(places.withColumn("digest", F.unhex(F.sha2(F.col("shard"), 256)))).collect()


def test_tables_on_the_way_go(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], SCHEMA)
    root = f"{spark.conf.get('spark.checkpoint.dir')}/tabulon/{spark.sparkContext.applicationId}"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert media.media_columns(docs).count() == 2
    assert sorted(x.rpartition("-")[0] for x in set(os.listdir(root)) - before) == ["looks", "media", "media"]
