from graphloom.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def test_whole_documents_move(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op7_sharding"](spark, SF)
    assert got.columns == [*docs.columns, "shard_id"]
    assert sorted(map(str, got.collect())) == sorted(map(str, sharding.assign_shards(docs, "doc_id").collect()))
    assert got.rdd.getNumPartitions() == len(sharding.SHARDS)
