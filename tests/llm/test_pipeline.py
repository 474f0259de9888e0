from collections import Counter

import corpus_pipeline as P
from tests.llm.cases import SF, awkward, documents


def test_stages_against_their_parts(spark, tmp_path):
    docs = documents(spark)
    seen = []
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    language, single, clean, mixed = seen
    assert set(mixed) == set(clean) < set(single) < set(language)
    assert max(clean.values()) == 1 and max(mixed.values()) > 1
    shards = P.STAGES[4][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in shards) == mixed
    sums = Counter()
    for r in shards:
        sums[r.shard] += r.size
    assert len(sums) == 24


def test_run(spark):
    out = P.run(spark, SF)
    assert set(out.columns) == {"doc_id", "size", "text_crc32", "shard", "slot"} and out.count() > 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert P.STAGES[4][1](spark, docs, SF).count() == docs.count()
