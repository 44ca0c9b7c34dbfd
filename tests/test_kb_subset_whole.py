from heronlake.plans import catalogue
from heronlake.plans.registry import table


def test_vectors_are_exported_whole(spark, data):
    got = {r.vec_id: r.embedding for r in catalogue.queries()["kb_subset_whole"](spark, data).collect()}
    kept = {r.vec_id: r.embedding for r in table(spark, data, "embeddings").collect() if r.vec_id in got}
    assert got and {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in kept.items()}
    assert all(abs(a - b) <= 5.1e-7 for k in got for a, b in zip(got[k], kept[k]))
    assert set(got) == {r.vec_id for r in catalogue.queries()["kb_subset"](spark, data).collect()}
