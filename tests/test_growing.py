"""Classes that grow by deltas against classes of everything at once."""

import os
import random

import pytest

from marketlens.operators import fusion
from marketlens.operators.growing import GrowingClasses

SCHEMA = "id long, fusion_key string, model_key string"
KEYS = ["fusion_key", "model_key"]


def found(df):
    return {r.id: r["class"] for r in df.collect()}


def test_deltas_give_the_classes_of_all(spark, tmp_path):
    rnd = random.Random(3)
    key = lambda: rnd.choice([None, f"k{rnd.randint(0, 150)}"])
    rows = [(i, key(), key()) for i in rnd.sample(range(1000), 200)]
    rows += [(2000 + i, "shared", None) for i in range(60)]  # one key of many
    rnd.shuffle(rows)
    grown = GrowingClasses(spark, str(tmp_path / "g"))
    for n, (at, upto) in enumerate([(0, 170), (170, 255), (255, 260)]):
        delta = rows[at:upto] + rows[:1] * n  # a row that is known comes again
        assert grown.add(spark.createDataFrame(delta, SCHEMA), KEYS) == n + 1
        assert found(grown.classes()) == found(fusion.classes(spark.createDataFrame(rows[:upto], SCHEMA), KEYS))
    # a known product with one more key joins two classes
    more = [(rows[0][0], "shared", None)]
    grown.add(spark.createDataFrame(more, SCHEMA), KEYS)
    every = spark.createDataFrame([*rows, *more], SCHEMA)
    whole = found(fusion.classes(every, KEYS).groupBy("id").agg({"class": "min"}).withColumnRenamed("min(class)", "class"))
    assert found(grown.classes()) == whole


def test_a_failed_delta_is_not_there(spark, tmp_path, monkeypatch):
    grown = GrowingClasses(spark, str(tmp_path / "g"))
    assert found(grown.classes()) == {}
    grown.add(spark.createDataFrame([(5, "a", None), (6, "b", None)], SCHEMA), KEYS)
    with monkeypatch.context() as m:
        m.setattr(grown.moves, "overwrite", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            grown.add(spark.createDataFrame([(1, "a", "b")], SCHEMA), KEYS)
    assert found(grown.classes()) == {5: 5, 6: 6}
    before = {f for d, _, names in os.walk(tmp_path / "g/members/delta=1") for f in names}
    grown.add(spark.createDataFrame([(2, "a", None), (3, "b", None), (2, None, "m"), (3, None, "m")], SCHEMA), KEYS)
    assert found(grown.classes()) == {2: 2, 3: 2, 5: 2, 6: 2}
    assert {f for d, _, names in os.walk(tmp_path / "g/members/delta=1") for f in names} == before  # nothing old is written again
