import random

import numpy as np
import pyarrow as pa
import pytest

from siftkite.llm import common


def test_split_by_marks(spark):
    rng = random.Random(4)
    ids = [*(rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)), 0, -1, 5]
    wide = spark.createDataFrame([(i, "t", "m") for i in ids] + [(None, "t", "m"), (5, "again", "m")], "doc_id long, text string, hit string").repartition(3)
    marked = set(ids[:1000]) | {5}
    some, others = common.split_by_marks(wide, common.marks_of(spark.createDataFrame([(i,) for i in marked] * 2, "doc_id long")))
    got, left = [r.doc_id for r in some.collect()], [r.doc_id for r in others.collect()]
    assert some.columns == others.columns == wide.columns
    assert len(got) + len(left) == len(ids) + 2 and got.count(5) == 2 and None in left
    assert marked <= set(got) and not marked & set(left) and len(got) < len(marked) + 20
    none = common.split_by_marks(wide, common.marks_of(wide.limit(0)))
    assert [x.count() for x in none] == [0, len(ids) + 2]


def test_distinct_words():
    buf, offsets = common.text_buffer(pa.array(["a bb\ta", None, "", " ccc", "a" * 5000, "x", "x é"]))
    starts, ends = common.word_spans(buf, offsets)
    words, which = common.distinct_words(buf, starts, ends)
    assert [words[k].decode() for k in which] == ["a", "bb", "a", "ccc", "a" * 5000, "x", "x", "é"] and len(words) == len(set(words))
    assert common.distinct_words(buf[:0], starts[:0], ends[:0])[0] == []
    assert len(np.unique(common.word_hashes(buf, starts, ends))) == len(words)


def test_staged_tables_go_when_replaced(spark):
    import os

    first = common.stage(spark.range(3).toDF("doc_id"), "one")
    at = first._staged_at.removeprefix("file://")
    assert os.path.isdir(at)
    second = common.stage(first.filter("doc_id > 0"), "two", replaces=first)
    assert second.count() == 2 and not os.path.isdir(at)


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        common.shared_dir(Session())
