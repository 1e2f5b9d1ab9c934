import os
import threading

from voxloom.session import discard, scratch, stage


def tables(paths):
    return [os.path.exists(p.removeprefix("file:")) for p in paths]


def test_scratch_notes_the_tables_of_its_own_thread(spark):
    with scratch() as outer:
        kept = stage(spark.range(3), "kept")
        with scratch() as inner:
            stage(spark.range(4), "inner")
            other = threading.Thread(target=lambda: stage(spark.range(5), "other"))
            other.start()
            other.join()
    assert len(outer) == len(inner) == 1 and tables(outer + inner) == [True, True]
    discard(spark, inner)
    assert tables(outer + inner) == [True, False] and kept.count() == 3
    stage(spark.range(1), "later")
    assert len(outer) == 1
