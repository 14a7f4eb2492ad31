from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from tidemark.llm.store import own_tables, staged


def test_a_run_drops_its_own_tables_only(spark):
    outer = staged(spark.range(3), "outer")
    meet = Barrier(2, timeout=60)

    def one(n):
        with own_tables(spark) as tables:
            first = staged(spark.range(n), "first")
            meet.wait()
            last = staged(first.selectExpr("id + 1 as id"), "last")
            tables.close(keep=1)
            meet.wait()
            return last.count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(one, (4, 5))) == [4, 5]
    inside = None
    with own_tables(spark) as tables:
        inside = staged(spark.range(7), "inside")
        tables.close()
    again = staged(spark.range(2), "again")
    assert (outer.count(), again.count()) == (3, 2)
    try:
        inside.count()
        raise AssertionError("the table should be gone")
    except Exception as e:
        assert "FILE_NOT_EXIST" in str(e) or "does not exist" in str(e)
