"""Scratch tables: who removes them, and when."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from lendlake.functions.workspace import lease, shared_folder, stored
from lendlake.operators import maintenance, portfolio

ROOT = str(Path(__file__).resolve().parent.parent)


def folders(spark):
    return set(os.listdir(shared_folder(spark)))


@pytest.mark.parametrize("report", [
    portfolio.score_trend, portfolio.score_trend_raw, maintenance.status_timeline])
def test_a_report_leaves_no_folder(spark, star, report, tmp_path):
    before = folders(spark)
    with lease(spark) as held:
        report(star).write.parquet(str(tmp_path / "report"))
        assert len(held) == 1 and folders(spark) - before == {held[0].rsplit("/", 1)[1]}
    assert folders(spark) == before
    assert spark.read.parquet(str(tmp_path / "report")).count() > 0


def test_an_error_leaves_no_folder(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), lease(spark):
        assert stored(spark.range(5), "some").count() == 5
        raise ZeroDivisionError
    with pytest.raises(Exception, match="raised here"), lease(spark):  # while it is written
        stored(spark.range(5).selectExpr("raise_error('raised here') AS x"), "some")
    assert folders(spark) == before


def test_an_inner_block_leaves_the_outer_tables(spark):
    before = folders(spark)
    with lease(spark) as outer:
        kept = stored(spark.range(7), "outer")
        with lease(spark) as inner:
            assert stored(kept, "inner").count() == 7
        assert len(outer) == len(inner) == 1 and kept.count() == 7
    assert folders(spark) == before
    outside = stored(spark.range(3), "outside")
    assert outside.count() == 3 and len(folders(spark) - before) == 1


def test_without_a_lease_tables_go_with_the_process(tmp_path):
    program = f"""
import os
from lendlake.functions.workspace import stored
from lendlake.session import session
spark = session("ends", "local[1]", **{{"spark.ui.enabled": "false",
                                       "spark.checkpoint.dir": {str(tmp_path)!r}}})
assert stored(spark.range(9), "some").count() == 9
assert any(x.startswith("some-") for x in os.listdir({str(tmp_path)!r}))
"""
    subprocess.run([sys.executable, "-c", program], cwd=ROOT, check=True, timeout=120)
    for _ in range(60):  # the JVM ends a little after Python
        left = [x for x in os.listdir(tmp_path) if x.startswith("some-")]
        if not left:
            break
        time.sleep(0.5)
    assert not left
