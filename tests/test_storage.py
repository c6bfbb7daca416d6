from __future__ import annotations

import os

from jadwal.storage import own_dir, release, written


def test_tables_stay_until_released(spark):
    table = written(spark.range(10), "numbers")
    assert table.count() == 10 and os.listdir(own_dir(spark).removeprefix("file://"))
    release(spark)
    assert not os.path.exists(own_dir(spark).removeprefix("file://"))
    release(spark)
    assert written(spark.range(3), "numbers").count() == 3
