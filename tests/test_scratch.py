"""What a scratch table leaves in the shared folder."""

import os

from logweave.scratch import written


def test_no_marker_is_written(spark):
    out = written(spark.range(5), "marker")
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
    assert not [f for f in os.listdir(folder) if "_SUCCESS" in f]
    assert sorted(r.id for r in out.collect()) == list(range(5))
    assert written(spark.range(0), "empty").count() == 0
