"""Fan-out results are written with zstd, unless the session names a codec."""

import glob

import pyarrow.parquet as pq
import pytest

from klaxon.plans.queries import QUERIES
from klaxon.session import CODEC

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def codec(spark):
    before = spark.conf.get(CODEC, None)
    spark.conf.unset(CODEC)
    yield
    spark.conf.unset(CODEC) if before is None else spark.conf.set(CODEC, before)


def written(rows, path):
    rows.write.parquet(path)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    return {m.row_group(0).column(0).compression for m in files if m.num_rows}


@pytest.mark.parametrize("name", ["match_alerts", "route_tasks", "render_ntfy", "render_discord"])
def test_results_are_written_with_zstd(spark, codec, tmp_path, name):
    assert written(QUERIES[name](spark, FOLDER), str(tmp_path / "out")) == {"ZSTD"}


def test_a_codec_that_is_named_stays(spark, codec, tmp_path):
    spark.conf.set(CODEC, "gzip")
    assert written(QUERIES["match_alerts"](spark, FOLDER), str(tmp_path / "out")) == {"GZIP"}
