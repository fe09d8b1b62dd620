import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="symloom-test-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


SYMBOL = "sid long, file_id long, repo_id long, file string, name string, kind string, start_line int, end_line int, signature string, body string, centrality double, calls array<string>, member_calls array<string>, mentions array<string>, external_imports array<string>, call_counts map<string,int>, is_test boolean"


@pytest.fixture(scope="session")
def make_symbols(spark):
    def make(*rows):
        """Symbols from dictionaries with at least file and name."""
        out = []
        for i, r in enumerate(rows):
            out.append((
                r.get("sid", i), r.get("file_id", i), r.get("repo_id", 1), r["file"], r["name"], r.get("kind", "function"), r.get("start_line", 1), r.get("end_line", 1),
                r.get("signature", ""), r.get("body", ""), r.get("centrality", 0.0), r.get("calls", []), r.get("member_calls", []), r.get("mentions", []), r.get("external_imports", []), r.get("call_counts", {}), False,
            ))
        return spark.createDataFrame(out, SYMBOL)

    return make
