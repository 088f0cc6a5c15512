import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seqlake.session import get_spark

    s = get_spark("local[4]", 8, extra={"spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        d = str(tmp_path_factory.mktemp("ckpt"))
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


SF_SMALL = "/root/testdata/sf0.001"
# a folder with real small fixtures (a protein FASTA, a genome metadata TSV,
# ANI tables); tests that need it are skipped when unset
FIXTURE_DIR = os.environ.get("SEQLAKE_FIXTURE_DIR", "")
