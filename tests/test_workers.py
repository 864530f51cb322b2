"""Task functions reach workers that have no copy of the package, and a run's
written tables are gone when the driver ends."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tessera.session import get_session, scratch_path
from tessera.plans.catalog import load_all
spark = get_session("local[2]", shuffle_partitions=2)
for key in {keys!r}:
    print(key, len(load_all()[key][0](spark, "/root/testdata/sf0.001").collect()))
print("FOLDER", scratch_path(spark, "x").rsplit("/", 1)[0])
"""


def test_from_a_foreign_folder(tmp_path):
    keys = ["h5_nfkc_normalize", "h6_byte_level_words", "h12_rouge_l_recall_conversations", "k1_score_batches", "i3_wordpiece_encode",
            "e4_batch_ordinal"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, keys=keys)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    rows = dict(line.split() for line in run.stdout.splitlines() if len(line.split()) == 2)
    assert all(int(rows[k]) > 0 for k in keys)
    folder = rows["FOLDER"].removeprefix("file:")
    assert not os.path.exists(folder)
