import os
import shutil
import subprocess
import sys

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_part(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'device_stats' in q and not any(k.startswith('op') or k == 'pipeline' for k in q if k != 'orphan_files'); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    code = "from pyspark.sql import SparkSession as S; import __spark_entry__ as e; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); q = e.queries(); [q[k](s, '/root/testdata/sf0.001').count() for k in ('device_stats', 'decoded_values', 'stored_flush', 'import_choice')]; assert e.entry(s).count()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**env, "PYTHONPATH": str(copy)}, check=True)


def test_nothing_else_names_the_training_data_part():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, files in os.walk(os.path.join(root, "loggrove")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "loggrove.llm" not in text.read(), f
