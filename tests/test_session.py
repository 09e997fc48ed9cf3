from tablefeed import files
from tablefeed.session import clear_scratch, scratch_path, scratch_root
from tablefeed.sources.tables import written


def test_scratch_tables_are_in_one_folder_of_the_application(spark):
    kept = written(spark, spark.range(10), "ten")
    assert kept.count() == 10
    own = f"{scratch_root(spark)}/tablefeed-{spark.sparkContext.applicationId}"
    assert any(name.startswith("ten-") for name in files.names(spark, own))
    assert scratch_path(spark, "x").startswith(f"{own}/x-")
    clear_scratch(spark)
    assert files.names(spark, own) == [] and files.exists(spark, own)


def test_the_scratch_folder_goes_with_the_driver(tmp_path):
    import os
    import subprocess
    import sys

    code = (
        "from tablefeed.session import build_session, scratch_path\n"
        "from tablefeed.sources.tables import written\n"
        "spark = build_session('t', 'local[1]', **{'spark.ui.enabled': 'false', "
        f"'spark.checkpoint.dir': '{tmp_path}'}})\n"
        "print(written(spark, spark.range(3), 'three').count())\n"
        "import os; print(len(os.listdir(os.path.dirname(scratch_path(spark, 'x')))))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["3", "1"], done.stderr[-2000:]
    assert not [name for name in os.listdir(tmp_path) if name.startswith("tablefeed-")]
