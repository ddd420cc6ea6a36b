import re
from pathlib import Path

from trawl.llm import common


def private_mb(pid: int) -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_freed_memory_of_the_drivers_jvm_goes_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    # The last one stays, so that the C library's heap doesn't end at what is freed.
    for x in held[:-1]:
        x.end()
    jvm.System.gc()
    before = private_mb(pid)
    common.collect_garbage(spark)
    assert before - private_mb(pid) > 60
    held[-1].end()
