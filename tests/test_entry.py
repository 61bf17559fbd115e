import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry_and_keys(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns and out.count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(q) > 90 and set(o) <= set(q)


def test_rest_works_without_the_corpus_operators(tmp_path):
    for p in ("__spark_entry__.py", "bench.py"):
        (tmp_path / p).write_text((REPO / p).read_text())
    for p in (REPO / "weftgraph").rglob("*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(REPO)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q), e.oracle_sql().keys() <= q.keys())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, own, ok = out.stdout.split()
    assert int(n) > 90 and ok == "True" and own == "False"
