import json
import random

from weftgraph.store import Project
from weftgraph.streaming.reconcile import KeyedTable

from .mini import document, flow_document

CHANGE = "id int, at int, name string, deleted boolean"


def test_batches_rewrite_only_their_buckets(spark, tmp_path):
    rnd = random.Random(3)
    t, want, folders = KeyedTable(spark, f"file://{tmp_path}/t", "id", "at", 16), {}, {}
    sizes = [200, 2, 0, 40, 1]
    for n, size in enumerate(sizes):
        rows = [(rnd.randrange(300), n * 1000 + i, f"n{i}", rnd.random() < 0.3) for i in range(size)]
        t.apply(spark.createDataFrame(rows, CHANGE), n)
        for i, at, name, gone in sorted(rows, key=lambda r: r[1]):
            want.pop(i, None)
            if not gone:
                want[i] = (at, name)
        before, folders = folders, t._state(t._manifest())
        assert {r.id: (r.at, r.name) for r in t.read().collect()} == want
        if n:
            assert sum(folders[b] != before.get(b) for b in folders) <= size
    again = [tuple(r) for r in t.read().orderBy("id").collect()]
    t.apply(spark.createDataFrame([(1, 99_999, "again", False)], CHANGE), 3)  # delivered before
    assert [tuple(r) for r in t.read().orderBy("id").collect()] == again
    gone = t.vacuum()
    assert gone > 0 and t.vacuum() == 0
    assert [tuple(r) for r in t.read().orderBy("id").collect()] == again


def test_emptied_buckets_and_late_rows(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id", "at", 4)
    assert t.read() is None
    t.apply(spark.createDataFrame([(1, 5, "a", False)], CHANGE), 0)
    t.apply(spark.createDataFrame([(1, 4, "late", True)], CHANGE), 1)
    assert [(r.id, r.name) for r in t.read().collect()] == [(1, "a")]
    t.apply(spark.createDataFrame([(1, 6, "x", True)], CHANGE), 2)
    assert t.read().columns == ["id", "at", "name"] and t.read().count() == 0


def test_an_import_leaves_other_tables_where_they_are(spark, tmp_path):
    (tmp_path / "symbols.json").write_text(json.dumps(document()))
    (tmp_path / "flows.json").write_text(json.dumps(flow_document()))
    p = Project(spark, f"file://{tmp_path}/home", "shop")
    assert p.table("nodes") is None
    p.import_symbols(f"file://{tmp_path}/symbols.json")
    symbols = p._current()[1]
    p.import_flows(f"file://{tmp_path}/flows.json")
    both = p._current()[1]
    assert {n: both[n] for n in symbols} == symbols and p.table("flows").count() == 3
    p.import_symbols(f"file://{tmp_path}/symbols.json")
    last = p._current()[1]
    assert last["flows"] == both["flows"] and last["nodes"] != both["nodes"]
    nodes = p.table("nodes").count()
    assert p.vacuum() == 1 and p.table("nodes").count() == nodes and p.table("flows").count() == 3
    p.reset()
    assert p.table("flows") is None and p.table("nodes").count() == 0


def test_a_project_is_enriched_once(spark, tmp_path):
    (tmp_path / "symbols.json").write_text(json.dumps(document()))
    (tmp_path / "code/src").mkdir(parents=True)
    (tmp_path / "code/src/app.php").write_text("\n".join(f"line {i}" for i in range(40)))
    p = Project(spark, f"file://{tmp_path}/home", "shop")
    p.import_symbols(f"file://{tmp_path}/symbols.json")
    n = p.table("nodes").where("kind in ('Class', 'Method')").count()

    def explain(prompt, tokens, heat):
        if "App\\R2" in prompt.split("\n")[0] + prompt.split("Symbol")[-1].split("\n")[0]:
            raise ValueError("no")
        return f"about {len(prompt)}"

    sources, embed = f"file://{tmp_path}/code", lambda text: [1.0, 0.5]
    first = p.enrich(sources, explain, embed)
    assert first["total"] == n and first["failed"] >= 1 and first["done"] + first["failed"] == n
    again = p.enrich(sources, lambda *a: "second", embed)
    assert (again["skipped"], again["done"]) == (first["done"], first["failed"])
    said = {r.node_id: r.explanation for r in p.table("nodes").collect()}
    assert said["R2"] == "second" and said["S.run"].startswith("about") and said["f"] is None
    v = p.table("embeddings").collect()
    assert len(v) == n and len({r.vec_id for r in v}) == n and {r.collection for r in v} == {"explain_embeddings"}
