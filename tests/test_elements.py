import json
import random

import pytest

from weftgraph import schema as T
from weftgraph.sources.documents import read_symbols
from weftgraph.sources.elements import Malformed, Reader, objects

NASTY = ['}', '{', '"', '\\', '\\"}', '[{"a":1}]', "é}", "\n", '"nodes":[{', "", "\U0001f600{"]


def random_document(rnd, size):
    def value(depth):
        kind = rnd.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return "".join(rnd.choice(NASTY) for _ in range(rnd.randrange(4)))
        if kind == 2:
            return rnd.choice([None, 1.5, True, -7])
        if kind == 3:
            return [value(depth + 1) for _ in range(rnd.randrange(3))]
        return {rnd.choice(["a", "b}", "nodes", "x{"]): value(depth + 1) for _ in range(rnd.randrange(3))}

    things = lambda n: [{"id": str(i), "v": value(0)} for i in range(n)]
    doc = {"version": "1}", "nodes": things(size), "metadata": {"a": {"b": "}"}, "c": "{["}, "edges": things(rnd.randrange(size + 1)), "other": [[], "}", {"z": 1}], "empty": []}
    items = list(doc.items())
    rnd.shuffle(items)
    return dict(items)


def write(rnd, path, doc):
    path.write_text(json.dumps(doc, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1, 4])) + rnd.choice(["", "\n", " \n\n"]))


def found(spark, path, arrays):
    out = {}
    for array, df in objects(spark, f"file://{path}", dict.fromkeys(arrays)).items():
        for r in df.orderBy("file", "place").collect():
            out.setdefault((r.file.rsplit("/", 1)[-1], array), []).append((r.place, json.loads(r.x)))
    return out


def want(doc, arrays):
    return {a: list(enumerate(doc[a])) for a in arrays if doc.get(a)}


@pytest.mark.parametrize("size", [61, 300, 100_000])
def test_splits_of_any_size_give_the_same_objects(spark, tmp_path, size):
    rnd = random.Random(size)
    docs = {f"{i}.json": random_document(rnd, n) for i, n in enumerate([0, 1, 25, 9])}
    for name, doc in docs.items():
        write(rnd, tmp_path / name, doc)
    names = ["nodes", "edges", "empty"]
    keep = {c: spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in keep:
            spark.conf.set(c, str(size))
        got = found(spark, tmp_path, names)
        assert got == {(f, a): v for f, d in docs.items() for a, v in want(d, names).items()}
    finally:
        for c, v in keep.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_reader_goes_on_from_any_piece():
    rnd = random.Random(5)
    for _ in range(60):
        doc = random_document(rnd, 6)
        pieces = [p + "}" for p in json.dumps(doc).split("}")]
        r, got = Reader(), []
        for p in pieces:
            r = Reader(r.inside, r.depth, r.array, r.begun) if not r.text else r
            got += [(a, i, json.loads(t)) for a, i, t in r.read(p)]
        assert [g for g in got if g[0] in ("nodes", "edges")] == [(a, i, v) for a, vs in doc.items() if a in ("nodes", "edges") for i, v in enumerate(vs)]


def test_same_rows_as_one_task(spark, tmp_path):
    from .mini import document

    (tmp_path / "d.json").write_text(json.dumps(document()))
    nodes, edges = read_symbols(spark, f"file://{tmp_path}/d.json")
    doc = spark.read.schema(T.DOCUMENT).json(f"file://{tmp_path}/d.json", multiLine=True).first()
    assert [(r.node_ord, r.node_id, r.name) for r in nodes.orderBy("node_ord").collect()] == [(i, n.id, n.name) for i, n in enumerate(doc.nodes)]
    assert [(r.edge_ord, r.type, r.source_id, r.target_id) for r in edges.orderBy("edge_ord").collect()] == [(i, e.type.upper(), e.source, e.target) for i, e in enumerate(doc.edges)]


@pytest.mark.parametrize("text", ['{"nodes": [{"id": 1}, {"id": 2}', '{"nodes": [{"id": "1}]}', '{"nodes": [{"id": 1}'])
def test_cut_documents_are_refused(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Malformed):
        objects(spark, f"file://{tmp_path}/d.json", {"nodes": None})


def test_no_documents_and_empty_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.json").write_text('{"nodes": [], "edges": [null, 3, "x"]}\n')
    assert found(spark, tmp_path, ["nodes", "edges"]) == {}
