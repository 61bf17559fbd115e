"""A hand-written program as a symbol document and an application-flow document.

One file holds interface I { save }, class R implements I, class R2 extends R, entity E with a promoted
property, service S with an injected repository and run(), and controller C with act()."""

from __future__ import annotations

NS = "App\\"


def document() -> dict:
    nodes, edges = [], []

    def node(i, kind, name, fqn, line, doc=None, **more):
        nodes.append({"id": i, "kind": kind, "name": name, "fqn": fqn, "symbol": f"s {fqn}", "file": "src/app.php", "range": {"start_line": line, "start_col": 0, "end_line": line, "end_col": 9}, "enclosing_range": {"start_line": line, "start_col": 0, "end_line": line + 2, "end_col": 1}, "documentation": doc or [], **more})

    def edge(t, a, b, line=None, **more):
        edges.append({"type": t, "source": a, "target": b, **({"location": {"file": "src/app.php", "line": line, "col": 1}} if line is not None else {}), **more})

    node("f", "File", "app.php", "src/app.php", 0)
    node("I", "Interface", "I", NS + "I", 1)
    node("I.save", "Method", "save", NS + "I::save()", 2, ["```php\npublic function save(E $x): void\n```"])
    node("R", "Class", "R", NS + "R", 5)
    node("R.save", "Method", "save", NS + "R::save()", 6, ["```php\n#[Override] public function save(\n  E $x\n): void\n```"])
    node("R2", "Class", "R2", NS + "R2", 10)
    node("E", "Class", "E", NS + "E", 14)
    node("E.ctor", "Method", "__construct", NS + "E::__construct()", 15, ["```php\npublic function __construct(private readonly int $id\n```"])
    node("E.id", "Property", "$id", NS + "E::$id", 15, ["```php\nprivate readonly \\App\\Id $id\n```"])
    node("E.ctor.id", "Value", "$id", NS + "E::__construct().$id", 15, value_kind="parameter")
    node("S", "Class", "S", NS + "S", 20)
    node("S.repo", "Property", "$repo", NS + "S::$repo", 21, ["```php\nprivate I $repo\n```"])
    node("S.run", "Method", "run", NS + "S::run()", 23, ["```php\npublic static function run($in)\n```"])
    node("S.run.in", "Value", "$in", NS + "S::run().$in", 23, value_kind="parameter")
    node("S.run.e", "Value", "$e", NS + "S::run().$e", 24, value_kind="local")
    node("call.id", "Call", "call", "c1", 24, call_kind="access")
    node("call.new", "Call", "call", "c2", 24, call_kind="constructor")
    node("call.save", "Call", "call", "c3", 25, call_kind="method")
    node("res.id", "Value", "r1", "c1::r", 24, value_kind="result")
    node("res.new", "Value", "r2", "c2::r", 24, value_kind="result")
    node("C", "Class", "C", NS + "C", 30)
    node("C.act", "Method", "act", NS + "C::act()", 31)
    node("call.run", "Call", "call", "c4", 32, call_kind="method")
    for a, b in (("f", "I"), ("f", "R"), ("f", "R2"), ("f", "E"), ("f", "S"), ("f", "C"), ("I", "I.save"), ("R", "R.save"), ("E", "E.ctor"), ("E", "E.id"), ("E.ctor", "E.ctor.id"), ("S", "S.repo"), ("S", "S.run"), ("S.run", "S.run.in"), ("S.run", "S.run.e"), ("S.run", "call.id"), ("S.run", "call.new"), ("S.run", "call.save"), ("S.run", "res.id"), ("S.run", "res.new"), ("C", "C.act"), ("C.act", "call.run")):
        edge("contains", a, b)
    edge("implements", "R", "I")
    edge("extends", "R2", "R")
    edge("overrides", "R.save", "I.save")
    edge("type_hint", "S.repo", "I")
    edge("type_hint", "I.save", "E")
    edge("uses", "S.run", "E", 24)
    edge("uses", "S.run", "I.save", 25)
    edge("uses", "S", "I", 21)
    edge("uses", "C.act", "S.run", 32)
    edge("uses", "C.act", "E", 33)
    edge("uses", "f", "E", 0)
    edge("calls", "call.id", "E.id")
    edge("receiver", "call.id", "S.run.in")
    edge("produces", "call.id", "res.id")
    edge("calls", "call.new", "E.ctor")
    edge("argument", "call.new", "res.id", position=0, expression="$in->id", parameter=NS + "E::__construct().$id")
    edge("produces", "call.new", "res.new")
    edge("assigned_from", "S.run.e", "res.new")
    edge("assigned_from", "E.id", "E.ctor.id")
    edge("type_of", "S.run.e", "E")
    edge("calls", "call.save", "I.save")
    edge("argument", "call.save", "S.run.e", position=0, expression="", parameter=NS + "I::save().$x")
    edge("calls", "call.run", "S.run")
    return {"version": "2.0", "metadata": {}, "nodes": nodes, "edges": edges}


def flow_document() -> dict:
    src = lambda f, call=None: {"flow_id": f, **({"call_node_id": call} if call else {})}
    return {
        "flows": [
            {"id": "http:1", "type": "http", "entry": {"fqn": NS + "C", "method": "act", "node_id": "C", "method_node_id": "C.act", "route": "/act", "http_methods": ["GET", "POST"]}},
            {"id": "msg:1", "type": "message", "entry": {"fqn": NS + "S", "method": "run", "node_id": "S", "method_node_id": "S.run", "message": NS + "Msg\\Save"}},
            {"id": "cli:1", "type": "cli", "entry": {"fqn": NS + "S", "method": "run", "command_name": "app:run"}},
            {"id": "vendor:1", "type": "event", "entry": {"fqn": "Vendor\\X", "method": "on", "event": "Vendor\\E"}},
        ],
        "messages": [{"id": "m1", "dispatched_class": NS + "Msg\\Save", "dispatched_class_node_id": "E", "transports": ["async"], "sources": [src("http:1", "call.run")], "targets": [{"flow_id": "msg:1"}]}],
        "events": [{"id": "e1", "dispatched_class": NS + "Done", "sources": [src("msg:1", "call.save")], "targets": [{"flow_id": "http:1", "priority": 5}, {"flow_id": "vendor:1"}]}],
        "http_clients": [{"id": "h1", "service_id": "api", "class": NS + "R", "class_node_id": "R", "base_uri": "https://x", "sources": [src("cli:1")]}],
    }
