"""Tables of the property graph: fixed types, kinds and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Node kinds, edge types (as documents spell them) and kind lists.
NODE_KINDS = ["Class", "Interface", "Trait", "Enum", "Method", "Function", "Property", "Const", "EnumCase", "Argument", "Value", "Call", "File"]
EDGE_TYPES = ["contains", "uses", "extends", "implements", "overrides", "type_hint", "calls", "receiver", "argument", "produces", "assigned_from", "type_of", "return_type"]
SEARCHABLE = ["Class", "Interface", "Trait", "Enum", "Method", "Function", "Property", "Const", "EnumCase", "File"]
CONTAINERS = ["Class", "Interface", "Trait", "Enum", "File"]
INHERITABLE = ["Class", "Interface", "Trait", "Enum"]
ENRICHABLE = ["Class", "Method"]
FLOW_TYPES = ["http", "message", "event", "cli"]

_s, _i, _l = T.StringType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RANGE = _struct(start_line=_i, start_col=_i, end_line=_i, end_col=_i)

#: A symbol document, as read from JSON.
DOCUMENT = _struct(
    version=_s,
    metadata=T.MapType(_s, _s),
    nodes=T.ArrayType(_struct(id=_s, kind=_s, name=_s, fqn=_s, symbol=_s, file=_s, range=RANGE, enclosing_range=RANGE, documentation=T.ArrayType(_s), value_kind=_s, type_symbol=_s, call_kind=_s)),
    edges=T.ArrayType(_struct(type=_s, source=_s, target=_s, location=_struct(file=_s, line=_i, col=_i), position=_i, expression=_s, parameter=_s)),
)

#: Graph tables. node_ord and edge_ord are places in the document; they break ties.
NODES = _struct(
    node_ord=_l, node_id=_s, kind=_s, name=_s, fqn=_s, symbol=_s, file=_s, start_line=_i, start_col=_i, end_line=_i, end_col=_i,
    enclosing_start_line=_i, enclosing_start_col=_i, enclosing_end_line=_i, enclosing_end_col=_i,
    documentation=T.ArrayType(_s), value_kind=_s, type_symbol=_s, call_kind=_s, signature=_s,
)
EDGES = _struct(edge_ord=_l, type=_s, source_id=_s, target_id=_s, loc_file=_s, loc_line=_i, position=_i, expression=_s, parameter=_s, ordinal=_i)

_source = _struct(flow_id=_s, call_node_id=_s, caller_method_fqn=_s, caller_method_node_id=_s)
#: An application-flow document, as read from JSON.
FLOW_DOCUMENT = _struct(
    flows=T.ArrayType(_struct(id=_s, type=_s, entry=_struct(fqn=_s, method=_s, node_id=_s, method_node_id=_s, route=_s, http_methods=T.ArrayType(_s), message=_s, event=_s, command_name=_s))),
    messages=T.ArrayType(_struct(id=_s, dispatched_class=_s, dispatched_class_node_id=_s, transports=T.ArrayType(_s), sources=T.ArrayType(_source), targets=T.ArrayType(_struct(flow_id=_s)))),
    events=T.ArrayType(_struct(id=_s, dispatched_class=_s, dispatched_class_node_id=_s, sources=T.ArrayType(_source), targets=T.ArrayType(_struct(flow_id=_s, priority=_i)))),
    http_clients=T.ArrayType(_struct(**{"id": _s, "service_id": _s, "class": _s, "class_node_id": _s, "base_uri": _s, "sources": T.ArrayType(_source)})),
)
FLOW_EDGES = _struct(type=_s, from_label=_s, from_id=_s, to_label=_s, to_id=_s, call_node_id=_s, priority=_i)
