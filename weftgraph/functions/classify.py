"""Classification of references and calls as CASE columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds that count as types, reference types that callers chain through, orders of display.
TYPES = ("Class", "Interface", "Trait", "Enum")
CHAINABLE = ("method_call", "property_access", "instantiation", "static_call", "caller")
USED_BY_PRIORITY = {"instantiation": 0, "extends": 1, "implements": 1, "property_type": 2, "method_call": 3, "static_call": 3, "property_access": 4, "parameter_type": 5, "return_type": 5, "type_hint": 6}
CALL_REFERENCE = {"method": "method_call", "method_static": "static_call", "constructor": "instantiation", "access": "property_access", "access_static": "static_property", "function": "function_call"}
#: References that USED BY shows of a class; others are left out.
REGISTERED = ("instantiation", "extends", "implements", "property_type", "method_call", "property_access", "parameter_type", "return_type", "type_hint")
USES_PRIORITY = {"extends": 0, "implements": 0, "uses_trait": 0, "property_type": 1, "parameter_type": 2, "return_type": 2, "instantiation": 3, "type_hint": 4, "method_call": 5, "property_access": 5}
#: Which reference a class is shown with where it is used in several ways.
USES_CHOICE = {"instantiation": 0, "property_type": 1, "method_call": 2, "property_access": 2, "parameter_type": 3, "return_type": 4, "type_hint": 5}
LAST, LAST_USE = 10, 99


def type_reference() -> Column:
    """How a node refers to a type, from source_kind, source_name and the four hint flags of the two."""
    kind, flag = F.col("source_kind"), lambda c: F.coalesce(F.col(c), F.lit(False))
    method = F.when(flag("has_arg"), "parameter_type").when(flag("has_return"), "return_type").when((F.col("source_name") == "__construct") & flag("has_class_property"), "property_type").otherwise("type_hint")
    return (
        F.when(kind == "Argument", "parameter_type").when(kind == "Property", "property_type")
        .when(kind.isin("Method", "Function"), method)
        .when(kind.isin(*TYPES) & flag("has_property"), "property_type").otherwise("type_hint")
    )


def target_reference() -> Column:
    """How anything refers to a target_kind; null for types, where type_reference decides."""
    target = F.col("target_kind")
    use = F.when(target == "Method", "method_call").when(target == "Property", "property_access").when(target.isin(*TYPES), F.lit(None).cast("string"))
    for k, v in (("Constant", "constant_access"), ("Function", "function_call"), ("Argument", "argument_ref"), ("Variable", "variable_ref")):
        use = use.when(target == k, v)
    return use.otherwise("uses")


def reference_type(as_target: Column, as_type: Column) -> Column:
    """The label of an edge, from its type, what target_reference says of its target, and else type_reference."""
    edge = F.lower("type")
    return F.when(edge.isin("extends", "implements", "uses_trait"), edge).when(edge == "uses", F.coalesce(as_target, as_type)).otherwise("uses")


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[key]


def priority(ref_type: Column, values: dict[str, int] = USED_BY_PRIORITY, last: int = LAST) -> Column:
    return F.coalesce(_lookup(values, ref_type), F.lit(last)).cast("long")


def call_reference(call_kind: Column, callee_kind: Column) -> Column:
    """How a call refers to its callee; an unknown kind of call falls back on the callee's kind."""
    other = F.when(callee_kind == "Property", "property_access").when(callee_kind == "Function", "function_call").otherwise("method_call")
    return F.coalesce(_lookup(CALL_REFERENCE, call_kind), other)


def receiver_on() -> dict[str, Column]:
    """What a call is made on, its kind, and the symbol behind it: parameters and locals by name; a result by
    the member that gave it (made_*), itself read off a parameter, a local, or $this; without a receiver $this,
    where the kind of call implies one."""
    kind, made = F.col("receiver_value_kind"), F.col("made_name").isNotNull()
    base = F.when(F.col("made_on_kind").isin("parameter", "local"), F.col("made_on")).otherwise(F.lit("$this"))
    call = F.when(F.col("made_kind").isin("method", "method_static"), "()").otherwise("")
    chain = F.concat(base, F.lit("->"), F.regexp_replace("made_name", r"^\$+", ""), call)
    implied = kind.isNull() & F.col("call_kind").isin("access", "method", "method_static")
    named = kind.isin("parameter", "local")
    result = (kind == "result") & made
    on = F.when(implied | (kind == "self"), "$this").when(named, F.col("receiver_name")).when(result, chain).when(kind.isNotNull(), F.col("receiver_name"))
    of = F.when(implied, "self").when(kind == "parameter", "param").when(result, "property").otherwise(kind)
    return {"on_expr": on, "on_kind": of, "on_symbol": F.when(result, F.col("made_fqn"))}
