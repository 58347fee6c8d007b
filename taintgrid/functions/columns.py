"""Column expressions over facts and findings. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
HTTP_BINDINGS = [
    "FromQueryAttribute", "FromBodyAttribute", "FromRouteAttribute", "FromFormAttribute",
    "FromHeaderAttribute",
]
ACTION_ATTRIBUTES = [
    "HttpGetAttribute", "HttpPostAttribute", "HttpPutAttribute", "HttpDeleteAttribute",
    "HttpPatchAttribute", "RouteAttribute",
]
STRING_BUILD_WORDS = [
    "LITERAL", "var", "string", "int", "bool", "new", "return", "null", "true", "false", "using",
    "this", "if", "else", "ToString", "String",
]
DATA_FLOW_KINDS = ["flows_to", "aliases", "assigned_to", "captured_by", "taints", "returned_by"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
CONFIDENCES = ["confirmed", "high", "medium", "low"]
LITERAL_IN_QUOTES = r'"(?:[^"\\]|\\.)*"'
# ----------------------------------------------------------------------------------------


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_any(array: str | Column, values: list[str]) -> Column:
    """True if the array holds any of the values; a NULL array holds none."""
    return F.coalesce(F.arrays_overlap(_c(array), _strings(values)), F.lit(False))


# --- arguments, nodes, parameters, methods, classes -----------------------------------------


def may_be_tainted(arg: Column) -> Column:
    return ~arg["is_literal"] & arg["data_flow_origin"].isin("parameter", "return_value", "unknown")


def has_tainted_args(arguments: str | Column = "arguments") -> Column:
    return F.exists(_c(arguments), may_be_tainted)


def tainted_args(arguments: str | Column = "arguments") -> Column:
    return F.filter(_c(arguments), may_be_tainted)


def tainted_position(arguments: str | Column = "arguments") -> Column:
    """Position of the first argument, in array order, that may be tainted."""
    hits = F.transform(tainted_args(arguments), lambda a: a["position"])
    return F.when(F.size(hits) > 0, F.try_element_at(hits, F.lit(1)))


def analysis_priority() -> Column:
    return (
        F.when(F.col("is_known_sink") & has_tainted_args(), 1)
        .when(F.col("is_known_sink") | F.col("is_known_source"), 2)
        .otherwise(3)
    )


def is_http_bound(bindings: str | Column = "binding_attributes") -> Column:
    return has_any(bindings, HTTP_BINDINGS)


def is_user_controlled(bindings: str | Column = "binding_attributes") -> Column:
    return is_http_bound(bindings) | (F.coalesce(F.size(_c(bindings)), F.lit(0)) <= 0)


def method_flags(attributes: str | Column = "attributes") -> dict[str, Column]:
    return {
        "is_action_method": has_any(attributes, ACTION_ATTRIBUTES),
        "is_service_operation": has_any(attributes, ["OperationContractAttribute"]),
        "has_authorize": has_any(attributes, ["AuthorizeAttribute"]),
        "allows_anonymous": has_any(attributes, ["AllowAnonymousAttribute"]),
    }


def class_flags(
    name: str = "name", base: str = "base_class", attributes: str = "attributes"
) -> dict[str, Column]:
    controller = (
        has_any(attributes, ["ApiControllerAttribute", "ControllerAttribute"])
        | F.col(name).endswith("Controller")
        | F.coalesce(F.col(base).contains("ControllerBase"), F.lit(False))
    )
    return {
        "is_controller": controller,
        "is_service": has_any(attributes, ["ServiceContractAttribute"]),
    }


# --- graph kinds ------------------------------------------------------------------------


def dfg_node_kind(target: str | Column = "target_name") -> Column:
    t = _c(target)
    return (
        F.when(t.startswith("__interpolated") | t.startswith("__string_concat"), "STRING_BUILD")
        .when(t.startswith("__collection"), "COLLECTION")
        .when(t.startswith("__lambda_capture"), "LAMBDA_CAPTURE")
        .otherwise("ASSIGNMENT")
    )


def graph_node_kind() -> Column:
    """Kind of a semantic node in the unified graph."""
    return (
        F.when(F.col("is_known_sink"), "KNOWN_SINK")
        .when(F.col("is_known_source"), "KNOWN_SOURCE")
        .when(F.col("is_known_sanitizer"), "KNOWN_SANITIZER")
        .when(
            F.col("kind") == "InvocationExpression",
            F.when(F.col("is_async_call"), "AWAIT_EXPR")
            .when(F.coalesce(F.col("resolved_symbol").contains("Linq"), F.lit(False)), "LINQ_EXPRESSION")
            .otherwise("METHOD_CALL"),
        )
        .when(F.col("kind") == "ObjectCreationExpression", "OBJECT_CREATION")
        .when(F.col("kind") == "AssignmentExpression", "ASSIGNMENT")
        .when(F.col("kind") == "ReturnStatement", "RETURN_VALUE")
        .otherwise("METHOD_CALL")
    )


def graph_assignment_kind(target: str | Column = "target_name") -> Column:
    t = _c(target)
    return (
        F.when(t.contains("interpolated"), "STRING_INTERPOLATION")
        .when(t.contains("concat"), "STRING_CONCAT")
        .when(t.contains("collection"), "COLLECTION_ITEM")
        .when(t.contains("lambda"), "LAMBDA_CAPTURE")
        .otherwise("ASSIGNMENT")
    )


def edge_flags(kind: str = "edge_kind") -> dict[str, Column]:
    return {
        "is_conditional": F.col(kind).isin("true_branch", "false_branch"),
        "is_exception": F.col(kind).isin("exception", "throw"),
    }


def is_data_flow(kind: str = "edge_kind", with_returns: bool = True) -> Column:
    kinds = DATA_FLOW_KINDS if with_returns else [k for k in DATA_FLOW_KINDS if k != "returned_by"]
    return F.col(kind).isin(*kinds)


# --- string building --------------------------------------------------------------------


def string_build_has_variable(text: str | Column) -> Column:
    """An identifier is left once quoted literals and language words are gone."""
    bare = F.regexp_replace(_c(text), LITERAL_IN_QUOTES, "LITERAL")
    words = F.regexp_extract_all(bare, F.lit(r"(\b[a-zA-Z_][a-zA-Z0-9_]*\b)"), F.lit(1))
    return F.coalesce(F.size(F.array_except(words, _strings(STRING_BUILD_WORDS))) > 0, F.lit(False))


def is_string_concat(text: str | Column) -> Column:
    t = F.trim(_c(text))
    low = F.lower(t)
    builder = low.contains("stringbuilder") & (low.contains("append(") | low.contains("appendline("))
    chained = low.contains(".append(") & low.contains(".tostring()")
    quoted_plus = t.rlike('"[^"]*"') & t.contains("+")
    return F.coalesce(
        t.startswith('$"') | t.startswith('$@"') | builder | chained | quoted_plus, F.lit(False)
    )


def _first_arg(arguments: str | Column) -> Column:
    return F.try_element_at(_c(arguments), F.lit(1))


def first_arg_is_literal(arguments: str | Column = "arguments") -> Column:
    return F.coalesce(_first_arg(arguments)["is_literal"], F.lit(False))


def sink_is_literal(arguments: str | Column = "arguments") -> Column:
    """First argument is literal or the call is parameterised; no arguments counts as safe."""
    a = _first_arg(arguments)
    text = F.trim(a["text"])
    quoted = text.startswith('"') | text.startswith("'") | text.startswith('@"')
    return (F.size(_c(arguments)) <= 0) | F.coalesce(
        a["is_literal"] | (a["data_flow_origin"] == "literal") | quoted, F.lit(False)
    )


def build_flows_to_sink(target: str | Column, arguments: str | Column = "arguments") -> Column:
    """The built string reaches the first argument of the sink."""
    a = _first_arg(arguments)
    arg, name = F.trim(a["text"]), F.trim(_c(target))
    inline = arg.rlike('"[^"]*"') & arg.contains("+")
    flows = (
        F.when(a["is_literal"], False)
        .when(arg == name, True)
        .when(name == "__string_concat", inline)
        .otherwise(arg.contains(name))
    )
    return F.coalesce(flows, F.lit(False))


def field_base(text: str | Column) -> Column:
    """Text before the first dot of a member access; NULL without a dot."""
    t = F.trim(_c(text))
    return F.when(t.contains("."), F.trim(F.substring_index(t, ".", 1)))


# --- paths and short texts ----------------------------------------------------------------


def basename(path: str | Column) -> Column:
    return F.substring_index(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/", -1)


def short(text: str | Column, n: int | None = None) -> Column:
    """The first n characters, or the whole text."""
    return _c(text) if n is None else F.substring(_c(text), 1, n)


def first_items(array: str | Column, n: int) -> Column:
    return F.slice(_c(array), 1, n)


def last_segment(symbol: str | Column) -> Column:
    return F.substring_index(_c(symbol), ".", -1)


# --- scores, ids, ranks -------------------------------------------------------------------


def stable_id(file: str | Column, line: str | Column, symbol: str | Column) -> Column:
    """First 16 hex digits of SHA-256 of file:line:symbol; an empty symbol reads `unknown`."""
    s = _c(symbol)
    named = F.when(s.isNull() | (s == ""), F.lit("unknown")).otherwise(s)
    key = F.concat_ws(":", F.coalesce(_c(file), F.lit("")), _c(line).cast("string"), named)
    return F.substring(F.sha2(key, 256), 1, 16)


def severity(score: str | Column) -> Column:
    s = _c(score)
    return (
        F.when(s >= 9.0, "CRITICAL").when(s >= 7.0, "HIGH").when(s >= 4.0, "MEDIUM")
        .when(s > 0.0, "LOW").otherwise("INFO")
    )


def _rank(col: Column, values: list[str], default: int) -> Column:
    out = F.when(col == values[0], 0)
    for i, v in enumerate(values[1:], 1):
        out = out.when(col == v, i)
    return out.otherwise(default)


def severity_rank(col: str | Column = "severity", default: int = 4) -> Column:
    return _rank(_c(col), SEVERITIES, default)


def confidence_rank(col: str | Column = "confidence") -> Column:
    return _rank(F.lower(_c(col)), CONFIDENCES, 3)


def path_confidence(length: str | Column, source_is_parameter: Column) -> Column:
    n = _c(length)
    return (
        F.when(n <= 2, "confirmed").when(n <= 4, "high").when(source_is_parameter, "high")
        .otherwise("medium")
    )


def is_fp_candidate() -> Column:
    return (F.col("confidence") == "low") | (
        F.col("has_partial_sanitizer") & (F.col("confidence") != "confirmed")
    )


def risk_level(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return (
        F.when(critical > 0, "CRITICAL").when(high > 0, "HIGH").when(medium > 0, "MEDIUM")
        .when(low > 0, "LOW").otherwise("CLEAN")
    )


def duration_seconds(start: str | Column, end: str | Column) -> Column:
    """Seconds between two ISO-8601 texts, 2 decimals, NULL when either does not parse."""
    a, b = F.try_to_timestamp(_c(start)), F.try_to_timestamp(_c(end))
    return F.round((F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6), 2)
