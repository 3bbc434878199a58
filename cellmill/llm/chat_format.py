"""Chat formatting: link tool calls with their results, order them, validate arguments, serialise canonical JSON.

Calls and results are hash-joined by identifier. A call may name the call after whose result it comes; together with
result -> call these links form a forest, and pointer doubling gives each message its depth, which is a topological order
(sort a conversation by depth, then turn). Arguments are parsed as VARIANT and checked against the schema of the called
function; JSON is written with sorted keys and no white space. DataFrame operations only: one row a message comes out, so
no conversation is ever gathered in one task.

Defined results: a result without a call is an ``orphan``, a call without a result ``open``, a call or result whose
identifier occurs again among its kind ``repeated`` (still linked); a message in a cycle of links, or behind one, has null
depth; arguments that are no JSON object, or one that repeats a key, give the error ``not an object``; a null text is the
empty text; texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, without

OUTPUT = ("status", "linked", "depth", "errors", "json")


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null if it is none."""
    return F.to_json(F.try_parse_json(json))


_KINDS = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
#: Rules that are checked, and words that say nothing about validity.
RULES = {
    "type", "enum", "const", "properties", "required", "additionalProperties", "items", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties",
}
NOTES = {"title", "description", "default", "examples", "$comment"}


def _problems(value: Column, schema: dict, at: str) -> Column:
    """An array of complaints about a variant that stands at a place (empty for the whole)."""
    if unknown := sorted(schema.keys() - RULES - NOTES):
        raise ValueError(f"rules {unknown} at {at or 'the top'} aren't supported; there are {sorted(RULES)}")
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    number = F.when(kind.isin(*_KINDS["number"]), F.try_variant_get(value, "$", "double"))
    json = F.to_json(value)
    say = lambda bad, what: F.when(bad, F.lit(f"{at}: {what}" if at else what))
    checks: list[Column] = []
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = F.lit(False)
        for t in types:
            # a number without a fraction is an integer, however it is written
            fits = fits | ((number % 1 == 0) if t == "integer" else kind.isin(*_KINDS[t]))
        checks.append(say(~F.coalesce(fits, F.lit(False)), f"not {' or '.join(types)}"))
    canonical_of = lambda x: F.to_json(F.parse_json(F.lit(dumps(x))))
    same = lambda x: (number == float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else json == canonical_of(x)
    if "enum" in schema:
        any_ = F.lit(False)
        for x in schema["enum"]:
            any_ = any_ | F.coalesce(same(x), F.lit(False))
        checks.append(say(~any_, "not one of the values"))
    if "const" in schema:
        checks.append(say(~F.coalesce(same(schema["const"]), F.lit(False)), "not the value"))
    for rule, bad in (
        ("minLength", lambda x: F.char_length(text) < x), ("maxLength", lambda x: F.char_length(text) > x), ("pattern", lambda x: ~text.rlike(x)), ("minimum", lambda x: number < x), ("maximum", lambda x: number > x),
        ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x), ("multipleOf", lambda x: F.abs(number / x - F.round(number / x)) > 1e-9),
    ):
        if rule in schema:
            word = {"minLength": "too short", "maxLength": "too long", "pattern": "not of the pattern", "minimum": "too small", "maximum": "too large", "exclusiveMinimum": "too small", "exclusiveMaximum": "too large", "multipleOf": "no multiple"}[rule]
            checks.append(say(bad(schema[rule]), word))
    nested: list[Column] = []
    if schema.keys() & {"items", "minItems", "maxItems", "uniqueItems"}:
        parts = F.when(kind == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))
        if "minItems" in schema:
            checks.append(say(F.size(parts) < schema["minItems"], "too few"))
        if "maxItems" in schema:
            checks.append(say(F.size(parts) > schema["maxItems"], "too many"))
        if schema.get("uniqueItems"):
            shown = F.transform(parts, lambda x: F.to_json(x))
            checks.append(say(F.size(F.array_distinct(shown)) < F.size(shown), "repeated"))
        if "items" in schema:
            nested.append(F.coalesce(F.flatten(F.transform(parts, lambda x: _problems(x, schema["items"], f"{at}[]"))), F.array().cast("array<string>")))
    if schema.keys() & {"properties", "required", "additionalProperties", "minProperties", "maxProperties"}:
        keys = F.when(kind == "OBJECT", F.json_object_keys(json))
        place = lambda f: f"{at}.{f}" if at else f
        checks += [F.when(~F.array_contains(keys, f), F.lit(f"{place(f)}: missing")) for f in schema.get("required", [])]
        if "minProperties" in schema:
            checks.append(say(F.size(keys) < schema["minProperties"], "too few"))
        if "maxProperties" in schema:
            checks.append(say(F.size(keys) > schema["maxProperties"], "too many"))
        for field, rule in schema.get("properties", {}).items():
            if "'" in field and '"' in field:
                raise ValueError(f"{field}: a name with both kinds of quotes can't be looked up")
            quote = '"' if "'" in field else "'"
            here = F.when(kind == "OBJECT", F.try_variant_get(value, f"$[{quote}{field}{quote}]", "variant"))
            nested.append(F.when(F.array_contains(keys, field), _problems(here, rule, place(field))).otherwise(F.array().cast("array<string>")))
        if schema.get("additionalProperties", True) is False:
            unknown = F.array_except(keys, F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>"))
            nested.append(F.coalesce(F.transform(unknown, lambda k: F.concat(F.lit(f"{at}." if at else ""), k, F.lit(": unknown"))), F.array().cast("array<string>")))
        elif isinstance(schema.get("additionalProperties", True), dict):
            raise ValueError("additionalProperties is true or false")
    own = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return F.concat(own, *nested) if nested else own


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Sorted complaints about a call's arguments. schemas: function -> JSON schema of its arguments, which are an object;
    rules in RULES are checked at any depth (places in lists as []), those in NOTES are notes, others raise ValueError."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
    out = F.when(name.isNull(), F.array().cast("array<string>"))
    for function, schema in schemas.items():
        found = F.sort_array(F.array_distinct(_problems(value, {k: v for k, v in schema.items() if k != "type"}, "")))
        out = out.when(name == function, F.when(is_object, found).otherwise(F.array(F.lit("not an object"))))
    return out.otherwise(F.array(F.concat(name, F.lit(": no such function"))))


def depths(links: DataFrame) -> DataFrame:
    """links: node, parent (null for roots), unique nodes. Returns node, depth (0 for roots; null in or behind a cycle).
    A parent that is no node counts as none. The number of rounds is the logarithm of the number of nodes."""
    nodes = links.select(F.col("node").alias("p"))
    state = links.join(nodes, F.col("parent") == F.col("p"), "left").select("node", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = materialise(state)
    total, rounds = state.count(), 0
    done, active = state.filter("up is null"), state.filter("up is not null")
    while not active.isEmpty():
        if 2**rounds > total:  # longer than any path without a cycle
            return done.select("node", "depth").union(active.select("node", F.lit(None).cast("long")))
        above = done.union(active).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        # only what hasn't reached a root moves on, and is written again
        moved = materialise(active.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        done, active = done.union(moved.filter("up is null")), moved.filter("up is not null")
        rounds += 1
    return done.select("node", "depth")


def link_tools(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every row of messages with status, linked (the call's or result's counterpart stands), depth, errors and json.

    messages: role, text, call_id (of the call that this message makes), name, arguments (JSON of that call), result_of
    (the call_id that this message answers), after (the call_id after whose result a call comes); null where it is none
    of these. Other columns are kept."""
    key = "__chat_key"
    base = without(messages, *OUTPUT).withColumn(key, F.coalesce(F.concat(F.lit("c:"), "call_id"), F.concat(F.lit("r:"), "result_of")))
    base = materialise(base)
    calls = base.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_calls"), F.min("after").alias("after"))
    results = base.filter("result_of is not null and call_id is null").groupBy(F.col("result_of").alias("call_id")).agg(F.count("*").alias("n_results"))
    # one row an identifier on either side, so a task's hash table is its share of them
    both = materialise(calls.join(results.hint("shuffle_hash"), "call_id", "full"))
    # a call comes after the result of the call it names, or after that call if there is no result
    named = both.filter("n_calls is not null").select(F.col("call_id").alias("after"), F.when(F.col("n_results").isNotNull(), F.concat(F.lit("r:"), "call_id")).otherwise(F.concat(F.lit("c:"), "call_id")).alias("parent"))
    links = both.filter("n_calls is not null").join(named, "after", "left").select(F.concat(F.lit("c:"), "call_id").alias("node"), "parent")
    links = links.union(both.filter("n_results is not null").select(F.concat(F.lit("r:"), "call_id"), F.when(F.col("n_calls").isNotNull(), F.concat(F.lit("c:"), "call_id"))))
    depth = depths(materialise(links))
    facts = both.filter("n_calls is not null").select(F.concat(F.lit("c:"), "call_id").alias(key), F.col("n_calls").alias("same"), F.coalesce(F.col("n_results") > 0, F.lit(False)).alias("linked"))
    facts = facts.union(both.filter("n_results is not null").select(F.concat(F.lit("r:"), "call_id"), "n_results", F.coalesce(F.col("n_calls") > 0, F.lit(False))))
    facts = materialise(facts.join(depth.withColumnRenamed("node", key), key))
    out = base.join(facts.hint("shuffle_hash"), key, "left")
    none = F.col(key).isNull()
    status = F.when(none, "plain").when(F.col("same") > 1, "repeated").when(F.col("linked"), "linked").when(F.col("call_id").isNotNull(), "open").otherwise("orphan")
    arguments = F.try_parse_json("arguments")
    call = F.when(F.col("call_id").isNotNull(), F.array(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), F.col("name"))))
    message = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.col("role"), F.when(F.col("call_id").isNull(), F.col("result_of")).alias("tool_call_id"), call.alias("tool_calls")))
    out = out.withColumns({
        "status": status,
        "linked": F.coalesce("linked", F.lit(False)),
        "depth": F.when(none, F.lit(0).cast("long")).otherwise(F.col("depth")),
        "errors": argument_errors(F.when(F.col("call_id").isNotNull(), F.coalesce("name", F.lit(""))), F.coalesce("arguments", F.lit("")), schemas),
        "json": message,
    })
    return out.drop(key, "same")
