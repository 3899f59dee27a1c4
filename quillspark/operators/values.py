"""JSON values: canonical encoding of parameters, and the violations of a schema."""

from __future__ import annotations

import json
import re
from functools import reduce
from math import copysign

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored  # noqa: F401  nothing is written here any more; test_schema_checks_are_one_pass takes it away

#: A key that scripts list before others, in order of its number.
INDEX = re.compile(r"(?:0|[1-9][0-9]{0,9})")
LAST_INDEX = 4294967294
#: Rows of a schema check: violations, and values that are still to be looked into.
ROWS = "array<struct<path:string,problem:string,v:variant,node:int>>"


def _kind(text: Column) -> Column:
    """What a value is, by the first character of its JSON."""
    head = F.left(text, F.lit(1))
    names = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
    return F.coalesce(*[F.when(head == k, v) for k, v in names.items()], F.lit("number"))


def number_text(x: float) -> str:
    """A double as scripts print it, but with the sign of a zero."""
    if x == 0:
        return "-0" if copysign(1, x) < 0 else "0"
    if x.is_integer() and abs(x) < 1 << 53:
        return str(int(x))
    sign, whole, part, power = re.fullmatch(r"(-?)(\d+|inf)\.?(\d*)(?:e(.*))?", repr(x)).groups()
    if whole == "inf":
        return f"{sign}Infinity"
    led = (whole + part).lstrip("0")
    digits, point = led.rstrip("0"), int(power or 0) - len(part) + len(led)
    if -6 < point <= 21:
        return sign + (digits.ljust(point, "0") if point >= len(digits) else f"{digits[:point]}.{digits[point:]}" if point > 0 else f"0.{'0' * -point}{digits}")
    return f"{sign}{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{point - 1:+d}"


def _text(x: str) -> str:
    """A string behind its length in code units. Halves of surrogate pairs that stand alone can't be written."""
    units = x.encode("utf-16-le", "surrogatepass")
    return f"{len(units) // 2}:{x if x.isascii() else units.decode('utf-16-le', 'replace')}"


def _member_order(member: tuple) -> int:
    """Keys that are numbers come first, the others stay in their order."""
    return int(member[0]) if INDEX.fullmatch(member[0]) and int(member[0]) <= LAST_INDEX else LAST_INDEX + 1


def _object(members: list[tuple]) -> dict:
    found = dict(members)
    if len(found) < len(members):
        raise ValueError("a key is repeated")
    return found


def _no_number(text: str):
    raise ValueError(text)


def encoding(text: str | None) -> str | None:
    """The canonical encoding of a JSON text, in time linear in it; None where it is no JSON, repeats a key of an object or is nested too deeply for the parser."""
    try:
        value = json.loads(text or "", parse_int=float, parse_constant=_no_number, object_pairs_hook=_object)
    except (ValueError, RecursionError):
        return None
    out, left = [], [value]
    while left:
        x = left.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(f"string:{_text(x)};")
        elif isinstance(x, float):
            out.append(f"number:{number_text(x)};")
        elif isinstance(x, list):
            out.append(f"array:{len(x)}[")
            left += [("]",), *reversed(x)]
        elif isinstance(x, dict):
            out.append("object:")
            left.append((";",))
            for k, v in reversed(sorted(x.items(), key=_member_order)):
                left += [v, (f"key:{_text(k)}:",)]
        else:
            out.append("null;" if x is None else f"boolean:{x:d};")
    return "".join(out)


def _encoded(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([encoding(x) for x in batch.column("json").to_pylist()], pa.string())], ["id", "encoding"])


def canonical_values(values: DataFrame) -> DataFrame:
    """values(id, json) -> id, encoding, hash: type tags, lengths before texts, keys in the order in which scripts list them, -0 kept; null where json is none.

    Each value is encoded where it is read: nothing is shuffled or written."""
    rows = values.select("id", "json").mapInArrow(_encoded, f"id {values.schema['id'].dataType.simpleString()}, encoding string")
    return rows.select("id", "encoding", F.sha2("encoding", 256).alias("hash"))


def canonical_segments(segments: Column) -> Column:
    """The encoding of rows of values that are encoded already: an array of arrays."""
    array = lambda xs: F.concat(F.lit("array:"), F.size(xs).cast("string"), F.lit("["), F.array_join(xs, ""), F.lit("]"))
    return array(F.transform(segments, array))


def schema_violations(values: DataFrame, schema: dict) -> DataFrame:
    """values(id, json) -> id, path, problem: every violation, each with its path. schema knows type, enum, properties, required, additionalProperties false and items.

    The schema is compiled: a text is parsed once, and each level of items is one projection, whose rows are violations
    and the elements that are still to be looked into. Members are taken out of the parsed value, and only values of the
    right type are looked into. So all is one pass; nothing is shuffled or written. What isn't JSON is a violation of its own."""
    rows = values.select("id", F.lit("$").alias("path"), F.lit(0).alias("node"), F.try_parse_json("json").alias("v"))
    rows = rows.withColumn("problem", F.when(F.col("v").isNull(), "not JSON"))
    nodes, first = [schema], 0
    while first < len(nodes):
        last, found = len(nodes), []
        for n in range(first, last):
            rows, own = _checked(rows, n, nodes)
            found.append(F.when((F.col("node") == n) & F.col("problem").isNull(), own))
        done = F.array(_row(F.col("path"), F.col("problem"), F.col("v"), F.col("node")))
        rows = rows.select("id", F.explode(F.coalesce(*found, done)).alias("x")).where("x IS NOT NULL").select("id", "x.*")
        first = last
    return rows.select("id", "path", "problem")


def _row(path: Column, problem: Column, value: Column | None = None, node: Column | None = None) -> Column:
    value = F.lit(None).cast("variant") if value is None else value
    return F.struct(path.alias("path"), problem.alias("problem"), value.alias("v"), (F.lit(-1) if node is None else node).alias("node"))


def _checked(rows: DataFrame, n: int, nodes: list[dict]) -> tuple[DataFrame, Column]:
    """rows with columns of what node n and the members in it hold, and an array of what is found: violations, nulls, and elements of node numbers that are added to nodes."""
    live = (F.col("node") == n) & F.col("problem").isNull()
    slots, lists = [], []
    places = [("v", F.col("path"), nodes[n], live)]
    while places:
        depth = len(rows.columns)
        text, kind = (lambda i, d=depth: F.col(f"text_{n}_{d}_{i}")), (lambda i, d=depth: F.col(f"kind_{n}_{d}_{i}"))
        rows = rows.withColumns({f"text_{n}_{depth}_{i}": F.when(p[3], F.to_json(p[0])) for i, p in enumerate(places)})
        rows = rows.withColumns({f"kind_{n}_{depth}_{i}": F.when(text(i).isNotNull(), _kind(text(i))) for i in range(len(places))})
        members, deeper = {}, []
        for i, (value, path, schema, there) in enumerate(places):
            fit = there
            if "type" in schema:
                types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
                number = text(i).try_cast("double")
                fits = [(kind(i) == "number") & (number == F.floor(number)) if t == "integer" else kind(i) == t for t in types]
                fit = F.coalesce(reduce(lambda a, b: a | b, fits), F.lit(False))
                slots.append(F.when(there & ~fit, _row(path, F.concat(F.lit(f"expected type {' | '.join(types)}, got "), kind(i)))))
                fit = there & fit
            if "enum" in schema:
                options = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
                slots.append(F.when(fit & ~text(i).isin(options), _row(path, F.concat(F.lit("value "), text(i), F.lit(f" is not one of [{','.join(options)}]")))))
            if "properties" in schema:
                inside = fit & (kind(i) == "object")
                names = {}
                for key, inner in schema["properties"].items():
                    names[key] = f"member_{n}_{depth}_{len(members)}"
                    members[names[key]] = F.when(inside, _member(F.col(value), key))
                    deeper.append((names[key], F.concat(path, F.lit(f".{key}")), inner, F.col(names[key]).isNotNull()))
                for key in schema.get("required", []):
                    absent = F.col(names[key]).isNull() if key in names else ~F.array_contains(F.json_object_keys(text(i)), key)
                    slots.append(F.when(inside & absent, _row(F.concat(path, F.lit(f".{key}")), F.lit("required property is missing"))))
                if schema.get("additionalProperties") is False:
                    more = F.array_except(F.json_object_keys(text(i)), F.array(*[F.lit(k) for k in schema["properties"]]).cast("array<string>"))
                    lists.append((inside, F.transform(more, lambda k: _row(F.concat(path, F.lit("."), k), F.lit("unexpected property (additionalProperties is false)")))))
            if "items" in schema:
                node = len(nodes)
                nodes.append(schema["items"])
                element = lambda v, at: _row(F.concat(path, F.lit("["), at.cast("string"), F.lit("]")), F.lit(None).cast("string"), F.coalesce(v, F.expr("parse_json('null')")), F.lit(node))
                lists.append((fit & (kind(i) == "array"), F.transform(F.try_variant_get(value, "$", "array<variant>"), element)))
        if members:
            rows = rows.withColumns(members)
        places = deeper
    none = F.array().cast(ROWS)
    return rows, F.concat(F.array(*slots).cast(ROWS), *[F.when(where, some).otherwise(none) for where, some in lists])


def _member(value: Column, key: str) -> Column:
    """A member of a parsed object, or null if there is none; a path can't name a key with both kinds of quotes, which is looked up."""
    quote = next((q for q in "'\"" if q not in key), None)
    if quote is None:
        held = F.try_variant_get(value, "$", "map<string,variant>")
        return F.when(F.map_contains_key(held, key), F.coalesce(F.element_at(held, key), F.expr("parse_json('null')")))
    return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")
