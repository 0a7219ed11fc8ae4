"""FLT-13, GV-04: contracts as data, compiled to Columns: what a nested row breaks, with the path of each violation.

A contract is a dict:

    {"type": "struct", "fields": {name: contract}, "subset": [(a, b)], "disjoint": [(a, b)]}
    {"type": "array", "items": contract, "least": n, "most": n, "unique": field or True}
    {"type": "value", "required": bool, "enum": [...], "pattern": regex, "least": x, "most": x, "blank": bool}

`subset` and `disjoint` name two array fields of the struct; `unique` says that items (or a field of them) differ.  Fields that a struct has and
its contract doesn't name are told as `unknown`, fields of the contract that the schema lacks as `absent`; both are known before any row is read.

compiled() gives one Column, an array of (path, code), so a contract of any depth is checked in one pass, inside the plan; paths hold
places from 0, as in turns[3].role.  Nulls break `required` alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

KIND = "array<struct<path:string,code:string>>"


def _found(ok_or_null: Column, path: Column, code: str) -> Column:
    """One violation if the condition is false; nulls are no violation."""
    return F.when(~F.coalesce(ok_or_null, F.lit(True)), F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))).otherwise(F.array().cast(KIND))


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(KIND)


def _value(c: Column, path: Column, rule: dict) -> Column:
    parts = []
    if rule.get("required"):
        parts.append(_found(c.isNotNull(), path, "missing"))
    if "enum" in rule:
        parts.append(_found(c.isin(list(rule["enum"])), path, "not_in_enum"))
    if "pattern" in rule:
        parts.append(_found(c.rlike(rule["pattern"]), path, "pattern"))
    if "least" in rule:
        parts.append(_found(c >= F.lit(rule["least"]), path, "too_small"))
    if "most" in rule:
        parts.append(_found(c <= F.lit(rule["most"]), path, "too_large"))
    if rule.get("blank") is False:
        parts.append(_found(F.trim(c) != "", path, "blank"))
    return _all(parts)


def _array(c: Column, path: Column, rule: dict, kind: t.ArrayType) -> Column:
    parts = [_found(c.isNotNull(), path, "missing")] if rule.get("required") else []
    if "least" in rule:
        parts.append(_found(F.size(c) >= rule["least"], path, "too_few"))
    if "most" in rule:
        parts.append(_found(F.size(c) <= rule["most"], path, "too_many"))
    if unique := rule.get("unique"):
        keys = c if unique is True else F.transform(c, lambda x: x[unique])
        again = lambda x, i: F.when(x.isNotNull() & (F.array_position(keys, x) < i + 1), F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]" if unique is True else f"].{unique}")).alias("path"), F.lit("repeated").alias("code")))
        parts.append(F.coalesce(F.array_compact(F.transform(keys, again)), F.array().cast(KIND)))
    inner = lambda x, i: _compile(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), rule["items"], kind.elementType)
    if "items" in rule:
        parts.append(F.coalesce(F.flatten(F.transform(c, inner)), F.array().cast(KIND)))
    return _all(parts)


def _struct(c: Column | None, path: Column | None, rule: dict, kind: t.StructType) -> Column:
    at = lambda name: F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))
    of = lambda name: F.col(f"`{name}`") if c is None else c[name]
    always = lambda p, code: F.array(F.struct(p.alias("path"), F.lit(code).alias("code")))
    have, parts = {f.name: f.dataType for f in kind.fields}, []
    for name in rule["fields"]:
        parts.append(_compile(of(name), at(name), rule["fields"][name], have[name]) if name in have else always(at(name), "absent"))
    parts += [always(at(name), "unknown") for name in have if name not in rule["fields"]]
    for a, b in rule.get("subset", []):
        parts.append(_found(F.size(F.array_except(of(a), of(b))) == 0, at(a), f"not_within_{b}"))
    for a, b in rule.get("disjoint", []):
        parts.append(_found(~F.arrays_overlap(of(a), of(b)), at(a), f"overlaps_{b}"))
    whole = _all(parts)
    if c is None:
        return whole
    missing = _found(c.isNotNull(), path, "missing") if rule.get("required") else F.array().cast(KIND)
    return F.when(c.isNull(), missing).otherwise(whole)


def _compile(c: Column | None, path: Column | None, rule: dict, kind: t.DataType) -> Column:
    expected = {"struct": t.StructType, "array": t.ArrayType}.get(rule["type"])
    if expected and not isinstance(kind, expected) or not expected and isinstance(kind, (t.StructType, t.ArrayType, t.MapType)):
        return F.array(F.struct((path if path is not None else F.lit("")).alias("path"), F.lit("type").alias("code")))
    if rule["type"] == "struct":
        return _struct(c, path, rule, kind)
    return _array(c, path, rule, kind) if rule["type"] == "array" else _value(c, path, rule)


def compiled(contract: dict, schema: t.StructType) -> Column:
    """The violations of a row of this schema, as an array of (path, code)."""
    return _compile(None, None, contract, schema)


def violations(df: DataFrame, keys: list[str], contract: dict, unique: list[list[str]] = ()) -> DataFrame:
    """(keys, path, code) of every row's violations; `unique`: columns that no two rows share, told for each of them."""
    out = df.select(*keys, F.explode(compiled(contract, df.schema)).alias("v")).select(*keys, "v.path", "v.code")
    for columns in unique:
        again = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(again[c]) for c in columns])
        out = out.union(df.join(again, same, "left_semi").select(*keys, F.lit(",".join(columns)), F.lit("repeated_row")))
    return out
