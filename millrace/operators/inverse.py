"""Query documents against one plain document, for stored queries."""

from __future__ import annotations

import re


def _at(doc, parts: list[str]) -> list:
    """All values at a path, through arrays."""
    if not parts:
        return [doc, *doc] if isinstance(doc, list) else [doc]
    if isinstance(doc, list):
        return [v for d in doc for v in _at(d, parts)]
    return _at(doc[parts[0]], parts[1:]) if isinstance(doc, dict) and parts[0] in doc else []


def _comparable(a, b) -> bool:
    number = (int, float)
    return isinstance(a, bool) == isinstance(b, bool) and (type(a) is type(b) or (isinstance(a, number) and isinstance(b, number)))


def _test(values: list, op: str, v, around: dict) -> bool:
    if op == "$eq":
        return any(x == v and (v is None or _comparable(x, v)) for x in values) or (v is None and not values)
    if op == "$ne":
        return not _test(values, "$eq", v, around)
    if op == "$in":
        return any(_test(values, "$eq", x, around) for x in v)
    if op == "$nin":
        return not _test(values, "$in", v, around)
    if op == "$exists":
        return bool(values) == bool(v)
    if op == "$not":
        return not _field(values, v)
    if op == "$regex":
        flags = sum({"i": re.I, "m": re.M, "s": re.S, "x": re.X}[c] for c in around.get("$options", ""))
        return any(isinstance(x, str) and re.search(v, x, flags) for x in values)
    if op == "$size":
        return any(isinstance(x, list) and len(x) == v for x in values[:1])
    if op == "$elemMatch":
        return any(matches(v, x) if isinstance(x, dict) else _field([x], v) for x in values)
    if op in ("$options", "$comment"):
        return True
    compare = {"$gt": lambda x: x > v, "$gte": lambda x: x >= v, "$lt": lambda x: x < v, "$lte": lambda x: x <= v}
    if op in compare:
        return any(_comparable(x, v) and compare[op](x) for x in values)
    raise ValueError(f"unknown query operator {op}")


def _field(values: list, cond) -> bool:
    if isinstance(cond, dict) and cond and all(k.startswith("$") for k in cond):
        return all(_test(values, op, v, cond) for op, v in cond.items())
    return _test(values, "$eq", cond, {})


def matches(query: dict, doc: dict) -> bool:
    for key, v in query.items():
        if key == "$and":
            ok = all(matches(q, doc) for q in v)
        elif key == "$or":
            ok = any(matches(q, doc) for q in v)
        elif key == "$nor":
            ok = not any(matches(q, doc) for q in v)
        else:
            ok = _field(_at(doc, key.split(".")), v)
        if not ok:
            return False
    return True
