"""Pipeline rewrites that Catalyst can't make, since it never sees the stages."""

from __future__ import annotations


def _touches(spec, prefix: str) -> bool:
    """Whether a query document names a path at or under ``prefix``, or an expression."""
    for k, v in spec.items():
        if k in ("$and", "$or", "$nor"):
            if any(_touches(q, prefix) for q in v):
                return True
        elif k.startswith("$") or k == prefix or k.startswith(prefix + ".") or prefix.startswith(k + "."):
            return True
    return False


def rewrite(pipeline: list[dict]) -> list[dict]:
    """The pipeline with fused and moved stages.

    * adjacent $match stages are one;
    * a $match moves ahead of $lookup, $sort and field-adding stages whose
      output it doesn't read;
    * $lookup with equality and $unwind of its result is one flat join;
    * $limit after $limit takes the lesser, $skip after $skip the sum.
    """
    out = [dict(s) for s in pipeline]
    changed = True
    while changed:
        changed = False
        for i in range(len(out) - 1):
            (a, x), (b, y) = next(iter(out[i].items())), next(iter(out[i + 1].items()))
            new = None
            if a == b == "$match" and "$text" not in x and "$text" not in y:
                new = [{"$match": {"$and": [x, y]} if x and y else x or y}]
            elif b == "$match" and "$text" not in y:
                made = [x["as"]] if a == "$lookup" else list(x) if a in ("$addFields", "$set") else [] if a == "$sort" else None
                if made is not None and not any(_touches(y, m) for m in made) and not (made and _touches(y, "\0")):
                    new = [out[i + 1], out[i]]
            elif a == b == "$limit":
                new = [{"$limit": min(x, y)}]
            elif a == b == "$skip":
                new = [{"$skip": x + y}]
            elif a == "$lookup" and b == "$unwind" and "localField" in x and "pipeline" not in x:
                u = {"path": y} if isinstance(y, str) else y
                if u["path"] == "$" + x["as"] and "includeArrayIndex" not in u:
                    new = [{"$lookupUnwind": x | {"preserve": u.get("preserveNullAndEmptyArrays", False)}}]
            if new is not None:
                out[i : i + 2] = new
                changed = True
                break
    return out
