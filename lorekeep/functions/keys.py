"""Normal forms of ids and of paths below a store root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_LENGTH = 36


BLANKS = " \t\n\r\f\v\u00a0"


def norm_id(c: Column) -> Column:
    """Trimmed, lower case; blank and null ids are null."""
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def store_path(c: Column, root: str = "/srv/memstore") -> Column:
    """The shortest form of a path relative to root; empty and null paths are null.

    A backslash counts as '/', doubled slashes and '.' steps vanish, '..' removes the step before it, and the
    root itself in front makes no difference. Letter case is kept. A path that leaves the root keeps its
    absolute form. Clean paths, the usual case, skip the folding of steps.
    """
    p = F.regexp_replace(c, r"\\", "/")
    full = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    steps = F.aggregate(
        F.split(full, "/"),
        F.array().cast("array<string>"),
        lambda kept, step: F.when((step == "") | (step == "."), kept)
        .when(step == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept))
        .otherwise(F.concat(kept, F.array(step))),
    )
    folded = F.concat(F.lit("/"), F.array_join(steps, "/"))
    below = F.when(folded == root.rstrip("/"), F.lit("")).when(
        folded.startswith(root.rstrip("/") + "/"), F.substring(folded, len(root.rstrip("/")) + 2, 1 << 30)
    ).otherwise(folded)
    odd = c.rlike(r"\\|//|/$|^/|(^|/)\.\.?(/|$)")
    return F.nullif(F.when(odd, below).otherwise(c), F.lit(""))
