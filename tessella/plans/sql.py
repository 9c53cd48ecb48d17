"""Helpers for stating a query twice: as DataFrames and as SQL of another engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decimal places that both engines are rounded to.
PLACES = 6

_OF_VALUE, _OF_VECTOR = "value", "vector"
GRIDS = {  # name: (what a cell is made of, its value as an expression over k, width, height, planes); k = floor(1000 |value|), or the sum of those of a vector
    "mix": (_OF_VALUE, "k % 256", 24, 16, 3),
    "mix_b": (_OF_VALUE, "(k * 3 + 31) % 256", 24, 16, 3),
    "odd": (_OF_VECTOR, "k % 256", 13, 7, 3),
    "dots": (_OF_VECTOR, "case when k % 7 = 0 then 200 else 0 end", 17, 12, 1),
    "steps": (_OF_VECTOR, "k % 40", 32, 32, 1),
}


def plain(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Longs, rounded doubles and strings only, so that both engines give the same types and values."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint", "bigint"):
            out.append(F.col(name).cast("long").alias(name))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            out.append((F.round(F.col(name).cast("double"), places) + 0.0).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def typed(sql: str, columns: str, places: int = PLACES) -> str:
    """sql with its columns typed as `plain` does: `name:l` long, `name:d` double, `name:s` as it is."""
    parts = []
    for item in columns.split():
        name, kind = item.split(":")
        name = f'"{name}"'
        parts.append({"l": f"CAST({name} AS BIGINT)", "d": f"ROUND(CAST({name} AS DOUBLE), {places}) + 0.0", "s": name}[kind] + f" AS {name}")
    return f"SELECT {', '.join(parts)} FROM ({sql}) AS inner_query"


def grid_sql(name: str) -> str:
    """Values of all embeddings in order, folded into images of one size; the last image is filled up with zeros."""
    of, v, width, height, planes = GRIDS[name]
    cells = width * height * planes
    of_value = "SELECT vec_id * 64 + i - 1 AS nth, CAST(FLOOR(ABS(embedding[i]::DOUBLE) * 1000) AS BIGINT) AS k FROM embeddings, (SELECT range AS i FROM range(1, 65))"
    of_vector = "SELECT vec_id AS nth, CAST(list_sum(list_transform(embedding, lambda e: FLOOR(ABS(e::DOUBLE) * 1000))) AS BIGINT) AS k FROM embeddings"
    source = of_value if of == _OF_VALUE else of_vector
    return f"""(SELECT f.image_id, p.pos // {width * height} AS c, p.pos % {width * height} // {width} AS y, p.pos % {width} AS x, COALESCE(s.v, 0.0) AS v
FROM (SELECT DISTINCT nth // {cells} AS image_id FROM ({source})) f CROSS JOIN (SELECT range AS pos FROM range({cells})) p LEFT JOIN (SELECT nth, CAST({v} AS DOUBLE) AS v FROM ({source})) s ON s.nth = f.image_id * {cells} + p.pos)"""


def fold_sql(at: str, n: int, policy: str) -> str:
    """Border policy as SQL over the coordinate `at`."""
    if policy == "clamp":
        return f"least(greatest({at}, 0), {n - 1})"
    if policy == "drop":
        return at
    m = 2 * n if policy == "mirror" else 2 * n - 2
    back = 2 * n - 1 if policy == "mirror" else 2 * n - 2
    r = f"((({at}) % {m}) + {m}) % {m}"
    return f"(CASE WHEN {r} < {n} THEN {r} ELSE {back} - {r} END)"


def stencil_sql(grid: str, width: int, height: int, taps: Sequence[tuple[int, int, float]], policy: str, value: str = "SUM(k.w * q.v)") -> str:
    """The stencil as a join of cells, taps and cells."""
    values = ", ".join(f"({dx}, {dy}, {w!r}::DOUBLE)" for dx, dy, w in taps)
    return f"""SELECT p.image_id, p.c, p.y, p.x, {value} AS v
FROM {grid} AS p, (VALUES {values}) AS k(dx, dy, w), {grid} AS q
WHERE q.image_id = p.image_id AND q.c = p.c AND q.x = {fold_sql('p.x + k.dx', width, policy)} AND q.y = {fold_sql('p.y + k.dy', height, policy)}
GROUP BY p.image_id, p.c, p.y, p.x"""
