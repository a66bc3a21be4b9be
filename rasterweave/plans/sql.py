"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from ..fixtures import GRAY

REFLECT, OUTSIDE = "reflect", "outside"


def mirror(i: str, last: str) -> str:
    return f"case when {i} < 0 then -({i}) when {i} > {last} then 2 * {last} - ({i}) else {i} end"


def around(name: str, source: str, offsets: list[tuple], value: str = "v", pad: str = REFLECT, default: str = "null") -> str:
    """A table `name` (y, x, k, w, v): the source's value at each offset (dy, dx, weight) k of each pixel."""
    rows = ", ".join(f"({k}, {o[0]}, {o[1]}, {o[2] if len(o) > 2 else 1}::double)" for k, o in enumerate(offsets))
    ends = f"(select max(y) as my, max(x) as mx from {source}) d"
    to = (mirror("a.y + o.dy", "d.my"), mirror("a.x + o.dx", "d.mx")) if pad == REFLECT else ("a.y + o.dy", "a.x + o.dx")
    moved = f"select a.y, a.x, o.k, o.w, ({to[0]})::int as ty, ({to[1]})::int as tx from {source} a cross join (values {rows}) o(k, dy, dx, w) cross join {ends}"
    if pad == REFLECT:
        return f"{name} as materialized (select t.y, t.x, t.k, t.w, b.{value} as v from ({moved}) t join {source} b on b.y = t.ty and b.x = t.tx)"
    return f"{name} as materialized (select t.y, t.x, t.k, t.w, coalesce(b.{value}, {default}) as v from ({moved}) t left join {source} b on b.y = t.ty and b.x = t.tx)"


def kernel(rows: list[list[float]]) -> list[tuple]:
    r = len(rows) // 2
    return [(dy, dx, repr(float(rows[dy + r][dx + r]))) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def correlated(name: str, source: str, rows: list[list[float]], value: str = "v") -> str:
    """A table `name` (y, x, v): the correlation of the source with a kernel."""
    return around(f"{name}_n", source, kernel(rows), value) + f",\n{name} as materialized (select y, x, sum(v * w) as v from {name}_n group by y, x)"


def gray(*tables: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{GRAY}" + "".join(f",\n{t}" for t in tables) + f"\n{select}"


def gradients(kx: list[list[float]], ky: list[list[float]], source: str = "g", name: str = "gr") -> str:
    return f"{correlated(name + 'x', source, kx)},\n{correlated(name + 'y', source, ky)},\n{name} as materialized (select y, x, a.v as gx, b.v as gy, sqrt(a.v * a.v + b.v * b.v) as m from {name}x a join {name}y b using (y, x))"


def morph(name: str, source: str, offsets: list[tuple[int, int]], op: str) -> str:
    agg = "bool_and" if op == "erode" else "bool_or"
    return around(f"{name}_n", source, [tuple(o) for o in offsets], "fg", OUTSIDE, "false") + f",\n{name} as materialized (select y, x, {agg}(v) as fg from {name}_n group by y, x)"


#: Components of a table fg(y, x, fg): (y, x, label, size).
COMPONENTS = """walk as (select y, x, y as ry, x as rx from fg where fg union select f.y, f.x, w.ry, w.rx from walk w join fg f on f.fg and f.y between w.y - 1 and w.y + 1 and f.x between w.x - 1 and w.x + 1),
owner as (select y, x, min(ry * 100000 + rx) as root from walk group by y, x),
lab as (select y, x, dense_rank() over (order by root) as label, count(*) over (partition by root) as size from owner)"""
