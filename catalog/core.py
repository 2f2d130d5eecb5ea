"""The registry, and small helpers to write the SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build`` under ``name``; ``covers`` lists the inventory lines it shows."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, covers, build, sql)
        return build

    return add


# -- SQL text helpers --------------------------------------------------------


def rnd(expr: str, places: int) -> str:
    scale = 10**places
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5 + 1e-6) / {scale})"


def fix(expr: str, places: int) -> str:
    if places == 0:
        return f"(floor(({expr})::DOUBLE + 0.5 + 1e-6)::BIGINT::VARCHAR)"
    return f"printf('%.{places}f', {rnd(expr, places)})"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(pow(sin(radians({lat2}-({lat1}))/2),2) + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians({lon2}-({lon1}))/2),2))"
    )
    return f"(6371.0*2*atan2(sqrt({h}),sqrt(1-{h})))"


def key(seed: str, *parts: str) -> str:
    return "md5(concat_ws('|','" + seed + "'," + ",".join(parts) + "))"


def draw(seed: str, *parts: str) -> str:
    return f"('0x'||substr({key(seed, *parts)},1,8))::BIGINT"


def permuted(index: str, size: str, seed: str, *parts: str) -> str:
    """Twin of the keyed permutation: the same rounds as list folds."""
    digests = f"({key(seed, *parts)}||{key(seed + '+', *parts)})"
    words = [f"('0x'||substr({digests},{8 * i + 1},8))::BIGINT" for i in range(6)]
    bits = f"greatest(length(bin(({size})::BIGINT-1)),6)"
    mixed = "((s.r+k)%2147483648*1597334677%2147483648)"

    def once(x: str) -> str:
        high, low = f"(1::BIGINT<<({bits}//2))", f"(1::BIGINT<<(({bits}+1)//2))"
        return (
            f"list_transform([list_reduce([{','.join(words)}], lambda s, k: {{'l': s.r, 'r': xor(s.l, ({mixed}*{mixed}>>20)%s.w), "
            f"'w': s.v, 'v': s.w}}, {{'l': ({x})//{low}, 'r': ({x})%{low}, 'w': {high}, 'v': {low}}})], lambda z: z.l*{low}+z.r)[1]"
        )

    start = once(f"({index})::BIGINT")
    return f"list_reduce(range(1,64), lambda x, _: case when x>=({size}) then {once('x')} else x end, {start})"


def cell(expr: str, places: int) -> str:
    return f"round(({expr})*{10**places})::INTEGER"


def region_label(lat_cell: str, lon_cell: str) -> str:
    return f"(printf('%.1f',{lat_cell}/10.0::DOUBLE)||','||printf('%.1f',{lon_cell}/10.0::DOUBLE))"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE/nullif(({b})::DOUBLE,0),0.0)"
