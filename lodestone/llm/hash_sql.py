"""XXH64 as DuckDB SQL, by its published definition.

A relation of (k, h, seed), h the bytes as figures of base 16, becomes one of
(k, x).  All arithmetic is of 128 bits, cut to 64.
"""

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_ALL = 1 << 64


def _const(n: int) -> str:
    return f"{n}::UHUGEINT"


def _sum(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {_const(_ALL)})"


def _times(x: str, prime: int) -> str:
    return f"(({x} * {_const(prime)}) % {_const(_ALL)})"


def _turn(x: str, r: int) -> str:
    return f"(({x} * {_const(1 << r)}) % {_const(_ALL)} + {x} // {_const(1 << 64 - r)})"


def _word(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes at a place of h."""
    return "CAST('0x' || " + " || ".join(f"substring(h, {at} + {2 * i + 1}, 2)" for i in reversed(range(size))) + " AS UBIGINT)::UHUGEINT"


def xxh64(source: str, name: str) -> str:
    """Common table expressions that end in ``name``; the query must be WITH RECURSIVE."""
    lanes = (1, 2, 3, 4)
    begin = ", ".join(f"{_sum('seed', _const(c % _ALL))} AS v{i}" for i, c in zip(lanes, (P1 + P2, P2, 0, _ALL - P1), strict=True))
    fed = ", ".join(f"{_sum(f'v{i}', _times(_word(f'pos + {16 * (i - 1)}', 8), P2))} AS s{i}" for i in lanes)
    turned = ", ".join(f"{_times(_turn(f's{i}', 31), P1)} AS v{i}" for i in lanes)
    own = ", ".join(f"{_times('v' + str(i), P2)} AS w{i}" for i in lanes)
    own_turned = ", ".join(f"{_times(_turn(f'w{i}', 31), P1)} AS r{i}" for i in lanes)
    merged = f"SELECT *, {_sum(_turn('v1', 1), _turn('v2', 7), _turn('v3', 12), _turn('v4', 18))} AS m0, {own_turned} FROM (SELECT *, {own} FROM {name}_stripes WHERE pos + 64 > length(h))"
    for i in lanes:
        merged = f"SELECT *, {_sum(_times(f'xor(m{i - 1}, r{i})', P1), _const(P4))} AS m{i} FROM ({merged})"
    rest = "length(h) - pos"
    return (
        f"{name}_stripes AS (SELECT k, h, CAST(0 AS BIGINT) AS pos, {begin} FROM {source} WHERE length(h) >= 64 "
        f"UNION ALL SELECT k, h, pos + 64, {turned} FROM (SELECT *, {fed} FROM {name}_stripes WHERE pos + 64 <= length(h))), "
        f"{name}_begun AS (SELECT k, h, pos, {_sum('m4', '(length(h) // 2)::UHUGEINT')} AS a FROM ({merged}) "
        f"UNION ALL SELECT k, h, CAST(0 AS BIGINT), {_sum('seed', _const(P5), '(length(h) // 2)::UHUGEINT')} FROM {source} WHERE length(h) < 64), "
        f"{name}_tail AS (SELECT k, h, pos, a FROM {name}_begun "
        f"UNION ALL SELECT k, h, pos + CASE WHEN {rest} >= 16 THEN 16 WHEN {rest} >= 8 THEN 8 ELSE 2 END, "
        f"CASE WHEN {rest} >= 16 THEN {_sum(_times(_turn('b', 27), P1), _const(P4))} WHEN {rest} >= 8 THEN {_sum(_times(_turn('b', 23), P2), _const(P3))} ELSE {_times(_turn('b', 11), P1)} END "
        f"FROM (SELECT *, xor(a, CASE WHEN {rest} >= 16 THEN {_times(_turn('w', 31), P1)} ELSE w END) AS b FROM (SELECT *, "
        f"CASE WHEN {rest} >= 16 THEN {_times(_word('pos', 8), P2)} WHEN {rest} >= 8 THEN {_times(_word('pos', 4), P1)} ELSE {_times(_word('pos', 1), P5)} END AS w FROM {name}_tail WHERE pos < length(h)))), "
        f"{name} AS (SELECT k, CAST(xor(z, z // {_const(1 << 32)}) AS UBIGINT) AS x FROM (SELECT k, {_times(f'xor(y, y // {_const(1 << 29)})', P3)} AS z "
        f"FROM (SELECT k, {_times(f'xor(a, a // {_const(1 << 33)})', P2)} AS y FROM {name}_tail WHERE pos >= length(h))))"
    )
