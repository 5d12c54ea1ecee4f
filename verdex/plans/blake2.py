"""BLAKE2b with an eight-byte digest as SQL, to hold the hashed ids of the queries against."""

from __future__ import annotations

# Fixed values of BLAKE2b (RFC 7693): initial words and the order of message words by round.
IV = [0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179]
SIGMA = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
    [14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3],
    [11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4],
    [7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8],
    [9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13],
    [2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9],
    [12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11],
    [13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10],
    [6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5],
    [10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0],
]
ROUNDS, MASK = 12, "18446744073709551615::hugeint"


def _turned(value: str, by: int) -> str:
    """Rotated right within 64 bits."""
    return f"((({value}) >> {by}) | ((({value}) << {64 - by}) & {MASK}))"


def hash_ctes(source: str, message: str) -> str:
    """CTEs from ``source`` (id, and ``message``: hex digits of at most 128 bytes) to ``hashed`` (id, key): the unsigned key."""
    words = [f"('0x' || {' || '.join(f'substr(h, {16 * i + 15 - 2 * b}, 2)' for b in range(8))})::ubigint::hugeint m{i}" for i in range(16)]
    state = {i: f"{x}::hugeint" for i, x in enumerate([IV[0] ^ 0x01010008, *IV[1:], *IV])}
    state[12] = f"xor({IV[4]}::hugeint, n::hugeint)"
    state[14] = f"{IV[6] ^ ((1 << 64) - 1)}::hugeint"
    parts = [
        f"b0 as (select id, strlen({message}) // 2 n, rpad({message}, 256, '0') h from {source})",
        f"b1 as (select id, {', '.join(words)}, {', '.join(f'{x} v{i}' for i, x in state.items())} from b0)",
    ]
    every = [f"v{i}" for i in range(16)]

    def step(changed: dict[str, str]) -> None:
        columns = ", ".join(f"{changed[v]} {v}" if v in changed else v for v in every)
        parts.append(f"b{len(parts)} as (select id, {', '.join(f'm{i}' for i in range(16))}, {columns} from b{len(parts) - 1})")

    for r in range(ROUNDS):
        order = SIGMA[r % len(SIGMA)]
        for diagonal in (0, 1):
            lanes = [[f"v{4 * k + (i + diagonal * k) % 4}" for k in range(4)] for i in range(4)]
            for half, (first, second) in enumerate(((32, 24), (16, 63))):
                word = lambda i: f"m{order[8 * diagonal + 2 * i + half]}"
                step({a: f"(({a} + {b} + {word(i)}) & {MASK})" for i, (a, b, _, _) in enumerate(lanes)})
                step({d: _turned(f"xor({d}, {a})", first) for a, _, _, d in lanes})
                step({c: f"(({c} + {d}) & {MASK})" for _, _, c, d in lanes})
                step({b: _turned(f"xor({b}, {c})", second) for _, b, c, _ in lanes})
    last = len(parts) - 1
    # The digest is the first word's bytes; read as a big-endian number its bytes turn round.
    whole = f"xor(xor({IV[0] ^ 0x01010008}::hugeint, v0), v8)"
    turned = " + ".join(f"((({whole}) >> {8 * b}) & 255::hugeint) * {1 << (56 - 8 * b)}::hugeint" for b in range(8))
    parts.append(f"hashed as (select id, {turned} as key from b{last})")
    return ",\n".join(parts)
