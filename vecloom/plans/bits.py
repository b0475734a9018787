"""How many bits each segment of dimensions gets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from .config import MAX_BITS, QuantizeConfig


@dataclass(frozen=True)
class Segment:
    offset: int
    length: int
    bits: int


def with_offsets(parts: Sequence[tuple[int, int]]) -> list[Segment]:
    out, at = [], 0
    for length, bits in parts:
        out.append(Segment(at, length, bits))
        at += length
    return out


def equal_plan(dims: int, segments: int, bits: int, block: int) -> list[Segment]:
    """Segments as even as whole blocks allow, all with the same bits."""
    parts, left = [], dims
    for k in range(segments, 0, -1):
        length = min(left, -(-(-(-left // k)) // block) * block)
        if length:
            parts.append((length, bits))
        left -= length
    return with_offsets(parts)


def cost(variance: Sequence[float], plan: Sequence[Segment]) -> float:
    """The expected squared error that a plan leaves, up to a constant."""
    return sum(sum(variance[s.offset : s.offset + s.length]) / 2**s.bits for s in plan)


def planned(variance: Sequence[float], avg_bits: float, block: int, overhead: int = 64) -> list[Segment]:
    """The cheapest plan within ``avg_bits`` a dimension and ``overhead`` bits a coded segment.

    Over prefixes of blocks the planner keeps, for each number of segments and
    bits spent, the least cost; a last segment may have no bits and costs no
    overhead.  A plan replaces a simpler one (fewer segments, then fewer bits
    spent) only if it is more than 1 % cheaper.
    """
    blocks = len(variance) // block
    budget = int(avg_bits * len(variance)) + overhead
    most = max(1, blocks if avg_bits < 2 else blocks // 2)
    sums = [0.0]
    for b in range(blocks):
        sums.append(sums[-1] + float(sum(variance[b * block : (b + 1) * block])))
    # Plans of n segments over the first i blocks: spent bits -> (cost, parts).
    layers: list[dict[int, dict[int, tuple[float, tuple]]]] = [{0: {0: (0.0, ())}}]
    for _ in range(most):
        layer: dict[int, dict[int, tuple[float, tuple]]] = {}
        for i, states in layers[-1].items():
            for j in range(i + 1, blocks + 1):
                mass = sums[j] - sums[i]
                choices = [(b, block * (j - i) * b + overhead) for b in range(1, MAX_BITS + 1)]
                if j == blocks:
                    choices.insert(0, (0, 0))
                slot = layer.setdefault(j, {})
                for used, (c, parts) in states.items():
                    for bits, price in choices:
                        spent = used + price
                        if spent > budget:
                            break
                        value = c + mass / 2**bits
                        if spent not in slot or value < slot[spent][0]:
                            slot[spent] = (value, (*parts, (block * (j - i), bits)))
        layers.append(layer)
    best: tuple[float, tuple] | None = None
    for layer in layers[1:]:
        for _, state in sorted(layer.get(blocks, {}).items()):
            if best is None or state[0] * 1.01 < best[0]:
                best = state
    if best is None:
        raise ValueError("no plan fits the budget")
    return with_offsets(best[1])


def make_plan(variance: Sequence[float], config: QuantizeConfig) -> list[Segment]:
    """The plan that ``config`` asks for; ``variance`` is padded to whole blocks here."""
    dims = -(-len(variance) // config.dim_block) * config.dim_block
    padded = [*map(float, variance), *([0.0] * (dims - len(variance)))]
    if not config.segmentation:
        return equal_plan(dims, 1, int(config.avg_bits), config.dim_block)
    if config.equal_segments:
        return equal_plan(dims, config.equal_segments, int(config.avg_bits), config.dim_block)
    return planned(padded, config.avg_bits, config.dim_block)
