"""Settings, checked where they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_BITS = 13
L2, IP = "l2sqr", "ip"


def check_distance(kind: str) -> str:
    if kind not in (L2, IP):
        raise ValueError(f"distance {kind!r}: {L2!r} or {IP!r}")
    return kind


@dataclass(frozen=True)
class CodeConfig:
    """How one segment is coded."""

    rotate: bool = True
    adjust: bool = True
    #: Rounds of code adjustment at most; None for until nothing changes.
    max_rounds: int | None = 6
    epsilon: float = 1e-8
    #: Code at this many bits first and keep the top ones; 0: at the target bits.
    source_bits: int = 0

    def __post_init__(self) -> None:
        if self.source_bits and not 0 < self.source_bits <= MAX_BITS:
            raise ValueError(f"source_bits up to {MAX_BITS}")


@dataclass(frozen=True)
class QuantizeConfig:
    """How vectors are cut into segments and coded."""

    avg_bits: float = 2.0
    segmentation: bool = True
    #: Equal segments of this number instead of planned ones; 0: planned.
    equal_segments: int = 0
    #: Dimensions come in blocks of this many.
    dim_block: int = 64
    distance: str = L2
    one_centroid: bool = False
    seed: int = 42
    code: CodeConfig = field(default_factory=CodeConfig)

    def __post_init__(self) -> None:
        check_distance(self.distance)
        if not 0 <= self.avg_bits <= MAX_BITS:
            raise ValueError(f"avg_bits from 0 to {MAX_BITS}")
        if self.dim_block < 1 or self.equal_segments < 0:
            raise ValueError("dim_block from 1, equal_segments from 0")


@dataclass(frozen=True)
class SearchConfig:
    """How an index is searched."""

    distance: str = L2
    #: Multiplier of the variance-only bound.
    bound_multiplier: float = 4.0
    #: Skip what the bounds rule out; the bounds are heuristic, so this may lose neighbours.
    prune: bool = False
    #: Fixed values of the fast estimate.
    fast_shift: float = 0.58
    fast_scale: float = 0.8

    def __post_init__(self) -> None:
        check_distance(self.distance)


def real_bits(bits: float, dims: int) -> float:
    """Bits a dimension costs when each vector also stores 64 bits of factors."""
    return (bits * dims + 64) / dims
