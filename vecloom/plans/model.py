"""A fitted quantizer: settings, variances, segments and their rotations."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .bits import Segment, make_plan
from .config import QuantizeConfig


@dataclass
class Model:
    config: QuantizeConfig
    dims: int
    variance: np.ndarray
    segments: list[Segment]
    rotations: list[np.ndarray | None] = field(default_factory=list)

    @classmethod
    def fit(cls, variance: np.ndarray, config: QuantizeConfig, plan: list[Segment] | None = None) -> Model:
        """Plans segments for these variances and draws a rotation for each from the seed."""
        from ..operators.transforms import random_rotation

        segments = plan or make_plan(variance, config)
        padded = np.zeros(segments[-1].offset + segments[-1].length)
        padded[: len(variance)] = variance
        turns = [random_rotation(s.length, config.seed + i) if config.code.rotate else None for i, s in enumerate(segments)]
        return cls(config, len(variance), padded, segments, turns)

    @property
    def padded(self) -> int:
        return len(self.variance)

    @property
    def code_bits(self) -> int:
        return sum(s.length * s.bits for s in self.segments)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """The rotated segments of padded vectors."""
        out = []
        for s, turn in zip(self.segments, self.rotations, strict=True):
            part = x[:, s.offset : s.offset + s.length]
            out.append(part if turn is None else part @ turn)
        return out
