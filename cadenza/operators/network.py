"""Sizes of the acoustic network: what a checkpoint must hold. The network itself is no Spark work and is not here."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod


@dataclass(frozen=True)
class Shape:
    """Sizes of the network."""

    input_dim: int = 39
    classes: int = 42
    heads: int = 8
    squeeze: int = 8
    channels: tuple[int, ...] = (64, 128, 256, 512)
    kernel: int = 3

    def __post_init__(self) -> None:
        if self.heads < 1 or self.channels[-1] % self.heads:
            raise ValueError(f"{self.heads} heads do not divide {self.channels[-1]} channels")

    def layers(self) -> dict[str, tuple[int, ...]]:
        """Name and dimensions of every weight."""
        out: dict[str, tuple[int, ...]] = {}
        a = self.input_dim
        for i, b in enumerate(self.channels):
            m = max(b // self.squeeze, 1)
            out |= {f"conv{i}.w": (b, a, self.kernel), f"conv{i}.b": (b,), f"norm{i}.g": (b,), f"norm{i}.b": (b,), f"down{i}.w": (b, m), f"down{i}.b": (m,), f"up{i}.w": (m, b), f"up{i}.b": (b,)}
            a = b
        out |= {"norm.g": (a,), "norm.b": (a,)}
        for k in "qkvo":
            out |= {f"{k}.w": (a, a), f"{k}.b": (a,)}
        for head, n in (("phoneme", self.classes), ("ctc", self.classes), ("boundary", 1)):
            out |= {f"{head}.w": (a, n), f"{head}.b": (n,)}
        return out

    def size(self) -> int:
        return sum(prod(d) for d in self.layers().values())
