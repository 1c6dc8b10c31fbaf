"""Validated settings with their defaults."""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

EOS = "<eos>"


@dataclass(frozen=True)
class PackConfig:
    context: int = 2048
    batch: int = 8
    eos: str = EOS

    def __post_init__(self) -> None:
        if self.context < 1 or self.batch < 1:
            raise ValueError("context and batch are positive")

    @property
    def width(self) -> int:
        """Tokens in a chunk: the inputs and one more, so that each input has a target."""
        return self.context + 1


@dataclass(frozen=True)
class ModelConfig:
    heads: int = 8
    kv_heads: int = 4
    hidden: int = 256
    intermediate: int = 768
    layers: int = 6
    experts: int = 2
    experts_per_token: int = 1
    head_dim: int = 32
    rope_base: float = 10_000.0
    rope_alpha: float = 1.0
    rope_beta: float = 32.0
    rope_scale: float = 1.0
    initial_context: int = 2048
    vocab: int = 49_152

    def __post_init__(self) -> None:
        if self.heads % self.kv_heads:
            raise ValueError("heads must be a multiple of kv_heads")
        if self.experts_per_token > self.experts:
            raise ValueError("more experts per token than experts")


def environment(env: Mapping[str, str]) -> tuple[int, int]:
    """(local rank, rank) of a process; -1 and 0 where unset."""
    return int(env.get("LOCAL_RANK", -1)), int(env.get("RANK", 0))


def parse_args(argv: Sequence[str]) -> argparse.Namespace:
    """``local_rank`` and ``batch_size``; a launcher's own arguments are left alone."""
    p = argparse.ArgumentParser()
    p.add_argument("--local_rank", type=int, default=-1)
    p.add_argument("--batch_size", type=int, default=PackConfig.batch)
    return p.parse_known_args(list(argv))[0]
