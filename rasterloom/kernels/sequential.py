"""Linking in ministacks: earlier batches leave one compressed layer each; new epochs fold into a kept state.  Numpy only.

A sealed (full) ministack never changes when epochs follow, so a fold links the open one and new ones
only, and its result equals that of a run over all epochs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .linking import Linking, compress, link_stack


@dataclass(frozen=True)
class Plan:
    """Batches of ``size`` epochs; at most ``cap`` compressed layers are carried; how output and compression are referenced."""

    size: int = 15
    cap: int = 10
    reference: str = "always_first"  # first_per, last_per
    output: int = 0

    def __post_init__(self) -> None:
        if self.size < 2:
            raise ValueError("a ministack holds at least two epochs")
        if self.reference not in ("always_first", "first_per", "last_per"):
            raise ValueError(f"unknown reference plan {self.reference!r}")

    def references(self, carried: int) -> tuple[int, int]:
        """Output and compression reference; -1 stands for the last epoch."""
        if self.reference == "always_first":
            return self.output, self.output
        return (self.output, carried) if self.reference == "first_per" else (carried - 1, -1)

    def batches(self, epochs: int, sealed: int = 0) -> list[tuple[int, int, int]]:
        """``(first epoch, epochs, carried layers)``, after ``sealed`` earlier ministacks."""
        return [(a, min(self.size, epochs - a), min(sealed + k, self.cap)) for k, a in enumerate(range(0, epochs, self.size))]


@dataclass
class State:
    """Products of sealed ministacks by name, and the raw epochs of the open one."""

    sealed: list[dict[str, np.ndarray]] = field(default_factory=list)
    open: np.ndarray | None = None


def link_batch(real: np.ndarray, carried: list[np.ndarray], plan: Plan, how: Linking) -> dict[str, np.ndarray]:
    """One ministack: carried layers first; phases and deviations of real epochs, closures of all."""
    n = len(carried)
    combined = np.concatenate([np.stack(carried), real]) if n else real
    output, compression = plan.references(n)
    found = link_stack(combined, how, n, output % len(combined), max(n - 1, 0))
    out = {"compressed": compress(combined, found["theta"], n, compression % len(combined))}
    for name, layer in found.items():
        out[name] = layer[n:] if name in ("theta", "sigma") else layer
    return out


def run(stack: np.ndarray, plan: Plan, how: Linking, state: State | None = None) -> tuple[list[dict[str, np.ndarray]], State]:
    """Products of every ministack and the state for later epochs; ``stack`` follows those of ``state``."""
    state = state or State()
    if not len(stack):
        raise ValueError("no new epochs")
    if state.open is not None:
        if state.open.shape[1:] != stack.shape[1:]:
            raise ValueError("new epochs have another grid")
        stack = np.concatenate([state.open, stack])
    done = list(state.sealed)
    if done and done[0]["compressed"].shape != stack.shape[1:]:
        raise ValueError("new epochs have another grid")
    sealed, last = len(done), None
    for a, n, carried in plan.batches(len(stack), len(done)):
        layers = [d["compressed"] for d in done[len(done) - carried :]] if carried else []
        done.append(link_batch(stack[a : a + n], layers, plan, how))
        if n == plan.size:
            sealed += 1
        else:
            last = stack[a : a + n]
    return done, State(done[:sealed], last)


def joined(products: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One layer set: epochs and closures one after another, quality as the mean of finite layers, coherence by its counts."""
    out = {name: np.concatenate([p[name] for p in products]) for name in ("theta", "sigma", "closure") if name in products[0]}
    out["temp_coh"] = finite_mean(np.stack([p["temp_coh"] for p in products]))
    out["compressed"] = np.stack([p["compressed"] for p in products])
    if "coherence_sum" in products[0]:
        out["coherence"] = finish_coherence([(p["coherence_sum"], p["coherence_count"]) for p in products])
    return out


def finite_mean(layers: np.ndarray) -> np.ndarray:
    ok = np.isfinite(layers)
    n = ok.sum(axis=0)
    return np.where(n > 0, np.where(ok, layers, 0.0).sum(axis=0) / np.maximum(n, 1), np.nan)


def finish_coherence(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean from partial sums and counts; missing without any."""
    total, count = sum(p[0] for p in parts), sum(p[1] for p in parts)
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)
