"""Algebra of class distributions held as array<double>, as SQL expressions."""

from __future__ import annotations

from plyframe.functions.rules import let

#: Fixed sizes: move classes (with `empty` last), diagram classes (0-81, x, -, empty).
MOVE_CLASSES, DIAGRAM_CLASSES, EMPTY_MOVE, VALUES, X, DASH = 163, 85, 162, 82, 82, 83


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (s_, x_) -> s_ + x_)"


def softmax(z: str, temperature: str = "1D") -> str:
    return let("top_", f"array_max({z})", let("e_", f"transform({z}, x -> exp((x - top_) / {temperature}))", let("t_", total("e_"), "transform(e_, x -> x / t_)")))


def argmax(p: str) -> str:
    """Index of the largest value, the first of equals."""
    return f"int(array_position({p}, array_max({p})) - 1)"


def masked(p: str, keep: str) -> str:
    """p with 0 where the condition on index i does not hold."""
    return f"transform({p}, (v, i) -> if({keep}, v, 0D))"


def topk(p: str, k: int) -> str:
    """array<struct<np, i>>: the k most likely, ties by index."""
    return f"slice(array_sort(transform({p}, (v, i) -> named_struct('np', -v, 'i', i))), 1, {k})"


def class_filter(p: str, keep: str) -> str:
    """Distribution over the classes kept, null if less than 1e-6 remains."""
    return let("m_", masked(p, keep), let("t_", total("m_"), "if(t_ < 1e-6D, null, transform(m_, v -> v / t_))"))


def diagram_logits(z: str, key: str) -> str:
    return f"transform(sequence(0, {DIAGRAM_CLASSES - 1}), i -> 8D * {z}[i % 64] + double((i * 37 + {key} * 11) % 101) / 50D)"
