"""Decoding: from class distributions of cells to the most likely legal game."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyframe.functions import prob, rules
from plyframe.functions.rules import let

#: Fixed values of the scoring.
SCORE_FLOOR, POOL_BYTES, BYTES_EACH = "1e-12D", 2 << 30, 25_000


def stop_reason(n_plies: Column, over: Column, illegal_at: Column, empty_at: Column) -> Column:
    """illegal_at and empty_at: the ply of the first such cell, or null."""
    return (
        F.when(empty_at <= n_plies, "empty cell")
        .when(illegal_at <= n_plies, "illegal move")
        .when(over, "game over")
        .otherwise("sheet exhausted")
    )


def result_consistency(g: str, stated: str) -> str:
    """0, 1 or 2: a stated result (0, 1, -1 or null) against a position."""
    leader = f"if({g}.kazans[0] > {g}.kazans[1], 0, if({g}.kazans[0] < {g}.kazans[1], 1, -1))"
    over = rules.is_over(g)
    return f"case when {stated} is null then if({over}, 1, 0) when {over} and {rules.winner(g)} = {stated} then 2 when {leader} = {stated} then 1 else 0 end"


def beam_cap(width: Column, per_ply: Column) -> Column:
    """Hypotheses that fit in the pool's memory, at least one."""
    most = F.floor(F.lit(POOL_BYTES) / (F.lit(BYTES_EACH) * F.greatest(per_ply, F.lit(1))))
    return F.greatest(F.lit(1), F.least(width, most)).cast("long")


def class_index(notation: str) -> str:
    """Index of a move's class: two per (source, column), the second with x."""
    return f"(2 * (9 * (int(substring({notation}, 1, 1)) - 1) + int(substring({notation}, 2, 1)) - 1) + if(endswith({notation}, 'x'), 1, 0))"


def marginals(p: str) -> str:
    """struct<src: array(9), land: array(9), x> of a distribution over move classes;
    the class `empty` (162) belongs to none."""
    src = f"transform(sequence(0, 8), s -> aggregate(slice({p}, 18 * s + 1, 18), 0D, (t, v) -> t + v))"
    land = f"transform(sequence(0, 8), e -> aggregate(sequence(0, 8), 0D, (t, s) -> t + {p}[18 * s + 2 * e] + {p}[18 * s + 2 * e + 1]))"
    x = f"aggregate(sequence(0, 80), 0D, (t, i) -> t + {p}[2 * i + 1])"
    return f"named_struct('src', {src}, 'land', {land}, 'x', {x})"


def legal_score(p: str, marg: str, note: str, action: str) -> str:
    """The exact class and the marginals, halves each, times the weight of the
    tuzdyk mark.  Unnormalised, as the beam needs it."""
    both = f"{marg}.src[{action}] * {marg}.land[int(substring({note}, 2, 1)) - 1] * 9"
    return f"((0.5D * {p}[{class_index(note)}] + 0.5D * {both}) * if(endswith({note}, 'x'), {marg}.x, 1 - {marg}.x))"


def scored_moves(g: str, p: str, marg: str) -> str:
    """Legal moves of a state as array<struct<neg, action, notation>>, best first (neg is
    the negated score), then in order of action.  No move is played for that."""
    one = let("note_", rules.notation(g, "a"), f"named_struct('neg', -{legal_score(p, marg, 'note_', 'a')}, 'action', a, 'notation', note_)")
    return f"array_sort(transform({rules.legal(g)}, a -> {one}))"


#: Fixed values of the evidence: weights and floors of kazans and pits, classes of the
#: tuzdyk and the dash, the largest count that a class says.
KAZAN_WEIGHT, KAZAN_FLOOR, PIT_WEIGHT, PIT_FLOOR, X, DASH, MOST = "1D", "1e-4D", "0.5D", "1e-3D", 82, 83, 81


def evidence(g: str, check: str) -> str:
    """D3: log-likelihood of a diagram given a board.  check: 20 distributions over the
    diagram classes, pits 0-17 and both kazans, null where nothing was read."""
    chance = (
        f"if(k >= 18, if({g}.kazans[k - 18] > {MOST}, 0D, d[{g}.kazans[k - 18]]), "
        f"if({g}.tuz[1 - k div 9] = k % 9, d[{X}], if({g}.pits[k] = 0, d[{DASH}] + d[0], if({g}.pits[k] > {MOST}, 0D, d[{g}.pits[k]]))))"
    )
    term = let("c_", chance, f"if(k >= 18, {KAZAN_WEIGHT} * ln(greatest(c_, {KAZAN_FLOOR})), {PIT_WEIGHT} * ln(greatest(c_, {PIT_FLOOR})))")
    return f"aggregate(transform({check}, (d, k) -> if(d is null, 0D, {term})), 0D, (s_, t_) -> s_ + t_)"


CHECK = "array<array<double>>"


def diagram_filter(k: str, p: str) -> str:
    """what a diagram cell can say: 10-81 in a kazan (18, 19), anything but
    `empty` in a pit; null where nothing is left."""
    return f"if({k} >= 18, {prob.class_filter(p, f'i between 10 and {MOST}')}, {prob.class_filter(p, f'i <= {DASH}')})"


def beam_step(beam: str, q: str, width: str, per_ply: int) -> str:
    """One level of the beam: every live hypothesis by its best moves, the `width`
    best stay; finished ones are never pruned.  Ties: parent first, then child.

    beam: struct<active, finished, open>; q: struct<p, marg, check>, check null but
    where a diagram shows the board after this ply.
    """
    logp = f"h.logp + ln(greatest(-c.neg, {SCORE_FLOOR})) + if({q}.check is null, 0D, {evidence('mv.state', f'{q}.check')})"
    child = let(
        "mv",
        rules.play("h.state", "c.action"),
        f"named_struct('state', mv.state, 'moves', concat(h.moves, array({rules.annotated('mv')})), 'shares', concat(h.shares, array(-c.neg / if(all_ = 0, 1D, all_))), 'logp', {logp}, 'over', {rules.is_over('mv.state')})",
    )
    scored = scored_moves("h.state", f"{q}.p", f"{q}.marg")
    kids_of = let("ranked_", scored, let("all_", "aggregate(ranked_, 0D, (s_, x_) -> s_ - x_.neg)", f"transform(slice(ranked_, 1, {per_ply}), c -> {child})"))
    best = f"transform(slice(array_sort(transform(live_, (k, i) -> named_struct('neg', -k.logp, 'rank', i))), 1, {width}), x -> live_[x.rank])"
    done = f"concat({beam}.finished, filter(kids, k -> k.over))"
    body = f"if(size(live_) = 0, named_struct('active', {beam}.active, 'finished', {done}, 'open', false), named_struct('active', {best}, 'finished', {done}, 'open', true))"
    body = let("live_", "filter(kids, k -> not k.over)", body)
    return f"if({beam}.open, {let('kids', f'flatten(transform({beam}.active, h -> {kids_of}))', body)}, {beam})"


HYPOTHESIS = "struct<state:struct<pits:array<int>,kazans:array<int>,tuz:array<int>,turn:int>,moves:array<string>,shares:array<double>,logp:double,over:boolean>"


def beam(dists: str, width: int | str, per_ply: int = 9) -> str:
    """Decode array<struct<p, marg, check>> (one per ply): struct<active, finished, open>.
    The width is cut to what the pool's memory takes (D6)."""
    cap = f"greatest(1L, least(bigint({width}), bigint({POOL_BYTES} div ({BYTES_EACH} * {max(per_ply, 1)}))))"
    first = f"named_struct('state', {rules.START}, 'moves', cast(array() as array<string>), 'shares', cast(array() as array<double>), 'logp', 0D, 'over', false)"
    start = f"named_struct('active', array({first}), 'finished', cast(array() as array<{HYPOTHESIS}>), 'open', true)"
    return let("cap_", f"int({cap})", f"aggregate({dists}, {start}, (b, q) -> {beam_step('b', 'q', 'cap_', per_ply)})")


def beam_final(beam: str, stated: str) -> str:
    """Longest first, then agreement with the stated result, then likelihood;
    live hypotheses come before finished ones.  struct<moves, shares, logp, state>."""
    keyed = f"transform(concat({beam}.active, {beam}.finished), (h, i) -> named_struct('len', size(h.moves), 'fits', {result_consistency('h.state', stated)}, 'logp', h.logp, 'rank', -i, 'h', h))"
    return f"array_max(transform({keyed}, k -> named_struct('len', k.len, 'fits', k.fits, 'logp', k.logp, 'rank', k.rank, 'h', named_struct('moves', k.h.moves, 'shares', k.h.shares, 'logp', k.h.logp, 'state', k.h.state)))).h"
