"""The rules and the decoding for many boards at a time, in numpy.

The same rules as `functions.rules` and the same scores, evidence and order as `decode`,
in the same order of additions; a ply is a step over all boards of a batch.  Games are
given as plies one after another, game g's between offsets[g] and offsets[g + 1].
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plyframe.functions.rules import SIDE, STONES, WINNING

from . import decode

#: The floors and weights of `decode`, as numbers.
_number = lambda text: float(text.rstrip("D"))
SCORE_FLOOR, KAZAN_FLOOR, PIT_FLOOR, KAZAN_WEIGHT, PIT_WEIGHT = map(_number, (decode.SCORE_FLOOR, decode.KAZAN_FLOOR, decode.PIT_FLOOR, decode.KAZAN_WEIGHT, decode.PIT_WEIGHT))
X, DASH, MOST, CLASSES = decode.X, decode.DASH, decode.MOST, 163
#: Hypotheses that are in work at a time, and boards that are made of their children at a
#: time where evidence asks for all.
POOL, MADE = 1 << 15, 1 << 14
#: Widths from which a game's best children are parted from the others before they are sorted.
WIDE = 64


@dataclass
class Boards:
    pits: np.ndarray  # [n, 18]
    kazans: np.ndarray  # [n, 2]
    tuz: np.ndarray  # [n, 2]
    turn: np.ndarray  # [n]

    def take(self, i: np.ndarray) -> Boards:
        return Boards(self.pits[i], self.kazans[i], self.tuz[i], self.turn[i])

    def put(self, i: np.ndarray, other: Boards) -> None:
        self.pits[i], self.kazans[i], self.tuz[i], self.turn[i] = other.pits, other.kazans, other.tuz, other.turn


def starts(n: int) -> Boards:
    return Boards(np.full((n, 2 * SIDE), STONES, np.int16), np.zeros((n, 2), np.int16), np.full((n, 2), -1, np.int16), np.zeros(n, np.int16))


def legal(b: Boards) -> np.ndarray:
    """[n, 9]: whether the side to move may play from each of its holes."""
    at = np.arange(len(b.turn))
    return (b.pits.reshape(-1, 2, SIDE)[at, b.turn] > 0) & (np.arange(SIDE) != b.tuz[at, 1 - b.turn][:, None])


def _landing(b: Boards, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = b.pits[np.arange(len(start)), start]
    last = start + np.maximum(n - 1, 1)
    return n, last - last // (2 * SIDE) * (2 * SIDE)


def _wins(b: Boards, last: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of moves [n] or [n, k] of each board, by the hole that they end in."""
    at = np.arange(len(last))
    mine, other, turn = (v if last.ndim == 1 else v[:, None] for v in (b.tuz[at, b.turn], b.tuz[at, 1 - b.turn], b.turn))
    row = (last >= SIDE).astype(np.int16)
    col = last - SIDE * row
    return (row == 1 - turn) & (count == 3) & (mine == -1) & (col != SIDE - 1) & (col != other)


def outcomes(b: Boards, act: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of moves [n, k] of each board, without playing them: their classes, and whether they
    may end the game (where not, they do not)."""
    at, act = np.arange(len(b.turn)), act.astype(np.int16)
    turn = b.turn[:, None]
    start = turn * SIDE + act
    n = np.take_along_axis(b.pits, start.astype(np.intp), axis=1)
    far = np.maximum(n - 1, 1)
    rounds = far // (2 * SIDE)
    past = far - 2 * SIDE * rounds
    last = start + past
    last -= 2 * SIDE * (last >= 2 * SIDE).astype(np.int16)
    before = np.take_along_axis(b.pits, last.astype(np.intp), axis=1)
    owned = (last == np.where(b.tuz[:, :1] < 0, -1, SIDE + b.tuz[:, :1])) | (last == b.tuz[:, 1:])
    held = np.where(owned, 0, np.where(past == 0, 0, before) + rounds + 1)
    makes = _wins(b, last, held)
    row = (last >= SIDE).astype(np.int16)
    gain = np.where(makes, 3, np.where((row == 1 - turn) & (held & 1 == 0), held, 0))
    # A tuzdyk's hole is empty before a move, which brings a stone a round at most.
    most = np.maximum(b.kazans[at, b.turn][:, None] + gain, b.kazans[at, 1 - b.turn][:, None]) + rounds + 1
    # A move empties one of the other side's holes at most.
    left = ((b.pits.reshape(-1, 2, SIDE)[at, 1 - b.turn] > 0) & (np.arange(SIDE) != b.tuz[at, b.turn][:, None])).sum(axis=1)
    return 2 * (SIDE * act + last - SIDE * row) + makes, (most >= WINNING) | (left < 2)[:, None]


def move_class(b: Boards, act: np.ndarray) -> np.ndarray:
    """The class of each move as it is written, without playing it."""
    return outcomes(b, act[:, None])[0][:, 0].astype(int)


def play(b: Boards, act: np.ndarray) -> tuple[Boards, np.ndarray]:
    """The boards after the moves, and whether each captured."""
    at, holes = np.arange(len(act)), np.arange(2 * SIDE, dtype=np.int16)
    start = (b.turn * SIDE + act).astype(np.int16)
    n, last = _landing(b, start)
    sown = b.pits.copy()
    sown[at, start] = 0
    away = holes - start[:, None]
    away += 2 * SIDE * (away < 0).astype(np.int16)
    sown += (n[:, None] + (2 * SIDE - 1) - away) // (2 * SIDE)
    one = np.flatnonzero(n == 1)  # a single stone goes on, others leave one behind
    sown[one, start[one]] = 0
    sown[one, last[one]] += 1
    kazans, tuz = b.kazans.copy(), b.tuz.copy()
    held = sown
    for s in (0, 1):
        own = np.flatnonzero(b.tuz[:, s] >= 0)
        hole = SIDE * (1 - s) + b.tuz[own, s]
        kazans[own, s] += sown[own, hole]
    for s in (0, 1):
        own = np.flatnonzero(b.tuz[:, s] >= 0)
        held[own, SIDE * (1 - s) + b.tuz[own, s]] = 0
    count = held[at, last]
    makes = _wins(b, last, count)
    gain = np.where(makes, 3, np.where((last // SIDE == 1 - b.turn) & (count % 2 == 0), count, 0)).astype(np.int16)
    taken = np.flatnonzero(gain > 0)
    held[taken, last[taken]] = 0
    kazans[at, b.turn] += gain
    made = np.flatnonzero(makes)
    tuz[made, b.turn[made]] = last[made] % SIDE
    return Boards(held, kazans, tuz, (1 - b.turn).astype(np.int16)), (gain > 0) & ~makes


def is_over(b: Boards) -> np.ndarray:
    return (b.kazans.max(axis=1, initial=0) >= WINNING) | ~legal(b).any(axis=1)


def _side(kazans: np.ndarray) -> np.ndarray:
    return np.where(kazans[:, 0] > kazans[:, 1], 0, np.where(kazans[:, 0] < kazans[:, 1], 1, -1))


def winner(b: Boards) -> np.ndarray:
    """0, 1 or -1 for a draw; a stuck side's opponent adds its own stones."""
    stuck = (b.kazans.max(axis=1, initial=0) < WINNING) & ~legal(b).any(axis=1)
    own = b.pits.reshape(-1, 2, SIDE).sum(axis=2)
    return _side(b.kazans + own * (stuck[:, None] & (b.turn[:, None] == 1 - np.arange(2))))


def consistency(b: Boards, stated: np.ndarray) -> np.ndarray:
    """decode.result_consistency; stated is 0, 1, -1 or another number for null."""
    over = is_over(b)
    known = np.where(over & (winner(b) == stated), 2, (_side(b.kazans) == stated).astype(int))
    return np.where(np.isin(stated, (0, 1, -1)), known, over.astype(int))


def added(columns) -> np.ndarray:
    """Sum of arrays one after another, as a fold adds them."""
    total = 0.0
    for c in columns:
        total = total + c
    return total


def marginals(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """decode.marginals of each row: src [n, 9], land [n, 9], x [n]."""
    cells = p[:, : CLASSES - 1].reshape(-1, SIDE, SIDE, 2)
    src = added(cells[:, :, e, x] for e in range(SIDE) for x in (0, 1))
    land = added(cells[:, s, :, x] for s in range(SIDE) for x in (0, 1))
    return src, land, added(p[:, i] for i in range(1, CLASSES - 1, 2))


def terms(d: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """What the 20 cells of diagrams, d [n, 20, 85] with those that were seen, add to the
    evidence [n, 20, 84]: by stones there, then for more than a class says, for a tuzdyk."""
    c = np.concatenate([d[:, :, : MOST + 1], np.zeros((*d.shape[:2], 1)), d[:, :, X : X + 1]], axis=2)
    c[:, : 2 * SIDE, 0] = d[:, : 2 * SIDE, DASH] + d[:, : 2 * SIDE, 0]
    pits, kazans = PIT_WEIGHT * np.log(np.maximum(c[:, : 2 * SIDE], PIT_FLOOR)), KAZAN_WEIGHT * np.log(np.maximum(c[:, 2 * SIDE :], KAZAN_FLOOR))
    return np.where(seen[:, :, None], np.concatenate([pits, kazans], axis=1), 0.0)


def evidence(b: Boards, said: np.ndarray, row: np.ndarray) -> np.ndarray:
    """decode.evidence of each board by its row of `terms`, which no board has a copy of."""
    total = np.zeros(len(row))
    for k in range(20):
        stones = b.kazans[:, k - 2 * SIDE] if k >= 2 * SIDE else b.pits[:, k]
        i = np.minimum(stones, MOST + 1)
        if k < 2 * SIDE:
            i = np.where(b.tuz[:, 1 - k // SIDE] == k % SIDE, MOST + 2, i)
        total += said[row, k, i]
    return total


@dataclass
class Replays:
    """What the strict replay says of each ply (p) and game (g)."""

    n_legal: np.ndarray  # g: plies before the replay ends
    illegal: np.ndarray  # g: whether an illegal ply ended it
    won: np.ndarray  # g: 0, 1, 2 (draw) where the game's end did, else -1
    stop: np.ndarray  # g: the ply that ended it, or -1
    in_sync: np.ndarray  # p
    captured: np.ndarray  # p
    can: np.ndarray  # p: [9] classes of the legal moves, -1 for none


def replays(raw: np.ndarray, offsets: np.ndarray) -> Replays:
    """sheets.strict_replay of the raw reads (classes)."""
    games, plies = len(offsets) - 1, len(raw)
    out = Replays(np.zeros(games, int), np.zeros(games, bool), np.full(games, -1), np.full(games, -1), np.zeros(plies, bool), np.zeros(plies, bool), np.full((plies, SIDE), -1))
    live, b, t = np.arange(games), starts(games), 0
    while True:
        more = offsets[live] + t < offsets[live + 1]
        live, b = live[more], b.take(np.flatnonzero(more))
        if not len(live):
            return out
        at = offsets[live] + t
        who, act = np.nonzero(legal(b))
        cls = np.full((len(live), SIDE), -1)
        cls[who, act] = move_class(b.take(who), act)
        out.in_sync[at], out.can[at] = True, cls
        ok = (cls == raw[at][:, None]).any(axis=1)
        out.illegal[live[~ok]], out.stop[live[~ok]] = True, t
        live, at, b = live[ok], at[ok], b.take(np.flatnonzero(ok))
        b, out.captured[at] = play(b, raw[at] // (2 * SIDE))
        out.n_legal[live] += 1
        over = is_over(b)
        ended = live[over]
        out.won[ended], out.stop[ended] = winner(b.take(np.flatnonzero(over))) % 3, t
        live, b, t = live[~over], b.take(np.flatnonzero(~over)), t + 1


@dataclass
class Beams:
    """The chosen hypothesis of each game: its moves lie from offsets[g] on."""

    offsets: np.ndarray
    move: np.ndarray
    captured: np.ndarray
    share: np.ndarray
    logp: np.ndarray
    state: Boards


def _firsts(sorted_games: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_games[1:] != sorted_games[:-1]])) if len(sorted_games) else np.zeros(0, int)


def beams(p: np.ndarray, offsets: np.ndarray, width: np.ndarray, per_ply: int, stated: np.ndarray, checks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> Beams:
    """decode.beam and decode.beam_final of each game, as many games at a time as the
    pool takes.  checks: by ply (from 1) the games with a diagram after it, d and seen."""
    parts, first, taken = [], 0, 0
    for g in range(len(width)):
        if taken and taken + width[g] > POOL:
            parts.append(range(first, g))
            first, taken = g, 0
        taken += width[g]
    if first < len(width):
        parts.append(range(first, len(width)))
    done = [_beams(p, offsets[r.start : r.stop + 1], width[r.start : r.stop], per_ply, stated[r.start : r.stop], _own(checks or {}, r)) for r in parts]
    sizes = np.concatenate([np.diff(x.offsets) for x in done]) if done else np.zeros(0, int)
    joined = lambda name: np.concatenate([getattr(x, name) for x in done]) if done else np.zeros(0)
    state = Boards(*[np.concatenate([getattr(x.state, n) for x in done]) for n in ("pits", "kazans", "tuz", "turn")]) if done else starts(0)
    return Beams(np.concatenate([[0], np.cumsum(sizes)]).astype(int), joined("move"), joined("captured"), joined("share"), joined("logp"), state)


def _own(checks: dict, r: range) -> dict:
    found = {}
    for ply, (games, d, seen) in checks.items():
        mine = np.flatnonzero((games >= r.start) & (games < r.stop))
        if len(mine):
            found[ply] = (games[mine] - r.start, d[mine], seen[mine])
    return found


def _scores(p: np.ndarray, marg: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """decode.legal_score of all moves by their classes."""
    src, land, x = marg
    cls = np.arange(CLASSES - 1)
    return (0.5 * p[:, : CLASSES - 1] + 0.5 * src[:, cls // (2 * SIDE)] * land[:, cls // 2 % SIDE] * 9) * np.where(cls % 2 == 1, x[:, None], 1 - x[:, None])


def _kept(game: np.ndarray, live: np.ndarray, logp: np.ndarray, score: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Of live children ([n, 9], n in order of games; parents in order in their game) each
    game's best as indices, in order: by likelihood, parent, score and hole."""
    first = _firsts(game)
    end = np.concatenate([first[1:], [len(game)]]).astype(int)
    mine = np.add.reduceat(live.sum(axis=1), first) if len(first) else np.zeros(0, int)
    wanted = live.copy()
    for f, e, w in zip(*(v[(mine > width[game[first]]) & (width[game[first]] >= WIDE)] for v in (first, end, width[game[first]])), strict=True):
        own = np.where(live[f:e], logp[f:e], -np.inf)
        wanted[f:e] &= own >= np.partition(own, own.size - w, axis=None)[own.size - w]
    i = np.flatnonzero(wanted)
    h = i // SIDE
    i = i[np.lexsort((-score.ravel()[i], h, -logp.ravel()[i], game[h]))]
    of = game[i // SIDE]
    first = _firsts(of)
    return i[np.arange(len(i)) - np.repeat(first, np.diff(np.concatenate([first, [len(i)]]))) < width[of]]


def _beams(p: np.ndarray, offsets: np.ndarray, width: np.ndarray, per_ply: int, stated: np.ndarray, checks: dict) -> Beams:
    """A level scores the children of all hypotheses by tables of their games' plies, and
    plays the ones that stay; of others only those that may end a game or meet a diagram."""
    n_games, holes = len(width), np.arange(SIDE)[None, :]
    marg = marginals(p[offsets[0] : offsets[-1]]) if offsets[-1] > offsets[0] else (np.zeros((0, SIDE)), np.zeros((0, SIDE)), np.zeros(0))
    game, b, logp = np.arange(n_games), starts(n_games), np.zeros(n_games)
    history = []  # per level, of what stayed: parent, move
    # The pick so far: its number of plies, parent and last move (of a finished one) or place.
    size, place, last = np.zeros(n_games, int), np.zeros(n_games, int), np.full(n_games, -1)
    best, fits = np.zeros(n_games), np.full(n_games, -1)

    def at_ply(games: np.ndarray, t: int) -> np.ndarray:
        rel = offsets[games] + t - offsets[0]
        return _scores(p[offsets[games] + t], tuple(m[rel] for m in marg))

    def settle(rows: np.ndarray, t: int) -> None:
        """The best of the live hypotheses `rows` (in order) against the finished pick."""
        fit = consistency(b.take(rows), stated[game[rows]])
        order = np.lexsort((np.arange(len(rows)), -logp[rows], -fit, game[rows]))
        order = order[_firsts(game[rows][order])]
        g, i, fit = game[rows][order], rows[order], fit[order]
        better = (t > size[g]) | ((t == size[g]) & ((fit > fits[g]) | ((fit == fits[g]) & (logp[i] >= best[g]))))
        g, i = g[better], i[better]
        size[g], place[g], last[g], best[g] = t, i, -1, logp[i]

    t = 0
    while len(game):
        more = offsets[game] + t < offsets[game + 1]
        settle(np.flatnonzero(~more), t)
        can = legal(b) & more[:, None]
        cls, ending = outcomes(b, np.broadcast_to(holes, can.shape))
        # Scores by class of the games that have the ply.
        row, going = np.zeros(n_games, int), np.unique(game[more])
        row[going] = np.arange(len(going))
        table = at_ply(going, t)
        logs = np.log(np.maximum(table, SCORE_FLOOR))
        told = np.where(can, row[game][:, None] * (CLASSES - 1) + cls, 0)
        score = table.ravel()[told] if table.size else np.zeros(can.shape)
        kid_logp = logp[:, None] + (logs.ravel()[told] if logs.size else 0.0)
        if per_ply < SIDE:
            among = np.argsort(np.where(can, -score, np.inf), axis=1, kind="stable")[:, :per_ply]
            first = np.zeros(can.shape, bool)
            np.put_along_axis(first, among, True, axis=1)
            can &= first
        if t + 1 in checks:
            games, d, seen = checks[t + 1]
            said, row = terms(d, seen), np.full(n_games, -1)
            row[games] = np.arange(len(games))
            h, act = np.nonzero(can & (row[game] >= 0)[:, None])
            for i in range(0, len(h), MADE):
                k, a = h[i : i + MADE], act[i : i + MADE]
                kid_logp[k, a] += evidence(play(b.take(k), a)[0], said, row[game[k]])
        live = can
        h, act = np.nonzero(can & ending)
        if len(h):
            kids = play(b.take(h), act)[0]
            done = np.flatnonzero(is_over(kids))
            h, act, kids = h[done], act[done], kids.take(done)
            live[h, act] = False
            of, likely = game[h], kid_logp[h, act]
            fit = consistency(kids, stated[of])
            by = np.lexsort((-score[h, act], h, -likely, -fit, of))
            by = by[_firsts(of[by])]
            g = of[by]
            size[g], place[g], best[g], fits[g], last[g] = t + 1, h[by], likely[by], fit[by], cls[h[by], act[by]]
        # Where no child is live, the parents stay as the last ones.
        alive = np.zeros(n_games, bool)
        alive[game[live.any(axis=1)]] = True
        settle(np.flatnonzero(more & ~alive[game]), t)
        kept = _kept(game, live, kid_logp, score, width)
        h, act = kept // SIDE, kept % SIDE
        history.append((h.astype(np.int32), cls[h, act].astype(np.int16)))
        game, b, logp, t = game[h], play(b.take(h), act)[0], kid_logp[h, act], t + 1
    into = np.concatenate([[0], np.cumsum(size)]).astype(int)
    move, took, part = np.zeros(into[-1], int), np.zeros(into[-1], bool), np.zeros(into[-1])
    ended = np.flatnonzero(last >= 0)
    move[into[ended + 1] - 1] = last[ended]
    # A finished pick's place is its parent's, one level up.
    reach = size - (last >= 0)
    for level in range(int(reach.max(initial=0)) - 1, -1, -1):
        g = np.flatnonzero(reach > level)
        parent, cls = history[level]
        i = place[g]
        move[into[g] + level], place[g] = cls[i], parent[i]
    # The picks are played once more, for their shares, captures and boards.
    state = starts(n_games)
    for t in range(int(size.max(initial=0))):
        g = np.flatnonzero(size > t)
        b, to = state.take(g), into[g] + t
        can = legal(b)
        score = np.where(can, np.take_along_axis(at_ply(g, t), np.where(can, outcomes(b, np.broadcast_to(holes, can.shape))[0], 0).astype(np.intp), axis=1), 0.0)
        all_ = added(-np.sort(-score, axis=1).T)
        act = move[to] // (2 * SIDE)
        part[to] = score[np.arange(len(g)), act] / np.where(all_ == 0, 1.0, all_)
        b, took[to] = play(b, act)
        state.put(g, b)
    return Beams(into, move, took, part, best, state)
