"""The sowing game as SQL expressions over a struct.

A state is struct<pits: array<int>(18), kazans: array<int>(2), tuz: array<int>(2),
turn: int>: pits 0-8 are the first player's, 9-17 the second's; tuz[s] is the
column that player s owns on the other side, or -1.  Every function takes and
returns SQL text, so that a whole game is one fold without a shuffle or UDF.
"""

from __future__ import annotations

#: The fixed values of the game.
PITS, SIDE, STONES, WINNING = 18, 9, 9, 82

START = f"named_struct('pits', array_repeat({STONES}, {PITS}), 'kazans', array(0, 0), 'tuz', array(-1, -1), 'turn', 0)"


def let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sown_at(pits: str, start: str, i: str, v: str) -> str:
    """Stones in pit i (v before) after sowing the n stones of start (closed form): a
    single one moves on; of more, one stays and the rest go round, start included."""
    return (
        f"int(if(n = 1, if({i} = {start}, 0, if({i} = pmod({start} + 1, {PITS}), {v} + 1, {v})), "
        f"if({i} = {start}, 0, {v}) + (n + {PITS - 1} - pmod({i} - {start}, {PITS})) div {PITS}))"
    )


def sow(pits: str, start: str) -> str:
    """All pits after sowing from start."""
    return let("n", f"{pits}[{start}]", f"transform({pits}, (v, i) -> {sown_at(pits, start, 'i', 'v')})")


def landing(pits: str, start: str) -> str:
    return f"pmod({start} + greatest(1, {pits}[{start}] - 1), {PITS})"


def legal(g: str) -> str:
    """Actions 0-8 of the side to move: a pit with stones that the other side does
    not own."""
    return f"filter(sequence(0, {SIDE - 1}), a -> {g}.pits[{g}.turn * {SIDE} + a] > 0 and {g}.tuz[1 - {g}.turn] <> a)"


def _makes(g: str, last: str, count: str) -> str:
    """Whether a last stone that makes `count` in pit `last` wins a tuzdyk there."""
    col = f"{last} % {SIDE}"
    return f"({last} div {SIDE} = 1 - {g}.turn and {count} = 3 and {g}.tuz[{g}.turn] = -1 and {col} <> {SIDE - 1} and {col} <> {g}.tuz[1 - {g}.turn])"


def _owned(g: str, i: str) -> str:
    """Whether pit i is somebody's tuzdyk."""
    return f"(({g}.tuz[0] >= 0 and {i} = {SIDE} + {g}.tuz[0]) or ({g}.tuz[1] >= 0 and {i} = {g}.tuz[1]))"


def notation(g: str, action: str) -> str:
    """A move as it is written, from where its last stone lands, without playing it."""
    count = f"if({_owned('g0', 'last')}, 0, {sown_at('g0.pits', 'start', 'last', 'g0.pits[last]')})"
    body = f"concat(act + 1, last % {SIDE} + 1, if({_makes('g0', 'last', 'count')}, 'x', ''))"
    body = let("n", "g0.pits[start]", let("count", count, body))
    body = let("last", landing("g0.pits", "start"), body)
    return let("g0", g, let("act", action, let("start", f"g0.turn * {SIDE} + act", body)))


def notations(g: str) -> str:
    """The legal moves of a state as they are written, in order of action."""
    return f"transform({legal(g)}, a -> {notation(g, 'a')})"


def play(g: str, action: str) -> str:
    """struct<state, action, notation, captured, makes_tuzdyk, sown> after a move."""
    income = lambda s: f"if(g0.tuz[{s}] < 0, 0, sown[{SIDE} * (1 - {s}) + g0.tuz[{s}]])"
    emptied = f"if(g0.tuz[0] < 0 and g0.tuz[1] < 0, sown, transform(sown, (v, i) -> if({_owned('g0', 'i')}, 0, v)))"
    state = (
        f"named_struct('pits', if(gain > 0, transform(held, (v, i) -> if(i = last, 0, v)), held), "
        f"'kazans', array(int(g0.kazans[0] + {income(0)} + if(g0.turn = 0, gain, 0)), int(g0.kazans[1] + {income(1)} + if(g0.turn = 1, gain, 0))), "
        f"'tuz', if(makes, array(if(g0.turn = 0, int(last % {SIDE}), g0.tuz[0]), if(g0.turn = 1, int(last % {SIDE}), g0.tuz[1])), g0.tuz), 'turn', 1 - g0.turn)"
    )
    result = (
        f"named_struct('state', {state}, 'action', int(act), 'notation', concat(act + 1, last % {SIDE} + 1, if(makes, 'x', '')), "
        "'captured', int(if(makes, 0, gain)), 'makes_tuzdyk', makes, 'sown', sown)"
    )
    body = let("gain", f"if(makes, 3, if(last div {SIDE} = 1 - g0.turn and held[last] % 2 = 0, held[last], 0))", result)
    body = let("makes", _makes("g0", "last", "held[last]"), body)
    body = let("held", emptied, body)
    body = let("sown", sow("g0.pits", "start"), body)
    body = let("last", landing("g0.pits", "start"), body)
    return let("g0", g, let("act", action, let("start", f"g0.turn * {SIDE} + act", body)))


def outcome(g: str, action: str) -> str:
    """struct<notation, captured, over> of a move, without the board that it makes: only
    the pits that decide it are sown."""
    count = lambda i: sown_at("g0.pits", "start", i, f"g0.pits[{i}]")
    income = lambda s: f"if(g0.tuz[{s}] < 0, 0, {count(f'({SIDE} * (1 - {s}) + g0.tuz[{s}])')})"
    kazan = lambda s: f"g0.kazans[{s}] + {income(s)} + if(g0.turn = {s}, gain, 0)"
    pit = f"((1 - g0.turn) * {SIDE} + b)"
    # What the other side could move next: its own pits, but for the mover's tuzdyk.
    owned = "if(makes, last % 9, g0.tuz[g0.turn])"
    left = f"exists(sequence(0, {SIDE - 1}), b -> {owned} <> b and not ({pit} = last and gain > 0) and not {_owned('g0', pit)} and {count(pit)} > 0)"
    body = f"named_struct('notation', concat(act + 1, last % {SIDE} + 1, if(makes, 'x', '')), 'captured', int(if(makes, 0, gain)), 'over', greatest({kazan(0)}, {kazan(1)}) >= {WINNING} or not {left})"
    body = let("gain", f"int(if(makes, 3, if(last div {SIDE} = 1 - g0.turn and held % 2 = 0, held, 0)))", body)
    body = let("makes", _makes("g0", "last", "held"), body)
    body = let("held", f"if({_owned('g0', 'last')}, 0, {count('last')})", body)
    body = let("n", "g0.pits[start]", let("last", landing("g0.pits", "start"), body))
    return let("g0", g, let("act", action, let("start", f"g0.turn * {SIDE} + act", body)))


def side_total(g: str, side: int) -> str:
    return f"aggregate(slice({g}.pits, {side * SIDE + 1}, {SIDE}), 0, (s, v) -> s + v)"


def is_over(g: str) -> str:
    return f"(array_max({g}.kazans) >= {WINNING} or size({legal(g)}) = 0)"


def winner(g: str) -> str:
    """0, 1 or -1 for a draw.  Where the side to move is stuck and nobody has won,
    the other side adds the stones on its own side."""
    share = lambda s: f"{g}.kazans[{s}] + if(array_max({g}.kazans) < {WINNING} and {g}.turn = {1 - s} and size({legal(g)}) = 0, {side_total(g, s)}, 0)"
    return let("totals", f"array({share(0)}, {share(1)})", "if(totals[0] > totals[1], 0, if(totals[0] < totals[1], 1, -1))")


def annotated(move: str) -> str:
    """Notation, with + where stones were captured."""
    return f"concat({move}.notation, if({move}.captured > 0, '+', ''))"


#: What a fold keeps per ply.
PLY = "struct<ply:int,action:int,notation:string,captured:int,makes_tuzdyk:boolean,sown:array<int>,before:struct<pits:array<int>,kazans:array<int>,tuz:array<int>,turn:int>,after:struct<pits:array<int>,kazans:array<int>,tuz:array<int>,turn:int>>"


#: Plies between diagrams on a sheet.
DIAGRAM_EVERY = 20
STATE = "struct<pits:array<int>,kazans:array<int>,tuz:array<int>,turn:int>"

#: What a fold of a whole game keeps: its type, and what move m adds.
KEPT = {
    "plies": (PLY, "array(named_struct('ply', s.n + 1, 'action', m.action, 'notation', m.notation, 'captured', m.captured, 'makes_tuzdyk', m.makes_tuzdyk, 'sown', m.sown, 'before', s.state, 'after', m.state))"),
    "moves": ("string", "array(concat(m.notation, if(m.captured > 0, '+', '')))"),
    "boards": (f"struct<ply:int,g:{STATE}>", f"if((s.n + 1) % {DIAGRAM_EVERY} = 0, array(named_struct('ply', s.n + 1, 'g', m.state)), cast(array() as array<struct<ply:int,g:{STATE}>>))"),
}


def opening(keep: str | None = "plies") -> str:
    """What a fold of a game begins with."""
    none = f", '{keep}', cast(array() as array<{KEPT[keep][0]}>)" if keep else ""
    return f"named_struct('state', {START}, 'n', 0{none})"


def playout(choices: str, keep: str | None = "plies", start: str | None = None) -> str:
    """Fold a game: choice c takes legal action number c % n; the game stops when it
    is over.  struct<state, n, plies or moves>; with keep=None only state and n.  With
    `start`, such a struct, the game goes on from there."""
    more = f", '{keep}', concat(s.{keep}, {KEPT[keep][1]})" if keep else ""
    step = let("m", play("s.state", "can[int(pmod(c, size(can)))]"), f"named_struct('state', m.state, 'n', s.n + 1{more})")
    step = f"if(array_max(s.state.kazans) >= {WINNING}, s, {let('can', legal('s.state'), f'if(size(can) = 0, s, {step})')})"
    return f"aggregate({choices}, {start or opening(keep)}, (s, c) -> {step})"


def fits(g: str, move: str) -> str:
    """Whether a move (a trailing + is ignored) is legal as it is written; its first
    character tells the only action that it can be."""
    act = f"try_cast(substring({move}, 1, 1) as int) - 1"
    ok = f"act_ between 0 and {SIDE - 1} and array_contains({legal('g1')}, act_) and {notation('g1', 'act_')} = rtrim('+', {move})"
    return let("g1", g, let("act_", act, f"coalesce({ok}, false)"))


def replay(moves: str) -> str:
    """Fold given notations (a trailing + is ignored): struct<state, stopped, played>;
    stopped is the first move that is not legal as written, else null."""
    played = let("m", play("s.state", "int(substring(t, 1, 1)) - 1"), "named_struct('state', m.state, 'stopped', s.stopped, 'played', concat(s.played, array(%s)))" % annotated("m"))
    step = f"if({fits('s.state', 't')}, {played}, named_struct('state', s.state, 'stopped', t, 'played', s.played))"
    return f"aggregate({moves}, named_struct('state', {START}, 'stopped', cast(null as string), 'played', cast(array() as array<string>)), (s, t) -> if(s.stopped is not null, s, {step}))"


def pgn(moves: str) -> str:
    """`k. white black` lines with a line end after each; no moves give one line end."""
    line = f"transform(sequence(1, int((size({moves}) + 1) div 2)), k -> concat_ws(' ', concat(k, '.'), {moves}[2 * k - 2], get({moves}, 2 * k - 1)))"
    return f"if(size({moves}) = 0, '\\n', concat(array_join({line}, '\\n'), '\\n'))"
