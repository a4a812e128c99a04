"""From class distributions of a sheet's cells to its games: one row per sheet.

Cells of a sheet are dealt once, in game order (a sheet has some hundred and sixty), and
whole sheets are replayed and decoded in Arrow batches, many games at a ply (`batches`).
`readable` and `strict_replay` say the same as expressions over one row of a sheet.

cells: sheet, move_no, side ('W' or 'B'), ink, p (move classes).
diagrams: sheet, move_no, kind ('kazan' or 'pit'), side, pit_index (1-9), ink, p
(diagram classes).  results: sheet, result (0, 1, -1 or null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.functions import prob, rules
from plyframe.functions.rules import let

from . import batches, decode
from .metrics import has_ink

#: Least ink of a cell with a move, alternatives kept a ply.
MIN_INK, TOP = "0.02D", 5
_MIN_INK = float(MIN_INK.rstrip("D"))

#: Names of the classes by index.
MOVE_NAME = "if(i_ = 162, 'empty', concat(int(i_ div 18) + 1, int(i_ div 2) % 9 + 1, if(i_ % 2 = 1, 'x', '')))"
DIAGRAM_NAME = "case i_ when 82 then 'x' when 83 then '-' when 84 then 'empty' else string(i_) end"

STOPPED = "struct<move:int,side:string,reason:string,winner:string>"
RECORD = "struct<move:int,side:string,raw:string,raw_is_legal:boolean,legal:array<string>,top5:array<struct<class:string,p:double>>,alternatives:array<struct<notation:string,p:double>>>"


def readable(cells: DataFrame) -> DataFrame:
    """F2, 2.6: sheet and its plies before the first cell that is blank (little ink, or
    `empty` its likeliest class), with that cell's place (blank, null if none)."""
    rows = cells.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("move_no", (F.col("side") != "W").alias("black"), "side", "ink", "p"))).alias("all"))
    stop = F.expr(f"array_position(transform(all, c -> c.ink < {MIN_INK} or {prob.argmax('c.p')} = {prob.EMPTY_MOVE}), true)")
    found = rows.withColumn("stop", stop)
    return found.select("sheet", F.expr("if(stop = 0, all, slice(all, 1, int(stop) - 1))").alias("plies"), F.expr("if(stop = 0, null, all[int(stop) - 1])").alias("blank"))


def _record() -> str:
    """What is kept of ply c with raw read `raw` before state s.state."""
    top = let("t_", prob.topk("c.p", TOP), f"transform(t_, t -> named_struct('class', {let('i_', 't.i', MOVE_NAME)}, 'p', round(-t.np, 4)))")
    alternatives = f"array_sort(transform(can_, (t, k) -> named_struct('np', -round(c.p[{decode.class_index('t')}], 4), 'k', k, 't', t)))"
    return (
        "named_struct('move', c.move_no, 'side', c.side, 'raw', raw, 'raw_is_legal', if(s.in_sync, ok, null), 'legal', if(s.in_sync, can_, cast(array() as array<string>)), "
        f"'top5', {top}, 'alternatives', if(s.in_sync and not ok, transform({alternatives}, x -> named_struct('notation', x.t, 'p', -x.np)), null))"
    )


def strict_replay(plies: str) -> str:
    """struct<state, in_sync, stopped, raw, legal, records>: raw reads are
    played while they are legal as written.  The first that is not ends that, with
    its alternatives; later plies keep their raw text.  So does the end of the game."""
    won = f"element_at(array('P1', 'P2', 'draw'), if({rules.winner('m.state')} < 0, 3, {rules.winner('m.state')} + 1))"
    why = f"named_struct('move', c.move_no, 'side', c.side, 'reason', {{}}, 'winner', {{}})"
    ended = why.format("'game over'", won)
    fits = let(
        "m",
        rules.play("s.state", "int(substring(raw, 1, 1)) - 1"),
        let(
            "over_",
            rules.is_over("m.state"),
            f"named_struct('state', m.state, 'in_sync', not over_, 'stopped', if(over_, {ended}, s.stopped), 'raw', concat(s.raw, array({rules.annotated('m')})), 'legal', concat(s.legal, array({rules.annotated('m')})), 'records', concat(s.records, array(rec)))",
        ),
    )
    broken = why.format("concat('illegal move ', raw)", "cast(null as string)")
    other = f"named_struct('state', s.state, 'in_sync', false, 'stopped', if(s.in_sync and s.stopped is null, {broken}, s.stopped), 'raw', concat(s.raw, array(raw)), 'legal', s.legal, 'records', concat(s.records, array(rec)))"
    step = let("rec", _record(), f"if(ok and s.in_sync, {fits}, {other})")
    step = let("ok", "array_contains(can_, raw)", step)
    step = let("can_", f"if(s.in_sync, array_sort({rules.notations('s.state')}), cast(array() as array<string>))", step)
    step = let("raw", let("i_", prob.argmax(prob.masked("c.p", f"i <> {prob.EMPTY_MOVE}")), MOVE_NAME), step)
    start = f"named_struct('state', {rules.START}, 'in_sync', true, 'stopped', cast(null as {STOPPED}), 'raw', cast(array() as array<string>), 'legal', cast(array() as array<string>), 'records', cast(array() as array<{RECORD}>))"
    return f"aggregate({plies}, {start}, (s, c) -> {step})"


def _placed(diagrams: DataFrame) -> DataFrame:
    """The cells with ink and their place k."""
    player = F.when(F.col("side") == "W", 0).otherwise(1)
    k = F.when(F.col("kind") == "kazan", player + 18).otherwise(player * 9 + F.col("pit_index") - 1).cast("int")
    return diagrams.filter(has_ink(F.col("kind"), F.col("ink"))).withColumn("k", k)


def checkpoints(diagrams: DataFrame) -> DataFrame:
    """Sheet, ply (twice the move number), k (0-17 pits, 18 and 19
    kazans), d (the distribution over what the cell may say), read and prob; cells
    that are blank or say nothing are left out."""
    seen = _placed(diagrams).filter(F.expr(f"{prob.argmax('p')} <> {prob.DIAGRAM_CLASSES - 1}"))
    rows = seen.withColumn("d", F.expr(decode.diagram_filter("k", "p"))).filter("d is not null")
    return rows.select("sheet", "move_no", (F.col("move_no") * 2).alias("ply"), "kind", "side", "pit_index", "k", "d", F.expr(let("i_", prob.argmax("d"), DIAGRAM_NAME)).alias("read"), F.round(F.array_max("d"), 4).alias("prob"))


def replayed(cells: DataFrame, p: str | batches.Made = "p", beside: DataFrame | None = None) -> DataFrame:
    """Sheet, raw (the record as read, annotated where legal), legal_plies and
    records of the strict replay."""
    return batches.read_batches(cells, p=p, width=None, min_ink=_MIN_INK, beside=beside).select("sheet", "raw", "legal_plies", "records")


def read_sheets(cells: DataFrame, diagrams: DataFrame | None = None, results: DataFrame | None = None, width: int = 1024, per_ply: int = 9, p: str | batches.Made = "p", d: str | batches.Made = "p", records: bool = True, beside: DataFrame | None = None) -> DataFrame:
    """One row per sheet: raw_pgn, legal_pgn, beam_pgn, plies_scanned, legal_plies,
    beam_plies, stopped, log_prob, beam_detail, agreed_plies, checkpoint_report, warnings
    and records (left null where they are not asked for).  `results` may have a column
    width, which then goes for its sheet.  `p` (of cells) and `d` (of diagrams) may be
    functions that make distributions from other columns, which then are moved instead;
    `beside` as in batches.read_batches."""
    seen = None if diagrams is None else _placed(diagrams).withColumn("ply", F.col("move_no") * 2)
    done = batches.read_batches(cells, seen, results, p, d, width, per_ply, records=records, min_ink=_MIN_INK, beside=beside)
    capped = decode.beam_cap(F.col("asked"), F.lit(per_ply))
    trimmed = F.when(capped < F.col("asked"), F.concat(F.lit("beam width "), F.col("asked").cast("string"), F.lit(" trimmed to "), capped.cast("string"), F.lit(" to stay inside the memory budget")))
    return done.select(
        "sheet",
        F.expr(rules.pgn("raw")).alias("raw_pgn"),
        F.expr(rules.pgn("slice(raw, 1, legal_plies)")).alias("legal_pgn"),
        F.expr(rules.pgn("moves")).alias("beam_pgn"),
        "plies_scanned",
        "legal_plies",
        F.size("moves").alias("beam_plies"),
        "stopped",
        F.round("logp", 3).alias("log_prob"),
        "beam_detail",
        "agreed_plies",
        F.col("report").alias("checkpoint_report"),
        F.array_compact(F.array(trimmed)).alias("warnings"),
        "records",
    )


def game_json(sheets: DataFrame) -> DataFrame:
    """Sheet and its document."""
    beam = F.struct(F.col("beam_plies").alias("plies"), "log_prob", F.col("beam_detail").alias("moves"))
    return sheets.select("sheet", F.to_json(F.struct("plies_scanned", "legal_plies", beam.alias("beam"), F.col("checkpoint_report").alias("checkpoints"), "stopped", "warnings", F.col("records").alias("plies"))).alias("json"))


def batch(images: DataFrame, games: DataFrame, sheets: DataFrame) -> DataFrame:
    """Images (batch, n, sheet) with their game lines (batch, n, white, black,
    error) and read sheets.  An image without a sheet is an error row and the others
    go on; lines missing are blank; a line without an image is an error of its own."""
    rows = images.join(games, ["batch", "n"], "full").join(sheets, "sheet", "left")
    said = F.concat(F.col("stopped.reason"), F.coalesce(F.concat(F.lit(" "), F.col("stopped.winner")), F.lit("")))
    return rows.select(
        "batch",
        "n",
        F.coalesce("white", F.lit("")).alias("white"),
        F.coalesce("black", F.lit("")).alias("black"),
        F.when(F.col("sheet").isNull(), "more game lines than images").when(F.col("error").isNotNull(), F.col("error")).when(F.col("beam_pgn").isNull(), "no cells were found").alias("error"),
        F.col("legal_plies").cast("long").alias("legal_plies"),
        said.alias("stopped"),
        "beam_pgn",
    )


