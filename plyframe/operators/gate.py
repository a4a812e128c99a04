"""The request gate: everything a batch is asked with is checked before any page is read.

A request is a row (request, meta_text, games_text, beam_choice, images): one metadata
line `Tournament,Location,Date,Round`, a game line `White,Black,Result,WhiteTime,BlackTime`
per image in order (blank lines do not count; fewer lines than images are fine), the
beam's width as typed, and the ids of its images.  A request has the first of its
errors, by name, or is admitted whole; errors are rows, so other requests go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions import text

from .reading import MOST_IMAGES, beam_width

#: Fields of a metadata line and of a game line, rounds, line ends.
META, GAME, ROUNDS = ["event", "site", "date", "round"], ["white", "black", "result", "white_clock", "black_clock"], (1, 20)
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
ERROR = "struct<code:string,line:int,got:string>"


def _error(code: str, got: Column, line: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(None) if line is None else line).cast("int").alias("line"), got.cast("string").alias("got"))


def padded(fields: Column, names: list[str]) -> Column:
    """Fields by name; those that a short line lacks are empty."""
    return F.struct(*[F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def parsed_meta(line: Column) -> Column:
    """struct<event, site, date, round, error>; the round is normalised (`07` is `7`)."""

    def one(fields: Column) -> Column:
        f = padded(fields, META)
        number = text.whole_number(f["round"])
        error = (
            F.when(text.too_many(fields, len(META)), _error("meta_fields", F.size(fields)))
            .when((f["round"] != "") & number.isNull(), _error("round_not_number", f["round"]))
            .when((f["round"] != "") & ~number.between(*ROUNDS), _error("round_range", number))
        )
        rounds = F.when(f["round"] != "", number.cast("string")).otherwise("")
        return F.struct(f["event"].alias("event"), f["site"].alias("site"), f["date"].alias("date"), rounds.alias("round"), error.alias("error"))

    # The line is cut into fields once, not once for each use of one.
    return F.transform(F.array(text.csv_fields(F.coalesce(line, F.lit("")))), one)[0]


def parsed_games(lines: Column) -> Column:
    """array<struct<white, black, result, white_clock, black_clock, error>> of the lines
    that are not blank; the result is a code (0, 1, -1 or null)."""
    kept = F.filter(F.split(F.coalesce(lines, F.lit("")), LINE_ENDS), lambda x: ~x.rlike(r"^\s*$"))

    def one(fields: Column, i: Column) -> Column:
        f = padded(fields, GAME)
        error = F.when(text.too_many(fields, len(GAME)), _error("game_fields", F.size(fields), i + 1)).when(~text.result_is_valid(f["result"]), _error("game_result", f["result"], i + 1))
        return F.struct(*[(text.result_code(f[n]) if n == "result" else f[n]).alias(n) for n in GAME], error.alias("error"))

    return F.transform(F.transform(kept, text.csv_fields), one)


def checked(requests: DataFrame) -> DataFrame:
    """request, images, meta, games, width and the first error (code, line, got) or null."""
    parsed = F.struct(parsed_meta(F.col("meta_text")).alias("meta"), parsed_games(F.col("games_text")).alias("games"), beam_width(F.col("beam_choice")).alias("width"))
    # An array of one: filters on the error stay above it, and nothing is parsed twice.
    rows = requests.select("request", "images", F.explode_outer(F.array(parsed)).alias("_c")).select("request", "images", "_c.*")
    n = F.when(F.col("images").isNull(), 0).otherwise(F.size("images"))
    error = (
        F.when(n < 1, _error("no_images", n))
        .when(n > MOST_IMAGES, _error("too_many_images", n))
        .when(F.col("meta.error").isNotNull(), F.col("meta.error"))
        .when(F.size("games") > n, _error("game_lines", F.size("games")))
        .otherwise(F.get(F.filter(F.col("games.error"), lambda e: e.isNotNull()), F.lit(0)))
    )
    return rows.withColumn("error", error)


def refused(requests: DataFrame) -> DataFrame:
    """request, code, line and got of the requests that are not begun."""
    return checked(requests).filter("error is not null").select("request", "error.*")


def admitted(requests: DataFrame) -> DataFrame:
    """A row for each image of the requests without an error: request, n (from 1), sheet,
    name (of its files), width, result and tags."""
    # posexplode_outer: the array's size is not asked for below the parsing.
    rows = checked(requests).filter("error is null").select("request", "meta", "games", "width", F.posexplode_outer("images").alias("i", "sheet"))
    game = lambda n: F.coalesce(F.get(F.col(f"games.{n}"), F.col("i")), F.lit(None if n == "result" else ""))
    rows = rows.withColumn("game", F.struct(*[game(n).alias(n) for n in GAME]))
    round_ = text.slug(F.col("meta.round"))
    name = F.concat(F.when(round_ != "", F.concat(F.lit("round"), round_, F.lit("_"))).otherwise(""), F.lit("game"), F.col("i") + 1)
    return rows.select("request", (F.col("i") + 1).alias("n"), "sheet", name.alias("name"), "width", F.col("game.result").alias("result"), text.pgn_tags(F.col("meta"), F.col("game")).alias("tags"))
